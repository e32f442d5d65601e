"""Whole queries over the driver's tables, built from the operators."""
