"""Typed batch sources and sinks: Parquet, delimited text, record text, fixed-width binary, ranked lists, JSON."""
