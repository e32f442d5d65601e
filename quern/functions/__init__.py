"""Column functions: vectors, weighted sets, spectra-like peak lists, scores."""
