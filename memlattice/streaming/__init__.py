"""streaming of memlattice."""
