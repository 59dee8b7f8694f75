"""sources of memlattice."""
