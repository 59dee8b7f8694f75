"""operators of memlattice."""
