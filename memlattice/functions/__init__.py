"""functions of memlattice."""
