"""plans of memlattice."""
