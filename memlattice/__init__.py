"""memlattice: sparse-matrix and cache-behaviour analytics on PySpark DataFrames."""
