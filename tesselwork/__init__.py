"""Versioned N-dimensional array catalogues as Spark tables and plans."""
