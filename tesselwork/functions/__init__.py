"""Column functions: paths and keys, chunk grids, byte ranges, locations, identifiers."""
