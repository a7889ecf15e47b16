"""Column functions, usable from Python and from SQL."""
