"""Column functions: intervals, times, identifiers and series windows."""
