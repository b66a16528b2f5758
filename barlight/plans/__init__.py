"""Whole runs: stages, reports and the query catalogue."""
