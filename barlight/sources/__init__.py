"""Readers, writers, layout and replay of recorded exchange data."""
