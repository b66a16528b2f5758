"""Operators on candles, factor panels and their evaluation."""
