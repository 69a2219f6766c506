"""Operators on session events, transcripts and documents for training data.

Nothing outside this package imports it.
"""
