"""Operators for streams of events."""
