"""Operators on sequences, intervals, matrices, graphs, hierarchies and result tables."""
