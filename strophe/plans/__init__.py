"""Queries that apply the operators to whole tables, with SQL that gives the same rows."""

from . import alignment, encoding, evolution, files, grammars, graphs, hierarchies, kernels, matrices, measures, patterns, relations, statistics, structures, translations
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "alignment", "encoding", "evolution", "files", "grammars", "graphs", "hierarchies", "kernels", "matrices", "measures", "patterns", "relations", "statistics", "structures", "translations"]
