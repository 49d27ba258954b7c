"""Queries and oracle SQL of all operators of this subpackage."""

from . import answer_defects, containers, encoding, format_variants, grouped_split, lookalikes, mixture, pieces, split_overlap, target_sample

_MODULES = (format_variants, split_overlap, pieces, grouped_split, lookalikes, target_sample, answer_defects, containers, mixture, encoding)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
