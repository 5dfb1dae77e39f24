"""Operators for large training-data pipelines.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames; ``entries()`` gives the registered ``opN_<name>`` queries.
"""

from __future__ import annotations


def entries():
    """(queries, oracle SQL) of the operators, without the pipeline."""
    from . import queries

    return queries.QUERIES, queries.ORACLE_SQL
