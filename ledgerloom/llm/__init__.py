"""Operators over text corpora: counting, splitting, cleaning, grouping, encoding and mixing.

Nothing outside this package imports it. ``all_queries()`` and ``all_sql()``
add its entries to the driver contract.
"""

from __future__ import annotations


def all_queries():
    from ledgerloom.llm.queries import QUERIES

    return dict(QUERIES)


def all_sql():
    from ledgerloom.llm.oracle import ORACLE

    return dict(ORACLE)
