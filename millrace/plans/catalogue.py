"""All queries of the core over the test tables, by name, and their SQL."""

from __future__ import annotations

from millrace.plans import jobruns, logs, order, shared, words

QUERIES = {**words.QUERIES, **order.QUERIES, **logs.QUERIES, **shared.QUERIES, **jobruns.QUERIES}
SQL = {**words.SQL, **order.SQL, **logs.SQL, **shared.SQL, **jobruns.SQL}
