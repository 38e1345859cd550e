"""Registered queries and, by the same names, the SQL that must give the same rows."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: The hashed order of a key in SQL.
H = "CAST(('0x' || substr(md5(CAST({k} AS VARCHAR) || '42'), 1, 8)) AS BIGINT)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add
