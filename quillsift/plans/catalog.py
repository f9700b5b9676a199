"""Registry of the named queries and their DuckDB counterparts."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLE[name] = oracle
        return fn

    return wrap


from . import messages, events  # noqa: E402, F401  the queries register themselves
