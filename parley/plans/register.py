"""How queries are registered with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from parley.sources import catalog


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracle: dict[str, str] = {}

    def query(self, sql: str | None = None, *views: str) -> Callable:
        """Register a function of (spark, sf_dir) under its name, with SQL over the named views.

        SQL that begins with ``CTE`` goes on with more common table expressions.
        """

        def add(f: Callable) -> Callable:
            self.queries[f.__name__] = f
            if sql is not None:
                body = sql.strip()
                if views:
                    more = body.startswith("CTE ")
                    body = f"{catalog.with_views(*views)}{', ' if more else ' '}{body.removeprefix('CTE ')}"
                self.oracle[f.__name__] = body
            return f

        return add
