"""Registration of queries with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from .sources import orders


def register(into: dict, sql: str | None = None, *, prefix: str = orders.SQL):
    """Decorator: name -> (function, SQL). The relations matrix, cells and genes precede the SQL."""

    def add(f: Callable):
        into[f.__name__] = (f, None if sql is None else f"WITH {prefix}{',' if sql.lstrip().startswith('+') else ''} {sql.lstrip().removeprefix('+')}" if prefix else sql)
        return f

    return add
