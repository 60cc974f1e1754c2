"""Registered queries: a name, the operator ids it covers, a Spark plan and its SQL twin."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from squallframe.tables import VIEW_SQL, Tables


@dataclass(frozen=True)
class Entry:
    name: str
    covers: str
    build: Callable[[Tables], DataFrame]
    oracle: str | None


REGISTRY: dict[str, Entry] = {}


def sql(views: str, body: str) -> str:
    """One statement: the named views as CTEs, then ``body`` (further CTEs and a SELECT, or a SELECT)."""
    ctes = [f"{v} AS ({VIEW_SQL[v]})" for v in views.split()]
    body = body.strip()
    if body[:6].upper() == "SELECT":
        return (f"WITH {', '.join(ctes)} " if ctes else "") + body
    return "WITH " + ", ".join([*ctes, body])


def query(name: str, covers: str, oracle: str | None = None):
    def keep(build: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name!r} registered twice")
        REGISTRY[name] = Entry(name, covers, build, oracle)
        return build

    return keep


def r6(col: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(col) if isinstance(col, str) else col, digits)
