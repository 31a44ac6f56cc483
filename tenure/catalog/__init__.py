"""Named queries over the retail tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    oracle: str | None


REGISTRY: dict[str, Entry] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        if name in REGISTRY:
            raise KeyError(name)
        REGISTRY[name] = Entry(fn, oracle)
        return fn

    return keep
