"""Registry of the workload's queries and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .adapter import Chat, chat
from .oracle import PREFIX


@dataclass(frozen=True)
class Query:
    name: str
    covers: str
    build: Callable[[Chat], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(chat(spark, sf_dir))

    @property
    def oracle(self) -> str | None:
        return None if self.sql is None else PREFIX + self.sql


CATALOG: dict[str, Query] = {}


def query(covers: str, sql: str | None = None):
    """Register a function (Chat -> DataFrame) under its own name; ``covers`` lists the
    inventory ids it stands for."""

    def register(build: Callable[[Chat], DataFrame]):
        name = build.__name__
        if name in CATALOG:
            raise ValueError(f"two queries named {name}")
        CATALOG[name] = Query(name, covers, build, sql)
        return build

    return register


def instant_text(ts: Column | str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def joined(values: Column | str) -> Column:
    """A list as sorted text, for comparison."""
    return F.array_join(F.sort_array(values), "|")
