"""Registered queries: Spark builder + oracle SQL + output types.

Each entry builds a lazy DataFrame from the driver's tables (through the
adapter) and states its output columns with one type list. The Spark side
is cast to that list (`typed`) and the oracle SQL is wrapped in the same
casts (`oracle.with_types`), so both engines hand back identical types.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.plans import oracle as O
from shelfspark.sources import adapter as A

Builder = Callable[[SparkSession, str], DataFrame]

_SPARK_TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DATE": "date",
                "DOUBLE": "double", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz"}


def spark_type(duck: str) -> str:
    return _SPARK_TYPES.get(duck, duck.lower())


def typed(df: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    return df.select([F.col(c).cast(spark_type(t)).alias(c) for c, t in columns])


@dataclass
class QuerySpec:
    build: Builder
    columns: list[tuple[str, str]]
    oracle_body: str | None = None  # None: no SQL twin (rows-only check)
    extra_ctes: str = ""
    notes: str = ""
    tags: list[str] = field(default_factory=list)

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return typed(self.build(spark, sf_dir), self.columns)

    def oracle(self) -> str | None:
        if self.oracle_body is None:
            return None
        return O.with_types(self.oracle_body, self.columns, self.extra_ctes)


REGISTRY: dict[str, QuerySpec] = {}


def register(name: str, columns: list[tuple[str, str]], oracle_body: str | None = None,
             extra_ctes: str = "", notes: str = ""):
    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = QuerySpec(fn, columns, oracle_body, extra_ctes, notes)
        return fn

    return deco


AS_OF: dt.date = A.AS_OF
AS_OF_SQL = O.AS_OF_SQL
M2 = "DECIMAL(10,2)"
MS = "DECIMAL(38,2)"
MA = "DECIMAL(18,2)"

# Importing the query modules fills REGISTRY.
from shelfspark.plans import q_access, q_io, q_ledger, q_more, q_raw, q_reports, q_stream  # noqa: E402,F401
