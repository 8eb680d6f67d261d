"""Query registry: a Spark plan over the views and, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gradeloom.plans.views import VIEWS, Views, needed, open_views

QUERIES: dict[str, Callable[[Views], DataFrame]] = {}
SQL: dict[str, str] = {}
IDS: dict[str, str] = {}
# Sub-queries shared by oracles only; no Spark plan reads them.
SHARED: dict[str, str] = {}


def query(name: str, ids: str, sql: str | None = None):
    def register(build: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = build
        IDS[name] = ids
        if sql is not None:
            SQL[name] = sql
        return build

    return register


def widen(df: DataFrame, *columns: str) -> DataFrame:
    """Given columns as BIGINT, the type their SQL has."""
    return df.withColumns({name: df[name].cast("bigint") for name in columns})


def placed(df: DataFrame, *group: str) -> DataFrame:
    """Rows of an ordered frame with their place within a group, as the frame gives them out."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    numbered = df.withColumn("_at", F.monotonically_increasing_id())
    return numbered.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy("_at")).cast("bigint")).drop("_at")


def bound(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: QUERIES[name](open_views(spark, folder).fresh())


def oracle(name: str) -> str:
    definitions = {**VIEWS, **SHARED}
    parts = [f"{used} AS ({definitions[used].strip()})" for used in needed(SQL[name], definitions)]
    body = SQL[name].strip()
    if not parts:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + body[15:]
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body
