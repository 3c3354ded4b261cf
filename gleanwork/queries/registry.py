"""The registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanwork.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with the SQL it is checked against where SQL can say it."""

    def register(build: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(configure(spark), sf_dir)

        run.__name__ = build.__name__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A driver table, its zone-less timestamps read as UTC.

    The given tables are one file each, which one core would read alone. With `spread`,
    meant for costly work per row, a table of fewer files than cores is dealt out to all of
    them; a table of many files is left as it is.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if spread and len(df.inputFiles()) < cores:
        df = df.repartition(cores)
    zoneless = [f.name for f in df.schema if f.dataType.simpleString() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df


def text(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def sql_text(at: str) -> str:
    return f"strftime({at}, '%Y-%m-%d %H:%M:%S.%f')"


def as_uuid(hexadecimal: str) -> str:
    """SQL turning 32 hex digits into UUID text."""
    return f"regexp_replace({hexadecimal}, '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')"


def uuid_text(hexadecimal: Column) -> Column:
    return F.regexp_replace(hexadecimal, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
