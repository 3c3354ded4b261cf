"""Reading tables, and keyed tables that grow by appended parts.

What a batch says about a key is a part row, and part rows of a key fold into one: the fold
is associative, so a table is the fold of its parts, whoever computed them and in whatever
groups. A batch only ever appends its own part, under a folder named by its number, which a
replay replaces; nothing stored is read or rewritten for it. Readers fold base and parts by
key; compaction folds the older parts into a new base now and then.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, name: str, schema: T.StructType | None = None) -> DataFrame:
    """A catalog table by name, or parquet files by path."""
    if "/" not in name:
        return spark.table(name)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(name)


class PartsTable:
    """Part rows by key, with the fold that makes one of many and the view of a folded row."""

    def __init__(
        self, spark: SparkSession, path: str, schema: str,
        fold: Callable[[DataFrame], DataFrame], view: Callable[[DataFrame], DataFrame],
    ) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.fold, self.view = fold, view

    def put(self, rows: DataFrame, batch: int) -> DataFrame:
        """Store a batch's part rows; returns them as stored."""
        names = T.StructType.fromDDL(self.schema).fieldNames()
        at = f"{self.path}/parts/batch={batch}"
        rows.select(*names).write.mode("overwrite").parquet(at)
        return self.spark.read.schema(self.schema).parquet(at)

    def _stored(self, kind: str, number: str) -> DataFrame | None:
        try:
            return self.spark.read.schema(f"{self.schema}, {number} bigint").parquet(f"{self.path}/{kind}")
        except AnalysisException as problem:
            if problem.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def parts(self, before: int | None = None) -> DataFrame:
        """The part rows that make the table, or made it before a batch. Only the newest base
        and later parts are read; both are chosen by folder."""
        base, parts = self._stored("base", "upto"), self._stored("parts", "batch")
        found = self.spark.createDataFrame([], self.schema)
        upto = None
        if base is not None:
            bases = base.select("upto").distinct() if before is None else base.select("upto").distinct().filter(F.col("upto") < before)
            upto = bases.agg(F.max("upto")).first()[0]
            if upto is not None:
                found = base.filter(F.col("upto") == upto).drop("upto")
        if parts is not None:
            if upto is not None:
                parts = parts.filter(F.col("batch") > upto)
            if before is not None:
                parts = parts.filter(F.col("batch") < before)
            found = found.unionByName(parts.drop("batch"))
        return found

    def read(self, before: int | None = None) -> DataFrame:
        return self.view(self.fold(self.parts(before)))

    def compact(self, upto: int) -> None:
        """Fold all parts up to a finished batch into a base. Older files may be deleted once
        no reader needs them."""
        self.fold(self.parts(before=upto + 1)).write.mode("overwrite").parquet(f"{self.path}/base/upto={upto}")


def append_events(events: DataFrame, path: str) -> None:
    """Append refusal events; ids are made at write time."""
    events.withColumn("id", F.expr("uuid()")).select(
        "id", "occurred_at", "domain", "start_url_id", "source_url", "posting_url", "stage", "reason", "detail"
    ).write.mode("append").parquet(path)
