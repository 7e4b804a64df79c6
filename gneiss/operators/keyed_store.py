"""Stored tables by key: rows are put and removed by key, in buckets that are rewritten beside what readers have and published together."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from gneiss.operators.generations import Pointer, VerificationError, current, new_generation, publish
from gneiss.shared import written

BUCKETS = 64


@dataclass(frozen=True)
class KeyedStore:
    """A table of schema in root with one row for each key, whose rows are bucketed by the columns of by (by default the key)."""

    root: str
    schema: StructType
    keys: tuple[str, ...]
    by: tuple[str, ...] = field(default=())
    buckets: int = BUCKETS

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*(self.by or self.keys)), F.lit(self.buckets)).cast("int")

    def _read(self, spark: SparkSession, parts: dict[str, str], of: set[str] | None = None) -> DataFrame:
        paths = [f"{self.root}/{g}/bucket={b}" for b, g in sorted(parts.items()) if of is None or b in of]
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)

    def read(self, spark: SparkSession) -> DataFrame:
        """What is published; no rows before anything is."""
        return self._read(spark, current(spark, self.root).parts)

    def put(self, rows: DataFrame) -> None:
        """Puts rows in the place of those of equal key. Two rows of one key raise VerificationError, a null in a key ValueError, and nothing is published."""
        rows = written(rows.select(*self.schema.names), "put")
        if not rows.where(" OR ".join(f"`{k}` IS NULL" for k in self.keys)).isEmpty():
            raise ValueError("a key must not be null")
        self._rewrite(rows.sparkSession, rows.select(*{*self.keys, *self.by}), rows)

    def remove(self, keys: DataFrame) -> None:
        """Removes the rows whose key is among keys (the key's and by's columns)."""
        self._rewrite(keys.sparkSession, written(keys.select(*{*self.keys, *self.by}).distinct(), "remove"), None)

    def _rewrite(self, spark: SparkSession, changed: DataFrame, fresh: DataFrame | None) -> None:
        begun, generation = current(spark, self.root), new_generation()
        touched = {str(r[0]) for r in changed.select(self.bucket()).distinct().collect()}  # as many as buckets at most
        if fresh is None:
            touched &= set(begun.parts)
        if not touched:
            return
        rows = self._read(spark, begun.parts, touched).join(changed.select(*self.keys).distinct(), list(self.keys), "left_anti").select(*self.schema.names)
        rows = rows if fresh is None else rows.unionByName(fresh)
        dealt = rows.withColumn("bucket", self.bucket()).hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", *self.keys)
        dealt.write.partitionBy("bucket").parquet(f"{self.root}/{generation}")
        whole = StructType([*self.schema.fields]).add("bucket", "integer")
        left = {str(r[0]) for r in spark.read.schema(whole).parquet(f"{self.root}/{generation}").select("bucket").distinct().collect()}
        staged = self._read(spark, dict.fromkeys(left, generation))
        if not staged.groupBy(*self.keys).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            raise VerificationError(f"{self.root}: rows of one key")
        kept = {b: g for b, g in begun.parts.items() if b not in touched}
        publish(spark, self.root, begun, Pointer(generation=generation, parts=kept | dict.fromkeys(left, generation), facts=begun.facts))


def store(root: str, schema: StructType, keys: Sequence[str], by: Sequence[str] = (), buckets: int = BUCKETS) -> KeyedStore:
    return KeyedStore(root.rstrip("/"), schema, tuple(keys), tuple(by), buckets)
