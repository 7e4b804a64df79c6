"""Tabular analytics, read-only SQL, catalog rules and table maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import NumericType

from gneiss.operators.readonly import UnsupportedQueryError, select_only
from gneiss.shared import written

__all__ = [
    "ADMIN_ROLES", "OPERATIONS", "ColumnNotFoundError", "UnsupportedOperationError", "UnsupportedQueryError", "analyse", "cached_answers", "describe", "fresh_entries", "latest", "may_use", "not_yet",
    "register_tables", "scope", "select_only", "shared_content", "stale", "upsert", "visible", "visible_counts",
]

OPERATIONS = ("count", "columns", "shape", "describe", "sum", "mean", "min", "max", "top_n", "bottom_n")
ADMIN_ROLES = ("admin", "knowledge_admin")


class ColumnNotFoundError(ValueError):
    """A column that the table doesn't have."""


class UnsupportedOperationError(ValueError):
    """An operation that isn't one of OPERATIONS."""


def _number(column: str) -> Column:
    value = F.col(f"`{column}`").cast("double")
    return F.when(~F.isnan(value), value)


def analyse(df: DataFrame, operation: str, column: str | None = None, n: int = 5) -> DataFrame:
    """One of OPERATIONS, in any case, as a DataFrame: single figures as one row named by the operation. NaN counts as missing; the sum of nothing is 0.

    top_n and bottom_n give whole rows by column, missing last; of equal ones those whose other columns come first.
    """
    op = operation.lower()
    if op not in OPERATIONS:
        raise UnsupportedOperationError(f"{operation!r} isn't one of {', '.join(OPERATIONS)}")
    if column is not None and column not in df.columns:
        raise ColumnNotFoundError(column)
    if column is None and op in ("sum", "mean", "min", "max", "top_n", "bottom_n"):
        raise ColumnNotFoundError(f"{op} needs a column")
    if op == "count":
        return df.agg(F.count("*").alias("count"))
    if op == "columns":
        return df.sparkSession.createDataFrame([(k, c) for k, c in enumerate(df.columns)], "position int, name string")
    if op == "shape":
        return df.agg(F.count("*").alias("rows"), F.lit(len(df.columns)).cast("long").alias("columns"))
    if op == "describe":
        return describe(df)
    if op in ("top_n", "bottom_n"):
        order = F.col(f"`{column}`").desc_nulls_last() if op == "top_n" else F.col(f"`{column}`").asc_nulls_last()
        return df.orderBy(order, *[F.col(f"`{c}`") for c in df.columns if c != column]).limit(n)
    value = _number(column)
    return df.agg({"sum": F.coalesce(F.sum(value), F.lit(0.0)), "mean": F.avg(value), "min": F.min(value), "max": F.max(value)}[op].alias(op))


def describe(df: DataFrame) -> DataFrame:
    """(column, count, mean, std, min, p25, p50, p75, max) of the numeric columns; quartiles are exact, between ranks by line.

    Values are counted, dealt to ranges by column and value, and numbered within their range; a range's first rank is the sum of the
    ranges before it, of which there are as many as shuffle partitions. So no task holds a column, and a value that repeats is one row.
    """
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, count long, mean double, std double, min double, p25 double, p50 double, p75 double, max double")
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), _number(c).alias("v")) for c in names])).alias("x")).select("x.column", "x.v")
    figures = long.groupBy("column").agg(F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    counted = long.where("v is not null").groupBy("column", "v").agg(F.count("*").alias("n"))
    dealt = written(counted.repartitionByRange("column", "v").withColumn("part", F.spark_partition_id()), "describe")
    parts = dealt.groupBy("column", "part").agg(F.sum("n").alias("whole"))
    before = Window.partitionBy("column").orderBy("part")
    parts = parts.select("column", "part", (F.sum("whole").over(before) - F.col("whole")).alias("before"), F.sum("whole").over(Window.partitionBy("column")).alias("total"))
    upto = F.sum("n").over(Window.partitionBy("column", "part").orderBy("v"))
    ranked = dealt.withColumn("upto", upto).join(parts, ["column", "part"]).withColumn("last", F.col("before") + F.col("upto") - 1).withColumn("first", F.col("last") - F.col("n") + 1)
    out = []
    for name, share in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)):
        place = F.lit(share) * (F.col("total") - 1)
        at = lambda rank: F.max(F.when((F.col("first") <= rank) & (rank <= F.col("last")), F.col("v")))
        low, high = at(F.floor(place)), at(F.ceil(place))
        part = F.max(place - F.floor(place))
        out.append(F.when(part == 0, low).otherwise((1 - part) * low + part * high).alias(name))
    quartiles = ranked.groupBy("column").agg(*out)
    return figures.join(quartiles, "column", "left").select("column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def register_tables(spark: SparkSession, folder: str, names: list[str]) -> None:
    for name in names:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)


def scope(role: Column, own: Column, requested: Column) -> Column:
    """The departments that a user may ask for: all for admin roles; the own one where nothing, all or it is requested; else none."""
    none = requested.isNull() | (F.size(requested) == 0)
    return (
        F.when(role.isin(*ADMIN_ROLES), F.array(F.lit("*")))
        .when(none | F.array_contains(requested, "*") | F.array_contains(requested, own), F.array(own))
        .otherwise(F.array().cast("array<string>"))
    )


def may_use(permissions: Column, tool: Column) -> Column:
    return F.array_contains(permissions, "*") | F.array_contains(permissions, tool)


def visible(documents: DataFrame, users: DataFrame) -> DataFrame:
    """(user_id, document columns) that each user may read: those of the own tenant and, without an admin role, of the own department."""
    own = users.select("user_id", F.col("tenant_id").alias("user_tenant"), F.col("department").alias("user_department"), "role")
    found = documents.join(own, F.col("tenant_id") == F.col("user_tenant"))
    found = found.where(F.col("role").isin(*ADMIN_ROLES) | (F.col("department") == F.col("user_department")))
    return found.select("user_id", *documents.columns)


def visible_counts(documents: DataFrame, users: DataFrame) -> DataFrame:
    """(user_id, n) of users that may read any documents: as many as visible gives, counted by tenant and department before the users are joined."""
    counted = documents.groupBy("tenant_id", "department").agg(F.count("*").alias("n"))
    return visible(counted, users).groupBy("user_id").agg(F.sum("n").alias("n"))


def latest(versions: DataFrame, keys: list[str], version: str, *tie: str) -> DataFrame:
    """The row of each key with the highest version."""
    order = Window.partitionBy(*keys).orderBy(F.col(version).desc(), *tie)
    return versions.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def upsert(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """stored with the rows of fresh in place of those of equal key; of fresh rows of one key, one."""
    return stored.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh.dropDuplicates([key]))


def stale(stored: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """The stored rows whose key isn't current."""
    return stored.join(current.select(key).distinct(), key, "left_anti")


def not_yet(found: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that a batch still has to process."""
    return found.join(done.select(*keys).distinct(), keys, "left_anti")


def shared_content(documents: DataFrame, digest: str, path: str) -> DataFrame:
    """(digest, path, n): every path of a content that more than one has, n being their number. A content's paths are never gathered."""
    counts = documents.groupBy(digest).agg(F.count("*").alias("n")).where("n > 1")
    return documents.select(digest, path).join(counts, digest)


def cached_answers(queries: DataFrame, cache: DataFrame, scores: DataFrame, top: int = 10, least: float = 0.8) -> DataFrame:
    """The best usable cached answer of each query: of the tenant's first top by score, those of at least the score, whose departments aren't empty and are authorised.

    queries (query_id, tenant_id, departments), cache (entry_id, tenant_id, answer_departments, expires_at), scores (query_id, entry_id, score); the order of these steps counts.
    """
    q, c = queries.select("query_id", F.col("tenant_id").alias("qt"), "departments"), cache.select("entry_id", F.col("tenant_id").alias("ct"), "answer_departments")
    found = scores.join(q, "query_id").join(c, "entry_id").where("qt = ct")
    first = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "entry_id")
    found = found.withColumn("place", F.row_number().over(first)).where((F.col("place") <= top) & (F.col("score") >= least) & (F.size("answer_departments") > 0))
    usable = F.array_contains("departments", "*") | (F.size(F.array_except("answer_departments", "departments")) == 0)
    best = found.where(usable).withColumn("n", F.row_number().over(first)).where("n = 1")
    return best.select("query_id", "entry_id", "score", "place")


def fresh_entries(cache: DataFrame, now: Column) -> DataFrame:
    return cache.where(F.col("expires_at") > now)
