"""JSON lines with the places of bad lines: numbers of lines in files that many tasks read in splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

BAD = "_bad_line"


class BadLineError(ValueError):
    """Lines that aren't JSON of the schema."""


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, mark, value): every line with the split that it was read in; marks rise with the lines of a split by one."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("mark"), "value")


def _parsed(lines: DataFrame, schema: StructType) -> DataFrame:
    wide = StructType([*schema.fields]).add(BAD, "string")
    record = F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD})
    return lines.where(F.col("value").rlike(r"\S")).withColumn("record", record)


def bad_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """(file, line, value) of the lines in path that aren't JSON objects of the schema, numbered from 1 within their file, blank lines counted.

    A line's number is its place in its split and the number of lines in the file's splits before: splits are counted where they are read, and
    only their counts and the bad lines are shuffled.
    """
    lines = _lines(spark, path)
    counts = lines.groupBy("file", "split").agg(F.min("mark").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = counts.select("file", "split", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    bad = _parsed(lines, schema).where(F.col("record").isNull() | F.col(f"record.{BAD}").isNotNull()).select("file", "split", "mark", "value")
    return bad.join(splits, ["file", "split"]).select("file", (F.col("before") + F.col("mark") - F.col("first") + 1).alias("line"), "value")


def read_checked_lines(spark: SparkSession, path: str, schema: StructType | str, shown: int = 5) -> DataFrame:
    """The records of JSON lines in path; blank lines are passed over. If any other line isn't a JSON object of the schema, BadLineError names the first few with their files and numbers."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    found = bad_lines(spark, path, schema).orderBy("file", "line").limit(shown).collect()
    if found:
        raise BadLineError("; ".join(f"{r['file']}, line {r['line']}: {r['value'][:80]}" for r in found))
    return _parsed(_lines(spark, path), schema).select(*[F.col(f"record.`{f.name}`").alias(f.name) for f in schema.fields])


def write_lines(df: DataFrame, path: str) -> None:
    """One JSON object a line: keys in the order of their names, no space between, nulls kept."""
    fields = F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)])
    df.select(F.to_json(fields, {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)
