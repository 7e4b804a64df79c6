"""Stored tables that are replaced as a whole or in parts: what is new is staged beside what is read, verified, and then published by one pointer row that readers resolve.

A root holds one folder for each generation and a table of pointers. A run that ends between any two steps leaves folders that no pointer names, and readers keep what they had.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession, functions as F

POINTERS = "sequence long, generation string, parts map<string, string>, facts map<string, string>"


class VerificationError(ValueError):
    """What was staged isn't what was to be stored."""


class PublishConflictError(RuntimeError):
    """Someone else has published since this generation was begun."""


@dataclass(frozen=True)
class Pointer:
    """parts: for each named part of the table the generation that holds it; facts: what the writer says of the whole."""

    sequence: int = 0
    generation: str | None = None
    parts: dict[str, str] = field(default_factory=dict)
    facts: dict[str, str] = field(default_factory=dict)


def new_generation() -> str:
    return f"g-{uuid.uuid4().hex}"


def current(spark: SparkSession, root: str) -> Pointer:
    """The newest pointer in root: of one sequence, that of the least generation. Without any, one of sequence 0 that names nothing."""
    try:
        rows = spark.read.schema(POINTERS).json(f"{root}/pointers")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return Pointer()
    found = rows.where("generation is not null").orderBy(F.col("sequence").desc(), "generation").limit(1).collect()
    return Pointer(found[0]["sequence"], found[0]["generation"], found[0]["parts"] or {}, found[0]["facts"] or {}) if found else Pointer()


def publish(spark: SparkSession, root: str, begun: Pointer, made: Pointer) -> Pointer:
    """Puts made after begun, the pointer that its writer started from: one row in one file, which Spark's committer moves into place whole.

    If another writer was faster, made isn't published, or is passed over by every reader, and PublishConflictError is raised.
    """
    if current(spark, root) != begun:
        raise PublishConflictError(f"{root} has changed since generation {made.generation} was begun")
    row = Pointer(begun.sequence + 1, made.generation, made.parts, made.facts)
    spark.createDataFrame([(row.sequence, row.generation, row.parts, row.facts)], POINTERS).coalesce(1).write.mode("append").json(f"{root}/pointers")
    if current(spark, root) != row:
        raise PublishConflictError(f"another writer has published {root} before generation {made.generation}")
    return row
