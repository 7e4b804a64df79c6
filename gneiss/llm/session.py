"""What the operators take from the session: the shared folder, and plan-cutting writes to it."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Hashable
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from gneiss.shared import shared_dir, small_batches, written

__all__ = ["free_name", "new_path", "only_cache", "shared_dir", "small_batches", "table", "text_or_empty", "written"]

#: What a Python worker keeps from task to task: one thing at a time.
_KEPT: dict[Hashable, Any] = {}


def only_cache(name: Hashable, make: Callable[[], Any] | None = None) -> Any:
    """What this worker keeps under name, made where it isn't there; what it keeps under other names is given back, so that the
    stages of a pipeline don't add up in workers that are used again."""
    if any(k != name for k in _KEPT):
        for k in [k for k in _KEPT if k != name]:
            del _KEPT[k]
        gc.collect()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # no glibc: the memory stays with the worker
            pass
    if make is None:
        return None
    if name not in _KEPT:
        _KEPT[name] = make()
    return _KEPT[name]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def free_name(df: DataFrame, base: str) -> str:
    """base, with underscores put before it until no column of df has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))
