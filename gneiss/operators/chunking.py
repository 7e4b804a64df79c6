"""Chunking: windows, found in one pass over each text in Arrow batches, routing, and chunk ids."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from gneiss.functions.text import SPACE, chunk_id
from gneiss.shared import small_batches


@dataclass(frozen=True)
class ChunkConfig:
    """Sizes are in tokens (runs of non-white space) or characters."""

    strategy: str = "recursive"
    version: str = "1.0"
    size: int = 512
    overlap: int = 64
    least: int = 50
    unit: str = "tokens"
    rows_per_group: int = 25
    merge_small: bool = True
    whole_table: bool = False
    separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ", "")

    def __post_init__(self) -> None:
        if self.unit not in ("tokens", "characters"):
            raise ValueError("unit must be tokens or characters")
        if self.size <= 0 or self.rows_per_group <= 0:
            raise ValueError("size and rows_per_group must be over zero")
        if self.overlap < 0 or self.overlap >= self.size:
            raise ValueError("overlap must be from zero to under size")
        if self.least < 0 or self.least > self.size:
            raise ValueError("least must be from zero to size")
        if not self.strategy.strip() or not self.version.strip():
            raise ValueError("strategy and version must not be blank")

    def of(self, strategy: str) -> ChunkConfig:
        return replace(self, strategy=strategy)


_WINDOW = StructType([StructField("text", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("units", IntegerType())])
_TOKEN = re.compile(r"\S+")  # of the same white space as SPACE


def _cut(text: str, config: ChunkConfig) -> list[tuple[str, int, int, int]]:
    """The windows of one text, each its own characters from a unit's start to a unit's end, found in one pass over the text."""
    if config.unit == "tokens":
        bounds = [m.span() for m in _TOKEN.finditer(text)]
        starts, ends = [a for a, _ in bounds], [b for _, b in bounds]
    else:
        starts, ends = range(len(text)), range(1, len(text) + 1)
    n, step, out = len(starts), config.size - config.overlap, []
    for k in range(0, max(0, -(-(n - config.size) // step)) * step + 1 if n else 0, step):
        a, b = starts[k], ends[min(k + config.size, n) - 1]
        out.append((text[a:b], a, b, min(n - k, config.size)))
    return out


def with_windows(docs: DataFrame, config: ChunkConfig, text: str, name: str = "windows") -> DataFrame:
    """docs with an array of overlapping windows of a text: structs of text, start, end (code points) and units, each the text's own characters.

    A window ends the text if it reaches its end; no later one begins. A null text has none.
    """

    @F.arrow_udf(ArrayType(_WINDOW))
    def windows(texts: pa.Array) -> pa.Array:
        found = [_cut(t, config) if t is not None else [] for t in texts.to_pylist()]
        ends = np.concatenate(([0], np.cumsum([len(w) for w in found]))).astype(np.int32)
        columns = list(zip(*(w for own in found for w in own))) or [[], [], [], []]
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32())
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.name for f in _WINDOW]))

    small_batches(docs.sparkSession)
    return docs.withColumn(name, windows(F.col(text)))


def fixed_size(docs: DataFrame, config: ChunkConfig, text: str = "text") -> DataFrame:
    """docs' columns with chunk_index, chunk_text, start_char, end_char and token_count. Windows of fewer units than least are left out and not counted, so short texts give none."""
    found = F.filter("_windows", lambda w: w["units"] >= config.least)
    one = with_windows(docs, config, text, "_windows").select(*docs.columns, F.posexplode(found).alias("chunk_index", "_window"))
    return one.select(*docs.columns, "chunk_index", F.col("_window.text").alias("chunk_text"), F.col("_window.start").alias("start_char"), F.col("_window.end").alias("end_char"), F.col("_window.units").alias("token_count"))


def page_aware(pages: DataFrame, config: ChunkConfig) -> DataFrame:
    """(doc_id, page_number, chunk_index, chunk_text, token_count) from rows (doc_id, page_number, text): no chunk crosses a page, blank pages give none, and tails stay."""
    given = pages.where(F.col("text").rlike(f"[^{SPACE}]")).select("doc_id", "page_number", "text")
    cut = with_windows(given, config, "text", "_windows").select("doc_id", "page_number", F.posexplode(F.filter("_windows", lambda w: w["units"] > 0)).alias("k", "_window"))
    order = Window.partitionBy("doc_id").orderBy("page_number", "k")
    return cut.select("doc_id", "page_number", (F.row_number().over(order) - 1).alias("chunk_index"), F.col("_window.text").alias("chunk_text"), F.col("_window.units").alias("token_count"))


def with_chunk_ids(chunks: DataFrame, strategy: str, version: str = "1.0") -> DataFrame:
    """chunks of (tenant_id, document_id, content_hash, chunk_index, chunk_text) with chunk_id and strategy."""
    made = chunk_id(F.col("tenant_id"), F.col("document_id"), F.col("content_hash"), F.lit(strategy), F.lit(version), F.col("chunk_index"), F.col("chunk_text"))
    return chunks.withColumns({"chunk_id": made, "strategy": F.lit(strategy)})


def routed(decisions: DataFrame, by_strategy: dict[str, DataFrame]) -> DataFrame:
    """The chunks (doc_id, strategy, ...) of the strategies that each document was routed to; all frames have the same columns.

    A decision for a strategy without a frame fails the run, when the result is read.
    """
    failed = F.raise_error(F.concat(F.lit("no chunker for strategy "), F.coalesce("strategy", F.lit("null")))).cast("boolean")
    unknown = decisions.where(F.when(F.col("strategy").isin(*by_strategy), F.lit(False)).otherwise(failed))
    out = None
    for strategy, chunks in by_strategy.items():
        chosen = decisions.where(F.col("strategy") == strategy).select("doc_id").distinct()
        own = chunks.join(chosen, "doc_id", "left_semi").withColumn("strategy", F.lit(strategy))
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("there are no chunkers")
    return out.unionByName(unknown.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in out.schema]))
