"""Mixing sources to target weights by capped water-filling, sampled in seeded whole and fractional repetitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from gneiss.llm.session import small_batches, written
from gneiss.llm.words import slices, words

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 20
#: Bits of a document's seeded hash that each of the two histograms of a source is by.
BITS = 12


def with_word_counts(docs: DataFrame, name: str = "size", text: str = "text") -> DataFrame:
    """docs with the number of words of each text; null has none."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text)

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            count = np.zeros(batch.num_rows, np.int64)
            for lo, hi in slices(batch.column(at)):
                count[lo:hi] = np.diff(words(batch.column(at).slice(lo, hi - lo)).first)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(count)], [*batch.schema.names, name])

    return docs.mapInArrow(batches, docs.limit(0).withColumn(name, F.lit(0).cast("long")).schema)


def draw(key: Column, text: Column, seed: int = SEED) -> Column:
    """A document's seeded place from 0 to 2 ** (2 * BITS) - 1; equal rows share one."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), key, F.xxhash64(text)), 64 - 2 * BITS)


def water_fill(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    The sources by code point, null last, have the weights, repeated. They share the sum of all sizes; a target stops
    at max_epochs times its source's size, and the excess is shared again by weight until no target is above.
    A source of size 0 has target 0. Only sums come to the driver, one pair for each round of clamping; the weights
    follow a rank that is counted over ranges of sources, so no task holds them all.
    """
    n = len(weights)
    ranged = sizes.withColumn("last", F.col("source").isNull().cast("int")).repartitionByRange("last", "source").withColumn("range", F.spark_partition_id())
    ranged = written(ranged, "mix-sources")
    within = F.row_number().over(Window.partitionBy("range").orderBy("last", "source"))
    before = ranged.groupBy("range").agg(F.count("*").alias("n"))
    before = before.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))  # one row for each range
    ranked = ranged.withColumn("within", within).join(before, "range").withColumn("rank", F.col("within") + F.col("before") - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % n).cast("int") + 1)
    ranked = written(ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * float(max_epochs)).alias("cap")), "mix-weights")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        clamped = F.col("weight") * level >= F.col("cap")
        held, open_weight = ranked.agg(F.sum(F.when(clamped, F.col("cap")).otherwise(0.0)), F.sum(F.when(clamped, 0.0).otherwise(F.col("weight")))).first()
        if not open_weight:
            break
        risen = (total - held) / open_weight
        if risen <= level * (1 + 1e-12):
            break
        level = risen
    return ranked.select("source", "source_size", F.least("cap", F.col("weight") * level).alias("target"))


def _plan(docs: DataFrame, weights: tuple[int, ...], max_epochs: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size, draw) of every row of docs, and (p, source_size, target, whole, cut) of every source."""
    given = with_word_counts(docs.select("doc_id", "source", "text"))
    base = written(given.select("doc_id", "source", "size", draw(F.col("doc_id"), F.col("text"), seed).alias("draw")), "mix")
    high, low = F.shiftright("draw", BITS), F.col("draw").bitwiseAND((1 << BITS) - 1)
    bins = written(base.groupBy("source", high.alias("bin")).agg(F.sum("size").alias("size")), "mix-bins")
    targets = water_fill(bins.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = targets.withColumn("whole", F.floor(epochs + 1e-9)).withColumn("wanted", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    targets = written(targets, "mix-targets")

    def cut(hist: DataFrame, wanted: Column) -> DataFrame:
        """Of each source, the last bin that begins at or before the wanted sum, and the sum before it."""
        upto = F.sum("size").over(Window.partitionBy("source").orderBy("bin"))
        from_ = hist.withColumn("before", upto - F.col("size")).where(F.col("before") <= wanted)
        return from_.groupBy("source").agg(F.max_by(F.struct("bin", "before", "size"), "bin").alias("b"))

    named = targets.select(F.col("source").alias("s"), "wanted")
    first = cut(bins.join(named, F.col("source").eqNullSafe(F.col("s"))), F.col("wanted")).select(F.col("source").alias("s"), F.col("b.bin").alias("cut_bin"), F.col("b.before").alias("before"))
    first = written(first.join(targets.select("source", "wanted"), F.col("s").eqNullSafe(F.col("source"))).select("s", "cut_bin", "before", "wanted"), "mix-cuts")
    inner = base.join(first, F.col("source").eqNullSafe(F.col("s")) & (high == F.col("cut_bin")))
    inner = inner.groupBy("source", low.alias("bin")).agg(F.sum("size").alias("size"), F.first("before").alias("offset"), F.first("wanted").alias("wanted"))
    second = cut(inner, F.col("wanted") - F.col("offset"))
    whole = inner.select(F.col("source").alias("i"), "offset", "wanted").distinct()
    near = second.join(whole, F.col("source").eqNullSafe(F.col("i")))
    over = F.col("wanted") - F.col("offset") - F.col("b.before")
    near = near.select(F.col("source").alias("c"), (F.col("b.bin") + F.when(2 * over > F.col("b.size"), 1).otherwise(0)).alias("cut_low"))
    cuts = first.join(near, F.col("s").eqNullSafe(F.col("c")), "left").select("s", (F.shiftleft("cut_bin", BITS) + F.coalesce("cut_low", F.lit(0))).alias("cut"))
    plan = written(targets.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").select(F.col("source").alias("p"), "source_size", "target", "whole", F.coalesce("cut", F.lit(0)).alias("cut")), "mix-plan")
    return base, plan


def _repeats(max_epochs: float) -> Column:
    return F.least(F.col("whole") + (F.col("draw") < F.col("cut")).cast("int"), F.lit(int(max_epochs))).cast("long")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """(doc_id, draw, size, source, source_size, target, repeats) of every row of docs.

    A source whose target is e times its size gives every document floor(e) times, and once more the documents whose
    seeded draw is under the source's cut. The cut is where the sizes under it come nearest to the rest of the
    target: two histograms of the draws find it, the first over all documents, the second over the first's cut
    bin, so that no task sorts a source. Equal draws are taken together. Words in a text give its size; null and empty
    texts have size 0; null sources are one source. Repeated rows share a draw and so their repeats.
    """
    base, plan = _plan(docs, weights, max_epochs, seed)
    out = base.join(plan, F.col("source").eqNullSafe(F.col("p")))
    return out.select("doc_id", "draw", "size", "source", "source_size", "target", _repeats(max_epochs).alias("repeats"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """docs' rows as often as the mix takes them; all columns stay."""
    _, plan = _plan(docs, weights, max_epochs, seed)
    kept = [F.col(f"d.`{c}`") for c in docs.columns]
    placed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), draw(F.col("doc_id"), F.col("text"), seed).alias("draw"), F.col("source").alias("s"))
    taken = placed.join(plan, F.col("s").eqNullSafe(F.col("p"))).withColumn("repeats", _repeats(max_epochs)).where("repeats > 0")
    return taken.select("d", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))).alias("nth")).select(*kept)
