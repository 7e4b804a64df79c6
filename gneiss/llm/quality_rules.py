"""Quality rules: adaptive thresholds from mergeable quantile sketches of each language and source."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gneiss.llm.session import small_batches, text_or_empty, written

#: Fixed base rules: fewer words, or a larger share of repeated words in percent.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: The fence over a group's upper quartile, in spreads: its quartiles' distance, or the least spread if that is more.
FENCE = 6
#: Metrics in thousandths, and their least spreads.
METRICS = {"symbols": 60, "repeats": 60, "dup_lines": 60, "word_length": 500}
#: Documents that the sketch of all documents counts as, merged into each group's own.
PRIOR = 20
#: Bits of a value that the sketch keeps: the relative error of a quantile is under 2 ** (1 - BITS).
BITS = 8
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"


def measure(text: str) -> tuple[int, int, int, int, int, int]:
    """(words, characters in words, symbols, duplicate lines, words in repeated windows of three, lines with words)."""
    own = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, SPACES))
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            lines += 1
            if line in seen:
                dup += 1
            seen.add(line)
    first: dict[tuple, int] = {}
    twice: set[int] = set()
    put = first.setdefault
    for k, window in enumerate(zip(own, own[1:], own[2:])):
        if (j := put(window, k)) != k:
            twice.add(k)
            twice.add(j)
    repeated, upto = 0, 0
    for k in sorted(twice):
        repeated += k + 3 - max(k, upto)
        upto = k + 3
    return len(own), chars, sum(map(text.count, SYMBOLS)), dup, repeated, lines


def with_measures(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines) of whole texts."""
    small_batches(docs.sparkSession)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
    given = docs.select("doc_id", "lang", "source", text_or_empty().alias("text"))
    schema = given.drop("text").schema
    for name in names:
        schema = schema.add(name, "long")

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            got = [measure(t) for t in batch.column(3).to_pylist()]
            columns = [pa.array([row[k] for row in got], pa.int64()) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], ["doc_id", "lang", "source", *names])

    return given.mapInArrow(batches, schema)


def metric(name: str) -> Column:
    return {
        "symbols": F.expr("1000 * n_symbols div greatest(n_words, 1)"),
        "repeats": F.expr("1000 * n_repeat_words div greatest(n_words, 1)"),
        "dup_lines": F.expr("1000 * n_dup_lines div greatest(n_lines, 1)"),
        "word_length": F.expr("1000 * word_chars div greatest(n_words, 1)"),
    }[name]


def bucket(value: Column) -> Column:
    """The value with all but its BITS highest bits cleared: a bin of the sketch, which adds up by counting."""
    drop = F.greatest(F.length(F.bin(value)) - BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def sketch(measured: DataFrame) -> DataFrame:
    """(lang, source, metric, bin, n): each group's counts by bin. Sketches merge by adding the counts of equal bins."""
    found = measured.where("n_words > 0").select(
        "lang", "source", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), bucket(metric(m)).alias("bin")) for m in METRICS])).alias("m")
    )
    return found.groupBy("lang", "source", "m.metric", "m.bin").agg(F.count("*").alias("n"))


def quantile(own: dict[int, int], whole: dict[int, int], percent: int) -> int:
    """The least bin that so many percent of the blend reach: the group's documents, one each, and PRIOR documents spread as all documents are. In integers."""
    n, total = sum(own.values()), sum(whole.values())
    upto = 0
    for b in sorted(own.keys() | whole.keys()):
        upto += total * own.get(b, 0) + PRIOR * whole.get(b, 0)
        if 100 * upto >= percent * total * (n + PRIOR):
            return b
    raise ValueError("a sketch without documents")


def fences(sketched: DataFrame) -> DataFrame:
    """(lang, source, metric, fence): fence is the value over which a document of the group is rejected.

    A group's quartiles are those of its own sketch merged with the sketch of all documents, which counts as PRIOR documents whatever its size: a group of a few documents is judged much
    like all are, a large one by itself, and nothing is switched on between. A sketch has a bounded number of bins, so a group's are held together, and the driver takes those of all documents.
    """
    whole: dict[str, dict[int, int]] = {m: {} for m in METRICS}
    for m, b, n in sketched.groupBy("metric", "bin").agg(F.sum("n")).toLocalIterator():  # as many rows as bins at most
        whole[m][b] = n
    groups = sketched.groupBy("lang", "source", "metric").agg(F.collect_list(F.struct("bin", "n")).alias("bins"))

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            out = []
            for m, bins in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                own = {x["bin"]: x["n"] for x in bins}
                low, high = (quantile(own, whole[m], p) for p in (25, 75))
                out.append(high + FENCE * max(high - low, METRICS[m]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.int64())], ["lang", "source", "metric", "fence"])

    return groups.mapInArrow(batches, groups.select("lang", "source", "metric").schema.add("fence", "long"))


def judge_quality(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of every row of docs.

    base_failed: under MIN_WORDS words, or over MAX_REPEAT_PERCENT percent of them in repeated windows of three. The
    others are kept unless, of symbols a word, repeated words a word, duplicate lines a line or characters a word,
    one is over the fence of the document's language and source. Null languages and sources are groups of their
    own; null and empty texts have no words and fail; repeated rows count as often as they are there and get equal rows.
    """
    measured = written(with_measures(docs), "rules")
    sketched = written(sketch(measured), "rules-sketch")
    cut = [F.max(F.when(F.col("metric") == m, F.col("fence"))).alias(f"fence_{m}") for m in METRICS]
    own = written(fences(sketched).groupBy(F.col("lang").alias("l"), F.col("source").alias("s")).agg(*cut), "rules-fences")
    joined = measured.join(own, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left")
    base_failed = (F.col("n_words") < MIN_WORDS) | F.expr(f"100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words")
    over = F.lit(False)
    for m in METRICS:
        over = over | F.coalesce(metric(m) > F.col(f"fence_{m}"), F.lit(False))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), (~base_failed & ~over).alias("kept"))
