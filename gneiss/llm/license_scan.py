"""License scans: a trained paragraph classifier names licence families, and template comparison confirms them.

All DataFrame operations. A family has to be named by the classifier and confirmed by a template. Both conditions have to
hold, so the cheaper one, which needs no join, is put to every window of every paragraph within its row; what passes it is
exploded to word n-grams and joined with the weights. A window that no template confirms is unknown whatever the classifier
says of it, so this order loses nothing; a test holds the result against a scan that scores every window.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gneiss.llm.license_templates import OTHERS, TEMPLATES
from gneiss.llm.session import text_or_empty, written

UNKNOWN = "unknown"
FAMILIES = sorted(TEMPLATES)
CLASSES = [*FAMILIES, UNKNOWN]
#: A paragraph ends at a blank line or at a line end behind a sentence's end; other line ends only wrap it.
PARAGRAPH_END = r"(?<=[.!?:;])[ \t\r]*\n|\n[ \t\r]*(?=\n)"
#: Paragraphs of more words are cut to windows of so many, a new one every half.
WINDOW = 64
#: The least calibrated probability of a family, and the least share of word pairs in common with one of its templates:
#: of the template's pairs, or of the paragraph's where it is a part of a longer licence.
PROBABILITY, SIMILARITY, LEAST_PAIRS = 0.5, 0.6, 2
WORD = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
COPIES, ROUNDS, STEP, DECAY = 16, 250, 2.0, 1e-3


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.translate({c: c + 32 for c in range(65, 91)}))


def grams_of(words: list[str]) -> set[str]:
    return set(words) | {f"{a} {b}" for a, b in zip(words, words[1:])}


def _examples(seed: int) -> list[tuple[set[str], int]]:
    """Templates whole, with words left out or put before and after, and in parts; other sentences and words in any order."""
    rng = np.random.default_rng(seed)
    pool = [words_of(t) for f in FAMILIES for t in TEMPLATES[f]]
    every = sorted({w for own in pool for w in own})
    filler = sorted({w for t in OTHERS for w in words_of(t)})
    pick = lambda xs, n: [xs[int(k)] for k in rng.integers(len(xs), size=n)]
    out = []
    for c, family in enumerate(FAMILIES):
        for text in TEMPLATES[family]:
            own = words_of(text)
            for copy in range(COPIES):
                kept = [w for w in own if copy == 0 or rng.random() > 0.06]
                if len(kept) > 14 and copy % 3 == 2:
                    lo = int(rng.integers(len(kept) - 10))
                    kept = kept[lo : lo + 12]
                around = 0 if copy == 0 else int(rng.integers(40 if copy % 4 == 3 else 5))
                lead = int(rng.integers(around + 1))
                out.append((grams_of([*pick(filler if copy % 2 else every, lead), *kept, *pick(filler if copy % 2 else every, around - lead)]), c))
    for text in OTHERS:
        own = words_of(text)
        for _ in range(COPIES):
            out.append((grams_of([w for w in own if rng.random() > 0.1]), len(FAMILIES)))
    for _ in range(COPIES * 14):
        out.append((grams_of(pick(every if rng.random() < 0.6 else filler, int(rng.integers(3, WINDOW)))), len(FAMILIES)))
    return out


@lru_cache(maxsize=1)
def model() -> tuple[dict[str, np.ndarray], np.ndarray]:
    """(weights of each n-gram, biases), by class: multinomial logistic regression, fitted on one set of written examples and
    calibrated on another by the temperature that gives it the least loss."""
    rows = _examples(1)
    vocabulary = {g: k for k, g in enumerate(sorted(set().union(*(g for g, _ in rows))))}

    def matrix(rows):
        x = np.zeros((len(rows), len(vocabulary)), np.float32)
        for r, (own, _) in enumerate(rows):
            known = [vocabulary[g] for g in own if g in vocabulary]
            x[r, known] = 1 / np.sqrt(max(1, len(own)))
        return x, np.array([c for _, c in rows])

    def soft(z):
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    x, y = matrix(rows)
    w, b, one = np.zeros((len(vocabulary), len(CLASSES)), np.float32), np.zeros(len(CLASSES), np.float32), np.eye(len(CLASSES), dtype=np.float32)[y]
    for _ in range(ROUNDS):
        g = (soft(x @ w + b) - one) / len(y)
        w -= 20 * STEP * (x.T @ g + DECAY * w / len(y))
        b -= STEP * g.sum(axis=0)
    x, y = matrix(_examples(2))
    loss = lambda t: -np.log(soft((x @ w + b) * t)[np.arange(len(y)), y] + 1e-12).mean()
    heat = min(np.arange(0.5, 4.01, 0.25), key=loss)
    return {g: (w[k] * heat).astype(np.float64) for g, k in vocabulary.items()}, (b * heat).astype(np.float64)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(f"({WORD})"), F.lit(1))


def _pairs(words: Column) -> Column:
    return F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))


def template_pairs() -> list[tuple[str, int, set[str]]]:
    """(family, number, distinct word pairs) of every template; one of a single word has that word."""
    out = []
    for family in FAMILIES:
        for k, text in enumerate(TEMPLATES[family]):
            own = words_of(text)
            out.append((family, k, {f"{a} {b}" for a, b in zip(own, own[1:])} or set(own)))
    return out


def _among(values: Column, known: set[str]) -> Column:
    return F.filter(values, lambda v: v.isin(sorted(known)))


def _confirmable(words: Column) -> Column:
    """Whether a template shares enough of its word pairs, or of the window's, with a window of words."""
    every = template_pairs()
    everything = set().union(*(own for _, _, own in every))

    def like(own: Column) -> Column:
        out = F.lit(False)
        for _, _, pairs in every:
            shared = F.size(_among(own["known"], pairs))
            out = out | ((shared >= min(LEAST_PAIRS, len(pairs))) & (shared >= SIMILARITY * F.least(F.lit(len(pairs)), F.greatest(own["m"], F.lit(6))) - 1e-9))
        return out

    measured = F.transform(F.array(F.array_distinct(_pairs(words))), lambda pairs: F.struct(_among(pairs, everything).alias("known"), F.size(pairs).alias("m")))
    return F.exists(measured, lambda own: (F.size(own["known"]) > 0) & like(own))


def units(text: Column) -> Column:
    """The windows of a text's paragraphs, and of the lines of wrapped ones, that a template can confirm, as words joined by spaces."""
    wrapped = F.flatten(F.transform(F.split(text, PARAGRAPH_END), lambda p: F.when(F.contains(p, F.lit("\n")), F.concat(F.array(p), F.split(p, "\n"))).otherwise(F.array(p))))
    worded = F.transform(wrapped, _words)
    windows = F.flatten(F.transform(worded, lambda ws: F.transform(F.sequence(F.lit(1), F.greatest(F.size(ws) - WINDOW // 2, F.lit(1)), F.lit(WINDOW // 2)), lambda k: F.slice(ws, k, WINDOW))))
    return F.transform(F.filter(windows, _confirmable), lambda ws: F.array_join(ws, " "))


def n_paragraphs(text: Column) -> Column:
    return F.size(F.filter(F.split(text, PARAGRAPH_END), lambda p: p.rlike("[A-Za-z0-9]"))).cast("long")


def _tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(gram, w0, w1, ...) and (pair, family, template, n) as written tables, of the model's and the templates' fixed size."""
    weights, _ = model()
    fields = ", ".join(f"w{k} double" for k in range(len(CLASSES)))
    known = spark.createDataFrame([(g, *map(float, w)) for g, w in sorted(weights.items())], f"gram string, {fields}")
    rows = [(p, family, k, len(pairs)) for family, k, pairs in template_pairs() for p in sorted(pairs)]
    return written(known.coalesce(1), "licence-weights"), written(spark.createDataFrame(rows, "pair string, family string, template int, n int").coalesce(1), "licence-templates")


def judge_units(found: DataFrame) -> DataFrame:
    """(unit, family, confidence, similarity) of distinct units; family is unknown where it isn't confirmed."""
    weights, templates = _tables(found.sparkSession)
    _, bias = model()
    worded = found.withColumn("ws", F.split("unit", " "))
    grams = worded.select("unit", F.explode(F.array_distinct(F.concat("ws", _pairs(F.col("ws"))))).alias("gram"), F.size(F.array_distinct(F.concat("ws", _pairs(F.col("ws"))))).alias("m"))
    sums = grams.join(weights, "gram", "left").groupBy("unit").agg(*[F.sum(F.coalesce(f"w{k}", F.lit(0.0)) / F.sqrt("m")).alias(f"z{k}") for k in range(len(CLASSES))])
    z = F.array(*[F.struct((F.round(F.col(f"z{k}"), 9) + F.lit(float(bias[k]))).alias("z"), F.lit(c).alias("family")) for k, c in enumerate(CLASSES)])
    top = sums.select("unit", z.alias("zs")).withColumn("top", F.array_max("zs"))
    top = top.select("unit", F.col("top.family").alias("guess"), (1 / F.aggregate("zs", F.lit(0.0), lambda a, x: a + F.exp(x["z"] - F.col("top.z")))).alias("confidence"))
    pairs = worded.select("unit", F.explode(F.array_distinct(_pairs(F.col("ws")))).alias("pair"), F.size(F.array_distinct(_pairs(F.col("ws")))).alias("m"))
    shared = pairs.join(templates, "pair").groupBy("unit", "family", "template").agg(F.count("*").alias("shared"), F.first("n").alias("n"), F.first("m").alias("m"))
    like = shared.select("unit", F.col("family").alias("guess"), F.when(F.col("shared") >= F.least(F.lit(LEAST_PAIRS), F.col("n")), F.greatest(F.col("shared") / F.col("n"), F.col("shared") / F.greatest(F.col("m"), F.lit(6)))).otherwise(0.0).alias("similarity"))
    like = like.groupBy("unit", "guess").agg(F.max("similarity").alias("similarity"))
    judged = top.join(like, ["unit", "guess"], "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    sure = (F.col("guess") != UNKNOWN) & (F.col("confidence") >= PROBABILITY) & (F.col("similarity") >= SIMILARITY)
    return judged.select("unit", F.when(sure, F.col("guess")).otherwise(UNKNOWN).alias("family"), "confidence", "similarity")


def scan_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, n_paragraphs, families, family, confidence) of every row of docs.

    n_paragraphs: paragraphs with a word, all of which are judged; families: the confirmed families, sorted and joined by
    commas, empty without any; family: the one of most confidence, the first by name of equal ones, else null with
    confidence 0. A null text is empty; rows that repeat a doc_id keep their own texts' results, equal rows have equal ones.

    One pass over the texts writes what may be a licence; each distinct window is judged once however often it occurs, so a
    licence that a third of all documents holds is one row to the classifier.
    """
    text = text_or_empty()
    scanned = written(docs.select("doc_id", F.xxhash64(text).alias("text_key"), n_paragraphs(text).alias("n_paragraphs"), units(text).alias("units")), "licence-units")
    counted = scanned.where(F.size("units") > 0).select("doc_id", "text_key", F.explode("units").alias("unit"))
    judged = written(judge_units(counted.select("unit").distinct()), "licence-judged")
    named = counted.join(judged.where(F.col("family") != UNKNOWN), "unit").withColumn("own", F.struct((-F.col("confidence")).alias("z"), F.col("family").alias("family")))
    found = named.groupBy(F.col("doc_id").alias("d"), F.col("text_key").alias("k")).agg(F.collect_set("own.family").alias("families"), F.min("own").alias("best"))
    out = scanned.drop("units").join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left")
    return out.select(
        "doc_id",
        "n_paragraphs",
        F.coalesce(F.array_join(F.array_sort("families"), ","), F.lit("")).alias("families"),
        F.col("best.family").alias("family"),
        F.coalesce(-F.col("best.z"), F.lit(0.0)).alias("confidence"),
    )
