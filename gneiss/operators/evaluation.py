"""Retrieval and answer evaluation: recall, reciprocal rank, facts, sources, citations, faithfulness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gneiss.functions.text import SPACE, normalised

# The answer that abstains, and phrases that let an uncited sentence stand before a claim.
ABSTENTION = "i do not know based on the provided context"
ABSTENTION_ANSWER = "I do not know based on the provided context."
PREFIX_MARKERS = ("as follows", "but the exact", "the following", "different limits", "conflicting", "required for requests")
CONTINUATIONS = ("and ", "or ", "but ", "however ", "while ", "including ", "such as ")
CITATION = r"\[([^\[\]]+)\]"


def recall_at(found: Column, relevant: Column, k: int) -> Column:
    """The share of the relevant that the first k found hold, as sets; 0 without relevant ones."""
    if k <= 0:
        raise ValueError("k must be over zero")
    own = F.array_distinct(relevant)
    return F.when(F.size(own) == 0, 0.0).otherwise(F.size(F.array_intersect(F.slice(found, 1, k), own)) / F.size(own))


def reciprocal_rank(found: Column, relevant: Column) -> Column:
    places = F.filter(F.transform(found, lambda f, k: F.when(F.array_contains(relevant, f), k + 1)), lambda k: k.isNotNull())
    return F.coalesce(1 / F.array_min(places), F.lit(0.0))


def contains_text(text: Column, phrase: Column) -> Column:
    return F.contains(normalised(text), normalised(phrase))


def source_recall(found: Column, expected: Column) -> Column:
    """As recall, but 1 where nothing is expected."""
    own = F.array_distinct(expected)
    return F.when(F.size(own) == 0, 1.0).otherwise(F.size(F.array_intersect(found, own)) / F.size(own))


def abstains(answer: Column) -> Column:
    return F.contains(normalised(answer), F.lit(ABSTENTION))


def matched_facts(answer: Column, facts: Column) -> Column:
    """The fact groups of which the answer has any phrase; an empty group never matches."""
    return F.filter(facts, lambda group: F.exists(group, lambda p: contains_text(answer, p)))


def fact_recall(answer: Column, facts: Column) -> Column:
    return F.when(F.size(facts) == 0, 1.0).otherwise(F.size(matched_facts(answer, facts)) / F.size(facts))


def failure(dense: Column, sparse: Column, hybrid: Column) -> Column:
    """What became of a query, from the ranks of its first relevant document in three lists; null is not found."""
    return (
        F.when(hybrid == 1, "success_rank_1")
        .when(hybrid.isNotNull(), "success_low_rank")
        .when(dense.isNull() & sparse.isNull(), "both_retrievers_miss")
        .when(dense.isNull(), "dense_miss_fusion_failure")
        .when(sparse.isNull(), "sparse_miss_fusion_failure")
        .otherwise("fusion_ranking_failure")
    )


def citations(answer: Column) -> Column:
    return F.transform(F.regexp_extract_all(answer, F.lit(CITATION), F.lit(1)), lambda x: F.trim(x))


def valid_citations(answer: Column, allowed: Column) -> Column:
    """The cited allowed sources, each at its first place."""
    return F.array_intersect(citations(answer), allowed)


def answer_units(answer: Column) -> Column:
    """Sentences of the answer's lines, without bullets; none of a blank answer or one that abstains."""
    lines = F.transform(F.split(answer, "[\n\r]+"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^\s*[-*]\s+", "")))
    cut = F.flatten(F.transform(lines, lambda x: F.split(F.regexp_replace(x, f"([.!?])[{SPACE}]+", "$1\x01"), "\x01")))
    units = F.filter(F.transform(cut, lambda x: F.trim(x)), lambda u: u != "")
    return F.when(abstains(answer), F.array().cast("array<string>")).otherwise(units)


def completeness(answer: Column, allowed: Column) -> Column:
    """Struct of factual, cited and score. A unit of citations alone counts for the unit before it; one that ends in a colon doesn't count; without units the score is 1."""
    marks = F.transform(answer_units(answer), lambda u: F.struct(u.endswith(":").alias("colon"), u.rlike(r"^(?:\s*\[[^\[\]]+\]\s*)+$").alias("alone"), (F.size(valid_citations(u, allowed)) > 0).alias("cited")))
    start = F.struct(F.lit(0).alias("factual"), F.lit(0).alias("cited"), F.lit(False).alias("last"))

    def step(state: Column, mark: Column) -> Column:
        own = ~mark["colon"] & ~mark["alone"]
        credit = ~mark["colon"] & mark["alone"] & mark["cited"] & (state["factual"] > 0) & ~state["last"]
        return F.struct(
            (state["factual"] + own.cast("int")).alias("factual"), (state["cited"] + (own & mark["cited"] | credit).cast("int")).alias("cited"),
            F.when(own, mark["cited"]).otherwise(state["last"] | credit).alias("last"),
        )

    score = lambda s: F.when(s["factual"] == 0, 1.0).otherwise(s["cited"] / s["factual"])
    return F.aggregate(marks, start, step, lambda s: F.struct(s["factual"].alias("factual"), s["cited"].alias("cited"), score(s).alias("score")))


def claims(answer: Column, allowed: Column) -> Column:
    """Structs of claim and citations, for each unit that cites an allowed source. A claim of six words or fewer, or one that begins as a continuation, takes the last uncited unit that can stand before it; that one stays."""
    lines = F.transform(F.split(F.replace(answer, F.lit("\r\n"), F.lit("\n")), "\n"), lambda x: F.trim(x))
    units = F.filter(F.transform(F.flatten(F.transform(lines, lambda x: F.split(F.regexp_replace(x, f"([.!?])[{SPACE}]+", "$1\x01"), "\x01"))), lambda x: F.trim(x)), lambda u: u != "")
    kind = "struct<prefix:string,pairs:array<struct<claim:string,citations:array<string>>>>"
    start = F.from_json(F.lit('{"prefix":"","pairs":[]}'), kind)
    words = lambda t: F.size(F.filter(F.split(t, " "), lambda w: w != ""))

    def step(state: Column, unit: Column) -> Column:
        own = valid_citations(unit, allowed)
        claim = F.regexp_replace(F.regexp_replace(unit, CITATION, ""), r"^\s*(?:[-*•]|\d+[.)])\s*", "")
        claim = F.regexp_replace(F.trim(F.regexp_replace(claim, f"[{SPACE}]+", " ")), "[ ,;:]+$", "")
        low = F.lower(claim)
        opens = (claim != "") & ((words(claim) >= 4) | low.rlike("|".join(PREFIX_MARKERS)))
        needs = (state["prefix"] != "") & ((words(claim) <= 6) | low.rlike(f"^(?:{'|'.join(CONTINUATIONS)})"))
        joined = F.concat(F.regexp_replace(state["prefix"], "[ ,;:]+$", ""), F.lit(" "), F.regexp_replace(claim, "^[ ,;:]+", ""))
        pair = F.struct(F.when(needs, joined).otherwise(claim).alias("claim"), own.alias("citations"))
        without = F.struct(F.when(opens, claim).otherwise(state["prefix"]).alias("prefix"), state["pairs"].alias("pairs"))
        with_pair = F.struct(state["prefix"].alias("prefix"), F.array_append(state["pairs"], pair).alias("pairs"))
        return F.when(F.size(own) == 0, without).when(claim == "", state).otherwise(with_pair)

    return F.aggregate(units, start, step, lambda s: s["pairs"])


def gated(answer: Column, sources: Column) -> Column:
    """The answer, or the abstention where it is blank, abstains in these words or has no sources."""
    blank = answer.isNull() | ~answer.rlike(f"[^{SPACE}]")
    same = normalised(answer) == F.lit(ABSTENTION_ANSWER.lower())
    return F.when(blank | same | (F.size(sources) == 0), ABSTENTION_ANSWER).otherwise(answer)


def faithfulness(verdicts: DataFrame) -> DataFrame:
    """(case_id, n_claims, faithfulness) from rows (case_id, claim_no, verdict), a verdict for each source or null without evidence.

    A claim is supported if all its sources support it (1), partly if some do or some partly do (0.5), else not (0).
    """
    full, some = F.count_if(F.col("verdict") == "SUPPORTED"), F.count_if(F.col("verdict").isin("SUPPORTED", "PARTIALLY_SUPPORTED"))
    claim = verdicts.groupBy("case_id", "claim_no").agg(F.when((F.count("verdict") > 0) & (full == F.count("verdict")), 1.0).when(some > 0, 0.5).otherwise(0.0).alias("score"))
    return claim.groupBy("case_id").agg(F.count("*").alias("n_claims"), F.round(F.avg("score"), 6).alias("faithfulness"))
