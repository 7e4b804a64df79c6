"""Judged answers: parsing a judge's output, evidence, quality rows, behaviour and outcome rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gneiss.functions.text import SPACE, outer_space
from gneiss.operators import evaluation as E

# A judge's verdicts, and words that tell of a conflict.
VERDICTS = ("SUPPORTED", "PARTIALLY_SUPPORTED", "UNSUPPORTED")
CONFLICT = ("conflict", "conflicting", "different", "inconsistent")


def parse_judgement(output: Column) -> Column:
    """Struct of verdict, reason and error of a judge's JSON, with or without a code fence around it. Only one of verdict and error is set."""
    body = F.regexp_replace(F.regexp_replace(outer_space(output), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")
    found = F.from_json(body, "verdict string, reason string, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    verdict, reason = F.upper(outer_space(F.coalesce(found["verdict"], F.lit("")))), outer_space(F.coalesce(found["reason"], F.lit("")))
    error = F.when(found.isNull() | found["_corrupt"].isNotNull(), "invalid JSON").when(~verdict.isin(*VERDICTS), "invalid verdict").when(reason == "", "empty reason")
    return F.struct(F.when(error.isNull(), verdict).alias("verdict"), F.when(error.isNull(), reason).alias("reason"), error.alias("error"))


def claim_verdict(verdicts: Column) -> Column:
    """A claim's verdict from its sources': all supported; any support, in part; else, or without sources, unsupported."""
    own = F.array_distinct(F.filter(verdicts, lambda v: v.isNotNull()))
    some = F.array_contains(own, VERDICTS[0]) | F.array_contains(own, VERDICTS[1])
    return F.when((F.size(own) == 1) & F.array_contains(own, VERDICTS[0]), VERDICTS[0]).when(some, VERDICTS[1]).otherwise(VERDICTS[2])


def resolve_evidence(claims: DataFrame, chunks: DataFrame) -> DataFrame:
    """(case_id, claim_no, claim, evidence, missing) from claims (case_id, claim_no, claim, citations) and context chunks (case_id, position, source, text).

    evidence: structs of place, source and its texts in context order, by the order of citations; missing: cited sources without chunks. Chunks without a source are evidence for nothing.
    """
    texts = F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda c: c["text"])
    grouped = chunks.where("source is not null and source <> ''").groupBy("case_id", "source").agg(texts.alias("texts"))
    cited = claims.select("case_id", "claim_no", "claim", F.posexplode_outer("citations").alias("place", "source"))
    found = cited.join(grouped, ["case_id", "source"], "left")
    has = F.col("texts").isNotNull()
    pieces = lambda kept: F.array_sort(F.collect_list(F.when(kept, F.struct("place", "source", "texts"))))
    out = found.groupBy("case_id", "claim_no", "claim").agg(pieces(has).alias("evidence"), pieces(~has & F.col("source").isNotNull()).alias("lost"))
    return out.select("case_id", "claim_no", "claim", "evidence", F.transform("lost", lambda m: m["source"]).alias("missing"))


def judge_prompt(claim: Column, source: Column, texts: Column) -> Column:
    """What a judge is asked of one claim and source: numbered chunks and the claim."""
    blocks = F.array_join(F.transform(texts, lambda t, k: F.concat(F.lit('<chunk id="'), (k + 1).cast("string"), F.lit('">\n'), t, F.lit("\n</chunk>"))), "\n")
    return F.concat(F.lit("Source: "), source, F.lit("\n"), blocks, F.lit("\nClaim: "), claim, F.lit("\nAnswer in JSON with verdict and reason."))


def quality_row(cases: DataFrame) -> DataFrame:
    """cases (case_id, answer, behaviour, facts, expected_sources, allowed) with the figures of an answer's quality and passed.

    behaviour is answer or unknown; an answer is right to abstain just if nothing is known.
    """
    full = E.completeness(F.col("answer"), F.col("allowed"))
    sources = E.valid_citations(F.col("answer"), F.col("allowed"))
    out = cases.withColumn("c", full).select(
        "case_id",
        F.col("answer").rlike(f"[^{SPACE}]").alias("answer_present"),
        (E.abstains(F.col("answer")) == (F.col("behaviour") == "unknown")).alias("abstention_correct"),
        F.round(E.fact_recall(F.col("answer"), F.col("facts")), 6).alias("fact_recall"),
        F.round(E.source_recall(sources, F.col("expected_sources")), 6).alias("source_recall"),
        F.round("c.score", 6).alias("completeness"),
    )
    return out.withColumn("passed", F.col("answer_present") & F.col("abstention_correct") & (F.col("fact_recall") == 1) & (F.col("source_recall") == 1) & (F.col("completeness") == 1))


def behaves(answer: Column, sources: Column, expected: Column) -> Column:
    """Whether an answer does as expected: unknown, conflict, answer or citation; anything else is never met."""
    low, n = F.lower(answer), F.size(sources)
    unknown = F.contains(low, F.lit(E.ABSTENTION))
    real = answer.rlike(f"[^{SPACE}]") & ~unknown & (n > 0)
    cited = F.forall(sources, lambda s: F.contains(answer, F.concat(F.lit("["), s, F.lit("]"))))
    return (
        F.when(expected == "unknown", unknown & (n == 0))
        .when(expected == "conflict", ~unknown & low.rlike("|".join(CONFLICT)) & (n >= 2))
        .when(expected == "answer", real)
        .when(expected == "citation", real & cited)
        .otherwise(False)
    )


def retrieval_outcome(before: Column, after: Column, expected: Column) -> Column:
    """IMPROVED, REGRESSED or UNCHANGED, by whether any expected source was found before and after."""
    had, has = F.arrays_overlap(before, expected), F.arrays_overlap(after, expected)
    return F.when(~had & has, "IMPROVED").when(had & ~has, "REGRESSED").otherwise("UNCHANGED")


def decision(outcomes: DataFrame) -> DataFrame:
    """One row decision from rows (outcome): no regression and more hits, no regression and as many, or regressions."""
    up, down = F.count_if(F.col("outcome") == "IMPROVED"), F.count_if(F.col("outcome") == "REGRESSED")
    return outcomes.agg(F.when(down > 0, "regressions").when(up > 0, "improved").otherwise("no improvement").alias("decision"))


def memory_outcome(baseline: Column, remembered: Column, cited: Column) -> Column:
    """IMPROVED where memory turns an abstention into a cited answer, REGRESSED where it does the opposite."""
    was, now = F.contains(F.lower(baseline), F.lit(E.ABSTENTION)), F.contains(F.lower(remembered), F.lit(E.ABSTENTION))
    return F.when(was & ~now & cited, "IMPROVED").when(~was & now, "REGRESSED").otherwise("UNCHANGED")


def contextualised(query: Column, history: Column, rewritten: Column, enabled: bool = True) -> Column:
    """Struct of query and rewritten: the rewriter's cleaned output; the query itself where that is invalid, there is no history or it is off."""
    from gneiss.functions.text import normalised
    from gneiss.operators.context import clean_rewrite

    use = F.coalesce(history, F.lit("")) != ""
    out = F.when(use, F.coalesce(clean_rewrite(rewritten), query)).otherwise(query) if enabled else query
    return F.struct(out.alias("query"), (normalised(out) != normalised(query)).alias("rewritten"))


def new_uploads(found: DataFrame, catalog: DataFrame) -> DataFrame:
    """(path, tenant_id, department, content_hash, outcome) of paths: created, skipped where the tenant has the content, ignored where no part names a department.

    found (path, tenant_id, content_hash), catalog (tenant_id, content_hash); of equal contents in one batch the first path is created.
    """
    known = catalog.select("tenant_id", "content_hash").distinct().withColumn("there", F.lit(True))
    first = found.groupBy("tenant_id", "content_hash").agg(F.min(F.struct(F.col("department").isNull().alias("lost"), "path")).alias("first"))
    joined = found.join(known, ["tenant_id", "content_hash"], "left").join(first, ["tenant_id", "content_hash"], "left")
    outcome = F.when(F.col("department").isNull(), "ignored").when(F.coalesce("there", F.lit(False)) | (F.col("path") != F.col("first.path")), "skipped").otherwise("created")
    return joined.select("path", "tenant_id", "department", "content_hash", outcome.alias("outcome"))


def department_of(path: Column, departments: tuple[str, ...]) -> Column:
    """The first part of a path that names a department."""
    return F.get(F.filter(F.split(path, "/"), lambda p: p.isin(*departments)), F.lit(0))
