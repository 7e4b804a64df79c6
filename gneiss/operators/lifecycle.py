"""What changes or selects stored documents, chunks, answers and conversations: cleaning whole documents, deletes, appends, filters and round-trip checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gneiss.functions.text import CLEANING, SPACE, clean, clean_cells, clean_each
from gneiss.operators.evaluation import ABSTENTION_ANSWER
from gneiss.operators.validation import blank, issue, issues

CLEANING_VERSION = "1.0"
# What a page's warnings say where no text could be recognised, and the states of documents that can be indexed.
OCR_FAILURES = ("OCR failed", "OCR returned no text")
INDEXABLE = ("COMPLETED", "READY")
#: What a stored vector keeps of its chunk.
PROVENANCE = ("chunk_type", "strategy", "chunk_index", "page_numbers", "table_ids", "section_path", "source_filename", "source_file_type", "source_s3_key", "content_hash")


def clean_documents(docs: DataFrame) -> DataFrame:
    """docs (raw_text, pages, tables, ...) with pages and tables cleaned, clean_text, cleaning_steps and cleaning_version.

    pages: structs of page_number and text; tables: structs of table_id, headers and rows. Where there are pages, clean_text is those
    with text, each under its number; else it is the raw text, cleaned. Null cells stay null.
    """
    texts = clean_each(F.transform("pages", lambda p: p["text"]))
    cells = clean_cells(F.transform("tables", lambda t: F.concat(F.array(t["headers"]), t["rows"])))
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("pages", "tables")]
    done = docs.select(*rest, "pages", "tables", texts.alias("_texts"), cells.alias("_cells"))
    pages = F.zip_with("pages", "_texts", lambda p, t: F.struct(p["page_number"].alias("page_number"), t.alias("text")))
    tables = F.zip_with("tables", "_cells", lambda t, c: F.struct(t["table_id"].alias("table_id"), c[0].alias("headers"), F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))).alias("rows")))
    done = done.select(*rest, pages.alias("pages"), tables.alias("tables"))
    shown = F.array_join(F.transform(F.filter("pages", lambda p: p["text"] != ""), lambda p: F.concat(F.lit("Page "), p["page_number"].cast("string"), F.lit("\n"), p["text"])), "\n\n")
    return done.withColumns({"clean_text": F.when(F.size("pages") > 0, shown).otherwise(clean(F.col("raw_text"))), "cleaning_steps": F.array(*map(F.lit, CLEANING)), "cleaning_version": F.lit(CLEANING_VERSION)})


def delete_document(stored: DataFrame, document_id: Column, tenant_id: Column) -> DataFrame:
    """stored (document_id, tenant_id, ...) without the tenant's rows of the document; rows with a null id or tenant stay."""
    return stored.where(~F.coalesce((F.col("document_id") == document_id) & (F.col("tenant_id") == tenant_id), F.lit(False)))


def cacheable(answer: Column, sources: Column, grounded: Column) -> Column:
    """Whether an answer may be cached: grounded, with sources, and no abstention."""
    return F.coalesce(grounded & (F.size(sources) > 0) & (answer != ABSTENTION_ANSWER), F.lit(False))


def cache_insert(stored: DataFrame, fresh: DataFrame, key: str = "entry_id") -> DataFrame:
    """stored with the rows of fresh in place of those of equal key; fresh rows whose answer_departments are null or empty are refused."""
    allowed = fresh.where(F.size("answer_departments") > 0)
    return stored.join(allowed.select(key).distinct(), key, "left_anti").unionByName(allowed.dropDuplicates([key]))


def failed_pages(docs: DataFrame) -> DataFrame:
    """(doc_id, pages) of documents with pages (page_number, warnings) that recognition failed on."""
    failed = F.filter("pages", lambda p: F.exists(p["warnings"], lambda w: w.rlike("|".join(OCR_FAILURES))))
    return docs.select("doc_id", F.transform(failed, lambda p: p["page_number"]).alias("pages")).where(F.size("pages") > 0)


def relevant_chunks(chunks: DataFrame, relevant: DataFrame) -> DataFrame:
    """The chunks (filename, ...) of files that some query (filename) should have found, to look into misses."""
    return chunks.join(relevant.select("filename").distinct(), "filename", "left_semi")


def indexable(documents: DataFrame, key: str = "document_id") -> DataFrame:
    """The documents whose status lets them be indexed, by key."""
    return documents.where(F.col("status").isin(*INDEXABLE)).orderBy(key)


def best_configuration(grid: DataFrame, order: str) -> DataFrame:
    """The row of the best recall_5, then mrr, recall_1 and recall_3; of equal ones the first by order."""
    return grid.orderBy(*[F.col(c).desc_nulls_last() for c in ("recall_5", "mrr", "recall_1", "recall_3")], order).limit(1)


def add_turns(turns: DataFrame, fresh: DataFrame, order: str) -> DataFrame:
    """turns (tenant_id, conversation_id, turn_no, user_message, assistant_message) with the fresh ones appended, each once, stripped, numbered on by order.

    Fresh rows with a blank or null tenant, conversation or message are left out; rejected_turns has them.
    """
    keys = ["tenant_id", "conversation_id"]
    stripped = fresh.where(~_rejected()).select(*[_stripped(c).alias(c) for c in (*keys, "user_message", "assistant_message")], F.col(order).alias("_order"))
    last = turns.groupBy(*keys).agg(F.max("turn_no").alias("_last"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("_order", "user_message", "assistant_message"))
    placed = stripped.withColumn("_n", nth).join(last, keys, "left").select(*keys, (F.coalesce("_last", F.lit(-1)) + F.col("_n")).cast(turns.schema["turn_no"].dataType).alias("turn_no"), "user_message", "assistant_message")
    return turns.select(*placed.columns).unionByName(placed)


def rejected_turns(fresh: DataFrame) -> DataFrame:
    return fresh.where(_rejected())


def _rejected() -> Column:
    return blank(F.col("tenant_id")) | blank(F.col("conversation_id")) | blank(F.col("user_message")) | blank(F.col("assistant_message"))


def _stripped(name: str) -> Column:
    return F.regexp_replace(name, f"^[{SPACE}]+|[{SPACE}]+$", "")


def clear_conversations(turns: DataFrame, cleared: DataFrame) -> DataFrame:
    """turns without the conversations (tenant_id, conversation_id) of cleared."""
    return turns.join(cleared.select("tenant_id", "conversation_id").distinct(), ["tenant_id", "conversation_id"], "left_anti")


def round_trip_issues(expected: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Issues of a table as it was read back: rows that are missing, unknown, repeated or changed, by key."""
    others = [c for c in expected.columns if c != key]
    digest = F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`").alias("v"))) for c in others]) if others else F.lit(0)
    rows = lambda df, n: df.groupBy(key).agg(F.count("*").alias(f"n{n}"), F.min(digest).alias(f"d{n}"), F.max(digest).alias(f"e{n}"))
    both = rows(expected, 1).join(rows(stored, 2), key, "full")
    return issues(
        both, key,
        issue(F.col("n2").isNull(), "ERROR", "MISSING_ROW"),
        issue(F.col("n1").isNull(), "ERROR", "UNKNOWN_ROW"),
        issue(F.col("n1") != F.col("n2"), "ERROR", "COUNT_MISMATCH"),
        issue((F.col("d1") != F.col("d2")) | (F.col("e1") != F.col("e2")), "ERROR", "CHANGED_ROW"),
    )


def unpaired(raw: DataFrame, cleaned: DataFrame, key: str) -> DataFrame:
    """Issues of raw documents without a clean one, and of clean ones without a raw one."""
    lost = issues(raw.select(key).distinct().join(cleaned.select(key).distinct(), key, "left_anti"), key, issue(F.lit(True), "ERROR", "MISSING_CLEAN_DOCUMENT"))
    return lost.unionByName(issues(cleaned.select(key).distinct().join(raw.select(key).distinct(), key, "left_anti"), key, issue(F.lit(True), "ERROR", "MISSING_RAW_DOCUMENT")))


def request_issues(requests: DataFrame, key: str = "request_id") -> DataFrame:
    """Issues of requests (key, query): a query has one character at least."""
    return issues(requests, key, issue(F.coalesce(F.length("query"), F.lit(0)) < 1, "ERROR", "EMPTY_QUERY"))


def rewrite_statistics(rewrites: DataFrame) -> DataFrame:
    """One row of rewrites (rewritten, original_tokens, query_tokens): queries, rewritten, unchanged and mean token counts."""
    return rewrites.agg(F.count("*").alias("queries"), F.count_if("rewritten").alias("rewritten"), F.count_if(~F.col("rewritten")).alias("unchanged"), F.round(F.avg("original_tokens"), 6).alias("original_tokens"), F.round(F.avg("query_tokens"), 6).alias("query_tokens"))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases of a JSON array file; lists that a case leaves out are empty."""
    schema = "name string, query string, tenant_id string, department string, expected_behavior string, expected_facts array<array<string>>, expected_sources array<string>"
    found = spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    return found.withColumns({"expected_facts": F.coalesce("expected_facts", F.array().cast("array<array<string>>")), "expected_sources": F.coalesce("expected_sources", F.array().cast("array<string>"))})


def provenance(chunks: DataFrame) -> DataFrame:
    """chunks with metadata: the struct of what a stored vector keeps of its chunk."""
    return chunks.withColumn("metadata", F.struct(*PROVENANCE))


def ensure(stored: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """stored with the wanted rows whose keys it doesn't have yet, each once; what is stored stays as it is."""
    return stored.unionByName(wanted.dropDuplicates(list(keys)).join(stored.select(*keys).distinct(), list(keys), "left_anti").select(*stored.columns))


def manifest_by_type(chunks: DataFrame, *config: Column) -> DataFrame:
    """(document_id, chunks, by_strategy, by_type, config): a document's chunks in all, by strategy and by type, as maps in order of their names, and the configuration."""
    named = lambda name: F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, "n"))))
    counted = lambda name: chunks.groupBy("document_id", name).agg(F.count("*").alias("n")).groupBy("document_id").agg(F.sum("n").alias("chunks"), named(name).alias(f"by_{name}"))
    by_type = counted("chunk_type").select("document_id", F.col("by_chunk_type").alias("by_type"))
    return counted("strategy").join(by_type, "document_id").withColumn("config", F.struct(*config)) if config else counted("strategy").join(by_type, "document_id")


def strategies_issues(decisions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Issues of documents whose chunks' strategies aren't those that they were routed to."""
    gathered = lambda df, name: df.groupBy("doc_id").agg(F.array_sort(F.collect_set("strategy")).alias(name))  # noqa: E731 - of a fixed number of strategies
    both = gathered(decisions, "routed").join(gathered(chunks, "found"), "doc_id", "full")
    none = F.array().cast("array<string>")
    return issues(both, "doc_id", issue(F.coalesce("routed", none) != F.coalesce("found", none), "ERROR", "STRATEGY_MISMATCH"))
