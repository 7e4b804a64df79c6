"""Validators: each gives rows of issues (subject, severity, code, message, ...), to be counted or joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gneiss.functions.text import SPACE, meaningful_length

NEAR_EMPTY_DOCUMENT, NEAR_EMPTY_PAGE = 50, 10
LOW_RETENTION, HIGH_EXPANSION = 0.5, 1.2
STRATEGIES = ("fixed_size", "recursive", "sentence", "paragraph", "page_aware", "structure_aware", "table_aware", "json_aware")
CHUNK_TYPES = ("text", "table")
# The payload fields that a stored point has to have.
PAYLOAD = ("chunk_id", "document_id", "tenant_id", "department", "content_hash", "source_filename", "source_file_type", "chunk_index", "chunk_type", "strategy", "text")


def issue(condition: Column, severity: str, code: str, message: str = "", page: Column | None = None, table: Column | None = None) -> Column:
    none = F.lit(None)
    body = F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.lit(message).alias("message"), (page if page is not None else none).cast("int").alias("page_number"), (table if table is not None else none).cast("string").alias("table_id"))
    return F.when(condition, body)


def issues(df: DataFrame, subject: str, *found: Column, nested: list[Column] | None = None) -> DataFrame:
    """(subject, severity, code, message, page_number, table_id) of the conditions that hold; nested: arrays of issues."""
    every = F.array(*found)
    for more in nested or []:
        every = F.concat(every, more)
    held = F.filter(every, lambda i: i.isNotNull())
    return df.select(F.col(subject).cast("string").alias("subject"), F.explode(held).alias("i")).select("subject", "i.*")


def blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(f"[^{SPACE}]")


def raw_issues(docs: DataFrame) -> DataFrame:
    """From rows (doc_id, tenant_id, department, filename, file_type, content_hash, raw_text, pages, tables, warnings, json_ok, path).

    pages: array of (page_number, text, ocr_needed, ocr_used, ocr_failed); tables: array of (table_id, headers, rows).
    """
    required = ("doc_id", "tenant_id", "department", "filename", "file_type", "content_hash")
    parts = F.split("path", "/")
    wrong = (parts[1] != F.col("tenant_id")) | (parts[2] != F.col("department")) | (parts[3] != F.col("content_hash"))
    warned = F.coalesce("warnings", F.array().cast("array<string>"))

    def of_page(p: Column) -> Column:
        n = meaningful_length(F.coalesce(p["text"], F.lit("")))
        page = p["page_number"]
        return F.array(
            issue(blank(p["text"]), "ERROR", "EMPTY_PAGE_TEXT", page=page),
            issue(~blank(p["text"]) & (n < NEAR_EMPTY_PAGE), "WARNING", "NEAR_EMPTY_PAGE_TEXT", page=page),
            issue(p["ocr_needed"] & ~p["ocr_used"], "ERROR", "OCR_NOT_ATTEMPTED", page=page),
            issue(p["ocr_failed"], "ERROR", "OCR_FAILED", page=page),
        )

    def of_table(t: Column) -> Column:
        return F.array(
            issue(t["headers"].isNull(), "ERROR", "INVALID_TABLE_HEADERS", table=t["table_id"]),
            issue(t["rows"].isNull(), "ERROR", "INVALID_TABLE_ROWS", table=t["table_id"]),
            issue(F.size(t["rows"]) == 0, "WARNING", "EMPTY_TABLE", table=t["table_id"]),
        )

    empty = blank(F.col("raw_text")) & F.col("raw_text").isNotNull()
    return issues(
        docs, "doc_id",
        issue(~F.coalesce("json_ok", F.lit(False)), "ERROR", "INVALID_JSON"),
        *[issue(blank(F.col(c).cast("string")), "ERROR", "MISSING_METADATA", c) for c in required],
        issue(F.size(parts) != 5, "ERROR", "INVALID_OUTPUT_PATH"),
        issue((F.size(parts) == 5) & wrong, "ERROR", "PATH_METADATA_MISMATCH"),
        issue(F.col("raw_text").isNull(), "ERROR", "INVALID_RAW_TEXT"),
        issue(empty, "ERROR", "EMPTY_DOCUMENT_TEXT"),
        issue(~blank(F.col("raw_text")) & (meaningful_length(F.col("raw_text")) < NEAR_EMPTY_DOCUMENT), "WARNING", "NEAR_EMPTY_DOCUMENT_TEXT"),
        issue(F.col("warnings").isNull(), "ERROR", "INVALID_WARNINGS_FIELD"),
        issue(F.col("pages").isNull(), "ERROR", "INVALID_PAGES_FIELD"),
        issue(F.col("tables").isNull(), "ERROR", "INVALID_TABLES_FIELD"),
        nested=[
            F.transform(warned, lambda w: issue(w.isNotNull(), "WARNING", "PARSER_WARNING")),
            F.coalesce(F.flatten(F.transform("pages", of_page)), F.array()),
            F.coalesce(F.flatten(F.transform("tables", of_table)), F.array()),
        ],
    )


def clean_issues(pairs: DataFrame) -> DataFrame:
    """From rows (doc_id, clean_doc_id, raw_text, clean_text, raw_pages, clean_pages, raw_tables, clean_tables, steps); pages: array of (page_number, ocr_used), tables: array of (table_id, n_rows), and page_number where both have it.

    Retention compares lengths where the raw text isn't blank.
    """
    paged = all("page_number" in pairs.schema[c].dataType.elementType.names for c in ("raw_tables", "clean_tables"))
    share = F.char_length("clean_text") / F.char_length("raw_text")
    compared = F.col("raw_text").isNotNull() & F.col("clean_text").isNotNull() & ~blank(F.col("raw_text")) & ~blank(F.col("clean_text"))
    same_size = lambda what: F.size(f"raw_{what}") == F.size(f"clean_{what}")
    differ = lambda what, field: same_size(what) & F.exists(F.zip_with(f"raw_{what}", f"clean_{what}", lambda a, b: ~a[field].eqNullSafe(b[field])), lambda x: x)
    return issues(
        pairs, "doc_id",
        issue(F.col("doc_id").isNull() | F.col("clean_doc_id").isNull(), "ERROR", "MISSING_METADATA"),
        issue(F.col("doc_id") != F.col("clean_doc_id"), "ERROR", "DOCUMENT_IDENTITY_MISMATCH"),
        issue(F.col("raw_text").isNull(), "ERROR", "INVALID_RAW_TEXT"),
        issue(F.col("clean_text").isNull(), "ERROR", "INVALID_CLEAN_TEXT"),
        issue(F.col("clean_text").isNotNull() & blank(F.col("clean_text")), "ERROR", "EMPTY_CLEAN_TEXT"),
        issue(compared & (share < LOW_RETENTION), "WARNING", "LOW_TEXT_RETENTION"),
        issue(compared & (share > HIGH_EXPANSION), "WARNING", "UNEXPECTED_TEXT_EXPANSION"),
        issue(F.col("clean_pages").isNull(), "ERROR", "INVALID_CLEAN_PAGES"),
        issue(~same_size("pages"), "ERROR", "PAGE_COUNT_MISMATCH"),
        issue(differ("pages", "page_number"), "ERROR", "PAGE_NUMBER_MISMATCH"),
        issue(differ("pages", "ocr_used"), "ERROR", "PAGE_PROVENANCE_MISMATCH"),
        issue(F.col("clean_tables").isNull(), "ERROR", "INVALID_CLEAN_TABLES"),
        issue(~same_size("tables"), "ERROR", "TABLE_COUNT_MISMATCH"),
        issue(differ("tables", "table_id"), "ERROR", "TABLE_ID_MISMATCH"),
        *([issue(differ("tables", "page_number"), "ERROR", "TABLE_PROVENANCE_MISMATCH")] if paged else []),
        issue(differ("tables", "n_rows"), "ERROR", "TABLE_ROW_COUNT_MISMATCH"),
        issue(F.col("steps").isNull(), "ERROR", "INVALID_CLEANING_STEPS"),
        issue(F.size("steps") == 0, "WARNING", "NO_CLEANING_STEPS_RECORDED"),
    )


def chunk_issues(chunks: DataFrame, size: int) -> DataFrame:
    """From rows (chunk_id, document_id, tenant_id, department, content_hash, each but the first with an expected_ one, strategy, chunk_type, chunk_index, chunk_text, token_count, page_numbers, table_ids, section_path); the second and later rows of an id or place are duplicates."""
    nth = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("document_id", "strategy", "chunk_index", "chunk_text"))
    known = chunks.withColumns({"n_id": nth("chunk_id"), "n_local": nth("document_id", "chunk_id"), "n_place": nth("document_id", "strategy", "chunk_index")})
    return issues(
        known, "chunk_id",
        issue(blank(F.col("chunk_id")), "ERROR", "EMPTY_CHUNK_ID"),
        issue(F.col("n_local") > 1, "ERROR", "DUPLICATE_LOCAL_CHUNK_ID"),
        issue(F.col("n_id") > 1, "ERROR", "DUPLICATE_GLOBAL_CHUNK_ID"),
        issue(F.col("n_place") > 1, "ERROR", "DUPLICATE_STRATEGY_INDEX"),
        issue(F.col("document_id") != F.col("expected_document_id"), "ERROR", "CHUNK_DOCUMENT_MISMATCH"),
        issue(F.col("tenant_id") != F.col("expected_tenant_id"), "ERROR", "CHUNK_TENANT_MISMATCH"),
        issue(F.col("department") != F.col("expected_department"), "ERROR", "CHUNK_DEPARTMENT_MISMATCH"),
        issue(F.col("content_hash") != F.col("expected_content_hash"), "ERROR", "CHUNK_CONTENT_HASH_MISMATCH"),
        issue(~F.col("strategy").isin(*STRATEGIES), "ERROR", "UNKNOWN_STRATEGY"),
        issue(~F.col("chunk_type").isin(*CHUNK_TYPES), "ERROR", "UNKNOWN_CHUNK_TYPE"),
        issue(blank(F.col("chunk_text")), "ERROR", "EMPTY_CHUNK_TEXT"),
        issue(F.col("token_count") <= 0, "ERROR", "INVALID_TOKEN_COUNT"),
        issue(F.col("token_count") > size, "ERROR", "OVERSIZED_CHUNK"),
        issue(F.col("chunk_index") < 0, "ERROR", "NEGATIVE_CHUNK_INDEX"),
        issue((F.col("strategy") == "page_aware") & (F.size("page_numbers") == 0), "ERROR", "MISSING_PAGE_PROVENANCE"),
        issue((F.col("strategy") == "table_aware") & (F.size("table_ids") == 0), "ERROR", "MISSING_TABLE_PROVENANCE"),
        issue((F.col("strategy") == "structure_aware") & (F.size("section_path") == 0), "WARNING", "MISSING_SECTION_PROVENANCE"),
    )


def layout_issues(files: DataFrame, parts: Column) -> DataFrame:
    """Issues of chunk files (path, tenant_id, department, content_hash) whose path (parts: as path_parts gives them) names something else, or isn't laid out so."""
    own = files.withColumn("_p", parts)
    return issues(
        own, "path",
        issue(F.col("_p.tenant_id").isNull(), "ERROR", "INVALID_DIRECTORY_LAYOUT"),
        issue(F.col("_p.tenant_id") != F.col("tenant_id"), "ERROR", "TENANT_PATH_MISMATCH"),
        issue(F.col("_p.department") != F.col("department"), "ERROR", "DEPARTMENT_PATH_MISMATCH"),
        issue(F.col("_p.content_hash") != F.col("content_hash"), "ERROR", "CONTENT_HASH_PATH_MISMATCH"),
    )


def manifest_issues(manifests: DataFrame, chunks: DataFrame) -> DataFrame:
    """Issues of manifests (document_id, chunks, by_strategy, by_type: maps of counts) against chunks (document_id, strategy, chunk_type)."""
    gathered = lambda name: chunks.groupBy("document_id", name).agg(F.count("*").alias("n")).groupBy("document_id").agg(F.sum("n").alias(f"{name}_n"), F.array_sort(F.collect_list(F.struct(name, "n"))).alias(f"{name}_own"))  # noqa: E731 - of a fixed number of names
    listed = lambda name: F.array_sort(F.transform(F.map_entries(name), lambda e: F.struct(e["key"].alias("k"), e["value"].cast("long").alias("n"))))
    plain = lambda name, own: F.transform(own, lambda e: F.struct(e[name].alias("k"), e["n"].alias("n")))
    both = manifests.join(gathered("strategy").join(gathered("chunk_type"), "document_id"), "document_id", "full")
    names = lambda found: F.transform(found, lambda e: e["k"])
    s, t = plain("strategy", F.col("strategy_own")), plain("chunk_type", F.col("chunk_type_own"))
    return issues(
        both, "document_id",
        issue(F.col("strategy_n").isNull(), "ERROR", "MISSING_CHUNKS"),
        issue(F.col("chunks").isNull(), "ERROR", "MISSING_MANIFEST"),
        issue(F.col("chunks") != F.col("strategy_n"), "ERROR", "MANIFEST_CHUNK_COUNT_MISMATCH"),
        issue(names(listed("by_strategy")) != names(s), "ERROR", "MANIFEST_STRATEGY_SET_MISMATCH"),
        issue((names(listed("by_strategy")) == names(s)) & (listed("by_strategy") != s), "ERROR", "STRATEGY_COUNT_MISMATCH"),
        issue(listed("by_type") != t, "ERROR", "CHUNK_TYPE_COUNT_MISMATCH"),
    )


def embedding_file_issues(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Issues by document of vectors (document_id, position, chunk_id, model_name, embedding_version) against chunks (document_id, position, chunk_id): the file, the count, the order of ids, one model and version."""
    pairs = chunks.select("document_id", "position", F.col("chunk_id").alias("wanted")).join(vectors, ["document_id", "position"], "full")
    each = pairs.groupBy("document_id").agg(
        F.count("wanted").alias("n"), F.count("chunk_id").alias("m"), F.count_if(F.col("wanted") != F.col("chunk_id")).alias("moved"),
        (F.min("model_name") != F.max("model_name")).alias("models"), (F.min("embedding_version") != F.max("embedding_version")).alias("versions"),
    )
    return issues(
        each, "document_id",
        issue((F.col("m") == 0) & (F.col("n") > 0), "ERROR", "MISSING_EMBEDDING_FILE"),
        issue((F.col("m") > 0) & (F.col("m") != F.col("n")), "ERROR", "EMBEDDING_COUNT_MISMATCH"),
        issue(F.col("moved") > 0, "ERROR", "CHUNK_ORDER_MISMATCH"),
        issue(F.col("models"), "ERROR", "MODEL_NOT_CONSTANT"),
        issue(F.col("versions"), "ERROR", "VERSION_NOT_CONSTANT"),
    )


def embedding_issues(chunks: DataFrame, vectors: DataFrame, dimension: int) -> DataFrame:
    """From chunks (chunk_id) and vectors (chunk_id, vector): missing, unknown, repeated, empty, of another dimension, not finite."""
    own = vectors.withColumn("n", F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.size("vector"))))
    missing = issues(chunks.select("chunk_id").distinct().join(vectors.select("chunk_id").distinct(), "chunk_id", "left_anti"), "chunk_id", issue(F.lit(True), "ERROR", "MISSING_EMBEDDING"))
    unknown = issues(vectors.select("chunk_id").distinct().join(chunks.select("chunk_id").distinct(), "chunk_id", "left_anti"), "chunk_id", issue(F.lit(True), "ERROR", "UNKNOWN_CHUNK"))
    finite = F.forall("vector", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return missing.unionByName(unknown).unionByName(
        issues(
            own, "chunk_id",
            issue(F.col("n") > 1, "ERROR", "DUPLICATE_EMBEDDING"),
            issue(F.col("vector").isNull() | (F.size("vector") == 0), "ERROR", "EMPTY_VECTOR"),
            issue((F.size("vector") > 0) & (F.size("vector") != dimension), "ERROR", "DIMENSION_MISMATCH"),
            issue(~finite, "ERROR", "NON_FINITE_VECTOR"),
        )
    )


def embedding_identity_issues(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Issues of vectors (document_id, position, chunk_id, tenant_id, department) at the places of chunks of the same columns: whose they are, and ids that a document or the corpus has twice.

    Of an id's rows the first by document and position is no duplicate; a second one of the same document is one of the document and of the corpus. Ids are counted by
    partial aggregates, so a frequent one isn't gathered.
    """
    place = ["document_id", "position"]
    pairs = vectors.join(chunks.select(*place, *[F.col(c).alias(f"chunk_{c}") for c in ("tenant_id", "department")]), place, "left")
    local = vectors.groupBy("document_id", "chunk_id").agg(F.min("position").alias("first_place"))
    first = vectors.groupBy("chunk_id").agg(F.min("document_id").alias("first_document"))
    known = pairs.join(local, ["document_id", "chunk_id"]).join(first, "chunk_id")
    again = F.col("position") > F.col("first_place")
    other = lambda c: F.col(f"chunk_{c}").isNotNull() & ~F.col(c).eqNullSafe(F.col(f"chunk_{c}"))
    return issues(
        known, "chunk_id",
        issue(F.col("chunk_tenant_id").isNull() & F.col("chunk_department").isNull(), "ERROR", "DOCUMENT_MISMATCH"),
        issue(other("tenant_id"), "ERROR", "TENANT_MISMATCH"),
        issue(other("department"), "ERROR", "DEPARTMENT_MISMATCH"),
        issue(again, "ERROR", "DUPLICATE_LOCAL_EMBEDDING"),
        issue(again | (F.col("document_id") > F.col("first_document")), "ERROR", "DUPLICATE_GLOBAL_EMBEDDING"),
    )


def point_count_issues(points: DataFrame, stated: int) -> DataFrame:
    """The issue of a collection that states another number of points than it has."""
    return issues(points.agg(F.count("*").alias("n")).withColumn("collection", F.lit("collection")), "collection", issue(F.col("n") != stated, "ERROR", "POINT_COUNT_MISMATCH"))


def vector_issues(points: DataFrame, dimension: int) -> DataFrame:
    """From points of (PAYLOAD columns, vector); missing_fields lists the payload fields that are null."""
    missing = F.filter(F.array(*[F.when(F.col(c).isNull(), c) for c in PAYLOAD]), lambda c: c.isNotNull())
    own = points.withColumn("n", F.row_number().over(Window.partitionBy("chunk_id").orderBy("document_id", "chunk_index")))
    return issues(
        own, "chunk_id",
        issue(F.size(missing) > 0, "ERROR", "MISSING_PAYLOAD_FIELDS"),
        issue(F.col("n") > 1, "ERROR", "DUPLICATE_CHUNK"),
        issue(F.col("vector").isNull(), "ERROR", "MISSING_VECTOR"),
        issue(F.size("vector") != dimension, "ERROR", "DIMENSION_MISMATCH"),
        issue(blank(F.col("text")), "ERROR", "EMPTY_TEXT"),
    )


def dataset_issues(cases: DataFrame, files: DataFrame) -> DataFrame:
    """From cases (case_id, query, tenant_id, department, relevant) and files (filename): blanks, repeated queries, relevant files that don't exist."""
    nth = F.row_number().over(Window.partitionBy("query").orderBy("case_id"))
    there = cases.select("case_id", F.explode_outer("relevant").alias("filename")).join(files.select("filename").distinct().withColumn("known", F.lit(True)), "filename", "left")
    lost = there.groupBy("case_id").agg(F.count_if(F.col("filename").isNotNull() & F.col("known").isNull()).alias("lost"))
    return issues(
        cases.withColumn("n", nth).join(lost, "case_id"), "case_id",
        issue(blank(F.col("query")), "ERROR", "EMPTY_QUERY"),
        issue(~blank(F.col("query")) & (F.col("n") > 1), "ERROR", "DUPLICATE_QUERY"),
        issue(blank(F.col("tenant_id")), "ERROR", "MISSING_TENANT"),
        issue(blank(F.col("department")), "ERROR", "MISSING_DEPARTMENT"),
        issue(F.coalesce(F.size("relevant"), F.lit(0)) <= 0, "ERROR", "NO_RELEVANT_DOCUMENTS"),
        issue(F.col("lost") > 0, "ERROR", "UNKNOWN_RELEVANT_DOCUMENT"),
    )


def status(subjects: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """(key, status): ERROR, WARNING or CLEAN."""
    worst = found.groupBy("subject").agg(F.max(F.when(F.col("severity") == "ERROR", 2).otherwise(1)).alias("worst"))
    joined = subjects.select(F.col(key).cast("string").alias("subject")).distinct().join(worst, "subject", "left")
    return joined.select(F.col("subject").alias(key), F.when(F.col("worst") == 2, "ERROR").when(F.col("worst") == 1, "WARNING").otherwise("CLEAN").alias("status"))


def counts(found: DataFrame) -> DataFrame:
    return found.groupBy("severity", "code").agg(F.count("*").alias("n"))


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
