"""Document profiles, and the routing of documents to chunking strategies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gneiss.functions.text import SPACE, token_count

# Heading and paragraph forms, and the file types of each route.
MARKDOWN_HEADING = r"^#{1,6}\s+\S.+$"
NUMBERED_HEADING = r"^(?:\d+\.)+\s*\S.+$"
UPPERCASE_HEADING = r"^[A-Z][A-Z0-9\s/&(),:'-]{2,100}$"
PARAGRAPH = r"(?s)\S(?:.*?\S)?(?=\n\s*\n|\z)"
STRUCTURED_TYPES = (".md", ".markdown", ".html", ".docx")
TABLE_TYPES = (".csv", ".xlsx")
SHORT = 512


def headings(text: Column) -> Column:
    """The number of lines that look like headings."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, f"^[{SPACE}]+|[{SPACE}]+$", ""))
    upper = lambda x: x.rlike(UPPERCASE_HEADING) & (token_count(x).between(1, 15)) & (F.char_length(x) <= 120)
    return F.size(F.filter(lines, lambda x: x.rlike(MARKDOWN_HEADING) | x.rlike(NUMBERED_HEADING) | upper(x)))


def paragraphs(text: Column) -> Column:
    """A one-character paragraph goes with the next, as the form's tail is optional but taken first."""
    return F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0))


def profile(docs: DataFrame) -> DataFrame:
    """docs (doc_id, file_type, text, pages, tables) without those, with counts, flags and structure_confidence.

    pages: array of texts; tables: array of row counts. Null texts are empty, null arrays have nothing.
    """
    text = F.coalesce("text", F.lit(""))
    base = docs.withColumn("text", text).withColumn("p", paragraphs(text)).withColumn("heading_count", headings(text))
    n, h = F.size("p"), F.col("heading_count")
    filled = F.size(F.filter(F.coalesce("pages", F.array().cast("array<string>")), lambda x: x.rlike(f"[^{SPACE}]")))
    rowed = F.size(F.filter(F.coalesce("tables", F.array().cast("array<int>")), lambda x: x > 0))
    sums = [F.when(c, w).otherwise(0.0) for c, w in ((h >= 1, 0.25), (h >= 3, 0.25), (n >= 2, 0.20), (n >= 5, 0.15), ((h > 0) & (n > h), 0.15))]
    score = F.when(text.rlike(f"[^{SPACE}]"), F.least(F.round(sum(sums[1:], sums[0]), 6), F.lit(1.0))).otherwise(0.0)
    average = F.when(n == 0, 0.0).otherwise(F.round(F.aggregate("p", F.lit(0), lambda a, x: a + token_count(x)) / n, 6))
    return base.select(
        *[c for c in docs.columns if c not in ("text", "pages", "tables")],
        F.char_length("text").alias("character_count"), token_count(F.col("text")).alias("token_count"), "heading_count", n.alias("paragraph_count"), average.alias("average_paragraph_tokens"),
        (filled > 0).alias("has_pages"), (rowed > 0).alias("has_tables"), score.alias("structure_confidence"), (score >= 0.5).alias("has_structure"), (token_count(F.col("text")) <= SHORT).alias("is_short"),
    )


def route(profiles: DataFrame) -> DataFrame:
    """profiles with decisions, structs of priority, strategy and content, by falling priority and then strategy, and error where none fits."""
    kind, tokens, tables = F.lower("file_type"), F.col("token_count"), F.col("has_tables")
    one = lambda strategy, content, priority: F.struct(F.lit(-priority).alias("order"), F.lit(strategy).alias("strategy"), F.lit(content).alias("content"))
    none = F.array().cast("array<struct<order:int,strategy:string,content:string>>")
    with_tables = F.when(tables, F.array(one("table_aware", "tables", 90))).otherwise(none)
    plain = F.array(one("recursive", "text", 50))
    pdf = F.when(F.col("has_pages"), F.array(one("page_aware", "text", 100))).when(tokens > 0, plain).otherwise(none)
    chosen = (
        F.when(kind == ".json", F.array(one("json_aware", "text", 100)))
        .when(kind.isin(*TABLE_TYPES), F.when(tables, F.array(one("table_aware", "tables", 100))).otherwise(plain))
        .when(kind == ".pdf", F.concat(pdf, with_tables))
        .when(kind.isin(*STRUCTURED_TYPES), F.concat(F.when(F.col("has_structure"), F.array(one("structure_aware", "text", 100))).otherwise(plain), with_tables))
        .when(kind == ".txt", plain)
        .otherwise(F.array(one("recursive", "text", 10)))
    )
    sorted_ = F.array_sort(F.array_distinct(chosen))
    out = F.transform(sorted_, lambda d: F.struct((-d["order"]).alias("priority"), d["strategy"].alias("strategy"), d["content"].alias("content")))
    return profiles.withColumn("decisions", out).withColumn("error", F.when(F.size("decisions") == 0, "no strategy fits the document"))


def combination(decisions: Column) -> Column:
    return F.array_join(F.transform(decisions, lambda d: d["strategy"]), "+")
