"""Context assembly, prompts and conversation memory: ordered folds over each query's ranked rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gneiss.functions.text import SPACE, normalised, outer_space, terms, token_count

BUDGET = 3000
UNITS = 3


def dedupe_fold(rows: Column) -> Column:
    """Of ordered structs with id and text, those whose id and normalised text no kept one has. A dropped row registers neither."""
    start = F.struct(F.array().cast("array<string>").alias("ids"), F.array().cast("array<string>").alias("texts"), F.slice(rows, 1, 0).alias("kept"))

    def step(state: Column, row: Column) -> Column:
        seen = F.array_contains(state["ids"], row["id"].cast("string")) | F.array_contains(state["texts"], normalised(row["text"]))
        return F.when(seen, state).otherwise(
            F.struct(F.array_append(state["ids"], row["id"].cast("string")).alias("ids"), F.array_append(state["texts"], normalised(row["text"])).alias("texts"), F.array_append(state["kept"], row).alias("kept"))
        )

    return F.aggregate(rows, start, step, lambda s: s["kept"])


def budget_fold(rows: Column, budget: int = BUDGET, size: str = "tokens") -> Column:
    """Of ordered structs, those that still fit the budget when their turn comes; one that doesn't is skipped and later ones may fit. Sizes under 1 are dropped."""
    start = F.struct(F.lit(0).cast("long").alias("total"), F.slice(rows, 1, 0).alias("kept"))

    def step(state: Column, row: Column) -> Column:
        fits = (row[size] > 0) & (state["total"] + row[size] <= budget)
        return F.when(fits, F.struct((state["total"] + row[size].cast("long")).alias("total"), F.array_append(state["kept"], row).alias("kept"))).otherwise(state)

    return F.aggregate(rows, start, step, lambda s: s["kept"])


def build_context(hits: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(query_id, position, doc_id, text, tokens) from ranked hits (query_id, rank, doc_id, text): deduplicated, then within the budget."""
    rows = F.sort_array(F.collect_list(F.struct("rank", F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), token_count(F.coalesce("text", F.lit(""))).alias("tokens"))))
    kept = hits.groupBy("query_id").agg(rows.alias("rows")).select("query_id", F.posexplode(budget_fold(dedupe_fold(F.col("rows")), budget)).alias("position", "row"))
    return kept.select("query_id", "position", F.col("row.id").alias("doc_id"), F.col("row.text").alias("text"), F.col("row.tokens").alias("tokens"))


def content_units(text: Column) -> Column:
    """Blocks between blank lines; a block of two lines or more with a bar is a table and gives its lines."""
    blocks = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda x: F.trim(x)), lambda b: b != "")
    lines = lambda b: F.filter(F.transform(F.split(b, "\n"), lambda x: F.trim(x)), lambda line: line != "")
    barred = lambda b: F.size(F.filter(lines(b), lambda line: F.contains(line, F.lit("|")))) >= 2
    return F.flatten(F.transform(blocks, lambda b: F.when(barred(b), lines(b)).otherwise(F.array(b))))


def select_units(query: Column, text: Column, most: int = UNITS) -> Column:
    """The text's units that share most terms with the query, in their own order; its first units if none does; the text itself without query terms."""
    asked, units = terms(query), content_units(text)
    scored = F.transform(units, lambda u, k: F.struct((-F.size(F.array_intersect(asked, terms(u)))).alias("n"), k.alias("k"), u.alias("u")))
    best = F.slice(F.array_sort(F.filter(scored, lambda s: s["n"] < 0)), 1, most)
    chosen = F.transform(F.array_sort(F.transform(best, lambda s: F.struct(s["k"].alias("k"), s["u"].alias("u")))), lambda s: s["u"])
    return F.when(F.size(asked) == 0, text).otherwise(F.array_join(F.when(F.size(chosen) > 0, chosen).otherwise(F.slice(units, 1, most)), "\n\n"))


def prompt(query: Column, blocks: Column, history: Column | None = None) -> Column:
    """A deterministic prompt: rules, history where there is one, numbered source blocks, the question. blocks: structs of source and text."""
    shown = F.array_join(F.transform(blocks, lambda b, k: F.concat(F.lit('<document id="'), (k + 1).cast("string"), F.lit('" source="'), b["source"], F.lit('">\n'), b["text"], F.lit("\n</document>"))), "\n\n")
    before = F.lit("") if history is None else F.when(history != "", F.concat(F.lit("Conversation so far:\n"), history, F.lit("\n\n"))).otherwise("")
    return F.concat(F.lit("Answer from the documents only and cite their sources in brackets.\n\n"), before, F.lit("Documents:\n"), shown, F.lit("\n\nQuestion: "), query)


def memory(turns: DataFrame, last: int = 5, characters: int = 6000) -> DataFrame:
    """(tenant_id, conversation_id, position, turn_no, user_message, assistant_message): of each conversation's last turns, from the newest back those that still fit, in their own order."""
    order = Window.partitionBy("tenant_id", "conversation_id").orderBy(F.col("turn_no").desc())
    recent = turns.withColumn("age", F.row_number().over(order)).where(F.col("age") <= last)
    size = F.char_length("user_message") + F.char_length("assistant_message")
    rows = F.sort_array(F.collect_list(F.struct("age", "turn_no", "user_message", "assistant_message", size.alias("tokens"))))
    kept = recent.groupBy("tenant_id", "conversation_id").agg(F.reverse(budget_fold(rows, characters)).alias("rows"))
    one = kept.select("tenant_id", "conversation_id", F.posexplode("rows").alias("position", "row"))
    return one.select("tenant_id", "conversation_id", "position", "row.turn_no", "row.user_message", "row.assistant_message")


def paired_turns(messages: DataFrame) -> DataFrame:
    """(conv_id, turn_no, user_message, assistant_message): each user message that an assistant's follows, from rows (conv_id, turn, role, text)."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    ahead = messages.withColumns({"next_role": F.lead("role").over(order), "next_text": F.lead("text").over(order)})
    found = ahead.where("role = 'user' and next_role = 'assistant'")
    return found.select("conv_id", F.col("turn").alias("turn_no"), F.col("text").alias("user_message"), F.col("next_text").alias("assistant_message"))


# What a rewriting model puts before its query, and prompt tags that make its output invalid.
PREFIXES = ("standalone query:", "standalone retrieval query:", "rewritten query:", "contextualized query:", "retrieval query:")
PROMPT_TAGS = ("<conversation_history>", "<current_query>", "<task>")


def clean_rewrite(text: Column) -> Column:
    """A rewritten query without a pair of outer quotes and one known prefix, white space collapsed; null where it is empty, over 1000 characters or holds a prompt tag."""
    out = outer_space(text)
    out = outer_space(F.regexp_replace(out, "(?s)^([\"'])(.*)\\1$", "$2"))
    out = F.trim(F.regexp_replace(F.regexp_replace(out, f"(?i)^(?:{'|'.join(PREFIXES)})", ""), f"[{SPACE}]+", " "))
    bad = (out == "") | (F.char_length(out) > 1000) | out.rlike("|".join(PROMPT_TAGS))
    return F.when(bad, F.lit(None).cast("string")).otherwise(out)
