r"""Chat formatting by prefix-target expansion: one example per assistant turn, all turns before it as context.

A turn is written ``<turn ROLE>\nTEXT</turn>\n``. In roles and texts a backslash becomes two, ``<`` becomes
``\l`` and ``>`` becomes ``\g``, so that angle brackets stand only in marks; reading turns this back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

TRAINED_ROLE = "assistant"
OPEN, MIDDLE, CLOSE = "<turn ", ">\n", "</turn>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescape(text: Column) -> Column:
    """Pairs of backslashes are taken off from the left first, so a lone one always begins ``\\l`` or ``\\g``."""
    plain = F.transform(F.split(text, r"\\\\"), lambda p: F.replace(F.replace(p, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">")))
    return F.array_join(plain, "\\")


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, example, trained, text, loss_start, loss_end) from rows (conv_id, turn, role, text).

    Every assistant turn gives an example: the turns before it, then the turn; loss_start and loss_end (code
    points, end exclusive) mask its reply. Where other turns follow the last assistant turn, or there is none, a
    last example without loss (trained false, mask 0 to 0) holds the whole conversation, so that the output loses
    no turn. Turns are ordered by turn, role and text, nulls first; repeated rows are repeated turns. A null role
    or text is empty; null conv_ids form one conversation. No rows give no examples. Other columns are ignored.

    The output of a conversation of n turns is quadratic in n by the method's nature; one conversation is held in
    one task, as its last example holds it whole.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = turns.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    opened = lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(MIDDLE))
    whole = whole.select(
        "conv_id",
        F.transform("ts", lambda t: F.concat(opened(t), escape(t["text"]), F.lit(CLOSE))).alias("parts"),
        F.transform("ts", lambda t: F.char_length(opened(t))).alias("heads"),
        F.transform("ts", lambda t: t["role"] == TRAINED_ROLE).alias("trained"),
    )
    at = F.sequence(F.lit(1), F.size("parts"))
    ends = F.filter(at, lambda i: F.element_at("trained", i) | (i == F.size("parts")))
    one = whole.select("*", F.posexplode(ends).alias("example", "n"))
    before = F.array_join(F.slice("parts", F.lit(1), F.col("n") - 1), "")
    trained = F.element_at("trained", F.col("n"))
    start = F.char_length(before) + F.element_at("heads", F.col("n"))
    end = F.char_length(before) + F.char_length(F.element_at("parts", F.col("n"))) - len(CLOSE)
    return one.select(
        "conv_id",
        F.col("example").cast("int"),
        trained.alias("trained"),
        F.array_join(F.slice("parts", F.lit(1), F.col("n")), "").alias("text"),
        F.when(trained, start).otherwise(0).cast("int").alias("loss_start"),
        F.when(trained, end).otherwise(0).cast("int").alias("loss_end"),
    )


def read_turns(text: Column) -> Column:
    """The (role, text) structs of a formatted example."""
    parts = F.filter(F.split(text, CLOSE), lambda p: p != "")
    role = lambda p: F.substr(p, F.lit(len(OPEN) + 1), F.instr(p, F.lit(MIDDLE)) - len(OPEN) - 1)
    body = lambda p: F.substr(p, F.instr(p, F.lit(MIDDLE)) + len(MIDDLE))
    return F.transform(parts, lambda p: F.struct(unescape(role(p)).alias("role"), unescape(body(p)).alias("text")))


def digest_chats(examples: DataFrame) -> DataFrame:
    """What the examples of each conversation hold, read back from their text and masks.

    The last example has all turns; the masked replies are joined in order. One row per conv_id.
    """
    loss = unescape(F.substr("text", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    each = examples.select("conv_id", "example", F.when(F.col("trained"), loss).otherwise("").alias("loss"), F.char_length("text").cast("long").alias("chars"), "text")
    got = each.groupBy("conv_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda e: e["loss"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
        F.max_by("text", "example").alias("last"),
        F.count("*").alias("n_examples"),
    )
    got = got.withColumn("ts", read_turns(F.col("last")))
    joined = F.array_join(F.transform("ts", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return got.select(
        "conv_id",
        F.size("ts").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
    )
