"""Text and hash expressions over columns."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, SparkSession, functions as F
from pyspark.sql.types import ArrayType, StringType

from gneiss.shared import small_batches

# What counts as white space in text (the inside of a character class), and the English stop words and phrases in use.
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LINE_SPACE = r"\t\x0b-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "what", "when", "where", "with")
WORD = r"[\p{L}\p{N}_]+"
TOKEN = f"[^{SPACE}]+"


def normalised(text: Column) -> Column:
    """Lower case, white space collapsed to single spaces, outer white space off."""
    return F.trim(F.regexp_replace(F.lower(text), f"[{SPACE}]+", " "))


def tokens(text: Column) -> Column:
    """Runs of anything but white space."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def token_count(text: Column) -> Column:
    return F.size(tokens(text))


def word_tokens(text: Column) -> Column:
    """The sparse index's words: letters, digits and underscores of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def terms(text: Column) -> Column:
    """Distinct ASCII words of two characters or more that aren't stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_except(F.filter(found, lambda t: F.length(t) > 1), F.array(*map(F.lit, STOP_WORDS)))


def meaningful_length(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """Compatibility composition; texts of ASCII alone, which it never changes, don't leave the JVM's row."""
    small_batches(SparkSession.active())
    return F.when(text.rlike(r"[^\x00-\x7f]"), _nfkc(text)).otherwise(text)


def _composed(value):
    """NFKC of a string, or of those in nested lists; null stays."""
    return value if value is None else unicodedata.normalize("NFKC", value) if isinstance(value, str) else [_composed(v) for v in value]


@F.pandas_udf(ArrayType(StringType()))
def _nfkc_each(texts: pd.Series) -> pd.Series:
    return texts.map(_composed)


@F.pandas_udf(ArrayType(ArrayType(ArrayType(StringType()))))
def _nfkc_cells(cells: pd.Series) -> pd.Series:
    return cells.map(_composed)


def line_endings(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def control_characters(text: Column) -> Column:
    return F.regexp_replace(text, r"[\p{Cc}\p{Cf}&&[^\n\t]]", "")


def horizontal_space(text: Column) -> Column:
    text = F.regexp_replace(text, r"[ \t]+", " ")
    text = F.regexp_replace(text, f"(^|\\n)[{LINE_SPACE}]+", "$1")
    return F.regexp_replace(text, f"[{LINE_SPACE}]+(\\n|$)", "$1")


def blank_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


def outer_space(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


#: The cleaning steps by name, in their order; more can be registered.
CLEANING = {
    "unicode_normalization": nfkc,
    "line_ending_normalization": line_endings,
    "control_character_removal": control_characters,
    "horizontal_whitespace_normalization": horizontal_space,
    "blank_line_normalization": blank_lines,
    "outer_whitespace_trim": outer_space,
}


def clean(text: Column, steps: dict | None = None) -> Column:
    return reduce(lambda t, step: step(t), (steps or CLEANING).values(), text)


def _clean_composed(text: Column) -> Column:
    return clean(text, {name: step for name, step in CLEANING.items() if name != "unicode_normalization"})


def _any_wide(values: Column) -> Column:
    return F.to_json(values).rlike(r"[^\x00-\x7f]")


def clean_each(texts: Column) -> Column:
    """An array's texts, cleaned; nulls stay."""
    small_batches(SparkSession.active())
    return F.transform(F.when(_any_wide(texts), _nfkc_each(texts)).otherwise(texts), _clean_composed)


def clean_cells(cells: Column) -> Column:
    """The cells of an array of tables, each an array of rows, cleaned; nulls stay."""
    small_batches(SparkSession.active())
    composed = F.when(_any_wide(cells), _nfkc_cells(cells)).otherwise(cells)
    return F.transform(composed, lambda table: F.transform(table, lambda row: F.transform(row, _clean_composed)))


def sorted_numbers(values: Column) -> Column:
    """Distinct, ascending."""
    return F.array_sort(F.array_distinct(values))


def distinct_texts(values: Column) -> Column:
    """Those that aren't empty, each once, in their order."""
    return F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != "")))


def same_set(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same values, however often and in whatever order."""
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def sentences(text: Column) -> Column:
    """The text cut behind sentence ends that white space follows."""
    return F.split(F.regexp_replace(text, f"([.!?])[{SPACE}]+", "$1\x01"), "\x01")


def chunk_id(tenant: Column, document: Column, content: Column, strategy: Column, version: Column, index: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws("|", tenant, document, content, strategy, version, index.cast("string"), F.sha2(text, 256)), 256)


def cache_key(tenant: Column, departments: Column, query: Column) -> Column:
    """Key of a cached answer: tenant, sorted departments and normalised query."""
    return F.concat(F.lit("rag:"), F.sha2(F.concat_ws(":", tenant, F.array_join(F.array_sort(departments), ","), normalised(query)), 256))
