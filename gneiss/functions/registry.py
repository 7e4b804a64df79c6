"""The functions that SQL can call: column functions and chunkers that Catalyst inlines, and chunkers with state over partitions. More can be defined by name.

Spark takes no function written in SQL within the arguments of a table function: clean in a subquery, and chunk its column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession, functions as F
from pyspark.sql.types import Row

from gneiss.functions import text as T

_S = T.SPACE
_L = T.LINE_SPACE


class DuplicateFunctionError(ValueError):
    """A name that is defined already."""


@dataclass(frozen=True)
class SqlFunction:
    """A function written in SQL: its parameters, what it returns (a type, or TABLE (...)) and the expression or query that it stands for."""

    parameters: str
    returns: str
    body: str


#: Functions of columns, by name; those of SQL have the same names.
COLUMNS: dict[str, Callable[..., Column]] = {
    "normalise_text": T.normalised, "count_tokens": T.token_count, "meaningful_length": T.meaningful_length, "nfkc": T.nfkc, "fix_line_endings": T.line_endings,
    "drop_control_characters": T.control_characters, "fix_horizontal_space": T.horizontal_space, "fix_blank_lines": T.blank_lines, "trim_space": T.outer_space, "clean_text": T.clean,
}

SQL: dict[str, SqlFunction] = {
    "normalise_text": SqlFunction("t STRING", "STRING", f"trim(regexp_replace(lower(t), r'[{_S}]+', ' '))"),
    "count_tokens": SqlFunction("t STRING", "INT", f"size(regexp_extract_all(t, r'{T.TOKEN}', 0))"),
    "meaningful_length": SqlFunction("t STRING", "INT", r"char_length(regexp_replace(t, r'[^\p{L}\p{N}]', ''))"),
    "fix_line_endings": SqlFunction("t STRING", "STRING", r"regexp_replace(t, r'\r\n?', '\n')"),
    "drop_control_characters": SqlFunction("t STRING", "STRING", r"regexp_replace(t, r'[\p{Cc}\p{Cf}&&[^\n\t]]', '')"),
    "fix_horizontal_space": SqlFunction("t STRING", "STRING", rf"regexp_replace(regexp_replace(regexp_replace(t, r'[ \t]+', ' '), r'(^|\n)[{_L}]+', '$1'), r'[{_L}]+(\n|$)', '$1')"),
    "fix_blank_lines": SqlFunction("t STRING", "STRING", r"regexp_replace(t, r'\n{3,}', '\n\n')"),
    "trim_space": SqlFunction("t STRING", "STRING", f"regexp_replace(t, r'^[{_S}]+|[{_S}]+$', '')"),
    "clean_text": SqlFunction("t STRING", "STRING", "trim_space(fix_blank_lines(fix_horizontal_space(drop_control_characters(fix_line_endings(nfkc(t))))))"),
    # Pieces are tokens with the white space behind them, so a window's pieces together are the text's own characters.
    "chunk": SqlFunction(
        "t STRING, size INT, overlap INT",
        "TABLE (chunk_index INT, chunk_text STRING, token_count INT)",
        # One array expression of the text alone: Spark generates its rows where the text is, where a subquery would be joined to it by the text.
        f"""SELECT inline(flatten(transform(array(regexp_extract_all(chunk.t, r'{T.TOKEN}[{_S}]*', 0)), p -> transform(
            filter(sequence(0, CAST(greatest(0, ceil((size(p) - chunk.size) / (chunk.size - chunk.overlap))) AS INT) * (chunk.size - chunk.overlap), chunk.size - chunk.overlap), k -> size(p) > 0),
            (k, i) -> named_struct('chunk_index', i, 'chunk_text', regexp_replace(array_join(slice(p, k + 1, chunk.size), ''), r'[{_S}]+$', ''), 'token_count', greatest(0, least(size(p) - k, chunk.size)))))))""",
    ),
}


class PackUnits:
    """Chunks of a partition's units (unit_id, text), taken in the order that the call gives: each as many whole units as have no more than size tokens together; a longer unit is a chunk of its own.

    One row a chunk: its number, its first and last unit, its text (units joined by line ends) and its tokens. A unit without text is passed over.
    A task holds one chunk at a time, whatever the size of the partition.
    """

    def __init__(self) -> None:
        self.number, self.ids, self.texts, self.tokens = 0, [], [], 0

    def _packed(self) -> Iterator[tuple]:
        if self.texts:
            yield self.number, self.ids[0], self.ids[-1], "\n".join(self.texts), self.tokens
            self.number, self.ids, self.texts, self.tokens = self.number + 1, [], [], 0

    def eval(self, row: Row, size: int) -> Iterator[tuple]:
        units = len((row["text"] or "").split())
        if not units:
            return
        if self.tokens + units > size:
            yield from self._packed()
        self.ids.append(row["unit_id"])
        self.texts.append(row["text"])
        self.tokens += units

    def terminate(self) -> Iterator[tuple]:
        yield from self._packed()


#: Table functions in Python, for what depends on the rows before: by name, the class and the columns that it gives.
TABLES: dict[str, tuple[type, str]] = {"pack_units": (PackUnits, "chunk_index int, first_unit long, last_unit long, chunk_text string, token_count int")}


def column_function(name: str, *columns: Column) -> Column:
    """The named function of these columns."""
    if name not in COLUMNS:
        raise KeyError(f"{name!r} isn't one of {', '.join(COLUMNS)}")
    return COLUMNS[name](*columns)


def define(name: str, function: Callable[..., Column] | SqlFunction | tuple[type, str]) -> None:
    """Adds a function of columns, one of SQL, or a table function's class with its columns. A name may have one of columns and one of SQL."""
    place = SQL if isinstance(function, SqlFunction) else TABLES if isinstance(function, tuple) else COLUMNS
    if name in place or place is not COLUMNS and (name in SQL or name in TABLES):
        raise DuplicateFunctionError(name)
    place[name] = function


def register(spark: SparkSession) -> None:
    """Makes every function of SQL and every table function known to the session's SQL, as temporary functions; again is allowed."""
    spark.udf.register("nfkc", T._nfkc)
    for name, f in SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({f.parameters}) RETURNS {f.returns} RETURN {f.body}")
    for name, (made, columns) in TABLES.items():
        spark.udtf.register(name, F.udtf(made, returnType=columns))
