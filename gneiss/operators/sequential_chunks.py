"""Chunkers that fold over a document: recursive, sentence, paragraph, structure, table and JSON.

Each is a generator over one document, run in Arrow batches; documents are the unit of parallelism.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from gneiss.functions.text import SPACE
from gneiss.operators.chunking import ChunkConfig
from gneiss.shared import small_batches, written

CHUNK_SCHEMA = "doc_id long, strategy string, chunk_index int, chunk_text string, chunk_type string, section_path array<string>, start_char int, end_char int, token_count int"
TABLE_CHUNKS = "doc_id long, table_id string, chunk_index int, chunk_text string, token_count int"
#: Rows of a table that one task packs at a time.
ROWS_IN_BLOCK = 4096
_TOKEN = re.compile(r"\S+")


@dataclass
class Piece:
    text: str
    start: int | None = None
    end: int | None = None
    path: tuple[str, ...] = ()
    kind: str = "text"


def counter(config: ChunkConfig) -> Callable[[str], int]:
    return len if config.unit == "characters" else lambda text: len(text.split())


def spans_of_size(text: str, config: ChunkConfig, offset: int) -> Iterator[Piece]:
    """Consecutive parts of at most size units; the last may be short."""
    if config.unit == "characters":
        bounds = [(k, min(k + config.size, len(text))) for k in range(0, len(text), config.size)]
    else:
        at = [m.span() for m in _TOKEN.finditer(text)]
        bounds = [(at[k][0], at[min(k + config.size, len(at)) - 1][1]) for k in range(0, len(at), config.size)]
    for a, b in bounds:
        if text[a:b].strip():
            yield Piece(text[a:b], offset + a, offset + b)


def _packed(units: list[Piece], joiner: str, config: ChunkConfig, overlap: bool) -> list[list[Piece]]:
    """Greedy groups whose joined text has at most size units. With overlap, a group begins with the last units of the one before that have at most so many units together and leave room for the next."""
    count = counter(config)
    width = lambda group: count(joiner.join(u.text.strip() for u in group if u.text.strip()))
    groups: list[list[Piece]] = []
    now: list[Piece] = []
    for unit in units:
        if now and width([*now, unit]) > config.size:
            groups.append(now)
            kept: list[Piece] = []
            if overlap and config.overlap > 0:
                for earlier in reversed(now):
                    if width([earlier, *kept]) > config.overlap:
                        break
                    kept.insert(0, earlier)
                while kept and width([*kept, unit]) > config.size:
                    kept.pop(0)
            now = kept
        now = [*now, unit]
    return [*groups, now] if now else groups


def _tail_merged(groups: list, config: ChunkConfig, width: Callable, join: Callable, may: Callable = lambda a, b: True) -> list:
    """A last group under the least size joins the one before if both fit together."""
    if len(groups) > 1 and config.merge_small and width(groups[-1]) < config.least and may(groups[-2], groups[-1]):
        both = join(groups[-2], groups[-1])
        if width(both) <= config.size:
            return [*groups[:-2], both]
    return groups


def _grouped(units: list[Piece], joiner: str, config: ChunkConfig, overlap: bool, path: Callable = lambda g: ()) -> Iterator[Piece]:
    count = counter(config)
    text = lambda group: joiner.join(u.text.strip() for u in group if u.text.strip())
    same_path = lambda a, b: path(a) == path(b)
    for group in _tail_merged(_packed(units, joiner, config, overlap), config, lambda g: count(text(g)), lambda a, b: a + b, same_path):
        yield Piece(text(group), min(u.start for u in group), max(u.end for u in group), path(group))


def _fitting(units: list[Piece], config: ChunkConfig) -> list[Piece]:
    count, out = counter(config), []
    for unit in units:
        if count(unit.text) <= config.size:
            out.append(unit)
        else:
            out += [Piece(p.text, p.start, p.end, unit.path) for p in spans_of_size(unit.text, config, unit.start)]
    return out


def _stripped(m: re.Match) -> Piece | None:
    raw = m.group()
    text = raw.strip()
    if not text:
        return None
    start = m.start() + len(raw) - len(raw.lstrip())
    return Piece(text, start, start + len(text))


_SENTENCE = re.compile(r".+?(?:[.!?]+(?=\s+|$)|$)", re.DOTALL)
_PARAGRAPH = re.compile(r"\S(?:.*?\S)?(?=\n\s*\n|\Z)", re.DOTALL)


def sentence(text: str, config: ChunkConfig) -> Iterator[Piece]:
    units = [p for p in map(_stripped, _SENTENCE.finditer(text)) if p]
    yield from _grouped(_fitting(units, config), " ", config, True)


def paragraph(text: str, config: ChunkConfig) -> Iterator[Piece]:
    units = [p for p in map(_stripped, _PARAGRAPH.finditer(text)) if p]
    yield from _grouped(_fitting(units, config), "\n\n", config, True)


# The forms of headings.
_MARKDOWN = re.compile(r"^(#{1,6})\s+(.+?)\s*$")
_NUMBERED = re.compile(r"^((?:\d+\.)+\d*|\d+)[\s.)-]+(.+?)\s*$")
_UPPERCASE = re.compile(r"^[A-Z][A-Z0-9\s/&(),:'-]{2,100}$")


def heading_of(line: str) -> tuple[int, str] | None:
    """(level, heading) of a stripped line: the number of # signs, or of dots and one more, six at most; upper case is level 1."""
    short = lambda t: 1 <= len(t.split()) <= 15 and len(t) <= 120
    if m := _MARKDOWN.match(line):
        return len(m[1]), m[2].strip()
    if (m := _NUMBERED.match(line)) and short(m[2].strip()):
        return min(m[1].count(".") + 1, 6), m[2].strip()
    return (1, line) if _UPPERCASE.match(line) and short(line) else None


def structure(text: str, config: ChunkConfig) -> Iterator[Piece]:
    """Sections by headings, with the path of headings above them; packed without overlap."""
    sections: list[Piece] = []
    stack: list[tuple[int, str]] = []
    begin = at = 0
    path: tuple[str, ...] = ()

    def close(end: int) -> None:
        body = text[begin:end].strip()
        if body:
            sections.append(Piece(body, begin, end, path))

    for raw in text.split("\n"):
        found = heading_of(raw.strip()) if raw.strip() else None
        if found:
            if at > begin:
                close(at)
            while stack and stack[-1][0] >= found[0]:
                stack.pop()
            stack.append(found)
            begin, path = at, tuple(h for _, h in stack)
        at += len(raw) + 1
    close(len(text))

    def shared(group: list[Piece]) -> tuple[str, ...]:
        paths = [u.path for u in group if u.path]
        out = paths[0] if paths else ()
        for p in paths[1:]:
            n = next((k for k, (a, b) in enumerate(zip(out, p)) if a != b), min(len(out), len(p)))
            out = out[:n]
        return out

    for piece in _grouped(_fitting(sections, config), "\n\n", config, False, shared):
        yield Piece(piece.text, piece.start, piece.end, tuple(dict.fromkeys(piece.path)))


def _cut(text: str, separators: tuple[str, ...], config: ChunkConfig, count: Callable[[str], int]) -> Iterator[str]:
    """Parts of at most size units, cut at the first separator that helps; a separator stays at its part's end."""
    if count(text) <= config.size:
        yield text
    elif not separators or separators[0] == "":
        if config.unit == "characters":
            yield from (text[k : k + config.size] for k in range(0, len(text), config.size))
        else:
            own = text.split()
            yield from (" ".join(own[k : k + config.size]) for k in range(0, len(own), config.size))
    else:
        parts = text.split(separators[0])
        if len(parts) == 1:
            yield from _cut(text, separators[1:], config, count)
            return
        for k, part in enumerate(parts):
            if part:
                whole = part + separators[0] * (k < len(parts) - 1)
                yield from [whole] if count(whole) <= config.size else _cut(whole, separators[1:], config, count)


def recursive(text: str, config: ChunkConfig) -> Iterator[Piece]:
    count = counter(config)
    chunks: list[str] = []
    now = ""
    for part in _cut(text, config.separators, config, count):
        if not part.strip():
            continue
        if now and count(now + part) > config.size:
            chunks.append(now.strip())
            now = _carried(now, part, config, count) + part
        else:
            now += part
    if now.strip():
        chunks.append(now.strip())
    chunks = _tail_merged(chunks, config, count, lambda a, b: f"{a}\n{b}".strip())
    after = 0
    for chunk in chunks:
        start = text.find(chunk, after)
        if start < 0:
            yield Piece(chunk)
        else:
            after = start
            yield Piece(chunk, start, start + len(chunk))


def _carried(before: str, part: str, config: ChunkConfig, count: Callable[[str], int]) -> str:
    """The end of a finished chunk that begins the next one: the longest that is at most overlap units and fits before part."""
    room = config.size - count(part)
    if room <= 0 or config.overlap <= 0:
        return ""
    if config.unit == "characters":
        return before[-config.overlap :][-room:]
    own = before.split()[-config.overlap :]
    low, high, best = 0, min(len(own), room), ""
    while low <= high:
        middle = (low + high) // 2
        tried = " ".join(own[-middle:]) if middle else ""
        if count(tried + part) <= config.size:
            best, low = tried, middle + 1
        else:
            high = middle - 1
    return f"{best} " if best else ""


class TableLayout:
    """How rows go into chunks under a repeated header: what a row weighs, how long a group is, what a group shows."""

    def __init__(self, headers: list[str | None], config: ChunkConfig) -> None:
        self.config, self.count = config, counter(config)
        self.headers = ["" if h is None else str(h).strip() for h in headers]
        self.head = " | ".join(self.headers) if any(self.headers) else ""
        self.line_end = int(config.unit == "characters")
        self.room = config.size - (self.count(f"{self.head}\n") if self.head else 0)
        #: The most that a group's rows may weigh; each row's line end counts, so one more than the last has.
        self.capacity = self.room + self.line_end

    def weight(self, row: list[str]) -> int:
        return self.count(" | ".join(row)) + self.line_end

    def shown(self, group: list[list[str]]) -> str:
        return "\n".join([*([self.head] if self.head else []), *(" | ".join(r) for r in group)])

    def fields(self, row: list[str]) -> list[str]:
        """The texts of a row that doesn't fit: `header: value` fields, cut, each part under the header."""
        if self.room <= 0:
            raise ValueError("a table's header alone fills a chunk")
        fields = "\n".join(f"{self.headers[k] if k < len(self.headers) else f'column_{k + 1}'}: {cell}" for k, cell in enumerate(row))
        parts = _cut(fields, (), ChunkConfig(size=self.room, overlap=0, least=0, unit=self.config.unit), self.count)
        return [f"{self.head}\n{part}".strip() if self.head else part.strip() for part in parts if part.strip()]

    def ends(self, weights: list[int], most: int) -> list[int]:
        """Of each row, where a group that begins with it ends: at most rows and the capacity; a row beyond it is alone."""
        out, end, held = [], 0, 0
        for k, w in enumerate(weights):
            if end <= k:
                end, held = k, 0
            while end < len(weights) and end - k < most and held + weights[end] <= self.capacity:
                held += weights[end]
                end += 1
            out.append(max(end, k + 1))
            if end > k:
                held -= w
        return out

    def texts(self, group: list[list[str]]) -> list[str]:
        return self.fields(group[0]) if len(group) == 1 and self.weight(group[0]) > self.capacity else [self.shown(group)]


def table_cells(row: list[str | None]) -> list[str]:
    return ["" if c is None else str(c).strip() for c in row]


def table(headers: list[str], rows: list[list[str | None]], config: ChunkConfig) -> Iterator[Piece]:
    """Groups of rows under a repeated header, of at most rows_per_group rows and size units; a row that doesn't fit is written as `header: value` fields and cut, each part under the header."""
    layout = TableLayout(headers, config)
    rows = [row for row in map(table_cells, rows) if any(row)]
    weights = [layout.weight(row) for row in rows]
    ends = layout.ends(weights, len(rows) if config.whole_table and sum(weights) <= layout.capacity else config.rows_per_group)
    at = 0
    while at < len(rows):
        yield from (Piece(text, kind="table") for text in layout.texts(rows[at : ends[at]]))
        at = ends[at]


def json_values(text: str, config: ChunkConfig) -> Iterator[Piece]:
    """One `path: value` chunk for each scalar, list of scalars and list element, depth first, in the document's order. Invalid JSON raises ValueError."""
    shown = lambda v: json.dumps(v, ensure_ascii=False, sort_keys=True)

    def leaf(value, path: tuple[str, ...]) -> Piece:
        return Piece(f"{'.'.join(path)}: {shown(value)}" if path and ".".join(path) else shown(value))

    def walk(value, path: tuple[str, ...]) -> Iterator[Piece]:
        if isinstance(value, dict):
            for key, child in value.items():
                yield from walk(child, (*path, key))
        elif isinstance(value, list) and any(isinstance(v, (dict, list)) for v in value):
            for k, child in enumerate(value):
                yield from [leaf(child, (*path, str(k)))] if isinstance(child, dict) else walk(child, (*path, str(k)))
        elif value != []:
            yield leaf(value, path)

    yield from walk(json.loads(text), ())


STRATEGIES: dict[str, Callable[[str, ChunkConfig], Iterator[Piece]]] = {"recursive": recursive, "sentence": sentence, "paragraph": paragraph, "structure_aware": structure, "json_aware": json_values}


def chunk(docs: DataFrame, config: ChunkConfig) -> DataFrame:
    """CHUNK_SCHEMA rows of docs (doc_id, text). Null and blank texts give none; an unknown strategy raises ValueError."""
    if config.strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {config.strategy!r}; there are {', '.join(sorted(STRATEGIES))}")
    cut, count = STRATEGIES[config.strategy], counter(config)

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text and text.strip():
                    pieces = [p for p in cut(text, config) if p.text.strip()]
                    rows += [(doc_id, config.strategy, k, p.text.strip(), p.kind, list(p.path), p.start, p.end, len(p.text.split())) for k, p in enumerate(pieces)]
            columns = list(zip(*rows)) if rows else [[]] * 9
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], ["doc_id", "strategy", "chunk_index", "chunk_text", "chunk_type", "section_path", "start_char", "end_char", "token_count"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(batches, CHUNK_SCHEMA)


def chunk_tables(tables: DataFrame, config: ChunkConfig) -> DataFrame:
    """(doc_id, table_id, chunk_index, chunk_text, token_count) from rows (doc_id, table_id, headers, rows)."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            rows = []
            for doc_id, table_id, headers, body in zip(*(c.to_pylist() for c in batch.columns)):
                rows += [(doc_id, table_id, k, p.text, len(p.text.split())) for k, p in enumerate(table(headers or [], body or [], config))]
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int32()])], ["doc_id", "table_id", "chunk_index", "chunk_text", "token_count"])

    small_batches(tables.sparkSession)
    return tables.select("doc_id", "table_id", "headers", "rows").mapInArrow(batches, TABLE_CHUNKS)


def chunk_table_rows(rows: DataFrame, headers: DataFrame, config: ChunkConfig, block: int = ROWS_IN_BLOCK) -> DataFrame:
    """What chunk_tables gives, from a table's rows (doc_id, table_id, row_no, cells) and headers (doc_id, table_id, headers), however many rows a table has.

    Rows are numbered again without the blank ones and packed in blocks, each with the first rows of the next. A group has at
    most rows_per_group rows, so a block's first group begins at one of as many rows: each block says for every such
    beginning where the next block's is and how many chunks it makes. One small row a block is then followed from the table's
    first row on, and the blocks are cut. Rows of equal row_no are in the order of their cells; those with null ids
    are left out; tables without rows, and rows without headers, give none.
    """
    most = config.rows_per_group
    size = max(block, most, config.size)
    key = ["doc_id", "table_id"]
    cells = F.transform("cells", lambda c: F.coalesce(F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", ""), F.lit("")))
    given = rows.select(*key, "row_no", cells.alias("cells")).where(F.exists("cells", lambda c: c != "")).withColumn("part", F.floor(F.col("row_no") / size))
    parts = given.groupBy(*key, "part").agg(F.sort_array(F.collect_list(F.struct("row_no", "cells"))).alias("body"))
    earlier = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = given.groupBy(*key, "part").agg(F.count("*").alias("n")).select(*key, "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    numbered = parts.join(before, [*key, "part"]).select(*key, "before", F.posexplode("body").alias("k", "row")).select(*key, (F.col("before") + F.col("k")).alias("n"), "row.cells")
    own = F.floor(F.col("n") / size)
    blocks = F.when((own > 0) & (F.col("n") % size < most), F.array(own, own - 1)).otherwise(F.array(own))
    packed = numbered.withColumn("block", F.explode(blocks)).groupBy(*key, "block").agg(F.sort_array(F.collect_list(F.struct("n", "cells"))).alias("body"))
    packed = written(packed.join(headers.select(*key, "headers"), key).select(*key, "block", "headers", F.col("body.cells").alias("body")), "table-blocks")

    def layout_of(number: int, headers: list, body: list) -> tuple[TableLayout, list[int], list[int]]:
        layout = TableLayout(headers or [], config)
        weights = [layout.weight(row) for row in body]
        whole = config.whole_table and number == 0 and len(body) <= size and sum(weights) <= layout.capacity
        return layout, weights, layout.ends(weights, len(body) if whole else most)

    def steps(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            out = []
            for number, names, body in zip(*(c.to_pylist() for c in batch.columns[2:])):
                layout, weights, ends = layout_of(number, names, body)
                last = min(len(body), size)
                leaves, counts = [max(0, k - size) for k in range(last + most)], [0] * (last + most)
                for k in range(last - 1, -1, -1):
                    alone = weights[k] > layout.capacity
                    counts[k] = len(layout.fields(body[k])) if alone else 1
                    if ends[k] < last:
                        counts[k] += counts[ends[k]]
                        leaves[k] = leaves[ends[k]]
                    else:
                        leaves[k] = ends[k] - last
                out.append((leaves[:most], counts[:most]))
            columns = [pa.array([o[k] for o in out], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], [*key, "block", "leaves", "counts"])

    def follow(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            out = []
            for doc_id, table_id, way in zip(*(c.to_pylist() for c in batch.columns)):
                entry, first = 0, 0
                for step in way:
                    out.append((doc_id, table_id, step["block"], entry, first))
                    entry, first = step["leaves"][entry], first + step["counts"][entry]
            columns = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32()])], [*key, "block", "entry", "first"])

    def cut(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            out = []
            for doc_id, table_id, number, names, body, at, index in zip(*(c.to_pylist() for c in batch.columns)):
                layout, _, ends = layout_of(number, names, body)
                while at < min(len(body), size):
                    for text in layout.texts(body[at : ends[at]]):
                        out.append((doc_id, table_id, index, text, len(text.split())))
                        index += 1
                    at = ends[at]
            columns = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int32()])], [*key, "chunk_index", "chunk_text", "token_count"])

    schema = "doc_id long, table_id string, block long"
    made = packed.mapInArrow(steps, f"{schema}, leaves array<int>, counts array<int>")
    ways = made.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("block", "leaves", "counts"))).alias("way"))
    entries = ways.mapInArrow(follow, f"{schema}, entry int, first int")
    return packed.join(entries, [*key, "block"]).select(*key, "block", "headers", "body", "entry", "first").mapInArrow(cut, TABLE_CHUNKS)
