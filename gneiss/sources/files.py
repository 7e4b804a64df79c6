"""Readers: a registry of parsers by file suffix, and tables of a folder."""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

RAW_SCHEMA = (
    "path string, file_type string, content_hash string, size long, title string, language string, raw_text string, "
    "tables array<struct<table_id:string,headers:array<string>,rows:array<array<string>>>>, extra map<string,string>, warnings array<string>, error string"
)
# Tags that hold no text for readers, and tags that make blocks.
NOISE = frozenset(("script", "style", "noscript", "template", "svg", "canvas"))
BLOCKS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "pre", "blockquote"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))


class UnsupportedOperationError(ValueError):
    """A file type or operation that isn't registered."""


class Parsers:
    """Parsers by lower-cased suffix; a second registration of a suffix, and an unknown one, raise ValueError."""

    def __init__(self) -> None:
        self._by_suffix: dict[str, Callable[[bytes], dict]] = {}

    def register(self, suffixes: tuple[str, ...], parser: Callable[[bytes], dict]) -> None:
        for suffix in map(str.lower, suffixes):
            if suffix in self._by_suffix:
                raise ValueError(f"{suffix} is registered already")
            self._by_suffix[suffix] = parser

    def get(self, path: str) -> Callable[[bytes], dict]:
        if (suffix := suffix_of(path)) not in self._by_suffix:
            raise ValueError(f"no parser for {suffix or path!r}")
        return self._by_suffix[suffix]

    def supports(self, path: str) -> bool:
        return suffix_of(path) in self._by_suffix

    def suffixes(self) -> list[str]:
        return sorted(self._by_suffix)


def suffix_of(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return f".{name.rsplit('.', 1)[1].lower()}" if "." in name[1:] else ""


def decoded(content: bytes) -> tuple[str, list[str]]:
    """UTF-8, else with a mark, else Latin-1; what isn't plain UTF-8 warns."""
    for encoding in ("utf-8", "utf-8-sig", "latin-1"):
        try:
            return content.decode(encoding), [] if encoding == "utf-8" else [f"decoded using fallback encoding: {encoding}"]
        except UnicodeDecodeError:
            continue
    raise ValueError("the file can't be decoded")


def parse_text(content: bytes) -> dict:
    return {"raw_text": content.decode("utf-8")}


def parse_markdown(content: bytes) -> dict:
    return {"raw_text": content.decode("utf-8", "replace")}


def parse_json(content: bytes) -> dict:
    data = json.loads(content.decode("utf-8"))
    extra = {"root_type": type(data).__name__}
    if isinstance(data, dict):
        extra["top_level_keys"] = ",".join(data)
    return {"raw_text": json.dumps(data, indent=2, ensure_ascii=False), "extra": extra}


def rendered_rows(headers: list[str], rows: list[list[str | None]]) -> str:
    return "\n".join(f"Row {n}: " + " | ".join(f"{h}: {'' if v is None else v}" for h, v in zip(headers, row)) for n, row in enumerate(rows, 1))


def parse_csv(content: bytes) -> dict:
    text, warnings = decoded(content)
    found = [row for row in csv.reader(io.StringIO(text)) if row]
    headers, rows = (found[0], found[1:]) if found else ([], [])
    rows = [[v if v != "" else None for v in (row + [""] * len(headers))[: len(headers)]] for row in rows]
    own = {"table_id": "table_0", "headers": headers, "rows": rows}
    return {"raw_text": rendered_rows(headers, rows), "tables": [own], "warnings": warnings, "extra": {"row_count": str(len(rows)), "column_count": str(len(headers))}}


class _Tree(HTMLParser):
    """A tree of [tag, attributes, children]; text is a child string. Block tags that HTML closes by themselves are closed."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = ["", {}, []]
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        closes = {"p"} if tag in BLOCKS | {"table", "div", "ul", "ol"} else set()
        closes |= {"li"} if tag == "li" else {"td", "th"} if tag in ("td", "th", "tr") else set()
        closes |= {"tr"} if tag == "tr" else set()
        while len(self.open) > 1 and self.open[-1][0] in closes:
            self.open.pop()
        node = [tag, dict(attrs), []]
        self.open[-1][2].append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break

    def handle_data(self, data: str) -> None:
        self.open[-1][2].append(data)


def _walk(node: list, skip: frozenset = frozenset()) -> Iterator[list]:
    for child in node[2]:
        if isinstance(child, list) and child[0] not in skip:
            yield child
            yield from _walk(child, skip)


def _strings(node: list, skip: frozenset) -> Iterator[str]:
    for child in node[2]:
        if isinstance(child, str):
            yield child
        elif child[0] not in skip:
            yield from _strings(child, skip)


def _text(node: list, skip: frozenset = NOISE) -> str:
    return " ".join(" ".join(s.split()) for s in _strings(node, skip) if s.strip())


def _html_table(node: list, number: int) -> dict:
    found = [[_text(c) for c in _walk(row, NOISE) if c[0] in ("td", "th")] for row in _walk(node, NOISE) if row[0] == "tr"]
    found = [row for row in found if row]
    if found and any(c[0] == "th" for c in _walk(node, NOISE)):
        headers, rows = found[0], found[1:]
    else:
        headers, rows = [f"column_{k + 1}" for k in range(max(map(len, found), default=0))], found
    return {"table_id": f"table_{number}", "headers": headers, "rows": rows}


def parse_html(content: bytes | str) -> dict:
    """Blocks in document order, a nested block in its parent's text and again by itself; tables are taken out first and written after the blocks."""
    text, warnings = (content, []) if isinstance(content, str) else decoded(content)
    tree = _Tree()
    tree.feed(text)
    tree.close()
    nodes = list(_walk(tree.root, NOISE))
    title = next((" ".join("".join(c for c in n[2] if isinstance(c, str)).split()) for n in nodes if n[0] == "title"), None)
    meta = {n[1].get("name"): n[1].get("content") for n in reversed(nodes) if n[0] == "meta"}
    tables = [_html_table(n, k) for k, n in enumerate(n for n in nodes if n[0] == "table")]
    without = NOISE | {"table"}
    body = next((n for n in nodes if n[0] == "body"), tree.root)
    sections = []
    for node in _walk(body, without):
        if node[0] in BLOCKS and (own := _text(node, without)):
            before = {"li": "- ", "pre": "Code Block:\n", "blockquote": "Quote: "}.get(node[0], "#" * int(node[0][1]) + " " if node[0][0] == "h" else "")
            sections.append(before + own)
    for t in tables:
        lines = [f"Table: {t['table_id']}", f"Columns: {' | '.join(t['headers'])}", rendered_rows(t["headers"], t["rows"])]
        sections.append("\n".join(x for x in lines if x))
    count = lambda *tags: str(sum(n[0] in tags for n in _walk(tree.root, without)))
    extra = {"heading_count": count("h1", "h2", "h3", "h4", "h5", "h6"), "paragraph_count": count("p"), "link_count": count("a"), "table_count": str(len(tables))}
    extra |= {k: v for k, v in (("description", meta.get("description")), ("author", meta.get("author"))) if v}
    language = next((n[1]["lang"].strip() for n in nodes if n[0] == "html" and n[1].get("lang")), None)
    raw = "\n\n".join(sections)
    return {"raw_text": raw, "title": title or None, "language": language, "tables": tables, "extra": extra, "warnings": warnings + ([] if raw.strip() else ["HTML document contains no extractable content."])}


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def parse_docx(content: bytes) -> dict:
    """Paragraphs and tables in body order: headings with # by level, list items with a dash, table rows as cells joined by bars."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        core = z.read("docProps/core.xml").decode("utf-8", "replace") if "docProps/core.xml" in z.namelist() else ""
    shown = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t")).strip()
    sections, tables = [], []
    for e in body if body is not None else ():
        if e.tag == f"{_W}p" and (text := shown(e)):
            style = e.find(f"{_W}pPr/{_W}pStyle")
            name = (style.get(f"{_W}val") or "") if style is not None else ""
            level = re.search(r"(?i)^heading\s*(\d+)", name)
            listed = e.find(f"{_W}pPr/{_W}numPr") is not None or name.lower().startswith("list")
            sections.append(f"{'#' * min(max(int(level[1]), 1), 6)} {text}" if level else f"- {text}" if listed else text)
        elif e.tag == f"{_W}tbl":
            rows = [[shown(c) for c in row.iter(f"{_W}tc")] for row in e.iter(f"{_W}tr")]
            if rows:
                tables.append({"table_id": f"table_{len(tables)}", "headers": rows[0], "rows": rows[1:]})
                sections.append("\n".join(" | ".join(r) for r in rows))
    title = re.search(r"<dc:title>([^<]*)</dc:title>", core)
    return {"raw_text": "\n\n".join(sections), "tables": tables, "title": title[1] if title and title[1] else None}


def parse_xlsx(content: bytes) -> dict:
    """All sheets; rows and columns without a value are dropped, blank headers are named by their place."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        titles = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet")]
        sheets = [ElementTree.fromstring(z.read(n)) for n in sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))]
    tables, sections = [], []
    for title, sheet in zip(titles, sheets):
        grid: list[dict[int, str | None]] = []
        for row in sheet.iter(f"{_S}row"):
            own: dict[int, str | None] = {}
            for n, cell in enumerate(row.iter(f"{_S}c")):
                letters = re.match(r"[A-Z]+", cell.get("r") or "")
                column = n
                if letters:
                    column = -1
                    for ch in letters[0]:
                        column = (column + 1) * 26 + ord(ch) - 65
                v = cell.find(f"{_S}v")
                value = "".join(t.text or "" for t in cell.iter(f"{_S}t")) if cell.get("t") == "inlineStr" else None if v is None else shared[int(v.text)] if cell.get("t") == "s" else v.text
                if value not in (None, ""):
                    own[column] = value
            grid.append(own)
        used = sorted({c for row in grid[1:] for c in row} | set(grid[0] if grid else ()))
        headers = [(grid[0].get(c) or f"unnamed_column_{k + 1}").strip() for k, c in enumerate(used)] if grid else []
        rows = [[row.get(c) for c in used] for row in grid[1:] if row]
        tables.append({"table_id": title, "headers": headers, "rows": rows})
        sections.append(f"Sheet: {title}\n{rendered_rows(headers, rows)}".strip())
    return {"raw_text": "\n\n".join(sections), "tables": tables, "extra": {"sheet_count": str(len(tables))}}


PARSERS = Parsers()
for _suffixes, _parser in (((".txt",), parse_text), ((".md", ".markdown"), parse_markdown), ((".json",), parse_json), ((".csv",), parse_csv), ((".html", ".htm"), parse_html), ((".docx",), parse_docx), ((".xlsx",), parse_xlsx)):
    PARSERS.register(_suffixes, _parser)


def _parsed(path: str, content: bytes, parsers: Parsers) -> dict:
    try:
        return parsers.get(path)(content)
    except Exception as e:  # a bad file is a row with its error, and the others go on
        return {"error": f"{type(e).__name__}: {e}"}


def read_documents(spark: SparkSession, folder: str, parsers: Parsers = PARSERS) -> DataFrame:
    """RAW_SCHEMA rows of a folder's files, read through Spark's file systems (parse_files)."""
    return parse_files(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder), parsers)


def parse_files(files: DataFrame, parsers: Parsers = PARSERS) -> DataFrame:
    """RAW_SCHEMA rows of files (path, length, content). A file that can't be parsed has its error and no text."""
    given = files.select("path", "length", F.sha2("content", 256).alias("hash"), "content")
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.struct([("table_id", pa.string()), ("headers", pa.list_(pa.string())), ("rows", pa.list_(pa.list_(pa.string())))])), pa.map_(pa.string(), pa.string()), pa.list_(pa.string()), pa.string()]

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            rows = []
            for path, size, digest, content in zip(*(c.to_pylist() for c in batch.columns)):
                d = _parsed(path, content, parsers)
                rows.append((path, suffix_of(path), digest, size, d.get("title"), d.get("language"), d.get("raw_text"), d.get("tables", []), list(d.get("extra", {}).items()), d.get("warnings", []), d.get("error")))
            columns = list(zip(*rows)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], [f.split()[0] for f in re.split(r", (?=\w+ )", RAW_SCHEMA)])

    return given.mapInArrow(batches, RAW_SCHEMA)


def html_columns(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages without the html, with title, language, raw_text, n_headings, n_paragraphs, n_links and n_tables."""
    kept = [c for c in pages.columns if c != html]
    schema = pages.select(*kept).schema
    for name in ("title", "language", "raw_text"):
        schema = schema.add(name, "string")
    counts = {"n_headings": "heading_count", "n_paragraphs": "paragraph_count", "n_links": "link_count", "n_tables": "table_count"}
    for name in counts:
        schema = schema.add(name, "long")

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            got = [parse_html(h or "") for h in batch.column(len(kept)).to_pylist()]
            texts = [pa.array([d.get(k) for d in got], pa.string()) for k in ("title", "language", "raw_text")]
            numbers = [pa.array([int(d["extra"][k]) for d in got], pa.int64()) for k in counts.values()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *texts, *numbers], [*kept, "title", "language", "raw_text", *counts])

    return pages.select(*kept, html).mapInArrow(batches, schema)


def path_parts(path: Column) -> Column:
    """Struct of tenant, department, content_hash and file of `original/<tenant>/<department>/<hash>/<file>`; null for any other form."""
    parts = F.split(path, "/")
    fits = (F.size(parts) == 5) & (parts[0] == "original") & F.forall(parts, lambda p: p != "")
    return F.when(fits, F.struct(parts[1].alias("tenant_id"), parts[2].alias("department"), parts[3].alias("content_hash"), parts[4].alias("file_name")))


def ocr_needed(text: Column, least: int = 50) -> Column:
    """Whether a page's own text has under so many letters and digits."""
    return F.char_length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]", "")) < least


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A .csv or .xlsx file as a table; any other suffix raises UnsupportedOperationError."""
    suffix = suffix_of(path)
    if suffix == ".csv":
        return spark.read.csv(path, header=True, inferSchema=True)
    if suffix in (".xlsx", ".xls"):
        table = read_documents(spark, path).select(F.get("tables", F.lit(0)).alias("t"))
        headers = table.select("t.headers").first()["headers"]
        return table.select(F.explode("t.rows").alias("r")).select(*[F.get("r", F.lit(k)).alias(h) for k, h in enumerate(headers)])
    raise UnsupportedOperationError(f"{suffix or path!r} isn't a table file")
