"""Personal data in whole texts: patterns, and a character tagger over overlapping windows, reconciled globally."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gneiss.llm.pii_model import KINDS, STRIDE, WINDOW, Tagger, codes, trained
from gneiss.llm.session import free_name, small_batches, text_or_empty

Span = tuple[int, int, int]  # start, place of the kind in KINDS, end
#: A span that the tagger adds has this marginal probability at least, at each of its characters. On held-out windows of the
#: writer it leaves precision at 0.96 to 0.99 by kind, and recall at 0.96 to 0.97 of the spans that no edge cuts.
CONFIDENCE = 0.6
#: No span has fewer digits, but an e-mail address, which has an at and a dot.
LEAST_DIGITS = 4
WINDOWS_AT_ONCE = 64

#: What may stand for an at sign or a dot: the signs, wide ones too, a short word in brackets, the word dot by itself, the word at before a name with a dot.
_MARK = re.compile(r"[@＠﹫．]|[\[({<] ?[^\W\d_]{1,4} ?[\])}>]|\bdot\b|\bat\s+[A-Za-z0-9-]+ ?\.", re.I)
_DIGIT = re.compile(r"[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_MAIL = re.compile(r"[A-Za-z0-9].*?(?:[@＠﹫]|\b[aä]t\b).*?[A-Za-z0-9].*?(?:[.．]|\bdot\b).*[A-Za-z]", re.I | re.S)


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """A local part reaches back to the first character that can't be in one, or to the match before: found from each at sign in linear time."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        free = found.end() if found else at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed patterns: leftmost and non-overlapping for each kind; a match that fails its check is dropped."""
    out = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        own = _digits(m[0])
        if 12 <= len(own) <= 19 and luhn(own):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def valid(kind: int, text: str) -> bool:
    """Whether a span that the tagger found can be of its kind, in whatever spelling: the bounds that the base spans keep too.

    An e-mail address has an at and a dot, as signs or words, between letters or digits; an address of four numbers has none over
    255; a card has 12 to 19 digits that pass Luhn; a phone has 9 to 15 digits. Cards and phones have no letters.
    """
    if kind == 0:
        return bool(_MAIL.search(text))
    if kind == 1:
        numbers = re.findall(r"[0-9]+", text)
        return len(numbers) == 4 and all(len(n) <= 3 and int(n) <= 255 for n in numbers)
    own = _digits(text)
    if any(c.isalpha() for c in text):
        return False
    return 12 <= len(own) <= 19 and luhn(own) if kind == 2 else 9 <= len(own) <= 15


def windows(text: str, base: list[Span], gated: bool = True) -> list[int]:
    """Where the windows begin that are decoded.

    Windows are laid over the whole text, one every STRIDE. With gated, only those are decoded that have LEAST_DIGITS digits, or
    what may stand for an at sign or a dot (_MARK), outside the base spans. A number of any kind has so many digits; an address whose at and dot are
    written in yet another way is in no such window, and isn't found. Tests hold the gate against decoding all windows.
    """
    if not gated:
        return list(range(0, max(1, len(text) - WINDOW + STRIDE), STRIDE))
    covered = np.zeros(len(text) + 1, np.int64)
    for a, _, b in base:
        covered[a] += 1
        covered[b] -= 1
    free = np.cumsum(covered)[:-1] == 0
    digit = np.zeros(len(text) + 1, np.int64)
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    digit[1:] = np.cumsum((raw >= 48) & (raw <= 57) & free)
    mark = np.zeros(len(text) + 1, np.int64)
    for m in _MARK.finditer(text):
        mark[m.start() + 1] += free[m.start()]
    mark = np.cumsum(mark)
    starts = np.arange(0, max(1, len(text) - WINDOW + STRIDE), STRIDE)
    ends = np.minimum(starts + WINDOW, len(text))
    return starts[(digit[ends] - digit[starts] >= LEAST_DIGITS) | (mark[ends] > mark[starts])].tolist()


def reconcile(found: list[tuple[int, int, int, float]], base: list[Span]) -> list[Span]:
    """The non-overlapping spans (start, end, kind, confidence) of most confidence times length in all, clear of the base spans.

    A span that more windows found counts once, with its highest confidence; of equal totals the earlier spans win.
    """
    merged: list[list[int]] = []
    for a, _, b in sorted(base):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    starts = [a for a, _ in merged]
    best: dict[tuple[int, int, int], float] = {}
    for a, b, kind, sure in found:
        k = bisect_left(starts, b) - 1
        if k < 0 or merged[k][1] <= a:
            best[a, b, kind] = max(sure, best.get((a, b, kind), 0))
    spans = sorted(best, key=lambda s: (s[1], s[0], s[2]))
    ends, totals, came = [s[1] for s in spans], [0.0], [(0, False)]
    for k, (a, b, kind) in enumerate(spans):
        before = bisect_right(ends, a, 0, k)
        total = totals[before] + best[a, b, kind] * (b - a)
        came.append((before, True) if total > totals[k] else (k, False))
        totals.append(max(total, totals[k]))
    chosen, k = [], len(spans)
    while k:
        before, taken = came[k]
        if taken:
            a, b, kind = spans[k - 1]
            chosen.append((a, kind, b))
        k = before
    return chosen[::-1]


def decoded(texts: list[str], asked: list[tuple[int, int]], width: int, tagger: Tagger) -> Iterator[tuple[int, int, int, int, float, bool]]:
    """(place in asked, start, end, kind, confidence, whether an inner edge of the window cuts it) of the spans in windows (place of the text, start) of one width."""
    most = max(1, WINDOWS_AT_ONCE * WINDOW // width)
    for lo in range(0, len(asked), most):
        part = asked[lo : lo + most]
        x = np.full((len(part), width), 130)
        for row, (k, a) in enumerate(part):
            own = codes(texts[k][a : a + width])
            x[row, : len(own)] = own
        for row, ((k, a), spans) in enumerate(zip(part, tagger.spans(x))):
            for s, e, kind, sure in spans:
                yield lo + row, a + s, a + e, kind, sure, (s == 0 and a > 0) or (e >= width and a + width < len(texts[k]))


def regions(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that overlap or touch, joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def furthest(spans: Iterable[tuple[int, int]]) -> Callable[[int], int]:
    """The furthest end of the spans that start at a place or before it; 0 without any."""
    ordered = sorted(spans)
    starts, ends = [a for a, _ in ordered], [0, *accumulate((b for _, b in ordered), max)]
    return lambda at: ends[bisect_right(starts, at)]


def find_spans(texts: list[str], tagger: Tagger, gated: bool = True) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text; gated as in windows().

    Where an inner edge of a window cuts a span that is clear of the base spans and that no other window shows whole, the
    text is decoded again in a window laid around all its pieces, twice as wide until no edge cuts a span there.
    """
    some = [not gated or bool(_DIGIT.search(t) or _MARK.search(t)) for t in texts]
    base = [base_spans(t) if own else [] for t, own in zip(texts, some)]
    asked = [(k, a) for k, t in enumerate(texts) if some[k] for a in windows(t, base[k], gated)]
    found: dict[int, list[tuple[int, int, int, float]]] = {}
    cuts: dict[int, list[tuple[int, int]]] = {}

    def take(k: int, a: int, b: int, kind: int, sure: float) -> None:
        if sure >= CONFIDENCE and valid(kind, texts[k][a:b]):
            found.setdefault(k, []).append((a, b, kind, sure))

    for place, a, b, kind, sure, cut in decoded(texts, asked, WINDOW, tagger):
        if cut:
            cuts.setdefault(asked[place][0], []).append((a, b))
        else:
            take(asked[place][0], a, b, kind, sure)
    for k, pieces in cuts.items():
        taken, whole = furthest((a, b) for a, _, b in base[k]), furthest((a, b) for a, b, _, _ in found.get(k, []))
        cuts[k] = regions([(a, b) for a, b in pieces if taken(b - 1) <= a and whole(a) < b])
    width = 2 * WINDOW
    while any(cuts.values()):
        every = [(k, lo, hi) for k, own in cuts.items() for lo, hi in own]
        fit = [(k, lo, hi) for k, lo, hi in every if hi - lo + WINDOW <= width]
        again: dict[int, list[tuple[int, int]]] = {}
        for k, lo, hi in every:
            if hi - lo + WINDOW > width:
                again.setdefault(k, []).append((lo, hi))
        shown_in: dict[int, list[tuple[int, int, int, float, bool]]] = {}
        for place, *span in decoded(texts, [(k, max(0, lo - (width - hi + lo) // 2)) for k, lo, hi in fit], width, tagger):
            if span[0] < fit[place][2] and fit[place][1] < span[1]:
                shown_in.setdefault(place, []).append(tuple(span))
        for place, spans in shown_in.items():
            k, lo, hi = fit[place]
            if any(cut for *_, cut in spans):
                again.setdefault(k, []).extend([(lo, hi), *((a, b) for a, b, *_ in spans)])
                continue
            for a, b, kind, sure, _ in spans:
                take(k, a, b, kind, sure)
        cuts = {k: regions(own) for k, own in again.items()}
        width *= 2
    return [(b, sorted([*b, *reconcile(found[k], b)]) if k in found else b) for k, b in enumerate(base)]


def shown(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans)


def find_pii(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """docs without the text, with n_email, n_ip, n_card, n_phone, base_sha256 and spans.

    spans: kind:start:end in code points, end exclusive, by start and then kind, comma-joined: the base spans and
    those the tagger adds; n_*: the numbers of the base spans; base_sha256: the hex digest of their string. A null text is
    empty and has none. One row per row of docs; its other columns stay, those of these names replaced.
    """
    small_batches(docs.sparkSession)
    names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    rest = [c for c in docs.columns if c != "text" and c.lower() not in names]
    given = docs.select(*[F.col(f"`{c}`") for c in rest], text_or_empty().alias(free_name(docs, "pii_text")))
    schema = given.select(*[F.col(f"`{c}`") for c in rest]).schema
    for name in names:
        schema = schema.add(name, "long" if name.startswith("n_") else "string")
    shared = docs.sparkSession.sparkContext.broadcast(tagger or trained())  # of fixed size, some 100 KB

    def found(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            got = find_spans(batch.column(batch.num_columns - 1).to_pylist(), shared.value)
            counts = [pa.array([sum(s[1] == k for s in own) for own, _ in got], pa.int64()) for k in range(len(KINDS))]
            digests = pa.array([hashlib.sha256(shown(b).encode()).hexdigest() for b, _ in got], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *counts, digests, pa.array([shown(every) for _, every in got], pa.string())], [*rest, *names])

    return given.mapInArrow(found, schema)
