"""URL filters: host-suffix and path-prefix expressions, matched on short hash prefixes and confirmed on full digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gneiss.llm.session import free_name

#: Hex digits of a SHA-256 digest that the join is on; the rest is compared afterwards.
PREFIX_DIGITS = 8
#: The most labels and code points of path that a URL is expanded to. A rule with more is found by its last labels and
#: first code points of so many, and compared whole with what it is found by.
MAX_LABELS, MAX_PATH = 127, 2048
#: Between host and path in what is hashed; no host has one.
BETWEEN = "#"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _expressions(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """The host's suffixes of so many labels, each with the path's prefixes of so many code points."""
    suffixes = F.transform(F.filter(F.array(*map(F.lit, labels)), lambda n: n <= F.size(F.split(host, r"\."))), lambda n: F.call_function("substring_index", host, F.lit("."), -n))
    prefixes = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.char_length(path)), lambda n: F.substr(path, F.lit(1), n))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, F.lit(BETWEEN), p))))


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict.

    rules: (host, path, action); a rule fits its host and all subdomains where the URL's path starts with the
    rule's path. The rule with the most code points in host and path wins; of equal ones (the same rule listed
    with both actions) ``block`` wins. Without a fitting rule, rule is null and verdict is ``default``. Rules with
    a null or empty host or a null path or action fit nothing. A null url, or one without ``://``, has an empty host
    and path and no rule. Repeated pages give repeated rows; columns of pages named host, path, rule or verdict
    are replaced.

    Each distinct (host, path) is expanded once, however many rows share it; only the numbers of labels and the
    path lengths that some rule has are expanded, so the matches are exact and their number is bounded by the
    rules' shapes, not by the URL.
    """
    rules = rules.select(F.translate("host", _UPPER, _LOWER).alias("rh"), F.col("path").alias("rp"), "action").where("rh is not null and rh <> '' and rp is not null and action is not null")
    rules = rules.groupBy("rh", "rp").agg(F.max("action").alias("action"))
    labels = [r[0] for r in rules.select(F.least(F.size(F.split("rh", r"\.")), F.lit(MAX_LABELS))).distinct().collect()]  # MAX_LABELS at most
    lengths = [r[0] for r in rules.select(F.least(F.char_length("rp"), F.lit(MAX_PATH))).distinct().collect()]  # MAX_PATH at most, and 0
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    split = pages.select(*[F.col(f"`{c}`") for c in kept], host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    if not labels:
        return split.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})

    key = F.concat(F.call_function("substring_index", "rh", F.lit("."), F.lit(-MAX_LABELS)), F.lit(BETWEEN), F.substring("rp", 1, MAX_PATH))
    digests = rules.select("rh", "rp", F.concat("rh", "rp").alias("rule"), "action", F.sha2(key, 256).alias("digest")).withColumn("short", F.substring("digest", 1, PREFIX_DIGITS))
    places = split.select("host", "path").distinct()
    asked = places.select("host", "path", F.explode(_expressions(F.col("host"), F.col("path"), sorted(labels), sorted(lengths))).alias("text"))
    asked = asked.select("host", "path", F.sha2("text", 256).alias("asked")).withColumn("short", F.substring("asked", 1, PREFIX_DIGITS))
    whole = F.endswith(F.concat(F.lit("."), "host"), F.concat(F.lit("."), "rh")) & F.startswith("path", F.col("rp"))
    fits = asked.join(digests, "short").where((F.col("asked") == F.col("digest")) & whole)
    name = free_name(split, "best")
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.char_length("rule").alias("n"), F.col("action").alias("a"), F.col("rule").alias("r"))).alias(name))
    out = split.join(best, ["host", "path"], "left")
    return out.select(*[F.col(f"`{c}`") for c in kept], "host", "path", F.col(f"`{name}`.r").alias("rule"), F.coalesce(F.col(f"`{name}`.a"), F.lit(default)).alias("verdict"))
