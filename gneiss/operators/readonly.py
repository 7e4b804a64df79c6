"""Read-only SQL: a SELECT whose parsed plan only reads tables that the session knows."""

from __future__ import annotations

import re

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession


class UnsupportedQueryError(ValueError):
    """SQL that isn't a SELECT of known tables."""


#: Nodes of a parsed plan that read or rearrange rows. What isn't here, such as a script transformation or any command, is refused.
READING = frozenset(
    """Aggregate CTE Deduplicate Distinct Except Expand Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit LocalRelation Offset OneRowRelation Pivot Project
    RebalancePartitions Repartition RepartitionByExpression Sample Sort SubqueryAlias Union UnresolvedHaving UnresolvedHint UnresolvedInlineTable UnresolvedOrdinal UnresolvedPivot UnresolvedRelation UnresolvedSubqueryColumnAliases
    UnresolvedTVFAliases UnresolvedTableValuedFunction UnresolvedUnpivot UnresolvedWith Unpivot WithWindowDefinition View Window""".split()
)
#: Functions that call any method of the JVM.
CALLS = re.compile(r"(?i)'(?:try_)?reflect\(|'java_method\(")
_NODE = re.compile(r"^(?P<tree>(?:[:+\- ] {2}|[:+]- )*)'?(?P<name>[A-Za-z]+)")
_RELATION = re.compile(r"UnresolvedRelation \[(?P<parts>.*?)\], \[")


def parsed_plan(spark: SparkSession, query: str) -> list[str]:
    """The lines of the query's parsed plan, a node each but for those that a line end in a literal begins. Nothing is run."""
    text = spark.sql(f"EXPLAIN EXTENDED {query}").first()[0]
    return text.split("== Analyzed Logical Plan ==", 1)[0].split("== Parsed Logical Plan ==", 1)[1].strip("\n").split("\n")


def nodes(lines: list[str]) -> list[tuple[str, str]]:
    """(name, line) of each node. A line that doesn't begin with a branch of the tree goes on with a literal of the node above; a literal can add nodes by its line ends, and hide none."""
    found = []
    for k, line in enumerate(lines):
        met = _NODE.match(line)
        if met and (k == 0 or met["tree"].endswith("- ")):
            found.append((met["name"], line[met.start("name") :]))
    return found


def check_read_only(spark: SparkSession, query: str) -> None:
    """Raises UnsupportedQueryError unless the query is one SELECT statement whose plan only reads, and only tables and views of the session: no path as a table, no script, no call into the JVM. WITH at its start is refused; a subquery may have one."""
    if not query.strip().lower().startswith("select"):
        raise UnsupportedQueryError("only SELECT is allowed")
    try:
        lines = parsed_plan(spark, query)
    except ParseException as e:
        if ";" in query and re.search("extra input|near ';'", str(e)):
            raise UnsupportedQueryError("only one statement is allowed") from e
        raise
    for name, line in nodes(lines):
        if name not in READING:
            raise UnsupportedQueryError(f"{name} isn't allowed in a SELECT")
        for met in _RELATION.finditer(line):
            parts = met["parts"].split(", ")
            if len(parts) > 1 and not spark.catalog.tableExists(".".join(f"`{p.replace('`', '``')}`" for p in parts)):
                raise UnsupportedQueryError(f"{'.'.join(parts)} is no table of this session")
    if CALLS.search("\n".join(lines)):
        raise UnsupportedQueryError("calls into the JVM aren't allowed")


def select_only(spark: SparkSession, query: str) -> DataFrame:
    """spark.sql of a query that check_read_only lets pass; a semicolon may end it."""
    query = query.strip()
    while query.endswith(";"):
        query = query[:-1].rstrip()
    check_read_only(spark, query)
    return spark.sql(query)
