"""Figures of a table that are gathered while it is written, so that no second scan is needed for counts and manifests."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, functions as F


def write_counted(df: DataFrame, path: str, figures: dict[str, Column] | None = None, values: dict[str, Sequence[Any]] | None = None, by: Sequence[str] = ()) -> dict[str, Any]:
    """Writes df to path as Parquet (in folders by the columns of by) and returns figures of what was written, gathered by the writing tasks themselves.

    rows, and each of figures (an aggregate by name). values: for a column, the values that are counted, under "column=value"; those that are none of them are counted under
    "column=other", so the counts of a column always add up to rows. The values must be stated beforehand: as many counts are kept as there are values, whatever the data.
    """
    watched = Observation()
    measures = [F.count(F.lit(1)).alias("rows"), *[c.alias(name) for name, c in (figures or {}).items()]]
    for column, known in (values or {}).items():
        own = F.col(f"`{column}`")
        measures += [F.count_if(own.eqNullSafe(F.lit(v))).alias(f"{column}={v}") for v in known]
        measures.append(F.count_if(~F.coalesce(own.isin(*[v for v in known if v is not None]), F.lit(None in known))).alias(f"{column}=other"))
    writer = df.observe(watched, *measures).write
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return watched.get


def manifest(counts: dict[str, Any], column: str) -> dict[str, int]:
    """A column's counts of what was written, those over zero, by value."""
    start = f"{column}="
    return {name.removeprefix(start): n for name, n in counts.items() if name.startswith(start) and n}
