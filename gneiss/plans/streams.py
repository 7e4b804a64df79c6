"""The batch form of the streaming extension's window query, with its SQL."""

from __future__ import annotations

from gneiss.streaming.ingest import event_counts


def event_windows(spark, sf):
    return event_counts(spark.read.parquet(f"{sf}/events.parquet").select("ts", "event_type", "value"))


QUERIES = {"event_windows": event_windows}
ORACLE = {"event_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL"}
