"""Keyed state that lives with the stream: the response cache, whose entries expire, and the conversation memory, which keeps the last turns."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Seconds that a cached response lives, and turns that a conversation remembers.
CACHE_TTL, REMEMBERED = 3600, 5
#: Requests of the cache: ask for a key, or set its value. seq orders requests of one key within a batch.
REQUEST = "key string, seq long, kind string, value string"
ANSWER = "key string, seq long, hit boolean, value string"
TURN = "tenant_id string, conv_id long, turn long, role string, text string"
MEMORY = "tenant_id string, conv_id long, turn long, remembered int, history array<struct<turn: bigint, role: string, text: string>>"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Keyed state with lists and expiry needs the RocksDB store; a provider that the session names already is kept."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(key, ""):
        spark.conf.set(key, ROCKSDB)
    spark.streams.active  # noqa: B018  starts the session's state coordinator, which a table's state needs too


class ResponseCache(StatefulProcessor):
    """One value a key, gone ttl seconds after it was last set. A blank key is never cached; a null value is none."""

    def __init__(self, ttl: float = CACHE_TTL):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entry = handle.getValueState("entry", "value string", int(self.ttl * 1000))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        for r in sorted(rows, key=lambda r: (r["seq"], r["kind"] == "get")):
            if r["kind"] == "set":
                if r["value"] is not None and (key[0] or "").strip():
                    self.entry.update((r["value"],))
                continue
            found = self.entry.get() if self.entry.exists() else None
            yield Row(key=key[0], seq=r["seq"], hit=found is not None, value=found[0] if found is not None else None)

    def close(self) -> None:
        pass


class ConversationMemory(StatefulProcessor):
    """The last turns of a tenant's conversation, in the order of their numbers; each turn that isn't blank answers with what is then remembered."""

    def __init__(self, remembered: int = REMEMBERED, ttl: float | None = None):
        self.remembered, self.ttl = remembered, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = "turn long, role string, text string"
        self.turns = handle.getListState("turns", schema) if self.ttl is None else handle.getListState("turns", schema, int(self.ttl * 1000))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        kept = [tuple(t) for t in self.turns.get()] if self.turns.exists() else []
        # A turn that is sent again, as after a failure of its sender, has its place already.
        fresh = sorted((r["turn"], r["role"], r["text"]) for r in rows if (r["text"] or "").strip() and r["role"] is not None and r["turn"] is not None)
        for turn in fresh:
            if turn in kept:
                continue
            kept = sorted([*kept, turn])[-self.remembered :]
            yield Row(tenant_id=key[0], conv_id=key[1], turn=turn[0], remembered=len(kept), history=[Row(turn=t, role=r, text=x) for t, r, x in kept])
        if kept:
            self.turns.put(kept)

    def close(self) -> None:
        pass


def cache_answers(requests: DataFrame, ttl: float = CACHE_TTL) -> DataFrame:
    """ANSWER rows for the requests (REQUEST) of kind get, of a stream or a table: what the key's last set before it (by seq, in this batch or one before) had, unless it has expired.

    Expiry goes by the clock when a batch is run. The rows of one key of a batch meet in one task.
    """
    use_state_store(requests.sparkSession)
    return requests.groupBy("key").transformWithState(ResponseCache(ttl), ANSWER, "append", "ProcessingTime")


def remember(turns: DataFrame, remembered: int = REMEMBERED, ttl: float | None = None) -> DataFrame:
    """MEMORY rows for the turns (TURN) of a stream or a table, one for each turn that isn't blank: the last remembered turns of its tenant's conversation up to it.

    A turn that comes in a later batch than one of a higher number takes its place among those that are remembered, and falls out if it is older than all of them.
    """
    use_state_store(turns.sparkSession)
    keyed = turns.select("tenant_id", "conv_id", F.col("turn").cast("long"), "role", "text").groupBy("tenant_id", "conv_id")
    return keyed.transformWithState(ConversationMemory(remembered, ttl), MEMORY, "append", "None" if ttl is None else "ProcessingTime")
