"""The outbox as keyed streaming state: what is still to be sent of each record.

A change raises its record's generation and clears its attempts; a failed send
counts an attempt; an acknowledgement of the generation that is current ends the
entry, one of an older generation does not, as the record has changed since.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Columns of an entry after its key.
ENTRY = "generation long, operation string, changed_at timestamp, event_id long, attempts int, pending boolean"


class OutboxEntries(StatefulProcessor):
    """Entries of records, over rows (key, ``kind``, ``operation``, ``at``, ``event_id``, ``generation``).

    ``kind`` is ``change``, ``failed`` or ``sent``. Rows of one micro-batch are
    taken in the order of ``at`` and ``event_id``; of changes that come late, the
    generation counts, but the newest one's operation stays.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entry = handle.getValueState("entry", ENTRY)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        kept = self.entry.get() if self.entry.exists() else None
        generation, operation, changed, event, attempts, pending = tuple(kept) if kept is not None else (0, None, None, -1, 0, False)
        changed = None if changed is None else pd.Timestamp(changed)
        taken = (row for part in rows for row in zip(*(part[c].tolist() for c in ("at", "event_id", "kind", "operation", "generation")), strict=True))
        for at, number, kind, done, sent in sorted(taken, key=lambda row: [(True, 0) if pd.isna(x) else (False, x) for x in row[:2]]):  # missing ones last
            if kind == "change":
                generation, attempts, pending = generation + 1, 0, True
                if changed is None or (at, number) > (changed, event):
                    operation, changed, event = done, at, number
            elif kind == "failed":
                attempts += int(pending)
            elif kind == "sent" and sent == generation:
                pending = False
        self.entry.update((int(generation), operation, None if changed is None else changed.to_pydatetime(), int(event), int(attempts), bool(pending)))
        names = ["generation", "operation", "changed_at", "event_id", "attempts", "pending"]
        yield pd.DataFrame([[*key, generation, operation, changed, event, attempts, pending]], columns=[*self.keys, *names])

    def close(self) -> None:
        pass

    def __init__(self, keys: list[str]):
        self.keys = keys


def outbox_updates(events: DataFrame, keys: list[str]) -> DataFrame:
    """A stream of entries as they become, one for each record and micro-batch that touches it; update mode."""
    schema = T.StructType([*[events.schema[k] for k in keys], *T._parse_datatype_string(ENTRY).fields])
    return events.groupBy(*keys).transformWithStateInPandas(OutboxEntries(keys), schema, "Update", "None")


def run_outbox(spark: SparkSession, events: DataFrame, keys: list[str], out: str, checkpoint: str) -> DataFrame:
    """Run the stream until what is there is done; the last entry of each record.

    A micro-batch's entries are a folder by its number, so one that is run again
    writes the same folder.
    """
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        query = outbox_updates(events, keys).writeStream.outputMode("update").foreachBatch(write)
        query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)
    entries = spark.read.parquet(out)
    rest = [c for c in entries.columns if c not in (*keys, "batch")]
    last = entries.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("e"))
    return last.select(*keys, *[F.col(f"e.{c}").alias(c) for c in rest])
