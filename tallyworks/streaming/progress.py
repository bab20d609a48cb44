"""The display of imports as keyed state over a stream of their events.

Each import's state is one small row. ``follow`` keeps it in a table: a micro-batch's events are aggregated, so no import's events
meet in one task, and merged into the rows that they touch. ``progress_stream`` keeps it in the stream's own state and folds an
import's events of a batch at once. Events up to the last one seen are replays and change nothing, so any split of the stream into batches, and any batch that comes again, ends in the same
state as ``operators.ingest.progress`` over all events. Events of an import must not come after later ones of
an earlier batch: the source hands them over in order (a log, or files by time).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators.ingest import COUNTED, EVENT, PROGRESS, merged_progress
from ..operators.snapshot import materialize
from ..operators.store import Store, upserts

FIELDS = [f.split()[0] for f in PROGRESS.split(", ")][1:]
STATE = PROGRESS.removeprefix("import_id bigint, ")
BLANK = {"last_seq": -1, "phase": "idle", "total": 0, "done": 0, "current_name": None, **dict.fromkeys(COUNTED, 0), "vision_candidates": 0, "problems": 0}


def fold(state: dict, events: pd.DataFrame) -> dict:
    """The state after some events, in any order within ``events``."""
    fresh = events[events["seq"] > state["last_seq"]].drop_duplicates("seq").sort_values("seq")
    if fresh.empty:
        return state
    out = {**state, "last_seq": int(fresh["seq"].iloc[-1])}
    started = fresh[fresh["type"] == "started"]
    if len(started):
        out |= {**BLANK, "last_seq": out["last_seq"], "phase": "running", "total": int(started["total"].iloc[-1])}
        fresh = fresh[fresh["seq"] > started["seq"].iloc[-1]]
    finished, files = fresh[fresh["type"] == "finished"], fresh[fresh["type"] == "file"]
    out["done"] += len(files)
    out["vision_candidates"] += int(files["vision_would_help"].eq(True).sum())
    out["problems"] += int((files["status"] != "imported").sum())
    if len(finished):
        out |= {"phase": "done", "current_name": None, **{c: int(finished[c].iloc[-1]) for c in COUNTED}}
        files = files[files["seq"] > finished["seq"].iloc[-1]]
    for c, s in COUNTED.items():
        out[c] += int((files["status"] == s).sum())
    if len(files):
        out["current_name"] = files["name"].iloc[-1]
    return out


def progress_stream(events: DataFrame) -> DataFrame:
    """The changed displays of a stream of events, one row for each import that a batch touches."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = dict(zip(FIELDS, state.get, strict=True)) if state.exists else dict(BLANK)
        own = fold(own, pd.concat(list(batches), ignore_index=True))
        state.update(tuple(own[f] for f in FIELDS))
        yield pd.DataFrame([{"import_id": key[0], **own}])

    return events.groupBy("import_id").applyInPandasWithState(step, PROGRESS, STATE, "update", GroupStateTimeout.NoTimeout)


def watch_events(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def progress_table(spark: SparkSession, path: str) -> Store:
    store = Store(spark, path)
    store.table("progress", StructType.fromDDL(PROGRESS), ["import_id"])
    return store


def follow(events: DataFrame, store: Store, checkpoint: str, name: str = "progress", available_now: bool = True) -> StreamingQuery:
    """Keeps a table of displays up to date; each batch is one change set, committed once however often it runs."""

    def each(batch: DataFrame, number: int) -> None:
        if store.manifest().batches.get(name, -1) < number:
            shown = materialize(merged_progress(batch, store.tables["progress"].read_keys(batch)))
            store.apply({"progress": upserts(shown, F.col("last_seq"))}, batch=(name, number))

    writer = events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
