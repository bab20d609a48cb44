"""What an import says about its files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import is_complete, present
from ..schema import STATUSES
from .snapshot import materialize


def file_status(already: Column) -> Column:
    """Status of an extracted invoice row; already: its hash is in the ledger."""
    return (
        F.when(already, "alreadyImported")
        .when(is_complete(), "imported")
        .when(present(F.col("number")) | present(F.col("total")), "needsReview")
        .otherwise("failed")
    )


def vision_candidate(has_image: Column) -> Column:
    return has_image & ~is_complete()


def tally(files: DataFrame) -> DataFrame:
    """One row: a count per status, total and vision_candidates, of (status, vision_would_help)."""
    return files.agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES],
        F.count(F.lit(1)).alias("total"),
        F.count_if("vision_would_help").alias("vision_candidates"),
    )


IDLE = {"phase": "idle", "total": 0, "done": 0, "current_name": None, "tally": dict.fromkeys(STATUSES, 0), "vision_candidates": 0, "problems": []}


def reduce_ingest(state: dict, event: dict) -> dict:
    """The next state of an import's display: started resets, finished overrides the running tally."""
    kind = event["type"]
    if kind == "started":
        return {**IDLE, "tally": dict(IDLE["tally"]), "problems": [], "phase": "running", "total": event["total"]}
    if kind == "file":
        counts = dict(state["tally"])
        counts[event["status"]] += 1
        return {
            **state,
            "done": state["done"] + 1,
            "current_name": event["name"],
            "tally": counts,
            "vision_candidates": state["vision_candidates"] + bool(event.get("vision_would_help")),
            "problems": state["problems"] if event["status"] == "imported" else [*state["problems"], event],
        }
    if kind == "finished":
        last = {"imported": event["imported"], "needsReview": event["needs_review"], "alreadyImported": event["duplicates"], "failed": event["failed"]}
        return {**state, "phase": "done", "current_name": None, "tally": last}
    raise ValueError(f"unknown event {kind!r}")


#: An import's event as a row; what its type doesn't have is null.
EVENT = "import_id bigint, seq bigint, type string, total bigint, name string, status string, vision_would_help boolean, imported bigint, needs_review bigint, duplicates bigint, failed bigint"
#: An import's display as a row.
PROGRESS = "import_id bigint, last_seq bigint, phase string, total bigint, done bigint, current_name string, imported bigint, needs_review bigint, duplicates bigint, failed bigint, vision_candidates bigint, problems bigint"
COUNTED = dict(zip(("imported", "needs_review", "duplicates", "failed"), ("imported", "needsReview", "alreadyImported", "failed"), strict=True))


def merged_progress(events: DataFrame, known: DataFrame) -> DataFrame:
    """The displays that some events touch, after those beyond the last one that each known display has seen.

    An event that comes more than once counts once. What is new is folded by ``progress``; where it holds no start, the known display goes on.
    """
    last = known.select("import_id", F.col("last_seq").alias("_last"))
    fresh = events.join(last, "import_id", "left").where(F.col("_last").isNull() | (F.col("seq") > F.col("_last"))).drop("_last")
    fresh = materialize(fresh.dropDuplicates(["import_id", "seq"]))
    own = progress(fresh).alias("n")
    begun = fresh.where("type = 'started'").select("import_id").distinct().withColumn("_begun", F.lit(True))
    new, old = lambda c: F.col(f"n.{c}"), lambda c: F.col(f"o.{c}")
    goes_on = F.col("_begun").isNull() & old("import_id").isNotNull()
    ended = new("phase") == "done"
    add = lambda c: (new(c) + F.when(goes_on, old(c)).otherwise(0)).cast("long").alias(c)
    return own.join(known.alias("o"), F.col("n.import_id") == F.col("o.import_id"), "left").join(begun.alias("b"), F.col("n.import_id") == F.col("b.import_id"), "left").select(
        new("import_id").alias("import_id"), new("last_seq").alias("last_seq"), F.when(goes_on & ~ended, old("phase")).otherwise(new("phase")).alias("phase"),
        F.when(goes_on, old("total")).otherwise(new("total")).alias("total"), add("done"),
        F.when(goes_on & ~ended & (new("done") == 0), old("current_name")).otherwise(new("current_name")).alias("current_name"),
        # a finish replaces the tally that led to it
        *[(new(c) + F.when(goes_on & ~ended, old(c)).otherwise(0)).cast("long").alias(c) for c in COUNTED], add("vision_candidates"), add("problems"),
    )


def progress(events: DataFrame) -> DataFrame:
    """The display of every import after all its events, in order of seq: what ``reduce_ingest`` arrives at.

    What is before the last start doesn't count, and the last finish since then replaces the tally that led to it. Both
    places are aggregates, so an import of very many events is never ordered in one task.
    """
    is_ = lambda t: F.col("type") == t
    start = events.groupBy("import_id").agg(F.max(F.when(is_("started"), F.col("seq"))).alias("_start"), F.max_by("total", F.when(is_("started"), F.col("seq"))).alias("_total"), F.max("seq").alias("last_seq"))
    start = materialize(start)
    since = events.join(start.select("import_id", "_start"), "import_id").where(F.col("_start").isNull() | (F.col("seq") > F.col("_start")))
    at = F.when(is_("finished"), F.col("seq"))
    finish = materialize(since.where(is_("finished")).groupBy("import_id").agg(F.max(at).alias("_finish"), *[F.max_by(c, at).alias(f"_{c}") for c in COUNTED]))
    files = since.where(is_("file")).join(finish.select("import_id", "_finish"), "import_id", "left")
    after = F.col("_finish").isNull() | (F.col("seq") > F.col("_finish"))
    seen = files.groupBy("import_id").agg(
        F.count(F.lit(1)).alias("done"), F.max_by("name", F.when(after, F.col("seq"))).alias("current_name"),
        *[F.count_if(after & (F.col("status") == s)).alias(f"_more_{c}") for c, s in COUNTED.items()],
        F.count_if("vision_would_help").alias("vision_candidates"), F.count_if(F.col("status") != "imported").alias("problems"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    phase = F.when(F.col("_finish").isNotNull(), "done").when(F.col("_start").isNotNull(), "running").otherwise("idle")
    return start.join(finish, "import_id", "left").join(seen, "import_id", "left").select(
        "import_id", "last_seq", phase.alias("phase"), zero("_total").alias("total"), zero("done").alias("done"), "current_name",
        *[(zero(f"_{c}") + zero(f"_more_{c}")).alias(c) for c in COUNTED], zero("vision_candidates").alias("vision_candidates"), zero("problems").alias("problems"),
    )
