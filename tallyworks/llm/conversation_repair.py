"""Conversation structure repair: the cheapest edits of turns, found by a scan of min-plus matrices.

A conversation is well formed if the initials of its roles read ``(s?(ua)+)?``. Reading it is in one of
four states: nothing read, or the last role was s, u or a. Every turn is a 4x4 matrix whose entry (i, j)
is the cheapest way from state i to state j over that turn, as an element (cost, audit): audit is the
string of edits, one letter each. Elements add up by cost and joined audits; of two, the cheaper stays,
of equal cost the one whose audit is least in ASCII. Two audits of equal cost are never prefixes of one
another (an insertion costs), so that order survives appending and the product of matrices is associative.

1. Equal rows of a turn become one row with a count. Rows are sorted by ranges of (conversation, turn,
   role, text), so a conversation of very many rows spans many partitions; no task ever holds one.
2. A task folds the turns of each conversation into chunks of at most ``CHUNK`` rows and ``CHUNK_BYTES``
   bytes, each turn's matrix closed under insertion, and writes a matrix per chunk.
3. Conversations of several chunks go through a tree of products, ``FAN`` children a node, up for the
   total and down again for the states between the children.
4. Each chunk replays the audit between its two states over its rows.

Edits: Keep 0, Rerole to user or assistant 2, Delete 3 (the only one for blank or duplicate turns), Insert a
turn without text 2; a truncated turn that stays adds 1. The state decides whether an inserted or reroled
turn is the user's or the assistant's.

Edge cases: a null role or text is one space (so such a text is blank); rows with a null turn come first;
rows of one turn go by role, then text (their first 32 and 64 characters, then a hash of both);
repeated rows follow each other and are duplicates; a null conv_id is a conversation of its own; a conversation
without rows has zeros, an empty audit and the hash of the empty text; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

#: Most rows and bytes of text of a chunk; children of a node of the tree, as a power of two.
CHUNK, CHUNK_BYTES, FAN_BITS = 1_000, 4 << 20, 6
#: The states' names, and the state after each turn that may be kept.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The role of a turn that is inserted or reroled, and the state after it.
FILLS = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
WHITE = " \t\n\x0b\x0c\r"

Element = tuple[int, str] | None
Matrix = list[list[Element]]
ELEMENT = "struct<cost: bigint, audit: string>"
_MATRIX = pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())]))


def times(p: Matrix, q: Matrix) -> Matrix:
    out: Matrix = []
    for row in p:
        best: list[Element] = [None] * 4
        for i, a in enumerate(row):
            if a is not None:
                for j, b in enumerate(q[i]):
                    if b is not None:
                        made = (a[0] + b[0], a[1] + b[1])
                        if best[j] is None or made < best[j]:
                            best[j] = made
        out.append(best)
    return out


def _closure() -> Matrix:
    """Any number of insertions: the closure of one or none."""
    one: Matrix = [[(0, "") if i == j else None for j in range(4)] for i in range(4)]
    for i, (_, j) in FILLS.items():
        one[i][j] = (INSERT, "I")
    return times(times(one, one), one)


CLOSURE = _closure()


def turn_matrix(initial: str, fault: str | None, copies: int = 1) -> Matrix:
    """A turn and its repetitions, with the insertions that may follow each."""
    out: Matrix = [[None] * 4 for _ in range(4)]
    for i in range(4):
        out[i][i] = (DELETE, "D")
        if fault not in ("blank", "duplicate"):
            extra = TRUNCATED if fault == "truncated" else 0
            out[i][FILLS[i][1]] = (REROLE + extra, "R")
            if (i, initial) in NEXT:
                out[i][NEXT[i, initial]] = (KEEP + extra, "K")
    out = times(out, CLOSURE)
    if copies > 1:
        gone: Matrix = [[(DELETE * (copies - 1), "D" * (copies - 1)) if i == j else None for j in range(4)] for i in range(4)]
        out = times(out, times(gone, CLOSURE))
    return out


def fold(turns: list[tuple[str, str | None, int]]) -> Matrix:
    """The product over (role initial, fault, copies) of some turns; insertions may come first."""
    out = CLOSURE
    known: dict[tuple, Matrix] = {}
    for turn in turns:
        if turn not in known:
            known[turn] = turn_matrix(*turn)
        out = times(out, known[turn])
    return out


def replay(state: int, audit: str, rows: list[tuple]) -> Iterator[tuple]:
    """(edit, times, turn, role, text) of an audit over rows (turn, role, text, copies)."""
    at, left = -1, 0
    gone = 0
    for edit in audit:
        if edit == "I":
            role, state = FILLS[state]
            if gone:
                yield ("D", gone, *rows[at][:3])
                gone = 0
            yield ("I", 1, None, role, "")
            continue
        if not left:
            if gone:
                yield ("D", gone, *rows[at][:3])
                gone = 0
            at += 1
            left = rows[at][3]
        left -= 1
        turn, role, text = rows[at][:3]
        if edit == "D":
            gone += 1
            continue
        if edit == "R":
            role, state = FILLS[state]
        else:
            state = NEXT[state, role[:1]]
        yield (edit, 1, turn, role, text)
    if gone:
        yield ("D", gone, *rows[at][:3])


def _flat(m: Matrix) -> list[dict | None]:
    return [None if e is None else {"cost": e[0], "audit": e[1]} for row in m for e in row]


def _square(flat) -> Matrix:
    own = [None if e is None else (e["cost"], e["audit"]) for e in flat]
    return [own[i : i + 4] for i in range(0, 16, 4)]


def conversation_key(conv_id: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def with_faults(turns: DataFrame) -> DataFrame:
    """(c, turn, role, text, n, fault) of turns (c, turn, role, text, n); equal rows become one with a count."""
    same = turns.groupBy("c", "turn", "role", "text").agg(F.sum("n").alias("n")).withColumn("h", F.sha2(F.concat_ws("\x00", "role", "text"), 256))
    # only texts that come in several turns meet the rows again; both sides are plain exchanges, so a hot text can be split over tasks
    seen = materialize(
        same.groupBy("c", "h").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct(F.col("turn").isNotNull().alias("k"), "turn")).alias("first")).where("m > 1"),
        "seen",
    )
    text = F.rtrim("text", F.lit(WHITE))
    again = F.col("first").isNotNull() & (F.struct(F.col("turn").isNotNull().alias("k"), F.col("turn")) != F.col("first"))
    fault = F.when(text == "", "blank").when(again, "duplicate").when(~F.right(text, F.lit(1)).isin(".", "!", "?"), "truncated")
    return same.join(seen.select("c", "h", "first"), ["c", "h"], "left").select("c", "turn", "role", "text", "n", "h", fault.alias("fault"))


def chunks_of(faults: DataFrame) -> DataFrame:
    """Rows in order with their chunk (p, k) and place i; a chunk's last row holds its matrix and role initials."""
    spark = faults.sparkSession
    schema = f"c string, p int, k int, i int, turn bigint, role string, text string, n bigint, fault string, m array<{ELEMENT}>, head string, tail string, illegal bigint"
    names = ["c", "p", "k", "i", "turn", "role", "text", "n", "fault", "m", "head", "tail", "illegal"]
    types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), _MATRIX, pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        out: list[tuple] = []
        open_: list[tuple] = []
        key, k, size, held = None, 0, 0, 0

        def close() -> None:
            illegal, before = 0, None
            for _, role, _, n, _ in open_:
                initial = role[:1]
                if before is not None:
                    illegal += before + initial not in ("su", "ua", "au")
                illegal += n - 1  # a role never follows itself
                before = initial
            m = _flat(fold([(r[1][:1], r[4], r[3]) for r in open_]))
            for i, r in enumerate(open_):
                last = i == len(open_) - 1
                out.append((key, part, k, i, *r, *((m, open_[0][1][:1], before, illegal) if last else (None,) * 4)))
            open_.clear()

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names)

        for batch in batches:
            for c, *rest in zip(*(batch.column(x).to_pylist() for x in ("c", "turn", "role", "text", "n", "fault")), strict=True):
                if open_ and (c != key or len(open_) >= CHUNK or size >= CHUNK_BYTES):
                    close()
                    k = k + 1 if c == key else 0
                    held += size
                    size = 0
                    if len(out) >= CHUNK or held >= CHUNK_BYTES:
                        yield batch_of(out)
                        out, held = [], 0
                key = c
                open_.append(tuple(rest))
                size += len(rest[2].encode())
        if open_:
            close()
        if out:
            yield batch_of(out)

    order = [F.col("c"), F.col("turn").asc_nulls_first(), F.left("role", F.lit(32)), F.left("text", F.lit(64)), F.col("h")]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return materialize(faults.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, schema), "chunks")


def _tree(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(totals, states) of conversations of several chunks: their products, and each chunk's states before and after it."""
    spec = f"m array<{ELEMENT}>, head string, tail string, illegal bigint"

    def combine(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["hi", "lo"])
        total, illegal = CLOSURE, int(rows["illegal"].sum())
        for m in rows["m"]:
            total = times(total, _square(m))
        for tail, head in zip(rows["tail"][:-1], rows["head"][1:], strict=True):
            illegal += tail + head not in ("su", "ua", "au")
        return pd.DataFrame({"c": [key[0]], "hi": [key[1]], "lo": [key[2]], "m": [_flat(total)], "head": [rows["head"].iloc[0]], "tail": [rows["tail"].iloc[-1]], "illegal": [illegal]})

    def divide(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["hi", "lo"])
        ways: list = [None] * 4
        ways[int(rows["before"].iloc[0])] = (0, "", ())
        for m in rows["m"]:
            to: list = [None] * 4
            for i, row in enumerate(_square(m)):
                for j, e in enumerate(row):
                    if ways[i] is not None and e is not None:
                        made = (ways[i][0] + e[0], ways[i][1] + e[1], (*ways[i][2], j))
                        if to[j] is None or made[:2] < to[j][:2]:
                            to[j] = made
            ways = to
        path = ways[int(rows["after"].iloc[0])][2]
        return pd.DataFrame({"c": rows["c"], "hi": rows["hi"], "lo": rows["lo"], "before": [int(rows["before"].iloc[0]), *path[:-1]], "after": list(path)})

    level = chunks.select("c", F.col("p").cast("long").alias("hi"), F.col("k").cast("long").alias("lo"), "m", "head", "tail", "illegal")
    below: list[DataFrame] = []
    while True:
        top = level.agg(F.max("hi"), F.max("lo")).first()
        if not top[0] and not top[1]:
            break
        up = F.shiftright("lo", FAN_BITS) if top[1] else F.lit(0).cast("long")
        over = F.col("hi") if top[1] else F.shiftright("hi", FAN_BITS)
        level = level.withColumns({"ghi": over, "glo": up})
        below.append(level)
        level = materialize(level.groupBy("c", "ghi", "glo").applyInPandas(combine, f"c string, hi bigint, lo bigint, {spec}"), "level")

    def last(m: Column) -> Column:
        """The state of the better of the two endings."""
        a, b = m[START * 4 + START], m[START * 4 + ASSISTANT]
        return F.when(b.isNull() | (a.isNotNull() & (a < b)), START).otherwise(ASSISTANT)

    totals = level.select("c", "m", "illegal")
    states = level.select("c", "hi", "lo", F.lit(START).cast("long").alias("before"), last(F.col("m")).cast("long").alias("after"))
    for children in reversed(below):
        given = states.select("c", F.col("hi").alias("ghi"), F.col("lo").alias("glo"), "before", "after")
        states = materialize(
            children.join(given, ["c", "ghi", "glo"]).groupBy("c", "ghi", "glo").applyInPandas(divide, "c string, hi bigint, lo bigint, before bigint, after bigint"), "states"
        )
    return totals, states


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repaired, summary) of turns (c key, turn, role, text, n copies).

    repaired: c, p, k, j (its place: chunk, then row), edit, times, turn, role, text, with the deleted rows.
    summary: c, gaps, blank, duplicate, truncated, illegal, cost, audit, for conversations with rows.
    """
    leaves = chunks_of(with_faults(turns))
    counts = leaves.groupBy("c", "turn").agg(
        F.sum(F.when(F.col("fault") == "blank", F.col("n")).otherwise(0)).alias("blank"),
        # the first of equal rows may be blank, its repetitions are then blank too; else they are duplicates
        F.sum(F.when(F.col("fault") == "duplicate", F.col("n")).when(F.col("fault") == "blank", 0).otherwise(F.col("n") - 1)).alias("duplicate"),
        F.sum(F.when(F.col("fault") == "truncated", 1).otherwise(0)).alias("truncated"),
    )
    counts = counts.groupBy("c").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"),
        *[F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated")],
    )
    chunks = leaves.where("m IS NOT NULL").select("c", "p", "k", "m", "head", "tail", "illegal")
    many = materialize(chunks.groupBy("c").agg(F.count(F.lit(1)).alias("chunks")).where("chunks > 1").select("c"), "many")
    totals, states = _tree(materialize(chunks.join(many, "c", "left_semi"), "parts"))
    a, b = F.col("m")[START * 4 + START], F.col("m")[START * 4 + ASSISTANT]
    best = F.when(b.isNull() | (a < b), a).otherwise(b)
    single = chunks.join(many, "c", "left_anti")
    whole = single.select("c", "m", "illegal").unionByName(totals).select("c", "illegal", best.alias("e"))
    summary = counts.join(whole.select("c", "illegal", "e.cost", "e.audit"), "c")

    ends = single.select("c", "p", "k", F.lit(START).alias("before"), F.when(b.isNull() | (a < b), START).otherwise(ASSISTANT).alias("after"), "m").unionByName(
        chunks.join(states.select("c", F.col("hi").cast("int").alias("p"), F.col("lo").cast("int").alias("k"), "before", "after"), ["c", "p", "k"]).select("c", "p", "k", "before", "after", "m")
    )
    piece = F.element_at("m", (F.col("before") * 4 + F.col("after") + 1).cast("int"))
    plans = ends.select("c", "p", "k", F.lit(-1).alias("i"), F.col("before").cast("int").alias("state"), piece["audit"].alias("audit"))
    rows = leaves.select("c", "p", "k", "i", "turn", "role", "text", "n").unionByName(plans, allowMissingColumns=True)
    schema = "c string, p int, k int, j int, edit string, times bigint, turn bigint, role string, text string"
    names, types = ["c", "p", "k", "j", "edit", "times", "turn", "role", "text"], [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[tuple] = []
        key, state, audit = None, START, ""
        made: list[tuple] = []
        held = 0

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made, strict=True), types, strict=True)], names)

        for batch in batches:
            for c, p, k, i, turn, role, text, n, s, e in zip(*(batch.column(x).to_pylist() for x in ("c", "p", "k", "i", "turn", "role", "text", "n", "state", "audit")), strict=True):
                if i < 0:
                    if key is not None:
                        made += [(*key, j, *x) for j, x in enumerate(replay(state, audit, own))]
                        held += sum(len(r[2]) for r in own)
                        if len(made) >= CHUNK or held >= CHUNK_BYTES:
                            yield batch_of()
                            made, held = [], 0
                    key, state, audit = (c, p, k), s, e
                    own = []
                else:
                    own.append((turn, role, text, n))
        if key is not None:
            made += [(*key, j, *x) for j, x in enumerate(replay(state, audit, own))]
        if made:
            yield batch_of()

    parts = max(1, int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    repaired = rows.repartition(parts, "c", "p", "k").sortWithinPartitions("c", "p", "k", "i").mapInArrow(run, schema)
    return repaired, summary


def digest(repaired: DataFrame) -> DataFrame:
    """(c, repaired_sha256) of the turns that stay, as ``role:text`` lines.

    The hash reads a conversation's bytes one after the other by definition, so one task streams them, in constant memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h = None, None
        done: list[tuple[str, str]] = []
        for batch in batches:
            for c, role, text in zip(*(batch.column(x).to_pylist() for x in ("c", "role", "text")), strict=True):
                line = f"{role}:{text}".encode()
                if c == key:
                    h.update(b"\n" + line)
                else:
                    if h:
                        done.append((key, h.hexdigest()))
                    key, h = c, hashlib.sha256(line)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*done, strict=True)], ["c", "repaired_sha256"])
                done = []
        if h:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([h.hexdigest()])], ["c", "repaired_sha256"])

    parts = max(1, int(repaired.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kept = repaired.where("edit <> 'D'").select("c", "p", "k", "j", "role", "text")
    return kept.repartition(parts, "c").sortWithinPartitions("c", "p", "k", "j").select("c", "role", "text").mapInArrow(run, "c string, repaired_sha256 string")


def damage(conversations: DataFrame) -> DataFrame:
    """(c, turn, role, text, n) of the conversations' rows after the contract's damage."""
    text_of = lambda x: F.coalesce(x.cast("string"), F.lit(" "))
    lot = F.crc32(F.concat(text_of(F.col("conv_id")), F.lit(":"), text_of(F.col("turn"))).cast("binary")) % 20
    role, text = text_of(F.col("role")), text_of(F.col("text"))
    return conversations.select(
        conversation_key(F.col("conv_id")).alias("c"),
        F.col("turn").try_cast("long").alias("turn"),
        F.when(lot == 4, "user").otherwise(role).alias("role"),
        F.when(lot == 1, "").when(lot == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(lot == 3, 2).otherwise(1).cast("long").alias("n"),
        lot.alias("lot"),
    ).where("lot <> 0").drop("lot")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    repaired, summary = repair(damage(given))
    out = given.select("conv_id").distinct().withColumn("c", conversation_key(F.col("conv_id"))).join(summary, "c", "left").join(digest(repaired), "c", "left")
    zero = [F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
