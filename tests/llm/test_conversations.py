"""Conversation repair against a plain search over all edits, with chunks of a few rows and without."""

import hashlib
import random
import re
import zlib

import pytest

from tallyworks.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string"
GOOD = re.compile(r"(s?(ua)+)?")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        role, text, lot = show(role), show(text), zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
        role = "user" if lot == 4 else role
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(lot, 1)
    return out


def brute(rows):
    """The contract's row for the damaged rows of one conversation, by a search over whole edit strings."""
    order = lambda r: (r[1] is not None, r[1] or 0, r[2][:32], r[3][:64], hashlib.sha256(f"{r[2]}\0{r[3]}".encode()).hexdigest())
    rows = sorted(rows, key=order)
    turns = [r[1] for r in rows if r[1] is not None]
    faults, seen = [], set()
    for _, _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    initials = [r[2][:1] for r in rows]
    # ways: (cost, audit) by what is repaired so far; what is repaired is cut to its last initial, and whether it began
    ways = {"": (0, "", [])}

    def better(to, key, made):
        if key not in to or made[:2] < to[key][:2]:
            to[key] = made

    def insert(ways):
        for _ in range(3):
            for key, (cost, audit, lines) in list(ways.items()):
                role = "assistant" if key == "u" else "user"
                better(ways, role[0], (cost + 2, audit + "I", [*lines, f"{role}:"]))
        return ways

    insert(ways)
    for (_, _, role, text), fault in zip(rows, faults, strict=True):
        to = {}
        for key, (cost, audit, lines) in ways.items():
            better(to, key, (cost + 3, audit + "D", lines))
            if fault not in ("blank", "duplicate"):
                more = int(fault == "truncated")
                new = "assistant" if key == "u" else "user"
                better(to, new[0], (cost + 2 + more, audit + "R", [*lines, f"{new}:{text}"]))
                if role and key + role[:1] in ("s", "u", "su", "ua", "au"):
                    better(to, role[:1], (cost + more, audit + "K", [*lines, f"{role}:{text}"]))
        ways = insert(to)
    cost, audit, lines = min(w for k, w in ways.items() if k in ("", "a"))
    assert GOOD.fullmatch("".join(x[:1] for x in lines))
    count = lambda f: faults.count(f)
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "blank": count("blank"), "duplicate": count("duplicate"), "truncated": count("truncated"),
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), "cost": cost, "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


def run(spark, tmp_path, rows, extra=""):
    df = spark.createDataFrame(rows, SCHEMA)
    for c in extra.split():
        df = df.withColumn(c, df["role"])
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    return cr.op13_conversation_repair(spark, str(tmp_path)).collect()


def check(got, rows):
    want = {c: brute([r for r in damaged(rows) if r[0] == c]) for c in {r[0] for r in rows}}
    assert len(got) == len(want)
    for r in got:
        assert {k: r[k] for k in want[r["conv_id"]]} == want[r["conv_id"]], r


def made(seed, convs, most):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "cut off", "  ", "", "Is it?", None, "Well. \n", "é ", "多 🙂。", "a.", "a!"]
    rows = []
    for conv in convs:
        for _ in range(rng.randint(1, most)):
            rows.append((conv, rng.choice([None, *range(most)]), rng.choice(["user", "assistant", "system", "", None, "tool", "assistant", "user"]), rng.choice(texts)))
    return rows


@pytest.mark.parametrize("chunk", [1_000, 2])
def test_against_search(spark, tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(cr, "CHUNK", chunk)
    monkeypatch.setattr(cr, "FAN_BITS", 6 if chunk > 2 else 1)
    rows = made(chunk, [*range(40), None], 14)
    check(run(spark, tmp_path, rows, "c p k m n h fault"), rows)


def test_one_conversation_holds_most_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cr, "CHUNK", 16)
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant"]), rng.choice(["One.", f"Answer {t}.", f"Open {t}"])) for t in range(1_500)]
    rows += [(7, 3, "user", "again.")] * 300 + made(3, range(8, 14), 6)
    check(run(spark, tmp_path, rows), rows)
    chunks = cr.chunks_of(cr.with_faults(cr.damage(spark.createDataFrame(rows, SCHEMA))))
    assert chunks.where("c = '=7'").select("p").distinct().count() > 1 and chunks.agg({"i": "max"}).first()[0] < 16


def test_long_text_and_empty_table(spark, tmp_path):
    rows = [(1, 1, "user", "word " * 400_000 + "end."), (1, 2, "assistant", "x" * 3_000_000), (1, 3, "user", "y.")]
    check(run(spark, tmp_path / "a", rows), rows)
    assert run(spark, tmp_path / "b", []) == []


def test_product_is_associative():
    rng = random.Random(1)
    for _ in range(200):
        ms = [cr.turn_matrix(rng.choice("suax"), rng.choice([None, "blank", "truncated", "duplicate"]), rng.choice([1, 1, 3])) for _ in range(3)]
        assert cr.times(cr.times(ms[0], ms[1]), ms[2]) == cr.times(ms[0], cr.times(ms[1], ms[2]))
