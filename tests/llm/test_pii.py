"""Personal data against a plain search: the contract's patterns by re, disclosure by counting in Python."""

import hashlib
import math
import random
import re
from collections import defaultdict

import pytest
import regex

from tallyworks.llm import pii

BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]
WORD = regex.compile(r"(?<![\p{L}\p{M}])\p{L}[\p{L}\p{M}]{2,}+")


def holds(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        total = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind != "phone" or 8 <= len(digits) <= 15


def base(text):
    return [(kind, m.start(), m.end()) for kind, p in BASE for m in re.finditer(p, text or "") if holds(kind, m[0])]


def near(text):
    """(entity, word) pairs: whole words within CONTEXT characters of a value, up to the next match of its kind."""
    out = set()
    cut = lambda s: {w.lower() for w in WORD.findall(re.sub(r"\S*@\S*", " ", s))}
    for kind, p in BASE:
        found = list(re.finditer(p, text))
        for k, m in enumerate(found):
            if not holds(kind, m[0]):
                continue
            name = (kind, m[0].lower() if kind == "email" else m[0] if kind == "ip" else re.sub("[^0-9]", "", m[0]))
            before = text[found[k - 1].end() if k else 0 : m.start()]
            after = text[m.end() : found[k + 1].start() if k + 1 < len(found) else len(text)]
            n = pii.CONTEXT
            before = regex.sub(r"^[\p{L}\p{M}]+", "", before[-n:]) if len(before) > n else before
            after = regex.sub(r"[\p{L}\p{M}]+$", "", after[:n]) if len(after) > n else after
            out |= {(name, w) for w in cut(before) | cut(after)}
    return out


def disclosing(rows):
    docs = sorted({(i, t or "") for i, t in rows}, key=repr)
    pairs, texts, entities, held = defaultdict(int), defaultdict(set), defaultdict(int), defaultdict(int)
    for _, t in docs:
        own = near(t)
        for p in own:
            pairs[p] += 1
            texts[p].add(t)
        names = set()
        for kind, s, e in base(t):
            names.add((kind, t[s:e].lower() if kind == "email" else t[s:e] if kind == "ip" else re.sub("[^0-9]", "", t[s:e])))
        for c in names:
            entities[c] += 1
        for w in {w.lower() for w in WORD.findall(t)}:
            held[w] += 1
    out = defaultdict(float)
    for (c, w), n in pairs.items():
        ic = math.log2(len(docs) / entities[c])
        if len(texts[c, w]) >= pii.SUPPORT and ic > 0 and 1 + math.log2(n / held[w]) / ic >= pii.GENERALISE:
            out[w] = max(out[w], 1 + math.log2(n / held[w]) / ic)
    return out


def brute(rows):
    terms = disclosing(rows)
    out = []
    for i, t in rows:
        own = base(t)
        more = [("term", m.start(), m.end()) for m in WORD.finditer(t or "") if m[0].lower() in terms and not any(s < m.end() and e > m.start() for _, s, e in own)]
        show = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        counts = [sum(k == name for k, _, _ in own) for name, _ in BASE]
        out.append((i, *counts, hashlib.sha256(show(own).encode()).hexdigest(), show(own + more)))
    return sorted(out, key=repr), terms


def run(spark, tmp_path, docs, rows, extra=""):
    df = docs(*rows)
    for c in extra.split():
        df = df.withColumn(c, df["source"])
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return sorted(map(tuple, pii.op11_pii(spark, str(tmp_path)).collect()), key=repr)


EDGE = [
    None, "", "a@b.c_d@e.f x@y a@b.c.d.. +a.b%c@d-e.f-g", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.4 1.2.3 10.0.0.255. 1..2.3.4", "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111",
    "49927398716 4111 1111  1111 1111 - 6011000990139424 00000000000000000000 0000000000000000000", "+1 (377) 555-0271 +123 +12345678 +1 23 456 789 012 345 678 ++4 (0) 30 123456",
    "é🙂 a@b.cd ünï+49 30 123456 🙂 9.9.9.9 çé", "a" * 2_000 + "@", "1" * 2_000, "1.1." * 500, "x@" + "a." * 500 + "b ", "+" + "1 " * 1_000, "@" * 1000 + "a@b.c", "+1.2.3.4 5555 a@1.2.3.4",
]


def test_patterns(spark, tmp_path, docs):
    rows = [(k, t) for k, t in enumerate(EDGE)] + [(3, EDGE[3]), (None, EDGE[3])]
    assert run(spark, tmp_path, docs, rows, "d h kind i gap t") == brute(rows)[0]


def test_long_texts_cost_linear_time(spark, tmp_path, docs):
    """A plain search takes the square of these lengths, so their spans are stated."""
    n = 1_000_000
    rows = [(0, "a" * n + "@"), (1, "1" * n), (2, "x@" + "a." * n + "b "), (3, "+" + "1 " * n), (4, "word " * n + "a@b.c"), (5, ("é" * 40 + " 1.2.3.4 ") * 20_000)]
    got = {r[0]: r for r in run(spark, tmp_path, docs, rows)}
    assert [got[k][6] for k in (0, 1, 3)] == ["", "", ""] and got[2][6] == f"email:0:{2 * n + 3}" and got[4][6] == f"email:{5 * n}:{5 * n + 5}"
    assert got[5][2] == 20_000 and got[5][6].endswith(f"ip:{20_000 * 49 - 8}:{20_000 * 49 - 1}")


def made():
    rng = random.Random(4)
    common = ["the", "and", "over", "Quelle", "über", "letter", "was", "sent", "today"]
    rows = []
    for k in range(160):
        words = rng.choices(common, k=rng.randint(5, 60))
        who = k % 40
        if who < 6:
            words[2:2] = [f"Person{'abcdef'[who]}son", f"p{who}@mail.org", rng.choice(common)] if k % 2 else ["zürich" + "xyzuvw"[who], "+49 30 12345" + str(who) * 2]
        rows.append((k, " ".join(words) + rng.choice([".", ".\n", ""])))
    rows += [(500 + k, "Copies say Onlyhere near q@mail.org now.") for k in range(30)]
    rows += [(1_000 + k, f"Filler without any value, {k}.") for k in range(400)]
    rows += [(600, "Personbson wrote Personbson. personbSON?"), (601, "x.personbson@mail.org personbsonx")]
    return rows


def test_disclosure(spark, tmp_path, docs):
    rows = made()
    want, terms = brute(rows)
    assert "personbson" in terms and "letter" not in terms and "onlyhere" not in terms
    assert run(spark, tmp_path, docs, rows) == want


def test_shuffled_joins_agree(spark, tmp_path, docs, monkeypatch):
    monkeypatch.setattr(pii, "BROADCAST", 0)
    rows = made()
    assert run(spark, tmp_path, docs, rows) == brute(rows)[0]


def test_given_documents(spark, small):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, pii.op11_pii(spark, small).collect()), key=repr) == brute(rows)[0]


def test_sanitised_texts(spark, docs):
    rows = made() + [(700, "Card 4111 1111 1111 1111, a@1.2.3.4 end"), (701, None), (702, "plain")]
    df = docs(*rows)
    got = {r["doc_id"]: r for r in pii.sanitise(df.withColumn("runs", df["lang"])).collect()}
    assert got[700]["text"] == "Card [CARD], [EMAIL] end" and got[701]["text"] is None and got[702]["text"] == "plain" and got[1]["runs"] == "en"
    terms = disclosing(rows)
    for i, t in rows:
        if t:
            own = base(t)
            spans = sorted([(s, e, f"[{k.upper()}]") for k, s, e in own] + [
                (m.start(), m.end(), "" if terms[m[0].lower()] >= pii.REMOVE else "[TERM]") for m in WORD.finditer(t) if m[0].lower() in terms and not any(s < m.end() and e > m.start() for _, s, e in own)
            ])
            out, at = "", 0
            for s, e, mark in spans:
                if s >= at:
                    out, at = out + t[at:s] + mark, e
            assert got[i]["text"] == out + t[at:], i


def test_native(spark, small):
    plan = pii.op11_pii(spark, small)._jdf.queryExecution().executedPlan().toString()
    docs = spark.read.parquet(f"{small}/documents.parquet")
    plan += pii.base_matches(pii._keyed(docs, "doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty_table(spark, tmp_path, docs):
    assert run(spark, tmp_path, docs, []) == []


@pytest.mark.parametrize("digits", ["4111111111111111", "4111111111111112", "6011000990139424", "0000000000000000000", "1234567890123456789"])
def test_luhn(values, digits):
    assert values(pii._luhn, [digits]) == [holds("card", digits)]
