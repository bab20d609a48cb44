import hashlib

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyworks.llm import bpe, token_counts


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.public_vocabulary()


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=vocabulary[1], mergeable_ranks=bpe.read_ranks(vocabulary[0]), special_tokens={})


TEXTS = ["", None, "Hello, world's  end\n\n x", "中文 ñandú\u00a0é 123456", "a" * 3000, "\x00\ud7ff", " " * 50 + "x", "<|endoftext|>", "ab" * 700 + "!" * 33]


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_ids_of_any_text(text):
    v = bpe.public_vocabulary()
    coder = bpe.coder(*v)
    lib = tiktoken.Encoding("own", pat_str=v[1], mergeable_ranks=coder.ranks, special_tokens={})
    ids = coder.encode(text)
    assert ids == lib.encode_ordinary(text) and coder.decode(ids) == text.encode("utf-8", "replace")


def test_merge_against_the_plain_loop(vocabulary):
    ranks = bpe.read_ranks(vocabulary[0])
    for piece in (b" therapeutically", b"aaaaaaa", b"\xe4\xb8\xad\xe6\x96\x87", b"xyzzyxyzzy", b"q"):
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            pairs = [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
            if not pairs:
                break
            _, k = min(pairs)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        assert bpe.merge(piece, ranks) == [ranks[p] for p in parts]


def test_tables_keep_ids(vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    coder = bpe.ByteBPE(*vocabulary)
    text = " one two three four five one two three four five one"
    assert coder.encode(text) == bpe.ByteBPE(*vocabulary).encode(text) and len(coder.known) <= 3


def test_digests_and_columns(docs, vocabulary, library):
    df = docs(*TEXTS, (None, "x"), (3, "x"), (3, "x"))
    got = {(r["doc_id"], r["ids_sha256"]): r for r in bpe.digests(df, vocabulary).collect()}
    for k, t in enumerate(TEXTS):
        ids = library.encode_ordinary(t or "")
        r = got[k, hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()]
        assert r["n_tokens"] == len(ids) and r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    clash = df.withColumnRenamed("lang", "ids").withColumnRenamed("source", "decoded")
    out = bpe.encode_documents(clash, vocabulary, check=True)
    assert out.columns == ["doc_id", "text", "decoded", "n_chars", "ids", "n_tokens", "round_trip"] and out.where("not round_trip").isEmpty() and out.count() == len(TEXTS) + 3
    assert bpe.decode_ids(out, vocabulary).where("decode(decoded, 'utf-8') <> coalesce(text, '')").isEmpty()
    assert bpe.digests(df.limit(0), vocabulary).count() == 0


def brute_tokens(word, score):
    """(score, tokens) of the best split: highest score, then fewest tokens."""
    data = word.encode()
    best = [(0, 0)]
    for end in range(1, len(data) + 1):
        best.append(max((best[s][0] + score[data[s:end]], best[s][1] - 1) for s in range(end) if data[s:end] in score))
    return -best[-1][1]


def test_counts_against_brute_force(docs, vocabulary, monkeypatch):
    score = token_counts.scores(vocabulary[0])
    forward = token_counts.ForwardTrie(*vocabulary)
    text = "The theory thereof, unbelievably: antidisestablishmentarianism ñandúes 中文字 123456 éé the the"
    words = forward.split(text)
    assert [forward.count(w) for w in words] == [brute_tokens(w, score) for w in words]
    nodes = len(forward.best)
    assert forward.document(text) == (len(words), sum(brute_tokens(w, score) for w in words)) and len(forward.best) == nodes  # nothing is scored twice
    monkeypatch.setattr(token_counts, "NODES", 5)
    tight = token_counts.ForwardTrie(*vocabulary)
    assert [tight.count(w) for w in words] == [brute_tokens(w, score) for w in words]
    got = {r["doc_id"]: (r["n_pretokens"], r["n_tokens"]) for r in token_counts.count_tokens(docs(text, None, "", text), vocabulary).collect()}
    assert got[0] == got[3] == (len(words), sum(brute_tokens(w, score) for w in words)) and got[1] == got[2] == (0, 0)
    assert token_counts.count_tokens(docs().limit(0) if False else docs("x").limit(0), vocabulary).count() == 0


def test_long_pretokens_keep_the_trie_small(vocabulary, monkeypatch):
    score = token_counts.scores(vocabulary[0])
    words = ["a" * 700, "abcde" * 90, "unbelievably" * 20, "é" * 150, "x"]
    want = [brute_tokens(w, score) for w in words]
    monkeypatch.setattr(token_counts, "DEPTH", 37)
    forward = token_counts.ForwardTrie(*vocabulary)
    assert [forward.count(w) for w in words] == want == [forward.count(w) for w in words]
    assert len(forward.best) <= 37 * len(words) + 1 and set(forward.terminal) == {"x"}
    assert forward.document(" ".join(words))[1] == sum(forward.count(w) for w in forward.split(" ".join(words)))


def test_every_byte_has_a_split(vocabulary):
    score = token_counts.scores(vocabulary[0])
    assert all(bytes([b]) in score for b in range(256))


def test_queries(spark, small):
    n = spark.read.parquet(f"{small}/documents.parquet").count()
    assert bpe.op4_byte_bpe(spark, small).count() == n and token_counts.op10_token_counts(spark, small).where("n_tokens < n_pretokens").isEmpty()
