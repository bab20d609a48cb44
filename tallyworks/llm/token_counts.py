"""Token counts under a unigram model by dynamic programming on a shared trie.

The model gives a public rank file's token of rank r the log score -ln(r + 2),
so texts split into few, frequent tokens; all 256 bytes are tokens, so every
text has a split. Distinct pre-tokens are inserted, byte by byte, in a trie. A
node keeps the best forward score of the bytes on its path and the tokens of
that best split; both follow from its ancestors, so a prefix that many words
share is scored once. The node where a word ends keeps its token count.

Among splits of equal score the one with fewer tokens counts.

Edge cases: null and empty texts have 0 tokens; pre-tokens of any length are
scored whole (the trie holds their first DEPTH bytes; from there on only the
scores that a token can still reach back to are kept, in bounded memory); repeated rows each give a row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .bpe import public_vocabulary, read_ranks
from .common import table, worker_cache

#: Trie nodes that a worker keeps at a time; the trie starts anew beyond it (counts don't change).
NODES = 1_000_000
#: Bytes of a pre-token that the trie holds; what follows is scored on without nodes (counts don't change).
DEPTH = 4_096
#: Scores are integers (millionths), so equal splits compare equal on every machine.
UNIT = 1_000_000


def scores(raw: bytes) -> dict[bytes, int]:
    return {token: -round(UNIT * math.log(rank + 2)) for token, rank in read_ranks(raw).items()}


class ForwardTrie:
    def __init__(self, raw: bytes, pattern: str):
        self.score = scores(raw)
        self.longest = max(map(len, self.score))
        self.split = regex.compile(pattern).findall
        self.clear()

    def clear(self) -> None:
        self.children: list[dict[int, int]] = [{}]
        self.best = [0]  # forward score of the path to the node
        self.tokens = [0]  # tokens of that best split
        self.terminal: dict[str, int] = {}  # word -> tokens, stored where it ends

    def count(self, word: str) -> int:
        """Tokens of one pre-token; only nodes that aren't there yet are scored."""
        data = word.encode("utf-8", "replace")
        if len(self.best) > NODES:
            self.clear()
        children, best, tokens, score, longest = self.children, self.best, self.tokens, self.score, self.longest
        path, node = [0], 0
        for end, byte in enumerate(data[:DEPTH], 1):
            nxt = children[node].get(byte)
            if nxt is None:
                top, few = None, 0
                for start in range(max(0, end - longest), end):
                    s = score.get(data[start:end])
                    if s is not None:
                        s += best[path[start]]
                        t = tokens[path[start]] + 1
                        if top is None or s > top or s == top and t < few:
                            top, few = s, t
                nxt = len(best)
                children[node][byte] = nxt
                children.append({})
                best.append(top)
                tokens.append(few)
            node = nxt
            path.append(node)
        if len(data) > DEPTH:
            return self.further(data, [(best[n], tokens[n]) for n in path[-longest:]])
        self.terminal[word] = tokens[node]
        return tokens[node]

    def further(self, data: bytes, reached: list[tuple[int, int]]) -> int:
        """Tokens of a word longer than the trie is deep; reached: score and tokens at the last positions up to DEPTH."""
        score, recent = self.score, deque(reached, maxlen=self.longest)
        for end in range(DEPTH + 1, len(data) + 1):
            top, few = None, 0
            for start, (sum_, count) in enumerate(recent, end - len(recent)):
                s = score.get(data[start:end])
                if s is not None:
                    s += sum_
                    if top is None or s > top or s == top and count + 1 < few:
                        top, few = s, count + 1
            recent.append((top, few))
        return recent[-1][1]

    def document(self, text: str | None) -> tuple[int, int]:
        """(pre-tokens, tokens) of a whole text."""
        words = self.split(text or "")
        total, known, count = 0, self.terminal, self.count
        for word in words:
            n = known.get(word)
            total += count(word) if n is None else n
        return len(words), total


def trie(raw: bytes, pattern: str) -> ForwardTrie:
    made = worker_cache("token_counts")
    key = (hashlib.sha256(raw).hexdigest(), pattern)
    if key not in made:
        made[key] = ForwardTrie(raw, pattern)
    return made[key]


def count_tokens(df: DataFrame, vocabulary: tuple[bytes, str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_pretokens, n_tokens) of every row."""
    sent = df.sparkSession.sparkContext.broadcast(vocabulary)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forward = trie(*sent.value)
        for batch in batches:
            found = [forward.document(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())],
                [key, "n_pretokens", "n_tokens"],
            )

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_pretokens long, n_tokens long")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_vocabulary())
