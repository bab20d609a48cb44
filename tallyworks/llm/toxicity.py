"""Toxicity scores: a lexicon learned from labels, fuzzy matches, context windows.

Fitting reads a bounded sample of labelled training rows (``SAMPLE``), never
rows of the held-out fold:

1. Lexicon: words whose document frequency among toxic rows, short quotations
   left out, is far above that among clean rows (log likelihood ratio, odds).
   Beginnings that many such words share are terms too ("stem*": any ending).
2. Levenshtein automata of all terms are intersected with the trie of the
   lexicon: a state is the set of (trie node, edits so far) that a prefix can
   reach; states are made when first met and then cost one lookup a letter. A
   stem's node accepts whatever follows. Every term of 4 letters or more allows one
   edit, of 12 or more two, however rare it is. What an edit is worth is learned
   for each length: half of the clean rows tell which words are words of their
   own, the other half how often such matches still occur in clean rows.
3. Each match gets a score from its context window (words on either side, and
   whether quotation marks surround it), so that quoting a term counts less
   than using it; window weights are learned too.
4. A logistic model over sums of the match scores gives the document's score.

Scripts without blanks (Chinese, Japanese, Thai and others) are read as the
overlapping pairs of their letters.

Edge cases: null, empty and wordless texts have no matches and get the model's
score for none; without labels of both kinds the model scores 0 everywhere;
repeated rows get equal scores; null ids count as held out by their (empty)
id's checksum; extra columns are ignored.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, held_out, labelled_sample, table, worker_cache

#: Most labelled training rows that the model is fitted on.
SAMPLE = 10_000
#: Words on each side of a match.
WINDOW = 4
#: Word verdicts that a worker remembers at a time.
REMEMBERED = 50_000
#: States of an automaton that a worker holds at a time.
STATES = 50_000
#: Toxic rows, and share of them, that must hold a term, and least smoothed log odds of a term.
LEAST_ROWS, LEAST_SHARE, LEAST_ODDS = 4, 0.006, 4.2
#: Strength of a match inside quotation marks; share of a term's strength that one edit leaves before any is seen, and rows that outweigh that guess.
QUOTED, EDITED, GUESS = 0.25, 0.7, 10
QUOTES = "\"'“”„‟«»‹›‘’「」"
#: Different neighbours that make half of a term's rows needless.
ENOUGH_CONTEXTS = 20
#: Letters that a stem can have.
STEMS = (4, 5, 6, 7)
#: Short quotations, which say little about who uses a word.
QUOTED_SPAN = regex.compile(r"[\"“„«「][^\"”»」\n]{1,60}[\"”“»」]")
#: Letters of scripts without blanks.
UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]+")
EDGE = regex.compile(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$")


def fold(raw: str) -> str:
    """A raw token without what is neither letter nor digit at its ends, in lower case."""
    return EDGE.sub("", raw).lower()


class LexiconAutomaton:
    """All words within the allowed edits of a lexicon term."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.child: list[dict[str, int]] = [{}]
        self.term_at: list[int] = [-1]
        self.stem_at: list[int] = [-1]
        for k, term in enumerate(terms):
            node = 0
            for c in term.removesuffix("*"):
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.term_at.append(-1)
                    self.stem_at.append(-1)
                node = self.child[node][c]
            # a stem, written with a star, takes any word that begins with it
            (self.stem_at if term.endswith("*") else self.term_at)[node] = k
        self.reach = [0] * len(self.child)  # most edits that any term below a node allows
        for node in range(len(self.child) - 1, -1, -1):
            own = self.edits(self.terms[self.term_at[node]]) if self.term_at[node] >= 0 else 0
            self.reach[node] = max([own, *(self.reach[x] for x in self.child[node].values())])
        self._start()

    def edits(self, term: str) -> int:
        return 0 if len(term) < 4 else 1 if len(term) < 12 else 2

    def _start(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.sets: list[tuple[frozenset, int]] = []
        self.next: list[dict[str, int]] = []
        self.accepts: list[tuple[int, int] | None] = []
        self.stems: list[int] = []
        self.dead = self._state({}, -1)
        self.root = self._state(self._closed({0: 0}), self.stem_at[0])

    def _closed(self, at: dict[int, int]) -> dict[int, int]:
        """With the letters of terms that the word leaves out."""
        todo = list(at.items())
        while todo:
            node, e = todo.pop()
            if at.get(node, 99) < e:
                continue
            for x in self.child[node].values():
                if e + 1 <= self.reach[x] and at.get(x, 99) > e + 1:
                    at[x] = e + 1
                    todo.append((x, e + 1))
        return at

    def _state(self, at: dict[int, int], stem: int) -> int:
        """The state of these nodes, below the accepting subtree of a stem (-1: none)."""
        key = frozenset([*at.items(), (-1, stem)])
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append((frozenset(at.items()), stem))
            self.next.append({})
            ends = [(e, self.term_at[n]) for n, e in at.items() if self.term_at[n] >= 0 and e <= self.edits(self.terms[self.term_at[n]])]
            best = min(ends, default=None)
            self.accepts.append((0, stem) if stem >= 0 and (best is None or best[0]) else best)
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        at: dict[int, int] = {}

        def put(node: int, e: int) -> None:
            if e <= self.reach[node] and at.get(node, 99) > e:
                at[node] = e

        nodes, stem = self.sets[state]
        for node, e in nodes:
            put(node, e + 1)  # a letter too many
            for x, n in self.child[node].items():
                put(n, e if x == c else e + 1)
                if x == c and not e and stem < 0:
                    stem = self.stem_at[n]
        to = self._state(self._closed(at), stem)
        self.next[state][c] = to
        return to

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, term number) of the nearest term, or None; a stem stands behind an exact term, ties go to the term listed first."""
        if len(self.sets) > STATES:
            self._start()
        state, dead = self.root, self.dead
        for c in word:
            to = self.next[state].get(c)
            state = self._step(state, c) if to is None else to
            if state == dead:
                return None
        return self.accepts[state]


def words_of(text: str | None) -> list[str]:
    """What white space leaves of a text; runs of a script without blanks as their overlapping pairs."""
    text = text or ""
    if text.isascii() or not UNSPACED.search(text):
        return text.split()
    pairs = lambda m: " " + " ".join(m[0][i : i + 2] for i in range(max(1, len(m[0]) - 1))) + " "
    return UNSPACED.sub(pairs, text).split()


def shortest(word: str) -> int:
    """Letters that a term of this script has at least."""
    return 2 if UNSPACED.match(word) else 3


def learn_stems(rows: list[tuple[str | None, int]], toxic: Counter, clean: Counter, n: list[int]) -> dict[str, float]:
    """Beginnings of words that many different words of toxic rows share and clean rows hardly use: stem -> log odds.

    A stem of ``STEMS`` letters is made as long as it can be without losing a row; clean rows are counted at most too high.
    """
    own = {w for w in toxic if not clean[w]}
    words: dict[str, set[str]] = {}
    rows_of: Counter = Counter()
    for text, y in rows:
        if y:
            found = own.intersection(map(fold, words_of(QUOTED_SPAN.sub(" ", text or ""))))
            rows_of.update({w[:k] for w in found for k in STEMS if len(w) > k})
            for w in found:
                for k in STEMS:
                    if len(w) > k:
                        words.setdefault(w[:k], set()).add(w)
    # a stem speaks for endings that weren't seen, so its most frequent word (a term by itself) says nothing for it
    for p, own in words.items():
        rows_of[p] -= max(toxic[w] for w in own)
    likely = {p for p, a in rows_of.items() if a >= max(LEAST_ROWS, LEAST_SHARE * n[1]) and len(words[p]) >= 3}
    against: Counter = Counter()
    for w, b in clean.items():
        for k in STEMS:
            if w[:k] in likely:
                against[w[:k]] += b
    odds = {p: math.log((rows_of[p] + 0.5) / (n[1] - rows_of[p] + 1)) - math.log((against[p] + 0.5) / (max(n[0] - against[p], 0) + 1)) for p in sorted(likely)}
    good = {p for p, o in odds.items() if o > LEAST_ODDS}
    out = {}
    for p in sorted(good, key=lambda q: (len(q), q)):
        if any(p[:k] in out for k in STEMS if k < len(p)):
            continue
        while longer := [q for q in sorted(good) if len(q) == len(p) + 1 and q.startswith(p) and words[q] == words[p]]:
            p = longer[0]
        out[p] = odds[p]
    return out


def learn_terms(rows: list[tuple[str | None, int]]) -> tuple[list[str], list[float], Counter, Counter]:
    """(terms, weights, words' toxic rows, words' clean rows), best terms first."""
    by = (Counter(), Counter())
    n = [0, 0]
    for text, y in rows:
        n[y] += 1
        by[y].update({w for raw in set(words_of(QUOTED_SPAN.sub(" ", text or ""))) if (w := fold(raw))})
    if not all(n):
        return [], [], by[1], by[0]
    found = []
    for w, a in by[1].items():
        b = by[0][w]
        if a < max(LEAST_ROWS, LEAST_SHARE * n[1]) or len(w) < shortest(w):
            continue
        odds = math.log((a + 0.5) / (n[1] - a + 1)) - math.log((b + 0.5) / (n[0] - b + 1))
        share = (a + b) / (n[0] + n[1])
        g2 = 2 * (a * math.log(a / (n[1] * share)) + (b * math.log(b / (n[0] * share)) if b else 0))
        if odds > LEAST_ODDS and g2 > 10:
            found.append((-g2, w, odds))
    # copies of one text repeat a word between the same neighbours, users of a word don't
    near: dict[str, set[tuple[str, str]]] = {w: set() for _, w, _ in found}
    for text, y in rows:
        if y:
            words, seen = [fold(raw) for raw in words_of(QUOTED_SPAN.sub(" ", text or ""))], set()
            for i, w in enumerate(words):
                if w in near and w not in seen:
                    seen.add(w)
                    near[w].add((words[i - 1] if i else "", words[i + 1] if i + 1 < len(words) else ""))
    apart = lambda w: len(near[w]) >= max(LEAST_ROWS, min(0.5 * by[1][w], ENOUGH_CONTEXTS))
    found = sorted(x for x in found if apart(x[1]))
    stems = learn_stems(rows, by[1], by[0], n)
    return [w for _, w, _ in found] + [f"{p}*" for p in stems], [o for _, _, o in found] + list(stems.values()), by[1], by[0]


class ToxicityModel:
    """Plain data that travels to the tasks: terms, weights, clean neighbours, context weights, logistic weights."""

    def __init__(self, rows: list[tuple[str | None, int]]):
        self.id = uuid.uuid4().hex
        self.terms, self.weights, toxic, clean = learn_terms(rows)
        self.constant = not self.terms
        self.weight = dict(zip(self.terms, self.weights, strict=True))
        self.worth: dict[tuple[int, int], float] = {}
        self.context: dict[str, float] = {}
        self.beta = np.zeros(1)
        self.clean: set[str] = set()
        if self.constant:
            return
        auto = self.automaton()
        # every word of the sample that is near a term, once
        near = {w: m for w in {*toxic, *clean} if len(w) >= shortest(w) and (m := auto.match(w))}
        self._edits(rows, near)
        n1, n0 = sum(y for _, y in rows), sum(1 - y for _, y in rows)
        self.clean = self._own_words(toxic, clean, n1, n0, near)
        known: dict[str, tuple[int, int] | None] = {}
        self._context(rows, auto, known)
        x = np.array([self.features(text, auto, known) for text, _ in rows])
        y = np.array([float(v) for _, v in rows])
        self.beta = logistic(x, y, 0.1)

    def automaton(self) -> LexiconAutomaton:
        return LexiconAutomaton(self.terms)

    def _own_words(self, toxic: Counter, clean: Counter, n1: int, n0: int, near: dict[str, tuple[int, int]]) -> set[str]:
        """Words near a term that clean rows use as well as toxic ones."""
        return {w for w, m in near.items() if m[0] and clean[w] and (toxic[w] + 0.5) / n1 < 4 * (clean[w] + 0.5) / n0}

    def _edits(self, rows: list[tuple[str | None, int]], near: dict[str, tuple[int, int]]) -> None:
        """What an edit of a term of each length is worth: rows of one half with a near word that the other half doesn't know as a word of its own.

        Only rows without any term as it is count, so that a toxic row's other words don't speak for the edit.
        """
        halves = [[], []]
        for text, y in rows:  # copies of a text fall in one half
            halves[zlib.crc32((text or "").encode("utf-8", "replace")) % 2].append((near.keys() & {fold(raw) for raw in words_of(text)}, y))
        seen = (Counter(), Counter())
        n = [0, 0]
        for k in (0, 1):
            by = (Counter(), Counter())
            for words, y in halves[1 - k]:
                by[y].update(words)
            n1, n0 = (max(1, sum(y == v for _, y in halves[1 - k])) for v in (1, 0))
            known = self._own_words(by[1], by[0], n1, n0, near)
            for words, y in halves[k]:
                found = [near[w] for w in words if w not in known]
                if all(e for e, _ in found):
                    n[y] += 1
                    seen[y].update({self._class(t, e) for e, t in found})
        for c in set(seen[0]) | set(seen[1]):
            a, b = seen[1][c], seen[0][c]
            odds = math.log((a + 0.5) / (n[1] + 1)) - math.log((b + 0.5) / (n[0] + 1))
            usual = sum(self.weights) / len(self.weights)
            share = max(0.0, min(1.0, odds / usual))
            self.worth[c] = ((a + b) * share + GUESS * EDITED ** c[1]) / (a + b + GUESS)

    def _class(self, term: int, edits: int) -> tuple[int, int]:
        return min(12, len(self.terms[term])), edits

    def _context(self, rows: list[tuple[str | None, int]], auto: LexiconAutomaton, known: dict) -> None:
        """Log odds of the words around matches, toxic rows against clean ones; shrunk towards 0."""
        near = (Counter(), Counter())
        for text, y in rows:
            words = words_of(text)
            at = [i for i, *_ in self.spans(text, auto, known)]
            near[y].update({fold(x) for i in at for x in words[max(0, i - WINDOW) : i] + words[i + 1 : i + 1 + WINDOW]})
        n = [sum(c.values()) + 1 for c in near]
        self.context = {
            w: max(-1.0, min(1.0, v))
            for w in set(near[0]) | set(near[1])
            if near[0][w] + near[1][w] >= 20
            and abs(v := math.log((near[1][w] + 10) / (n[1] + 10)) - math.log((near[0][w] + 10) / (n[0] + 10))) > 0.3
        }

    def match(self, word: str, auto: LexiconAutomaton) -> tuple[int, int] | None:
        """(edits, term number), or None; words known from clean rows match only exactly."""
        if len(word) < shortest(word):
            return None
        found = auto.match(word)
        return None if found and found[0] and word in self.clean else found

    def spans(self, text: str | None, auto: LexiconAutomaton, known: dict[str, tuple[int, int] | None] | None = None) -> list[tuple[int, str, int, bool, float]]:
        """(word position, term, edits, quoted, context score) of each match in a text."""
        known = {} if known is None else known
        words = words_of(text)
        hits = []
        for i, raw in enumerate(words):
            if raw in known:
                m = known[raw]
            else:
                if len(known) > REMEMBERED:
                    known.clear()
                m = known[raw] = self.match(fold(raw), auto)
            if m:
                hits.append((i, m))
        out = []
        for i, (edits, term) in hits:
            around = words[max(0, i - WINDOW) : i] + words[i + 1 : i + 1 + WINDOW]
            opened = any(x[0] in QUOTES for x in words[max(0, i - WINDOW) : i + 1])
            closed = any(x.rstrip(".,;:!?")[-1:] in QUOTES and x.rstrip(".,;:!?") for x in words[i : i + 1 + WINDOW])
            score = sum(self.context.get(fold(x), 0.0) for x in around) if self.context else 0.0
            out.append((i, self.terms[term], edits, bool(opened and closed), score))
        return out

    def features(self, text: str | None, auto: LexiconAutomaton, known: dict | None = None) -> list[float]:
        strength = context = 0.0
        for _, term, edits, quoted, near in self.spans(text, auto, known):
            worth = self.worth.get((min(12, len(term)), edits), EDITED**edits) if edits else 1.0
            strength += self.weight[term] * worth * (QUOTED if quoted else 1.0)
            context += 0.0 if quoted else near * worth
        return [math.log1p(strength), max(-2.0, min(2.0, context))]

    def score(self, text: str | None, auto: LexiconAutomaton, known: dict) -> float:
        if self.constant:
            return 0.0
        z = self.beta[0] + float(np.array(self.features(text, auto, known)) @ self.beta[1:])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (constant first) by Newton's steps with a ridge on all but the constant."""
    x = np.hstack([np.ones((len(x), 1)), x])
    beta = np.zeros(x.shape[1])
    keep = np.diag([1e-9, *[ridge] * (x.shape[1] - 1)])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = SAMPLE) -> ToxicityModel:
    """A model from at most about ``bound`` labelled training rows, gathered on the driver."""
    rows = labelled_sample(docs, labels, label, bound).select("text", "label").toLocalIterator()
    return ToxicityModel([(text, int(y > 0)) for text, y in rows])


def _automaton(model: ToxicityModel) -> tuple[LexiconAutomaton, dict]:
    """The automaton with the states met so far and the words judged so far, kept by a Python worker between tasks."""
    held = worker_cache("toxicity")
    if held.get("id") != model.id:
        held.clear()
        held.update(id=model.id, auto=model.automaton(), known={})
    return held["auto"], held["known"]


def score_documents(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` with score double and hits array<struct<at, term, edits, quoted, context>>; columns of these names are replaced."""
    keep = [c for c in docs.columns if c not in ("score", "hits")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    hit = pa.list_(pa.struct([("at", pa.int32()), ("term", pa.string()), ("edits", pa.int32()), ("quoted", pa.bool_()), ("context", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        auto, known = _automaton(m)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            score = [m.score(x, auto, known) for x in texts]
            hits = [[dict(zip(("at", "term", "edits", "quoted", "context"), h, strict=True)) for h in m.spans(x, auto, known)] for x in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64()), pa.array(hits, hit)], [*batch.schema.names, "score", "hits"])

    return docs.select(*keep).mapInArrow(run, f"{schema}, score double, hits array<struct<at: int, term: string, edits: int, quoted: boolean, context: double>>")


def scores(docs: DataFrame, model: ToxicityModel, carry: list[str], out: str = "score") -> DataFrame:
    """The carried columns (but for one named like the result) and the score, in one pass over the texts."""
    keep = [c for c in carry if c != out]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        auto, known = _automaton(m)
        for batch in batches:
            score = [m.score(x.as_py(), auto, known) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(score, pa.float64())], [*keep, out])

    # a text that is carried isn't sent twice
    at = keep.index("text") if "text" in keep else len(keep)
    sent_rows = docs.select(*keep) if "text" in keep else docs.select(*keep, F.col("text").alias(free_name("_scored", keep)))
    return sent_rows.mapInArrow(run, f"{schema}, `{out}` double")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scores(docs, fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
