"""Toxicity scores: a lexicon trie intersected with Levenshtein automata, and context windows.

The lexicon is learned from labelled rows: words, and stems that begin words, that
stand in toxic texts and hardly in others.  A term of a text matches an entry
exactly or within the edits that the entry's length allows.  The automaton of the
whole lexicon is made deterministic as words are read.  Windows around each match
tell quotation (quotation marks, words about words) from use, and use aimed at
someone; a logistic model over the counts gives the score.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship
from .textkernel import lean, slices

_WORD = re.compile(r"\w+")
_CACHE = 300_000
#: States of the automaton that are kept.
_STATES = 30_000
_STEMS = (4, 5, 6, 7, 8)
#: Words that speak of a word, or report speech, in the languages of the tables (fixed values).
_ABOUT = frozenset(
    "word words term terms called calling said says saying quote quoted quotes wrote written means meaning definition defined example insult insults slur slurs phrase "
    "wort wörter begriff sagte sagt schrieb bedeutet zitat zitiert beleidigung mot mots terme dit écrit signifie citation insulte palabra palabras término dijo escribió significa cita insulto".split()
)
#: Pronouns of address (fixed values).
_ADDRESS = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi vous votre tú ti usted vosotros".split())
_OPENING, _CLOSING, _PLAIN_QUOTES = "“«„‹", "”»‟›", "\"`"
_MARKS = re.compile(f"[\n{_OPENING}{_CLOSING}{_PLAIN_QUOTES}]")
FEATURES = 7
#: Edits that the longest entries allow.
MOST = 2


def allowed(term: str) -> int:
    """Edits that a word of the lexicon allows: none below 5 letters, one below 9, then two."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else MOST


class Lexicon:
    """Entries (term, stem): a stem matches words that begin with it."""

    def __init__(self, entries: list[tuple[str, bool]]):
        self.entries = sorted(entries)
        self.children: list[dict[str, int]] = [{}]
        self.word_edits: list[int] = [-1]  # edits allowed to an entry that ends here
        self.stem_edits: list[int] = [-1]
        for term, stem in self.entries:
            node = 0
            for c in term:
                if c not in self.children[node]:
                    self.children.append({}), self.word_edits.append(-1), self.stem_edits.append(-1)
                    self.children[node][c] = len(self.children) - 1
                node = self.children[node][c]
            if stem:
                self.stem_edits[node] = 1 if len(term) >= 7 else 0
            else:
                self.word_edits[node] = allowed(term)
        self._forget()

    def _forget(self) -> None:
        """Begin the automaton anew."""
        self._states: dict[frozenset, int] = {}
        self._sets: list[frozenset] = []
        self._step: list[dict[str, int]] = []
        self._word: list[int] = []  # fewest edits of an entry that ends in the state, or 9
        self._stem: list[int] = []
        self.start = self._state({(0, 0)})

    def _state(self, places: set[tuple[int, int]]) -> int:
        """The state of these (node, edits), with what dropping characters of an entry adds."""
        best: dict[int, int] = {}
        waiting = list(places)
        while waiting:
            node, e = waiting.pop()
            if e < best.get(node, 9):
                best[node] = e
                if e < MOST:
                    waiting += [(child, e + 1) for child in self.children[node].values()]
        key = frozenset(best.items())
        if key not in self._states:
            self._states[key] = len(self._sets)
            self._sets.append(key)
            self._step.append({})
            self._word.append(min((e for n, e in key if self.word_edits[n] >= e), default=9))
            self._stem.append(min((e for n, e in key if self.stem_edits[n] >= e), default=9))
        return self._states[key]

    def _next(self, state: int, c: str) -> int:
        to = set()
        for node, e in self._sets[state]:
            child = self.children[node].get(c)
            if child is not None:
                to.add((child, e))
            if e < MOST:
                to.add((node, e + 1))
                to.update((other, e + 1) for other in self.children[node].values())
        found = self._state(to) if to else -1
        if len(self._step[state]) < 5000:
            self._step[state][c] = found
        return found

    def edits(self, word: str) -> int:
        """Fewest edits to an entry that matches: 0 to MOST, or 9 if none does."""
        if len(self._sets) > _STATES:
            self._forget()
        state, stem = self.start, 9
        for c in word:
            step = self._step[state].get(c)
            state = self._next(state, c) if step is None else step
            if state < 0:
                return stem
            if self._stem[state] < stem:
                stem = self._stem[state]
                if stem == 0:
                    return 0
        return min(stem, self._word[state])


class _Codes(dict):
    """0 for words that match nothing, 1 exact, 2 misspelled."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> int:
        if len(self) >= _CACHE:
            self.clear()
        edits = self.lexicon.edits(word)
        code = 0 if edits == 9 else 1 if edits == 0 else 2
        if len(word) <= 64:
            self[word] = code
        return code


def quotations(text: str) -> list[tuple[int, int]]:
    """Spans between quotation marks that open and close in one line, in order of their ends."""
    spans, opened = [], {}
    for found in _MARKS.finditer(text):
        mark, at = found[0], found.start()
        if mark == "\n":
            opened.clear()
        elif mark in _PLAIN_QUOTES:
            if mark in opened:
                spans.append((opened.pop(mark), at))
            else:
                opened[mark] = at
        elif mark in _OPENING:
            opened[mark] = at
        else:
            start = opened.pop(_OPENING[_CLOSING.index(mark)], None)
            if start is not None:
                spans.append((start, at))
    return spans


class _Inside:
    """Whether a place lies in any of some spans."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts, self.reach = [], []
        for start, end in sorted(spans):
            self.starts.append(start)
            self.reach.append(max(end, self.reach[-1] if self.reach else 0))

    def __call__(self, start: int, end: int) -> bool:
        at = bisect.bisect_left(self.starts, start) - 1
        return at >= 0 and self.reach[at] >= end


def features(text: str, codes: _Codes) -> list[float] | None:
    """Features of a text, or None if nothing matches."""
    lowered = text.lower()
    words = _WORD.findall(lowered)
    if not any(map(codes.__getitem__, set(words)) if len(words) < 50 else map(codes.__getitem__, words)):
        return None
    spans = list(_WORD.finditer(lowered))
    quoted_at = _Inside(quotations(text if len(lowered) == len(text) else lowered))
    exact = fuzzy = quoted = aimed = 0
    for i, word in enumerate(words):
        code = codes[word]
        if not code:
            continue
        near = words[max(0, i - 6) : i] + words[i + 1 : i + 7]
        a, b = spans[i].span()
        if quoted_at(a, b) or not _ABOUT.isdisjoint(near):
            quoted += 1
            continue
        if code == 1:
            exact += 1
        else:
            fuzzy += 1
        if not _ADDRESS.isdisjoint(near[max(0, len(near) - 10) :]):
            aimed += 1
    return [1.0, float(exact > 0), float(fuzzy > 0), math.log1p(exact), math.log1p(fuzzy), math.log1p(quoted), math.log1p(aimed)]


@lean
def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and stems of each text, once, with the word before their first place."""
    for batch in batches:
        found: Counter = Counter()
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            seen: dict[tuple[str, bool], str] = {}
            last = ""
            for word in _WORD.findall((text or "").lower()):
                if (word, False) not in seen:
                    seen[word, False] = last
                    for n in _STEMS:
                        if len(word) > n:
                            seen.setdefault((word[:n], True), last)
                last = word
            for (term, stem), before in seen.items():
                found[term, stem, toxic, before if toxic else ""] += 1
        keys = list(found)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([k[2] for k in keys], pa.int32()), pa.array([k[3] for k in keys], pa.string()), pa.array(list(found.values()), pa.int64())], names=["term", "stem", "toxic", "before", "n"])


def _featured(entries):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes(Lexicon(entries))
        for batch in batches:
            rows = [features(t or "", codes) or [1.0] + [0.0] * (FEATURES - 1) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], names=["f", "toxic"])

    return run


class ToxicityModel:
    def __init__(self, entries: list[tuple[str, bool]], weights: np.ndarray):
        self.entries, self.weights = entries, weights


def fit(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows_per_class: int = 4000, largest: int = 2000, penalty: float = 0.05) -> ToxicityModel:
    """Learn from at most rows_per_class labelled rows of each class (a documented bound), chosen by a hash of the id.

    train: condition on the labels' rows.  Null labels and ids are left out.  The
    lexicon holds at most `largest` entries, those with the most support.
    """
    ship(docs.sparkSession)
    known = labels.where(train & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("toxic")).distinct()
    by = [F.xxhash64("i"), F.col("i")]
    picked = known.where("toxic = 1").orderBy(*by).limit(rows_per_class).unionAll(known.where("toxic = 0").orderBy(*by).limit(rows_per_class))
    # two limits bound the broadcast side
    sample = docs.select(F.col(id_col), F.col(text_col).alias("text")).join(F.broadcast(picked), F.col(id_col) == F.col("i")).select("text", "toxic").distinct().cache()
    try:
        sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        bad, good = sizes.get(1, 0), sizes.get(0, 0)
        if not bad:
            return ToxicityModel([], np.array([-math.log(good + 1.0)] + [0.0] * (FEATURES - 1)))
        # support is in different words before the term, so that copies of one text count once
        terms = sample.mapInArrow(_terms, "term string, stem boolean, toxic int, before string, n long").groupBy("term", "stem", "toxic", "before").agg(F.sum("n").alias("n"))
        terms = terms.groupBy("term", "stem").agg(F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum("toxic").alias("support"))
        least = max(4.0, 0.005 * bad)
        odds = (F.col("bad") / bad) / ((F.col("good") + 0.5) / (good + 1.0))
        chosen = terms.where((F.col("support") >= least) & (odds >= 20)).orderBy(F.desc("support"), "term", "stem").limit(largest).collect()
        stems: set[str] = set()
        for row in sorted((r for r in chosen if r["stem"]), key=lambda r: len(r["term"])):
            if not any(row["term"].startswith(s) for s in stems):
                stems.add(row["term"])
        words = {r["term"] for r in chosen if not r["stem"]}
        # a stem that only one word of the lexicon bears adds nothing to the word, but takes in strangers
        solo = {s for s in stems for w in words if w.startswith(s) and 2 * next(r["bad"] for r in chosen if r["term"] == w and not r["stem"]) > next(r["bad"] for r in chosen if r["term"] == s and r["stem"])}
        stems -= solo
        entries = [(w, False) for w in words] + [(s, True) for s in stems]
        rows = sample.select("text", "toxic").mapInArrow(_featured(entries), "f array<double>, toxic int").toPandas()
    finally:
        sample.unpersist()
    x, y = np.array(rows["f"].tolist()), rows["toxic"].to_numpy(np.float64)
    return ToxicityModel(sorted(entries), _logistic(x, y, penalty))


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float) -> np.ndarray:
    """Newton steps for a logistic model with a ridge on all but the constant."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[0] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _scorer(shared):
    @lean
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        codes = _Codes(Lexicon(model.entries))
        base = float(model.weights[0])
        for batch in batches:
            for a, b in slices(batch.column(1)):
                z = np.full(b - a, base)
                for i, text in enumerate(batch.column(1).slice(a, b - a).to_pylist()):
                    found = features(text, codes) if text else None
                    if found:
                        z[i] = float(np.dot(found, model.weights))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=["id", "score"])

    return score


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, score), the chance that the text is toxic.

    Null and empty texts get the score of a text without matches.  Null ids are
    kept; repeated rows are scored each; an empty table gives an empty result.
    Whole texts, of any length; other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded by the lexicon's size
    kind = dict(docs.dtypes)[id_col]
    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_scorer(shared), "id long, score double")
    return out.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)
