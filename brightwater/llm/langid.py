"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.  A
word's probability is the sum over all its segmentations, by the forward
algorithm; a text's is the product over its words.  The probabilities are fitted
by expectation-maximisation over the same lattices on a bounded sample.  A text's
margin holds its best language against a background in which letters are drawn one
by one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship
from .textkernel import lean, slices, trim

_WORD = re.compile(r"[^\W\d_]+")
_CACHE = 100_000
#: Words whose lattices are worked through together.
_AT_ONCE = 4000
UNKNOWN = "und"


def _words(text: str | None) -> list[str]:
    """Runs of letters in lower case."""
    return _WORD.findall(text.lower()) if text else []


@lean
def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: Counter = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for word, n in Counter(_words(text)).items():
                found[lang, word] += n
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "word", "n"])


class PieceModel:
    """Weights of pieces by language, and of single letters in all; pickles small."""

    def __init__(self, path: str, langs: list[str], weight: np.ndarray, prior: np.ndarray, background: np.ndarray):
        self.path, self.langs, self.weight, self.prior, self.background = path, langs, weight, prior, background


def fit(docs: DataFrame, train, vocabulary_path: str, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", docs_per_language: int = 300, iterations: int = 3, smoothing: float = 0.1) -> PieceModel:
    """Fit on about docs_per_language rows of each language (a documented bound), chosen by a hash of the id.

    train: condition for rows to learn from; rows with null language, text or id are
    left out.  A first pass counts each language's rows, so that only about twice
    the bound of them meet to be ranked, however many there are.  Rows that repeat a
    chosen id and language are all taken: with ids that repeat, the sample can
    exceed the bound by as many.
    """
    from .lattice import vocabulary, word_codes

    ship(docs.sparkSession)
    labelled = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    # a hash below the share that leaves twice the bound, 16 standard deviations and all of the rare languages
    share = labelled.groupBy(F.col(lang_col).alias("l")).agg(((2 * docs_per_language + 400) / F.count("*")).alias("share"))
    draw = F.pmod(F.xxhash64(F.lit(41), id_col), F.lit(1 << 30)) / float(1 << 30)
    drawn = labelled.select(id_col, lang_col).join(F.broadcast(share), F.col(lang_col) == F.col("l")).where(draw < F.col("share")).select(id_col, lang_col)  # a row a language
    rank = F.row_number().over(Window.partitionBy(lang_col).orderBy(F.xxhash64(id_col), id_col))
    chosen = drawn.withColumn("r", rank).where(F.col("r") <= docs_per_language).select(F.col(id_col).alias("i"), F.col(lang_col).alias("l"))
    # as many rows as the bound allows for each language
    sample = labelled.join(F.broadcast(chosen), (F.col(id_col) == F.col("i")) & (F.col(lang_col) == F.col("l")), "left_semi").select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    rows = sample.mapInArrow(_counter, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toPandas()
    pieces = vocabulary(vocabulary_path)
    langs = sorted(rows["lang"].unique())
    weight = np.full((pieces.size + 1, len(langs)), 1.0 / (pieces.size + 1))
    for k, lang in enumerate(langs):
        own = rows[rows["lang"] == lang].sort_values("word")
        counts = own["n"].to_numpy(np.float64)
        lattice = pieces.lattice(*word_codes([" " + w for w in own["word"]]))
        for _ in range(iterations):
            _, share = lattice.forward(weight[:, k : k + 1], shares=True)
            uses = lattice.expected(share, counts, pieces.size + 1) + smoothing
            weight[:, k] = uses / uses.sum()
    words = rows.groupby("word", sort=True)["n"].sum()
    codes, lengths = word_codes([" " + w for w in words.index])
    counts = np.bincount(pieces.letters(codes), np.repeat(words.to_numpy(np.float64), lengths), pieces.size + 1).astype(np.float64)
    counts[pieces.letters(np.array(pieces.single))] += smoothing
    counts[-1] += smoothing
    trim()
    return PieceModel(vocabulary_path, langs, weight, np.full(len(langs), -np.log(max(1, len(langs)))), counts / counts.sum())


class _Scores(dict):
    """log probability of a word in each language, by row number of a table."""

    def __init__(self, model: PieceModel, margin: bool):
        super().__init__()
        from .lattice import vocabulary

        self.weight, self.pieces = np.column_stack([model.weight, model.background]) if margin else model.weight, vocabulary(model.path)
        self.width = self.weight.shape[1]
        self.table = np.empty((_CACHE, self.width))

    def learn(self, words: list[str]) -> np.ndarray:
        from .lattice import word_codes

        return self.pieces.lattice(*word_codes([" " + w for w in words])).forward(self.weight)[0]


def _predictor(shared, margin: bool, shown: list[int]):
    """shown: which input columns go on."""

    @lean
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scores = _Scores(model, margin)
        n_langs = len(model.langs)
        names = np.array([*model.langs, UNKNOWN], dtype=object)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                texts = [_words(t) for t in batch.column(1).slice(a, b - a).to_pylist()]
                if not model.langs:
                    pred, best, above = np.zeros(b - a, np.int64), np.zeros(b - a), np.zeros(b - a)
                else:
                    fresh = list({w for words in texts for w in words} - scores.keys())
                    if len(scores) + len(fresh) > _CACHE:
                        scores.clear()
                        fresh = list({w for words in texts for w in words})
                    # a slice with more distinct words than the cache holds gets a table of its own
                    table = scores.table if len(scores) + len(fresh) <= _CACHE else np.empty((len(fresh), scores.width))
                    at = len(scores)
                    for k in range(0, len(fresh), _AT_ONCE):
                        part = fresh[k : k + _AT_ONCE]
                        table[at + k : at + k + len(part)] = scores.learn(part)
                    scores.update(zip(fresh, range(at, at + len(fresh)), strict=True))
                    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
                    index = np.fromiter((scores[w] for words in texts for w in words), np.int64, int(sizes.sum()))
                    total = np.zeros((len(texts), scores.width))
                    full = np.flatnonzero(sizes)
                    if len(full):
                        total[full] = np.add.reduceat(table[index], (np.cumsum(sizes) - sizes)[full], axis=0)
                    above = total[:, :n_langs].max(axis=1) - total[:, -1] if margin else np.zeros(b - a)
                    total = total[:, :n_langs] + model.prior
                    total -= total.max(axis=1, keepdims=True)
                    chance = np.exp(total)
                    chance /= chance.sum(axis=1, keepdims=True)
                    pred, best = chance.argmax(axis=1), chance.max(axis=1)
                    none = sizes == 0
                    pred[none], best[none] = len(model.langs), 0.0
                    if table is not scores.table:
                        scores.clear()
                yield pa.RecordBatch.from_arrays([pa.array(names[pred], pa.string()), pa.array(best), pa.array(above), *(batch.column(k).slice(a, b - a) for k in [0, *shown])], names=["lang_pred", "score", "margin", "id", *[f"_k{i}" for i in range(len(shown))]])

    return predict


def identify(docs: DataFrame, model: PieceModel, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), margin: bool = False) -> DataFrame:
    """One row per input row: (id, lang_pred, score, *keep), or with margin (id, lang_pred, score, margin, *keep).

    keep: columns of the input to pass through.
    score is the probability of the predicted language given the text.  margin is
    how far the best language's log probability is above that of single letters
    drawn from all languages: far below 0 the text is no language at all, and near 0
    it is too short to tell.  Null text and text without a letter: `und`, 0 and 0.  With nothing learned
    every text is `und`.  Null ids are kept; repeated rows are scored each; an empty
    table gives an empty result.  Whole texts count, of any length; other columns
    are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # vocabulary size x languages
    kind = dict(docs.dtypes)[id_col]
    # numbered names inside, so that no column of the input can clash; the text goes to Python once, also where it is kept
    held = [F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep) if c != text_col]
    shown = [1 if c == text_col else 2 + sum(x != text_col for x in keep[:i]) for i, c in enumerate(keep)]
    shape = T.StructType.fromDDL(f"lang_pred string, score double, margin double, id {kind}")
    for i, c in enumerate(keep):
        shape = shape.add(f"_k{i}", docs.schema[c].dataType)
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *held).mapInArrow(_predictor(shared, margin, shown), shape)
    return out.select(F.col("id").alias(id_col), "lang_pred", "score", *(["margin"] if margin else []), *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)])


def bucket(id_col: str, n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n
