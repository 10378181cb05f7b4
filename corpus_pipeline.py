"""A training corpus from documents: language ID, line dedup, near-dedup, substring dedup, packing.

STAGES are (name, function) pairs; a function takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and read again as the next one's
docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brightwater.llm import langid
from brightwater.llm.common import Scratch, release, table
from brightwater.llm.linededup import line_dedup
from brightwater.llm.minhash import near_duplicates
from brightwater.llm.packing import pack
from brightwater.llm.queries import TOKENIZER
from brightwater.llm.substring import substring_dedup


#: How much likelier a text must be as single letters than in any language, in nats, to be rejected.
NO_LANGUAGE = 5.0


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _held(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the other columns as one struct, so that none can clash with what a stage adds."""
    rest = [F.col(_quoted(c)).alias(f"c{k}") for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*rest, F.lit(0).alias("none")).alias("_rest"))


def _like(docs: DataFrame, done: DataFrame, **given: Column) -> DataFrame:
    """The columns of docs in their order, from done's _rest; given: columns with a new value, if docs has them."""
    kinds = dict(docs.dtypes)
    out = {c: F.col(c) if c in ("doc_id", "text") else F.col(f"_rest.c{k}") for k, c in enumerate(docs.columns)}
    return done.select(*[given.get(c, out[c]).cast(kinds[c]).alias(c) if c in given else out[c].alias(c) for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that are no language go; the others have the language that they are in as their lang.

    A document is rejected if its text is null, empty or without a letter, or likelier
    as single letters drawn from all languages than in any learned one by e**NO_LANGUAGE
    (keys, tokens, base64).  Learned from a bounded sample of rows with a lang.  Where
    nothing has a lang nothing is learned, and only texts without a letter go.  Null
    ids stay; rows that repeat are judged each; other columns pass through, whatever
    their names; an empty table gives an empty one.
    """
    held = _held(docs)
    if "lang" not in docs.columns:
        held = held.withColumn("lang", F.lit(None).cast("string"))
    else:
        held = held.withColumn("lang", F.col(f"_rest.c{docs.columns.index('lang')}"))
    model = langid.fit(held, F.lit(True), TOKENIZER("piece_bpe_32k.model"))
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = langid.identify(held, model, keep=("text", "_rest"), margin=True)
    found = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("margin") > -NO_LANGUAGE))
    return _like(docs, found, lang=F.col("lang_pred"))


def remove_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and documents of which nothing is left; n_chars is counted anew.

    Of equal three-line windows the first, by id and place, stands.  Null texts go,
    empty ones stay.  A null id sorts last; rows with one id and text have one
    result.  Other columns pass through; an empty table gives an empty one.
    """
    done = line_dedup(_held(docs), keep=("_rest",)).where("text is not null and (n_removed = 0 or n_removed < n_lines)")
    return _like(docs, done, n_chars=F.length("text"))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at 0.8 or more on five-word shingles, the one with the smallest id stays.

    Texts that are null or without words link with nothing and stay, as do null ids.
    Rows that repeat an id stay or go together: they go if each of their texts is
    linked to a smaller id.  Other columns pass through; an empty table gives an
    empty one.
    """
    found = near_duplicates(_held(docs))
    gone = found.groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept").select("doc_id")
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*[F.col(_quoted(c)) for c in docs.columns])


def remove_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that start in an earlier document go, and documents of which no word is left; n_chars is counted anew.

    Null text is empty, and stays.  A null id counts as larger than every other; rows
    with one id remove nothing from each other.  Other columns pass through; an empty
    table gives an empty one.
    """
    done = substring_dedup(_held(docs), batch_bytes=4 << 20, keep=("_rest",)).where("n_removed = 0 or n_removed < n_words")
    return _like(docs, done, n_chars=F.length("text"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: one row per piece, (doc_id, piece, start, length, ids_crc32, sequence_id, offset, part_bins, part_bound).

    Null and empty texts are one id, 0.  A null id stays null; rows that repeat are
    packed each; other columns are not read; an empty table gives an empty one.
    """
    return pack(docs, TOKENIZER("byte_bpe_50k.json"), TOKENIZER("byte_bpe_50k.tiktoken"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", remove_lines),
    ("near_dedup", remove_near_duplicates),
    ("substring_dedup", remove_passages),
    ("packing", pack_sequences),
]

#: Language ID and packing have no SQL; tests/llm/test_stages.py holds each stage against a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; the last stage's rows."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return done
        docs = scratch.put(name, done)
        if k:
            scratch.drop(STAGES[k - 1][0])
        release(spark)
    return docs
