"""The thin queries opN_<name> over the synthetic tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, piecesample, toxicity
from .common import table
from .embeddings import near_vectors
from .licenses import scan_licenses
from .linededup import line_dedup
from .minhash import near_duplicates
from .packing import pack
from .substring import substring_dedup
from .topk import exact_topk

#: Folder of the public tokenizers' files; a parameter of the operators that use them.
TOKENIZER = public_tokenizers.path

_SPACE = r"[\x20\x09-\x0D]+"


def joined_words(text: str):
    """The words of a text, joined by one space."""
    return F.regexp_replace(F.regexp_replace(text, _SPACE, " "), "^ | $", "")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), TOKENIZER("byte_bpe_50k.json"), TOKENIZER("byte_bpe_50k.tiktoken"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP2_SQL = """
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
w AS (SELECT doc_id, i, l[i] || chr(10) || l[i + 1] || chr(10) || l[i + 2] AS k
      FROM d, unnest(range(1, len(l) - 1)) AS t(i)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS rn FROM w) WHERE rn > 1),
c AS (SELECT DISTINCT doc_id, i + j AS p FROM r, range(0, 3) AS t(j)),
lines AS (SELECT doc_id, p, l[p] AS line FROM d, unnest(range(1, len(l) + 1)) AS t(p)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY p) AS s
         FROM lines ANTI JOIN c USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(l), 0) - coalesce(n, 0) AS BIGINT) AS n_removed,
       CASE WHEN l IS NOT NULL THEN sha256(coalesce(s, '')) END AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""


def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.93)


OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
n AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS s FROM v),
e AS (SELECT a.vec_id AS u, b.vec_id AS w FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE a.s > 0 AND b.s > 0 AND list_inner_product(a.e, b.e) / (a.s * b.s) >= 0.93),
r AS (SELECT vec_id AS u, vec_id AS w FROM embeddings UNION SELECT r.u, e.w FROM r JOIN e ON r.w = e.u),
c AS (SELECT u, min(w) AS m FROM r GROUP BY u),
k AS (SELECT u, count(*) AS n FROM e GROUP BY u)
SELECT t.vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, m AS component_id, m = t.vec_id AS kept
FROM embeddings t JOIN c ON c.u = t.vec_id LEFT JOIN k ON k.u = t.vec_id
"""


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, langid.bucket("doc_id", 4) != 2, TOKENIZER("piece_bpe_32k.model"))
    found = langid.identify(docs, model)
    return found.select("doc_id", (langid.bucket("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), langid.bucket("doc_id", 5) != 0)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (langid.bucket("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(joined_words("text"), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, i, sha256(array_to_string(ws[i:i + 12], ' ')) AS k
        FROM d, unnest(range(1, len(ws) - 11)) AS t(i)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS m FROM win) WHERE m < doc_id),
c AS (SELECT DISTINCT doc_id, i + j AS p FROM f, range(0, 13) AS t(j)),
words AS (SELECT doc_id, p, ws[p] AS w FROM d, unnest(range(1, len(ws) + 1)) AS t(p)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY p) AS s
         FROM words ANTI JOIN c USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op10_sample_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = TOKENIZER("piece_bpe_32k.model")
    coded = piecesample.encode(table(spark, sf_dir, "documents"), model, keep=("text",))
    both = piecesample.decode(coded, model)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.sha2(piecesample.ids_text("ids"), 256).alias("ids_sha256"), F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), numerator=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, sha256(array_to_string(ws[i:i + 4], ' ')) AS k FROM d, unnest(range(1, greatest(len(ws) - 3, 2))) AS t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS u, doc_id AS v FROM d UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u),
c AS (SELECT u, min(v) AS m FROM r GROUP BY u)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m AS component_id, m = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.u = d.doc_id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pack": op1_pack,
    "op2_line_dedup": op2_line_dedup,
    "op3_near_vectors": op3_near_vectors,
    "op4_langid": op4_langid,
    "op5_toxicity": op5_toxicity,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_topk": op7_topk,
    "op8_licenses": op8_licenses,
    "op9_minhash": op9_minhash,
    "op10_sample_pieces": op10_sample_pieces,
}

ORACLE_SQL: dict[str, str] = {
    "op2_line_dedup": OP2_SQL,
    "op3_near_vectors": OP3_SQL,
    "op7_topk": OP7_SQL,
    "op6_substring_dedup": OP6_SQL,
    "op9_minhash": OP9_SQL,
}
