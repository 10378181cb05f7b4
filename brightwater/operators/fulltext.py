"""Full text: tokenizers, a query grammar, highlights, and a postings index in files."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch

BUCKETS = 64


def tokenize(text: Column, kind: str = "default") -> Column:
    """Tokens of a text: default (lower-cased letters and digits, at most 40 characters), raw, simple, whitespace, ngram (2 and 3)."""
    if kind == "default":
        return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda t: F.length(t) <= 40)
    if kind == "simple":
        return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    if kind == "whitespace":
        return F.filter(F.split(text, r"\s+"), lambda t: t != "")
    if kind == "raw":
        return F.array(text)
    if kind == "ngram":
        places = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
        gram = lambda i, n: F.when(i + (n - 1) <= F.length(text), F.substr(text, i, F.lit(n)))
        return F.flatten(F.transform(places, lambda i: F.filter(F.array(gram(i, 2), gram(i, 3)), lambda g: g.isNotNull())))
    raise ValueError(f"no tokenizer {kind}")


def parse(query: str) -> tuple:
    """A query as a tree: ("term", t), ("prefix", t), ("phrase", [t]), ("and" | "or", [..]), ("not", q).

    Terms side by side are alternatives; NOT binds what follows, AND binds closer
    than OR, and parentheses group.
    """
    tokens = re.findall(r'"[^"]*"|\(|\)|[^\s()"]+', query)
    at = 0

    def atom():
        nonlocal at
        token = tokens[at]
        at += 1
        if token == "(":
            inner = either()
            if at >= len(tokens) or tokens[at] != ")":
                raise ValueError("a parenthesis is not closed")
            at += 1
            return inner
        if token in (")", "AND", "OR"):
            raise ValueError(f"{token} is out of place")
        if token == "NOT":
            return ("not", atom())
        if token[0] == '"':
            return ("phrase", token[1:-1].lower().split())
        return ("prefix", token[:-1].lower()) if token.endswith("*") and len(token) > 1 else ("term", token.lower())

    def every():
        nonlocal at
        parts = [atom()]
        while at < len(tokens) and tokens[at] in ("AND", "NOT"):
            if tokens[at] == "AND":
                at += 1
                if at >= len(tokens):
                    raise ValueError("AND is out of place")
            parts.append(atom())
        return parts[0] if len(parts) == 1 else ("and", parts)

    def either():
        nonlocal at
        parts = [every()]
        while at < len(tokens) and tokens[at] != ")":
            if tokens[at] == "OR":
                at += 1
                if at >= len(tokens):
                    raise ValueError("OR is out of place")
            parts.append(every())
        return parts[0] if len(parts) == 1 else ("or", parts)

    if not tokens:
        raise ValueError("the query is empty")
    tree = either()
    if at < len(tokens):
        raise ValueError(f"{tokens[at]} is out of place")
    return tree


def matches(tokens: Column, query: str) -> Column:
    """Whether a text's tokens answer a query."""

    def test(tree) -> Column:
        kind, what = tree
        if kind == "term":
            return F.array_contains(tokens, what)
        if kind == "prefix":
            return F.exists(tokens, lambda t: t.startswith(what))
        if kind == "phrase":
            return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")).contains(f" {' '.join(what)} ")
        if kind == "not":
            return ~test(what)
        return reduce(Column.__and__ if kind == "and" else Column.__or__, map(test, what))

    return test(parse(query))


def whole(words: str, ascii_only: bool = False) -> str:
    """A pattern of whole words in any case; ascii_only: as RE2 takes (?i) and \\b, where any character but [A-Za-z0-9_] ends a word."""
    if ascii_only:
        folded = re.sub("[sk]", lambda m: {"s": "[s\u017f]", "k": "[k\u212a]"}[m[0]], words.lower())  # the long s and the Kelvin sign
        return rf"(?i)(?<![A-Za-z0-9_])({folded})(?![A-Za-z0-9_])"
    return rf"(?iu)(?<![\p{{L}}\p{{N}}])({words})(?![\p{{L}}\p{{N}}])"


def highlight(text: Column, terms: list[str], before: str = "<b>", after: str = "</b>", ascii_only: bool = False) -> Column:
    """The text with each whole word that is one of the terms between two marks."""
    return F.regexp_replace(text, whole("|".join(re.escape(t) for t in terms), ascii_only), f"{before}$1{after}")


class Postings:
    """Postings (term, id, field, tf) in files by a hash of the term, and the lengths of documents.

    A query reads the buckets of its own terms only.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def build(cls, df: DataFrame, id_col: str, fields: list[str], kind: str = "default") -> Postings:
        index = cls(df.sparkSession, scratch(df.sparkSession, "postings"))
        tokens = df.select(F.col(id_col).alias("id"), *[tokenize(F.coalesce(F.col(f), F.lit("")), kind).alias(f"_{i}") for i, f in enumerate(fields)])
        tokens.select("id", *[F.size(f"_{i}").alias(f) for i, f in enumerate(fields)]).write.parquet(f"{index.path}/lengths")
        every = reduce(DataFrame.unionAll, [tokens.select("id", F.lit(f).alias("field"), F.explode(f"_{i}").alias("term")) for i, f in enumerate(fields)])
        counts = every.groupBy("term", "id", "field").agg(F.count("*").alias("tf"))
        counts.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")).repartition("bucket").sortWithinPartitions("term", "id").write.partitionBy("bucket").parquet(f"{index.path}/terms")
        return index

    def of(self, terms: list[str]) -> DataFrame:
        """Postings of the terms."""
        wanted = self.spark.createDataFrame([(t,) for t in terms], "term string").select(F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("b"))
        buckets = [r.b for r in wanted.distinct().collect()]  # one a term at most
        return self.spark.read.parquet(f"{self.path}/terms").where(F.col("bucket").isin(buckets) & F.col("term").isin(terms)).drop("bucket")

    def best(self, terms: list[str], k: int, weights: dict[str, float] | None = None, allowed: DataFrame | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """(id, score): the k best by BM25, ties by id; weights: of fields; allowed: ids that may be returned."""
        lengths = self.spark.read.parquet(f"{self.path}/lengths")
        fields = [c for c in lengths.columns if c != "id"]
        found = self.of(terms)
        means = lengths.agg(F.count("*").alias("n"), *[F.avg(f).alias(f"m_{f}") for f in fields])
        seen = found.groupBy("term", "field").agg(F.countDistinct("id").alias("d"))
        if allowed is not None:
            found = found.join(allowed.select(F.col(allowed.columns[0]).alias("id")).distinct(), "id", "left_semi")
        rows = found.join(seen, ["term", "field"]).join(lengths, "id").crossJoin(F.broadcast(means))  # one row
        length = F.coalesce(*[F.when(F.col("field") == f, F.col(f) / F.col(f"m_{f}")) for f in fields])
        weight = F.coalesce(*[F.when(F.col("field") == f, F.lit(float((weights or {}).get(f, 1.0)))) for f in fields])
        score = weight * F.ln(1 + (F.col("n") - F.col("d") + 0.5) / (F.col("d") + 0.5)) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * length))
        return rows.groupBy("id").agg(F.round(F.sum(score), 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)
