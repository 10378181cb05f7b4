"""Cases of the sources, changing tables, full text, functions and views that no query covers."""

import json

import pytest
from pyspark.sql import functions as F

import brightwater
from brightwater.functions import dialect as D
from brightwater.functions import udfs as U
from brightwater.functions.surface import SQL_FUNCTIONS
from brightwater.operators import aggregates, fulltext, incremental, recursive, tables
from brightwater.plans import registry
from brightwater.sources import files


def test_surface(spark):
    brightwater.register(spark)
    row = spark.sql("SELECT soundex_of('') AS s, substr0('abc', 0, 2) AS z, char_of(array(72, 128512)) AS c, array_at(array(5L, 6L), 1) AS a, json_type_of('{\"a\":[1]}', '$.a') AS t, json_quote_text('a\"') AS q, ip4_text(ip4_number('10.1.2.3')) AS ip").first()
    codes = spark.sql("SELECT refined_soundex('is') AS r, caverphone('phonetics') AS c, caverphone('is') AS d, refined_soundex('') AS e").first()
    assert tuple(codes) == ("I03", "FNTKS11111", "AS11111111", "")
    assert tuple(row) == ("?000", "a", "H😀", 6, "array", '"a\\""', "10.1.2.3")
    assert len(SQL_FUNCTIONS) > 60
    rows = spark.sql("SELECT t.* FROM (SELECT '{\"a\":{\"b c\":[1,null]}}' AS j), LATERAL json_tree(j, '$.a') t").collect()
    assert [(r.key, r.type, r.atom, r.fullkey, r.path) for r in rows] == [("a", "object", None, "$.a", "$"), ("b c", "array", None, '$.a."b c"', "$.a"), ("0", "integer", "1", '$.a."b c"[0]', '$.a."b c"'), ("1", "null", None, '$.a."b c"[1]', '$.a."b c"')]
    assert spark.sql("SELECT count(*) FROM (SELECT 'no json' AS j), LATERAL json_each(j, '$') t").first()[0] == 0


def test_json_edits():
    patch = U.apply_operations({"a": [1, 2], "b/c": 1}, [{"op": "add", "path": "/a/-", "value": 3}, {"op": "remove", "path": "/b~1c"}, {"op": "replace", "path": "/a/0", "value": 9}])
    assert patch == {"a": [9, 2, 3]}
    for a, b in (({"x": 1, "y": {"z": [1]}}, {"y": {"z": [2]}, "n~": None}), ({}, {"a": {}}), ({"a": 1}, {"a": {"b": 1}})):
        assert U.apply_operations(json.loads(json.dumps(a)), U.difference(a, b)) == b
    with pytest.raises(KeyError):
        U.apply_operations({}, [{"op": "replace", "path": "/a", "value": 1}])


def test_times(spark):
    t = spark.sql("SELECT TIMESTAMP_NTZ '2025-01-31 10:20:30.5' AS a, TIMESTAMP_NTZ '2024-01-01 00:00:00' AS b, TIMESTAMP_NTZ '2025-06-15 00:00:00' AS c")
    row = t.select(
        F.date_format(D.moment(F.col("a"), "+1 month"), "yyyy-MM-dd").alias("roll"),
        F.date_format(D.moment(F.col("a"), "+1 month", "floor"), "yyyy-MM-dd").alias("floor"),
        F.date_format(D.moment(F.col("a"), "start of month", "weekday 5", "-0.5 days"), "yyyy-MM-dd HH:mm").alias("chain"),
        D.timediff(F.col("b"), F.col("c")).alias("back"),
        D.timediff(F.col("a"), F.col("b")).alias("on"),
    ).first()
    assert tuple(row) == ("2025-03-03", "2025-02-28", "2025-01-02 12:00", "-0001-05-14 00:00:00.000", "+0001-00-30 10:20:30.500")
    with pytest.raises(ValueError):
        D.moment(F.col("a"), "sideways")


def test_printf(spark):
    row = spark.range(1).select(D.printf("%5.1f|%-4s|%q|%Q|%w|%c|%%|%d", F.lit(2.25), F.lit("ab"), F.lit("i't"), F.lit(None), F.lit('a"b'), F.lit("xyz"), F.lit(None)).alias("t")).first()
    assert row.t == "  2.3|ab  |i''t|NULL|a\"\"b|x|%|0"


def test_tables(spark):
    held = tables.create_as(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"))
    with pytest.raises(ValueError):
        held.insert(spark.createDataFrame([(2, "c")], "k int, v string"), "k")
    assert held.insert(spark.createDataFrame([(2, "c"), (3, None)], "k int, v string"), "k", "replace").count() == 2
    assert sorted((r.k, r.v) for r in held.rows().collect()) == [(1, "a"), (2, "c"), (3, None)]
    assert [r.v for r in held.update(F.col("v") == "c", v=F.lit("d")).collect()] == ["d"]
    assert [r.k for r in held.delete(F.col("v").isNull()).collect()] == [3]
    assert sorted((r.k, r.v) for r in held.rows().collect()) == [(1, "a"), (2, "d")] and held.rows(0).count() == 2
    numbers = tables.numbered(spark.range(500).withColumn("x", (F.col("id") * 7919 % 500).cast("int")), "x", start=10)
    assert all(r.n == 10 + r.x for r in numbers.collect())


def test_copy(spark, tmp_path):
    (tmp_path / "f.txt").write_text("id\tt\n1\ta\\tb\\\\n\\\n2\t\\N\n3\tx\\\ty\n\\.\n9\tz\n".replace("\\\n2", "\n2"))
    rows = files.copy_text(spark, str(tmp_path), "id int, t string", header=True).collect()
    assert sorted((r.id, r.t) for r in rows) == [(1, "a\tb\\n"), (2, None), (3, "x\ty")]


def test_grammar(spark):
    docs = spark.createDataFrame([(1, "fast database engine"), (2, "database nosql"), (3, "fasting days")], "id int, t string")
    ask = lambda q: {r.id for r in docs.where(fulltext.matches(fulltext.tokenize(F.col("t")), q)).collect()}
    assert ask("database NOT nosql") == {1} and ask("fast*") == {1, 3} and ask('"database engine" OR nosql') == {1, 2} and ask("fast AND (engine OR days)") == {1}
    for bad in ("", "(a", "a)", "AND", "a OR"):
        with pytest.raises((ValueError, IndexError)):
            fulltext.parse(bad)


def test_highlight_ends_words_like_its_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    texts = ["the MIT License, mit\u00fcber", "\u00e9mit license", "mit licen\u017fe_ mit Licen\u017fe\u00df", "m\u0131t license", "x_mit license", "mit license_", "MIT  license", "2mit license"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    registry.load()
    sql = registry.ORACLE_SQL["fts_highlight"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = [tuple(r) for r in registry.QUERIES["fts_highlight"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(duckdb.connect().sql(sql).fetchall()) and (1, "\u00e9<b>mit</b> <b>license</b>") in got


def test_aggregate_and_graph(spark):
    df = spark.createDataFrame([("a", 1), ("a", 5), ("b", 2)], "k string, v int").repartition(3)
    out = aggregates.user_aggregate(df, ["k"], "v", "m", "int", lambda: 0, max, max, lambda s: s)
    assert sorted((r.k, r.m) for r in out.collect()) == [("a", 5), ("b", 2)]
    edges = spark.createDataFrame([(1, 2, 5), (3, 2, 1)], "src int, dst int, w int")
    start = spark.createDataFrame([(1,)], "s int")
    assert {r.node for r in recursive.match_path(edges, start, [("out", "w > 3"), ("in", None)]).collect()} == {1, 3}
    assert {r.node for r in recursive.match_path(edges, start, [("both", None), ("both", "w < 3")]).collect()} == {3}


def test_view_takes_back_all(spark):
    rows = spark.createDataFrame([(1, None), (2, 5)], "k long, v long")
    sign = lambda n: rows.withColumn("weight", F.lit(n).cast("long"))
    view = incremental.View(spark, {"r": "k long, v long"}, lambda s: s["r"], keys=["k"], sums={"s": "v"})
    view.apply(r=sign(1))
    assert sorted((r.k, r.s, r.weight) for r in view.rows().collect()) == [(1, None, 1), (2, 5, 1)]
    view.apply(r=sign(-1))
    assert view.rows().count() == 0


def test_capture(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(2, None), (3, "z")], "k int, v string")
    full = {r.id: r for r in incremental.capture(a, b, "k", "t").collect()}
    assert [full[i].change_type for i in (1, 2, 3)] == [-1, 0, 1] and full[2].updates == "v" and json.loads(full[2].after) == {"k": 2, "v": None}
    assert sorted(r.change_type for r in incremental.capture(a, b, "k", "t", "id", 2).collect()) == [-1, 0, 1, 2]
    with pytest.raises(ValueError):
        incremental.capture(a, b, "k", "t", "some")


def test_percentile_without_a_map_of_all(spark):
    rows = spark.range(5001).select(F.when(F.col("id") % 7 > 0, (F.col("id") * 7919 % 3001).cast("double")).alias("x"))
    for p in (0.0, 0.3333, 0.5, 1.0):
        for df in (rows, rows.limit(2), rows.where("x = 4"), rows.where("x < 0")):
            found = aggregates.exact_percentile(df, "x", p)
            assert found.first()[0] == df.agg(F.percentile("x", p)).first()[0]


def test_approx_aggregates_keep_no_sketch_a_key(spark, tmp_path):
    spark.range(100).selectExpr("id AS o_orderkey", "id % 40 AS o_custkey", "CAST(id AS DOUBLE) + 1 AS o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    registry.load()
    found = registry.QUERIES["approx_aggregates"](spark, str(tmp_path))
    assert tuple(found.first()) == (True, True)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "approx_count_distinct" in line and "keys=[o_custkey" in line]
