"""Graphs, model text, questions, sources and plans."""

import pytest
from pyspark.sql import functions as F

from quern.functions import model_text, questions
from quern.operators import graph, vectors
from quern.plans import systems
from quern.plans.registry import table
from quern.sources import files, wide_column
from tests.sql_match import assert_same, connection

#: fixed values: a published graph whose results are known
FRIENDS = [("a", "b", "friend"), ("b", "c", "follow"), ("c", "b", "follow"), ("f", "c", "follow"), ("e", "f", "follow"), ("e", "d", "friend"), ("d", "a", "friend"), ("a", "e", "friend")]
PEOPLE = list("abcdefg")


@pytest.fixture(scope="module")
def friends(spark):
    return graph.Graph(spark.createDataFrame([(x, x.upper()) for x in PEOPLE], "id string, name string"), spark.createDataFrame(FRIENDS, "src string, dst string, relationship string"))


def test_degrees_leave_out_isolated_vertices(friends):
    assert {r.id: r.in_degree for r in friends.in_degrees().collect()} == {"a": 1, "b": 2, "c": 2, "d": 1, "e": 1, "f": 1}
    assert {r.id: r.out_degree for r in friends.out_degrees().collect()} == {"a": 2, "b": 1, "c": 1, "d": 1, "e": 2, "f": 1}
    assert "g" not in {r.id for r in friends.degrees().collect()}


def test_triangles_and_components(friends):
    assert {r.id: r.triangles for r in graph.triangle_counts(friends).collect()} == {"a": 1, "d": 1, "e": 1, "b": 0, "c": 0, "f": 0, "g": 0}
    assert {r.id: r.component for r in graph.connected_components(friends).collect()} == {**dict.fromkeys("abcdef", "a"), "g": "g"}


def test_motifs(friends):
    mutual = friends.find("(a)-[e]->(b); (b)-[e2]->(a)")
    assert mutual.columns == ["a", "e", "b", "e2"] and mutual.count() == 2
    assert friends.find("(a)-[]->(b); (b)-[]->(c); (c)-[]->(a)").count() == 3  # rotations of a-e-d
    assert {(r.a.id, r.b.id) for r in friends.find("(a)-[]->(b); !(b)-[]->(a)").collect()} == {(s, d) for s, d, _ in FRIENDS if (d, s) not in {(x, y) for x, y, _ in FRIENDS}}
    assert friends.find("(a)-[]->(a)").count() == 0
    assert friends.find("(a)-[e]->()").columns == ["a", "e"]


@pytest.mark.parametrize("bad", ["", "(a)->(b)", "(a)-[e]->(b); !(b)-[x]->(a)", "!(a)-[]->(b)", "(a)-[]->(b); !(b)-[]->(z)"])
def test_bad_motifs(bad):
    with pytest.raises(ValueError):
        graph.parse_motif(bad)


def test_long_chain_and_star_components(spark):
    n = 400
    edges = [(i, i + 1) for i in range(n)] + [(10_000, 10_000 + i) for i in range(1, 50)] + [(5, 5)]
    vertices = spark.createDataFrame([(i,) for i in range(n + 1)] + [(10_000 + i,) for i in range(50)], "id bigint")
    got = graph.connected_components(graph.Graph(vertices, spark.createDataFrame(edges, "src bigint, dst bigint"))).groupBy("component").count().collect()
    assert {r.component: r["count"] for r in got} == {0: n + 1, 10_000: 50}


def test_rank_reaches_its_fixed_point(spark):
    edges = [(1, 2), (2, 3), (3, 1), (1, 3), (4, 4)]
    g = graph.Graph(spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5)], "id int"), spark.createDataFrame(edges, "src int, dst int"))
    vertices, weighted = graph.page_rank(g, tol=1e-6)
    got = {r.id: r.pagerank for r in vertices.collect()}
    assert sum(got.values()) == pytest.approx(5, abs=1e-4)
    want = dict.fromkeys(range(1, 6), 1.0)
    for _ in range(300):
        lost = want[5] / 5
        want = {v: 0.15 + 0.85 * (lost + sum(want[s] / sum(1 for x, _ in edges if x == s) for s, d in edges if d == v)) for v in want}
    assert got == pytest.approx(want, abs=1e-4)
    assert {(r.src, r.dst): r.weight for r in weighted.collect()}[1, 2] == 0.5


def test_model_calls(spark):
    df = spark.createDataFrame([(i, f"row {i} has an error" if i % 2 else "fine") for i in range(250)] + [(999, None)], "id bigint, text string")
    replies = {r.id: r.reply for r in df.select("id", model_text.per_row(model_text.Offline, "classify")("text").alias("reply")).collect()}
    assert replies[1] == "problem" and replies[2] == "normal" and replies[999] is None
    batches = model_text.per_batch(df.coalesce(1), "id", "text", model_text.Offline, 100).groupBy("reply").count().collect()
    assert {r.reply: r["count"] for r in batches} == {"100 records": 200, "51 records": 51}
    joined = model_text.batch_summaries(df, "id", "text", model_text.Offline, 10)
    assert joined.count() == 251 and all(int(r.reply.split()[0]) >= r.n for r in joined.groupBy("batch_id", "reply").agg(F.count("*").alias("n")).collect() if r.n == 10)
    failing = df.select("id", model_text.per_row(lambda: model_text.Offline(fail_every=1), "classify")("text").alias("reply"))
    assert model_text.failures(failing, "reply").count() == 250


TEXTS = ["", None, "fine", "ERROR", "café error", "Fehler – ErRoR", "érror", "ERRÓR", "İERROR\u212a", "错误", "e\u0301rror", "👩\u200d👩\u200d👧", "a\u00a0b\r\nerror\u2028", "err\nor", "\x00error"]


@pytest.fixture(scope="module")
def any_texts(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("texts"))
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.mark.parametrize("name", ["L01_row_classify", "L08_struct_reply", "L09_retries", "L10_broadcast_config"])
def test_model_queries_take_texts_of_any_letters(spark, any_texts, name):
    if name.startswith("L08"):
        want = {(i, len(t or "")) for i, t in enumerate(TEXTS)}
    elif name.startswith("L09"):
        want = {(i,) for i, t in enumerate(TEXTS) if t and "error" in t.lower()}
    else:
        want = {(i, None if t is None else "problem" if "error" in t.lower() else "normal") for i, t in enumerate(TEXTS)}
    assert set(map(tuple, systems.registry.queries[name](spark, any_texts).collect())) == want
    assert_same(spark, connection(any_texts), systems.registry.queries[name], systems.registry.sql[name], any_texts)


def test_only_e_r_and_o_have_such_a_lower_case():
    assert {chr(c) for c in range(0x110000) if set(chr(c).lower()) & set("ero")} == set("eroERO")


def test_the_task_is_read_in_the_worker(spark):
    seen = spark.sparkContext.accumulator(0)

    def task():
        seen.add(1)
        return "classify"

    assert spark.range(1).select(model_text.per_row(model_text.Offline, task)(F.lit("error"))).first()[0] == "problem" and seen.value >= 1


def test_streams_in_several_batches_write_each_window_once(spark, tmp_path):
    from quern.streaming import windows

    day = [(i, f"2024-01-01 {i // 60:02}:{i % 60:02}:00", "ab"[i % 2]) for i in range(0, 600, 7)]
    df = spark.createDataFrame(day, "id int, t string, k string").select("id", F.col("t").cast("timestamp_ntz").alias("t"), "k")
    for part in range(3):
        df.where(f"id >= {part * 200} AND id < {part * 200 + 200}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = windows.run_to_end(stream, "t", lambda s: windows.tumbling_counts(s, "t", "k", late="1 day")).collect()
    want = df.groupBy(F.date_trunc("hour", "t").alias("h"), "k").count().collect()
    assert sorted((str(r.start), r.k, r.n) for r in got) == sorted((str(r.h), r.k, r["count"]) for r in want)


def test_ranges_reach_the_scan_of_stored_cells(spark):
    cells = wide_column.store(spark.range(1000).select(F.lpad(F.col("id").cast("string"), 6, "0").alias("row_key"), F.lit("f").alias("family"), F.lit("q").alias("qualifier"), F.lit(1).alias("ts"), F.col("id").cast("string").alias("value")))
    found = wide_column.scan(cells, "000100", "000200")
    assert found.count() == 100 and "GreaterThanOrEqual(row_key,000100)" in plan(found)


def test_ranks_that_do_not_settle_are_an_error(spark):
    g = graph.Graph(spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(1, 2), (2, 1), (1, 1)], "src int, dst int"))
    with pytest.raises(RuntimeError):
        graph.page_rank(g, tol=1e-12, max_rounds=2)


def test_tables_are_described_as_sql_reads_them(spark):
    told = questions.describe("t", spark.createDataFrame([(1, None), (2, "b")], "id int, name string"), 1)
    assert told == 'CREATE TABLE `t` (`id` INT, `name` STRING);\n-- {"id":1,"name":null}'


def test_retries_recover():
    client = model_text.Offline(fail_every=2)
    assert [model_text.ask(client, "summarize\na b") for _ in range(4)] == ["a b"] * 4
    assert model_text.ask(model_text.Offline(fail_every=1), "x").startswith(model_text.ERROR)


@pytest.mark.parametrize("reply,sql", [("```sql\nSELECT 1;\n```", "SELECT 1"), ("Sure: select a\nfrom t ;", "select a\nfrom t"), ("```\nWITH x AS (SELECT 1) SELECT * FROM x\n``` and ```sql\nSELECT 2```", "WITH x AS (SELECT 1) SELECT * FROM x"), ("no idea", "no idea")])
def test_extract_sql(reply, sql):
    assert questions.extract_sql(reply) == sql


def test_guard_lets_only_queries_pass(spark):
    df = spark.createDataFrame([(1, "a")], "id int, name string")
    ask = lambda sql, mode=questions.Mode.SQL: questions.answer(spark, lambda _: sql, "?", {"guarded": df}, mode)
    assert ask("SELECT name FROM guarded").rows.first().name == "a"
    for bad in ("DROP VIEW guarded", "```sql\nCREATE TABLE x AS SELECT 1\n```", "SELECT nope FROM guarded", "SELEC 1", "SET a=b", "INSERT INTO guarded VALUES (2, 'b')"):
        assert ask(bad).error and ask(bad).rows is None
    assert "Scan" in ask("SELECT name FROM guarded", questions.Mode.EXPLAIN).text
    assert ask("All is well", questions.Mode.INSIGHT).text == "All is well"


def test_wide_column_versions_and_ranges(spark):
    t = spark.createDataFrame([("row1", "p", "age", 1, "34"), ("row1", "p", "age", 2, "55"), ("row2", "p", "name", 1, "x"), ("row3", "q", "z", 1, "y")], "row_key string, family string, qualifier string, ts int, value string")
    assert [(r.row_key, r.value) for r in wide_column.get(t, "row1").collect()] == [("row1", "55")]
    assert {r.row_key for r in wide_column.scan(t, "row1", "row3").collect()} == {"row1", "row2"}
    assert {r.row_key for r in wide_column.scan(t, "row2").collect()} == {"row2", "row3"}
    assert {(r.row_key, r.p_age) for r in wide_column.pivoted(t, [("p", "age")]).collect()} == {("row1", "55"), ("row2", None), ("row3", None)}
    with pytest.raises(Exception, match="unknown family"):
        wide_column.put(t, t, ["p"]).collect()


def test_nearest(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 1.0]), (3, [0.9, 0.1]), (4, [0.0, 0.0]), (5, None), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "id bigint, v array<float>")
    got = [(r.query, r.neighbour) for r in vectors.nearest(df, df.where("id = 0"), "id", "v", 2).orderBy("query", F.desc("cosine"), "neighbour").collect()]
    assert got == [(0, 1), (0, 3)]
    assert vectors.nearest(df, df.limit(0), "id", "v").count() == 0


def test_readers_and_writers_refuse_nonsense(spark, tmp_path):
    for call in (lambda: files.read_any(spark, "avro", "x"), lambda: files.read_any(spark, "dbase", "x"), lambda: files.write_any(spark.range(1), "csv", str(tmp_path), mode="maybe"), lambda: files.write_any(spark.range(1), "csv", str(tmp_path), codec="lzma"), lambda: files.to_records(spark.range(5), 4), lambda: files.jdbc_options("u", "t", "d", "me", "X", "id", 5, 1)):
        with pytest.raises(ValueError):
            call()


def test_jdbc_options(monkeypatch):
    monkeypatch.setenv("DB_PASSWORD", "s")
    got = files.jdbc_options("jdbc:x", "t", "drv", "me", "DB_PASSWORD", "id", 0, 100, 4)
    assert got["password"] == "s" and got["numPartitions"] == "4" and got["lowerBound"] == "0"


def test_graphml(spark, tmp_path):
    (tmp_path / "g.xml").write_text('<graphml><graph><node id="n0"><data key="d0"> Ann </data></node><node id="n1"/><edge source="n0" target="n1"><data key="w">2</data></edge></graph></graphml>')
    vertices, edges = files.read_graphml(spark, str(tmp_path / "g.xml"))
    assert {r.id: r["keys"] for r in vertices.collect()} == {"n0": {"d0": "Ann"}, "n1": {}}
    assert [(r.src, r.dst, r["keys"]) for r in edges.collect()] == [("n0", "n1", {"w": "2"})]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, tmp_path):
    df = spark.range(1000).select("id", (F.col("id") % 5).alias("k"), F.lit("x").alias("other"))
    path = files.write_any(df, "parquet", str(tmp_path / "p"), partition_by=["k"])
    back = spark.read.parquet(path)
    pruned = plan(back.where("k = 3 AND id > 10").select("id"))
    assert "PartitionFilters: [isnotnull(k" in pruned and "GreaterThan(id,10)" in pruned and "other" not in pruned.split("ReadSchema")[1]
    assert plan(back.groupBy("k").count()).count("HashAggregate") == 2  # combined before the shuffle
    assert "TakeOrderedAndProject" in plan(back.orderBy("id").limit(3))
    assert "BroadcastHashJoin" in plan(back.join(F.broadcast(spark.range(3)), "id"))
    a, b = (files.write_bucketed(df.select("id", F.lit(n).alias(n)), f"quern_bucketed_{n}", 4, "id") for n in "ab")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" not in plan(a.join(b, "id"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
