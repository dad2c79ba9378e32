"""Queries of sources and sinks, wide-column tables, graphs, functions, model text, vectors, streams, recommendations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import model_text, questions, udfs
from quern.operators import graph, recommend, vectors
from quern.plans.registry import Registry, table
from quern.sources import files, wide_column
from quern.staging import scratch_path, stage
from quern.streaming import windows

registry = Registry()

_FOUR = [("Alice", 34, "US"), ("Bob", 45, "CN"), ("Cara", 29, "US"), ("Dan", None, "CN")]
_FOUR_SQL = "SELECT * FROM (VALUES ('Alice', CAST(34 AS BIGINT), 'US'), ('Bob', 45, 'CN'), ('Cara', 29, 'US'), ('Dan', NULL, 'CN')) AS t(name, age, country)"
_COLUMNS = ["name", "age", "country"]


# ---- sources ----------------------------------------------------------------------------------------------
@registry.query("S01_tuples", _FOUR_SQL)
def s01(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(_FOUR, _COLUMNS)


@registry.query("S02_dicts", _FOUR_SQL)
def s02(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([dict(zip(_COLUMNS, r)) for r in _FOUR])


@registry.query("S03_rows", _FOUR_SQL)
def s03(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([Row(**dict(zip(_COLUMNS, r))) for r in _FOUR])


@registry.query("S04_schema", _FOUR_SQL)
def s04(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(_FOUR, T.StructType([T.StructField("name", T.StringType()), T.StructField("age", T.LongType()), T.StructField("country", T.StringType())]))


@registry.query("S05_pandas", f"SELECT * FROM ({_FOUR_SQL}) WHERE age IS NOT NULL")
def s05(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(pd.DataFrame(_FOUR[:3], columns=_COLUMNS), "name string, age bigint, country string")


@registry.query("S06_parallelize", "SELECT range AS n FROM range(100)")
def s06(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(100, numPartitions=4).select(F.col("id").alias("n"))


@registry.query("S07_to_df", _FOUR_SQL)
def s07(spark: SparkSession, d: str) -> DataFrame:
    return spark.sparkContext.parallelize(_FOUR, 2).toDF(_COLUMNS)


@registry.query("S08_df_to_rdd", "SELECT n_name AS name FROM nation")
def s08(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").rdd.map(lambda r: (r.n_name,)).toDF(["name"])


@registry.query("S09_text_lines", "SELECT n_name AS value FROM nation")
def s09(spark: SparkSession, d: str) -> DataFrame:
    path = files.write_any(table(spark, d, "nation").select("n_name"), "text", scratch_path(spark, "lines"))
    return files.read_lines(spark, path, 4)


_SUPPLIER = "SELECT CAST(s_suppkey AS {k}) AS s_suppkey, s_name, s_acctbal FROM supplier"


def _supplier(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")


registry.add("S10_text_source", lambda spark, d: spark.read.text(files.write_any(table(spark, d, "region").select("r_name"), "text", scratch_path(spark, "text"))).select(F.upper("value").alias("loud")), "SELECT upper(r_name) AS loud FROM region")
registry.add("S17_generic_reader", lambda spark, d: files.read_any(spark, "parquet", f"{d}/region.parquet"), "SELECT * FROM region")


@registry.query("S19_jdbc_options", "SELECT 'partitionColumn' AS option, 'id' AS value UNION ALL SELECT 'numPartitions', '16'")
def s19(spark: SparkSession, d: str) -> DataFrame:
    """No driver is at hand: the options of a partitioned read."""
    options = files.jdbc_options("jdbc:postgresql://host/db", "orders", "org.postgresql.Driver", "reader", "QUERN_DB_PASSWORD", "id", 0, 1_000_000, 16)
    return spark.createDataFrame([(k, options[k]) for k in ("partitionColumn", "numPartitions")], "option string, value string")


@registry.query("S20_uri_schemes", "SELECT * FROM region")
def s20(spark: SparkSession, d: str) -> DataFrame:
    """Readers take any URI that a Hadoop file system serves; here file://, elsewhere s3a://, gs:// or abfss://."""
    return files.read_any(spark, "parquet", f"file://{d}/region.parquet")


@registry.query("S22_directories_as_input", "SELECT s_name AS value FROM supplier UNION ALL SELECT n_name FROM nation")
def s22(spark: SparkSession, d: str) -> DataFrame:
    paths = [files.write_any(table(spark, d, t).select(c), "text", scratch_path(spark, t)) for t, c in (("supplier", "s_name"), ("nation", "n_name"))]
    return spark.read.text(paths)


@registry.query("S11_csv_header", _SUPPLIER.format(k="INTEGER"))
def s11(spark: SparkSession, d: str) -> DataFrame:
    return files.read_csv(spark, files.write_any(_supplier(spark, d), "csv", scratch_path(spark, "csv"), header=True))


@registry.query("S12_csv_headerless", "SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name FROM supplier")
def s12(spark: SparkSession, d: str) -> DataFrame:
    return files.read_csv(spark, files.write_any(_supplier(spark, d), "csv", scratch_path(spark, "csv")), header=False, names=["id", "name", "balance"]).select("id", "name")


@registry.query("S13_csv_schema", _SUPPLIER.format(k="BIGINT"))
def s13(spark: SparkSession, d: str) -> DataFrame:
    return files.read_csv(spark, files.write_any(_supplier(spark, d), "csv", scratch_path(spark, "csv"), header=True), schema="s_suppkey bigint, s_name string, s_acctbal double")


@registry.query("S14_json", _SUPPLIER.format(k="BIGINT"))
def s14(spark: SparkSession, d: str) -> DataFrame:
    return files.read_any(spark, "json", files.write_any(_supplier(spark, d), "json", scratch_path(spark, "json")) + "/part-*").select("s_suppkey", "s_name", "s_acctbal")


@registry.query("S15_gzip_json", "SELECT count(*) AS n FROM supplier")
def s15(spark: SparkSession, d: str) -> DataFrame:
    path = files.write_any(_supplier(spark, d), "json", scratch_path(spark, "gz"), codec="gzip", one_file=True)
    return files.read_spread(files.read_any(spark, "json", path, "s_suppkey bigint"), 4).agg(F.count("*").alias("n"))


@registry.query("S16_parquet_wildcard", "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders WHERE year(o_orderdate) BETWEEN 1990 AND 1999 GROUP BY 1")
def s16(spark: SparkSession, d: str) -> DataFrame:
    path = _orders_by_year(spark, d)
    return spark.read.option("basePath", path).parquet(f"{path}/y=199*").groupBy(F.col("y").cast("bigint").alias("y")).agg(F.count("*").alias("n"))


@registry.query("S18_orc", _SUPPLIER.format(k="BIGINT"))
def s18(spark: SparkSession, d: str) -> DataFrame:
    return files.read_any(spark, "orc", files.write_any(_supplier(spark, d), "orc", scratch_path(spark, "orc")))


@registry.query("S21_sequence_file", "SELECT r_regionkey AS k, r_name AS v FROM region")
def s21(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "sequence")
    table(spark, d, "region").rdd.map(lambda r: (r.r_regionkey, r.r_name)).saveAsSequenceFile(path)
    return spark.createDataFrame(spark.sparkContext.sequenceFile(path), "k int, v string")


@registry.query("S23_edge_list", "SELECT n_regionkey AS src, n_nationkey AS dst FROM nation")
def s23(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "nation").select(F.col("n_regionkey").alias("src"), F.col("n_nationkey").alias("dst"))
    return files.read_csv(spark, files.write_any(edges, "csv", scratch_path(spark, "edges"), header=True))


@registry.query("S25_catalog", "SELECT 'catalog_region' AS table_name, true AS temporary, count(*) AS n FROM region")
def s25(spark: SparkSession, d: str) -> DataFrame:
    """The catalog's entry of a view, and the view read by the name found there."""
    table(spark, d, "region").createOrReplaceTempView("catalog_region")
    found = files.catalog_tables(spark).where("table_name = 'catalog_region'").select("table_name", "temporary")
    return found.withColumn("n", spark.table(found.first()["table_name"]).agg(F.count("*")).scalar())


# ---- sinks ------------------------------------------------------------------------------------------------
def _orders_by_year(spark: SparkSession, d: str, **how) -> str:
    orders = table(spark, d, "orders").withColumn("y", F.year("o_orderdate"))
    return files.write_any(orders, "parquet", scratch_path(spark, "years"), partition_by=["y"], **how)


@registry.query("K01_csv_header_per_file", "SELECT CAST(s_suppkey AS INTEGER) AS s_suppkey, s_name, s_acctbal FROM supplier")
def k01(spark: SparkSession, d: str) -> DataFrame:
    return files.read_csv(spark, files.write_any(_supplier(spark, d).repartition(3), "csv", scratch_path(spark, "csv3"), header=True))


@registry.query("K03_generic_writer", "SELECT * FROM region")
def k03(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.format("json").schema("r_regionkey int, r_name string").load(files.write_any(table(spark, d, "region"), "json", scratch_path(spark, "generic")))


@registry.query("PR16_for_each_partition", "SELECT count(*) AS n FROM nation")
def p16(spark: SparkSession, d: str) -> DataFrame:
    """Side effects per partition; what comes back is the count that the partitions reported, nothing they returned."""
    seen = spark.sparkContext.accumulator(0)
    table(spark, d, "nation").foreachPartition(lambda rows: seen.add(sum(1 for _ in rows)))
    return spark.createDataFrame([(seen.value,)], "n bigint")


@registry.query("K02_parquet_round_trip", "SELECT * FROM orders")
def k02(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(files.write_any(table(spark, d, "orders"), "parquet", scratch_path(spark, "orders"), codec="zstd"))


@registry.query("K04_modes", "SELECT r_name, count(*) AS n FROM (SELECT * FROM region UNION ALL SELECT * FROM region) GROUP BY 1")
def k04(spark: SparkSession, d: str) -> DataFrame:
    path, region = scratch_path(spark, "modes"), table(spark, d, "region")
    for mode in ("append", "overwrite", "append", "ignore"):
        files.write_any(region, "parquet", path, mode=mode)
    return spark.read.parquet(path).groupBy("r_name").agg(F.count("*").alias("n"))


@registry.query("K05_partition_by", "SELECT CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS n, max(o_orderkey) AS most FROM orders GROUP BY 1")
def k05(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(_orders_by_year(spark, d)).groupBy("y").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("most"))


@registry.query("K06_one_file_per_key", "SELECT CAST(year(o_orderdate) AS INTEGER) AS y, CAST(1 AS BIGINT) AS n_files FROM orders GROUP BY 1")
def k06(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(_orders_by_year(spark, d)).groupBy("y").agg(F.countDistinct("_metadata.file_path").alias("n_files"))


@registry.query("K07_bucketed", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
def k07(spark: SparkSession, d: str) -> DataFrame:
    return files.write_bucketed(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "quern_orders_bucketed", 8, "o_custkey").groupBy("o_custkey").agg(F.count("*").alias("n"))


@registry.query("K08_coalesce", "SELECT CAST(1 AS BIGINT) AS n_files, count(*) AS n FROM customer")
def k08(spark: SparkSession, d: str) -> DataFrame:
    path = files.write_any(table(spark, d, "customer"), "parquet", scratch_path(spark, "one"), one_file=True)
    return spark.read.parquet(path).agg(F.countDistinct("_metadata.file_path").alias("n_files"), F.count("*").alias("n"))


@registry.query("K09_codecs", "SELECT codec, count(*) AS n FROM region, (VALUES ('snappy'), ('zstd'), ('gzip'), ('none')) AS t(codec) GROUP BY 1")
def k09(spark: SparkSession, d: str) -> DataFrame:
    parts = [spark.read.parquet(files.write_any(table(spark, d, "region"), "parquet", scratch_path(spark, c), codec=c)).select(F.lit(c).alias("codec")) for c in ("snappy", "zstd", "gzip", "none")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3]).groupBy("codec").agg(F.count("*").alias("n"))


@registry.query("K10_text_file", "SELECT r_name AS value FROM region")
def k10(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "text")
    table(spark, d, "region").rdd.map(lambda r: r.r_name).saveAsTextFile(path)
    return spark.read.text(path)


@registry.query("K11_external_table", "SELECT o_orderkey, o_custkey FROM orders WHERE year(o_orderdate) = 1995")
def k11(spark: SparkSession, d: str) -> DataFrame:
    return files.external_table(spark, "quern_orders_external", "o_orderkey BIGINT, o_custkey BIGINT, y INT", ["y"], _orders_by_year(spark, d)).where("y = 1995").select("o_orderkey", "o_custkey")


@registry.query("K12_database", "SELECT count(*) AS n FROM nation")
def k12(spark: SparkSession, d: str) -> DataFrame:
    spark.sql("CREATE DATABASE IF NOT EXISTS quern_shop")
    path = files.write_any(table(spark, d, "nation"), "parquet", scratch_path(spark, "nations"), partition_by=["n_regionkey"])
    return files.external_table(spark, "quern_shop.nations", "n_nationkey INT, n_name STRING, n_regionkey INT", ["n_regionkey"], path).agg(F.count("*").alias("n"))


@registry.query("K13_tab_separated", "SELECT o_orderpriority AS k, CAST(count(*) AS INTEGER) AS n FROM orders GROUP BY 1")
def k13(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return spark.read.csv(files.write_tab_separated(counts, scratch_path(spark, "tabs")), sep="\t", schema="k string, n int")


@registry.query("K15_records", "SELECT r_regionkey, r_name FROM region")
def k15(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(files.to_records(table(spark, d, "region")), "r_regionkey int, r_name string")


@registry.query("F17_partition_pruning", "SELECT o_orderkey FROM orders WHERE year(o_orderdate) = 1996")
def f17(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(_orders_by_year(spark, d)).where("y = 1996").select("o_orderkey")


# ---- wide-column ------------------------------------------------------------------------------------------
_FAMILIES = {"person": ["name", "age"], "work": ["salary", "department_id"]}


def _cells(spark: SparkSession, d: str) -> DataFrame:
    staff = table(spark, d, "employees").withColumn("key", F.lpad(F.col("id").cast("string"), F.greatest(F.lit(12), F.length(F.col("id").cast("string"))), F.lit("0")))
    cells = wide_column.to_cells(staff, "key", _FAMILIES, "recorded_at")
    return wide_column.store(wide_column.put(cells.limit(0), cells, list(_FAMILIES)))


_CELLS = " UNION ALL ".join(f"SELECT lpad(CAST(id AS VARCHAR), CAST(greatest(12, length(CAST(id AS VARCHAR))) AS INTEGER), '0') AS row_key, '{f}' AS family, '{q}' AS qualifier, recorded_at AS ts, CAST({q} AS VARCHAR) AS value FROM employees WHERE {q} IS NOT NULL" for f, qs in _FAMILIES.items() for q in qs)
_LATEST = f"SELECT * FROM ({_CELLS}) QUALIFY row_number() OVER (PARTITION BY row_key, family, qualifier ORDER BY ts DESC, value DESC) = 1"


@registry.query("K14_put_latest", _LATEST)
def k14(spark: SparkSession, d: str) -> DataFrame:
    return wide_column.latest(_cells(spark, d))


@registry.query("S24_scan", f"SELECT * FROM ({_LATEST}) WHERE row_key >= '000000000100' AND row_key < '000000000200'")
def s24(spark: SparkSession, d: str) -> DataFrame:
    return wide_column.scan(_cells(spark, d), "000000000100", "000000000200")


@registry.query("S24_get", f"SELECT * FROM ({_LATEST}) WHERE row_key = '000000000100'")
def s24_get(spark: SparkSession, d: str) -> DataFrame:
    return wide_column.get(_cells(spark, d), "000000000100")


# ---- graphs -----------------------------------------------------------------------------------------------
def trade(spark: SparkSession, d: str) -> graph.Graph:
    """Nations, and an edge from the supplier's to the customer's nation where more than 0.17 % of all lines go."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    flows = lines.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    counted = flows.groupBy(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst")).agg(F.count("*").alias("n"))
    counted = stage(counted, "flows").frame
    edges = counted.where((F.col("src") != F.col("dst")) & (F.col("n") * 10000 > counted.agg(F.sum("n")).scalar() * 17))
    return graph.Graph(table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), "n_name"), edges)


_TRADE = "WITH c AS (SELECT s_nationkey AS src, c_nationkey AS dst, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2), e AS (SELECT * FROM c WHERE src <> dst AND n * 10000 > 17 * (SELECT sum(n) FROM c)), u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e)"


@registry.query("G01_edges", f"{_TRADE} SELECT src, dst, n FROM e")
def g01(spark: SparkSession, d: str) -> DataFrame:
    return trade(spark, d).edges


@registry.query("G02_degrees", f"{_TRADE} SELECT id, sum(i)::BIGINT AS ins, sum(o)::BIGINT AS outs, sum(i + o)::BIGINT AS both FROM (SELECT src AS id, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY 1")
def g02(spark: SparkSession, d: str) -> DataFrame:
    g = trade(spark, d)
    rows = g.degrees().join(g.in_degrees(), "id", "left").join(g.out_degrees(), "id", "left")
    return rows.select("id", F.coalesce("in_degree", F.lit(0)).alias("ins"), F.coalesce("out_degree", F.lit(0)).alias("outs"), F.col("degree").alias("both"))


@registry.query("G03_degree_filter", f"{_TRADE} SELECT src AS id, count(*) AS out_degree FROM e GROUP BY 1 HAVING count(*) > 5 ORDER BY 2 DESC, 1")
def g03(spark: SparkSession, d: str) -> DataFrame:
    return trade(spark, d).out_degrees().where("out_degree > 5").orderBy(F.desc("out_degree"), "id")


@registry.query("G04_motif", f"{_TRADE} SELECT x.src AS a, x.dst AS b, y.dst AS c FROM e x JOIN e y ON x.dst = y.src WHERE NOT EXISTS (SELECT 1 FROM e z WHERE z.src = x.src AND z.dst = y.dst)")
def g04(spark: SparkSession, d: str) -> DataFrame:
    return trade(spark, d).find("(a)-[]->(b); (b)-[]->(c); !(a)-[]->(c)").select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("c.id").alias("c"))


@registry.query("G05_motif_triangle", f"{_TRADE} SELECT x.src AS a, y.src AS b, z.src AS c FROM e x JOIN e y ON x.dst = y.src JOIN e z ON y.dst = z.src AND z.dst = x.src WHERE x.src < y.src")
def g05(spark: SparkSession, d: str) -> DataFrame:
    return trade(spark, d).find("(a)-[e1]->(b); (b)-[e2]->(c); (c)-[e3]->(a)").where("e1.src < e2.src").select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("c.id").alias("c"))


@registry.query("G06_motif_distinct", f"{_TRADE} SELECT DISTINCT x.src AS a, y.dst AS c FROM e x JOIN e y ON x.dst = y.src WHERE x.src <> y.dst")
def g06(spark: SparkSession, d: str) -> DataFrame:
    return trade(spark, d).find("(a)-[]->(b); (b)-[]->(c)").where("a.id <> c.id").select(F.col("a.id").alias("a"), F.col("c.id").alias("c")).dropDuplicates()


@registry.query("G07_triangles", f"{_TRADE}, t AS (SELECT p.a, p.b, q.b AS c FROM u p JOIN u q ON p.b = q.a JOIN u r ON r.a = p.a AND r.b = q.b) SELECT n_nationkey AS id, (SELECT count(*) FROM t WHERE n_nationkey IN (a, b, c)) AS triangles FROM nation")
def g07(spark: SparkSession, d: str) -> DataFrame:
    return graph.triangle_counts(trade(spark, d))


@registry.query("G08_components", "SELECT s_suppkey AS id, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS component FROM supplier UNION ALL SELECT -1 - s_nationkey, min(s_suppkey) FROM supplier GROUP BY s_nationkey")
def g08(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    edges = s.select(F.col("s_suppkey").alias("src"), (-1 - F.col("s_nationkey")).cast("bigint").alias("dst"))
    vertices = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    found = graph.connected_components(graph.Graph(vertices, edges))
    # components are named by their smallest id, here a nation's; the query names them by their smallest supplier
    first = found.where("id >= 0").groupBy("component").agg(F.min("id").alias("name"))
    return found.join(first, "component").select("id", F.col("name").alias("component"))


@registry.query(
    "G09_page_rank",
    f"""WITH RECURSIVE {_TRADE.removeprefix('WITH ')}, arcs AS MATERIALIZED (SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS w FROM e),
    ids AS MATERIALIZED (SELECT n_nationkey AS id, count(*) OVER () AS total, n_nationkey IN (SELECT src FROM e) AS leaves FROM nation),
    r AS (SELECT id, 1.0::DOUBLE AS rank, 0 AS k FROM ids UNION ALL
      SELECT * FROM (WITH given AS (SELECT dst, sum(rank * w) AS g FROM r JOIN arcs ON src = id GROUP BY 1), lost AS (SELECT coalesce(sum(rank), 0) AS l FROM r JOIN ids USING (id) WHERE NOT leaves)
      SELECT ids.id, 0.15 + 0.85 * (coalesce(g, 0) + l / total) AS rank, (SELECT max(k) FROM r) + 1 AS k FROM ids CROSS JOIN lost LEFT JOIN given ON dst = ids.id WHERE (SELECT max(k) FROM r) < 150))
    SELECT id, round(rank, 5) AS pagerank FROM r WHERE k = 150""",
)
def g09(spark: SparkSession, d: str) -> DataFrame:
    """Ranks at their fixed point, to five digits."""
    return graph.page_rank(trade(spark, d), tol=1e-9)[0].select("id", F.round("pagerank", 5).alias("pagerank"))


def together(spark: SparkSession, d: str) -> graph.Graph:
    """Parts, and an edge from each line's part to that of the order's next line: a graph that grows with the tables."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    following = lines.select(F.col("l_orderkey").alias("o"), (F.col("l_linenumber") - 1).alias("n"), F.col("l_partkey").alias("dst"))
    edges = lines.join(following, (F.col("l_orderkey") == F.col("o")) & (F.col("l_linenumber") == F.col("n"))).select(F.col("l_partkey").alias("src"), "dst").where("src <> dst").distinct()
    return graph.Graph(table(spark, d, "part").select(F.col("p_partkey").alias("id")), edges)


_TOGETHER = "WITH e AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey), u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e)"


@registry.query("G10_part_degrees", f"{_TOGETHER} SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY 1")
def g10(spark: SparkSession, d: str) -> DataFrame:
    return together(spark, d).degrees()


@registry.query("G11_part_triangles", f"{_TOGETHER}, t AS (SELECT p.a, p.b, q.b AS c FROM u p JOIN u q ON p.b = q.a JOIN u r ON r.a = p.a AND r.b = q.b), n AS (SELECT v, count(*) AS n FROM (SELECT unnest([a, b, c]) AS v FROM t) GROUP BY 1) SELECT p_partkey AS id, coalesce(n, 0) AS triangles FROM part LEFT JOIN n ON v = p_partkey")
def g11(spark: SparkSession, d: str) -> DataFrame:
    return graph.triangle_counts(together(spark, d))


@registry.query("G12_part_motif", f"{_TOGETHER} SELECT x.src AS a, x.dst AS b FROM e x JOIN e y ON x.dst = y.src AND x.src = y.dst")
def g12(spark: SparkSession, d: str) -> DataFrame:
    return together(spark, d).find("(a)-[]->(b); (b)-[]->(a)").select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


# ---- functions --------------------------------------------------------------------------------------------
@registry.query("X01_udf", "SELECT n_name, upper(n_name) || '!' AS loud FROM nation")
def x01(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_name", F.udf(udfs.shout)("n_name").alias("loud"))


@registry.query("X02_typed_udf", "SELECT p_partkey, p_size + 1 AS next FROM part")
def x02(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").withColumn("next", F.udf(lambda x: x + 1, T.IntegerType())("p_size")).select("p_partkey", "next")


@registry.query("X03_decorated_udf", "SELECT r_name, CAST(length(r_name) AS INTEGER) AS n FROM region")
def x03(spark: SparkSession, d: str) -> DataFrame:
    @F.udf("int")
    def size(s):
        return None if s is None else len(s)

    return table(spark, d, "region").select("r_name", size("r_name").alias("n"))


@registry.query("X04_sql_udf", "SELECT r_name, upper(r_name) || '!' AS loud FROM region")
def x04(spark: SparkSession, d: str) -> DataFrame:
    udfs.register(spark)
    table(spark, d, "region").createOrReplaceTempView("udf_region")
    return spark.sql("SELECT r_name, shout(r_name) AS loud FROM udf_region")


@registry.query("X05_pandas_udf", "SELECT s_suppkey, s_acctbal * 1.1::DOUBLE AS more FROM supplier")
def x05(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select("s_suppkey", udfs.plus_tenth()("s_acctbal").alias("more"))


@registry.query("X06_struct_udf", "SELECT n_nationkey, n_name[1] AS head, length(n_name) AS length FROM nation")
def x06(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", udfs.name_parts()("n_name").alias("p")).select("n_nationkey", "p.head", "p.length")


@registry.query("X07_partition_table", "SELECT p_partkey, unnest(string_split(p_type, ' ')) AS word FROM part")
def x07(spark: SparkSession, d: str) -> DataFrame:
    return udfs.word_rows(table(spark, d, "part"), "p_partkey", "p_type")


@registry.query("X08_pandas_aggregate", "SELECT c_nationkey, max(c_acctbal) - min(c_acctbal) AS span FROM customer GROUP BY 1")
def x08(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").groupBy("c_nationkey").agg(udfs.spread()("c_acctbal").alias("span"))


@registry.query("X09_table_function", "SELECT n_nationkey, unnest(range(0, CAST(n_nationkey % 3 + 1 AS BIGINT))) AS i FROM nation")
def x09(spark: SparkSession, d: str) -> DataFrame:
    """Beyond the reference: a Python table function, joined laterally."""
    spark.udtf.register("quern_upto", udfs.upto())
    table(spark, d, "nation").createOrReplaceTempView("udtf_nation")
    return spark.sql("SELECT n_nationkey, i FROM udtf_nation, LATERAL quern_upto(n_nationkey % 3 + 1)")


# ---- model text -------------------------------------------------------------------------------------------
# no letter but e, r and o themselves has one of them in its lower case, so the search is the same in both for any text
_CLASSIFIED = "SELECT doc_id, CASE WHEN contains(lower(text), 'error') THEN 'problem' WHEN text IS NOT NULL THEN 'normal' END AS reply FROM documents"


@registry.query("L01_row_classify", _CLASSIFIED)
def l01(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", model_text.per_row(model_text.Offline, "classify")("text").alias("reply"))


@registry.query("L03_batch_join_back", "SELECT doc_id, true AS full_batch FROM documents")
def l03(spark: SparkSession, d: str) -> DataFrame:
    """Every row with its batch's reply, which names as many records as the batch has rows; how rows fall into batches is
    no part of the result."""
    replies = model_text.batch_summaries(table(spark, d, "documents"), "doc_id", "text", model_text.Offline)
    sizes = replies.groupBy("batch_id").agg(F.count("*").alias("n"))
    return replies.join(sizes, "batch_id").select("doc_id", (F.col("reply").eqNullSafe(F.concat("n", F.lit(" records"))) & (F.col("n") <= 100)).alias("full_batch"))


@registry.query("L02_one_call", "SELECT 'problem' AS reply")
def l02(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(model_text.ask(model_text.Offline(), "classify\nAn error, again"),)], "reply string")


@registry.query("J24_join_batches_back", "SELECT count(*) AS n_rows, count(*) AS n_replies FROM documents")
def j24(spark: SparkSession, d: str) -> DataFrame:
    replies = model_text.batch_summaries(table(spark, d, "documents"), "doc_id", "text", model_text.Offline)
    return replies.agg(F.count("*").alias("n_rows"), F.count("reply").alias("n_replies"))


@registry.query("L06_validate_first", "SELECT 'SELECT r_name FROM guard_region' AS sql, true AS allowed UNION ALL SELECT 'DROP TABLE guard_region', false UNION ALL SELECT 'SELECT nope FROM guard_region', false")
def l06(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "region").createOrReplaceTempView("guard_region")
    tried = ("SELECT r_name FROM guard_region", "DROP TABLE guard_region", "SELECT nope FROM guard_region")
    return spark.createDataFrame([(t, questions.check(spark, t) is None) for t in tried], "sql string, allowed boolean")


@registry.query("L07_modes", "SELECT * FROM (VALUES ('insight'), ('sql'), ('explain_sql')) AS t(mode)")
def l07(spark: SparkSession, d: str) -> DataFrame:
    region = {"mode_region": table(spark, d, "region")}
    answers = {m: questions.answer(spark, lambda _: "SELECT count(*) AS n FROM mode_region", "How many?", region, m) for m in questions.Mode}
    return spark.createDataFrame([(m.value,) for m, a in answers.items() if not a.error and (a.text or a.rows is not None)], "mode string")


@registry.query("L10_broadcast_config", _CLASSIFIED)
def l10(spark: SparkSession, d: str) -> DataFrame:
    """The task comes from a broadcast variable that each worker reads."""
    config = spark.sparkContext.broadcast({"task": "classify"})
    return table(spark, d, "documents").repartition(16).select("doc_id", model_text.per_row(model_text.Offline, lambda: config.value["task"])("text").alias("reply"))


@registry.query("L12_english_transform", "SELECT r_name FROM region WHERE r_regionkey < 3")
def l12(spark: SparkSession, d: str) -> DataFrame:
    return questions.transform(table(spark, d, "region"), "keep the first three, names only", lambda _: "SELECT r_name FROM this WHERE r_regionkey < 3")


@registry.query("L13_chart_rows", "SELECT o_orderpriority AS label, count(*) AS n FROM orders GROUP BY 1")
def l13(spark: SparkSession, d: str) -> DataFrame:
    """The bounded rows behind a bar or pie chart."""
    counted = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("label")).agg(F.count("*").alias("n"))
    return spark.createDataFrame(files.to_records(counted, 100), "label string, n bigint")


@registry.query("L04_partition_batches", "SELECT count(*) AS n_rows, true AS whole_batches FROM documents")
def l04(spark: SparkSession, d: str) -> DataFrame:
    """Replies name the size of their batch, at most 100, so rows with the same reply come in multiples of it."""
    replies = model_text.per_batch(table(spark, d, "documents"), "doc_id", "text", model_text.Offline)
    size = F.split("reply", " ")[0].cast("bigint")
    sizes = replies.groupBy(size.alias("size")).agg(F.count("*").alias("n"))
    return sizes.agg(F.sum("n").alias("n_rows"), F.bool_and((F.col("n") % F.col("size") == 0) & (F.col("size") <= 100)).alias("whole_batches"))


_QUESTION_SQL = "SELECT n_name, count(*) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name"


@registry.query("L05_question_to_sql", _QUESTION_SQL)
def l05(spark: SparkSession, d: str) -> DataFrame:
    client = lambda prompt: f"Here is the query:\n```sql\n{_QUESTION_SQL};\n```\nIt counts suppliers."
    reply = questions.answer(spark, client, "How many suppliers has each nation?", {n: table(spark, d, n) for n in ("supplier", "nation")})
    if reply.error:
        raise ValueError(reply.error)
    return reply.rows


@registry.query("L08_struct_reply", "SELECT doc_id, coalesce(length(text), 0) AS n FROM documents")
def l08(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", model_text.parsed_rows(model_text.Offline)("text").alias("x")).select("doc_id", F.col("x.length").alias("n"))


@registry.query("L09_retries", "SELECT doc_id FROM documents WHERE contains(lower(text), 'error')")
def l09(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth call fails once and is tried again; texts with a refused word fail for good and come out marked."""
    make = lambda: model_text.Offline(fail_every=5, refuse="error")
    replies = table(spark, d, "documents").select("doc_id", model_text.per_row(make, "summarize", tries=4)("text").alias("reply"))
    return model_text.failures(replies, "reply").select("doc_id")


@registry.query(
    "L11_nearest_vectors",
    "SELECT query, neighbour, round(c, 6) AS cosine FROM (SELECT q.vec_id AS query, v.vec_id AS neighbour, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS c FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0) QUALIFY row_number() OVER (PARTITION BY query ORDER BY c DESC, neighbour) <= 5",
)
def l11(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    return vectors.nearest(rows, rows.where("vec_id % 20 = 0"), "vec_id", "embedding").withColumn("cosine", F.round("cosine", 6))


# ---- streams and recommendations --------------------------------------------------------------------------
@registry.query("Z01_tumbling", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def z01(spark: SparkSession, d: str) -> DataFrame:
    return windows.run_to_end(windows.file_stream(spark, d, "events"), "ts", lambda s: windows.tumbling_counts(s, "ts", "event_type"))


@registry.query("Z02_sliding", "SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM events) GROUP BY 1")
def z02(spark: SparkSession, d: str) -> DataFrame:
    return windows.run_to_end(windows.file_stream(spark, d, "events"), "ts", lambda s: windows.sliding_counts(s, "ts"))


@registry.query(
    "Z03_sessions",
    "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 1800000000 THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY user_id, s",
)
def z03(spark: SparkSession, d: str) -> DataFrame:
    return windows.run_to_end(windows.file_stream(spark, d, "events"), "ts", lambda s: windows.session_counts(s, "ts", "user_id"))


@registry.query("B01_recommendations")
def b01(spark: SparkSession, d: str) -> DataFrame:
    bought = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    return recommend.recommend(bought, "o_custkey", "l_suppkey", "q")


# ---- views, caching, partitions ---------------------------------------------------------------------------
@registry.query("V01_global_view", "SELECT count(*) AS n FROM nation")
def v01(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "nation").createOrReplaceGlobalTempView("quern_nation")
    return spark.sql("SELECT count(*) AS n FROM global_temp.quern_nation")


@registry.query("V02_partition_sizes", "SELECT count(*) AS n, CAST(4 AS BIGINT) AS parts FROM customer")
def v02(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "customer").repartition(4).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"))
    return parts.agg(F.sum("n").alias("n"), F.count("*").alias("parts"))


@registry.query("V03_cached_view", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def v03(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "customer").createOrReplaceTempView("quern_customer")
    spark.sql("CACHE LAZY TABLE quern_customer")
    return spark.sql("WITH c AS (SELECT c_mktsegment FROM quern_customer) SELECT c_mktsegment, count(*) AS n FROM c GROUP BY 1")


@registry.query("V04_derived_table", "SELECT avg(n) AS a FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) t")
def v04(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "orders").createOrReplaceTempView("quern_orders")
    return spark.sql("SELECT avg(n) AS a FROM (SELECT o_custkey, count(*) AS n FROM quern_orders GROUP BY 1) t")
