"""Queries of the relational core: projection, filters, joins, aggregation, windows, sorting, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators import joins, keyed
from quern.plans.registry import Registry, table
from quern.sources import files
from quern.staging import scratch_path

registry = Registry()


def on(name: str, query: str, sql: str, make) -> None:
    """Register ``query`` over one table: ``make`` gets its DataFrame."""
    registry.add(query, lambda spark, d: make(table(spark, d, name)), sql)


def over(names: str, query: str, sql: str | None, make) -> None:
    """Register ``query`` over several tables, given in order."""
    registry.add(query, lambda spark, d: make(*[table(spark, d, n) for n in names.split()]), sql)


def in_sql(query: str, text: str, tables: str, sql: str | None = None) -> None:
    """Register a query that is SQL text in Spark too, over temporary views."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        for n in tables.split():
            table(spark, d, n).createOrReplaceTempView(n)
        return spark.sql(text)

    registry.add(query, run, sql or text)


# ---- projection and columns -------------------------------------------------------------------------------
on("nation", "PR01_select", "SELECT n_nationkey, n_name FROM nation", lambda t: t.select("n_nationkey", F.col("n_name")))
on("nation", "PR02_select_expr", "SELECT n_nationkey AS k, upper(n_name) AS u FROM nation", lambda t: t.selectExpr("n_nationkey AS k", "upper(n_name) AS u"))
on(
    "part", "PR03_expr", "SELECT p_partkey, p_size * 2 AS twice, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS label FROM part",
    lambda t: t.select("p_partkey", F.expr("p_size * 2 AS twice"), F.expr("IF(p_size > 25, 'big', 'small') AS label")),
)
on(
    "customer", "PR04_with_column", "SELECT c_custkey, upper(c_name) AS c_name, c_acctbal * 2 AS twice FROM customer",
    lambda t: t.withColumn("twice", F.col("c_acctbal") * 2).withColumn("c_name", F.upper("c_name")).select("c_custkey", "c_name", "twice"),
)
on("region", "PR05_rename", "SELECT r_regionkey AS id, r_name AS r_name FROM region", lambda t: t.withColumnRenamed("r_regionkey", "id"))
on("nation", "PR06_drop", "SELECT n_name FROM nation", lambda t: t.drop("n_nationkey", t.n_regionkey))
on("supplier", "PR07_alias", "SELECT s_suppkey AS supplier, s_acctbal AS balance FROM supplier", lambda t: t.select(F.col("s_suppkey").alias("supplier"), F.col("s_acctbal").alias("balance")))
on(
    "customer", "PR08_case", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS grade FROM customer",
    lambda t: t.select("c_custkey", F.when(F.col("c_acctbal") < 0, "debt").when(F.col("c_acctbal") < 5000, "low").otherwise("high").alias("grade")),
)
on("customer", "PR09_boolean_column", "SELECT c_custkey, true AS rich FROM customer WHERE c_acctbal > 5000", lambda t: t.withColumn("rich", F.col("c_acctbal") > 5000).filter("rich").select("c_custkey", "rich"))
on("nation", "PR10_struct_field", "SELECT n_nationkey AS k, n_name AS label FROM nation", lambda t: t.select(F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("label")).alias("s")).select("s.k", "s.label"))
on("orders", "PR11_cast", "SELECT o_orderkey, CAST(trunc(o_totalprice) AS INTEGER) AS whole FROM orders", lambda t: t.select("o_orderkey", F.col("o_totalprice").cast("int").alias("whole")))
on("region", "PR12_map_rows", "SELECT r_name || '!' AS loud, CAST(length(r_name) AS BIGINT) AS n FROM region", lambda t: t.select(F.concat("r_name", F.lit("!")).alias("loud"), F.length("r_name").cast("bigint").alias("n")))
on("part", "PR13_flat_map", "SELECT p_partkey, unnest(string_split(p_type, ' ')) AS word FROM part", lambda t: t.select("p_partkey", F.explode(F.split("p_type", " ")).alias("word")))
on("customer", "PR14_map_values", "SELECT c_custkey, c_acctbal + 1 AS c_acctbal FROM customer", lambda t: t.select("c_custkey", "c_acctbal").withColumn("c_acctbal", F.col("c_acctbal") + 1))
on("region", "PR17_identity", "SELECT r_regionkey, r_name FROM region", lambda t: t.select("r_regionkey", "r_name"))


def _schema_rows(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(n, k) for n, k in table(spark, d, "nation").dtypes], "column_name string, kind string")


registry.add("PR18_schema", _schema_rows, "SELECT * FROM (VALUES ('n_nationkey', 'int'), ('n_name', 'string'), ('n_regionkey', 'int')) AS t(column_name, kind)")

# ---- filters ----------------------------------------------------------------------------------------------
on("part", "F01_compare", "SELECT p_partkey FROM part WHERE p_size > 10 AND p_size < 20 AND p_brand <> 'Brand#1'", lambda t: t.filter((F.col("p_size") > 10) & (F.col("p_size") < 20) & (F.col("p_brand") != "Brand#1")).select("p_partkey"))
on("orders", "F02_and_or_not", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 100000) AND NOT o_orderpriority = '1-URGENT'", lambda t: t.filter(((F.col("o_orderstatus") == "F") | (F.col("o_totalprice") > 100000)) & ~(F.col("o_orderpriority") == "1-URGENT")).select("o_orderkey"))
on("documents", "F03_nulls", "SELECT doc_id, lang IS NULL AS no_lang FROM documents WHERE title IS NOT NULL", lambda t: t.filter(F.col("title").isNotNull()).select("doc_id", F.col("lang").isNull().alias("no_lang")))
on("customer", "F04_isin", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3)", lambda t: t.filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & ~F.col("c_nationkey").isin(1, 2, 3)).select("c_custkey"))
on("part", "F05_between", "SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 9", lambda t: t.filter(F.col("p_size").between(5, 9)).select("p_partkey"))
on("nation", "F06_like", "SELECT n_name FROM nation WHERE n_name LIKE '%A%'", lambda t: t.filter(F.col("n_name").like("%A%")).select("n_name"))
on("documents", "F07_rlike", "SELECT doc_id FROM documents WHERE regexp_matches(text, '^[A-Z]')", lambda t: t.filter(F.col("text").rlike("^[A-Z]")).select("doc_id"))
on("documents", "F08_startswith", "SELECT doc_id FROM documents WHERE starts_with(text, '# ')", lambda t: t.filter(F.col("text").startswith("# ")).select("doc_id"))
on("orders", "F09_sql_predicate", "SELECT o_orderkey FROM orders WHERE o_totalprice > 150000 AND o_orderstatus = 'O'", lambda t: t.filter("o_totalprice > 150000 AND o_orderstatus = 'O'").select("o_orderkey"))
in_sql("F10_where_having", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY o_custkey HAVING n > 3", "orders", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY o_custkey HAVING count(*) > 3")
on("events", "F11_predicate_even", "SELECT event_id, event_id * event_id AS square FROM events WHERE event_id % 2 = 0", lambda t: t.where(F.col("event_id") % 2 == 0).select("event_id", (F.col("event_id") * F.col("event_id")).alias("square")))
on("documents", "F14_contains_folded", "SELECT doc_id FROM documents WHERE contains(lower(text), 'error')", lambda t: t.where(F.lower("text").contains("error")).select("doc_id"))
on("documents", "F15_not_empty", "SELECT doc_id FROM documents WHERE length(text) > 0", lambda t: t.where(F.length("text") > 0).select("doc_id"))
on("scu_continents_2", "F16_text_as_number", "SELECT rec_id FROM scu_continents_2 WHERE TRY_CAST(trim(substr(sdata, 2)) AS BIGINT) > 30000 AND regexp_full_match(sdata, 'd[0-9]+')", lambda t: t.where(F.col("sdata").rlike(r"\Ad[0-9]+\z") & (F.try_to_number(F.substring("sdata", 2, 40), F.lit("9" * 38)) > 30000)).select("rec_id"))
in_sql("F18_not_in", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)", "customer orders")


@registry.query("F20_drop_malformed", "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 7 > 1")
def f20(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a file, one in seven with a word for the balance and one in seven without any; the reader drops those."""
    k = F.col("s_suppkey") % 7
    balance = F.when(k == 0, "unknown").when(k > 1, F.col("s_acctbal").cast("string"))
    lines = table(spark, d, "supplier").select(F.concat_ws(",", F.col("s_suppkey").cast("string"), "s_name", balance))
    path = files.write_any(lines, "text", scratch_path(spark, "malformed"))
    return files.read_csv(spark, path, schema="s_suppkey bigint, s_name string, s_acctbal double", header=False, strict=True).select("s_suppkey", "s_name")


# ---- joins ------------------------------------------------------------------------------------------------
over("nation region", "J01_inner_using", "SELECT n_nationkey AS k, n_name, r_name FROM nation JOIN region ON n_nationkey = r_regionkey", lambda n, r: n.select(F.col("n_nationkey").alias("k"), "n_name").join(r.select(F.col("r_regionkey").alias("k"), "r_name"), "k"))
for _name, _how in (("J02_left", "left"), ("J03_right", "right"), ("J04_full", "full")):
    over(
        "customer orders", _name, f"SELECT c_custkey, o_orderkey FROM customer {_how.upper()} JOIN orders ON c_custkey = o_custkey AND o_totalprice > 100000",
        lambda c, o, how=_how: c.join(o, (c.c_custkey == o.o_custkey) & (o.o_totalprice > 100000), how).select("c_custkey", "o_orderkey"),
    )
over("nation region", "J05_cross", "SELECT n_name, r_name FROM nation CROSS JOIN region", lambda n, r: n.crossJoin(r).select("n_name", "r_name"))
over("customer orders", "J06_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)", lambda c, o: c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey"))
over("customer orders", "J07_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)", lambda c, o: c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey"))
over("nation region", "J08_expression", "SELECT n_regionkey, r_regionkey, n_name FROM nation JOIN region ON n_regionkey = r_regionkey", lambda n, r: n.join(r, n.n_regionkey == r.r_regionkey).select("n_regionkey", "r_regionkey", "n_name"))
over("customer supplier", "J09_multi_key", "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_custkey = s_suppkey", lambda c, s: c.withColumnsRenamed({"c_nationkey": "nk", "c_custkey": "k"}).join(s.withColumnsRenamed({"s_nationkey": "nk", "s_suppkey": "k"}), ["nk", "k"]).select(F.col("k").alias("c_custkey"), F.col("k").alias("s_suppkey")))
over("customer nation", "J10_broadcast", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey", lambda c, n: joins.small_side(c, n, c.c_nationkey == n.n_nationkey).select("c_custkey", "n_name"))
in_sql("J11_comma", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey", "nation region")
over("nation nation", "J12_self", "SELECT a.n_name AS one, b.n_name AS two FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey", lambda a, b: a.alias("a").join(b.alias("b"), F.col("a.n_regionkey") == F.col("b.n_regionkey")).select(F.col("a.n_name").alias("one"), F.col("b.n_name").alias("two")))
in_sql("J13_comma_cross", "SELECT a.r_name AS one, b.r_name AS two FROM region a, region b", "region")
in_sql("J14_natural", "SELECT k, n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) NATURAL JOIN (SELECT r_regionkey AS k, r_name FROM region)", "nation region")
in_sql("J15_sql_left", "SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_name LIKE 'C%'", "supplier nation")
for _name, _how in (("J16_pair_join", "inner"), ("J17_pair_left", "left"), ("J18_pair_right", "right"), ("J19_pair_full", "full")):
    over(
        "supplier customer", _name,
        f"SELECT coalesce(a.k, b.k) AS k, v, w FROM (SELECT s_nationkey AS k, count(*) AS v FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) a {_how.upper()} JOIN (SELECT c_nationkey AS k, count(*) AS w FROM customer WHERE c_acctbal < -900 GROUP BY 1) b ON a.k = b.k",
        lambda s, c, how=_how: s.where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("v")).join(c.where("c_acctbal < -900").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("w")), "k", how).select("k", "v", "w"),
    )
over(
    "nation supplier", "J20_cogroup",
    "SELECT n_nationkey AS k, (SELECT list(n_name ORDER BY n_name) FROM nation m WHERE m.n_nationkey = n.n_nationkey) AS lefts, coalesce((SELECT list(s_suppkey ORDER BY s_suppkey) FROM supplier WHERE s_nationkey = n_nationkey), []) AS rights FROM nation n",
    lambda n, s: joins.cogroup(n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v")), s.select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("v")), "k", "v"),
)
over("region region", "J21_cartesian", "SELECT a.r_regionkey AS one, b.r_regionkey AS two FROM region a CROSS JOIN region b", lambda a, b: a.select(F.col("r_regionkey").alias("one")).crossJoin(b.select(F.col("r_regionkey").alias("two"))))
over(
    "customer orders", "J22_reduce_side", "SELECT c_custkey AS k, c_name AS l, o_orderkey AS r FROM customer JOIN orders ON c_custkey = o_custkey",
    lambda c, o: joins.reduce_side_join(c.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("l")), o.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("r")), "k", "l", "r"),
)
over("employees departments", "J23_map_side", "SELECT row_id, d.n FROM employees JOIN (SELECT id, count(*) AS n FROM departments GROUP BY 1) d ON department_id = d.id", lambda e, p: joins.small_side(e, g := p.groupBy("id").agg(F.count("*").alias("n")), e.department_id == g.id).select("row_id", "n"))
for _hint in ("merge", "broadcast", "shuffle_hash"):
    over("orders customer", f"J25_{_hint}", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey", lambda o, c, h=_hint: o.join(c.hint(h), o.o_custkey == c.c_custkey).select("o_orderkey", "c_name"))
over("lineitem orders", "J26_salted", "SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey", lambda l, o: joins.salted_join(l.select("l_orderkey", "l_linenumber"), o.select("o_orderkey", "o_custkey"), "l_orderkey", "o_orderkey").select("l_orderkey", "l_linenumber", "o_custkey"))

# ---- aggregation ------------------------------------------------------------------------------------------
_MONEY = "CAST(sum(CAST({c} AS DECIMAL(18,2))) AS DOUBLE)"


def money(column: str):
    """An exact sum of amounts with cents, as a double."""
    return F.sum(F.col(column).cast("decimal(18,2)")).cast("double")


on("orders", "A01_count", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1", lambda t: t.groupBy("o_orderstatus").agg(F.count("*").alias("n")))
on("orders", "A02_avg_max_min", "SELECT o_orderpriority, round(avg(o_totalprice), 4) AS a, max(o_totalprice) AS hi, min(o_totalprice) AS lo FROM orders GROUP BY 1", lambda t: t.groupBy("o_orderpriority").agg(F.round(F.avg("o_totalprice"), 4).alias("a"), F.max("o_totalprice").alias("hi"), F.min("o_totalprice").alias("lo")))
on("part", "A03_dict", "SELECT p_brand, max(p_size) AS \"max(p_size)\", count(*) AS \"count(1)\" FROM part GROUP BY 1", lambda t: t.groupBy("p_brand").agg({"p_size": "max", "*": "count"}))
on("customer", "A04_stddev", "SELECT c_mktsegment, round(stddev(c_acctbal), 4) AS sd, count(*) AS n FROM customer GROUP BY 1", lambda t: t.groupBy("c_mktsegment").agg(F.round(F.stddev("c_acctbal"), 4).alias("sd"), F.count("*").alias("n")))
on("lineitem", "A05_sum", f"SELECT l_returnflag, l_linestatus, {_MONEY.format(c='l_quantity')} AS q, {_MONEY.format(c='l_extendedprice')} AS p FROM lineitem GROUP BY 1, 2", lambda t: t.groupBy("l_returnflag", "l_linestatus").agg(money("l_quantity").alias("q"), money("l_extendedprice").alias("p")))
on("orders", "A06_having", f"SELECT o_custkey, {_MONEY.format(c='o_totalprice')} AS s FROM orders GROUP BY 1 HAVING s > 500000", lambda t: t.groupBy("o_custkey").agg(money("o_totalprice").alias("s")).where("s > 500000"))
on("orders", "A07_order_by_agg", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, 1", lambda t: t.groupBy("o_orderpriority").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "o_orderpriority"))
on("events", "A08_count_distinct", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1", lambda t: t.groupBy("event_type").agg(F.countDistinct("user_id").alias("users")))
on("events", "A09_approx_distinct", None, lambda t: t.groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("users")))
on(
    "lineitem", "A10_pivot", "SELECT l_returnflag, CAST(sum(l_quantity) FILTER (WHERE l_linestatus = 'F') AS DOUBLE) AS F, CAST(sum(l_quantity) FILTER (WHERE l_linestatus = 'O') AS DOUBLE) AS O FROM lineitem GROUP BY 1",
    lambda t: t.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).sum("l_quantity"),
)
on("customer", "A11_rollup", "SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ROLLUP (c_nationkey, c_mktsegment)", lambda t: t.rollup("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n")))
on("customer", "A12_cube", "SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY CUBE (c_nationkey, c_mktsegment)", lambda t: t.cube("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n")))
on("customer", "A13_global_min", "SELECT min(c_acctbal) AS lo FROM customer", lambda t: t.groupBy().agg(F.min("c_acctbal").alias("lo")))
on("part", "A14_describe", "SELECT count(p_retailprice) AS n, round(avg(p_retailprice), 4) AS mean, round(stddev(p_retailprice), 4) AS sd, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part", lambda t: t.agg(F.count("p_retailprice").alias("n"), F.round(F.mean("p_retailprice"), 4).alias("mean"), F.round(F.stddev("p_retailprice"), 4).alias("sd"), F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi")))


@registry.query("A14_describe_rows", "SELECT unnest(['count', 'mean', 'stddev', 'min', 'max']) AS summary, round(unnest([count(p_retailprice), avg(p_retailprice), stddev(p_retailprice), min(p_retailprice), max(p_retailprice)]), 4) AS value FROM part")
def a14_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").describe("p_retailprice").select("summary", F.round(F.col("p_retailprice").cast("double"), 4).alias("value"))


def _quartiles(t: DataFrame, column: str, found: dict[float, float], error: float) -> DataFrame:
    """``(p, near)``: whether the share of rows below each found value and up to it takes in ``p``, but for ``error``."""
    v = F.col(column)
    tests = [F.struct(F.lit(p).alias("p"), ((F.avg((v < x).cast("int")) <= p + error) & (F.avg((v <= x).cast("int")) >= p - error)).alias("near")) for p, x in found.items()]
    return t.agg(F.array(*tests).alias("t")).select(F.inline("t"))


@registry.query("A15_summary", "SELECT unnest([0.25, 0.5, 0.75])::DOUBLE AS p, true AS near, max(p_retailprice) AS most, count(*) AS n FROM part")
def a15(spark: SparkSession, d: str) -> DataFrame:
    """Quartiles of ``summary`` are approximate: what is compared is that their ranks are right to one in a thousand."""
    t = table(spark, d, "part")
    rows = {r["summary"]: float(r["p_retailprice"]) for r in t.select("p_retailprice").summary("count", "25%", "50%", "75%", "max").collect()}
    near = _quartiles(t, "p_retailprice", {p: rows[f"{p:.0%}"] for p in (0.25, 0.5, 0.75)}, 0.001)
    return near.select("*", F.lit(rows["max"]).alias("most"), F.lit(int(rows["count"])).cast("bigint").alias("n"))

on("documents", "A16_null_counts", "SELECT " + ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS {c}" for c in ("text", "lang", "source", "title")) + " FROM documents", lambda t: t.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in ("text", "lang", "source", "title")]))
on("nation", "A17_collect_list", "SELECT n_regionkey, list(n_name ORDER BY n_name) AS names FROM nation GROUP BY 1", lambda t: t.groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("names")))
on("customer", "A18_distinct", "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer", lambda t: t.select("c_nationkey", "c_mktsegment").dropDuplicates(["c_nationkey", "c_mktsegment"]))
on("orders", "A31_max_per_key", "SELECT o_custkey, max(o_totalprice) AS most FROM orders GROUP BY 1", lambda t: t.groupBy("o_custkey").agg(F.max("o_totalprice").alias("most")))
on("scu_continents_1", "A30_median", "SELECT country, median(ndata) AS m FROM scu_continents_1 WHERE ndata IS NOT NULL GROUP BY 1", lambda t: keyed.exact_medians(t, "country", "ndata", "m"))
on("orders", "A37_histogram", "SELECT CAST(floor(o_totalprice / 10000) * 10000 AS BIGINT) AS lo, count(*) AS n FROM orders GROUP BY 1", lambda t: t.groupBy((F.floor(F.col("o_totalprice") / 10000) * 10000).cast("bigint").alias("lo")).agg(F.count("*").alias("n")))
over(
    "lineitem orders customer nation region", "A40_revenue",
    "SELECT r_name, o_orderpriority, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2",
    lambda l, o, c, n, r: l.join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).groupBy("r_name", "o_orderpriority").agg(money("l_extendedprice").alias("revenue")),
)
on("continents_countries_temp", "A41_avg_temperature", "SELECT continent, country, round(avg(temperature), 6) AS t FROM continents_countries_temp GROUP BY 1, 2", lambda t: t.groupBy("continent", "country").agg(F.round(F.avg("temperature"), 6).alias("t")))
on("events", "A43_conditional_avg", "SELECT user_id, round(avg(value), 6) AS a FROM events WHERE event_type = 'purchase' GROUP BY 1", lambda t: t.where("event_type = 'purchase'").groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("a")))

# ---- windows ----------------------------------------------------------------------------------------------
def _w():
    return Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")



_W = "OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)"
on("orders", "W02_row_number", f"SELECT o_orderkey, row_number() {_W} AS rn FROM orders", lambda t: t.select("o_orderkey", F.row_number().over(_w()).cast("bigint").alias("rn")))
def _p():
    return Window.partitionBy("p_brand").orderBy(F.desc("p_size"))



_P = "OVER (PARTITION BY p_brand ORDER BY p_size DESC)"
on("part", "W03_rank", f"SELECT p_partkey, rank() {_P} AS r FROM part", lambda t: t.select("p_partkey", F.rank().over(_p()).cast("bigint").alias("r")))
on("part", "W04_dense_rank", f"SELECT p_partkey, dense_rank() {_P} AS r FROM part", lambda t: t.select("p_partkey", F.dense_rank().over(_p()).cast("bigint").alias("r")))
on("orders", "W05_top_n", f"SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() {_W} <= 2", lambda t: t.withColumn("rn", F.row_number().over(_w())).where("rn <= 2").select("o_custkey", "o_orderkey"))
on("part", "W06_running", f"SELECT p_partkey, CAST(sum(p_size) {_P} AS BIGINT) AS s FROM part", lambda t: t.select("p_partkey", F.sum("p_size").over(_p()).alias("s")))
on("orders", "W07_lag_lead", f"SELECT o_orderkey, lag(o_totalprice) {_W} AS before, lead(o_totalprice) {_W} AS after FROM orders", lambda t: t.select("o_orderkey", F.lag("o_totalprice").over(_w()).alias("before"), F.lead("o_totalprice").over(_w()).alias("after")))
on("supplier", "W01_ordered_partition", "SELECT s_suppkey, first_value(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS richest FROM supplier", lambda t: t.select("s_suppkey", F.first("s_suppkey").over(Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")).alias("richest")))
on("customer", "W08_lead", "SELECT c_custkey, lead(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS next FROM customer", lambda t: t.select("c_custkey", F.lead("c_custkey").over(Window.partitionBy("c_nationkey").orderBy("c_custkey")).alias("next")))
on("part", "W09_percent_rank", f"SELECT p_partkey, round(percent_rank() {_P}, 6) AS r FROM part", lambda t: t.select("p_partkey", F.round(F.percent_rank().over(_p()), 6).alias("r")))
on("orders", "W10_ntile", f"SELECT o_orderkey, ntile(3) {_W} AS part FROM orders", lambda t: t.select("o_orderkey", F.ntile(3).over(_w()).cast("bigint").alias("part")))
def _by():
    return Window.partitionBy("o_custkey")


on(
    "orders", "W11_from_mean", "SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * count(*) OVER w - sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER w AS DOUBLE) / count(*) OVER w AS off FROM orders WINDOW w AS (PARTITION BY o_custkey)",
    lambda t: t.select("o_orderkey", ((F.col("o_totalprice").cast("decimal(18,2)") * F.count("*").over(_by()) - F.sum(F.col("o_totalprice").cast("decimal(18,2)")).over(_by())).cast("double") / F.count("*").over(_by())).alias("off")),
)
on("orders", "W12_rows_between", f"SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 4) AS a FROM orders", lambda t: t.select("o_orderkey", F.round(F.avg("o_totalprice").over(_w().rowsBetween(-1, 1)), 4).alias("a")))

# ---- sort, limit, sample ----------------------------------------------------------------------------------
on("customer", "T01_order_by", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey", lambda t: t.orderBy("c_mktsegment", F.desc("c_acctbal"), "c_custkey").select("c_custkey", "c_acctbal"))
in_sql("T02_sql_order_by", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey", "supplier")
in_sql("T03_limit", "SELECT s_suppkey FROM supplier ORDER BY s_acctbal, s_suppkey LIMIT 10", "supplier")
registry.add("T04_take", lambda spark, d: spark.createDataFrame((t := table(spark, d, "nation").orderBy("n_nationkey")).take(5), t.schema), "SELECT * FROM nation ORDER BY n_nationkey LIMIT 5")
on("customer", "T05_take_ordered", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 5", lambda t: t.select("c_custkey", "c_acctbal").orderBy("c_acctbal", "c_custkey").limit(5))
on("customer", "T06_top", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5", lambda t: t.select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(5))
on("orders", "T07_sort_by_take", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", lambda t: t.select("o_orderkey", "o_totalprice").sort("o_totalprice", "o_orderkey", ascending=[False, True]).limit(10))
on("part", "T08_sort_by_key", "SELECT p_size, count(*) AS n FROM part GROUP BY 1 ORDER BY 1", lambda t: t.groupBy("p_size").agg(F.count("*").alias("n")).orderBy("p_size"))
on("orders", "T09_sample", None, lambda t: t.sample(0.1, seed=7).select("o_orderkey"))


@registry.query("T10_approx_quantile", "SELECT unnest([0.25, 0.5, 0.75])::DOUBLE AS p, true AS near")
def t10(spark: SparkSession, d: str) -> DataFrame:
    t, shares = table(spark, d, "orders"), (0.25, 0.5, 0.75)
    return _quartiles(t, "o_totalprice", dict(zip(shares, t.approxQuantile("o_totalprice", list(shares), 0.01))), 0.01)


# ---- set operations ---------------------------------------------------------------------------------------
over("customer supplier", "U01_union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier", lambda c, s: c.select(F.col("c_nationkey").alias("k")).union(s.select("s_nationkey")))
over("customer supplier", "U02_tagged_union", "SELECT k, src, count(*) AS n FROM (SELECT c_nationkey AS k, 'c' AS src FROM customer UNION ALL SELECT s_nationkey, 's' FROM supplier) GROUP BY 1, 2", lambda c, s: c.select(F.col("c_nationkey").alias("k"), F.lit("c").alias("src")).unionByName(s.select(F.col("s_nationkey").alias("k"), F.lit("s").alias("src"))).groupBy("k", "src").agg(F.count("*").alias("n")))
on("orders", "U03_distinct", "SELECT DISTINCT o_orderpriority FROM orders", lambda t: t.select("o_orderpriority").distinct())
over(
    "customer supplier", "U04_list_intersection",
    "SELECT c.k, list_sort(list_intersect(a, b)) AS both FROM (SELECT c_mktsegment AS k, list(DISTINCT c_nationkey) AS a FROM customer GROUP BY 1) c, (SELECT list(DISTINCT s_nationkey) AS b FROM supplier WHERE s_acctbal < 0) s",
    lambda c, s: c.groupBy(F.col("c_mktsegment").alias("k")).agg(F.collect_set("c_nationkey").alias("a")).select("k", F.sort_array(F.array_intersect("a", s.where("s_acctbal < 0").agg(F.collect_set("s_nationkey")).scalar())).alias("both")),
)
over("customer nation", "U05_exclusion_list", "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)", lambda c, n: joins.small_side(c, n.where("n_regionkey = 0"), c.c_nationkey == n.n_nationkey, "left_anti").select("c_custkey"))
