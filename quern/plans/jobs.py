"""Queries of the text jobs, keyed jobs and scalar functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as words
from quern.operators import keyed
from quern.plans.registry import Registry, table

registry = Registry()


def on(name: str, query: str, sql: str | None, make) -> None:
    registry.add(query, lambda spark, d: make(table(spark, d, name)), sql)


def _lines(t: DataFrame, *keep: str) -> DataFrame:
    return words.lines(t, "text", *keep)


# ---- text jobs --------------------------------------------------------------------------------------------
_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents"
_SPLIT = r"unnest(list_filter(string_split_regex({x}, '[ \t\r]+'), lambda w: w <> ''))"
_FOLDED = f"SELECT {_SPLIT.format(x='lower(line)')} AS word FROM ({_LINES})"
on("documents", "M01_classic_word_count", f"SELECT regexp_replace(w, '[,.;]$', '') AS word, count(*) AS n FROM (SELECT {_SPLIT.format(x='trim(line)')} AS w FROM ({_LINES}) WHERE length(trim(line)) >= 3) WHERE length(w) >= 3 GROUP BY 1", lambda t: words.count_words(words.classic_words(_lines(t), "line")))
on("documents", "M02_filtered_word_count", f"SELECT word, count(*) AS n FROM ({_FOLDED}) WHERE length(word) > 2 GROUP BY 1 HAVING count(*) > 2", lambda t: words.count_words(words.folded_words(_lines(t), "line", 2), least=3))
on("documents", "M03_word_count", f"SELECT word, count(*) AS n FROM (SELECT {_SPLIT.format(x='line')} AS word FROM ({_LINES})) GROUP BY 1", lambda t: words.count_words(_lines(t).select(F.explode(words.split_blanks(F.col("line"))).alias("word"))))
on("documents", "M03_word_count_at_least_2", f"SELECT word, count(*) AS n FROM ({_FOLDED}) GROUP BY 1 HAVING count(*) >= 2", lambda t: words.count_words(words.folded_words(_lines(t).where(F.length("line") > 0), "line"), least=2))
# by code points, as in Spark
_BACKWARDS = "array_to_string(list_reverse(list_transform(range(1, length({x}) + 1), lambda i: substr({x}, i, 1))), '')"
_LEVELS = " UNION ALL ".join(f"SELECT '{x}' AS level, count(*) AS n FROM ({_LINES}) WHERE contains(lower(line), '{x}')" for x in ("error", "exception", "warning"))
on("documents", "M04_log_levels", _LEVELS, lambda t: words.level_counts(_lines(t), "line"))
on(
    "scu_continents_1", "M05_call_minutes",
    "SELECT country, CAST(sum(CAST(floor((epoch_us(arrived_at) - epoch_us(recorded_at)) / 60000000.0) AS BIGINT)) AS BIGINT) AS minutes FROM scu_continents_1 WHERE ndata > 100 GROUP BY 1 HAVING minutes >= 60",
    lambda t: keyed.call_minutes(t, "country", "recorded_at", "arrived_at", F.col("ndata") > 100),
)
on(
    "orders", "M06_top_item", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 0 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1",
    lambda t: keyed.best_per_key(t, "o_custkey", "o_orderkey", "o_totalprice"),
)
on("documents", "M07_palindromes", f"SELECT word, count(*) AS n FROM ({_FOLDED}) WHERE length(word) >= 3 AND word = {_BACKWARDS.format(x='word')} GROUP BY 1", lambda t: words.palindromes(words.folded_words(_lines(t), "line", 2)))


def _friends(t: DataFrame) -> DataFrame:
    """Suppliers whose numbers differ by 1, 2, 3 or 7 know each other."""
    ids = t.select(F.col("s_suppkey").alias("person"))
    near = ids.select("person", F.explode(F.array(*[F.lit(k) for k in (-7, -3, -2, -1, 1, 2, 3, 7)])).alias("k")).select("person", (F.col("person") + F.col("k")).alias("friend"))
    return near.join(ids.select(F.col("person").alias("friend")), "friend", "left_semi").select("person", "friend")


on(
    "supplier", "M08_common_friends",
    "WITH f AS (SELECT a.s_suppkey AS p, b.s_suppkey AS q FROM supplier a JOIN supplier b ON abs(a.s_suppkey - b.s_suppkey) IN (1, 2, 3, 7)), l AS (SELECT p, list(DISTINCT q) AS fs FROM f GROUP BY 1) "
    "SELECT f.p AS a, f.q AS b, list_sort(list_intersect(x.fs, y.fs)) AS common FROM f JOIN l x ON f.p = x.p JOIN l y ON f.q = y.p WHERE f.p < f.q",
    lambda t: keyed.common_friends(_friends(t)),
)
on("documents", "A35_inverted_index", r"SELECT DISTINCT doc_id, unnest(list_filter(string_split_regex(lower(text), '[ \t\r\n]+'), lambda w: w <> '')) AS word FROM documents", lambda t: words.inverted_index(t, "doc_id", "text"))
on(
    "documents", "A36_cooccurrence",
    f"WITH w AS (SELECT DISTINCT doc_id, i, word FROM (SELECT doc_id, i, {_SPLIT.format(x='lower(line)')} AS word FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))) SELECT x.word AS a, y.word AS b, count(*) AS n FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.i = y.i AND x.word < y.word GROUP BY 1, 2",
    lambda t: words.cooccurrence(_lines(t), "line"),
)
on("documents", "A38_word_lengths", f"SELECT CAST(length(word) AS BIGINT) AS len, count(*) AS n FROM ({_FOLDED}) GROUP BY 1", lambda t: words.folded_words(_lines(t), "line").groupBy(F.length("word").cast("bigint").alias("len")).agg(F.count("*").alias("n")))
on("documents", "T11_top_words", f"SELECT word, count(*) AS n FROM ({_FOLDED}) GROUP BY 1 ORDER BY n DESC, word LIMIT 10", lambda t: words.count_words(words.folded_words(_lines(t), "line")).orderBy(F.desc("n"), "word").limit(10))
on("part", "M11_by_region", "SELECT p_brand, count(*) AS n, CAST(1 AS BIGINT) AS parts FROM part GROUP BY 1", lambda t: t.repartition(8, "p_brand").select("p_brand", F.spark_partition_id().alias("part")).groupBy("p_brand").agg(F.count("*").alias("n"), F.countDistinct("part").alias("parts")))

# ---- keyed jobs -------------------------------------------------------------------------------------------
_EXACT = "CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE)"


def _exact(column: Column) -> Column:
    return F.sum(column.cast("decimal(18,4)")).cast("double")


on("events", "A19_group_by_key", f"SELECT event_type, {_EXACT} AS s, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1", lambda t: keyed.group_and_map(t.where("value IS NOT NULL"), ["event_type"], {"s": _exact(F.col("value")), "n": F.count("*")}))
on("orders", "A20_reduce_by_key", "SELECT o_custkey, max(o_totalprice) AS o_totalprice FROM orders GROUP BY 1", lambda t: keyed.reduce_by_key(t, ["o_custkey"], "o_totalprice", F.max))
on(
    "events", "A21_combine_by_key", f"SELECT event_type, {_EXACT} / count(value) AS a, count(value) AS n FROM events GROUP BY 1",
    lambda t: keyed.combine_by_key(t, ["event_type"], {"s": F.col("value").cast("decimal(18,4)"), "c": F.col("value")}, {"s": F.sum, "c": F.count}, {"a": F.col("s").cast("double") / F.col("c"), "n": F.col("c")}),
)
on("events", "A22_aggregate_by_key", "SELECT user_id, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1", lambda t: keyed.combine_by_key(t, ["user_id"], {"lo": F.col("value"), "hi": F.col("value")}, {"lo": F.min, "hi": F.max}))
on("customer", "A23_reduce_all", "SELECT CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS s FROM customer", lambda t: t.agg(F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double").alias("s")))
on("events", "A24_count_avg", f"SELECT user_id, count(value) AS n, {_EXACT} / count(value) AS a FROM events GROUP BY 1", lambda t: t.groupBy("user_id").agg(F.count("value").alias("n"), (_exact(F.col("value")) / F.count("value")).alias("a")))
on("events", "A25_sum_count_avg", f"SELECT event_type, {_EXACT} AS s, count(value) AS n, {_EXACT} / count(value) AS a FROM events GROUP BY 1", lambda t: t.groupBy("event_type").agg(_exact(F.col("value")).alias("s"), F.count("value").alias("n"), (_exact(F.col("value")) / F.count("value")).alias("a")))
on("events", "A26_avg_min_max", f"SELECT event_type, {_EXACT} / count(value) AS a, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1", lambda t: t.groupBy("event_type").agg((_exact(F.col("value")) / F.count("value")).alias("a"), F.min(F.col("value")).alias("lo"), F.max(F.col("value")).alias("hi")))
on("customer", "A27_signs", "SELECT c_nationkey, count(*) FILTER (WHERE c_acctbal > 0) AS pos, count(*) FILTER (WHERE c_acctbal < 0) AS neg, count(*) AS n, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS a FROM customer GROUP BY 1", lambda t: t.groupBy("c_nationkey").agg(F.count_if(F.col("c_acctbal") > 0).alias("pos"), F.count_if(F.col("c_acctbal") < 0).alias("neg"), F.count("*").alias("n"), (F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double") / F.count("*")).alias("a")))


def _signs(batches) -> pd.DataFrame:
    z = n = p = 0
    for b in batches:
        z, n, p = z + int((b.v == 0).sum()), n + int((b.v < 0).sum()), p + int((b.v > 0).sum())
    return pd.DataFrame({"zeros": [z], "negatives": [n], "positives": [p]})


_SIGNS = "SELECT count(*) FILTER (WHERE ndata = 0) AS zeros, count(*) FILTER (WHERE ndata < 0) AS negatives, count(*) FILTER (WHERE ndata > 0) AS positives FROM scu_continents_1"
on("scu_continents_1", "A28_signs_by_partition", _SIGNS, lambda t: keyed.fold_partitions(t.where("ndata IS NOT NULL").select(F.col("ndata").alias("v")), _signs, "zeros bigint, negatives bigint, positives bigint").agg(*[F.sum(c).alias(c) for c in ("zeros", "negatives", "positives")]))


def _ends(batches) -> pd.DataFrame:
    n, lo, hi = 0, None, None
    for b in batches:
        if len(b):
            n += len(b)
            lo = b.v.min() if lo is None else min(lo, b.v.min())
            hi = b.v.max() if hi is None else max(hi, b.v.max())
    return pd.DataFrame({"n": [n], "lo": [lo], "hi": [hi]})


on("orders", "A29_count_min_max_by_partition", "SELECT count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders", lambda t: keyed.fold_partitions(t.select(F.col("o_totalprice").alias("v")), _ends, "n bigint, lo double, hi double").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")))
on("events", "A33_distinct_by_key", "SELECT DISTINCT user_id, event_type FROM events", lambda t: t.groupBy("user_id", "event_type").agg(F.first(F.lit(1)).alias("x")).drop("x"))
on("lineitem", "A39_combiner", "SELECT l_shipdate, count(*) AS n FROM lineitem GROUP BY 1", lambda t: t.groupBy("l_shipdate").agg(F.count("*").alias("n")))
on("events", "A42_monoid_average", f"SELECT {_EXACT} / count(value) AS a FROM events", lambda t: t.groupBy("event_type").agg(F.sum(F.col("value").cast("decimal(18,4)")).alias("s"), F.count("value").alias("n")).agg((F.sum("s").cast("double") / F.sum("n")).alias("a")))
on("customer", "A44_partition_max", "SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer", lambda t: keyed.fold_partitions(t.select(F.col("c_acctbal").alias("v")), _ends, "n bigint, lo double, hi double").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")))
on("scu_continents_2", "A45_two_stage", "SELECT continent, count(*) AS n, max(ndata) AS most FROM scu_continents_2 GROUP BY 1", lambda t: keyed.two_stage(t, ["continent"], ["rec_id"], {"n": F.count("*"), "most": F.max("ndata")}, {"n": F.sum("n"), "most": F.max("most")}))
on(
    "events", "W13_sessions",
    "SELECT event_id, user_id, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 1800000000 THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))",
    lambda t: keyed.sessions(t, "user_id", "ts", "event_id").select("event_id", "user_id", "session"),
)
on("events", "PR15_map_partitions", "SELECT count(*) AS n, min(value) AS lo, max(value) AS hi FROM events WHERE value IS NOT NULL", lambda t: keyed.fold_partitions(t.where("value IS NOT NULL").select(F.col("value").alias("v")), _ends, "n bigint, lo double, hi double").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")))
on("documents", "F12_word_filter", f"SELECT word, count(*) AS n FROM ({_FOLDED}) WHERE length(word) >= 3 GROUP BY 1", lambda t: words.count_words(words.folded_words(_lines(t), "line", 2)))
on("documents", "F13_total_filter", f"SELECT word, count(*) AS n FROM ({_FOLDED}) GROUP BY 1 HAVING count(*) >= 4", lambda t: words.count_words(words.folded_words(_lines(t), "line"), least=4))
on("documents", "F19_palindrome_lines", f"SELECT doc_id, line FROM ({_LINES}) WHERE length(line) > 0 AND line = {_BACKWARDS.format(x='line')}", lambda t: _lines(t, "doc_id").where((F.length("line") > 0) & (F.col("line") == F.reverse("line"))))

# ---- scalar functions -------------------------------------------------------------------------------------
on("nation", "E01_strings", "SELECT upper(n_name) AS u, lower(n_name) AS l, CAST(length(n_name) AS BIGINT) AS n, trim(lower(n_name)) AS t, n_name[1] AS first FROM nation", lambda t: t.select(F.upper("n_name").alias("u"), F.lower("n_name").alias("l"), F.length("n_name").cast("bigint").alias("n"), F.trim(F.lower("n_name")).alias("t"), F.substring("n_name", 1, 1).alias("first")))
on("part", "E02_split_strip", "SELECT p_partkey, string_split(regexp_replace(p_type, '[,.;]$', ''), ' ') AS ws FROM part", lambda t: t.select("p_partkey", F.split(F.regexp_replace("p_type", "[,.;]$", ""), " ").alias("ws")))
on("orders", "E03_split_class", "SELECT o_orderkey, string_split(o_orderpriority, '-')[1] AS code FROM orders", lambda t: t.select("o_orderkey", F.split("o_orderpriority", "[-]")[0].alias("code")))
on("part", "E04_title_case", "SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title FROM part", lambda t: t.select("p_partkey", words.title_words(F.col("p_name")).alias("title")))
on("region", "E05_reverse", "SELECT reverse(r_name) AS r FROM region", lambda t: t.select(F.reverse("r_name").alias("r")))
on("nation", "E06_salt", None, lambda t: t.select("n_name", F.concat("n_name", F.lit("_"), F.floor(F.rand(3) * 4)).alias("salted")))
on("orders", "E07_math", "SELECT o_orderkey, abs(-o_totalprice) AS a, CAST(floor(o_totalprice / 10) * 10 AS BIGINT) AS tens FROM orders", lambda t: t.select("o_orderkey", F.abs(-F.col("o_totalprice")).alias("a"), (F.floor(F.col("o_totalprice") / 10) * 10).cast("bigint").alias("tens")))
on("orders", "E08_dates", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d FROM orders", lambda t: t.select("o_orderkey", F.year("o_orderdate").cast("bigint").alias("y"), F.month("o_orderdate").cast("bigint").alias("m"), F.dayofmonth("o_orderdate").cast("bigint").alias("d")))
on("scu_continents_1", "E09_minutes_between", "SELECT rec_id, (epoch_us(arrived_at) - epoch_us(recorded_at)) / 60000000.0 AS m FROM scu_continents_1", lambda t: t.select("rec_id", ((F.unix_micros(F.col("arrived_at").cast("timestamp")) - F.unix_micros(F.col("recorded_at").cast("timestamp"))) / F.lit(60000000.0)).alias("m")))
on("scu_continents_2", "E10_bad_dates", "SELECT rec_id, try_strptime(sdata, '%Y-%m-%d') IS NULL AS bad FROM scu_continents_2", lambda t: t.select("rec_id", F.try_to_timestamp("sdata", F.lit("yyyy-MM-dd")).isNull().alias("bad")))
on("documents", "E11_fill_null", "SELECT doc_id, coalesce(lang, '?') AS lang, coalesce(title, 'none') AS title FROM documents", lambda t: t.na.fill({"lang": "?", "title": "none"}).select("doc_id", "lang", "title"))
on("documents", "E12_drop_null", "SELECT doc_id FROM documents WHERE lang IS NOT NULL AND title IS NOT NULL AND source IS NOT NULL", lambda t: t.na.drop(subset=["lang", "title", "source"]).select("doc_id"))
on("events", "E13_json_path", "SELECT event_id, props->>'$.k' AS k FROM events", lambda t: t.select("event_id", F.get_json_object("props", "$.k").alias("k")))
on("events", "E14_json_struct", "SELECT event_id, CAST(props->>'$.k' AS INTEGER) AS k FROM events", lambda t: t.select("event_id", F.from_json("props", "k int")["k"].alias("k")))
on("part", "E15_arrays", "SELECT p_partkey, CAST(len(string_split(p_type, ' ')) AS BIGINT) AS n, unnest(string_split(p_type, ' ')) AS w FROM part", lambda t: t.select("p_partkey", F.size(F.split("p_type", " ")).cast("bigint").alias("n"), F.explode(F.split("p_type", " ")).alias("w")))
on("customer", "E16_maps", "SELECT c_custkey, ['segment', 'name'] AS ks, [c_mktsegment, c_name] AS vs FROM customer", lambda t: t.select("c_custkey", F.create_map(F.lit("segment"), "c_mktsegment", F.lit("name"), "c_name").alias("m")).select("c_custkey", F.map_keys("m").alias("ks"), F.map_values("m").alias("vs")))
on(
    "orders", "E17_batch_number", "SELECT count(*) AS n, true AS small FROM orders",
    lambda t: t.groupBy(F.floor(F.monotonically_increasing_id() / 100).alias("batch")).agg(F.count("*").alias("n")).agg(F.sum("n").alias("n"), F.bool_and(F.col("n") <= 100).alias("small")),
)

# ---- named jobs that are one of the plans above, over other tables ------------------------------------------
on("lineitem", "A32_arg_max", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 0 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) = 1", lambda t: keyed.best_per_key(t, "l_orderkey", "l_linenumber", "l_quantity"))
on("eval_items", "A34_word_count", f"SELECT word, count(*) AS n FROM (SELECT {_SPLIT.format(x='lower(text)')} AS word FROM eval_items) GROUP BY 1", lambda t: words.count_words(words.folded_words(t, "text")))
on("scu_continents_1", "M09_even_squares", "SELECT rec_id, rec_id * rec_id AS square FROM scu_continents_1 WHERE rec_id % 2 = 0", lambda t: t.where("rec_id % 2 = 0").select("rec_id", (F.col("rec_id") * F.col("rec_id")).alias("square")))
on("continents_countries_temp", "M10_avg_min_max", "SELECT country, round(avg(temperature), 6) AS a, min(temperature) AS lo, max(temperature) AS hi FROM continents_countries_temp GROUP BY 1", lambda t: t.groupBy("country").agg(F.round(F.avg("temperature"), 6).alias("a"), F.min("temperature").alias("lo"), F.max("temperature").alias("hi")))
