"""Queries of the training-data problems."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import leakage, packing, quantiles, spans, topn
from quern.plans.registry import Registry, table

registry = Registry()


_P2_TABLES = (("employees", "department_id", "salary"), ("continents_countries_temp", "country", "temperature"), ("scu_continents_1", "country", "ndata"))
PER_MILLE = (500, 900, 950, 990)


def _percentiles(spark: SparkSession, d: str, monthly: bool) -> DataFrame:
    summaries = []
    for name, group, value in _P2_TABLES:
        df = table(spark, d, name).withColumn("table_name", F.lit(name)).withColumn("grp", F.col(group).cast("string")).withColumn("month", F.date_format("recorded_at", "yyyy-MM"))
        summaries.append(quantiles.summarize(df, ["table_name", "grp", "month"], value))
    return quantiles.percentiles(summaries, ["table_name", "grp", *["month"] * monthly], PER_MILLE)


def _percentile_sql(month: str) -> str:
    more, by = (f"strftime(recorded_at, '%Y-%m') AS month, ", "table_name, grp, month") if month else ("", "table_name, grp")
    rows = " UNION ALL ".join(f"SELECT '{t}' AS table_name, CAST({g} AS VARCHAR) AS grp, {more}CAST({v} AS DOUBLE) AS v FROM {t} WHERE {v} IS NOT NULL" for t, g, v in _P2_TABLES)
    return f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY v) AS k, count(*) OVER (PARTITION BY {by}) AS n FROM ({rows}))
    SELECT {by}, CAST(p AS INTEGER) AS per_mille, n AS n_rows, v AS lower, v AS upper FROM r, (VALUES (500), (900), (950), (990)) AS t(p) WHERE k = greatest(1, (n * p + 999) // 1000)"""


@registry.query("p2_percentiles", _percentile_sql(""))
def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return _percentiles(spark, d, monthly=False)


@registry.query("p2_months", _percentile_sql("month"))
def p2_months(spark: SparkSession, d: str) -> DataFrame:
    return _percentiles(spark, d, monthly=True)


@registry.query("p2_bounds", "SELECT CAST(0 AS BIGINT) AS outside, true AS near")
def p2_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Summaries rounded to 8 bits: no exact percentile lies outside its interval, no interval is wider than stated."""
    rows = table(spark, d, "scu_continents_1")
    exact, rounded = (quantiles.percentiles(quantiles.summarize(rows, ["country"], "ndata", bits=b), ["country"], PER_MILLE) for b in (None, 8))
    same = F.col("e.country").eqNullSafe(F.col("r.country")) & (F.col("e.per_mille") == F.col("r.per_mille"))
    both = exact.alias("e").join(rounded.alias("r"), same)
    outside = ~F.col("e.lower").between(F.col("r.lower"), F.col("r.upper"))
    width = F.col("r.upper") - F.col("r.lower") <= 2 * F.abs(F.col("r.lower")) / 128 + 1
    return both.agg(F.count_if(outside).alias("outside"), F.bool_and(width).alias("near"))


@registry.query(
    "p6_found",
    """SELECT 'employees' AS table_name, row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY department_id ORDER BY salary DESC, row_id) AS r
      FROM employees WHERE department_id IS NOT NULL AND salary IS NOT NULL) WHERE r <= 5
    UNION ALL SELECT 'continents_countries_temp', row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY country ORDER BY temperature DESC, row_id) AS r
      FROM continents_countries_temp WHERE length(trim(country)) > 0 AND temperature IS NOT NULL) WHERE r <= 5""",
)
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    staff = topn.top_n(table(spark, d, "employees"), "department_id", "salary", "row_id")
    places = topn.top_n(table(spark, d, "continents_countries_temp").where(F.length(F.trim("country")) > 0), "country", "temperature", "row_id")
    return staff.select(F.lit("employees").alias("table_name"), "row_id").unionByName(
        places.select(F.lit("continents_countries_temp").alias("table_name"), "row_id")
    )


_TOKEN_RE2 = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\t\n\x0B\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@registry.query("p7_found", f"SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '{_TOKEN_RE2}')) > 1024")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents")).where("n_pieces > 1 AND piece = 0").select("doc_id")


@registry.query("p7_containers")
def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"))


@registry.query(
    "p7_pieces",
    f"""SELECT doc_id, n AS n_tokens, CAST(greatest(1, ceil(n / 1024)) AS BIGINT) AS n_pieces, n AS upto_token, CAST(0 AS BIGINT) AS overfull
    FROM (SELECT doc_id, CAST(coalesce(len(regexp_extract_all(text, '{_TOKEN_RE2}')), 0) AS BIGINT) AS n FROM documents)""",
)
def p7_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every text whole, whatever its container, and no container over its capacity."""
    packed = packing.pack(table(spark, d, "documents"))
    loads = packed.groupBy("container").agg(F.sum("n_tokens").alias("load")).agg(F.count_if(F.col("load") > 1024).alias("overfull"))
    per = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_pieces"), F.max(F.col("first_token") + F.col("n_tokens")).alias("upto_token"))
    return per.withColumn("overfull", loads.scalar())


@registry.query("p7_fill")
def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(packing.pack(table(spark, d, "documents")))


#: where the public tokenizers' files lie
TOKENIZERS = os.environ.get("QUERN_TOKENIZERS", "/opt/tokenizers")


@registry.query("p7_public_tokens")
def p7_public_tokens(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), size=packing.count_pieces(f"{TOKENIZERS}/byte_bpe_50k.tiktoken")(F.col("text")))


def leaked(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


@registry.query("p8_found")
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Of all links, those whose check found a common run."""
    return leaked(spark, d).where("verbatim").select("doc_id", "item_id")


registry.add("p8_leaks", leaked)


_SHARED = """WITH w AS (SELECT doc_id, s, md5(substr(text, s + 1, 300)) AS k FROM (SELECT doc_id, text, unnest(range(0, length(text) - 299)) AS s FROM documents WHERE length(text) >= 300)),
  m AS (SELECT DISTINCT doc_id, s FROM w SEMI JOIN (SELECT k FROM w GROUP BY 1 HAVING min(doc_id) <> max(doc_id)) USING (k)),
  i AS (SELECT *, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 300 THEN 0 ELSE 1 END AS jump FROM m),
  g AS (SELECT *, sum(jump) OVER (PARTITION BY doc_id ORDER BY s) AS n FROM i),
  spans AS (SELECT doc_id, min(s) AS span_start, max(s) + 300 AS span_end FROM g GROUP BY doc_id, n)"""


@registry.query("p9_found", f"{_SHARED} SELECT * FROM spans")
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(table(spark, d, "documents"))


@registry.query(
    "p9_shares",
    f"""{_SHARED}, sums AS (SELECT doc_id, count(*) AS n, sum(span_end - span_start) AS c FROM spans GROUP BY 1)
  SELECT doc_id, coalesce(length(text), 0) AS n_chars, coalesce(n, 0) AS n_spans, CAST(coalesce(c, 0) AS BIGINT) AS shared_chars,
    CASE WHEN length(text) > 0 THEN coalesce(c, 0)::DOUBLE / length(text) ELSE 0 END AS shared_share FROM documents LEFT JOIN sums USING (doc_id)""",
)
def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return spans.shared_amounts(docs, spans.shared_spans(docs))
