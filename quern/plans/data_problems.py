"""Queries of the general data problems: hot keys, quality profile, orphan references, records that fail."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import quality, records, references, skewed_keys
from quern.plans.registry import Registry, table

registry = Registry()
PLACE = ["continent", "country"]


def place_stats(spark: SparkSession, d: str) -> DataFrame:
    return skewed_keys.chunked_stats(table(spark, d, "scu_continents_2"), PLACE, value="ndata", distinct="city")


@registry.query(
    "p1_found",
    """SELECT continent, country FROM scu_continents_2 WHERE length(trim(continent)) > 0 AND length(trim(country)) > 0
    GROUP BY 1, 2 HAVING count(*) >= 0.02 * (SELECT count(*) FROM scu_continents_2)""",
)
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return skewed_keys.heavy_keys(place_stats(spark, d), PLACE, 0.02)


@registry.query(
    "p1_stats",
    """SELECT continent, country, count(*) AS n_rows, CAST(sum(ndata) AS VARCHAR) AS sum_ndata, count(DISTINCT city) AS n_city
    FROM scu_continents_2 GROUP BY 1, 2""",
)
def p1_stats(spark: SparkSession, d: str) -> DataFrame:
    return place_stats(spark, d).select(*PLACE, "n_rows", F.col("sum_ndata").cast("string").alias("sum_ndata"), "n_city")


EMPLOYEE_CHECKS = (
    quality.Check("age", "whole", lambda v: v.between(16, 90)),
    quality.Check("salary", "whole", lambda v: v.between(1_000, 5_000_000)),
)
PLACE_CHECKS = (quality.Check("city", "text", lambda v: v.rlike(quality.CITY_FORM), blank_is_null=True),)

#: the other columns of the two tables, all but load_no
STAFF_REST = (
    quality.Check("row_id", "whole"),
    quality.Check("id", "whole"),
    quality.Check("name", "text", lambda v: v.rlike(quality.NAME_FORM), blank_is_null=True),
    quality.Check("department_id", "whole", lambda v: v > 0),
    quality.Check("recorded_at", "time"),
    quality.Check("arrived_at", "time"),
)
PLACE_REST = (
    quality.Check("row_id", "whole"),
    quality.Check("continent", "text", lambda v: v.rlike(quality.NAME_FORM), blank_is_null=True),
    quality.Check("country", "text", lambda v: v.rlike(quality.NAME_FORM), blank_is_null=True),
    quality.Check("temperature", "frac", lambda v: v.between(-90, 60)),
    quality.Check("recorded_at", "time"),
)


def load_profile(spark: SparkSession, d: str, wide: bool) -> DataFrame:
    staff, places = list(EMPLOYEE_CHECKS), list(PLACE_CHECKS)
    if wide:
        staff += STAFF_REST
        places += PLACE_REST
    values = quality.counted_values(table(spark, d, "employees"), "employees", "load_no", staff)
    return quality.profile(values.unionByName(quality.counted_values(table(spark, d, "continents_countries_temp"), "continents_countries_temp", "load_no", places)))


_NUMBERS = """SELECT 'employees' AS table_name, 'age' AS column_name, load_no, CAST(age AS BIGINT) AS v, age NOT BETWEEN 16 AND 90 AS bad FROM employees
    UNION ALL SELECT 'employees', 'salary', load_no, salary, salary NOT BETWEEN 1000 AND 5000000 FROM employees"""
_P3 = rf"""WITH nums AS ({_NUMBERS}), texts AS (
    SELECT 'continents_countries_temp' AS table_name, 'city' AS column_name, load_no, CASE WHEN length(trim(city)) > 0 THEN city END AS v FROM continents_countries_temp),
  cells AS (SELECT table_name, column_name, load_no, CAST(v AS VARCHAR) AS v, bad FROM nums
    UNION ALL SELECT table_name, column_name, load_no, v, NOT regexp_full_match(v, '\p{{Lu}}\p{{L}}*([ ''-]\p{{L}}+)*') FROM texts),
  basic AS (SELECT table_name, column_name, load_no, count(*) AS n, count(v) AS filled, count(*) FILTER (WHERE bad) AS wrong FROM cells GROUP BY ALL),
  tops AS (SELECT table_name, column_name, load_no, max(c) AS top FROM (SELECT table_name, column_name, load_no, v, count(*) AS c FROM cells WHERE v IS NOT NULL GROUP BY ALL) GROUP BY ALL),
  own AS (SELECT table_name, column_name, load_no, median(v) AS m FROM nums GROUP BY ALL),
  rest AS (SELECT l.table_name, l.column_name, l.load_no, median(o.v) AS m FROM (SELECT DISTINCT table_name, column_name, load_no FROM nums) l
    JOIN nums o ON l.table_name = o.table_name AND l.column_name = o.column_name AND l.load_no <> o.load_no GROUP BY ALL)"""
_P3_FOUND = f"""{_P3}
  SELECT table_name, column_name, CAST(load_no AS BIGINT) AS load_no, 'nulls' AS finding FROM basic WHERE n - filled >= 0.1 * n
  UNION ALL SELECT table_name, column_name, CAST(load_no AS BIGINT), 'invalid' FROM basic WHERE filled > 0 AND wrong >= 0.1 * filled
  UNION ALL SELECT table_name, column_name, CAST(load_no AS BIGINT), 'dominant' FROM basic JOIN tops USING (table_name, column_name, load_no) WHERE top >= 0.3 * filled
  UNION ALL SELECT table_name, column_name, CAST(load_no AS BIGINT), 'shift' FROM own JOIN rest USING (table_name, column_name, load_no) WHERE abs(own.m - rest.m) > 0.25 * abs(rest.m)"""


@registry.query("p3_found", _P3_FOUND)
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.findings(load_profile(spark, d, wide=False))


_NAME = "NOT regexp_full_match({c}, '\\p{{Lu}}\\p{{L}}*([ ''-]\\p{{L}}+)*')"
_PROFILED = (
    ("employees", "whole", {"age": "{c} NOT BETWEEN 16 AND 90", "salary": "{c} NOT BETWEEN 1000 AND 5000000", "row_id": "false", "id": "false", "department_id": "{c} <= 0"}),
    ("employees", "time", {"recorded_at": "false", "arrived_at": "false"}),
    ("employees", "text", {"name": _NAME}),
    ("continents_countries_temp", "whole", {"row_id": "false"}),
    ("continents_countries_temp", "time", {"recorded_at": "false"}),
    ("continents_countries_temp", "frac", {"temperature": "{c} NOT BETWEEN -90 AND 60"}),
    ("continents_countries_temp", "text", {"city": _NAME, "continent": _NAME, "country": _NAME}),
)


def _profile_sql() -> str:
    """The profile by sorting every column's values: whole numbers and microseconds, fractions and texts each in their own type."""
    cells, parts = {"whole": [], "frac": [], "txt": []}, []
    for table_name, kind, columns in _PROFILED:
        for c, bad in columns.items():
            v = {"time": f"epoch_us({c})", "text": f"CASE WHEN length(trim({c})) > 0 THEN {c} END", "whole": f"CAST({c} AS BIGINT)", "frac": f"CASE WHEN NOT isnan({c}) THEN {c} END"}[kind]
            cells[{"time": "whole", "text": "txt"}.get(kind, kind)].append(f"SELECT '{table_name}' AS table_name, '{c}' AS column_name, CAST(load_no AS BIGINT) AS load_no, {v} AS v, coalesce({bad.format(c=c)}, false) AS bad FROM {table_name}")
    for kind, rows in cells.items():
        twice = "CAST(NULL AS DOUBLE)"
        if kind != "txt":
            wide = "HUGEINT" if kind == "whole" else "DOUBLE"
            middle = lambda n, u, at: f"CAST(max(v) FILTER (WHERE {u} - {at} < ({n} + 1) // 2 AND {u} >= ({n} + 1) // 2)::{wide} + max(v) FILTER (WHERE {u} - {at} < {n} // 2 + 1 AND {u} >= {n} // 2 + 1)::{wide} AS DOUBLE)"
        own, rest = (middle("total", "upto", "n"), middle("others", "rest_upto", "rest_n")) if kind != "txt" else (twice, twice)
        parts.append(
            f"""SELECT b.table_name, b.column_name, b.load_no, n_rows, n_null, n_invalid, n_distinct, top_count, min_value, max_value, ks, median2, rest_median2 FROM (
    SELECT table_name, column_name, load_no, count(*) AS n_rows, count(*) - count(v) AS n_null, count(*) FILTER (WHERE bad AND v IS NOT NULL) AS n_invalid,
      count(DISTINCT v) AS n_distinct, CAST(min(v) AS VARCHAR) AS min_value, CAST(max(v) AS VARCHAR) AS max_value FROM {kind}_cells GROUP BY ALL) b
    LEFT JOIN (SELECT table_name, column_name, load_no, max(n) AS top_count FROM {kind}_own GROUP BY ALL) t USING (table_name, column_name, load_no)
    LEFT JOIN (SELECT table_name, column_name, load_no, max(greatest(abs(upto / total - rest_upto / others), abs((upto - n) / total - (rest_upto - rest_n) / others))) FILTER (WHERE n > 0 AND others > 0) AS ks,
      {own} AS median2, {rest} AS rest_median2 FROM {kind}_curve GROUP BY ALL) c USING (table_name, column_name, load_no)"""
        )
    withs = []
    for kind, rows in cells.items():
        withs.append(f"{kind}_cells AS ({' UNION ALL '.join(rows)}), {kind}_own AS (SELECT table_name, column_name, load_no, v, count(*) AS n FROM {kind}_cells WHERE v IS NOT NULL GROUP BY ALL)")
        # every load at every value of its column; loads without any value have no curve
        withs.append(f"""{kind}_curve AS (SELECT *, all_n - n AS rest_n, sum(n) OVER l AS upto, sum(all_n - n) OVER l AS rest_upto, sum(n) OVER f AS total, sum(all_n - n) OVER f AS others FROM (
      SELECT g.table_name, g.column_name, g.load_no, a.v, a.all_n, coalesce(o.n, 0) AS n FROM (SELECT DISTINCT table_name, column_name, load_no FROM {kind}_own) g
      JOIN (SELECT table_name, column_name, v, sum(n)::BIGINT AS all_n FROM {kind}_own GROUP BY ALL) a USING (table_name, column_name)
      LEFT JOIN {kind}_own o ON o.table_name = g.table_name AND o.column_name = g.column_name AND o.load_no = g.load_no AND o.v = a.v)
    WINDOW l AS (PARTITION BY table_name, column_name, load_no ORDER BY v), f AS (PARTITION BY table_name, column_name, load_no))""")
    return f"WITH {', '.join(withs)} {' UNION ALL '.join(parts)}"


@registry.query("p3_profile", _profile_sql())
def p3_profile(spark: SparkSession, d: str) -> DataFrame:
    return load_profile(spark, d, wide=True)


def staff_orphans(spark: SparkSession, d: str) -> DataFrame:
    return references.orphans(table(spark, d, "employees"), "department_id", "recorded_at", table(spark, d, "departments"))


_ORPHAN = """FROM employees e WHERE department_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM departments p WHERE p.id = e.department_id
    AND p.created_at <= e.recorded_at AND (p.deleted_at IS NULL OR e.recorded_at < p.deleted_at))"""


@registry.query("p4_found", f"SELECT row_id {_ORPHAN}")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return staff_orphans(spark, d).select("row_id")


@registry.query(
    "p4_months",
    f"""SELECT 'employees' AS table_name, 'department_id' AS column_name, strftime(recorded_at, '%Y-%m') AS month, reason, count(*) AS n_orphans FROM (
    SELECT recorded_at, CASE WHEN f IS NULL AND k IS NULL THEN 'missing' WHEN recorded_at < f THEN 'not_yet' ELSE 'deleted' END AS reason FROM (SELECT * {_ORPHAN}) o
    LEFT JOIN (SELECT id AS k, min(created_at) AS f FROM departments GROUP BY 1) ON k = department_id) GROUP BY ALL""",
)
def p4_months(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_report(staff_orphans(spark, d), "employees", "department_id", "recorded_at")


def parsed(spark: SparkSession, d: str) -> DataFrame:
    return records.parse_records(table(spark, d, "raw_lines"))


_P5_FIELDS = r"""WITH raw AS (SELECT line_id, line_no, coalesce(line, '') AS line, CASE WHEN starts_with(file_name, 'employees_') THEN 5 ELSE 4 END AS n FROM raw_lines),
  ok AS (SELECT *, regexp_full_match(line, '(?s)("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*))*') AS sound FROM raw),
  cut AS (SELECT *, list_transform(regexp_extract_all(',' || line, ',("(?:[^"]|"")*"|[^",]*)', 1), lambda f: CASE WHEN starts_with(f, '"') THEN replace(f[2:length(f) - 1], '""', '"') ELSE f END) AS f FROM ok),
  num AS (SELECT *, CASE WHEN n = 5 THEN [trim(f[1], ' '), trim(f[3], ' '), trim(f[4], ' '), trim(f[5], ' ')] ELSE [trim(f[4], ' ')] END AS x FROM cut),
  told AS (SELECT *, CASE WHEN NOT sound THEN 'quoting' WHEN len(f) <> n THEN 'column_count'
    WHEN n = 4 AND NOT (x[1] = '' OR regexp_full_match(x[1], '[+-]?[0-9]+(\.[0-9]+)?')) THEN 'value'
    WHEN n = 5 AND NOT (list_bool_and(list_transform(x, lambda v: v = '' OR regexp_full_match(v, '[+-]?[0-9]+')))
      AND (x[1] = '' OR TRY_CAST(ltrim(x[1], '+') AS BIGINT) IS NOT NULL) AND (x[2] = '' OR TRY_CAST(ltrim(x[2], '+') AS INTEGER) IS NOT NULL)
      AND (x[3] = '' OR TRY_CAST(ltrim(x[3], '+') AS INTEGER) IS NOT NULL) AND (x[4] = '' OR TRY_CAST(ltrim(x[4], '+') AS BIGINT) IS NOT NULL)) THEN 'value' END AS reason FROM num)"""


@registry.query("p5_found", f"{_P5_FIELDS} SELECT line_id, reason FROM told WHERE reason IS NOT NULL")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return parsed(spark, d).where("reason IS NOT NULL").select("line_id", "reason")


@registry.query(
    "p5_employees",
    rf"""{_P5_FIELDS} SELECT line_id, TRY_CAST(ltrim(x[1], '+') AS BIGINT) AS id, f[2] AS name, TRY_CAST(ltrim(x[2], '+') AS INTEGER) AS age,
    TRY_CAST(ltrim(x[3], '+') AS INTEGER) AS department_id, TRY_CAST(ltrim(x[4], '+') AS BIGINT) AS salary FROM told WHERE reason IS NULL AND n = 5""",
)
def p5_employees(spark: SparkSession, d: str) -> DataFrame:
    return parsed(spark, d).where("reason IS NULL AND kind = 'employees'").select("line_id", "id", "name", "age", "department_id", "salary")


@registry.query(
    "p5_temperatures",
    rf"{_P5_FIELDS} SELECT line_id, f[1] AS continent, f[2] AS country, f[3] AS city, TRY_CAST(ltrim(x[1], '+') AS DOUBLE) AS temperature FROM told WHERE reason IS NULL AND n = 4",
)
def p5_temperatures(spark: SparkSession, d: str) -> DataFrame:
    return parsed(spark, d).where("reason IS NULL AND kind = 'continents_countries_temp'").select("line_id", "continent", "country", "city", "temperature")
