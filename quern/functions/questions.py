"""From a question to SQL to a result, with an injected client and a guard in front of the engine."""

from __future__ import annotations

import re
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.model_text import Client, ask

_FENCE = re.compile(r"```(?:sql)?\s*\n?(.*?)```", re.S | re.I)
_START = re.compile(r"\b(SELECT|WITH)\b.*", re.S | re.I)


class Mode(Enum):
    INSIGHT = "insight"
    SQL = "sql"
    EXPLAIN = "explain_sql"


@dataclass
class Answer:
    sql: str | None
    rows: DataFrame | None
    text: str | None
    error: str | None


def describe(name: str, df: DataFrame, samples: int = 5) -> str:
    """A table for a prompt, as SQL reads it: its CREATE TABLE statement, then ``samples`` rows as JSON in comments."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString().upper()}" for f in df.schema)
    rows = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).limit(samples)
    return "".join([f"CREATE TABLE `{name}` ({fields});", *(f"\n-- {r[0]}" for r in rows.toLocalIterator())])


def extract_sql(reply: str) -> str:
    """The first fenced block, else the text from the first SELECT or WITH; without a final semicolon."""
    text = m[1] if (m := _FENCE.search(reply)) else m[0] if (m := _START.search(reply)) else reply
    return text.strip().rstrip(";").strip()


def check(spark: SparkSession, sql: str) -> str | None:
    """Why ``sql`` must not run: it does not parse, changes something, or names what is not there. None if it may."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
        kind = plan.getClass().getSimpleName()
        if not re.match(r"\A\s*(SELECT|WITH|\()", sql, re.I) or re.search(r"Command|Create|Insert|Drop|Delete|Update|Merge|Set[A-Z]|Alter|Truncate", kind):
            return f"only SELECT is allowed, not {kind}"
        spark.sql(sql)._jdf.queryExecution().executedPlan()  # analysed and planned, as by EXPLAIN, not run
    except Exception as e:  # noqa: BLE001
        return next((x for x in map(str.strip, str(e).splitlines()) if x), type(e).__name__)
    return None


def answer(spark: SparkSession, client: Client, question: str, tables: dict[str, DataFrame], mode: Mode = Mode.SQL) -> Answer:
    """Ask for SQL about ``tables`` and run it behind :func:`check`; or ask for an insight or an explanation only."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    known = "\n\n".join(describe(n, df) for n, df in tables.items())
    reply = ask(client, f"{mode.value}\n{known}\n\nQuestion: {question}")
    if mode is Mode.INSIGHT:
        return Answer(None, None, reply, None)
    sql = extract_sql(reply)
    if problem := check(spark, sql):
        return Answer(sql, None, None, problem)
    if mode is Mode.EXPLAIN:
        return Answer(sql, None, spark.sql(f"EXPLAIN FORMATTED {sql}").first()[0], None)
    return Answer(sql, spark.sql(sql), None, None)


def transform(df: DataFrame, wish: str, client: Client) -> DataFrame:
    """``df`` changed as a sentence asks for: the client's SQL over the view ``this``, behind the same guard."""
    found = answer(df.sparkSession, client, wish, {"this": df})
    if found.error:
        raise ValueError(found.error)
    return found.rows
