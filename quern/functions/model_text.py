"""Text through a language model: an injected client, called per row, per batch or once.

A client is any callable ``prompt -> reply``; jobs take a *factory* of it, which is called once per Python worker, so
that no live connection is ever pickled. ``Offline`` is the deterministic client of tests and of use without a network.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Client = Callable[[str], str]
ERROR = "ERROR:"


class Offline:
    """Replies by simple rules: summarize = the first words, classify = by a word, translate = upper case,
    parse = JSON of length and first word. ``fail_every`` makes every n-th call raise, for tests of retries; texts with the
    word ``refuse`` in any case raise at every call."""

    def __init__(self, fail_every: int = 0, refuse: str | None = None):
        self.fail_every, self.refuse, self.calls = fail_every, refuse, 0

    def __call__(self, prompt: str) -> str:
        self.calls += 1
        if self.fail_every and self.calls % self.fail_every == 0:
            raise ConnectionError("offline client was told to fail")
        task, _, text = prompt.partition("\n")
        if self.refuse and self.refuse in text.lower():
            raise ValueError(f"texts with {self.refuse} are refused")
        words = text.split()
        if task == "summarize":
            return " ".join(words[:5])
        if task == "classify":
            return "problem" if "error" in text.lower() else "normal"
        if task == "translate":
            return text.upper()
        if task == "parse":
            return json.dumps({"length": len(text), "first": words[0] if words else ""})
        if task == "batch":
            return f"{text.count(chr(10)) + 1} records"
        return text


def ask(client: Client, prompt: str, tries: int = 3, wait: float = 0.0) -> str:
    """The reply, or ``ERROR: reason`` after ``tries`` failures."""
    for attempt in range(tries):
        try:
            return client(prompt)
        except Exception as e:  # noqa: BLE001 - whatever a client raises becomes a marked reply
            reason = str(e)
            if wait and attempt + 1 < tries:
                time.sleep(wait * 2**attempt)
    return f"{ERROR} {reason}"


def per_row(make: Callable[[], Client], task: str | Callable[[], str], tries: int = 3):
    """A column function: one call per row. Null text gives null. A callable ``task`` is called in the worker, where it may
    read a broadcast variable."""

    @F.pandas_udf("string")
    def reply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        client, what = make(), task() if callable(task) else task
        for texts in batches:
            yield texts.map(lambda t: None if t is None else ask(client, f"{what}\n{t}", tries))

    return reply


def parsed_rows(make: Callable[[], Client], tries: int = 3):
    """A column function that returns a struct from the model's JSON; broken replies give nulls."""

    @F.pandas_udf("length bigint, first string")
    def reply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        client = make()
        for texts in batches:
            out = []
            for t in texts:
                try:
                    x = json.loads(ask(client, f"parse\n{t or ''}", tries))
                    out.append((x["length"], x["first"]))
                except (ValueError, KeyError, TypeError):
                    out.append((None, None))
            yield pd.DataFrame(out, columns=["length", "first"])

    return reply


def per_batch(df: DataFrame, key: str, text: str, make: Callable[[], Client], size: int = 100) -> DataFrame:
    """``(key, reply)``: one call per ``size`` rows inside each partition, a last smaller batch included; a failed call
    marks all rows of its batch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, waiting = make(), []

        def flush():
            reply = ask(client, "batch\n" + "\n".join(" ".join((t or "").split()) for _, t in waiting))
            return pd.DataFrame({key: [k for k, _ in waiting], "reply": reply})

        for frame in frames:
            for row in zip(frame[key], frame[text]):
                waiting.append(row)
                if len(waiting) == size:
                    yield flush()
                    waiting = []
        if waiting:
            yield flush()

    return df.select(key, text).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, reply string")


def batch_summaries(df: DataFrame, key: str, text: str, make: Callable[[], Client], size: int = 100) -> DataFrame:
    """``(key, batch_id, reply)``: rows in batches of ``size`` by position within each key range, one call per batch, the
    reply joined back to the rows. Batch ids are dense per partition of the key's hash, so batches are full but the last."""
    from quern.operators.skewed_keys import number_rows

    numbered = number_rows(df.select(key, text).withColumn("__slot", F.pmod(F.xxhash64(key), F.lit(8))), ["__slot"], "__at")
    batched = numbered.withColumn("batch_id", F.concat_ws("-", F.col("__slot"), F.floor(F.col("__at") / size)))
    texts = batched.groupBy("batch_id").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct(key, text))), lambda x: F.regexp_replace(F.coalesce(x[text], F.lit("")), r"\s+", " "))).alias("all"))
    replies = texts.select("batch_id", per_row(make, "batch")("all").alias("reply"))
    return batched.select(key, "batch_id").join(replies, "batch_id", "left")


def failures(df: DataFrame, reply: str) -> DataFrame:
    """The rows whose call failed for good."""
    return df.where(F.col(reply).startswith(ERROR))
