"""Loading comma-separated records, some of which do not parse.

Blocks of records go through a columnar CSV parser at once. A block that fails anywhere is bisected, again
and again, until the bad records stand alone; those are read strictly, character by character, and get the
reason. A block fails if the parser refuses it, reads another number of records, or if what it read does not stand up
to a guard on the quoting and on the form of the numbers, so that the fast path accepts nothing that the strict reader
would not.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pcsv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Layout:
    """Files whose name starts with ``prefix`` have these ``fields``: name -> string, int, bigint or double."""

    prefix: str
    fields: tuple[tuple[str, str], ...]


#: fixed values: the two kinds of files and their fields
LAYOUTS = (
    Layout("continents_countries_temp_", (("continent", "string"), ("country", "string"), ("city", "string"), ("temperature", "double"))),
    Layout("employees_", (("id", "bigint"), ("name", "string"), ("age", "int"), ("department_id", "int"), ("salary", "bigint"))),
)
QUOTING, COLUMNS, VALUE, UNKNOWN = "quoting", "column_count", "value", "unknown_file"

_FIELD = r'(?:"(?:[^"]++|"")*+"|[^",]*+)'
_WHOLE, _FRACTION = r"[+-]?[0-9]+", r"[+-]?[0-9]+(?:\.[0-9]+)?"
_RANGE = {"int": 31, "bigint": 63}
_ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}
_PYTHON = {"string": str, "int": int, "bigint": int, "double": float}


def read_strictly(record: str | None, layout: Layout) -> tuple[str | None, list]:
    """(reason or None, typed fields). The first reason that applies: quoting, column_count, value."""
    record = record or ""
    fields, at, n = [], 0, len(record)
    while True:
        if record.startswith('"', at):
            end = at + 1
            while True:
                end = record.find('"', end)
                if end < 0:
                    return QUOTING, []
                if record.startswith('"', end + 1):
                    end += 2
                    continue
                break
            fields.append(record[at + 1 : end].replace('""', '"'))
            at = end + 1
            if at < n and record[at] != ",":
                return QUOTING, []
        else:
            end = record.find(",", at)
            end = n if end < 0 else end
            if '"' in record[at:end]:
                return QUOTING, []
            fields.append(record[at:end])
            at = end
        if at >= n:
            break
        at += 1
    if len(fields) != len(layout.fields):
        return COLUMNS, []
    typed = []
    for text, (_, kind) in zip(fields, layout.fields):
        if kind == "string":
            typed.append(text)
            continue
        text = text.strip(" ")
        if not text:
            typed.append(None)
        elif not re.fullmatch(_FRACTION if kind == "double" else _WHOLE, text):
            return VALUE, []
        else:
            if kind in _RANGE:  # Python reads no number of thousands of digits
                digits = text.lstrip("+-").lstrip("0")[:20] or "0"
                text = "-" * text.startswith("-") + digits
            value = _PYTHON[kind](text)
            if kind in _RANGE and not -(1 << _RANGE[kind]) <= value < 1 << _RANGE[kind]:
                return VALUE, []
            typed.append(value)
    return None, typed


def _number_form(kind: str) -> str:
    """Sound numbers but those with a leading +, which are left to the strict reader."""
    return "-?" + (_FRACTION if kind == "double" else _WHOLE).removeprefix("[+-]?")


@lru_cache(maxsize=16)
def _record_form(layout: Layout) -> re.Pattern:
    """What the fast path takes for a sound record: quoting, number of fields, form of the numbers."""
    forms = []
    for _, kind in layout.fields:
        number = rf" *+(?:{_number_form(kind)})? *+"
        forms.append(_FIELD if kind == "string" else rf'(?:"{number}"|{number})')
    return re.compile(",".join(forms))


def _stands(records: list[str | None], layout: Layout) -> bool:
    """The guard of parsed records. The parser is laxer than the rule: it fills up an empty line with empty fields, ends a
    record at a carriage return, and takes quotes inside a field as they are."""
    form = _record_form(layout).fullmatch
    return all(r and "\r" not in r and form(r) for r in records)


@lru_cache(maxsize=16)
def _options(layout: Layout) -> tuple:
    names = [f for f, _ in layout.fields]
    return (
        pcsv.ParseOptions(newlines_in_values=True, ignore_empty_lines=False),
        pcsv.ConvertOptions(column_types={f: pa.string() for f in names}, strings_can_be_null=False, null_values=[]),
    )


def parse_block(records: pa.Array, layout: Layout) -> list[pa.Array] | None:
    """The typed columns of a block of records, parsed at once; None if any of them fails."""
    lines = records.to_pylist()
    block = "\n".join(x or "" for x in lines).encode()
    read = pcsv.ReadOptions(column_names=[f for f, _ in layout.fields], use_threads=False, block_size=max(1 << 12, 2 * len(block) + 2))
    try:
        table = pcsv.read_csv(pa.BufferReader(block + b"\n"), read, *_options(layout))
        if table.num_rows != len(records) or not _stands(lines, layout):
            return None
        columns = []
        for name, kind in layout.fields:
            column = pa.concat_arrays(table[name].chunks)
            if kind != "string":
                column = pc.utf8_trim(column, " ")
                column = pc.if_else(pc.equal(column, ""), pa.scalar(None, pa.string()), column)
                column = pc.cast(column, _ARROW[kind])  # a number out of range is an exception
            columns.append(column)
    except pa.ArrowException:
        return None
    return columns


Piece = tuple[int, int, str | None, list | None]


def _strictly(records: pa.Array, at: int, layout: Layout) -> Piece:
    reason, typed = read_strictly(records[at].as_py(), layout)
    return at, at + 1, reason, None if reason else [pa.array([v], _ARROW[k]) for v, (_, k) in zip(typed, layout.fields)]


def read_block(records: pa.Array, layout: Layout, smallest: int = 8, parse: Callable[[pa.Array, Layout], list[pa.Array] | None] = parse_block) -> Iterator[Piece]:
    """``(from, to, reason, columns)`` pieces of the block in order: parsed stretches with typed columns, bad records alone.

    A part that ``parse`` refuses is halved, down to ``smallest`` records (it takes as long to read some ten records strictly
    as to try one parse); those are diagnosed one by one and kept if the strict reader takes them. Of a refused part
    whose first half is parsed, the second half is known to fail and is halved without a trial.
    """
    parts = [(0, len(records), False)]
    while parts:
        a, b, fails = parts.pop()
        if a == b:
            continue
        columns = None if fails else parse(records.slice(a, b - a), layout)
        if columns is not None:
            yield a, b, None, columns
        elif b - a <= smallest:
            for at in range(a, b):
                yield _strictly(records, at, layout)
        else:
            middle = (a + b) // 2
            columns = parse(records.slice(a, middle - a), layout)
            if columns is not None:
                yield a, middle, None, columns
                parts.append((middle, b, True))
            else:
                parts += [(middle, b, False), (a, middle, True)]


def parse_records(df: DataFrame, line: str = "line", file_name: str = "file_name", layouts: Sequence[Layout] = LAYOUTS, keep: Sequence[str] = ("line_id", "file_name", "line_no"), block: int = 512) -> DataFrame:
    """``keep`` columns, ``kind`` (the layout's prefix), ``reason`` (null for a sound record) and every layout's typed fields.

    Every record comes out once: sound ones typed (their own layout's fields filled, an empty number null),
    failed ones with the reason and no fields. A null record is a blank one (one field). A file of no known
    layout gives ``unknown_file``. Repeated records are kept; an empty table gives none; columns not in
    ``keep`` are ignored. It is one scan with no shuffle.
    """
    fields: dict[str, str] = {}
    for layout in layouts:
        for name, kind in layout.fields:
            if fields.setdefault(name, kind) != kind or name in keep:
                raise ValueError(f"field {name} is ambiguous")
    kinds = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType()}
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField("kind", T.StringType()), T.StructField("reason", T.StringType()), *[T.StructField(f, kinds[k]) for f, k in fields.items()]])
    layouts, keep, nk = tuple(layouts), list(keep), len(keep)

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(nk)
            known = pa.array([False] * len(names))
            parts = []
            for layout in layouts:
                of = pc.and_not(pc.fill_null(pc.starts_with(names, layout.prefix), False), known)
                known = pc.or_(known, of)
                parts.append((layout, batch.filter(of)))
            parts.append((None, batch.filter(pc.invert(known))))
            for layout, part in parts:
                if not part.num_rows:
                    continue
                reasons: list[str | None] = []
                columns: dict[str, list[pa.Array]] = {f: [] for f in fields}
                if layout is None:
                    reasons = [UNKNOWN] * part.num_rows
                else:
                    lines = pa.concat_arrays([part.column(nk + 1)])
                    for at in range(0, part.num_rows, block):
                        for a, b, reason, typed in read_block(lines.slice(at, block), layout):
                            reasons += [reason] * (b - a)
                            for i, (f, k) in enumerate(layout.fields):
                                columns[f].append(pa.nulls(b - a, _ARROW[k]) if typed is None else typed[i])
                arrays = [pa.concat_arrays(c) if c else pa.nulls(part.num_rows, _ARROW[fields[f]]) for f, c in columns.items()]
                kind = pa.array([layout.prefix.rstrip("_") if layout else None] * part.num_rows, pa.string())
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(nk)], kind, pa.array(reasons, pa.string()), *arrays], names=schema.names)

    rows = df.select(*keep, F.col(file_name).alias("__file"), F.col(line).cast("string").alias("__line"))
    return rows.mapInArrow(parse, schema)
