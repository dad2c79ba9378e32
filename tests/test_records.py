import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.operators.records import LAYOUTS, parse_block, parse_records, read_block, read_strictly

PLACES, STAFF = LAYOUTS
CASES = [
    ("1,Ann,30,5,1000", None), ("1,Ann,30,5", "column_count"), ("", "column_count"), ("   ", "column_count"), (None, "column_count"), ("1,Ann,30,5,1000,", "column_count"),
    ('1,"Ann, Dr.",30,5,1000', None), ('1,"Ann ""A"" B",30,5,1000', None), ('1,"Ann,30,5,1000', "quoting"), ('1,An"n,30,5,1000', "quoting"), ('1,"An"n,30,5,1000', "quoting"), ('1,"Ann" ,30,5,1000', "quoting"),
    (' 1 ,Ann, +30 ,-5,', None), ("1,Ann,3O,5,1000", "value"), ("1,Ann,30.0,5,1000", "value"), ("0x1F,Ann,30,5,1000", "value"), ("1,Ann,2147483648,5,1", "value"), ("1,Ann,-2147483648,5,1", None),
    ("9223372036854775807,Ann,1,1,1", None), ("9223372036854775808,Ann,1,1,1", "value"), ("1,Ann,30,5,1000\r", "value"), ("1,Ann,\t30,5,1000", "value"), ("1,Ann,٣,5,1000", "value"), ('1,"Ann\nB",30,5,"7"', None), ("1,Ann\nB,30,5,7", None), ("1,,,,", None), (",,,,", None), ("1\\,Ann,30,5,7", "value"),
    ("9" * 6000 + ",Ann,30,5,7", "value"), ("0" * 6000 + "7,Ann,30,5,7", None),
]


@pytest.mark.parametrize("line,reason", CASES)
def test_strict_reader(line, reason):
    assert read_strictly(line, STAFF)[0] == reason


def strict_rows(lines, layout):
    return [(r, None if r else tuple(f)) for r, f in (read_strictly(x, layout) for x in lines)]


def block_rows(lines, layout, smallest=1):
    out = []
    for a, b, reason, columns in read_block(pa.array(lines, pa.string()), layout, smallest):
        assert a == len(out)
        out += [(reason, None)] if reason else [(None, row) for row in zip(*[c.to_pylist() for c in columns])]
        assert b == len(out)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3, 8])
def test_bisected_blocks_equal_the_strict_reader(seed):
    lines = [x for x, _ in CASES] * 3 + ["5,Bo,40,2,9"] * 200
    random.Random(seed).shuffle(lines)
    assert block_rows(lines, STAFF, seed) == strict_rows(lines, STAFF)
    assert block_rows([x for x in lines if x is not None][:seed], STAFF) == strict_rows([x for x in lines if x is not None][:seed], STAFF)


@pytest.mark.parametrize("bad", [0, 1, 2, 5, 20, 512])
def test_parser_calls_grow_with_the_bad_records(bad):
    """It is the parser's refusal that halves a block: one call if all is sound, else at most two a level and bad record."""
    lines = ["5,Bo,40,2,9"] * 512
    for i in random.Random(bad).sample(range(512), bad):
        lines[i] = ["5,Bo,40,2", '5,"Bo,40,2,9', "5,Bo,4O,2,9", "5,Bo,99999999999,2,9"][i % 4]
    calls = []

    def counted(records, layout):
        calls.append(len(records))
        return parse_block(records, layout)

    pieces = list(read_block(pa.array(lines), STAFF, 1, counted))
    assert sum(reason is not None for *_, reason, _ in pieces) == bad and calls[0] == 512
    # nine levels of halves, each with a trial of the first half and perhaps of the second
    assert max(1, bad) <= len(calls) <= 1 + min(18 * bad, 1022)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet='a,"1\n\r. +-é', max_size=12), min_size=1, max_size=9))
def test_any_text_is_read_alike(lines):
    assert block_rows(lines, PLACES) == strict_rows(lines, PLACES)
    lines = [f"x,y,z,{x}" for x in lines]
    assert block_rows(lines, PLACES) == strict_rows(lines, PLACES)


@pytest.mark.parametrize("number,reason", [("1.5", None), ("-0.25", None), ("+7", None), ("1.", "value"), (".5", "value"), ("1e3", "value"), ("nan", "value"), ("inf", "value"), ("1,5", "column_count"), ("", None)])
def test_temperatures(number, reason):
    assert block_rows([f"Asia,A,B,{number}"] * 9, PLACES) == strict_rows([f"Asia,A,B,{number}"] * 9, PLACES)
    assert read_strictly(f"Asia,A,B,{number}", PLACES)[0] == reason


def test_parse_records(spark):
    rows = [(i, "employees_1.csv", i, line, "extra") for i, (line, _) in enumerate(CASES)] + [(900, "continents_countries_temp_1.csv", 1, "Asia,A,B,1.5", "e"), (901, "other.csv", 1, "x", "e"), (902, None, 1, "x", "e"), (900, "continents_countries_temp_1.csv", 1, "Asia,A,B,1.5", "e")]
    got = parse_records(spark.createDataFrame(rows, "line_id bigint, file_name string, line_no int, line string, kind string")).collect()
    assert len(got) == len(rows)
    by = {r.line_id: r for r in got}
    assert [by[i].reason for i in range(len(CASES))] == [reason for _, reason in CASES]
    assert by[900].temperature == 1.5 and by[900].id is None and by[900].kind == "continents_countries_temp"
    assert by[901].reason == by[902].reason == "unknown_file"
    assert parse_records(spark.createDataFrame([], "line_id bigint, file_name string, line_no int, line string")).count() == 0


def test_very_long_record(spark):
    name = "x" * 2_000_000
    got = parse_records(spark.createDataFrame([(1, "employees_1", 1, f"1,{name},3,4,5"), (2, "employees_1", 2, f'1,"{name},3,4,5')], "line_id bigint, file_name string, line_no int, line string")).collect()
    assert {r.line_id: (r.reason, r.name and len(r.name)) for r in got} == {1: (None, len(name)), 2: ("quoting", None)}
