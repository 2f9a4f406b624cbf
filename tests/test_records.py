"""CSV records over line breaks, in files cut into many splits, against Python's csv module."""

from __future__ import annotations

import csv
import io

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ledgerlens.schema import columns
from ledgerlens.sources import files, records

FIELD = st.text(alphabet='ab,"\n\r é', max_size=9)
NAMES = columns("products")


@pytest.fixture
def splits(spark):
    """Files are cut every few bytes."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "23")
    spark.conf.set("spark.sql.files.openCostInBytes", "5")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def as_csv(values, line_end="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=line_end).writerows(values)
    return out.getvalue()


def read(spark, path, text, header=False):
    path.write_bytes(text.encode())
    found = files.read_csv(spark, str(path), "products", header=header)
    return sorted(tuple(r[c] for c in NAMES) for r in found.collect())


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(FIELD, FIELD, FIELD), min_size=1, max_size=12))
def test_any_texts_come_back(spark, splits, tmp_path, fields):
    given_rows = [(f"P{i:02}", *f) for i, f in enumerate(fields)]
    want = sorted(tuple(v or None for v in r) for r in given_rows)
    assert read(spark, tmp_path / "x.csv", as_csv(given_rows)) == want


@pytest.mark.parametrize("line_end", ["\n", "\r\n"])
def test_long_fields_span_splits(spark, splits, tmp_path, line_end):
    long = "\n".join(f'line "{i}", of many' for i in range(40))
    given_rows = [NAMES, ("P1", long, "f", "1"), ("P2", "plain", "f", "2"), ("P3", "\n\n", 'say "x"', "3"), ("P4", long, long, "4"), ("P5", "a\r\nb", "", "5")]
    got = read(spark, tmp_path / "x.csv", as_csv(given_rows, line_end), header=True)
    assert got == sorted(tuple(v or None for v in r) for r in given_rows[1:])


def test_one_record_of_a_file_of_many_splits(spark, splits, tmp_path):
    (tmp_path / "x.csv").write_text(",".join(NAMES) + '\nP1,"a\nb",F,1.5\n' + "".join(f"P{i},N{i},F,{i}\n" for i in range(2, 60)))
    raw = files.read_csv(spark, str(tmp_path / "x.csv"), "products")
    good = files.accepted(raw, "products")
    assert good.count() == 59 and files.rejected(raw, "products").count() == 0
    assert rows(good.filter("product_id = 'P1'"), "product_name", "list_price_arr") == [("a\nb", 1.5)]


@pytest.mark.parametrize("bound", [records.BROADCAST_SPLITS, 0])
def test_several_files_and_both_joins(spark, splits, tmp_path, monkeypatch, bound):
    monkeypatch.setattr(records, "BROADCAST_SPLITS", bound)
    for name in "ab":
        text = as_csv([NAMES] + [(f"{name}{i}", f"x\ny{i}" * (i % 5), "f,g", str(i)) for i in range(30)])
        (tmp_path / f"{name}.csv").write_text(text)
    raw = files.read_csv(spark, str(tmp_path), "products")
    got = rows(files.accepted(raw, "products"), "product_id", "product_name")
    assert got == sorted(((f"{n}{i}", f"x\ny{i}" * (i % 5) or None) for n in "ab" for i in range(30)), key=repr)


def test_stray_quotes_open_nothing(spark, splits, tmp_path):
    text = 'P1,5" pipe,F,1\nP2,"q""q",F,2\nP3,a"b"c,F,3\nP4,"x"y,F,4\nP5,z,F,5\n'
    got = {r[0]: r[1] for r in read(spark, tmp_path / "x.csv", text)}
    assert got["P1"] == '5" pipe' and got["P2"] == 'q"q' and got["P3"] == 'a"b"c' and got["P5"] == "z" and len(got) == 5


def test_field_that_never_closes_is_one_broken_record(spark, splits, tmp_path):
    (tmp_path / "x.csv").write_text('P1,a,F,1\nP2,"b,F,2\nP3,c,F,3\n')
    raw = files.read_csv(spark, str(tmp_path / "x.csv"), "products", header=False)
    assert rows(files.accepted(raw, "products"), "product_id") == [("P1",)]
    assert files.rejected(raw, "products").count() == 1


def test_wrong_header_of_a_quoted_file(spark, tmp_path):
    (tmp_path / "x.csv").write_text('product_name,product_id,product_family,list_price_arr\n"a\nb",P1,F,1\n')
    with pytest.raises(Exception, match="header"):
        files.read_csv(spark, str(tmp_path / "x.csv"), "products").collect()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='a,"', max_size=12), st.booleans())
def test_open_fields_by_the_letter(line, inside):
    state = "in" if inside else "begin"
    for c in line:
        if state == "in":
            state = "quote" if c == '"' else "in"
        elif state == "quote":
            state = "in" if c == '"' else "begin" if c == "," else "rest"
        else:
            state = "in" if state == "begin" and c == '"' else "begin" if c == "," else "rest"
    assert records.open_after(line, inside) == (state == "in")
