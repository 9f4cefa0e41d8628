"""Broken lines are counted and kept; none becomes NULL unseen."""

import pytest

from altscore.sources import io as IO

SCHEMA = "id long, name string, amount double"


def _read(spark, tmp_path, lines, fmt, header):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / f"part.{fmt}").write_text("\n".join(lines) + "\n")
    schema = spark.createDataFrame([], SCHEMA).schema
    rows, bad = IO.scan_checked(spark, str(tmp_path / "in"), schema, fmt, header)
    bad = bad.collect()
    assert all(r.file.endswith(f"part.{fmt}") for r in bad)
    return sorted(map(tuple, rows.collect())), {r.line: r.reason for r in bad}


def test_csv(spark, tmp_path):
    lines = ["id,name,amount", "1,a,1.5", "2,b,", "x,c,2.5", "4,d,many", "5,e", "6,f,1.0,extra", "y,g,z", '7,"q, r",3']
    rows, bad = _read(spark, tmp_path, lines, "csv", True)
    assert rows == [(1, "a", 1.5), (2, "b", None), (7, "q, r", 3.0)]
    assert bad == {"x,c,2.5": "id is not bigint", "4,d,many": "amount is not double", "5,e": "wrong number of fields",
                   "6,f,1.0,extra": "wrong number of fields", "y,g,z": "id is not bigint; amount is not double"}


def test_json(spark, tmp_path):
    lines = ['{"id": 1, "name": "a", "amount": 1.5}', '{"id": 2, "name": "b"}', '{"id": "x", "name": "c", "amount": 2}', '{"id": 4, "na', "nothing"]
    rows, bad = _read(spark, tmp_path, lines, "json", False)
    assert rows == [(1, "a", 1.5), (2, "b", None)]
    assert bad == {lines[2]: "id is not bigint", lines[3]: "not a JSON object", lines[4]: "not a JSON object"}


def test_unknown_formats(spark):
    with pytest.raises(ValueError):
        IO.scan_checked(spark, "x", None, "xml")
