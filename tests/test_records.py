"""Delimited text with quoted line breaks in byte ranges, and folders of several dialects."""

import csv
import io
import random

import pytest

from tabwright.session import LIMITS
from tabwright.sources import delimited, records


@pytest.fixture
def small_ranges(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    open_cost = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    spark.conf.set("spark.sql.files.openCostInBytes", open_cost)


def random_rows(r, n):
    def cell():
        kind = r.random()
        if kind < 0.3:
            return "".join(r.choice('ab,;"\n é') for _ in range(r.randrange(1, 30))) + "z"
        if kind < 0.35:
            return "\n".join('say ""' for _ in range(r.randrange(30, 90))) + "z"  # longer than several ranges
        return "".join(r.choice("abc") for _ in range(r.randrange(1, 8)))

    return [(f"{i}x", cell(), cell()) for i in range(n)]


def written(rows, delimiter, always=False, end="\n"):
    out = io.StringIO()
    writer = csv.writer(out, delimiter=delimiter, lineterminator=end, quoting=csv.QUOTE_ALL if always else csv.QUOTE_MINIMAL)
    writer.writerows([("key", "left", "right"), *rows])
    return out.getvalue()


@pytest.mark.parametrize("seed", [1, 2])
def test_ranges_give_the_records_of_one_task(spark, tmp_path, small_ranges, seed):
    r = random.Random(seed)
    rows = []
    for k in range(3):
        some = [(f"{k}_{a}", b, c) for a, b, c in random_rows(r, 40)]
        rows += some
        text = written(some, ";", always=k == 1, end="\r\n" if k == 2 else "\n")
        (tmp_path / f"part {k}.csv").write_bytes(text.encode())
    states = records.range_states(records._with_states(records.text_lines(spark, str(tmp_path)), ";"))
    assert states.count() > 8 and states.where("open").count() > 1
    got = delimited.read_delimited(spark, str(tmp_path), infer=False)
    assert sorted(map(tuple, got.collect())) == sorted(rows)
    whole = delimited.read_delimited(spark, str(tmp_path), infer=False, multiline=True)
    assert sorted(map(tuple, whole.collect())) == sorted(rows)


def test_many_ranges_are_joined_without_a_broadcast(spark, tmp_path, small_ranges, monkeypatch):
    rows = random_rows(random.Random(9), 80)
    (tmp_path / "a.csv").write_text(written(rows, ","))
    monkeypatch.setattr(records, "LIMITS", type(LIMITS)(broadcast_rows=1))
    got = delimited.read_delimited(spark, str(tmp_path), infer=False)
    assert sorted(map(tuple, got.collect())) == sorted(rows)


def test_odd_files(spark, tmp_path, small_ranges):
    (tmp_path / "b.csv").write_bytes(b'\xef\xbb\xbfkey,left,right\r\n"q\r\n""z""",7,\r\n\r\nlast,"open\nto the end')
    got = sorted(map(tuple, delimited.read_delimited(spark, str(tmp_path), infer=False).collect()))
    assert got == [("last", "open\nto the end", None), ('q\r\n"z"', "7", None)] or got == [('last', '"open\nto the end', None), ('q\r\n"z"', "7", None)]


def test_a_folder_of_several_dialects(spark, tmp_path):
    (tmp_path / "1.csv").write_bytes("name;v\nMüller;1\nÉtage;2\n".encode("latin-1"))
    (tmp_path / "2 x.csv").write_bytes('v,name,w\n3,"a\nb",x\n4,日本,\n'.encode())
    (tmp_path / "3.csv").write_bytes("name;v\n日;5\n".encode())
    (tmp_path / "4.csv").write_bytes(b"\n \n")
    df = delimited.read_delimited(spark, str(tmp_path))
    assert dict(df.dtypes) == {"name": "string", "v": "bigint", "w": "string"}
    assert sorted((r["v"], r["name"], r["w"]) for r in df.collect()) == [(1, "Müller", None), (2, "Étage", None), (3, "a\nb", "x"), (4, "日本", None), (5, "日", None)]
    seen = {r["file"][-5:]: (r["encoding"], r["delimiter"], r["header"]) for r in delimited.file_dialects(spark, str(tmp_path)).collect()}
    assert seen["1.csv"] == ("ISO-8859-1", ";", b"name;v") and seen["x.csv"][:2] == ("UTF-8", ",") and seen["4.csv"][2] is None
    (tmp_path / "5.csv").write_text("a| a\n1|2\n")
    with pytest.raises(ValueError, match="repeated"):
        delimited.read_delimited(spark, str(tmp_path))


def test_a_latin_file_with_line_breaks(spark, tmp_path, small_ranges):
    rows = [(f"k{i}", "é\n" * 20 + "ü", "ß") for i in range(12)]
    (tmp_path / "l.csv").write_bytes(written(rows, "|").encode("latin-1"))
    got = delimited.read_delimited(spark, str(tmp_path), infer=False)
    assert sorted(map(tuple, got.collect())) == sorted(rows)


def test_records_are_cut_once(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text\n1,"a\nb"\n2,"c ""d"" e"\n')
    found = records.quoted_records(spark, [str(tmp_path / "a.csv")], ",")
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()
    assert [bytes(r["value"]) for r in found.orderBy("value").collect()] == [b'1,"a\nb"', b'2,"c ""d"" e"', b"id,text"]
