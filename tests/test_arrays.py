"""JSON arrays in and out, against Python's json and the published number format."""

import gzip
import json
import math
import random

import pytest

from vicinity.schemas import REFERENCE_JSON
from vicinity.sources import arrays


def c_number(v):
    if v == math.floor(v) and abs(v) < 1e15:
        return f"{v:.0f}"
    return f"{v:.10f}".rstrip("0").rstrip(".")


def records(n):
    rng = random.Random(5)
    return [None if rng.random() < 0.1 else {"vector": [round(rng.random(), 4) for _ in range(14)], "label": rng.choice(["fraud", "legit", 'a "q" \\ [x], é'])} for _ in range(n)]


@pytest.mark.parametrize("indent", [None, 2])
def test_arrays_are_read_record_by_record(spark, tmp_path, indent):
    """Gzipped, plain in one part, plain in many parts: nulls are skipped, positions are those in the file."""
    given = [None, None, *records(400), None]
    kept = [r for r in given if r]
    text = json.dumps(given, indent=indent, ensure_ascii=False)
    (tmp_path / "plain.json").write_text(text)
    with gzip.open(tmp_path / "packed.json.gz", "wt") as f:
        f.write(text)
    for name, size in (("plain.json", "128m"), ("packed.json.gz", "128m"), ("plain.json", "4k")):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            found = arrays.read_array(spark, str(tmp_path / name), REFERENCE_JSON)
            rows = sorted(map(tuple, found.collect()))
            assert size != "4k" or found.rdd.getNumPartitions() > 3
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert [(i, v, label) for i, v, label in rows] == [(i, r["vector"], r["label"]) for i, r in enumerate(kept)]


def test_empty_and_broken_files(spark, tmp_path):
    for name, text in (("a", "[]"), ("b", ""), ("c", "[null, null]\n"), ("d", '[{"vector": [1], "label": "x}"}]')):
        (tmp_path / name).write_text(text)
    found = {n: arrays.read_array(spark, str(tmp_path / n), REFERENCE_JSON).collect() for n in "abcd"}
    assert found["a"] == found["b"] == found["c"] == [] and found["d"][0].label is None


def test_numbers(spark):
    values = [0.0, -0.0, 1.0, 0.1, -2.5, 1e14, 123456789.5, 0.1234567891, 1e-5, 1e-12, 1 / 3, 2e15, 100.0, -1e-7]
    found = spark.createDataFrame([(v,) for v in values], "v double").select(arrays.number(arrays.F.col("v"))).collect()
    assert [r[0] for r in found] == [c_number(v) for v in values]


def test_written_arrays(spark, tmp_path):
    rows = [(1, [0.25, 1.0], 'a "b"\n', None, (2.5, None)), (2, [], "", True, (1e-3, "é")), (None, None, None, False, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>, s string, b boolean, o struct<x: double, y: string>").repartition(3)
    for pretty in (False, True):
        path = tmp_path / f"out{pretty}"
        arrays.write_array(df.orderBy("id"), str(path), pretty=pretty)
        (file,) = path.glob("*.txt")
        text = file.read_text()
        expected = [{"id": i, "v": v, "s": s, "b": b, "o": o and {"x": o[0], "y": o[1]}} for i, v, s, b, o in sorted(rows, key=lambda r: r[0] or 0)]
        assert json.loads(text) == expected
        if not pretty:
            assert text.replace("\n", "") == '[{"id":null,"v":null,"s":null,"b":false,"o":null},{"id":1,"v":[0.25,1],"s":"a \\"b\\"\\n","b":null,"o":{"x":2.5,"y":null}},{"id":2,"v":[],"s":"","b":true,"o":{"x":0.001,"y":"é"}}]'
        else:
            assert '{\n\t\t"id":\t1,\n\t\t"v":\t[0.25, 1],' in text and '"o":\t{\n\t\t\t"x":\t2.5,\n\t\t\t"y":\tnull\n\t\t}\n\t}' in text
    arrays.write_array(df, str(tmp_path / "parts"), single=False, compression="gzip")
    parts = sorted((tmp_path / "parts").glob("*.gz"))
    assert len(parts) > 1 and len(json.loads("".join(gzip.open(p, "rt").read() for p in parts))) == 3
    arrays.write_array(df.where("false"), str(tmp_path / "none"))
    assert [p.read_text() for p in (tmp_path / "none").glob("*.txt")] == ["[]\n"]
