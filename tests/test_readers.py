import csv
import io
import json
import random

import pytest
from pyspark.sql import types as T

from labelgrid.sources import files as fi
from labelgrid.sources.pieces import nested_entries

RANGE_KEYS = {"spark.sql.files.maxPartitionBytes": "97b", "spark.sql.files.openCostInBytes": "0b", "spark.sql.files.minPartitionNum": "1"}
ODD = ["plain", 'say "so"', "a,b", "two\nlines", "\n\n", "", "{[", "]}", "é–ñ", 'end"', "\\", 'x\\"y', "windows\r\nend", ",", '"']


@pytest.fixture
def short_ranges(spark):
    """Ranges far shorter than many records."""
    for key, value in RANGE_KEYS.items():
        spark.conf.set(key, value)
    yield spark
    for key in RANGE_KEYS:
        spark.conf.unset(key)


def texts(seed, n):
    rng = random.Random(seed)
    return [" ".join(rng.choice(ODD) for _ in range(rng.choice([0, 1, 2, 3, 40]))) for _ in range(n)]


@pytest.mark.parametrize("quoting", [csv.QUOTE_MINIMAL, csv.QUOTE_ALL])
def test_csv_in_ranges(short_ranges, tmp_path, quoting):
    expected = []
    for part in range(3):
        out = io.StringIO()
        writer = csv.writer(out, quoting=quoting, lineterminator="\r\n" if part == 1 else "\n")
        writer.writerow(["query_id", "query", "type"])
        for i, text in enumerate(texts(part, 60)):
            writer.writerow([f"q{part}_{i}", "x" + text + "x", "kind"])
            expected.append((f"q{part}_{i}", "x" + text + "x"))
        (tmp_path / f"q{part}.csv").write_bytes(out.getvalue().encode())
    rows = fi.read_queries(short_ranges, str(tmp_path / "*.csv"))
    assert sorted((r["query_id"], r["text"]) for r in rows.collect()) == sorted(expected)


def test_csv_header_must_match(spark, tmp_path):
    (tmp_path / "q.csv").write_text("query_id,text,type\n1,b,c\n")
    with pytest.raises(Exception, match="unexpected header"):
        fi.read_queries(spark, str(tmp_path / "q.csv")).collect()
    (tmp_path / "short.csv").write_text("query_id,query,type\n1,b\n")
    with pytest.raises(Exception):
        fi.read_queries(spark, str(tmp_path / "short.csv")).collect()
    (tmp_path / "mark.csv").write_bytes("﻿query_id,query,type\n\n1,b,c".encode())
    assert [tuple(r) for r in fi.read_queries(spark, str(tmp_path / "mark.csv")).collect()] == [("1", "b", "c")]
    (tmp_path / "none.csv").write_text("")
    assert fi.read_queries(spark, str(tmp_path / "none.csv")).collect() == []


@pytest.mark.parametrize("layout", [{}, {"indent": 2}, {"separators": (",", ":")}, {"ensure_ascii": False}])
def test_nested_object_in_ranges(short_ranges, tmp_path, layout):
    made = {}
    for k, name in enumerate(["f", "a,b", 'q"{', "\\", "none", "one"]):
        made[name] = {} if name == "none" else {f"{i},{k}": t for i, t in enumerate(texts(k, 1 if name == "one" else 40))}
    (tmp_path / "cache.json").write_text(json.dumps(made, **layout) + "\n")
    rows = fi.read_text_cache(short_ranges, str(tmp_path / "cache.json")).collect()
    assert sorted(tuple(r) for r in rows) == sorted((f, i, t) for f, items in made.items() for i, t in items.items())


def test_rankings_in_ranges(short_ranges, tmp_path):
    made = {f"q{q}": {s: [f"{q}_{i}" for i in range(n)] for s, n in (("a", 30), ("b", 0), ("c", 1))} for q in range(6)}
    (tmp_path / "rank.json").write_text(json.dumps(made))
    rows = fi.read_rankings(short_ranges, str(tmp_path / "rank.json")).collect()
    assert {(r["query_id"], r["system"], r["rank"], r["item_id"]) for r in rows} == {
        (q, s, n + 1, i) for q, systems in made.items() for s, ids in systems.items() for n, i in enumerate(ids)}


def test_objects_without_entries(spark, tmp_path):
    for name, text in (("a", "{}"), ("b", '{"x": {}}\n'), ("c", ""), ("d", "\n")):
        (tmp_path / f"{name}.json").write_text(text)
    assert nested_entries(spark, str(tmp_path / "*.json"), T.StringType()).collect() == []
    (tmp_path / "bad.json").write_text('{"x": {"y": 1, "z": oh}}')
    with pytest.raises(Exception):
        nested_entries(spark, str(tmp_path / "bad.json"), T.IntegerType()).collect()
