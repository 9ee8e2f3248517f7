"""A JSON document read by ranges, wherever they are cut, against the plain reader."""

import json
import random

import pytest

from weftgraph.sources import document, files
from weftgraph.sources.document import File, _Range, elements, read_document, summary


def some_document(rng):
    text = lambda: "".join(rng.choice('ab{}[]":,\\\\\n é😀') for _ in range(rng.randint(0, 12)))
    value = lambda d: rng.choice([text(), rng.random(), None, True, [], {}]) if d == 0 else rng.choice([[value(d - 1) for _ in range(rng.randint(0, 3))], {text(): value(d - 1) for _ in range(rng.randint(0, 3))}, text()])
    record = lambda: {"id": text(), **{text(): value(2) for _ in range(rng.randint(0, 3))}}
    return {"v" + text(): text(), "first": [record() for _ in range(rng.randint(0, 8))], "n": 3, "named": {f"k{i}{text()}": record() for i in range(rng.randint(0, 5))}, "none": [], "last": [record() for _ in range(rng.randint(0, 4))]}


def ranges(file, size):
    out, in_string, depth = [], False, 0
    for begin in range(0, file.size, size):
        end = min(file.size, begin + size)
        out.append(_Range(begin, end, in_string, depth))
        odd, outside, inside = summary(file.bytes(file.start(begin), file.start(end)))
        depth += inside if in_string else outside
        in_string ^= odd
    assert depth == 0 and not in_string
    return out


@pytest.mark.parametrize("indent", [None, 1])
def test_any_cut_gives_the_same_elements(tmp_path, indent):
    rng = random.Random(7)
    for k in range(25):
        doc = some_document(rng)
        path = tmp_path / f"{k}.json"
        path.write_text(json.dumps(doc, indent=indent, ensure_ascii=k % 2 == 0), encoding="utf-8")
        want = [(None, r) for r in doc["first"]] + [(key, r) for key, r in doc["named"].items()] + [(None, r) for r in doc["last"]]
        file = File(str(path))
        for size in (1, 2, 3, 7, 50, 1 << 20):
            rows = [r for part in ranges(file, size) for r in elements(file, part)]
            got = [(key, json.loads(raw)) for kind, _, key, raw in rows if kind == "element"]
            assert got == want
            head = json.loads("".join(raw for kind, _, _, raw in rows if kind == "head"))
            assert {k: [] if v == {} else v for k, v in head.items()} == {k: [] if isinstance(v, (list, dict)) else v for k, v in doc.items()}


def test_sections_over_spark(spark, tmp_path):
    doc = some_document(random.Random(1))
    (tmp_path / "d.json").write_text(json.dumps(doc))
    head, rows = read_document(spark, str(tmp_path / "d.json"), 100)
    assert len(document.states(spark, str(tmp_path / "d.json"), 100)) > 3
    got = [(r.section, r.key, json.loads(r.raw)) for r in rows.orderBy("place").collect()]
    assert got == [("first", None, x) for x in doc["first"]] + [("named", k, x) for k, x in doc["named"].items()] + [("last", None, x) for x in doc["last"]]
    assert list(head) == list(doc)


def test_a_broken_document_raises(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"a": [{"b": 1}, {"c": ')
    with pytest.raises(ValueError, match="close"):
        read_document(spark, str(tmp_path / "d.json"), 8)


def test_a_task_reads_many_small_ranges(spark, tmp_path):
    doc = {"a": [{"id": f"{i} {{", "x": "y" * 40} for i in range(2000)], "b": []}
    path = str(tmp_path / "d.json")
    (tmp_path / "d.json").write_text(json.dumps(doc))
    at = document.states(spark, path, 1000)
    read = spark.read.format("json_elements").option("path", path).option("states", json.dumps(at))
    spark.dataSource.register(document.JsonElements)
    assert len(at) > 100 and read.load().rdd.getNumPartitions() < 5
    assert [json.loads(r.raw) for r in read_document(spark, path, 1000)[1].orderBy("place").collect()] == doc["a"]


def test_an_export_is_written_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "COPY", 3)
    rows = spark.range(7).repartition(3).selectExpr("to_json(named_struct('id', id, 'text', ',\n    ')) as raw")
    files.write_export(spark, {"n": 1}, {"a": rows, "none": rows.limit(0), "b": rows.where("id = 3")}, str(tmp_path / "e.json"))
    got = json.loads((tmp_path / "e.json").read_text())
    assert got["n"] == 1 and got["none"] == [] and [x["id"] for x in got["b"]] == [3] and sorted(x["id"] for x in got["a"]) == list(range(7))
