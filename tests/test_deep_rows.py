"""Rows in nested texts against a plain walk of any depth."""

import json

from slate.sources import pages


def walk(value, under=None):
    if isinstance(value, dict) and value.get("GameDate") is not None:
        return [(str(value["GameDate"]), str(value["name"]) if value.get("name") is not None else None, under)]
    below = value.items() if isinstance(value, dict) else [(None, v) for v in value] if isinstance(value, list) else []
    return [r for k, v in below for r in walk(v, k if k is not None and k.isdigit() else under)]


def nested(levels):
    out = {"GameDate": f"d{levels}", "name": "n"}
    for i in range(levels):
        out = [out, 1, "x", None] if i % 3 == 0 else {str(i) if i % 4 == 1 else f"k{i}": out, "other": {}}
    return out


def test_any_depth(spark):
    texts = [nested(n) for n in (0, 1, 5, 40)]
    texts += [{"1": {"a": [{"GameDate": 3}, {"GameDate": None, "2": [{"GameDate": "x", "name": {"k": 1}, "3": {"GameDate": "inside"}}]}]}}, [], {}, 7, "text", None]
    rows = [(i, json.dumps(t)) for i, t in enumerate(texts)] + [(90, "no json {"), (91, None), (92, ""), (None, json.dumps({"5": [{"GameDate": 1, "name": "a"}]}))]
    found = pages.deep_rows(spark.createDataFrame(rows, "source_id int, body string"), "GameDate", ["GameDate", "name"]).collect()
    want = [(i, *r) for i, t in enumerate(texts) for r in walk(t)] + [(None, "1", "a", "5")]
    want = [(i, d, n if n is None or not n.startswith("{") else '{"k":1}', u) for i, d, n, u in want]
    assert sorted(((r.source_id, r.GameDate, r.name, r.under) for r in found), key=str) == sorted(want, key=str)


def test_no_texts(spark):
    assert pages.deep_rows(spark.createDataFrame([], "source_id int, body string"), "GameDate", ["GameDate"]).count() == 0
