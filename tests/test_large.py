"""Files read in splits give what reading them whole gives, wherever the splits fall."""

import json
import random

import pytest
from pyspark.sql import functions as F

from fablens.plans.source_queries import small_splits
from fablens.sources import files, large


def some_value(rng, depth=0):
    kind = rng.randrange(8 if depth < 3 else 5)
    if kind < 5:
        return rng.choice([1, 2.5, True, None, "plain", 'q"u\\o{t}e', "[,]{}", "ende\\", "ünï ", "}" * 5, ""])
    if kind == 5:
        return [some_value(rng, depth + 1) for _ in range(rng.randrange(3))]
    return {rng.choice("abc{]") + str(i): some_value(rng, depth + 1) for i in range(rng.randrange(1, 4))}


def documents():
    rng = random.Random(11)
    items = [{"n": i, **{k: some_value(rng) for k in "xyz"}} if i % 9 else rng.choice([1, "text }", [1, 2], None]) for i in range(40)]
    return {
        "list": json.dumps(items),
        "spaced": "\n " + json.dumps(items, indent=2, ensure_ascii=False) + "\n\n",
        "member": json.dumps({"a": {"b": [9, {"c": [8]}]}, "s": "[", "rows": items, "more": [{"no": 1}]}),
        "object": json.dumps({"a": {"b": [9]}, "s": "no list here }"}),
        "empty": "[ ]",
        "empty_member": '{"rows": [], "more": [1]}',
        "one": '[{"only": "record"}]',
        "open": json.dumps(items)[:-1],
        "open_string": '[{"a": "b}]',
        "no_json": "just text",
        "long": json.dumps([{"n": 1}, {"text": "} ] , " * 900}, {"n": 3}]),
    }


@pytest.mark.parametrize("size, window", [(1500, 200), (1 << 20, 1 << 20)])
def test_json_documents(spark, tmp_path, monkeypatch, size, window):
    monkeypatch.setattr(large, "WINDOW", window)
    for name, text in documents().items():
        (tmp_path / name).write_text(text, encoding="utf-8", newline="")
    with small_splits(spark, size):
        got = large.read_json_documents(spark, str(tmp_path)).withColumn("name", F.element_at(F.split("file", "/"), -1)).collect()
    whole = spark.createDataFrame(list(documents().items()), "name string, text string")
    want = files.parse_json_logs(whole, "text").collect()
    as_rows = lambda rows: sorted(((r.name, r.record_index, r.raw_fields, r.error) for r in rows), key=repr)
    assert as_rows(got) == as_rows(want)


@pytest.mark.parametrize("size", [300, 1 << 20])
def test_dump_blocks(spark, tmp_path, size):
    rng = random.Random(12)
    words = lambda n: [f"{i}\t{rng.choice(['a', 'COPY', '-- x', 'b c'])}" for i in range(n)]
    tables = {"public.one": words(80), "two": words(1), "public.none": [], "three": words(120)}
    tables["two"].append("COPY public.one (a, b) FROM stdin;")  # a line of the table
    lines = ["-- dump", "\\.", ""]
    for name, rows in tables.items():
        lines += [f'COPY {name} ("a", b) FROM stdin;', *rows, "\\.", "", "SELECT 1;"]
    lines += ["COPY late (a) FROM stdin;", "unfinished"]
    (tmp_path / "first.sql").write_text("\n".join(lines))
    (tmp_path / "second.sql").write_text("COPY two (a, b) FROM stdin;\nx\ty\n\\.\n")
    with small_splits(spark, size):
        got = large.dump_blocks(spark, str(tmp_path)).collect()
        one = large.read_dump_table(spark, str(tmp_path), "one", "a int, b string").collect()
        assert large.read_dump_table(spark, str(tmp_path), "missing", "a int").count() == 0
    want = [(t, r) for t, rows in tables.items() for r in rows] + [("late", "unfinished"), ("two", "x\ty")]
    assert sorted((r["table"], r["value"]) for r in got) == sorted(want)
    assert {tuple(r["columns"]) for r in got if r["table"] != "late"} == {("a", "b")}
    assert sorted((r.a, r.b) for r in one) == sorted((int(i), w) for i, w in (r.split("\t") for r in tables["public.one"]))


@pytest.mark.parametrize("size", [100, 1 << 20])
def test_dump_in_parts(spark, tmp_path, size):
    """A block that begins in one file of a dump and ends in another, with lines that look like headers at the cuts."""
    rows = [f"{i}\t{'x' * (i % 40)}" for i in range(200)]
    rows[60:60] = ["COPY other (a, b) FROM stdin;"]
    lines = ["-- dump", "COPY one (a, b) FROM stdin;", *rows, "\\.", "COPY two (a, b) FROM stdin;", "1\ttwo", "\\."]
    for part, at in enumerate(range(0, len(lines), 31)):
        (tmp_path / f"part-{part:03d}").write_text("\n".join(lines[at:at + 31]) + "\n")
    with small_splits(spark, size):
        got = large.dump_blocks(spark, str(tmp_path), parts=True).collect()
    assert sorted((r["table"], r["value"]) for r in got) == sorted([*(("one", r) for r in rows), ("two", "1\ttwo")])


def test_small_splits_share_tasks(spark, tmp_path):
    (tmp_path / "lines").write_text("some line\n" * 20_000)
    with small_splits(spark, 1000):
        pieces = large._splits(spark, str(tmp_path), "\n")
        assert pieces.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
        assert pieces.select("file", "start").distinct().count() == 200 and pieces.count() == 20_000
