"""Parsing and standardisation on small literal inputs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fablens.functions import classify, scoring, standardize
from fablens.operators import joins
from fablens.operators.skew import lookup_join
from fablens.sources import files as S
from fablens.sources import large

AS_OF = dt.datetime(2024, 5, 1)


def documents(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, doc string")


def records(parsed):
    rows = standardize.canonical_record(parsed.filter("error is null"), F.lit(AS_OF)).orderBy("id", "record_index")
    return [(r["source"], r["event_type"], r["severity"], r["message"], r["timestamp"]) for r in rows.collect()]


def test_json_object(spark):
    doc = ('{"timestamp":"2023-09-05T06:07:08","source":"etcher-7","event_type":"door_open",'
           '"severity":"WARNING","message":"front door left ajar"}')
    assert records(S.parse_json_logs(documents(spark, doc), "doc")) == [
        ("etcher-7", "door_open", "warning", "front door left ajar", dt.datetime(2023, 9, 5, 6, 7, 8))
    ]


def test_json_array_keeps_order(spark):
    levels = ["CRITICAL", "WARNING", "ERROR"]
    doc = "[" + ",\n".join(f'{{"source":"u{i}","severity":"{level}","message":"m{i}"}}' for i, level in enumerate(levels)) + "]"
    got = records(S.parse_json_logs(documents(spark, doc), "doc"))
    assert [(r[0], r[2]) for r in got] == [("u0", "critical"), ("u1", "warning"), ("u2", "error")]


@pytest.mark.parametrize("given,expected", [
    ("CRITICAL", "critical"), ("ERROR", "error"), ("WARNING", "warning"), ("INFO", "info"), ("DEBUG", "info"),
    ("warn", "warning"), ("UNKNOWN_SEV", "info"),
])
def test_severity(spark, given, expected):
    got = records(S.parse_json_logs(documents(spark, f'{{"source":"m5","severity":"{given}"}}'), "doc"))
    assert got[0][2] == expected


def test_data_quality(spark):
    docs = documents(
        spark,
        '{"timestamp":"2023-09-05T01:00:00","message":"nobody said who"}',
        '{"source":"u6","event_type":"probe","message":"nobody said when"}',
        '{"timestamp":"yesterday","source":"u6","event_type":"probe","severity":"ERROR","message":"x"}',
        '{"source":null,"Level":"error","LEVEL":"info","msg":""}',
    )
    got = records(S.parse_json_logs(docs, "doc"))
    assert got[0][:2] == ("unknown", "unknown")
    assert got[1][4] == AS_OF and got[2][4] == AS_OF
    assert got[3][0] == "unknown" and got[3][2] == "error" and got[3][3] == ""


def test_json_shapes_and_errors(spark):
    docs = documents(
        spark, '{"site":"[x","rows":[{"a":{"b":{"c":"007"}}},3,"t"]}', "{broken", "5", "[]",
        '{"a":{"b":1},"n":null,"t":true,"f":1.50,"l_":{}}', '  [{"A":1,"a":2}]', '{"a_b":1,"a":{"b":2}}',
    )
    rows = S.parse_json_logs(docs, "doc").orderBy("id", "record_index").collect()
    got = [(r["id"], r["record_index"], r["error"], r["raw_fields"]) for r in rows]
    bad_item, bad_doc = "item is not a JSON object", "document is not valid JSON"
    assert got[:5] == [
        (0, 0, None, {"a_b_c": "007"}), (0, 1, bad_item, None), (0, 2, bad_item, None),
        (1, None, bad_doc, None), (2, 0, bad_item, None),
    ]
    rest = {g[0]: g for g in got[5:]}
    assert rest[4][3] == {"a_b": "1", "t": "true", "f": "1.5"}
    assert rest[5][3] == {"A": "1", "a": "2"}
    assert rest[6][3] == {"a_b": "2"}
    assert 3 not in rest  # an empty array has neither records nor errors


def test_json_nesting(spark):
    deep = lambda n: '{"k":' * n + '"v"' + "}" * n
    depths = [1, 3, 17, 18, 40, 200]
    docs = documents(spark, *[deep(n) for n in depths], "[" + deep(40) + "," + deep(2) + "]", deep(100_000))
    rows = S.parse_json_logs(docs, "doc").orderBy("id", "record_index").collect()
    key = lambda n: "_".join(["k"] * n)
    assert [r["raw_fields"] for r in rows[:8]] == [{key(n): "v"} for n in depths + [40, 2]]
    assert rows[8]["error"] and len(rows) == 9


def test_json_repeated_keys_and_long_numbers(spark):
    long = "9" * 60
    docs = documents(
        spark, '{"a":{"b":1,"b":2},"c":"x"}', '{"n":' + long + ',"t":true,"z":null}', '[{"a":1},{"b":1,"b":"2"}]', '{"s":"{\\"a\\":1}"}',
        '{"rows":[{"x":{"y":{"z":{"w":' + long + "}}}},7]}",
    )
    rows = S.parse_json_logs(docs, "doc").orderBy("id", "record_index").collect()
    assert [(r["id"], r["raw_fields"], r["error"]) for r in rows] == [
        (0, {"a_b": "2", "c": "x"}, None), (1, {"n": long, "t": "true"}, None), (2, {"a": "1"}, None), (2, {"b": "2"}, None),
        (3, {"s": '{"a":1}'}, None), (4, {"x_y_z_w": long}, None), (4, None, "item is not a JSON object"),
    ]


def test_many_alias_rules(spark):
    aliases = [f"name{i:05d}" for i in range(20_000)]
    table = spark.createDataFrame([("source", a) for a in aliases], "field string, alias string")
    more = spark.createDataFrame([("severity", "NAME00007"), ("source", "Name00009"), ("other", "x"), (None, "x"), ("source", None)], table.schema)
    docs = documents(
        spark, '{"NAME19999":"late","name00007":"early","source":"own"}', '{"source":"own"}', '{"name00001":null,"Name00009":"a","name00009":"b"}', "[]",
    )
    parsed = S.parse_json_logs(docs, "doc")
    for small in (True, False):  # the aliases are broadcast, or joined with their hot keys salted
        with pytest.MonkeyPatch.context() as patch:
            if not small:
                patch.setattr(joins, "lookup_join", lambda *a, **k: lookup_join(*a, **k, max_broadcast_rows=0, max_group_rows=1))
            found = joins.with_rule_fields(parsed, table.unionByName(more))
            got = standardize.canonical_record(found, F.lit(AS_OF), rule_fields="rule_fields").orderBy("id").collect()
        assert [(r["id"], r["source"], r["severity"]) for r in got] == [(0, "early", "info"), (1, "own", "info"), (2, "a", "info")]


def test_csv(spark):
    doc = "timestamp,source,severity\n2023-09-05T02:00:00,u2,ERROR\n2023-09-05T02:01:00,u2,WARNING\n\n"
    quoted = 'source,message\nm1,"a, ""b""\nc"\nm2,x,y,z\n'
    parsed = S.parse_csv_logs(documents(spark, doc, quoted, "a,b", "a,a,b\n1,2,3\n4", 'a,a\n"1",2', None), "doc")
    got = records(parsed.filter("id = 0"))
    assert [(r[0], r[2]) for r in got] == [("u2", "error"), ("u2", "warning")]
    fields = lambda i: [r["raw_fields"] for r in parsed.filter(f"id = {i}").orderBy("record_index").collect()]
    assert fields(1) == [{"source": "m1", "message": 'a, "b"\nc'}, {"source": "m2", "message": "x", "_corrupt_record": "y,z"}]
    assert fields(2) == [] and fields(5) == []
    assert fields(3) == [{"a": "2", "b": "3"}, {"a": "4"}] and fields(4) == [{"a": "2"}]


def test_xml(spark):
    doc = """<?xml version="1.0"?>
<book><entry><timestamp>2023-09-05T03:00:00</timestamp><source>u3</source><event_type>leak</event_type>
<severity>CRITICAL</severity><message>water below the pump</message></entry></book>"""
    odd = '<EventLog><Event><a u="1">x</a><a>y</a><n o="2"><m>007</m></n></Event><CORRUPT vendor="V" payload="0x00"/></EventLog>'
    deep = "<r><e>" + "<d>" * 5000 + "v" + "</d>" * 5000 + "</e></r>"
    parsed = S.parse_xml_logs(documents(spark, doc, odd, "<bad>", deep), "doc").cache()
    assert records(parsed.filter("id = 0"))[0][:4] == ("u3", "leak", "critical", "water below the pump")
    fields = [r["raw_fields"] for r in parsed.filter("id = 1").orderBy("record_index").collect()]
    assert fields == [{"a": "y", "a_u": "1", "n_o": "2", "n_m": "007"}, {"vendor": "V", "payload": "0x00"}]
    bad = parsed.filter("id = 2").collect()
    assert len(bad) == 1 and bad[0]["error"]
    assert parsed.filter("id = 3").first()["raw_fields"] == {"_".join("d" * 5000): "v"}


def test_lines(spark):
    doc = ("[2023-09-05 04:00:00] ERROR on machine_4x: stuck lid\r\n\n   \n"
           "[2023-09-05 04:01:00] WARNING on machine_4x: slow lid\n[2023-09-05 04:02:00] INFO on machine_4x: lid is fine")
    rows = S.parse_line_logs(documents(spark, doc), "doc").withColumn("error", F.lit(None).cast("string"))
    got = records(rows.withColumnRenamed("line_no", "record_index"))
    assert [(r[0], r[2], r[4].minute) for r in got] == [
        ("machine_4x", "error", 0), ("machine_4x", "warning", 1), ("machine_4x", "info", 2)
    ]
    assert got[0][3].startswith("[2023-09-05 04:00:00] ERROR")


def test_format_detection(spark):
    cases = {'  {"a":1}': "json", "[1]": "json", "\n<x/>": "xml", "a,b,c\n1,2,3": "csv", "a,b\n1,2": "log", "": "log"}
    rows = spark.createDataFrame([(k,) for k in cases], "doc string")
    got = rows.select("doc", standardize.detect_format(F.col("doc").cast("binary")).alias("f")).collect()
    assert {r["doc"]: r["f"] for r in got} == cases
    hinted = rows.select(standardize.detect_format(F.col("doc").cast("binary"), F.lit("TXT")).alias("f")).distinct().collect()
    assert [r["f"] for r in hinted] == ["txt"]


@pytest.mark.parametrize("text,expected", [
    ("2024-04-17T10:30:00Z", dt.datetime(2024, 4, 17, 10, 30)),
    ("2024-04-17 10:30:00.125", dt.datetime(2024, 4, 17, 10, 30, 0, 125000)),
    ("2024-04-17T10:30:00+02:00", dt.datetime(2024, 4, 17, 8, 30)),
    ("2024-04-17T10", dt.datetime(2024, 4, 17, 10)),
    ("20260421T034719", dt.datetime(2026, 4, 21, 3, 47, 19)), ("20260421", dt.datetime(2026, 4, 21)),
    ("20260421T0347+0200", dt.datetime(2026, 4, 21, 1, 47)), ("2026-W17-2", dt.datetime(2026, 4, 21)),
    ("2026W17", dt.datetime(2026, 4, 20)), ("2026-W17-2T05:06:07", dt.datetime(2026, 4, 21, 5, 6, 7)),
    ("2026-W54-1", None), ("20261301", None),
    ("2024-04-17", dt.datetime(2024, 4, 17)),
    ("2024", None), ("17.04.2024", None), ("2024-13-01", None), ("", None),
])
def test_timestamps(spark, text, expected):
    got = spark.range(1).select(standardize.parse_timestamp(F.lit(text)).alias("t")).first()["t"]
    assert got == expected


def test_dump_with_zone_suffix(spark, tmp_path):
    path = str(tmp_path / "dump.tsv")
    with open(path, "w") as out:
        out.write("c41b\t2026-04-18 16:49:46.491737+00\t0.99\tf\t\\N\nc41c\t2026-04-18 16:49:46+00\t\\N\tt\t\n\\.\n")
    schema = "job_id string, timestamp timestamp, confidence double, review boolean, reason string"
    got = S.read_dump(spark, path, schema).orderBy("job_id").collect()
    assert got[0]["timestamp"] == dt.datetime(2026, 4, 18, 16, 49, 46, 491737)
    assert got[0]["reason"] is None and got[1]["confidence"] is None and got[1]["reason"] == ""
    assert (got[0]["review"], got[1]["review"]) == (False, True)


def test_dump_round_trip(spark, tmp_path):
    texts = ["a\tb", "c\nd", "\\N", "\\", "", None, 'q"x, y', "\\t", "\\\\n"]
    rows = spark.createDataFrame([(i, t, i % 2 == 0) for i, t in enumerate(texts)], "id int, text string, flag boolean")
    S.write_dump(rows, str(tmp_path / "d"))
    got = S.read_dump(spark, str(tmp_path / "d"), rows.schema).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(i, t, i % 2 == 0) for i, t in enumerate(texts)]


def test_dump_of_several_tables(spark, tmp_path):
    path = str(tmp_path / "dump.sql")
    with open(path, "w") as out:
        out.write("SET x = 1;\n\nCOPY public.marks (id, word) FROM stdin;\n1\ta\n2\t\\N\n\\.\n\nCOPY public.none (id) FROM stdin;\n\\.\n"
                  "-- next\nCOPY public.words (word) FROM stdin;\nb\n\nc\n\\.\n\nSELECT 1;\n")
    got = large.read_dump_table(spark, path, "marks", "id int, word string").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "a"), (2, None)]
    words = large.read_dump_table(spark, path, "words", "word string").collect()
    assert sorted(r["word"] for r in words) == ["", "b", "c"]
    assert large.read_dump_table(spark, path, "none", "id int").count() == 0


def test_small_functions(spark):
    names = spark.createDataFrame([("\t Chip_Crack\n",), ("a b!",)], "n string")
    assert [r["c"] for r in names.select(classify.valid_category_name(F.col("n")).alias("c")).collect()][0] == "chip_crack"
    vector = scoring.feature_vector(
        F.lit("ERROR"), F.lit(None).cast("double"), F.lit("thermal"), F.lit("s"), F.lit("t"), F.lit("m"), F.lit(False)
    )
    assert spark.range(1).select(vector.alias("v")).first()["v"][1] == 0.0


def test_file_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("source,severity\nm1,ERROR\nm2,INFO,extra\n")
    rows = S.read_csv_logs(spark, str(tmp_path / "a.csv"), "source string, severity string, _corrupt_record string").collect()
    assert [r["source"] for r in rows] == ["m1", "m2"] and rows[1]["_corrupt_record"] == "m2,INFO,extra"
    (tmp_path / "a.xml").write_text('<L><Event zone="Z"><source>007</source></Event><Event><source>b</source></Event></L>')
    rows = S.read_xml_logs(spark, str(tmp_path / "a.xml"), "Event", "source string, zone string").collect()
    assert [(r["source"], r["zone"]) for r in rows] == [("007", "Z"), ("b", None)]
    (tmp_path / "a.log").write_text("  one ERROR \n\ntwo tool_x\n")
    rows = S.read_line_logs(spark, str(tmp_path / "a.log")).collect()
    assert [r["line"] for r in rows] == ["one ERROR", "two tool_x"]
    (tmp_path / "empty.log").write_text("")
    files = S.ingest_files(S.read_files(spark, str(tmp_path), "*.log")).collect()
    assert [f["file_name"] for f in files] == ["a.log"]
    assert files[0]["file_key"] == f"raw_logs/{files[0]['job_id']}/a.log"


def test_opaque_vendor_message(spark):
    message = "almid 17, unit B, feed hbr low, step 5 of 9"
    got = spark.range(1).select(classify.keyword_category(F.lit(message)).alias("c")).first()["c"]
    assert got == "gas_leak"  # 'hbr' stands in an earlier group than 'almid'


def test_result_validation(spark):
    texts = ['{"category":"thermal","confidence":1.7}', '{"category":"x"}', "no json", '{"category":"thermal","confidence":"high"}']
    rows = documents(spark, *texts).select("id", classify.validated_result(F.col("doc")).alias("r")).orderBy("id").collect()
    assert [(r["r"]["category"], r["r"]["confidence"], r["r"]["recommended_action"]) for r in rows] == [
        ("thermal", 1.0, None), ("unknown", 0.5, None), ("unknown", 0.0, "manual review"), ("unknown", 0.0, "manual review")
    ]


def test_mixed_files_are_read_once(spark, tmp_path):
    """The parsers work on what was told apart once; none of them reads the files again."""
    documents(spark, '{"source":"a"}', "<r><source>b</source></r>", "source,x,y\nc,1,2\n", "ERROR tool_d").write.parquet(str(tmp_path / "given"))
    parsed = S.parse_logs(spark.read.parquet(str(tmp_path / "given")), "doc")
    assert not [name for name in parsed.inputFiles() if "/given/" in name]
    assert sorted((r["id"], r["format"]) for r in parsed.collect()) == [(0, "json"), (1, "xml"), (2, "csv"), (3, "log")]
