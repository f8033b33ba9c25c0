"""Sources and sinks (S1–S9, S11, S12, P1–P11) and the streaming ingest, on FIXTURES.md rows."""

import json

from pyspark.sql import functions as F

from taxolink.operators import shape as SH
from taxolink.sources import bundle as BD
from taxolink.sources import catalog as CT
from taxolink.sources import feeds as FD
from taxolink.sources import pages as PG
from taxolink.streaming.feed_stream import start_feed_ingest

from helpers import rows


def item(rid, desc, pts, date):
    return {"cve": {"CVE_data_meta": {"ID": rid},
                    "problemtype": {"problemtype_data": [{"description": [{"lang": "en", "value": v} for v in pt]}
                                                         for pt in pts]},
                    "description": {"description_data": [{"lang": "en", "value": d} for d in desc]}},
            "publishedDate": date}


FEED = [
    item("R-1", ["Buffer issue in abc"], [["CWE-79"]], "2020-03-01T10:00Z"),
    item("R-2", ["Two causes"], [["CWE-79", "CWE-89"]], "2020-12-31T12:00Z"),
    item("R-3", ["x"], [["CWE-79"], ["CWE-89"]], "2021-06-01T00:00Z"),
    item("R-4", ["** REJECT ** unused"], [["CWE-79"]], "2020-01-05T00:00Z"),
    item("R-5", ["will reject input"], [["CWE-20"]], "2020-01-05T00:00Z"),
    item("R-6", [], [["CWE-79"]], "2020-01-05T00:00Z"),
    item("R-7", ["y"], [[]], "2020-01-05T00:00Z"),
    item("R-8", ["z"], [], "2020-01-05T00:00Z"),
]


def expected_records():
    return {"R-1": ["CWE-79"], "R-2": ["CWE-79", "CWE-89"], "R-3": ["CWE-79"], "R-5": ["CWE-20"],
            "R-7": ["NONE"], "R-8": ["NONE"]}


def test_yearly_feed_multiline(spark, tmp_path):
    p1, p2 = tmp_path / "feed-2020.json", tmp_path / "feed-2021.json"
    p1.write_text(json.dumps({"CVE_data_type": "CVE", "CVE_Items": FEED[:4]}, indent=2))
    p2.write_text(json.dumps({"CVE_data_type": "CVE", "CVE_Items": FEED[4:]}, indent=2))
    paths = FD.year_paths(str(tmp_path), [2020, 2021], "feed-{year}.json")
    recs = FD.process_feed(FD.read_feed(spark, paths))
    got = {r["record_id"]: r["labels"] for r in recs.collect()}
    assert got == expected_records()
    ts = {r["record_id"]: r["published_ts"] for r in recs.collect()}
    assert str(ts["R-2"]) == "2020-12-31 12:00:00"


def test_json_lines_feed_and_stream(spark, tmp_path):
    staged = tmp_path / "staged"
    staged.mkdir()
    (staged / "a-2020.json").write_text("\n".join(json.dumps(i) for i in FEED[:5]))
    out, chk = str(tmp_path / "out"), str(tmp_path / "chk")
    q = start_feed_ingest(spark, str(staged), out, checkpoint=chk)
    q.awaitTermination(120)
    assert {r["record_id"] for r in spark.read.parquet(out).collect()} == {"R-1", "R-2", "R-3", "R-5"}
    (staged / "b-2021.json").write_text("\n".join(json.dumps(i) for i in FEED[5:]))
    q = start_feed_ingest(spark, str(staged), out, checkpoint=chk)
    q.awaitTermination(120)
    got = {r["record_id"]: r["labels"] for r in spark.read.parquet(out).collect()}
    assert got == expected_records()


def test_feed_gaps_and_staged_years(spark, tmp_path):
    for y in (2020, 2022):
        (tmp_path / f"nvd-{y}.json").write_text("{}")
    staged = FD.staged_years(spark, str(tmp_path))
    assert rows(FD.feed_gaps(spark, staged, range(2020, 2023))) == [(2021,)]


def test_remap_and_known(spark):
    df = spark.createDataFrame([("NVD-CWE-Other",), ("CWE-79",), ("NONE",)], "c string")
    out = df.select(FD.remap_unknown("c").alias("c")).withColumn("k", FD.known_code("c"))
    assert rows(out) == [("CWE-79", True), ("NONE", False), ("UNKNOWN", False)]


def test_catalog_csv_latin1(spark, tmp_path):
    header = "CWE-ID,Name,Weakness Abstraction,Description,Extended Description,Related Weaknesses,Common Consequences,\n"
    body = ('20,Input check,Class,text,,,"conseq",\n'
            '79,"Caf\xe9 ""x""",Base,"line one\nline two",ext,'
            '"::NATURE:ChildOf:CWE ID:74:VIEW ID:1000::",,\n')
    (tmp_path / "cat.csv").write_bytes((header + body).encode("latin-1"))
    cat = CT.catalog_b(CT.read_csv(spark, str(tmp_path / "cat.csv")))
    got = {r["CWE-ID"]: r for r in cat.collect()}
    assert got[79]["Name"] == 'Café "x"'
    assert got[79]["Description"] == "line one\nline two"
    assert got[20]["Extended Description"] is None
    text = cat.select(SH.class_text("Name", "Description", "Extended Description", "Common Consequences").alias("t"))
    assert "Input check text nan conseq" in {r["t"] for r in text.collect()}


def test_csv_sink_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", [1, 2])], "id long, s string, l array<int>")
    CT.write_csv(df, str(tmp_path / "o"))
    back = CT.read_csv(spark, str(tmp_path / "o"), encoding="UTF-8")
    r = back.first()
    assert r["s"] == "a,b" and json.loads(r["l"]) == [1, 2]


def test_first_table_only(spark):
    html = ("<html><table><tr><td>CWE-79</td><td>XSS</td></tr><tr><td><b>CWE-89</b></td></tr></table>"
            "<table><tr><td>CWE-1</td></tr></table></html>")
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    out = PG.first_block_rows(pages)
    assert rows(out, "pos", "item") == [(0, "CWE-79XSS"), (1, "CWE-89")]


def test_bundle_materialize_and_log(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    p = str(tmp_path / "t")
    assert BD.materialize(spark, p, build).count() == 3
    assert BD.materialize(spark, p, build).count() == 3
    assert len(calls) == 1
    BD.materialize(spark, p, build, recompute=True)
    assert len(calls) == 2
    BD.save_bundle({"a": spark.range(2), "b": spark.range(4)}, str(tmp_path / "bundle"))
    loaded = BD.load_bundle(spark, str(tmp_path / "bundle"), ["a", "b"])
    assert loaded["a"].count() == 2 and loaded["b"].count() == 4
    log = str(tmp_path / "log")
    BD.log_metrics(spark, log, "run1", {"train_acc": [1, 2, 3, 4]})
    lines = BD.read_metrics(spark, log).collect()
    assert lines[0]["line"] == "train_acc :1.0 2.0 3.0 4.0"


def test_profile_and_apply_columns(spark):
    df = spark.createDataFrame([(1, "a", ["x", "y"]), (2, None, None)], "id long, s string, l array<string>")
    prof = rows(SH.profile({"t": df}), "col", "n_rows", "n_nonnull")
    assert prof == [("id", 2, 2), ("l", 2, 1), ("s", 2, 1)]
    from pyspark.sql import types as T
    up = SH.apply_columns(df, F.upper, leaf_types=(T.StringType,))
    assert rows(up.filter("id = 1"), "s", "l") == [("A", ["X", "Y"])]
    assert SH.move_first(df, "s").columns == ["s", "id", "l"]


def test_first_list_decodes_entities(spark):
    html = "<ul><li><a href='/x'>Fish &amp; chips</a></li><li>a &lt;b&gt;</li></ul><ul><li>no</li></ul>"
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    out = PG.first_block_rows(pages, container="ul", row="li")
    assert rows(out, "pos", "item") == [(0, "Fish & chips"), (1, "a <b>")]


def test_stream_default_checkpoint_is_per_source_and_sink(spark, tmp_path):
    staged = tmp_path / "s"
    staged.mkdir()
    (staged / "a.json").write_text("\n".join(json.dumps(i) for i in FEED[:2]))
    q1 = start_feed_ingest(spark, str(staged), str(tmp_path / "o1"))
    q1.awaitTermination(120)
    q2 = start_feed_ingest(spark, str(staged), str(tmp_path / "o2"))
    q2.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "o1")).count() == 2
    assert spark.read.parquet(str(tmp_path / "o2")).count() == 2


def test_staged_files_missing_broken_empty_and_unexpected(spark, tmp_path):
    item = '{"cve": {"CVE_data_meta": {"ID": "R-1"}}, "publishedDate": "2020-01-01T00:00Z"}'
    for year, body in {2001: f'{{"CVE_data_type": "CVE", "CVE_Items": [{item}, {item}]}}', 2002: '{"CVE_data_type": "CVE", "CVE_Items": [{"cve"',
                       2004: '{"CVE_data_type": "CVE", "CVE_Items": []}', 2009: f'{{"CVE_Items": [{item}]}}'}.items():
        (tmp_path / f"nvdcve-1.1-{year}.json").write_text(body)
    (tmp_path / "notes.json").write_text("{}")
    (tmp_path / "nvdcve-1.1-2005.json").write_text("")
    got = rows(FD.staged_files(spark, str(tmp_path), range(2001, 2006)), "year", "n_files", "n_items", "n_broken", "status")
    assert got == [(2001, 1, 2, 0, "ok"), (2002, 1, 0, 1, "broken"), (2003, 0, 0, 0, "missing"), (2004, 1, 0, 0, "ok"),
                   (2005, 0, 0, 0, "missing"), (2009, 1, 1, 0, "unexpected")]
    lines = tmp_path / "lines"
    (lines / "2001.json").mkdir(parents=True)
    (lines / "2001.json" / "part-0").write_text(f"{item}\n{item[:30]}\n{item}\n")
    got = rows(FD.staged_files(spark, str(lines), [2001], r"(\d{4})\.json/", json_lines=True), "year", "n_files", "n_items", "n_broken", "status")
    assert got == [(2001, 1, 2, 1, "broken")]
