import json

import pytest

from tidemark.config import Config
from tidemark.sources import artifacts as A
from tidemark.sources import subtitles


def srt(*blocks):
    return "\n\n".join(blocks) + "\n"


@pytest.fixture()
def corpus(tmp_path):
    files = {
        "Transcript/P01/DAY1/s1_transcript.srt": srt("1\n00:00:01,000 --> 00:00:02,500\nNeed  milk", "2\n00:00:03,000 --> 00:00:04,000\nNeed milk", "3\n00:00:05,5 --> 00:00:06,000\n<b>ok</b>"),
        "DenseCaption/P01/DAY1/s1_dense_caption.SRT": "﻿1\r\n00:00:01,000 --> 00:00:03,000\r\nA person pours milk\r\n\r\n2\r\nno time\r\n",
        "Transcript/P01/DAY2/sub/s2.srt": srt("1\n00:00:09,000 --> 00:00:08,000\nbackwards", "2\n00:00:10,000 --> 00:00:11,000\n"),
        "Transcript/P02/nowhere/s3.srt": "",
        "Transcript/P02/DAY1/s4.txt": "not a subtitle",
        "Transcript/P02/DAY1/s5.srt": "",
    }
    for name, text in files.items():
        p = tmp_path / "raw" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text.encode())
    return tmp_path / "raw"


def test_discovery_and_parsing(spark, corpus):
    inventory = subtitles.discover(spark, {"transcript": f"file:{corpus}/Transcript", "dense_caption": f"file:{corpus}/DenseCaption", "none": f"file:{corpus}/Missing"})
    got = {r.relative_path: r for r in inventory.collect()}
    assert len(got) == 5
    one = got["Transcript/P01/DAY1/s1_transcript.srt"]
    assert (one.participant_source_id, one.source_day, one.session_uid, one.session_id, one.has_counterpart) == ("P01", "DAY1", "s1", "ses_P01_DAY1_s1", True)
    assert got["DenseCaption/P01/DAY1/s1_dense_caption.SRT"].has_counterpart
    assert got["Transcript/P01/DAY2/sub/s2.srt"].session_uid == "sub_s2" and not got["Transcript/P01/DAY2/sub/s2.srt"].has_counterpart
    assert got["Transcript/P02/nowhere/s3.srt"].path_status == "inventory_error"

    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"file:{corpus}").where("lower(path) like '%.srt'").selectExpr("regexp_extract(path, '([^/]+)$', 1) as relative_path", "cast(content as string) as content")
    content = content.union(spark.createDataFrame([("s5.srt", "")], "relative_path string, content string"))  # a scan leaves out empty files
    parsed = subtitles.parse(content, ["relative_path"])
    status = {(r.relative_path, r.srt_block_index): (r.parse_status, r.error, r.start_sec, r.text) for r in parsed.collect()}
    assert status["s1_transcript.srt", 1] == ("ok", None, 1.0, "Need milk")
    assert status["s1_transcript.srt", 2][:2] == ("discarded_duplicate_adjacent", "duplicate_adjacent_text")
    assert status["s1_transcript.srt", 3][2] == 5.5
    assert status["s1_dense_caption.SRT", 1] == ("ok", None, 1.0, "A person pours milk")
    assert status["s1_dense_caption.SRT", 2][:2] == ("error", "missing_or_invalid_timecode")
    assert status["s2.srt", 1][1] == "non_positive_duration" and status["s2.srt", 2][0] == "discarded_empty"
    assert status["s5.srt", 0][1] == "no_srt_blocks"


def test_publication_gate(spark, tmp_path):
    path = f"file:{tmp_path}/table"
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "id int, x string")
    marker = A.publish(df, path, A.Publication("v1", {"source": "h"}))
    assert marker["rows"] == 3
    again = A.open_verified(spark, path, df.schema, "v1", {"source": "h"})
    assert A.content_hash(again) == A.content_hash(df.orderBy("x"))
    with pytest.raises(A.GateError):
        A.open_verified(spark, path, df.schema, "v2")
    with pytest.raises(A.GateError):
        A.open_verified(spark, path, df.schema, "v1", {"source": "other"})
    df.limit(1).write.mode("append").parquet(path)
    with pytest.raises(A.GateError):
        A.open_verified(spark, path, df.schema)
    with pytest.raises(A.GateError):
        A.open_verified(spark, f"file:{tmp_path}/nothing", df.schema)
    assert A.publish(df.limit(1), path)["rows"] == 1 and A.open_verified(spark, path, df.schema).count() == 1


def test_lines_and_csv(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n[1, 2]\n{"a": "no"}\n')
    got = A.read_json_lines(spark, f"file:{tmp_path}/x.jsonl", "a int").cache()
    assert got.count() == 3 and got.where("_corrupt_record is not null").count() == 2
    with pytest.raises(Exception):
        A.read_json_lines(spark, f"file:{tmp_path}/x.jsonl", "a int", strict=True).collect()
    (tmp_path / "x.csv").write_text("a,b\n1,x\n")
    assert A.read_csv(spark, f"file:{tmp_path}/x.csv", "a int, b string").first().asDict() == {"a": 1, "b": "x"}


def test_manifest(spark):
    rows = spark.createDataFrame([(0,), (0,), (1,), (3,)], "shard int")
    want = spark.createDataFrame([(0, 2), (1, 5), (2, 1)], "shard int, n_rows bigint")
    got = {r.shard: r.status for r in A.manifest_check(rows, want, "shard").collect()}
    assert got == {0: "ok", 1: "row_count", 2: "missing_shard", 3: "unknown_shard"}


def test_plugged_model(spark):
    got = A.inferred(spark.createDataFrame([("ab",)], "t string"), lambda b: b.assign(n=b.t.str.len()), "t string, n bigint")
    assert tuple(got.first()) == ("ab", 2)


def test_config(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"raw": "data/raw", "protocol": {"status": "frozen", "x": 1}, "open": {"status": "frozen", "x": None}}))
    c = Config.load(tmp_path / "c.json")
    assert c.path("raw") == str((tmp_path / "data/raw").resolve()) and c.frozen("protocol")["x"] == 1
    with pytest.raises(ValueError):
        c.frozen("open")
