"""Frames, replies and the stream of messages, against ``struct``."""

import struct

from pyspark.sql import functions as F

from lamina.streaming import server as V

SCHEMA = "seq long, client int, data binary"


def plain(kind, payload=b"", mark=0x564F4C54, length=None):
    return struct.pack(">IHHI", mark, kind, 0, len(payload) if length is None else length) + payload


def request(name, level, *at):
    return name.encode().ljust(64, b"\0") + struct.pack(">iqqq", level, *at)


def test_frames_are_those_of_struct(spark):
    rows = [(0, b""), (6, b'{"a": 1}'), (65535, bytes(range(256))), (12, None)]
    got = spark.createDataFrame(rows, "kind int, payload binary").select("*", V.frame(F.col("kind"), F.col("payload")).alias("data")).collect()
    assert all(bytes(r["data"]) == plain(r["kind"], bytes(r["payload"] or b"")) for r in got)
    r = spark.createDataFrame([("vol-é", -1, -(2**63), 2**63 - 1, 7), ("x" * 80, 2**31 - 1, 0, 1, 2)], "v string, l int, z long, y long, x long")
    got = r.select("*", V.chunk_request(F.col("v"), F.col("l"), F.col("z"), F.col("y"), F.col("x")).alias("p")).select("*", V.parse_request(F.col("p")).alias("q")).collect()
    assert bytes(got[0]["p"]) == request("vol-é", -1, -(2**63), 2**63 - 1, 7)
    assert tuple(got[0]["q"]) == ("vol-é", -1, -(2**63), 2**63 - 1, 7)
    assert tuple(got[1]["q"]) == ("x" * 63, 2**31 - 1, 0, 1, 2)


def test_faults(spark):
    rows = [(0, 1, plain(0)), (1, 1, plain(0)[:11]), (2, 1, plain(0, mark=1)), (3, 1, plain(6, b"abc", length=4)), (4, 1, plain(6, b"abcd", length=3)), (5, 1, None), (6, 1, b"")]
    got = {r["seq"]: (r["fault"], r["kind"], None if r["payload"] is None else bytes(r["payload"])) for r in V.parse(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {0: (None, 0, b""), 1: ("truncated", None, None), 2: ("magic", None, None), 3: ("truncated", None, None), 4: (None, 6, b"abc"), 5: ("truncated", None, None), 6: ("truncated", None, None)}


def messages():
    return [
        (0, 1, plain(V.PING)),
        (1, 2, plain(V.CHUNK_REQ, request("a", 0, 1, 2, 3))),
        (2, 2, plain(V.CHUNK_REQ, request("a", 0, 9, 2, 3))),
        (3, 2, plain(V.CHUNK_REQ, request("b", 0, 1, 2, 3))),
        (4, 2, plain(V.CHUNK_REQ, b"short")),
        (5, 3, plain(V.SEG_UPDATE, b'{"volume_id":"a","name":"s1","surface_path":"/s"}')),
        (6, 3, plain(V.SEG_UPDATE, b'{"volume_id":"a"}')),
        (7, 3, plain(V.ANNOT_UPDATE, b'{"segment_id": 5,"type":"point"}')),
        (8, 3, plain(V.ANNOT_UPDATE, b'{"segment_id":"x","type":"point"}')),
        (9, 3, plain(V.ANNOT_UPDATE, b"no json")),
        (10, 3, plain(V.SEG_UPDATE)),
        (11, 3, plain(V.PONG)),
        (12, 3, b"junk"),
    ]


WANT = {
    (0, False, V.PONG, b""),
    (1, False, V.CHUNK_RESP, b"data"),
    (2, False, V.ERROR, b"chunk not found"),
    (3, False, V.ERROR, b"unknown volume"),
    (4, False, V.ERROR, b"bad chunk_req"),
    (5, False, V.SEG_ACK, b'{"id":5}'),
    (5, True, V.SEG_UPDATE, b'{"volume_id":"a","name":"s1","surface_path":"/s"}'),
    (6, False, V.ERROR, b"bad seg_update"),
    (7, False, V.ANNOT_ACK, b'{"id":7}'),
    (7, True, V.ANNOT_UPDATE, b'{"segment_id": 5,"type":"point"}'),
    (8, False, V.ERROR, b"bad annot_update"),
    (9, False, V.ERROR, b"bad annot_update"),
}


def test_replies_and_the_stream(spark, tmp_path):
    chunks = spark.createDataFrame([("a", 0, 1, 2, 3, b"data")], "volume_id string, level int, z long, y long, x long, data binary")
    rows = messages()
    got = V.replies(spark.createDataFrame(rows, SCHEMA), chunks).collect()
    assert {(r["seq"], r["to_all"], r["kind"], bytes(r["payload"])) for r in got} == WANT
    assert len(got) == len(WANT)
    for k in range(0, 13, 5):
        spark.createDataFrame(rows[k : k + 5], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    V.serve(stream, chunks, str(tmp_path / "out")).awaitTermination()
    read = lambda name: spark.read.parquet(str(tmp_path / "out" / name)).collect()
    assert {(r["seq"], r["to_all"], r["kind"], bytes(r["payload"])) for r in read("replies")} == WANT
    assert {r["batch"] for r in read("replies")} == {0, 1}  # the third batch has no answers
    assert [(r["id"], r["volume_id"], r["name"], r["surface_path"]) for r in read("segments")] == [(5, "a", "s1", "/s")]
    assert [(r["id"], r["segment_id"], r["type"]) for r in read("annotations")] == [(7, 5, "point")]
