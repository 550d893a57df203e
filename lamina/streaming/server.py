"""The message protocol of the volume server as tables: frames in, replies out, in batches or as a stream.

A frame is a 12-byte header (mark, kind, flags, payload length; big-endian) and a payload. Frames are taken apart with binary
functions, kinds are answered by joins and expressions, and nothing is kept between messages but the tables they add to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the protocol: the mark and the kinds of messages.
MARK = "564F4C54"
KINDS = ("ping", "pong", "auth_req", "auth_resp", "chunk_req", "chunk_resp", "seg_update", "seg_ack", "annot_update", "annot_ack", "compute_req", "compute_status", "error")
PING, PONG, CHUNK_REQ, CHUNK_RESP, SEG_UPDATE, SEG_ACK, ANNOT_UPDATE, ANNOT_ACK, ERROR = (KINDS.index(k) for k in ("ping", "pong", "chunk_req", "chunk_resp", "seg_update", "seg_ack", "annot_update", "annot_ack", "error"))
#: Bytes of a header and of a chunk request (volume id of 64, level of 4, three coordinates of 8).
HEADER, REQUEST = 12, 92


def _hex(v: Column, digits: int) -> Column:
    return F.lpad(F.right(F.hex(v.cast("long")), F.lit(digits)), digits, "0")


def frame(kind: Column, payload: Column) -> Column:
    """A message of ``kind`` with a binary payload (null: none)."""
    body = F.coalesce(payload, F.lit(b""))
    return F.unhex(F.concat(F.lit(MARK), _hex(kind, 4), F.lit("0000"), _hex(F.octet_length(body), 8), F.hex(body)))


def _number(digits: Column, bits: int) -> Column:
    """A big-endian signed number from its hex digits."""
    v = F.conv(digits, 16, -10).cast("long")
    return F.when(v >= 2 ** (bits - 1), v - 2**bits).otherwise(v) if bits < 64 else v


def parse(messages: DataFrame, data: str = "data") -> DataFrame:
    """``messages`` with kind, payload and ``fault``: null, "magic", or "truncated" (a header or payload that is cut short); bytes beyond the payload are ignored."""
    h = F.hex(F.col(data))
    size = F.octet_length(F.col(data))
    length = F.conv(F.substr(h, F.lit(17), F.lit(8)), 16, 10).cast("long")
    fault = F.when(F.col(data).isNull() | (size < HEADER), "truncated").when(F.substr(h, F.lit(1), F.lit(8)) != MARK, "magic").when(size < HEADER + length, "truncated")
    rest = [c for c in messages.columns if c != data]
    out = messages.select(*rest, fault.alias("fault"), F.conv(F.substr(h, F.lit(9), F.lit(4)), 16, 10).cast("int").alias("_k"), F.unhex(F.substr(h, F.lit(2 * HEADER + 1), (2 * length).cast("int"))).alias("_p"))
    return out.select(*rest, "fault", *[F.when(F.col("fault").isNull(), F.col(a)).alias(b) for a, b in (("_k", "kind"), ("_p", "payload"))])


def chunk_request(volume_id: Column, level: Column, z: Column, y: Column, x: Column) -> Column:
    """The payload of a chunk request; ids keep 63 bytes."""
    name = F.rpad(F.hex(F.substr(volume_id, F.lit(1), F.lit(63)).cast("binary")), 128, "0")
    return F.unhex(F.concat(name, _hex(level, 8), *[_hex(c, 16) for c in (z, y, x)]))


def parse_request(payload: Column) -> Column:
    """Struct (volume_id, level, z, y, x) of a chunk request; null if it is too short."""
    h = F.hex(payload)
    name = F.regexp_extract(F.substr(h, F.lit(1), F.lit(126)), "^((?:(?!00)[0-9A-F]{2})*)", 1)
    at = [_number(F.substr(h, F.lit(137 + 16 * i), F.lit(16)), 64).alias(c) for i, c in enumerate("zyx")]
    return F.when(F.octet_length(payload) >= REQUEST, F.struct(F.decode(F.unhex(name), "UTF-8").alias("volume_id"), _number(F.substr(h, F.lit(129), F.lit(8)), 32).cast("int").alias("level"), *at))


def replies(messages: DataFrame, chunks: DataFrame) -> DataFrame:
    """(seq, client, to_all, kind, payload): what ``messages`` (seq, client, data) are answered with.

    ``chunks`` is (volume_id, level, z, y, x, data). A segment or annotation gets the sequence number of its message as id and goes to all clients as well.
    Faulty frames and kinds without an answer get none.
    """
    m = parse(messages).where("fault is null")
    text = lambda s: F.lit(s).cast("binary")
    asked = m.where(F.col("kind") == CHUNK_REQ).select("seq", "client", parse_request(F.col("payload")).alias("q")).select("seq", "client", F.col("q").isNotNull().alias("ok"), "q.*")
    known = chunks.select("volume_id").distinct().withColumn("known", F.lit(True))
    got = asked.join(known, "volume_id", "left").join(chunks.withColumnRenamed("data", "chunk"), ["volume_id", "level", "z", "y", "x"], "left")
    fault = F.when(~F.col("ok"), "bad chunk_req").when(F.col("known").isNull(), "unknown volume").when(F.col("chunk").isNull(), "chunk not found")
    served = got.select("seq", "client", F.lit(False).alias("to_all"), F.when(fault.isNull(), CHUNK_RESP).otherwise(ERROR).alias("kind"), F.coalesce(fault.cast("binary"), F.col("chunk")).alias("payload"))
    body = F.decode(F.col("payload"), "UTF-8")
    field = lambda k: F.coalesce(F.get_json_object(body, f"$.{k}"), F.lit(""))
    segment = (field("volume_id") != "") & (field("name") != "")
    note = (F.coalesce(F.expr("try_cast(get_json_object(decode(payload, 'UTF-8'), '$.segment_id') as bigint)"), F.lit(-1)) >= 0) & (field("type") != "")
    good = F.when(F.col("kind") == SEG_UPDATE, segment).otherwise(note)
    ack = F.concat(F.lit('{"id":'), F.col("seq").cast("string"), F.lit("}")).cast("binary")
    named = F.when(F.col("kind") == SEG_UPDATE, text("bad seg_update")).otherwise(text("bad annot_update"))
    updates = m.where(F.col("kind").isin(SEG_UPDATE, ANNOT_UPDATE) & (F.octet_length("payload") > 0)).withColumn("good", good)
    answer = F.struct(F.lit(False).alias("to_all"), F.when(F.col("good"), F.col("kind") + 1).otherwise(ERROR).alias("kind"), F.when(F.col("good"), ack).otherwise(named).alias("payload"))
    echo = F.struct(F.lit(True).alias("to_all"), F.col("kind").alias("kind"), F.col("payload").alias("payload"))
    told = updates.select("seq", "client", F.explode(F.filter(F.array(answer, F.when(F.col("good"), echo)), lambda r: r.isNotNull())).alias("r")).select("seq", "client", "r.*")
    pongs = m.where(F.col("kind") == PING).select("seq", "client", F.lit(False).alias("to_all"), F.lit(PONG).alias("kind"), F.lit(b"").alias("payload"))
    return served.unionByName(told).unionByName(pongs)


def added(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments (id, volume_id, name, surface_path) and annotations (id, segment_id, type, data_json) that ``messages`` add."""
    m = parse(messages).where("fault is null").select("seq", "kind", F.decode("payload", "UTF-8").alias("j"))
    field = lambda k: F.get_json_object("j", f"$.{k}")
    s = m.where(F.col("kind") == SEG_UPDATE).select(F.col("seq").alias("id"), *[F.coalesce(field(k), F.lit("")).alias(k) for k in ("volume_id", "name", "surface_path")]).where("volume_id <> '' and name <> ''")
    a = m.where(F.col("kind") == ANNOT_UPDATE).select(F.col("seq").alias("id"), F.expr("try_cast(get_json_object(j, '$.segment_id') as bigint)").alias("segment_id"), F.coalesce(field("type"), F.lit("")).alias("type"), F.col("j").alias("data_json")).where("segment_id >= 0 and type <> ''")
    return s, a


def serve(stream: DataFrame, chunks: DataFrame, path: str, **trigger):
    """Answer a stream of messages (seq, client, data): replies, segments and annotations go to folders of ``path``, a batch a sub-folder that is written again if the batch is.

    Returns the running query.
    """

    def answer(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        s, a = added(batch)
        for name, df in (("replies", replies(batch, chunks)), ("segments", s), ("annotations", a)):
            df.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(answer).option("checkpointLocation", f"{path}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()
