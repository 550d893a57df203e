"""Training-order materialisation of token ids (operator 1).

Documents are tokenised once, each followed by an end token, into a table of compressed chunks in the shared folder. Their
tokens, in order of (file, place in the file, row), are one stream, cut into sequences of a fixed number of
tokens; only the last sequence is padded. The stream does not depend on how a scan is split: running totals over the
splits give each chunk its place. A keyed Feistel network over the next even power of two permutes the sequences' numbers, walking
along its cycles until it is back below the number of sequences; that gives every sequence its slot in training
order. Slots are dealt to partitions in ranges, a range is written as shard files of a fixed stride, so slot s
lies at byte (s - first slot) * stride of shard s // slots_per_shard, and ``manifest.json`` beside them holds what a
reader needs to resume by seeking.

Rows that do not come from files keep their partition's order. Shards are written under a temporary name and renamed, so a
task that is run again gives the same file. A task holds one chunk (``CHUNK`` bytes or one longer text), ``HELD`` bytes of pieces, or one range
(``RANGE`` bytes); one row of three numbers for each split of the scan is broadcast.

Edge cases: null and empty texts give their end token only; an empty table gives no shards; repeated documents are repeated
in the order; null ids are kept in ``first_doc_id`` as null; other columns are not read.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import fresh_dir, materialize

#: The byte-level BPE vocabulary that the box offers, its split pattern and its free id for the end of a text.
VOCABULARY, END = "/opt/tokenizers/byte_bpe_50k.tiktoken", 50256
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of a worker's cache of words' tokens (about 65 MB when full); it is emptied when full.
CACHE = 400_000
#: Bytes of tokens in a chunk, of pieces that a task holds, of a range of slots; level of compression of what is stored and shuffled.
CHUNK, HELD, RANGE, LEVEL = 4 << 20, 32 << 20, 32 << 20, 3
#: Signs that end a word as a piece of their own; an apostrophe may begin a contraction.
SIGNS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'


_RUN = re.compile(r"\s ")


class Tokenizer:
    """Byte-level BPE with a cache of words; tokens come as little-endian bytes.

    The split pattern never joins a space to what stands before it, so a text without white space before
    a space can be tokenised word by word, each with the space in front of it.
    """

    _made: dict = {}

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.dtype = np.dtype("<u2" if max(ranks.values()) < 2**16 - 1 else "<u4")
        self.code, self._signs = "H" if self.dtype.itemsize == 2 else "I", {}
        outer, piece = self, self.encoding._core_bpe.encode_single_piece

        class Words(dict):
            def __missing__(self, word):
                base = word.rstrip(SIGNS)
                if len(base) < len(word) and base.isalpha():
                    # letters and the signs behind them are pieces of their own, and only the letters are kept
                    return self[base] + outer.signs(word[len(base) :])
                if len(self) >= CACHE:
                    self.clear()
                    self[""] = b""
                if word.isalpha():
                    got = array(outer.code, piece((" " + word).encode())).tobytes()
                else:
                    got = outer.plain(" " + word)
                self[word] = got
                return got

        self.words = Words({"": b""})

    @classmethod
    def of(cls, path: str, pattern: str = PATTERN) -> "Tokenizer":
        if (path, pattern) not in cls._made:
            cls._made[path, pattern] = cls(path, pattern)
        return cls._made[path, pattern]

    def plain(self, text: str) -> bytes:
        return array(self.code, self.encoding.encode_ordinary(text)).tobytes()

    def signs(self, text: str) -> bytes:
        if text not in self._signs:
            if len(self._signs) >= 10_000:
                self._signs.clear()
            self._signs[text] = self.plain(text)
        return self._signs[text]

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if text[0] == " " or text[-1] == " " or _RUN.search(text):
            return self._runs(text)
        words = text.split(" ")
        first, words[0] = words[0], ""
        return self.plain(first) + b"".join(map(self.words.__getitem__, words))

    def _runs(self, text: str) -> bytes:
        """Texts with runs of white space: words that stand alone by the cache, the rest together."""
        out, held = [], []
        parts = text.split(" ")
        for i, w in enumerate(parts):
            after = parts[i + 1] if i + 1 < len(parts) else "x"
            ends = bool(w) and not w[-1].isspace() and after != ""
            if not held and i and ends:
                out.append(self.words[w])
            else:
                held.append(w if i == 0 else " " + w)
                if w and not w[-1].isspace():
                    out.append(self.plain("".join(held)))
                    held = []
        if held:
            out.append(self.plain("".join(held)))
        return b"".join(out)


def feistel(index: np.ndarray, n: int, key: int, rounds: int = 4) -> np.ndarray:
    """A permutation of [0, n) under ``key``, applied to ``index``."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [_mix(np.array([(key + r * 0x9E3779B97F4A7C15) % 2**64], np.uint64))[0] for r in range(1, rounds + 1)]

    def once(x):
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            left, right = right, left ^ (_mix(right ^ k) & mask)
        return (left << np.uint64(half)) | right

    out = once(index.astype(np.uint64))
    while (far := out >= n).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _tokenised(path: str, end: int):
    """Chunks of the token stream of each split: place in the split, documents' starts and ids, compressed tokens."""

    def run(batches):
        from pyspark import TaskContext

        part, t = TaskContext.get().partitionId(), Tokenizer.of(path)
        width, stop, pack = t.dtype.itemsize, np.array([end], t.dtype).tobytes(), zstandard.ZstdCompressor(LEVEL)
        where, split, at, held = None, -1, 0, bytearray()
        starts: list[int] = []
        ids: list = []

        def chunk():
            nonlocal at, held
            n = len(held) // width
            row = {"file": where[0], "block": where[1], "part": part, "split": split, "at": at, "n": n, "doc_at": starts[:], "doc_ids": ids[:], "tokens": pack.compress(held)}
            at, held = at + n, bytearray()
            starts.clear()
            ids.clear()
            return pa.RecordBatch.from_pylist([row], _CHUNKS)

        for b in batches:
            for i, x, file, block in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (file, block) != where:
                    if held:
                        yield chunk()
                    where, split, at = (file, block), split + 1, 0
                starts.append(len(held) // width)
                ids.append(i)
                held += t(x or "")
                held += stop
                if len(held) >= CHUNK:
                    yield chunk()
        if held:
            yield chunk()

    return run


_CHUNKS = pa.schema([("file", pa.string()), ("block", pa.int64()), ("part", pa.int32()), ("split", pa.int32()), ("at", pa.int64()), ("n", pa.int64()), ("doc_at", pa.list_(pa.int64())), ("doc_ids", pa.list_(pa.int64())), ("tokens", pa.binary())])
_CHUNKS_DDL = "file string, block long, part int, split int, at long, n long, doc_at array<long>, doc_ids array<long>, tokens binary"
_PIECES = pa.schema([("range", pa.int32()), ("slot", pa.list_(pa.int64())), ("seq", pa.list_(pa.int64())), ("at", pa.list_(pa.int32())), ("n", pa.list_(pa.int32())), ("doc", pa.list_(pa.int64())), ("tokens", pa.binary())])
_PIECES_DDL = "range int, slot array<long>, seq array<long>, at array<int>, n array<int>, doc array<long>, tokens binary"


def _dealt(length: int, width: int, sequences: int, key: int, per_range: int):
    """Pieces of sequences, packed by the range of slots they go to."""

    def run(batches):
        pack, unpack = zstandard.ZstdCompressor(LEVEL), zstandard.ZstdDecompressor()
        held: dict[int, list] = {}
        size = 0

        def packed():
            rows = [{"range": k, "slot": [p[0] for p in ps], "seq": [p[1] for p in ps], "at": [p[2] for p in ps], "n": [p[3] for p in ps], "doc": [p[4] for p in ps], "tokens": pack.compress(b"".join(p[5] for p in ps))} for k, ps in sorted(held.items())]
            held.clear()
            return pa.RecordBatch.from_pylist(rows, _PIECES)

        for b in batches:
            for start, n, doc_at, doc_ids, tokens in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = unpack.decompress(tokens, max_output_size=n * width)
                seq = np.arange(start // length, (start + n - 1) // length + 1)
                lo, hi = np.maximum(seq * length, start), np.minimum((seq + 1) * length, start + n)
                slot, at = feistel(seq, sequences, key), lo - seq * length
                doc = np.searchsorted(np.array(doc_at), lo - start, side="right") - 1
                for s, q, a, x, y, d in zip(slot.tolist(), seq.tolist(), at.tolist(), (lo - start).tolist(), (hi - start).tolist(), doc.tolist(), strict=True):
                    held.setdefault(s // per_range, []).append((s, q, a, y - x, doc_ids[d], data[x * width : y * width]))
                size += len(data)
                if size >= HELD:
                    yield packed()
                    size = 0
        if held:
            yield packed()

    return run


def write_atomically(uri: str, data: bytes) -> None:
    """Put ``data`` at ``uri``; a reader sees all of it or nothing. An equal file that is there already is left alone."""
    import uuid

    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    info = system.get_file_info(path)
    if info.type == fs.FileType.File and info.size == len(data):
        with system.open_input_file(path) as f:
            if f.read() == data:
                return
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(part) as f:
        f.write(data)
    system.move(part, path)


def _written(uri: str, length: int, dtype: np.dtype, end: int, sequences: int, tokens: int, per_shard: int, per_range: int):
    """Write the shards of the ranges that come and give their index."""

    def run(batches):
        unpack, ranges = zstandard.ZstdDecompressor(), {}
        for b in batches:
            for k, slot, seq, at, n, doc, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                first, count = k * per_range, min(per_range, sequences - k * per_range)
                if k not in ranges:
                    ranges[k] = (np.full(count * length, end, dtype), np.zeros(count, np.int64), np.full(count, -1), [None] * count)
                stream, filled, seqs, docs = ranges[k]
                piece, p = np.frombuffer(unpack.decompress(data, max_output_size=sum(n) * dtype.itemsize), dtype), 0
                for s, q, a, m, d in zip(slot, seq, at, n, doc, strict=True):
                    stream[(s - first) * length + a : (s - first) * length + a + m] = piece[p : p + m]
                    filled[s - first] += m
                    seqs[s - first] = q
                    if a == 0:
                        docs[s - first] = d
                    p += m
        for k, (stream, filled, seqs, docs) in sorted(ranges.items()):
            want = np.where(seqs == sequences - 1, tokens - (sequences - 1) * length, length)
            if (seqs < 0).any() or (filled != want).any():
                raise RuntimeError(f"range {k} does not hold every token of its slots once")
            rows, stride = stream.reshape(-1, length), length * dtype.itemsize
            for i in range(0, len(rows), per_shard):
                shard = (k * per_range + i) // per_shard
                part = rows[i : i + per_shard]
                write_atomically(shard_name(uri, shard), part.tobytes())
                m = len(part)
                yield pa.record_batch([pa.array(np.arange(m) + k * per_range + i), pa.array([shard] * m, pa.int64()), pa.array(np.arange(m) * stride), pa.array([stride] * m, pa.int32()), pa.array(seqs[i : i + m]), pa.array(docs[i : i + m], pa.int64()), pa.array(filled[i : i + m].astype(np.int32)), pa.array([zlib.crc32(x.tobytes()) for x in part], pa.int64())], names=_INDEX_NAMES)

    return run


def shard_name(uri: str, shard: int) -> str:
    return f"{uri}/shard-{shard:08d}.bin"


_INDEX_NAMES = ["slot", "shard", "offset", "stride", "seq", "first_doc_id", "n_tokens", "crc32"]
INDEX = "slot long, shard long, offset long, stride int, seq long, first_doc_id long, n_tokens int, crc32 long"


def materialise_order(df: DataFrame, path: str | None = None, length: int = 1024, shard_bytes: int = 4 << 20, key: int = 20240501, vocabulary: str = VOCABULARY, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards under ``path`` (a new folder in the shared one if not given) and return their index, a row per slot.

    The files are written while the index is computed. ``key`` fixes the order; ``length`` is in tokens.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long"), F.col(text_col), F.input_file_name(), F.input_file_block_start())
    chunks = materialize(rows.mapInArrow(_tokenised(vocabulary, end), _CHUNKS_DDL), "tokens", compression="none")
    splits = chunks.groupBy("file", "block", "part", "split").agg(F.sum("n").alias("tokens"))
    before = Window.orderBy("file", "block", "part", "split").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("part", "split", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("before"))
    tokens = chunks.agg(F.sum("n")).first()[0] or 0
    dtype = Tokenizer.of(vocabulary).dtype
    stride, sequences = length * dtype.itemsize, -(-tokens // length)
    per_shard = max(1, shard_bytes // stride)
    per_range = per_shard * max(1, RANGE // (per_shard * stride))
    uri = path or fresh_dir(spark, "order")
    uri = uri if "://" in uri else f"file://{uri.removeprefix('file:')}"
    manifest = {"sequences": sequences, "tokens": tokens, "length": length, "dtype": dtype.str, "stride": stride, "slots_per_shard": per_shard, "key": key, "end": end, "vocabulary": vocabulary.rsplit("/", 1)[-1]}
    write_atomically(f"{uri}/manifest.json", json.dumps(manifest).encode())
    placed = chunks.join(F.broadcast(starts), ["part", "split"]).select((F.col("before") + F.col("at")).alias("start"), "n", "doc_at", "doc_ids", "tokens")
    pieces = placed.mapInArrow(_dealt(length, dtype.itemsize, sequences, key, per_range), _PIECES_DDL)
    return pieces.repartitionById(max(1, -(-sequences // per_range)), F.col("range")).mapInArrow(_written(uri, length, dtype, end, sequences, tokens, per_shard, per_range), INDEX)


def read_slots(uri: str, first: int, count: int) -> np.ndarray:
    """Sequences of slots first .. first + count - 1, by seeking in the shard files that the manifest describes."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_file(f"{path}/manifest.json") as f:
        m = json.loads(f.read())
    out, count = [], min(count, m["sequences"] - first)
    while count > 0:
        shard, at = divmod(first, m["slots_per_shard"])
        with system.open_input_file(shard_name(path, shard)) as f:
            got = f.read_at(min(count, m["slots_per_shard"] - at) * m["stride"], at * m["stride"])
        out.append(np.frombuffer(got, m["dtype"]).reshape(-1, m["length"]))
        first, count = first + len(out[-1]), count - len(out[-1])
    return np.concatenate(out) if out else np.zeros((0, m["length"]), m["dtype"])


def op1_order(spark, sf_dir: str) -> DataFrame:
    """Index of the shards that hold all documents' tokens in training order."""
    return materialise_order(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
