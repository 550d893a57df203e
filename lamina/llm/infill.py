r"""Fill-in-the-middle rows by run-length class encoding (operator 13).

The class of a code point is its length in UTF-8. A text is stored as its maximal runs of one class, each with the
number of units (code points) and bytes before it. A cut after u units is found by binary search for the run that
holds unit u; its byte offset is the run's offset plus the units into the run times the class's length, so neither the text is
decoded nor its characters are indexed. The runs of a whole slice of texts lie in one pair of sorted arrays, and all
cuts of the slice are searched at once.

Two keyed hashes of the id choose the cuts, a third whether the row is rearranged, a fourth in which order:
``psm`` writes prefix, suffix, middle and ``spm`` suffix, prefix, middle, each part behind its sentinel, ``plain`` the text itself.

Edge cases: a null text counts as empty and is plain; so is a text that contains a sentinel, so that ``restore`` is exact for
every row; a null id hashes like an empty one; rows of repeated ids are cut alike but each by its own
length; columns named like the added ones are replaced, all others pass through; an empty table gives an empty result.
A task holds one slice of at most ``SLICE`` bytes (or one longer text) and its arrays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentinels before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Bytes of text that are encoded together.
SLICE = 4 << 20
ADDED = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string"}

#: Length in UTF-8 of the code point that a byte begins; 0 for the bytes inside one.
_LENGTH = np.array([1] * 128 + [0] * 64 + [2] * 32 + [3] * 16 + [4] * 16, np.uint8)


class ClassRuns:
    """Maximal runs of equal classes of some concatenated texts: first unit and first byte of each, and its class."""

    def __init__(self, data: np.ndarray):
        """``data``: the texts' UTF-8 bytes."""
        lead = np.flatnonzero(_LENGTH[data])
        kinds = _LENGTH[data[lead]]
        first = np.flatnonzero(np.diff(kinds, prepend=0) != 0)
        self.units, self.bytes, self.kinds = first, lead[first], kinds[first].astype(np.int64)
        self.total, self.size = len(lead), len(data)

    def byte_of(self, units: np.ndarray) -> np.ndarray:
        """Byte offsets of the positions before these units; the number of all units stands for the end."""
        if not self.total:
            return np.zeros(len(units), np.int64)
        run = np.searchsorted(self.units, units, side="right") - 1
        return self.bytes[run] + (units - self.units[run]) * self.kinds[run]

    def unit_of(self, offsets: np.ndarray) -> np.ndarray:
        """The inverse of ``byte_of``, for offsets where a code point begins, and the end."""
        if not self.total:
            return np.zeros(len(offsets), np.int64)
        run = np.searchsorted(self.bytes, offsets, side="right") - 1
        return self.units[run] + (offsets - self.bytes[run]) // self.kinds[run]


def _slices(lengths: np.ndarray):
    """Ranges of rows with about ``SLICE`` bytes of text."""
    ends, at = np.cumsum(lengths), 0
    while at < len(lengths):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, side="right")))
        yield at, upto
        at = upto


def _rearranged(text_at: int, kept: list[int], marks: tuple[str, str, str]):
    p, s, m = (x.encode() for x in marks)

    def one(texts: list[bytes], h: np.ndarray) -> pa.RecordBatch:
        ends = np.cumsum([len(t) for t in texts])
        starts = np.concatenate([[0], ends[:-1]])
        runs = ClassRuns(np.frombuffer(b"".join(texts), np.uint8))
        first = runs.unit_of(starts)
        n = runs.unit_of(ends) - first
        cuts = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
        a, b = (runs.byte_of(first + cuts[:, k]) - starts for k in (0, 1))
        plain = (n == 0) | (h[:, 2] == 0) | np.array([any(x in t for x in (p, s, m)) for t in texts], bool)
        forms, out = [], []
        for t, i, j, skip, swap in zip(texts, a.tolist(), b.tolist(), plain.tolist(), (h[:, 3] == 1).tolist(), strict=True):
            forms.append("plain" if skip else "spm" if swap else "psm")
            out.append(t if skip else b"".join((s, t[j:], p, t[:i], m, t[i:j]) if swap else (p, t[:i], s, t[j:], m, t[i:j])))
        sizes = [pa.array(x, pa.int64(), mask=plain) for x in (cuts[:, 0], cuts[:, 1] - cuts[:, 0])]
        return [pa.array(n, pa.int64()), pa.array(forms, pa.string()), *sizes, pa.array(out, pa.binary()).cast(pa.string())]

    def run(batches):
        for batch in batches:
            texts = batch.column(text_at).cast(pa.binary()).fill_null(b"")
            h = np.stack([np.asarray(batch.column(batch.num_columns - 4 + k)) for k in range(4)], 1)
            lengths = np.asarray(pa.compute.binary_length(texts), np.int64)
            for at, upto in _slices(lengths):
                made = one(texts[at:upto].to_pylist(), h[at:upto])
                yield pa.record_batch([*[batch.column(i)[at:upto] for i in kept], *made], names=[*[batch.schema.names[i] for i in kept], *ADDED])

    return run


def fill_in_middle(df: DataFrame, rate: int = 90, swapped: int = 20, seed: str = "1", sentinels: tuple[str, str, str] = SENTINELS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with n (code points), form, prefix_chars, middle_chars (null if plain) and output (the rearranged text).

    ``rate`` percent of the rows are rearranged, ``swapped`` percent of those as spm.
    """
    base = df.drop(*(c for c in ADDED if c not in (id_col, text_col)))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]
    names = [f"_fim{k}" for k in range(4)]
    keyed = base.select("*", *[x.alias(c) for x, c in zip([h[0], h[1], (h[2] % 100 < rate).cast("long"), (h[3] % 100 < swapped).cast("long")], names, strict=True)])
    kept = [i for i, c in enumerate(base.columns) if c not in ADDED]
    schema = ", ".join([*[f"`{base.columns[i]}` {base.dtypes[i][1]}" for i in kept], *[f"{c} {t}" for c, t in ADDED.items()]])
    return keyed.mapInArrow(_rearranged(base.columns.index(text_col), kept, sentinels), schema)


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that ``fill_in_middle`` rearranged. No part contains a sentinel, and none can arise where parts meet sentinels, as only their first sign is ``<``."""
    parts = F.split(output, "|".join(f"\\Q{x}\\E" for x in sentinels), -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))


def op13_infill(spark, sf_dir: str) -> DataFrame:
    """Form, cuts and digests of every document's rearranged and restored text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made = fill_in_middle(docs)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP13_SQL = """
with d as (select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as x from documents),
h as (select doc_id, t, length(t) as n, cast('0x' || substr(x, 1, 8) as bigint) as h1, cast('0x' || substr(x, 9, 8) as bigint) as h2,
        cast('0x' || substr(x, 17, 8) as bigint) % 100 as h3, cast('0x' || substr(x, 25, 8) as bigint) % 100 as h4 from d),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
        case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 >= 90 then 'plain' when h4 < 20 then 'spm' else 'psm' end as form from h),
p as (select *, substring(t, 1, a) as pre, substring(t, a + 1, b - a) as mid, substring(t, b + 1) as suf from c)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then cast(a as bigint) end as prefix_chars, case when form <> 'plain' then cast(b - a as bigint) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
  sha256(t) as restored_sha256
from p
"""
