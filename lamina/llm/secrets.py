r"""Secrets and multipart credentials in whole texts (operator 11).

A credential has parts of three roles: an identifier (who), a secret (with what) and an endpoint (where). Patterns find the
parts. *Base* parts are reported wherever they stand:

* ``assign`` (secret): ``KEYWORD = value`` with a value of 8 or more characters; the span is the whole match
* ``access`` (identifier): ``AKIA...`` of 16 or more characters
* ``hex`` (secret): 32 or more lower-case hex digits

*Weak* parts mean little alone and are reported only if a complementary part stands in their scope:

* ``login`` (identifier): ``user = value`` and the like, if a secret, weak or not, is in scope
* ``short`` (secret): a value of 4 to 7 characters behind a keyword, if an identifier is
* ``opaque`` (secret): a stand-alone token of 20 or more characters with both cases and a digit, if an identifier is
* ``endpoint`` (endpoint): a connection URL or ``host = value``, if a secret is that is reported itself

The scope of a part is the interval of ``reach`` code points on either side of it, cut at the blank lines around its section of the text.
Scopes and parts meet in an interval join: per section and role the parts lie sorted by start with the largest end so
far, and a scope finds an overlapping part by one binary search, whatever the number of parts; no pair is formed. A
document's parts never leave it, so the join runs where its text is read and nothing is shuffled.

A weak part that overlaps a base part is that part, and is left out; so is an opaque token inside an endpoint. Per kind, matches are
leftmost and do not overlap; those that fail a length are dropped afterwards, as if they had been no match but still hide what they cover.

Edge cases: a null or empty text has no findings (an empty array); rows of null or repeated ids are scanned like all
others; texts of any length are scanned whole; a column named like the result is replaced, others pass through; an empty
table gives an empty result. Matching is by code point; letters of keywords match in either case for ASCII only.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points on either side of a part in which its complements count.
REACH = 300

_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_LOGIN = re.compile(r"""(?ai)\b(user(?:_?name)?|login|account(?:_?id)?|client_?id|access_?key_?id|uid)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""")
_OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}+(?![A-Za-z0-9+/_=-])")
_ENDPOINT = re.compile(r"""(?ai)\b(?:https?|ftps?|sftp|ssh|s3|amqps?|rediss?|mongodb(?:\+srv)?|postgres(?:ql)?|mysql|jdbc:[a-z0-9]+)://[^\s"'<>]+|\b(?:host(?:name)?|server|endpoint)["']?\x20*[:=]\x20*["']?[A-Za-z0-9][A-Za-z0-9-]*(?:\.[A-Za-z0-9-]+)+(?::[0-9]+)?""")
_BLANK = re.compile(r"\n[^\S\n]*\n")

#: Kinds in the order in which spans of one start are listed, and their roles.
KINDS = {"assign": "secret", "access": "identifier", "hex": "secret", "login": "identifier", "short": "secret", "opaque": "secret", "endpoint": "endpoint"}
BASE = ("assign", "access", "hex")
_ORDER = {k: i for i, k in enumerate(KINDS)}
#: What must be in scope for a weak part of a role.
COMPLEMENT = {"identifier": "secret", "secret": "identifier", "endpoint": "secret"}


class Cover:
    """Spans by start, for overlap searches."""

    def __init__(self, spans):
        self.spans, self.ends, top = sorted(spans), [], -1
        self.starts = [s for s, _ in self.spans]
        for _, e in self.spans:
            top = max(top, e)
            self.ends.append(top)

    def meets(self, start: int, end: int) -> bool:
        """Whether a span shares a position with [start, end)."""
        k = bisect_left(self.starts, end)
        return k > 0 and self.ends[k - 1] > start

    def nearest(self, start: int, end: int) -> int:
        """Start of the span that begins closest to [start, end), the earlier one on ties."""
        k = bisect_left(self.starts, start)
        near = self.starts[max(0, k - 1) : k + 1]
        return min(near, key=lambda s: (abs(s - start), s))


def parts_of(text: str) -> list[tuple[str, int, int]]:
    """Base and weak parts (kind, start, end) before linking."""
    base, weak = [], []
    for m in _ASSIGN.finditer(text):
        size = len(m[2])
        if size >= 8:
            base.append(("assign", *m.span()))
        elif size >= 4:
            weak.append(("short", *m.span()))
    base += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    base += [("hex", *m.span()) for m in _HEX.finditer(text)]
    taken = Cover((s, e) for _, s, e in base)
    ends = [("endpoint", *m.span()) for m in _ENDPOINT.finditer(text)]
    urls = Cover((s, e) for _, s, e in ends)
    weak += ends
    weak += [("login", *m.span()) for m in _LOGIN.finditer(text)]
    for m in _OPAQUE.finditer(text):
        t = m[0]
        if not urls.meets(*m.span()) and any(c.isdigit() for c in t) and t.lower() != t and t.upper() != t:
            weak.append(("opaque", *m.span()))
    return base + [x for x in weak if not taken.meets(x[1], x[2])]


def linked(text: str, reach: int = REACH) -> list[tuple[str, str, int, int, bool, int | None]]:
    """Findings (kind, role, start, end, base, start of the nearest complement in scope), sorted; the interval join of parts and scopes."""
    parts = parts_of(text)
    if not parts:
        return []
    cuts = [m.start() for m in _BLANK.finditer(text)]
    sections: dict[int, list] = {}
    for p in parts:
        sections.setdefault(bisect_right(cuts, p[1]), []).append(p)
    found = []
    for n, held in sections.items():
        low, high = (cuts[n - 1] if n else 0), (cuts[n] if n < len(cuts) else len(text))
        covers = {r: Cover((s, e) for k, s, e in held if KINDS[k] == r) for r in ("identifier", "secret")}

        def complement(kind, start, end):
            cover = covers[COMPLEMENT[KINDS[kind]]]
            return cover.nearest(start, end) if cover.meets(max(low, start - reach), min(high, end + reach)) else None

        kept = [(*p, other) for p in held if p[0] != "endpoint" and ((other := complement(*p)) is not None or p[0] in BASE)]
        # endpoints need a secret that is reported
        covers["secret"] = Cover((s, e) for k, s, e, _ in kept if KINDS[k] == "secret")
        kept += [(*p, other) for p in held if p[0] == "endpoint" and (other := complement(*p)) is not None]
        found += [(k, KINDS[k], s, e, k in BASE, other) for k, s, e, other in kept]
    return sorted(found, key=lambda f: (f[2], _ORDER[f[0]], f[3]))


_FINDING = pa.struct([("kind", pa.string()), ("role", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("linked", pa.int64())])
_FINDINGS = "array<struct<kind: string, role: string, start: bigint, end: bigint, base: boolean, linked: bigint>>"


def scan(df: DataFrame, reach: int = REACH, text_col: str = "text", out: str = "findings", keep_text: bool = True) -> DataFrame:
    """``df`` with ``out``: the findings of each text, sorted by start, then kind (the order of ``KINDS``)."""
    base = df.drop(out) if out != text_col else df
    names = [c for c in base.columns if c != out and (keep_text or c != text_col)]
    types = dict(base.dtypes)

    def run(batches):
        for b in batches:
            texts = b.column(b.schema.get_field_index(text_col))
            found = [[dict(zip(("kind", "role", "start", "end", "base", "linked"), f, strict=True)) for f in linked(x.as_py() or "", reach)] for x in texts]
            yield pa.record_batch([*[b.column(b.schema.get_field_index(c)) for c in names], pa.array(found, pa.list_(_FINDING))], names=[*names, out])

    return base.mapInArrow(run, ", ".join([*[f"`{c}` {types[c]}" for c in names], f"`{out}` {_FINDINGS}"]))


def listed(findings: Column) -> Column:
    """Findings as kind:start:end, joined by commas."""
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")


def masked(text: Column, findings: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every base or linked secret and identifier replaced by ``mark``; overlapping spans become one mark."""
    spans = F.filter(findings, lambda f: f["role"] != "endpoint")
    zero = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))

    def step(acc, f):
        fresh = F.when(f["start"] >= acc["at"], F.concat(acc["done"], F.substr(text, (acc["at"] + 1).cast("int"), (f["start"] - acc["at"]).cast("int")), F.lit(mark))).otherwise(acc["done"])
        return F.struct(fresh.alias("done"), F.greatest(acc["at"], f["end"]).alias("at"))

    return F.aggregate(spans, zero, step, lambda acc: F.concat(acc["done"], F.substr(text, (acc["at"] + 1).cast("int"))))


def op11_secrets(spark, sf_dir: str) -> DataFrame:
    """Counts and spans of the secrets of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, keep_text=False)

    def count(kind):
        return F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = listed(F.filter("findings", lambda f: f["base"]))
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(base, 256).alias("base_sha256"), listed(F.col("findings")).alias("spans"))
