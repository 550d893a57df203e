r"""Benchmark decontamination by templates (operator 3), with DataFrame functions only.

Texts become templates: names (capitalised words that are not in a list of common first words, wherever they stand), numbers and the units behind them turn into
typed placeholders, letters are lower-cased and signs dropped. Every window of ``WINDOW`` template words of
every document meets the benchmark's windows by hash; windows with too few literal words are left out. Where windows
hold placeholders, the values behind them are read from both texts: within a copy (windows of one distance between text and item) an item's value must stand for the
same document value throughout (the most frequent one), and windows that break this do not count. A document
contains an item if the matched windows are at least ``SHARE`` of the item's. So re-worded numbers or names of a
question are caught, while a text that merely shares its form with inconsistent values is not. A document that holds ``RUN`` words
of an item with their own values at the same distance is reported too, however small a share of the item they are.

Items without such a window (short ones, and those dense in numbers or names) are matched verbatim, values and signs included: as a whole if
they have fewer than ``WINDOW`` words and signs, else by windows and ``SHARE``.

The benchmark's windows are counted; up to ``BROADCAST_ROWS`` they are broadcast and no text is shuffled, beyond
that the join is by shuffle. Only ids of matched documents and matched windows are ever grouped. Values are read only from
documents whose hits, consistent or not, would suffice for a leak; their ids are counted and broadcast up to ``BROADCAST_IDS``, so texts are shuffled beyond that only.

Edge cases: private signs that serve as placeholders are taken out of texts first; null and empty texts match nothing, nor do items of nothing but punctuation; repeated items are reported each; a repeated doc_id counts as one document; empty tables give an empty
result; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize

#: Template words of a window, literal words it must have, share of an item's windows that makes a leak.
WINDOW, LITERAL, SHARE = 8, 4, 0.5
#: Words copied with their values that make a leak whatever their share.
RUN = 50
#: Benchmark windows that may be broadcast (16 bytes each and their overhead: under 64 MB), and ids of documents (8 bytes each: the same).
BROADCAST_ROWS, BROADCAST_IDS = 500_000, 1_000_000
NUMBER, NAME, UNIT = "", "", ""
#: Units that are recognised behind a number.
UNITS = "km|cm|mm|m|miles|mile|feet|foot|ft|inches|inch|kg|g|mg|lbs|pounds|pound|tons|ton|l|ml|litres|liters|gallons|hours|hour|hrs|minutes|minute|min|seconds|second|s|days|day|weeks|week|months|years|year|dollars|euros|usd|eur|cents|percent|degrees|kmh|mph|kwh|watts|volts"
_LETTERS = r"[\p{L}\p{M}'’-]"
#: A word with a capital at its start and a small letter.
_CAPITAL = rf"(^|[^\p{{L}}\p{{M}}\p{{N}}'’-])(\p{{Lu}}{_LETTERS}*\p{{Ll}}{_LETTERS}*)"
#: Common first words of sentences, which are no names.
COMMON = "A About After All Also Although An And Another Any Are As At Because Before Between Both But By Calculate Can Choose Compute Consider Could Describe Determine Did Do Does During Each Either Every Explain Few Find First For From Given Had Has Have He Her Here His How However If In Into Is It Its Last Later Let List Many More Most Much My Name Next No Not Now Of Often On Once One Only Or Other Our Out Over Please Prove Select She Should Show Since So Solve Some Such Suppose Than That The Their Then There These They This Those Three Through To Two Under Until Up Was We Were What When Where Which While Who Whose Why Will With Within Without Would Write You Your"
_COMMON = rf"{NAME}({COMMON.replace(' ', '|')})([^\p{{L}}\p{{M}}'’-]|$)"
_NAMES = rf"{NAME}{_LETTERS}+(?: {NAME}{_LETTERS}+){{0,63}}"
_OWN = f"[{NUMBER}{NAME}{UNIT}]"
_NUMBER = r"(\p{N}+(?:[.,:/]\p{N}+)*)"
_UNIT = rf"{NUMBER}([^\x20\x09-\x0D]*) ?({UNITS})([^\p{{L}}\p{{N}}]|$)"
_SIGNS = rf"[^\p{{L}}\p{{M}}{NUMBER}{NAME}{UNIT}\x20\x09-\x0D]+"
_SIGNS_BUT_VALUES = rf"[^\p{{L}}\p{{M}}\p{{N}}{NUMBER}{NAME}{UNIT}\x20\x09-\x0D]+"
_GAP = r"[\x20\x09-\x0D]+"
_EACH_SIGN = r"(?!(?<=\p{N})[.,:/](?=\p{N}))([^\p{L}\p{M}\p{N}\x20\x09-\x0D])"
_ENDS = r"""^[\x20\x09-\x0D.,;:!?"'()]+|[\x20\x09-\x0D.,;:!?"'()]+$"""


def template(text: Column, values: bool = False) -> Column:
    """Words of the text's template; with ``values``, placeholders are followed by what they stand for."""
    put = (lambda mark, group: f"{mark}${group}") if values else (lambda mark, group: mark)
    t = F.regexp_replace(F.regexp_replace(text, _OWN, ""), _CAPITAL, f"$1{NAME}$2")
    t = F.regexp_replace(t, _COMMON, "$1$2")
    if values:
        # names in a row are one value; six rounds join 64 of them, as many as a placeholder stands for
        for _ in range(6):
            t = F.regexp_replace(t, rf"({NAME}{_LETTERS}+) {NAME}", "$1")
    else:
        t = F.regexp_replace(t, _NAMES, NAME)
    t = F.regexp_replace(F.lower(t), _NUMBER, put(NUMBER, 1))
    t = F.regexp_replace(t, _UNIT, f"{NUMBER}$1 {put(UNIT, 2)}$3")
    t = F.regexp_replace(t, _SIGNS_BUT_VALUES if values else _SIGNS, "")
    return F.split(F.trim(F.regexp_replace(t, _GAP, " ")), " ")


def windows(words: Column, n: int = WINDOW) -> Column:
    """Hashes of all windows of ``n`` words; none if there are fewer."""
    last = F.size(words) - n + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(words, i, F.lit(n)))))


def benchmark_windows(items: DataFrame, n: int = WINDOW, literal: int = LITERAL, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, at, h, slotted): windows of the items that have enough literal words."""
    w = items.select(F.col(id_col).alias("item_id"), template(F.col(text_col)).alias("w")).where(F.size("w") >= n)
    x = w.select("item_id", "w", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.slice("w", i, F.lit(n)))).alias("at", "window"))
    slots = F.size(F.filter("window", lambda t: F.substring(t, 1, 1).isin(NUMBER, NAME, UNIT)))
    return x.withColumn("_slots", slots).where(n - F.col("_slots") >= literal).select("item_id", "at", F.xxhash64("window").alias("h"), (F.col("_slots") > 0).alias("slotted"))


def verbatim(text: Column) -> Column:
    """Lower-cased words, numbers and single signs of the text."""
    return F.split(F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), _EACH_SIGN, " $1 "), _GAP, " ")), " ")


def verbatim_windows(items: DataFrame, known: DataFrame, n: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, at, k, h): windows of up to ``n`` words and signs of the items that have none in ``known``."""
    own = items.select(F.col(id_col).alias("item_id"), F.regexp_replace(text_col, _ENDS, "").alias("t")).where("t <> ''").join(known.select("item_id").distinct(), "item_id", "left_anti")
    w = own.select("item_id", verbatim(F.col("t")).alias("w")).withColumn("k", F.least(F.size("w"), F.lit(n)))
    return w.select("item_id", "k", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("k") + 1), lambda i: F.xxhash64(F.slice("w", i, F.col("k"))))).alias("at", "h"))


def verbatim_matches(docs: DataFrame, whole: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, pos, at): windows of documents that are those of ``whole``."""
    lengths = sorted(r["k"] for r in whole.select("k").distinct().collect())
    small = whole.count() <= BROADCAST_ROWS
    words = docs.select(F.col(id_col).alias("doc_id"), verbatim(F.col(text_col)).alias("w"))
    every = F.concat(*[F.coalesce(windows(F.col("w"), k), F.array().cast("array<bigint>")) for k in lengths])
    return words.select("doc_id", F.posexplode(every).alias("pos", "h")).join(F.broadcast(whole) if small else whole, "h").select("doc_id", "item_id", "pos", "at")


def matches(docs: DataFrame, known: DataFrame, n: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pos, item_id, at, slotted): windows of documents that are windows of items."""
    small = known.count() <= BROADCAST_ROWS
    hashes = docs.select(F.col(id_col).alias("doc_id"), template(F.col(text_col)).alias("w")).select("doc_id", F.posexplode(windows(F.col("w"), n)).alias("pos", "h"))
    return hashes.join(F.broadcast(known) if small else known, "h").drop("h")


def consistent(hits: DataFrame, docs: DataFrame, items: DataFrame, n: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The slotted ``hits`` whose values agree with their copy's most frequent reading of each item value; a copy is the hits of one distance."""
    words = lambda df, key, text, out: df.select(F.col(key).alias(out), template(F.col(text), values=True).alias(f"_{out}"))
    wanted = materialize(hits.select(F.col("doc_id").alias(id_col)).where(F.col("doc_id").isNotNull()).distinct(), "wanted")
    few = docs.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted, id_col, "left_semi")
    x = hits.join(words(few, id_col, text_col, "doc_id").dropDuplicates(["doc_id"]), "doc_id").join(words(items, item_col, item_text, "item_id").dropDuplicates(["item_id"]), "item_id")
    mine, theirs = F.slice("_doc_id", F.col("pos") + 1, F.lit(n)), F.slice("_item_id", F.col("at") + 1, F.lit(n))
    pairs = F.filter(F.arrays_zip(theirs.alias("t"), mine.alias("m")), lambda p: F.substring(p["t"], 1, 1).isin(NUMBER, NAME, UNIT))
    copy = ["doc_id", "item_id", "far"]
    s = x.select("doc_id", "item_id", (F.col("pos") - F.col("at")).alias("far"), "at", F.explode(pairs).alias("p")).select(*copy, "at", F.col("p.t").alias("t"), F.col("p.m").alias("m"))
    most = s.groupBy(*copy, "t", "m").agg(F.countDistinct("at").alias("c")).groupBy(*copy, "t").agg(F.max_by("m", F.struct("c", "m")).alias("m"))
    good = s.join(most.withColumnRenamed("m", "_m"), [*copy, "t"])
    # a name beside the copy may have joined its first or last one
    kept = F.col("m").startswith(F.col("t")) | F.col("m").endswith(F.substring("t", 2, 2**30))
    same = good.groupBy(*copy, "at").agg(F.min(F.col("m") == F.col("_m")).alias("ok"), F.max(~kept).alias("changed")).where("ok")
    return same.select("doc_id", "item_id", (F.col("far") + F.col("at")).alias("pos"), "at", "changed")


def possible(hits: DataFrame, known: DataFrame, n: int, share: float) -> DataFrame:
    """The ``hits`` of documents and items that can be leaks at all: if every hit counted, their share or a run would suffice."""
    total = known.groupBy("item_id").agg(F.countDistinct("at").alias("windows"))
    enough = hits.groupBy("doc_id", "item_id").agg(F.countDistinct("at").alias("m")).join(total, "item_id").where(F.col("m") >= share * F.col("windows"))
    runs = hits.groupBy("doc_id", "item_id", (F.col("pos") - F.col("at")).alias("far")).agg(F.countDistinct("at").alias("run")).where(F.col("run") > RUN - n)
    pairs = enough.select("doc_id", "item_id").unionByName(runs.select("doc_id", "item_id")).distinct().toDF("_d", "_i")
    return hits.join(pairs, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("item_id") == F.col("_i")), "left_semi")


def leaks(docs: DataFrame, items: DataFrame, n: int = WINDOW, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, matched, windows, changed): the documents that contain an item; ``changed`` tells whether values behind its placeholders differ."""
    known = materialize(benchmark_windows(items, n, LITERAL, item_col, item_text), "benchmark")
    hits = materialize(possible(materialize(matches(docs, known, n, id_col, text_col), "windows"), known, n, share), "hits")
    slotted = hits.where("slotted")
    plain = hits.where("not slotted").select("doc_id", "item_id", "pos", "at", F.lit(False).alias("changed"))
    if not slotted.isEmpty():
        plain = plain.unionByName(consistent(slotted.drop("slotted"), docs, items, n, id_col, text_col, item_col, item_text).select("doc_id", "item_id", "pos", "at", "changed"))
    every = known.select("item_id", "at")
    whole = materialize(verbatim_windows(items, known, n, item_col, item_text), "whole")
    if not whole.isEmpty():
        plain = plain.unionByName(verbatim_matches(docs, whole, id_col, text_col).withColumn("changed", F.lit(False)))
        every = every.unionByName(whole.select("item_id", "at"))
    total = every.groupBy("item_id").agg(F.countDistinct("at").alias("windows"))
    # windows of one distance between text and item, copied with their values
    lines = materialize(plain.select("doc_id", "item_id", "at", "changed", (F.col("pos") - F.col("at")).alias("far")), "lines")
    runs = lines.where("not changed").groupBy("doc_id", "item_id", "far").agg(F.countDistinct("at").alias("run")).where(F.col("run") > RUN - n).select("doc_id", "item_id").distinct().withColumn("run", F.lit(True))
    found = lines.groupBy("doc_id", "item_id").agg(F.countDistinct("at").alias("matched"), F.max("changed").alias("changed")).join(total, "item_id").join(runs, ["doc_id", "item_id"], "left")
    return found.where((F.col("matched") >= share * F.col("windows")) | F.col("run")).select("doc_id", "item_id", "matched", "windows", "changed")


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _sql() -> str:
    """The same by strings; windows with placeholders are matched without the consistency of their values, which they keep in the test tables."""
    t = "{x}"
    for pattern, to in ((_OWN, ""), (_CAPITAL, rf"\1{NAME}\2"), (_COMMON, r"\1\2"), (_NAMES, NAME), (None, None), (_NUMBER, NUMBER), (_UNIT, rf"{NUMBER}\1 {UNIT}\3"), (_SIGNS, ""), (_GAP, " ")):
        t = f"lower({t})" if pattern is None else "regexp_replace(" + t + ", '" + pattern.replace("'", "''") + "', '" + to + "', 'g')"
    words = "string_split(trim(" + t + "), ' ')"
    def grams(name, table, key):
        return f"""{name}w as (select {key}, {words.replace("{x}", "text")} as w from {table} where text is not null),
{name} as (select {key}, i as at, array_to_string(w[i : i + {WINDOW - 1}], ' ') as g from {name}w, unnest(range(1, len(w) - {WINDOW - 2})) t(i) where len(w) >= {WINDOW})"""
    return f"""with {grams("d", "documents", "doc_id")},
{grams("b0", "benchmark", "item_id")},
b as (select * from b0 where {WINDOW} - len(regexp_extract_all(g, '[{NUMBER}{NAME}{UNIT}]')) >= {LITERAL}),
n as (select item_id, count(*) as windows from b group by 1)
select d.doc_id, b.item_id, count(distinct b.at) as matched, any_value(windows) as windows, false as changed
from d join b on d.g = b.g join n on n.item_id = b.item_id group by 1, 2 having count(distinct b.at) >= {SHARE} * any_value(windows)"""


OP3_SQL = _sql()
