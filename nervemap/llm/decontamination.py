"""Benchmark decontamination by winnowing. DataFrame functions only.

Of every run of ``span`` words the smallest hash of its k-grams is kept (k + w - 1 = span, w k-grams a run), with its place; runs that
overlap mostly keep the same one, so a text has about one anchor for four words. Equal runs have equal anchors in equal places, so every
shared run of ``span`` words or more is found. Anchors of a text and of the items are joined on the fingerprint alone; each
carries the words around it as far as a run can reach, and the hit is extended to the left and right while words agree. If that makes
``span`` words, it is a shared run; overlapping ones merge. Items of fewer words count as one run of their own length, with k-grams as
long as that allows.

A filter of the items' fingerprints lets a text's anchors through before anything is written; it grows with the items up to a
fixed size, beyond which it only lets more through. All results are functions of the text alone and are computed once for each distinct text,
known by two independent 64-bit hashes and its length, so copies never pile up.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nervemap.runtime import materialize

#: What stands between words, once A-Z are lower case: all of ASCII but digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Least and greatest slots (a byte each) of the filter, and slots for each fingerprint in between.
SLOTS, PER_FINGERPRINT = (1 << 14, 1 << 22), 32
#: Texts with hits up to which their results (about 150 bytes each) are broadcast to the rows; beyond, rows are salted and joined.
BROADCAST_TEXTS, SALTS = 200_000, 32
KEY = ["_k1", "_k2", "_k3"]
_ANCHORS = "array<struct<span:int,at:int,fp:bigint,before:array<string>,after:array<string>>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """Lower case for A-Z only."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), BETWEEN), lambda w: w != "")


def text_key(text: Column) -> list[Column]:
    whole = F.coalesce(text.cast("string"), F.lit(""))
    return [F.xxhash64(whole).alias("_k1"), F.xxhash64(F.lit("second"), whole).alias("_k2"), F.octet_length(whole).alias("_k3")]


def _anchors(w: Column, span: int, gram: int, wanted: Callable[[Column], Column] | None) -> Column:
    """Of the runs of ``span`` words in the array ``w`` the distinct anchors for which ``wanted`` holds: place, fingerprint, and the words before
    (nearest first) and from there on that a run with this anchor can have."""
    k = min(gram, span)
    reach = span - k

    def of_grams(grams: Column) -> Column:
        least = lambda i: F.array_min(F.slice(grams, i + 1, reach + 1))
        seen = F.transform(F.sequence(F.lit(0), F.size(w) - span), lambda i: F.struct(i.alias("i"), least(i).alias("fp")))
        if wanted is not None:
            seen = F.filter(seen, lambda x: wanted(x["fp"]))
        placed = F.transform(seen, lambda x: F.struct((x["i"] + F.array_position(F.slice(grams, x["i"] + 1, reach + 1), x["fp"]).cast("int") - 1).alias("at"), x["fp"].alias("fp")))
        return F.transform(
            F.array_distinct(placed),
            lambda x: F.struct(
                F.lit(span).alias("span"), x["at"], x["fp"],
                F.reverse(F.slice(w, F.greatest(x["at"] - reach, F.lit(0)) + 1, F.least(x["at"], F.lit(reach)))).alias("before"),
                F.slice(w, x["at"] + 1, F.lit(span)).alias("after"),
            ),
        )

    hashes = F.transform(w, lambda x: F.xxhash64(x))
    grams = let(hashes, lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(F.slice(h, i + 1, k))))
    return F.when(F.size(w) >= span, let(grams, of_grams)).otherwise(F.array().cast(_ANCHORS))


def _agreeing(a: Column, b: Column) -> Column:
    """How many words from the start are equal."""
    differ = F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y))  # where one ends, null meets a word
    at = F.array_position(differ, True).cast("int")
    return F.when(at > 0, at - 1).otherwise(F.size(a))


def _filter(anchors: DataFrame, n: int) -> Callable[[Column], Column]:
    """A test that every fingerprint of ``anchors``, ``n`` of them, passes. A sixty-fourth of the slots reaches the driver."""
    slots = SLOTS[0]
    while slots < min(SLOTS[1], n * PER_FINGERPRINT):
        slots *= 2
    places = lambda fp: [fp.bitwiseAND(F.lit(slots - 1)), F.shiftright(fp, 30).bitwiseAND(F.lit(slots - 1))]
    bits = F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 AS int))")).alias("bits")
    table = bytearray(slots)
    for r in anchors.select(F.explode(F.array(*places(F.col("fp")))).alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(bits).collect():
        for i in range(64):
            if r["bits"] >> i & 1:
                table[r["word"] * 64 + i] = 1
    held = F.lit(bytes(table))
    first, second = (lambda fp, j=j: F.substring(held, (places(fp)[j] + 1).cast("int"), 1) == F.lit(b"\x01") for j in (0, 1))
    return lambda fp: first(fp) & second(fp)


def _of_rows(base: DataFrame, found: DataFrame) -> DataFrame:
    """``base`` with what was found of its texts."""
    if found.count() <= BROADCAST_TEXTS:
        return base.join(F.broadcast(found), KEY, "left")
    salt = base.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    every = found.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salt.join(every, [*KEY, "_salt"], "left").drop("_salt")


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    span: int = 13,
    gram: int = 6,
    share: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row per input row: id, n_words, n_hit, n_items, items_sha256, contaminated, and the key of its text.

    A word inside any occurrence of an item's run is hit. ``contaminated``: some word is, and at least one in
    ``share``. A null or empty text has no words and is clean; an item without words is ignored; a null item id counts
    as an empty one; rows with the same item id are one item. Repeated rows get a row each; long texts are searched whole. Without items nothing
    is hit; without rows the result is empty. Other columns play no part.
    """
    listed = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), words(F.coalesce(F.col(item_text_col), F.lit(""))).alias("w"))
    listed = materialize(listed.where(F.size("w") > 0), "items")
    sizes = sorted(r["n"] for r in listed.select(F.least(F.size("w"), F.lit(span)).alias("n")).distinct().collect())
    prepared = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    if sizes:
        parts = [listed.where(F.least(F.size("w"), F.lit(span)) == n).select("item", F.explode(_anchors(F.col("w"), n, gram, None)).alias("x")).select("item", "x.*") for n in sizes]
        own = parts[0]
        for p in parts[1:]:
            own = own.unionByName(p)
        # items that have the same words around an anchor share it
        own = own.groupBy("span", "fp", "before", "after").agg(F.collect_set("item").alias("items")).withColumn("context", F.monotonically_increasing_id())
        own = materialize(own, "item-anchors")
        count = {r["span"]: r["n"] for r in own.groupBy("span").agg(F.count_distinct("fp").alias("n")).collect()}
        wanted = {n: _filter(own.where(F.col("span") == n), count[n]) for n in sizes}
        found = lambda w: F.concat(*(_anchors(w, n, gram, wanted[n]) for n in sizes))
    else:
        found = lambda w: F.array().cast(_ANCHORS)
    both = let(words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), found(w).alias("anchors")))
    prepared = materialize(prepared.select("id", *text_key(F.col("text")), both.alias("x")).select("id", *KEY, "x.n_words", "x.anchors"), "anchors")
    base = prepared.select("id", *KEY, "n_words")
    zero = F.lit(0).cast("long")
    if not sizes:
        out = base.withColumns({"n_hit": zero, "n_items": zero, "items_sha256": F.sha2(F.lit(""), 256)})
    else:
        # texts are told apart first: copies bring the same anchors
        here = prepared.where(F.size("anchors") > 0).groupBy(*KEY).agg(F.first("anchors").alias("anchors")).select(*KEY, F.explode("anchors").alias("x")).select(*KEY, "x.*")
        theirs = own.select("span", "fp", F.col("before").alias("_before"), F.col("after").alias("_after"), "context")
        met = here.join(theirs, ["span", "fp"]).withColumns({"left": _agreeing(F.col("before"), F.col("_before")), "right": _agreeing(F.col("after"), F.col("_after"))})
        same = (F.col("right") >= F.least(F.lit(gram), F.col("span"))) & (F.col("left") + F.col("right") >= F.col("span"))
        hits = materialize(met.where(same).select(*KEY, (F.col("at") - F.col("left")).cast("long").alias("start"), (F.col("at") + F.col("right")).cast("long").alias("end"), "context"), "hits")
        merged = F.aggregate(
            F.array_sort("s"),
            F.struct(zero.alias("end"), zero.alias("n")),
            lambda a, x: F.struct(F.greatest(a["end"], x["end"]).alias("end"), (a["n"] + F.greatest(zero, x["end"] - F.greatest(a["end"], x["start"]))).alias("n")),
            lambda a: a["n"],
        )
        spans = hits.select(*KEY, "start", "end").distinct().groupBy(*KEY).agg(F.collect_list(F.struct("start", "end")).alias("s")).select(*KEY, merged.alias("n_hit"))
        of_items = hits.select(*KEY, "context").distinct().join(own.select("context", F.explode("items").alias("item")), "context").select(*KEY, "item").distinct().groupBy(*KEY)
        of_items = of_items.agg(F.count(F.lit(1)).alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list("item")), ","), 256).alias("items_sha256"))
        out = _of_rows(base, materialize(spans.join(of_items, KEY), "contaminated-texts"))
        out = out.withColumns({"n_hit": F.coalesce("n_hit", zero), "n_items": F.coalesce("n_items", zero), "items_sha256": F.coalesce("items_sha256", F.sha2(F.lit(""), 256))})
    bad = (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))
    return out.select(F.col("id").alias(id_col), "n_words", "n_hit", "n_items", "items_sha256", bad.alias("contaminated"), *KEY)
