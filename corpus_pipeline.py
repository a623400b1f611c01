"""From raw documents to packed sequences: quality, near duplicates, repeated passages, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nervemap.llm.decontamination import BROADCAST_TEXTS, KEY, decontaminate, text_key
from nervemap.llm.near_copies import near_copies
from nervemap.llm.packing import pack
from nervemap.llm.quality import fit, with_score
from nervemap.llm.queries import _table, _tokenizer
from nervemap.llm.substring_dedup import without_repeats
from nervemap.runtime import importable, materialize, own_columns, unused


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier gives a probability of 0.3 or more to be of quality 1.

    A null or empty text is scored like any other; repeated rows share their score; long texts are scored whole. An empty table, or
    one of which no row has a label, keeps all rows. Other columns stay, whatever they are called.
    """
    importable(spark)
    score, good = unused(docs, "score", "good")
    model = fit(docs.select("doc_id", "text"), _table(spark, sf_dir, "labels"), sample=20_000, folds=5, fold=0)
    return with_score(docs, model, 0.3, score_col=score, predicted_col=good).where(F.col(good) == 1).select(*own_columns(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (similarity 0.8 or more on five words) the row of smallest doc_id, once if it is repeated.

    Rows without a doc_id come last. Null and empty texts, and those without a word, are copies of one another. Of rows that share the smallest
    doc_id of a group the one with the smallest key of its text stays. Long texts count whole; an empty table gives an empty
    result. Other columns stay, whatever they are called.
    """
    importable(spark)
    key, kept = unused(docs, *KEY), unused(docs, "kept_id", *(f"kept{k}" for k in KEY))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *KEY)).alias("x")
    found = docs.select("doc_id", *text_key(F.col("text"))).groupBy(*KEY).agg(first).join(near_copies(docs, width=5, similarity=0.8), KEY)
    keep = found.groupBy("group").agg(F.min("x").alias("x")).select(*(F.col(f"x.{c}").alias(n) for c, n in zip(("doc_id", *KEY), kept, strict=True)))
    marked = docs.withColumns(dict(zip(key, text_key(F.col("text")), strict=True)))
    same = F.col("doc_id").eqNullSafe(F.col(kept[0]))
    for a, b in zip(key, kept[1:], strict=True):
        same &= F.col(a) == F.col(b)
    return marked.join(keep, same, "left_semi").dropDuplicates(["doc_id", *key]).select(*own_columns(docs))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the bytes that strings of 200 bytes cover which occur more than once; n_chars follows the text.

    A null text becomes empty; texts of under 200 bytes stay as they are; repeated rows repeat each other; long texts count whole. A character of
    which a part goes, goes. An empty table gives an empty result. Other columns stay, whatever they are called.
    """
    importable(spark)
    kept = without_repeats(docs, length=200)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*own_columns(docs))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text isn't contaminated.

    Null and empty texts have no words and stay; repeated rows stay or go together; long texts are searched whole. An empty table, or
    one of items, changes nothing. Other columns stay, whatever they are called.
    """
    importable(spark)
    found = decontaminate(docs, _table(spark, sf_dir, "benchmark"))
    key = unused(docs, *KEY)
    bad = materialize(found.where("contaminated").select(*KEY).distinct(), "contaminated").toDF(*key)
    if bad.count() <= BROADCAST_TEXTS:  # 24 bytes each
        bad = F.broadcast(bad)
    marked = docs.withColumns(dict(zip(key, text_key(F.col("text")), strict=True)))
    return marked.join(bad, key, "left_anti").select(*own_columns(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every text, with its place in a sequence of at most 4096 tokens.

    A null or empty text is a piece of its end alone; repeated rows are packed each; only longer texts than a sequence are cut. An empty
    table gives an empty result. Other columns are left out.
    """
    importable(spark)
    return pack(docs, _tokenizer(), capacity=4096, end_id=1)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("passages", passages),
    ("benchmark", benchmark),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = materialize(stage(spark, out, sf_dir), f"stage-{name}")
    return out


#: The network, the fingerprints and the tokeniser are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None
