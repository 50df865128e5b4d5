"""The corpus pipeline: stages over the documents, each written as Parquet and read again by the next.

Every stage but the last returns the columns of documents. A document goes if its language can't be told, if it is a near copy
of one that stays, if nothing of it is left without passages that other documents repeat, or if it holds a benchmark item.
The last stage gives the token ids of what is left, and the text decoded from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoplate.llm import bpe, decontaminate, langid, minhash, suffix_dedup
from chronoplate.llm.common import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Scores below are no language at all; clean prose of a few words scores above.
LEAST_SCORE = 0.2
#: Ids of documents that may be broadcast (16 MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def _keyed(docs: DataFrame) -> DataFrame:
    """Documents with `key`, which is never null and tells texts of one id apart: ids may be null, and sources may use the same ids. Keys sort by id, null last."""
    return docs.withColumn("key", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")))


def _without(docs: DataFrame, gone: DataFrame, on: list[str]) -> DataFrame:
    gone = written(gone.distinct().select(*(F.col(c).alias(f"gone_{c}") for c in on)), "gone")
    same = [docs[c].eqNullSafe(gone[f"gone_{c}"]) for c in on]
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, same, "left_anti")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters or whose language scores below LEAST_SCORE; fills a missing language."""
    judged = langid.with_language(docs.select(*COLUMNS))
    passed = judged.filter((F.col("language.pred") != langid.UNKNOWN) & (F.col("language.score") >= LEAST_SCORE))
    return passed.withColumn("lang", F.coalesce("lang", "language.pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the smallest key. Rows of the same id and text count as one document."""
    keyed = _keyed(docs)
    found = written(minhash.near_duplicates(keyed, key="key", width=5, percent=80), "near")
    left = _without(keyed, found.filter("not kept").select("key"), ["key"])
    if found.groupBy("key").count().filter("count > 1").isEmpty():
        return left.select(*COLUMNS)
    # Rows of one id and text may differ in the other columns: the least of them stays, nulls first.
    return left.groupBy("key").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts strings of 200 bytes that start twice or more; a character that loses bytes goes whole. A text that is cut to nothing goes."""
    cut = suffix_dedup.remove_repeats(docs, carry=("lang", "source", "n_chars"), as_text=True)
    whole = cut.select("doc_id", F.col("kept").alias("text"), "lang", "source", "n_chars", "n_removed")
    left = whole.filter((F.col("n_removed") == 0) | (F.col("text") != ""))
    return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    marked = docs.withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
    return _without(marked, found.filter("contaminated").select("doc_id", "th"), ["doc_id", "th"]).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = bpe.encode_and_decode(docs)
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        "ids",
        F.decode("decoded", "UTF-8").alias("text"),
        F.sha2("packed", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("byte_bpe", tokenize),
]

#: No SQL: language models, suffix arrays over bytes and tokenizers have no form in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
