"""A corpus pipeline of five stages, each calling one operator of ``lodestar.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all rows that the
stage before it kept. All but the last return the columns of ``documents``.

1. language_id: rows predicted ``und`` go, and so do rows predicted, with a score of
   ``REJECT_SCORE`` or more, to be in another language than they are labelled with.
2. near_dedup: texts whose SimHash fingerprints over five-word shingles differ in 2 of 64 bits
   or fewer, which takes a similarity of far over 0.8, are linked; of each class the row with
   the smallest doc_id stays (of rows that share it, one); rows without a doc_id stay.
3. decontamination: rows with a twentieth of their words or more in benchmark windows go.
4. secret_scan: secrets are replaced by a mask; no row goes.
5. packing: all rows are tokenised and packed into sequences.

Rows with a null text are predicted ``und`` and leave in the first stage. Extra columns of
``docs`` are carried along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import decontamination, langid, packing, secrets, simhash
from lodestar.llm.shared import settle, small, table

TOKENIZER = "word_bpe_49k.json"
REJECT_SCORE = 0.65
#: Words a shingle of near_dedup.
SHINGLE = 5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    filters = langid.train(docs.where(~langid.held_out()))
    row = F.struct(*docs.columns).alias("row")
    judged = langid.predict(docs.select(row, F.col("text").cast("string").alias("text")), filters)
    other = (F.col("lang_pred") != F.col("row.lang")) & (F.col("score") >= REJECT_SCORE)
    return judged.where((F.col("lang_pred") != "und") & ~F.coalesce(other, F.lit(False))).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key, doc = F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.col("doc_id")
    found = simhash.near_duplicates(docs.select(key.alias("same"), "text"), SHINGLE, "same")
    linked = found.select("same", F.col("component_id").alias("root")).distinct()
    # Of each class the least of (doc_id, key) stays, once.
    rows = docs.where("doc_id is not null").select(doc.alias("id"), key.alias("key")).groupBy("id", "key").agg(F.count("*").alias("n"))
    # Settled, so that very many copies of a text are a plain join, which Spark can split.
    classed = settle(rows.join(linked, rows["key"] == linked["same"]).select("root", "id", "key", "n"), "classed")
    best = classed.groupBy("root").agg(F.min(F.struct("id", "key")).alias("best"), F.sum("n").alias("of")).where("of > 1")
    best = settle(best, "best")
    judged = settle(classed.join(best.select("root", "best"), "root").withColumn("stays", F.struct("id", "key") == F.col("best")), "judged")
    judged = judged.where("not stays or n > 1").select("id", "key", "stays")
    # The row is one struct while it is joined, so no column of it can have the name of another.
    held = docs.select(F.struct(*docs.columns).alias("row"), doc.alias("id"), key.alias("key"))
    going = small(judged.select("id", "key").distinct())
    staying = held.join(going, ["id", "key"], "left_anti").select("row.*")
    # Of repeated rows that stay, all left with those that go; one comes back.
    again = small(judged.where("stays").select("id", "key").distinct())
    chosen = held.join(again, ["id", "key"], "left_semi")
    chosen = chosen.groupBy("id", "key").agg(F.min_by("row", F.coalesce("row.text", F.lit(""))).alias("row"))
    return staying.union(chosen.select("row.*"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key = F.concat_ws("-", F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))
    keyed = docs.select(key.alias("key"), F.col("text").cast("string").alias("text"))
    found = decontamination.contamination(keyed, table(spark, sf_dir, "benchmark"), id_col="key")
    bad = settle(decontamination.verdicts(found).where("contaminated").select("key").distinct(), "contaminated")
    held = docs.select(F.struct(*docs.columns).alias("row"), key.alias("key"))
    return held.join(bad, "key", "left_anti").select("row.*")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secrets.redact(docs, secrets.train(secrets.labelled_findings(spark)))
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("secret_scan", secret_scan),
    ("packing", pack),
]

#: Language filters, fingerprints, the forest and the tokenizer are beyond SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
