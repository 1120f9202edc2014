"""A training-data pipeline in five stages over `documents`. Each stage is written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoflux.llm.common import Scratch, read
from genoflux.llm.decontaminate import contaminated_words
from genoflux.llm.language_id import fit as fit_languages
from genoflux.llm.language_id import predictions, remainder
from genoflux.llm.ngram_join import linked_rows
from genoflux.llm.secret_scan import masked
from genoflux.llm.sentencepiece_codec import encode

#: A text is rejected when no language reaches this share of its probability.
LEAST_SCORE = 0.3
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null and empty texts too) or without a likely language; a null lang is filled with
    the one predicted. Learns from rows that the language query learns from."""
    net = fit_languages(docs.where(remainder() != 2))
    kept = predictions(docs, net).where(F.col("lang_pred") != "und").where(F.col("score") >= LEAST_SCORE)
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of linked texts: that of the least doc_id (a null one comes last), of these the one whose
    columns hash lowest. Rows without words are linked with nothing and all stay. Rows are told apart by doc_id and their
    columns' hash, so texts that share a doc_id stand or fall each on its own."""
    docs, scratch = docs.select(*COLUMNS), Scratch(spark)
    row = F.xxhash64("text", "lang", "source", "n_chars")
    linked = scratch.write(linked_rows(docs, 5, "0.8", row).where("root is not null").select("doc_id", "row", "root"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), "row")
    # written, so that the join below reads two plain shuffles and a large group's rows can be split
    best = scratch.write(linked.groupBy("root").agg(F.min(order).alias("best"), F.count("*").alias("n")).where("n > 1").select("root", "best"))
    first = F.col("doc_id").eqNullSafe(F.col("best.id")) & (F.col("row") == F.col("best.row"))
    grouped = scratch.write(linked.join(best, "root").select(F.col("doc_id").alias("id"), "row", first.alias("first")))
    same = lambda keys: F.col("doc_id").cast("long").eqNullSafe(keys["id"]) & (row == keys["row"])
    dropped = grouped.where("not first").select("id", "row").distinct().hint("merge")  # grows with the input: never broadcast
    kept = docs.join(dropped, same(dropped), "left_anti")
    again = scratch.write(grouped.where("first").groupBy("id", "row").count().where("count > 1").select("id", "row"))
    if again.isEmpty():  # then the texts are moved no further
        return kept
    once = kept.join(again, same(again), "left_semi").dropDuplicates()
    return kept.join(again, same(again), "left_anti").unionByName(once)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of a benchmark item occurs."""
    carry = tuple(c for c in COLUMNS if c != "text")
    return contaminated_words(docs, read(spark, sf_dir, "benchmark"), 10, carry=carry).where("n_hit = 0").select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every secret in the text and counts its characters anew; no document is dropped."""
    return masked(docs.select(*COLUMNS)).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document and its round trip: doc_id, ids, n_tokens, decoded."""
    out = encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), "decoded")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("sentencepiece", sentencepiece),
]

#: The network, the forest and the encoder have no SQL form; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark), read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return scratch.write(STAGES[-1][1](spark, docs, sf_dir))
