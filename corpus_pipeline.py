"""A training corpus from raw documents, in five stages.

Every stage reads what the one before has written. The first four return the
columns of documents; the last returns the pieces of packed sequences.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import kneser_ney, langid, mixing, order_minhash, packing
from lodestone.llm.textbuf import text_slices
from lodestone.session import load, materialize

#: Least share of a text's letters under one language: at sf0.1 it keeps every document labelled quality 1 and rejects random letters.
MIN_LANGUAGE_SCORE = 0.5
#: Tokens of each domain after mixing, as multiples of what comes in.
MULTIPLES = {"q0t0": 0.5, "q0t1": 0.25, "q1t0": 1.02, "q1t1": 0.5}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose perplexity is above the threshold of their language.

    Null and empty texts go; repeated rows are judged alike; texts of any length are scored whole; an empty table gives no
    rows; without trusted labels only empty texts go. ``docs`` is a table: it is read more than once.
    """
    return kneser_ney.keep_good(docs, kneser_ney.fit_quality(docs, load(spark, sf_dir, "labels")))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters or without a language that leads clearly: words that fit no language count against all.

    Null texts go; equal texts are judged alike; texts of any length are labelled whole; without a learned language, and from
    an empty table, no rows come.
    """
    model = langid.fit(langid.training_rows(docs))

    def run(batches):
        for s in text_slices(batches, lower=True):
            ok, _, score = langid.decide(s, model)
            yield s.batch.slice(s.lo, s.n).filter(pa.array(ok & (score >= MIN_LANGUAGE_SCORE)))

    return docs.mapInArrow(run, docs.schema)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class, the one with the smallest doc_id.

    Rows with equal doc_id and text are one document; rows without a doc_id stay.
    """
    classes = order_minhash.near_duplicates(docs)
    gone = materialize(classes.where(F.col("doc_id") != F.col("class_id")).select("doc_id").distinct(), "pipeline-gone")
    few = gone.count() <= order_minhash.BROADCAST_IDS
    kept = docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*docs.columns)
    again = kept.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.isEmpty():
        return kept
    repeated = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, "doc_id", "left_anti").unionByName(repeated.select(*docs.columns)).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents by rates that meet the target tokens of the domains.

    A null text has no tokens and rate 1; equal rows have equal rates, and copies by a hash of doc_id and text; without labels
    and from an empty table every row stays.
    """
    model = mixing.fit(docs, load(spark, sf_dir, "labels"))
    members = materialize(mixing.posteriors(docs, model), "pipeline-posteriors")
    return mixing.resample(docs, model, mixing.solve(members, model.domains, multiples=MULTIPLES))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of 1024 tokens: rows as often as they occur, a null text as its end id; no rows from an empty table."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("language ID", language),
    ("MinHash near-dedup", near_duplicates),
    ("mixing sources to target weights", mix),
    ("packing", pack),
]

#: No stage but the last has SQL for its learned decisions; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-stage-{k}")
    return docs
