"""Corpus pipeline: five stages over documents, each written as Parquet and read by the next.

All stages take null texts as empty (language_id drops them), keep rows with null or repeated doc_id apart by
their texts, treat repeated rows alike, return no rows for an empty table, and keep extra columns,
whatever their names.  Ties go to the smaller doc_id, then to the smaller hash of the text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from rillflow.llm import decontam, langid, packing, probminhash, suffix_dedup, text as T
from rillflow.llm.queries import held_out, tokenizer_path

#: A document whose language is surer than this stays; texts without a letter have score 0.  With two
#: families of two languages no other text has less than 0.25.  Of held-out rows of known languages
#: (sf0.1) 0.1 % are under 0.568; text in other scripts and letter junk had 0.36 to 0.52.
LEAST_SCORE = 0.55


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those of no sure language."""
    T.prepare(spark)
    model = langid.train(docs, ~held_out())
    # the columns travel in one struct, so that none clashes with those of the operator
    rest = F.struct(*(c for c in docs.columns if c != "text")).alias("__row")
    found = langid.identify(docs.select(rest, "text", F.col("text").alias("__whole")), model, keep=["__row", "__whole"])
    sure = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return sure.select(*(F.col("__whole").alias("text") if c == "text" else F.col("__row")[c].alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: that with the smallest doc_id."""
    T.prepare(spark)
    return probminhash.first_of_class(docs).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts what repeats an earlier passage of 100 bytes or more out of the texts; a text that was nothing else goes."""
    T.prepare(spark)
    return suffix_dedup.deduplicated(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark; each row is judged by its own text."""
    T.prepare(spark)
    return decontam.clean(docs, T.table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens."""
    T.prepare(spark)
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("minhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("benchmark_decontamination", decontaminated),
    ("packing", packed),
]

#: SQL can express neither the trained model nor the sketches nor the tokenizer.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, with what each returns written under the shared checkpoint folder."""
    docs = T.table(spark, sf_dir, "documents")
    T.checkpointed(spark.range(1))  # makes sure that there is a checkpoint folder
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
