"""A training-corpus pipeline of five stages over ``documents``.

toxicity (rejected documents go), line dedup (later repeated runs go from the texts), SimHash near-dedup (one document of each
group stays), mixing (documents repeat by fitted rates; none is lost), SentencePiece encoding. Every stage but the last returns
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import mixing, piece_automaton, simhash, toxicity, winnow
from tessella.llm.common import scratch, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: After the toxicity stage; what little is left of that domain isn't aimed at.
TARGETS = {"clean": 0.9, "low": 0.1}


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.toxicity_scores(docs, model).where("predicted = 0").select(*COLUMNS)


def delete_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return winnow.delete_repeated_lines(docs).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one_of_each(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat_rows(docs, table(spark, sf_dir, "labels"), TARGETS).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_automaton.piece_codes(docs, ids=True)


STAGES = [("toxicity", reject_toxic), ("line_dedup", delete_lines), ("simhash_near_dedup", drop_near_copies), ("source_mixing", mix_sources), ("sentencepiece", encode)]
#: No stage can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for i, (name, stage) in enumerate(STAGES):
        path = scratch(spark, f"stage{i}-{name}") + "/t"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
