"""The pipeline end to end on small tables."""

import gc
import weakref

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import piece_automaton, winnow
from tessella.llm.common import scratch, table


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents").select(*corpus_pipeline.COLUMNS)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "source_mixing", "sentencepiece"]
    at = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, sf)
        path = scratch(spark, name) + "/t"
        out.write.parquet(path)
        back = spark.read.parquet(path)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert back.columns == corpus_pipeline.COLUMNS
        if name in ("toxicity", "simhash_near_dedup"):
            assert back.join(at, "doc_id", "left_anti").count() == 0 and 0 < back.count() <= at.count()
        if name == "line_dedup":
            assert back.count() == at.count() and back.agg(F.sum("n_chars")).first()[0] < at.agg(F.sum("n_chars")).first()[0]
        if name == "source_mixing":
            assert back.select("doc_id").distinct().count() == at.select("doc_id").distinct().count()
        at = back
    assert at.where("not lossless").count() == 0 and at.where("size(ids) <> n_tokens").count() == 0


def test_empty_documents(spark):
    sf = "/root/testdata/sf0.001"
    at = table(spark, sf, "documents").select(*corpus_pipeline.COLUMNS).where("false")
    for _, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, sf)
        assert at.count() == 0
        if "lossless" not in at.columns:
            at = spark.createDataFrame([], at.schema)


class InThisProcess:
    """Stands for a DataFrame whose tasks run here, as one worker process runs those of all stages."""

    def __init__(self, batch):
        self.batch = batch

    def select(self, *names):
        return InThisProcess(self.batch.select(names))

    def mapInArrow(self, run, schema):
        return list(run(iter([self.batch])))


def test_line_dedup_frees_what_the_encoder_remembers():
    texts = ["one two three\nfour five", "six seven\none two three"]
    docs = InThisProcess(pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2], pa.int64()), "text": pa.array(texts)}))
    codes = piece_automaton.piece_codes(docs, ids=True)
    kept = weakref.ref(piece_automaton.model(piece_automaton.model_path()))
    assert kept().words
    (rows,) = winnow.selected_rows(docs, 2)
    gc.collect()
    assert kept() is None
    assert rows.column("_doc").to_pylist() == [1, 1, 2, 2]
    assert piece_automaton.piece_codes(docs, ids=True) == codes
    kept = weakref.ref(piece_automaton.model(piece_automaton.model_path()))
    winnow.extended(InThisProcess(rows), 2)
    gc.collect()
    assert kept() is None
