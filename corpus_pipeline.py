"""The training-data pipeline: documents in, clean, unique and encoded documents out.

Each stage gets the rows its predecessor kept and returns the columns of documents (the last adds the encoding). Stages
are written to the shared folder and read again, so an executor that is lost costs at most one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatstream.llm import decontaminate, minhash, pieces, pii, weak_quality
from chatstream.llm.common import read, stored
from chatstream.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of low quality and toxic ones go."""
    scorer = weak_quality.train(docs, read(spark, sf_dir, "labels"))
    marks = weak_quality.scored(docs.withColumns({f"_{c}": F.col(c) for c in ("low", "toxic", "kept") if c in docs.columns}), scorer)
    return marks.filter("kept").drop("low", "toxic", "kept").withColumnsRenamed({f"_{c}": c for c in ("low", "toxic", "kept")}).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, and one row of each doc_id; rows without a doc_id stay."""
    groups = stored(minhash.near_duplicates(docs, words=5), "groups")
    gone = groups.filter("not kept").select("doc_id").distinct()
    repeated = stored(groups.filter("kept and doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    left = docs.join(gone, "doc_id", "left_anti")
    if not repeated.isEmpty():
        left = left.join(repeated, "doc_id", "left_anti").unionByName(left.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return left.select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the name of its kind; all documents stay."""
    trees = pii.fit(stored(pii.with_candidates(docs.select("doc_id", "text")).drop("text"), "candidates"))
    return pii.redact(docs, trees)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their ids and the digests of ids and decoded text."""
    return pieces.encode_documents(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("personal data", redacted),
    ("sentencepiece", encoded),
]

#: The trained stages cannot be told in SQL; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{k}")
    return docs
