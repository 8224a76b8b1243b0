"""A training corpus from `documents`: quality, near-duplicates, benchmark leaks, mixture, token files.

Each stage is (name, function of (spark, docs, sf_dir)); its result is written as Parquet and read as the next one's
docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import cut
from millrace.llm.decontaminate import without_leaks
from millrace.llm.jaccard_join import jaccard_join
from millrace.llm.mixing import mixed_documents
from millrace.llm.quality_classifier import quality_scores
from millrace.llm.queries import tokenizer_path
from millrace.llm.token_binary import token_binary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. A null or empty text is judged by the model's bias; repeated rows fare alike."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    scored = quality_scores(docs, labels.select("doc_id", F.col("quality").alias("label")), threshold=0.3, keep=True)
    return scored.where("predicted = 1").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each class stays, once; rows without a doc_id stay, copies of them once.

    Documents without words (null, empty) are classes of their own and stay.
    """
    spare = jaccard_join(docs, shingle=5, threshold=0.8).where("class_id <> doc_id").select("doc_id").distinct()
    rows = docs.select("doc_id", F.xxhash64("text").alias("copy"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.join(spare, "doc_id", "left_anti").dropDuplicates(["doc_id", "copy"]).select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go; those without words stay."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document once for each time that the mix takes it, the last of a source cut to its budget; those
    without words are never taken."""
    return mixed_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token files, read back; rows without a doc_id have no place in them."""
    return token_binary(docs, tokenizer_path(), end_id=0)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("token_files", token_files),
]

#: Classifier, sketches and tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
