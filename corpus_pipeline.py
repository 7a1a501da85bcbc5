"""From raw documents to token ids, in stages that are each written and read again.

Every stage takes all rows that its predecessor kept. Null and empty texts go with the quality rules, which ask for
fifty words; what a stage says of nulls, ties, repeated rows and long texts is in its module. Rows that repeat a
``doc_id`` count as one document among near copies. Further columns come through all stages but the last, whatever their
names. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoflow.llm import decontaminate, ngram_join, quality_rules, secrets, sentencepiece
from geoflow.llm.common import table
from geoflow.session import cut, owned, remove

#: SQL cannot express the last stage; ``run`` is tested against a plain form of all stages.
ORACLE_SQL = None


#: Rows of a batch between Spark and its Python workers. Texts of the default of 10,000 rows take 40 MB in each of them.
BATCH_ROWS = 1_000


def _small_batches(spark: SparkSession) -> None:
    """Stages that hold texts in Python workers get them in small batches from here on; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, measured against references of ``docs``."""
    _small_batches(spark)
    return quality_rules.keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group: five-word shingles, similarity 0.8 or more."""
    _small_batches(spark)
    return ngram_join.keep_one(docs, ngram_join.Similar(width=5, percent=80))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked."""
    _small_batches(spark)
    return secrets.mask_documents(docs)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, piece ids and their number."""
    _small_batches(spark)
    out = sentencepiece.encode_documents(docs)
    return out.select("doc_id", "pieces", F.size("pieces").cast("long").alias("n_pieces"))


STAGES = [
    ("quality_rules", quality),
    ("ngram_join", near_copies),
    ("decontamination", decontaminated),
    ("secrets", without_secrets),
    ("sentencepiece", tokenized),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows as a kept table; what the stages kept before it is deleted."""
    return _run(spark, table(spark, sf_dir, "documents"), sf_dir)


@owned
def _run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    before = None
    for number, (_, stage) in enumerate(STAGES):
        if number == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        docs = cut(stage(spark, docs, sf_dir))
        if before is not None:
            remove(before)
        before = docs
    return docs
