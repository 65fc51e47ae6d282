"""A corpus from raw documents: quality, near duplicates, decontamination, personal data, mixture."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.llm import decontam, mixing, pii, quality_knn, simhash_neardup
from terravane.llm.common import crc32_of, cut, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold go. Labels that are held out for evaluation are not learned from."""
    labels = table(spark, sf_dir, "labels").where(crc32_of(F.col("doc_id")) % 5 != 0)
    model = quality_knn.fit(table(spark, sf_dir, "documents"), labels, "quality")
    return docs.where(quality_knn.quality(docs, model) >= quality_knn.THRESHOLD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents similar in their five-word shingles by 0.8 or more, the one with the smallest id stays.

    SimHash fingerprints linked by their Golay keys come first and are checked exactly; what lies further apart is
    found by exact keys.
    """
    return simhash_neardup.keep_first(docs, words=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return pii.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents placed in blocks that hold the sources in their weights; each is placed at least once."""
    return mixing.mixture(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixture", mixture),
]

#: Neither the classifier nor the fingerprints can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
