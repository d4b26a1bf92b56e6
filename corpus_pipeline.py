"""Training-data pipeline over ``documents``.

Five stages in order; each works on all that its predecessor kept and returns
the columns of ``documents`` (``n_chars`` follows the text), the last one adds
the token ids:

1. quality classifier: texts that importance resampling rejects go;
2. n-gram Jaccard join: one text of each group of near duplicates stays
   (5 words, similarity 0.8);
3. benchmark decontamination: benchmark passages are cut out;
4. secret scans: secrets are replaced by marks;
5. byte-level BPE: texts are encoded.

The defined cases of each stage are those of its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inventa.llm import bpe, decontaminate, jaccard, quality, secrets
from inventa.llm.storage import stored
from inventa.session import table


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps."""
    return quality.resample(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram Jaccard join."""
    return jaccard.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their benchmark passages."""
    return _counted(decontaminate.remove_spans(docs, table(spark, sf_dir, "benchmark")))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced by marks."""
    return _counted(secrets.redact(docs))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ``ids`` and ``n_tokens``."""
    return bpe.encode(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secret_stage),
    ("byte-level BPE", encoding_stage),
]

#: the quality stage learns hashed models, which SQL does not express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored before the next begins."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "pipeline")
    return docs
