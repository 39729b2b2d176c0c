"""The corpus pipeline: five operators in a row over documents, each stage's rows written and read again.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Stages tolerate null ids, null and empty texts, repeated rows and empty tables as their operators define.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridx.llm import minhash_dedup, mixing, packing, quality_rules, suffix_dedup
from gridx.llm.common import broadcast_within, checkpoint_folder, cut, remove_folder

#: Percent of common shingles from which the stage links documents; op2 has a threshold of its own.
SIMILAR = 80
ROW = "_row_place"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.keep_clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of smallest id.

    Near duplicates are linked at a similarity of SIMILAR percent. Rows that repeat an id with the same text are one
    document, rows that repeat it with different texts are documents of their own. Rows with a null id are in no
    group and stay.
    """
    if docs.groupBy("doc_id").count().where("doc_id is not null and count > 1").limit(1).count():
        whole = docs.where("doc_id is null").unionByName(docs.where("doc_id is not null").dropDuplicates(["doc_id", "text"]))
        # places in the order of ids, cut so that they stay
        numbered = cut(whole.orderBy("doc_id", "text").withColumn(ROW, F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())))
        return _without_copies(numbered, ROW).drop(ROW)
    return _without_copies(docs, "doc_id")


def _without_copies(docs: DataFrame, key: str) -> DataFrame:
    """The rows whose key, unique unless null, is the smallest of its group of near duplicates."""
    found = minhash_dedup.near_duplicates(docs.select(F.col(key).alias("doc_id"), "text"), percent=SIMILAR)
    dropped = cut(found.where("doc_id != component_id").select(F.col("doc_id").cast(docs.schema[key].dataType).alias(key)).distinct())
    n = dropped.count()
    return docs.join(broadcast_within(dropped, n), key, "left_anti") if n else docs


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document has; n_chars follows the text."""
    names = docs.columns
    found = suffix_dedup.remove_repeats(docs, with_text=True, carry=tuple(names))
    text = F.when(F.col(f"carried_{names.index('text')}").isNotNull(), F.col("kept_text"))
    columns = {"text": text.alias("text")}
    if "n_chars" in names:
        old = F.col(f"carried_{names.index('n_chars')}")
        columns["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(old).alias("n_chars")
    return found.select(*[columns.get(c, F.col(f"carried_{i}").alias(c)) for i, c in enumerate(names)])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, once for each pass that takes them."""
    return mixing.mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality),
    ("near-duplicate removal", near_dedup),
    ("repeated-passage removal", suffix_dedup_stage),
    ("source mixing", mix),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between two stages is Parquet in the shared checkpoint folder."""
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            remove_folder(spark, f"{folder}/{k - 1}")  # nothing reads it any more
    return docs


#: SQL can express neither the similarity components nor the tokenizer.
ORACLE_SQL = None
