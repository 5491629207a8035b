"""The corpus pipeline: five stages from ``documents`` to balanced shards.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and is written as
Parquet and read again for the next.  Columns besides those of the table's contract pass through, whatever
their names.  An empty table passes every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanveil.llm import decontaminate, jaccard_join, mixing, quality, sharding
from spanveil.llm.util import cut_lineage, only_ids, read_table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte-level classifier does not reject (probability of label 1 at least one half).  Null and empty
    texts are scored like any other; equal texts share their fate; an empty table stays empty."""
    return quality.keep_documents(docs, quality.fit(docs, read_table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a Jaccard similarity of 0.8 or more, that of the smallest id;
    of rows that repeat an id and a set of shingles one stays.  Texts without words and rows with a null id all stay."""
    return jaccard_join.one_of_each(docs, words=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window that copies a benchmark item.  An id goes with all its rows; null ids and texts stay."""
    found = decontaminate.contaminated(docs, read_table(spark, sf_dir, "benchmark"))
    return only_ids(docs, cut_lineage(found.select("doc_id"), "contaminated"), "doc_id", "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of the sources takes it, perhaps never.  A null source is one of its own; null texts have
    no words and are taken in whole epochs and in a partial one that reaches them; rows that agree in id, source and size are taken alike."""
    return mixing.repeated(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and place in it; null texts count as empty, ties fall by id and place in the input.  Input
    columns named like an added one (size, text_crc32, law, shard, slot, grown_shard) give way."""
    return sharding.shard_by_bytes(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: a convolutional network and hash fingerprints are not SQL; tests compare with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
