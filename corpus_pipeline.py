"""A corpus from documents: known languages, one of each near-copy, no test items, mixed, in shards.

Each stage reads what the one before it wrote, as Parquet, and works on all of
it.  All but the last return the columns of documents.  Extra columns go along;
an empty table gives an empty one at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm.common import cut
from quern.llm.decontaminate import decontaminated
from quern.llm.jaccard_join import keep_one
from quern.llm.language_id import identified
from quern.llm.mixing import mixed_documents
from quern.llm.sharding import sharded


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts too), alike in several languages, or in none that was learned, go; texts in two languages and repeated rows stay."""
    return identified(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that 5-word shingles of Jaccard similarity 0.75 or more link, the one with the least doc_id stays; so does each without words. Of rows equal in doc_id and text one stays."""
    return keep_one(docs)


def no_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a copy of a benchmark item go; null and empty texts, and all if there are no items, stay."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights 1, 2, 3 and again, as many words as came in, none over three times its size; a document stands as often as it is taken, one without words never. Each row counts for itself, also if ids repeat."""
    return mixed_documents(docs)


def in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With shard and slot: 16 shards, each with every source in its share, null being a source like others; every row has a place of its own."""
    return sharded(docs, 16)


STAGES = [
    ("language ID", known_language),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", no_test_items),
    ("mixing sources to target weights", mixed),
    ("sharding", in_shards),
]

#: The language model and the alignments have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
