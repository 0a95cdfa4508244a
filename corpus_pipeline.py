"""A training corpus from ``documents``: toxic rows out, known languages, one of each near copy, mixed, packed.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that is written and
read again as the next one's docs. ``run`` applies them to ``documents`` of a folder. SQL cannot express trained
classifiers, so ``ORACLE_SQL`` is None; the tests hold ``run`` against a brute-force version.

Cases: null and empty texts, and texts without a letter, end at the language stage; very long texts are judged and packed
whole; repeated rows are copies, of which one stays; documents of equal standing go by doc_id; an empty table gives no rows
at every stage; extra columns are kept by all stages but the last, whatever they are named.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lendmill.llm.jaccard_join import one_of_each
from lendmill.llm.language_id import fit_language_id, known_language_rows
from lendmill.llm.mixing import mix
from lendmill.llm.packing import pack
from lendmill.llm.registry import byte_vocabulary
from lendmill.llm.tasks import shared_folder, table
from lendmill.llm.toxicity import clean_rows, fit_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, trained on ``documents`` and ``labels``, does not take for toxic."""
    return clean_rows(docs, fit_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in a learned language; texts without a letter go."""
    return known_language_rows(docs, fit_language_id(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked documents."""
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows sampled to tempered shares of source, language and topic."""
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens, with their ids."""
    return pack(docs, **byte_vocabulary(), window=1024, end_id=0, with_ids=True)


STAGES = [("toxicity", toxicity), ("language_id", language_id), ("near_copies", near_copies), ("mixing", mixing), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the stages make of ``documents``; each stage's rows are written to the shared folder."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
