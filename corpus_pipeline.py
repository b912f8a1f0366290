"""The training-corpus pipeline: five operators in order over ``documents``.

quality classifier -> one of each near-duplicate group -> benchmark
decontamination -> personal data -> mix to source weights.  A stage takes
(spark, docs, sf_dir) and returns the documents it keeps, changed where that
is its work; all but the last return the columns of ``documents``.  The last
adds ``mix_size``, ``mix_source_size``, ``mix_target``, ``mix_copies`` and
``mix_taken`` (a column of that name in ``documents`` gives way); documents
that the mix does not take are gone.

Empty tables, nulls and repeated rows follow the operators' docstrings: no
stage fails on them.  A classifier cannot be written in SQL, so there is no
``ORACLE_SQL``; the tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlens.llm import cotrain, decontaminate, mixing, ngram_join, pii
from demandlens.llm.common import cut, table

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject."""
    return cotrain.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the least id) of every group of linked documents."""
    return ngram_join.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by the name of its kind."""
    return pii.redact(docs, pii.find_pii(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their copies."""
    mixed = mixing.pareto_mix(docs).filter("copies > 0")
    new = {f"mix_{c}": F.col(c) for c in ("size", "source_size", "target", "copies", "taken")}
    return mixed.select(*[F.col("doc")[c].alias(c) for c in docs.columns if c not in new], *[v.alias(c) for c, v in new.items()])


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mix", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, f"stage-{name}")
    return docs
