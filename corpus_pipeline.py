"""A corpus made ready for training, in five stages.

Documents of poor quality go, then toxic ones, then all but one of each group of near duplicates;
personal data in the rest is masked, and what is left is packed along a space-filling curve. Each
stage takes and returns a table; all but the last keep the columns of ``documents``, whatever other
columns there are and whatever their names.

A null text counts as empty, in every stage: it is scored as such, is near only to other empty texts, has
nothing to mask, and is packed as its end mark. A row without an id is kept like any other; among near
documents it stays only if none has an id. Of near documents the one of least id stays, of equal rows one.
Texts of any length are taken whole. Empty tables give empty tables; without labels the quality stage keeps all, and toxicity goes by its seeds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vicinity.llm import packing, pii, quality, resemblance, toxicity
from vicinity.llm.common import cut, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine scores at its threshold or above."""
    return quality.keep_good(docs, quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighted lexicon scores below one half."""
    return toxicity.keep_clean(docs, toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a five-word Jaccard similarity of 0.8 or more, found through SimHash and BK-trees."""
    return resemblance.keep_one(docs)


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; ``n_chars`` is that of the text as it is now."""
    return pii.mask(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document and its place in a sequence."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", good_quality),
    ("toxicity", not_toxic),
    ("SimHash near-dedup", without_near_copies),
    ("PII", masked),
    ("packing", packed),
]

#: Fitted models and iterated components have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. The lineage is cut after each, as later ones read their input more than once."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
