"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and its result is written as Parquet
and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import mixing, packing, quality, queries, simhash
from weftgraph.llm.common import read, small_batches
from weftgraph.plans.stage import materialize


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier does not reject.

    A null text is empty; empty, very long and repeated texts are judged like
    any other, equal texts alike, so all of them stay or none. Null ids stay
    null and match no label. Without labels all documents stay. An empty table
    stays empty. All columns are kept as they are.
    """
    small_batches(spark)
    model = quality.train(docs, queries.graded(spark, sf_dir))
    return quality.kept(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id.

    Of several with that id, or if all ids are null, the first by text; of
    rows equal in id and text any one. Null, empty and wordless texts are one
    group, as their fingerprint is zero. Very long texts are read whole. An
    empty table stays empty. All columns are kept as they are.
    """
    small_batches(spark)
    return simhash.representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the last of a source may be cut.

    A null source is a source of its own. Documents without words (null,
    empty) have nothing to be taken. Rows equal in id, source and text share
    what is taken of them, the first ones first. A very long text may be cut,
    like any other. An empty table stays empty. Columns are kept as they are,
    but ``n_chars`` follows a cut text.
    """
    plan = materialize(mixing.mix(docs), "mix-plan")
    return mixing.take(docs, plan)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences.

    A null text is empty, and an empty one is its end id alone. Null ids stay
    null; repeated rows are packed each. Longer texts than a sequence are cut
    into pieces, of which only the first may be short. An empty table gives no
    rows. Only ids and texts are read, whatever other columns there are.
    """
    small_batches(spark)
    return packing.pack_documents(docs, packing.PackParams(queries.TOKENIZER))


STAGES = [
    ("quality classifier", keep_good),
    ("simhash near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: A fitted classifier and bin packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{i + 1}")
    return docs
