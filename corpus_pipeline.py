"""Documents to training sequences: five stages, each over all that its predecessor kept.

All stages but the last return the columns of their ``docs``, whatever others there are and whatever their
names; values of columns that a stage doesn't change pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.llm import jaccard_join, mixing, packing, pii, toxicity
from braidwork.llm.common import stored, table

TOXIC = 0.5
#: No SQL can express the tagger, the pseudonyms or the tokenizer.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxic spans score ``TOXIC`` or more go.

    Null and empty texts score 0 and stay; repeated rows go or stay together; an empty table stays empty.
    """
    labels = table(spark, sf_dir, "labels").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    return toxicity.without_toxic(docs, toxicity.fit(docs, labels), TOXIC)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked documents, the one with the smallest id stays.

    Null and empty texts, and texts without words, are linked with nothing and stay; of repeated rows one
    stays; rows without an id come last in their class; an empty table stays empty.
    """
    return jaccard_join.one_per_class(docs)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Validated numbers, dates and addresses become pseudonyms; lengths are counted anew where known.

    Null and empty texts stay; repeated rows change alike; an empty table stays empty. A session without a
    key runs with the example key, as the tables are synthetic.
    """
    out = pii.pseudonyms(docs, pii.key_of(spark, pii.EXAMPLE_KEY)).select(*docs.columns)
    n = F.when(F.col("n_chars").isNotNull(), F.length("text").cast("bigint"))
    return out.withColumn("n_chars", F.coalesce(n, F.col("n_chars")).cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that all sources have equal shares.

    A null source is a source of its own; texts are not looked at; an empty table stays empty.
    """
    return mixing.mix(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences.

    Null and empty texts have the final id alone; repeated rows are packed each; an empty table gives no row.
    """
    import public_tokenizers

    return packing.pack(docs.select("doc_id", "source", "text"), packing.word_bpe(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("pii", hide_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
