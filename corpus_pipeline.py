"""From raw documents to training sequences: five stages, each an operator over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.llm import jaccard, language, mixing, packing, toxicity
from gaugeflow.llm.common import store, table

#: A language is none if its probability is hardly above chance: less than this many times an even share.
ABOVE_CHANCE = 1.25


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told better than by chance; null texts and texts without a letter go.

    The model learns from the documents that name a language. Where none does,
    nothing can be told and only texts without a letter go.
    """
    model = language.train(docs.select("doc_id", "text", "lang"))
    found = language.identify(docs, model)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return found.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") * len(model.languages) >= min(ABOVE_CHANCE, len(model.languages)))).select("row.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, does not call toxic.

    Null and empty texts are scored as texts without a window; without labels of
    both classes nothing is rejected. Whole texts are read; equal texts share
    their fate, repeated rows too. An empty table stays empty.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.train(docs.select("doc_id", "text"), labels)
    return toxicity.assess(docs, model).where("predicted = 0").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a likeness of 0.8.

    The least id of a group stays, null ids last; of rows equal in id and text
    one stays. Null and blank texts link with nothing and all stay. Whole texts
    are compared. An empty table stays empty.
    """
    return jaccard.keep_heads(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it.

    A null source is one of its own; null and empty texts have no words and stay
    by a draw; rows that agree in everything are drawn one by one. An empty
    table stays empty.
    """
    return mixing.apply_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences of 4096 ids.

    Null and empty texts are a closing id alone; repeated rows are packed like
    any other; a very long text is cut into pieces. An empty table has no pieces.
    """
    return packing.pack(docs, "word_bpe_49k.json").withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("language", identify_language),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Trained models and draws decide; the stages are tested against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written before the next reads it."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
