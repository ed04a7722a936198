"""A corpus pipeline of the training-data operators: documents in, packed sequences out.

Each stage takes and returns the columns of documents, the last one packed pieces; further columns, whatever their names, go.
Rows with a null doc_id are kept as documents of their own, without being learned from; null and empty texts are texts without words;
an empty table gives an empty table.  The stages' docstrings say what that means for their decisions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexnet.llm import common, decontaminate, entry, packing, quality, simhash, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field over lines calls bad (a score under 0.5) go; exactly 0.5 stays.

    Labels of a third of the ids are held out, as in the query.  Null, empty and blank texts are scored as one line without words;
    repeated rows go or stay together; without labels of both kinds all have one score.
    """
    docs = docs.select(COLUMNS)
    field = quality.fit(docs, common.table(spark, sf_dir, "labels"), common.fold(F.col("doc_id"), 3) != 1)
    return quality.predict(docs, field, *COLUMNS).where("predicted = 1").select(COLUMNS)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose nearest labelled examples call them toxic (a score of 0.5 or more) go.

    Texts without a word that an example has are scored by the examples without words; repeated rows go or stay together.
    """
    docs = docs.select(COLUMNS)
    index = toxicity.fit(docs, common.table(spark, sf_dir, "labels"), common.fold(F.col("doc_id"), 5) != 0)
    return toxicity.predict(docs, index, *COLUMNS).where("predicted = 0").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: shingles of five words, similarity 0.8 or more.

    It is the one with the smallest id, once; of texts with that id, the one with the smallest hash.  Texts without words are copies of each
    other.  Rows with a null doc_id stay.
    """
    return simhash.first_of_each(docs.select(COLUMNS), size=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go.

    Null and wordless texts have none; rows with a null doc_id are judged like any other; repeated rows go or stay together.
    """
    return decontaminate.clean(docs.select(COLUMNS), common.table(spark, sf_dir, "benchmark"), remove="documents")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents as pieces of sequences of 2048 tokens.

    A null or empty text is its end token alone; a null doc_id stays null; repeated rows are packed as often as they come; longer documents are
    cut; pieces of equal length are taken in the order of id, piece and start.
    """
    return packing.pack_documents(docs, entry.tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("toxicity", toxicity_filter),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", best_fit_packing),
]

#: SQL can't express the trained stages and the packing; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again, and deleted after the next."""
    docs, written = common.table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.materialize(docs, f"stage{k}")
            if written is not None:
                common.drop(written)
            written = docs
    return docs
