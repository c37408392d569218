"""From raw documents to packed training sequences, in five stages over stored tables.

All stages but the last return the columns of their documents, whatever these are called; columns that a stage does not
read come along. Null texts are empty, a null id is an id that no other row has, rows that repeat or share an id are
judged and kept alike, texts are taken whole however long they are, and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlcorpus.llm.common import table
from sqlcorpus.llm.minhash import near_duplicates
from sqlcorpus.llm.pack import pack_documents
from sqlcorpus.llm.quality import keep_quality
from sqlcorpus.llm.queries import LEARNED, tokenizer_path
from sqlcorpus.llm.suffix import remove_repeats
from sqlcorpus.llm.toxicity import keep_clean, train_toxicity
from sqlcorpus.session import Workspace


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that all quality rules accept; null and empty texts have no words and are not."""
    return keep_quality(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the toxicity threshold of their language; the classifier learns from the labels of ``docs``.

    A language without labels, or none, has the threshold 0.5. Without labels of both kinds all documents stay.
    """
    return keep_clean(docs, train_toxicity(docs, table(spark, sf_dir, "labels"), keep=LEARNED))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates.

    Rows without an id stay; rows that share the id of a document that goes, go.
    """
    gone = near_duplicates(docs, Workspace(spark)).where("NOT kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the passages that one with a smaller id holds; ``n_chars`` counts what is left.

    A character stays if one of its bytes does. A null text becomes an empty one; a null id is larger than all others.
    """
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    kept = remove_repeats(docs, characters=True, carry=others)
    text = F.decode("kept", "UTF-8")
    found = {"doc_id": F.col("doc_id"), "text": text, **{c: F.col(f"rest.`{c}`") for c in others}}
    if "n_chars" in found:
        found["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return kept.select(*(found[c].alias(c) for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 2048 tokens; an empty text is a piece of one token."""
    return pack_documents(docs, Workspace(spark), tokenizer_path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality), ("toxicity", toxicity), ("near dedup", near_dedup),
          ("suffix-array dedup", suffix_dedup), ("packing", packing)]

#: SQL can express neither the classifier nor the tokenizer; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is stored and read again as the next stage's documents."""
    work = Workspace(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = work.table(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
