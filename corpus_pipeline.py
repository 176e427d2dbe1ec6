"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents, whatever further columns those have and whatever their names, and n_chars, where there
is one, as the length of the text that the stage returns.

In every stage: a null text has no words and no secrets, and stays null where its row stays (it fails
the quality rules); a null doc_id is judged like any other, by its text; an empty table gives an empty
one; texts of any length are taken whole. What ties and repeated rows give is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.llm import packing, quality, secrets, simhash, substrings
from pagelake.llm.queries import tokenizer
from pagelake.session import prepare, staged


def _sized(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns, with n_chars of the text as it is now; a null text leaves it."""
    length = F.coalesce(F.length("text").cast("long"), F.col("n_chars")) if "n_chars" in columns else None
    return docs.select(*(length.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed rules reject go, among them null texts and those under 50 words.

    Repeated rows are judged alike and stay or go together; a posterior of just one half stays."""
    return quality.kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one of smallest doc_id (null last).

    Of repeated rows one stays. Two texts of one doc_id stay both, unless they are near copies.
    Texts without words are near copies of each other."""
    return simhash.representatives(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages of 35 words and more that stand elsewhere too go, all occurrences alike.

    Texts without any stay as they are, with their white space. A repeated row counts as another
    document, so both lose what they share."""
    return _sized(substrings.without_repeats(docs), docs.columns)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are masked, overlapping ones by one mark. Repeated rows are masked alike."""
    return _sized(secrets.redacted(docs), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in training sequences.

    A null text is an empty document, its end id alone. Each row is a document, also when repeated.
    Documents of one length are packed in the order in which they come."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("secret scans", secret_scans),
    ("packing", packed),
]

#: Tokenizers and expectation-maximisation are beyond SQL; the tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"stage{k}")
    return docs
