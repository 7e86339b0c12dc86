"""Corpus pipeline over the documents table.

Five stages, each over all that its predecessor kept: drop documents without a
recognisable language, keep one document of each near-duplicate group, drop
documents that hold benchmark passages, blank out secrets, and mix the sources
to their target weights. Every stage but the last returns the columns of
documents; the last adds `copies`, how often the mix repeats a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm.common import fold, materialise, table
from tokenloom.llm.decontaminate import decontaminate
from tokenloom.llm.langid import UND, identify
from tokenloom.llm.mixing import mix
from tokenloom.llm.secrets import redact
from tokenloom.llm.simhash import keep_one

#: Below this score no language stands out: with four languages, chance alone gives 0.25.
MIN_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language; those without a letter, or of no clear language, go.

    Learned from docs itself (lang of the rows whose crc32(doc_id) mod 4 is not 2; a
    null lang or id teaches nothing). A null or empty text goes; a text of any length
    is read whole; repeated rows have one fate; without any labelled row every document
    goes; an empty table stays empty. Further columns pass through, whatever their names.
    """
    found, name = identify(docs, F.coalesce(fold(F.col("doc_id"), 4) != 2, F.lit(False)))
    return found.where((F.col(f"{name}.lang") != UND) & (F.col(f"{name}.score") >= MIN_SCORE)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that with the smallest id.

    A null id, and a text without words (null and empty too), is near to nothing and
    stays. Of rows that repeat an id and a text one stays; an id with different texts
    keeps one row of each, if it heads a group. Texts of any length are compared
    whole; an empty table stays empty. Further columns pass through, whatever their names.
    """
    return keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark table occurs.

    A null or empty text has no windows and stays; a text of any length is scanned
    whole; repeated rows have one fate, whatever else is in them; an empty table stays
    empty, and an empty benchmark drops nothing. Further columns pass through, whatever
    their names.
    """
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in their text replaced; n_chars follows the text.

    A null or empty text stays as it is (n_chars null or 0); overlapping secrets are
    one replacement; a text of any length is scanned whole; repeated rows all stay; an
    empty table stays empty. Further columns pass through, whatever their names; without
    a column n_chars none is added.
    """
    clean = redact(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, and how often (a last column, copies, or copies_ where that name is taken).

    A null source is a source of its own; a null or empty text weighs nothing; rows
    equal in id, source and size have the same number of copies; texts of any length
    are counted whole; an empty table stays empty.
    """
    return mix(docs)


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark),
    ("secret_scans", secret_scan),
    ("mixing", mixing),
]

#: The stages learn models and compare sketches, which SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage, each stage written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
