"""From raw documents to token ids: five stages, each a dealt operator on all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.llm.decontaminate import drop_contaminated
from slotwise.llm.language import keep_recognised
from slotwise.llm.line_runs import drop_repeats
from slotwise.llm.near_copies import one_of_each
from slotwise.llm.queries import PIECES
from slotwise.llm.shelf import Shelf
from slotwise.llm.texts import read
from slotwise.llm.unigram import encode


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; null texts and texts without a letter go."""
    return keep_recognised(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs are cut out of the texts, and n_chars follows; documents left without a word go."""
    return drop_repeats(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: shingles of five words, similarity of 0.8 or more."""
    return one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is benchmark passages go; all others stay unchanged."""
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the texts, and whether they decode to the same text."""
    return encode(docs, PIECES)


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("tokens", tokens),
]

#: The language model, the banding and the search have no counterpart in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    shelf = Shelf(spark)
    docs, before = read(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = shelf.put(stage(spark, docs, sf_dir))
        if before is not None:
            shelf.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
