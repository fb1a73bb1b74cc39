"""The corpus pipeline: stages over whole documents, each one's rows written and read again by the next.

All but the last return the columns of documents (doc_id, text, lang, source, n_chars), whatever other columns come in; the last returns
packed pieces. A stage's table is removed once the next one's is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import decontaminate, language, lines, near_dups
from loomgraph.llm.common import discard, table, written
from loomgraph.llm.packing import pack_sequences
from loomgraph.llm.tokens import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _restored(df: DataFrame, **changed) -> DataFrame:
    """The columns of documents from the struct row, but for those changed."""
    return df.select(*(changed.get(c, F.col(f"row.{c}")).alias(c) for c in COLUMNS))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any letter go; a missing language is filled in, unless there was no language to learn."""
    model = language.fit(docs)
    found = language.identify(docs, model, carry=True).where("has_letter")
    return _restored(found, lang=F.coalesce("row.lang", "lang_pred")) if model.languages else _restored(found)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; every document stays."""
    return _restored(lines.dedup_lines(docs, carry=True), text=F.col("text"), n_chars=F.length("text").cast("long"))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, that with the smallest id."""
    return near_dups.keep_one(docs).select(*COLUMNS)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    found = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"), carry=True)
    return _restored(found.where(F.size("spans") == 0))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_sequences(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language", identify_language),
    ("lines", dedup_lines),
    ("near_duplicates", dedup_documents),
    ("benchmark", remove_benchmark),
    ("packing", packing),
]

#: Language mixtures, weighted sketches and tokenization are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
            discard(before)
    return docs
