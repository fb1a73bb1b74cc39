"""Text, PDF and directory sources, and the JSON sink."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.sources.pdf import pdf_text

SUFFIXES = ("pdf", "txt", "docx")
#: From a file's bytes to its text.
Extractor = Callable[[bytes], str]


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole files: path and text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def as_plain_text(data: bytes) -> str:
    return data.decode("utf-8", "replace")


def read_directory(spark: SparkSession, path: str, pdf: Extractor | None = pdf_text) -> tuple[DataFrame, DataFrame]:
    """The files of a directory, not of those below it, whose suffix, in lower case, is pdf, txt or docx: path and text; and those left
    out, with a reason (Spark itself passes over files of no bytes). pdf: takes the text out of a PDF; None leaves PDF files out. docx isn't
    plain text, and is left out, and so is a file whose text can't be taken out.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(SUFFIXES) + "}").load(path)
    kind = F.regexp_extract("path", r"\.(\w+)$", 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, suffix, data in zip(*(c.to_pylist() for c in b.columns)):
                text = reason = None
                if suffix == "docx" or suffix == "pdf" and pdf is None:
                    reason = f"no extractor for {suffix}"
                elif not data:
                    reason = "empty"
                else:
                    try:
                        text = (pdf if suffix == "pdf" else as_plain_text)(data)
                    except Exception as e:
                        reason = f"extraction failed: {e}"
                if text is not None and text.startswith("ERROR:"):
                    text, reason = None, "error"
                rows.append((name, text, reason))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)] if rows else [pa.array([], pa.string())] * 3, ["path", "text", "reason"])

    found = files.select("path", kind.alias("suffix"), "content").mapInArrow(run, "path string, text string, reason string")
    return found.where("reason is null").drop("reason"), found.where("reason is not null").drop("text")


def probe(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit(1).alias("test"))


def as_json(df: DataFrame, alias: str = "json") -> DataFrame:
    """A JSON object for each row; nulls stay."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(alias))


def write_json(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", "false").json(path)
