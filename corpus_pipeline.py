"""Corpus pipeline: the stages that turn ``documents`` into encoded training text.

Each stage takes (spark, docs, folder of the tables) and returns a DataFrame; it is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of ``documents``, with ``n_chars`` brought up to date where texts change.
SQL has no toxicity model, no SimHash and no piece model, so there is no SQL for the rows of ``run``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, line_dedup, near_dedup, pieces, toxicity
from corpusloom.llm.texts import read_table, small_batches
from corpusloom.session import materialize


def _same_columns(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, the number of characters counted again."""
    return changed.select(*(F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the toxicity grades do not reject; the model is trained on the labels."""
    model = toxicity.train(docs, read_table(spark, folder, "labels"))
    return toxicity.grade(docs, model).where("NOT toxic").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without the lines that a document of smaller id holds; an emptied document stays, with an empty text."""
    small_batches(spark)
    return _same_columns(line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs)), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity of 0.8 or more)."""
    small_batches(spark)
    return near_dedup.keep_one(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Texts without the passages that a benchmark item holds; documents that were nothing else go."""
    return _same_columns(decontaminate.remove_overlaps(docs, read_table(spark, folder, "benchmark")), docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Piece ids (little-endian 32-bit) of each text, and whether they decode to it."""
    small_batches(spark)
    coded = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", "lang", "source", "n_pieces", "n_chunks", "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", cut_benchmark),
    ("SentencePiece", encode_pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole of ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
