"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import sentiment, tokens
from corpusloom.plans.registry import query, with_blocks
from corpusloom.session import scratch_path
from corpusloom.sources import catalog, files
from corpusloom.sources.lexicons import lexicon


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.explode_lines(catalog.documents(spark, folder).select("doc_id", "text"))


@query("scan_text_lines", with_blocks("SELECT doc_id, line_no, text FROM lines", "lines"))
def scan_text_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Text files written from the documents, a numbered line each, and read back as lines."""
    path = scratch_path(spark, "lines-text")
    _lines(spark, folder).select(F.concat_ws("\t", "doc_id", "line_no", "text").alias("value")).write.text(path)
    parts = F.split("text", "\t", 3)
    return files.read_lines(spark, path).select(parts[0].cast("long").alias("doc_id"), parts[1].cast("int").alias("line_no"), parts[2].alias("text"))


@query(
    "scan_csv",
    with_blocks(
        "SELECT doc_id, line_no, CASE WHEN text IN ('', 'NA') THEN NULL ELSE text END AS text FROM lines", "lines"
    ),
)
def scan_csv(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "lines-csv")
    files.write_csv(_lines(spark, folder), path)
    return files.read_csv(spark, path, "doc_id BIGINT, line_no INT, text STRING")


@query("scan_csv2", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def scan_csv2(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "customer-csv2")
    files.write_csv2(catalog.table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal"), path)
    return files.read_csv2(spark, path, "c_custkey BIGINT, c_name STRING, c_acctbal DOUBLE")


@query(
    "sink_csv",
    with_blocks(
        "SELECT p.party, p.doc_id AS document, round(s.prop_positive, 8) AS prop_positive "
        "FROM posit s JOIN party p ON s.doc_id = p.doc_id",
        "posit", "party",
    ),
)
def sink_csv(spark: SparkSession, folder: str) -> DataFrame:
    scored = sentiment.positivity(catalog.labelled(spark, folder), lexicon(spark, "sentiments"), ["party", "doc_id"])
    path = scratch_path(spark, "positivity-csv")
    files.write_csv(scored.select("party", F.col("doc_id").alias("document"), "prop_positive"), path)
    back = files.read_csv(spark, path, "party STRING, document BIGINT, prop_positive DOUBLE")
    return back.withColumn("prop_positive", F.round("prop_positive", 8))


@query(
    "sink_object",
    with_blocks("SELECT source, word, CAST(count(*) AS BIGINT) AS n FROM tok GROUP BY source, word", "tok"),
)
def sink_object(spark: SparkSession, folder: str) -> DataFrame:
    docs = catalog.documents(spark, folder).select("source", "text")
    path = scratch_path(spark, "counts-table")
    files.save_object(tokens.term_counts(tokens.explode_words(docs), ["source"]), path)
    return files.load_object(spark, path)


@query(
    "lexicon_source",
    with_blocks(
        "SELECT l.word, l.sentiment, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM sentiments l "
        "LEFT JOIN (SELECT word, count(*) AS n FROM tok GROUP BY word) c ON l.word = c.word",
        "tok", "sentiments",
    ),
)
def lexicon_source(spark: SparkSession, folder: str) -> DataFrame:
    docs = catalog.documents(spark, folder).select("text")
    listed = lexicon(spark, "sentiments")
    hits = tokens.explode_words(docs).join(listed.select("word").distinct(), "word", "left_semi")
    counts = tokens.term_counts(hits, [])
    return listed.join(counts, "word", "left").select("word", "sentiment", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "literal_table",
    "SELECT CAST(k AS INTEGER) AS K, CAST(count(*) AS BIGINT) AS n_docs FROM (SELECT len(string_split(text, chr(10))) AS n "
    "FROM documents) d JOIN range(2, 21, 2) g(k) ON g.k <= d.n GROUP BY k",
)
def literal_table(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with at least K lines, for the literal grid K = 2, 4, ..., 20."""
    from corpusloom.functions.text import lines

    n_lines = F.size(lines("text"))
    docs = catalog.documents(spark, folder).select(n_lines.alias("n")).filter(F.col("n") >= 2)
    grid = F.explode(F.sequence(F.lit(2), F.least(F.lit(20), F.col("n")), F.lit(2)))
    return docs.select(grid.alias("K")).groupBy("K").agg(F.count("*").alias("n_docs"))
