"""Every operator on awkward rows, on empty tables and beside columns of clashing names."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import decontaminate, line_dedup, near_dedup, pieces, pii, queries, secrets, simhash, token_counts, toxicity
from tests.llm import brute

ROWS = brute.awkward()
PIECES, TOKENS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, brute.DOCS)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, " ".join(ROWS[5][1].split()[20:60])), (2, None), (3, ""), (None, "tion rest"), (4, "?!")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 7 == 0)) for i in range(25)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "decontaminate": lambda d, b, x: decontaminate.find_overlaps(d, b), "cut": lambda d, b, x: decontaminate.remove_overlaps(d, b),
    "lines": lambda d, b, x: line_dedup.apply_bitmaps(d, line_dedup.keep_bitmaps(d)), "simhash": lambda d, b, x: simhash.near_duplicates(d),
    "copies": lambda d, b, x: near_dedup.keep_one(d), "pieces": lambda d, b, x: pieces.encode(d, PIECES), "tokens": lambda d, b, x: token_counts.count_tokens(d, TOKENS),
    "toxicity": lambda d, b, x: toxicity.grade(d, toxicity.train(d, x)), "secrets": lambda d, b, x: secrets.find_secrets(d), "pii": lambda d, b, x: pii.find_personal_data(d, pii.train(d)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_rows_are_kept_beside_clashing_columns(docs, benchmark, labels, name):
    more = docs.withColumns({c: F.lit("own") for c in brute.CLASHING})
    plain = sorted(map(repr, OPERATORS[name](docs, benchmark, labels).collect()))
    crowded = OPERATORS[name](more, benchmark, labels)
    assert len(set(crowded.columns)) == len(crowded.columns)
    assert crowded.count() == len(plain)
    if name not in ("copies", "cut"):
        assert len(plain) == len(ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(docs, benchmark, labels, name):
    assert OPERATORS[name](docs.limit(0), benchmark, labels.limit(0)).collect() == []
    assert OPERATORS[name](docs.limit(0), benchmark.limit(0), labels).collect() == []


def test_stages_on_awkward_rows(spark, docs, benchmark, labels, tmp_path):
    for name, table in (("documents", docs), ("benchmark", benchmark), ("labels", labels)):
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, str(tmp_path))
        assert after.schema.simpleString() == docs.schema.simpleString(), name
        now = spark.createDataFrame(after.collect(), docs.schema)
    assert stage is corpus_pipeline.cut_benchmark
    assert corpus_pipeline.run(spark, str(tmp_path)).where("NOT round_trip").count() == 0


def test_queries_on_empty_tables(spark, docs, benchmark, labels, tmp_path):
    schemas = {"embeddings": "vec_id long, embedding array<float>, label int", "pages": "page_id long, url string, html string"}
    tables = {"documents": docs, "benchmark": benchmark, "labels": labels} | {n: spark.createDataFrame([], s) for n, s in schemas.items()}
    for name, table in tables.items():
        table.limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in queries.QUERIES.items():
        assert query(spark, str(tmp_path)).collect() == [], name
