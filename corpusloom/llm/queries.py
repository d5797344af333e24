"""The registered queries of the operators, each with the SQL that must give the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import cover_tree, decontaminate, line_dedup, merkle, pieces, pii, recurrent_lm, secrets, simhash, token_counts, toxicity, vector_search, warc
from corpusloom.llm.texts import read_table
from corpusloom.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(key: str, sql: str | None = None):
    def register(fn):
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = sql
        return fn

    return register


_WORDS = f"regexp_extract_all({_LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP1_SQL = f"""
WITH dw AS MATERIALIZED (SELECT doc_id, coalesce({_WORDS}, []::VARCHAR[]) AS w FROM documents),
bw AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
win AS MATERIALIZED (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM bw WHERE len(w) > 0)),
grams AS MATERIALIZED (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS g
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM dw, (SELECT DISTINCT size FROM win) WHERE len(w) >= size)),
occ AS MATERIALIZED (SELECT doc_id, i, grams.size AS size, item_id FROM grams JOIN win ON grams.size = win.size AND grams.g = win.g),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM occ) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(sha, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated FROM dw d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op1_benchmark_decontamination", OP1_SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    found = decontaminate.find_overlaps(docs, read_table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op5_simhash_near_dedup")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


OP8_SQL = f"""
WITH lines AS MATERIALIZED (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS MATERIALIZED (SELECT *, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM lines),
rep AS (SELECT key, min(doc_id) AS holder FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
marked AS (SELECT k.*, coalesce(doc_id > holder, false) AS drop FROM keyed k LEFT JOIN rep ON k.key = rep.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE drop) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT drop), '')) AS kept_sha256 FROM marked GROUP BY doc_id
"""


@query("op8_line_dedup", OP8_SQL)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    kept = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op9_toxicity")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.train(docs, read_table(spark, folder, "labels"))
    return toxicity.grade(docs, model).select("doc_id", "p_toxic", "severity", "toxic")


@query("op10_sentencepiece")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    coded = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id", "n_pieces", "n_chunks", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


OP4_SQL = """
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, r.vec_id AS vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(r.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v r ON q.vec_id <> r.vec_id AND len(q.e) = len(r.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


@query("op4_exact_top_k", OP4_SQL)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    rows = vector_search.whole_numbers(read_table(spark, folder, "embeddings").select("vec_id", "embedding"), "embedding")
    return vector_search.top_products(rows, rows.where("vec_id % 50 = 0"))


@query("op6_token_counts")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


_DIGEST_SQL = "concat(" + ", ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST(concat('0x', substr(h, {1 + 5 * k}, 5)) AS BIGINT) >> {s}) & 31), 1)"
    for k in range(8) for s in (15, 10, 5, 0)) + ")"
OP2_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS MATERIALIZED (SELECT page_id, payload_bytes, {_DIGEST_SQL} AS payload_digest FROM p),
k AS (SELECT payload_digest, max(page_id) AS keeper FROM d GROUP BY payload_digest)
SELECT page_id, payload_bytes, d.payload_digest, CASE WHEN page_id < keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < keeper THEN keeper END AS refers_to FROM d JOIN k ON d.payload_digest = k.payload_digest
"""


@query("op2_warc", OP2_SQL)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write(read_table(spark, folder, "pages"), path)
    return warc.page_facts(warc.captures(warc.read(spark, path), payload=False))


def _joined(spans):
    """kind:start:end of an array of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count(column: str, kind: str):
    return F.size(F.filter(column, lambda s: s["kind"] == kind)).cast("long")


@query("op3_secret_scan")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.find_secrets(read_table(spark, folder, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind"] != "novel")
    return found.select(
        "doc_id", *(_count("secrets", k).alias(f"n_{k}") for k in secrets.KINDS), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("secrets")).alias("spans"))


@query("op7_personal_data")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    found = pii.find_personal_data(docs, pii.train(docs)).withColumn("first", F.filter("pii", lambda s: s["base"]))
    return found.select(
        "doc_id", *(_count("first", k).alias(f"n_{k}") for k in pii.KINDS), F.sha2(_joined(F.col("first")), 256).alias("base_sha256"), _joined(F.col("pii")).alias("spans"))


_FIELDS = ", ".join(f"coalesce(concat(strlen(CAST({c} AS VARCHAR)), ':', {c}), '-')" for c in ("doc_id", "source", "lang", "n_chars", "{text}"))
_CRC_BYTE = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))"
_CRC = f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: {_CRC_BYTE}), 4294967295)"


def _tree_sql(name: str, leaves: str) -> str:
    """Nodes of all levels over (grp, idx, h), then each leaf's siblings as ``left|right`` from its level up."""
    return f"""
{name}n AS MATERIALIZED (WITH RECURSIVE nodes(grp, lev, idx, h, n) AS (SELECT grp, 0, idx, h, count(*) OVER (PARTITION BY grp) FROM {leaves}
  UNION ALL SELECT grp, lev + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 2) // 3 FROM nodes WHERE n > 1 GROUP BY grp, lev, idx // 3) SELECT * FROM nodes),
{name}s AS (SELECT a.grp, a.lev, a.idx, concat(coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (WHERE b.idx < a.idx), ''), '|',
  coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (WHERE b.idx > a.idx), '')) AS side
  FROM {name}n a JOIN {name}n b ON a.grp IS NOT DISTINCT FROM b.grp AND a.lev = b.lev AND a.idx // 3 = b.idx // 3 WHERE a.n > 1 GROUP BY a.grp, a.lev, a.idx),
{name}p AS MATERIALIZED (SELECT l.grp, l.idx, coalesce(list(s.side ORDER BY s.lev) FILTER (WHERE s.side IS NOT NULL), []) AS path FROM {leaves} l LEFT JOIN {name}s s
  ON l.grp IS NOT DISTINCT FROM s.grp AND l.idx // CAST(pow(3, s.lev) AS BIGINT) = s.idx GROUP BY l.grp, l.idx)"""


OP11_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, source AS grp, sha256(concat({_FIELDS.format(text="text")})) AS h,
  CASE WHEN {_CRC} % 2 = 0 THEN sha256(concat({_FIELDS.format(text="replace(text, chr(10), '')")})) END AS found FROM documents),
x AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, h) - 1 AS idx FROM d),
{_tree_sql("g", "x")},
y AS MATERIALIZED (SELECT 0 AS grp, grp AS name, h, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 AS idx FROM gn WHERE n = 1),
{_tree_sql("t", "y")},
w AS MATERIALIZED (SELECT x.doc_id, x.h AS leaf, coalesce(x.found, x.h) AS begun, y.h AS subroot, (SELECT h FROM tn WHERE n = 1) AS root, list_concat(gp.path, tp.path) AS path
  FROM x JOIN gp ON x.grp IS NOT DISTINCT FROM gp.grp AND x.idx = gp.idx JOIN y ON x.grp IS NOT DISTINCT FROM y.name JOIN tp ON y.idx = tp.idx),
f AS (SELECT *, list_reduce(list_prepend(begun, path), lambda a, s: sha256(concat(split_part(s, '|', 1), a, split_part(s, '|', 2)))) AS folded_root FROM w)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(path, ''), '|', '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM f
"""


@query("op11_merkle_manifest", OP11_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    chosen = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    later = merkle.row_digest([*columns[:-1], F.replace("text", F.lit("\n"), F.lit(""))])
    proven = merkle.manifest(docs, columns, "source", "doc_id", F.when(chosen & F.contains("text", F.lit("\n")), later))
    return proven.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


OP12_SQL = """
WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT q.vec_id AS anchor_id, r.vec_id, q.label = r.label AS same, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(r.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v r ON q.vec_id <> r.vec_id AND len(q.e) = len(r.e) WHERE q.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same) WHERE place <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
  row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score) WHERE rank <= 5
"""


@query("op12_hard_negatives", OP12_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    table = read_table(spark, folder, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = vector_search.whole_numbers(table.withColumn("label", label), "embedding")
    return cover_tree.hard_negatives(rows, F.col("vec_id") % 100 == 0)


@query("op13_recurrent_lm")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    return recurrent_lm.score_documents(docs, F.crc32(F.col("doc_id").cast("string")) % 5 == 1)
