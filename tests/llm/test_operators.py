"""Results against brute force, library answers and held-out labels."""

import gzip
import hashlib
import base64
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import components, decontaminate, line_dedup, near_dedup, pieces, pii, queries, secrets, simhash, token_counts, toxicity, vector_search, warc
from corpusloom.llm.fm_index import FMIndex
from corpusloom.llm.piece_model import SPACE, PieceModel
from corpusloom.llm.texts import read_table
from tests.compare import compare, connect
from tests.llm import brute

FOLDER = "/root/testdata/sf0.001"
PIECES, TOKENS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(brute.awkward(), brute.DOCS)


def table(spark, name):
    return read_table(spark, FOLDER, name)


@pytest.mark.parametrize("key", queries.SQL)
def test_query_equals_sql(spark, key):
    assert compare(spark, connect(FOLDER), key, queries.QUERIES[key], queries.SQL[key], FOLDER) == ""


# Benchmark decontamination.


@pytest.mark.parametrize("seed", range(6))
def test_index_finds_all_places(seed):
    rng = np.random.default_rng(seed)
    text = np.concatenate([rng.integers(0, 4, size=rng.integers(1, 400)), np.tile([1, 2, 1], 50), [0]])
    index = FMIndex(text, 3)
    for _ in range(40):
        size = int(rng.integers(1, 12))
        phrase = rng.integers(1, 4, size=size)
        low, high = index.search(phrase, np.array([size]), np.array([size]))
        rows = np.arange(low[0], max(low[0], high[0]))
        truth = [i for i in range(len(text) - size + 1) if (text[i : i + size] == phrase).all()]
        assert sorted(index.locate(rows).tolist()) == truth


@pytest.mark.parametrize("small", [False, True])
def test_overlaps(spark, docs, monkeypatch, small):
    if small:  # several blocks and shards
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 40)
        monkeypatch.setattr(decontaminate, "SHARD_BYTES", 300)
        monkeypatch.setattr(decontaminate, "LOCATE_ROWS", 7)
    long_ = brute.words(brute.awkward()[5][1])
    items = {1: " ".join(long_[20:60]), 2: None, 10: " - ".join(long_[55:65]).upper(), 3: " ".join(long_[5:8]), 4: "?!"}
    found = decontaminate.find_overlaps(docs, spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()
    for r in found:
        assert (r.n_words, r.n_hit, list(r.hit_items)) == brute.overlaps(r.text, items), r.doc_id
    assert sum(r.n_hit > 0 for r in found) >= 6


@pytest.mark.parametrize("block", [40, 4 << 20])
def test_repeated_item_ids_count_once(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    items = [("b", "one two three four five six seven"), ("b", "one two three four five six seven"), ("a", "red green blue white black grey pink"), ("a", "cold warm hot mild cool damp dry")]
    frame = spark.createDataFrame([(1, ". ".join(t for _, t in items))], "doc_id long, text string")
    found = decontaminate.find_overlaps(frame, spark.createDataFrame(items, "item_id string, text string"), window=5).collect()
    assert [(r.n_words, r.n_hit, list(r.hit_items)) for r in found] == [(28, 28, ["a", "b"])]


def test_cut_leaves_clean_rows_alone(spark, docs):
    long_ = brute.words(brute.awkward()[5][1])
    items = {1: " ".join(long_[20:60])}
    after = decontaminate.remove_overlaps(docs.where("doc_id IS NOT NULL"), spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()
    before = {(i, t) for i, t, *_ in brute.awkward()}
    for r in after:
        assert brute.overlaps(r.text, items)[1] == 0
        assert r.n_cut > 0 or (r.doc_id, r.text) in before
    whole = spark.createDataFrame([(1, "The " + items[1].replace("t", "T") + "!", None, None, 1)], brute.DOCS)
    left = decontaminate.remove_overlaps(whole, spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()
    assert [r.text for r in left] == ["The \n!"]


# WARC.


def test_archives(spark, tmp_path):
    tricky = "a" + warc.BETWEEN + "WARC-Type: response\r\n"
    rows = [(1, "http://h.org/a?b#c", "<p>é</p>"), (2, None, None), (3, "no address", ""), (4, "x\r\ny", tricky), (5, "https://h.org", "<p>é</p>"), (6, "u", "<p>é</p>"), (None, "v", "lone"), (7, "u", None), (7, "u", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write(pages, f"{tmp_path}/w")
    got = warc.captures(warc.read(spark, f"{tmp_path}/w"))
    assert got.where("request IS NULL OR metadata IS NULL").count() == 0
    assert [bytes(r.p).decode() for r in got.where("metadata.block LIKE 'page-id: 4%'").select(F.col("response.payload").alias("p")).collect()] == [tricky]
    facts = sorted(map(tuple, warc.page_facts(got).collect()), key=repr)
    keeper = {}
    for i, _, h in rows:
        keeper[h or ""] = max(keeper.get(h or "", -1), -1 if i is None else i)
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    again = lambda i, h: i is not None and i < keeper[h or ""]
    assert facts == sorted(((i, len((h or "").encode()), digest(h), "revisit" if again(i, h) else "response", keeper[h or ""] if again(i, h) else None) for i, _, h in rows), key=repr)


def test_foreign_archive(spark, tmp_path):
    """Records gzipped one by one, other header order, the response naming its request."""
    body = b"HTTP/1.0 200 OK\r\n\r\nbinary \xff\xfe\r\n\r\n"
    parts = [b"WARC/1.1\r\nContent-Length: 3\r\nWARC-Type: request\r\nwarc-record-id: <urn:uuid:q>\r\n\r\nGET\r\n\r\n",
             b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:r>\r\nWARC-Concurrent-To: <urn:uuid:q>\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"]
    (tmp_path / "f.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts))
    records = warc.read(spark, str(tmp_path))
    assert {(r.type, r.complete) for r in records.collect()} == {("request", True), ("response", True)}
    one = warc.captures(records).collect()
    assert [(r.request.block, bytes(r.response.payload)) for r in one] == [("GET", b"binary \xff\xfe\r\n\r\n")]


# Secrets and personal data.


def test_secret_spans(spark, docs):
    import re

    texts = ["password=abcdef secretoken: xyz123 api-key", "TOKEN = 'a1b2c3d4' apiKey:\"short\" api_key==12", "AKIA" + "Z" * 16 + " AKIAX " + "f" * 24 + " " + "a" * 23, "ſecret=abcdefg toKen=abcdefg",
             "the credential is q7Zp0xK2mN9vR4tB8wY1 here", "the credential is abcdefghijklmnopqrstuvwxyz0123456789 here", "plain q7Zp0xK2mN9vR4tB8wY1 text", None]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.secrets] for r in secrets.find_secrets(frame).collect()}
    assign = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for i, text in enumerate(texts):
        text = text or ""
        base = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        assert [s for s in got[i] if s[0] != "novel"] == [(secrets.KINDS[k], a, b) for a, k, b in sorted(base)]
    assert [k for k, *_ in got[4]] == ["novel"] and got[5] == [] and got[6] == []


def test_personal_data(spark):
    import re

    texts = ["a.b@c.de, x@y z@@q.org u@v.w.x@k.lm", "1.2.3.4.5.6.7.8 999.1.1.1 1.1.1 01.02.03.004", "4111 1111-1111 1111 4111 1111 1111 1112 0000000000000", "+49 (0)151 2345678 +1 +12345678 +1234567890123456",
             "call +49 151 2345678, later 0049 151 2345678", "mail jo.doe@example.com or jo.doe at example dot com", None, "1" * 5000 + ".1.1.1"] * 30
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.start, s.end, s.base) for s in r.pii] for r in pii.find_personal_data(frame, pii.train(frame)).collect()}
    digits = lambda x: re.sub("[^0-9]", "", x)
    for i, text in enumerate(texts):
        text = text or ""
        base = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        base += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(len(p) < 9 and int(p) <= 255 for p in m[0].split("."))]
        base += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
        base += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
        assert [s[:3] for s in got[i] if s[3]] == [(pii.KINDS[k], a, b) for k, a, b in sorted(base)], text[:60]
    assert [s[0] for s in got[4] if not s[3]] == ["phone"] and [s[0] for s in got[5] if not s[3]] == ["email"]
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def _kept_number(repeats):
    """A text whose first number is a base phone, with ``repeats`` of its digits in a form that no base pattern knows."""
    return "call +49 151 2345678 now. " + " ".join(f"Item {k}: write to 0049 151 2345678 again." for k in range(repeats))


@pytest.mark.parametrize("repeats", [1, 20, 500])
def test_every_repeat_is_labelled(repeats):
    field = pii.fit(pii.graph([_kept_number(1), "a +49 30 1234567 b", "code 12345678 end", "mail a.b@c.de or 4111 1111 1111 1111"] * 10)[0])
    g, _ = pii.graph([_kept_number(repeats), "code 12345678 end"])
    chance = pii.marginals(field, g)
    phone = 1 + pii.KINDS.index("phone")
    assert len(chance) == repeats + 2 and (chance[: repeats + 1, phone] >= pii.SURE).all() and chance[-1, 0] > 0.5


# Vector search.


@pytest.mark.parametrize("block, part", [(700, 500), (1 << 20, 500), (5_000, 1 << 20), (1 << 20, 1 << 20)])
def test_exact_top_k(spark, block, part):
    rng = np.random.default_rng(3)
    vectors = rng.integers(-300, 300, size=(160, 10)).tolist() + [[1] * 10] * 20 + [[2**40] * 10, [5, 6], [7, 8], None, [1, None], [2**62] * 10, [], [-(2**62)] * 10, []]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(3, vectors[3]), (None, vectors[4])]
    frame = spark.createDataFrame(rows, "vec_id long, v array<long>").repartition(5)
    got = {}
    for r in vector_search.top_products(frame, frame.where("vec_id % 9 = 0 OR vec_id > 175"), block_bytes=block, query_bytes=part).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    real = [(i, v) for i, v in rows if v is not None and None not in v and i is not None]
    for q, v in {i: v for i, v in real if i % 9 == 0 or i > 175}.items():
        near = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, x)))), i) for i, x in real if i != q and len(x) == len(v))[:5]
        assert sorted(got.get(q, [])) == [(k + 1, i, -s) for k, (s, i) in enumerate(near)]


def test_top_k_of_awkward_tables(spark):
    """Columns that clash with the operator's own, rows that all have one id, and tables without rows."""
    rows = spark.range(40).selectExpr("id AS vec_id", "array(id, 1L, 40 - id) AS v")
    crowded = rows.selectExpr("*", *(f"'own' AS {c}" for c in ("id", "block", "part", "tile", "query", "floor", "home", "query_id", "score", "rank")))
    plain = sorted(map(tuple, vector_search.top_products(rows, rows.where("vec_id < 3"), block_bytes=300).collect()))
    assert len(plain) == 15 and plain == sorted(map(tuple, vector_search.top_products(crowded, crowded.where("vec_id < 3"), block_bytes=300).collect()))
    same = rows.selectExpr("7L AS vec_id", "v")
    assert vector_search.top_products(same, same).isEmpty()
    found = vector_search.top_products(same, rows.where("vec_id = 2"), block_bytes=300).collect()
    assert sorted((r.rank, r.vec_id, r.score) for r in found) == [(k + 1, 7, s) for k, s in enumerate(sorted((2 * i + 1 + 38 * (40 - i) for i in range(40)), reverse=True)[:5])]
    for a, b in ((rows.limit(0), rows), (rows, rows.limit(0)), (rows.limit(0), rows.limit(0))):
        assert vector_search.top_products(a, b).isEmpty()


def test_bounds_drop_most_pairs(spark):
    """Counted on the given vectors, which are random: under half of the pairs get exact products, also with more blocks and their floor."""
    rows = queries.read_table(spark, "/root/testdata/sf0.1", "embeddings")
    found = vector_search.whole_numbers(rows.select("vec_id", "embedding"), "embedding").where("v IS NOT NULL").orderBy("vec_id").toPandas()
    ids, vectors = found["vec_id"].to_numpy(), np.stack(found["v"].to_numpy())
    asked = ids % 50 == 0
    first = vector_search.Block(ids[::2], vectors[::2])
    a, _, score = first.top(ids[asked], vectors[asked], 5)
    second = vector_search.Block(ids[1::2], vectors[1::2])
    second.top(ids[asked], vectors[asked], 5, np.array([score[a == q].min() for q in range(asked.sum())], dtype=float))
    assert first.verified + second.verified < 0.5 * asked.sum() * len(ids)
    assert second.verified < first.verified


@pytest.mark.parametrize("dimensions", [1, 2, 3, 7, 64, 100])
def test_no_bound_lies_below_the_product(dimensions):
    rng = np.random.default_rng(dimensions)
    q, x = (np.concatenate([rng.integers(-256, 256, size=(40, dimensions)), rng.integers(0, 2, size=(40, dimensions))]).astype(float) for _ in range(2))
    bound = last = None
    for level, (mine, own) in enumerate(zip(vector_search.resolutions(q, -1), vector_search.resolutions(x))):
        bound = mine @ own.T + (bound if level >= len(vector_search.levels(dimensions)) else 0)
        assert (bound >= q @ x.T - 1e-6).all()
        assert level <= len(vector_search.levels(dimensions)) or (bound <= last + 1e-6).all()
        last = bound


def test_only_finite_vectors_take_part(spark):
    frame = spark.createDataFrame([(1, [0.5, -0.001]), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, [None, 1.0]), (5, None)], "vec_id long, e array<float>")
    assert [r.v for r in vector_search.whole_numbers(frame, "e").orderBy("vec_id").collect()] == [[128, -1], None, None, None, None]


# SimHash.


def test_fingerprints_and_classes(spark, docs):
    got = simhash.near_duplicates(docs).collect()
    by_id = {}
    for i, text, *_ in brute.awkward():
        by_id.setdefault(i, set()).add(brute.fingerprint(text))
    assert {(r.doc_id, r.fp % 2**64) for r in got} == {(i, f) for i, fs in by_id.items() for f in fs}
    root = brute.classes(sorted({r.fp % 2**64 for r in got}), lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for r in got:
        if r.doc_id is not None:
            c = root[r.fp % 2**64]
            least[c] = min(least.get(c, r.doc_id), r.doc_id)
    assert all(r.component_id == least.get(root[r.fp % 2**64]) for r in got)


@pytest.mark.parametrize("cell_rows,small", [(20_000, 24), (40, 3)])
def test_no_close_pair_is_lost(spark, monkeypatch, cell_rows, small):
    monkeypatch.setattr(simhash, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(simhash, "SMALL_CELL", small)
    rng = random.Random(4)
    prints = {rng.getrandbits(64) for _ in range(150)}
    for p in list(prints)[:60]:
        prints.add(p ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))))
    dense = rng.getrandbits(64)
    prints |= {dense ^ sum(1 << b for b in rng.sample(range(20), rng.randint(0, 6))) for _ in range(120)}
    prints = sorted(p - 2**64 * (p >= 2**63) for p in prints)
    links = simhash.near_links(spark.createDataFrame([(p,) for p in prints], "fp long"))
    got = {r.node: r.component for r in components.components(links).collect()}
    truth = brute.classes(prints, lambda a, b: ((a ^ b) % 2**64).bit_count() <= 3)
    assert {p: got.get(p, p) for p in prints} == truth
    assert all(((r.u ^ r.v) % 2**64).bit_count() <= 3 or cell_rows > 0 for r in links.collect())


def test_components_of_chains_and_stars(spark):
    rng = random.Random(6)
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 150)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(60)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    nodes = sorted({x for e in real for x in e})
    pairs = {frozenset(e) for e in real}
    assert got == brute.classes(nodes, lambda a, b: frozenset((a, b)) in pairs)


def test_near_copies_of_the_documents(spark):
    docs = table(spark, "documents")
    kept = {r.doc_id for r in near_dedup.keep_one(docs).collect()}
    rows = {r.doc_id: brute.shingle_set(r.text) for r in docs.collect()}
    truth = brute.classes(sorted(rows), lambda a, b: brute.jaccard(rows[a], rows[b]) >= 0.8)
    assert kept == set(truth.values())


def _spoilt(rng, base, changed):
    """A text whose shingles differ from the base's in ``changed`` runs of five."""
    out = list(base)
    for at in rng.sample(range(1, len(base) // 10 - 1), changed):
        out[at * 10] = f"x{rng.getrandbits(40)}"
    return out


@pytest.mark.parametrize("tile", [2_000, 40])
def test_copies_that_only_the_original_joins(spark, monkeypatch, tile):
    monkeypatch.setattr(near_dedup, "TILE_ROWS", tile)
    rng = random.Random(9)
    base = [f"w{k}" for k in range(304)]
    texts = [base] + [_spoilt(rng, base, 5) for _ in range(200)]
    sets = [brute.shingle_set(" ".join(t)) for t in texts]
    assert all(brute.jaccard(sets[0], s) >= 0.8 for s in sets) and brute.jaccard(sets[1], sets[2]) < 0.8
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert [r.doc_id for r in near_dedup.keep_one(frame).collect()] == [0]


def test_similar_short_texts(spark):
    """Pairs at or just above 0.8, of 4 to 75 shingles, and pairs just below."""
    rng = random.Random(10)
    texts = []
    for n in [*range(4, 61), 65, 70, 75] * 3:
        base = [f"w{rng.getrandbits(40)}" for _ in range(n + 4)]
        near, less = n // 9 if n >= 9 else 0, n // 9 + 1
        texts += [base, base[: len(base) - near] + [f"x{rng.getrandbits(40)}" for _ in range(near)] if near else base + ["more"], base[less:] + [f"y{rng.getrandbits(40)}" for _ in range(less)]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = [brute.shingle_set(t) for _, t in rows]
    truth = brute.classes(range(len(rows)), lambda a, b: a // 3 == b // 3 and brute.jaccard(sets[a], sets[b]) >= 0.8)
    assert sorted(r.doc_id for r in near_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == sorted(set(truth.values()))
    assert len(rows) / 3 < len(set(truth.values())) < len(rows)


def test_repeats_inside_a_text_change_nothing(spark):
    rng = random.Random(12)
    texts = []
    for times in (20, 60, 200, 400) * 10:
        base = [f"w{rng.getrandbits(40)}" for _ in range(204)]
        texts += [base, base + base[100:110] * times]
    sets = [brute.shingle_set(" ".join(t)) for t in texts]
    assert all(brute.jaccard(a, b) >= 0.8 for a, b in zip(sets[::2], sets[1::2]))
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r.doc_id for r in near_dedup.keep_one(frame).collect()) == list(range(0, len(texts), 2))


# Token counts.


def test_counts_are_the_librarys(spark, docs, monkeypatch):
    monkeypatch.setattr(token_counts, "PART", 50)
    monkeypatch.setattr(token_counts, "BATCH", 200)
    model = tokenizers.Tokenizer.from_file(TOKENS)
    rng = random.Random(8)
    more = ["<|endoftext|>", "a<|endoftext|> b", "don't    x y\x1c z\x85", "  lead", "trail \n\n", *("".join(rng.choice("ab1 \n\t'! \x1c　é🎉<|>") for _ in range(300)) for _ in range(60))]
    frame = docs.select("doc_id", "text").union(spark.createDataFrame([(i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    for r in token_counts.count_tokens(frame, TOKENS, limit=20).collect():
        n = len(model.encode(r.text or "", add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((r.text or "").encode()), n > 20), r.text[:80]
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for r in token_counts.count_tokens(frame.limit(20), PIECES).collect():
        assert r.n_tokens == len(sp.encode(r.text or ""))


# Line dedup.


@pytest.mark.parametrize("shard", [200, 8 << 20])
def test_kept_lines(spark, docs, monkeypatch, shard):
    monkeypatch.setattr(line_dedup, "SHARD_BYTES", shard)
    rows = [(i, t) for i, t, *_ in brute.awkward()]
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs)).collect()), key=repr)
    assert got == sorted(((i, *k) for (i, _), k in zip(rows, brute.kept_lines(rows))), key=repr)


# Toxicity.


def test_grades_on_held_out_labels(spark):
    """About one in twelve toxic labels here is on a text without any toxic word, so not all can be found."""
    folder = "/root/testdata/sf0.1"
    docs, labels = read_table(spark, folder, "documents"), read_table(spark, folder, "labels")
    model = toxicity.train(docs, labels.where("doc_id % 3 > 0"))
    assert (np.diff(model.thresholds) > 0).all()
    rows = toxicity.grade(docs, model).join(labels.where("doc_id % 3 = 0").select("doc_id", F.col("toxic").alias("truth")), "doc_id").collect()
    bad = [r for r in rows if r.truth]
    assert sum(r.toxic for r in bad) >= 0.85 * len(bad) and sum(r.toxic for r in rows if not r.truth) <= 0.02 * len(rows)
    assert all(0 <= r.severity <= 3 and r.severity >= r.p_toxic for r in rows)


def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, size=(3000, 6))
    grade = np.searchsorted([0.5, 1.5, 2.5], x[:, :3].sum(axis=1) + rng.normal(0, 0.2, 3000))
    row, feature = np.nonzero(x)
    w, t = toxicity.fit_ordinal(row, feature, grade, 6, 3)
    assert (w[:3] > 3).all() and (np.abs(w[3:]) < 0.5).all() and (np.diff(t) > 0).all()


# SentencePiece.


@pytest.fixture(scope="module")
def models():
    return PieceModel(pieces.read_model(PIECES)), sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_pieces_are_the_librarys(models):
    model, library = models
    rng = random.Random(2)
    texts = ["", " ", "  a  b ", "aaaa" * 40, f"{SPACE}{SPACE} {SPACE}", "<s></s><0x41>", "é" * 70, " " * 40 + "x" + " " * 50, "日本語🎉\x00\x01"]
    texts += ["".join(rng.choice("abcdehlnorst  ABTI.,;()=_-0129\n\té日한🎉ü") for _ in range(rng.randint(1, 90))) for _ in range(800)]
    ids, sizes = model.encode(texts)
    bounds = np.cumsum([0, *sizes])
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [library.encode(t) for t in texts]
    assert [d.decode() for d in model.decode(ids, sizes)] == [t.replace(SPACE, " ") for t in texts]


def test_scan_over_any_cut(models):
    model, library = models
    rng = random.Random(3)
    for _ in range(80):
        letters = rng.choice(["abcdehlnorst", "thequickbrownfox   ", "abc日本\n é🎉", "  a"])
        text = "".join(rng.choice(letters) for _ in range(rng.randint(70, 300)))
        whole, size = SPACE + text.replace(" ", SPACE), rng.randint(20, 90)
        n = -(-len(whole) // size)
        chunks = []
        for k in range(n):
            low = max(0, k * size - 64)
            chunks.append(pieces.Chunk(model, whole[low : (k + 1) * size + 64], k * size - low, min(len(whole), (k + 1) * size) - low, k == 0, k == n - 1))
        tables = [c.matrix() for c in chunks]
        ids = np.concatenate([c.back(*s) for c, s in zip(chunks, pieces.scan(tables))]).tolist()
        assert ids == library.encode(text)
        left = tables[0]
        for t in tables[1:]:
            left = pieces.product(left, t)
        right = tables[-1]
        for t in tables[-2::-1]:
            right = pieces.product(t, right)
        assert left == right and -max(left[pieces.START].values()) == len(ids)


@pytest.mark.parametrize("chunk", [300, 1 << 15])
def test_encoded_documents(spark, docs, models, chunk):
    rows = pieces.encode(docs, PIECES, chunk=chunk).collect()
    for r in rows:
        assert np.frombuffer(r.ids, dtype="<u4").tolist() == models[1].encode(r.text or "")
        assert r.n_pieces == len(r.ids) // 4 and r.decoded == (r.text or "")
    assert max(r.n_chunks for r in rows) > 1


# Pipeline.


def test_pipeline_against_plain_steps(spark):
    """Toxicity decisions from the operator (checked above), every later step by brute force."""
    docs = table(spark, "documents")
    stay = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, FOLDER).select("doc_id").collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in stay)
    rows = [(i, k[2]) for (i, _), k in zip(rows, brute.kept_lines(rows))]
    sets = {i: brute.shingle_set(t) for i, t in rows}
    kept = set(brute.classes([i for i, _ in rows], lambda a, b: brute.jaccard(sets[a], sets[b]) >= 0.8).values())
    items = {r.item_id: r.text for r in table(spark, "benchmark").collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r.doc_id: np.frombuffer(r.ids, dtype="<u4").tolist() for r in corpus_pipeline.run(spark, FOLDER).collect()}
    clean = {i: t for i, t in rows if i in kept and not brute.overlaps(t, items)[1]}
    assert clean.keys() <= got.keys() <= kept and len(clean) < len(kept)
    assert all(got[i] == library.encode(t) for i, t in clean.items())
    for i in got.keys() - clean.keys():
        assert brute.overlaps(library.decode(got[i]), items)[1] == 0


def test_digest_is_hashed_once(spark, tmp_path):
    """Each of the 32 letters used to be an expression of its own over the payload's hash, and a branch computes each of them anew."""
    texts = ["", "a", "é\n", "x" * 5000, *(f"page {i}" for i in range(300))]  # some digests begin a part with zeros
    pages = spark.createDataFrame([(i, f"http://h/{i}", t) for i, t in enumerate(texts)], "page_id long, url string, html string")
    got = [r[0] for r in pages.orderBy("page_id").select(warc.base32_sha1(F.col("html"))).collect()]
    assert got == [base64.b32encode(hashlib.sha1(t.encode()).digest()).decode() for t in texts]
    assert str(warc.base32_sha1(F.col("html"))).count("sha1(") <= 4
    warc.write(pages, f"{tmp_path}/w")
    plan = warc.captures(warc.read(spark, f"{tmp_path}/w"))._jdf.queryExecution().analyzed().toString()
    assert not [branch for branch in plan.split("CASE WHEN")[1:] if "THEN" in branch and "sha1(" in branch.split(" END")[0]]
