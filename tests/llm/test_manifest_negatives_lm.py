"""Merkle manifest, hard negatives and language-model scores against plain answers; borders, secrets and few labels."""

import base64
import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import cover_tree, gru, merkle, queries, recurrent_lm, secrets, toxicity, vector_search, warc
from corpusloom.llm.numbering import positions
from corpusloom.llm.texts import read_table
from tests.llm import brute

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def write(spark, folder, **tables):
    schemas = {"documents": brute.DOCS, "embeddings": "vec_id long, embedding array<float>, label int"}
    for name, rows in tables.items():
        spark.createDataFrame(rows, schemas[name]).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


# Merkle manifest.


def digest(row):
    """Of (doc_id, text, lang, source, n_chars)."""
    parts = [str(x).encode() if x is not None else None for x in (row[0], row[3], row[2], row[4], row[1])]
    return hashlib.sha256(b"".join(b"-" if p is None else b"%d:%s" % (len(p), p) for p in parts)).hexdigest()


def plain_tree(leaves):
    """(root, siblings (left, right) of every leaf level by level)."""
    paths, nodes = [[] for _ in leaves], [(h, [i]) for i, h in enumerate(leaves)]
    while len(nodes) > 1:
        after = []
        for i in range(0, len(nodes), 3):
            run = nodes[i : i + 3]
            for j, (_, below) in enumerate(run):
                for leaf in below:
                    paths[leaf].append(("".join(h for h, _ in run[:j]), "".join(h for h, _ in run[j + 1 :])))
            after.append((hashlib.sha256("".join(h for h, _ in run).encode()).hexdigest(), [x for _, b in run for x in b]))
        nodes = after
    return nodes[0][0], paths


def plain_manifest(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, digest(r))):
        groups.setdefault(r[3], []).append(r)
    names = sorted(groups, key=lambda n: (n is not None, (n or "").encode()))
    trees = {n: plain_tree([digest(r) for r in groups[n]]) for n in names}
    root, above = plain_tree([trees[n][0] for n in names])
    out = []
    for n, up in zip(names, above):
        for r, path in zip(groups[n], trees[n][1]):
            path = path + up
            odd = r[0] is None or zlib.crc32(str(r[0]).encode()) % 2
            h = digest(r if odd or r[1] is None else (r[0], r[1].replace("\n", ""), *r[2:]))
            for left, right in path:
                h = hashlib.sha256((left + h + right).encode()).hexdigest()
            out.append((r[0], digest(r), trees[n][0], root, hashlib.sha256("".join(a + b for a, b in path).encode()).hexdigest(), h, h == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [(1,), (3, 1), (730, 2, 9, 28), (0,)])
def test_manifest(spark, tmp_path, sizes):
    rows = [(1000 * g + i, f"line {i}\nof {g}" if i % 5 else None, "en", f"s{g}" if g else None, i) for g, n in enumerate(sizes) for i in range(n)]
    folder = write(spark, tmp_path, documents=rows)
    got = sorted((tuple(r) for r in queries.QUERIES["op11_merkle_manifest"](spark, folder).collect()), key=repr)
    assert got == (plain_manifest(rows) if rows else [])


def test_manifest_of_awkward_rows(spark, tmp_path):
    rows = brute.awkward()
    got = sorted((tuple(r) for r in queries.QUERIES["op11_merkle_manifest"](spark, write(spark, tmp_path, documents=rows)).collect()), key=repr)
    assert got == plain_manifest(rows)
    crowded = spark.createDataFrame(rows, brute.DOCS).withColumns({c: F.lit("own") for c in ("grp", "idx", "n", "own", "leaf", "id", "level", "root")})
    assert merkle.manifest(crowded, COLUMNS, "source", "doc_id").where("verified").count() == len(rows)


def test_a_changed_row_gives_another_root(spark):
    rows = spark.createDataFrame(brute.awkward(), brute.DOCS)
    found = merkle.manifest(rows, COLUMNS, "source", "doc_id", F.when(F.col("doc_id") == 3, merkle.row_digest([F.lit(1)])))
    assert {r.doc_id for r in found.where("NOT verified").collect()} == {3}


def test_places_in_groups_of_any_size(spark):
    rows = [(g, i) for g, n in ((None, 5), ("a", 300), ("b", 1)) for i in range(n)]
    got = positions(spark.createDataFrame(rows, "g string, x int").repartition(7), "g", ["x"]).collect()
    assert sorted(((r.g or "", r.x, r.idx, r.n) for r in got)) == sorted((g or "", x, x, {"": 5, "a": 300, "b": 1}[g or ""]) for g, x in rows)


# Hard negatives.


def plain_negatives(rows):
    clean = []
    for i, v, y in rows:
        if i is None or y is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        clean.append((i, [math.floor(256 * float(np.float32(x))) for x in v], (y + 1) % 10 if i % 7 == 0 else y))
    out = []
    for i, q, y in sorted({r[0]: r for r in reversed(clean)}.values()):
        if i % 100:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(q, v)), j, z) for j, v, z in clean if j != i and len(v) == len(q)))
        for s, p, _ in [t for t in scored if t[2] == y][:5]:
            inside = [(t, j) for t, j, z in scored if z != y and 80 * -s <= 100 * -t <= 100 * -s][:5]
            out += [(i, p, n + 1, j, -s, -t) for n, (t, j) in enumerate(inside)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_negatives(spark, tmp_path, monkeypatch, small):
    if small:  # many trees
        monkeypatch.setattr(cover_tree, "LEAST_BYTES", 4_000)
        monkeypatch.setattr(cover_tree, "MOST_BYTES", 4_000)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + 0.3 * rng.normal(size=8)).tolist(), int(rng.integers(0, 4))) for i in range(700)]
    rows += [(1000 + i, [0.5] * 8, 1 + i % 2) for i in range(60)] + [(2000, [0.0] * 8, 1), (2100, [0.25] * 8, 9)]
    rows += [(3000 + i, [1.0, float(i)], 1 + i % 2) for i in range(5)] + [(3100, [1.0, 1.0], 1), (4000, [], 1), (4001, [], 2)]
    rows += [(None, [1.0] * 8, 1), (5000, None, 1), (5001, [float("nan")] * 8, 1), (5002, [None] * 8, 1), (5003, [1.0] * 8, None), (5100, [float("inf")] * 8, 1)]
    folder = write(spark, tmp_path, embeddings=rows)
    got = sorted(tuple(r) for r in queries.QUERIES["op12_hard_negatives"](spark, folder).collect())
    assert got == plain_negatives(rows) and len(got) > 100


def test_negatives_without_rows_and_beside_other_columns(spark, tmp_path):
    table = read_table(spark, FOLDER, "embeddings")
    assert queries.QUERIES["op12_hard_negatives"](spark, write(spark, tmp_path, embeddings=[])).collect() == []
    rows = vector_search.whole_numbers(table, "embedding")
    crowded = rows.withColumns({c: F.lit("own") for c in ("id", "block", "positives", "anchor", "ids", "name", "rank", "place")})
    chosen = F.col("vec_id") % 50 == 0
    assert sorted(map(tuple, cover_tree.hard_negatives(crowded, chosen).collect())) == sorted(map(tuple, cover_tree.hard_negatives(rows, chosen).collect()))


def test_cover_tree_covers_separates_and_skips():
    rng = np.random.default_rng(8)
    rows = np.concatenate([(rng.normal(size=16) * 300 + rng.normal(size=(150, 16)) * 8).astype(np.int64) for _ in range(20)] + [np.zeros((40, 16), dtype=np.int64)])
    tree = cover_tree.CoverTree(np.arange(len(rows)), np.zeros(len(rows), dtype=np.int64), rows)
    assert sorted(tree.order.tolist()) == list(range(len(rows)))

    def below(n):
        a, b = tree.child[n]
        return np.concatenate([below(c) for c in range(a, b)]) if b else tree.order[tree.member[n] : tree.member[n + 1]]

    for n in range(len(tree.centre)):
        gaps = np.linalg.norm(tree.lifted[below(n)] - tree.lifted[tree.centre[n]], axis=1)
        assert gaps.max() <= tree.radius[n] + 1e-6
        a, b = tree.child[n]
        if b:
            apart = np.linalg.norm(tree.lifted[tree.centre[a:b], None] - tree.lifted[tree.centre[None, a:b]], axis=2)
            assert (apart[~np.eye(b - a, dtype=bool)] > tree.radius[n] / 2 - 1e-3).all() and tree.centre[n] in tree.centre[a:b]
    everything, verified = np.ones(len(rows), dtype=bool), 0
    for q in rows[::97]:
        truth = rows @ q
        top = int(truth.max())
        windows = [(-(2**63), 2**63 - 1), (top // 2, top - 1), (0, top // 3)]
        found, count = tree.search(q, windows, everything, 5)
        verified += count
        for (low, high), (scores, ids) in zip(windows, found):
            inside = [(-int(s), i) for i, s in enumerate(truth) if low <= s <= high]
            assert list(zip((-scores).tolist(), ids.tolist())) == sorted(inside)[:5]
    # On clustered rows most are never verified.
    assert verified < 0.35 * len(rows) * len(rows[::97])


def test_products_beyond_floating_point():
    rows = np.array([[2**40, 2**40], [-(2**40), 3], [2**40, 2**40]])
    tree = cover_tree.CoverTree(np.array([5, 6, 7]), np.zeros(3, dtype=np.int64), rows)
    (scores, ids), = tree.search(np.array([2**20, 1]), [(-(2**63), 2**63 - 1)], np.ones(3, dtype=bool), 5)[0]
    assert list(zip(scores.tolist(), ids.tolist())) == [(2**60 + 2**40, 5), (2**60 + 2**40, 7), (-(2**60) + 3, 6)]
    (scores, _), = tree.search(np.array([2**40, 2**40]), [(-(2**63), 2**63 - 1)], np.ones(3, dtype=bool), 1)[0]
    assert scores.tolist() == [2**63 - 1]  # held at the end of 64 bits


# Language model.


def tokens(text):
    return re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().translate(brute.LOWER)) + [b""]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def base_rows(rows):
    counts = Counter(t for i, text in rows if not held(i) for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    return [(i, held(i), len(t), sum(counts[w] > 0 for w in t), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)) for i, t in ((i, tokens(x)) for i, x in rows)]


@pytest.mark.parametrize("table", [1 << 20, 40])
def test_scores(spark, monkeypatch, table):
    """With a small table most words are joined. Scores of held-out texts are better than those of word counts."""
    monkeypatch.setattr(recurrent_lm, "TABLE", table)
    docs = read_table(spark, FOLDER, "documents")
    got = recurrent_lm.score_documents(docs, F.crc32(F.col("doc_id").cast("string")) % 5 == 1).collect()
    want = {r[0]: r for r in base_rows([(r.doc_id, r.text) for r in docs.collect()])}
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[:5] == want[r.doc_id][:5] and math.isclose(r.base_score, want[r.doc_id][5], rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score <= 0
    if table > 40:
        out = [r for r in got if r.held_out]
        assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_scores_of_awkward_rows(spark):
    rows = brute.awkward()
    docs = spark.createDataFrame(rows, brute.DOCS).withColumns({c: F.lit("own") for c in ("row", "held_out", "ids", "word", "c", "base", "score", "tail")})
    got = recurrent_lm.score_documents(docs, F.crc32(F.col("doc_id").cast("string")) % 5 == 1).collect()
    plain = lambda rows: sorted(((i is None, i, *rest, round(b, 6)) for i, *rest, b in rows), key=repr)
    assert plain(tuple(r)[:6] for r in got) == plain(base_rows([(r[0], r[1]) for r in rows]))
    assert recurrent_lm.score_documents(docs.limit(0), F.lit(False)).collect() == []
    alone = recurrent_lm.score_documents(docs, F.lit(True)).collect()  # nothing to learn from
    assert {(r.n_known, r.train_tokens, r.base_score) for r in alone} == {(0, 0, 0.0)} and all(math.isfinite(r.score) for r in alone)


def test_gradients_against_differences():
    rng = np.random.default_rng(0)
    lay = gru.Layout(np.array([0, 1, 3, 7]), 2, 5)
    w = {k: v.astype(np.float64) + rng.normal(0, 0.3, v.shape) for k, v in lay.begin(np.ones(9)).items()}
    x, y, live = rng.integers(0, 9, (4, 3)), rng.integers(0, 9, (4, 3)), np.ones((4, 3), dtype=bool)
    live[3, 2] = False
    loss = lambda w: -gru._window(lay, w, np.zeros((3, 5)), x, y, live, True)[0].sum()
    grad = gru._window(lay, w, np.zeros((3, 5)), x, y, live, True)[2]
    for k in w:
        for _ in range(6):
            i = tuple(int(rng.integers(0, s)) for s in w[k].shape)
            more, less = ({a: b.copy() for a, b in w.items()} for _ in range(2))
            more[k][i] += 1e-5
            less[k][i] -= 1e-5
            assert math.isclose(grad[k][i], (loss(more) - loss(less)) / 2e-5, rel_tol=1e-4, abs_tol=1e-6), k


def test_windows_do_not_change_scores_and_words_sum_to_one(monkeypatch):
    rng = np.random.default_rng(1)
    lay = gru.Layout(np.array([0, 1, 4, 9]), 3, 6)
    w = {k: v + rng.normal(0, 0.3, v.shape).astype(np.float32) for k, v in lay.begin(np.arange(12.0)).items()}
    texts = [np.append(rng.integers(1, 12, size=n), 0) for n in (1, 3, 50, 200, 49, 7)]
    whole = gru.run(lay, w, texts)
    monkeypatch.setattr(gru, "STEPS", 5)
    monkeypatch.setattr(gru, "LANES", 2)
    assert np.allclose(gru.run(lay, w, texts), whole, atol=1e-3)
    chances = np.exp(gru.run(lay, w, [np.array([3, 5, t]) for t in range(12)]) - gru.run(lay, w, [np.array([3, 5])]))
    assert math.isclose(chances.sum(), 1, rel_tol=1e-4)  # of all ids behind the same words


# Captures, secrets and toxicity: cases that once went wrong.


def test_payloads_that_make_borders(spark, tmp_path):
    border = warc.BETWEEN
    payloads = ["WARC/1.1\r\nhello", "x\r\n\r\nWARC/1.1", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc", f"a{border}b", border, border * 3, "\r\n\r\nWARC/1.1\r", "", "\r\n", "\r\n\r\n", "WARC/1.1", "WARC/1.1\r\n"]
    payloads.append("".join(f"{border}WARC-Type: metadata\r\nWARC-Concurrent-To: <urn:uuid:1>\r\n\r\npage-id: 5\r\n{p}" for p in payloads[:6]))
    pages = spark.createDataFrame([(i, "http://h.org/", p) for i, p in enumerate(payloads)], "page_id long, url string, html string")
    warc.write(pages.withColumns({c: F.lit("own") for c in ("page", "payload", "digest", "bytes", "keeper", "n", "value", "type")}), f"{tmp_path}/w")
    records = warc.read(spark, f"{tmp_path}/w")
    assert records.count() == 3 * len(payloads) and records.where("NOT complete").count() == 0
    got = {r.page_id: r for r in warc.page_facts(warc.captures(records)).collect()}
    assert len(got) == len(payloads)
    for i, p in enumerate(payloads):
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(p.encode()), base64.b32encode(hashlib.sha1(p.encode()).digest()).decode())


ALPHABETS = {"hex": "0123456789ABCDEF", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "lower": string.ascii_lowercase + string.digits, "both": string.ascii_letters + string.digits, "base64": string.ascii_letters + string.digits + "+/"}


@pytest.mark.parametrize("name", ALPHABETS)
@pytest.mark.parametrize("size", [24, 40, 64, 160, 400, 2000])
def test_random_strings_near_words_are_new(name, size):
    rng = random.Random(size)
    found = 0
    for _ in range(20):
        value = "A1" + "".join(rng.choice(ALPHABETS[name]) for _ in range(size - 2)) if name != "lower" else "a1" + "".join(rng.choice(ALPHABETS[name]) for _ in range(size - 2))
        for text in (f"see the credential {value} here", f"{value} # the passphrase"):
            found += secrets.novel_spans(text, []) == [(text.index(value), 3, text.index(value) + size)]
    assert found >= 38


def test_spans_never_overlap_and_keys_take_many_lines():
    text = "bearer abcd1fgh9jklmn0pTokenY_ef2hzzQxR8kLw rest"
    spans = secrets.novel_spans(text, [])
    assert all(a[2] <= b[0] for a, b in zip(spans, spans[1:])) and len(spans) <= 1
    rng = random.Random(3)
    lines = ["".join(rng.choice(ALPHABETS["base64"]) for _ in range(64)) for _ in range(12)]
    key = "-----BEGIN PRIVATE KEY-----\n" + "\n".join(lines) + "\n-----END\n" + "far away " * 20 + lines[0]
    assert len(secrets.novel_spans(key, [])) >= 11


def test_clean_prose_has_few_new_strings(spark):
    rows = read_table(spark, FOLDER, "documents").collect()
    found = sum(len(secrets.novel_spans(r.text or "", secrets.base_spans(r.text or ""))) for r in rows)
    assert found <= len(rows) / 10


@pytest.mark.parametrize("toxic, clean", [(5, 5), (28, 28), (40, 40), (20, 100), (16, 400), (60, 20)])
def test_few_labels(spark, toxic, clean):
    rng = random.Random(toxic)
    words = [f"w{i}" for i in range(400)]

    def text(bad):
        return " ".join([rng.choice(words) for _ in range(60)] + ["vile", "nasty"] * bad)

    rows = [(i, text(i < toxic)) for i in range(toxic + clean)] + [(10_000 + i, text(i < 30)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < toxic)) for i in range(toxic + clean)], "doc_id long, toxic int")
    graded = {r.doc_id: r.toxic for r in toxicity.grade(docs, toxicity.train(docs, labels)).where("doc_id >= 10000").collect()}
    assert [graded[10_000 + i] for i in range(60)] == [i < 30 for i in range(60)]


def test_labels_that_no_word_tells_reject_nothing(spark):
    docs = spark.createDataFrame([(i, f"the same words {i % 3}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(60)], "doc_id long, toxic int")
    assert toxicity.grade(docs, toxicity.train(docs, labels)).where("toxic").count() == 0


def test_words_are_numbered_by_hash_without_sorting_all(monkeypatch):
    monkeypatch.setattr(np, "unique", None)  # sorted every token of a shard
    w = recurrent_lm.split([b"b a b", b"", b"c a", b"  "])
    assert [w.spelled(np.arange(3))[i] for i in w.token] == [b"b", b"a", b"b", b"c", b"a"] and (np.diff(w.hashes.astype(object)) > 0).all()
    assert sorted(zip(w.spelled(np.arange(3)), w.count.tolist())) == [(b"a", 2), (b"b", 2), (b"c", 1)]
    assert recurrent_lm.split([b"", b" "]).count.tolist() == []


def test_scores_of_a_text_follow_the_gates_step_by_step():
    rng, h = np.random.default_rng(4), 5
    lay = gru.Layout(np.array([0, 1, 4, 9]), 2, h)
    w = {k: rng.normal(0, 0.4, v.shape) for k, v in lay.begin(np.ones(lay.words + 2)).items()}
    text, state, before, total = np.array([3, 8, 9, 1, 10, 4, 0]), np.zeros(h), 0, 0.0
    squash = lambda v: 1 / (1 + np.exp(-v))
    for y in text:
        given, own = w["input"][before] @ w["gate"] + w["gate_bias"], state @ w["state"]
        z, r = squash(given[:h] + own[:h]), squash(given[h : 2 * h] + own[h : 2 * h])
        state = z * state + (1 - z) * np.tanh(given[2 * h :] + r * own[2 * h :])
        kinds, c = state @ w["class"] + w["class_bias"], lay.class_of[y]
        total += kinds[c] - np.log(np.exp(kinds).sum())
        if y < lay.words:
            words = slice(lay.starts[c], lay.starts[c + 1])
            near = w["word"][words] @ state + w["word_bias"][words]
            total += near[y - lay.starts[c]] - np.log(np.exp(near).sum())
        before = y
    assert np.allclose(gru.run(lay, w, [text]), total, atol=1e-5)
    # A gate's numbers lie side by side, and scoring alone leaves out the shares.
    assert gru._entry(w).shape == (3, lay.words + 2, h)
    scores = rng.normal(size=(4, 6))
    part, divisor = gru._shares(scores.copy(), False)
    assert np.allclose(divisor, np.log(np.exp(scores).sum(axis=0))) and not np.allclose(part.sum(axis=0), 1)
