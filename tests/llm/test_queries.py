"""The registered queries without SQL, over whole tables, against plain answers."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from corpusloom.llm import pii, queries, secrets
from corpusloom.llm.texts import read_table
from tests.llm import brute

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in read_table(spark, FOLDER, "documents").collect()}


def run(spark, key):
    rows = queries.QUERIES[key](spark, FOLDER).collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    return {r.doc_id: r for r in rows}


def listed(kinds, spans):
    return ",".join(f"{kinds[k]}:{a}:{b}" for k, a, b in spans)


def test_secrets(spark, texts):
    got = run(spark, "op3_secret_scan")
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        base = [(k, a, b) for a, k, b in secrets.base_spans(t)]
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == n for k, *_ in base) for n in range(3))
        assert got[i].base_sha256 == brute.sha(listed(secrets.KINDS, base))
        assert set(filter(None, listed(secrets.KINDS, base).split(","))) <= set(got[i].spans.split(","))


def test_simhash(spark, texts):
    got = run(spark, "op5_simhash_near_dedup")
    prints = {i: brute.fingerprint(t) for i, t in texts.items()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r.component_id for i, r in got.items()} == brute.classes(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)


def test_token_counts(spark, texts):
    model = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, r in run(spark, "op6_token_counts").items():
        n = len(model.encode(texts[i], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[i].encode()), n, n > 512)


def test_personal_data(spark, texts):
    for i, r in run(spark, "op7_personal_data").items():
        base = pii.base_spans(texts[i])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == n for k, *_ in base) for n in range(4))
        assert r.base_sha256 == brute.sha(listed(pii.KINDS, base))
        assert set(filter(None, listed(pii.KINDS, base).split(","))) <= set(r.spans.split(","))


def test_toxicity(spark, texts):
    got = run(spark, "op9_toxicity")
    assert got.keys() == texts.keys() and all(r.toxic == (r.p_toxic > 0.5) for r in got.values())


def test_pieces(spark, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for i, r in run(spark, "op10_sentencepiece").items():
        ids = library.encode(texts[i])
        assert (r.n_pieces, r.round_trip) == (len(ids), True)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
