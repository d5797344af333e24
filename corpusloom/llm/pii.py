"""Personal data: fixed patterns, and a skip-chain conditional random field that carries labels to similar mentions."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import texts as X

SHARD_BYTES = 3 << 20

# The patterns of the base kinds, in the order of listing.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone")

LABELS = len(KINDS) + 1  # label 0: none
EMAIL_BYTES = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-@")
#: What might be meant as a number: seven digits or more, with up to three separators between two.
NUMBER = re.compile(r"[+(]{0,2}[0-9](?:[ ().\-/]{0,3}[0-9]){6,}")
#: The middle of what might be meant as a mail address, and what follows it; the part before is read backward.
AT = re.compile(r"@|\(at\)|\[at\]| at ")
DOMAIN = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?:\.|\(dot\)|\[dot\]| dot )[A-Za-z0-9-]{1,63}){1,4}")
WIDTH = 1 << 14
#: Documents on which the field is trained, at most.
TRAINING_DOCS = 2_000
STEPS = 150
#: Messages run until none of a document changes by more than this. Steps shrink after ``STEADY`` rounds, so that messages which
#: swing come to rest too; ``ROUNDS`` is only a guard against a loop without end.
TOLERANCE, STEADY, ROUNDS = 1e-4, 200, 20_000
#: Log-potential of equal labels on a skip edge that the ridge pulls to; repeated mentions are rare in a training sample.
AGREE = 6.0
#: Probability from which a mention outside the base spans is added.
SURE = 0.8

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(digits)):
        value = int(c) << (place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _digits(value: str) -> str:
    return "".join(c for c in value if "0" <= c <= "9")


def _emails(text: str) -> Iterator[re.Match]:
    """Matches inside the runs of fitting characters around each @, so that words without one are never scanned."""
    at = text.find("@")
    while at >= 0:
        low, high = at, at + 1
        while low and text[low - 1] in EMAIL_BYTES:
            low -= 1
        while high < len(text) and text[high] in EMAIL_BYTES:
            high += 1
        yield from EMAIL.finditer(text, low, high)
        at = text.find("@", high)


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the fixed patterns that pass their checks; kinds count from 0 as listed."""
    out = [(0, *m.span()) for m in _emails(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def mentions(text: str) -> list[tuple[int, int]]:
    """Places of possible numbers and mail addresses, from left to right, none inside another."""
    found = [m.span() for m in NUMBER.finditer(text)]
    for m in AT.finditer(text):
        low = m.start()
        while low and m.start() - low < 64 and text[low - 1] not in " \t\n\r@":
            low -= 1
        if low < m.start() and (domain := DOMAIN.match(text, m.end())):
            found.append((low, domain.end()))
    out: list[tuple[int, int]] = []
    for start, end in sorted(found):
        if not out or start >= out[-1][1]:
            out.append((start, end))
    return out


def _shape(value: str) -> str:
    return re.sub(r"(.)\1+", r"\1+", re.sub("[^\\W\\d_]", "a", re.sub("[0-9]", "9", value[:80])))


def _words(value: str) -> list[str]:
    return re.findall(r"[^\W\d_]+", value)[-1:] or [""]


def mention_features(text: str, start: int, end: int) -> list[int]:
    """Hashed features of a mention: its form and the words beside it."""
    value = text[start:end]
    digits = _digits(value)
    found = [
        "bias", "shape=" + _shape(value), f"digits={min(len(digits), 20)}", "plus" if value[0] == "+" else "no plus",
        "at" if "@" in value else "no at", f"dots={min(value.count('.'), 5)}", f"luhn={13 <= len(digits) <= 19 and luhn(digits)}",
        "before=" + _words(text[max(0, start - 24) : start])[0].lower(), "after=" + (re.findall(r"[^\W\d_]+", text[end : end + 24]) or [""])[0].lower(),
    ]
    return [zlib.crc32(f.encode()) % WIDTH for f in found]


def similarity_key(value: str) -> str:
    """Equal for mentions that a skip edge joins: the same last nine digits, or the same letters of a mail address."""
    digits = _digits(value)
    if "@" in value or len(digits) < 7:
        return re.sub(r"[^a-z0-9]", "", re.sub(r"\(at\)|\[at\]| at |\(dot\)|\[dot\]| dot ", "", value.lower()))
    return digits[-9:]


@dataclass
class Graph:
    """Mentions of many documents: features, observed labels (0 where the base patterns say nothing), edges."""

    place: list[tuple[int, int, int]]  # document, start, end
    features: np.ndarray
    base: np.ndarray
    left: np.ndarray
    right: np.ndarray
    skip: np.ndarray  # whether an edge joins similar mentions instead of neighbours
    group: np.ndarray  # first mention of the document that is similar


def graph(texts: list[str]) -> tuple[Graph, list[list[Span]]]:
    place, features, base, left, right, skip, group, spans = [], [], [], [], [], [], [], []
    for doc, text in enumerate(texts):
        known = base_spans(text)
        spans.append(known)
        last, by_key = None, {}
        at = 0
        ordered = sorted(known, key=lambda s: s[1])
        for start, end in mentions(text):
            while at < len(ordered) and ordered[at][2] <= start:
                at += 1
            node = len(place)
            place.append((doc, start, end))
            features.append(mention_features(text, start, end))
            base.append(1 + ordered[at][0] if at < len(ordered) and ordered[at][1] < end else 0)
            key = similarity_key(text[start:end])
            similar = by_key.get(key)
            by_key[key] = node
            group.append(node if similar is None else group[similar])
            for other, kind in ((last, False), (similar, True)):
                if other is not None and (kind or other != similar):
                    left.append(other)
                    right.append(node)
                    skip.append(kind)
            last = node
    shape = np.array(features, dtype=np.int64).reshape(len(place), len(features[0]) if features else 1)
    return Graph(place, shape, np.array(base, dtype=np.int64), np.array(left, dtype=np.int64), np.array(right, dtype=np.int64), np.array(skip, dtype=bool), np.array(group, dtype=np.int64)), spans


@dataclass
class Field:
    node: np.ndarray  # feature x label
    chain: np.ndarray  # label x label
    skip: np.ndarray


def _mixed(rows: np.ndarray) -> np.ndarray:
    """Logarithm of the sums of exponentials over the second axis."""
    top = rows.max(axis=1, keepdims=True)
    return np.log(np.exp(rows - top).sum(axis=1)) + top[:, 0]


def marginals(field: Field, g: Graph) -> np.ndarray:
    """Label probabilities of all mentions by loopy message passing; observed ones are held fixed.

    Similar mentions of a document share one hub, so that any two are two steps apart. Where some are observed, the hub has their
    labels and is fixed, however many others there are; otherwise it is a variable without features.
    """
    size = len(g.place)
    if not size:
        return np.zeros((0, LABELS))
    own = field.node[g.features].sum(axis=1)
    seen = np.flatnonzero(g.base)
    counts = np.zeros((size, LABELS))
    np.add.at(counts, (g.group[seen], g.base[seen]), 1)
    fixed = counts.any(axis=1)
    told = np.flatnonzero(fixed[g.group] & (g.base == 0))
    if told.size:
        hub = np.where(counts > 0, np.log(np.maximum(counts, 1)), -np.inf)[g.group[told]]
        own[told] += _mixed(hub[:, :, None] + field.skip[None])
    own[seen] = -50.0
    own[seen, g.base[seen]] = 0.0
    free = np.flatnonzero((np.bincount(g.group, minlength=size)[g.group] > 1) & ~fixed[g.group])
    hubs, hub = np.unique(g.group[free], return_inverse=True)
    own = np.concatenate([own, np.zeros((len(hubs), LABELS))])
    left, right = np.concatenate([g.left[~g.skip], free]), np.concatenate([g.right[~g.skip], size + hub])
    skip = np.concatenate([np.zeros(len(left) - len(free), dtype=bool), np.ones(len(free), dtype=bool)])
    source, target = np.concatenate([left, right]), np.concatenate([right, left])
    back = np.concatenate([np.arange(len(left)) + len(left), np.arange(len(left))])
    tables = np.where(np.concatenate([skip, skip])[:, None, None], field.skip[None], field.chain[None])
    doc = np.array([p[0] for p in g.place], dtype=np.int64)[np.concatenate([left, left])]
    message = np.zeros((len(source), LABELS))
    at = np.arange(len(source))  # edges of the documents whose messages still change
    for turn in range(ROUNDS):
        if not at.size:
            break
        total = own.copy()
        np.add.at(total, target[at], message[at])
        new = _mixed((total[source[at]] - message[back[at]])[:, :, None] + tables[at])
        new -= new.max(axis=1, keepdims=True)
        worst = np.zeros(int(doc.max()) + 1)
        np.maximum.at(worst, doc[at], np.abs(new - message[at]).max(axis=1))
        step = 0.5 * min(1.0, STEADY / (turn + 1))
        message[at] += step * (new - message[at])
        at = at[worst[doc[at]] >= TOLERANCE]
    total = own.copy()
    np.add.at(total, target, message)
    total = np.exp(total - total.max(axis=1, keepdims=True))[:size]
    return total / total.sum(axis=1, keepdims=True)


def fit(g: Graph) -> Field:
    """Pseudo-likelihood with Adam: each mention given its neighbours. Labels are those of the base patterns.

    A mention without a base label that is similar to one with a label is left out of the sum: whether it carries the label is the
    question, and counting it as none would unlearn the skip edges.
    """
    node, chain, skip = np.zeros((WIDTH, LABELS)), np.zeros((LABELS, LABELS)), AGREE * np.eye(LABELS)
    if not len(g.place):
        return Field(node, chain, skip)
    used = np.ones(len(g.place), dtype=bool)
    known = np.zeros(len(g.place), dtype=bool)
    known[g.group[g.base > 0]] = True
    used[(g.base == 0) & known[g.group]] = False
    sums = {False: np.zeros((len(g.place), LABELS)), True: np.zeros((len(g.place), LABELS))}
    for kind, counts in sums.items():
        e = (g.skip == kind) & used[g.left] & used[g.right]
        np.add.at(counts, g.left[e], np.eye(LABELS)[g.base[g.right[e]]])
        np.add.at(counts, g.right[e], np.eye(LABELS)[g.base[g.left[e]]])
    rows = np.flatnonzero(used)
    x, y = g.features[rows], np.eye(LABELS)[g.base[rows]]
    params, names = [node, chain, skip], (None, False, True)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(1, STEPS + 1):
        score = params[0][x].sum(axis=1) + sums[False][rows] @ params[1] + sums[True][rows] @ params[2]
        p = np.exp(score - score.max(axis=1, keepdims=True))
        d = (p / p.sum(axis=1, keepdims=True) - y) / len(rows)
        grads = [np.zeros_like(params[0]), *(sums[k][rows].T @ d for k in names[1:])]
        np.add.at(grads[0], x, d[:, None, :])
        for k, (param, grad, (m, v)) in enumerate(zip(params, grads, moments)):
            grad = grad + 1e-4 * (param - AGREE * np.eye(LABELS) if k == 2 else param)
            if k:
                grad = (grad + grad.T) / 2
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            param -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(*params)


def train(docs: DataFrame, text: str = "text", doc: str = "doc_id") -> Field:
    """Fit on at most ``TRAINING_DOCS`` documents with digits or an @, those with the smallest id hashes; labels are the base patterns'."""
    sample = docs.where(F.col(text).rlike("@|[0-9]")).select(F.col(doc).alias("id"), F.col(text).alias("text"))
    ids = sample.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(TRAINING_DOCS)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in X.pieces(batches, "text", SHARD_BYTES):
            g, _ = graph([t.decode("utf-8", "replace") for t in X.raw_texts(shard, "text")])
            if len(g.place):
                parts = (g.features.astype(np.int32), g.base.astype(np.int32), g.left.astype(np.int32), g.right.astype(np.int32), g.skip, g.group.astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], names=["x", "y", "a", "b", "s", "g"])

    found = sample.join(ids, "id", "left_semi").select("text").mapInArrow(lines, "x binary, y binary, a binary, b binary, s binary, g binary").toArrow().to_pylist()
    found.sort(key=lambda r: r["x"])
    x, y, a, b, s, same, n = [], [], [], [], [], [], 0
    for r in found:
        y.append(np.frombuffer(r["y"], dtype=np.int32).astype(np.int64))
        x.append(np.frombuffer(r["x"], dtype=np.int32).reshape(len(y[-1]), -1).astype(np.int64))
        a.append(np.frombuffer(r["a"], dtype=np.int32).astype(np.int64) + n)
        b.append(np.frombuffer(r["b"], dtype=np.int32).astype(np.int64) + n)
        s.append(np.frombuffer(r["s"], dtype=bool))
        same.append(np.frombuffer(r["g"], dtype=np.int32).astype(np.int64) + n)
        n += len(y[-1])
    if not n:
        return fit(graph([])[0])
    return fit(Graph([(0, 0, 0)] * n, *(np.concatenate(v) for v in (x, y, a, b, s, same))))


def find_personal_data(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """``docs`` with ``pii`` (array of kind, start, end, base; code points, end exclusive; by kind, then start) added.

    Base spans stay. Further mentions of numbers and mail addresses are labelled by the field: neighbouring mentions share chain potentials,
    similar ones anywhere in the document share a hub by skip potentials, and messages run over all mentions of a shard at once, for
    each document until they rest. A mention
    outside the base spans is added where its label is sure.

    Each whole text is read in one task; nothing is shuffled. A null or empty text has none; repeated rows are kept; a column named
    ``pii`` is replaced.
    """
    out = docs.drop("pii")
    schema = T.StructType(out.schema.fields + T.StructType.fromDDL("pii array<struct<kind:string,start:int,end:int,base:boolean>>").fields)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in X.pieces(batches, text, SHARD_BYTES):
            g, base = graph([t.decode("utf-8", "replace") for t in X.raw_texts(shard, text)])
            found = [[(k, a, b, True) for k, a, b in spans] for spans in base]
            chance = marginals(field, g)
            for node in np.flatnonzero((g.base == 0) & (chance[:, 1:].max(axis=1, initial=0) >= SURE)).tolist():
                doc, start, end = g.place[node]
                found[doc].append((int(chance[node, 1:].argmax()), start, end, False))
            rows = [[{"kind": KINDS[k], "start": a, "end": b, "base": c} for k, a, b, c in sorted(f)] for f in found]
            yield pa.RecordBatch.from_arrays([*shard.columns, pa.array(rows, kind)], names=[*shard.schema.names, "pii"])

    return out.mapInArrow(run, schema)
