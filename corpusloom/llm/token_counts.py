"""Token counts of whole texts: batch encoding inside Arrow functions, lengths only."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpusloom.llm import texts as X

SHARD_BYTES = 4 << 20
#: Characters after which a text is split at the next safe place, and characters encoded in one call.
PART, BATCH = 1 << 16, 1 << 19

# The characters with the Unicode property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Every pattern of a byte-level tokenizer ends before white space that follows another character.
SAFE = re.compile(f"(?<=[^{WHITE_SPACE}])(?=[{WHITE_SPACE}])")


def parts(text: str, size: int = PART) -> list[str]:
    """The text cut at safe places, each part ``size`` characters long or a little longer; a text without such places stays whole."""
    out, begin = [], 0
    while len(text) - begin > size:
        place = SAFE.search(text, begin + size)
        if place is None:
            break
        out.append(text[begin : place.start()])
        begin = place.start()
    return [*out, text[begin:]]


def batches(sizes: list[int], most: int = BATCH) -> Iterator[slice]:
    """Consecutive runs of about ``most`` characters."""
    begin, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield slice(begin, i)
            begin, held = i, 0
        held += n
    if begin < len(sizes):
        yield slice(begin, len(sizes))


@cache
def counter(kind: str, content: bytes) -> tuple[Callable[[list[str]], list[int]], bool]:
    """Lengths of encoded texts, and whether texts may be split at safe places. One for each Python worker."""
    if kind == "model":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=content)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)], False
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
    import tokenizers

    model = tokenizers.Tokenizer.from_str(content.decode())
    model.no_truncation()
    model.no_padding()
    config = json.loads(content)
    before = config["pre_tokenizer"] or {}
    safe = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not config["normalizer"]
    return lambda texts: [len(e) for e in model.encode_batch_fast(texts, add_special_tokens=False)], safe


def count_tokens(docs: DataFrame, path: str, limit: int = 512, text: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit`` added.

    ``path`` is a ``.json`` file (tokenizers) or a ``.model`` file (sentencepiece), read once by the driver. Counts are those of the
    library's own encoding of the whole text, without added tokens; special strings in a text count as the library has it. Rows are
    cut into shards by bytes; the texts of a shard, long ones split where the tokenizer always splits, are packed into calls of
    about equal size. Nothing is shuffled.

    A null or empty text has no tokens; repeated rows are kept; columns named like the added ones are replaced.
    """
    added = T.StructType.fromDDL("n_bytes bigint, n_tokens bigint, over_limit boolean")
    out = docs.drop(*added.names)
    schema, kind = T.StructType(out.schema.fields + added.fields), path.rpartition(".")[2]
    with open(path, "rb") as file:
        content = file.read()

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, safe = counter(kind, content)
        for shard in X.pieces(stream, text, SHARD_BYTES):
            raw = X.raw_texts(shard, text)
            cut = [parts(t) if safe else [t] for t in (r.decode("utf-8", "replace") for r in raw)]
            flat = [p for c in cut for p in c]
            lengths = [n for s in batches([len(p) for p in flat]) for n in count(flat[s])]
            owner = np.repeat(np.arange(len(raw)), [len(c) for c in cut])
            tokens = np.bincount(owner, weights=lengths, minlength=len(raw)).astype(np.int64)
            new = [pa.array([len(r) for r in raw], pa.int64()), pa.array(tokens), pa.array(tokens > limit)]
            yield pa.RecordBatch.from_arrays([*shard.columns, *new], names=[*shard.schema.names, *added.names])

    return out.mapInArrow(run, schema)
