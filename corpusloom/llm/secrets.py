"""Secret scan: fixed patterns, and strings that a dictionary-primed compressor finds new where secrets stand."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpusloom.llm import texts as X

SHARD_BYTES = 3 << 20

# The patterns of the base kinds, in the order of listing.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")

#: Words in whose reach strings are measured, the reach in characters, and the text around a string that primes the compressor.
SENSITIVE = re.compile(r"(?i:passw(?:or)?d|passphrase|secret|token|(?:api|access|private)[ _-]?key|credential|authorization|bearer|client[ _-]?id)", re.A)
REACH, AROUND = 64, 512
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Part of the bytes of a random string over the same letters from which a string counts as new, and what the compressor spends on its tables.
NOVELTY, TABLES = 0.8, 16
#: Letters a string can be over, the smallest first: digits, hexadecimal, base32, one case with digits, both cases, base64.
ALPHABETS = [(re.compile(p), n) for p, n in (
    (r"[0-9]+", 10), (r"[0-9a-f]+|[0-9A-F]+", 16), (r"[A-Z2-7=]+", 32), (r"[0-9a-z_-]+|[0-9A-Z_-]+", 38), (r"[0-9A-Za-z]+", 62))]

#: What code and its placeholders are made of; primes the compressor beside the surrounding text.
IDENTIFIERS = (
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 1234567890 xxxxxxxxxxxxxxxx XXXXXXXXXXXXXXXX 0000000000000000 "
    "your_api_key_here your-secret-token replace_me changeme example placeholder dummy sample default undefined null none true false "
    "import from return function class self this const let var public private protected static void string int long float double "
    "request response session client server config settings environment getenv process.env os.environ username password user_name "
    "access_key_id secret_access_key private_key public_key client_secret client_id api_key auth_token bearer_token refresh_token "
    "authorization credential credentials certificate connection database localhost https://www.example.com http:// application/json "
    "get_value set_value get_token set_token create_session update_user delete_user open_file read_file write_file test_ fixture_"
).encode()

Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the fixed patterns; whole matches."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def marginal_bytes(value: str, before: str, after: str) -> int:
    """Bytes that ``value`` adds when the compressor already knows the identifiers and the text around."""
    known = zstandard.ZstdCompressionDict(IDENTIFIERS + after.encode() + before.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    press = zstandard.ZstdCompressor(level=9, dict_data=known, write_content_size=False, write_dict_id=False)
    lead = before[-16:].encode()
    return len(press.compress(lead + value.encode())) - len(press.compress(lead))


def mixed(value: str) -> bool:
    """Digits beside letters: words and plain numbers are no secrets."""
    return any(c.isdigit() for c in value) and any(c.isalpha() for c in value)


def random_bytes(value: str) -> float:
    """About what a random string of this length over the same letters compresses to."""
    letters = next((n for p, n in ALPHABETS if p.fullmatch(value)), 66)
    return min(len(value), len(value) * math.log2(letters) / 8 + TABLES)


def novel_spans(text: str, taken: list[Span]) -> list[Span]:
    """Strings in reach of a sensitive word, outside the base spans, that hardly compress.

    A string is in reach of a word before it, behind it or inside it, and so is one on the line below such a string: a key may take
    many lines. Strings run to their own end, whatever their length, and never overlap.
    """
    words = [m.span() for m in SENSITIVE.finditer(text)]
    if not words:
        return []
    begins, ends = [a for a, _ in words], sorted(b for _, b in words)
    out, last, reached = [], 0, False
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        # A word begins between the string's own begin and its reach behind, or ends in the reach before.
        i, j = bisect_left(begins, start), bisect_left(ends, start - REACH)
        near = (i < len(begins) and begins[i] <= end + REACH) or (j < len(ends) and ends[j] <= start)
        reached = near or (reached and start - last <= 2 and text[last:start].strip() == "")
        last = end
        if not reached or not mixed(m[0]) or any(start < b and a < end for a, _, b in taken):
            continue
        if marginal_bytes(m[0], text[max(0, start - AROUND) : start], text[end : end + AROUND]) >= NOVELTY * random_bytes(m[0]):
            out.append((start, 3, end))
    return out


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``secrets`` (array of kind, start, end; code points, end exclusive; by start, then kind) added.

    Each whole text is scanned where it is read; nothing is shuffled. A null or empty text has none; repeated rows are kept; a
    column named ``secrets`` is replaced; an empty table gives no rows. Strings are measured to their end, however long.
    """
    out = docs.drop("secrets")
    schema = T.StructType(out.schema.fields + T.StructType.fromDDL("secrets array<struct<kind:string,start:int,end:int>>").fields)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in X.pieces(batches, text, SHARD_BYTES):
            found = []
            for value in X.raw_texts(shard, text):
                value = value.decode("utf-8", "replace")
                base = base_spans(value)
                spans = sorted([*base, *novel_spans(value, base)])
                found.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans])
            yield pa.RecordBatch.from_arrays([*shard.columns, pa.array(found, kind)], names=[*shard.schema.names, "secrets"])

    return out.mapInArrow(run, schema)
