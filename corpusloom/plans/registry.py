"""Query registry and the shared building blocks of the checking SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.functions import text as X
from corpusloom.sources.lexicons import values_sql

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
MODULES = ("sources", "verbs", "text", "stats", "topics", "classify", "charts")


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"corpusloom.plans.{name}")


def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its key, with the SQL that must give the same rows."""

    def register(fn: Query) -> Query:
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = sql
        return fn

    return register


def text_literal(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# Named blocks: name -> (blocks it reads, body). Tokenizing happens first, in a
# materialized block, before any join or filter on the tokens.
BLOCKS: dict[str, tuple[tuple[str, ...], str]] = {}


def block(name: str, needs: tuple[str, ...], body: str) -> None:
    BLOCKS[name] = (needs, body)


def with_blocks(body: str, *names: str) -> str:
    """``WITH`` clause of the named blocks and everything they need, then the body."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for needed in BLOCKS[name][0]:
            visit(needed)
        ordered.append(name)

    for name in names:
        visit(name)
    clause = ", ".join(f"{n} AS MATERIALIZED ({BLOCKS[n][1]})" for n in ordered)
    return f"WITH {clause} {body}" if clause else body


WORD = text_literal(X.WORD_PATTERN)
NON_WORD = text_literal(X.NON_WORD_PATTERN)
SENTENCE = text_literal(X.SENTENCE_PATTERN)
PIECE = text_literal(X.PIECE_PATTERN)
VOWELS = text_literal(X.VOWEL_GROUP)
SILENT = text_literal(X.SILENT_E)
STOPPED = text_literal(X.STOP_CHARS)

block("party", (), "SELECT doc_id, CASE WHEN quality = 1 THEN 'A' ELSE 'B' END AS party FROM labels")
block("docs", (), "SELECT doc_id, text, lang, source FROM documents")
block(
    "lines", (),
    "SELECT doc_id, source, lang, CAST(unnest(range(len(string_split(text, chr(10))))) AS INTEGER) AS line_no, "
    "unnest(string_split(text, chr(10))) AS text FROM documents",
)
block(
    "tok", (),
    f"SELECT doc_id, source, lang, unnest(regexp_extract_all(lower(text), {WORD}, 0)) AS word FROM documents",
)
block("tp", ("tok", "party"), "SELECT t.doc_id, t.source, t.lang, p.party, t.word FROM tok t JOIN party p ON t.doc_id = p.doc_id")
for _name in ("sentiments", "valences", "shifters", "stop_words", "parts_of_speech", "tagged_tokens"):
    block(_name, (), values_sql(_name))
block(
    "sent0", (),
    f"SELECT doc_id, source, lang, list_filter(list_transform(regexp_extract_all(lower(text), {SENTENCE}, 0), "
    r"lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS ss FROM documents",
)
block(
    "sent", ("sent0",),
    "SELECT doc_id, source, lang, unnest(range(len(ss))) AS sent_no, unnest(ss) AS sentence FROM sent0",
)
block(
    "clean0", ("party",),
    "SELECT d.doc_id, p.party, d.source, list_filter(list_transform(regexp_extract_all(lower(regexp_replace(d.text, "
    f"{text_literal(X.CLEAN_CHARS)}, '', 'g')), {SENTENCE}, 0), "
    r"lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS ss "
    "FROM documents d JOIN party p ON d.doc_id = p.doc_id",
)
block(
    "clean1", ("clean0",),
    "SELECT doc_id, party, source, unnest(range(len(ss))) AS sent_no, unnest(ss) AS sentence FROM clean0",
)
block(
    "clean", ("clean1",),
    "SELECT * FROM (SELECT *, row_number() OVER (ORDER BY doc_id, sent_no) AS sentence_id FROM clean1) WHERE sent_no <> 0",
)


def _modal(pairs: str, key: str, value: str) -> str:
    return (
        f"SELECT {key}, {value} FROM (SELECT {key}, {value}, row_number() OVER (PARTITION BY {key} "
        f"ORDER BY count(*) DESC, {value}) AS rn FROM {pairs} GROUP BY {key}, {value}) WHERE rn = 1"
    )


block("tagtok", ("tagged_tokens",), _modal("tagged_tokens", "token", "upos"))
block("lemtok", ("tagged_tokens",), _modal("tagged_tokens", "token", "lemma"))
for _size in (3, 2, 1):
    block(
        f"end{_size}", ("tagged_tokens",),
        _modal(
            f"(SELECT right(token, {_size}) AS e{_size}, upos AS tag{_size} FROM tagged_tokens WHERE length(token) >= 5)",
            f"e{_size}", f"tag{_size}",
        ),
    )
# Tags of every distinct word, so the look-ups run once per word.
block("vocab", ("tok",), "SELECT DISTINCT word FROM tok")


def tag_sql(source: str, token: str) -> str:
    """SQL that tags the ``token`` column of a block."""
    return (
        f"SELECT s.*, coalesce(l.lemma, lower(s.{token})) AS lemma, CASE WHEN t.upos IS NOT NULL THEN t.upos "
        rf"WHEN regexp_matches(s.{token}, '^\p{{N}}') THEN 'NUM' "
        rf"WHEN NOT regexp_matches(s.{token}, '^[\p{{L}}\p{{M}}\p{{N}}_]') THEN 'PUNCT' "
        f"ELSE coalesce(tag3, tag2, tag1, 'NOUN') END AS upos FROM {source} s "
        f"LEFT JOIN tagtok t ON t.token = lower(s.{token}) LEFT JOIN lemtok l ON l.token = lower(s.{token}) "
        f"LEFT JOIN end3 ON e3 = right(lower(s.{token}), 3) LEFT JOIN end2 ON e2 = right(lower(s.{token}), 2) "
        f"LEFT JOIN end1 ON e1 = right(lower(s.{token}), 1)"
    )


TAGGER = ("tagtok", "lemtok", "end3", "end2", "end1")
block("vtag", ("vocab", *TAGGER), tag_sql("vocab", "word"))

# Per-document measures.
block(
    "syl", ("tok",),
    f"SELECT doc_id, word, greatest(1, len(regexp_extract_all(word, {VOWELS})) - "
    f"CASE WHEN regexp_matches(word, {SILENT}) THEN 1 ELSE 0 END) AS s FROM tok",
)
block(
    "rcount", ("syl",),
    "SELECT d.doc_id, d.source, d.lang, greatest(1, len(regexp_extract_all(d.text, '[.!?]+'))) AS n_sent, "
    "coalesce(c.w, 0) AS n_words, coalesce(c.ch, 0) AS n_chars, coalesce(c.sy, 0) AS n_syll, coalesce(c.cx, 0) AS n_complex "
    "FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS w, sum(length(word)) AS ch, sum(s) AS sy, "
    "count(*) FILTER (WHERE s >= 3) AS cx FROM syl GROUP BY doc_id) c ON d.doc_id = c.doc_id",
)
READABILITY = {
    "Flesch_Kincaid": "0.39::DOUBLE * (n_words::DOUBLE / n_sent) + 11.8::DOUBLE * (n_syll::DOUBLE / n_words) - 15.59::DOUBLE",
    "Gunning_Fog_Index": "0.4::DOUBLE * (n_words::DOUBLE / n_sent + 100.0::DOUBLE * (n_complex::DOUBLE / n_words))",
    "Coleman_Liau": "0.0588::DOUBLE * (n_chars * 100.0::DOUBLE / n_words) - 0.296::DOUBLE * (n_sent * 100.0::DOUBLE / n_words) - 15.8::DOUBLE",
    "SMOG": "1.043::DOUBLE * sqrt(n_complex * 30.0::DOUBLE / n_sent) + 3.1291::DOUBLE",
    "Automated_Readability_Index": "4.71::DOUBLE * (n_chars::DOUBLE / n_words) + 0.5::DOUBLE * (n_words::DOUBLE / n_sent) - 21.43::DOUBLE",
}
READABILITY["Average_Grade_Level"] = "(" + " + ".join(f"({v})" for v in READABILITY.values()) + ") / 5"
block("readab", ("rcount",), "SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in READABILITY.items()) + " FROM rcount WHERE n_words > 0")
FORMAL = "('NOUN', 'ADJ', 'ADP', 'DET')"
CONTEXT = "('PRON', 'VERB', 'AUX', 'ADV')"
block(
    "formal", ("tok", "vtag"),
    "SELECT doc_id, f, c, 50.0::DOUBLE * ((f - c)::DOUBLE / (f + c)::DOUBLE + 1) AS F_measure FROM (SELECT t.doc_id, "
    f"sum(CASE WHEN v.upos IN {FORMAL} THEN 1 END) AS f, sum(CASE WHEN v.upos IN {CONTEXT} THEN 1 END) AS c "
    "FROM tok t JOIN vtag v ON t.word = v.word GROUP BY t.doc_id) WHERE f IS NOT NULL OR c IS NOT NULL",
)
block(
    "lens", (),
    r"SELECT doc_id, source, lang, len(regexp_extract_all(text, '\.|!')) AS n_stops, "
    f"len(regexp_extract_all(text, {NON_WORD})) AS n_words FROM documents",
)
block("lens2", ("lens",), "SELECT *, n_words::DOUBLE / nullif(n_stops, 0) AS mean_sent_length FROM lens")
block(
    "style", ("readab", "formal", "lens2"),
    "SELECT l.doc_id, l.source, l.lang, f.F_measure, r.Flesch_Kincaid, l.n_words, l.mean_sent_length "
    "FROM lens2 l LEFT JOIN readab r ON l.doc_id = r.doc_id LEFT JOIN formal f ON l.doc_id = f.doc_id",
)
block(
    "posit", ("tok", "sentiments"),
    "SELECT doc_id, pos AS n, tot AS sum_n, pos::DOUBLE / tot AS prop_positive FROM (SELECT t.doc_id, "
    "count(*) FILTER (WHERE s.sentiment = 'positive') AS pos, count(*) AS tot FROM tok t JOIN sentiments s ON t.word = s.word "
    "WHERE regexp_matches(s.sentiment, 'pos|neg') GROUP BY t.doc_id) WHERE pos > 0",
)
