"""Small hand-made cases with known answers."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import scalars
from corpusloom.functions import text as X
from corpusloom.operators import contrast, grouped, measures, sentiment, tokens
from corpusloom.sources.lexicons import lexicon


def _lines(spark, rows):
    return spark.createDataFrame(rows, "doc_id BIGINT, line_no INT, text STRING")


def test_delimiter_segments(spark):
    lines = _lines(spark, [(0, i, t) for i, t in enumerate(["x", "***", "a", "***", "b"])])
    found = tokens.segments(lines, "doc_id", "line_no", r"\*\*\*")
    assert [r.segment for r in found.orderBy("line_no").collect()] == [-1, 0, 0, 1, 1]
    assert [r.text for r in tokens.drop_edge_segments(found).collect()] == ["x"]


def test_header_fields_and_dates(spark):
    rows = [(0, 0, "The Address"), (0, 1, "Jane Roe"), (0, 2, "January 8, 1790"), (0, 3, "Fellow"), (1, 0, "The Address"), (1, 1, "John Doe"), (1, 2, "no date")]
    found = tokens.header_fields(_lines(spark, rows), "doc_id", "line_no", "The Address", {"who": 1, "day": 2})
    got = {r.doc_id: (r.who, r.day) for r in found.withColumn("day", scalars.mdy("day")).collect()}
    assert got == {0: ("Jane Roe", datetime.date(1790, 1, 8)), 1: ("John Doe", None)}


def test_header_repeated_keeps_first(spark):
    rows = [(0, 0, "H"), (0, 1, "a"), (0, 2, "H"), (0, 3, "b")]
    found = tokens.header_fields(_lines(spark, rows), "doc_id", "line_no", "^H$", {"who": 1}).collect()
    assert [(r.doc_id, r.who) for r in found] == [(0, "a")]


def test_skip_intro_lines(spark):
    kept = tokens.skip_lines(_lines(spark, [(0, i, str(i)) for i in range(8)]), ["doc_id"], "line_no", 6)
    assert sorted(r.line_no for r in kept.collect()) == [6, 7]


def test_unmatched_dimension_drops_document(spark):
    docs = spark.createDataFrame([(0, "Jane"), (1, "Nobody")], "doc_id BIGINT, president STRING")
    dim = spark.createDataFrame([("Jane", "none")], "president STRING, party STRING")
    assert [r.doc_id for r in grouped.natural_join(docs, dim).filter("party is not null").collect()] == [0]


def _formality(spark, tags):
    return measures.formality(spark.createDataFrame([(0, t) for t in tags], "doc_id BIGINT, upos STRING"), ["doc_id"]).first()


def test_formality(spark):
    row = _formality(spark, ["NOUN", "NOUN", "DET", "VERB", "PROPN", "PUNCT"])
    assert (row.f, row.c, row.F_measure) == (3, 1, 75.0)
    assert _formality(spark, ["NOUN", "NOUN", "DET"]).F_measure is None


def test_sentence_length_and_zero_stops(spark):
    df = spark.createDataFrame([("One two. Three!",), ("one two",)], "text STRING")
    a, b = measures.lengths(df).collect()
    assert (a.n_stops, a.n_words, a.mean_sent_length) == (2, 3, 1.5)
    assert b.mean_sent_length is None


def test_lexicon_fan_out_and_positivity(spark):
    docs = spark.createDataFrame([(0, "that"), (1, "that with this was"), (2, "was by")], "doc_id BIGINT, text STRING")
    counts = sentiment.lexicon_counts(docs.filter("doc_id = 0"), lexicon(spark, "sentiments"), ["doc_id"]).collect()
    assert {(r.sentiment, r.n) for r in counts} == {("positive", 1), ("trust", 1)}
    scored = {r.doc_id: r.prop_positive for r in sentiment.positivity(docs, lexicon(spark, "sentiments"), ["doc_id"]).collect()}
    assert scored == {0: 1.0, 1: 0.75}


def test_log_ratio(spark):
    counts = spark.createDataFrame([("A", "x", 9), ("A", "y", 19), ("B", "x", 19), ("B", "y", 9), ("A", "z", 9)], "party STRING, word STRING, n BIGINT")
    got = {r.word: r.logratio for r in contrast.log_ratio(counts, "party", "A", "B", 5).collect()}
    assert got == {"x": 1.0, "y": -1.0}
    swapped = {r.word: r.logratio for r in contrast.log_ratio(counts, "party", "B", "A", 5).collect()}
    assert swapped == {w: -v for w, v in got.items()}


def test_top_n_keeps_ties(spark):
    df = spark.createDataFrame([(0, v) for v in (5, 4, 4, 3)], "g INT, v INT")
    assert grouped.top_n_ties(df, ["g"], F.desc("v"), 2).count() == 3


def test_tf_idf(spark):
    counts = spark.createDataFrame([("A", "x", 1), ("A", "y", 3), ("B", "y", 4)], "party STRING, word STRING, n BIGINT")
    got = {(r.party, r.word): r.tf_idf for r in contrast.tf_idf(counts, "party").collect()}
    assert math.isclose(got["A", "x"], 0.25 * math.log(2)) and got["A", "y"] == 0.0


def test_first_sentence_removed(spark):
    docs = spark.createDataFrame([(7, "One. Two. Three."), (3, "Solo here.")], "doc_id BIGINT, text STRING")
    got = {(r.doc_id, r.sentence_id, r.sentence) for r in tokens.clean_sentences(docs).collect()}
    assert got == {(7, 3, "two."), (7, 4, "three.")}


def test_sentences_split_only_before_blank(spark):
    df = spark.createDataFrame([("Pay 3.50 now! Why?  Yes",)], "text STRING")
    assert df.select(X.sentences("text").alias("s")).first().s == ["pay 3.50 now!", "why?", "yes"]


def test_split_length_counts_empty_pieces(spark):
    row = measures.split_lengths(spark.createDataFrame([("a  b",)], "sentence STRING")).first()
    assert row.sentence_length == 3 and math.isclose(row.mean_word_length, 2 / 3)


def test_keep_first(spark):
    df = spark.createDataFrame([(1, 9, "late"), (1, 2, "early")], "id INT, o INT, v STRING")
    assert grouped.keep_first(df, ["id"], ["o"]).first().v == "early"


def test_date_number(spark):
    row = spark.sql("SELECT DATE'1790-01-08' AS d").select(scalars.date_number("d").alias("n")).first()
    assert row.n == 0


def test_replace_first(spark):
    df = spark.createDataFrame([("a\nXbX",)], "t STRING")
    assert df.select(X.replace_first("t", "X", "_").alias("r")).first().r == "a\n_bX"


def test_log_factorial(spark):
    df = spark.createDataFrame([(0,), (1,), (5,), (30,)], "k INT")
    got = [r.v for r in df.select(scalars.log_factorial(F.col("k")).alias("v")).collect()]
    assert all(math.isclose(a, math.lgamma(k + 1), abs_tol=1e-9) for a, k in zip(got, (0, 1, 5, 30)))


def test_readability_formulas(spark):
    # 4 words, 1 sentence, syllables 1 + 1 + 1 + 3, one complex word, 15 letters.
    df = spark.createDataFrame([(0, "The dog was tomato."), ], "doc_id BIGINT, text STRING")
    row = measures.readability(df, ["doc_id"]).first()
    assert (row.n_words, row.n_sent, row.n_syll, row.n_complex, row.n_chars) == (4, 1, 6, 1, 15)
    assert math.isclose(row.Flesch_Kincaid, 0.39 * 4 + 11.8 * 6 / 4 - 15.59)
    assert math.isclose(row.Gunning_Fog_Index, 0.4 * (4 + 25))
    assert math.isclose(row.SMOG, 1.043 * math.sqrt(30) + 3.1291)


def test_valence_shift(spark):
    s = spark.createDataFrame([(1, "it with us"), (2, "is that x"), (3, "nothing here"), (4, "that a b c d e f it")], "sentence_id BIGINT, sentence STRING")
    got = {
        r.sentence_id: r.sentiment
        for r in sentiment.shifted_score(s, lexicon(spark, "valences"), lexicon(spark, "shifters"), ["sentence_id"]).collect()
    }
    assert math.isclose(got[1], -1 / math.sqrt(3))
    assert math.isclose(got[2], 2 * 1.8 / math.sqrt(3))
    assert got[3] == 0.0
    assert math.isclose(got[4], 2 / math.sqrt(8))  # the negator is outside the window


def test_pos_table(spark):
    lines = _lines(spark, [(0, 0, "The  station was early. It is 42!")])
    rows = tokens.pos_table(lines, ["doc_id", "line_no"], tokens.train_tagger(lexicon(spark, "tagged_tokens"))).orderBy("token_no").collect()
    text = "The  station was early. It is 42!"
    assert [text[r.start - 1:r.end] for r in rows] == [r.token for r in rows]
    assert [r.upos for r in rows] == ["DET", "NOUN", "AUX", "ADV", "PUNCT", "PRON", "AUX", "NUM", "PUNCT"]
    assert [r.sentence_id for r in rows] == [1, 1, 1, 1, 1, 2, 2, 2, 2]
    assert rows[2].lemma == "be"


def test_reduce_join_suffixes(spark):
    a = spark.createDataFrame([(1, "p", 5)], "k INT, party STRING, a INT")
    b = spark.createDataFrame([(1, "q")], "k INT, party STRING")
    joined = grouped.reduce_left_join([a, b], "k")
    assert sorted(joined.columns) == ["a", "k", "party_x", "party_y"]


def test_null_groups_survive(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "g STRING, v INT")
    got = {(r.g, r.v, r.m) for r in grouped.attach(df, ["g"], F.max("v").alias("m")).collect()}
    assert got == {(None, 1, 2), (None, 2, 2), ("a", 3, 3)}


def test_forms_of_a_lemma_are_one_term(spark):
    model = tokens.train_tagger(spark.createDataFrame([("stations", "station", "NOUN"), ("station", "station", "NOUN"), ("ran", "run", "VERB"), ("hq", "head office", "NOUN")], "token STRING, lemma STRING, upos STRING"))
    counts = spark.createDataFrame([(1, "stations", 2), (1, "station", 1), (2, "stations", 1), (2, "ran", 9), (2, "hq", 2), (1, "office", 2)], "doc_id BIGINT, word STRING, n BIGINT")
    stop = spark.createDataFrame([("head",)], "word STRING")
    got = {(r.doc_id, r.word): r.n for r in tokens.lemma_counts(counts, model, stop, (), tokens.NOUN_TAGS, more_than=3).collect()}
    assert got == {(1, "station"): 3, (2, "station"): 1, (2, "office"): 2, (1, "office"): 2}


@pytest.mark.parametrize("limit", [0, 60 * 80, 1 << 20])
def test_join_hot_is_the_plain_join(spark, limit, tmp_path):
    """None, some or all of the keys are sent; rows are those of the plain join, rows without a partner stay out."""
    rows = [(d, f"w{w}") for d in range(40) for w in range(d % 7, 100, 1 + d % 5)] + [(99, None)]
    spark.createDataFrame(rows, "doc_id BIGINT, word STRING").write.parquet(str(tmp_path / "cells"))
    cells = spark.read.parquet(str(tmp_path / "cells"))
    table = spark.createDataFrame([(f"w{w}", 1000 // (w + 1)) for w in range(90)] + [("other", None)], "word STRING, total BIGINT")
    got = sorted(map(tuple, grouped.join_hot(cells, table, "word", "total", limit).select("doc_id", "word", "total").collect()))
    assert got == sorted(map(tuple, cells.join(table, "word").select("doc_id", "word", "total").collect()))


def test_lemmas_of_dealt_texts_are_counted_without_a_shuffle(spark):
    """Counts dealt by document stay where they are: words are looked up in small tables, rows of words are not moved."""
    import corpusloom.operators.tokens as own
    from corpusloom.plans.text import tagger

    stored, keep = [], own.materialize
    own.materialize = lambda df, name: stored.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df, name)
    try:
        docs = spark.createDataFrame([(1, "the nation nation"), (1, "nation"), (2, "station nation")], "doc_id BIGINT, text STRING").repartition(4, "doc_id")
        counts = own.term_counts(own.explode_words(docs), ["doc_id"])
        got = own.lemma_counts(counts, tagger(spark), lexicon(spark, "stop_words"), (), own.NOUN_TAGS, more_than=3)
    finally:
        own.materialize = keep
    assert [tuple(r) for r in got.orderBy("doc_id").collect()] == [(1, "nation", 3), (2, "nation", 1)]
    assert "SortMergeJoin" not in stored[0] and stored[0].count("Exchange hashpartitioning(doc_id") == 1


def test_syllables_of_a_whole_text_are_those_of_its_words(spark):
    """Words were measured one by one, each by two patterns twice; sums now come from the words side by side."""
    texts = [None, "", ". !", "e", "the be e a i", "axexe axexexe axexei axexie tree", "l'eau d'été être aujourd'hui", "xyz brr t'e 12.e 3.5", "e'e'e e.e.e.e a_e_ee_e", "Été 𝒜e𝒜e𝒜e"]
    rows = spark.createDataFrame([(t,) for t in texts], "text STRING").withColumn("w", X.words("text"))
    sums = X.syllable_sums(F.col("w"))
    each = F.transform("w", lambda word: X.syllables(word).cast("long"))
    got = rows.select("text", sums[0].alias("s"), sums[1].alias("x"), each.alias("each")).collect()
    want = [(None, None) if r.each is None else (sum(r.each), sum(n >= 3 for n in r.each)) for r in got]
    assert [(r.s, r.x) for r in got] == want and (12, 3) in want


def test_tag_before_ending_and_longer_ending_before_shorter(spark):
    tagged = [("running", "run", "VERB"), ("nation", "nation", "NOUN"), ("quickly", "quick", "ADV"), ("happily", "happy", "ADV")]
    model = tokens.train_tagger(spark.createDataFrame(tagged, "token STRING, lemma STRING, upos STRING"))
    asked = ["Running", "walking", "station", "oddly", "Oddly", "fly", "on", "zzz", "7th", "ing", "?", "", "été", "_g", None]
    frame = tokens.tag_tokens(spark.createDataFrame([(t,) for t in asked], "token STRING"), model)
    got = {r.token: (r.lemma, r.upos) for r in frame.collect()}
    assert got == {
        "Running": ("run", "VERB"), "walking": ("walking", "VERB"), "station": ("station", "NOUN"), "oddly": ("oddly", "ADV"), "Oddly": ("oddly", "ADV"),
        "fly": ("fly", "ADV"), "on": ("on", "NOUN"), "zzz": ("zzz", "NOUN"), "7th": ("7th", "NUM"), "ing": ("ing", "VERB"), "?": ("?", "PUNCT"),
        "": ("", "PUNCT"), "été": ("été", "NOUN"), "_g": ("_g", "VERB"), None: (None, "NOUN"),
    }
    # What has its tag looks up no ending.
    assert frame._jdf.queryExecution().optimizedPlan().toString().count("THEN substring(lower(token") == 3
