"""Text operators and text measures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import contrast, grouped, measures, sentiment, sequence, tokens
from corpusloom.plans.registry import (
    CONTEXT, FORMAL, PIECE, READABILITY, SENTENCE, SILENT, STOPPED, TAGGER, VOWELS, WORD, block, query, tag_sql, text_literal, with_blocks,
)
from corpusloom.session import materialize, scratch_path
from corpusloom.sources import catalog
from corpusloom.sources.lexicons import DOMAIN_STOP_WORDS, EXCLUDED_SENTIMENT_WORDS, lexicon

DIGITS = 8
DOMAIN = ", ".join(f"'{w}'" for w in DOMAIN_STOP_WORDS)


_TAGGERS: dict[str, dict[str, str]] = {}


def tagger(spark: SparkSession) -> dict[str, DataFrame]:
    """The tag tables, trained once per application and stored in the shared folder."""
    paths = _TAGGERS.setdefault(spark.sparkContext.applicationId, {})
    if not paths:
        for name, frame in tokens.train_tagger(lexicon(spark, "tagged_tokens")).items():
            path = scratch_path(spark, f"tagger-{name}")
            frame.write.parquet(path)
            paths[name] = path
    return {name: spark.read.parquet(path) for name, path in paths.items()}


def noun_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, source, lang, word, n) of the topic vocabulary: lemmas of nouns, no stop words, used more than 3 times."""
    counts = _document_words(catalog.documents(spark, folder), ["doc_id", "source", "lang"])
    return tokens.lemma_counts(counts, tagger(spark), lexicon(spark, "stop_words"), DOMAIN_STOP_WORDS, tokens.NOUN_TAGS, more_than=3)


def _document_words(docs, keys):
    # Texts are dealt by document before they become words: a text is far smaller than the rows of its words.
    return tokens.term_counts(tokens.explode_words(tokens.deal_texts(docs.select(*keys, "text"), keys)), keys)


def noun_totals(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """(keys, word, n): ``noun_counts`` summed over the documents of each value of ``keys``, found without counts of each document."""
    words = tokens.explode_words(catalog.documents(spark, folder).select(*keys, "text"))
    counts = tokens.term_counts(words, keys)
    return tokens.lemma_counts(counts, tagger(spark), lexicon(spark, "stop_words"), DOMAIN_STOP_WORDS, tokens.NOUN_TAGS, more_than=3)


def noun_counts_of(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, word, n) of the noun lemmas of some documents, rare ones included."""
    counts = _document_words(docs, ["doc_id"])
    return tokens.all_lemma_counts(counts, tagger(spark), lexicon(spark, "stop_words"), DOMAIN_STOP_WORDS, tokens.NOUN_TAGS)


block(
    "nouns", ("tok", "vtag", "stop_words"),
    "SELECT doc_id, source, lang, word, n FROM (SELECT *, sum(n) OVER (PARTITION BY word) AS everywhere FROM (SELECT doc_id, source, lang, word, count(*) AS n "
    f"FROM (SELECT t.doc_id, t.source, t.lang, unnest(regexp_extract_all(lower(v.lemma), {WORD}, 0)) AS word FROM tok t JOIN vtag v ON t.word = v.word "
    f"WHERE v.upos IN ('NOUN', 'PROPN')) WHERE word NOT IN ({DOMAIN}) AND word NOT IN (SELECT word FROM stop_words) GROUP BY ALL)) WHERE everywhere > 3",
)


# --- tokens -------------------------------------------------------------------


@query("tok_words", with_blocks("SELECT doc_id, word, CAST(count(*) AS BIGINT) AS n FROM tok GROUP BY ALL", "tok"))
def tok_words(spark, folder):
    docs = catalog.documents(spark, folder).select("doc_id", "text")
    return tokens.term_counts(tokens.explode_words(docs), ["doc_id"])


@query(
    "tok_lemma",
    with_blocks(
        "SELECT upos, word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT v.upos, unnest(regexp_extract_all(lower(v.lemma), "
        + text_literal(X.WORD_PATTERN)
        + ", 0)) AS word, c.n FROM vtag v JOIN (SELECT word, count(*) AS n FROM tok GROUP BY word) c ON v.word = c.word) GROUP BY ALL",
        "tok", "vtag",
    ),
)
def tok_lemma(spark, folder):
    """Lemmas tokenized again, so multi-part lemmas split; counted per tag."""
    counts = tokens.term_counts(tokens.explode_words(catalog.documents(spark, folder).select("text")), [])
    tagged = tokens.tag_tokens(counts, tagger(spark), token="word").select("upos", "lemma", "n")
    return tokens.explode_words(tagged, text="lemma").groupBy("upos", "word").agg(F.sum("n").alias("n"))


@query("tok_sentences", with_blocks("SELECT doc_id, CAST(sent_no AS INTEGER) AS sent_no, sentence FROM sent", "sent"))
def tok_sentences(spark, folder):
    return tokens.explode_sentences(catalog.documents(spark, folder).select("doc_id", "text"))


@query(
    "tok_stopchars",
    with_blocks(
        f"SELECT lang, word, CAST(count(*) AS BIGINT) AS n FROM tok WHERE NOT regexp_matches(word, {STOPPED}) GROUP BY ALL", "tok"
    ),
)
def tok_stopchars(spark, folder):
    words = tokens.explode_words(catalog.documents(spark, folder).select("lang", "text"))
    return tokens.term_counts(tokens.drop_stop_chars(words), ["lang"])


@query(
    "tok_stopwords",
    with_blocks(
        f"SELECT source, word, CAST(count(*) AS BIGINT) AS n FROM tok WHERE word NOT IN ({DOMAIN}) "
        "AND word NOT IN (SELECT word FROM stop_words) GROUP BY ALL",
        "tok", "stop_words",
    ),
)
def tok_stopwords(spark, folder):
    words = tokens.explode_words(catalog.documents(spark, folder).select("source", "text"))
    return tokens.term_counts(tokens.drop_stop_words(words, lexicon(spark, "stop_words"), DOMAIN_STOP_WORDS), ["source"])


@query(
    "tok_pos_filter",
    with_blocks(
        "SELECT 'tag' AS by, 'keep' AS mode, t.lang, CAST(count(*) AS BIGINT) AS n FROM tok t JOIN vtag v ON t.word = v.word "
        "WHERE v.upos IN ('NOUN', 'PROPN') GROUP BY t.lang UNION ALL "
        "SELECT 'lexicon', m.mode, t.lang, CAST(count(*) AS BIGINT) FROM tok t JOIN (VALUES ('keep'), ('drop')) m(mode) ON "
        "(t.word IN (SELECT word FROM parts_of_speech WHERE pos IN ('Noun', 'Plural'))) = (m.mode = 'keep') GROUP BY m.mode, t.lang",
        "tok", "vtag", "parts_of_speech",
    ),
)
def tok_pos_filter(spark, folder):
    """Nouns kept by tag, and kept or dropped by a part-of-speech word list."""
    docs = catalog.documents(spark, folder).select("lang", "text")
    counts = tokens.term_counts(tokens.explode_words(docs), ["lang"])
    nouns = lexicon(spark, "parts_of_speech").filter(F.col("pos").isin("Noun", "Plural"))
    by_tag = tokens.tag_tokens(counts, tagger(spark), token="word").filter(F.col("upos").isin(*tokens.NOUN_TAGS))
    parts = [(by_tag, "tag", "keep")] + [
        (tokens.filter_lexicon(counts, nouns, mode), "lexicon", mode) for mode in ("keep", "drop")
    ]
    frames = [
        df.groupBy("lang").agg(F.sum("n").alias("n")).select(F.lit(by).alias("by"), F.lit(mode).alias("mode"), "lang", "n")
        for df, by, mode in parts
    ]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query(
    "tok_min_freq",
    with_blocks(
        "SELECT doc_id, word, CAST(count(*) AS BIGINT) AS n FROM tok WHERE word IN (SELECT word FROM tok GROUP BY word HAVING count(*) > 3) "
        "GROUP BY ALL",
        "tok",
    ),
)
def tok_min_freq(spark, folder):
    docs = catalog.documents(spark, folder).select("doc_id", "text")
    return tokens.min_frequency(tokens.term_counts(tokens.explode_words(docs), ["doc_id"]), 3)


block(
    "piece0", ("lines",),
    f"SELECT doc_id, line_no, regexp_extract_all(text, {PIECE}, 0) AS ts, string_split_regex(text, {PIECE}) AS gs FROM lines",
)
block(
    "piece1", ("piece0",),
    "SELECT doc_id, line_no, unnest(range(len(ts))) AS token_no, unnest(ts) AS token, "
    "unnest(list_transform(gs[1:len(ts)], lambda g: length(g))) AS gap FROM piece0",
)
block(
    "piece2", ("piece1",),
    "SELECT *, sum(gap + length(token)) OVER w AS e, CASE WHEN coalesce(lag(token) OVER w IN ('.', '!', '?'), false) "
    "AND token NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS opens FROM piece1 WINDOW w AS (PARTITION BY doc_id, line_no ORDER BY token_no)",
)
block(
    "piece3", ("piece2",),
    "SELECT doc_id, line_no, token_no, token, CAST(e - length(token) + 1 AS BIGINT) AS \"start\", CAST(e AS BIGINT) AS \"end\", "
    "CAST(sum(opens) OVER (PARTITION BY doc_id, line_no ORDER BY token_no) + 1 AS BIGINT) AS sentence_id FROM piece2",
)


@query(
    "pos_tag",
    with_blocks(
        "SELECT doc_id, line_no, CAST(token_no AS INTEGER) AS token_no, token, \"start\", \"end\", sentence_id, lemma, upos "
        f"FROM ({tag_sql('piece3', 'token')})",
        "piece3", *TAGGER,
    ),
)
def pos_tag(spark, folder):
    lines = tokens.explode_lines(catalog.documents(spark, folder).select("doc_id", "text"))
    return tokens.pos_table(lines, ["doc_id", "line_no"], tagger(spark))


def sequence_tagger(spark: SparkSession, lines: DataFrame) -> sequence.SequenceTagger:
    """Words and endings from the tagged list, transitions from all sentences of the corpus as the look-up tags them."""
    first = tokens.pos_table(lines, ["doc_id", "line_no"], tagger(spark))
    return sequence.train(lexicon(spark, "tagged_tokens"), first, ["doc_id", "line_no", "sentence_id"], "token_no", materialize)


@query("pos_tag_sequence")
def pos_tag_sequence(spark, folder):
    """Tags by the best path of each sentence, so that words of several tags are told apart by their neighbours."""
    lines = tokens.explode_lines(catalog.documents(spark, folder).select("doc_id", "text"))
    return sequence.sequence_table(lines, ["doc_id", "line_no"], sequence_tagger(spark, lines))


@query(
    "corpus_documents",
    with_blocks(
        "SELECT l.doc_id, l.source, p.party, string_agg(l.text, ' ' ORDER BY l.line_no) AS text FROM lines l "
        "JOIN party p ON l.doc_id = p.doc_id GROUP BY ALL",
        "lines", "party",
    ),
)
def corpus_documents(spark, folder):
    lines = tokens.explode_lines(catalog.labelled(spark, folder).select("doc_id", "source", "party", "text"))
    return grouped.ordered_concat(lines, ["doc_id", "source", "party"], "line_no", "text")


@query("corpus_sentences", with_blocks("SELECT doc_id, source, party, sentence_id, sentence FROM clean", "clean"))
def corpus_sentences(spark, folder):
    return tokens.clean_sentences(catalog.labelled(spark, folder).select("doc_id", "source", "party", "text"))


@query("dtm_sparse", with_blocks("SELECT doc_id, word, CAST(n AS BIGINT) AS n FROM nouns", "nouns"))
def dtm_sparse(spark, folder):
    return noun_counts(spark, folder).select("doc_id", "word", "n")


# --- readability, formality, lengths ---------------------------------------------


def _readability_query(key: str, score: str) -> None:
    sql = with_blocks(f"SELECT doc_id, round({score}, {DIGITS}) AS {score} FROM readab", "readab")

    def run(spark: SparkSession, folder: str) -> DataFrame:
        docs = catalog.documents(spark, folder).select("doc_id", "text")
        scored = measures.readability(docs, ["doc_id"], unique=True).filter(F.col("n_words") > 0)
        return scored.select("doc_id", F.round(score, DIGITS).alias(score))

    query(key, sql)(run)


for _key, _score in (
    ("read_flesch_kincaid", "Flesch_Kincaid"),
    ("read_gunning_fog", "Gunning_Fog_Index"),
    ("read_coleman_liau", "Coleman_Liau"),
    ("read_smog", "SMOG"),
    ("read_ari", "Automated_Readability_Index"),
):
    _readability_query(_key, _score)


@query(
    "read_average_grade",
    with_blocks(
        "SELECT source, CAST(sum(n_words) AS BIGINT) AS n_words, "
        + ", ".join(f"round({v.replace('Average_Grade_Level', 'x')}, 6) AS {k}" for k, v in READABILITY.items())
        + " FROM (SELECT source, sum(n_sent) AS n_sent, sum(n_words) AS n_words, sum(n_chars) AS n_chars, sum(n_syll) AS n_syll, "
        "sum(n_complex) AS n_complex FROM rcount GROUP BY source) GROUP BY ALL",
        "rcount",
    ).replace("GROUP BY ALL", "GROUP BY source, n_sent, n_words, n_chars, n_syll, n_complex"),
)
def read_average_grade(spark, folder):
    """All scores per group of documents: the counts are summed, then the formulas applied."""
    scored = measures.readability(catalog.documents(spark, folder).select("source", "text"), ["source"])
    return scored.select("source", "n_words", *[F.round(s, 6).alias(s) for s in READABILITY])


@query(
    "formality_f",
    with_blocks(
        "SELECT doc_id, CAST(f AS BIGINT) AS f, CAST(c AS BIGINT) AS c, round(F_measure, 8) AS F_measure FROM formal", "formal"
    ),
)
def formality_f(spark, folder):
    docs = catalog.documents(spark, folder).select("doc_id", "text")
    return measures.document_formality(docs, tagger(spark)).withColumn("F_measure", F.round("F_measure", DIGITS))


@query(
    "sent_length_doc",
    with_blocks(
        "SELECT doc_id, CAST(n_stops AS INTEGER) AS n_stops, CAST(n_words AS INTEGER) AS n_words, "
        "round(mean_sent_length, 8) AS mean_sent_length FROM lens2",
        "lens2",
    ),
)
def sent_length_doc(spark, folder):
    sized = measures.lengths(catalog.documents(spark, folder).select("doc_id", "text"))
    return sized.select("doc_id", "n_stops", "n_words", F.round("mean_sent_length", DIGITS).alias("mean_sent_length"))


@query(
    "doc_length",
    with_blocks(
        "SELECT doc_id, source, CAST(n_words AS INTEGER) AS n_words, round(avg(n_words) OVER (PARTITION BY source), 6) AS group_mean, "
        "round(avg(n_words) OVER (), 6) AS overall_mean FROM lens",
        "lens",
    ),
)
def doc_length(spark, folder):
    sized = measures.lengths(catalog.documents(spark, folder).select("doc_id", "source", "text")).select(
        "doc_id", "source", "n_words"
    )
    grouped_means = grouped.attach(sized, ["source"], F.round(F.avg("n_words"), 6).alias("group_mean"))
    return grouped_means.withColumn("overall_mean", F.round(sized.select(F.avg("n_words")).scalar(), 6))


@query(
    "sent_length_split",
    with_blocks("SELECT sentence_id, CAST(len(string_split(sentence, ' ')) AS INTEGER) AS sentence_length FROM clean", "clean"),
)
def sent_length_split(spark, folder):
    return measures.split_lengths(corpus_sentences(spark, folder)).select("sentence_id", "sentence_length")


@query(
    "mean_word_length",
    with_blocks(
        "SELECT sentence_id, round(list_avg(list_transform(string_split(sentence, ' '), lambda s: length(s))), 8) AS mean_word_length FROM clean",
        "clean",
    ),
)
def mean_word_length(spark, folder):
    sized = measures.split_lengths(corpus_sentences(spark, folder))
    return sized.select("sentence_id", F.round("mean_word_length", DIGITS).alias("mean_word_length"))


# --- sentiment ---------------------------------------------------------------------


def _share_sql(group: str, table: str, negate: str) -> str:
    return with_blocks(
        f"SELECT {group}, sentiment, CAST(n AS BIGINT) AS n, CAST(sum(n) OVER (PARTITION BY {group}) AS BIGINT) AS sum_n, "
        f"round(n::DOUBLE / sum(n) OVER (PARTITION BY {group}), {DIGITS}) AS proportion FROM (SELECT t.{group}, s.sentiment, count(*) AS n "
        f"FROM {table} t JOIN sentiments s ON t.word = s.word WHERE {negate} regexp_matches(s.sentiment, 'pos|neg') GROUP BY ALL)",
        table, "sentiments",
    )


def _share(spark, folder, group: str, polarity: bool) -> DataFrame:
    docs = catalog.labelled(spark, folder) if group == "party" else catalog.documents(spark, folder)
    shares = sentiment.sentiment_shares(docs, lexicon(spark, "sentiments"), [group], polarity)
    return shares.withColumn("proportion", F.round("proportion", DIGITS))


@query("sentiment_share", _share_sql("source", "tok", "NOT"))
def sentiment_share(spark, folder):
    return _share(spark, folder, "source", polarity=False)


@query("sentiment_share_polarity", _share_sql("source", "tok", ""))
def sentiment_share_polarity(spark, folder):
    return _share(spark, folder, "source", polarity=True)


@query("sentiment_share_party", _share_sql("party", "tp", "NOT"))
def sentiment_share_party(spark, folder):
    return _share(spark, folder, "party", polarity=False)


@query("sentiment_share_party_polarity", _share_sql("party", "tp", ""))
def sentiment_share_party_polarity(spark, folder):
    return _share(spark, folder, "party", polarity=True)


@query(
    "sentiment_positivity",
    with_blocks(
        "SELECT doc_id, CAST(n AS BIGINT) AS n, CAST(sum_n AS BIGINT) AS sum_n, round(prop_positive, 8) AS prop_positive FROM posit", "posit"
    ),
)
def sentiment_positivity(spark, folder):
    scored = sentiment.positivity(catalog.documents(spark, folder), lexicon(spark, "sentiments"), ["doc_id"])
    return scored.withColumn("prop_positive", F.round("prop_positive", DIGITS))


block(
    "sword", ("clean",),
    "SELECT sentence_id, unnest(range(len(w))) AS pos, unnest(w) AS word, len(w) AS word_count FROM (SELECT sentence_id, "
    f"regexp_extract_all(lower(sentence), {text_literal(X.WORD_PATTERN)}, 0) AS w FROM clean)",
)


@query(
    "sentiment_score_lexicon",
    with_blocks(
        "SELECT c.sentence_id, CAST(coalesce(x.s, 0) AS BIGINT) AS sentiment_score FROM clean c LEFT JOIN (SELECT sentence_id, sum(valence) AS s "
        "FROM sword JOIN valences USING (word) GROUP BY sentence_id) x ON c.sentence_id = x.sentence_id",
        "clean", "sword", "valences",
    ),
)
def sentiment_score_lexicon(spark, folder):
    sentences = corpus_sentences(spark, folder)
    return sentiment.additive_score(sentences, lexicon(spark, "valences"), ["sentence_id"])


block(
    "shit", ("sword", "valences", "shifters"),
    "SELECT s.sentence_id, s.pos, s.word_count, v.valence, f.kind FROM sword s LEFT JOIN valences v ON s.word = v.word "
    "LEFT JOIN shifters f ON s.word = f.word",
)
block(
    "snear", ("shit",),
    "SELECT sentence_id, valence, (count(*) FILTER (WHERE kind = 'negator') OVER a) % 2 AS neg, "
    "count(*) FILTER (WHERE kind = 'amplifier') OVER a AS amp, count(*) FILTER (WHERE kind = 'deamplifier') OVER a AS dea, "
    "count(*) FILTER (WHERE kind = 'adversative') OVER b - count(*) FILTER (WHERE kind = 'adversative') OVER c AS adv FROM shit WINDOW "
    "a AS (PARTITION BY sentence_id ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 2 FOLLOWING), "
    "b AS (PARTITION BY sentence_id ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), "
    "c AS (PARTITION BY sentence_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)",
)


@query(
    "sentiment_valence_shift",
    with_blocks(
        "SELECT c.sentence_id, CAST(coalesce(w.k, 0) AS INTEGER) AS word_count, round(coalesce(x.s, 0::DOUBLE) / "
        "sqrt(greatest(1, coalesce(w.k, 0))), 8) AS sentiment FROM clean c "
        "LEFT JOIN (SELECT sentence_id, max(word_count) AS k FROM sword GROUP BY 1) w ON c.sentence_id = w.sentence_id "
        "LEFT JOIN (SELECT sentence_id, sum(valence * (1 - 2 * neg) * (1 + 0.8::DOUBLE * (1 - neg) * amp + "
        "greatest(-1.0::DOUBLE, -0.8::DOUBLE * (neg * amp + dea))) * (1 + 0.25::DOUBLE * adv)) AS s FROM snear WHERE valence IS NOT NULL "
        "GROUP BY 1) x ON c.sentence_id = x.sentence_id",
        "clean", "sword", "snear",
    ),
)
def sentiment_valence_shift(spark, folder):
    sentences = materialize(corpus_sentences(spark, folder).select("sentence_id", "sentence"), "sentences")
    scored = sentiment.shifted_score(sentences, lexicon(spark, "valences"), lexicon(spark, "shifters"), ["sentence_id"])
    return scored.withColumn("sentiment", F.round("sentiment", DIGITS))


# --- sentences with all their measures ------------------------------------------------

block(
    "ssyl", ("sword",),
    f"SELECT sentence_id, word, greatest(1, len(regexp_extract_all(word, {VOWELS})) - CASE WHEN regexp_matches(word, {SILENT}) THEN 1 ELSE 0 END) AS s FROM sword",
)
block(
    "scount", ("clean", "ssyl"),
    "SELECT c.sentence_id, c.party, c.sentence, greatest(1, len(regexp_extract_all(c.sentence, '[.!?]+'))) AS n_sent, n_words, n_chars, n_syll, n_complex "
    "FROM clean c JOIN (SELECT sentence_id, count(*) AS n_words, sum(length(word)) AS n_chars, sum(s) AS n_syll, count(*) FILTER (WHERE s >= 3) AS n_complex "
    "FROM ssyl GROUP BY 1) w ON c.sentence_id = w.sentence_id",
)
block("svocab", ("sword",), "SELECT DISTINCT word FROM sword")
block("svtag", ("svocab", *TAGGER), tag_sql("svocab", "word"))
block(
    "sformal", ("sword", "svtag"),
    "SELECT sentence_id, 50.0::DOUBLE * ((f - c)::DOUBLE / (f + c)::DOUBLE + 1) AS F_measure FROM (SELECT t.sentence_id, "
    f"sum(CASE WHEN v.upos IN {FORMAL} THEN 1 END) AS f, sum(CASE WHEN v.upos IN {CONTEXT} THEN 1 END) AS c "
    "FROM sword t JOIN svtag v ON t.word = v.word GROUP BY t.sentence_id)",
)


@query(
    "feat_sentence_style",
    with_blocks(
        "SELECT c.sentence_id, c.party, " + ", ".join(f"round({v}, 8) AS {k}" for k, v in READABILITY.items()) + ", round(F_measure, 8) AS F_measure, "
        "CAST(len(string_split(c.sentence, ' ')) AS INTEGER) AS sentence_length, "
        "round(list_avg(list_transform(string_split(c.sentence, ' '), lambda s: length(s))), 8) AS mean_word_length, "
        "CAST(coalesce(a.s, 0) AS BIGINT) AS sentiment_score, round(coalesce(x.s, 0::DOUBLE) / sqrt(n_words), 8) AS sentiment_score2, "
        "CAST(n_words AS INTEGER) AS word_count FROM scount c JOIN sformal f ON c.sentence_id = f.sentence_id "
        "LEFT JOIN (SELECT sentence_id, sum(valence) AS s FROM sword JOIN valences USING (word) GROUP BY 1) a ON c.sentence_id = a.sentence_id "
        "LEFT JOIN (SELECT sentence_id, sum(valence * (1 - 2 * neg) * (1 + 0.8::DOUBLE * (1 - neg) * amp + "
        "greatest(-1.0::DOUBLE, -0.8::DOUBLE * (neg * amp + dea))) * (1 + 0.25::DOUBLE * adv)) AS s FROM snear WHERE valence IS NOT NULL "
        "GROUP BY 1) x ON c.sentence_id = x.sentence_id WHERE F_measure IS NOT NULL",
        "scount", "sformal", "sword", "valences", "snear",
    ),
)
def feat_sentence_style(spark, folder):
    """One row per sentence: readability, formality, lengths and both sentiment scores; incomplete sentences left out."""
    sentences = materialize(corpus_sentences(spark, folder).select("sentence_id", "party", "sentence"), "sentences")
    scores = measures.readability_scores()
    base = measures.split_lengths(measures.readability_counts(sentences, "sentence").select("sentence_id", "party", "sentence", *[c.alias(n) for n, c in scores.items()]))
    formal = measures.document_formality(sentences.withColumnRenamed("sentence", "text"), tagger(spark), ["sentence_id"]).select("sentence_id", "F_measure")
    plain = sentiment.additive_score(sentences, lexicon(spark, "valences"), ["sentence_id"])
    shifted = sentiment.shifted_score(sentences, lexicon(spark, "valences"), lexicon(spark, "shifters"), ["sentence_id"]).withColumnRenamed("sentiment", "sentiment_score2")
    every = reduce(lambda a, b: a.join(b, "sentence_id"), (base, formal, plain, shifted))
    complete = every.drop("sentence").na.drop().dropDuplicates(["sentence_id"])
    return complete.withColumns({c: F.round(c, DIGITS) for c in (*scores, "F_measure", "mean_word_length", "sentiment_score2")})


# --- contrasts ----------------------------------------------------------------------


def party_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(party, word, n) without stop characters and stop words.

    Stored once: the contrasts read it several times, and it is far smaller
    than the corpus.
    """
    docs = catalog.labelled(spark, folder).select("party", "text")
    counts = tokens.term_counts(tokens.explode_words(docs), ["party"])
    return materialize(tokens.drop_stop_words(tokens.drop_stop_chars(counts), lexicon(spark, "stop_words")), "party-counts")


block(
    "pcount", ("tp", "stop_words"),
    f"SELECT party, word, count(*) AS n FROM tp WHERE NOT regexp_matches(word, {STOPPED}) AND word NOT IN (SELECT word FROM stop_words) "
    "GROUP BY ALL",
)


def _ratio_block(name: str, source: str, keys: str, more_than: int) -> None:
    block(
        name, (source,),
        f"SELECT {keys}word, a, b, (a + 1)::DOUBLE / (sum(a + 1) OVER ())::DOUBLE AS A_share, (b + 1)::DOUBLE / (sum(b + 1) OVER ())::DOUBLE AS B_share, "
        "log2(((b + 1)::DOUBLE / (sum(b + 1) OVER ())::DOUBLE) / ((a + 1)::DOUBLE / (sum(a + 1) OVER ())::DOUBLE)) AS logratio "
        f"FROM (SELECT {keys}word, coalesce(sum(n) FILTER (WHERE party = 'A'), 0) AS a, coalesce(sum(n) FILTER (WHERE party = 'B'), 0) AS b "
        f"FROM {source} GROUP BY ALL) WHERE a > {more_than} AND b > {more_than}",
    )


_ratio_block("ratio", "pcount", "", 5)
block(
    "scount", ("tp", "sentiments"),
    "SELECT t.party, s.sentiment, t.word, count(*) AS n FROM tp t JOIN sentiments s ON t.word = s.word WHERE regexp_matches(s.sentiment, 'pos|neg') "
    "AND t.word NOT IN (" + ", ".join(f"'{w}'" for w in EXCLUDED_SENTIMENT_WORDS) + ") GROUP BY ALL",
)
_ratio_block("sratio", "scount", "sentiment, ", 5)


@query(
    "log_ratio",
    with_blocks("SELECT word, round(A_share, 10) AS A, round(B_share, 10) AS B, round(logratio, 8) AS logratio FROM ratio", "ratio"),
)
def log_ratio(spark, folder):
    ratios = contrast.log_ratio(party_counts(spark, folder), "party", "A", "B", more_than=5)
    return ratios.select("word", F.round("A", 10).alias("A"), F.round("B", 10).alias("B"), F.round("logratio", DIGITS).alias("logratio"))


@query(
    "log_ratio_top",
    with_blocks(
        "SELECT word, round(logratio, 8) AS logratio FROM (SELECT *, rank() OVER (PARTITION BY logratio < 0 ORDER BY round(abs(logratio), 8) DESC) AS rk "
        "FROM ratio) WHERE rk <= 15",
        "ratio",
    ),
)
def log_ratio_top(spark, folder):
    ratios = contrast.log_ratio(party_counts(spark, folder), "party", "A", "B", more_than=5)
    return contrast.log_ratio_top(ratios, 15).select("word", F.round("logratio", DIGITS).alias("logratio"))


@query(
    "log_ratio_sentiment",
    with_blocks(
        "SELECT sentiment, word, round(logratio, 8) AS logratio FROM (SELECT *, rank() OVER (PARTITION BY sentiment, logratio < 0 "
        "ORDER BY round(abs(logratio), 8) DESC) AS rk FROM sratio) WHERE rk <= 15",
        "sratio",
    ),
)
def log_ratio_sentiment(spark, folder):
    """Log ratio of sentiment words, top 15 per sentiment and side."""
    docs = catalog.labelled(spark, folder).select("party", "text")
    polar = lexicon(spark, "sentiments").filter(F.col("sentiment").rlike(sentiment.POLARITY))
    counts = tokens.term_counts(tokens.explode_words(docs), ["party"]).filter(~F.col("word").isin(*EXCLUDED_SENTIMENT_WORDS))
    ratios = contrast.log_ratio(materialize(counts.join(polar, "word"), "sentiment-counts"), "party", "A", "B", more_than=5, keys=["sentiment"])
    return contrast.log_ratio_top(ratios, 15, ["sentiment"]).select("sentiment", "word", F.round("logratio", DIGITS).alias("logratio"))


block(
    "tfidf", ("pcount",),
    "SELECT party, word, n, n::DOUBLE / sum(n) OVER (PARTITION BY party) AS tf, ln((SELECT count(DISTINCT party) FROM pcount)::DOUBLE / "
    "count(*) OVER (PARTITION BY word)) AS idf FROM pcount",
)


@query(
    "tf_idf",
    with_blocks(
        "SELECT party, word, CAST(n AS BIGINT) AS n, round(tf, 10) AS tf, round(idf, 10) AS idf, round(tf * idf, 10) AS tf_idf FROM "
        "(SELECT *, rank() OVER (PARTITION BY party ORDER BY round(tf * idf, 10) DESC) AS rk FROM tfidf) WHERE rk <= 15",
        "tfidf",
    ),
)
def tf_idf(spark, folder):
    scored = contrast.tf_idf(party_counts(spark, folder), "party")
    top = contrast.top_terms_by(scored, "party", "tf_idf", 15)
    return top.select("party", "word", "n", *[F.round(c, 10).alias(c) for c in ("tf", "idf", "tf_idf")])
