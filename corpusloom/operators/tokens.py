"""Lines, documents, sentences, tokens, tags and document-term counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators.grouped import attach, join_hot
from corpusloom.operators.ordered import item_offsets, key_bucket, prefix_sum, stored_items
from corpusloom.session import materialize

FORMAL_TAGS = ("NOUN", "ADJ", "ADP", "DET")
CONTEXT_TAGS = ("PRON", "VERB", "AUX", "ADV")
NOUN_TAGS = ("NOUN", "PROPN")
#: Bytes of text of a part whose words are counted by document.
DEAL_BYTES = 8 << 20


def explode_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per text line; ``line_no`` counts from 0 inside the document."""
    others = [c for c in docs.columns if c != text]
    return docs.select(*others, F.posexplode(X.lines(text)).alias("line_no", text))


def explode_words(df: DataFrame, text: str = "text", out: str = "word") -> DataFrame:
    """One row per word token, other columns kept."""
    others = [c for c in df.columns if c != text]
    return df.select(*others, F.explode(X.words(text)).alias(out))


def explode_sentences(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per sentence; ``sent_no`` counts from 0 inside the document."""
    others = [c for c in df.columns if c != text]
    return df.select(*others, F.posexplode(X.sentences(text)).alias("sent_no", "sentence"))


def segments(lines: DataFrame, key: str, order: str, delimiter: str, text: str = "text", out: str = "segment") -> DataFrame:
    """Running count of delimiter lines, less one, over the whole corpus.

    A delimiter line opens its segment; lines before the first one get -1.
    """
    marked = key_bucket(lines.withColumn("__mark", F.col(text).rlike(delimiter).cast("int")), key, "__block")
    counted = prefix_sum(marked, "__mark", [key, order], "__block", out=out)
    return counted.withColumn(out, F.col(out) - 1).drop("__mark", "__block")


def document_segments(docs: DataFrame, key: str, delimiter: str, text: str = "text") -> DataFrame:
    """(other columns, line_no, segment) of every line: ``segments`` for whole documents.

    The text is read once, where lines become marks; documents' totals of marks are summed up in order, and only marks are moved.
    """
    marks = F.transform(X.lines(text), lambda line: line.rlike(delimiter).cast("int"))
    total = F.aggregate("__marks", F.lit(0), lambda a, m: a + m).cast("long")
    stored = stored_items(docs.withColumn("__marks", marks).drop(text), key, F.col("__marks"), total, "line-marks").drop("__marks")
    rows = stored.join(item_offsets(stored, key), "__row").select(*[c for c in docs.columns if c != text], "__row", "__before", F.posexplode("__items").alias("line_no", "__mark"))
    so_far = F.sum("__mark").over(Window.partitionBy("__row").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("segment", F.col("__before") + so_far - 1).drop("__row", "__before", "__mark")


def line_ids(docs: DataFrame, key: str, text: str = "text", out: str = "id") -> DataFrame:
    """(other columns, line_no, ``out``) of every line, numbered over the whole corpus. The text is read once, to count its lines."""
    count = F.size(X.lines(text)).cast("long")
    stored = stored_items(docs.withColumn("__count", count).drop(text), key, F.lit(None).cast("int"), F.col("__count"), "line-counts").drop("__count", "__items")
    numbered = stored.join(item_offsets(stored, key), "__row")
    exploded = numbered.select(*[c for c in docs.columns if c != text], "__before", F.explode(F.sequence(F.lit(0), F.col("__n").cast("int") - 1)).alias("line_no"))
    return exploded.withColumn(out, F.col("__before") + F.col("line_no") + 1).drop("__before")


def drop_edge_segments(df: DataFrame, segment: str = "segment") -> DataFrame:
    """Drop segment 0 and the last segment."""
    last = df.select(F.max(segment)).scalar()
    return df.filter((F.col(segment) != 0) & (F.col(segment) != last))


def header_fields(lines: DataFrame, key: str, order: str, header: str, fields: dict[str, int], text: str = "text") -> DataFrame:
    """Values found a fixed number of lines below the first header line of each document.

    ``fields`` maps a new column to its line offset. Only header neighbourhoods
    are aggregated: the result has one row per document.
    """
    w = Window.partitionBy(key).orderBy(order)
    ahead = lines.select(key, order, text, *[F.lead(text, k).over(w).alias(n) for n, k in fields.items()])
    hits = ahead.filter(F.col(text).rlike(header))
    first = F.min_by(F.struct(*fields), F.col(order))
    return hits.groupBy(key).agg(first.alias("__f")).select(key, *[F.col(f"__f.{n}").alias(n) for n in fields])


def skip_lines(lines: DataFrame, keys: Sequence[str], order: str, count: int) -> DataFrame:
    """Drop the first lines of every document."""
    w = Window.partitionBy(*keys).orderBy(order)
    return lines.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") > count).drop("__rn")


def clean_sentences(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Cleaned sentence table with corpus-wide ids, first sentence of each document removed."""
    cleaned = docs.withColumn("__all", X.sentences(X.remove_all("text", X.CLEAN_CHARS))).drop("text")
    stored = stored_items(cleaned, key, F.col("__all"), F.size("__all").cast("long"), "sentences").drop("__all")
    # Sentences stay with their document; only counts are put in order.
    numbered = stored.join(item_offsets(stored, key), "__row").select(*[c for c in docs.columns if c != "text"], "__before", F.posexplode("__items").alias("sent_no", "sentence"))
    # The first sentence of a document has the smallest id, i.e. sent_no 0.
    kept = numbered.filter(F.col("sent_no") != 0).withColumn("sentence_id", F.col("__before") + F.col("sent_no") + 1)
    return kept.drop("sent_no", "__before")


def drop_stop_chars(tokens: DataFrame, word: str = "word") -> DataFrame:
    return tokens.filter(~F.col(word).rlike(X.STOP_CHARS))


def drop_stop_words(tokens: DataFrame, stop: DataFrame, extra: Sequence[str] = (), word: str = "word") -> DataFrame:
    """Remove a fixed list and every word of a stop-word table."""
    kept = tokens.filter(~F.col(word).isin(*extra)) if extra else tokens
    return kept.join(stop.select(F.col("word").alias(word)).distinct(), word, "left_anti")


def filter_lexicon(tokens: DataFrame, listed: DataFrame, mode: str, word: str = "word") -> DataFrame:
    """Keep (``mode='keep'``) or drop (``mode='drop'``) the words of a list."""
    how = {"keep": "left_semi", "drop": "left_anti"}[mode]
    return tokens.join(listed.select(F.col("word").alias(word)).distinct(), word, how)


def min_frequency(counts: DataFrame, more_than: int, word: str = "word", n: str = "n") -> DataFrame:
    """Keep words used more than ``more_than`` times in the corpus.

    Takes (…, word, n) counts, so hot words are already collapsed per document.
    """
    totalled = attach(counts, [word], F.sum(n).alias("__all"))
    return totalled.filter(F.col("__all") > more_than).drop("__all")


def vocabulary_totals(counts: DataFrame, word: str = "word", n: str = "n") -> DataFrame:
    """(word, total) of a count table."""
    return counts.groupBy(word).agg(F.sum(n).alias("total"))


def term_counts(tokens: DataFrame, keys: Sequence[str], word: str = "word") -> DataFrame:
    """(keys, word, n): the sparse document-term matrix as a long table."""
    return tokens.groupBy(*keys, word).agg(F.count(F.lit(1)).alias("n"))


def deal_texts(docs: DataFrame, keys: Sequence[str], text: str = "text", most: int = DEAL_BYTES) -> DataFrame:
    """``docs`` dealt by ``keys`` into as many parts as hold about ``most`` bytes of text each, the session's number of parts at least.

    Words of a part are counted in memory, some thirty times its text; with a fixed number of parts the counts of a larger corpus spill.
    """
    size = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    return docs.repartition(max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // most)), *keys)


def all_lemma_counts(counts: DataFrame, model: dict[str, DataFrame], stop: DataFrame, extra: Sequence[str], tags: Sequence[str]) -> DataFrame:
    """(keys, word, n) of the lemmas of words with the given tags, as words of their own, without a minimum of uses.

    Tags, lemmas and stop words are small tables and are looked up where the counts are, so counts dealt by their keys are not
    shuffled again.
    """
    keys = [c for c in counts.columns if c not in ("word", "n")]
    tagged = tag_tokens(counts, model, token="word").filter(F.col("upos").isin(*tags))
    forms = tagged.select(*keys, "n", F.explode(X.words("lemma")).alias("word"))
    return drop_stop_words(forms, stop, extra).groupBy(*keys, "word").agg(F.sum("n").alias("n"))


def lemma_counts(
    counts: DataFrame, model: dict[str, DataFrame], stop: DataFrame, extra: Sequence[str], tags: Sequence[str], more_than: int
) -> DataFrame:
    """``all_lemma_counts`` of lemmas used more than ``more_than`` times.

    The minimum of uses is that of the lemma, over all its forms; lemmas are stored before it is applied.
    """
    keys = [c for c in counts.columns if c not in ("word", "n")]
    stored = materialize(all_lemma_counts(counts, model, stop, extra, tags), "lemmas")
    totals = materialize(vocabulary_totals(stored).filter(F.col("total") > more_than), "lemma-totals")
    return join_hot(stored, totals, "word", "total").drop("total").select(*keys, "word", "n")


def top_vocabulary(counts: DataFrame, size: int, word: str = "word", n: str = "n") -> DataFrame:
    """The most used words; equal counts are ordered by word."""
    return counts.groupBy(word).agg(F.sum(n).alias("total")).orderBy(F.desc("total"), word).limit(size)


# --- part-of-speech tags ------------------------------------------------------


def _modal(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """Most frequent value per key; equal counts go to the smaller value."""
    counted = pairs.groupBy(key, value).agg(F.count(F.lit(1)).alias("c"))
    best = F.min_by(F.col(value), F.struct(-F.col("c"), F.col(value)))
    return counted.groupBy(key).agg(best.alias(value))


def train_tagger(tagged: DataFrame) -> dict[str, DataFrame]:
    """Modal tag and lemma per token, and modal tag per ending of 3, 2 and 1 letters."""
    tags = _modal(tagged, "token", "upos").join(_modal(tagged, "token", "lemma"), "token")
    model = {"token": tags}
    longer = tagged.filter(F.length("token") >= 5)
    for size in (3, 2, 1):
        ending = longer.select(F.substring("token", -size, size).alias(f"end{size}"), F.col("upos").alias(f"tag{size}"))
        model[f"end{size}"] = _modal(ending, f"end{size}", f"tag{size}")
    return model


def tag_tokens(tokens: DataFrame, model: dict[str, DataFrame], token: str = "token") -> DataFrame:
    """Adds ``lemma`` and ``upos`` to a token column by exact match, then by ending.

    A token that has its tag asks for no shorter ending: its key there is null, which no join looks up.
    """
    known = model["token"].withColumnsRenamed({"token": "__t", "lemma": "__lemma", "upos": "__upos"})
    lowered = F.lower(token)
    tagged = tokens.join(known, lowered == F.col("__t"), "left")
    found = F.col("__upos")
    for size in (3, 2, 1):
        ending = F.when(found.isNull(), F.substring(lowered, -size, size))
        tagged = tagged.join(model[f"end{size}"], ending == F.col(f"end{size}"), "left").drop(f"end{size}")
        found = F.coalesce(found, F.col(f"tag{size}"))
    by_ending = F.coalesce("tag3", "tag2", "tag1", F.lit("NOUN"))
    upos = (
        F.when(F.col("__upos").isNotNull(), F.col("__upos"))
        # Begins with one of a to z: no pattern is needed to tell.
        .when((F.col(token) >= "a") & (F.col(token) < "{"), by_ending)
        .when(F.col(token).rlike(r"^\p{N}"), "NUM")
        .when(~F.col(token).rlike(r"^[\p{L}\p{M}\p{N}_]"), "PUNCT")
        .otherwise(by_ending)
    )
    return tagged.withColumns({"lemma": F.coalesce("__lemma", lowered), "upos": upos}).drop(
        "__t", "__lemma", "__upos", "tag3", "tag2", "tag1"
    )


def token_positions(lines: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Tokens and punctuation of each line with 1-based offsets and sentence number.

    The window is keyed by one line of text, so a partition is never larger
    than the line itself.
    """
    pattern = F.lit(X.PIECE_PATTERN)
    pieces = F.arrays_zip(
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("token"),
        F.slice(F.split(text, X.PIECE_PATTERN), F.lit(1), F.regexp_count(F.col(text), pattern)).alias("gap"),
    )
    # Lines are dealt out before they become tokens, so the window below shuffles nothing.
    rows = lines.repartition(*keys).select(*keys, F.posexplode(pieces).alias("token_no", "p")).select(
        *keys, "token_no", F.col("p.token").alias("token"), F.length("p.gap").alias("gap")
    )
    w = Window.partitionBy(*keys).orderBy("token_no")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    ends = F.col("token").isin(".", "!", "?")
    opens = F.coalesce(F.lag(ends).over(w), F.lit(False)) & ~ends
    placed = rows.withColumn("__open", opens.cast("int"))
    return placed.select(
        *keys,
        "token_no",
        "token",
        (F.sum(F.col("gap") + F.length("token")).over(so_far) - F.length("token") + 1).alias("start"),
        F.sum(F.col("gap") + F.length("token")).over(so_far).alias("end"),
        (F.sum("__open").over(so_far) + 1).alias("sentence_id"),
    )


def pos_table(lines: DataFrame, keys: Sequence[str], model: dict[str, DataFrame]) -> DataFrame:
    """Tagged token table of a line (or sentence) table."""
    return tag_tokens(token_positions(lines, keys), model)
