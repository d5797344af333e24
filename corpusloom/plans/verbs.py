"""Plain verbs: projection, filter, join, aggregate, window, sort, scalar functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import scalars
from corpusloom.functions import text as X
from corpusloom.operators import contrast, grouped, measures, ordered, sentiment, tokens
from corpusloom.plans.registry import NON_WORD, STOPPED, query, with_blocks
from corpusloom.sources import catalog
from corpusloom.sources.lexicons import DOMAIN_STOP_WORDS, EXCLUDED_SENTIMENT_WORDS, lexicon

DIGITS = 8


def _r(name: str | Column, alias: str | None = None, digits: int = DIGITS) -> Column:
    column = F.round(name, digits)
    return column.alias(alias or name)


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    """Document attributes only: the scan never reads the text column."""
    return catalog.table(spark, folder, "documents").drop("text")


def _source_party_words(spark: SparkSession, folder: str) -> DataFrame:
    docs = catalog.labelled(spark, folder).select("party", "text")
    return tokens.term_counts(tokens.explode_words(docs), ["party"])


# --- projection ----------------------------------------------------------------


@query("select_drop", "SELECT doc_id AS document, lang, source FROM documents")
def select_drop(spark, folder):
    return _docs(spark, folder).drop("n_chars").select(F.col("doc_id").alias("document"), "lang", "source")


@query("select_everything", "SELECT source, lang, doc_id, n_chars FROM documents")
def select_everything(spark, folder):
    df = _docs(spark, folder)
    front = ["source", "lang"]
    return df.select(*front, *[c for c in df.columns if c not in front])


@query("rename", "SELECT doc_id AS document, lang AS language, source AS president, n_chars FROM documents")
def rename(spark, folder):
    return _docs(spark, folder).withColumnsRenamed({"doc_id": "document", "lang": "language", "source": "president"})


@query(
    "mutate",
    f"SELECT doc_id, n_chars, CAST(doc_id + 1 AS BIGINT) AS position, round(n_chars / 1000.0::DOUBLE, {DIGITS}) AS kchars, "
    "doc_id || '/' || source AS tag FROM documents",
)
def mutate(spark, folder):
    return _docs(spark, folder).select("doc_id", "n_chars", "source").withColumns({
        "position": F.col("doc_id") + 1,
        "kchars": F.round(F.col("n_chars") / F.lit(1000.0), DIGITS),
        "tag": F.concat_ws("/", "doc_id", "source"),
    }).drop("source")


@query(
    "transmute",
    'SELECT source AS "Source name", CAST(sum(n_chars) AS BIGINT) AS "Total characters", '
    f'round(avg(n_chars), {DIGITS}) AS "Mean characters" FROM documents GROUP BY source',
)
def transmute(spark, folder):
    totals = _docs(spark, folder).groupBy("source").agg(F.sum("n_chars").alias("t"), F.avg("n_chars").alias("m"))
    return totals.select(F.col("source").alias("Source name"), F.col("t").alias("Total characters"), _r("m", "Mean characters"))


@query(
    "mutate_if_numeric",
    with_blocks(
        f"SELECT word, round((a + 1)::DOUBLE / (sum(a + 1) OVER ())::DOUBLE, 10) AS A, "
        f"round((b + 1)::DOUBLE / (sum(b + 1) OVER ())::DOUBLE, 10) AS B FROM (SELECT word, "
        "count(*) FILTER (WHERE party = 'A') AS a, count(*) FILTER (WHERE party = 'B') AS b FROM tp GROUP BY word)",
        "tp",
    ),
)
def mutate_if_numeric(spark, folder):
    wide = grouped.pivot_counts(_source_party_words(spark, folder), ["word"], "party", "n", catalog.GROUPS, fill=0)
    names = grouped.numeric_columns(wide)
    totals = grouped.column_totals(wide.select(*[(F.col(c) + 1).alias(c) for c in names]), names)
    return grouped.map_numeric(
        wide, lambda c: F.round((F.col(c) + 1).cast("double") / totals.getField(c).cast("double"), 10)
    )


@query(
    "case_when",
    "SELECT CASE WHEN n_chars > 1000 THEN 'long' ELSE 'short' END AS class, n_chars < 500 AS tiny, "
    "CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY ALL",
)
def case_when(spark, folder):
    label = F.when(F.col("n_chars") > 1000, "long").otherwise("short").alias("class")
    return _docs(spark, folder).groupBy(label, (F.col("n_chars") < 500).alias("tiny")).agg(F.count("*").alias("n"))


@query(
    "cast",
    "SELECT CAST(o_orderkey AS VARCHAR) AS key_text, CAST(o_orderkey AS DOUBLE) AS key_number, "
    "CAST(datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS day_number, "
    "CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS DOUBLE) AS level FROM orders",
)
def cast(spark, folder):
    """Text, number, day number, and a factor whose levels are in alphabetical order."""
    from pyspark.ml.feature import StringIndexer

    orders = catalog.table(spark, folder, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    indexer = StringIndexer(inputCol="o_orderpriority", outputCol="level", stringOrderType="alphabetAsc")
    return indexer.fit(orders).transform(orders).select(
        F.col("o_orderkey").cast("string").alias("key_text"),
        F.col("o_orderkey").cast("double").alias("key_number"),
        F.unix_date(F.col("o_orderdate").cast("date")).alias("day_number"),
        "level",
    )


@query("pull_column", "SELECT source FROM documents")
def pull_column(spark, folder):
    return _docs(spark, folder).select("source")


@query(
    "positional_add",
    with_blocks(
        f"SELECT d.doc_id, d.source, l.n_words, round(l.mean_sent_length, {DIGITS}) AS mean_sent_length "
        "FROM documents d LEFT JOIN lens2 l ON d.doc_id = l.doc_id",
        "lens2",
    ),
)
def positional_add(spark, folder):
    """Columns computed elsewhere are added by key, never by position."""
    added = measures.lengths(catalog.documents(spark, folder).select("doc_id", "text"))
    added = added.select("doc_id", "n_words", _r("mean_sent_length"))
    return _docs(spark, folder).select("doc_id", "source").join(added, "doc_id", "left")


# --- filters --------------------------------------------------------------------


@query("filter_eq_or", "SELECT doc_id, lang FROM documents WHERE (lang = 'en' OR lang = 'fr') AND source <> 'src0'")
def filter_eq_or(spark, folder):
    df = _docs(spark, folder).select("doc_id", "lang", "source")
    return df.filter(((F.col("lang") == "en") | (F.col("lang") == "fr")) & (F.col("source") != "src0")).drop("source")


@query(
    "filter_in",
    with_blocks(
        "SELECT word, CAST(count(*) AS BIGINT) AS n FROM tok WHERE word NOT IN ("
        + ", ".join(f"'{w}'" for w in (*DOMAIN_STOP_WORDS, "the", "of")) + ") GROUP BY word",
        "tok",
    ),
)
def filter_in(spark, folder):
    words = tokens.explode_words(catalog.documents(spark, folder).select("text"))
    return tokens.term_counts(words.filter(~F.col("word").isin(*DOMAIN_STOP_WORDS, "the", "of")), [])


@query(
    "filter_regex",
    with_blocks(
        "SELECT sentiment, CAST(count(*) AS BIGINT) AS n FROM tok JOIN sentiments USING (word) "
        "WHERE NOT regexp_matches(sentiment, 'pos|neg') GROUP BY sentiment",
        "tok", "sentiments",
    ),
)
def filter_regex(spark, folder):
    docs = catalog.documents(spark, folder).select("text")
    kept = lexicon(spark, "sentiments").filter(~F.col("sentiment").rlike(sentiment.POLARITY))
    return sentiment.lexicon_counts(docs, kept, [])


@query(
    "filter_numeric",
    with_blocks(
        "SELECT * FROM (SELECT word, CAST(count(*) FILTER (WHERE party = 'A') AS BIGINT) AS A, "
        "CAST(count(*) FILTER (WHERE party = 'B') AS BIGINT) AS B FROM tp GROUP BY word) WHERE A > 25 AND B > 5",
        "tp",
    ),
)
def filter_numeric(spark, folder):
    wide = grouped.pivot_counts(_source_party_words(spark, folder), ["word"], "party", "n", catalog.GROUPS, fill=0)
    return wide.filter((F.col("A") > 25) & (F.col("B") > 5))


@query(
    "filter_notna",
    "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL",
)
def filter_notna(spark, folder):
    joined = _docs(spark, folder).select("doc_id").join(
        catalog.table(spark, folder, "labels").select("doc_id", "quality"), "doc_id", "left"
    )
    return joined.na.drop(subset=["quality"])


@query(
    "filter_extreme",
    "SELECT doc_id, source FROM documents WHERE doc_id <> 0 AND doc_id <> (SELECT max(doc_id) FROM documents)",
)
def filter_extreme(spark, folder):
    df = _docs(spark, folder).select("doc_id", "source")
    return df.filter((F.col("doc_id") != 0) & (F.col("doc_id") != df.select(F.max("doc_id")).scalar()))


@query(
    "row_index",
    "SELECT d.doc_id, d.source, CASE WHEN l.doc_id IS NOT NULL THEN 'in' ELSE 'out' END AS part "
    "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
)
def row_index(spark, folder):
    """Rows in and not in an index table, by semi and anti join on the key."""
    df = _docs(spark, folder).select("doc_id", "source")
    index = catalog.table(spark, folder, "labels").select("doc_id")
    inside = df.join(index, "doc_id", "left_semi").withColumn("part", F.lit("in"))
    return inside.unionByName(df.join(index, "doc_id", "left_anti").withColumn("part", F.lit("out")))


# --- joins ----------------------------------------------------------------------


@query("join_left", "SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def join_left(spark, folder):
    return _docs(spark, folder).select("doc_id", "lang").join(catalog.table(spark, folder, "labels"), "doc_id", "left")


@query(
    "join_left_composite",
    "SELECT d.doc_id, d.source, d.lang, g.longest FROM documents d LEFT JOIN (SELECT source, lang, max(n_chars) AS longest "
    "FROM documents WHERE n_chars > 2000 GROUP BY source, lang) g ON d.source = g.source AND d.lang = g.lang",
)
def join_left_composite(spark, folder):
    df = _docs(spark, folder)
    longest = df.filter(F.col("n_chars") > 2000).groupBy("source", "lang").agg(F.max("n_chars").alias("longest"))
    return df.select("doc_id", "source", "lang").join(longest, ["source", "lang"], "left")


@query(
    "join_left_renamed",
    "SELECT o.o_orderkey, o.o_custkey AS doc_id, d.source FROM orders o LEFT JOIN documents d ON o.o_custkey = d.doc_id",
)
def join_left_renamed(spark, folder):
    orders = catalog.table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("doc_id"))
    return orders.join(_docs(spark, folder).select("doc_id", "source"), "doc_id", "left")


@query(
    "join_natural",
    "SELECT d.doc_id, d.source, d.n_chars, t.n_docs FROM documents d LEFT JOIN (SELECT source, lang, "
    "CAST(count(*) AS BIGINT) AS n_docs FROM documents GROUP BY ALL) t ON d.source = t.source AND d.lang = t.lang",
)
def join_natural(spark, folder):
    df = _docs(spark, folder)
    sizes = df.groupBy("source", "lang").agg(F.count("*").alias("n_docs"))
    return grouped.natural_join(df, sizes).drop("lang")


@query("join_inner", "SELECT d.doc_id, d.source, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def join_inner(spark, folder):
    labels = catalog.table(spark, folder, "labels").select(F.col("doc_id").alias("document"), "toxic")
    df = _docs(spark, folder).select("doc_id", "source")
    return df.join(labels, df["doc_id"] == labels["document"]).drop("document")


@query(
    "join_lexicon",
    with_blocks(
        "SELECT doc_id, sentiment, CAST(count(*) AS BIGINT) AS n FROM tok JOIN sentiments USING (word) GROUP BY ALL",
        "tok", "sentiments",
    ),
)
def join_lexicon(spark, folder):
    docs = catalog.documents(spark, folder).select("doc_id", "text")
    return sentiment.lexicon_counts(docs, lexicon(spark, "sentiments"), ["doc_id"])


@query(
    "join_anti",
    with_blocks(
        "SELECT lang, word, CAST(count(*) AS BIGINT) AS n FROM tok WHERE word NOT IN (SELECT word FROM stop_words) GROUP BY ALL",
        "tok", "stop_words",
    ),
)
def join_anti(spark, folder):
    words = tokens.explode_words(catalog.documents(spark, folder).select("lang", "text"))
    kept = words.join(lexicon(spark, "stop_words"), "word", "left_anti")
    return tokens.term_counts(kept, ["lang"])


@query(
    "join_reduce",
    with_blocks(
        "SELECT d.doc_id, d.source AS source_x, p.party AS party_x, d.lang, s.prop AS prop_positive, q.party AS party_y, "
        "q.source AS source_y FROM documents d LEFT JOIN party p ON d.doc_id = p.doc_id "
        f"LEFT JOIN (SELECT doc_id, round(prop_positive, {DIGITS}) AS prop FROM posit) s ON d.doc_id = s.doc_id "
        "LEFT JOIN (SELECT pp.doc_id, pp.party, dd.source FROM party pp JOIN documents dd ON pp.doc_id = dd.doc_id "
        "WHERE pp.party = 'B') q ON d.doc_id = q.doc_id",
        "party", "posit",
    ),
)
def join_reduce(spark, folder):
    df = _docs(spark, folder).select("doc_id", "source", "lang")
    party = catalog.parties(spark, folder)
    scored = sentiment.positivity(
        catalog.documents(spark, folder), lexicon(spark, "sentiments"), ["doc_id"]
    ).select("doc_id", _r("prop_positive"))
    second = party.filter(F.col("party") == "B").join(df.select("doc_id", "source"), "doc_id")
    return grouped.reduce_left_join([df.join(party, "doc_id", "left"), scored, second], "doc_id")


HEADER = "^[A-D]"


@query(
    "join_header_offset",
    with_blocks(
        "SELECT l.doc_id, l.line_no, length(h.speaker) AS speaker_length, length(h.said_on) AS date_length FROM lines l LEFT JOIN "
        "(SELECT * FROM (SELECT doc_id, speaker, said_on, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS rn FROM "
        "(SELECT doc_id, line_no, text, lead(text, 1) OVER w AS speaker, lead(text, 2) OVER w AS said_on FROM lines "
        "WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)) WHERE regexp_matches(text, '^[A-D]')) WHERE rn = 1) h "
        "ON l.doc_id = h.doc_id",
        "lines",
    ),
)
def join_header_offset(spark, folder):
    lines = tokens.explode_lines(catalog.documents(spark, folder).select("doc_id", "text"))
    found = tokens.header_fields(lines, "doc_id", "line_no", HEADER, {"speaker": 1, "said_on": 2})
    sized = found.select("doc_id", F.length("speaker").alias("speaker_length"), F.length("said_on").alias("date_length"))
    return lines.select("doc_id", "line_no").join(sized, "doc_id", "left")


# --- aggregation and reshape ------------------------------------------------------


@query("agg_count", with_blocks("SELECT party, word, CAST(count(*) AS BIGINT) AS n FROM tp GROUP BY ALL", "tp"))
def agg_count(spark, folder):
    return _source_party_words(spark, folder)


@query(
    "agg_add_count",
    with_blocks(
        "SELECT DISTINCT doc_id, word, CAST(n AS BIGINT) AS n, CAST(c AS BIGINT) AS total FROM (SELECT doc_id, word, "
        "count(*) OVER (PARTITION BY doc_id, word) AS n, count(*) OVER (PARTITION BY word) AS c FROM tok)",
        "tok",
    ),
)
def agg_add_count(spark, folder):
    counts = tokens.term_counts(
        tokens.explode_words(catalog.documents(spark, folder).select("doc_id", "text")), ["doc_id"]
    )
    return grouped.attach(counts, ["word"], F.sum("n").alias("total"))


@query(
    "agg_sum_mean",
    f"SELECT source, CAST(sum(n_chars) AS BIGINT) AS total, round(avg(n_chars), {DIGITS}) AS mean FROM documents GROUP BY source",
)
def agg_sum_mean(spark, folder):
    return _docs(spark, folder).groupBy("source").agg(F.sum("n_chars").alias("total"), _r(F.avg("n_chars"), "mean"))


@query(
    "agg_all_numeric",
    "SELECT l_returnflag, l_linestatus, "
    + ", ".join(
        f"round(avg({c}), 4) AS {c}"
        for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    )
    + " FROM lineitem GROUP BY ALL",
)
def agg_all_numeric(spark, folder):
    means = grouped.mean_numeric(catalog.table(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus"])
    return grouped.map_numeric(means, lambda c: F.round(c, 4))


@query(
    "agg_global",
    f"SELECT round(avg(n_chars), {DIGITS}) AS mean_chars, max(doc_id) AS last_id, CAST(count(*) AS BIGINT) AS n FROM documents",
)
def agg_global(spark, folder):
    return _docs(spark, folder).agg(
        _r(F.avg("n_chars"), "mean_chars"), F.max("doc_id").alias("last_id"), F.count("*").alias("n")
    )


@query(
    "agg_weighted_mean",
    with_blocks(
        f"SELECT round(sum(r.Flesch_Kincaid * n.k) / sum(n.k), 6) AS line_mean, round(avg(r.Flesch_Kincaid), 6) AS doc_mean FROM readab r "
        "JOIN (SELECT doc_id, len(string_split(text, chr(10))) AS k FROM documents) n ON r.doc_id = n.doc_id",
        "readab",
    ),
)
def agg_weighted_mean(spark, folder):
    """Mean weighted by lines per document, beside the plain document mean."""
    docs = catalog.documents(spark, folder).select("doc_id", "text").withColumn("k", F.size(X.lines("text")))
    scored = measures.readability(docs, ["doc_id", "k"], unique=True).filter(F.col("n_words") > 0)
    fk = F.col("Flesch_Kincaid")
    return scored.agg(
        F.round(F.sum(fk * F.col("k")) / F.sum("k"), 6).alias("line_mean"), F.round(F.avg(fk), 6).alias("doc_mean")
    )


@query("agg_distinct", "SELECT DISTINCT source, lang FROM documents")
def agg_distinct(spark, folder):
    return _docs(spark, folder).select("source", "lang").distinct()


@query(
    "agg_distinct_keep",
    "SELECT source, lang, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars, doc_id) AS rn "
    "FROM documents) WHERE rn = 1",
)
def agg_distinct_keep(spark, folder):
    return grouped.keep_first(_docs(spark, folder), ["source", "lang"], ["n_chars", "doc_id"])


@query(
    "agg_string_concat",
    "SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id",
)
def agg_string_concat(spark, folder):
    return grouped.ordered_concat(catalog.table(spark, folder, "conversations"), ["conv_id"], "turn", "text")


@query(
    "agg_list",
    with_blocks(
        "SELECT source, string_agg(word, ', ' ORDER BY n DESC, word) AS terms FROM (SELECT source, word, n, rank() OVER "
        "(PARTITION BY source ORDER BY n DESC) AS rk FROM (SELECT source, word, count(*) AS n FROM tok GROUP BY ALL)) "
        "WHERE rk <= 6 GROUP BY source",
        "tok",
    ),
)
def agg_list(spark, folder):
    counts = tokens.term_counts(
        tokens.explode_words(catalog.documents(spark, folder).select("source", "text")), ["source"]
    )
    top = grouped.top_n_ties(counts, ["source"], F.desc("n"), 6)
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "word")))
    return top.groupBy("source").agg(F.concat_ws(", ", F.transform(listed, lambda x: x["word"])).alias("terms"))


@query(
    "pivot_wide",
    "SELECT source, "
    + ", ".join(f"CAST(sum(n_chars) FILTER (WHERE lang = '{x}') AS BIGINT) AS {x}" for x in catalog.LANGS)
    + " FROM documents GROUP BY source",
)
def pivot_wide(spark, folder):
    return grouped.pivot_counts(_docs(spark, folder), ["source"], "lang", "n_chars", catalog.LANGS)


@query(
    "unpivot_long",
    " UNION ALL ".join(
        f"SELECT source, '{x}' AS lang, CAST(sum(n_chars) FILTER (WHERE lang = '{x}') AS BIGINT) AS value FROM documents GROUP BY source"
        for x in catalog.LANGS
    ),
)
def unpivot_long(spark, folder):
    return pivot_wide(spark, folder).unpivot("source", list(catalog.LANGS), "lang", "value")


@query(
    "explode_nested",
    "SELECT source, CAST(unnest(range(len(ids))) AS INTEGER) AS pos, unnest(ids) AS n_chars FROM "
    "(SELECT source, list_distinct(list(lang)) AS x, list_sort(list(DISTINCT n_chars % 1000)) AS ids FROM documents GROUP BY source)",
)
def explode_nested(spark, folder):
    nested = _docs(spark, folder).groupBy("source").agg(
        F.array_sort(F.collect_set(F.col("n_chars") % 1000)).alias("values")
    )
    return nested.select("source", F.posexplode("values").alias("pos", "n_chars"))


@query(
    "col_sums_top",
    with_blocks(
        "SELECT word, CAST(count(*) AS BIGINT) AS total FROM tp WHERE NOT regexp_matches(word, " + STOPPED + ") "
        "GROUP BY word ORDER BY total DESC, word LIMIT 1000",
        "tp",
    ),
)
def col_sums_top(spark, folder):
    return tokens.top_vocabulary(tokens.drop_stop_chars(_source_party_words(spark, folder)), 1000)


# --- windows ------------------------------------------------------------------------


@query(
    "win_cumsum_segment",
    with_blocks(
        "SELECT doc_id, line_no, segment FROM (SELECT doc_id, line_no, CAST(sum(CASE WHEN regexp_matches(text, '^[A-D]') THEN 1 ELSE 0 END) "
        "OVER (ORDER BY doc_id, line_no ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS segment FROM lines)",
        "lines",
    ),
)
def win_cumsum_segment(spark, folder):
    return tokens.document_segments(catalog.documents(spark, folder).select("doc_id", "text"), "doc_id", HEADER)


@query("win_row_number_skip", with_blocks("SELECT doc_id, line_no, text FROM lines WHERE line_no >= 6", "lines"))
def win_row_number_skip(spark, folder):
    lines = tokens.explode_lines(catalog.documents(spark, folder).select("doc_id", "text"))
    return tokens.skip_lines(lines, ["doc_id"], "line_no", 6)


@query(
    "win_global_id",
    with_blocks("SELECT doc_id, line_no, row_number() OVER (ORDER BY doc_id, line_no) AS id FROM lines", "lines"),
)
def win_global_id(spark, folder):
    return tokens.line_ids(catalog.documents(spark, folder).select("doc_id", "text"), "doc_id")


@query(
    "win_drop_first",
    with_blocks(
        "SELECT doc_id, line_no FROM (SELECT *, min(line_no) OVER (PARTITION BY doc_id) AS first FROM lines "
        "WHERE NOT regexp_matches(text, '^[A-D]')) WHERE line_no <> first",
        "lines",
    ),
)
def win_drop_first(spark, folder):
    lines = tokens.explode_lines(catalog.documents(spark, folder).select("doc_id", "text"))
    body = lines.filter(~F.col("text").rlike(HEADER)).select("doc_id", "line_no")
    return grouped.attach(body, ["doc_id"], F.min("line_no").alias("first")).filter("line_no <> first").drop("first")


@query(
    "win_group_share",
    "SELECT source, lang, n, CAST(sum(n) OVER (PARTITION BY source) AS BIGINT) AS sum_n, "
    f"round(n::DOUBLE / sum(n) OVER (PARTITION BY source), {DIGITS}) AS proportion "
    "FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL)",
)
def win_group_share(spark, folder):
    counts = _docs(spark, folder).groupBy("source", "lang").agg(F.count("*").alias("n"))
    return grouped.share(counts, "n", ["source"]).withColumn("proportion", _r("proportion"))


@query(
    "win_group_mean",
    f"SELECT doc_id, source, n_chars, round(avg(n_chars) OVER (PARTITION BY source), {DIGITS}) AS mean FROM documents",
)
def win_group_mean(spark, folder):
    df = _docs(spark, folder).select("doc_id", "source", "n_chars")
    return grouped.attach(df, ["source"], _r(F.avg("n_chars"), "mean"))


@query(
    "win_col_normalize",
    "SELECT source, lang, round((n + 1)::DOUBLE / (sum(n + 1) OVER ())::DOUBLE, 10) AS n FROM "
    "(SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL)",
)
def win_col_normalize(spark, folder):
    counts = _docs(spark, folder).groupBy("source", "lang").agg(F.count("*").alias("n"))
    return grouped.add_one_share(counts, ["n"]).withColumn("n", F.round("n", 10))


@query(
    "win_topn_ties",
    with_blocks(
        "SELECT source, word, n FROM (SELECT *, rank() OVER (PARTITION BY source ORDER BY n DESC) AS rk FROM "
        "(SELECT source, word, CAST(count(*) AS BIGINT) AS n FROM tok GROUP BY ALL)) WHERE rk <= 15",
        "tok",
    ),
)
def win_topn_ties(spark, folder):
    counts = tokens.term_counts(
        tokens.explode_words(catalog.documents(spark, folder).select("source", "text")), ["source"]
    )
    return grouped.top_n_ties(counts, ["source"], F.desc("n"), 15)


@query(
    "win_rev_order",
    "SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id DESC) AS rev_order FROM documents",
)
def win_rev_order(spark, folder):
    df = _docs(spark, folder).select("doc_id", "n_chars").withColumn("back", -F.col("doc_id"))
    return ordered.global_row_number(df, "back", ["back"], "rev_order").drop("back")


@query(
    "win_reorder_levels",
    "SELECT f.source, round(avg(b.doc_id), 8) AS level_value, row_number() OVER (ORDER BY round(avg(b.doc_id), 8), f.source) AS level_no FROM "
    "(SELECT source, row_number() OVER (ORDER BY doc_id) AS i FROM documents) f JOIN "
    "(SELECT doc_id, row_number() OVER (ORDER BY doc_id DESC) AS i FROM documents) b ON f.i = b.i GROUP BY f.source",
)
def win_reorder_levels(spark, folder):
    """Levels by the mean of the reversed covariate vector (i-th row takes the i-th value from the end)."""
    df = _docs(spark, folder).select("doc_id", "source")
    forward = ordered.global_row_number(df, "doc_id", ["doc_id"], "i")
    back = ordered.global_row_number(df.select((-F.col("doc_id")).alias("back")), "back", ["back"], "i")
    paired = forward.select("i", "source").join(back.select("i", (-F.col("back")).alias("value")), "i")
    levels = grouped.level_order(paired, "source", "value")
    return levels.withColumn("level_value", F.round("level_value", 8))


# --- sort and top k --------------------------------------------------------------------


@query(
    "sort_arrange",
    with_blocks(
        "SELECT word, n, CAST(rank() OVER (ORDER BY n DESC) AS BIGINT) AS place FROM (SELECT word, CAST(count(*) AS BIGINT) AS n FROM tok GROUP BY word)",
        "tok",
    ),
)
def sort_arrange(spark, folder):
    counts = tokens.term_counts(tokens.explode_words(catalog.documents(spark, folder).select("text")), [])
    return ordered.value_rank(counts, "n", "place", descending=True).orderBy(F.desc("n"), "word")


@query(
    "topk_extremes",
    "SELECT * FROM (SELECT 'low' AS side, doc_id, n_chars FROM documents ORDER BY n_chars, doc_id LIMIT 3) UNION ALL "
    "SELECT * FROM (SELECT 'high' AS side, doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 3)",
)
def topk_extremes(spark, folder):
    df = _docs(spark, folder).select("doc_id", "n_chars")
    low = df.orderBy("n_chars", "doc_id").limit(3).select(F.lit("low").alias("side"), "*")
    high = df.orderBy(F.desc("n_chars"), "doc_id").limit(3).select(F.lit("high").alias("side"), "*")
    return low.unionByName(high)


@query("setdiff_cols", "SELECT doc_id, n_chars, source FROM documents")
def setdiff_cols(spark, folder):
    df = _docs(spark, folder)
    response = ["lang"]
    return df.select(*[c for c in df.columns if c not in response])


# --- scalar functions ------------------------------------------------------------------


@query(
    "str_count",
    r"SELECT doc_id, CAST(len(regexp_extract_all(text, '\.|!')) AS INTEGER) AS n_stops, "
    f"CAST(len(regexp_extract_all(text, {NON_WORD})) AS INTEGER) AS n_words FROM documents",
)
def str_count(spark, folder):
    docs = catalog.documents(spark, folder)
    return docs.select("doc_id", X.n_stops("text").alias("n_stops"), X.n_separators("text").alias("n_words"))


@query(
    "str_remove_all",
    "SELECT doc_id, length(regexp_replace(text, 'NA|Applause|[0-9]|_', '', 'g')) AS kept, "
    "md5(regexp_replace(text, 'NA|Applause|[0-9]|_', '', 'g')) AS digest FROM documents",
)
def str_remove_all(spark, folder):
    kept = X.remove_all("text", X.CLEAN_CHARS)
    return catalog.documents(spark, folder).select("doc_id", F.length(kept).alias("kept"), F.md5(kept).alias("digest"))


@query(
    "str_replace",
    "SELECT doc_id, regexp_replace(source, 'src', '') AS source_no, md5(regexp_replace(text, 'the', '')) AS digest FROM documents",
)
def str_replace(spark, folder):
    return catalog.documents(spark, folder).select(
        "doc_id", X.replace_first("source", "src", "").alias("source_no"), F.md5(X.replace_first("text", "the", "")).alias("digest")
    )


@query(
    "str_split_len",
    "SELECT doc_id, CAST(len(string_split(text, ' ')) AS INTEGER) AS pieces, CAST(length(text) AS INTEGER) AS chars, "
    "CAST(list_max(list_transform(string_split(text, ' '), lambda s: length(s))) AS INTEGER) AS longest FROM documents",
)
def str_split_len(spark, folder):
    pieces = X.split_blank("text")
    return catalog.documents(spark, folder).select(
        "doc_id",
        F.size(pieces).alias("pieces"),
        F.length("text").alias("chars"),
        F.array_max(F.transform(pieces, F.length)).alias("longest"),
    )


@query("str_paste", "SELECT doc_id, 'Topic ' || doc_id AS topic, concat_ws(' ', source, lang) AS label FROM documents")
def str_paste(spark, folder):
    return _docs(spark, folder).select(
        "doc_id", F.concat(F.lit("Topic "), F.col("doc_id").cast("string")).alias("topic"), F.concat_ws(" ", "source", "lang").alias("label")
    )


@query(
    "date_mdy",
    "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS long_form, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS short_form, "
    "CAST(NULL AS VARCHAR) AS broken FROM orders",
)
def date_mdy(spark, folder):
    day = F.col("o_orderdate")
    return catalog.table(spark, folder, "orders").select(
        "o_orderkey",
        scalars.mdy(F.date_format(day, "MMMM d, yyyy")).cast("string").alias("long_form"),
        scalars.mdy(F.date_format(day, "M/d/yyyy")).cast("string").alias("short_form"),
        scalars.mdy(F.col("o_orderpriority")).cast("string").alias("broken"),
    )


@query(
    "date_to_number",
    "SELECT o_orderkey, CAST(datediff('day', DATE '1790-01-08', CAST(o_orderdate AS DATE)) AS INTEGER) AS day_no FROM orders",
)
def date_to_number(spark, folder):
    day = F.col("o_orderdate").cast("date")
    return catalog.table(spark, folder, "orders").select("o_orderkey", scalars.date_number(day).alias("day_no"))


@query(
    "math_log",
    "SELECT doc_id, round(log2(n_chars + 1.0), 8) AS log2, round(ln(n_chars + 1.0), 8) AS ln, abs(500 - n_chars) AS abs, "
    "round(-(n_chars / (doc_id + 1.0::DOUBLE)), 7) AS rounded, round(n_chars / nullif(doc_id, 0)::DOUBLE, 6) AS ratio FROM documents",
)
def math_log(spark, folder):
    n = F.col("n_chars").cast("double")
    return _docs(spark, folder).select(
        "doc_id",
        F.round(F.log2(n + 1), 8).alias("log2"),
        F.round(F.ln(n + 1), 8).alias("ln"),
        F.abs(F.lit(500) - F.col("n_chars")).alias("abs"),
        F.round(-(n / (F.col("doc_id") + F.lit(1.0))), 7).alias("rounded"),
        F.round(scalars.ratio(n, F.col("doc_id")), 6).alias("ratio"),
    )


@query(
    "math_lfactorial",
    "SELECT p_partkey, round(lgamma(p_size + 1), 6) AS lfact FROM part",
)
def math_lfactorial(spark, folder):
    return catalog.table(spark, folder, "part").select(
        "p_partkey", F.round(scalars.log_factorial(F.col("p_size")), 6).alias("lfact")
    )


@query(
    "seq_gen",
    "SELECT p_partkey, CAST(unnest(range(2, p_size + 1, 2)) AS INTEGER) AS k FROM part",
)
def seq_gen(spark, folder):
    parts = catalog.table(spark, folder, "part").filter("p_size >= 2")
    return parts.select("p_partkey", F.explode(F.sequence(F.lit(2), F.col("p_size"), F.lit(2))).alias("k"))


@query(
    "udf_higher_order",
    "SELECT doc_id, CAST(list_sum(list_transform(string_split(text, ' '), lambda s: length(s))) AS INTEGER) AS total, "
    "CAST(len(list_filter(string_split(text, ' '), lambda s: length(s) > 6)) AS INTEGER) AS long_pieces FROM documents",
)
def udf_higher_order(spark, folder):
    pieces = X.split_blank("text")
    total = F.aggregate(F.transform(pieces, F.length), F.lit(0), lambda a, b: a + b)
    long_pieces = F.size(F.filter(pieces, lambda s: F.length(s) > 6))
    return catalog.documents(spark, folder).select("doc_id", total.alias("total"), long_pieces.alias("long_pieces"))
