"""Queries on documents, pages and conversations."""

from pyspark.sql import functions as F

from lorespark.functions import text
from lorespark.operators import blocks, chunking, keywords, sessions, topics
from lorespark.plans.registry import query, table
from lorespark.sources import readers


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query("SELECT lang, count(*) AS n, sum(ceil(len(text) / 2.5))::BIGINT AS tokens, max(ceil(len(text) / 2.5))::BIGINT AS longest FROM documents GROUP BY lang")
def token_estimate(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"), F.sum(text.tokens_estimate(F.col("text"))).alias("tokens"), F.max(text.tokens_estimate(F.col("text"))).alias("longest"))


_SENTENCES = r"WITH s AS (SELECT doc_id, lang, list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS l FROM documents) "


@query(_SENTENCES + "SELECT doc_id, pos::INTEGER AS pos, sentence FROM (SELECT doc_id, unnest(l) AS sentence, unnest(range(len(l))) AS pos FROM s)")
def sentence_split(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(chunking.sentences(F.col("text"))).alias("pos", "sentence"))


@query(_SENTENCES + "SELECT lang, sum(len(l))::BIGINT AS sentences, round(avg(len(l)), 6) AS mean FROM s GROUP BY lang")
def sentence_count_by_lang(spark, sf_dir):
    n = F.size(chunking.sentences(F.col("text")))
    return _docs(spark, sf_dir).groupBy("lang").agg(F.sum(n).alias("sentences"), F.round(F.avg(n), 6).alias("mean"))


@query(
    r"""WITH RECURSIVE s AS (SELECT doc_id, [len(x) for x in list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')] AS l FROM documents),
f AS (SELECT doc_id, l, 1 AS i, l[1] + 1 AS cur, 1 AS chunks FROM s WHERE len(l) > 0
  UNION ALL SELECT doc_id, l, i + 1, CASE WHEN cur + l[i + 1] + 2 <= 500 THEN cur + l[i + 1] + 1 ELSE l[i + 1] + 1 END,
    CASE WHEN cur + l[i + 1] + 2 <= 500 THEN chunks ELSE chunks + 1 END FROM f WHERE i < len(l))
SELECT doc_id, max(chunks)::INTEGER AS chunks FROM f GROUP BY doc_id"""
)
def pack_sentences_budget(spark, sf_dir):
    runs = chunking.pack(chunking.sentences(F.col("text")), 500)
    return _docs(spark, sf_dir).select("doc_id", F.size(runs).alias("chunks")).where("chunks > 0")


@query("SELECT text_hash, n, first_id FROM (SELECT md5(text) AS text_hash, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY text) WHERE n > 1")
def duplicate_documents(spark, sf_dir):
    rows = _docs(spark, sf_dir).select(F.md5(F.col("text").cast("binary")).alias("text_hash"), "doc_id")
    firsts = readers.first_of(rows, "text_hash", ["doc_id"], "text_hash").withColumnRenamed("doc_id", "first_id")
    return keywords.duplicates(rows, "text_hash").join(firsts, "text_hash").select("text_hash", "n", "first_id")


@query("SELECT source, count(*) AS n, sum(len(text))::BIGINT AS chars, round(avg(len(text)), 6) AS mean, count(DISTINCT lang) AS langs FROM documents GROUP BY source")
def doc_stats_by_source(spark, sf_dir):
    size = F.length("text")
    return _docs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.sum(size).cast("long").alias("chars"), F.round(F.avg(size), 6).alias("mean"), F.countDistinct("lang").alias("langs"))


@query("SELECT doc_id, source, lang FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents WHERE trim(text) <> '') WHERE k = 1")
def first_article_wins(spark, sf_dir):
    # a text by its digest, so that no text is shuffled
    rows = _docs(spark, sf_dir).select("doc_id", "source", "lang", F.md5(F.col("text").cast("binary")).alias("article_id"), F.substring(F.trim("text"), 1, 1).alias("sign"))
    return readers.first_of(rows, "article_id", ["doc_id"], "sign").select("doc_id", "source", "lang")


@query("SELECT page_id, pos, href, label FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)</a>', 2)) AS label, unnest(range(len(regexp_extract_all(html, '<a href=\"([^\"]*)\">', 1))))::INTEGER AS pos FROM pages)")
def page_links(spark, sf_dir):
    return blocks.page_links(table(spark, sf_dir, "pages"), "page_id")


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS heading, regexp_extract(html, '<html lang=\"([a-z]*)\"', 1) AS lang FROM pages")
def page_titles(spark, sf_dir):
    cut = lambda p: F.regexp_extract("html", p, 1)
    return table(spark, sf_dir, "pages").select("page_id", cut("<title>([^<]*)</title>").alias("title"), cut("<h1>([^<]*)</h1>").alias("heading"), cut('<html lang="([a-z]*)"').alias("lang"))


@query("SELECT page_id, len(regexp_extract_all(html, '<p>')) AS paragraphs, len(regexp_extract_all(html, '<(?:script|style)>')) AS stripped FROM pages")
def page_paragraphs(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_count("html", F.lit("<p>")).cast("long").alias("paragraphs"), F.regexp_count("html", F.lit("<(?:script|style)>")).cast("long").alias("stripped"))


@query(
    "SELECT article, version, n FROM (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS article, coalesce(nullif(regexp_extract(url, '/([0-9]+)(?:[.?#]|$)', 1), ''), '-') AS version, count(*) AS n FROM pages GROUP BY 1, 2)"
)
def page_url_version(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    number = F.coalesce(F.nullif(F.regexp_extract("url", "/([0-9]+)(?:[.?#]|$)", 1), F.lit("")), F.lit("-"))
    return pages.groupBy(F.regexp_extract("url", "://([^/?#]*)", 1).alias("article"), number.alias("version")).agg(F.count("*").alias("n"))


@query()
def html_blocks(spark, sf_dir):
    return blocks.html_blocks(table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("article_id"), "html"))


@query()
def section_chunks(spark, sf_dir):
    return chunking.section_chunks(html_blocks(spark, sf_dir), 2000)


@query()
def semantic_chunks(spark, sf_dir):
    return chunking.semantic_chunks(html_blocks(spark, sf_dir), 0.8)


@query()
def hybrid_chunks(spark, sf_dir):
    return chunking.hybrid_chunks(_docs(spark, sf_dir).select(F.col("doc_id").alias("article_id"), "text"), 2000, 0.6)


@query(
    """SELECT conv_id, turn, role, section FROM (SELECT conv_id, turn, role,
  last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::VARCHAR AS section FROM conversations)"""
)
def header_carry(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumns({"type": F.when(F.col("role") == "user", "header").otherwise("paragraph"), "mark": F.col("turn").cast("string")})
    return chunking.carry_header(rows, "conv_id", "turn", "type", "mark").select("conv_id", "turn", "role", "section")


@query("SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS asked, sum(len(text))::BIGINT AS chars, first(role ORDER BY turn) AS opened_by FROM conversations GROUP BY conv_id")
def conversation_turns(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rows.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("asked"), F.sum(F.length("text")).cast("long").alias("chars"), F.min_by("role", "turn").alias("opened_by"))


_GAP = """WITH l AS (SELECT event_id, user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
i AS (SELECT *, sum(CASE WHEN date_sub('second', p, ts) > 43200 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS island FROM l) """


@query(_GAP + "SELECT user_id, island, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM i GROUP BY user_id, island")
def segment_merge(spark, sf_dir):
    gap = F.timestamp_diff("SECOND", F.col("_prev.ts"), F.col("ts"))
    cut = sessions.islands(table(spark, sf_dir, "events").select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"], gap, 43200)
    return cut.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


# --- keywords -------------------------------------------------------------------------

_WORDS = r"""WITH w AS (SELECT doc_id, source, unnest(string_split_regex(lower(text), '[^\p{L}\p{N}]+')) AS word FROM documents),
tf AS (SELECT doc_id, word, count(*) AS tf FROM w WHERE len(word) >= 4 GROUP BY ALL) """
_SCORED = _WORDS + ", df AS (SELECT word, count(*) AS df FROM tf GROUP BY word), sc AS (SELECT doc_id, word, tf, round(tf * ln((SELECT count(*) + 1 FROM documents) / (df + 1)), 6) AS score FROM tf JOIN df USING (word)), top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, word) AS rank FROM sc) WHERE rank <= 5) "
_MENTIONS = _SCORED + ", m AS (SELECT doc_id, doc_id % 50 AS article_id, word, least(1.0, tf / 10) AS confidence FROM top) "


def _tops(spark, sf_dir, most=5):
    return keywords.top_tfidf(_docs(spark, sf_dir), most)


def _mentions(spark, sf_dir):
    return _tops(spark, sf_dir).select("doc_id", (F.col("doc_id") % 50).alias("article_id"), "word", F.least(F.lit(1.0), F.col("tf") / 10).alias("confidence"))


@query(_WORDS + "SELECT word, sum(tf)::BIGINT AS n, count(*) AS docs FROM tf GROUP BY word HAVING count(*) >= 20")
def keyword_tf(spark, sf_dir):
    return keywords.mentions(_docs(spark, sf_dir)).groupBy("word").agg(F.sum("tf").alias("n"), F.count("*").alias("docs")).where("docs >= 20")


@query(_SCORED + "SELECT doc_id, word, score, rank FROM top")
def keyword_tfidf_topn(spark, sf_dir):
    return _tops(spark, sf_dir).select("doc_id", "word", "score", "rank")


@query(
    _WORDS
    + ", c AS (SELECT source, word, count(*) AS tf FROM w WHERE len(word) >= 4 GROUP BY ALL), f AS (SELECT word, sum(tf) AS f FROM c GROUP BY word), a AS (SELECT avg(n) AS a FROM (SELECT sum(tf) AS n FROM c GROUP BY source)), s AS (SELECT source, word, tf, round(tf * ln(1 + a / f), 6) AS score FROM c JOIN f USING (word), a) SELECT source, word, tf, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, word) AS rank FROM s) WHERE rank <= 10"
)
def ctfidf_by_source(spark, sf_dir):
    return keywords.top_words(keywords.class_tfidf(keywords.mentions(_docs(spark, sf_dir), "source"), "source"), 10, "source").select("source", "word", "tf", "score", "rank")


@query(_MENTIONS + "SELECT word, article_id, max(confidence) AS confidence, array_to_string(list_sort(list(DISTINCT doc_id)), ',') AS chunks FROM m GROUP BY word, article_id")
def keyword_merge_max_conf(spark, sf_dir):
    from lorespark.operators import graph

    merged = graph.merge_edges(_mentions(spark, sf_dir), ["word", "article_id"], "doc_id")
    return merged.select("word", "article_id", "confidence", F.array_join(F.col("chunk_ids").cast("array<string>"), ",").alias("chunks"))


@query(_MENTIONS + "SELECT a.word AS subject, b.word AS object, count(*) AS n FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.word < b.word GROUP BY ALL")
def cooccurrence_relations(spark, sf_dir):
    return keywords.cooccurrence(_tops(spark, sf_dir))


@query(_MENTIONS + "SELECT count(*) FILTER (confidence >= 0.8) AS high, count(*) FILTER (confidence >= 0.5 AND confidence < 0.8) AS medium, count(*) FILTER (confidence > 0 AND confidence < 0.5) AS low, count(*) FILTER (confidence = 0) AS zero FROM m")
def confidence_histogram(spark, sf_dir):
    return keywords.histogram(_mentions(spark, sf_dir))


@query(_MENTIONS + "SELECT lower(word) AS key, article_id, arg_min(word, doc_id) AS word, max(confidence) AS confidence FROM m GROUP BY lower(word), article_id")
def dedup_word_article(spark, sf_dir):
    return keywords.dedup(_mentions(spark, sf_dir), F.col("doc_id"))


@query(_MENTIONS + "SELECT article_id, word FROM (SELECT article_id, word, row_number() OVER (PARTITION BY article_id ORDER BY confidence DESC, word, doc_id) AS k FROM m WHERE confidence >= 0.3 AND word NOT IN ('this', 'with', 'that')) WHERE k <= 3")
def confident_keywords(spark, sf_dir):
    protected = spark.createDataFrame([("This",), ("with",), ("THAT",)], "word string")
    return keywords.confident(keywords.unprotected(_mentions(spark, sf_dir), protected), 0.3, 3, ["article_id"], [F.desc("confidence"), "word", "doc_id"]).select("article_id", "word")


@query(
    "WITH c AS (SELECT source, lang, count(*) AS n, min(doc_id) AS f FROM documents GROUP BY ALL) SELECT source, arg_max(lang, n * 1000000000 - f) AS lang FROM c GROUP BY source"
)
def most_frequent_language(spark, sf_dir):
    return keywords.most_frequent(_docs(spark, sf_dir), ["source"], "lang", "doc_id")


@query()
def topic_model(spark, sf_dir):
    return topics.model(_docs(spark, sf_dir), topics=8)
