"""Queries of the composed operators: trees, concepts, notes, inspection."""

from pyspark.sql import functions as F

from lorespark.functions import text, vectors
from lorespark.operators import blocks, clustering, concepts, graph, keywords, notes, retrieval, topics
from lorespark.plans.registry import query, table
from lorespark.sources import readers


@query()
def summary_tree(spark, sf_dir):
    """Trees over the paragraphs of pages, an article for each page."""
    rows = blocks.html_blocks(table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("article_id"), "html")).where("type = 'paragraph'")
    leaves = rows.select("article_id", F.format_string("%s_chunk_%03d", "article_id", "pos").alias("node_id"), "text", vectors.counted_characters(F.col("text")).alias("embedding"))
    return clustering.summary_tree(leaves, clustering.character_vector)


def _members(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    tops = keywords.top_tfidf(docs, 5)
    joined = tops.join(docs.select("doc_id", "lang", "source"), "doc_id")
    return joined.select("word", F.col("source").alias("article_id"), F.col("lang").alias("category"), F.least(F.lit(1.0), F.col("tf") / 10).alias("confidence"), F.lit("v1").alias("version"), F.col("doc_id").alias("pos"), vectors.character_embedding(F.col("word")).alias("embedding"))


@query()
def concept_build(spark, sf_dir):
    members = _members(spark, sf_dir)
    pairs = keywords.cooccurrence(members.select(F.col("pos").alias("doc_id"), "word"))
    edges = pairs.select("subject", F.lit("with").alias("predicate"), "object", F.least(F.lit(1.0), F.col("n") / 5).alias("confidence"))
    return concepts.build(members, edges, 0.85)[0]


@query()
def concept_relations(spark, sf_dir):
    members = _members(spark, sf_dir)
    pairs = keywords.cooccurrence(members.select(F.col("pos").alias("doc_id"), "word"))
    edges = pairs.select("subject", F.lit("with").alias("predicate"), "object", F.least(F.lit(1.0), F.col("n") / 5).alias("confidence"))
    return concepts.build(members, edges, 0.85)[1]


_CENTRES = """WITH f AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS p FROM embeddings WHERE vec_id % 2 = 0),
m AS (SELECT label, p, avg(x) AS x FROM f GROUP BY label, p), c AS (SELECT label, list(x ORDER BY p) AS v FROM m GROUP BY label),
s AS (SELECT vec_id, c.label, round(list_dot_product(embedding::DOUBLE[], v) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(v, v)) + 1e-8), 6) AS score FROM embeddings, c WHERE vec_id % 2 = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS k FROM s) """


@query(_CENTRES + "SELECT vec_id, label::VARCHAR AS best, score, CASE WHEN score >= 0.4 THEN 'direct' WHEN score >= 0.3 THEN 'candidate' ELSE 'unmatched' END AS kind, CASE WHEN score >= 0.4 THEN label::VARCHAR END AS concept_id FROM r WHERE k = 1")
def concept_expand(spark, sf_dir):
    points = table(spark, sf_dir, "embeddings")
    known = retrieval.centroids(points.where("vec_id % 2 = 0"), "label").select(F.col("label").alias("concept_id"), F.col("centroid").alias("embedding"))
    new = points.where("vec_id % 2 = 1").select(F.col("vec_id").alias("word_id"), "embedding")
    return concepts.expand(spark, new, known, 0.4, 0.3).withColumnRenamed("word_id", "vec_id")


@query("SELECT source AS article_id, count(*) AS keywords, count(*) FILTER (n_chars < 500) AS need_description, count(*) FILTER (n_chars / 5000 >= 0.8) AS high, count(*) FILTER (n_chars / 5000 >= 0.5 AND n_chars / 5000 < 0.8) AS medium, count(*) FILTER (n_chars / 5000 > 0 AND n_chars / 5000 < 0.5) AS low, count(*) FILTER (n_chars = 0) AS zero, count(*) FILTER (n_chars < 500) + greatest(1, count(*) // 3) + 1 AS calls FROM documents GROUP BY source")
def concept_dry_run(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("article_id"), F.when(F.col("n_chars") >= 500, "described").alias("description"), (F.col("n_chars") / 5000).alias("confidence"))
    return concepts.dry_run(rows)


@query("SELECT source AS run_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT lang)), ',') AS domains, min(doc_id) AS began FROM documents GROUP BY source")
def run_history(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("run_id"), F.col("lang").alias("domain"), F.col("doc_id").alias("created_at"))
    return concepts.runs(rows).withColumn("domains", F.array_join("domains", ","))


@query("SELECT conv_id, arg_max(text, turn) AS broad, coalesce(arg_max(text, len(text) * 1000 + turn) FILTER (role = 'user'), arg_min(text, turn)) AS detail FROM conversations GROUP BY conv_id")
def broad_and_detail(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("chunk_id"), "text", F.when(F.col("role") == "user", 0).otherwise(F.col("turn") + 1).alias("level"), "turn", "role")
    broad = concepts.contexts(rows.withColumn("level", F.col("turn")), ["conv_id"]).select("conv_id", "broad")
    return broad.join(concepts.contexts(rows, ["conv_id"]).select("conv_id", "detail"), "conv_id")


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(len(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn) AS upto FROM conversations) WHERE upto <= 1000")
def prompt_budget(spark, sf_dir):
    return concepts.within_budget(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], 1000).select("conv_id", "turn")


@query("SELECT role, sum(ceil(len(text) / 2.5))::BIGINT AS total, count(*) AS calls FROM conversations GROUP BY ROLLUP (role)")
def token_usage(spark, sf_dir):
    n = text.tokens_estimate(F.col("text"))
    usage = table(spark, sf_dir, "conversations").select(F.col("role").alias("component"), n.alias("prompt"), F.lit(0).cast("long").alias("completion"), n.alias("total"), F.lit(1).alias("calls"))
    return readers.token_totals(usage).select(F.col("component").alias("role"), "total", "calls")


@query("SELECT page_id, '- [' || CASE WHEN page_id % 3 = 0 THEN 'x' ELSE ' ' END || '] visit [[' || page_id || ']] 📅 2025-01-' || lpad((page_id % 28 + 1)::VARCHAR, 2, '0') AS line FROM pages")
def task_lines(spark, sf_dir):
    day = F.make_date(F.lit(2025), F.lit(1), (F.col("page_id") % 28 + 1).cast("int"))
    status = F.when(F.col("page_id") % 3 == 0, "done").otherwise("open")
    line = text.task_line(status, F.lit(None).cast("string"), F.lit("visit"), F.array(F.col("page_id").cast("string")), {"due_date": day}, F.lit(None).cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", line.alias("line"))


@query("SELECT page_id, 'visit' AS text, CASE WHEN page_id % 3 = 0 THEN 'done' ELSE 'open' END AS status, page_id::VARCHAR AS people, DATE '2025-01-01' + (page_id % 28)::INTEGER AS due_date FROM pages")
def parsed_tasks(spark, sf_dir):
    t = text.task(F.col("line"), F.lit(""))
    return task_lines(spark, sf_dir).select("page_id", t.alias("t")).select("page_id", "t.text", "t.status", F.array_join("t.people", ",").alias("people"), "t.due_date")


@query(r"SELECT page_id, 'Page ' || page_id AS target, 'S' || page_id % 5 AS section, CASE WHEN page_id % 2 = 0 THEN 'name' ELSE 'S' || page_id % 5 END AS display FROM pages")
def wiki_links(spark, sf_dir):
    raw = F.concat(F.lit("see [[Page "), F.col("page_id").cast("string"), F.lit("#S"), (F.col("page_id") % 5).cast("string"), F.when(F.col("page_id") % 2 == 0, "|name").otherwise(""), F.lit("]]"))
    found = F.explode(text.links(raw)).alias("l")
    return table(spark, sf_dir, "pages").select("page_id", found).select("page_id", "l.target", "l.section", "l.display")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate >= DATE '1997-01-01' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50)")
def induced_edges(spark, sf_dir):
    """Edges with both ends among chosen nodes."""
    edges = table(spark, sf_dir, "orders").where("o_orderdate >= '1997-01-01'").select(F.col("o_orderkey").alias("a"), F.col("o_custkey").alias("b"))
    orders = table(spark, sf_dir, "lineitem").where("l_quantity = 50").select((-F.col("l_orderkey")).alias("node"))
    nodes = orders.union(table(spark, sf_dir, "customer").where("c_acctbal > 5000").select("c_custkey"))
    inside = graph.semi_both(edges.withColumn("a", -F.col("a")), nodes)
    return inside.select((-F.col("a")).alias("o_orderkey"), F.col("b").alias("o_custkey"))


@query("SELECT chunk_id, count(*) AS n FROM (SELECT CASE WHEN l_returnflag = 'N' THEN '(no chunk)' ELSE l_returnflag || l_linestatus END AS chunk_id FROM lineitem) GROUP BY chunk_id")
def relations_by_chunk(spark, sf_dir):
    chunks = F.when(F.col("l_returnflag") == "N", F.array().cast("array<string>")).otherwise(F.array(F.concat("l_returnflag", "l_linestatus")))
    return graph.by_chunk(table(spark, sf_dir, "lineitem").select(chunks.alias("chunk_ids")))


@query("SELECT page_id, round(minutes / 60.0, 6) AS hours, shown FROM (SELECT page_id, 300 + page_id AS minutes, ((300 + page_id) // 60) || ':' || lpad(((300 + page_id) % 60)::VARCHAR, 2, '0') AS shown FROM pages)")
def sleep_durations(spark, sf_dir):
    shown = text.sexagesimal((F.col("page_id") + 300).cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", F.round(text.minutes(shown) / 60, 6).alias("hours"), shown.alias("shown"))


@query()
def note_sections(spark, sf_dir):
    """Sections of notes made from conversations, a heading for each turn."""
    line = F.concat(F.lit("## "), "role", F.lit("\n- [ ] "), F.coalesce("text", F.lit("")), F.lit(" #t"), F.col("turn").cast("string"))
    made = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("note")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    return notes.tasks(notes.lines(made)).select("note", "pos", "text", "section", F.array_join("tags", ",").alias("tags"))


@query()
def topics_by_density(spark, sf_dir):
    """Topics whose number is found, with outliers; a plain version is in the tests."""
    return topics.density_model(table(spark, sf_dir, "documents"))
