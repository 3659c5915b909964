"""Queries of whole notes, merged descriptions, outliers of topics and points of concepts."""

from pyspark.sql import functions as F

from lorespark.operators import concepts, notes, retrieval, topics
from lorespark.plans.q_graph import _TASKS, _tasks
from lorespark.plans.registry import query, table


@query("SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS daily, strftime(o_orderdate, '%G-W%V') AS weekly, strftime(o_orderdate, '%Y-%m') AS monthly FROM orders")
def period_labels(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(notes.period_labels(F.col("o_orderdate").cast("date")).alias("p")).distinct().select("p.*")


_MEANS = """WITH d AS (SELECT ts::DATE AS day, count(*) FILTER (event_type = 'view') AS sleep_minutes, avg(CASE WHEN event_type = 'click' THEN value END) AS energy FROM events GROUP BY 1),
w AS (SELECT strftime(ts, '%G-W%V') AS week, max(value) AS week_mark FROM events GROUP BY 1)
SELECT (SELECT coalesce(round(avg(sleep_minutes), 6), 0) FROM d) AS sleep_minutes, (SELECT coalesce(round(avg(energy), 6), 0) FROM d) AS energy, (SELECT coalesce(round(avg(week_mark), 6), 0) FROM w) AS week_mark"""


@query(_MEANS)
def vault_means(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    days = rows.groupBy(F.to_date("ts").alias("day")).agg(F.count_if(F.col("event_type") == "view").alias("sleep_minutes"), F.avg(F.when(F.col("event_type") == "click", F.col("value"))).alias("energy"))
    weeks = rows.groupBy(notes.period_labels(F.to_date("ts"))["weekly"].alias("week")).agg(F.max("value").alias("week_mark"))
    return notes.vault_means(days, weeks)


@query(_TASKS + "SELECT pos, CASE WHEN person = 'c1' THEN 'c2' WHEN person = 'c2' THEN 'c2' ELSE person || ',c2' END AS people FROM t")
def task_people(spark, sf_dir):
    return notes.change_people(_tasks(spark, sf_dir), ["c2"], ["c1"]).select("pos", F.array_join("people", ",").alias("people"))


_LIST = """, n AS (SELECT *, row_number() OVER (PARTITION BY source_date ORDER BY pos) AS k FROM t)
SELECT source_date, string_agg(CASE WHEN k <= 3 THEN '- [' || CASE WHEN status = 'done' THEN 'x' ELSE ' ' END || '] o' || pos || ' — ' || person END, chr(10) ORDER BY k) || CASE WHEN count(*) > 3 THEN chr(10) || '… ' || (count(*) - 3) ELSE '' END AS markdown FROM n GROUP BY source_date"""


@query(_TASKS + _LIST)
def task_list(spark, sf_dir):
    rows = _tasks(spark, sf_dir).withColumn("text", F.concat(F.lit("o"), F.col("pos").cast("string")))
    return notes.as_markdown(rows, ["source_date"], ["pos"], 3)


@query("SELECT p_brand AS concept_id, string_agg(d, '; ' ORDER BY d) AS description FROM (SELECT DISTINCT p_brand, p_type AS d FROM part) GROUP BY p_brand")
def concept_descriptions(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("concept_id"), F.col("p_type").alias("word"), F.col("p_type").alias("description"))
    return concepts.described(rows)


_BATCHES = """WITH RECURSIVE s AS (SELECT conv_id, turn, len(coalesce(text, '')) + 1 AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
f AS (SELECT conv_id, turn, k, n AS used, 0 AS batch FROM s WHERE k = 1 UNION ALL
SELECT s.conv_id, s.turn, s.k, CASE WHEN f.used + s.n > 300 THEN s.n ELSE f.used + s.n END, f.batch + CASE WHEN f.used + s.n > 300 THEN 1 ELSE 0 END FROM f JOIN s ON s.conv_id = f.conv_id AND s.k = f.k + 1)
SELECT conv_id, turn, batch::BIGINT AS batch FROM f"""


@query(_BATCHES)
def prompt_batches(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return concepts.prompt_batches(rows, ["conv_id"], ["turn"], 200).select("conv_id", "turn", "batch")


@query("SELECT conv_id, turn, v[1] AS first, len(v) AS n FROM (SELECT conv_id, turn, list_filter(['First about ' || role, 'Then ' || turn, 'x'], lambda x: len(x) > 5) AS v FROM conversations)")
def query_variants(spark, sf_dir):
    answer = F.concat(F.lit("1. First about "), "role", F.lit("\n2) Then "), F.col("turn").cast("string"), F.lit("\n\n- x"))
    found = retrieval.variants(answer)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", found.alias("v")).select("conv_id", "turn", F.get("v", F.lit(0)).alias("first"), F.size("v").cast("long").alias("n"))


_OUTLIERS = """WITH a AS (SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN -1 ELSE label END AS topic, embedding FROM embeddings),
f AS (SELECT topic, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS p FROM a WHERE topic >= 0), m AS (SELECT topic, p, avg(x) AS x FROM f GROUP BY topic, p), c AS (SELECT topic, list(x ORDER BY p) AS v FROM m GROUP BY topic),
r AS (SELECT vec_id, c.topic AS near, round(list_cosine_similarity(embedding::DOUBLE[], v), 6) AS score, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], v), 6) DESC, c.topic) AS k FROM a, c WHERE a.topic = -1)
SELECT a.vec_id, CASE WHEN a.topic = -1 AND r.score >= 0.3 THEN r.near ELSE a.topic END::INTEGER AS topic FROM a LEFT JOIN r ON r.vec_id = a.vec_id AND r.k = 1"""


@query(_OUTLIERS)
def outlier_reassign(spark, sf_dir):
    points = table(spark, sf_dir, "embeddings")
    assigned = points.select("vec_id", F.when(F.col("vec_id") % 5 == 0, -1).otherwise(F.col("label")).cast("int").alias("topic"))
    return topics.reassign(spark, assigned, points, 0.3, "vec_id")


@query("SELECT source_id, target_id FROM (SELECT DISTINCT o_custkey AS source_id, l_suppkey AS target_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey) WHERE source_id % 7 <> 0 AND target_id % 7 <> 0")
def relations_after_delete(spark, sf_dir):
    """Relations of all line items that stay when concepts go."""
    bought = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    relations = bought.select(F.col("o_custkey").alias("source_id"), F.col("l_suppkey").alias("target_id")).distinct()
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("concept_id")).union(table(spark, sf_dir, "supplier").select("s_suppkey"))
    return concepts.delete_concepts(ids, relations, ids.where("concept_id % 7 = 0"))[1]
