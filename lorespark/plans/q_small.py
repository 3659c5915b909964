"""Queries of the smaller operators: rendering, note parts, permissions, graph joins, versions, readers."""


from pyspark.sql import functions as F

from lorespark.functions import recurrence, text, vectors
from lorespark.operators import acl, chunking, concepts, finance, graph, keywords, notes, retrieval, sessions, tables, topics
from lorespark.plans.q_graph import _TASKS, _tasks
from lorespark.plans.registry import query, table
from lorespark.sources import readers
from lorespark.sources.keyed import KeyedTable


def _pages(spark, sf_dir, *more):
    return table(spark, sf_dir, "pages").select("page_id", *more)


def _s(column):
    return F.col(column).cast("string")


# --- text expressions -----------------------------------------------------------------


@query("SELECT page_id, '**_' || page_id || '** [`p' || page_id || '`](/' || page_id || ')' AS shown, repeat('#', (page_id % 3 + 1)::INTEGER) || ' **_' || page_id || '** [`p' || page_id || '`](/' || page_id || ')' AS header FROM pages".replace("[`p' || page_id || '`]", "[p' || page_id || ']"))
def rendered_blocks(spark, sf_dir):
    """Inlines with marks, links and images, and the header made of them."""
    one = lambda kind, said, href, *marks: F.struct(F.lit(kind).alias("type"), said.alias("text"), href.alias("href"), F.array(*map(F.lit, marks)).cast("array<string>").alias("marks"))
    none = F.lit(None).cast("string")
    inlines = F.array(one("text", F.concat(F.lit("_"), _s("page_id")), none, "bold"), one("image", F.lit("seen"), none), one("link", F.concat(F.lit("p"), _s("page_id")), F.concat(F.lit("/"), _s("page_id"))), one("text", F.lit(""), none, "italic"))
    level = (F.col("page_id") % 3 + 1).cast("int")
    return _pages(spark, sf_dir).select("page_id", text.inline_text(inlines).alias("shown"), text.render_block(F.lit("header"), level, inlines).alias("header"))


@query("SELECT page_id, 'note ' || page_id AS article, CASE WHEN page_id % 2 = 0 THEN '20250101_12' || lpad((page_id % 10000)::VARCHAR, 4, '0') END AS version FROM pages")
def file_versions(spark, sf_dir):
    stamp = F.concat(F.lit("_20250101_12"), F.lpad((F.col("page_id") % 10000).cast("string"), 4, "0"))
    name = F.concat(F.lit("note "), _s("page_id"), F.when(F.col("page_id") % 2 == 0, F.concat(stamp, F.lit(".yaml"))).otherwise(".yml"))
    return _pages(spark, sf_dir, text.file_version(name).alias("v")).select("page_id", "v.article", "v.version")


@query("SELECT DISTINCT CASE WHEN source IS NULL THEN NULL WHEN right(source, 1) < '5' THEN upper(source) ELSE lower(source) END AS word FROM documents")
def normal_keywords(spark, sf_dir):
    """Abbreviations in capitals stay, other words are lower-cased, white space around them goes."""
    raw = F.when(F.right(F.col("source"), F.lit(1)) < "5", F.concat(F.lit(" "), F.upper("source"), F.lit(" "))).otherwise(F.concat(F.lit(" "), F.initcap("source")))
    return table(spark, sf_dir, "documents").select(text.normal_keyword(raw).alias("word")).distinct()


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'a, b|' || page_id ELSE 'a|b|' || page_id END AS parts, 'c|d' AS commas FROM pages")
def split_lists(spark, sf_dir):
    listed = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("a, b; ;"), _s("page_id"))).otherwise(F.concat(F.lit(" a ;b;;"), _s("page_id")))
    return _pages(spark, sf_dir, F.array_join(text.split_list(listed), "|").alias("parts"), F.array_join(text.split_list(F.lit("c,, d ,")), "|").alias("commas"))


@query("SELECT page_id, page_id % 6 < 4 AS truth, CASE WHEN page_id % 3 = 0 THEN 'Anna' WHEN page_id % 3 = 1 THEN 'Cher' ELSE 'A' END AS name FROM pages")
def small_values(spark, sf_dir):
    """Words for true, and first names."""
    words = F.array(F.lit("TRUE"), F.lit(" yes "), F.lit("1"), F.lit("Да"), F.lit("no"), F.lit(None).cast("string"))
    names = F.array(F.lit("Smith Anna"), F.lit(" Cher "), F.lit("A B C"))
    pick = lambda values, n: F.get(values, (F.col("page_id") % n).cast("int"))
    return _pages(spark, sf_dir, text.truth(pick(words, 6)).alias("truth"), text.first_name(pick(names, 3)).alias("name"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN '[{"a":' || page_id || '}]' WHEN 1 THEN '[{"a":' || page_id || '}]' WHEN 2 THEN '[1,' || page_id || ']' END AS json, CASE page_id % 4 WHEN 3 THEN 'no ' || page_id ELSE 'x' END AS bare FROM pages""")
def answers_repaired(spark, sf_dir):
    """JSON out of answers with thoughts, fences, commas too many, or none."""
    n = _s("page_id")
    kinds = F.array(F.concat(F.lit('<think>[1]</think>Sure: [{"a": '), n, F.lit("},]")), F.concat(F.lit('```json\n{"a": '), n, F.lit("}\n```")), F.concat(F.lit("so [1, "), n, F.lit("] it is")), F.concat(F.lit("no "), n))
    answer = F.get(kinds, (F.col("page_id") % 4).cast("int"))
    json = F.regexp_replace(text.repaired_json(answer), r"\s+|,(?=\])", "")
    bare = F.when(F.col("page_id") % 4 == 3, text.without_thoughts(F.concat(F.lit("<THINK>\nlong\n</THINK> "), answer))).otherwise("x")
    return _pages(spark, sf_dir, json.alias("json"), bare.alias("bare"))


@query("SELECT page_id, CASE WHEN page_id % 4 = 3 THEN 0 ELSE page_id END AS prompt, CASE WHEN page_id % 4 = 3 THEN 0 ELSE page_id + 1 END AS completion, CASE WHEN page_id % 4 = 3 THEN 0 ELSE 2 * page_id + 1 END AS total, 1::INTEGER AS calls FROM pages")
def answer_tokens(spark, sf_dir):
    a, b = _s("page_id"), (F.col("page_id") + 1).cast("string")
    kinds = F.array(
        F.format_string('{"usage_metadata": {"input_tokens": %s, "output_tokens": %s}}', a, b), F.format_string('{"usage": {"prompt_tokens": %s, "completion_tokens": %s}}', a, b),
        F.format_string('{"prompt_eval_count": %s, "eval_count": %s}', a, b), F.lit("plain"),
    )
    return _pages(spark, sf_dir, text.token_usage(F.get(kinds, (F.col("page_id") % 4).cast("int"))).alias("u")).select("page_id", "u.*")


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'normal' END AS priority, CASE page_id % 5 WHEN 0 THEN 'open' WHEN 1 THEN 'done' WHEN 2 THEN 'done' WHEN 3 THEN 'in_progress' ELSE 'cancelled' END AS status, 'call ' || page_id AS text, '10:00' AS starts, 'every day' AS rule, DATE '2025-12-31' AS until, 'later' AS comment, 'a,b/c' AS tags FROM pages")
def tasks_in_full(spark, sf_dir):
    """Task lines with every part; the sign of a priority goes before the section's."""
    mark = F.get(F.array(*map(F.lit, " xX/-")), (F.col("page_id") % 5).cast("int"))
    sign = F.get(F.array(F.lit("⏫ "), F.lit(""), F.lit("🔼 "), F.lit("")), (F.col("page_id") % 4).cast("int"))
    section = F.get(F.array(F.lit("Фокус дня"), F.lit("В фокусе: фокус"), F.lit("Фокус"), F.lit("Прочее")), (F.col("page_id") % 4).cast("int"))
    line = F.concat(F.lit("  - ["), mark, F.lit("] "), sign, F.lit("call "), _s("page_id"), F.lit(" 10:00-11:30 #a #b/c 🔁 every day until 2025-12-31 (later)"))
    t = text.task(line, section)
    return _pages(spark, sf_dir, t.alias("t")).select("page_id", "t.priority", "t.status", "t.text", F.col("t.time_slot.start").alias("starts"), F.col("t.recurrence.rule").alias("rule"), F.col("t.recurrence.until").alias("until"), F.col("t.inline_comment").alias("comment"), F.array_join("t.tags", ",").alias("tags"))


# --- parts of notes -------------------------------------------------------------------

_NOTE = "# Итоги {0}\n- plain {0}\n- [ ] task {0}\n```\n- code\n```\n## Инсайты\nweek-mark:: {1}\n7 из 10\n- last"


def _notes(spark, sf_dir):
    whole = F.replace(F.replace(F.lit(_NOTE), F.lit("{0}"), _s("page_id")), F.lit("{1}"), (F.col("page_id") % 9).cast("string"))
    return _pages(spark, sf_dir).select(F.col("page_id").alias("note"), whole.alias("text"))


@query("SELECT page_id AS note, unnest(['Итоги ' || page_id, 'Инсайты']) AS section, unnest(['plain ' || page_id, 'last']) AS item FROM pages")
def note_bullets(spark, sf_dir):
    return notes.bullets(notes.lines(_notes(spark, sf_dir))).select("note", "section", "item")


@query("SELECT page_id AS note, '# Итоги ' || page_id || chr(10) || '- plain ' || page_id || chr(10) || '- [ ] task ' || page_id || chr(10) || '## Инсайты' || chr(10) || 'week-mark:: ' || page_id % 9 || chr(10) || '7 из 10' || chr(10) || '- last' AS text FROM pages")
def notes_without_fences(spark, sf_dir):
    return notes.without_fences(notes.lines(_notes(spark, sf_dir)))


@query("SELECT page_id AS note, 'insights' AS kind, 'week-mark:: ' || page_id % 9 || chr(10) || '7 из 10' || chr(10) || '- last' AS text, (page_id % 9)::INTEGER AS week_mark, 7::INTEGER AS score FROM pages")
def note_kinds(spark, sf_dir):
    """What sections are about, with the week's mark and the month's score."""
    found = notes.sections(notes.lines(_notes(spark, sf_dir)), notes.WEEKLY_SECTIONS)
    return found.withColumns({"week_mark": notes.week_mark(F.col("text")), "score": notes.month_score(F.col("text"))})


@query("SELECT page_id AS note, replace(replace(n, '{0}', page_id::VARCHAR), '{1}', (page_id % 9)::VARCHAR) AS text FROM pages, (SELECT '" + _NOTE.replace("## Инсайты", "- new\n## Инсайты") + "' AS n)")
def note_appended(spark, sf_dir):
    """A line added at the end of each note's first section, before the next heading of its level (there is none of it: before the rule)."""
    lines = notes.lines(_notes(spark, sf_dir).withColumn("text", F.replace("text", F.lit("## Инсайты"), F.lit("# Инсайты"))))
    first = lines.where("pos = 0").select("note", F.col("section").alias("title"))
    marked = lines.join(first, "note").withColumn("section", F.when(F.col("section") == F.col("title"), "head").otherwise(F.col("section"))).drop("title")
    return notes.append_to_section(marked, "head", ["- new"]).withColumn("text", F.replace("text", F.lit("# Инсайты"), F.lit("## Инсайты")))


#: A note for each conversation: a section for each turn, of its whole text.
_TALKS = "SELECT conv_id AS note, string_agg('## ' || role || ' ' || turn || chr(10) || {body}, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id"


def _talks(spark, sf_dir):
    turn = F.concat(F.lit("## "), "role", F.lit(" "), F.col("turn").cast("string"), F.lit("\n"), F.coalesce("text", F.lit("")))
    parts = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("note")).agg(F.sort_array(F.collect_list(F.struct("turn", turn.alias("t")))).alias("p"))
    return parts.select("note", F.array_join(F.transform("p", lambda x: x["t"]), "\n").alias("text"))


@query(_TALKS.format(body="CASE WHEN role = 'assistant' AND turn = 1 THEN '- first' || chr(10) || '- second' ELSE coalesce(text, '') END"))
def section_set(spark, sf_dir):
    """The first answer of each conversation's note replaced, its heading kept."""
    return notes.set_section(notes.lines(_talks(spark, sf_dir)), "Assistant 1", ["- first", "- second"])


@query("SELECT note::VARCHAR AS note, '---' || chr(10) || 'sleep-duration: \"7:30\"' || chr(10) || 'morning-energy: 4' || chr(10) || '---' || chr(10) || text AS text FROM (" + _TALKS.format(body="coalesce(text, '')") + ")")
def measures_set(spark, sf_dir):
    """Measures put before the text of each note."""
    return notes.set_measures(_talks(spark, sf_dir), {"morning-energy": 4, "sleep-duration": "7:30"})


@query("WITH n AS (" + _TALKS.format(body="coalesce(text, '')") + ") SELECT note, text FROM n WHERE note % 2 = 0 UNION ALL SELECT note, '# ' || note || chr(10) AS text FROM n WHERE note % 2 <> 0")
def notes_ensured(spark, sf_dir):
    """Every second note is there; the others are made from a template."""
    talks = _talks(spark, sf_dir)
    return notes.ensure_notes(talks.where("note % 2 = 0"), talks.select("note"), "# {{note}}\n")


@query("SELECT page_id AS note, replace(replace(n, '{0}', page_id::VARCHAR), '{1}', (page_id % 9)::VARCHAR) AS text FROM pages, (SELECT '" + _NOTE.replace("- [ ] task", "- [x] task") + "' AS n)")
def note_task_done(spark, sf_dir):
    return notes.change_first_task(notes.lines(_notes(spark, sf_dir)), "TASK", lambda c: F.replace(c, F.lit("[ ]"), F.lit("[x]")))


@query(_TASKS + "SELECT pos, CASE WHEN priority = 'high' THEN 'high' ELSE priority END AS priority, CASE WHEN status = 'done' THEN 'done' ELSE 'todo' END AS status, source_date AS due FROM t")
def bot_tasks(spark, sf_dir):
    return notes.to_bot(_tasks(spark, sf_dir).withColumn("due_date", F.lit(None).cast("date"))).select("pos", "priority", "status", "due")


@query(_TASKS + "SELECT pos FROM t WHERE person = 'c7' OR pos % 100 = 0")
def tasks_of_person(spark, sf_dir):
    """Tasks with the person an alias means, among people or link targets."""
    people = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), _s("c_custkey")).alias("name"), F.lit(False).alias("is_group"))
    found = spark.createDataFrame([("Boss", "c7", 1)], "alias string, name string, pos long")
    link = F.struct(F.lit("C7").alias("target"), F.lit(None).cast("string").alias("section"), F.lit("he").alias("display"))
    linked = F.when(F.col("pos") % 100 == 0, F.array(link)).otherwise(F.array().cast("array<struct<target:string,section:string,display:string>>"))
    return notes.mentioning(_tasks(spark, sf_dir).withColumn("wiki_links", linked), "BOSS", notes.aliases(people, found)).select("pos")


@query(_TASKS + "SELECT source_date, string_agg(pos::VARCHAR, ',' ORDER BY pos % 3 = 0, pos % 24, pos) AS positions FROM t GROUP BY source_date".replace("pos % 3 = 0, pos % 24, pos", "pos % 3 = 0, CASE WHEN pos % 3 <> 0 THEN lpad((pos % 24)::VARCHAR, 2, '0') END, pos"))
def agenda_in_order(spark, sf_dir):
    """Tasks with a time come first, by time; the others as they stand."""
    slot = F.when(F.col("pos") % 3 != 0, F.struct(F.lpad((F.col("pos") % 24).cast("string"), 2, "0").alias("start"), F.lit("24:00").alias("end")))
    rows = notes.agenda_order(_tasks(spark, sf_dir).withColumn("time_slot", slot))
    placed = rows.withColumn("place", F.monotonically_increasing_id())
    return placed.groupBy("source_date").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "pos"))), lambda x: x["pos"].cast("string")), ",").alias("positions"))


@query("SELECT p_brand AS \"group\", 'm' || p_partkey AS person, p_type AS role FROM part")
def group_members(spark, sf_dir):
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name")).agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("m"), _s("p_partkey")), "p_type"))).alias("members"))
    return notes.members(rows)


@query(_TASKS + "SELECT pos, CASE WHEN pos % 2 = 0 THEN pos::VARCHAR END AS week FROM t")
def tasks_of_all_notes(spark, sf_dir):
    rows = _tasks(spark, sf_dir).select("pos")
    return notes.all_tasks(rows.where("pos % 2 = 1"), rows.where("pos % 2 = 0").withColumn("week", _s("pos")))


@query("SELECT n_nationkey, (DATE '2025-01-31' + n_nationkey::INTEGER + 1) AS daily, (DATE '2025-01-31' + n_nationkey::INTEGER + 1) AS weekly, (DATE '2025-01-31' + n_nationkey::INTEGER + 1 + CASE WHEN isodow(DATE '2025-01-31' + n_nationkey::INTEGER + 1) = 7 THEN 1 ELSE 0 END)::DATE AS weekday FROM nation".replace("CASE WHEN isodow(DATE '2025-01-31' + n_nationkey::INTEGER + 1) = 7 THEN 1 ELSE 0 END", "((8 - isodow(DATE '2025-01-31' + n_nationkey::INTEGER + 1)) % 7)::INTEGER"))
def recurrence_following(spark, sf_dir):
    """The first date after each day: the rule is counted from the next day on."""
    after = F.date_add(F.lit("2025-01-31").cast("date"), F.col("n_nationkey").cast("int"))
    rules = {"daily": "every 3 days", "weekly": "every week", "weekday": "every mon"}
    return table(spark, sf_dir, "nation").select("n_nationkey", *(recurrence.following(recurrence.parse(F.lit(r)), after).alias(n) for n, r in rules.items()))


# --- permissions ----------------------------------------------------------------------


@query("SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 15 ELSE 0 END::INTEGER AS bits FROM nation")
def permission_bits(spark, sf_dir):
    names = F.when(F.col("n_nationkey") % 3 == 0, F.array(F.lit("read"), F.lit("WRITE"))).when(F.col("n_nationkey") % 3 == 1, F.array(F.lit("ALL"), F.lit("READ"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "nation").select("n_nationkey", acl.permission_bits(names).alias("bits"))


@query("SELECT r_name AS role, n_name AS user FROM region JOIN nation ON n_regionkey = r_regionkey".replace("AS user", 'AS "user"'))
def roles_of_users(spark, sf_dir):
    held = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return acl.roles_of(held.groupBy(F.col("r_name").alias("role")).agg(F.collect_list("n_name").alias("users"))).select("role", "user")


_OWN = """WITH n AS (SELECT page_id, 'p/' || page_id AS path, page_id % 4 AS k FROM pages)
SELECT path, u AS "user", CASE WHEN k = 0 AND u = 'eve' THEN 0 WHEN k = 1 AND u = 'eve' THEN 3 WHEN k = 2 THEN 5 ELSE 1 END::INTEGER AS allowed FROM n, (VALUES ('ann'), ('eve')) v(u)"""


@query(_OWN)
def acl_inline_and_grants(spark, sf_dir):
    """Everyone may read; a note's own rules deny or allow one user, and grants are above both."""
    paths = _pages(spark, sf_dir, F.concat(F.lit("P\\"), _s("page_id")).alias("path"), (F.col("page_id") % 4).alias("k"))
    of = lambda users: F.array(*map(F.lit, users)).cast("array<string>")
    inline = acl.inline_rules(paths.where("k < 2").select("path", F.when(F.col("k") == 0, 15).otherwise(2).alias("perms"), (F.col("k") == 0).alias("deny"), of(["eve"]).alias("users"), of([]).alias("roles")))
    grants = paths.where("k = 2").select(F.concat(F.lit("g"), "path").alias("request_id"), "path", F.lit(4).alias("perms"), F.explode(of(["ann", "eve"])).alias("requester"))
    policy = spark.createDataFrame([acl.rule(1, allow=["READ"], priority=1, roles=["all"])], acl.RULES)
    rules = policy.unionByName(inline.select(policy.columns)).unionByName(acl.grant_rules(grants).select(policy.columns))
    roles = spark.createDataFrame([("ann", "all"), ("eve", "all")], "user string, role string")
    asked = paths.select(F.explode(of(["ann", "eve"])).alias("user"), "path")
    return acl.resolve(asked, rules, roles).select(F.lower(F.replace("path", F.lit("\\"), F.lit("/"))).alias("path"), "user", "allowed")


# --- graphs and keywords --------------------------------------------------------------


@query("SELECT l_orderkey, n FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) WHERE n > 1")
def duplicate_keys(spark, sf_dir):
    return keywords.duplicates(table(spark, sf_dir, "lineitem"), "l_orderkey")


@query("SELECT p_partkey, CASE WHEN p_brand = 'Brand#11' THEN 'eleven' ELSE p_brand END AS word FROM part")
def refined_words(spark, sf_dir):
    refined = spark.createDataFrame([("BRAND#11", "eleven"), ("other", "none")], "raw string, word string")
    return keywords.refine(table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("word")), refined)


@query("SELECT source AS article, lang || (doc_id % 90) AS raw, lang || (doc_id % 90) AS word FROM documents GROUP BY ALL")
def refined_in_batches(spark, sf_dir):
    """Keywords of each source in batches of fifty and again in batches of a hundred."""
    word = F.concat(F.lit("  "), F.upper("lang"), (F.col("doc_id") % 90).cast("string"))
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("article"), word.alias("word"), F.col("lang").alias("category"), F.col("doc_id").alias("pos"))
    return keywords.refine_batches(rows, "article").select("article", F.lower(F.trim("raw")).alias("raw"), "word")


@query("SELECT s_suppkey AS article_id, s_name AS name, CASE WHEN s_nationkey < 20 THEN n_name END AS place FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey")
def articles_with_metadata(spark, sf_dir):
    articles = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("article_id"), F.col("s_name").alias("name"), "s_nationkey")
    found = table(spark, sf_dir, "nation").where("n_nationkey < 20").join(articles, F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("article_id").alias("id"), F.lit("hidden").alias("name"), F.col("n_name").alias("place"))
    return readers.with_metadata(articles, found).select("article_id", "name", "place")


@query("SELECT ps AS article_id, l_partkey AS word, coalesce(c, 0.0) AS confidence, v AS version FROM (SELECT l_suppkey AS ps, l_partkey, max(CASE WHEN l_quantity > 10 THEN l_discount END) AS c FROM lineitem GROUP BY ALL) JOIN (SELECT s_suppkey, 'v' || s_nationkey AS v FROM supplier) ON s_suppkey = ps")
def article_keywords(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("article_id"), F.col("l_partkey").alias("word")).agg(F.max(F.when(F.col("l_quantity") > 10, F.col("l_discount"))).alias("confidence"))
    articles = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("article_id"), F.concat(F.lit("v"), _s("s_nationkey")).alias("version"))
    found = concepts.article_keywords(edges.withColumn("chunk_ids", F.lit(None).cast("array<string>")), articles)
    return found.where("size(chunk_ids) = 0").select("article_id", "word", "confidence", "version")


@query("SELECT p_partkey AS word, c AS confidence, coalesce(n, 0) AS n_edges FROM part LEFT JOIN (SELECT l_partkey, max(l_discount) AS c, count(*) AS n FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey")
def keyword_listing(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("word"), F.col("l_discount").alias("confidence"))
    return keywords.listing(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("word")), edges)


@query("SELECT l_orderkey AS edge_id, turn AS level, conv_id || '-' || turn AS node_id, CASE WHEN len(text) > 300 THEN text[1:300] || '…' ELSE text END AS text FROM (SELECT DISTINCT l_orderkey, l_orderkey % 100 AS c FROM lineitem) JOIN conversations ON conv_id = c AND turn < 3")
def provenance_of_edges(spark, sf_dir):
    """Chunks that edges hold in an array, looked up and shortened."""
    chunks = table(spark, sf_dir, "conversations").select(F.concat_ws("-", _s("conv_id"), _s("turn")).alias("node_id"), F.col("turn").alias("level"), "text")
    ids = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda t: F.concat_ws("-", (F.col("l_orderkey") % 100).cast("string"), t.cast("string")))
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("edge_id"), ids.alias("chunk_ids")).distinct()
    return concepts.provenance(edges, chunks).select("edge_id", "level", "node_id", "text")


@query("SELECT 'n' || n_nationkey AS concept_id, p_partkey AS word, s_suppkey AS article_id, s_suppkey % 2 = 0 AS in_concept, CASE WHEN s_suppkey % 2 = 0 THEN 0.5 END AS similarity FROM nation JOIN part ON p_partkey = n_nationkey + 1 JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) ON l_partkey = p_partkey JOIN supplier ON s_suppkey = l_suppkey")
def concept_members(spark, sf_dir):
    """Every article of a concept's words, and whether it is the concept's."""
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("word"), F.col("l_suppkey").alias("article_id")).distinct()
    own = edges.where("article_id % 2 = 0").join(table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).alias("word"), F.concat(F.lit("n"), _s("n_nationkey")).alias("concept_id")), "word")
    bare = edges.join(own.select("word", "concept_id").distinct(), "word")
    held = own.groupBy("concept_id").agg(F.collect_list(F.struct("word", "article_id", F.lit(0.5).alias("similarity"))).alias("members"))
    rest = bare.groupBy("concept_id").agg(F.count("*").alias("n"))
    return concepts.inspect(held.join(rest, "concept_id").drop("n"), edges)


@query("SELECT id, other, predicate, 'Concept ' || id AS id_name, CASE WHEN other % 2 = 0 THEN 'Concept ' || other ELSE ((10000000000 + other)::VARCHAR)[1:8] END AS other_name FROM (SELECT s AS id, t AS other, predicate FROM e UNION SELECT t, s, predicate FROM e) WHERE id % 10 = 0 AND id % 2 = 0".replace("FROM (SELECT", "FROM (WITH e AS (SELECT DISTINCT l_suppkey AS s, 1000 + l_partkey AS t, 'k' || l_linenumber AS predicate FROM lineitem) SELECT"))
def relations_of_concepts(spark, sf_dir):
    """Relations of found concepts either way, with the names of both ends; an unknown one shows the start of its id."""
    wide = lambda c: (F.lit(10_000_000_000) + c).cast("string")
    edges = table(spark, sf_dir, "lineitem").select(wide(F.col("l_suppkey")).alias("source_id"), wide(F.col("l_partkey") + 1000).alias("target_id"), F.concat(F.lit("k"), _s("l_linenumber")).alias("predicate"))
    ids = edges.select(F.col("source_id").alias("id")).union(edges.select("target_id")).distinct()
    n = F.col("id").cast("long") - 10_000_000_000
    names = ids.where(n % 2 == 0).select("id", F.concat(F.lit("Concept "), n.cast("string")).alias("name"))
    found = concepts.relations_of(ids.where(n % 10 == 0), edges, names)
    return found.select(n.alias("id"), (F.col("other").cast("long") - 10_000_000_000).alias("other"), "predicate", "id_name", "other_name")


@query("SELECT concept_id, domain, multi FROM (SELECT p_brand AS concept_id, p_brand[1:7] AS domain, count(DISTINCT p_type) > 1 OR count(DISTINCT p_size) > 1 AS multi, bool_or(p_size = 7) AS has FROM part GROUP BY p_brand) WHERE has AND domain = 'Brand#1'")
def concepts_listed(spark, sf_dir):
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("concept_id")).agg(F.collect_set("p_type").alias("keyword_words"), F.collect_set(F.concat(F.lit("m"), _s("p_size"))).alias("source_articles"))
    return concepts.list_concepts(rows.withColumn("domain", F.substring("concept_id", 1, 7)), "Brand#1", "m7").select("concept_id", "domain", "multi")


@query("SELECT DISTINCT l_partkey AS p_partkey FROM lineitem WHERE l_partkey % 17 = 0")
def selected_keys(spark, sf_dir):
    wanted = table(spark, sf_dir, "part").where("p_partkey % 17 = 0").select("p_partkey")
    return graph.select_explicit(wanted, table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey")), "p_partkey")


@query("SELECT source AS word, arg_max(lang, doc_id) AS category, arg_max('w' || doc_id, doc_id) FILTER (doc_id % 3 <> 0) AS original FROM documents GROUP BY source")
def keyword_upsert(spark, sf_dir):
    """The last category of a word; its original words are only replaced by some."""
    words = F.when(F.col("doc_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("w"), _s("doc_id"))))
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("word"), F.col("lang").alias("category"), words.alias("original_words"), "doc_id")
    return graph.upsert_keywords(rows, F.col("doc_id")).select("word", "category", F.get("original_words", F.lit(0)).alias("original"))


@query("SELECT l_suppkey AS target, arg_max(l_returnflag, l_orderkey * 10 + l_linenumber) AS display, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_orderkey * 10 + l_linenumber) AS chunks FROM lineitem GROUP BY l_suppkey")
def merged_links(spark, sf_dir):
    """Reference edges: the last one's fields, and the chunks of all, repeats included."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("target"), F.col("l_returnflag").alias("display"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"), F.array(_s("l_linenumber")).alias("chunk_ids"))
    return graph.merge_links(rows, ["target"], F.col("at"), ["display"]).select("target", "display", F.array_join("chunk_ids", ",").alias("chunks"))


@query("SELECT l_suppkey AS article_id, array_to_string(list_sort(list(DISTINCT l_linenumber)), ',') AS chunks, max(l_discount) AS confidence FROM lineitem WHERE l_suppkey % 2 = 0 GROUP BY l_suppkey HAVING true")
def kept_after_delete(spark, sf_dir):
    """Edges of the articles that stay when one is gone after another, merged by article."""
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("article_id"), F.col("l_linenumber").alias("chunk_id"), F.col("l_discount").alias("confidence"), F.col("l_partkey").alias("word")).where("article_id % 2 = 0 or article_id = '1'")
    left, _ = graph.delete_article("1", edges, edges.select("word").distinct())
    merged = graph.merge_edges(left, ["article_id"])
    return merged.select(F.col("article_id").cast("long").alias("article_id"), F.array_join(F.col("chunk_ids").cast("array<string>"), ",").alias("chunks"), "confidence")


@query("SELECT unnest(CASE WHEN n % 5 = 0 THEN ['reached'] ELSE ['left'] END) AS kind, n AS node FROM (SELECT DISTINCT l_partkey AS n FROM lineitem)")
def reached_and_left(spark, sf_dir):
    wanted = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("node"))
    seen = table(spark, sf_dir, "part").where("p_partkey % 5 = 0").select(F.col("p_partkey").alias("node"))
    reached, left = graph.reached_of(seen, wanted)
    return reached.withColumn("kind", F.lit("reached")).unionByName(left.withColumn("kind", F.lit("left"))).select("kind", "node")


_CROSS = """WITH t AS (SELECT l_orderkey AS o, l_linenumber AS n, l_suppkey AS a, 10000 + l_partkey AS b, 'c' || l_suppkey % 7 AS ca, 'c' || l_partkey % 7 AS cb, 'k' || l_linenumber AS predicate, l_discount AS confidence, l_returnflag || l_linestatus AS article FROM lineitem),
e AS (SELECT *, least(ca, cb) AS x, greatest(ca, cb) AS y FROM t WHERE ca <> cb),
k AS (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY o, n, a, b) AS i FROM e),
f AS (SELECT x, y, predicate, min(i) AS i FROM k GROUP BY ALL),
p AS (SELECT x, y, string_agg(predicate, ', ' ORDER BY i) AS predicate FROM (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY i) AS r FROM f) WHERE r <= 3 GROUP BY x, y)
SELECT arg_min(ca, i) AS source, arg_min(cb, i) AS target, any_value(p.predicate) AS predicate, string_agg(a || ' ' || k.predicate || ' ' || b, '; ' ORDER BY i) FILTER (i <= 5) AS description, max(confidence) AS confidence, array_to_string(list_sort(list(DISTINCT article)), ',') AS articles, count(*) AS n_edges
FROM k JOIN p USING (x, y) GROUP BY x, y"""


@query(_CROSS)
def cross_relations(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_suppkey").alias("a"), (F.col("l_partkey") + 10000).alias("b"), F.concat(F.lit("c"), (F.col("l_suppkey") % 7).cast("string")).alias("cluster_a"),
        F.concat(F.lit("c"), (F.col("l_partkey") % 7).cast("string")).alias("cluster_b"), F.concat(F.lit("k"), _s("l_linenumber")).alias("predicate"), F.col("l_discount").alias("confidence"), F.concat("l_returnflag", "l_linestatus").alias("article_id"),
    )
    kind = F.when(F.col("cluster_a") == F.col("cluster_b"), "intra").otherwise("inter")
    return graph.cross_relations(rows.withColumn("kind", kind), ["o", "n", "a", "b"]).withColumn("articles", F.array_join("articles", ","))


@query("WITH e AS (SELECT DISTINCT l_suppkey AS a, 10000 + l_partkey AS b, 'c' || l_suppkey % 7 AS ca, 'c' || l_partkey % 7 AS cb FROM lineitem) SELECT cluster, kind, count(*) AS n FROM (SELECT ca AS cluster, CASE WHEN ca = cb THEN 'intra' ELSE 'inter' END AS kind FROM e UNION ALL SELECT cb, 'inter' FROM e WHERE ca <> cb) GROUP BY ALL")
def edges_of_clusters(spark, sf_dir):
    """Edges inside clusters once, and between two with both."""
    # suppliers are even nodes and parts odd ones, so that no number of suppliers reaches a part
    edges = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") * 2).alias("a"), (F.col("l_partkey") * 2 + 1).alias("b")).distinct()
    of = lambda c: edges.select(F.col(c).alias("node"), F.concat(F.lit("c"), (F.shiftright(c, 1) % 7).cast("string")).alias("cluster"))
    return graph.edges_of_clusters(graph.classify_edges(edges, of("a").union(of("b")).distinct())).groupBy("cluster", "kind").agg(F.count("*").alias("n"))


@query("SELECT s, t, p, least(c, 5) AS created_at, CASE WHEN t % 2 = 0 THEN 0.9 ELSE 0.1 END AS confidence FROM (SELECT DISTINCT l_suppkey AS s, l_linenumber AS t, 'is' AS p, CASE WHEN l_linenumber = 6 THEN 9 ELSE 5 END AS c FROM lineitem WHERE l_linenumber <> 6) UNION ALL SELECT DISTINCT l_suppkey, 6, 'is', 9, 0.9 FROM lineitem")
def relations_upserted(spark, sf_dir):
    """Relations put over others by source, target and predicate, which keep the time they were first made at."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source_id"), F.col("l_linenumber").alias("target_id"), F.lit("is").alias("predicate")).distinct()
    state = rows.where("target_id <> 6").withColumns({"created_at": F.lit(5), "confidence": F.lit(0.1)})
    suppliers = rows.select("source_id").distinct()
    delta = rows.where("target_id % 2 = 0 and target_id <> 6").unionByName(suppliers.select("source_id", F.lit(6).cast(rows.schema["target_id"].dataType).alias("target_id"), F.lit("is").alias("predicate"))).withColumns({"created_at": F.lit(9), "confidence": F.lit(0.9)})
    return concepts.upsert_relations(state, delta).select(F.col("source_id").alias("s"), F.col("target_id").alias("t"), F.col("predicate").alias("p"), "created_at", "confidence")


# --- concepts -------------------------------------------------------------------------


@query("SELECT vec_id, label AS cluster, round(list_cosine_similarity(embedding::DOUBLE[], c), 4) AS similarity FROM embeddings JOIN (SELECT label AS l, list(x ORDER BY p) AS c FROM (SELECT label, p, avg(x) AS x FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS p FROM embeddings) GROUP BY label, p) GROUP BY label) ON l = label")
def concept_similarities(spark, sf_dir):
    points = table(spark, sf_dir, "embeddings").withColumnRenamed("label", "cluster")
    centres = retrieval.centroids(points, "cluster").withColumnRenamed("centroid", "embedding")
    return concepts.similarities(points, centres).select("vec_id", "cluster", "similarity")


@query("SELECT l_suppkey AS word, l_linenumber AS cluster, '{' || string_agg('\"' || m || '\":' || s, ',' ORDER BY m) || '}' AS similarities FROM (SELECT l_suppkey, l_linenumber, l_returnflag AS m, (count(*) / 10 + 0.1)::DECIMAL(9, 1)::VARCHAR AS s FROM lineitem GROUP BY ALL) GROUP BY ALL".replace("(count(*) / 10 + 0.1)::DECIMAL(9, 1)::VARCHAR", "count(*)::VARCHAR"))
def instance_edges(spark, sf_dir):
    """Edges of words to concepts with the similarity by article as JSON."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("word"), F.col("l_linenumber").alias("cluster"), F.col("l_returnflag").alias("article_id")).agg(F.count("*").alias("similarity"))
    return concepts.instance_edges(rows)


@query("SELECT s.n_nationkey AS source_id, t.n_nationkey AS target_id, 'trades' AS predicate, 0.5 AS confidence, array_to_string(list_sort(list_distinct([s.r, t.r])), ',') AS articles FROM (SELECT n_nationkey, n_regionkey::VARCHAR AS r FROM nation) s JOIN (SELECT n_nationkey, n_regionkey::VARCHAR AS r FROM nation) t ON t.n_nationkey = (s.n_nationkey * 2) % 30 WHERE s.n_nationkey <> t.n_nationkey")
def concept_answers(spark, sf_dir):
    """Relations that a model names, by names in any case: unknown names and loops are dropped, articles put together."""
    nations = table(spark, sf_dir, "nation")
    known = nations.select(F.col("n_nationkey").alias("concept_id"), F.initcap("n_name").alias("canonical_name"), F.array(_s("n_regionkey")).alias("source_articles"), F.create_map(_s("n_regionkey"), F.lit("v1")).alias("source_versions"))
    other = nations.select(F.col("n_nationkey").alias("to"), F.upper("n_name").alias("target"))
    answers = nations.withColumn("to", (F.col("n_nationkey") * 2) % 30).join(other, "to", "left").select(F.lower("n_name").alias("source"), F.coalesce("target", F.lit("nowhere")).alias("target"), F.lit("trades").alias("predicate"), F.lit(None).cast("double").alias("confidence"))
    return concepts.concept_relations(answers, known).select("source_id", "target_id", "predicate", "confidence", F.array_join("source_articles", ",").alias("articles"))


@query("SELECT n_nationkey, coalesce(CASE WHEN n_nationkey % 2 = 0 THEN 1 END, 3)::INTEGER AS chosen_version FROM nation")
def chosen_versions(spark, sf_dir):
    offers = table(spark, sf_dir, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, 1).alias("choice"), F.array(F.lit(1), F.lit(3), F.lit(2)).alias("versions"))
    return concepts.chosen_version(offers).select("n_nationkey", "chosen_version")


_FINAL = """WITH n AS (SELECT n_nationkey AS g, n_nationkey % 4 AS k FROM nation),
v AS (SELECT g, 1 AS version, k < 2 AS is_active FROM n UNION ALL SELECT g, 2, k = 2 FROM n WHERE k >= 2 UNION ALL SELECT g, 3, k = 3 FROM n WHERE k >= 2)
SELECT 'version' AS kind, g::VARCHAR AS concept_group_id, version::INTEGER AS version, is_active::VARCHAR AS told FROM v
UNION ALL SELECT 'evolved', g::VARCHAR, 1, '2' FROM n WHERE k >= 2 UNION ALL SELECT 'evolved', g::VARCHAR, 2, '3' FROM n WHERE k >= 2"""


@query(_FINAL)
def expand_finalized(spark, sf_dir):
    """Versions after the choice: none made, the original kept, the direct one or the model's taken."""
    none = F.array().cast("array<string>")
    version = lambda n: F.struct(F.lit(n).alias("version"), F.array(F.lit("w")).alias("keyword_words"), none.alias("source_articles"))
    k = F.col("n_nationkey") % 4
    nations = table(spark, sf_dir, "nation").select(_s("n_nationkey").alias("concept_group_id"), F.when(k > 0, k.cast("int")).alias("chosen_version"))
    state = nations.select("concept_group_id", F.lit(1).alias("version"), F.lit(True).alias("is_active"), F.array(F.lit("w")).alias("keyword_words"), none.alias("source_articles"))
    offers = nations.select("*", F.lit(1).alias("original_version"), version(2).alias("v_direct"), version(3).alias("v_llm"))
    after, evolved = concepts.finalize_expand(state, offers)
    return after.select(F.lit("version").alias("kind"), "concept_group_id", "version", F.col("is_active").cast("string").alias("told")).union(evolved.select(F.lit("evolved"), "concept_group_id", "from_version", F.col("to_version").cast("string")))


@query("SELECT 'new' AS concept_group_id, 1::INTEGER AS version, count(DISTINCT l_partkey) AS words, count(DISTINCT l_suppkey) AS articles FROM lineitem WHERE l_partkey % 31 = 0")
def concept_added(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("word"), F.col("l_suppkey").cast("string").alias("article_id"))
    state = spark.createDataFrame([], "concept_group_id string, version int, is_active boolean, keyword_words array<string>, source_articles array<string>")
    wanted = table(spark, sf_dir, "part").where("p_partkey % 31 = 0").select(_s("p_partkey").alias("word"))
    return concepts.add_concept(state, "new", wanted, edges).select("concept_group_id", "version", F.size("keyword_words").cast("long").alias("words"), F.size("source_articles").cast("long").alias("articles"))


@query("SELECT conv_id, arg_max(text, turn)[1:100] AS broad, coalesce(arg_max(text, len(text) * 1000 + turn) FILTER (role = 'user'), arg_min(text, turn))[1:100] AS detail FROM conversations GROUP BY conv_id")
def dual_context(spark, sf_dir):
    """Broad and detailed context, each cut to two fifths of the budget."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("chunk_id"), "text", F.when(F.col("role") == "user", 0).otherwise(F.col("turn") + 1).alias("level"), "turn")
    last = rows.groupBy("conv_id").agg(F.max("turn").alias("turn")).withColumn("last", F.lit(1))
    ranked = rows.join(last, ["conv_id", "turn"], "left").withColumn("level", F.when(F.col("last") == 1, F.when(F.col("level") == 0, 0).otherwise(1000)).otherwise(F.col("level")))
    broad = concepts.dual_context(rows.withColumn("level", F.col("turn")), ["conv_id"], 100).select("conv_id", "broad")
    return broad.join(concepts.dual_context(ranked.withColumn("level", F.when(F.col("level") == 0, 0).otherwise(F.col("turn") + 1)), ["conv_id"], 100).select("conv_id", "detail"), "conv_id")


@query("WITH s AS (SELECT conv_id, turn, text, sum(len(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn) - len(text) - 1 AS b FROM conversations) SELECT conv_id, turn, text[1:(175 - b)::INTEGER] AS text FROM s WHERE b < 175")
def concept_prompt(spark, sf_dir):
    return concepts.concept_prompt(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], 100).select("conv_id", "turn", "text")


_MEAN = """WITH f AS (SELECT unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS p FROM embeddings WHERE label = 1), c AS (SELECT list(x ORDER BY p) AS v FROM (SELECT p, avg(x) AS x FROM f GROUP BY p)),
r AS (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], v), 6) AS score FROM embeddings, c)
SELECT vec_id, score, (row_number() OVER (ORDER BY score DESC, vec_id))::INTEGER AS rank FROM r ORDER BY score DESC, vec_id LIMIT 200"""


@query(_MEAN)
def ranked_to_mean(spark, sf_dir):
    points = table(spark, sf_dir, "embeddings")
    return retrieval.rank_to_mean(spark, points, points.where("label = 1"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_orderkey, l_linenumber OFFSET 60 LIMIT 20")
def third_page(spark, sf_dir):
    return retrieval.page(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"], 3, 20)


@query("WITH h AS (SELECT 'parts' AS kind, l_suppkey AS q, l_partkey AS p FROM lineitem WHERE l_quantity = 50 UNION ALL SELECT 'orders', l_suppkey, l_orderkey FROM lineitem WHERE l_quantity = 1) SELECT kind, q AS query_id, count(*) AS hits FROM h GROUP BY ALL UNION ALL SELECT 'total', NULL, count(DISTINCT (kind, p)) FROM h")
def hits_of_kinds(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    hits = lambda cut, point: items.where(cut).select(F.col("l_suppkey").alias("query_id"), point)
    return concepts.hit_counts({"parts": hits("l_quantity = 50", "l_partkey"), "orders": hits("l_quantity = 1", "l_orderkey")})


@query("SELECT label AS topic, 't' || CASE WHEN label < 3 THEN 'new' ELSE 'old' END AS label FROM (SELECT DISTINCT label FROM embeddings)")
def topics_upserted(spark, sf_dir):
    known = table(spark, sf_dir, "embeddings").select(F.col("label").alias("topic")).distinct()
    return topics.upsert(known.withColumn("label", F.lit("told")), known.where("topic < 3").withColumn("label", F.lit("tnew")))


@query("SELECT vec_id, label AS topic FROM embeddings WHERE label > 0")
def topic_links(spark, sf_dir):
    assigned = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("label") > 0, F.col("label")).otherwise(-1).alias("topic"))
    return topics.links(assigned, "vec_id")


@query("WITH RECURSIVE s AS (SELECT l_suppkey AS g, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_quantity::INTEGER) AS k, l_quantity::INTEGER AS n FROM lineitem), w AS (SELECT g, k, 0 AS grp, n AS total FROM s WHERE k = 1 UNION ALL SELECT s.g, s.k, CASE WHEN w.total >= 60 THEN w.grp + 1 ELSE w.grp END, CASE WHEN w.total >= 60 THEN s.n ELSE w.total + s.n END FROM w JOIN s ON s.g = w.g AND s.k = w.k + 1), e AS (SELECT *, max(grp) OVER (PARTITION BY g) AS last, last_value(total) OVER (PARTITION BY g ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS tail FROM w) SELECT g, string_agg((CASE WHEN grp = last AND last > 0 AND tail < 60 THEN grp - 1 ELSE grp END)::VARCHAR, ',' ORDER BY k) AS groups FROM e GROUP BY g")
def short_groups_merged(spark, sf_dir):
    """Sizes gathered until their sum is enough; a short tail joins the last group."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("g")).agg(F.transform(F.sort_array(F.collect_list(F.struct("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("n")))), lambda x: x["n"]).alias("sizes"))
    return rows.select("g", F.array_join(chunking.merge_short(F.col("sizes"), 60).cast("array<string>"), ",").alias("groups"))


@query("WITH s AS (SELECT user_id, date_diff('second', TIMESTAMP '2024-01-01', ts) AS a, event_id FROM events), l AS (SELECT *, lag(a + 3600) OVER (PARTITION BY user_id ORDER BY a, a + 3600) AS p FROM s), i AS (SELECT *, sum(CASE WHEN a - p > 7200 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, a + 3600) AS island FROM l) SELECT user_id, island::BIGINT AS island, min(a) AS start, max(a + 3600) AS \"end\", count(*) AS n FROM i GROUP BY user_id, island")
def merged_segments(spark, sf_dir):
    start = F.timestamp_diff("SECOND", F.lit("2024-01-01").cast("timestamp"), F.col("ts"))
    rows = table(spark, sf_dir, "events").select("user_id", start.alias("start"), (start + 3600).alias("end"))
    return sessions.merge_segments(rows, ["user_id"], 7200)


# --- readers and writers --------------------------------------------------------------


@query("SELECT conv_id, arg_max(text_len, turn) AS said, max(turn) AS turn FROM (SELECT conv_id, turn, role || len(text) AS text_len FROM conversations) GROUP BY conv_id")
def metadata_last_wins(spark, sf_dir):
    """Metadata written as CSV files, read again: of an id the last row of the last file holds, and a missing file is skipped."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("role", F.length("text").cast("string")).alias("said"))
    folder, turns = tables.folder(spark), rows.select("turn").distinct().orderBy("turn").collect()
    rows.withColumn("file", F.col("turn")).write.partitionBy("file").option("header", True).csv(folder)  # all files in one job
    found = readers.metadata(spark, [*(f"{folder}/file={r.turn}" for r in turns), f"{folder}/none"], "conv_id")
    return found.select(F.col("conv_id").cast("long").alias("conv_id"), "said", F.col("turn").cast("long").alias("turn"))


@query("SELECT conv_id AS article_id, max(turn)::VARCHAR AS version, count(*) FILTER (turn = m) AS n FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS m FROM conversations) GROUP BY conv_id")
def latest_versions(spark, sf_dir):
    """Versions of articles appended to a table, and the rows of the last of each."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("article_id"), "turn", "role")
    path = tables.folder(spark)
    readers.write_versions(rows.withColumn("turn", F.lpad(F.col("turn").cast("string"), 5, "0")).withColumnRenamed("turn", "version"), path)
    found = readers.latest(spark.read.schema("article_id long, role string, version string").parquet(path))
    return found.groupBy("article_id").agg(F.max(F.col("version").cast("int").cast("string")).alias("version"), F.count("*").alias("n"))


@query("SELECT conv_id || ',' || turn || ',' || coalesce(role, 'None') || ',' || CASE WHEN turn > 1 THEN 'True' ELSE 'False' END || ',\"' || coalesce(text, 'None') || '\"' AS line FROM conversations")
def plain_list(spark, sf_dir):
    """Whole turns as lines between commas, nothing escaped."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", (F.col("turn") > 1).alias("late"), "text")
    return readers.plain_lines(rows, ("text",))


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 1.0 ELSE round(embedding[1]::DOUBLE, 6) END AS first FROM embeddings")
def vectors_upserted(spark, sf_dir):
    points = table(spark, sf_dir, "embeddings").select("vec_id", vectors.doubles(F.col("embedding")).alias("embedding"))
    size = points.select(F.max(F.size("embedding"))).first()[0]
    delta = points.where("vec_id % 3 = 0").withColumn("embedding", F.array_repeat(F.lit(1.0), size))
    return readers.upsert_vectors(points, delta, size, "vec_id").select("vec_id", F.round(F.get("embedding", F.lit(0)), 6).alias("first"))


@query("SELECT vec_id AS node_id, label::VARCHAR || CASE WHEN vec_id % 3 = 0 THEN ',x' ELSE '' END AS keywords FROM embeddings")
def points_upserted(spark, sf_dir):
    points = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), F.array(_s("label")).alias("keywords"))
    delta = points.where("node_id % 3 = 0").withColumn("keywords", F.array(F.lit("x"), F.get("keywords", F.lit(0))))
    return readers.upsert_points(points, delta).select("node_id", F.array_join("keywords", ",").alias("keywords"))


@query("SELECT c_custkey AS node_id, 'concept' AS kind FROM customer UNION ALL SELECT s_suppkey || ':' || n_nationkey || ':in', 'relation' FROM supplier JOIN nation ON n_nationkey = s_nationkey".replace("SELECT c_custkey AS", "SELECT c_custkey::VARCHAR AS"))
def concept_points(spark, sf_dir):
    """Points to search: concepts by their id, relations by source, target and predicate."""
    v = F.array(F.lit(1.0)).alias("embedding")
    own = table(spark, sf_dir, "customer").select(_s("c_custkey").alias("concept_id"), v)
    relations = table(spark, sf_dir, "supplier").select(_s("s_suppkey").alias("source_id"), _s("s_nationkey").alias("target_id"), F.lit("in").alias("predicate"), v)
    return concepts.vector_points(own, relations).select("node_id", "kind")


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '{"amount": ' || page_id || '}' WHEN page_id % 3 = 1 THEN '{"n": {"amount": 1}}'[7:19] END AS json FROM pages""")
def flat_objects(spark, sf_dir):
    """The first flat object of an answer."""
    kinds = F.array(F.concat(F.lit('so {"amount": '), _s("page_id"), F.lit('} and {"b": 2}')), F.lit('{"n": {"amount": 1}}'), F.lit("{not json}"))
    return _pages(spark, sf_dir, text.flat_json(F.get(kinds, (F.col("page_id") % 3).cast("int"))).alias("json"))


@query("SELECT DISTINCT 'SUPPLIER ' || (l_suppkey * 2) AS name, CASE WHEN l_suppkey * 2 IN (SELECT s_suppkey FROM supplier) THEN 's' || l_suppkey * 2 ELSE 'SUPPLIER ' || (l_suppkey * 2) END AS article_id, l_suppkey * 2 NOT IN (SELECT s_suppkey FROM supplier) AS placeholder FROM lineitem UNION ALL SELECT 'S' || s_suppkey, 's' || s_suppkey, false FROM supplier")
def articles_found_or_made(spark, sf_dir):
    """Articles by name or id in any case, with placeholders for the others."""
    suppliers = table(spark, sf_dir, "supplier")
    articles = suppliers.select(F.concat(F.lit("s"), _s("s_suppkey")).alias("article_id"), F.concat(F.lit("supplier "), _s("s_suppkey")).alias("name"))
    wanted = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("SUPPLIER "), (F.col("l_suppkey") * 2).cast("string")).alias("name"))
    return graph.find_or_make(wanted.union(suppliers.select(F.concat(F.lit("S"), _s("s_suppkey")))), articles)


_VECTORS = """WITH c AS (SELECT s_suppkey AS id, ord(unnest(regexp_extract_all(lower(s_name), '.'))) % 64 AS place FROM supplier), n AS (SELECT id, place, count(*) AS n FROM c GROUP BY ALL)
SELECT id, place::INTEGER AS place, round(n / sqrt(sum(n * n) OVER (PARTITION BY id)), 6) AS x FROM n"""


@query(_VECTORS)
def account_vectors(spark, sf_dir):
    accounts = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return finance.account_vectors(accounts).select("id", F.posexplode("embedding").alias("place", "x")).where("x <> 0").withColumn("x", F.round("x", 6))


@query("SELECT source AS article_id, count(*) AS keywords, count(DISTINCT lang) AS refs, min(doc_id) % 2 = 0 AS has_summary FROM documents GROUP BY source")
def articles_listed(spark, sf_dir):
    """Articles with the number of their keywords and references, and whether they have a summary."""
    from lorespark.plans.tools import TOOLS

    docs = table(spark, sf_dir, "documents")
    summary = F.when(F.min("doc_id") % 2 == 0, "told").otherwise(" ")
    tables = {"articles": docs.groupBy(F.col("source").alias("article_id")).agg(summary.alias("summary")), "has_keyword": docs.select(F.col("source").alias("article_id"), F.col("doc_id").alias("word")), "references": docs.select(F.col("source").alias("article_id"), "lang").distinct()}
    return TOOLS.get("list_articles")(tables).select("article_id", "keywords", "refs", "has_summary")


@query("SELECT s_suppkey AS article_id FROM supplier WHERE contains(lower(s_name), '7') ORDER BY s_suppkey::VARCHAR LIMIT 5".replace("SELECT s_suppkey AS", "SELECT s_suppkey::VARCHAR AS"))
def articles_alike(spark, sf_dir):
    from lorespark.plans.tools import TOOLS

    return TOOLS.get("similar_articles")({"articles": table(spark, sf_dir, "supplier").select(F.lit("x").alias("hidden"), _s("s_suppkey").alias("article_id"), F.col("s_name").alias("name")).drop("hidden")}, "7").select("article_id")


_STEPS = """WITH a AS (SELECT n_nationkey AS id, n_name AS name, lower(trim(n_name)) AS nm, n_nationkey % 5 AS k FROM nation),
q AS (SELECT DISTINCT CASE k WHEN 0 THEN ' ' || upper(name) || ' ' WHEN 1 THEN 'zq' || id WHEN 2 THEN name[2:] WHEN 3 THEN 'pay ' || name || ' now' ELSE reverse(name) || '?' END AS query FROM a),
n AS (SELECT query, lower(trim(query)) AS qn FROM q),
v AS (SELECT nm, list_transform(range(64), lambda d: len(list_filter(string_split(nm, ''), lambda c: ascii(c) % 64 = d))::DOUBLE) AS x FROM (SELECT nm FROM a UNION SELECT qn FROM n)),
l AS (SELECT query, id, round(list_cosine_similarity(qv.x, av.x), 6) AS sim FROM n JOIN v qv ON qv.nm = qn, a JOIN v av ON av.nm = a.nm),
s AS (SELECT query, id, 1.0 AS confidence, 'synonym' AS how, 1 AS step, 0 AS o FROM n JOIN a ON qn = 'zq' || id AND k = 1
UNION ALL SELECT query, id, 1.0, 'exact', 2, 0 FROM n JOIN a ON nm = qn
UNION ALL SELECT query, id, CASE WHEN count(*) OVER (PARTITION BY query) = 1 THEN 0.8 ELSE 0.6 END, 'part', 3, len(name) FROM n JOIN a ON contains(nm, qn)
UNION ALL SELECT query, id, 0.5, 'whole', 4, -len(name) FROM n JOIN a ON contains(qn, nm)
UNION ALL SELECT query, id, sim, 'similar', 5, round(-sim * 1000000) FROM l WHERE sim >= 0.9
UNION ALL SELECT query, (SELECT min(id) FROM a), 0.3, 'default', 6, 0 FROM n)
SELECT query, id AS account_id, confidence, how FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY step, o, id) AS r FROM s) WHERE r = 1"""


@query(_STEPS)
def account_cascade_steps(spark, sf_dir):
    """Phrases for which each step finds an account, the likeness of names among them."""
    nations = table(spark, sf_dir, "nation")
    k, name, ident = F.col("n_nationkey") % 5, F.col("n_name"), _s("n_nationkey")
    phrase = F.when(k == 0, F.concat(F.lit(" "), F.upper(name), F.lit(" "))).when(k == 1, F.concat(F.lit("zq"), ident)).when(k == 2, F.substring(name, 2, 1000)).when(k == 3, F.concat(F.lit("pay "), name, F.lit(" now"))).otherwise(F.concat(F.reverse(name), F.lit("?")))
    synonyms = nations.where(k == 1).select(F.concat(F.lit("ZQ"), ident).alias("word"), name.alias("name"))
    accounts = nations.select(F.col("n_nationkey").alias("id"), name.alias("name"))
    return finance.resolve_accounts(nations.select(phrase.alias("query")), accounts, synonyms, least=0.9).select("query", "account_id", "confidence", "how")


@query("SELECT c_custkey, CASE WHEN c_custkey % 50 = 0 THEN 'new ' || c_name ELSE c_name END AS c_name FROM customer WHERE c_custkey % 90 <> 1 UNION ALL SELECT c_custkey + 1000000000, c_name FROM customer WHERE c_custkey % 70 = 0")
def keyed_upsert(spark, sf_dir):
    """Customers kept by key: some renamed, some added, some deleted, each time in their buckets alone."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name")
    kept = KeyedTable.create(spark, tables.folder(spark), rows, ["c_custkey"], 16)
    kept.upsert(rows.where("c_custkey % 50 = 0").withColumn("c_name", F.concat(F.lit("new "), "c_name")))
    kept.upsert(rows.where("c_custkey % 70 = 0").withColumn("c_custkey", F.col("c_custkey") + 1_000_000_000))
    kept.delete(rows.where("c_custkey % 90 = 1"))
    return kept.read()


#: The first two words of each test item, as names: the item's own is its person.
_NAMED = """WITH p AS (SELECT DISTINCT lower(regexp_extract(text, '^\\S+\\s+\\S+')) AS name FROM benchmark WHERE regexp_matches(text, '^\\S+\\s+\\S+')),
c AS (SELECT name, name AS alias, 1 AS rank FROM p UNION ALL SELECT name, unnest(string_split_regex(name, '\\s+')), 2 FROM p),
r AS (SELECT alias, name, row_number() OVER (PARTITION BY alias ORDER BY rank, name) AS k FROM c WHERE len(alias) >= 2),
d AS (SELECT doc_id, lower(text) AS t FROM documents),
w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(t, '[\\p{L}\\p{N}_]+'))) AS word FROM d),
f AS (SELECT w.doc_id, name, alias FROM w JOIN r ON alias = word AND k = 1 WHERE regexp_full_match(alias, '[\\p{L}\\p{N}_]+')
UNION SELECT doc_id, name, alias FROM d JOIN r ON k = 1 AND contains(t, alias) WHERE NOT regexp_full_match(alias, '[\\p{L}\\p{N}_]+')
  AND regexp_matches(t, '(^|[^\\p{L}\\p{N}_])' || regexp_escape(alias) || '($|[^\\p{L}\\p{N}_])'))
SELECT doc_id, name, alias FROM f"""


@query(_NAMED)
def people_in_texts(spark, sf_dir):
    """Whom whole documents name, by full names and by parts of names that are free."""
    names = F.lower(F.regexp_extract("text", r"^\S+\s+\S+", 0))
    people = table(spark, sf_dir, "benchmark").select(names.alias("name"), F.lit(False).alias("is_group")).where("name <> ''").distinct()
    return notes.people_in(spark, table(spark, sf_dir, "documents"), notes.aliases(people)).select("doc_id", "name", "alias")


@query("WITH f AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS p FROM embeddings WHERE vec_id % 2 = 0), m AS (SELECT label, p, avg(x) AS x FROM f GROUP BY label, p), c AS (SELECT label, list(x ORDER BY p) AS v FROM m GROUP BY label), s AS (SELECT vec_id, c.label AS l, round(list_cosine_similarity(embedding::DOUBLE[], v), 6) AS score FROM embeddings, c WHERE vec_id % 2 = 1), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, l) AS k FROM s) SELECT vec_id, CASE WHEN score >= 0.4 THEN l ELSE -1 END::INTEGER AS topic, score FROM r WHERE k = 1")
def topics_inferred(spark, sf_dir):
    """Topics of new points by the nearest centre of the old ones."""
    points = table(spark, sf_dir, "embeddings")
    centres = retrieval.centroids(points.where("vec_id % 2 = 0").withColumnRenamed("label", "topic"), "topic")
    return topics.infer(spark, points.where("vec_id % 2 = 1"), centres, 0.4, "vec_id")


@query("WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: len(x) >= 4) AS l FROM documents), g AS (SELECT DISTINCT doc_id, unnest(list_concat(l, [l[i] || ' ' || l[i + 1] for i in range(1, len(l))])) AS word FROM w) SELECT word, count(*) AS df FROM g GROUP BY word HAVING count(*) >= 20")
def common_pairs(spark, sf_dir):
    """Words and pairs of words with the number of documents that have them."""
    return keywords.document_counts(table(spark, sf_dir, "documents"), grams=2).where("df >= 20")


@query("WITH x AS (SELECT o_custkey AS user_id, o_orderkey AS id, c_mktsegment AS category, round(o_totalprice::DECIMAL(12,2)::DOUBLE, 2) AS amount, o_orderdate::DATE AS day FROM orders JOIN customer ON o_custkey = c_custkey) SELECT id, amount, day FROM x WHERE user_id = 7 AND category = (SELECT c_mktsegment FROM customer WHERE c_custkey = 7) AND day >= DATE '1993-01-01'")
def expenses_of_category(spark, sf_dir):
    from lorespark.plans.q_graph import _expenses

    category = table(spark, sf_dir, "customer").where("c_custkey = 7").first()["c_mktsegment"]
    return finance.select_range(_expenses(spark, sf_dir), 7, "1993-01-01", category=category).select("id", F.round(F.col("amount").cast("double"), 2).alias("amount"), "day")
