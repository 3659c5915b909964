import fnmatch
import re
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorespark.functions import text
from lorespark.operators import acl, blocks, chunking, clustering, concepts, finance, graph, keywords, notes, retrieval, sessions
from lorespark.sources import readers
from lorespark.streaming import streams

RULES = [
    ([acl.rule(1, "**/*", allow=["READ"], priority=10, roles=["admin"]), acl.rule(2, "secrets/*.md", deny=["READ"], priority=20, roles=["admin"])], [("alice", "admin")], [("alice", "docs/hello.md", "READ", True), ("alice", "secrets/password.md", "READ", False), ("bob", "docs/hello.md", "READ", False)]),
    (
        [acl.rule(1, "**/*", allow=["ALL"], priority=10, roles=["editor"]), acl.rule(2, "daily/*.md", deny=["DELETE"], priority=20, roles=["editor"]), acl.rule(3, "daily/2025-01-01.md", allow=["DELETE"], priority=30, users=["bob"])],
        [("bob", "editor")],
        [("bob", "daily/2025-02-02.md", "DELETE", False), ("bob", "daily/2025-02-02.md", "READ", True), ("bob", "daily/2025-01-01.md", "DELETE", True)],
    ),
    ([acl.rule(1, "**/*", allow=["READ"], priority=10, users=["charlie"]), acl.rule(2, "daily/2025-*.md", deny=["READ"], priority=10, users=["charlie"])], [("x", "y")], [("charlie", "daily/2025-05-05.md", "READ", False)]),
    ([acl.rule(1, "**/*", allow=["READ"], priority=10, users=["charlie"]), acl.rule(2, "daily/2025-*.md", deny=["READ"], priority=10, users=["charlie"]), acl.rule(3, "daily/2025-05-05.md", allow=["READ"], priority=10, users=["charlie"])], [("x", "y")], [("charlie", "Daily\\2025-05-05.md", "READ", True)]),
]


@pytest.mark.parametrize("rules,roles,checks", RULES)
def test_permissions(spark, rules, roles, checks):
    frame = spark.createDataFrame([(u, p, acl.permissions([a])) for u, p, a, _ in checks], "user string, path string, perms int")
    got = {(r.user, r.path, r.perms): r.granted for r in acl.can(frame, spark.createDataFrame(rules, acl.RULES), spark.createDataFrame(roles, "user string, role string")).collect()}
    assert got == {(u, p, acl.permissions([a])): want for u, p, a, want in checks}


def test_policy_and_permission_names(spark):
    rules, roles = acl.load_policy(spark, "roles: {admin: [al]}\nrules:\n  - {permissions: [READ], roles: [admin]}\n  - {pattern: 'x/*', permissions: [all], deny: true, priority: 3, users: [bo]}\n")
    assert [(r.pattern, r.perms, r.deny, r.priority) for r in rules.orderBy("rule_id").collect()] == [("**/*", 1, False, 0), ("x/*", 15, True, 3)] and roles.first().user == "al"
    with pytest.raises(ValueError):
        acl.permissions(["FLY"])
    assert acl.acl_block("a\n```acl\nusers: [x]\n```\n") == "users: [x]\n"


def test_grants(spark):
    t = lambda m: datetime(2025, 1, 1, 10, m)
    ask = lambda i, kind="TEMPORARY", ttl=30: (i, "request", "bo", t(0), "bo", "al", "a.md", 1, kind, ttl)
    act = lambda i, e, who, m: (i, e, who, t(m), None, None, None, None, None, None)
    rows = [ask(1), act(1, "approve", "al", 5), ask(2), act(2, "approve", "bo", 5), ask(3), act(3, "deny", "al", 1), act(3, "approve", "al", 2), ask(4, "PERMANENT"), act(4, "approve", "al", 1), act(4, "revoke", "al", 9), ask(5, "PERMANENT"), act(5, "approve", "al", 1)]
    log = spark.createDataFrame(rows, "request_id long, event string, actor string, ts timestamp, requester string, owner string, path string, perms int, kind string, ttl_minutes long")
    states = acl.grant_states(log)
    assert {r.request_id: r.status for r in states.collect()} == {1: "approved", 2: "pending", 3: "denied", 4: "revoked", 5: "approved"}
    at = lambda m: {r.request_id for r in acl.active_grants(states, F.lit(t(m))).collect()}
    assert at(35) == {1, 5} and at(36) == {5}
    assert acl.grant_rules(acl.active_grants(states, F.lit(t(6)))).count() == 2


def test_accounts(spark):
    names = ["Наличка", "Сбер расчетный счет", "Сбер накопительный счет общий", "Альфа расчетный счет", "Тинькофф расчетный счет", "Копилки"]
    accounts = spark.createDataFrame(list(enumerate(names, 1)), "id long, name string")
    words = [("сбер", names[1]), ("сбербанк", names[1]), ("нал", names[0]), ("копилка", names[5])]
    asked = ["сбербанк", "наличка", "накопительный", "счет", "перевод на альфа расчетный счет сегодня", "копилкки", "!!!"]
    got = {r.query: (r.account_id, r.how, r.confidence) for r in finance.resolve_accounts(spark.createDataFrame([(a,) for a in asked], "query string"), accounts, spark.createDataFrame(words, "word string, name string"), names[1]).collect()}
    assert got["сбербанк"] == (2, "synonym", 1.0) and got["наличка"] == (1, "exact", 1.0) and got["накопительный"] == (3, "part", 0.8) and got["счет"] == (2, "part", 0.6)
    assert got["перевод на альфа расчетный счет сегодня"] == (4, "whole", 0.5) and got["копилкки"][:2] == (6, "similar") and got["!!!"] == (2, "default", 0.3)


NOTE = "# День\n## Основные дела\n- [ ] 🔺 стендап 10:00-10:15 [[Иванов Иван]]\n- [x] код ревью\n- заметка\n```dataview\n# не заголовок\n- [ ] не дело\n```\n### Внутри\n- [ ] ещё\n## Заметки\n- [/] тесты #testing\nitog 7 из 10"


def test_notes(spark):
    frame = spark.createDataFrame([("n", NOTE)], "note string, text string")
    marked = notes.lines(frame)
    found = notes.tasks(marked).orderBy("pos").collect()
    assert [(r.text, r.status, r.section) for r in found] == [("стендап", "open", "Основные дела"), ("код ревью", "done", "Основные дела"), ("ещё", "open", "Внутри"), ("тесты", "in_progress", "Заметки")]
    assert [r.item for r in notes.bullets(marked).collect()] == ["заметка"]
    assert "dataview" not in notes.without_fences(marked).first().text
    assert notes.set_section(marked, "основные дела", ["- new"]).first().text == "# День\n## Основные дела\n- new\n## Заметки\n- [/] тесты #testing\nitog 7 из 10"
    assert "- [ ] ещё\n- more\n## Заметки" in notes.append_to_section(marked, "Основные дела", ["- more"]).first().text
    assert "- [x] код ревью" not in notes.change_first_task(marked, "код").first().text
    assert "- [x] ещё" in notes.change_first_task(marked, "ещё", lambda c: F.replace(c, F.lit("[ ]"), F.lit("[x]"))).first().text
    assert frame.select(notes.month_score(F.col("text"))).first()[0] == 7
    assert notes.front_matter("---\na: 1\n---\nbody") == ({"a": 1}, "body") and notes.front_matter("---\n- x\n---\nb")[0] == {} and notes.front_matter("x")[0] == {}
    assert notes.serialise_front_matter({"b": True, "a": "6:30", "z": None}, ["a"]) == '---\na: "6:30"\nb: true\nz:\n---\n'


def test_task_filters(spark):
    rows = [("стендап", "open", "high", "Основные дела", "2025-12-01", None, ["Иванов Иван"]), ("ревью", "done", "medium", "Основные дела", "2025-12-01", None, []), ("тесты", "in_progress", "low", "Второстепенные задачи", "2025-12-02", None, []), ("отменено", "cancelled", "normal", "Основные дела", "2025-12-03", None, []), ("просрочено", "open", "high", None, "2025-11-01", "2025-11-15", [])]
    frame = spark.createDataFrame(rows, "text string, status string, priority string, section string, d string, s string, people array<string>")
    frame = frame.select("*", F.col("text").alias("raw_line"), F.to_date("d").alias("source_date"), F.to_date("s").alias("scheduled_date"), F.lit(None).cast("string").alias("time_slot"))
    n = lambda **k: notes.filter_tasks(frame, **k).count()
    assert [n(status="open"), n(status="done"), n(priority="high"), n(date_from="2025-12-01", date_to="2025-12-01"), n(date_from="2025-12-01", date_to="2025-12-02"), n(person="иванов иван"), n(query="СТЕНД"), n(query="нет"), n(status="open", priority="high"), n(has_scheduled=True), n(section="основные")] == [2, 1, 2, 2, 3, 1, 1, 0, 2, 1, 3]
    assert notes.overdue(frame, F.lit("2025-12-01").cast("date")).count() == 1
    people = spark.createDataFrame([("Иванов Иван", False), ("Группа А", True)], "name string, is_group boolean")
    names = notes.aliases(people, spark.createDataFrame([("Ваня", "Иванов Иван", 1)], "alias string, name string, pos long"))
    assert {r.alias: r.name for r in names.collect()} == {"иванов иван": "Иванов Иван", "иванов": "Иванов Иван", "иван": "Иванов Иван", "группа а": "Группа А", "ваня": "Иванов Иван"}
    linked = frame.withColumn("wiki_links", F.array().cast("array<struct<target:string>>"))
    assert notes.mentioning(linked, "Ваня", names).count() == 1


def test_blocks(spark):
    md = "# A\ntext **b** [l](u)\n\n- one\n  - two\n\n## B\n> quote\n\n```py\ncode < 1\n```\n# C\nend ![i](s)"
    rows = blocks.html_blocks(spark.createDataFrame([("a/1", md), ("b", None), ("c", " ")], "article_id string, html string"), markdown=True)
    got = rows.orderBy("pos").collect()
    assert [(r.id, r.type, r.text) for r in got] == [("1", "header", "# A"), ("1.1", "paragraph", "text **b** [l](u)"), ("1.2", "list_item", "- one"), ("1.3", "list_item", "- two"), ("1.4", "header", "## B"), ("1.4.1", "blockquote", "quote"), ("1.4.2", "code", ""), ("2", "header", "# C"), ("2.1", "paragraph", "end")]
    assert got[6].code == "code < 1" and got[6].lang == "py" and got[0].article_id == "a_1"
    assert [(r.kind, r.target) for r in blocks.assets(rows).orderBy("block_id").collect()] == [("link", "u"), ("image", "s")]
    assert blocks.text_range(rows, "1.4").first().text == "## B\n\nquote" and blocks.text_range(rows, "1.2", "1.4").first().text == "- one\n\n- two\n\n## B" and blocks.text_range(rows, "2", "9").first().text == "# C\n\nend"
    assert blocks.sequence_breaks(rows).count() == 0 and blocks.sequence_breaks(rows.where("id <> '1.2'")).collect()[0].id == "1.3"
    page = blocks.read_html("<p>x<script>no()</script><b>y<br><p>z &amp; <i>w</i>")
    assert [b["text"] for b in page] == ["x **y**", "z & *w*"]


def test_section_spans():
    import random

    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(0, 30)
        sizes, heads = [rng.randint(1, 40) for _ in range(n)], [rng.random() < 0.3 for _ in range(n)]
        least, most, overlap = rng.choice([0, 30, 80]), rng.choice([50, 120]), rng.choice([0, 20, 60])
        length = lambda p: sum(sizes[i] for i in p) + 2 * (len(p) - 1)  # noqa: B023, E731
        parts, open_ = [], []
        for i in range(n):
            if heads[i] and open_ and length(open_) >= least:
                parts, open_ = [*parts, open_], []
            open_ = [*open_, i]
        if open_ and parts and length(open_) < least:
            parts[-1] = parts[-1] + open_
        elif open_:
            parts.append(open_)
        want = []
        for p in parts:
            if length(p) <= most:
                want.append((p[0], p[-1] + 1))
                continue
            now = []
            for i in p:
                if now and sum(sizes[j] for j in now) + sizes[i] > most:
                    want.append((now[0], now[-1] + 1))
                    now = [j for j in now if sum(sizes[k] for k in now if k >= j) <= overlap]
                now = [*now, i]
            want.append((now[0], now[-1] + 1))
        assert chunking.section_spans(sizes, heads, least, most, overlap) == want


def test_section_chunks(spark):
    rows = [("a", 0, "1", "header", "A"), ("a", 1, "1.1", "paragraph", "x" * 9), ("a", 2, "2", "header", "A"), ("a", 3, "2.1", "paragraph", "y" * 9), ("a", 4, "2.2", "paragraph", " "), ("a", 5, "2.3", "paragraph", "z" * 9), ("b", 0, "1", "paragraph", "p"), ("c", 0, "1", "paragraph", "")]
    got = chunking.section_chunks(spark.createDataFrame(rows, "article_id string, pos int, id string, type string, text string"), 20, 5, 9).orderBy("article_id", "idx").collect()
    assert [(r.article_id, r.idx, r.section, r.block_ids, r.char_count) for r in got] == [("a", 0, "A", ["1", "1.1"], 12), ("a", 1, "A", ["2", "2.1", "2.3"], 23), ("b", 0, None, ["1"], 1)]


def test_semantic_chunks(spark):
    rows = [(0, "aaa", [1.0, 0.0]), (1, "bbb", [1.0, 0.1]), (2, "c", [0.0, 1.0]), (3, "dd", [0.0, 0.0]), (4, " ", [1.0, 1.0])]
    blocks_ = spark.createDataFrame([("a", p, str(p), "paragraph", t, v) for p, t, v in rows], "article_id string, pos int, id string, type string, text string, v array<double>")
    cut = lambda least: [r.block_ids for r in chunking.semantic_chunks(blocks_, 0.5, least, vector="v").orderBy("idx").collect()]
    assert cut(1) == [["0", "1"], ["2"], ["3"]] and cut(2) == [["0", "1"], ["2", "3"]] and cut(4) == [["0", "1", "2", "3"]] and cut(99) == [["0", "1", "2", "3"]]


def test_folds(spark):
    frame = spark.createDataFrame([(["aaaa", "bb", "cccccccccccc", "d"], [3, 3, 5, 1, 9, 2])], "p array<string>, n array<int>")
    assert [tuple(r)[:2] for r in frame.select(chunking.pack(F.col("p"), 10)).first()[0]] == [(0, 2), (2, 3), (3, 4)]
    assert frame.select(chunking.merge_short(F.col("n"), 6)).first()[0] == [0, 0, 1, 1, 2, 2]
    odd = frame.sparkSession.createDataFrame([(1, None, None), (2, [], []), (3, ["x" * 30], [1]), (4, ["a", "b"], [9, 1])], "k int, p array<string>, n array<int>").coalesce(1)
    got = odd.orderBy("k").select(chunking.pack(F.col("p"), 10).alias("runs"), chunking.merge_short(F.col("n"), 6).alias("groups")).collect()
    assert [None if r.runs is None else [tuple(x) for x in r.runs] for r in got] == [None, [], [(0, 1, 31)], [(0, 2, 4)]]
    assert [r.groups for r in got] == [None, [], [0], [0, 0]]
    long = spark.createDataFrame([(1, "Aaa bbb. Ccc ddd! Zzz?")], "article_id long, text string")
    assert [r.text for r in chunking.hybrid_chunks(long, 12, 0.0).orderBy("idx").collect()] == ["Aaa bbb.", "Ccc ddd!", "Zzz?"]
    segments = spark.createDataFrame([("a", 0.0, 1.0), ("a", 1.2, 2.0), ("a", 3.0, 4.0)], "k string, start double, end double")
    assert [(r.start, r.end) for r in sessions.merge_segments(segments, ["k"]).orderBy("start").collect()] == [(0.0, 2.0), (3.0, 4.0)]


def test_tree(spark):
    leaves = spark.createDataFrame([("a", f"n{i:02d}", f"Text {i % 4}. More.", clustering.character_vector("abcd"[i % 4] * 5 + str(i))) for i in range(16)], "article_id string, node_id string, text string, embedding array<double>")
    got = clustering.summary_tree(leaves, clustering.character_vector).collect()
    ids = {r.node_id for r in got}
    assert len(ids) == len(got) and max(r.level for r in got) <= 3 and any(r.level == 1 for r in got)
    assert all(set(r.children_ids) <= ids and (r.level == 0) == (not r.children_ids) for r in got)
    for level in (1, 2, 3):
        children = [c for r in got if r.level == level for c in r.children_ids]
        assert len(children) == len(set(children))
    again = clustering.summary_tree(leaves.repartition(3), clustering.character_vector).collect()
    assert sorted((r.node_id, r.text) for r in got) == sorted((r.node_id, r.text) for r in again)


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e")], "a string, b string")
    start = spark.createDataFrame([("a",)], "node string")
    assert [(r.node, r.hop) for r in graph.bfs(spark, edges, start, 5).orderBy("hop").collect()] == [("a", 0), ("b", 1), ("c", 2)] and graph.bfs(spark, edges, start, 5, 2).count() == 2
    assert graph.dfs(edges, "b", 10) == ["b", "a", "c"]
    nodes = lambda *n: spark.createDataFrame([(x,) for x in n], "node string")
    assert graph.is_connected(spark, nodes("a", "b", "c"), edges) and not graph.is_connected(spark, nodes("a", "c"), edges)
    with pytest.raises(ValueError):
        graph.select_explicit(nodes("zz"), nodes("a"), "node")
    mentions = spark.createDataFrame([("s", "p", "o", 0.5, "c2"), ("s", "p", "o", 0.9, "c1"), ("s", "p", "o", None, "c1")], "subject string, predicate string, object string, confidence double, chunk_id string")
    assert tuple(graph.merge_edges(mentions, ["subject", "predicate", "object"]).first())[3:] == (0.9, ["c1", "c2"])
    links = spark.createDataFrame([(1, "t", "x", ["a"]), (2, "t", "y", ["a", "b"])], "o int, target string, display string, chunk_ids array<string>")
    assert tuple(graph.merge_links(links, ["target"], F.col("o"), ["display"]).first()) == ("t", "y", ["a", "a", "b"])
    words = spark.createDataFrame([(1, "w", "c1", ["x"]), (2, "w", "c2", [])], "o int, word string, category string, original_words array<string>")
    assert tuple(graph.upsert_keywords(words, F.col("o")).first()) == ("w", "c2", ["x"])
    has = spark.createDataFrame([("1", "k"), ("1", "only"), ("2", "k")], "article_id string, word string")
    left, kept = graph.delete_article("1", has, spark.createDataFrame([("k",), ("only",), ("free",)], "word string"))
    assert left.count() == 1 and sorted(r.word for r in kept.collect()) == ["free", "k"]


def test_concepts(spark):
    v = clustering.character_vector
    rows = [(w, a, c, f, "v1", i, v(w)) for i, (w, a, c, f) in enumerate([("spark", "1", "tech", 0.9), ("Spark", "1", "tech", 0.5), ("sparks", "2", "tech", 0.4), ("zebra", "2", "life", 0.0)])]
    members = spark.createDataFrame(rows, "word string, article_id string, category string, confidence double, version string, pos int, embedding array<double>")
    edges = spark.createDataFrame([("spark", "eats", "zebra", 0.5), ("zebra", "likes", "sparks", 0.7)], "subject string, predicate string, object string, confidence double")
    built, related = concepts.build(members, edges, 0.8)
    assert {(r.canonical_name, r.domain, tuple(r.source_articles)) for r in built.collect()} == {("spark", "tech", ("1", "2")), ("zebra", "life", ("2",))}
    assert [(r.n_edges, r.predicates, r.confidence) for r in related.collect()] == [(2, "eats, likes", 0.7)]
    state = spark.createDataFrame([("g", 1, True, "r1", None, 1, ["a"], ["1"])], "concept_group_id string, version int, is_active boolean, run_id string, previous_version int, created_at int, keyword_words array<string>, source_articles array<string>")
    delta = spark.createDataFrame([("g", ["a", "b"], ["2"]), ("h", ["c"], ["2"])], "concept_group_id string, keyword_words array<string>, source_articles array<string>")
    after = {(r.concept_group_id, r.version): (r.is_active, r.keyword_words, r.source_articles) for r in concepts.next_version(state, delta, "r2", F.lit(2)).collect()}
    assert after == {("g", 1): (False, ["a"], ["1"]), ("g", 2): (True, ["a", "b"], ["1", "2"]), ("h", 1): (True, ["c"], ["2"])}
    known = spark.createDataFrame([("1", "Spark", ["1"], {"1": "v"}), ("2", "Zebra", ["2"], {"1": "w", "2": "x"})], "concept_id string, canonical_name string, source_articles array<string>, source_versions map<string,string>")
    said = spark.createDataFrame([("spark", "ZEBRA", "eats", None), ("spark", "spark", "is", 1.0), ("spark", "nobody", "is", 1.0)], "source string, target string, predicate string, confidence double")
    assert [(r.source_id, r.target_id, r.confidence, r.source_articles, r.source_versions) for r in concepts.concept_relations(said, known).collect()] == [("1", "2", 0.5, ["1", "2"], {"1": "w", "2": "x"})]
    assert concepts.dry_run(members.withColumn("description", F.lit(None).cast("string"))).where("article_id = '1'").first().calls == 4
    entries = spark.createDataFrame([("k", 1, "aaaa"), ("k", 2, "bbbb"), ("k", 3, "c")], "k string, o int, text string")
    assert concepts.within_budget(entries, ["k"], ["o"], 10).count() == 2
    chunks = spark.createDataFrame([("k", "c0", 0, "short"), ("k", "c1", 0, "longer leaf"), ("k", "c2", 2, "broad")], "k string, chunk_id string, level int, text string")
    assert tuple(concepts.contexts(chunks, ["k"]).first()) == ("k", "broad", "longer leaf")


def test_keyword_tables(spark):
    raw = spark.createDataFrame([("1", "Js"), ("1", "other")], "article_id string, word string")
    assert sorted(r.word for r in keywords.refine(raw, spark.createDataFrame([("JS", "JavaScript")], "raw string, word string")).collect()) == ["JavaScript", "other"]


def test_sources(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "2025-12-01.md").write_text("# x\n- [ ] y")
    (tmp_path / "d" / "2025-W49.md").write_text("w")
    (tmp_path / "d" / "other.md").write_text("# T\nbody")
    (tmp_path / "d" / "p.html").write_text("<h1>H</h1><p>b")
    (tmp_path / "d" / "a_20250101_120000.yaml").write_text("k: [1, 2]")
    (tmp_path / "d" / "bad.yaml").write_text("k: [1")
    assert {r.note: r.grain for r in readers.notes(spark, str(tmp_path / "d")).collect()} == {"2025-12-01": "daily", "2025-W49": "weekly"}
    assert readers.documents(spark, str(tmp_path / "d")).where("article_id = 'p'").count() == 2
    yaml = {r.name: r for r in readers.yaml_documents(spark, str(tmp_path / "d")).collect()}
    assert yaml["a_20250101_120000.yaml"].json == '{"k": [1, 2]}' and yaml["a_20250101_120000.yaml"].version == "20250101_120000" and yaml["bad.yaml"].error
    (tmp_path / "a.csv").write_text("id,content_html\nx/1,\"<h1>T</h1>\n<p>b</p>\"\ny,\n")
    assert [(r.article_id, r.text) for r in readers.articles_csv(spark, str(tmp_path / "a.csv")).orderBy("pos").collect()] == [("x_1", "# T"), ("x_1", "b")]
    (tmp_path / "m1.csv").write_text("id,title\n1,old\n2,two\n")
    (tmp_path / "m2.csv").write_text("id,title\n1,new\n1,newest\n")
    assert {r.id: r.title for r in readers.metadata(spark, [str(tmp_path / n) for n in ("m1.csv", "none.csv", "m2.csv")]).collect()} == {"1": "newest", "2": "two"}
    readers.write_csv(spark.createDataFrame([(1, ["a", "b"], 'q"x')], "i int, l array<string>, t string"), str(tmp_path / "out"))
    assert [tuple(r) for r in spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "out")).collect()] == [("1", "a;b", 'q"x')]
    points = spark.createDataFrame([("a", [1.0, 2.0])], "node_id string, embedding array<double>")
    assert readers.upsert_vectors(points, spark.createDataFrame([("a", [3.0, 4.0]), ("b", [5.0, 6.0])], points.schema), 2).count() == 2
    with pytest.raises(Exception, match="hasn't 3 numbers"):
        readers.upsert_vectors(points, points, 3).collect()
    wide = spark.createDataFrame([("b", [5.0, 6.0, 7.0])], points.schema)
    assert {r.node_id for r in readers.upsert_vectors(points, wide, 3, recreate=True).collect()} == {"b"}
    assert {r.node_id for r in readers.upsert_vectors(points, wide, 3).collect()} == {"a", "b"}
    assert {r.node_id for r in readers.upsert_vectors(points, points.limit(0), 2, recreate=True).collect()} == {"a"}
    rows = [("2025-01-01", None, 'a "b", c', True, ["x", "y"], 7), ("2025-01-02", "7:30", None, None, [], None)]
    readers.write_plain_csv(spark.createDataFrame(rows, "date string, duration string, text string, no_phone boolean, people array<string>, quality int").coalesce(1), str(tmp_path / "plain"), ("text", "people"))
    (part,) = (tmp_path / "plain").glob("*.txt")
    want = ["date,duration,text,no_phone,people,quality"] + [f'{d},{v},"{t}",{n},"{";".join(p)}",{q}' for d, v, t, n, p, q in rows]
    assert part.read_bytes() == ("\n".join(want) + "\n").encode()


def test_streams(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    schema = "ts timestamp, event_type string, value double, user_id long"
    rows.select("ts", "event_type", "value", "user_id").repartitionByRange(3, "ts").write.parquet(str(tmp_path / "in"))
    query = streams.windowed_counts(streams.events(spark, str(tmp_path / "in"), schema), "60 days").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = rows.groupBy(F.window("ts", "1 day").start.alias("start"), "event_type").agg(F.count("*").alias("n"))
    assert spark.sql("select start, event_type, n from counts").exceptAll(want).isEmpty() and spark.table("counts").count() == want.count()


def test_grant_stream(spark, tmp_path):
    t = lambda h, m=0: datetime(2025, 1, 1, h, m)
    schema = "request_id long, event string, ts timestamp, ttl_minutes long"
    for k, part in enumerate([[(1, "approve", t(10), 30), (2, "approve", t(10), 600)], [(2, "revoke", t(11), 0), (3, "approve", t(12), 60)], [(4, "approve", t(20), 5)]]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = streams.grant_changes(streams.events(spark, str(tmp_path / "in"), schema, 10)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(120)
        del k
    got = {(r.request_id, r.status) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {(1, "approved"), (2, "approved"), (2, "revoked"), (3, "approved"), (1, "expired"), (4, "approved")} <= got and (2, "expired") not in got


def test_token_totals(spark):
    usage = spark.createDataFrame([("a", '{"usage":{"prompt_tokens":1,"completion_tokens":2}}'), ("b", "x")], "component string, answer string").select("component", text.token_usage(F.col("answer")).alias("u")).select("component", "u.*")
    assert {r.component: (r.total, r.calls) for r in readers.token_totals(usage).collect()} == {"a": (3, 1), "b": (0, 1), None: (3, 2)}


def test_globs_as_the_standard_library_reads_them(spark):
    globs = ["*", "**/*", "**/a.md", "[!x]bc", "[a-c]?.md", "[!a-c]*", "a[", "[]]", "n*/[!.]*", "x.md", "A/B*.MD", "a^b", "(a|b)", "{a,b}", "a\\b", "[[]x]"]
    paths = ["abc", "xbc", "a.md", "d/a.md", "bc.md", "a[", "]", "n/x.md", "n/.x", "x.md", "a/b1.md", "a/b\n.md", "a^b", "(a|b)", "{a,b}", "a/b", "[x]", "", "Ünï.md"]
    rules = spark.createDataFrame([acl.rule(k, g, allow=["READ"], users=["u"]) for k, g in enumerate(globs)], acl.RULES)
    got = {(r.path, r.pattern) for r in acl.matched(spark.createDataFrame([(p,) for p in paths], "path string"), rules).collect()}
    exact = lambda g: not set(g) & set("*?[")
    want = {(p, g) for p in paths for g in globs if (p.lower().replace("\\", "/") == g.lower() if exact(g) else re.match(fnmatch.translate(g.lower()), p.lower().replace("\\", "/")))}
    assert got == want


def test_policies_beyond_a_block(spark, monkeypatch):
    monkeypatch.setattr(acl, "MOST_GLOBS", 3)
    rules = spark.createDataFrame([acl.rule(k, f"d{k}/*", allow=["READ"], roles=["r"]) for k in range(10)] + [acl.rule(20, "d3/x", deny=["READ"], priority=5, users=["ann"])], acl.RULES)
    asked = spark.createDataFrame([("ann", f"d{k}/x", 1, k) for k in range(12)] + [("bob", "d1/x", 1, 1), (None, "d1/x", 1, 1), ("ann", None, 1, 1)], "user string, path string, perms int, allowed int")
    roles = spark.createDataFrame([("ann", "r")], "user string, role string")
    got = acl.can(asked, rules, roles)
    assert got.columns == ["user", "path", "perms", "allowed", "granted"]
    assert {(r.user, r.path) for r in got.collect() if r.granted} == {("ann", f"d{k}/x") for k in range(10) if k != 3}
    assert {r.allowed for r in acl.resolve(asked.where("user = 'bob' or path is null"), rules, roles, default_deny=False).collect()} == {15}


def test_null_and_ragged_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.6, 0.8]), (4, [None, 1.0]), (None, [1.0, 1.0]), (5, [0.0, 0.0])]
    points = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {(r.query_id, r.vec_id) for r in retrieval.knn(spark, points, points, 5).collect()} == {(a, b) for a in (1, 3, 5) for b in (1, 3, 5) if a != b}
    assert [(r.a, r.b, r.score) for r in retrieval.similar_pairs(points, 0.5).collect()] == [(1, 3, 0.6)]
    found = retrieval.classify(spark, points, spark.createDataFrame([("x", [1.0, 0.0]), ("y", None), ("z", [0.0, 1.0])], "name string, centroid array<double>"), "name")
    assert sorted((r.vec_id, r.best) for r in found.collect()) == [(1, "x"), (3, "z"), (5, "x")]
    ragged = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0])], "vec_id long, embedding array<double>").coalesce(1)
    with pytest.raises(Exception, match="different lengths"):
        retrieval.knn(spark, ragged, ragged, 1).collect()


def test_classes_beyond_a_block(spark, monkeypatch):
    rng = np.random.default_rng(4)
    points = spark.createDataFrame([(i % 30, v.tolist()) for i, v in enumerate(rng.normal(size=(40, 6)))], "vec_id long, embedding array<double>")
    classes = spark.createDataFrame([(f"c{i:02d}", v.tolist()) for i, v in enumerate(np.repeat(rng.normal(size=(9, 6)), 2, axis=0))], "name string, centroid array<double>")
    want = sorted(map(tuple, retrieval.classify(spark, points, classes, "name").collect()))
    monkeypatch.setattr(retrieval, "MOST_QUERIES", 4)
    assert sorted(map(tuple, retrieval.classify(spark, points, classes, "name").collect())) == want and len(want) == 40


def test_matching_has_a_small_number_in_its_denominator(spark):
    tiny = spark.createDataFrame([(1, [1e-9, 0.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>")
    found = retrieval.match_concepts(spark, tiny, spark.createDataFrame([("x", [1.0, 0.0])], "name string, centroid array<double>"), "name", 0.9, 0.5)
    assert {r.vec_id: (r.score, r.kind) for r in found.collect()} == {1: (0.090909, "unmatched"), 2: (1.0, "direct")}


def test_depth_first_in_a_graph_that_is_not_collected(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (9, 10)], "a long, b long")
    assert graph.dfs(edges, 1, 10) == graph.dfs(edges, 1, 10, most_edges=2) == [1, 2, 4, 3, 5]


@pytest.mark.parametrize("most", [1_000_000, 3])
def test_top_words_of_each_row(spark, monkeypatch, most):
    monkeypatch.setattr(keywords, "MOST_WORDS", most)
    texts = ["alpha beta beta gamma Alpha delta", "beta gamma gamma", None, "", "an it", "zeta zeta über über alpha", "beta gamma gamma"]
    docs = spark.createDataFrame([(f"d{min(i, 5)}", t) for i, t in enumerate(texts)], "doc_id string, text string").repartition(2)
    got = sorted((r.doc_id, r.rank, r.word, r.tf, round(r.score, 6)) for r in keywords.top_tfidf(docs, 2).collect())
    rows = [[w for w in (t or "").lower().split() if len(w) >= 4] for t in texts]
    want = []
    for i, own in enumerate(rows):
        score = lambda w: round(own.count(w) * np.log((len(texts) + 1) / (sum(w in r for r in rows) + 1)), 6)  # noqa: B023, E731
        first = sorted(set(own), key=lambda w: (-score(w), w))[:2]
        want += [(f"d{min(i, 5)}", k + 1, w, own.count(w), score(w)) for k, w in enumerate(first)]
    assert got == sorted(want)
    counted = {(r.doc_id, r.word): r.tf for r in keywords.mentions(docs).collect()}
    assert counted[("d5", "gamma")] == 2 and counted[("d5", "zeta")] == 2 and counted[("d0", "beta")] == 2
