"""Registered queries that SQL can't state, each against a plain version on small tables."""

import re
from collections import defaultdict
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorespark.operators import blocks, chunking, clustering
from lorespark.plans import load

SF = "/root/testdata/sf0.001"
QUERIES = load().QUERIES


def plain_blocks(html):
    """Blocks of the test tables' pages by cutting: titles, list items with one link, and runs of text between tags."""
    html = re.sub(r"(?s)<!--.*?-->|<head>.*?</head>|<script>.*?</script>|<style>.*?</style>|<!DOCTYPE[^>]*>", "", html)
    out, inside = [], None
    for tag, href, text in re.findall(r'(?:<(/?[a-z0-9]+)(?:\s+(?:href|class|lang)="([^"]*)")?[^>]*>)([^<]*)', html):
        text = unescape(re.sub(r"\s+", " ", text)).strip()
        if tag in ("h1", "h2", "h3"):
            out.append(("header", "#" * int(tag[1]) + " " + text))
        elif tag == "li":
            inside = "item"
        elif tag == "a" and inside == "item":
            out.append(("list_item", f"- [{text}]({href})"))
        elif tag == "/li":
            inside = None
        elif text:
            out.append(("text", text))
    return out


def test_html_blocks(spark):
    pages = {str(r.page_id): r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    found = defaultdict(list)
    for r in sorted(QUERIES["html_blocks"](spark, SF).collect(), key=lambda r: (r.article_id, r.pos)):
        found[r.article_id].append(r)
    assert set(found) == set(pages)
    squeezed = lambda t: re.sub(r"[\s*_`]+", "", t)
    for key, html in pages.items():
        want = plain_blocks(html)
        own = found[key]
        assert [b.pos for b in own] == list(range(len(own)))
        for kind in ("header", "list_item"):
            assert [b.text for b in own if b.type == kind] == [t for k, t in want if k == kind], key
        rest = squeezed("".join(b.text for b in own if b.type not in ("header", "list_item", "list")))
        assert rest == squeezed("".join(t for k, t in want if k == "text")), key
        # ids: a header opens a level, all else counts below the header it is under
        stack, counts = [], defaultdict(int)
        for b in own:
            while b.type == "header" and stack and stack[-1][0] >= b.level:
                stack.pop()
            parent = stack[-1][1] if stack else ""
            counts[parent] += 1
            want_id = f"{parent}.{counts[parent]}" if parent else str(counts[parent])
            assert b.id == want_id
            if b.type == "header":
                stack.append((b.level, want_id))


def held_blocks(spark):
    rows = QUERIES["html_blocks"](spark, SF).select("article_id", "pos", "id", "type", F.trim("text").alias("text")).where("text <> ''").collect()
    of = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.article_id, r.pos)):
        of[r.article_id].append(r)
    return of


def size(part):
    return sum(len(b.text) for b in part) + 2 * (len(part) - 1)


def carried(part, whole):
    heads = [b.text for b in whole[: whole.index(part[0]) + 1] if b.type == "header"]
    return heads[-1] if heads else None


def gathered(groups, least, length):
    """Groups run on until they are long enough; a short end belongs to the last."""
    out, now = [], []
    for g in groups:
        now = now + g
        if length(now) >= least:
            out.append(now)
            now = []
    if now:
        out = [*out[:-1], out[-1] + now] if out else [now]
    return out


def test_section_chunks(spark):
    got = defaultdict(list)
    for r in sorted(QUERIES["section_chunks"](spark, SF).collect(), key=lambda r: (r.article_id, r.idx)):
        got[r.article_id].append((r.section, r.text, list(r.block_ids), r.char_count))
    for key, whole in held_blocks(spark).items():
        sections = []
        for b in whole:
            if b.type == "header" or not sections:
                sections.append([])
            sections[-1].append(b)
        want = []
        for section in gathered(sections, 200, size):
            if size(section) <= 2000:
                want.append(section)
                continue
            first, least_stop = 0, 1
            while True:
                stop = least_stop
                while stop < len(section) and sum(len(b.text) for b in section[first : stop + 1]) <= 2000:
                    stop += 1
                want.append(section[first:stop])
                if stop == len(section):
                    break
                back = stop
                while back > first and sum(len(b.text) for b in section[back - 1 : stop]) <= 100:
                    back -= 1
                first, least_stop = back, stop + 1
        texts = ["\n\n".join(b.text for b in part) for part in want]
        assert got[key] == [(carried(p, whole), t, [b.id for b in p], len(t)) for p, t in zip(want, texts)], key


def vector(text):
    v = np.zeros(64)
    for c in text.lower():
        v[ord(c) % 64] += 1
    return v / (np.linalg.norm(v) or 1.0)


def test_semantic_chunks(spark):
    got = defaultdict(list)
    for r in sorted(QUERIES["semantic_chunks"](spark, SF).collect(), key=lambda r: (r.article_id, r.idx)):
        got[r.article_id].append((r.text, list(r.block_ids)))
    for key, whole in held_blocks(spark).items():
        groups = [[whole[0]]]
        for a, b in zip(whole, whole[1:]):
            if round(float(vector(a.text) @ vector(b.text)), 6) < 0.8:
                groups.append([])
            groups[-1].append(b)
        want = gathered(groups, 200, lambda part: sum(len(b.text) for b in part))
        assert got[key] == [("\n\n".join(b.text for b in p), [b.id for b in p]) for p in want], key


def test_hybrid_chunks(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("text is not null").collect()}
    got = defaultdict(list)
    for r in sorted(QUERIES["hybrid_chunks"](spark, SF).collect(), key=lambda r: (r.article_id, r.idx)):
        got[r.article_id].append(r.text)
    for key, text in docs.items():
        pieces = [p for p in re.sub(r"([.!?])\s+", "\\1\x01", text).split("\x01") if p]
        want = [" ".join(pieces)] if pieces else []
        if pieces and len(want[0]) > 2000:
            want = [pieces[0]]
            for a, b in zip(pieces, pieces[1:]):
                if float(vector(a) @ vector(b)) >= 0.6 and len(want[-1]) + len(b) + 1 <= 2000:
                    want[-1] += " " + b
                else:
                    want.append(b)
        assert got[key] == want, key


def test_summary_tree(spark):
    rows = QUERIES["summary_tree"](spark, SF).collect()
    trees = defaultdict(lambda: defaultdict(list))
    for r in rows:
        trees[r.article_id][r.level].append(r)
    assert max(max(t) for t in trees.values()) >= 1
    for article, levels in trees.items():
        for level in levels:
            nodes = sorted(levels[level], key=lambda r: r.node_id)
            below = {r.node_id: r for r in levels.get(level - 1, [])}
            taken = [c for r in nodes for c in r.children_ids]
            assert len(taken) == len(set(taken)) and set(taken) <= set(below) or level == 0
            if level:
                assert len(below) > 3 and level <= 3 and all(len(r.children_ids) >= 2 for r in nodes)
                assert [r.node_id for r in nodes] == [f"{article}_summary_L{level}_{k:03d}" for k in range(len(nodes))]
                for r in nodes:
                    assert r.text == clustering.first_sentences([below[c].text for c in r.children_ids], 1400)
                    assert np.allclose(r.embedding, vector(r.text))


def test_tree_of_whole_graph_walks(spark, tmp_path):
    """Components of many small chains, a star and loops."""
    edges = [(i, i + 1) for i in range(0, 60) if i % 7] + [(100, k) for k in range(101, 140)] + [(5, 5), (3, 2), (2, 3)]
    spark.createDataFrame([(a, b - 1_000_000, 1.0, 0.0) for a, b in edges], "l_suppkey long, l_partkey long, l_quantity double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    want = {}
    for start in sorted(near):
        level = [start] if start not in want else []
        while level:
            want |= dict.fromkeys(level, start)
            level = [n for x in level for n in near[x] if n not in want]
    assert {r.node: r.component for r in QUERIES["connected_components"](spark, str(tmp_path)).collect()} == want


@pytest.mark.parametrize("html", [None, "", "<p>", "plain", "<ul><li>a<ul><li>b", "<h1>t</h1>" * 3])
def test_odd_pages(spark, html):
    frame = spark.createDataFrame([("a/b", html)], "article_id string, html string")
    rows = blocks.html_blocks(frame).collect()
    assert all(r.article_id == "a_b" for r in rows) and [r.pos for r in sorted(rows)] == list(range(len(rows)))
    assert chunking.section_chunks(blocks.html_blocks(frame)).count() >= bool(html and "plain" in html)
