"""HTML and Markdown to numbered blocks, and ranges, assets and checks of blocks."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.operators.tables import spread

INLINE = "struct<type:string,order:int,text:string,href:string,src:string,alt:string,marks:array<string>>"
BLOCKS = f"article_id string, pos int, id string, type string, level int, text string, code string, lang string, inlines array<{INLINE}>"
#: Characters of articles whose blocks are held at once, or one article.
SLICE_CHARACTERS = 1 << 20
_MARKS = {"b": "bold", "strong": "bold", "i": "italic", "em": "italic", "code": "code"}
_SKIP = ("script", "style", "head", "noscript", "template")


class _Reader(HTMLParser):
    """Collects blocks with their inlines from HTML; unclosed tags end with their block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[dict] = []
        self.inlines: list[dict] = []
        self.marks: list[str] = []
        self.href = self.code = None
        self.kind, self.level, self.depth, self.skip, self.quote = "paragraph", 0, 0, 0, 0

    def finish(self) -> None:
        if self.code is not None:
            self.blocks.append({"type": "code", "level": 0, "code": "".join(self.code).strip("\n"), "lang": self.code_lang, "inlines": []})
            self.code = None
        elif any(x["text"] or x["type"] == "image" for x in self.inlines):
            self.blocks.append({"type": self.kind, "level": self.level, "code": None, "lang": None, "inlines": self.inlines})
        self.inlines = []

    def start(self, kind: str, level: int = 0) -> None:
        self.finish()
        self.kind, self.level, self.marks, self.href = kind, level, [], None

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        if tag in _SKIP:
            self.skip += 1
        elif re.fullmatch("h[1-6]", tag):
            self.start("header", int(tag[1]))
        elif tag in ("ul", "ol"):
            self.depth += 1
            self.start("list_item", self.depth)
        elif tag == "li":
            self.start("list_item", max(1, self.depth))
        elif tag == "blockquote":
            self.quote += 1
            self.start("blockquote")
        elif tag == "pre":
            self.finish()
            self.code, self.code_lang = [], None
        elif tag in ("p", "div", "article", "section", "footer", "nav", "header", "main", "table", "tr", "body", "td", "th"):
            self.start("blockquote" if self.quote else "list_item" if self.depth else "paragraph", self.depth)
        elif tag == "a":
            self.href = given.get("href")
        elif tag == "img":
            self.add("image", "", src=given.get("src"), alt=given.get("alt"))
        elif tag == "code" and self.code is not None:
            found = re.search(r"language-(\S+)", given.get("class") or "")
            self.code_lang = found and found[1]
        elif tag in _MARKS:
            self.marks.append(_MARKS[tag])

    def handle_endtag(self, tag):
        if tag in _SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag in ("ul", "ol"):
            self.finish()
            self.depth = max(0, self.depth - 1)
        elif tag == "blockquote":
            self.finish()
            self.quote = max(0, self.quote - 1)
        elif tag == "a":
            self.href = None
        elif tag in _MARKS and self.code is None:
            if _MARKS[tag] in self.marks:
                self.marks.remove(_MARKS[tag])
        elif re.fullmatch("h[1-6]|p|div|li|pre|article|section|footer|nav|table|tr|td|th", tag):
            self.start("paragraph")

    def handle_data(self, data):
        if self.skip:
            return
        if self.code is not None:
            self.code.append(data)
        elif data.strip():
            self.add("link" if self.href is not None else "text", re.sub(r"\s+", " ", data).strip(), href=self.href)

    def add(self, kind, text, href=None, src=None, alt=None):
        self.inlines.append({"type": kind, "order": len(self.inlines), "text": text, "href": href, "src": src, "alt": alt, "marks": list(self.marks)})


def markdown_to_html(source: str) -> str:
    """Headings, lists, quotes, fences, links, images and marks of Markdown as HTML."""
    from html import escape

    out, fence, listed, paragraph = [], None, 0, []

    def inline(t: str) -> str:
        t = escape(t, quote=False)
        t = re.sub(r"!\[([^\]]*)\]\(([^)\s]+)\)", r'<img alt="\1" src="\2">', t)
        t = re.sub(r"(?<!!)\[([^\]]*)\]\(([^)\s]+)\)", r'<a href="\2">\1</a>', t)
        t = re.sub(r"`([^`]+)`", r"<code>\1</code>", t)
        t = re.sub(r"\*\*([^*]+)\*\*", r"<b>\1</b>", t)
        return re.sub(r"(?<!\*)\*([^*]+)\*(?!\*)", r"<i>\1</i>", t)

    def close():
        nonlocal listed
        if paragraph:
            out.append(f"<p>{inline(' '.join(paragraph))}</p>")
            paragraph.clear()
        out.extend(["</ul>"] * listed)
        listed = 0

    for line in source.split("\n"):
        if fence is not None:
            if line.strip().startswith("```"):
                out.append(f'<pre><code class="language-{fence}">' + escape("\n".join(code)) + "</code></pre>" if fence else "<pre>" + escape("\n".join(code)) + "</pre>")
                fence = None
            else:
                code.append(line)
            continue
        if line.strip().startswith("```"):
            close()
            fence, code = line.strip()[3:].strip(), []
        elif m := re.match(r"(#{1,6})\s+(.*)", line):
            close()
            out.append(f"<h{len(m[1])}>{inline(m[2])}</h{len(m[1])}>")
        elif m := re.match(r"(\s*)(?:[-*+]|\d+\.)\s+(.*)", line):
            depth = len(m[1]) // 2 + 1
            if paragraph:
                close()
            while listed < depth:
                out.append("<ul>")
                listed += 1
            while listed > depth:
                out.append("</ul>")
                listed -= 1
            out.append(f"<li>{inline(m[2])}</li>")
        elif line.startswith(">"):
            close()
            out.append(f"<blockquote>{inline(line[1:].strip())}</blockquote>")
        elif line.strip():
            if listed:
                close()
            paragraph.append(line.strip())
        else:
            close()
    close()
    return "\n".join(out)


def number(blocks: list[dict]) -> list[str]:
    """Hierarchical ids: headers open a level, all else is numbered one level below the header it is under."""
    stack: list[tuple[int, str]] = []
    counters: dict[str, int] = {}
    out = []
    for b in blocks:
        if b["type"] == "header":
            while stack and stack[-1][0] >= b["level"]:
                stack.pop()
        parent = stack[-1][1] if stack else ""
        counters[parent] = counters.get(parent, 0) + 1
        own = f"{parent}.{counters[parent]}" if parent else str(counters[parent])
        if b["type"] == "header":
            stack.append((b["level"], own))
        out.append(own)
    return out


def _plain(inlines: list[dict]) -> str:
    def one(x):
        text = x["text"]
        if x["type"] == "image" or not text:
            return ""
        text = f"[{text}]({x['href'] or ''})" if x["type"] == "link" else text
        for m in x["marks"]:
            text = {"bold": f"**{text}**", "italic": f"*{text}*", "code": f"`{text}`"}[m]
        return text

    return " ".join(t for t in map(one, inlines) if t)


def read_html(source: str | None) -> list[dict]:
    """Blocks of an HTML document in order, with ids and rendered texts."""
    reader = _Reader()
    reader.feed(source or "")
    reader.close()
    reader.finish()
    for k, (b, own) in enumerate(zip(reader.blocks, number(reader.blocks))):
        text = _plain(b["inlines"])
        b |= {"pos": k, "id": own, "text": {"header": "#" * b["level"] + " " + text, "list_item": "- " + text}.get(b["type"], text)}
    return reader.blocks


def html_blocks(pages: DataFrame, source: str = "html", markdown: bool = False) -> DataFrame:
    """Blocks of each article (``article_id`` and a column of HTML or Markdown); empty ones are skipped."""

    def run(frames):
        columns = ["article_id", "pos", "id", "type", "level", "text", "code", "lang", "inlines"]
        for frame in frames:
            rows, held = [], 0
            for article, body in zip(frame["article_id"], frame["body"]):
                for b in read_html(markdown_to_html(body) if markdown else body):
                    rows.append((article, b["pos"], b["id"], b["type"], b["level"], b["text"], b["code"], b["lang"], b["inlines"]))
                held += len(body)
                if held >= SLICE_CHARACTERS:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=columns)

    chosen = pages.select(F.regexp_replace(F.col("article_id").cast("string"), "/", "_").alias("article_id"), F.col(source).alias("body")).where("body is not null and trim(body) <> ''")
    return spread(chosen).mapInPandas(run, BLOCKS)


def page_links(pages: DataFrame, by: str, source: str = "html") -> DataFrame:
    """Anchors of a page cut out by pattern: ``pos``, ``href``, ``label``."""
    pattern = F.lit('<a href="([^"]*)">([^<]*)</a>')
    pairs = F.arrays_zip(F.regexp_extract_all(source, pattern, F.lit(1)).alias("href"), F.regexp_extract_all(source, pattern, F.lit(2)).alias("label"))
    return pages.select(by, F.posexplode(pairs).alias("pos", "a")).select(by, "pos", F.col("a")["href"].alias("href"), F.col("a")["label"].alias("label"))


def assets(blocks: DataFrame) -> DataFrame:
    """Links and images of the blocks, with their place."""
    flat = blocks.select("article_id", F.col("id").alias("block_id"), F.explode("inlines").alias("x")).where("x.type in ('link', 'image')")
    return flat.select("article_id", "block_id", F.col("x.type").alias("kind"), F.col("x.order").alias("order"), F.coalesce("x.href", "x.src").alias("target"), F.when(F.col("x.type") == "image", F.col("x.alt")).otherwise(F.col("x.text")).alias("text"))


def text_range(blocks: DataFrame, start: str, end: str | None = None) -> DataFrame:
    """Text from one block id to another, blanks dropped, joined by empty lines.

    Without an end, the block and all below it; with one that isn't there, to the end of
    the document.
    """
    if end is None:
        chosen = blocks.where((F.col("id") == start) | F.col("id").startswith(start + "."))
    else:
        of = Window.partitionBy("article_id")
        first, last = (F.min(F.when(F.col("id") == i, F.col("pos"))).over(of) for i in (start, end))
        chosen = blocks.withColumns({"_a": first, "_b": last}).where("pos >= _a and (_b is null or pos <= _b)")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
    return chosen.where("trim(text) <> ''").groupBy("article_id").agg(F.array_join(parts, "\n\n").alias("text"))


def sequence_breaks(blocks: DataFrame) -> DataFrame:
    """Block ids that skip a number: below each parent a child is at most one more than the highest before it."""
    child: Column = F.regexp_extract("id", r"([0-9]+)$", 1).try_cast("int")
    parent = F.regexp_replace("id", r"\.?[^.]+$", "")
    before = Window.partitionBy("article_id", "_parent").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    marked = blocks.withColumns({"_child": child, "_parent": parent}).where("_child is not null")
    return marked.withColumn("_most", F.coalesce(F.max("_child").over(before), F.lit(0))).where("_child > _most + 1").select("article_id", "id")
