"""Quality rules as a short-circuit cascade.

Counts that are always reported come first.  The rules are then ordered by what they
reject for their cost, both estimated on a sample where it lies, and a document leaves
the cascade at the first rule that rejects it.  A document is kept only if no rule rejects
it, so the order decides the cost and never the verdict.  The unit of cost is a character
that is read, so reruns have the same order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm.common import slices

SEPARATORS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Documents of the sample, about; they are chosen by a hash and read whole, and only sums of the rules leave the tasks.
SAMPLE_DOCS = 200


@dataclass(frozen=True)
class Facts:
    """What the base counts leave for the rules."""

    text: str
    words: list[bytes]
    kinds: np.ndarray
    counts: list[int]
    n_dup_lines: int


@dataclass(frozen=True)
class Rule:
    """``reads`` is what a verdict costs: the characters that the rule reads beside the base counts."""

    name: str
    rejects: Callable[[Facts], bool]
    reads: Callable[[Facts], int] = lambda f: 1


#: Kinds of characters.
OTHER, SEPARATOR, SYMBOL, LETTER, UPPER = range(5)


@lru_cache(1)
def _kind_table() -> np.ndarray:
    """The kind of every code point."""
    every = "".join(map(chr, range(0xD800))) + " " * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
    table = np.zeros(len(every), dtype=np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (UPPER, r"\p{Lu}")):
        table[[m.start() for m in regex.finditer(pattern, every)]] = kind
    table[[ord(c) for c in SEPARATORS]], table[[ord(c) for c in SYMBOLS]] = SEPARATOR, SYMBOL
    return table


_LOUD = regex.compile(r"(?:!!|\?\?|\.\.\.\.)")


def _letter_words(kinds: np.ndarray) -> int:
    """Words with a letter, out of the kinds of a text's characters."""
    word = kinds != SEPARATOR
    starts = word.copy()
    starts[1:] &= ~word[:-1]
    own = np.cumsum(starts)[kinds >= LETTER]
    return int((np.diff(own) != 0).sum()) + 1 if len(own) else 0


def _lines(text: str) -> int:
    return sum(1 for x in text.split("\n") if x.strip(SEPARATORS))


RULES = (
    Rule("symbols", lambda f: 10 * f.counts[SYMBOL] > len(f.words)),
    Rule("repeated_lines", lambda f: 10 * f.n_dup_lines > 4 * _lines(f.text), lambda f: len(f.text)),
    Rule("shouting", lambda f: 10 * f.counts[UPPER] > 3 * (f.counts[LETTER] + f.counts[UPPER])),
    Rule("loud_marks", lambda f: 10 * len(_LOUD.findall(f.text)) > len(f.words), lambda f: len(f.text)),
    Rule("few_letter_words", lambda f: 10 * _letter_words(f.kinds) < 7 * len(f.words), lambda f: 4 * len(f.kinds)),
    Rule("word_length", lambda f: not 2 * len(f.words) <= len(f.kinds) - f.counts[SEPARATOR] <= 14 * len(f.words)),
)


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that are found twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    # a word's number is the place where it is first seen
    ids = np.fromiter(map(numbers.setdefault, words, count()), dtype=np.uint64, count=len(words))
    k = np.uint64(len(words))
    pairs = ids[:-1] * k + ids[1:]
    if len(words) > 2_000_000:  # three would not fit: renumber the pairs
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.uint64)
    triples = pairs[:n] * k + ids[2:]
    order = np.argsort(triples)
    same = np.diff(triples[order]) == 0
    found = np.zeros(n, dtype=np.int64)
    found[order] = np.append(same, False) | np.concatenate([[False], same])
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    edge[:n] += found
    edge[3 : n + 3] -= found
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base(text: str | None) -> tuple[Facts, int, int, bool]:
    """The facts, characters in words, repeated words, and whether the base counts fail."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    kinds = _kind_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    counts = np.bincount(kinds, minlength=5).tolist()
    seen, repeats = set(), 0
    for line in text.split("\n"):
        if line in seen:
            repeats += bool(line.strip(SEPARATORS))
        else:
            seen.add(line)
    again = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * again > 50 * len(words)
    return Facts(text, words, kinds, counts, repeats), len(text) - counts[SEPARATOR], again, failed


def estimates(texts: list[str | None], rules: tuple[Rule, ...] = RULES) -> list[tuple[str, int, int, int]]:
    """Of each rule: its name, the texts that reach it, those it rejects, and its cost over them."""
    facts = [f for f, _, _, failed in map(base, texts) if not failed]
    return [(r.name, len(facts), sum(bool(r.rejects(f)) for f in facts), sum(r.reads(f) for f in facts)) for r in rules]


def ordered(found: list[tuple[str, int, int, int]]) -> tuple[list[str], dict[str, dict[str, float]]]:
    """Rule names by rejection per cost, and what was estimated."""
    # one imagined rejection keeps rules without any in order of their cost
    stats = {name: {"cost": (cost + 1) / (n + 1), "selectivity": (rejected + 1) / (n + 2)} for name, n, rejected, cost in found}
    return sorted(stats, key=lambda n: (-stats[n]["selectivity"] / stats[n]["cost"], n)), stats


def _sampled(docs: DataFrame) -> list[tuple[str, int, int, int]]:
    """The estimates over about ``SAMPLE_DOCS`` documents, added up over all tasks."""

    def run(batches):
        for batch in slices(batches, "text"):
            columns = zip(*estimates(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["rule", "n", "rejected", "cost"])

    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    h = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")), F.lit(1 << 30))
    chosen = docs.where(h < int(share * (1 << 30))).select(F.col("text").cast("string").alias("text"))
    sums = chosen.mapInArrow(run, "rule string, n long, rejected long, cost long").groupBy("rule").agg(F.sum("n"), F.sum("rejected"), F.sum("cost"))
    found = {r[0]: tuple(r) for r in sums.collect()}  # a row a rule
    return [found.get(r.name, (r.name, 0, 0, 0)) for r in RULES]


def judge(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Base counts and verdict of every row, in one pass without a shuffle.

    Columns: ``doc_id``, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words``, ``base_failed``, ``kept`` and ``rejected_by`` (``base``, the rule
    that ended the cascade, or null).  A null or empty text has no words and fails the
    base.  Texts of any length are read whole.  Repeated rows are judged one by one; further columns, whatever their names, are
    not read; an empty table gives none.
    """
    names, _ = ordered(_sampled(docs))

    def run(batches):
        by_name = {r.name: r for r in RULES}
        cascade = [by_name[n] for n in names]
        for batch in slices(batches, "text"):
            rows = []
            for text in batch.column("text").to_pylist():
                facts, chars, again, failed = base(text)
                by = "base" if failed else next((r.name for r in cascade if r.rejects(facts)), None)
                rows.append((len(facts.words), chars, facts.counts[SYMBOL], facts.n_dup_lines, again, failed, by is None, by))
            columns = list(zip(*rows))
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], NAMES)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string"
    )


NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by"]

SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
tri AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
hot AS (SELECT doc_id, g FROM tri GROUP BY ALL HAVING count(*) > 1),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM tri JOIN hot USING (doc_id, g)) GROUP BY doc_id),
ln AS (
  SELECT doc_id, count(*) FILTER (len(trim(l, E' \t\n\x0b\x0c\r')) > 0) AS n_lines,
         count(*) FILTER (len(trim(l, E' \t\n\x0b\x0c\r')) > 0)
           - count(DISTINCT l) FILTER (len(trim(l, E' \t\n\x0b\x0c\r')) > 0) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(t, E'\n')) AS l FROM w) GROUP BY doc_id),
f AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, len(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         len(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(n_lines, 0) AS n_lines,
         len(regexp_replace(t, '[^\p{Lu}]', '', 'g')) AS upper, len(regexp_replace(t, '[^\p{L}]', '', 'g')) AS letters,
         len(regexp_extract_all(t, '!!|\?\?|\.\.\.\.')) AS loud,
         len(list_filter(ws, lambda x: regexp_matches(x, '\p{L}'))) AS letter_words
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN ln USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (10 * n_symbols > n_words OR 10 * n_dup_lines > 4 * n_lines OR 10 * upper > 3 * letters
         OR 10 * loud > n_words OR 10 * letter_words < 7 * n_words OR word_chars < 2 * n_words OR word_chars > 14 * n_words) AS kept
FROM b
"""
