"""How the sources of a language differ in their use of words.

Terms are counted once, inside the tasks first.  The most overused terms of a group (one
source in one language) are found by upper bounds: terms lie in buckets by their count in
the group, and the largest share in a bucket less the least share that the language gives
one of its terms bounds the difference of all of them.  Buckets are evaluated best first,
a batch a round for all groups at once, until every bucket left is bounded strictly below
the group's k-th difference.  Distances between groups come from postings: the lists of
groups that have a term give the terms that two groups share, and histograms of each
group's shares give the rest, so no group meets the terms that it lacks.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorespark.llm import words
from lorespark.llm.common import Scratch, byte_values, shuffle_partitions, slices

LEAST_DOCS = 30
TOP = 50
#: Terms that a task counts before it passes its counts on.
HELD_TERMS = 400_000
#: Counts below this have a bucket each; larger ones share it with those of the same leading bits.
EXACT_COUNTS = 1024
#: Terms of a group that the first round evaluates, and how the number grows.
FIRST_TERMS, GROWTH = 2 * TOP, 8
#: Sources of a language that one tile compares with as many others.
TILE = 256
#: Parts of a tile's terms; a task adds up all parts of a tile that it gets, so that more of them only deal more evenly.
SLICES = 1024


def _tally(batches):
    """Occurrences and documents of each term in each group, added up inside the task."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def flush():
        for (lang, source), (n, docs) in held.items():
            terms = pa.array(n.keys(), pa.binary()).cast(pa.string())
            columns = [pa.array([x] * len(n), pa.string()) for x in (lang, source)]
            yield pa.RecordBatch.from_arrays([*columns, terms, pa.array(n.values(), pa.int64()), pa.array([docs[t] for t in n], pa.int64())], ["lang", "source", "term", "n", "docs"])
        held.clear()

    for batch in batches:
        for part in slices([batch], "text"):
            for lang, source, text in zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), byte_values(part.column("text"))):
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                seen: set[bytes] = set()
                for own in words.pieces(text, words.LETTERS):
                    n.update(own)
                    seen.update(own)
                docs.update(seen)
                size += len(seen)
                if size >= HELD_TERMS:
                    yield from flush()
                    size = 0
    yield from flush()


def _share(count: str, total: str, terms: str) -> Column:
    """Smoothed share of a term in parts of 10^9; decimals keep it exact at any count."""
    return F.expr(f"1 + (cast(1000000000 as decimal(10,0)) * cast({count} + 5 as decimal(20,0))) div cast({total} + 5 * {terms} as decimal(20,0))")


class Audit:
    """Written tables of one corpus: ``groups``, numbered by source within a language, and ``postings`` of the kept terms."""

    def __init__(self, spark: SparkSession, docs: DataFrame, least_docs: int = LEAST_DOCS, tile: int = TILE):
        self.spark, self.scratch, self.tile = spark, Scratch(spark, "divergence"), tile
        named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
        texts = docs.select(*named, F.col("text").cast("string").alias("text"))
        tallied = texts.mapInArrow(_tally, "lang string, source string, term string, n long, docs long")
        counts = self.scratch.save(tallied.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
        kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= least_docs)
        kept = self.scratch.save(kept.select("lang", "term", "lang_n"), "kept")
        found = self.scratch.save(counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "found")
        self.scratch.drop(counts)
        langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
        groups = docs.select(*named).distinct().join(found.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("terms")), ["lang", "source"], "left")
        groups = groups.join(langs, "lang", "left").fillna(0, ["total", "terms", "v", "lang_total"])
        groups = groups.withColumn("p0", F.when(F.col("v") > 0, _share("0", "total", "v")).otherwise(0))
        # one row a source: its number in the language
        groups = groups.withColumn("sid", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
        self.groups = self.scratch.save(groups, "groups")
        shares = found.join(self.groups, ["lang", "source"])
        shares = shares.select("lang", "source", "sid", "term", "n", _share("n", "total", "v").alias("p"), _share("lang_n", "lang_total", "v").alias("q"), "p0")
        self.postings = self.scratch.save(shares, "postings")
        self.scratch.drop(found, kept)

    # --- terms ------------------------------------------------------------------------

    def _banded(self) -> DataFrame:
        """Postings with the bucket of their count."""
        drop = f"greatest(0, length(bin(n)) - length(bin({EXACT_COUNTS - 1})))"
        return self.postings.select("lang", "sid", "term", "p", "q", F.expr(f"shiftleft(shiftright(n, {drop}), {drop})").alias("band"))

    def top_terms(self, k: int = TOP) -> DataFrame:
        """The ``k`` terms of each group with the largest excess over the language: ``lang``, ``source``, ``item``, ``value``, ``rank``."""
        key = ["lang", "sid"]
        banded = self._banded()
        buckets = banded.groupBy(*key, "band").agg((F.max("p") - F.min("q")).alias("bound"), F.count("*").alias("terms")).where("bound > 0")
        order = Window.partitionBy(*key).orderBy(F.desc("bound"), "band")  # a group has a bounded number of buckets
        buckets = self.scratch.save(buckets.withColumn("before", F.sum("terms").over(order) - F.col("terms")), "buckets")
        best = self.spark.createDataFrame([], "lang string, sid int, term string, value long")
        floor = self.spark.createDataFrame([], "lang string, sid int, floor long")
        low, high, written = 0, FIRST_TERMS, []
        while True:
            open_ = buckets.where(F.col("before") >= low).join(floor, key, "left").where("floor is null or bound >= floor")
            if open_.isEmpty():
                break
            now = banded.join(open_.where(F.col("before") < high).select(*key, "band"), [*key, "band"], "left_semi").where("p > q")
            ranked = best.unionByName(now.select(*key, "term", (F.col("p") - F.col("q")).alias("value")))
            ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("value"), "term"))).where(F.col("rank") <= k)
            found = self.scratch.save(ranked, "best")
            self.scratch.drop(*written)
            best, floor, written = found.drop("rank"), found.where(F.col("rank") == k).select(*key, F.col("value").alias("floor")), [found]
            low, high = high, high * GROWTH
        if not written:
            return best.select("lang", F.lit("").alias("source"), F.col("term").alias("item"), "value", F.lit(0).alias("rank"))
        return found.join(self.groups.select("lang", "sid", "source"), key).select("lang", "source", F.col("term").alias("item"), "value", "rank")

    # --- pairs ------------------------------------------------------------------------

    def distances(self) -> DataFrame:
        """Sum over the kept terms of the difference of shares, for each two groups of a language: ``lang``, ``lo``, ``hi``, ``value``."""
        # what each group's own terms differ from the other's share of a term that it lacks; all two groups are named here
        histogram = self.postings.groupBy("lang", "sid", "p").agg(F.count("*").alias("m")).groupBy("lang", "sid").agg(F.collect_list(F.struct("p", "m")).alias("shares"))
        own = self.groups.select("lang", "sid", "p0", "terms", "v").join(histogram, ["lang", "sid"], "left")
        others = self.groups.groupBy("lang", (F.col("sid") / self.tile).cast("int").alias("tile")).agg(F.collect_list(F.struct("sid", "p0", "terms")).alias("others"))
        alone = own.join(others, "lang").mapInArrow(_alone, "lang string, lo int, hi int, value long")
        # correction for the terms that both have, from the postings of each term
        tiles = self.groups.groupBy("lang").agg((F.max("sid") / self.tile).cast("int").alias("last_tile"))
        dealt = self.postings.select("lang", "sid", "term", "p", "p0").join(tiles, "lang").withColumn("other", F.explode(F.sequence(F.lit(0), "last_tile")))
        tile = (F.col("sid") / self.tile).cast("int")
        dealt = dealt.select("lang", F.least(tile, "other").alias("i"), F.greatest(tile, "other").alias("j"), F.pmod(F.xxhash64("term"), F.lit(SLICES)).alias("slice"), "term", "sid", "p", "p0")
        keys = ["lang", "i", "j", "slice"]
        shared = dealt.repartition(shuffle_partitions(self.spark), *keys).sortWithinPartitions(*keys, "term", "sid").mapInArrow(_shared(self.tile), "lang string, lo int, hi int, value long")
        return alone.unionByName(shared).groupBy("lang", "lo", "hi").agg(F.sum("value").alias("value"))

    def pairs(self) -> DataFrame:
        """Every other source of the language for each group, the most distant first: ``lang``, ``source``, ``item``, ``value``, ``rank``."""
        one = self.distances()
        both = one.select("lang", F.explode(F.array(F.struct(F.col("lo").alias("a"), F.col("hi").alias("b")), F.struct(F.col("hi").alias("a"), F.col("lo").alias("b")))).alias("s"), "value")
        names = self.groups.select("lang", "sid", "source")
        named = both.select("lang", "s.*", "value").join(names.withColumnRenamed("sid", "a"), ["lang", "a"]).join(names.select("lang", F.col("sid").alias("b"), F.col("source").alias("item")), ["lang", "b"])
        return named.select("lang", "source", "item", "value", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank"))


_PAIR = ["lang", "lo", "hi", "value"]


def _alone(batches):
    """Sums over a group's terms of their distance from the other's least share, by prefix sums over its sorted shares."""
    for batch in batches:
        for row in batch.to_pylist():
            shares = np.array(sorted((s["p"], s["m"]) for s in row["shares"] or ()), dtype=np.int64).reshape(-1, 2)
            p, m = shares[:, 0], shares[:, 1]
            number, weight = np.concatenate([[0], np.cumsum(m)]), np.concatenate([[0], np.cumsum(p * m)])
            other = np.array([(o["sid"], o["p0"], o["terms"]) for o in row["others"] if o["sid"] != row["sid"]], dtype=np.int64).reshape(-1, 3)
            sid, x, terms = other.T
            at = np.searchsorted(p, x)
            value = (weight[-1] - weight[at]) - x * (number[-1] - number[at]) + x * number[at] - weight[at]
            # terms that neither has are counted once for the two
            first = row["sid"] < sid
            value += np.where(first, (row["v"] - row["terms"] - terms) * np.abs(row["p0"] - x), 0)
            columns = [pa.array([row["lang"]] * len(sid), pa.string()), *(pa.array(f(sid, row["sid"]), pa.int32()) for f in (np.minimum, np.maximum)), pa.array(value)]
            yield pa.RecordBatch.from_arrays(columns, _PAIR)


def _runs(batches):
    """Rows of one tile at a time, in parts that never cut the rows of a term."""
    held: list[pa.RecordBatch] = []

    def parts(table: pa.Table, last: bool):
        key = table.select(["lang", "i", "j"]).to_pandas()
        new = (key != key.shift()).any(axis=1).to_numpy()
        cuts = [*np.flatnonzero(new).tolist(), table.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            whole = table.slice(a, b - a)
            if b == table.num_rows and not last:  # the last term may go on
                terms = whole.column("term").to_numpy()
                end = int(np.flatnonzero(terms != terms[-1])[-1]) + 1 if (terms != terms[-1]).any() else 0
                held[:] = whole.slice(end).to_batches()
                whole = whole.slice(0, end)
            if whole.num_rows:
                yield whole

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            table, held = pa.Table.from_batches(held), []
            yield from parts(table, False)
    if held:
        yield from parts(pa.Table.from_batches(held), True)


def _shared(tile: int):
    """What the terms that two groups share change in their distance, summed over a tile inside the task."""

    def run(batches):
        key, sums = None, None

        def result():
            a, b = np.nonzero(sums)
            (lang, i, j), n = key, len(a)
            columns = [pa.array([lang] * n, pa.string()), pa.array(a + i * tile, pa.int32()), pa.array(b + j * tile, pa.int32()), pa.array(sums[a, b])]
            return pa.RecordBatch.from_arrays(columns, _PAIR)

        for part in _runs(batches):
            own = part.slice(0, 1).to_pylist()[0]
            if (own["lang"], own["i"], own["j"]) != key:
                if key is not None:
                    yield result()
                key, sums = (own["lang"], own["i"], own["j"]), np.zeros((tile, tile), dtype=np.int64)
            sid, p, p0 = (part.column(c).to_numpy().astype(np.int64) for c in ("sid", "p", "p0"))
            terms = part.column("term").to_numpy()
            number = np.cumsum(np.concatenate([[True], terms[1:] != terms[:-1]]))
            x, step = np.arange(len(number)), 0
            while len(x):  # two postings of one term, ``step`` places apart
                step += 1
                x = x[x < len(number) - step]
                x = x[number[x] == number[x + step]]
                a, b = x, x + step
                if key[1] != key[2]:
                    apart = sid[a] // tile != sid[b] // tile
                    a, b = a[apart], b[apart]
                change = np.abs(p[a] - p[b]) - np.abs(p[a] - p0[b]) - np.abs(p0[a] - p[b]) + np.abs(p0[a] - p0[b])
                np.add.at(sums, (sid[a] - key[1] * tile, sid[b] - key[2] * tile), change)
        if key is not None:
            yield result()

    return run


def audit(spark: SparkSession, docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """Distances between the sources of a language, and the terms that a source overuses.

    Columns ``lang``, ``source``, ``part``, ``item``, ``value`` and ``rank``.  A language keeps the
    terms in at least ``least_docs`` of its documents.  Part ``pair`` has every other source
    with the summed difference of shares, part ``term`` the ``top`` terms by their share's
    excess over the language's.  Shares are whole numbers of parts of 10^9, and ties go by
    the item's bytes.  Null languages, sources and texts are empty ones; texts of any length
    are read whole; repeated rows count each.  A language without kept terms has distances
    of 0.  Further columns, whatever their names, are not read; an empty table gives an
    empty result.
    """
    own = Audit(spark, docs, least_docs)
    parts = [f.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank") for name, f in (("pair", own.pairs()), ("term", own.top_terms(top)))]
    return parts[0].unionByName(parts[1])


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS lang_n FROM w GROUP BY lang, term HAVING count(DISTINCT doc) >= 30),
l AS (SELECT lang, count(*) AS v, sum(lang_n)::HUGEINT AS lang_total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
f AS (
  SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, lang_n, v, lang_total, coalesce(sum(n) OVER (PARTITION BY g.lang, g.source), 0)::HUGEINT AS total
  FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (
  SELECT lang, source, term, n, (1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * v))::BIGINT AS p, (1 + (1000000000::HUGEINT * (lang_n + 5)) // (lang_total + 5 * v))::BIGINT AS q FROM f),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
    FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source) x
  ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM s WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50
"""
