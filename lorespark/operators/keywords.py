"""Keywords and relations: extraction by frequency, refinement, merging, statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorespark.functions.names import spare
from lorespark.operators.tables import saved, spread


#: Words whose weights are broadcast, those in the most documents; the weights of rarer ones lie between two bounds.
MOST_WORDS = 300_000
#: Bytes of text whose words are held at once.
SLICE_BYTES = 8 << 20


def _slices(batches):
    """Parts of the batches with up to ``SLICE_BYTES`` of ``body``, or of one row."""
    for batch in batches:
        upto = np.cumsum(pc.binary_length(batch.column("body")).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = upto[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(upto, before + SLICE_BYTES, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def _word_lists(texts: pa.Array, least: int, grams: int) -> tuple[np.ndarray, pa.Array]:
    """Row and word of each lower-cased run of at least ``least`` letters and digits; with ``grams`` of two each with the one behind it too."""
    lists = pc.split_pattern_regex(pc.utf8_lower(texts.cast(pa.large_string())), r"[^\pL\pN]+")
    rows, flat = pc.list_parent_indices(lists).to_numpy(), lists.flatten()
    long = pc.greater_equal(pc.utf8_length(flat), least)
    rows, flat = rows[long.to_numpy(zero_copy_only=False)], flat.filter(long)
    if grams > 1 and len(flat) > 1:
        same = pa.array(rows[1:] == rows[:-1])
        pairs = pc.binary_join_element_wise(flat[:-1].filter(same), flat[1:].filter(same), pa.scalar(" ", pa.large_string()))
        rows, flat = np.concatenate([rows, rows[:-1][rows[1:] == rows[:-1]]]), pa.concat_arrays([flat, pairs])
    return rows.astype(np.int64), flat


def _counted(batch: pa.RecordBatch, groups: np.ndarray, least: int, grams: int = 1, among: pa.Array | None = None) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Group, word and number of each distinct pair in a batch with a column ``body``, of the words ``among`` if they are given; ``groups`` numbers the rows."""
    rows, flat = _word_lists(batch.column("body"), least, grams)
    if among is None:
        coded = flat.dictionary_encode()
        names, at = coded.dictionary.cast(pa.string()), coded.indices.to_numpy()
    else:
        names, at = among, pc.index_in(flat, value_set=among.cast(flat.type)).fill_null(-1).to_numpy(zero_copy_only=False)
        rows, at = rows[at >= 0], at[at >= 0]
    k = max(1, len(names))
    pairs, counts = np.unique(groups[rows] * k + at, return_counts=True)
    return pairs // k, names.take(pa.array(pairs % k)), counts


def _texts(docs: DataFrame, body: str, *by: str) -> DataFrame:
    return spread(docs.select(*by, F.col(body).cast("string").alias("body")).where("body is not null"))


def mentions(docs: DataFrame, by: str = "doc_id", body: str = "text", least: int = 4, grams: int = 1, among: pa.Array | None = None) -> DataFrame:
    """Words of at least ``least`` characters in each document with how often they are there (``word``, ``tf``).

    Words are counted within each batch of rows before they are shuffled; with ``among``, a
    bounded number of words, only those are.
    """
    shared = None if among is None else docs.sparkSession.sparkContext.broadcast(among)

    def run(batches):
        for batch in _slices(batches):
            own = batch.column(by).dictionary_encode(null_encoding="encode")
            group, word, n = _counted(batch, own.indices.to_numpy().astype(np.int64), least, grams, shared and shared.value)
            yield pa.RecordBatch.from_arrays([own.dictionary.take(pa.array(group)), word, pa.array(n, pa.int64())], [by, "word", "tf"])

    lists = _texts(docs, body, by)
    counted = lists.mapInArrow(run, T.StructType([docs.schema[by], T.StructField("word", T.StringType()), T.StructField("tf", T.LongType())]))
    return counted.groupBy(by, "word").agg(F.sum("tf").alias("tf"))


def document_counts(docs: DataFrame, body: str = "text", least: int = 4, grams: int = 1) -> DataFrame:
    """``df`` of each ``word``: the number of rows that have it, counted within each batch before the shuffle."""

    def run(batches):
        for batch in _slices(batches):
            _, word, _ = _counted(batch, np.arange(batch.num_rows, dtype=np.int64), least, grams)
            counts = word.value_counts()
            yield pa.RecordBatch.from_arrays([counts.field("values"), counts.field("counts")], ["word", "df"])

    return _texts(docs, body).mapInArrow(run, "word string, df long").groupBy("word").agg(F.sum("df").alias("df"))


#: Counts that a task holds before it adds up those of the same word and class.
MOST_COUNTS = 1 << 21


def counts_by_class(docs: DataFrame, classes: str, body: str = "text", least: int = 4, grams: int = 1) -> DataFrame:
    """``word``, ``topic``, ``tf``, ``df``: how often each word is in rows of each class, and in how many rows, in one pass.

    The column ``classes`` lists a row's classes, numbers from 0 on; ``df`` counts a row once, at its first
    class or, without one, at -1.  Sums of a task are parts: a word and class may have several rows.
    """

    def summed(parts: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(parts).group_by(["word", "topic"]).aggregate([("tf", "sum"), ("df", "sum")]).select(["word", "topic", "tf_sum", "df_sum"]).rename_columns(["word", "topic", "tf", "df"])

    def run(batches):
        parts, n = [], 0
        for batch in _slices(batches):
            lists = batch.column(classes).fill_null([])
            row, word, tf = _counted(batch, np.arange(batch.num_rows, dtype=np.int64), least, grams)
            coded = word.dictionary_encode()
            at, names = coded.indices.to_numpy(), coded.dictionary
            # the classes of each row, one after another; -1 where there are none
            size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            own = np.full(int(np.maximum(size, 1).sum()), -1, dtype=np.int64)
            begin = np.cumsum(np.maximum(size, 1)) - np.maximum(size, 1)
            own[np.repeat(size > 0, np.maximum(size, 1))] = lists.flatten().to_numpy(zero_copy_only=False)
            times = np.maximum(size, 1)[row]
            first = np.cumsum(times) - times
            k = np.repeat(np.arange(len(row)), times)
            step = np.arange(len(k)) - first[k]
            kind = own[begin[row[k]] + step]
            key, inverse = np.unique(at[k].astype(np.int64) * (1 << 32) + kind + 1, return_inverse=True)
            sums = [np.bincount(inverse, weights=w, minlength=len(key)).astype(np.int64) for w in (np.where(kind < 0, 0, tf[k]), step == 0)]
            parts.append(pa.table({"word": names.take(pa.array(key >> 32)), "topic": pa.array((key & 0xFFFFFFFF) - 1, pa.int32()), "tf": sums[0], "df": sums[1]}))
            n += len(key)
            if n > MOST_COUNTS:
                parts = [summed(parts)]
                n = parts[0].num_rows
                if n > MOST_COUNTS // 2:
                    yield from parts[0].combine_chunks().to_batches()
                    parts, n = [], 0
        if parts:
            yield from summed(parts).combine_chunks().to_batches()

    return _texts(docs, body, classes).mapInArrow(run, "word string, topic int, tf long, df long")


def diverse(vectors: np.ndarray, relevance: np.ndarray, most: int, diversity: float) -> list[int]:
    """Places of the first candidate and of those that follow by maximal marginal relevance."""
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = np.divide(vectors, size, out=np.zeros_like(vectors), where=size > 0)
    alike, chosen = unit @ unit.T, [int(relevance.argmax())] if len(relevance) else []
    while len(chosen) < min(most, len(relevance)):
        gain = (1 - diversity) * relevance - diversity * alike[:, chosen].max(axis=1)
        gain[chosen] = -np.inf
        chosen.append(int(gain.argmax()))
    return chosen


def top_tfidf(docs: DataFrame, most: int, by: str = "doc_id", body: str = "text", least: int = 4) -> DataFrame:
    """The ``most`` words of the highest weight (count, and fewer rows with the word) of every row: ``word``, ``tf``, ``score``, ``rank``; each row is a document of its own.

    The weights of the ``MOST_WORDS`` commonest words are broadcast, and every row ranks its
    own words where it is.  A rarer word is in at least one row and at most in as many as
    the commonest of them, so its score has bounds; only words that may be among the first
    by these are joined with their weights and ranked again.
    """
    spark, documents = docs.sparkSession, docs.count()
    lists = _texts(docs, body, by).withColumn("row", F.monotonically_increasing_id())
    counts = saved(spark, document_counts(docs, body, least))
    weight = lambda df: F.log((F.lit(documents) + 1) / (df + 1))
    rarest = _rarest(counts)
    table = counts.where(F.col("df") > rarest).select("word", weight(F.col("df")).alias("idf")).toArrow()
    known = pa.concat_arrays([c.cast(pa.string()) for c in table.column("word").chunks]) if table.num_rows else pa.array([], pa.string())
    shared = spark.sparkContext.broadcast((known, table.column("idf").to_numpy(), float(np.log((documents + 1) / 2)), float(np.log((documents + 1) / (max(1, rarest) + 1)))))

    def chosen(batches):
        names, idf, high, low = shared.value
        for batch in _slices(batches):
            row, word, tf = _counted(batch, np.arange(batch.num_rows, dtype=np.int64), least)
            if not len(word):
                continue
            coded = word.dictionary_encode()
            found = pc.index_in(coded.dictionary, value_set=names).fill_null(-1).to_numpy(zero_copy_only=False)[coded.indices.to_numpy()]
            own = idf[found] if len(idf) else np.zeros(len(found))
            lowest, highest = tf * np.where(found < 0, low, own), tf * np.where(found < 0, high, own)
            order = np.lexsort((-lowest, row))
            place = np.arange(len(order)) - np.searchsorted(row[order], row[order])
            # the last of the first by their lower bounds; scores are rounded
            bound = np.full(batch.num_rows, -np.inf)
            last = order[place == most - 1]
            bound[row[last]] = lowest[last]
            at = pa.array(np.flatnonzero(highest >= bound[row] - 1e-5))
            held = pa.array(row).take(at)
            yield pa.RecordBatch.from_arrays([batch.column("row").take(held), batch.column(by).take(held), word.take(at), pa.array(tf, pa.int64()).take(at), pa.array(own, mask=found < 0).take(at)], ["row", by, "word", "tf", "idf"])

    fields = [("word", T.StringType()), ("tf", T.LongType()), ("idf", T.DoubleType())]
    likely = saved(spark, lists.mapInArrow(chosen, T.StructType([T.StructField("row", T.LongType()), docs.schema[by], *(T.StructField(n, t) for n, t in fields)])))
    rare = likely.where("idf is null").drop("idf").join(counts.where(F.col("df") <= rarest), "word").withColumn("idf", weight(F.col("df"))).drop("df")
    scored = likely.where("idf is not null").unionByName(rare).withColumn("score", F.round(F.col("tf") * F.col("idf"), 6))
    return top_words(scored, most, "row").select(by, "word", "tf", "score", "rank")


def _rarest(counts: DataFrame) -> int:
    """The least ``df`` so that at most ``MOST_WORDS`` words are in more rows; 0 if there are no more words than that."""
    above = 0
    # there are no more different numbers than the root of twice the words of all rows
    for r in counts.groupBy("df").agg(F.count("*").alias("n")).orderBy(F.desc("df")).toLocalIterator():
        above += r.n
        if above > MOST_WORDS:
            return r.df
    return 0


def top_words(scored: DataFrame, most: int, by: str = "doc_id", score: str = "score") -> DataFrame:
    """The ``most`` best words of each document, ties in order of the word."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), "word"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= most)


def class_tfidf(tf: DataFrame, by: str) -> DataFrame:
    """Class-based weight: ``tf * ln(1 + A / f)`` with A the mean number of words of a class and f the word's total."""
    total = tf.groupBy("word").agg(F.sum("tf").alias("f"))
    return class_scores(tf.join(total, "word"), tf.groupBy(by).agg(F.sum("tf").alias("n")))


def class_scores(counted: DataFrame, sizes: DataFrame) -> DataFrame:
    """The class-based weight of counts ``tf`` with the word's total ``f``; ``sizes`` has the number of words ``n`` of each class."""
    mean = sizes.agg(F.avg("n").alias("a"))
    return counted.join(F.broadcast(mean)).withColumn("score", F.round(F.col("tf") * F.log(1 + F.col("a") / F.col("f")), 6)).drop("a")


def refine(raw: DataFrame, refined: DataFrame) -> DataFrame:
    """Raw mentions with their refined word; those without one stay as they are (``raw``, ``word``)."""
    key, new = spare(raw.columns, "_key", "_word")
    table = refined.groupBy(F.lower("raw").alias(key)).agg(F.min("word").alias(new))
    return raw.join(table, F.lower(F.col("word")) == F.col(key), "left").withColumn("word", F.coalesce(new, "word")).drop(key, new)


def unprotected(words: DataFrame, protected: DataFrame) -> DataFrame:
    """Words without those that are protected, in any case."""
    (key,) = spare(words.columns, "_key")
    return words.join(protected.select(F.lower("word").alias(key)).distinct(), F.lower(F.col("word")) == F.col(key), "left_anti")


def confident(rows: DataFrame, least: float, most: int, by: list[str], order: list) -> DataFrame:
    """Rows with a word and enough confidence (null is 0), the first ``most`` of each group."""
    kept = rows.where((F.coalesce("confidence", F.lit(0.0)) >= least) & (F.trim("word") != ""))
    (n,) = spare(rows.columns, "_n")
    return kept.withColumn(n, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(n) <= most).drop(n)


def dedup(rows: DataFrame, order: Column) -> DataFrame:
    """One row for each word, in any case, and article: the first one's spelling and the highest confidence."""
    return rows.groupBy(F.lower("word").alias("key"), "article_id").agg(F.min_by("word", order).alias("word"), F.max("confidence").alias("confidence"))


def histogram(rows: DataFrame, value: str = "confidence") -> DataFrame:
    """Counts from 0.8, from 0.5, above 0 and at 0; null is 0."""
    v = F.coalesce(F.col(value), F.lit(0.0))
    return rows.agg(F.count_if(v >= 0.8).alias("high"), F.count_if((v >= 0.5) & (v < 0.8)).alias("medium"), F.count_if((v > 0) & (v < 0.5)).alias("low"), F.count_if(v == 0).alias("zero"))


def cooccurrence(tops: DataFrame, by: str = "doc_id") -> DataFrame:
    """Unordered pairs of top words that share documents: ``subject``, ``object``, ``n``.

    The top words of a document are a bounded list, so pairs are made inside its row.
    """
    lists = tops.groupBy(by).agg(F.array_sort(F.collect_set("word")).alias("w"))
    pairs = F.flatten(F.transform("w", lambda a: F.transform(F.filter("w", lambda b: b > a), lambda b: F.struct(a.alias("subject"), b.alias("object")))))
    return lists.select(F.explode(pairs).alias("p")).groupBy("p.subject", "p.object").agg(F.count("*").alias("n"))


def most_frequent(rows: DataFrame, by: list[str], value: str, order: str, other: str = "general") -> DataFrame:
    """The most frequent value of each group; of equally frequent ones the first seen."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    found = counted.groupBy(*by).agg(F.max_by(value, F.struct("n", (-F.col("first")).alias("f"))).alias(value))
    return rows.select(*by).distinct().join(found, by, "left").withColumn(value, F.coalesce(value, F.lit(other)))


def listing(keywords: DataFrame, edges: DataFrame) -> DataFrame:
    """Every keyword with its highest confidence and number of edges."""
    found = edges.groupBy("word").agg(F.max("confidence").alias("confidence"), F.count("*").alias("n_edges"))
    return keywords.join(found, "word", "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))


#: Keywords that a refiner is asked about at once, and in the second pass if there are more than that.
REFINE_BATCH, SECOND_BATCH = 50, 100


def plain_refiner(batch: list[tuple[str, str]]) -> list[tuple[str, str, str]]:
    """Stands in for a language model: words in one spelling of case and space, with their category."""
    return [(word, " ".join(word.lower().split()), category) for word, category in batch]


def _asked(words: DataFrame, by: str, size: Column, model) -> DataFrame:
    """``by``, ``raw``, ``word``, ``category`` that a model gives for batches of words in their order (``pos``)."""

    def run(table):
        rows = table.sort_by("pos")
        try:
            found = model(list(zip(rows.column("raw").to_pylist(), rows.column("category").to_pylist())))
        except Exception:  # a batch that fails gives nothing, and its words stay
            found = []
        names = pa.array([rows.column(by)[0].as_py()] * len(found), rows.schema.field(by).type)
        return pa.table([names, *(pa.array([f[k] for f in found], pa.string()) for k in range(3))], [by, "raw", "word", "category"])

    number = F.floor((F.row_number().over(Window.partitionBy(by).orderBy("pos")) - 1) / size).alias("batch")
    numbered = words.select(by, "raw", "category", "pos", number)
    return numbered.groupBy(by, "batch").applyInArrow(run, T.StructType([words.schema[by], *(T.StructField(n, T.StringType()) for n in ("raw", "word", "category"))]))


def refine_batches(raw: DataFrame, by: str, model=plain_refiner) -> DataFrame:
    """Refined keyword of each raw one (``by``, ``raw``, ``word``, ``category``), in two passes of bounded batches.

    ``raw`` has ``by``, ``word``, ``category`` and ``pos``.  The first pass asks ``model``
    about the distinct words of each ``by``, ``REFINE_BATCH`` at once; the second about
    the distinct refined words, all at once or ``SECOND_BATCH`` at once if they are more.
    What the second pass makes of a word is written back to the raw words it came from.
    ``model`` maps a list of words with categories to raw word, refined word, category.
    """
    words = raw.where(F.trim("word") != "").groupBy(by, F.lower("word").alias("key")).agg(F.min_by(F.struct(F.col("word").alias("raw"), F.coalesce("category", F.lit("other")).alias("category")), "pos").alias("r"), F.min("pos").alias("pos"))
    first = saved(raw.sparkSession, _asked(words.select(by, "r.raw", "r.category", "pos"), by, F.lit(REFINE_BATCH), model))
    again = first.where(F.trim("word") != "").groupBy(by, F.lower("word").alias("key")).agg(F.min_by(F.struct(F.col("word").alias("raw"), "category"), "raw").alias("r"))
    again = again.select(by, "r.raw", "r.category", F.col("key").alias("pos"), F.count("*").over(Window.partitionBy(by)).alias("n"))
    few = _asked(again.where(F.col("n") <= REFINE_BATCH), by, F.lit(REFINE_BATCH), model)
    many = _asked(again.where(F.col("n") > REFINE_BATCH), by, F.lit(SECOND_BATCH), model)
    second = few.unionByName(many).groupBy(by, F.lower("raw").alias("key")).agg(F.min(F.struct("word", "category")).alias("s"))
    joined = first.join(second, (first[by] == second[by]) & (F.lower(first["word"]) == second["key"]), "left")
    return joined.select(first[by], first["raw"], F.coalesce("s.word", first["word"]).alias("word"), F.coalesce("s.category", first["category"]).alias("category"))


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """Keys that more than one row has, with how many."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def sampled(rows: DataFrame, fraction: float, needed: list[str], seed: int = 42) -> DataFrame:
    """A share of the rows that have all the needed columns."""
    return rows.dropna(subset=needed).sample(fraction=fraction, seed=seed)
