"""Concepts: building from keywords, versions, expansion, relations between concepts, reports."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lorespark.functions import models, text
from lorespark.functions.names import spare
from lorespark.operators import clustering, graph, keywords, retrieval
from lorespark.operators.tables import saved

#: Prompts that describing and verifying take, in keywords of a batch.
BATCH = 3


def article_keywords(edges: DataFrame, articles: DataFrame) -> DataFrame:
    """Keywords of articles with their version; null confidence is 0 and null lists are empty."""
    joined = edges.join(articles.select("article_id", "version"), "article_id")
    return joined.withColumns({"confidence": F.coalesce("confidence", F.lit(0.0)), "chunk_ids": F.coalesce("chunk_ids", F.array().cast("array<string>"))})


def aggregate_clusters(members: DataFrame) -> DataFrame:
    """One concept for each cluster: canonical name and domain by frequency, words, articles and versions.

    ``members`` has ``cluster``, ``word``, ``category``, ``article_id``, ``version``, ``pos``.
    """
    name = keywords.most_frequent(members, ["cluster"], "word", "pos").withColumnRenamed("word", "canonical_name")
    domain = keywords.most_frequent(members, ["cluster"], "category", "pos").withColumnRenamed("category", "domain")
    versions = members.groupBy("cluster", "article_id").agg(F.max_by("version", "pos").alias("version"))
    versions = versions.groupBy("cluster").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("article_id", "version")))).alias("source_versions"))
    lists = members.groupBy("cluster").agg(F.array_sort(F.collect_set("word")).alias("keyword_words"), F.array_sort(F.collect_set("article_id")).alias("source_articles"))
    return name.join(domain, "cluster").join(lists, "cluster").join(versions, "cluster")


def build(members: DataFrame, edges: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Concepts and the relations between them.

    ``members`` are keyword contexts (``word``, ``article_id``, ``category``, ``confidence``,
    ``version``, ``pos``, ``embedding``), which are clustered in one pass; ``edges`` are
    relations ``subject``, ``predicate``, ``object``, ``confidence``.
    """
    rows = members.withColumn("_id", F.concat_ws("\x1f", F.lower("word"), "article_id"))
    first = rows.groupBy("_id").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "_id"]), "pos").alias("r"), F.max("confidence").alias("_c")).select("_id", "r.*", "_c").withColumn("confidence", F.col("_c")).drop("_c")
    # read several times, and the pass should run once
    placed = saved(members.sparkSession, first.join(clustering.greedy(first, least, "_id", "embedding", "word"), "_id"))
    # a word in several clusters goes with the last of them
    of_word = placed.groupBy(F.col("word").alias("node")).agg(F.max("cluster").alias("cluster"))
    ends = graph.classify_edges(edges.withColumnsRenamed({"subject": "a", "object": "b"}), of_word)
    return aggregate_clusters(placed), graph.cluster_relations(ends)


def next_version(state: DataFrame, delta: DataFrame, run_id: str, now: Column) -> DataFrame:
    """Concept table after a run: changed concepts get a new version and the old one ends.

    ``state`` has ``concept_group_id``, ``version``, ``is_active``, ``run_id``,
    ``previous_version`` and ``created_at`` beside ``keyword_words`` and
    ``source_articles``; ``delta`` has the group and the two lists, which are put to the
    old ones.
    """
    active = state.where("is_active").select("concept_group_id", F.col("version").alias("_v"), F.col("keyword_words").alias("_w"), F.col("source_articles").alias("_a"))
    joined = delta.join(active, "concept_group_id", "left")
    none = F.array().cast("array<string>")
    new = joined.select(
        "concept_group_id", (F.coalesce("_v", F.lit(0)) + 1).alias("version"), F.lit(True).alias("is_active"), F.lit(run_id).alias("run_id"), F.col("_v").alias("previous_version"), now.alias("created_at"),
        F.array_sort(F.array_union(F.coalesce("_w", none), "keyword_words")).alias("keyword_words"), F.array_sort(F.array_union(F.coalesce("_a", none), "source_articles")).alias("source_articles"),
        F.size(F.array_except(F.coalesce("keyword_words", none), F.coalesce("_w", none))).alias("_fresh"), F.col("_v").isNull().alias("_first"),
    ).where("_fresh > 0 or _first").drop("_fresh", "_first")
    changed = new.select("concept_group_id").withColumn("_changed", F.lit(True))
    old = state.join(changed, "concept_group_id", "left").withColumn("is_active", F.col("is_active") & F.col("_changed").isNull()).select(state.columns)
    return old.unionByName(new.select(state.columns))


def similarities(members: DataFrame, concepts: DataFrame) -> DataFrame:
    """Similarity of each keyword to the vector of its concept, to four places."""
    from lorespark.functions import vectors

    (centre,) = spare(members.columns, "_c")
    joined = members.join(concepts.select("cluster", F.col("embedding").alias(centre)), "cluster")
    return joined.withColumn("similarity", F.round(vectors.cosine(F.col("embedding"), F.col(centre)), 4)).drop(centre)


def instance_edges(scored: DataFrame) -> DataFrame:
    """INSTANCE_OF edges: each word and concept with the similarity by article as JSON."""
    pairs = F.map_from_entries(F.sort_array(F.collect_list(F.struct("article_id", "similarity"))))
    return scored.groupBy("word", "cluster").agg(F.to_json(pairs).alias("similarities"))


def expand(spark: SparkSession, words: DataFrame, concepts: DataFrame, direct: float, candidate: float, verify=None) -> DataFrame:
    """New keywords set beside the concepts: direct ones join, candidates join if ``verify`` says so, the rest start new ones.

    Without a verifier candidates are turned down.
    """
    found = retrieval.match_concepts(spark, words, concepts, "concept_id", direct, candidate, key="word_id", class_vector="embedding")
    taken = F.col("kind") == "direct"
    if verify is not None:
        taken = taken | ((F.col("kind") == "candidate") & verify(found))
    return found.withColumn("concept_id", F.when(taken, F.col("best")))


#: What a verifier is asked, and the shape of its answer.
BELONGS = "Concept {concept} of {domain}: {about}\nWord {word}: {text}\nDoes the word belong to the concept? Answer in JSON with belongs, confidence and relationship."
AGAIN = "Concept {concept}: {about}\nNew words:\n{words}\nWrite its description anew. Answer in JSON with description."


def verified(candidates: DataFrame, model, batch: int = 8, least: float = 0.0) -> DataFrame:
    """``candidates`` with a model's verdict: ``belongs``, ``confidence``, ``relationship``, and ``error`` where there is none.

    Candidates have ``word``, ``description``, ``canonical_name``, ``domain`` and ``about``.
    They are asked about in batches; where a batch fails its rows are asked one by one, and
    the row that fails belongs to nothing and says why, as does one whose answer can't be
    read.  A confidence below ``least`` is a no.  Those columns are replaced where they are.
    """
    prompt, answer = spare(candidates.columns, "_prompt", "_answer")
    kept = candidates.select([c for c in candidates.columns if c not in ("belongs", "confidence", "relationship", "error")])
    filled = text.fill(BELONGS, concept=F.col("canonical_name"), domain=F.col("domain"), about=F.col("about"), word=F.col("word"), text=F.col("description"))
    asked = models.ask(kept.withColumn(prompt, filled), prompt, model, answer, batch)
    v = F.try_parse_json(text.flat_json(F.col(answer)))
    sure = F.coalesce(F.try_variant_get(v, "$.confidence", "double"), F.lit(0.0))
    yes = F.coalesce(F.try_variant_get(v, "$.belongs", "boolean"), F.lit(False)) & (sure >= least)
    unread = F.when(F.col(answer).isNotNull() & v.isNull(), F.lit("the answer has no JSON object"))
    found = {"belongs": yes, "confidence": sure, "relationship": F.coalesce(F.try_variant_get(v, "$.relationship", "string"), F.lit("")), "error": F.coalesce(F.col(f"{answer}_error"), unread)}
    return asked.withColumns(found).select(*kept.columns, *found)


def expand_verified(spark: SparkSession, words: DataFrame, concepts: DataFrame, direct: float, candidate: float, model, batch: int = 8, least: float = 0.0) -> DataFrame:
    """``expand`` with candidates decided by a model, and what it said of each; direct and unmatched words are not asked about."""
    found = expand(spark, words, concepts, direct, candidate)
    asked = found.where("kind = 'candidate'").join(words.select("word_id", "word", "description"), "word_id")
    asked = asked.join(concepts.select(F.col("concept_id").cast("string").alias("best"), "canonical_name", "domain", F.col("description").alias("about")), "best")
    told = verified(asked, model, batch, least).select("word_id", "belongs", "confidence", "relationship", "error")
    joined = found.join(told, "word_id", "left")
    return joined.withColumn("concept_id", F.when(F.col("kind") == "direct", F.col("best")).when(F.col("belongs"), F.col("best")))


def redescribed(entries: DataFrame, model, by: str = "concept_id", tokens: int = 3000) -> DataFrame:
    """``by``, ``description`` and ``error`` of each concept after its new words, a batch of a bounded size at a time.

    ``entries`` has ``by``, ``canonical_name``, ``about`` (the description so far), ``word`` and
    ``description``.  Each batch is asked about with the description that the one before gave;
    a batch that fails leaves it as it is, and the first failure is reported.  A concept's
    words are read in order as a stream, so its batches follow one another.
    """
    line = F.concat(F.lit("- "), F.coalesce("word", F.lit("")), F.lit(": "), F.coalesce("description", F.lit("")))
    numbered = prompt_batches(entries.select(by, "canonical_name", "about", "word", line.alias("text")), [by], ["word", "text"], tokens)
    parts = numbered.groupBy(by, "batch").agg(F.min("canonical_name").alias("name"), F.min("about").alias("about"), F.array_join(F.sort_array(F.collect_list("text")), "\n").alias("words"))

    def run(frames):
        held, now, error = None, None, None
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                key = getattr(row, by)
                if key != held:
                    if held is not None:
                        out.append((held, now, error))
                    held, now, error = key, row.about, None
                try:
                    now = model([AGAIN.format(concept=row.name, about=now or "", words=row.words)])[0] or now
                except Exception as e:  # the others go on with what there is
                    error = error or str(e)[:300]
            yield pd.DataFrame(out, columns=[by, "description", "error"])
        if held is not None:
            yield pd.DataFrame([(held, now, error)], columns=[by, "description", "error"])

    ordered = parts.repartition(by).sortWithinPartitions(by, "batch")
    return ordered.mapInPandas(run, StructType([entries.schema[by], StructField("description", StringType()), StructField("error", StringType())]))


def chosen_version(expansion: DataFrame) -> DataFrame:
    """The version that was chosen, else the last one on offer."""
    return expansion.withColumn("chosen_version", F.coalesce("choice", F.array_max("versions")))


def concept_relations(answers: DataFrame, concepts: DataFrame) -> DataFrame:
    """Extracted relations by concept names in any case: unknown names and loops are dropped, articles and versions put together."""
    side = lambda n: concepts.select(F.lower("canonical_name").alias(f"_{n}"), F.col("concept_id").alias(f"{n}_id"), F.col("source_articles").alias(f"_{n}_a"), F.col("source_versions").alias(f"_{n}_v"))
    joined = answers.withColumns({"_s": F.lower("source"), "_t": F.lower("target")}).join(side("s"), "_s").join(side("t"), "_t").where("s_id <> t_id")
    versions = F.map_from_entries(F.array_distinct(F.concat(F.map_entries(F.map_filter("_s_v", lambda k, v: ~F.map_contains_key(F.col("_t_v"), k))), F.map_entries("_t_v"))))
    return joined.select(F.col("s_id").alias("source_id"), F.col("t_id").alias("target_id"), "predicate", F.coalesce("confidence", F.lit(0.5)).alias("confidence"), F.array_sort(F.array_union("_s_a", "_t_a")).alias("source_articles"), versions.alias("source_versions"))


def relations_of(found: DataFrame, relations: DataFrame, names: DataFrame) -> DataFrame:
    """Relations, either way, of found concepts, with the names of both ends; an unknown one shows the start of its id."""
    both = relations.select(F.col("source_id").alias("id"), F.col("target_id").alias("other"), "predicate").union(relations.select("target_id", "source_id", "predicate")).distinct()
    near = both.join(found.select("id"), "id", "left_semi")
    named = lambda frame, c: frame.join(names.select(F.col("id").alias(c), F.col("name").alias(f"{c}_name")), c, "left").withColumn(f"{c}_name", F.coalesce(f"{c}_name", F.substring(c, 1, 8)))
    return named(named(near, "id"), "other")


def inspect(concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """Every article of a concept's words, whether it is the concept's, and the similarity: its own first, most similar first."""
    own = concepts.select("concept_id", F.explode("members").alias("m")).select("concept_id", "m.word", "m.article_id", "m.similarity")
    words = own.select("concept_id", "word").distinct()
    every = words.join(edges.select("word", "article_id").distinct(), "word").join(own, ["concept_id", "word", "article_id"], "left")
    return every.withColumn("in_concept", F.col("similarity").isNotNull()).orderBy("concept_id", F.desc("in_concept"), F.desc_nulls_last("similarity"), "word", "article_id")


def provenance(edges: DataFrame, chunks: DataFrame, most: int = 300) -> DataFrame:
    """Chunks that edges were taken from, broadest first, with their text cut."""
    from lorespark.functions import text

    flat = edges.select("edge_id", F.explode("chunk_ids").alias("node_id"))
    return flat.join(chunks, "node_id").withColumn("text", text.shorten(F.col("text"), most)).orderBy("edge_id", F.desc("level"), "node_id")


def contexts(chunks: DataFrame, by: list[str]) -> DataFrame:
    """Broad and detailed context: the highest chunk, and the longest leaf or else the lowest chunk."""
    leaf = F.when(F.col("level") == 0, F.struct(F.length("text"), "chunk_id"))
    return chunks.groupBy(*by).agg(F.max_by("text", F.struct("level", "chunk_id")).alias("broad"), F.coalesce(F.max_by("text", leaf), F.min_by("text", F.struct("level", "chunk_id"))).alias("detail"))


def within_budget(entries: DataFrame, by: list[str], order: list, most: int) -> DataFrame:
    """Entries whose lengths and line ends, added up in order, fit the budget."""
    run = Window.partitionBy(*by).orderBy(*order)
    (upto,) = spare(entries.columns, "_upto")
    return entries.withColumn(upto, F.sum(F.length("text") + 1).over(run)).where(F.col(upto) <= most).drop(upto)


def dry_run(rows: DataFrame) -> DataFrame:
    """What a build would take, by article: counts, missing descriptions, confidence, and calls estimated."""
    need = F.count_if(F.coalesce("description", F.lit("")) == "")
    high = F.coalesce("confidence", F.lit(0.0))
    out = rows.groupBy("article_id").agg(F.count("*").alias("keywords"), need.alias("need_description"), F.count_if(high >= 0.8).alias("high"), F.count_if((high >= 0.5) & (high < 0.8)).alias("medium"), F.count_if((high > 0) & (high < 0.5)).alias("low"), F.count_if(high == 0).alias("zero"))
    return out.withColumn("calls", F.col("need_description") + F.greatest(F.lit(1), F.floor(F.col("keywords") / BATCH)) + 1)


def runs(concepts: DataFrame) -> DataFrame:
    """Runs, newest first: concepts, domains, and when they began."""
    return concepts.groupBy("run_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("domain")).alias("domains"), F.min("created_at").alias("began")).orderBy(F.desc("began"))


def list_concepts(concepts: DataFrame, domain: str | None = None, article: str | None = None) -> DataFrame:
    """Concepts, optionally of a domain or an article, and whether they join several words or articles."""
    if domain is not None:
        concepts = concepts.where(F.col("domain") == domain)
    if article is not None:
        concepts = concepts.where(F.array_contains("source_articles", article))
    return concepts.withColumn("multi", (F.size("keyword_words") > 1) | (F.size("source_articles") > 1))


def described(members: DataFrame, by: str = "concept_id") -> DataFrame:
    """Descriptions put together without a model: the distinct ones of the members, in order of their words."""
    texts = F.transform(F.sort_array(F.collect_set(F.when(F.trim("description") != "", F.struct("word", "description")))), lambda x: x["description"])
    return members.groupBy(by).agg(F.array_join(F.array_distinct(texts), "; ").alias("description"))


def prompt_batches(entries: DataFrame, by: list[str], order: list[str], tokens: int, share: float = 0.6, chars: float = 2.5) -> DataFrame:
    """Entries with the number of the batch they are asked in: batches fill up in order to a share of the token budget.

    A group is read in order as a stream, with the size of the open batch as all its
    state; an entry over the budget is a batch of its own.
    """
    most = int(tokens * chars * share)
    (length,) = spare(entries.columns, "_size")

    def run(frames):
        last, batch, used = None, 0, 0
        for frame in frames:
            numbers = []
            for key, size in zip(frame[by].itertuples(index=False, name=None), frame[length]):
                if key != last:
                    last, batch, used = key, 0, 0
                elif used + size > most:
                    batch, used = batch + 1, 0
                used += size
                numbers.append(batch)
            yield frame.drop(columns=length).assign(batch=numbers)

    sized = entries.withColumn(length, F.length(F.coalesce("text", F.lit(""))) + 1)
    ordered = sized.repartition(*by).sortWithinPartitions(*by, *order)
    return ordered.mapInPandas(run, StructType([*entries.schema.fields, StructField("batch", LongType())]))


def delete_concepts(concepts: DataFrame, relations: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Concepts and relations without those that go (``concept_id``), at either end."""
    dead = gone.select("concept_id").distinct()
    kept = relations
    for end in ("source_id", "target_id"):
        kept = kept.join(dead.select(F.col("concept_id").alias(end)), end, "left_anti")
    return concepts.join(dead, "concept_id", "left_anti"), kept.select(relations.columns)


def vector_points(concepts: DataFrame, relations: DataFrame) -> DataFrame:
    """Points to search: concepts by their id, relations by source, target and predicate."""
    relation = F.concat_ws(":", "source_id", "target_id", "predicate")
    return concepts.select(F.col("concept_id").alias("node_id"), F.lit("concept").alias("kind"), "embedding").unionByName(relations.select(relation.alias("node_id"), F.lit("relation").alias("kind"), "embedding"))


def finalize_expand(state: DataFrame, offers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Concept versions after the choice, and EVOLVED_TO edges.

    ``state`` has ``concept_group_id``, ``version``, ``is_active``, ``keyword_words`` and
    ``source_articles``; ``offers`` has ``concept_group_id``, ``original_version``,
    ``chosen_version`` and the versions on offer, ``v_direct`` and ``v_llm``, each a
    structure of ``version``, ``keyword_words`` and ``source_articles`` or null.  Where
    another version than the original is chosen, the old one ends and every offer is
    stored, the chosen one active.  Edges lead from the original to the direct version,
    where a choice was made, and from the direct one, or else the original, to the model's.
    """
    made = offers.where("chosen_version is not null and chosen_version <> original_version")
    ended = made.select("concept_group_id", F.col("original_version").alias("version")).distinct().withColumn("ended", F.lit(True))
    old = state.join(ended, ["concept_group_id", "version"], "left").withColumn("is_active", F.col("is_active") & F.col("ended").isNull()).select(state.columns)
    several = F.filter(F.array("v_direct", "v_llm"), lambda v: v.isNotNull())
    new = made.select("concept_group_id", "chosen_version", F.explode(several).alias("v")).select("concept_group_id", "v.version", (F.col("v.version") == F.col("chosen_version")).alias("is_active"), "v.keyword_words", "v.source_articles")
    edge = lambda a, b: F.struct(a.alias("from_version"), b.alias("to_version"))
    original, direct, model = F.col("original_version"), F.col("v_direct.version"), F.col("v_llm.version")
    edges = F.array(F.when(direct.isNotNull() & F.col("chosen_version").isNotNull(), edge(original, direct)), F.when(model.isNotNull(), edge(F.coalesce(direct, original), model)))
    changed = offers.join(made.select("concept_group_id").distinct().withColumn("stored", F.lit(True)), "concept_group_id", "left").where("stored")
    evolved = changed.select("concept_group_id", F.explode(F.filter(edges, lambda e: e.isNotNull())).alias("e")).select("concept_group_id", "e.*")
    return old.unionByName(new.select(state.columns)), evolved


def from_unmatched(unmatched: DataFrame, least: float) -> DataFrame:
    """New concepts out of keywords that no concept took: greedy clusters of them, put together."""
    rows = unmatched.withColumn("member", F.concat_ws("\x1f", F.lower("word"), "article_id"))
    first = rows.groupBy("member").agg(F.min_by(F.struct(*unmatched.columns), "pos").alias("r")).select("member", "r.*")
    return aggregate_clusters(first.join(clustering.greedy(first, least, "member", "embedding", "word"), "member"))


def add_concept(state: DataFrame, name: str, words: DataFrame, edges: DataFrame) -> DataFrame:
    """State with a concept of its own version 1 from chosen words and the articles that have them; an error if no word is known."""
    known = graph.select_explicit(words, edges, "word")
    lists = edges.join(known, "word", "left_semi").agg(F.array_sort(F.collect_set("word")).alias("keyword_words"), F.array_sort(F.collect_set("article_id")).alias("source_articles"))
    new = lists.select(F.lit(name).alias("concept_group_id"), F.lit(1).alias("version"), F.lit(True).alias("is_active"), "keyword_words", "source_articles")
    return state.unionByName(new.select(state.columns))


def upsert_relations(state: DataFrame, delta: DataFrame) -> DataFrame:
    """Relations by source, target and predicate with the delta's over them; ``created_at`` stays as it was first set."""
    key = ["source_id", "target_id", "predicate"]
    first = state.select(*key, F.col("created_at").alias("first"))
    kept = delta.join(first, key, "left").withColumn("created_at", F.coalesce("first", "created_at")).select(state.columns)
    return state.join(delta.select(*key), key, "left_anti").unionByName(kept)


def reset(*tables: DataFrame) -> list[DataFrame]:
    """The tables without any row."""
    return [t.limit(0) for t in tables]


def dual_context(chunks: DataFrame, by: list[str], tokens: int, chars: float = 2.5, share: float = 0.4) -> DataFrame:
    """Broad and detailed context, each cut to its share of the token budget."""
    most = int(tokens * chars * share)
    return contexts(chunks, by).withColumns({c: F.substring(c, 1, most) for c in ("broad", "detail")})


def concept_prompt(entries: DataFrame, by: list[str], order: list, tokens: int, chars: float = 2.5, share: float = 0.7) -> DataFrame:
    """Entries one to a line up to a share of the token budget; the first that doesn't fit is cut, the others are left out."""
    most = int(tokens * chars * share)
    before, size = spare(entries.columns, "_before", "_size")
    length = F.length(F.coalesce("text", F.lit(""))) + 1
    run = Window.partitionBy(*by).orderBy(*order)
    marked = entries.withColumn(size, length).withColumn(before, F.sum(size).over(run) - F.col(size)).where(F.col(before) < most)
    return marked.withColumn("text", F.substr(F.col("text"), F.lit(1), (F.lit(most) - F.col(before)).cast("int"))).drop(before, size)


def hit_counts(found: dict[str, DataFrame]) -> DataFrame:
    """Hits by query over several kinds of points (``kind``, ``query_id``, ``hits``), and under the kind ``total`` the distinct points."""
    hits = reduce(DataFrame.unionByName, [f.select(F.lit(k).alias("kind"), "query_id", F.col(f.columns[1]).cast("string").alias("point")) for k, f in found.items()])
    each = hits.groupBy("kind", "query_id").agg(F.count("*").alias("hits"))
    whole = hits.agg(F.count_distinct("kind", "point").alias("hits")).select(F.lit("total").alias("kind"), F.lit(None).cast("long").alias("query_id"), "hits")
    return each.unionByName(whole)
