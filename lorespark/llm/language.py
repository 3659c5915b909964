"""Language identification by hierarchical discrimination.

Linear support vector machines first tell language families apart; one-versus-one
machines then separate the languages within the family that was predicted.  Features
are hashed runs of two and three characters over the whole text.  Each machine is a
task, fitted on a sample of labelled documents that one parameter bounds, whatever the
labels; only the features of the sample leave the executors.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorespark.functions.names import spare
from lorespark.llm.common import Scratch, slices

FEATURES = 1 << 13
#: The sample's bound: documents of all languages together, and of each language at most and at least.  Beyond
#: ``ALL_DOCS // LEAST_DOCS`` languages only those with the most labelled documents are learned.
ALL_DOCS, PER_LANGUAGE, LEAST_DOCS = 1500, 250, 10
#: Characters of a long text whose features are counted at once.
CHUNK = 1 << 18
UNKNOWN = "und"
#: Texts with a lower score are in no language that was learned.  Two machines that know nothing of a text give 0.25.
LEAST_SCORE = 0.3

#: Families of closely related languages by ISO 639-1 code.  Others are families of their own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "indic": "hi mr ne bn pa gu ur",
    "iranian": "fa ps ku tg",
    "dravidian": "ta te kn ml",
    "malayic": "id ms jv",
    "chinese": "zh yue",
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_LETTER = regex.compile(r"\p{L}")


def family_of(lang: str) -> str:
    return _FAMILY_OF.get(lang.lower().split("-")[0].split("_")[0], lang)


def features(text: str) -> np.ndarray:
    """Unit vector of hashed two- and three-character runs; case, digits and punctuation don't count."""
    counts = np.zeros(FEATURES, dtype=np.float64)
    table = _letters()
    for at in range(0, len(text), CHUNK):
        before = text[max(0, at - 2) : at].lower()  # where runs of three begin that end in this part
        part = before + text[at : at + CHUNK].lower()
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        codes = np.where(table[np.minimum(codes, len(table) - 1)], codes, 32).astype(np.uint32)
        if len(codes) < 2:
            continue
        two = codes[:-1] * np.uint32(0x9E3779B1) + codes[1:]
        keys = two * np.uint32(0x85EBCA77)
        counts += np.bincount(keys[max(0, len(before) - 1) :] >> np.uint32(19), minlength=FEATURES)
        keys = (two[:-1] * np.uint32(0xC2B2AE3D) + codes[2:]) * np.uint32(0x27D4EB2F)
        counts += np.bincount(keys >> np.uint32(19), minlength=FEATURES)
    counts = np.sqrt(counts)
    norm = np.sqrt(counts @ counts)
    return counts / norm if norm else counts


_TABLE: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _TABLE:
        _TABLE.append(np.array([chr(c).isalpha() for c in range(0x10000)] + [True]))
    return _TABLE[0]


def _codes(text: str):
    """Letters of a text in lower case, by parts, as places in the table of letters."""
    table = _letters()
    for at in range(0, len(text), CHUNK):
        codes = np.frombuffer(text[at : at + CHUNK].lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
        codes = np.minimum(codes, len(table) - 1)
        yield codes[table[codes]]


def alphabet(text: str) -> np.ndarray:
    """The different letters of a text."""
    return np.unique(np.concatenate([np.unique(c) for c in _codes(text)] or [np.zeros(0, dtype=np.uint32)]))


def fit_machine(x: np.ndarray, y: np.ndarray, rounds: int = 30, strength: float = 1e-4, seed: int = 7) -> np.ndarray:
    """Linear support vector machine for signs ``y`` by averaged stochastic subgradients; the last weight is the bias."""
    rng = np.random.default_rng(seed)
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
    # both classes weigh the same
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)
    w, mean, step = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0
    for turn in range(rounds):
        for i in rng.permutation(len(x)):
            step += 1
            rate = 1.0 / (strength * (step + 1 / strength))
            w *= 1 - rate * strength
            if y[i] * (x[i] @ w) < 1:
                w += rate * weight[i] * y[i] * x[i]
            if turn >= rounds // 2:
                mean += w
    return mean / max(1, step - len(x) * (rounds // 2))


@dataclass(frozen=True)
class Sample:
    """Features, language and family of each document that is learned from."""

    x: np.ndarray
    langs: np.ndarray
    kin: np.ndarray
    #: The letters of all of them, as places in the table of letters.
    letters: np.ndarray

    @staticmethod
    def of(rows: list[tuple[str, str]]) -> Sample:
        rows = [(t, lang) for t, lang in rows if _LETTER.search(t)]
        return Sample.made([features(t) for t, _ in rows], [lang for _, lang in rows], [alphabet(t) for t, _ in rows])

    @staticmethod
    def made(found: list[np.ndarray], langs: list[str], letters: list[np.ndarray]) -> Sample:
        x = np.array(found, dtype=np.float32).reshape(len(found), FEATURES)
        known = np.unique(np.concatenate([np.asarray(a, dtype=np.int64) for a in letters] or [np.zeros(0, dtype=np.int64)]))
        return Sample(x, np.array(langs, dtype=object), np.array([family_of(lang) for lang in langs], dtype=object), known)

    def languages(self) -> dict[str, list[str]]:
        return {f: sorted(set(self.langs[self.kin == f])) for f in sorted(set(self.kin))}

    def machines(self) -> list[tuple[str, str | None]]:
        """A family against all others, or two languages of one family, in the order of the model."""
        found = self.languages()
        whole = [(f, None) for f in found] if len(found) > 1 else []
        return whole + [pair for own in found.values() for pair in combinations(own, 2)]

    def machine(self, names: tuple[str, str | None]) -> np.ndarray:
        a, b = names
        if b is None:
            return fit_machine(self.x, np.where(self.kin == a, 1, -1)).astype(np.float32)
        chosen = (self.langs == a) | (self.langs == b)
        return fit_machine(self.x[chosen], np.where(self.langs[chosen] == a, 1, -1)).astype(np.float32)


@dataclass(frozen=True)
class Model:
    families: list[str]
    family_weights: np.ndarray
    languages: dict[str, list[str]]
    pair_weights: dict[str, np.ndarray]
    #: Whether a letter was learned from, by its place in the table of letters.
    known: np.ndarray

    @staticmethod
    def fit(rows: list[tuple[str, str]] | Sample, fitted=None) -> Model:
        """From ``(text, language)`` pairs or their features; ``fitted`` gives the weights of the machines of a sample, here one after another."""
        sample = rows if isinstance(rows, Sample) else Sample.of(rows)
        weights = iter((fitted or (lambda s: map(s.machine, s.machines())))(sample))
        families = sorted(set(sample.kin))
        whole = [next(weights) for _ in families] if len(families) > 1 else [np.zeros(FEATURES + 1)] * len(families)
        pairs = {f: np.array([next(weights) for _ in combinations(own, 2)]).reshape(-1, FEATURES + 1) for f, own in sample.languages().items()}
        known = np.zeros(len(_letters()), dtype=bool)
        known[sample.letters] = True
        return Model(families, np.array(whole).reshape(len(families), FEATURES + 1), sample.languages(), pairs, known)

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score of a whole text; ``und`` and 0 without a letter, or without a model.

        The score is what the machines are sure of, times the share of the text's letters
        that were learned from: hashed runs don't tell an unknown alphabet from a known one.
        """
        if not text or not self.families or not _LETTER.search(text):
            return UNKNOWN, 0.0
        x = np.append(features(text), 1.0)
        margins = self.family_weights @ x
        best = int(np.argmax(margins))
        score = self._familiar(text) * (_logistic(margins[best]) if len(margins) > 1 else 1.0)
        own = self.languages[self.families[best]]
        if len(own) == 1:
            return own[0], score
        votes, total, sure = np.zeros(len(own)), np.zeros(len(own)), np.ones(len(own))
        for (a, b), margin in zip(combinations(range(len(own)), 2), self.pair_weights[self.families[best]] @ x):
            votes[a if margin >= 0 else b] += 1
            total[a], total[b] = total[a] + margin, total[b] - margin
            sure[a], sure[b] = min(sure[a], _logistic(margin)), min(sure[b], _logistic(-margin))
        at = max(range(len(own)), key=lambda k: (votes[k], total[k], -k))
        return own[at], score * float(sure[at])

    def _familiar(self, text: str) -> float:
        known = total = 0
        for codes in _codes(text):
            known, total = known + int(self.known[codes].sum()), total + len(codes)
        return known / total if total else 1.0


def _logistic(margin: float) -> float:
    return float(1 / (1 + np.exp(-4 * np.clip(margin, -50, 50))))


def fold() -> Column:
    """Remainder by 3 of the CRC-32 of ``doc_id`` as text; 1 is held out."""
    return F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 3


def _featured(batches):
    """The features that a whole text has, as places and values; rows without a letter go."""
    for batch in batches:
        for part in slices([batch], "text"):
            kept = [k for k, t in enumerate(part.column("text").to_pylist()) if _LETTER.search(t)]
            part = part.take(pa.array(kept, pa.int64()))
            found = [features(t).astype(np.float32) for t in part.column("text").to_pylist()]
            places = [np.flatnonzero(x).astype(np.int32) for x in found]
            columns = [pa.array(places, pa.list_(pa.int32())), pa.array([x[p] for x, p in zip(found, places)], pa.list_(pa.float32()))]
            columns.append(pa.array([alphabet(t).astype(np.int32) for t in part.column("text").to_pylist()], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([part.column(c) for c in ("lang", "h", "doc_id")] + columns, ["lang", "h", "doc_id", "places", "x", "letters"])


def sample(docs: DataFrame) -> DataFrame:
    """Features of the training sample: ``lang``, ``places``, ``x`` and ``letters``.

    Of each language that is learned, the documents that come first by a hash of their id,
    outside the held-out fold; texts are read whole.  ``ALL_DOCS`` rows at most.
    """
    usable = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null and doc_id is not null")
    usable = usable.where(fold() != 1).select("*", F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(1 << 30)).alias("h"))
    # a written table has a known size, so a small one is broadcast and no text is shuffled
    counts = Scratch(docs.sparkSession, "languages").save(usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(ALL_DOCS // LEAST_DOCS), "counts")
    each = min(PER_LANGUAGE, ALL_DOCS // max(1, counts.count()))
    # about three times as many as needed pass the first cut, so that no task ranks a whole language
    cut = counts.select("lang", (F.lit(3.0 * each) / F.col("n") * (1 << 30)).alias("most"))
    near = usable.join(cut, "lang").where("h < most").select("lang", "h", F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = near.mapInArrow(_featured, "lang string, h long, doc_id long, places array<int>, x array<float>, letters array<int>")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "places", "x"))
    return found.withColumn("k", rank).where(F.col("k") <= each).select("lang", "h", "doc_id", "places", "x", "letters")


def train(spark: SparkSession, docs: DataFrame) -> Model:
    """The machines of the learned languages of ``docs``, each fitted by a task of its own on the shared sample."""
    rows = sorted(sample(docs).collect(), key=lambda r: (r.lang, r.h, r.doc_id, r.places, r.x))
    x = np.zeros((len(rows), FEATURES), dtype=np.float32)
    for own, row in zip(x, rows):
        own[row.places] = row.x

    def fitted(own: Sample) -> list[np.ndarray]:
        shared, names = spark.sparkContext.broadcast(own), own.machines()
        if not names:
            return []

        def run(batches):
            for batch in batches:
                for k in batch.column("id").to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([shared.value.machine(names[k]).tobytes()], pa.binary())], ["id", "weights"])

        jobs = spark.range(0, len(names), 1, min(len(names), 4096)).mapInArrow(run, "id long, weights binary")
        found = [np.frombuffer(bytes(r.weights), dtype=np.float32) for r in sorted(jobs.collect(), key=lambda r: r.id)]
        shared.unpersist()  # tens of megabytes that no later task needs
        return found

    return Model.fit(Sample.made(list(x), [r.lang for r in rows], [r.letters for r in rows]), fitted)


def _judged(spark: SparkSession, docs: DataFrame, model: Model | None, names: tuple[str, str]) -> DataFrame:
    """``docs`` with the language and score of every row's ``text`` in two more columns."""
    shared = spark.sparkContext.broadcast(model or train(spark, docs))

    def run(batches):
        tool = shared.value
        for batch in slices(batches, "text"):
            found = [tool.predict(t) for t in batch.column("text").to_pylist()]
            columns = pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *names])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]))


def identify(spark: SparkSession, docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` of every row, in one pass without a shuffle.

    ``lang_pred`` is a language of the sample, or ``und`` if the text is null or has no
    letter.  The model is fitted on ``docs`` unless one is given; the languages with the most
    labelled documents are learned (150 at most), and without any labelled document every row
    is ``und``.  Texts of any length are read whole.  Of equal votes the language with the
    larger sum of margins wins, then the first by name.  A row without a ``doc_id`` is neither
    learned from nor held out.  Repeated rows are judged one by one, and each is learned from
    if its id is drawn; further columns, whatever their names, are not read.
    """
    shared = model or train(spark, docs)
    held = F.coalesce(fold() == 1, F.lit(False)).alias("held_out")
    return _judged(spark, docs.select(F.col("doc_id").cast("long").alias("doc_id"), held, F.col("text").cast("string").alias("text")), shared, ("lang_pred", "score")).drop("text")


def accept(spark: SparkSession, docs: DataFrame, model: Model | None = None, least: float = LEAST_SCORE, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The rows of ``docs`` whose text is in a language that was learned, with the language and score in columns ``names``.

    A row goes if its text is null or without a letter, or if the machines are so unsure
    of it that the score is below ``least``.  Columns of ``docs`` that are named so are
    replaced, all others are kept; repeated rows are judged one by one.
    Without any labelled document every row goes; an empty table gives an empty one.
    """
    pred, score = spare(docs.columns, "lang_pred", "score")
    judged = _judged(spark, docs, model, (pred, score)).where((F.col(pred) != UNKNOWN) & (F.col(score) >= least))
    kept = [c for c in docs.columns if c.lower() not in {n.lower() for n in names}]
    return judged.select(*kept, F.col(pred).alias(names[0]), F.col(score).alias(names[1]))
