"""Toxicity: a counterfactual-regularised linear classifier.

A logistic model over the presence of words and of pieces of words (five bytes,
of which the first may be the place before the word, so that inflected and
compound insults are met too) is fitted on at most ``max_labelled`` labelled
rows of each class (a documented bound; which ones, a hash of the id decides)
and has at most ``max_words`` features beside the identity terms, those that
tell the classes apart best. In every labelled sentence with an identity term
the term is swapped for the others of its group, and the change of score is
penalised. A term's part of a score is the weight of the word and of all its
pieces, so a swap of t for o changes it by ``s_t - s_o``, and what is penalised
is the square of that. The terms of a group so get one score at most, and
neutral mentions of a group are not held against a text.

Fitting takes only words, never ids, languages, sources or the labels of rows
that are scored; rows whose ``crc32(id) % 5`` is 0 are held out. Word counts by
class are summed by Spark; the driver gets the chosen words and, for the
bounded sample, their numbers.

Defined results: a null or empty text has no words and the score of the
intercept alone. Without a labelled row of either class every score is the
share of toxic labels (0 without labels). Labels that contradict each other
for an id count as toxic if at least half say so. Repeated rows repeat their
score; clashing input columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tessera.llm.common import _IS_WORD, cut, steps, utf8, word_hashes

MAX_LABELLED = 10_000
MAX_WORDS = 2_048
MIN_TEXTS = 3
#: Chi-square of a word's two-by-two table from which on its difference between the classes is no chance among so many words.
LEAST_CHI_SQUARE = 20.0
COUNTERFACTUAL = 10.0
RIDGE = 1e-5
#: Toxic texts weigh as if they were at least this share: one that is missed costs more than their rarity says.
LEAST_SHARE = 0.25
HELD_OUT_OF = 5

#: Groups of terms that may stand for one another in a neutral sentence.
IDENTITY_GROUPS = (
    "women men woman man girls boys female male trans transgender nonbinary".split(),
    "muslim muslims jewish jews christian christians hindu hindus buddhist buddhists atheist atheists catholic sikh".split(),
    "black white asian african american european latino hispanic arab arabs indian mexican chinese roma".split(),
    "gay lesbian straight bisexual queer heterosexual homosexual".split(),
    "immigrant immigrants refugee refugees migrant migrants foreigner foreigners native locals".split(),
    "blind deaf disabled autistic old young elderly teenagers".split(),
    "femmes hommes femme homme musulmans juifs chretiens".split(),
    "frauen männer frau mann muslime juden christen".split(),
    "mujeres hombres mujer hombre musulmanes judios cristianos".split(),
)


PIECE = 5
_SEGMENT = 1 << 19


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, feature) of all words and pieces, with repetitions, some at a time."""
    hashes, at = word_hashes(texts)
    yield np.repeat(np.arange(len(texts)), np.diff(at)), hashes | np.uint64(1 << 63)
    data, offsets = utf8(pc.utf8_lower(pc.fill_null(texts, "")))
    for first in range(0, len(data) - PIECE + 1, _SEGMENT):
        part = data[first : first + _SEGMENT + PIECE - 1]
        word = _IS_WORD[part]
        n = len(part) - PIECE + 1
        ok = np.ones(n, bool)
        key = np.zeros(n, np.uint64)
        plain = np.where(word, part, np.uint8(32)).astype(np.uint64)
        for k in range(PIECE):
            key = (key << np.uint64(8)) | plain[k : k + n]
            if k:
                ok &= word[k : k + n]
        inner = offsets[1:-1] - first
        inner = inner[(inner > 0) & (inner < len(part))]
        for k in range(1, PIECE):  # not across two texts
            over = inner - k
            ok[over[(over >= 0) & (over < n)]] = False
        place = np.flatnonzero(ok)
        yield np.searchsorted(offsets, place + first, "right") - 1, key[place]


@dataclass(frozen=True)
class ToxicityModel:
    words: np.ndarray  # features, ascending
    weights: np.ndarray
    intercept: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = np.full(len(texts), self.intercept)
        if not len(self.words):
            return 1 / (1 + np.exp(-np.clip(out, -30, 30)))
        table = np.zeros(1 << 16, bool)
        table[_slot(self.words)] = True
        pairs = [np.empty(0, np.int64)]
        for owner, keys in features(texts):
            near = np.flatnonzero(table[_slot(keys)])
            place = np.minimum(np.searchsorted(self.words, keys[near]), len(self.words) - 1)
            known = self.words[place] == keys[near]
            pairs.append(np.unique(owner[near[known]] * len(self.words) + place[known]))
        found = np.unique(np.concatenate(pairs))
        np.add.at(out, found // len(self.words), self.weights[found % len(self.words)])
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def _slot(keys: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.intp)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % HELD_OUT_OF == 0, F.lit(False))


def _word_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, distinct features) of (label, text)."""
    for whole in batches:
        for batch in steps(whole):
            own: list[list[np.ndarray]] = [[] for _ in range(batch.num_rows)]
            for owner, keys in features(batch.column(1)):
                at = np.searchsorted(owner, np.arange(batch.num_rows + 1))
                for i in range(batch.num_rows):
                    own[i].append(np.unique(keys[at[i] : at[i + 1]]))
            sets = [np.unique(np.concatenate(x)).tobytes() for x in own]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["label", "words"])


#: Features with their counts that a task holds before it gives them on.
_HELD = 1 << 18


def _folded(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their (clean, toxic) counts."""
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each word, in how many clean and toxic texts of a task it stands; a word may come several times, with parts of its counts."""
    now = [(np.empty(0, np.uint64), np.empty((0, 2), np.int32))]
    for batch in batches:
        for label in (0, 1):
            own = batch.column(1).filter(pc.equal(batch.column(0), label)).to_pylist()
            keys, n = np.unique(np.frombuffer(b"".join(own), np.uint64), return_counts=True)
            counts = np.zeros((len(keys), 2), np.int32)
            counts[:, label] = n
            now.append((keys, counts))
        now = [_folded(now)]
        if len(now[0][0]) > _HELD:
            yield from _given(*now[0])
            now = [(now[0][0][:0], now[0][1][:0])]
    yield from _given(*now[0])


def _given(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(keys), 100_000):
        part = slice(at, at + 100_000)
        yield pa.RecordBatch.from_arrays([pa.array(keys[part].view(np.int64)), pa.array(counts[part, 0].astype(np.int64)), pa.array(counts[part, 1].astype(np.int64))], names=["word", "clean", "toxic"])


def _numbers(chosen: np.ndarray):
    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.flatnonzero(np.isin(chosen, np.frombuffer(w, np.uint64), assume_unique=True)).astype("<u2").tobytes() for w in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["label", "numbers"])

    return numbered


def identity_features() -> list[list[np.ndarray]]:
    """For each group and term its features, the word itself first."""
    out = []
    for group in IDENTITY_GROUPS:
        found = [[] for _ in group]
        for owner, keys in features(pa.array([f" {x} " for x in group])):
            for i, key in zip(owner.tolist(), keys.tolist(), strict=True):
                found[i].append(key)
        out.append([np.array(list(dict.fromkeys(x)), np.uint64) for x in found])
    return out


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_labelled: int = MAX_LABELLED, max_words: int = MAX_WORDS, min_texts: int = MIN_TEXTS, counterfactual: float = COUNTERFACTUAL, ridge: float = RIDGE) -> ToxicityModel:
    """Fits the classifier on rows that are not held out."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("_id")).agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("label"))
    known = known.where(~held_out(F.col("_id")))
    share = known.agg(F.avg("label").alias("p"), F.count("*").alias("n")).first()
    prior = float(share["p"] or 0.0)
    if prior in (0.0, 1.0):
        odds = np.log((prior * share["n"] + 0.5) / ((1 - prior) * share["n"] + 0.5)) if share["n"] else -30.0
        return ToxicityModel(np.empty(0, np.uint64), np.empty(0), float(odds))
    order = F.xxhash64(F.col("_id")), F.col("_id")
    sample = known.where("label = 1").orderBy(*order).limit(max_labelled).unionByName(known.where("label = 0").orderBy(*order).limit(max_labelled))
    ids = docs.sparkSession.createDataFrame(sample.collect(), sample.schema)  # at most 2 * max_labelled ids and labels
    source = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(ids), "_id")
    sets = source.select("label", "text").mapInArrow(_word_sets, "label int, words binary")
    sets = cut(sets.dropDuplicates(["label", "words"]))  # copies of a sentence teach once
    counts = sets.mapInArrow(_count, "word long, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    sizes = {r["label"]: r["count"] for r in sets.groupBy("label").count().collect()}
    n0, n1 = max(1, sizes.get(0, 0)), max(1, sizes.get(1, 0))
    a, b = F.col("clean").cast("double"), F.col("toxic").cast("double")
    cross = a * (n1 - b) - b * (n0 - a)
    chi = (n0 + n1) * cross * cross / (F.lit(float(n0) * n1) * (a + b) * F.greatest(n0 + n1 - a - b, F.lit(1.0)))
    best = counts.where((a + b >= min_texts) & (chi >= LEAST_CHI_SQUARE)).orderBy(chi.desc(), "word").limit(max_words).select("word").collect()
    terms = identity_features()
    chosen = np.unique(np.concatenate([np.array([r["word"] for r in best], np.int64).view(np.uint64), np.array([t[0] for g in terms for t in g], np.uint64)]))
    groups = [[np.flatnonzero(np.isin(chosen, t)) for t in g] for g in terms]
    words = [np.searchsorted(chosen, np.array([t[0] for t in g], np.uint64)) for g in terms]
    rows = sets.mapInArrow(_numbers(chosen), "label int, numbers binary").collect()
    y = np.array([r["label"] for r in rows], np.float64)
    held = [np.frombuffer(r["numbers"], "<u2").astype(np.int64) for r in rows]
    weights, intercept = _fit(held, y, len(chosen), words, groups, counterfactual, ridge, max(prior, LEAST_SHARE))
    return ToxicityModel(chosen, weights, intercept)


def _fit(held: list[np.ndarray], y: np.ndarray, size: int, words: list[np.ndarray], groups: list[list[np.ndarray]], counterfactual: float, ridge: float, prior: float, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Weights that minimise the log loss (classes weighed as ``prior`` says), a ridge, and the squared score change of every swap.

    ``held`` are the features of each sentence; for each group, ``words`` is the feature that tells that a term stands in a
    sentence, and ``groups`` are all features that a term brings with it.
    """
    n = len(held)
    flat = np.concatenate(held) if n else np.empty(0, np.int64)
    owner = np.repeat(np.arange(n), [len(f) for f in held])
    weight = np.where(y == 1, prior / max(1, y.sum()), (1 - prior) / max(1, (1 - y).sum()))
    # Swaps: for a term in a labelled sentence, every other term of its group; each sentence's swaps weigh as one.
    counts = np.bincount(flat, weights=weight[owner], minlength=size)
    group_of = []
    for own, terms in zip(words, groups, strict=True):
        group_of.append((np.concatenate(terms), np.repeat(np.arange(len(terms)), [len(t) for t in terms]), counts[own]))
    w, b = np.zeros(size), float(np.log(prior / (1 - prior)))
    second = np.zeros(size)
    first = np.zeros(size)
    b1 = b2 = 0.0
    for t in range(1, rounds + 1):
        z = b + np.bincount(owner, weights=w[flat], minlength=n)
        error = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        grad = np.bincount(flat, weights=error[owner], minlength=size) + ridge * w
        for place, term, c in group_of:
            # d/ds of counterfactual * sum over t, o of c_t / (k - 1) * (s_t - s_o) ** 2, then to the features of s
            s = np.bincount(term, weights=w[place], minlength=len(c))
            own = c * (len(c) * s - s.sum()) + (c.sum() * s - (c * s).sum())
            np.add.at(grad, place, 2 * counterfactual * own[term] / max(1, len(c) - 1))
        step = 0.2 / (1 + t / 200)
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad**2
        w = w - step * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-6)
        g0 = error.sum()
        b1, b2 = 0.9 * b1 + 0.1 * g0, 0.99 * b2 + 0.01 * g0**2
        b -= step * (b1 / (1 - 0.9**t)) / (np.sqrt(b2 / (1 - 0.99**t)) + 1e-6)
    return w, b


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", keep: list[str] | None = None, into: str = "score") -> DataFrame:
    """``keep`` (all columns unless named) with the score of each whole text."""
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() != into.lower()]
    source = docs.select(*[f"`{c}`" for c in dict.fromkeys([*keep, text])])
    schema = T.StructType([*[source.schema[c] for c in keep], T.StructField(into, T.DoubleType())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps(whole, text):
                values = model.scores(batch.column(batch.schema.get_field_index(text)))
                yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in keep], pa.array(values)], names=[*keep, into])

    return source.mapInArrow(scored, schema)
