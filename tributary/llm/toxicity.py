"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams, each with a vector of its own; a short
window of words is the average of its words' averages, and a linear softmax over it
gives the probability of the toxic class.  Vectors and softmax are trained jointly in
numpy, so an unseen misspelling is scored by the n-grams it shares with known words.
A document scores as its worst window: one insult in a long text counts as much as in
a short one.  In training, the loss at a document's worst window is spread over its
windows by their softmax, so the words behind a label are found without marks on them.

How many words a window averages and how far rare n-grams are shrunk is chosen in every
fit, on a fifth of the rows to learn from that the candidates don't see.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tributary.llm.common import Words, give_back, slices, tidy, words
from tributary.llm.substrings import _mixed

GRAMS = (3, 4, 5, 6)
BUCKETS = 1 << 18
DIMENSIONS = 8

#: Labelled toxic rows that the classifier is fitted on, at most; of the other class, three times as many.
TOXIC_ROWS = 1200

#: Text bytes that the classifier is fitted on, at most; a text of more than a sixteenth of them is not fitted on.
FIT_BYTES = 32 << 20


class Setting(NamedTuple):
    """What a fit may choose: words to a window, and the documents at which an n-gram counts half."""

    window: int
    half: float


SETTINGS = (Setting(1, 5), Setting(1, 20), Setting(2, 20))

#: Words whose n-grams are gone through at a time.
AT_ONCE = 100_000

#: An n-gram takes part if so many fitted documents hold it; fewer are enough, down to three, where few rows are fitted.
FEWEST = 8


def subwords(distinct: pa.Array, at_once: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all words and their n-grams, one word after another, and where each word's start.

    Words are lower-cased and only their letters and digits count.
    """
    flat, count = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for a in range(0, len(distinct), at_once):
        some = pc.replace_substring_regex(pc.utf8_lower(distinct.slice(a, at_once)), r"[^\p{L}\p{N}]+", "").to_pylist()
        whole = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in some), np.uint64, len(some))
        value, whose = [whole % np.uint64(BUCKETS)], [np.arange(len(some))]
        code = np.frombuffer("".join([f"<{w}>" for w in some]).encode("utf-32-le"), np.uint32).astype(np.uint64)
        owner = np.cumsum(code == ord("<")) - 1
        for n in GRAMS:
            size = len(code) - n + 1
            if size < 1:
                continue
            h = np.full(size, n, np.uint64)
            for i in range(n):
                h = h * np.uint64(0x100000001B3) + code[i : i + size]
            inside = np.flatnonzero(owner[:size] == owner[n - 1 :])
            value.append((_mixed(h[inside]) >> np.uint64(20)) % np.uint64(BUCKETS))
            whose.append(owner[inside])
        order = np.argsort(np.concatenate(whose), kind="stable")
        flat.append(np.concatenate(value).astype(np.int32)[order])
        count.append(np.bincount(np.concatenate(whose), minlength=len(some)))
    return np.concatenate(flat), np.concatenate([[0], np.cumsum(np.concatenate(count))]).astype(np.int64)


def _means(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The mean of each run of values; 0 for an empty one."""
    upto = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    count = np.maximum(np.diff(starts), 1)
    return (upto[starts[1:]] - upto[starts[:-1]]) / (count if values.ndim == 1 else count[:, None])


def _windows(found: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the windows, and the first window of each document; a short document is one window."""
    per = np.maximum(found.counts - window + 1, 1)
    first = np.concatenate([[0], np.cumsum(per)])
    start = np.arange(first[-1]) - np.repeat(first[:-1] - found.starts[:-1], per)
    return start, np.minimum(start + window, np.repeat(found.starts[1:], per)), first


@dataclass
class Toxicity:
    """What scoring needs of a fitted model: the softmax margin that each n-gram adds, and the bias."""

    margins: np.ndarray
    bias: float
    window: int = 1

    def __call__(self, texts: pa.Array) -> np.ndarray:
        found = words(texts)
        if not len(found.distinct) or not len(texts):
            return np.full(len(texts), 1 / (1 + np.exp(-self.bias)))
        grams, starts = subwords(found.distinct)
        each = _means(self.margins[grams], starts)
        start, end, first = _windows(found, self.window)
        upto = np.concatenate([[0], np.cumsum(each[found.codes])])
        margin = (upto[end] - upto[start]) / np.maximum(end - start, 1)
        return 1 / (1 + np.exp(-(np.maximum.reduceat(margin, first[:-1]) + self.bias)))


def _in_docs(grams: np.ndarray, size: np.ndarray, found: Words) -> np.ndarray:
    """For each bucket, how many documents hold it; counted once per word, so an upper bound."""
    pair = found.owner()
    pair *= len(size)
    pair += found.codes
    pair.sort()
    docs = np.bincount(pair[np.diff(pair, prepend=-1) > 0] % len(size), minlength=len(size)).astype(np.float32)
    ends, held = np.concatenate([[0], np.cumsum(size)]), np.zeros(BUCKETS)
    for a in range(0, len(size), AT_ONCE):
        b = min(a + AT_ONCE, len(size))
        held += np.bincount(grams[ends[a] : ends[b]], np.repeat(docs[a:b], size[a:b]), BUCKETS)
    return held


@dataclass
class _Rows:
    """The labelled rows as words and n-grams, and which of them are held back from the vectors.

    ``grams`` holds those of ``fewest`` documents or more, ``size`` how many each word has of them and ``count`` of all.
    """

    found: Words
    grams: np.ndarray
    size: np.ndarray
    count: np.ndarray
    in_docs: np.ndarray
    labels: np.ndarray
    back: np.ndarray
    fewest: int


def _train(rows: _Rows, setting: Setting, epochs: int, rate: float, decay: float, seed: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Vectors and softmax, trained together, all documents at a time; both classes weigh the same.

    Gives the margin that each n-gram adds, each document's highest margin and the bias.
    """
    found, labels, size, count, back = rows.found, rows.labels, rows.size, rows.count, rows.back
    rng = np.random.default_rng(seed)
    live = np.flatnonzero(rows.in_docs >= rows.fewest)  # buckets that are trained; the others add nothing
    place = np.zeros(BUCKETS, np.int32)
    place[live] = np.arange(len(live))
    grams = place[rows.grams]
    trust = (rows.in_docs[live] / (rows.in_docs[live] + setting.half)).astype(np.float32)
    start, end, first = _windows(found, setting.window)
    length = np.maximum(end - start, 1)
    doc = np.repeat(np.arange(len(labels)), np.diff(first))
    some = np.flatnonzero(size)
    first_gram = (np.cumsum(size) - size)[some]
    weight = np.where(labels == 1, 0.5 / labels[~back].sum(), 0.5 / (1 - labels[~back]).sum()) * ~back
    vectors = rng.normal(0, 0.1, (len(live), DIMENSIONS)).astype(np.float32)
    softmax = rng.normal(0, 0.5, (2, DIMENSIONS)).astype(np.float32)
    bias = np.zeros(2)
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (vectors, softmax, bias)]
    for step in range(1, epochs + 1):
        # A mean of vectors into a linear softmax is the mean of what each vector adds to it.
        of_gram = (vectors @ (softmax[1] - softmax[0])) * trust
        of_word = np.zeros(len(size))
        for a in range(0, len(some), AT_ONCE):
            mine = some[a : a + AT_ONCE]
            run = grams[first_gram[a] : first_gram[a] + int(size[mine].sum())]
            of_word[mine] = np.add.reduceat(of_gram[run], first_gram[a : a + AT_ONCE] - first_gram[a]) / count[mine]
        # From here on there are numbers for every window: what is done with is written over.
        upto = np.concatenate([[0], np.cumsum(of_word[found.codes])])
        margin = upto[end]
        margin -= upto[start]
        margin /= length
        top = np.maximum.reduceat(margin, first[:-1])
        chance = 1 / (1 + np.exp(-(top + bias[1] - bias[0])))
        if step == epochs:
            break
        share = margin
        share -= top[doc]
        share *= 4
        np.exp(np.minimum(share, 0, out=share), out=share)
        error = (chance - labels) * weight
        pull = share * (error / np.add.reduceat(share, first[:-1]))[doc]
        pull /= length
        edge = np.bincount(start, pull, len(upto))
        edge -= np.bincount(end, pull, len(upto))
        by_word = np.bincount(found.codes, np.cumsum(edge, out=edge)[:-1], len(size))
        del upto, margin, share, pull, edge
        by_gram = np.zeros(len(live))
        for a in range(0, len(some), AT_ONCE):
            mine = some[a : a + AT_ONCE]
            run = grams[first_gram[a] : first_gram[a] + int(size[mine].sum())]
            by_gram += np.bincount(run, np.repeat(by_word[mine] / count[mine], size[mine]), len(live))
        by_gram = (by_gram * trust).astype(np.float32)
        d_margin = by_gram @ vectors
        d_vectors = by_gram[:, None] * (softmax[1] - softmax[0])
        for x, d, (m, v) in zip((vectors, softmax, bias), (d_vectors, np.stack([-d_margin, d_margin]), np.array([-error.sum(), error.sum()])), state, strict=True):
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            if x is vectors:
                x *= 1 - rate * decay
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    margins = np.zeros(BUCKETS, np.float32)
    margins[live] = of_gram
    return margins, top, float(bias[1] - bias[0])


def _cut(top: np.ndarray, toxic: np.ndarray, prior: float) -> tuple[float, float]:
    """The margin at which held-back documents are told apart with the least expected error, and that error.

    The error is that of the best cut, averaged with its two neighbours of half and
    double the share of toxic rows, so that one lucky cut does not decide.
    """
    order = np.argsort(top, kind="stable")
    top, toxic = top[order], toxic[order]
    missed = np.concatenate([[0], np.cumsum(toxic)]) / toxic.sum()
    wrong = 1 - np.concatenate([[0], np.cumsum(1 - toxic)]) / (1 - toxic).sum()
    best = []
    for p in (prior, prior / 2, min(2 * prior, 0.999)):
        cost = missed * p + wrong * (1 - p)
        best.append((float(cost.min()) / min(p, 1 - p), np.flatnonzero(cost <= cost.min() + 1e-12)))
    cut = int(best[0][1][len(best[0][1]) // 2])
    edges = np.concatenate([[top[0] - 1], top, [top[-1] + 1]])
    return float((edges[cut] + edges[cut + 1]) / 2), sum(b[0] for b in best) / len(best)


def fit(
    texts: pa.Array, labels: np.ndarray, prior: float = 0.1, epochs: int = 80, rate: float = 0.2, decay: float = 0.02, seed: int = 7,
    settings: tuple[Setting, ...] = SETTINGS,
) -> Toxicity:
    """Train every setting for a third of the epochs, and the one that then tells held-back rows apart best for all.

    A fifth of the rows is held back from the vectors to choose the setting and to set
    the bias, so that the fewest errors are made at a probability of one half where
    ``prior`` of the documents are toxic.  If there are too few rows to hold some of
    both classes back, the first setting is used and the trained bias.  Without rows of
    both classes, every text scores by the one class there is; without any, nothing is
    known to be toxic.
    """
    labels = np.asarray(labels, float)
    if not len(labels) or labels.min() == labels.max():
        return Toxicity(np.zeros(BUCKETS, np.float32), 20.0 if len(labels) and labels[0] else -20.0)
    rng = np.random.default_rng(seed)
    found = words(texts)
    grams, starts = subwords(found.distinct)
    size = np.diff(starts)
    back = rng.random(len(labels)) < 0.2
    if any(labels[~back].sum() in (0, (~back).sum()) or not (labels[back] == c).any() for c in (0, 1)):
        back[:] = False
    in_docs = _in_docs(grams, size, found)
    fewest = min(FEWEST, max(3, len(labels) // 150))  # rarer ones only tell single rows apart
    common = (in_docs >= fewest)[grams]
    rows = _Rows(found, grams[common], np.add.reduceat(common, starts[:-1], dtype=np.int64), np.maximum(size, 1), in_docs, labels, back, fewest)
    del grams, common
    best = settings[0]
    if back.any() and len(settings) > 1:
        errors = [_cut(_train(rows, s, max(epochs // 3, 1), rate, decay, seed)[1][back], labels[back], prior)[1] for s in settings]
        best = settings[int(np.argmin(errors))]
    margins, top, shift = _train(rows, best, epochs, rate, decay, seed)
    return Toxicity(margins, -_cut(top[back], labels[back], prior)[0] if back.any() else shift, best.window)


def fitted(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = TOXIC_ROWS) -> Toxicity:
    """Fit on at most ``most`` toxic and ``3 * most`` other labelled documents, picked by a hash of their ids.

    Of these, texts of up to a sixteenth of ``FIT_BYTES`` take part, in the order of the
    hash, as far as ``FIT_BYTES`` go; all others are scored all the same.
    Labels other than 0 and 1, or without an id or a document, are left out; an id
    that is labelled twice counts as toxic if any of its labels says so.  ``labels``
    holds the rows that may be learned from.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .filter("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    )
    shares = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    by_hash = known.orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = by_hash.filter("label = 1").limit(most).unionByName(by_hash.filter("label = 0").limit(3 * most))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).dropna()
    # At most 4 * most ids are broadcast, and as many texts go to the one task that fits.
    size, by = F.octet_length("text"), [F.xxhash64("doc_id"), "doc_id", "text"]
    short = texts.filter(size <= FIT_BYTES // 16).join(F.broadcast(picked), "doc_id").orderBy(*by).limit(4 * most)
    upto = F.sum(size).over(Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = short.withColumn("_upto", upto).filter(F.col("_upto") <= FIT_BYTES).select("text", "label")
    toxic = shares.get(1, 0)
    prior = min(max(toxic / max(toxic + shares.get(0, 0), 1), 0.001), 0.999)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = pa.Table.from_batches(batches, pa.schema([("text", pa.string()), ("label", pa.int32())]))
        model = fit(sample.column("text").combine_chunks(), sample.column("label").to_numpy(), prior=prior)
        yield pa.record_batch([pa.array([model.margins.tobytes()], pa.binary()), pa.array([model.bias]), pa.array([model.window])], ["margins", "bias", "window"])

    found = rows.mapInArrow(tidy(run), "margins binary, bias double, window long").first()
    if found is None:
        return fit(pa.array([], pa.string()), np.zeros(0))
    return Toxicity(np.frombuffer(found["margins"], np.float32), found["bias"], found["window"])


def with_score(docs: DataFrame, model: Toxicity, text: str = "text", into: str = "score") -> DataFrame:
    """All rows and columns, and the probability that the whole text is toxic.

    Null and empty texts have no words and score by the bias alone.  A column named
    ``into`` is replaced.
    """

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        parts = [model(part.column(0)) for part in slices(pa.record_batch([texts], ["text"]), "text")]
        give_back()
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return docs.withColumn(into, score(F.col(f"`{text}`").cast("string")))
