"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax.

Words are counted over all training documents.  The most frequent ones have an outcome of their
own, the others share outcomes by hash, so p(word | h) = p(class | h) p(member | class, h) p(word | outcome).
The first two are softmax models over hashed n-gram and skip features of the outcomes before; the
third is the word's smoothed share of its outcome.  Unseen words have the share of one that was never seen.

Training goes over all training documents once, in ``ROUNDS`` disjoint shares.  In a round each task starts from the
shared weights, takes gradient steps on its documents and puts out its changes; Spark sums them by
row of the weight tables, and each row moves by the mean of its changes, weighted by how often a task met
it.  The weights have a fixed size; counts and shares grow with the corpus and stay in Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import slices, staged, tidy, words

#: Classes, and members of each; the outcomes of the first ``OWN`` belong to one word each.
CLASSES, MEMBERS = 32, 32
OWN = 24 * MEMBERS
OUTCOMES = CLASSES * MEMBERS
SHARED = OUTCOMES - OWN

#: Rows of the weight tables that features are hashed to, as powers of two.
CLASS_BITS, MEMBER_BITS = 15, 16

#: Words whose counts every task holds; the others' counts are joined.
COMMON = 1 << 18

#: Shares of the training documents, tokens of a gradient step, and its size.
ROUNDS, STEP, RATE = 4, 1 << 14, 0.2

#: Squares of changes that a row starts from, and the largest weight after a round.
CALM, LARGEST = 0.03, 8.0

#: Smoothing of counts.
UNSEEN = 0.1

#: The end of a text: a token of its own, and the first outcome.  Before a text there is nothing, which is outcome ``OUTCOMES``.
END = -1
TEXT_BYTES = 12 << 20
BLOCK = 256


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of the distinct words after A-Z are lower-cased, each token's place among them, and where the tokens of each text start."""
    found = words(pc.ascii_lower(pc.fill_null(texts, "")))
    names = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in found.distinct.to_pylist()), np.uint64, len(found.distinct)).view(np.int64)
    return names, found.codes, found.starts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", TEXT_BYTES):
            names, codes, _ = hashed_words(part.column("text"))
            n = np.bincount(codes, minlength=len(names))
            seen = n > 0
            yield pa.record_batch([pa.array(np.append(names[seen], END)), pa.array(np.append(n[seen], part.num_rows).astype(np.int64))], ["word", "n"])


@dataclass
class Vocabulary:
    """Counts of the common words, by sorted hash, and the outcomes."""

    words: np.ndarray  # sorted hashes
    counts: np.ndarray
    outcome: np.ndarray
    tokens: int  # of the training documents
    distinct: int
    mass: np.ndarray  # per outcome: its tokens, smoothed

    @property
    def total(self) -> float:
        return self.tokens + UNSEEN * (self.distinct + 1)

    def look_up(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Outcome and count of each word; -1 where the count is not held here."""
        if not len(self.words):
            return _shared(names), np.full(len(names), -1)
        at = np.minimum(np.searchsorted(self.words, names), len(self.words) - 1)
        held = self.words[at] == names
        return np.where(held, self.outcome[at], _shared(names)), np.where(held, self.counts[at], -1)


def _shared(names: np.ndarray) -> np.ndarray:
    return OWN + (names & (SHARED - 1))  # a power of two


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From ``word, n`` of all training words; what comes to the driver is bounded by ``COMMON`` and ``SHARED``."""
    tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    end, others = counts.filter(F.col("word") == END), counts.filter(F.col("word") != END)
    top = end.unionByName(others.orderBy(F.desc("n"), "word").limit(COMMON)).orderBy(F.col("word") != END, F.desc("n"), "word").toArrow()
    names, n = top.column("word").to_numpy().astype(np.int64), top.column("n").to_numpy().astype(np.int64)
    outcome = _shared(names)
    outcome[:OWN] = np.arange(min(OWN, len(names)))
    bucket = F.col("word").bitwiseAND(F.lit(SHARED - 1))
    sums = counts.groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).toArrow()
    held, kinds = np.zeros(SHARED), np.zeros(SHARED)
    held[sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
    kinds[sums.column("bucket").to_numpy()] = sums.column("words").to_numpy()
    own = outcome < OWN
    back = _shared(names[own]) - OWN
    np.subtract.at(held, back, n[own])
    np.subtract.at(kinds, back, 1)
    mass = np.full(OUTCOMES, UNSEEN)
    mass[outcome[own]] = n[own] + UNSEEN
    mass[OWN:] = held + UNSEEN * (kinds + 1)
    order = np.argsort(names)
    return Vocabulary(names[order], n[order], outcome[order], int(tokens), int(distinct), mass)


_CODED = "row long, doc_id string, held_out boolean, learn boolean, n_tokens long, n_known long, base double, share double, outcomes binary, rest array<long>"


def _encode(vocab: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = vocab.value
        row = TaskContext.get().partitionId() << 33
        (end_outcome,), (end_count,) = v.look_up(np.array([END], np.int64))
        end_count = max(int(end_count), 0)
        end_share = 0 if end_outcome < OWN else np.log10(UNSEEN / v.mass[end_outcome])
        log_total, log_mass = np.log10(v.total), np.log10(v.mass)
        for batch in batches:
            for part in slices(batch, "text", TEXT_BYTES):
                names, codes, starts = hashed_words(part.column("text"))
                outcome, n = v.look_up(names)
                held = np.where(n >= 0, np.log10(np.maximum(n, 0) + UNSEEN), 0)
                # An own outcome is one word; any other word has its share of the outcome's tokens.
                share = np.where((outcome < OWN) & (n >= 0), 0, held - log_mass[outcome])
                docs = part.num_rows
                owner = np.repeat(np.arange(docs), np.diff(starts))
                of = lambda per_word: np.bincount(owner, weights=per_word[codes], minlength=docs).astype(float)
                counts = np.diff(starts) + 1
                base = of(held) + np.log10(end_count + UNSEEN) - counts * log_total
                all_outcomes = np.full(len(codes) + docs, end_outcome, np.uint16)
                all_outcomes[np.arange(len(codes)) + owner] = outcome[codes]
                ends = np.cumsum(counts)
                edges = (np.concatenate([[0], ends]) * 2).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), docs, [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(all_outcomes.tobytes())])
                rest = n[codes] < 0
                upto = np.concatenate([[0], np.cumsum(rest)])[starts].astype(np.int32)
                others = pa.ListArray.from_arrays(pa.array(upto), pa.array(names[codes[rest]]))
                known = np.bincount(owner[n[codes] > 0], minlength=docs) + (end_count > 0)
                yield pa.record_batch([
                    pa.array(row + np.arange(docs)), part.column("doc_id"), part.column("held_out"), part.column("learn"), pa.array(counts),
                    pa.array(known), pa.array(base), pa.array(of(share) + end_share), packed, others,
                ], ["row", "doc_id", "held_out", "learn", "n_tokens", "n_known", "base", "share", "outcomes", "rest"])
                row += docs

    return run


@dataclass
class Weights:
    """The model: biases from counts, and a row of weights for each hashed feature."""

    class_bias: np.ndarray
    member_bias: np.ndarray
    classes: np.ndarray = field(default_factory=lambda: np.zeros((1 << CLASS_BITS, CLASSES), np.float32))
    members: np.ndarray = field(default_factory=lambda: np.zeros((1 << MEMBER_BITS, MEMBERS), np.float32))


def fresh(vocab: Vocabulary) -> Weights:
    mass = vocab.mass.reshape(CLASSES, MEMBERS)
    return Weights(np.log(mass.sum(1) / mass.sum()).astype(np.float32), np.log(mass / mass.sum(1, keepdims=True)).astype(np.float32))


def _rows(bits: int, kind: int, *parts: np.ndarray) -> np.ndarray:
    mixed = np.full(len(parts[0]), kind * 0x9E3779B97F4A7C15 & (1 << 64) - 1, np.uint64)
    for p in parts:
        mixed = (mixed ^ p.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
    return (mixed >> np.uint64(64 - bits)).astype(np.uint16)


def features(outcomes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]]:
    """Some tokens' outcomes, and their rows of the class table and of the member table, a step's tokens at a time.

    Class features: the outcome before, the two before, and the second before by itself.
    Member feature: the outcome before, with the class.
    """
    n = len(outcomes)
    place = np.minimum(np.arange(n) - np.repeat(starts[:-1], np.diff(starts)), 2).astype(np.uint8)
    padded = np.concatenate([np.zeros(2, outcomes.dtype), outcomes])
    for a in range(0, n, STEP):
        b = min(a + STEP, n)
        one, two = (np.where(place[a:b] >= k, padded[a + 2 - k : b + 2 - k], OUTCOMES) for k in (1, 2))
        now = outcomes[a:b].astype(np.int64)
        kind = now // MEMBERS
        yield (
            now,
            [_rows(CLASS_BITS, 1, one), _rows(CLASS_BITS, 2, two, one), _rows(CLASS_BITS, 3, two)],
            [_rows(MEMBER_BITS, 5, one, kind)],
        )


def _odds(bias: np.ndarray, table: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """Logits of each token's alternatives.  Weights are bounded, so their exponentials are too."""
    x = np.take(table, rows[0], axis=0)
    for r in rows[1:]:
        x += np.take(table, r, axis=0)
    x += bias
    return x


def _log_chance(x: np.ndarray, right: np.ndarray) -> np.ndarray:
    return x[np.arange(len(right)), right] - np.log(np.exp(x) @ np.ones(x.shape[1], np.float32))


def _sums(x: np.ndarray, turned: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the distinct ``rows``: which, how many of each, and the sum of their lines of ``x``, which ``turned`` holds column by column."""
    order = np.argsort(rows, kind="stable")
    held = rows[order]
    first = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
    n = np.diff(np.append(first, len(held)))
    several = n > 1
    out = np.take(x, order[first], axis=0)
    if several.any():
        starts = np.cumsum(n[several]) - n[several]
        out[several] = np.add.reduceat(np.take(turned, order[np.repeat(several, n)], axis=1), starts, axis=1).T
    return held[first], n, out


def token_scores(w: Weights, outcomes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """log10 p(outcome | the outcomes before) of every token."""
    out = []
    for now, by_class, by_member in features(outcomes, starts):
        k, m = np.divmod(now, MEMBERS)
        by = _log_chance(_odds(w.class_bias, w.classes, by_class), k).astype(float)
        out.append(by + _log_chance(_odds(w.member_bias[k], w.members, by_member), m))
    return np.concatenate(out) / np.log(10)


class Learner:
    """One task's gradient steps, and what they change."""

    def __init__(self, start: Weights) -> None:
        self.start = start
        self.now = Weights(start.class_bias, start.member_bias, start.classes.copy(), start.members.copy())
        self.met = [np.zeros(len(start.classes)), np.zeros(len(start.members))]
        self.size = [np.full(len(start.classes), CALM, np.float32), np.full(len(start.members), CALM, np.float32)]

    def learn(self, outcomes: np.ndarray, starts: np.ndarray) -> None:
        for now, by_class, by_member in features(outcomes, starts):
            k, m = np.divmod(now, MEMBERS)
            self._step(0, self.now.classes, self.now.class_bias, by_class, k)
            self._step(1, self.now.members, self.now.member_bias[k], by_member, m)

    def _step(self, which: int, table: np.ndarray, bias: np.ndarray, rows: list[np.ndarray], right: np.ndarray) -> None:
        slope = np.exp(_odds(bias, table, rows))
        slope /= (slope @ np.ones(slope.shape[1], np.float32))[:, None]
        slope[np.arange(len(right)), right] -= 1
        turned = np.ascontiguousarray(slope.T)
        for r in rows:
            row, n, step = _sums(slope, turned, r)
            self.size[which][row] += np.einsum("ij,ij->i", step, step) / step.shape[1]
            step *= (RATE / np.sqrt(self.size[which][row]))[:, None]
            table[row] -= step
            self.met[which][row] += n

    def changes(self) -> Iterator[pa.RecordBatch]:
        """Per block of rows the changes, weighted by how often each row was met."""
        schema = pa.schema([("block", pa.int32()), ("change", pa.binary()), ("met", pa.binary())])
        block = 0
        for before, after, met in ((self.start.classes, self.now.classes, self.met[0]), (self.start.members, self.now.members, self.met[1])):
            for a in range(0, len(before), BLOCK):
                n = met[a : a + BLOCK]
                if n.any():
                    moved = (after[a : a + BLOCK] - before[a : a + BLOCK]) * n[:, None]
                    yield pa.record_batch([pa.array([block], pa.int32()), [moved.astype(np.float32).tobytes()], [n.tobytes()]], schema=schema)
                block += 1


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Some rows, all their outcomes, and where those of each row start."""
    for batch in batches:
        for part in slices(batch, "outcomes"):
            blobs = [b.as_buffer() for b in part.column("outcomes")]
            starts = np.concatenate([[0], np.cumsum([len(b) // 2 for b in blobs])]).astype(np.int64)
            yield part, np.frombuffer(b"".join(blobs), np.uint16), starts


def _learn(weights: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner = None
        for _, outcomes, starts in _streams(batches):
            learner = learner or Learner(weights.value)
            learner.learn(outcomes, starts)
        if learner:
            yield from learner.changes()

    return run


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of each block's changes; rows come sorted by block, so one block is held at a time."""
    schema = pa.schema([("block", pa.int32()), ("change", pa.binary()), ("met", pa.binary())])
    block, change, met = None, None, None
    made = lambda: pa.record_batch([pa.array([block], pa.int32()), [change.tobytes()], [met.tobytes()]], schema=schema)
    for batch in batches:
        for b, c, m in zip(batch.column("block").to_pylist(), batch.column("change"), batch.column("met"), strict=True):
            c, m = np.frombuffer(c.as_buffer(), np.float32), np.frombuffer(m.as_buffer())
            if b != block:
                if block is not None:
                    yield made()
                block, change, met = b, np.zeros(len(c)), np.zeros(len(m))
            change += c
            met += m
    if block is not None:
        yield made()


def _moved(w: Weights, sums: pa.Table) -> Weights:
    classes, members = w.classes.copy(), w.members.copy()
    whole = len(classes) // BLOCK
    for b, c, m in zip(*(sums.column(x).to_pylist() for x in ("block", "change", "met")), strict=True):
        met = np.frombuffer(m)
        table, at = (classes, b) if b < whole else (members, b - whole)
        table[at * BLOCK : (at + 1) * BLOCK] += (np.frombuffer(c).reshape(BLOCK, -1) / np.maximum(met, 1)[:, None]).astype(np.float32)
    return Weights(w.class_bias, w.member_bias, classes.clip(-LARGEST, LARGEST), members.clip(-LARGEST, LARGEST))


def trained(coded: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS) -> Weights:
    """Weights after ``rounds`` rounds of distributed gradient steps on the rows of ``coded`` that are to be learned from."""
    sc, weights = coded.sparkSession.sparkContext, fresh(vocab)
    for share in range(rounds):
        shared = sc.broadcast(weights)
        docs = coded.filter("learn").filter(F.pmod(F.xxhash64("row"), F.lit(rounds)) == share).select("outcomes")
        changes = docs.mapInArrow(tidy(_learn(shared)), "block int, change binary, met binary")
        sums = changes.repartition("block").sortWithinPartitions("block").mapInArrow(_sum, "block int, change binary, met binary")
        weights = _moved(weights, sums.toArrow())
        shared.destroy()
    return weights


def _score(weights: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, outcomes, starts in _streams(batches):
            score = np.add.reduceat(token_scores(weights.value, outcomes, starts), starts[:-1])
            kept = [part.column(c) for c in ("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "share")]
            yield pa.record_batch([*kept, pa.array(score)], ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "share", "lm"])

    return run


def scored(docs: DataFrame, learn: Column, held_out: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Score every text by a model of the rows where ``learn`` holds.

    Tokens are the words after A-Z are lower-cased, and one end.  Returns ``doc_id, held_out, n_tokens,
    n_known`` (tokens seen in training), ``train_tokens``, ``base_score`` (smoothed unigrams) and ``score``
    (the model), both sums of log10 probabilities.

    A null or empty text is its end alone.  A row for which ``learn`` is null is not learned from; null ids
    stay null; equal rows get equal scores, up to rounding; texts of any length are scored whole; other columns are ignored.
    Without training rows every token is unseen.  An empty table gives no rows.
    """
    sc = docs.sparkSession.sparkContext
    kind = docs.schema[doc_id].dataType
    source = docs.select(
        F.col(f"`{doc_id}`").cast("string").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(learn, F.lit(False)).alias("learn"),
    )
    counted = source.filter("learn").select("text").mapInArrow(tidy(_count), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = staged(counted, "word-counts").frame
    vocab = vocabulary(counts)
    coded = staged(source.mapInArrow(tidy(_encode(sc.broadcast(vocab))), _CODED), "coded").frame
    weights = sc.broadcast(trained(coded, vocab))
    # Words whose counts no task holds are rare, so none is a hot key here.
    rest = coded.select("row", F.explode("rest").alias("word")).groupBy("row", "word").agg(F.count("*").alias("times")).join(counts, "word", "left")
    more = rest.groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + UNSEEN)).alias("more"), F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("more_known")
    )
    columns = "row long, doc_id string, held_out boolean, n_tokens long, n_known long, base double, share double, lm double"
    found = coded.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "share", "outcomes").mapInArrow(tidy(_score(weights)), columns).join(more, "row", "left")
    extra = F.coalesce("more", F.lit(0.0))
    return found.select(
        F.col("doc_id").cast(kind).alias(doc_id), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(vocab.tokens).cast("long").alias("train_tokens"), (F.col("base") + extra).alias("base_score"), (F.col("lm") + F.col("share") + extra).alias("score"),
    )
