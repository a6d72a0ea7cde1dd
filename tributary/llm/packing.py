"""Packing: concatenate all documents and cut the stream into windows.

Two passes.  The first tokenizes each document and notes its place among the
tokens of its partition; sums over the partitions' totals then give each
partition its place in the whole stream.  The second pass needs no order and no
shuffle: a row knows its global offset, cuts itself at the window edges and
yields one boundary record per piece.  The tokenized rows are written to the
shared folder between the passes, so tokens are made once and the places stay
the same if an executor is lost.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tributary.llm.common import ragged, slices, staged, tidy, words

#: Text bytes tokenized at a time: the more there are, the fewer words come again in the next step, and the more memory it takes.
TEXT_BYTES = 4 << 20

#: Words, and parts of words, of which a worker remembers the ids.
REMEMBERED = 300_000

#: New parts of words that are encoded at a time.
AT_ONCE = 20_000

#: Words that Unicode normalization leaves alone and whose letters are lower-cased one by one.
PLAIN = re.compile("[!-~\u00a1-\u017f]+")

#: Those of letters and at most one sign after them; without U+0130, of which lower case is two characters.
SIGNS = ".,!"
LETTERS = f"^[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+[{SIGNS}]?$"

#: Byte-level vocabularies write a byte that has no visible character as the next free one from 256 on.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
BYTES = [chr(256 + _HIDDEN.index(b)) if b in _HIDDEN else chr(b) for b in range(256)]

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, padded_to int"


class WordIds:
    """Ids of texts by a tokenizer that never joins characters across ASCII white space: each distinct word is encoded once.

    If the tokenizer's file says that it lower-cases and then splits words by one
    pattern, words of plain Latin letters and signs are split here first and
    remembered by their parts, of which there are far fewer.  Words of letters with
    at most one sign behind them are split and lower-cased all at once.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.model = self.tokenizer.model
        self.split = _splitter(self.tokenizer)

    def _learn_parts(self, names: Iterable[str]) -> None:
        new = list({p for p in names if p not in self.parts})
        for a in range(0, len(new), AT_ONCE):
            some, ids, ends = new[a : a + AT_ONCE], [], []
            for p in some:
                ids += [t.id for t in self.model.tokenize(p if p.isascii() else "".join([BYTES[b] for b in p.encode()]))]
                ends.append(len(ids) * self.dtype.itemsize)
            flat = np.array(ids, self.dtype).tobytes()
            self.parts.update((p, flat[x:y]) for p, x, y in zip(some, [0, *ends], ends, strict=False))

    def _learn(self, names: list[str]) -> None:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = [w for w in names if w not in self.known]
        split = {w: self.split(w.lower()) for w in new if PLAIN.fullmatch(w) and "<|" not in w} if self.split else {}
        self._learn_parts(p for mine in split.values() for p in mine)
        self.known.update((w, b"".join([self.parts[p] for p in mine])) for w, mine in split.items())
        other = [w for w in new if w not in split]
        for w, e in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False), strict=True):
            self.known[w] = np.array(e.ids, self.dtype).tobytes()

    def _lettered(self, names: pa.Array) -> list[bytes]:
        """The ids of words that ``LETTERS`` describes."""
        stems = pc.utf8_lower(pc.utf8_rtrim(names, characters=SIGNS)).dictionary_encode()
        distinct = _strings(stems.dictionary)
        self._learn_parts([*distinct, *SIGNS])
        of_stem, tail = [self.parts[p] for p in distinct], [b"", *(self.parts[s] for s in SIGNS)]
        sign = np.zeros(len(names), np.int64)
        for i, s in enumerate(SIGNS):
            sign[np.asarray(pc.ends_with(names, s))] = i + 1
        return [of_stem[c] + tail[t] for c, t in zip(stems.indices.to_numpy().tolist(), sign.tolist(), strict=True)]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where those of each text start."""
        found = words(texts)
        if len(self.parts) > REMEMBERED:
            self.parts.clear()
        easy = np.asarray(pc.match_substring_regex(found.distinct, LETTERS)) if self.split else np.zeros(len(found.distinct), bool)
        other = _strings(found.distinct.filter(pa.array(~easy)))
        self._learn(other)
        lettered, rest = iter(self._lettered(found.distinct.filter(pa.array(easy)))), (self.known[w] for w in other)
        parts = [next(lettered if e else rest) for e in easy.tolist()]
        each = np.fromiter(map(len, parts), np.int64, len(parts)) // self.dtype.itemsize
        pool = np.frombuffer(b"".join(parts), self.dtype)
        counts = each[found.codes]
        ids = pool[ragged((np.cumsum(each) - each)[found.codes], counts)]
        return ids, np.concatenate([[0], np.cumsum(counts)])[found.starts]


def _strings(names: pa.Array) -> list[str]:
    return names.to_numpy(zero_copy_only=False).tolist()


def _splitter(tokenizer: Tokenizer) -> Callable[[str], list[str]] | None:
    """The split into parts that the model encodes one by one, if the settings are of the known kind.

    Only the parts with settings are read: the whole file as text is many times their size.
    """
    of = lambda part: json.loads(part.__getstate__()) if part is not None else {}
    steps = [x["type"] for x in of(tokenizer.normalizer).get("normalizers", [])]
    splits = of(tokenizer.pre_tokenizer).get("pretokenizers", [])
    known = steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in splits] == ["Split", "ByteLevel"]
    if not known or splits[0]["behavior"] != "Removed" or not splits[0]["invert"] or splits[1]["use_regex"] or splits[1]["add_prefix_space"]:
        return None
    if any(not x.content.startswith("<|") for x in tokenizer.get_added_tokens_decoder().values()):
        return None
    return regex.compile(splits[0]["pattern"]["Regex"]).findall


def _tokenize(path: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, placed = WordIds(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in slices(batch, "text", TEXT_BYTES):
                ids, starts = encode(rows.column("text"))
                counts = np.diff(starts) + 1
                all_ids = np.insert(ids, starts[1:], end_id)
                ends = np.cumsum(counts)
                edges = (np.concatenate([[0], ends]) * encode.dtype.itemsize).astype(np.int32)
                blobs = pa.Array.from_buffers(pa.binary(), rows.num_rows, [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(all_ids.tobytes())])
                yield pa.record_batch([
                    rows.column("doc_id"), pa.array(np.full(rows.num_rows, part, np.int32)), pa.array(placed + ends - counts), pa.array(counts), blobs,
                ], ["doc_id", "part", "before", "doc_tokens", "ids"])
                placed += int(ends[-1])

    return run


def _cut(window: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "ids"):
                n = rows.column("doc_tokens").to_numpy()
                at = rows.column("at").to_numpy()
                total = rows.column("total").to_numpy()
                first = at // window
                pieces = (at + n - 1) // window - first + 1
                row = np.repeat(np.arange(rows.num_rows), pieces)
                sequence = ragged(first, pieces)
                begin = np.maximum(at[row], sequence * window)
                length = np.minimum((at + n)[row], (sequence + 1) * window) - begin
                start = begin - at[row]
                used = np.minimum(total[row] - sequence * window, window)
                texts = [np.frombuffer(x.as_buffer(), width) for x in rows.column("ids")]
                ids = [texts[r][s : s + k].astype("<u4").tobytes() for r, s, k in zip(row.tolist(), start.tolist(), length.tolist(), strict=True)]
                yield pa.record_batch([
                    rows.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(length), pa.array(ids, pa.binary()), pa.array(n[row]),
                    pa.array(sequence), pa.array(begin - sequence * window), pa.array(np.where(used & (used - 1), window, used).astype(np.int32)),
                ], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "padded_to"])

    return run


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Cut all documents into sequences of ``window`` ids; one row per piece of a document.

    ``tokenizer`` is a file of the tokenizers library whose ids do not join
    characters across ASCII white space.  A document is its ids and then
    ``end_id``.  ``ids`` holds a piece's ids as little-endian unsigned 32-bit
    numbers, ``offset`` its place in the sequence, ``padded_to`` the length to
    which the sequence is padded: ``window``, or its own length if that is a power
    of two.  Every sequence but the last is full.

    A null or empty text is its ``end_id`` alone.  Null ids stay null, equal rows
    are packed one by one, other columns are ignored, an empty table gives no
    rows, a text of any length is cut as often as needed.
    """
    width = "<u2" if _vocabulary(tokenizer) <= 1 << 16 else "<u4"
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    tokens = staged(
        source.mapInArrow(tidy(_tokenize(tokenizer, end_id)), "doc_id long, part int, before long, doc_tokens long, ids binary"), "tokens"
    ).frame
    # One row per partition: what is sorted and broadcast here is bounded by their number.
    totals = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("tokens"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bases = totals.select("part", (F.sum("tokens").over(upto) - F.col("tokens")).alias("base"), F.sum("tokens").over(everything).alias("total"))
    placed = tokens.join(F.broadcast(bases), "part").select("doc_id", "doc_tokens", "ids", (F.col("base") + F.col("before")).alias("at"), "total")
    return placed.mapInArrow(_cut(window, width), PIECES)


def _vocabulary(path: str) -> int:
    return Tokenizer.from_file(path).get_vocab_size()
