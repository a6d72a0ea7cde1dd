"""SentencePiece encoding and decoding by suffix-array matching.

The distinct chunks of a batch that are not known yet are concatenated and indexed by a
suffix array.  Every piece of the vocabulary is binary-searched in it; its range of
suffixes are its occurrences.  Those edges, sorted by position, are the lattice of all
segmentations.  It is relaxed the way byte-pair models rank segmentations: from single
characters on, the best-scored edge that joins two neighbouring segments is taken, the
leftmost first, until none is left.

No piece holds white space after another character, so a text falls into chunks (white
space and what follows it) that are encoded independently.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import ragged, slices

SPACE = "▁"
CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")

#: Chunks of which a worker remembers the ids, twice at most, and text bytes taken at a time.
REMEMBERED = 400_000
TEXT_BYTES = 5 << 20
#: Longer chunks are relaxed one by one with a queue, the others all together.
LONG = 48


def order_of(key: np.ndarray) -> np.ndarray:
    """The stable order of numbers from 0 on; 16 bits at a time, which numpy sorts by counting."""
    order, shift, top = np.argsort((key & 0xFFFF).astype(np.uint16), kind="stable"), 16, int(key.max()) if len(key) else 0
    while top >> shift:
        order = order[np.argsort(((key >> shift) & 0xFFFF).astype(np.uint16)[order], kind="stable")]
        shift += 16
    return order


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """The places of a text sorted by the ``depth`` codes from there on; rank doubling."""
    key, done = codes.astype(np.int64), 1
    while True:
        top = int(key.max()) + 1 if len(key) else 1
        if done >= depth:
            return order_of(key)
        if top <= 4 * len(key) + (1 << 21):  # few possible keys: ranks by counting
            seen = np.zeros(top, bool)
            seen[key] = True
            rank = np.cumsum(seen, dtype=np.int64)[key]
        else:
            order = order_of(key)
            held = key[order]
            rank = np.empty(len(key), np.int64)
            rank[order] = np.cumsum(np.concatenate([[True], held[1:] != held[:-1]]))
        after = np.zeros(len(rank), np.int64)
        after[: max(len(rank) - done, 0)] = rank[done:]
        key = rank * (int(rank.max()) + 1 if len(rank) else 1) + after
        done *= 2


class Pieces:
    """A byte-pair model with byte fallback, read from a file of the sentencepiece library."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.encode(" a  b", out_type=str) and model.decode(model.encode(" a  b ")) != " a  b ":
            raise ValueError("the model must keep white space as it is")
        size = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        if any(SPACE in self.text[i].lstrip(SPACE) for i in plain):
            raise ValueError("a piece holds white space after another character")
        self.single = {self.text[i]: i for i in plain if len(self.text[i]) == 1}
        self.byte = {int(self.text[i][1:-1], 16): i for i in range(size) if model.is_byte(i)}
        self.longer = np.array(sorted((i for i in plain if len(self.text[i]) > 1), key=lambda i: self.text[i]))
        self.width = max((len(self.text[i]) for i in self.longer), default=1)
        self.length = np.array([len(self.text[i]) for i in self.longer], np.int64)
        self.codes = np.zeros((len(self.longer), self.width), np.int32)
        for row, i in enumerate(self.longer):
            self.codes[row, : self.length[row]] = [ord(c) for c in self.text[i]]
        self.single_codes = np.array(sorted(ord(c) for c in self.single), np.int64)
        self.single_ids = np.array([self.single[chr(c)] for c in self.single_codes.tolist()], np.int64)
        self.price = np.array([-model.get_score(i) for i in range(size)])
        self.known: dict[str, bytes] = {}  # what was met of late
        self.older: dict[str, bytes] = {}  # what was met before that: what comes again moves up, the rest goes
        raw = [bytes([int(t[1:-1], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else t.replace(SPACE, " ").encode() for i, t in enumerate(self.text)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_length = np.array([len(r) for r in raw], np.int64)
        self.raw_start = np.cumsum(self.raw_length) - self.raw_length

    def occurrences(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``longer`` and the places where they occur, by place."""
        order = suffix_array(codes, self.width)
        padded = np.concatenate([codes, np.full(self.width, -1)]).astype(np.int32)
        step = np.arange(self.width)
        first_code = codes[order]
        edges = [np.searchsorted(first_code, self.codes[:, 0], side) for side in ("left", "right")]
        inside = step < self.length[:, None]
        ranges = []
        for upper in (False, True):
            low, high = edges[0].copy(), edges[1].copy()
            while (low < high).any():
                mid = (low + high) // 2
                go = np.flatnonzero(low < high)
                mid = mid[go]
                apart = (padded[order[mid][:, None] + step] - self.codes[go]) * inside[go]
                sign = apart[np.arange(len(go)), (apart != 0).argmax(1)]
                before = (sign <= 0) if upper else (sign < 0)
                low[go[before]] = mid[before] + 1
                high[go[~before]] = mid[~before]
            ranges.append(low)
        count = ranges[1] - ranges[0]
        place, row = order[ragged(ranges[0], count)], np.repeat(np.arange(len(count)), count)
        by_place = order_of(place)
        return row[by_place], place[by_place]

    def _learn(self, chunks: list[str]) -> list[bytes]:
        """The ids of chunks that are not known yet."""
        codes = np.frombuffer("\0".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        row, place = self.occurrences(codes)
        edge = np.full((len(codes), self.width + 1), -1, np.int16 if len(self.text) < 1 << 15 else np.int32)
        edge[place, self.length[row]] = self.longer[row]
        size = np.array([len(c) for c in chunks], np.int64)
        start = np.cumsum(size + 1) - size - 1
        cut = np.ones(len(codes) + 1, bool)  # whether a segment starts at a place
        for k in np.flatnonzero(size > LONG).tolist():
            self._relax_one(edge, cut, int(start[k]), int(size[k]))
        short = np.flatnonzero((size > 1) & (size <= LONG))
        self._relax(edge, cut, ragged(start[short], size[short]), np.repeat(np.arange(len(short)), size[short]), len(short))
        cut[start + size] = False  # what parts the chunks
        cut = cut[: len(codes)]
        begin = np.flatnonzero(cut)
        owner = np.searchsorted(start, begin, "right") - 1
        length = np.minimum(np.append(begin[1:], len(codes)), (start + size)[owner]) - begin
        piece = edge[begin, length].astype(np.int64)
        alone = np.flatnonzero(length == 1)
        at = np.minimum(np.searchsorted(self.single_codes, codes[begin[alone]]), len(self.single_codes) - 1)
        piece[alone] = np.where(self.single_codes[at] == codes[begin[alone]], self.single_ids[at], -1)
        strange = np.flatnonzero(piece < 0)
        other = [[self.byte[x] for x in chr(codes[begin[i]]).encode("utf-8", "replace")] for i in strange.tolist()]
        count = np.ones(len(piece), np.int64)
        count[strange] = [len(o) for o in other]
        ids = np.repeat(piece, count)
        if len(strange):
            ids[ragged((np.cumsum(count) - count)[strange], count[strange])] = np.concatenate(other)
        flat = ids.astype("<u4").tobytes()
        ends = (np.cumsum(np.bincount(owner, count, len(chunks))).astype(np.int64) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _relax(self, edge: np.ndarray, cut: np.ndarray, at: np.ndarray, owner: np.ndarray, chunks: int) -> None:
        """Take edges in all chunks at once, one per chunk and round, until none is left anywhere."""
        price = np.append(self.price, np.inf)
        length = np.ones(len(at), np.int64)
        while len(at) > 1:
            total = length[:-1] + length[1:]
            join = (owner[:-1] == owner[1:]) & (total <= self.width)
            cost = np.full(len(at), np.inf)
            cost[:-1][join] = price[edge[at[:-1][join], total[join]]]
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            best = np.minimum.reduceat(cost, first)
            which = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(at))))
            hit = np.flatnonzero((cost == best[which]) & np.isfinite(cost))
            hit = hit[np.unique(which[hit], return_index=True)[1]]  # the leftmost of each chunk
            length[hit] += length[hit + 1]
            cut[at[hit + 1]] = False
            keep = np.isfinite(best)[which]
            keep[hit + 1] = False
            at, owner, length = at[keep], owner[keep], length[keep]

    def _relax_one(self, edge: np.ndarray, cut: np.ndarray, start: int, size: int) -> None:
        """The same for one long chunk: a queue of edges by price and place."""
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        alive, queue = [True] * size, []

        def offer(left: int) -> None:
            right = after[left] if left >= 0 else size
            if left >= 0 and right < size:
                end = after[right]
                piece = int(edge[start + left, end - left]) if end - left <= self.width else -1
                if piece >= 0:
                    heapq.heappush(queue, (self.price[piece], left, right, end))

        for i in range(size - 1):
            offer(i)
        while queue:
            _, left, right, end = heapq.heappop(queue)
            if not (alive[left] and right < size and alive[right] and after[left] == right and after[right] == end):
                continue
            alive[right] = False
            cut[start + right] = False
            after[left] = end
            if end < size:
                before[end] = left
            offer(before[left])
            offer(left)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where those of each text start; a null text has none."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        lists = pc.split_pattern(texts, " ")
        flat = pc.list_flatten(lists)
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(counts)])
        empty = np.concatenate([[0], np.cumsum(np.asarray(pc.equal(pc.binary_length(flat), 0), bool))])
        odd = np.flatnonzero(empty[starts[1:]] > empty[starts[:-1]])
        if len(odd):  # white space in a row, or at an end, makes up other chunks
            parts, runs = [], []
            last = 0
            for i in odd.tolist():
                text = texts[i].as_py()
                own = CHUNK.findall(SPACE + text.replace(" ", SPACE)) if text else []
                parts += [flat.slice(starts[last], starts[i] - starts[last]), pa.array([c[1:] for c in own], pa.large_string())]
                runs.append(len(own))
                last = i + 1
            parts.append(flat.slice(starts[last]))
            flat = pa.concat_arrays(parts)
            counts[odd] = runs
            starts = np.concatenate([[0], np.cumsum(counts)])
        coded = flat.dictionary_encode()
        chunks = coded.dictionary.to_pylist()
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        blobs = list(map(known.get, chunks))
        missing = [i for i, b in enumerate(blobs) if b is None]
        for i in missing:
            again = older.get(chunks[i])
            if again is not None:
                known[chunks[i]] = blobs[i] = again
        new = [i for i in missing if blobs[i] is None]
        if new:
            for i, b in zip(new, self._learn([SPACE + chunks[i] for i in new]), strict=True):
                known[chunks[i]] = blobs[i] = b
        each = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        pool = np.frombuffer(b"".join(blobs), "<u4")
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        of_chunk = each[codes]
        return pool[ragged((np.cumsum(each) - each)[codes], of_chunk)], np.concatenate([[0], np.cumsum(of_chunk)])[starts]

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> list[str]:
        """The texts of runs of ids; bytes that are no UTF-8 become U+FFFD."""
        length = self.raw_length[ids]
        flat = self.raw[ragged(self.raw_start[ids], length)].tobytes()
        ends = np.concatenate([[0], np.cumsum(length)])[starts].tolist()
        return [flat[a:b].decode("utf-8", "replace").removeprefix(" ") for a, b in zip(ends[:-1], ends[1:], strict=True)]


_MODELS: dict[str, Pieces] = {}


def _model(path: str) -> Pieces:
    """One model per worker and path."""
    return _MODELS.get(path) or _MODELS.setdefault(path, Pieces(path))


def encoder(path: str) -> Column:
    """A function of a text column: its ids, little-endian unsigned 32-bit numbers in one binary value.

    Null and empty texts have no ids.
    """

    @F.arrow_udf("binary")
    def encode(texts: pa.Array) -> pa.Array:
        out: list[bytes] = []
        for part in slices(pa.record_batch([texts], ["text"]), "text", TEXT_BYTES):
            ids, starts = _model(path).encode(part.column(0))
            flat, edges = ids.astype("<u4").tobytes(), (starts * 4).tolist()
            out += [flat[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return pa.array(out, pa.binary())

    return encode


def decoder(path: str) -> Column:
    """A function of such ids: their text; null has an empty one."""

    @F.arrow_udf("string")
    def decode(blobs: pa.Array) -> pa.Array:
        out: list[str] = []
        for part in slices(pa.record_batch([pc.fill_null(blobs, b"")], ["ids"]), "ids", TEXT_BYTES):
            blob = part.column(0)
            starts = np.concatenate([[0], np.cumsum(pc.binary_length(blob).to_numpy(zero_copy_only=False).astype(np.int64) // 4)])
            out += _model(path).decode(np.frombuffer(b"".join(blob.to_pylist()), "<u4").astype(np.int64), starts)
        return pa.array(out, pa.string())

    return decode


def with_ids(docs: DataFrame, path: str, text: str = "text", into: str = "ids") -> DataFrame:
    """All rows and columns, and the ids of the whole text; a column named ``into`` is replaced."""
    return docs.withColumn(into, encoder(path)(F.col(f"`{text}`").cast("string")))


def with_text(docs: DataFrame, path: str, ids: str = "ids", into: str = "text") -> DataFrame:
    """All rows and columns, and the text of the ids; a column named ``into`` is replaced."""
    return docs.withColumn(into, decoder(path)(F.col(f"`{ids}`")))
