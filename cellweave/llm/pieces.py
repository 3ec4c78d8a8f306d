"""SentencePiece encoding and decoding by suffix-array matching.

A batch's segments that are not known yet are concatenated and indexed by a suffix array (to the
depth of the longest piece); every piece of the vocabulary is looked up by binary search, and its
occurrence range gives edges (position, length, piece), which are put in order of position. The
model at hand is a BPE model, for which a best-path relaxation over edge scores would give other
results than the library; here the edges are relaxed in order of merge rank instead: in each round
every segment joins the adjacent pair whose edge has the best score, the leftmost at a tie.
Characters without a piece become byte pieces. Results equal the library's.

Segments begin at the first of a run of spaces; no piece of the vocabulary reaches across such a
point (checked when the model is read; otherwise whole texts are segments). Null and empty texts
have no pieces; repeated rows repeat; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.shingles import runs_of

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Longer segments are relaxed one by one with a heap.
LONG = 48
#: Segments in the cache, and their characters together; the cache before it holds as many.
CACHE_ENTRIES, CACHE_CHARACTERS = 400_000, 8_000_000
_BIG = np.int64(1 << 62)


def read_model(spark: SparkSession, path: str | None = None):
    """The vocabulary, read by the driver and sent to the executors: (piece, score, kind) with kind p, b (byte) or other."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: "b" if m.is_byte(i) else "o" if m.is_control(i) or m.is_unknown(i) else "p"
    return spark.sparkContext.broadcast([(m.id_to_piece(i), m.get_score(i), kind(i)) for i in range(m.get_piece_size())])


class PieceEncoder:
    """Encodes texts to ids as little-endian unsigned 32-bit bytes, and back."""

    def __init__(self, vocabulary: list[tuple[str, float, str]]):
        self.size = len(vocabulary)
        self.pieces = [(p, i) for i, (p, _, kind) in enumerate(vocabulary) if kind == "p"]
        self.depth = max(len(p) for p, _ in self.pieces)
        scores = np.array([s if kind == "p" else -np.inf for _, s, kind in vocabulary])
        _, place = np.unique(-scores, return_inverse=True)
        self.rank = place.astype(np.int64)
        self.byte = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(vocabulary) if kind == "b"}
        self.spelled = [bytes([int(p[3:5], 16)]) if kind == "b" else p.replace(SPACE, " ").encode() if kind == "p" else b"" for p, _, kind in vocabulary]
        self.splits = not any(SPACE in p.lstrip(SPACE) for p, _ in self.pieces)
        self.codes = np.zeros((len(self.pieces), self.depth), dtype=np.uint32)
        for k, (p, _) in enumerate(self.pieces):
            self.codes[k, : len(p)] = [ord(c) + 1 for c in p]  # 0 separates segments
        self.lengths = np.array([len(p) for p, _ in self.pieces])
        self.ids = np.array([i for _, i in self.pieces])
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    # -- segments

    def segments(self, text: str) -> list[str]:
        if not text:
            return []
        if not self.splits:
            return [SPACE + text.replace(" ", SPACE)]
        if SPACE not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            return [SPACE + w for w in text.split(" ")]
        return re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text.replace(" ", SPACE))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        parts = [self.segments(t or "") for t in texts]
        fresh = list(dict.fromkeys(s for p in parts for s in p if s not in self.cache))
        if len(self.cache) + len(fresh) > CACHE_ENTRIES or self.held > CACHE_CHARACTERS:
            self.older, self.cache, self.held = self.cache, {}, 0
            fresh = list(dict.fromkeys(s for p in parts for s in p))
        missing = []
        self.held += sum(map(len, fresh))
        for s in fresh:
            if (known := self.older.get(s)) is not None:
                self.cache[s] = known
            else:
                missing.append(s)
        for lo, hi in runs_of([len(s) + 1 for s in missing], 1 << 20):
            self.cache.update(zip(missing[lo:hi], self.match(missing[lo:hi]), strict=True))
        return [b"".join(map(self.cache.__getitem__, p)) for p in parts]

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.spelled.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")

    # -- suffix array, edges, relaxation

    def edges(self, data: np.ndarray) -> np.ndarray:
        """``table[length - 1, position]``: the id of the piece of that length that occurs at that position, or -1."""
        alphabet = np.unique(data)
        dense = np.searchsorted(alphabet, data).astype(np.uint64)  # 0 is the separator: it sorts first and no piece has it
        bits = max(1, int(len(alphabet)).bit_length())
        per = 64 // bits
        n, words = len(data), -(-self.depth // (64 // bits))
        padded = np.concatenate([dense, np.zeros(words * per, dtype=np.uint64)])

        def pack(column) -> list[np.ndarray]:
            out = []
            for w in range(words):
                acc = np.zeros(len(column(0)), dtype=np.uint64)
                for k in range(w * per, (w + 1) * per):
                    acc = (acc << np.uint64(bits)) | column(k)
                out.append(acc)
            return out

        suffix = pack(lambda k: padded[k : k + n])
        array = np.lexsort(suffix[::-1])
        suffix = [w[array] for w in suffix]
        at = np.minimum(np.searchsorted(alphabet, self.codes), len(alphabet) - 1)
        used = np.arange(self.depth) < self.lengths[:, None]
        usable = ((alphabet[at] == self.codes) | ~used).all(axis=1)
        at, used, lengths, ids = at[usable], used[usable], self.lengths[usable], self.ids[usable]
        low, high = np.where(used, at, 0).astype(np.uint64), np.where(used, at, (1 << bits) - 1).astype(np.uint64)
        edge = lambda m, fill: pack(lambda k: m[:, k] if k < self.depth else np.full(len(m), fill, dtype=np.uint64))

        def bound(key: list[np.ndarray], right: bool) -> np.ndarray:
            lo, hi = np.zeros(len(key[0]), dtype=np.int64), np.full(len(key[0]), n, dtype=np.int64)
            while (lo < hi).any():
                mid = np.minimum((lo + hi) // 2, n - 1)
                less, same = np.zeros(len(lo), dtype=bool), np.ones(len(lo), dtype=bool)
                for s, k in zip(suffix, key, strict=True):
                    v = s[mid]
                    less |= same & (v < k)
                    same &= v == k
                below, open_ = less | (same if right else False), lo < hi
                lo, hi = np.where(open_ & below, mid + 1, lo), np.where(open_ & ~below, mid, hi)
            return lo

        first, last = bound(edge(low, 0), False), bound(edge(high, (1 << bits) - 1), True)
        table = np.full((self.depth, n), -1, dtype=np.int32)
        count = last - first
        of = np.repeat(np.arange(len(count)), count)
        position = array[np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)]
        table[lengths[of] - 1, position] = ids[of]
        return table

    def match(self, segments: list[str]) -> list[bytes]:
        text = "\0".join(segments) + "\0"
        data = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        # A NUL inside a segment must not look like a separator.
        size = np.array([len(s) for s in segments])
        begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
        data = data + np.uint32(1)
        data[begin + size] = 0
        table = self.edges(data)
        table[:, begin + size] = -1
        rank = np.append(self.rank, _BIG)
        length = np.ones(len(data), dtype=np.int64)
        live = np.ones(len(data), dtype=bool)
        live[begin + size] = False
        for k in np.flatnonzero(size > LONG).tolist():
            self._heap(table, rank, int(begin[k]), int(size[k]), length, live)
        active = np.flatnonzero((size > 1) & (size <= LONG))
        symbols = np.flatnonzero(live & np.repeat((size > 1) & (size <= LONG), size + 1)) if len(active) else np.empty(0, dtype=np.int64)
        owner = np.repeat(np.arange(len(segments)), size + 1)
        while len(symbols):
            of = owner[symbols]
            pair = np.append(of[1:] == of[:-1], False)
            following = np.append(symbols[1:], symbols[-1:])
            span = length[symbols] + length[following]
            fits = pair & (span <= self.depth)
            found = np.where(fits, table[np.minimum(span, self.depth) - 1, symbols], -1)
            key = np.where(found >= 0, rank[found] * (1 << 32) + np.arange(len(symbols)), _BIG)
            heads = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            best = np.minimum.reduceat(key, heads)
            joined = best < _BIG
            at = (best[joined] & 0xFFFFFFFF).astype(np.int64)
            length[symbols[at]] = span[at]
            live[symbols[at + 1]] = False
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            keep &= np.repeat(joined, np.diff(np.append(heads, len(symbols))))
            symbols = symbols[keep]
        final = np.flatnonzero(live)
        ids = table[length[final] - 1, final].astype(np.int64)
        cut = np.searchsorted(final, np.append(begin, len(data)))
        raw = ids.astype("<u4").tobytes()
        bare = set(np.repeat(np.arange(len(segments)), np.diff(cut))[ids < 0].tolist())
        out = []
        for k in range(len(segments)):
            lo, hi = int(cut[k]), int(cut[k + 1])
            if k not in bare:
                out.append(raw[4 * lo : 4 * hi])
                continue
            some: list[int] = []
            for i, at in zip(ids[lo:hi].tolist(), final[lo:hi].tolist(), strict=True):
                some += [i] if i >= 0 else [self.byte[b] for b in text[at].encode("utf-8", "replace")]
            out.append(np.array(some, dtype="<u4").tobytes())
        return out

    def _heap(self, table: np.ndarray, rank: np.ndarray, begin: int, size: int, length: np.ndarray, live: np.ndarray) -> None:
        """The same relaxation for one long segment."""
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        sizes, gone = [1] * size, [False] * size
        rows = table[:, begin : begin + size]
        queue: list[tuple[int, int, int]] = []

        def offer(left: int) -> None:
            right = after[left]
            if right < size and sizes[left] + sizes[right] <= self.depth:
                i = int(rows[sizes[left] + sizes[right] - 1, left])
                if i >= 0:
                    heapq.heappush(queue, (int(rank[i]), left, sizes[left] + sizes[right]))

        for k in range(size - 1):
            offer(k)
        while queue:
            _, left, span = heapq.heappop(queue)
            if gone[left] or after[left] >= size or sizes[left] + sizes[after[left]] != span:
                continue
            right = after[left]
            gone[right] = True
            sizes[left] = span
            after[left] = after[right]
            if after[left] < size:
                before[after[left]] = left
            offer(left)
            if before[left] >= 0:
                offer(before[left])
        length[begin : begin + size] = sizes
        live[begin : begin + size] = ~np.array(gone)


_made: dict = {}


def _encoder(vocabulary: list[tuple[str, float, str]]) -> PieceEncoder:
    """One encoder for each Python worker and vocabulary."""
    key = hash(tuple(vocabulary))
    if key not in _made:
        _made.clear()
        _made[key] = PieceEncoder(vocabulary)
    return _made[key]


def encode_pieces(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, restored[, ids]): per row; ``restored`` says that decoding the ids gives the text again."""
    sent = read_model(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _encoder(sent.value)
        for batch in batches:
            column = batch.column("text")
            sizes = [len(t.as_buffer()) if t.is_valid else 0 for t in column]
            for lo, hi in runs_of(sizes, 4 << 20):
                texts = column.slice(lo, hi - lo).to_pylist()
                ids = model.encode(texts)
                arrays = [batch.column("doc_id").slice(lo, hi - lo), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([zlib.crc32(i) for i in ids], pa.int64()), pa.array([model.decode(i) == (t or "") for i, t in zip(ids, texts, strict=True)], pa.bool_())]
                if with_ids:
                    arrays.append(pa.array([np.frombuffer(i, dtype="<u4").astype(np.int32) for i in ids], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_pieces", "ids_crc32", "restored", "ids"][: len(arrays)])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_pieces long, ids_crc32 long, restored boolean" + ", ids array<int>" * with_ids)


def decode_pieces(rows: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of ``rows(doc_id, ids)``; null ids give null text."""
    sent = read_model(rows.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _encoder(sent.value)
        for batch in batches:
            texts = [None if i is None else model.decode(np.array(i, dtype="<u4").tobytes()) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")
