"""Byte-level BPE ids of whole texts, by the tokenizers library."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import SparkSession

TOKENIZER = "byte_bpe_50k.json"
#: So many encoded chunks are held in the cache, and as many in the one before it.
CACHE_ENTRIES = 500_000
#: Both caches turn over as well when their chunks have so many characters.
CACHE_CHARACTERS = 16_000_000
#: How the vocabulary spells the byte of a space.
SPACE_BYTE = "Ġ"
#: After a letter or digit, a run of these at a chunk's end is always a pre-token of its own.
TAIL = ".,;:!?%$#&*)"

#: Texts of a column are split and looked up together up to so many bytes.
BLOCK = 8 << 20

_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_run = re.compile(f" [{_SPACE}]")
_cut = re.compile(f" (?=[^{_SPACE}])")
_made: dict = {}


class ChunkEncoder:
    """Ids of a text as little-endian unsigned 32-bit bytes.

    The vocabulary's pre-tokenizer never joins what stands before a space with what follows it if
    the next character is not white space. So a text may be cut there, and each distinct chunk is
    encoded once by the library and then looked up.
    """

    def __init__(self, vocabulary: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.encode_special_tokens = True
        names = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(names.values()) + 1, dtype=bool)
        self.opens[[i for name, i in names.items() if name.startswith(SPACE_BYTE)]] = True
        self.blank = self._ids(" ")
        self.cache: dict[str, bytes] = {"": self.blank}
        self.older: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.held = 0

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()

    def _learn(self, words: set[str]) -> None:
        """Put the ids of " " + word into the cache, for all words by one call of the library where none has a space."""
        cache, older = self.cache, self.older
        if len(cache) + len(words) > CACHE_ENTRIES or self.held > CACHE_CHARACTERS:
            self.older, self.cache, self.held = cache, {"": self.blank}, 0
            cache, older = self.cache, self.older
        self.held += sum(map(len, words))
        fresh, tailed = set(), []
        for w in words:
            if (known := older.get(w)) is not None:
                cache[w] = known
                continue
            core = w.rstrip(TAIL)
            if " " in w:
                cache[w] = self._ids(" " + w)
            elif core is not w and core and core[-1].isalnum():
                tailed.append((w, core))
                if core not in cache:
                    fresh.add(core)
            else:
                fresh.add(w)
        self._encode(list(fresh))
        for w, core in tailed:
            tail = w[len(core) :]
            if (last := self.tails.get(tail)) is None:
                last = self._ids(tail)
                if len(self.tails) < CACHE_ENTRIES and len(tail) <= 64:
                    self.tails[tail] = last
            cache[w] = cache[core] + last

    def _encode(self, fresh: list[str]) -> None:
        cache = self.cache
        if not fresh:
            return
        ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(fresh)], add_special_tokens=False)[0].ids, dtype="<u4")
        cuts = np.flatnonzero(self.opens[ids])
        if len(cuts) != len(fresh):
            for w in fresh:
                cache[w] = self._ids(" " + w)
            return
        raw, ends = ids.tobytes(), [*(cuts[1:] * 4).tolist(), len(ids) * 4]
        at = 0
        for w, end in zip(fresh, ends, strict=True):
            cache[w] = raw[at:end]
            at = end

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        words = _cut.split(text) if _run.search(text) else text.split(" ")
        head = self._ids(words[0]) if words[0] else b""
        del words[0]
        return head + b"".join(self._known(words))

    def _known(self, words: list[str]) -> list[bytes]:
        """Ids of " " + word for each word."""
        found = list(map(self.cache.get, words))
        missing = [k for k, known in enumerate(found) if known is None]
        if missing:
            self._learn({words[k] for k in missing})
            cache = self.cache
            for k in missing:
                found[k] = cache[words[k]]
        return found

    def encode_all(self, texts: pa.Array) -> Iterator[bytes | memoryview]:
        """What :meth:`encode` gives for each text; a word that recurs in a block of texts is looked up once for all of them."""
        texts = texts.fill_null("")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(texts):
            last = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, side="right")))
            yield from self._block(texts.slice(at, last - at))
            at = last

    def _block(self, texts: pa.Array) -> Iterator[bytes | memoryview]:
        runs = pc.match_substring_regex(texts, _run.pattern)
        odd = runs.to_numpy(zero_copy_only=False)
        split = pc.split_pattern(pc.if_else(runs, "", texts), " ")
        starts, flat = split.offsets.to_numpy(), split.flatten()
        inner = np.ones(len(flat), dtype=bool)
        inner[starts[:-1]] = False
        words, heads = flat.filter(pa.array(inner)).dictionary_encode(), flat.take(pa.array(starts[:-1])).dictionary_encode()
        codes = np.empty(len(flat), dtype=np.int32)
        codes[inner] = words.indices.to_numpy()
        codes[~inner] = heads.indices.to_numpy() + len(words.dictionary)
        firsts = self.tokenizer.encode_batch_fast(heads.dictionary.to_pylist(), add_special_tokens=False)
        known = self._known(words.dictionary.to_numpy(zero_copy_only=False).tolist()) + [np.array(e.ids, dtype="<u4").tobytes() for e in firsts]
        ids = pa.array(known, pa.large_binary()).take(pa.array(codes))
        _, begins, data = ids.buffers()
        bounds = np.frombuffer(begins, dtype=np.int64)[starts].tolist()
        raw = memoryview(data or b"")
        for k in range(len(texts)):
            yield self.encode(texts[k].as_py()) if odd[k] else raw[bounds[k] : bounds[k + 1]]


def vocabulary(spark: SparkSession, path: str | None = None) -> Broadcast:
    """The vocabulary file's text, read by the driver and sent to the executors; its size does not grow with data."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encoder(vocab: Broadcast) -> ChunkEncoder:
    """One encoder for each Python worker and vocabulary."""
    text = vocab.value
    key = hash(text)
    if key not in _made:
        _made.clear()
        _made[key] = ChunkEncoder(text)
    return _made[key]
