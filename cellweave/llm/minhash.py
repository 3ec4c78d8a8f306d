"""Near-duplicates by min-max hashing.

Every permutation gives two signature values, the least and the greatest hash of a set, so half as
many permutations are evaluated; bands of ``rows`` values make candidate buckets. The number of
bands follows from the threshold, so that a pair at the threshold is missed with a probability
under ``miss``. The work then never expands a group into pairs:

1. Equal sets are one class, found by a digest; only class representatives go on.
2. In every bucket each member is compared, on full shingle sets, with one member alone (a star):
   the one that meets most others over all bands. Components of the confirmed links follow.
3. Members of a star that are not in its largest component are compared with the rest of the star,
   in blocks whose number grows with the root of the star; a block returns links between components,
   never pairs, so nothing that grows with the square of a group is written.

Links join exactly the pairs with ``100 * |A & B| >= percent * |A | B|`` among candidates. Texts
travel compressed to the comparison and are shingled there again, as hashes do not compress.

Null or blank texts have empty sets and link with nothing. Rows with a null ``doc_id`` come back with
a null component and ``kept`` true, and link nothing. Rows that repeat an id are one document: it has
the links of all its texts, and its rows one component. An empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.linking import components_of_buckets, documents, same_ids
from cellweave.llm.shingles import mix, runs_of, shingle_sets
from cellweave.storage import materialise

SHINGLE, PERCENT, ROWS, MISS = 5, 80, 6, 3e-7
_CACHED = 1 << 16


def bands_for(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands with which a pair at the threshold shares no bucket with a probability under ``miss``."""
    return math.ceil(math.log(miss) / math.log1p(-((percent / 100) ** rows)))


def _constants(n: int) -> list[tuple[np.uint32, np.uint32]]:
    rng = np.random.default_rng(7919)
    return [(np.uint32(a | 1), np.uint32(b | 1)) for a, b in rng.integers(0, 1 << 32, (n, 2), dtype=np.uint32)]


def min_max(keys: np.ndarray, offsets: np.ndarray, permutations: int) -> np.ndarray:
    """Signatures (documents x 2 * permutations) of non-empty sets: minima and maxima in turn."""
    x = (keys ^ (keys >> np.uint64(32))).astype(np.uint32)
    out = np.empty((len(offsets) - 1, 2 * permutations), dtype=np.uint32)
    constants = _constants(permutations)
    # Blocks of sets that fit the processor's cache together.
    begin = 0
    while begin < len(offsets) - 1:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + _CACHED, side="right")) - 1)
        part, starts = x[offsets[begin] : offsets[end]], offsets[begin:end] - offsets[begin]
        for k, (a, b) in enumerate(constants):
            h = part * a
            h ^= h >> np.uint32(15)
            h *= b
            out[begin:end, 2 * k] = np.minimum.reduceat(h, starts)
            out[begin:end, 2 * k + 1] = np.maximum.reduceat(h, starts)
        begin = end
    return out


def signatures(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, digest, bands): per document; digest and bands are null for empty sets."""
    permutations = math.ceil(bands * rows / 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo, hi in runs_of(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
                keys, offsets = shingle_sets([texts[k].as_py() or b"" for k in range(lo, hi)], shingle)
                size = np.diff(offsets)
                full = np.flatnonzero(size)
                where = np.concatenate([offsets[full], offsets[-1:]])
                n = len(full)
                if n:
                    twice = [np.add.reduceat(mix(keys + np.uint64(salt)), where[:-1]) for salt in (0x51ED, 0xA24B)]
                    digest = [t.tobytes() + s.tobytes() for t, s in zip(*twice, strict=True)]
                    sig = min_max(keys, where, permutations)[:, : bands * rows]
                    # A band takes values of different permutations, so its values are independent.
                    order = np.argsort(np.arange(bands * rows) % 2, kind="stable")
                    wide = sig[:, order].reshape(n, bands, rows).astype(np.uint64)
                    code = np.full((n, bands), 17, dtype=np.uint64) + np.arange(bands, dtype=np.uint64)
                    for r in range(rows):
                        code = mix(code * np.uint64(0xD6E8FEB86659FD93) + wide[:, :, r])
                none = [None] * (hi - lo)
                digests, codes = none[:], none[:]
                for j, k in enumerate(full.tolist()):
                    digests[k], codes[k] = digest[j], code[j].view(np.int64)
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(size, pa.int64()), pa.array(digests, pa.binary()), pa.array(codes, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "digest", "bands"])

    rows_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows_.mapInArrow(run, "doc_id long, n_shingles long, digest binary, bands array<long>")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, rows: int = ROWS, miss: float = MISS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs(doc_id, text)``."""
    bands = bands_for(percent, rows, miss)
    signed = materialise(signatures(docs, shingle, bands, rows), "signatures")
    classes = materialise(signed.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands")), "classes")
    banded = classes.select("rep", F.posexplode("bands").alias("band", "code"))
    counts = banded.groupBy("band", "code").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    members = materialise(banded.join(counts, ["band", "code"]), "members")

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack.compress(t.as_py() or b"") for t in batch.column(1)], pa.binary())], names=["doc_id", "packed"])

    def pack(ids: DataFrame) -> DataFrame:
        wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).join(ids, "doc_id", "left_semi")
        return wanted.mapInArrow(shrink, "doc_id long, packed binary")

    found = components_of_buckets(members, pack, same_ids(signed, classes), partial(shingle_sets, size=shingle), percent)
    return documents(signed, classes, found, "n_shingles")
