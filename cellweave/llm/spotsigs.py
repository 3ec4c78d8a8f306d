"""SpotSigs fingerprints: chains of content words that follow common-word anchors.

A signature is an anchor with the next ``CHAIN`` content words after it; a fingerprint is the set of
a text's signatures, as 32-bit hashes in ascending order (hex digits, 8 a signature). Anchors are
frequent function words of several languages and, so that texts without them have fingerprints too,
one of every ``RARE`` words by its hash. Where a text has fewer than ``ENOUGH`` distinct chains, a
sample of its letter grams makes up for what they lack: grams are taken by their hash, in the share of
the lack in the number of grams, so that the features change gradually with the text, and texts
that are nearly equal sample nearly the same grams. Likeness is the Jaccard similarity of two fingerprints.

:func:`neighbour_fingerprints` gives each row's likeness to two given texts. :func:`near_duplicates` finds
all similar documents: fingerprints are dealt to partitions by set size, of which only neighbours can
hold similar sets; in a partition an index of signatures lists every fingerprint under its rarest
signatures, as many as two similar sets cannot all miss; the members of a list are compared whole, but
for pairs whose sizes rule the similarity out. The search loses no pair.

Null and empty texts have empty fingerprints; the likeness of two empty ones is 1 (equal texts), of
one empty one 0; in the search they link with nothing. Rows with a null ``doc_id`` sort first, and link
nothing in the search. Repeated ids sort by their compressed texts; in the search they are one document.
An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.llm.linking import components_of_buckets, documents, same_ids
from cellweave.llm.shingles import mix, runs_of, word_hashes
from cellweave.storage import materialise

CHAIN, RARE, ENOUGH, GRAM, PERCENT = 2, 8, 200, 4, 80
_rng = np.random.default_rng(20260301)
_GRAM = _rng.integers(1, 1 << 63, GRAM, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Function words of English, German, French and Spanish.
ANCHORS = frozenset(
    "the a an of to and in is was be for on that it with as at by this from or are not "
    "der die das und ist von zu den mit im des dem auf für nicht ein eine als auch sich "
    "le la les de des du et un une est en que qui dans pour au sur par pas avec "
    "el los las y del que en una por con no para se su al lo como más".split()
)
_DROP = bytes(c for c in range(33, 128) if not chr(c).isalnum())
#: Hashes of the anchors.
_ANCHORS = np.sort(word_hashes([w.encode() for w in sorted(ANCHORS)])[0])


def _words(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass").translate(None, _DROP)


def _grams(texts: list[str], owner: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Keys (owner, code) of about ``most`` distinct letter grams of each text, or of all if they are fewer."""
    letters = ["".join(t.lower().split()) for t in texts]
    data = np.frombuffer("".join(x + "\0" * GRAM for x in letters).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    size = np.array([len(x) for x in letters])
    count = np.maximum(size - GRAM + 1, 1)
    of = np.repeat(np.arange(len(texts)), count)
    at = np.arange(len(of)) + np.repeat(np.cumsum(size + GRAM) - (size + GRAM) - (np.cumsum(count) - count), count)
    codes = np.zeros(len(at), dtype=np.uint64)
    for k in range(GRAM):
        codes += data[at + k] * _GRAM[k]
    codes = mix(codes)
    # The upper half of a hash is its code, the lower half decides whether it is taken.
    order = np.lexsort((codes, of))
    codes, of = codes[order], of[order]
    fresh = np.ones(len(codes), dtype=bool)
    fresh[1:] = (codes[1:] != codes[:-1]) | (of[1:] != of[:-1])
    codes, of = codes[fresh], of[fresh]
    share = most / np.bincount(of, minlength=len(texts))
    taken = (codes & np.uint64(0xFFFFFFFF)).astype(np.float64) < share[of] * 2.0**32
    return (owner[of[taken]].astype(np.uint64) << np.uint64(32)) | (codes[taken] >> np.uint64(32))


def fingerprints(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct 32-bit signature hashes of each text."""
    words, owner = word_hashes([_words(t) for t in texts])
    at = np.minimum(np.searchsorted(_ANCHORS, words), len(_ANCHORS) - 1)
    spots = (_ANCHORS[at] == words) | (words % np.uint64(RARE) == 0)
    content, content_owner = words[~spots], owner[~spots]
    follow = np.cumsum(~spots)[spots]  # the index of the first content word after each anchor
    last = follow + CHAIN - 1
    whole = last < len(content)
    whole[whole] = content_owner[last[whole]] == owner[spots][whole]
    follow, of, codes = follow[whole], owner[spots][whole], words[spots][whole]
    for k in range(CHAIN):
        codes = mix(codes * np.uint64(0xD6E8FEB86659FD93) + content[follow + k])
    keys = np.unique((of.astype(np.uint64) << np.uint64(32)) | (codes >> np.uint64(32)))
    lack = ENOUGH - np.bincount((keys >> np.uint64(32)).astype(np.int64), minlength=len(texts))
    poor = [k for k, text in enumerate(texts) if text and lack[k] > 0]
    if poor:
        keys = np.unique(np.concatenate([keys, _grams([texts[k] for k in poor], np.array(poor), lack[poor])]))
    cuts = np.searchsorted(keys, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(32))
    codes = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return [codes[x:y] for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def encode(codes: np.ndarray) -> str:
    return codes.astype(">u4").tobytes().hex()


def decode(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), dtype=">u4").astype(np.uint32)


def jaccard(x: np.ndarray, y: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity; 0 without intersecting when the sizes alone rule out ``least``."""
    small, large = sorted((len(x), len(y)))
    if not large:
        return 1.0
    if not small or small < least * large:
        return 0.0
    at = np.searchsorted(x, y)
    both = int(np.count_nonzero(x[np.minimum(at, len(x) - 1)] == y))
    return both / (len(x) + len(y) - both)


def size_partition(n: int, least: float) -> int:
    """Sets of similarity ``least`` or more lie in the same or neighbouring partitions of set sizes."""
    return int(np.floor(np.log(max(n, 1)) / partition_width(least)))


def partition_width(least: float) -> float:
    """Width of a partition of logarithmic sizes, with room for rounding."""
    return -math.log(least) * (1 + 1e-9) + 1e-9


def _spots(docs: DataFrame) -> DataFrame:
    """(doc_id, n_signatures, digest, codes) per document; digest is null for empty fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.columns
            for lo, hi in runs_of(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
                found = fingerprints([t or "" for t in texts.slice(lo, hi - lo).to_pylist()])
                digest = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in found]
                columns = [ids.slice(lo, hi - lo), pa.array([len(x) for x in found], pa.int64()), pa.array(digest, pa.binary()), pa.array([x.view(np.int32) for x in found], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_signatures", "digest", "codes"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_signatures long, digest binary, codes array<int>")


def _sets(contents: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints one after another, and their offsets."""
    return np.frombuffer(b"".join(contents), dtype="<u4").astype(np.uint64), np.cumsum([0] + [len(x) // 4 for x in contents])


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_signatures, component_id, kept) for every row of ``docs(doc_id, text)``: documents link with a likeness of at least ``percent`` / 100.

    Equal fingerprints are one class, of which one goes on. Two sets of n signatures and more that link
    have at least ``percent * n / 100`` in common, so they share one of the n - that + 1 rarest. Signatures
    of one class only are the rarest and in no list, so most classes are listed nowhere.
    """
    signed = materialise(_spots(docs), "spots")
    classes = materialise(signed.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min_by("codes", "doc_id").alias("codes")), "classes")
    spots = classes.select("digest", "rep", F.size("codes").alias("n"), F.explode("codes").alias("code"))
    lists = spots.groupBy("code").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    of_class = Window.partitionBy("digest")
    ranked = spots.join(lists, "code").select("*", F.row_number().over(of_class.orderBy("held", "code")).alias("k"), F.count(F.lit(1)).over(of_class).alias("listed"))
    listed = ranked.where(f"k <= listed + 1 - ({percent} * n + 99) div 100")
    part = F.floor(F.log("n") / F.lit(partition_width(percent / 100))).cast("int")
    dealt = listed.select("rep", "code", F.explode(F.array(part, part + 1)).alias("band"))
    counts = dealt.groupBy("band", "code").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    members = materialise(dealt.join(counts, ["band", "code"]), "members")

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            packed = [squeeze.compress(np.asarray(x.values, dtype="<i4").tobytes()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["doc_id", "packed"])

    def pack(ids: DataFrame) -> DataFrame:
        return classes.select(F.col("rep").alias("doc_id"), "codes").join(ids, "doc_id", "left_semi").mapInArrow(shrink, "doc_id long, packed binary")

    found = components_of_buckets(members, pack, same_ids(signed, classes), _sets, percent)
    return documents(signed, classes, found, "n_signatures")


def edited(text: str, following: str) -> str:
    """The last third of ``text`` replaced by the beginning of ``following``."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def neighbour_fingerprints(docs: DataFrame) -> DataFrame:
    """Per row: fingerprints of the text and of its edited text, and likeness to it and to the next document (descending ids).

    Rows are dealt out by id ranges whose bounds are quantiles of the ids; the last row before each
    range (one per range) is sent to it as well, so a row's neighbour is always in the same task.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    fractions = [k / n for k in range(1, n)]
    first = rows.select("doc_id").agg(F.percentile_approx("doc_id", F.array(*map(F.lit, fractions)), 20 * n).alias("q"), F.max("doc_id").alias("last")).first()
    bounds = np.unique(np.array(first["q"] or [], dtype=np.int64))

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).drop_null().to_numpy(zero_copy_only=False)
            of = np.searchsorted(bounds, ids, side="right")
            if len(ids):
                order = np.lexsort((ids, of))
                ends = np.flatnonzero(np.diff(np.concatenate([of[order], [-1]])))
                yield pa.RecordBatch.from_arrays([pa.array(of[order][ends].astype(np.int64)), pa.array(ids[order][ends])], names=["r", "top"])

    tops = {r["r"]: r["top"] for r in rows.select("doc_id").mapInArrow(ranges, "r long, top long").groupBy("r").agg(F.max("top").alias("top")).collect()}
    has_null = not rows.where("doc_id IS NULL").select("doc_id").isEmpty()
    # Range -1 holds rows without an id; the row before a range is the largest below it, before the first the largest of all.
    starts = sorted([*tops, *([-1] if has_null else [])])
    last_of = {r: tops.get(r) for r in starts}
    ghost_of: dict = {}
    for k, r in enumerate(starts):
        ghost_of.setdefault(last_of[starts[k - 1]], []).append(r)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = text.as_py()
                packed = squeeze.compress((raw or "").encode("utf-8", "surrogatepass"))
                own = -1 if doc_id is None else int(np.searchsorted(bounds, doc_id, side="right"))
                out.append((own, True, doc_id, packed))
                out += [(r, False, doc_id, packed) for r in ghost_of.get(doc_id, ())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.bool_(), pa.int64(), pa.binary()), strict=True)] if out else [pa.array([], t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.binary())], names=["r", "own", "doc_id", "packed"])

    dealt = rows.mapInArrow(deal, "r long, own boolean, doc_id long, packed binary").repartition(max(1, n // 4), "r").sortWithinPartitions("r", "own", "doc_id", "packed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = zstandard.ZstdDecompressor()
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_signatures"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
        at, next_text, next_codes = None, "", np.empty(0, dtype=np.uint32)
        for batch in batches:
            packed = batch.column("packed")
            for lo, hi in runs_of([3 * len(p) for p in packed.to_pylist()]):
                part, out = batch.slice(lo, hi - lo), []
                texts = [opened.decompress(p).decode("utf-8", "surrogatepass") for p in packed.slice(lo, hi - lo).to_pylist()]
                changed = [edited(t, n) for t, n in zip(texts, [next_text, *texts], strict=False)]
                found, theirs = fingerprints(texts), fingerprints(changed)
                for r, own, doc_id, text, new, codes, others in zip(*(part.column(k).to_pylist() for k in range(3)), texts, changed, found, theirs, strict=True):
                    if own:
                        if at != r:
                            raise ValueError("a range has no row before it")
                        sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
                        out.append((doc_id, len(text), sha, encode(codes), encode(others), jaccard(codes, others), jaccard(codes, next_codes), len(codes)))
                    at, next_codes = r, codes
                next_text = texts[-1]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_signatures long")
