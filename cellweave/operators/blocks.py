"""Graphs as packed neighbour lists, dealt out in blocks of vertices with all lists that a block needs.

A block holds whole lists of its own vertices and of all their neighbours, so whatever depends on two
hops is complete inside one task and needs no further shuffle. Lists travel as compressed arrays of
integers: a list goes once to each block in which it has a neighbour. In a graph whose ids say nothing
of who is linked that is nearly every block, so triangles and sums over two hops are found in tiles: a
task holds the lists of two ranges of vertices and does the edges between them. With k ranges a list
goes to k tasks at most, and k grows with the square root of the number of tasks.
Vertex, hyperedge and graph ids must be integers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from cellweave.storage import materialise

#: Entries of own lists that a block aims at, pairs or list entries packed at once, rows sent at once.
BLOCK, CHUNK, ROWS = 1 << 20, 1 << 20, 1 << 17
#: List entries in a range of vertices of a tile, rows looked up at once, widest span of ids that gets a table.
TILE, GROUP, SPAN = 18 << 20, 32, 1 << 26
_PACKED = "part int, vs binary, gs binary, sizes binary, near binary, n long, qs array<struct<g:long,v:long>>"


def packs(*columns: np.ndarray) -> list[bytes]:
    """Arrays of integers, those that mostly ascend as differences, compressed byte plane by byte plane."""
    codec, out = pa.Codec("zstd", 1), []
    for x in columns:
        x = np.ascontiguousarray(x, dtype="<i8")
        d = np.diff(x, prepend=0)
        mixed = 4 * np.count_nonzero(d < 0) > len(d)
        data = codec.compress(np.ascontiguousarray((x if mixed else d).view("u1").reshape(-1, 8).T).tobytes(), asbytes=True) if len(x) else b""
        out.append((2 * len(x) + int(mixed)).to_bytes(8, "little") + data if len(x) else b"")
    return out


def unpack(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, dtype="i8")
    n, mixed = divmod(int.from_bytes(data[:8], "little"), 2)
    planes = np.frombuffer(pa.Codec("zstd").decompress(data[8:], decompressed_size=8 * n), dtype="u1").reshape(8, n)
    x = np.ascontiguousarray(planes.T).view("<i8").ravel()
    return x if mixed else np.cumsum(x)


def _numbers(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).to_numpy(zero_copy_only=False)


def _mixed(g: np.ndarray, v: np.ndarray) -> np.ndarray:
    """A hash of vertices, not negative."""
    with np.errstate(over="ignore"):
        x = (v.astype("u8") + g.astype("u8") * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(1)).astype("i8")


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype("i8")


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions start .. start + size - 1 of each range, one after another."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


def integral(df: DataFrame, *columns: str) -> bool:
    return all(isinstance(df.schema[c].dataType, IntegralType) for c in columns)


def _distinct(g: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (g, v, w), ascending."""
    if not len(g):
        return g, v, w
    low = [int(x.min()) for x in (g, v, w)]
    bits = [(int(x.max()) - y).bit_length() for x, y in zip((g, v, w), low, strict=True)]
    if sum(bits) < 63:
        key = ((g - low[0] << bits[1]) + (v - low[1]) << bits[2]) + (w - low[2])
        key.sort()
        first = np.ones(len(key), dtype=bool)
        first[1:] = key[1:] != key[:-1]
        key = key[first]
        return (key >> bits[1] + bits[2]) + low[0], (key >> bits[2] & (1 << bits[1]) - 1) + low[1], (key & (1 << bits[2]) - 1) + low[2]
    order = np.lexsort((w, v, g))
    g, v, w = g[order], v[order], w[order]
    first = np.ones(len(g), dtype=bool)
    first[1:] = (g[1:] != g[:-1]) | (v[1:] != v[:-1]) | (w[1:] != w[:-1])
    return g[first], v[first], w[first]


def _sent(pairs: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], parts: int) -> Iterator[pa.RecordBatch]:
    """Distinct directed pairs (g, v, w) of chunks, packed for the part of v."""
    for g, v, w in pairs:
        g, v, w = _distinct(g, v, w)
        part = (_mixed(g, v) % parts).astype("u2" if parts < 1 << 16 else "i8")
        order = np.argsort(part, kind="stable")
        g, v, w, part = g[order], v[order], w[order], part[order]
        to, at = np.unique(part, return_index=True)
        rows = [[int(p), *packs(g[lo:hi], v[lo:hi], w[lo:hi])] for p, lo, hi in zip(to, at, [*at[1:], len(part)], strict=True)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["part", "g", "v", "w"])


def _received(batches: Iterator[pa.RecordBatch]) -> tuple[int | None, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The part and the distinct pairs of all chunks sent to it."""
    kept = [[], [], []]
    part = None
    for batch in batches:
        for p, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            part = p
            for k, x in enumerate(row):
                kept[k].append(unpack(x))
    return part, _distinct(*(np.concatenate(x) for x in kept)) if part is not None else (np.zeros(0, dtype="i8"),) * 3


def _gathered(pairs: DataFrame, parts: int) -> DataFrame:
    """Packed lists, a row for each part, from packed pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, (g, v, w) = _received(batches)
        if part is None:
            return
        new = np.ones(len(g), dtype=bool)
        new[1:] = (g[1:] != g[:-1]) | (v[1:] != v[:-1])
        at = np.flatnonzero(new)
        sizes = np.diff(np.append(at, len(g)))
        # Points at equal numbers of entries: what bounds of blocks are taken from.
        q = at[np.searchsorted(at, np.linspace(0, len(g) - 1, min(len(g), 512)).astype("i8"), side="right") - 1]
        vs, gs, ns, near = packs(v[at], g[at], sizes, w)
        qs = [{"g": int(a), "v": int(b)} for a, b in zip(g[q], v[q], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([vs], pa.binary()), pa.array([gs], pa.binary()), pa.array([ns], pa.binary()), pa.array([near], pa.binary()), pa.array([len(g)], pa.int64()), pa.array([qs], pa.list_(pa.struct([("g", pa.int64()), ("v", pa.int64())])))], names=["part", "vs", "gs", "sizes", "near", "n", "qs"])

    return materialise(pairs.repartitionById(parts, "part").mapInArrow(run, _PACKED), "lists", clean=True)


def _parts(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _chunks(rows: Iterator[list[np.ndarray]]) -> Iterator[list[np.ndarray]]:
    """Columns joined until they have CHUNK entries."""
    kept, n = [], 0
    for row in rows:
        kept.append(row)
        n += len(row[0])
        if n >= CHUNK:
            yield [np.concatenate(x) for x in zip(*kept, strict=True)]
            kept, n = [], 0
    if n:
        yield [np.concatenate(x) for x in zip(*kept, strict=True)]


def lists_of_edges(edges: DataFrame) -> DataFrame:
    """Packed neighbour lists of ``edges(g, u, v)``, both directions, repeats merged."""
    parts = _parts(edges)

    def rows(batches):
        for batch in batches:
            yield [_numbers(batch.column(k)) for k in range(3)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _sent(((np.concatenate([g, g]), np.concatenate([u, v]), np.concatenate([v, u])) for g, u, v in _chunks(rows(batches))), parts)

    return _gathered(edges.select("g", "u", "v").where("u <> v").mapInArrow(run, "part int, g binary, v binary, w binary"), parts)


def lists_of_hypergraph(incidence: DataFrame) -> DataFrame:
    """Packed neighbour lists of the clique expansion of ``incidence(g, v, he)``; repeated rows count once, and no pair is ever a row."""
    parts = _parts(incidence)
    members = incidence.select("g", "he", "v").where("v IS NOT NULL AND he IS NOT NULL")

    def rows(batches):
        for batch in batches:
            yield [_numbers(batch.column(k)) for k in range(3)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _sent(_chunks(rows(batches)), parts)

    def pairs(batches):
        kept, n = [], 0
        part, (g, he, ids) = _received(batches)
        if part is not None:
            at = np.flatnonzero((np.diff(g, prepend=g[0]) != 0) | (np.diff(he, prepend=he[0] - 1) != 0))
            sizes = np.diff(np.append(at, len(g)))
            g, start = g[at], at
            row = np.repeat(np.arange(len(g)), sizes)
            # In parts, as a set of k gives k * k pairs.
            ends = np.cumsum(sizes[row])
            for lo in range(0, len(row), 1 << 16):
                hi = min(len(row), lo + (1 << 16))
                while lo < hi:
                    to = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CHUNK, side="right")))
                    to = min(to, hi)
                    r = row[lo:to]
                    v, w = np.repeat(ids[lo:to], sizes[r]), ids[_ranges(start[r], sizes[r])]
                    other = v != w
                    kept.append((np.repeat(g[r], sizes[r])[other], v[other], w[other]))
                    n += len(kept[-1][0])
                    lo = to
                    if n >= CHUNK:
                        yield [np.concatenate(x) for x in zip(*kept, strict=True)]
                        kept, n = [], 0
        if n:
            yield [np.concatenate(x) for x in zip(*kept, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _sent(pairs(batches), parts)

    packed = "part int, g binary, v binary, w binary"
    return _gathered(members.mapInArrow(deal, packed).repartitionById(parts, "part").mapInArrow(run, packed), parts)


def edges_of(lists: DataFrame) -> DataFrame:
    """The edges (g, u, v), u < v, of packed lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for vs, gs, sizes, near in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, w = unpack(sizes), unpack(near)
                g, u = np.repeat(unpack(gs), n), np.repeat(unpack(vs), n)
                up = w > u
                g, u, w = g[up], u[up], w[up]
                for lo in range(0, len(g), ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + ROWS]) for x in (g, u, w)], names=["g", "u", "v"])

    return lists.select("vs", "gs", "sizes", "near").mapInArrow(run, "g long, u long, v long")


class Block:
    """One graph's share of a block: ``own`` (positions of own vertices), ``ids`` of all vertices in reach, and their whole lists of positions (empty beyond the neighbours of own ones)."""

    def __init__(self, g: int, v: np.ndarray, own: np.ndarray, sizes: np.ndarray, near: np.ndarray):
        self.g, self.ids = g, np.unique(np.concatenate([v, near]))
        at = np.searchsorted(self.ids, v)
        self.own = np.sort(at[own])
        to, start = np.searchsorted(self.ids, near).astype("i4"), _starts(sizes)
        self.near = [np.zeros(0, dtype="i4")] * len(self.ids)
        for k, p in enumerate(at.tolist()):
            self.near[p] = to[start[k] : start[k + 1]]
        self.size = np.zeros(len(self.ids), dtype="i8")
        self.size[at] = sizes


def _entries(lists: DataFrame) -> int:
    return lists.agg(F.sum("n")).first()[0] or 0


def _ranges_of(lists: DataFrame, count: int) -> Callable[[int, np.ndarray], np.ndarray]:
    """A function (g, vertices) -> which of ``count`` ranges of about equal numbers of entries each lies in."""
    # A part holds vertices by hash, so that some parts stand for all.
    points = sorted((r["q"]["g"], r["q"]["v"]) for r in lists.where("part < 64").select(F.explode("qs").alias("q")).toLocalIterator()) if count > 1 else []
    bounds = sorted({points[k * len(points) // count] for k in range(1, count)}) if points else []
    bg, bv = np.array([b[0] for b in bounds], dtype="i8"), np.array([b[1] for b in bounds], dtype="i8")

    def block(g: int, v: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(bg, g), np.searchsorted(bg, g, side="right")
        return lo + np.searchsorted(bv[lo:hi], v, side="right")

    return block


def _graphs(g: np.ndarray) -> list[tuple[int, int, int]]:
    """(g, from, to) of each run of equal g."""
    cuts = np.flatnonzero(np.diff(g, prepend=g[0] - 1)) if len(g) else []
    return [(int(g[lo]), lo, hi) for lo, hi in zip(cuts, [*cuts[1:], len(g)], strict=True)]


def by_block(lists: DataFrame, work: Callable[[Block], Iterator[list]], schema: str) -> DataFrame:
    """``work`` on every block: it yields lists of columns of ``schema``, without g, which comes first."""
    seen = _entries(lists)
    blocks = max(1, -(-seen // BLOCK), min(24, seen >> 17))
    block = _ranges_of(lists, blocks)

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for vs, gs, sizes, near in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                g, v, n, w = unpack(gs), unpack(vs), unpack(sizes), unpack(near)
                start, to, own = _starts(n), np.zeros(len(w), dtype="i8"), np.zeros(len(v), dtype="i8")
                for one, lo, hi in _graphs(g):
                    own[lo:hi] = block(one, v[lo:hi])
                    to[start[lo] : start[hi]] = block(one, w[start[lo] : start[hi]])
                row = np.repeat(np.arange(len(v)), n)
                # Each list once to each block; the block of the vertex itself needs it too.
                pair = np.unique(np.concatenate([to, own]) * len(v) + np.concatenate([row, np.arange(len(v))]))
                dest, row = pair // max(1, len(v)), pair % max(1, len(v))
                names, at = np.unique(dest, return_index=True)
                for b, lo, hi in zip(names.tolist(), at, [*at[1:], len(dest)], strict=True):
                    r = row[lo:hi]
                    data = packs(g[r], v[r], (own[r] == b).astype("i8"), n[r], w[_ranges(start[r], n[r])])
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), *(pa.array([x], pa.binary()) for x in data)], names=["block", "g", "v", "own", "sizes", "near"])

    names = ["g", *(c.split()[0] for c in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [[] for _ in range(5)]
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                for k, x in enumerate(row):
                    kept[k].append(unpack(x))
        if not kept[0]:
            return
        g, v, own, n, w = (np.concatenate(x) for x in kept)
        kept = None
        graphs = np.unique(g)
        start = _starts(n)
        for one in graphs.tolist():
            r = np.flatnonzero(g == one) if len(graphs) > 1 else np.arange(len(g))
            for columns in work(Block(one, v[r], own[r] == 1, n[r], w if len(graphs) == 1 else w[_ranges(start[r], n[r])])):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), one, dtype="i8")), *(c if isinstance(c, pa.Array) else pa.array(c) for c in columns)], names=names)

    packed = lists.select("vs", "gs", "sizes", "near").mapInArrow(ship, "block int, g binary, v binary, own binary, sizes binary, near binary")
    return packed.repartitionById(blocks, "block").mapInArrow(run, f"g long, {schema}")


def _flush(rows: list, width: int) -> list:
    return [np.concatenate([r[k] for r in rows]) for k in range(width)]


def _collect(found: Iterator[list], width: int) -> Iterator[list]:
    """Columns of a few rows joined to larger ones."""
    kept, n = [], 0
    for row in found:
        kept.append(row)
        n += len(row[0])
        if n >= ROWS:
            yield _flush(kept, width)
            kept, n = [], 0
    if n:
        yield _flush(kept, width)


class _Places:
    """Positions of integers among the distinct ones of ``chunks``, ascending; -1 for others."""

    def __init__(self, chunks: Callable[[], Iterator[np.ndarray]]):
        ends = [(int(x.min()), int(x.max())) for x in chunks() if len(x)] or [(0, 0)]
        self.low, high = min(e[0] for e in ends), max(e[1] for e in ends)
        self.table = None
        if high - self.low < SPAN:
            mark = np.zeros(high - self.low + 1, dtype=bool)
            for x in chunks():
                mark[x - self.low] = True
            self.ids = np.flatnonzero(mark) + self.low
            self.table = np.where(mark, np.cumsum(mark, dtype="i4") - 1, -1).astype("i4")
            return
        self.ids, new = np.zeros(0, dtype="i8"), []
        for x in chunks():
            new.append(np.unique(x))
            if sum(map(len, new)) > max(CHUNK, len(self.ids)):
                self.ids, new = np.unique(np.concatenate([self.ids, *new])), []
        self.ids = np.unique(np.concatenate([self.ids, *new]))

    def of(self, x: np.ndarray) -> np.ndarray:
        if self.table is not None:
            inside = (x >= self.low) & (x < self.low + len(self.table))
            return self.table[x - self.low] if inside.all() else np.where(inside, self.table[np.where(inside, x - self.low, 0)], -1)
        at = np.searchsorted(self.ids, x)
        return np.where(self.ids[np.minimum(at, len(self.ids) - 1)] == x, at, -1).astype("i4")


class Tile:
    """The edges of one graph from range ``i`` of its vertices to range ``j``, with the lists of both: ``near`` by position among ``ids``; ``size`` of each list, ``degree`` of each vertex where asked for."""

    def __init__(self, g: int, rows: list[tuple], block: Callable[[int, np.ndarray], np.ndarray], i: int, j: int):
        """``rows``: packed (v, sizes, near) of lists, then packed (v, sizes) of degrees."""
        lists, degrees = [r for r in rows if len(r) == 3], [r for r in rows if len(r) == 2]

        def all_ids():
            for v, _, w in lists:
                yield unpack(v)
                yield unpack(w)

        self.g, places = g, _Places(all_ids)
        self.ids = places.ids
        self.near, self.size = [np.zeros(0, dtype="i4")] * len(self.ids), np.zeros(len(self.ids), dtype="i8")
        for v, sizes, w in lists:
            at, n, w = places.of(unpack(v)), unpack(sizes), places.of(unpack(w))
            self.size[at] = n
            for p, hi, k in zip(at.tolist(), np.cumsum(n).tolist(), n.tolist(), strict=True):
                self.near[p] = w[hi - k : hi]
        self.degree = np.zeros(len(self.ids), dtype="i8")
        for v, n in degrees:
            at = places.of(unpack(v))
            self.degree[at[at >= 0]] = unpack(n)[at >= 0]
        of = block(g, self.ids)
        self.start, self.low, self.high = np.searchsorted(of, i), np.searchsorted(of, j), np.searchsorted(of, j, side="right")
        self.end = np.searchsorted(of, i, side="right")

    def edges(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(own, u, v) for groups of vertices of range i, with their edges (u, v), u < v, into range j, ascending; positions."""
        have = self.start + np.flatnonzero(self.size[self.start : self.end])
        for k in range(0, len(have), GROUP):
            own = have[k : k + GROUP]
            v = np.concatenate([self.near[u] for u in own.tolist()])
            u = np.repeat(own, self.size[own])
            into = (v >= self.low) & (v < self.high) & (v > u)
            if into.any():
                yield own, u[into], v[into]

    def thirds(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(u, v, w), in groups: for every edge (u, v) of the tile all w in both lists, ascending by u and v; positions."""
        width = len(self.ids)
        mark = np.zeros((GROUP, width), dtype=bool)
        for own, u, v in self.edges():
            number = np.searchsorted(own, u)
            for r, p in enumerate(own.tolist()):
                mark[r, self.near[p]] = True
            flat_mark, size = mark.reshape(-1), self.size[v]
            heavy = size > 16 * self.size[u] + 1024
            us, vs, ws = [], [], []
            # Of two lists the shorter is looked up in the longer.
            for k in np.flatnonzero(heavy).tolist():
                mine, long = self.near[u[k]], self.near[v[k]]
                w = mine[long[np.minimum(np.searchsorted(long, mine), len(long) - 1)] == mine]
                us.append(np.full(len(w), u[k]))
                vs.append(np.full(len(w), v[k]))
                ws.append(w)
            light = np.flatnonzero(~heavy & (size > 0))
            ends = np.cumsum(size[light])
            lo = 0
            while lo < len(light):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CHUNK, side="right")))
                e = light[lo:hi]
                flat = np.concatenate([self.near[x] for x in v[e].tolist()])
                hit = np.flatnonzero(flat_mark[np.repeat(number[e] * width, size[e]) + flat])
                if len(hit):
                    of = e[np.searchsorted(ends[lo:hi] - (ends[lo - 1] if lo else 0), hit, side="right")]
                    us.append(u[of])
                    vs.append(v[of])
                    ws.append(flat[hit])
                lo = hi
            for r, p in enumerate(own.tolist()):
                mark[r, self.near[p]] = False
            if us:
                u, v, w = np.concatenate(us), np.concatenate(vs), np.concatenate(ws)
                if heavy.any():
                    order = np.lexsort((w, v, u))
                    u, v, w = u[order], v[order], w[order]
                if len(u):
                    yield u, v, w


def by_tile(lists: DataFrame, work: Callable[[Tile], Iterator[list]], schema: str, above: bool = False, degrees: bool = False) -> DataFrame:
    """``work`` on every tile of every graph: it yields lists of columns of ``schema``, without g, which comes first.

    With ``above`` lists hold only what comes after their vertex; with ``degrees`` tiles know the degrees of all their vertices.
    """
    seen = _entries(lists)
    k = max(1, -(-(seen // 2 if above else seen) // TILE), int(np.ceil(np.sqrt(2 * min(21, seen >> 17)))) - 1)
    block = _ranges_of(lists, k)
    number = {(i, j): i * k - i * (i - 1) // 2 + j - i for i in range(k) for j in range(i, k)}
    tasks = len(number)
    task_of = np.array([[number[min(i, j), max(i, j)] for j in range(k)] for i in range(k)])
    sides = list(number)

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(task, *columns):
            return pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), *(pa.array([x], pa.binary()) for x in packs(*columns)), *[pa.array([None], pa.binary())] * (4 - len(columns))], names=["task", "g", "v", "sizes", "near"])

        for batch in batches:
            for vs, gs, sizes, near in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                g, v, n, w = unpack(gs), unpack(vs), unpack(sizes), unpack(near)
                start, own, to = _starts(n), np.zeros(len(v), dtype="i2"), np.zeros(len(w), dtype="i2")
                for one, lo, hi in _graphs(g):
                    own[lo:hi] = block(one, v[lo:hi])
                    to[start[lo] : start[hi]] = block(one, w[start[lo] : start[hi]])
                row = np.repeat(np.arange(len(v)), n)
                # Which list has a neighbour in which range.
                linked = np.zeros((len(v), k), dtype=bool)
                linked[row, to] = True
                if above:
                    up = w > v[row]
                    w, kept = w[up], np.bincount(row[up], minlength=len(v))
                    start = _starts(kept)
                else:
                    kept = n
                goes = np.full((len(v), k), -1)
                at, side = np.nonzero(linked & (kept > 0)[:, None])
                goes[at, side] = task_of[own[at], side]
                for task in np.unique(goes[at, side]).tolist():
                    r = np.flatnonzero((goes == task).any(axis=1))
                    yield sent(task, g[r], v[r], kept[r], w[_ranges(start[r], kept[r])])
                for task in range(tasks) if degrees else ():
                    yield sent(task, g, v, n)

    names = ["g", *(c.split()[0] for c in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graphs, task = {}, None
        for batch in batches:
            for task, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                g = unpack(row[0])
                if len(g) and g[0] == g[-1]:
                    graphs.setdefault(int(g[0]), []).append(tuple(x for x in row[1:] if x is not None))
                    continue
                v, n = unpack(row[1]), unpack(row[2])
                w, start = (unpack(row[3]), _starts(n)) if row[3] is not None else (None, None)
                for one, lo, hi in _graphs(g):
                    graphs.setdefault(one, []).append(tuple(packs(v[lo:hi], n[lo:hi], *([] if w is None else [w[start[lo] : start[hi]]]))))
        batch = row = None  # a task's rows come in few batches, and what is packed goes once it is unpacked
        for one in sorted(graphs):
            rows = graphs.pop(one)
            tile = Tile(one, rows, block, *sides[task]) if any(len(r) == 3 for r in rows) else None
            rows = None
            if tile is not None:
                for columns in work(tile):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), one, dtype="i8")), *(c if isinstance(c, pa.Array) else pa.array(c) for c in columns)], names=names)

    packed = lists.select("vs", "gs", "sizes", "near").mapInArrow(ship, "task int, g binary, v binary, sizes binary, near binary")
    return packed.repartitionById(tasks, "task").mapInArrow(run, f"g long, {schema}")


def triangles(lists: DataFrame) -> DataFrame:
    """(g, a, b, c), a < b < c: every triangle once, from the tile of its first edge."""

    def work(x: Tile):
        for u, v, w in _collect(x.thirds(), 3):
            yield [x.ids[u], x.ids[v], x.ids[w]]

    return by_tile(lists, work, "a long, b long, c long", above=True)


def triangle_neighbours(lists: DataFrame) -> DataFrame:
    """(g, u, v), both directions: edges that lie in a triangle."""

    def found(x: Tile):
        for u, v, _ in x.thirds():
            first = np.ones(len(u), dtype=bool)
            first[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
            u, v = x.ids[u[first]], x.ids[v[first]]
            yield [np.concatenate([u, v]), np.concatenate([v, u])]

    return by_tile(lists, lambda x: _collect(found(x), 2), "u long, v long")


def triangle_counts(lists: DataFrame) -> DataFrame:
    """(g, v, n): the number of triangles at each vertex of one."""

    def work(x: Tile):
        n = np.zeros(len(x.ids), dtype="i8")
        for t in _collect(x.thirds(), 3):
            n += np.bincount(np.concatenate(t), minlength=len(n))
        at = np.flatnonzero(n)
        for lo in range(0, len(at), ROWS):
            yield [x.ids[at[lo : lo + ROWS]], n[at[lo : lo + ROWS]]]

    return by_tile(lists, work, "v long, n long", above=True).groupBy("g", "v").agg(F.sum("n").alias("n"))


_TENS = 10 ** np.arange(19)


def joined_number(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The digits of b after those of a; ids are not negative."""
    return a * _TENS[np.maximum(np.searchsorted(_TENS, b, side="right"), 1)] + b


def up_laplacian_sums(lists: DataFrame) -> DataFrame:
    """(g, u, v, n, val, checksum): of each row of the up-Laplacian of rank 1 of the clique complex, the number of entries, their sum, and the sum of their columns' names read as numbers.

    Two edges lie in at most one triangle, so no entry off the diagonal cancels.
    """

    def found(x: Tile):
        for u, v, w in x.thirds():
            new = np.ones(len(u), dtype=bool)
            new[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
            at = np.flatnonzero(new)
            first, second, third = x.ids[u], x.ids[v], x.ids[w]
            other = joined_number(np.minimum(first, third), np.maximum(first, third)) + joined_number(np.minimum(second, third), np.maximum(second, third))
            t = np.diff(np.append(at, len(v)))
            # The entry of two edges is the product of their signs: of a middle third vertex both are -1, of others they cancel.
            middle = np.add.reduceat(((w > u) & (w < v)).astype("i8"), at)
            yield [first[at], second[at], 1 + 2 * t, t - 2 * middle, np.add.reduceat(other, at) + joined_number(first[at], second[at])]

    return by_tile(lists, lambda x: _collect(found(x), 5), "u long, v long, n long, val long, checksum long")


def two_hops(lists: DataFrame) -> DataFrame:
    """(g, centre, one, two): of every vertex with edges, its neighbours, and what else is two hops away, both ascending; ids."""

    def work(x: Block):
        near, far = [], []
        seen = np.zeros(len(x.ids), dtype=bool)

        def columns(own):
            lists_ = lambda rows: pa.ListArray.from_arrays(_starts(np.array([len(r) for r in rows])).astype("i4"), pa.array(x.ids[np.concatenate(rows)]))
            return [x.ids[own], lists_(near), lists_(far)]

        own, n = [], 0
        for u in x.own.tolist():
            mine = x.near[u]
            flat = np.concatenate([x.near[v] for v in mine.tolist()])
            if len(flat) * 8 > len(seen):
                seen[flat] = True
                seen[mine] = seen[u] = False
                two = np.flatnonzero(seen)
                seen[two] = False
            else:
                two = np.unique(flat)
                seen[mine] = seen[u] = True
                two = two[~seen[two]]
                seen[mine] = seen[u] = False
            own.append(u)
            near.append(mine)
            far.append(two)
            n += len(mine) + len(two)
            if n >= ROWS * 4:
                yield columns(own)
                own, n = [], 0
                near.clear()
                far.clear()
        if own:
            yield columns(own)

    return by_block(lists, work, "centre long, one array<long>, two array<long>")


def two_hop_sums(lists: DataFrame) -> DataFrame:
    """(g, centre, d, n, checksum): for every vertex with edges the number of vertices at distance d = 1 and d = 2, where there are any, and the sum of their ids.

    A task holds what the lists have in one range of vertices, j, and reads the lists of another, i, one after another: so what it counts for a centre is
    distinct by itself, and the counts of all j add up.
    """
    seen = _entries(lists)
    most = min(12, seen >> 17)
    held_in = max(1, -(-seen // (2 * TILE)), int(np.ceil(np.sqrt(most))))
    read_in = max(1, -(-most // held_in))
    held_of, read_of = _ranges_of(lists, held_in), _ranges_of(lists, read_in)

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(task, held, *columns):
            return pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([held]), *(pa.array([x], pa.binary()) for x in packs(*columns))], names=["task", "held", "g", "v", "sizes", "near"])

        for batch in batches:
            for vs, gs, sizes, near in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                g, v, n, w = unpack(gs), unpack(vs), unpack(sizes), unpack(near)
                start, own, to, back = _starts(n), np.zeros(len(v), dtype="i2"), np.zeros(len(w), dtype="i2"), np.zeros(len(w), dtype="i2")
                for one, lo, hi in _graphs(g):
                    own[lo:hi] = read_of(one, v[lo:hi])
                    to[start[lo] : start[hi]] = held_of(one, w[start[lo] : start[hi]])
                    back[start[lo] : start[hi]] = read_of(one, w[start[lo] : start[hi]])
                row = np.repeat(np.arange(len(v)), n)
                linked = np.zeros((len(v), read_in), dtype=bool)
                linked[row, back] = True
                for j in range(held_in):
                    into = to == j
                    kept = np.bincount(row[into], minlength=len(v))
                    part, first = w[into], _starts(kept)
                    for i in range(read_in):
                        # A centre in range i reaches range j by way of v.
                        r = np.flatnonzero(linked[:, i] & (kept > 0))
                        if len(r):
                            yield sent(i * held_in + j, True, g[r], v[r], kept[r], part[_ranges(first[r], kept[r])])
                for i in range(read_in):
                    r = np.flatnonzero(own == i)
                    for j in range(held_in if len(r) else 0):
                        yield sent(i * held_in + j, False, g[r], v[r], n[r], w[_ranges(start[r], n[r])])

    def sums(held: list, read: list) -> Iterator[list]:
        ids = _Places(lambda: (unpack(w) for _, _, w in held))
        over = _Places(lambda: (unpack(v) for v, _, _ in held))
        size, at, lists_, n = np.zeros(len(over.ids), dtype="i8"), np.zeros(len(over.ids), dtype="i8"), [], 0
        for v, sizes, w in held:
            p, sizes = over.of(unpack(v)), unpack(sizes)
            size[p], at[p] = sizes, n + _starts(sizes)[:-1]
            lists_.append(ids.of(unpack(w)))
            n += len(lists_[-1])
        flat = np.concatenate(lists_)
        lists_.clear()
        held.clear()
        last, order = np.zeros(len(ids.ids), dtype="i4"), np.arange(1 << 12, dtype="i4")
        for v, sizes, w in read:
            v, sizes, w = unpack(v), unpack(sizes), unpack(w)
            here, via, own = ids.of(w), over.of(w), ids.of(v)
            many = np.where(via >= 0, size[via], 0)
            first, start, ends = at[via], _starts(sizes), np.concatenate([[0], np.cumsum(many)])
            lo = 0
            while lo < len(v):
                hi = max(lo + 1, int(np.searchsorted(ends[start[1:]], ends[start[lo]] + CHUNK, side="right")))
                far = flat[_ranges(first[start[lo] : start[hi]], many[start[lo] : start[hi]])]
                cut = (ends[start[lo : hi + 1]] - ends[start[lo]]).tolist()
                if hi - lo == 1 and len(far) > len(order):
                    order = np.arange(len(far), dtype="i4")
                elif len(order) < max(CHUNK, len(far)):
                    order = np.arange(max(CHUNK, len(far)), dtype="i4")
                out = np.zeros((4, hi - lo), dtype="i8")
                for c in range(lo, hi):
                    near = here[start[c] : start[c + 1]]
                    near = near[near >= 0]
                    two = far[cut[c - lo] : cut[c - lo + 1]]
                    # Of each vertex the last mention counts, and none of what is nearer.
                    last[two] = order[: len(two)]
                    last[near] = -1
                    if own[c] >= 0:
                        last[own[c]] = -1
                    two = two[last[two] == order[: len(two)]]
                    out[:, c - lo] = len(near), ids.ids[near].sum(), len(two), ids.ids[two].sum()
                for d, n_, check in ((1, out[0], out[1]), (2, out[2], out[3])):
                    some = n_ > 0
                    if some.any():
                        yield [v[lo:hi][some], np.full(some.sum(), d, dtype="i4"), n_[some], check[some]]
                lo = hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graphs = {}
        for batch in batches:
            for _, held, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                g = unpack(row[0])
                if g[0] == g[-1]:
                    graphs.setdefault(int(g[0]), ([], []))[not held].append(tuple(row[1:]))
                    continue
                v, n, w = map(unpack, row[1:])
                start = _starts(n)
                for one, lo, hi in _graphs(g):
                    graphs.setdefault(one, ([], []))[not held].append(tuple(packs(v[lo:hi], n[lo:hi], w[start[lo] : start[hi]])))
        batch = row = None
        for one in sorted(graphs):
            held, read = graphs.pop(one)
            for columns in _collect(sums(held, read), 4) if held and read else ():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), one, dtype="i8")), *(pa.array(c) for c in columns)], names=["g", "centre", "d", "n", "checksum"])

    packed = lists.select("vs", "gs", "sizes", "near").mapInArrow(ship, "task int, held boolean, g binary, v binary, sizes binary, near binary")
    found = packed.repartitionById(held_in * read_in, "task").mapInArrow(run, "g long, centre long, d int, n long, checksum long")
    return found.groupBy("g", "centre", "d").agg(F.sum("n").alias("n"), F.sum("checksum").alias("checksum"))


def returns(lists: DataFrame, steps: int) -> DataFrame:
    """(g, k, v, p): return probabilities of the uniform walk after 2 and, with ``steps`` 3, three steps, where positive."""

    def work(x: Tile):
        # The graph is symmetric: a walk of two steps that returns is an edge, one of three a triangle.
        inverse = np.where(x.degree > 0, 1 / np.maximum(x.degree, 1), 0.0)
        two, three = np.zeros(len(x.ids)), np.zeros(len(x.ids))
        for _, u, v in x.edges():
            p = inverse[u] * inverse[v]
            np.add.at(two, u, p)
            np.add.at(two, v, p)
        for t in _collect(x.thirds(), 3) if steps > 2 else ():
            p = 2 * inverse[t[0]] * inverse[t[1]] * inverse[t[2]]
            for v in t:
                three += np.bincount(v, p, minlength=len(three))
        at = np.flatnonzero((two > 0) | (three > 0))
        for lo in range(0, len(at), ROWS):
            r = at[lo : lo + ROWS]
            yield [x.ids[r], two[r], three[r]]

    found = by_tile(lists, work, "v long, two double, three double", above=True, degrees=True).groupBy("g", "v").agg(F.sum("two").alias("two"), F.sum("three").alias("three"))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(c).alias("p")) for k, c in ((2, "two"), (3, "three")))))
    return found.select("g", "v", each.alias("x")).select("g", "x.k", "v", "x.p").where("p > 0")
