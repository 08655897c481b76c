"""SimHash near-duplicates through a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits; its embedding is the
vector of their bit counts.  Flipping one bit moves one coordinate by one, so
the Manhattan distance of two embeddings never exceeds the Hamming distance of
the fingerprints: candidates within ``bits`` in Manhattan distance hold every
link.  The counts are stored in unary (00, 01, 11), which makes the Manhattan
distance the bit count of an exclusive or.

The range join runs on grids.  The coordinates fall into g groups; two vectors
within Manhattan distance d differ in at most d groups, so they lie in the
same cell of at least one of the grids that keep g - d groups.  g follows the
number of fingerprints, so that cells stay small.  Each cell is searched in a
task by sorted runs; what a cell emits is a spanning forest of its links, not
its pairs.  A cell of more rows than a task should hold is dealt out as pairs
of blocks and searched exactly in a second pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweft.llm.shared import cut
from tallyweft.operators.iterate import component_labels as components

SEED = 42
#: Shingles hashed at once, rows of a cell that one task compares, links held before they are merged.
BLOCK, CELL, LINKS = 1 << 16, 4096, 1 << 21
#: Probability that two random 2-bit segments hold the same number of bits.
SAME = 0.375
LOW = 0x5555555555555555


# --- fingerprints -----------------------------------------------------------------------------


def fingerprint(text: str | None, words: int = 4) -> int:
    """Unsigned 64-bit SimHash of the text's word shingles, repeats included; 0 without words.

    A-Z are lower-cased; words are runs of other than ASCII white space; each
    shingle is hashed with XXH64 (UTF-8, seed 42); a bit is set if it is set
    in over half of the hashes.  Shingles are hashed in blocks, so memory
    stays near the text's own size.
    """
    import xxhash

    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(parts) - words + 1)
    ends = ends[-n:] if len(parts) >= words else ends[-1:]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[at : min(n, at + BLOCK)].tolist(), ends[at : at + BLOCK].tolist(), strict=True)]
        bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _printer(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """doc_id and the fingerprint's 64 bits as a signed long, for each row."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(_printer(words), "doc_id long, fp long")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# --- links ------------------------------------------------------------------------------------


def unary_counts(fp: Column) -> Column:
    """The embedding: each 2-bit segment's bit count in unary, packed into a long."""
    high = F.shiftrightunsigned(fp, 1)
    some = fp.bitwiseOR(high).bitwiseAND(F.lit(LOW))
    both = fp.bitwiseAND(high).bitwiseAND(F.lit(LOW))
    return some.bitwiseOR(F.shiftleft(both, 1))


def grids(n: int, bits: int, fixed: int | None = None) -> list[int]:
    """Masks of the coordinates that each grid keeps, for n fingerprints.

    The fewest groups for which a cell is expected to hold 32 random
    fingerprints at most, or a fixed number of groups.
    """
    for groups in [fixed] if fixed else range(bits + 2, 13):
        sizes = [32 // groups + (i < 32 % groups) for i in range(groups)]
        if n * SAME ** (sum(sorted(sizes)[: groups - bits])) <= 32:
            break
    edges = np.concatenate(([0], np.cumsum(sizes)))
    parts = [sum(3 << (2 * s) for s in range(edges[i], edges[i + 1])) for i in range(groups)]
    return [int(np.array(sum(parts[i] for i in kept), np.uint64).view(np.int64)) for kept in combinations(range(groups), groups - bits)]


class _Forest:
    """Merges links between the rows of a block into roots."""

    def __init__(self, fp: np.ndarray):
        self.names, self.at = np.unique(fp, return_inverse=True)
        self.root = np.arange(len(self.names))
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.n = 0

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        self.held.append((self.at[i], self.at[j]))
        self.n += len(i)
        if self.n > LINKS:
            self.merge()

    def merge(self) -> None:
        if not self.n:
            return
        a, b = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.n, root = [], 0, self.root
        while len(a):
            low = np.minimum(root[a], root[b])
            np.minimum.at(root, root[a], low)
            np.minimum.at(root, root[b], low)
            while (root[root] != root).any():
                root = root[root]
            open_ = root[a] != root[b]
            a, b = a[open_], b[open_]
        self.root = root

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        self.merge()
        moved = self.root != np.arange(len(self.root))
        return self.names[self.root[moved]], self.names[moved]


def _unary(fp: np.ndarray) -> np.ndarray:
    x, low = fp.view(np.uint64), np.uint64(LOW)
    high = x >> np.uint64(1)
    return ((x | high) & low) | (((x & high) & low) << np.uint64(1))


def _search(cell: np.ndarray, fp: np.ndarray, bits: int, nearest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links over rows sorted by cell, between rows of equal cells within the bounds: a
    forest that joins all of them, or each row's nearest among the rows before it."""
    forest, counts, x = _Forest(fp), _unary(fp), fp.view(np.uint64)
    least, best = np.full(len(fp), bits + 1, np.uint8), np.zeros(len(fp), np.int64)
    at, step = np.arange(len(fp) - 1), 1
    while len(at):
        at = at[cell[at] == cell[at + step]]
        near = at[np.bitwise_count(counts[at] ^ counts[at + step]) <= bits]
        apart = np.bitwise_count(x[near] ^ x[near + step])
        near, apart = near[apart <= bits], apart[apart <= bits]
        if len(near) and nearest:
            closer = apart < least[near + step]
            least[near[closer] + step], best[near[closer] + step] = apart[closer], near[closer]
        elif len(near):
            forest.add(near, near + step)
        step += 1
        at = at[at + step < len(fp)]
    if nearest:
        own = np.flatnonzero(least <= bits)
        return fp[best[own]], fp[own]
    return forest.links()


def _searcher(bits: int, most: int | None, nearest: bool):
    """Streams rows sorted by (g, key): links as (0, u, v), and rows of cells above ``most`` as (1 + g, key, fp)."""

    def out(kind, a, b):
        return pa.RecordBatch.from_arrays([pa.array(kind, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["kind", "a", "b"])

    def done(rows: np.ndarray, cell: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(rows) > 1:
            u, v = _search(cell, np.ascontiguousarray(rows[:, 2]), bits, nearest)
            if len(u):
                yield out(np.zeros(len(u), np.int64), u, v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, large = np.zeros((0, 3), np.int64), None
        for batch in batches:
            rows = np.column_stack([c.to_numpy() for c in batch.columns])
            if large is not None:
                own = (rows[:, :2] == large).all(axis=1)
                if own.any():
                    yield out(rows[own, 0] + 1, rows[own, 1], rows[own, 2])
                    rows = rows[~own]
                if not len(rows):
                    continue
                large = None
            rows = np.concatenate([rest, rows])
            if not len(rows):
                continue
            cell = np.concatenate(([0], np.cumsum((rows[1:, :2] != rows[:-1, :2]).any(axis=1))))
            size = np.bincount(cell)
            over = size > most if most else np.zeros(len(size), bool)
            last = cell == len(size) - 1
            if over[-1]:
                large, rest = rows[-1, :2].copy(), rows[:0]
            else:
                rest = rows[last]
            if over.any():
                own = over[cell]
                yield out(rows[own, 0] + 1, rows[own, 1], rows[own, 2])
            keep = ~last & ~over[cell]
            yield from done(rows[keep], cell[keep])
        yield from done(rest, np.zeros(len(rest), int))

    return run


def links(prints: DataFrame, *, bits: int = 4, most: int = CELL, nearest: bool = False, groups: int | None = None) -> DataFrame:
    """(u, v) links that join the same fingerprints as all pairs within ``bits`` bits would.

    ``prints`` has distinct, non-null ``fp``.  Links between pairs that other
    links already join may be left out.  With ``nearest``, each link is a pair
    within ``bits`` bits: of each fingerprint in each cell, the one to its
    nearest among the smaller fingerprints there.  ``groups`` fixes the number
    of coordinate groups, so that the number of grids does not depend on the
    number of fingerprints.
    """
    masks = grids(prints.count() if groups is None else 0, bits, groups)
    counts = unary_counts(F.col("fp"))
    cells = F.explode(F.array(*[F.struct(F.lit(g).cast("long").alias("g"), counts.bitwiseAND(F.lit(m)).alias("key")) for g, m in enumerate(masks)]))
    rows = prints.select("fp", cells.alias("c")).select("c.g", "c.key", "fp")
    dealt = rows.repartition("g", "key").sortWithinPartitions("g", "key", "fp")
    found = cut(dealt.mapInArrow(_searcher(bits, most, nearest), "kind long, a long, b long"), "links")
    direct = found.where("kind = 0").select(F.col("a").alias("u"), F.col("b").alias("v"))
    large = found.where("kind > 0").select((F.col("kind") - 1).alias("g"), F.col("a").alias("key"), F.col("b").alias("fp"))
    if large.isEmpty():
        return direct
    blocks = large.groupBy("g", "key").agg(F.ceil(F.count(F.lit(1)) / most).alias("n"))
    own = large.join(blocks, ["g", "key"]).withColumn("i", F.pmod(F.xxhash64("fp"), F.col("n")))
    pair = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))
    dealt = own.select("g", "key", "fp", "i", pair.alias("j")).select(F.xxhash64("g", "key", F.least("i", "j"), F.greatest("i", "j")).alias("g"), F.col("key"), "fp")
    second = dealt.repartition("g", "key").sortWithinPartitions("g", "key", "fp").mapInArrow(_searcher(bits, None, nearest), "kind long, a long, b long")
    return direct.unionByName(second.select(F.col("a").alias("u"), F.col("b").alias("v")))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 4, bits: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of each row.

    component_id is the smallest id among all documents reachable over links
    of ``bits`` differing bits at most.  Null and empty texts have fingerprint
    zero, which links like any other; a null id never is the smallest (a group
    of null ids only has a null component); repeated rows repeat; other
    columns are not read; an empty table gives an empty result.
    """
    prints = cut(fingerprints(docs, id_col=id_col, text_col=text_col, words=words), "prints")
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    groups = components(links(distinct.select("fp"), bits=bits)).withColumnRenamed("node", "fp")
    members = groups.join(distinct, "fp")
    least = members.groupBy("label").agg(F.min("first").alias("component_id"))
    linked = members.join(least, "label").select("fp", "component_id")
    of_print = distinct.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    return prints.join(of_print, "fp").select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")


# --- one document of each group ---------------------------------------------------------------


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; a shorter text is one shingle."""
    import xxhash

    parts = (text or "").encode().lower().split()
    h = np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, len(parts))
    n = max(1, len(h) - words + 1)
    out = np.full(n, min(len(h), words), np.uint64)
    for i in range(min(len(h), words)):  # order counts: each step multiplies, then mixes high bits down
        out = (out ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def _each_shingle(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                found = np.concatenate([shingles(text.as_py(), words) for text in batch.column(0)[at : at + 64]])
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["h"])

    return run


def _grams(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(text.as_py(), words).tobytes() for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["t", "grams"])

    return run


def sketch(grams: np.ndarray) -> bytes:
    """Parities of the shingles in as many bits as there are shingles, rounded up to a power of two, 64 at least.

    A shingle of one text only flips one bit, so two sketches never differ in
    more bits than the texts have shingles apart.  Halves of a sketch, taken
    together by exclusive or, are the sketch of half the bits.
    """
    m = max(64, 1 << (len(grams) - 1).bit_length())
    odd = np.bincount((grams & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _sketcher(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, bits = [], []
            for text in batch.column(1):
                grams = shingles(text.as_py(), words)
                n.append(len(grams))
                bits.append(sketch(grams))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(bits, pa.binary())], names=["t", "n", "bits"])

    return run


def _prefixes(words: int, similarity: float, names: np.ndarray, often: np.ndarray, hot: int):
    """Rows (kind, h, t, n, at) of each text's prefix: of its n shingles, by the sample's count and
    hash, the first that two texts of the similarity cannot both lack; kind is 1 if the count is above ``hot``."""

    def prefix(t: int, text: str) -> np.ndarray:
        grams = shingles(text, words)
        n, count = len(grams), np.zeros(len(grams), np.int64)
        if len(names):
            i = np.minimum(np.searchsorted(names, grams), len(names) - 1)
            count = np.where(names[i] == grams, often[i], 0)
        first = np.argsort(count, kind="stable")[: n - math.ceil(similarity * n) + 1]
        m = len(first)
        return np.stack([count[first] > hot, grams[first].view(np.int64), np.full(m, t), np.full(m, n), np.arange(m)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = np.concatenate([prefix(t.as_py(), text.as_py()) for t, text in zip(part.column(0), part.column(1), strict=True)], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["kind", "h", "t", "n", "at"])

    return run


def _meetings(similarity: float, most: int):
    """Streams rows (kind, h, t, n, at) sorted by (kind, h): the texts that meet in cells of at most ``most`` as (0, cell, t, 0, 0), rows of other cells as (1, h, t, n, rest).

    A text meets no other where its rest, or every other's, is too short for
    the similarity if this is the first shingle the two share; they then have
    an earlier one, or are not of that similarity.  A cell is named by its
    texts and not by the shingle, so that the many shingles which near copies
    share give one cell.  There is a row for each text, not for each pair.
    """

    def out(kind, a, b, n=None, rest=None):
        none = np.zeros(len(a), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (none + kind, a, b, none if n is None else n, none if rest is None else rest)], names=["kind", "a", "b", "n", "rest"])

    def done(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(rows):
            return
        cell = np.concatenate(([0], np.cumsum(rows[1:, 1] != rows[:-1, 1])))
        over = (np.bincount(cell) > most)[cell]
        if over.any():
            yield out(1, rows[over, 1], rows[over, 2], rows[over, 3], rows[over, 3] - rows[over, 4])
            rows, cell = rows[~over], cell[~over]
        t, n, rest = rows[:, 2], rows[:, 3], rows[:, 3] - rows[:, 4]
        meets = np.zeros(len(rows), bool)
        at, step = np.arange(len(rows) - 1), 1
        while len(at):
            at = at[cell[at] == cell[at + step]]
            good = at[np.minimum(rest[at], rest[at + step]) * (1 + similarity) >= similarity * (n[at] + n[at + step]) - 1e-6]
            meets[good] = meets[good + step] = True
            step += 1
            at = at[at + step < len(rows)]
        if meets.any():
            t, cell = t[meets], cell[meets]
            mixed = t.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            mixed ^= mixed >> np.uint64(32)
            starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
            names = np.add.reduceat(mixed, starts).view(np.int64)
            yield out(0, np.repeat(names, np.diff(np.append(starts, len(t)))), t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            rows = np.column_stack([c.to_numpy() for c in batch.columns]) if batch.num_rows else np.zeros((0, 5), np.int64)
            hot = rows[:, 0] == 1
            if hot.any():
                yield out(1, rows[hot, 1], rows[hot, 2], rows[hot, 3], rows[hot, 3] - rows[hot, 4])
                rows = rows[~hot]
            if not len(rows):
                continue
            if held and rows[0, 1] == rows[-1, 1] == held[0][-1, 1]:
                held.append(rows)
                continue
            rows = np.concatenate([*held, rows])
            last = rows[:, 1] == rows[-1, 1]
            held = [rows[last]]
            yield from done(rows[~last])
        if held:
            yield from done(np.concatenate(held))

    return run


def _alike(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                good.append(both >= similarity * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good, pa.bool_())), batch.column(1).filter(pa.array(good, pa.bool_()))], names=["u", "v"])

    return run


def _face(rows: list[tuple[int, int, int, int]], similarity: float) -> dict[int, tuple[float, int]]:
    """Of rows (n, t, label, sketch) those whose sketch allows a partner of another label: t, and how far off (of both lengths) and which the nearest is."""
    rows, share, found = sorted(rows), (1 - similarity) / (1 + similarity), {}
    sizes = [max(64, 1 << (row[0] - 1).bit_length()) for row in rows]
    for i, (n, t, label, bits) in enumerate(rows):
        for j in range(i + 1, len(rows)):
            long, other, apart, y = rows[j]
            if long * similarity > n + 1e-6:
                break
            if label == apart:
                continue
            m = sizes[j]
            while m > sizes[i]:
                m //= 2
                y = (y ^ (y >> m)) & ((1 << m) - 1)
            differ = (bits ^ y).bit_count()
            if differ <= share * (n + long) + 1e-6:
                off = differ / (n + long)
                found[t] = min(found.get(t, (2.0, 0)), (off, other))
                found[other] = min(found.get(other, (2.0, 0)), (off, t))
    return found


def _facing(similarity: float):
    """Streams rows (block, t, label, n, bits) sorted by block: (block, t, label, u) of each text that, by the sketches, can have a partner of another label there, and the nearest one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        made: list[tuple] = []

        def done() -> None:
            if len({r[2] for r in rows}) > 1:
                label = {r[1]: r[2] for r in rows}
                found = _face([(r[3], r[1], r[2], int.from_bytes(r[4], "little")) for r in rows], similarity)
                made.extend((rows[0][0], t, label[t], u) for t, (_, u) in found.items())

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*made, strict=True) if made else [[]] * 4)], names=["block", "t", "label", "u"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and rows[0][0] != row[0]:
                    done()
                    rows = []
                rows.append(row)
            yield out()
            made = []
        done()
        yield out()

    return run


def _spread(t: np.ndarray, label: np.ndarray, grams: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """Links that join the labels of a block as all its pairs of the similarity would: each text
    reached is compared with all texts not reached yet."""
    n = np.array([len(g) for g in grams])
    names, ids = np.unique(np.concatenate(grams), return_inverse=True)
    ids = np.split(ids, np.cumsum(n)[:-1])
    mark, left, u, v = np.zeros(len(names), bool), np.arange(len(t)), [], []
    while len(left):
        own = label[left] == label[left[0]]
        queue, left = left[own].tolist(), left[~own]
        flat = None
        while queue and len(left):
            x = queue.pop()
            if flat is None:
                flat, starts = np.concatenate([ids[i] for i in left]), np.concatenate(([0], np.cumsum(n[left])[:-1]))
            mark[ids[x]] = True
            both = np.add.reduceat(mark[flat], starts, dtype=np.int64)
            mark[ids[x]] = False
            found = both >= similarity * (n[x] + n[left] - both)
            if found.any():
                u.extend([int(t[x])] * int(found.sum()))
                v.extend(t[left[found]].tolist())
                own = np.isin(label[left], label[left[found]])
                queue.extend(left[own].tolist())
                left, flat = left[~own], None
    return u, v


def _spreader(similarity: float):
    """Streams rows (block, t, label, grams) sorted by block and t: links (u, v)."""

    def done(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows = list({r[1]: r for r in rows}.values())
        if len({r[2] for r in rows}) > 1:
            t, label = (np.array([r[i] for r in rows], np.int64) for i in (1, 2))
            u, v = _spread(t, label, [np.frombuffer(r[3], np.uint64) for r in rows], similarity)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and rows[0][0] != row[0]:
                    yield from done(rows)
                    rows = []
                rows.append(row)
        yield from done(rows)

    return run


def _open_rows(large: DataFrame, similarity: float) -> DataFrame:
    """(h, t): of the rows (h, t, n, rest) of large cells those that can have a partner for which this is the first shingle shared.

    Partners differ in length by the similarity at most, so they lie in the
    same step of a logarithm or the next.  Of the steps around a row, the
    longest rest and the shortest text bound what the row could share: texts
    of one template, each with words of its own before the common ones, have
    no such partner and leave the cell here, whatever their number.
    """
    at = F.floor(F.log(F.col("n").cast("double")) / math.log(1 / similarity)).cast("long")
    rows = large.withColumn("step", at)
    steps = rows.groupBy("h", "step").agg(F.max("rest").alias("_rest"), F.min("n").alias("_n"))
    near = steps.select("h", F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)).alias("step"), "_rest", "_n")
    near = near.groupBy("h", "step").agg(F.max("_rest").alias("_rest"), F.min("_n").alias("_n"))
    least = F.greatest(F.col("_n").cast("double"), F.col("n") * similarity)
    fits = F.least("rest", "_rest") * (1 + similarity) >= (F.col("n") + least) * similarity - 1e-6
    return rows.join(near, ["h", "step"]).where(fits).select("h", "t")


def close_prints(texts: DataFrame, *, words: int = 4, bits: int = 4) -> DataFrame:
    """(u, v) pairs of texts (t, text) that the fingerprints propose: each with the first text of its fingerprint, and the first texts of linked fingerprints."""
    prints = cut(fingerprints(texts, id_col="t", words=words).select(F.col("doc_id").alias("t"), "fp"), "prints")
    heads = cut(prints.groupBy("fp").agg(F.min("t").alias("head")), "heads")
    own = prints.join(heads, "fp").where("head <> t").select(F.col("head").alias("u"), F.col("t").alias("v"))
    u, v = (heads.select(F.col("fp").alias(c), F.col("head").alias(f"{c}_head")) for c in "uv")
    linked = links(heads.select("fp"), bits=bits).join(u, "u").join(v, "v").select(F.col("u_head").alias("u"), F.col("v_head").alias("v"))
    return own.unionByName(linked)


def alike(texts: DataFrame, *, words: int = 5, similarity: float = 0.8, sample: int = 1 << 14, most: int = 64, block: int = 1024) -> DataFrame:
    """(u, v) links that join the rows (t, text), t distinct, as all pairs of texts of the similarity would.

    Two sets of that Jaccard similarity share a shingle among the first of
    each in any common order (prefix filter), so cells of one shingle hold
    every pair.  Order is by the count in a sample, so that frequent shingles
    come last; it bears on the cost only.  Pairs are not listed: a cell is a
    row for each of its texts, and of these stay the texts whose sketch allows
    a partner there.  Each is compared with its nearest by the sketches, and
    with what SimHash proposes; texts of cells of over ``most``, with the
    smallest of the cell.  Where a cell then holds texts that verified links
    do not join, it is searched exactly, as pairs of blocks if it is large.
    Whole sets of shingles go only to texts that have passed their sketches.
    """
    every = max(1, -(-texts.count() // sample))
    counted = texts.where(F.pmod(F.xxhash64("t"), F.lit(every)) == 0).select("text").mapInArrow(_each_shingle(words), "h long").groupBy("h").count()
    common = counted.where("count > 1").orderBy(F.desc("count"), "h").limit(1 << 16).toArrow()
    names, often = common.column("h").to_numpy().view(np.uint64), common.column("count").to_numpy()
    order = np.argsort(names)
    first = texts.select("t", "text").mapInArrow(_prefixes(words, similarity, names[order], often[order], most // every), "kind long, h long, t long, n long, at long")
    dealt = first.repartition("h", F.when(F.col("kind") == 1, F.col("t"))).sortWithinPartitions("kind", "h")
    found = cut(dealt.mapInArrow(_meetings(similarity, most), "kind long, a long, b long, n long, rest long"), "cells")
    large = cut(_open_rows(found.where("kind = 1").select(F.col("a").alias("h"), F.col("b").alias("t"), "n", "rest"), similarity), "large")
    small = found.where("kind = 0").select(F.col("a").alias("h"), F.col("b").alias("t")).distinct()
    bits = cut(texts.select("t", "text").mapInArrow(_sketcher(words), "t long, n long, bits binary"), "bits")

    def facing(rows: DataFrame, name: str) -> DataFrame:
        dealt = rows.join(bits, "t").select("block", "t", "label", "n", "bits").repartition("block").sortWithinPartitions("block", "t")
        return cut(dealt.mapInArrow(_facing(similarity), "block long, t long, label long, u long"), name)

    def grams(ends: DataFrame) -> DataFrame:
        return cut(texts.select("t", "text").join(ends.distinct(), "t", "left_semi").mapInArrow(_grams(words), "t long, grams binary"), "grams")

    # a pair is a cell of two
    stars = large.join(large.groupBy("h").agg(F.min("t").alias("u")), "h").where("u < t").groupBy("u", "t").count()
    stars = stars.groupBy(F.col("t").alias("v")).agg(F.max_by("u", F.struct("count", "u")).alias("u")).select("u", "v")
    pairs = stars.unionByName(close_prints(texts).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))).distinct()
    pairs = pairs.select(F.xxhash64("u", "v").alias("h"), F.explode(F.array("u", "v")).alias("t"))
    near = facing(small.unionByName(pairs).select(F.col("h").alias("block"), "t", F.col("t").alias("label")), "near")
    tried = cut(near.select(F.least("t", "u").alias("u"), F.greatest("t", "u").alias("v")).distinct(), "tried")
    sets = grams(tried.select(F.explode(F.array("u", "v")).alias("t")))
    u, v = (sets.select(F.col("t").alias(c), F.col("grams").alias(f"{c}_grams")) for c in "uv")
    good = cut(tried.join(u, "u").join(v, "v").select("u", "v", "u_grams", "v_grams").mapInArrow(_alike(similarity), "u long, v long"), "verified")

    labels = cut(components(good).select(F.col("node").alias("t"), "label"), "labels")
    cells = near.select(F.col("block").alias("h"), "t").unionByName(large)
    cells = cut(cells.join(labels, "t", "left").select("h", "t", F.coalesce("label", "t").alias("label")), "labelled")
    mixed = cells.groupBy("h").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    own = cut(cells.join(mixed.select("h"), "h").join(bits.select("t", "n"), "t"), "mixed")
    if own.isEmpty():
        return good
    size = own.groupBy("h").agg(F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("n") * 8 / (1 << 24))).alias("k"))
    own = own.join(size, "h").withColumn("i", F.pmod(F.xxhash64("t"), F.col("k"))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    open_ = facing(own.select(F.xxhash64("h", F.least("i", "j"), F.greatest("i", "j")).alias("block"), "t", "label"), "open")
    # blocks of the same texts are one
    same = open_.groupBy("block").agg(F.bit_xor(F.xxhash64("t")).alias("same"))
    open_ = cut(open_.join(same, "block").select(F.col("same").alias("block"), "t", "label").distinct(), "blocks")
    if open_.isEmpty():
        return good
    parts = open_.join(grams(open_.select("t")), "t").select("block", "t", "label", "grams").repartition("block").sortWithinPartitions("block", "t")
    return good.unionByName(cut(parts.mapInArrow(_spreader(similarity), "u long, v long"), "spread"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` less all but the smallest id of each group of near copies, columns unchanged.

    Two texts are near copies if their sets of shingles of ``words`` words
    have a Jaccard similarity of ``similarity`` at least; every such pair is
    found.  Groups are the components of these pairs; equal texts are of one
    group.  Rows of one id with different texts are different documents, rows
    equal in both (null counts as empty) are one; rows without an id cannot
    stand for a group and stay.
    """
    named = docs.where(F.col(id_col).isNotNull())
    whole = lambda text: [F.xxhash64(text).alias("_h"), F.xxhash64(F.lit(1), text).alias("_g")]  # noqa: E731  128 bits tell texts apart
    narrow = named.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select("*", *whole(F.col("text")))
    # written tables have true sizes: Spark broadcasts them where they are small, and texts are dealt out only where they are not
    reps = cut(narrow.groupBy("_h", "_g").agg(F.min("doc_id").alias("rep")).withColumn("t", F.monotonically_increasing_id()), "reps")
    own = narrow.join(reps.withColumnRenamed("rep", "doc_id"), ["_h", "_g", "doc_id"])
    again = cut(own.groupBy("t", "doc_id", "_h", "_g").count().where("count > 1").drop("count"), "again")
    single = own.join(again, "t", "left_anti")
    several = own.join(again, "t", "left_semi").dropDuplicates(["t"])
    texts = cut(single.unionByName(several).select("t", F.col("doc_id").alias("rep"), "_h", "_g", "text"), "texts")
    groups = components(alike(texts, words=words, similarity=similarity)).select(F.col("node").alias("t"), "label")
    members = texts.select("t", "rep", "_h", "_g").join(groups, "t", "left")
    least = members.groupBy(F.coalesce("label", "t").alias("label")).agg(F.min(F.struct("rep", "_h", "_g", "t")).alias("least"))
    kept = cut(least.select("least.*"), "kept")
    names = ["_keep_id", "_keep_h", "_keep_g"]
    key = [docs[id_col].cast("long"), *whole(F.coalesce(docs[text_col], F.lit("")))]
    keyed = docs.select("*", *[k.alias(n) for k, n in zip(key, names, strict=True)])
    at = lambda rows: rows.select(*[F.col(c).alias(n) for c, n in zip(("rep", "_h", "_g"), names, strict=True)])
    repeated = again.select("t")
    once = keyed.join(at(kept.join(repeated, "t", "left_anti")), names, "left_semi")
    more = keyed.join(at(kept.join(repeated, "t", "left_semi")), names, "left_semi").dropDuplicates(names)
    return once.unionByName(more).select(*docs.columns).unionByName(docs.where(F.col(id_col).isNull()))
