"""Document fingerprints by one-permutation MinHash.

Each word shingle is hashed once; the top bits of the hash choose one of BINS
bins, and a bin keeps its least hash.  Empty bins are filled by optimal
densification (Shrivastava 2017): bin i takes over the first filled bin in an
order that is fixed at random for i.  The lowest BITS bits of each bin are
packed into the fingerprint; chance agreement of low bits is corrected for in
``likeness``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweft.llm.shared import cut

BINS, BITS, WORDS = 256, 4, 5
#: Bytes of a text whose words are hashed at once.
CHUNK = 1 << 22

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: An odd multiplier modulo 2**64 and its inverse.
_P = 0x9E3779B97F4A7C15
_Q = pow(_P, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}
_order: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    if len(_powers.get(base, ())) < n:
        p = np.full(1 << max(12, (n - 1).bit_length()), base, np.uint64)
        p[0] = 1
        _powers[base] = np.cumprod(p)
    return _powers[base][:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word (run of other than ASCII white space), in order."""
    found, at = [], 0
    while at < len(data):
        end = min(len(data), at + CHUNK)
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        b = np.frombuffer(data, np.uint8, end - at, at)
        word = ~_SPACE[b]
        turn = np.flatnonzero(np.diff(np.concatenate(([False], word, [False]))))
        start, stop = turn[::2], turn[1::2]
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _power(_P, len(b)))))
        found.append(_mixed((total[stop] - total[start]) * _power(_Q, len(b))[start]))
        at = end
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def shingle_hashes(data: bytes, words: int = WORDS) -> np.ndarray:
    """A hash of each shingle of so many words; of the whole sequence, if it is shorter."""
    w = word_hashes(data)
    if not len(w):
        return w
    words = min(words, len(w))
    n = len(w) - words + 1
    total = np.full(n, words, np.uint64)
    for i in range(words):
        total = total * np.uint64(_P) + w[i : i + n]
    return _mixed(total)


def _orders(bins: int) -> np.ndarray:
    """Row i: at what place bin i looks at each bin."""
    if bins not in _order:
        rng = np.random.default_rng(20170806)
        _order[bins] = np.argsort(rng.random((bins, bins)), axis=1).astype(np.int32)
    return _order[bins]


def low_bits(hashes: np.ndarray, bins: int = BINS, bits: int = BITS) -> np.ndarray:
    """The low bits of each bin's least hash, after densification."""
    shift = np.uint64(64 - bins.bit_length() + 1)
    h = np.sort(hashes)
    first = np.searchsorted(h, np.arange(bins, dtype=np.uint64) << shift)
    value = h[np.minimum(first, len(h) - 1)]
    filled = (first < len(h)) & ((value >> shift) == np.arange(bins, dtype=np.uint64))
    if not filled.all():
        own = np.flatnonzero(filled)
        empty = np.flatnonzero(~filled)
        value[empty] = value[own[np.argmin(_orders(bins)[np.ix_(empty, own)], axis=1)]]
    return (value & np.uint64((1 << bits) - 1)).astype(np.uint8)


def fingerprint(text: str | None, words: int = WORDS, bins: int = BINS, bits: int = BITS) -> str:
    """Packed low bits in hex; the empty string for a text without words."""
    hashes = shingle_hashes((text or "").encode(), words)
    if not len(hashes):
        return ""
    low = low_bits(hashes, bins, bits)
    planes = (low[:, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint8)) & 1
    return np.packbits(planes.astype(np.uint8).ravel()).tobytes().hex()


def likeness(a: str, b: str, bits: int = BITS) -> float:
    """Estimated Jaccard similarity of the shingle sets, 0 to 1.

    Two bins agree by chance with probability 2**-bits; the share of equal
    bins is corrected for that.  Texts without words equal each other only.
    """
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    x = np.unpackbits(np.frombuffer(bytes.fromhex(a), np.uint8) ^ np.frombuffer(bytes.fromhex(b), np.uint8)).reshape(-1, bits)
    chance = 2.0**-bits
    return float(min(1.0, max(0.0, ((~x.any(axis=1)).mean() - chance) / (1 - chance))))


#: Fingerprints and digests are bytes until the result, at half the size.
FIELDS = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
KINDS = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]


def _row(doc_id, text: str, own: str, after: str, after_print: str) -> tuple:
    cut_ = len(text) // 4
    edited = text[: len(text) - cut_] + after[:cut_]
    print_ = fingerprint(edited)
    return doc_id, len(text), hashlib.sha256(edited.encode()).digest(), bytes.fromhex(own), bytes.fromhex(print_), likeness(own, print_), likeness(own, after_print)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents in order of id; of each task's first and last document one open row with their texts."""
    from pyspark import TaskContext

    names = [f.split()[0] for f in FIELDS.split(", ")] + ["part", "text", "head"]
    kinds = [*KINDS, pa.int32(), pa.string(), pa.string()]
    head = last = None

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py() or ""
            own = fingerprint(text)
            if last is None:
                head = text
            else:
                rows.append((*_row(*last, text, own), None, None, None))
            last = (doc_id, text, own)
        if rows:
            yield table(rows)
    if last is not None:
        yield table([(last[0], None, None, bytes.fromhex(last[2]), None, None, None, TaskContext.get().partitionId(), last[1], head)])


def _closing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in FIELDS.split(", ")]
    for batch in batches:
        rows = [_row(r["doc_id"], r["text"], r["fingerprint"].hex(), r["after"], fingerprint(r["after"])) for r in batch.to_pylist()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)], names=names)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint of each row: one narrow pass.  Null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t.as_py()) for t in batch.column(1)], pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def edited_neighbours(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last quarter comes from the next document.

    The texts are dealt once, by range of id, and each task walks its
    documents in order.  A task's last document waits, with the task's first
    text, for the head of the next task that has rows (of the first task, at
    the end): as many open rows as tasks, closed by a small join.  Equal ids
    are ordered by text, null ids come first, null texts count as empty, a
    single document follows itself, an empty table gives an empty result.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dealt = narrow.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    found = cut(dealt.mapInArrow(_neighbours, f"{FIELDS}, part int, text string, head string"), "neighbours")
    done = found.where("part is null").drop("part", "text", "head")
    edges = found.where("part is not null")
    parts = edges.agg(F.sort_array(F.collect_list("part")).alias("p")).select(F.posexplode("p").alias("at", "part"), "p")
    follows = parts.select("part", F.coalesce(F.try_element_at("p", F.col("at") + 2), F.element_at("p", 1)).alias("next"))
    heads = edges.select(F.col("part").alias("next"), F.col("head").alias("after"))
    open_ = edges.join(follows, "part").join(heads, "next").select("doc_id", "fingerprint", "text", "after")
    both = done.unionByName(open_.mapInArrow(_closing, FIELDS))
    return both.withColumns({c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")})
