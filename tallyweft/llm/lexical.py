"""Ranked lexical search by windows of documents.

Terms are maximal runs of letters and digits of ASCII and of all other
characters beyond it; only A-Z are lowered.  A query is the set of an item's
terms.  One pass over the texts and one over their postings answer a block of
items:

1. Each task gives its documents dense numbers in the order it reads them and
   cuts them into windows of ``WINDOW`` numbers (fewer where their postings
   come to ``POSTINGS``).  A window is one row: ids and lengths of its
   documents, and for each query term met its postings, that is places in the
   window and frequencies, in order of term and place.
2. N, L and the document frequencies are sums over windows.
3. Each task traverses its windows.  A term's postings get their parts of the
   score once a window; for each item they are scattered into one array of
   ``WINDOW`` sums, small enough for a core's cache, and marked in a bitset of
   occupied places.  The occupied places are harvested into the item's heap.
   An item whose best possible sum in the window lies below its heap is passed
   over.
4. The heaps of all tasks meet by item, in two steps, so that no task reads
   more than a share of an item's candidates.

Items come in blocks of ``ITEMS`` whose terms are sent to the tasks: that is
the bound of what is broadcast; more items mean more blocks, each over all
documents.
"""

from __future__ import annotations

import heapq
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyweft.llm.shared import cut

#: Documents returned for an item.
TOP = 50
#: Documents and postings of a window; items of a block, and distinct (item, term) pairs of it.
WINDOW, POSTINGS, ITEMS, PAIRS = 1 << 13, 1 << 21, 1 << 12, 1 << 20
#: Bytes of a long text that are cut into terms at once.
PIECE = 1 << 20
#: Parts an item's candidates are dealt into before they meet.
SALT = 64

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of UTF-8 text: separators become spaces, A-Z become a-z, bytes of other characters stay.
TABLE = bytes(ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))


def count_terms(text: bytes) -> Counter:
    """How often each term, in UTF-8, occurs; long texts are cut where a term ends."""
    text, at, found = text.translate(TABLE), 0, Counter()
    while len(text) - at > PIECE:
        end = text.find(b" ", at + PIECE)
        if end < 0:
            break
        found.update(text[at:end].split())
        at = end
    found.update((text[at:] if at else text).split())
    return found


def item_terms(items: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """item (a number of the row), item_id, terms: the distinct terms of each item, in order."""
    lowered = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    terms = F.array_sort(F.array_distinct(F.regexp_extract_all(lowered, F.lit(TERM), 0)))
    return items.select(F.monotonically_increasing_id().alias("item"), F.col(id_col).cast("long").alias("item_id"), terms.alias("terms"))


WINDOWS = "docs long, terms long, ids binary, known binary, lengths binary, found array<int>, df array<int>, places binary, often binary"


def _windows(vocabulary):
    """(id, text in UTF-8) rows to rows of WINDOWS; a window holds the documents that have a query term."""

    def row(docs: int, total: int, ids: list, lengths: list[int], posts: array) -> pa.RecordBatch:
        if posts:
            term, place, often = np.array(posts, np.int64).reshape(-1, 3).T
            order = np.argsort(term, kind="stable")
            found, df = np.unique(term, return_counts=True)
            place, often = place[order], often[order]
        else:
            found = df = place = often = np.empty(0, np.int64)
        known = np.array([i is not None for i in ids], np.uint8)
        values = [docs, total, np.array([i or 0 for i in ids], np.int64).tobytes(), known.tobytes(), np.array(lengths, np.int64).tobytes(), found.tolist(), df.tolist(), place.astype(np.uint16).tobytes(), often.astype(np.int64).tobytes()]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=[c.split()[0] for c in WINDOWS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(vocabulary.value)}
        docs, total, ids, lengths, posts = 0, 0, [], [], array("q")
        for batch in batches:
            for i, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py()
                counts = count_terms(text) if text else None
                if not counts:
                    continue
                n = counts.total()
                docs, total = docs + 1, total + n
                if len(counts) > len(number):
                    own = [v for t, k in number.items() if t in counts for v in (k, len(ids), counts[t])]
                else:
                    own = [v for t, c in counts.items() if t in number for v in (number[t], len(ids), c)]
                if own:
                    posts.extend(own)
                    ids.append(i.as_py())
                    lengths.append(n)
                    if len(ids) == WINDOW or len(posts) >= 3 * POSTINGS:
                        yield row(docs, total, ids, lengths, posts)
                        docs, total, ids, lengths, posts = 0, 0, [], [], array("q")
        if docs:
            yield row(docs, total, ids, lengths, posts)

    return run


def _scored(queries, top: int):
    """Rows of WINDOWS to (item, doc_id, score): a task's ``top`` documents of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight, n_docs, n_terms = queries.value
        heaps: list[list] = [[] for _ in items]
        sums, bits = np.zeros(WINDOW, np.int64), np.zeros(WINDOW // 8, np.uint8)
        for batch in batches:
            for w in batch.to_pylist():
                ids, known, lengths = np.frombuffer(w["ids"], np.int64), np.frombuffer(w["known"], np.uint8), np.frombuffer(w["lengths"], np.int64)
                if not len(ids):
                    continue
                place, often = np.frombuffer(w["places"], np.uint16), np.frombuffer(w["often"], np.int64)
                found, ends = np.array(w["found"]), np.cumsum(w["df"])
                m = 50 + (50 * lengths * n_docs) // n_terms
                part = np.repeat(weight[found], w["df"]) * ((1_000_000_000 * often) // (1000 * often + 20 * m[place]))
                posting, most = {}, np.zeros(len(weight), np.int64)
                for t, a, b in zip(found.tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    marks = np.zeros(WINDOW, bool)
                    marks[place[a:b]] = True
                    posting[t] = place[a:b], part[a:b], np.packbits(marks)
                    most[t] = part[a:b].max()
                for heap, terms in zip(heaps, items, strict=True):
                    least = heap[0][0] if len(heap) == top else 1
                    if most[terms].sum() < least:
                        continue
                    for t in terms[most[terms] > 0].tolist():
                        at, more, marks = posting[t]
                        sums[at] += more
                        bits |= marks
                    held = np.flatnonzero(np.unpackbits(bits))
                    score = sums[held]
                    sums[held] = 0
                    bits[:] = 0
                    held, score = held[score >= least], score[score >= least]
                    if len(held) > top:
                        # those below the top-th score cannot enter; ties with it all stay
                        edge = np.partition(score, -top)[-top]
                        held, score = held[score >= edge], score[score >= edge]
                    # of equal scores the smaller id is the better, no id is the worst
                    for s, k, i in zip(score.tolist(), known[held].tolist(), ids[held].tolist(), strict=True):
                        entry = s, k, -i
                        if len(heap) < top:
                            heapq.heappush(heap, entry)
                        elif entry > heap[0]:
                            heapq.heapreplace(heap, entry)
        for item, heap in enumerate(heaps):
            if heap:
                score, k, i = zip(*heap, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(heap), pa.int32()), pa.array([-x if y else None for x, y in zip(i, k, strict=True)], pa.int64()), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    return run


def weight(n: Column, df: Column) -> Column:
    """floor(1000 ln((2N + 2) / (2 df + 1)))."""
    return F.floor(1000 * F.log((2 * n + 2).cast("double") / (2 * df + 1).cast("double"))).cast("long")


def _best(found: DataFrame, top: int) -> DataFrame:
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    part = found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)))
    part = part.withColumn("rank", F.row_number().over(W.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= top)
    return part.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top).drop("part")


def _block(docs: DataFrame, items: list[tuple], top: int) -> DataFrame:
    """item_id, rank, doc_id, score for (item_id, terms) items."""
    spark = docs.sparkSession
    context = spark.sparkContext
    vocabulary = sorted({t for _, terms in items for t in terms})
    sent = context.broadcast([t.encode() for t in vocabulary])
    windows = cut(docs.mapInArrow(_windows(sent), WINDOWS), "windows")
    n_docs, n_terms = (v or 0 for v in windows.agg(F.sum("docs"), F.sum("terms")).first())
    pairs = windows.select(F.explode(F.arrays_zip("found", "df")).alias("x")).groupBy(F.col("x.found").alias("term")).agg(F.sum("x.df").alias("df"))
    weights = np.zeros(len(vocabulary), np.int64)
    for r in pairs.select("term", weight(F.lit(n_docs).cast("long"), F.col("df")).alias("w")).collect():  # a row for each query term of the block
        weights[r["term"]] = r["w"]
    number = {t: i for i, t in enumerate(vocabulary)}
    queries = context.broadcast(([np.array([number[t] for t in terms], np.int64) for _, terms in items], weights, n_docs, n_terms))
    found = windows.mapInArrow(_scored(queries, top), "item int, doc_id long, score long")
    ids = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(items)], "item int, item_id long")
    return _best(found, top).join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")


def _blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """(item_id, terms) of a block of items at a time."""
    block, pairs = [], 0
    for r in items.toLocalIterator():
        if block and (len(block) == ITEMS or pairs + len(r["terms"]) > PAIRS):
            yield block
            block, pairs = [], 0
        block.append((r["item_id"], r["terms"]))
        pairs += len(r["terms"])
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, *, top: int = TOP, doc_col: str = "doc_id", doc_text: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` best documents of each item with a score above 0.

    Equal scores rank by ascending id, rows without an id last.  Null and
    empty texts have no terms: such documents match nothing and such items
    get no rows.  Every row is a document or an item of its own: repeated rows
    and ids repeat in the ranking, each with a rank.  Empty tables give an
    empty result; texts of any length are counted whole, in pieces; other
    columns are not read.  Sums are 64-bit integers.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(doc_text).cast("binary").alias("text")).where("text IS NOT NULL")
    wanted = cut(item_terms(items, id_col=item_col, text_col=item_text).where(F.size("terms") > 0), "items")
    out = None
    for block in _blocks(wanted):
        found = _block(texts, block, top)
        found = found if out is None else cut(found, "ranked")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


#: The same ranking in SQL.
RANKING_SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS doc, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
d AS (SELECT doc, doc_id, terms, len(terms)::BIGINT AS n FROM t WHERE len(terms) > 0),
g AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM d),
q AS (
  SELECT item, item_id, unnest(terms) AS term FROM (
    SELECT row_number() OVER () AS item, item_id,
           list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS terms
    FROM benchmark)),
p AS (
  SELECT doc, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc, doc_id, n, unnest(terms) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, count(*)::BIGINT AS df FROM p GROUP BY term),
s AS (
  SELECT q.item, q.item_id, p.doc, p.doc_id,
         sum(floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT
             * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * big_n) // big_l))))::BIGINT AS score
  FROM p JOIN f USING (term) JOIN q USING (term), g GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id ASC NULLS LAST)::INT AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""
