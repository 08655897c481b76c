"""Token counts by distinct pre-token.

The pieces of a byte-level BPE never cross a pre-token, so the count of a text
is the sum over its distinct pre-tokens of frequency times pieces.

1. Each task cuts its texts into pre-tokens and writes, for each pre-token of
   a block of documents, the documents and frequencies it has there.
2. The pre-tokens of all blocks are made distinct, and the pieces of each are
   counted once.
3. The counts are joined to the frequencies.  The HOT most frequent short
   pre-tokens, a table of bounded size, are broadcast, so the rows of frequent
   ones are not shuffled; the others meet their counts by a shuffle.
4. What the joined rows add to each document is summed in each task and then
   by document.  No list of token ids is ever made.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweft.llm.shared import cut

#: Characters and documents of a block, whose frequencies are held at once (a document's place in it fits two bytes); characters beyond which a text is cut one match at a time.
CHUNK, DOCS, LONG = 8_000_000, 1 << 16, 1_000_000
#: Pre-tokens that are broadcast with their counts, and characters they have at most.
HOT, SHORT = 1 << 17, 32
#: Documents whose sums a task holds.
HELD = 1 << 21
#: Pre-tokens of a batch.
BATCH = 20_000


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Counts:
    """Pre-tokens, and piece counts of pre-tokens, of one tokenizer file: a byte-level BPE with the usual pattern.

    Any other kind of tokenizer raises, as its pieces could cross pre-tokens
    or its pre-tokens be others.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        first, model = made.get("pre_tokenizer") or {}, made["model"]
        if first.get("type") != "ByteLevel" or first.get("add_prefix_space") or not first.get("use_regex", True) or made.get("normalizer") or model.get("type") != "BPE":
            raise ValueError(f"{path} is no byte-level BPE without a normalizer and a prefix space")
        self.model = Tokenizer.from_file(path).model
        self.special = [t["content"] for t in made.get("added_tokens") or [] if t["content"]]
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        # the characters that stand for bytes: printable ones for themselves, others from 256 on
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        others = [b for b in range(256) if b not in plain]
        self.shown = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}

    def frequencies(self, text: str) -> Counter:
        """How often each pre-token occurs in the text; special strings are pre-tokens of their own."""
        found: Counter = Counter()
        some = any(s in text for s in self.special)
        for part in self.at_special.split(text) if some else [text]:
            if some and part in self.special:
                found[part] += 1
            else:
                found.update(self.pattern.findall(part) if len(part) <= LONG else (m.group() for m in self.pattern.finditer(part)))
        return found

    def pieces(self, word: str) -> int:
        """Tokens of one pre-token."""
        return 1 if word in self.special else len(self.model.tokenize(word.encode().decode("latin-1").translate(self.shown)))


def _binary(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column: row i has sizes[i] of the values."""
    ends = np.concatenate(([0], np.cumsum(sizes) * values.itemsize)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


_SPREAD = "part int, row int, doc_id long, n_bytes long, unit string, rows binary, times binary"


def _spread(path: str):
    """Rows of documents (part, row, doc_id, n_bytes), and of pre-tokens in a block of documents (part, row of the
    block's first document, unit, places of the documents in the block, times in each or nothing where all are one)."""
    kinds = pa.schema([("part", pa.int32()), ("row", pa.int32()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("unit", pa.string()), ("rows", pa.binary()), ("times", pa.binary())])

    def batch(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[k.name] if k.name in columns else pa.nulls(n, k.type) for k in kinds], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, part = Counts(path), TaskContext.get().partitionId()
        at, chars, names, ids, times, sizes, first = 0, 0, {}, [], [], [], 0

        def block() -> Iterator[pa.RecordBatch]:
            if names:
                own, n = np.concatenate(ids), len(names)
                order = np.argsort(own, kind="stable")
                place, often, size = np.repeat(np.arange(len(sizes)), sizes).astype(np.uint16)[order], np.concatenate(times)[order], np.bincount(own, minlength=n)
                more = np.maximum.reduceat(often, np.cumsum(size) - size) > 1
                often, told = often[np.repeat(more, size)], np.where(more, size, 0)
                ends, told_ends, units = np.concatenate(([0], np.cumsum(size))), np.concatenate(([0], np.cumsum(told))), list(names)
                for i in range(0, n, BATCH):
                    j = min(n, i + BATCH)
                    yield batch(
                        j - i, part=pa.array(np.full(j - i, part, np.int32)), row=pa.array(np.full(j - i, first, np.int32)), unit=pa.array(units[i:j], pa.string()),
                        rows=_binary(place[ends[i] : ends[j]], size[i:j]), times=_binary(often[told_ends[i] : told_ends[j]], told[i:j]),
                    )

        for b in batches:
            n_bytes = []
            for text in b.column(1):
                text = text.as_py() or ""
                n_bytes.append(len(text.encode()))
                found = counts.frequencies(text)
                ids.append(np.fromiter((names.setdefault(w, len(names)) for w in found), np.int32, len(found)))
                times.append(np.fromiter(found.values(), np.int32, len(found)))
                sizes.append(len(found))
                chars += len(text)
                if chars >= CHUNK or len(sizes) == DOCS:
                    yield from block()
                    first, chars, names, ids, times, sizes = first + len(sizes), 0, {}, [], [], []
            n = b.num_rows
            yield batch(n, part=pa.array(np.full(n, part, np.int32)), row=pa.array(np.arange(at, at + n, dtype=np.int32)), doc_id=b.column(0), n_bytes=pa.array(n_bytes, pa.int64()))
            at += n
        yield from block()

    return run


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(path)
        for b in batches:
            pieces = [counts.pieces(w.as_py()) for w in b.column(0)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pieces, pa.int64())], names=["unit", "weight", "pieces"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, row, n) from rows (part, row, rows, times, pieces): what they add to each document, summed within the task."""
    held: dict[int, np.ndarray] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for part, n in held.items():
            row = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), part, np.int32)), pa.array(row.astype(np.int32)), pa.array(n[row])], names=["part", "row", "n"])

    for b in batches:
        parts, pieces = b.column(0).to_numpy(), b.column(4).to_numpy()
        for part in np.unique(parts):
            own = np.flatnonzero(parts == part)
            took = b.take(pa.array(own))
            rows, times = took.column(2).to_pylist(), took.column(3).to_pylist()
            size, told = np.array([len(x) // 2 for x in rows]), np.array([len(x) > 0 for x in times])
            row = np.frombuffer(b"".join(rows), np.uint16) + np.repeat(took.column(1).to_numpy(), size)
            often = np.ones(len(row), np.int64)
            often[np.repeat(told, size)] = np.frombuffer(b"".join(times), np.int32)
            total = np.bincount(row, often * np.repeat(pieces[own], size)).astype(np.int64)
            was = held.get(part, np.zeros(0, np.int64))
            if len(was) < len(total):
                was, total = total, was
            was[: len(total)] += total
            held[part] = was
        if sum(map(len, held.values())) > HELD:
            yield from out()
            held = {}
    yield from out()


def token_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of ``docs``.

    A null text counts as empty: 0 bytes, 0 tokens.  A text of any length is
    counted whole.  A null id stays null, repeated rows give repeated rows,
    other columns are not read, an empty table gives an empty result.  Special
    strings inside a text count as the tokenizer's own default has it (one
    token).
    """
    path = path or byte_bpe_path()
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    spread = cut(narrow.mapInArrow(_spread(path), _SPREAD), "pretokens")
    units = spread.where("unit is not null").select("unit", "part", "row", "rows", "times")
    distinct = units.groupBy("unit").agg(F.sum(F.length("rows")).alias("weight"))
    counts = cut(distinct.mapInArrow(_counted(path), "unit string, weight long, pieces long"), "pieces")
    # HOT rows of SHORT characters at most
    hot = F.broadcast(counts.where(F.length("unit") <= SHORT).orderBy(F.desc("weight"), "unit").limit(HOT).select("unit", "pieces"))
    tagged = units.join(hot, "unit", "left")
    near = tagged.where("pieces is not null").select("part", "row", "rows", "times", "pieces")
    far = tagged.where("pieces is null").drop("pieces").join(counts.select("unit", "pieces"), "unit").select("part", "row", "rows", "times", "pieces")
    add = "part int, row int, n long"
    sums = near.mapInArrow(_summed, add).unionByName(far.mapInArrow(_summed, add)).groupBy("part", "row").agg(F.sum("n").alias("n_tokens"))
    named = spread.where("unit is null").select("part", "row", "doc_id", "n_bytes").join(sums, ["part", "row"], "left")
    n_tokens = F.coalesce("n_tokens", F.lit(0).cast("long"))
    return named.select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))
