"""SentencePiece encoding and decoding (BPE models) by suffix-array matching.

A batch's texts fall into chunks, white-space marks followed by other
characters up to the line's end, which no piece of the model crosses.  The new distinct chunks of a
batch are concatenated and indexed by a suffix array over the first eight
characters of each suffix (four, if the batch has over 255 different ones).  A
binary search of every piece in it gives the range of its occurrences, within
which the rest of longer pieces is compared; these are the edges of the batch's lattice.  The edges are sorted
by position and relaxed: a merge is open while its ends still are boundaries
and exactly one boundary lies between them, and each round every chunk takes
its open merge of the best score, the leftmost of equals.  That is the order
in which the library's queue merges, so the pieces are the library's.
Characters outside the vocabulary become bytes.

A chunk's ids are kept in a bounded table of two generations, since chunks
recur.  Chunks of more than LONG characters (text without spaces) are matched
by a suffix array of their own; as rounds take one merge of a chunk each, their
edges are relaxed by a queue, in the same order.
"""

from __future__ import annotations

import gc
import heapq
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Chunks whose ids a worker keeps, characters of text encoded at once, of new chunks in a suffix array, and of a chunk whose edges are relaxed in rounds.
KEPT, BLOCK, MATCHED, LONG = 320_000, 1_500_000, 200_000, 256
#: Characters of the longest piece.
LONGEST = 16


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _ranges(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the ranges in turn, and the range of each."""
    size = stop - start
    of = np.repeat(np.arange(len(size)), size)
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size), of


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at, value, shift = at + 1, value | (byte & 127) << shift, shift + 7
            if byte < 128:
                return value

    while at < len(message):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(tag & 7)
        size = varint() if size is None else size
        yield tag >> 3, message[at : at + size]
        at += size


def check_model(proto: bytes) -> None:
    """Raises unless the model is a BPE of the kind that chunks can be encoded apart: no normalizer, a space in front, spaces kept and escaped, byte pieces.

    Fixed values: fields of the public model format, its trainer settings (2:
    type 3, spaces behind words 24, bytes 35) and normalizer settings (3: table of characters 2, space
    in front 3, spaces removed 4, spaces escaped 5), and type 2 for BPE.
    """
    parts = {k: dict(_fields(v)) for k, v in _fields(proto) if k in (2, 3)}
    trainer, normal = parts.get(2, {}), parts.get(3, {})
    kept = normal.get(3, 1) == 1 and normal.get(4, 1) == 0 and normal.get(5, 1) == 1
    if trainer.get(3, 1) != 2 or trainer.get(24, 0) or trainer.get(35, 0) != 1 or normal.get(2, b"") or not kept:
        raise ValueError("the model is no BPE with byte pieces that leaves characters and spaces as they are")


class Pieces:
    """A model's vocabulary, its suffix-array matcher and the table of chunks."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        check_model(model.serialized_model_proto())
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        self.byte = np.zeros(256, np.int32)
        self.raw = [b""] * n
        self.ids: dict[str, int] = {}
        for i, name in enumerate(names):
            if model.is_byte(i):
                self.byte[int(name[3:5], 16)] = i
                self.raw[i] = bytes([int(name[3:5], 16)])
            elif model.is_unknown(i):
                self.raw[i] = " ⁇ ".encode()
            elif not model.is_control(i):
                self.ids[name] = i
                self.raw[i] = name.encode()
        self.score = np.array([model.get_score(i) for i in range(n)])
        if any(MARK in name.lstrip(MARK) for name in self.ids) or max(map(len, self.ids)) > LONGEST:
            raise ValueError("pieces across white space, or longer than 16 characters, are not supported")
        letters = sorted({c for name in self.ids for c in name})
        top = max(map(ord, letters)) + 2
        self.letters = len(letters)
        self.symbol = np.zeros(top, np.int64)  # the last stands for all characters beyond
        self.single = np.full(top, -1, np.int32)
        for k, c in enumerate(letters):
            self.symbol[ord(c)] = k + 1
            self.single[ord(c)] = self.ids.get(c, -1)
        many = [(name, i) for name, i in self.ids.items() if len(name) > 1]
        self.many = np.array([i for _, i in many], np.int32)
        self.length = np.array([len(name) for name, _ in many], np.int32)
        order = np.lexsort((self.many, -self.score[self.many]))
        # equal scores have equal places
        place = np.cumsum(np.concatenate(([0], np.diff(self.score[self.many][order]) != 0)))
        self.place = np.empty(len(many), np.int64)
        self.place[order] = place
        self.rows = np.zeros((len(many), LONGEST), np.int64)
        for k, (name, _) in enumerate(many):
            self.rows[k, : len(name)] = self.symbol[[ord(c) for c in name]]
        self.whole_lines = any("\n" in name for name in self.ids)
        self.known: dict[str, tuple[int, ...]] = {}
        self.former: dict[str, tuple[int, ...]] = {}

    # --- suffix array -------------------------------------------------------------------------

    def occurrences(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start of each occurrence of each piece of several characters, and which piece.

        The batch's own symbols are renumbered, so that a word of 64 bits
        holds eight (four, if there are over 255).  The suffix array sorts by
        one word; a binary search in it gives the range of each piece's first
        word, and the rest of longer pieces is compared within the range.
        """
        own = np.flatnonzero(np.bincount(symbols, minlength=self.letters + 1))
        bits = 8 if len(own) <= 256 else 16
        depth, small = 64 // bits, np.full(self.letters + 1, -1, np.int64)
        small[own] = np.arange(len(own)) + (own[0] != 0)
        n, shifts = len(symbols), np.uint64(bits) * np.arange(depth - 1, -1, -1, dtype=np.uint64)
        s = np.zeros(n + 2 * LONGEST, np.uint64)
        s[:n] = small[symbols]
        packed = np.zeros(n + LONGEST, np.uint64)
        for k in range(depth):
            packed |= s[k : k + len(packed)] << shifts[k]
        suffix = np.argsort(packed[:n])
        sorted_ = packed[suffix]

        rows = small[self.rows]
        rows[self.rows == 0] = 0
        there = np.flatnonzero((rows >= 0).all(axis=1))
        rows, length = rows[there].astype(np.uint64), self.length[there]
        words = [(rows[:, w : w + depth] << shifts).sum(axis=1, dtype=np.uint64) for w in range(0, LONGEST, depth)]
        full = ~np.uint64(0)
        # the bits of a word behind the piece's end
        free = [np.where(length - w >= depth, np.uint64(0), full >> (np.uint64(bits) * np.clip(length - w, 0, depth - 1).astype(np.uint64))) for w in range(0, LONGEST, depth)]
        first, last = np.searchsorted(sorted_, words[0], "left"), np.searchsorted(sorted_, words[0] | free[0], "right")
        flat, piece = _ranges(first, np.maximum(first, last))
        start = suffix[flat]
        long = np.flatnonzero(length[piece] > depth)
        if len(long):
            keep = np.ones(len(start), bool)
            for w in range(1, len(words)):
                own_words = packed[start[long] + w * depth] | free[w][piece[long]]
                keep[long] &= own_words == (words[w] | free[w])[piece[long]]
            start, piece = start[keep], piece[keep]
        return start, there[piece]

    def segment(self, chunks: list[str]) -> list[tuple[int, ...]]:
        """The ids of each chunk."""
        text = "".join(chunks)
        code = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), len(self.symbol) - 1)
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        word = np.repeat(np.arange(len(chunks)), sizes)
        at = np.arange(len(code)) + word  # one empty symbol after each chunk
        n = len(code) + len(chunks)
        symbols, piece_at = np.zeros(n, np.int64), np.full(n, -2, np.int32)
        symbols[at], piece_at[at] = self.symbol[code], self.single[code]
        word_at = np.repeat(np.arange(len(chunks), dtype=np.int32), sizes + 1)
        start, piece = self.occurrences(symbols)
        by_position = np.argsort(start)
        start, piece = start[by_position].astype(np.int32), piece[by_position].astype(np.int32)
        stop, key = start + self.length[piece], (self.place[piece] << 32) | start
        edge, left = np.ones(n + 1, bool), np.arange(len(start), dtype=np.int32)
        while len(left):
            before = np.cumsum(edge, dtype=np.int32)
            a, b = start[left], stop[left]
            inner = before[b - 1] - before[a]
            alive = edge[a] & edge[b] & (inner > 0)
            left, open_ = left[alive], left[alive & (inner == 1)]
            if not len(open_):
                break
            own, keys = word_at[start[open_]], key[open_]
            turn = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            best = open_[keys == np.repeat(np.minimum.reduceat(keys, turn), np.diff(np.concatenate((turn, [len(open_)]))))]
            edge[np.flatnonzero(edge)[before[start[best]]]] = False
            piece_at[start[best]] = self.many[piece[best]]
            # chunks without an open merge are done
            going = np.zeros(len(chunks), bool)
            going[own] = True
            left = left[going[word_at[start[left]]]]
        heads = at[edge[at]]
        ids = piece_at[heads]
        ends = np.cumsum(np.bincount(word_at[heads], minlength=len(chunks))).tolist()
        flat = ids.tolist()
        out = [tuple(flat[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
        for c in np.unique(word_at[heads[ids < 0]]).tolist():
            out[c] = self._with_bytes(chunks[c], out[c])
        return out

    def _with_bytes(self, chunk: str, ids: tuple[int, ...]) -> tuple[int, ...]:
        """Ids below 0, single characters outside the vocabulary, as their bytes."""
        out, at = [], 0
        for i in ids:
            if i >= 0:
                out.append(i)
                at += len(self.raw[i].decode())
            else:
                out += self.byte[list(chunk[at].encode("utf-8", "replace"))].tolist()
                at += 1
        return tuple(out)

    def queued(self, chunk: str) -> tuple[int, ...]:
        """A long chunk's ids: its edges as matched by the suffix array, relaxed by a queue in n log n steps."""
        code = np.minimum(np.frombuffer(chunk.encode("utf-32-le", "surrogatepass"), np.uint32), len(self.symbol) - 1)
        start, piece = self.occurrences(self.symbol[code])
        edges = dict(zip(zip(start.tolist(), (start + self.length[piece]).tolist(), strict=True), zip(self.place[piece].tolist(), self.many[piece].tolist(), strict=True), strict=True))
        n = len(chunk)
        # of the token that starts at a place: its end and id; of the one that ends there: its start
        stop, ids, begin = list(range(1, n + 1)), self.single[code].tolist(), list(range(-1, n))
        queue: list[tuple[int, int, int, int]] = []

        def offer(a: int, middle: int, b: int) -> None:
            if (edge := edges.get((a, b))) is not None:
                heapq.heappush(queue, (edge[0], a, middle, b))

        for a in range(n - 1):
            offer(a, a + 1, a + 2)
        while queue:
            _, a, middle, b = heapq.heappop(queue)
            if stop[a] != middle or stop[middle] != b:
                continue
            stop[a], begin[b], ids[a], stop[middle] = b, a, edges[a, b][1], -1
            if a:
                offer(begin[a], a, b)
            if b < n:
                offer(a, b, stop[b])
        out: list[int] = []
        a = 0
        while a < n:
            out += [ids[a]] if ids[a] >= 0 else self.byte[list(chunk[a].encode("utf-8", "replace"))].tolist()
            a = stop[a]
        return tuple(out)

    # --- texts --------------------------------------------------------------------------------

    _runs = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

    def chunks(self, text: str) -> list[str]:
        """The text after escaping: a mark in front and for each space, cut before each run of
        marks, and around line ends where no piece holds one."""
        if not text:
            return []
        t = MARK + text.replace(" ", MARK)
        if MARK + MARK in t:
            return [c for line in self._lines(t) for c in self._runs.findall(line)]
        return [c for line in self._lines(t) for c in self._whole(line)]

    def _lines(self, t: str) -> list[str]:
        if self.whole_lines or "\n" not in t:
            return [t]
        lines = t.split("\n")
        return [x for line in lines[:-1] for x in (line, "\n")] + lines[-1:]

    @staticmethod
    def _whole(line: str) -> list[str]:
        """Chunks of a line without two marks on end."""
        first, *rest = line.split(MARK)
        return ([first] if first else []) + [MARK + x for x in rest]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text."""
        cut = [self.chunks(t) for t in texts]
        if len(self.known) > KEPT // 2:
            # the younger half becomes the older; chunks that recur are taken over from it
            self.former, self.known = self.known, {}
        new = []
        for c in set().union(*cut):
            if c not in self.known:
                ids = self.former.get(c)
                if ids is None:
                    new.append(c)
                else:
                    self.known[c] = ids
        part, held = [], 0
        for c in new:
            if len(c) <= LONG:
                part.append(c)
                held += len(c)
                if held >= MATCHED:
                    self.known.update(zip(part, self.segment(part), strict=True))
                    part, held = [], 0
        if part:
            self.known.update(zip(part, self.segment(part), strict=True))
        self.known.update((c, self.queued(c)) for c in new if len(c) > LONG)
        known = self.known.__getitem__
        return [list(chain.from_iterable(map(known, parts))) for parts in cut]

    def decode(self, ids: list[int]) -> str:
        """The text of the ids: bytes joined, marks as spaces, the mark in front dropped."""
        raw = self.raw
        text = b"".join([raw[i] for i in ids]).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


def _blocks(texts: Iterable[str | None]) -> Iterator[list[str]]:
    block, held = [], 0
    for t in texts:
        block.append(t or "")
        held += len(t or "")
        if held >= BLOCK:
            yield block
            block, held = [], 0
    if block:
        yield block


def _encoder(path: str, check: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # many tuples are kept and none lies on a cycle: searching them for cycles is idle work
        gc.disable()
        try:
            yield from encoded(batches)
        finally:
            gc.enable()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        for batch in batches:
            done = 0
            for block in _blocks(t.as_py() for t in batch.column(1)):
                ids = pieces.encode(block)
                sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                flat = np.concatenate([np.array(x, np.int32) for x in ids])
                tokens = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(flat, pa.int32()))
                columns = [batch.column(0).slice(done, len(block)), pa.array(sizes, pa.int64()), tokens]
                if check:
                    columns.append(pa.array([pieces.decode(x) == t.replace(MARK, " ") for x, t in zip(ids, block, strict=True)], pa.bool_()))
                done += len(block)
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "token_ids", "restored"][: len(columns)])

    return run


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, check: bool = False) -> DataFrame:
    """doc_id, n_tokens, token_ids of each row; with ``check`` also whether decoding restores the text.

    One narrow pass.  Null and empty texts have no ids, repeated rows repeat,
    other columns are not read, an empty table gives an empty result.  A mark
    character in a text encodes as the library has it, like a space.  A text
    of any length is encoded whole; a worker holds one block of texts at a time,
    and the matches of one long chunk.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(_encoder(path or default_model(), check), "doc_id long, n_tokens long, token_ids array<int>" + ", restored boolean" * check)


def decode(encoded: DataFrame, *, id_col: str = "doc_id", ids_col: str = "token_ids", path: str | None = None) -> DataFrame:
    """doc_id and text of each row of ids; null ids give an empty text."""
    at = path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(at)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pieces.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("token_ids")).mapInArrow(run, "doc_id long, text string")
