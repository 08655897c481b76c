"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary text and one on toxic
text; both start from the same ordinary part, so they compress ordinary words
alike.  A text goes through in windows of a few words.  Each is compressed
under both, and the bytes that the toxic dictionary saves are its gain.  How
many windows reach each gain, and lose as much, goes through thresholds
calibrated on the labelled rows by a logistic regression; for that, each row
is compressed under dictionaries trained without it.

Labels are of documents, and most of a toxic document is ordinary.  So the
toxic dictionary is trained on what is left of the toxic texts without the
words that ordinary texts use about as often: runs of the words, or words of
the starts, that cover the toxic documents of the sample several times over
and are rare in its ordinary documents.  Compression matches their parts as
well, so unseen words built on the same stems gain as well.
"""

from __future__ import annotations

import heapq
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweft.llm.shared import cut

#: Bounds of the labelled sample: rows of each kind.
TOXIC_ROWS, ORDINARY_ROWS = 2000, 4000
#: Words of a window; bytes of the shared ordinary dictionary and of each dictionary's own part; lines that train each, and times as many tried for the ordinary part.
SPAN, SHARED, OWN, LINES, HARD = 2, 16_384, 1_024, 40_000, 5
#: A distinctive word: in so many toxic documents (of few, a thirtieth, 3 at least), and so much rarer in ordinary ones; each document is covered so often.
SUPPORT, RARER, COVER = 5, 0.05, 4
#: Bytes of a word's start that can be distinctive in its stead.
STEMS = (4, 5, 6)
#: Gains are counted from 1 to HIGH, losses up to LOW.
LOW, HIGH = 6, 10
FOLDS = 5
#: The part of the training sample that is all of it.
WHOLE = -1


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; rows of fold 0 are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


_LETTERS = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    """The text's runs of letters in lower case, in order."""
    return _LETTERS.findall((text or "").lower())


def windows(text: str | None) -> list[bytes]:
    """The words SPAN at a time, between spaces."""
    w = words(text)
    return [f" {' '.join(w[i : i + SPAN])} ".encode() for i in range(0, len(w), SPAN)]


@dataclass
class Pair:
    """The ordinary and the toxic dictionary; a few ten kilobytes.  ``pad`` ends each window, so that both lengths hold a match."""

    ordinary: bytes
    toxic: bytes
    pad: bytes
    _tools: tuple = field(default=(), repr=False, compare=False)

    def __getstate__(self):
        return {**self.__dict__, "_tools": ()}

    def gain(self, window: bytes) -> int:
        if not self._tools:
            self._tools = (_compressor(self.ordinary), _compressor(self.toxic))
        padded = window + self.pad
        return len(self._tools[0].compress(padded)) - len(self._tools[1].compress(padded))

    def gains(self, text: str | None) -> np.ndarray:
        """Bytes saved by the toxic dictionary, for each window of the text."""
        return np.array([self.gain(w) for w in windows(text)], np.int64)


@dataclass
class Model:
    """Dictionaries and calibration."""

    pair: Pair | None
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    prior: float = 0.0

    def score(self, text: str | None) -> float:
        if self.pair is None:
            return self.prior
        x = (features(self.pair.gains(text)) - self.mean) / self.scale
        return float(1 / (1 + np.exp(-np.clip(x @ self.weight[:-1] + self.weight[-1], -50, 50))))


def _compressor(content: bytes):
    import zstandard as z

    made = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
    how = z.ZstdCompressionParameters(
        window_log=15, hash_log=15, chain_log=15, search_log=5, min_match=5, target_length=32, strategy=z.STRATEGY_GREEDY,
        write_checksum=False, write_content_size=False, write_dict_id=False,
    )
    made.precompute_compress(compression_params=how)
    return z.ZstdCompressor(dict_data=made, compression_params=how)


def features(gains: np.ndarray) -> np.ndarray:
    """Windows that reach each gain (logarithm and share), those that lose at all and much, length, and the largest gain."""
    n = len(gains)
    counts = np.bincount(np.clip(gains, -LOW, HIGH) + LOW, minlength=LOW + HIGH + 1).astype(float)
    reach, lose = np.cumsum(counts[::-1])[::-1][LOW + 1 :], np.cumsum(counts)[LOW - 3 : LOW]
    return np.concatenate([np.log1p(reach), reach / max(1, n), np.log1p(lose), lose / max(1, n), [np.log1p(n), gains.max() if n else 0]])


def _stems(text: str) -> set[bytes]:
    """The text's distinct words, each with a space after it, and their first bytes."""
    found = {w.encode() for w in words(text)}
    return {w + b" " for w in found} | {w[:n] for w in found for n in STEMS if len(w) > n}


def _distinctive(toxic: list[str], ordinary: list[str]) -> list[bytes]:
    usual: Counter = Counter()
    for t in ordinary:
        usual.update(_stems(t))
    at = defaultdict(list)
    for i, t in enumerate(toxic):
        for w in _stems(t):
            at[w].append(i)
    least = int(np.clip(len(toxic) // 30, 3, SUPPORT))
    at = {w: v for w, v in at.items() if len(v) >= least and (usual[w] + 0.5) / (len(ordinary) + 1) < RARER * len(v) / len(toxic)}
    return _cover({w: v for w, v in at.items() if w.endswith(b" ")}, len(toxic), least) + _cover({w: v for w, v in at.items() if not w.endswith(b" ")}, len(toxic), least)


def _cover(at: dict[bytes, list[int]], n: int, least: int) -> list[bytes]:
    """Greedy choice of keys until each of n documents is covered COVER times, or none adds ``least`` - 1."""
    wanted, found = np.full(n, COVER), []
    queue = [(-len(v), w) for w, v in at.items()]
    heapq.heapify(queue)
    while queue:
        _, w = heapq.heappop(queue)
        gain = int((wanted[at[w]] > 0).sum())
        if gain < least - 1:
            continue
        if queue and gain < -queue[0][0]:
            heapq.heappush(queue, (-gain, w))
            continue
        found.append(w)
        wanted[at[w]] -= 1
    return found


def _left(toxic: list[str], distinctive: list[bytes]) -> list[bytes]:
    """The toxic texts without their ordinary words, a few words a line, in the texts' order."""
    whole = {w[:-1] for w in distinctive if w.endswith(b" ")}
    starts = tuple(w for w in distinctive if not w.endswith(b" "))
    lines = []
    for t in toxic:
        kept = [w for w in (w.encode() for w in words(t)) if w in whole or w.startswith(starts)]
        lines += [b" " + b" ".join(kept[i : i + 4]) + b" " for i in range(0, len(kept), 4)]
    return lines


def _trained(size: int, samples: list[bytes]) -> bytes:
    """A zstandard dictionary of ``size`` bytes; where the samples are too few to train one, their text itself."""
    import zstandard as z

    try:
        made = z.train_dictionary(size, samples, k=24, d=6).as_bytes()
    except z.ZstdError:
        made = b"".join(dict.fromkeys(samples))
    return made[-size:].rjust(size, b" ")


def dictionaries(toxic: list[str], ordinary: list[str], seed: int = 5) -> Pair:
    """The two dictionaries from texts of each kind."""
    rng = random.Random(seed)
    lines = [w for t in ordinary for w in windows(t)]
    rng.shuffle(lines)
    shared, own = _trained(SHARED, lines[:LINES]), _trained(OWN, lines[LINES : 2 * LINES] or lines)
    left = _left(toxic, _distinctive(toxic, ordinary)) or [w for t in toxic for w in windows(t)] or [b"  "]
    rng.shuffle(left)
    half = SHARED // 2
    hot, pad = _trained(OWN, left[:LINES]), shared[half : half + 32]
    # the ordinary part takes the ordinary lines that the toxic part would compress better, so that chance matches cancel
    trial = Pair(own + shared, hot + shared, pad)
    hard = [w for w in lines[: HARD * LINES] if trial.gain(w) >= 2]
    return Pair(_trained(OWN, hard or lines) + shared, hot + shared, pad)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -50, 50)))
        h = (a * (p * (1 - p))[:, None]).T @ a / len(a) + ridge * np.eye(len(w))
        w -= np.linalg.solve(h, a.T @ (p - y) / len(a) + ridge * w)
    return mean, scale, w


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Train on a bounded sample of labelled rows outside the held-out fold.

    The sample is chosen by a hash of the id, TOXIC_ROWS and ORDINARY_ROWS at
    most, of whole texts: its ids are few, so they are broadcast and only its
    texts are shuffled.  Null labels are no labels.  Three tasks train one pair
    of dictionaries each, on all rows and on either half; the halves calibrate
    each other's, on the executors.  With labels of one kind only, the score is
    that label.
    """
    known = labels.where(F.col(label_col).isNotNull() & (fold(F.col(id_col)) != 0)).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_y"))
    order = F.xxhash64("_id")
    chosen = known.where("_y = 1").orderBy(order).limit(TOXIC_ROWS).unionByName(known.where("_y = 0").orderBy(order).limit(ORDINARY_ROWS))
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    half = F.pmod(F.xxhash64("_id", F.lit("half")), F.lit(2)).cast("int")
    sample = cut(texts.join(F.broadcast(chosen), "_id").select("_id", F.coalesce("_text", F.lit("")).alias("_text"), F.col("_y").cast("int").alias("_y"), half.alias("_half")), "labelled")
    kinds = sorted(r["_y"] for r in sample.select("_y").distinct().collect())
    none = np.zeros(0)
    if len(kinds) < 2:
        return Model(None, none, none, none, float(kinds[0]) if kinds else 0.0)

    # part WHOLE has all rows, parts 0 and 1 those of either half; a task for each
    def trained(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["_id", "_text"])
        toxic, ordinary = (list(dict.fromkeys(frame["_text"][frame["_y"] == kind])) for kind in (1, 0))
        if not (toxic and ordinary):
            return pd.DataFrame({"part": [], "ordinary": [], "toxic": [], "pad": []})
        pair = dictionaries(toxic, ordinary)
        return pd.DataFrame({"part": [frame["_part"].iloc[0]], "ordinary": [pair.ordinary], "toxic": [pair.toxic], "pad": [pair.pad]})

    parts = sample.select("*", F.explode(F.array(F.lit(WHOLE), "_half")).alias("_part")).repartition(64, "_part")
    made = parts.groupBy("_part").applyInPandas(trained, "part int, ordinary binary, toxic binary, pad binary").collect()
    pairs = {r["part"]: Pair(bytes(r["ordinary"]), bytes(r["toxic"]), bytes(r["pad"])) for r in made}
    whole = pairs[WHOLE]
    other = [pairs.get(1, whole), pairs.get(0, whole)]

    def calibrated(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"y": f["_y"], "x": [features(other[h].gains(t)).tolist() for t, h in zip(f["_text"], f["_half"], strict=True)]})

    # copies of a text count once
    measured = sample.dropDuplicates(["_text", "_y", "_half"]).repartition(64, "_id").mapInPandas(calibrated, "y int, x array<double>").collect()
    measured = sorted((tuple(r["x"]), r["y"]) for r in measured)
    return Model(whole, *_logistic(np.array([x for x, _ in measured]), np.array([float(y) for _, y in measured])))


def score(model: Model, text: Column) -> Column:
    """A column of scores, 0 to 1; null texts count as empty."""

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series([model.score(t) for t in s], dtype=float)

    return scored(text)


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of each row, from its whole text alone.

    Null and empty texts get the score of a text without windows; a text of
    any length is scored in windows, one at a time; a null id is never held
    out; repeated rows repeat; an empty table gives an empty result; without
    labels of both kinds the score is constant.  Other columns are not read.
    """
    model = fit(docs, labels, id_col=id_col, text_col=text_col)
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(fold(F.col(id_col)) == 0, F.lit(False)).alias("held_out"), score(model, F.col(text_col)).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def reject(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, columns unchanged."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col)
    return docs.where(score(model, docs[text_col]) < 0.5)
