"""Toxicity by compression distance under two zstandard dictionaries.

Both dictionaries come from zstandard's own trainer: one from windows of ordinary
documents, one from the short windows of toxic documents around words that those hold
far more often. Every whole text is cut into windows of WINDOW_WORDS words; each is
compressed with the ordinary dictionary alone and with the toxic one before it, and
the difference of the two lengths says how much closer it is to toxic text. Counts of
windows over several thresholds, and the largest differences, give a document's
figures; a logistic model calibrates them.

Labels are learnt from a bounded sample: at most MAX_DOCS documents per class (in
expectation; picked by a hash of the id), of at most MAX_CHARS characters each; part
of it trains the dictionaries, the rest the calibration, weighted to the true class
sizes. Scoring takes the text alone, in whole. Null and empty texts are scored as one
empty window. Without labels of both classes, or in an empty table, the score is the
share of toxic labels (0 without any). A sample too small for the trainer is used as
it is. Repeated rows and ids are scored row by row; rows without an id are not held
out and teach nothing. Extra columns play no part, or stay as they are in
``drop_toxic``.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_lists

MAX_DOCS = 4000
MAX_CHARS = 20_000
WINDOW_WORDS = 16
#: Sizes of the ordinary and the toxic dictionary; together they fit into the compressor's window.
ORDINARY_BYTES, TOXIC_BYTES = 110_000, 16_384
#: Words on either side of a marked word in a toxic training window.
AROUND = 1
#: A word is marked if toxic training texts hold it this much more often, and this share of them does.
LEAST_LOG_ODDS, LEAST_SHARE = 3.5, 0.02
#: Differences in bytes from which a window counts.
THRESHOLDS = (2, 3, 4, 5, 6, 8)
#: Ordinary windows that train a dictionary.
TRAINING_WINDOWS = 200_000
_GAP = re.compile(r"[\W_]+")


def words_of(text: str | None) -> list[str]:
    return _GAP.sub(" ", (text or "").lower()).split()


def windows(text: str | None, size: int = WINDOW_WORDS) -> list[bytes]:
    words = words_of(text)
    return [(" " + " ".join(words[i:i + size]) + " ").encode() for i in range(0, max(1, len(words)), size)]


def marked_windows(texts: list[str], toxic: list[int]) -> list[bytes]:
    """Windows of toxic texts around words that toxic texts hold far more often; equal texts count once."""
    seen, n = (Counter(), Counter()), [0, 0]
    for text, y in dict(zip(texts, toxic)).items():
        seen[y].update(set(words_of(text)))
        n[y] += 1
    least = max(3, LEAST_SHARE * n[1])
    odds = lambda w: math.log((seen[1][w] + 0.5) / n[1]) - math.log((seen[0][w] + 0.5) / n[0])
    marked = {w for w, c in seen[1].items() if c >= least and odds(w) > LEAST_LOG_ODDS}
    out = []
    for text, y in zip(texts, toxic):
        words = words_of(text) if y else []
        out += [(" " + " ".join(words[max(0, i - AROUND):i + AROUND + 1]) + " ").encode() for i, w in enumerate(words) if w in marked]
    return out


def train(samples: list[bytes], size: int, segment: int, gram: int) -> bytes:
    """A dictionary by zstandard's cover trainer; the samples themselves where they are too few for it."""
    import zstandard as zstd

    try:
        return zstd.train_dictionary(size, samples, k=segment, d=gram).as_bytes()
    except zstd.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


def train_dictionaries(texts: list[str], toxic: list[int]) -> tuple[bytes, bytes]:
    """(ordinary, toxic) dictionaries."""
    ordinary = [w for text, y in zip(texts, toxic) if not y for w in windows(text, 2)]
    ordinary.sort(key=zlib.crc32)
    return train(ordinary[:TRAINING_WINDOWS], ORDINARY_BYTES, 64, 8), train(marked_windows(texts, toxic), TOXIC_BYTES, 16, 6)


class Distances:
    def __init__(self, dictionaries: tuple[bytes, bytes]):
        import zstandard as zstd

        ordinary, toxic = dictionaries
        params = zstd.ZstdCompressionParameters(
            strategy=zstd.STRATEGY_LAZY2, min_match=4, search_log=5, window_log=18, hash_log=16, chain_log=16,
            write_content_size=False, write_dict_id=False)
        # the filler keeps the ordinary content at equal distances on both sides
        self._sides = [
            zstd.ZstdCompressor(dict_data=zstd.ZstdCompressionDict(d, dict_type=zstd.DICT_TYPE_RAWCONTENT), compression_params=params)
            for d in (b"\x01" * len(toxic) + ordinary, toxic + ordinary)]

    def features(self, texts: list[str | None]) -> np.ndarray:
        """One row of figures per text, from the whole of it."""
        cut = [windows(t) for t in texts]
        flat = [w for ws in cut for w in ws]
        ordinary, both = (np.array([len(x) for x in side.multi_compress_to_buffer(flat, threads=0)]) for side in self._sides)
        gain, at, out = ordinary - both, 0, []
        for ws in cut:
            d = np.sort(gain[at:at + len(ws)])[::-1]
            at += len(ws)
            n = len(d)
            row = [*d[:4], *[0] * (4 - len(d[:4])), d.mean(), math.log1p(n)]
            for t in THRESHOLDS:
                over = int((d >= t).sum())
                row += [math.log1p(over), over / math.sqrt(n), over / n]
            out.append(row)
        return np.array(out, float).reshape(len(texts), -1)


@dataclass
class Model:
    dictionaries: tuple[bytes, bytes] | None
    weights: np.ndarray | None
    prior: float

    def scorer(self) -> Callable[[list[str | None]], np.ndarray]:
        if self.dictionaries is None or self.weights is None:
            return lambda texts: np.full(len(texts), self.prior)
        distances, weights = Distances(self.dictionaries), self.weights

        def score(texts: list[str | None]) -> np.ndarray:
            x = distances.features(texts)
            return 1 / (1 + np.exp(-np.clip(np.c_[x, np.ones(len(x))] @ weights, -30, 30)))

        return score


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps, for raw figures and a constant."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    a = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    ridge = np.r_[np.full(x.shape[1], 1.0), 1e-6]
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(ridge), a.T @ (weight * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    slope = w[:-1] / scale
    return np.r_[slope, w[-1] - slope @ mean]


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit_rows(texts: list[str], toxic: list[int], sizes: dict[int, int]) -> Model:
    """Model from these texts in a random order, for classes of these true sizes."""
    prior = sizes.get(1, 0) / max(1, sum(sizes.values()))
    part = [[k for k in range(len(texts)) if (k % 5 < 3) == first] for first in (True, False)]
    if any({toxic[k] for k in ks} != {0, 1} for ks in part):
        return Model(None, None, prior)
    dictionaries = train_dictionaries(*([x[k] for k in part[0]] for x in (texts, toxic)))
    y = np.array([toxic[k] for k in part[1]], float)
    share = np.where(y == 1, sizes[1] / max(1, (y == 1).sum()), sizes[0] / max(1, (y == 0).sum()))
    x = Distances(dictionaries).features([texts[k] for k in part[1]])
    return Model(dictionaries, calibrate(x, y, share * len(y) / share.sum()), prior)


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> Model:
    """Model from labelled documents that are not held out; see the module for the bounds."""
    marked = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id"))).select("doc_id", "toxic").dropDuplicates(["doc_id"])
    sizes = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = {y: min(1.0, max_docs / max(1, n)) for y, n in sizes.items()}
    ticket = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    picked = marked.filter(ticket < F.when(F.col("toxic") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0)))
    # the picked labels are about 2 x max_docs rows whatever the corpus, so the texts stay where they are
    known = docs.select("doc_id", "text").filter(F.length("text") <= MAX_CHARS).join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"])
    rows = sorted(known.collect(), key=lambda r: (r["toxic"], zlib.crc32(str(r["doc_id"]).encode())))
    return fit_rows([r["text"] for r in rows], [r["toxic"] for r in rows], sizes)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scored = shared.value.scorer()
        return lambda part: {"doc_id": part["doc_id"], "score": scored(part["text"])}

    return map_lists(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), make, "doc_id long, score double", 128)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns, in one pass over the texts."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scored = shared.value.scorer()
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                yield part.filter(pa.array(scored(part["text"].to_pylist()) < threshold))

    return docs.mapInArrow(run, docs.schema)
