"""Language of texts by averaged hashed subword embeddings and a linear softmax.

A text becomes lower-case letters with one space between words. Its subwords are all runs
of one to MAX_GRAM characters that hold no space but at their ends, so that beginnings and
ends of words are told apart. Each is hashed into one of BUCKETS embeddings of DIM
numbers; the text is their mean, and a linear layer with a softmax gives the language.
Embeddings and layer are trained together by stochastic gradient descent in numpy. At
prediction the layer is multiplied into the embeddings once, so a text costs one look-up
and one addition per subword, in blocks of BLOCK characters whatever its length.

Rejection is calibrated on documents that trained nothing: a temperature makes the score
the share of right answers, and ``accepted`` says that the score reaches the least
threshold above which the share TARGET of the calibration pieces is right. The prediction
itself is given either way.

Learnt from a bounded sample: MAX_DOCS documents per language in expectation, picked by a
hash of the id, of each PIECE_CHARS-long pieces at hashed places. Everything else, the
scoring above all, covers every text in whole. Only ids whose crc32 modulo 4 is not 2
teach, and only with a language; ``lang``, source and id are no inputs of a prediction.

Null texts and texts without a letter get ``und`` and score 0, as does every text where no
language could be learnt (no labelled rows, an empty table gives no rows). Texts of very
few letters are predicted like any other, with the low score they have. Ties of two
languages go to the first in alphabetical order. Repeated rows and ids are predicted row
by row; rows without an id are not held out and teach nothing. Further columns play no
part, whatever their names.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_lists

BUCKETS = 1 << 17
DIM = 16
MAX_GRAM = 4
#: Sample: documents per language (in expectation) and the lengths of the pieces taken from each.
MAX_DOCS = 800
PIECE_CHARS = (240, 80, 24)
#: Training: steps, texts a step and the first step size, which falls to zero linearly; small samples are passed more often.
STEPS, STEP_TEXTS, RATE = 1800, 32, 0.5
#: Share of right answers among the accepted calibration pieces.
TARGET = 0.995
BLOCK = 1 << 19
UNKNOWN = "und"
_SPACE = 32


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or a space."""
    table = np.full(0x110000, _SPACE, np.uint32)
    for code in range(0x110000):
        sign = chr(code)
        if sign.isalpha():
            low = sign.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


def spell(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts with one space before each word and one at the end, start of each text and the end).

    Of a run of spaces the last stays, so that the space before a text's first word is its own.
    """
    codes = _letters()[np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le"), "<u4")]
    space = codes == _SPACE
    keep = np.ones(len(codes), bool)
    keep[:-1] = ~(space[:-1] & space[1:])
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    before = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(keep, out=before[1:])
    return codes[keep], before[at]


def subwords(codes: np.ndarray, count: int):
    """Per length: (places under ``count`` at which a subword starts, its bucket)."""
    word = codes != _SPACE
    mixed = codes.astype(np.uint32)
    for n in range(1, MAX_GRAM + 1):
        if n > 1:
            if n > len(codes):
                return
            mixed = mixed[:len(codes) - n + 1] * np.uint32(0x01000193) ^ codes[n - 1:] * np.uint32(0x9E3779B1)
        ok = word[:len(mixed)].copy() if n == 1 else np.ones(len(mixed), bool)
        for inner in range(1, n - 1):
            ok &= word[inner:inner + len(mixed)]
        places = np.flatnonzero(ok[:count])
        h = mixed[places] + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(13)
        yield places, (h & np.uint32(BUCKETS - 1)).astype(np.int64)


def _summed(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the rows from each bound to the next."""
    out = np.zeros((len(bounds) - 1, values.shape[1]), values.dtype)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        out[full] = np.add.reduceat(values[:bounds[-1]], bounds[full], axis=0)
    return out


@dataclass
class Model:
    languages: list[str]
    #: Embeddings times layer, one row a bucket, divided by the temperature; the layer's bias likewise.
    votes: np.ndarray
    bias: np.ndarray
    threshold: float

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(logits, number of letters) of each text."""
        codes, starts = spell(texts)
        sums, n, letters = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for low in range(0, len(codes), BLOCK):
            window = codes[low:low + BLOCK + MAX_GRAM - 1]
            first, last = np.searchsorted(starts, low, "right") - 1, np.searchsorted(starts, low + BLOCK, "left")
            inside = slice(max(0, first), min(last, len(texts)))
            edges = np.clip(starts[inside.start:inside.stop + 1] - low, 0, BLOCK)
            for length, (places, buckets) in enumerate(subwords(window, BLOCK), 1):
                bounds = np.searchsorted(places, edges)
                sums[inside] += _summed(self.votes[buckets], bounds)
                n[inside] += np.diff(bounds)
                if length == 1:
                    letters[inside] += np.diff(bounds)
        return sums / np.maximum(n, 1)[:, None] + self.bias, letters

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """(language, score, accepted) of each text."""
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts), [False] * len(texts)
        z, letters = self.logits([t or "" for t in texts])
        p = softmax(z)
        best, known = p.argmax(axis=1), letters > 0
        score = np.where(known, p[np.arange(len(texts)), best], 0.0)
        return ([self.languages[b] if k else UNKNOWN for b, k in zip(best, known)], score.tolist(), (known & (score >= self.threshold)).tolist())


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def descend(texts: list[str], y: np.ndarray, n_classes: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(embeddings, layer, bias) by stochastic gradient descent on the cross entropy."""
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = np.zeros((DIM, n_classes), np.float32), np.zeros(n_classes, np.float32)
    bags = []
    for text in texts:
        codes, _ = spell([text])
        found = [b for _, b in subwords(codes, len(codes))]
        bags.append(np.concatenate(found) if found else np.zeros(0, np.int64))
    usable = np.flatnonzero([len(b) > 0 for b in bags])
    done = 0
    while done < STEPS and len(usable):
        order = rng.permutation(usable)
        for low in range(0, len(order), STEP_TEXTS):
            if done == STEPS:
                break
            rows = order[low:low + STEP_TEXTS]
            rate = np.float32(RATE * (1 - done / STEPS))
            done += 1
            sizes = np.array([len(bags[r]) for r in rows])
            flat = np.concatenate([bags[r] for r in rows])
            mean = np.add.reduceat(emb[flat], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0) / sizes[:, None].astype(np.float32)
            wrong = softmax(mean @ layer + bias)
            wrong[np.arange(len(rows)), y[rows]] -= 1
            # each text takes a whole step along its own gradient, as in descent text by text
            back = (wrong @ layer.T) / sizes[:, None].astype(np.float32)
            layer -= rate * (mean.T @ wrong)
            bias -= rate / STEP_TEXTS * wrong.sum(axis=0)
            by = np.argsort(flat, kind="stable")
            put = flat[by]
            heads = np.flatnonzero(np.concatenate([[True], put[1:] != put[:-1]]))
            emb[put[heads]] -= rate * np.add.reduceat(np.repeat(back, sizes, axis=0)[by], heads, axis=0)
    return emb, layer, bias


def fit_rows(texts: list[str], languages: list[str], calibrates: list[bool], target: float = TARGET) -> Model:
    """Model from pieces; those marked ``calibrates`` set the temperature and the threshold only."""
    names = sorted(set(languages))
    if not names:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    y, apart = np.array([names.index(x) for x in languages]), np.array(calibrates, bool)
    if apart.all() or not apart.any():
        apart[:] = False
    emb, layer, bias = descend([t for t, c in zip(texts, apart) if not c], y[~apart], len(names))
    raw = Model(names, emb.astype(np.float64) @ layer.astype(np.float64), bias.astype(np.float64), 0.0)
    held = np.flatnonzero(apart) if apart.any() else np.arange(len(texts))
    z, letters = raw.logits([texts[i] for i in held])
    z, truth = z[letters > 0], y[held][letters > 0]
    if not len(truth):
        return raw
    heat = np.exp(np.linspace(-4, 3, 141))
    loss = [-np.log(np.maximum(softmax(z / t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in heat]
    t = heat[int(np.argmin(loss))]
    p = softmax(z / t)
    score, right = p.max(axis=1), p.argmax(axis=1) == truth
    order = np.argsort(-score, kind="stable")
    enough = np.flatnonzero(np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= target)
    threshold = float(score[order][enough[-1]]) if len(enough) else 1.0
    return Model(names, raw.votes / t, raw.bias / t, threshold)


def fit(docs: DataFrame, max_docs: int = MAX_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Model from the labelled rows that are not held out; the driver sees the sample's pieces and one count a language."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter(
        "doc_id is not null and lang is not null").filter(~held_out(F.col("doc_id")))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not sizes:
        return fit_rows([], [], [])
    share = F.create_map(*(F.lit(x) for r in sizes for x in (r["lang"], min(1.0, max_docs / r["n"]))))
    ticket = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    picked = rows.filter((ticket < F.element_at(share, F.col("lang"))) & (F.length("text") > 0))
    place = lambda k, size: F.lit(1) + F.pmod(F.xxhash64("doc_id", F.lit(k)), F.greatest(F.length("text") - size, F.lit(0)).cast("long") + 1).cast("int")
    cut = F.struct("lang", *(F.substring("text", place(k, size), F.lit(size)).alias(f"p{k}") for k, size in enumerate(PIECE_CHARS)))
    # one row an id, so that an id of many rows does not outgrow the bound
    pieces = picked.groupBy("doc_id").agg(F.min(cut).alias("c")).select("doc_id", "c.*").collect()
    flat = sorted((r["doc_id"], r["lang"], r[f"p{k}"]) for r in pieces for k in range(len(PIECE_CHARS)))
    fold = [zlib.crc32(str(d).encode()) // 4 % 5 == 0 for d, _, _ in flat]
    return fit_rows([t for _, _, t in flat], [x for _, x, _ in flat], fold)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, accepted of every row, by its whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value

        def step(part: dict[str, list]) -> dict[str, list]:
            out: tuple[list, list, list] = ([], [], [])
            held, chars = [], 0
            for k, text in enumerate(part["text"]):
                held.append(text)
                chars += len(text or "")
                if chars >= BLOCK or k == len(part["text"]) - 1:
                    for have, new in zip(out, model.predict(held)):
                        have += new
                    held, chars = [], 0
            return {"doc_id": part["doc_id"], "lang_pred": out[0], "score": out[1], "accepted": out[2]}

        return step

    return map_lists(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), make,
                     "doc_id long, lang_pred string, score double, accepted boolean")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted: fitted on the rows that are not held out, applied to all."""
    return predict(docs, fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")
