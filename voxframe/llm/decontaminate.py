"""Benchmark passages in documents by pigeonhole edit matching.

Texts are compared in lower case with every run of characters other than letters
and digits as one space. A test item of L characters may occur with up to
``L // CHARS_PER_ERROR`` edits. It is cut into one piece more than that, so any such
occurrence holds some piece unchanged; all pieces are searched at once by an
Aho-Corasick automaton and each place found is verified with Myers' bit-parallel
distance over the whole item. An item of under WHOLE_CHARS characters has no budget
and counts where it stands as whole words. Test items are the stated query set: they
are sent to the tasks in blocks of a bounded size, one block after another, and every
block sees every document; the driver holds one block at a time.

Null and empty texts and items match nothing. Items that are equal are reported
each under its id; repeated documents each get their rows. Extra columns play no part
in the search and stay in ``decontaminate``. Empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_lists, materialize

CHARS_PER_ERROR = 16
BLOCK_BYTES = 8 << 20
#: Normalised items shorter than this must occur as they are, as whole words.
WHOLE_CHARS = 24
_OTHER = re.compile(r"[\W_]+")


def normalize(text: str | None) -> str:
    return _OTHER.sub(" ", (text or "").lower()).strip()


def pieces(pattern: str, budget: int) -> list[tuple[int, str]]:
    edges = [len(pattern) * i // (budget + 1) for i in range(budget + 2)]
    return [(lo, pattern[lo:hi]) for lo, hi in zip(edges, edges[1:])]


class Pattern:
    """Myers' bit-vectors of one item."""

    def __init__(self, text: str, budget: int):
        self.length, self.budget, self.masks, self.spaced = len(text), budget, {}, text[:1] == " "
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def best(self, text: str) -> tuple[int, int]:
        """(least distance of the item to any substring of ``text``, end of the first such)."""
        m, masks = self.length, self.masks
        full, high = (1 << m) - 1, 1 << (m - 1)
        up, down, score, best, end = full, 0, m, m, 0
        for at, c in enumerate(text, 1):
            eq = masks.get(c, 0)
            xv = eq | down
            xh = (((eq & up) + up) ^ up) | eq
            ph = down | (full & ~(xh | up))
            mh = up & xh
            if ph & high:
                score += 1
            elif mh & high:
                score -= 1
                if score < best:
                    best, end = score, at
            ph = ph << 1 & full
            up = (mh << 1 & full) | (full & ~(xv | ph))
            down = ph & xv
        return best, end


class Matcher:
    def __init__(self, items: list[tuple[int, str]]):
        import ahocorasick

        self.patterns: dict[str, tuple[Pattern, list[int]]] = {}
        places: dict[str, list[tuple[str, int]]] = {}
        for item, raw in items:
            text = normalize(raw)
            if not text:
                continue
            if len(text) < WHOLE_CHARS:
                # between the spaces that ``find`` puts around the text, too
                text = f" {text} "
            if text in self.patterns:
                self.patterns[text][1].append(item)
                continue
            budget = 0 if text[0] == " " else len(text) // CHARS_PER_ERROR
            self.patterns[text] = (Pattern(text, budget), [item])
            for offset, piece in pieces(text, budget):
                places.setdefault(piece, []).append((text, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def find(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(item, distance, end) for every item that occurs in a normalised text; the least distance, its first end."""
        text = f" {text} "
        diagonals: dict[str, list[int]] = {}
        for last, (length, where) in self.automaton.iter(text) if self.patterns else ():
            for item, offset in where:
                diagonals.setdefault(item, []).append(last - length + 1 - offset)
        for item, starts in diagonals.items():
            pattern, ids = self.patterns[item]
            reach, best = pattern.budget, (pattern.budget + 1, 0)
            lo = hi = None
            for d in [*sorted(set(starts)), None]:
                if lo is not None and (d is None or d - hi > 2 * reach):
                    begin = max(0, lo - reach)
                    distance, end = pattern.best(text[begin:hi + pattern.length + reach])
                    best = min(best, (distance, begin + end))
                    lo = None
                if d is not None:
                    lo, hi = (d, d) if lo is None else (lo, d)
            if best[0] <= pattern.budget:
                distance, end = best
                # without the space in front, and without the one behind a short item
                end = min(end - 1 - (pattern.budget == 0 and pattern.spaced), len(text) - 2)
                for i in ids:
                    yield i, distance, end


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, distance, end (in the normalised text) for every document and item that match."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def search(items: list[tuple[int, str]]) -> tuple[DataFrame, Broadcast]:
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def make():
            matcher = Matcher(shared.value)

            def step(part: dict[str, list]) -> dict[str, list]:
                rows = [(doc, *hit) for doc, text in zip(part["doc_id"], part["text"]) for hit in matcher.find(normalize(text))]
                return dict(zip(("doc_id", "item_id", "distance", "end"), map(list, zip(*rows)) if rows else [[]] * 4))

            return step

        return map_lists(named, make, "doc_id long, item_id long, distance int, end long"), shared

    found = None
    for block in range(blocks):
        part = benchmark.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        hits, shared = search([(r["item_id"], r["text"]) for r in part.select(F.col("item_id").cast("long"), "text").collect()])
        if blocks == 1:
            return hits
        hits = materialize(hits, "leaks")
        shared.destroy()
        found = hits if found is None else found.unionByName(hits)
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; rows without an id are judged together."""
    bad = leaks(docs, benchmark).select("doc_id").distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["doc_id"]), "left_anti")
