"""Groups of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

A pair at 0.8 differs in about ten of the 64 bits of its SimHash fingerprints, some pairs in
twenty; so many bits are beyond any trie under block keys. The fingerprint therefore only goes
first, and a search that misses no pair completes it:

1. Texts of equal shingle sets become one class with its least id.
2. Classes of equal or near fingerprints (``simhash.near_links``) are verified by their exact
   Jaccard similarity and joined, so that a large group of near copies is one component early.
3. Prefix filter: shingles have one order for all texts. A pair at 0.8 or more shares at least
   t = ceil(0.8 n) of n shingles, so the first MEETINGS of those shared (all t, if fewer) lie
   among the first n - t + MEETINGS of either side, and each leaves room for enough others. Pairs
   of different components that meet so often are verified too.
4. Components of all verified pairs.

The order puts the LATE most frequent shingles last, so that a passage of many texts is no meeting
place. They are counted over all texts, by the upper 32 bits of their hashes: shingles that agree
in these are late together. Any order gives the same groups; in a far larger corpus more shingles
of middling frequency stay in front and more pairs are verified.

Words are what ASCII white space separates, A-Z in lower case; a shorter text is one shingle.
Null and empty texts are alike. Shingles are compared as 64-bit hashes. Of rows that share an id
one stays; extra columns are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from . import simhash
from .common import discard, map_lists, materialize

WORDS = 5
BUDGET = 4
#: Texts from which a shingle is frequent, and the most frequent shingles that the order puts last, at most.
FREQUENT, LATE = 5, 1 << 20
#: Shared shingles of the prefixes from which a pair is verified.
MEETINGS = 8
#: Texts that one task counts together, and texts (about) whose number of shingles one range of hashes holds.
COUNTED, RANGE = 8192, 4096
#: Ids up to which they are sent to all tasks.
SENT_IDS = 500_000
#: Passes in which pairs are verified, to hold less on disk at once.
PASSES = 4


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Hashes of all shingles in order, with repeats."""
    from xxhash import xxh64_intdigest

    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    n = max(1, len(parts) - words + 1)
    starts = np.concatenate([[0], ends[:n - 1]]).tolist()
    stops = (ends[min(words, len(parts)) - 1:] - 1).tolist()
    return np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, stops)), np.uint64, n)


def fold(hashes: np.ndarray) -> int:
    """The SimHash fingerprint of these shingles, as ``simhash.fingerprint``."""
    if not len(hashes):
        return 0
    counts = np.zeros(simhash.BITS, np.int64)
    for k in range(0, len(hashes), 255):
        bits = np.unpackbits(hashes[k:k + 255].astype(">u8").view(np.uint8)).reshape(-1, simhash.BITS)
        counts += bits.sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def set_key(members: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(members.tobytes(), 7) if len(members) else 0


def least_shared(n: int) -> int:
    """Shingles of n that a set at 0.8 must share, at most MEETINGS."""
    return min(MEETINGS, (4 * n + 4) // 5)


def prefix(members: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The first shingles, in the common order, of a sorted set; a pair at 0.8 shares MEETINGS of them."""
    n = len(members)
    if len(frequent) and n:
        upper = (members >> np.uint64(32)).astype(np.uint32)
        late = frequent[np.minimum(np.searchsorted(frequent, upper), len(frequent) - 1)] == upper
        members = np.concatenate([members[~late], members[late]])
    return members[:n - (4 * n + 4) // 5 + least_shared(n)]


def pack(values: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending 32-bit values and their counts in few bytes: planes of the steps' bytes compress well."""
    steps = np.diff(values, prepend=np.uint32(0)).astype("<u4")
    return zlib.compress(np.c_[steps.view(np.uint8).reshape(-1, 4), counts.astype("<u4").view(np.uint8).reshape(-1, 4)].T.tobytes(), 1)


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.ascontiguousarray(np.frombuffer(zlib.decompress(packed), np.uint8).reshape(8, -1).T)
    return np.cumsum(planes[:, :4].copy().view("<u4")[:, 0], dtype=np.uint32), planes[:, 4:].copy().view("<u4")[:, 0]


def _frequent(docs: DataFrame) -> np.ndarray:
    """Sorted upper halves of the hashes of shingles that FREQUENT or more texts hold, the LATE most frequent."""
    ranges, least = max(16, docs.count() // RANGE), FREQUENT
    edges = np.linspace(0, 1 << 32, ranges + 1).astype(np.uint64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def packed(sets: list) -> pd.DataFrame:
            values, counts = np.unique(np.concatenate(sets), return_counts=True)
            at = np.searchsorted(values, edges)
            return pd.DataFrame([(k, pack(values[i:j], counts[i:j])) for k, (i, j) in enumerate(zip(at, at[1:])) if i < j], columns=["part", "packed"])

        held: list = []
        for pdf in batches:
            for text in pdf["text"]:
                held.append((np.unique(shingles(text)) >> np.uint64(32)).astype(np.uint32))
                if len(held) == COUNTED:
                    yield packed(held)
                    held = []
        if held:
            yield packed(held)

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        values, counts = (np.concatenate(x) for x in zip(*map(unpack, pdf["packed"])))
        distinct, place = np.unique(values, return_inverse=True)
        n = np.bincount(place, weights=counts).astype(np.int64)
        return pd.DataFrame({"h": distinct[n >= least].astype(np.int64), "n": n[n >= least]})

    counted = materialize(docs.select("text").mapInPandas(run, "part int, packed binary").groupBy("part").applyInPandas(total, "h long, n long"), "frequent")
    found = np.sort(counted.orderBy(F.desc("n"), "h").limit(LATE).select("h").toPandas()["h"].to_numpy(np.int64).astype(np.uint32))
    discard(counted)
    return found


def _prints(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """doc_id, key (of the shingle set), fp, n (shingles of the set), prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def make():
        late = shared.value

        def step(part: dict[str, list]) -> dict[str, list]:
            hashes = [shingles(t) for t in part["text"]]
            sets = [np.unique(h) for h in hashes]
            signed = lambda values: np.array(values, np.uint64).view(np.int64)
            return {"doc_id": part["doc_id"], "key": signed([set_key(m) for m in sets]), "fp": signed([fold(h) for h in hashes]),
                    "n": [len(m) for m in sets], "prefix": [prefix(m, late).view(np.int64) for m in sets]}

        return step

    return map_lists(docs.select("doc_id", "text"), make, "doc_id long, key long, fp long, n int, prefix array<long>")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Of the stored pairs a, b of set keys, those that have a Jaccard similarity of 0.8 or more."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    ids = materialize(classes.join(wanted, "key", "left_semi").select(F.col("least").alias("id")).distinct(), "ids")
    small = ids.count() <= SENT_IDS
    met = docs.join(F.broadcast(ids) if small else ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").select("text")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            members = [np.unique(shingles(t)) for t in pdf["text"]]
            yield pd.DataFrame({"key": np.array([set_key(m) for m in members], np.uint64).view(np.int64), "set": [m.tobytes() for m in members]})

    # repeated rows of one id give a pair twice, which does no harm
    stored = materialize(met.mapInPandas(sets, "key long, set binary"), "sets")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            good = []
            for x, y in zip(pdf["x"], pdf["y"]):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(p, q, assume_unique=True))
                good.append(9 * common >= 4 * (len(p) + len(q)))
            yield pdf.loc[np.array(good, bool), ["a", "b"]]

    # each pass moves the sets of its pairs and gives the disk back; only the sets of side b ride with the pairs
    found = None
    few = pairs.count() <= SENT_IDS
    for k in range(PASSES):
        mine = pairs.filter(F.pmod(F.xxhash64("a"), F.lit(PASSES)) == k)
        hubs = mine.select(F.col("a").alias("key")).distinct()
        left = stored.join(F.broadcast(hubs) if few else hubs, "key", "left_semi").select(F.col("key").alias("a"), F.col("set").alias("x"))
        right = stored.select(F.col("key").alias("b"), F.col("set").alias("y")).join(F.broadcast(mine) if few else mine, "b")
        part = materialize(right.join(left, "a").select("a", "b", "x", "y").mapInPandas(check, "a long, b long"), "verified")
        found = part if found is None else found.unionByName(part)
    discard(pairs, ids, stored)
    return found


def _groups(classes: DataFrame, links: DataFrame) -> DataFrame:
    """``classes`` with the component of each key."""
    member = connected_components(links).select(F.col("node").alias("key"), F.col("component"))
    return classes.join(member, "key", "left").withColumn("component", F.coalesce("component", "key"))


def _fingerprint_pairs(classes: DataFrame) -> DataFrame:
    """Pairs of set keys of equal or near fingerprints: a spanning set, not all."""
    prints = materialize(classes.groupBy("fp").agg(F.min("key").alias("hub")), "fingerprint-hubs")
    equal = classes.join(prints, "fp").filter("key <> hub").select(F.col("hub").alias("a"), F.col("key").alias("b"))
    near = simhash.near_links(prints.select("fp"), BUDGET, prints.count())
    return equal.unionByName(near.join(prints.select(F.col("fp").alias("a"), F.col("hub").alias("ha")), "a").join(
        prints.select(F.col("fp").alias("b"), F.col("hub").alias("hb")), "b").select(F.col("ha").alias("a"), F.col("hb").alias("b")))


def _prefix_pairs(grouped: DataFrame) -> DataFrame:
    """Pairs of set keys of different components that the prefix filter leaves."""
    rows = grouped.select("key", "n", "component", F.posexplode("prefix").alias("at", "shingle"))
    shared = materialize(rows.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("shingle"), "shared")
    meeting = materialize(rows.join(F.broadcast(shared) if shared.count() <= SENT_IDS else shared, "shingle", "left_semi"), "meeting")
    named = lambda s: meeting.select("shingle", *(F.col(c).alias(f"{c}_{s}") for c in ("key", "n", "component", "at")))
    met = named("a").join(named("b"), "shingle").filter(
        (F.col("key_a") < F.col("key_b")) & (F.col("component_a") != F.col("component_b"))
        & (5 * F.least("n_a", "n_b") >= 4 * F.greatest("n_a", "n_b"))
        & (9 * (F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) + MEETINGS - 1) >= 4 * (F.col("n_a") + F.col("n_b"))))
    enough = F.least(F.lit(MEETINGS), F.floor((4 * F.least("n_a", "n_b") + 4) / 5))
    pairs = materialize(met.groupBy(F.col("key_a").alias("a"), F.col("key_b").alias("b")).agg(
        F.count("*").alias("met"), F.min(enough).alias("enough")).filter("met >= enough").select("a", "b"), "pairs")
    discard(shared, meeting)
    return pairs


def near_groups(docs: DataFrame) -> DataFrame:
    """key, least (doc_id), component for every distinct shingle set."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints = materialize(_prints(named, _frequent(named)), "prints")
    classes = materialize(prints.groupBy("key").agg(
        F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("prefix").alias("prefix")), "set-classes")
    discard(prints)
    first = _verified(materialize(_fingerprint_pairs(classes), "pairs"), classes, named)
    grouped = materialize(_groups(classes, first).select("key", "least", "n", "prefix", "component"), "first-groups")
    discard(classes)
    rest = _verified(_prefix_pairs(grouped), grouped, named)
    keys = materialize(grouped.select("key", "least"), "keys")
    discard(grouped)
    return _groups(keys, first.unionByName(rest))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is the least of its group; of rows that share that id, one.

    Rows without an id have no place in that order and stay.
    """
    found = materialize(near_groups(docs).groupBy("component").agg(F.min("least").alias("doc_id")).filter("doc_id is not null").select("doc_id").distinct(), "kept-ids")
    return simhash.rows_kept(docs, found)
