"""Repeated byte strings across documents by a sharded run-length index.

A byte goes when some ``length`` bytes around it also start in a document with a
smaller id. In every window of that length the k-gram with the least hash (the
leftmost of equals) is its anchor, so equal windows have equal anchors wherever
they stand. Neighbouring windows with one anchor form a stretch of under 2 x
``length`` bytes; a shard of the index is one anchor's stretches.

1. Documents are stored in chunks, in a table bucketed by chunk, so that the later
   steps that need the texts again do not move them.
2. Each chunk asks for its distinct anchors, 32 bits and a count each, dealt to
   buckets of the hash. The answer says which anchors occur anywhere else; the others
   cannot match. This only selects candidates, it removes nothing.
3. Each chunk sends the bytes of its distinct stretches that are left to the shard of
   their anchor. A frequent anchor (more than HEAVY stretches) is split further: its
   windows go one by one, each distinct window of a chunk once, to the shard of the
   window's own hash.
4. A shard builds the run-compressed Burrows-Wheeler transform of its strings (run
   heads, run starts, the first row each run maps to, text places sampled at both run
   ends, the least document of every range of rows that agree in ``length`` bytes).
   Strings no later document could find are left out. The others are streamed through
   it backwards: matching statistics by steps inside runs, and by jumps to the nearest
   run of the wanted byte, with the sample's longest common extension as the new
   length. Places that match ``length`` bytes or more get the least document of
   their range.
5. The answers return to the chunks, where every document keeps the marks of
   smaller documents as maximal runs.

Null ids come after all others and, like equal ids, never remove from one another.
Null and empty texts have no bytes. Repeated rows each get their result. An empty
table gives an empty result; extra columns play no part.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch_root

LENGTH = 50
ANCHOR = 20
NO_ID = (1 << 63) - 1
#: Bytes of texts in a chunk (a longer text is a chunk of its own) and in a bucket of the chunk table.
CHUNK_BYTES, BUCKET_BYTES = 4 << 20, 64 << 20
#: Anchors that one bucket of requests holds, about.
BUCKET_ANCHORS = 1 << 21
#: Stretches of an anchor from which its windows are dealt one by one.
HEAVY = 10_000
#: Bytes of strings in one index (whole shards), and of texts for one task of shards.
INDEX_BYTES, SHARD_BYTES = 3 << 20, 16 << 20
_BLOCK = 1 << 17
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD], np.uint64)


def _gram_hash(words: np.ndarray, later: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of 20 bytes given as two words of 8 and one whose low half counts."""
    h = later * _MIX[1]
    h ^= h >> np.uint64(32)
    h *= _MIX[3]
    h ^= words * _MIX[0]
    h ^= (last & np.uint64(0xFFFFFFFF)) * _MIX[2]
    h ^= h >> np.uint64(32)
    h *= _MIX[3]
    h ^= h >> np.uint64(29)
    return h


def stretches(raw: bytes, sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, anchor hash) of the stretches of consecutive texts of these sizes, by place in ``raw``."""
    kinds = length - ANCHOR + 1
    total = len(raw) - length + 1
    none = np.zeros(0, np.int64)
    if total <= 0:
        return none, none, np.zeros(0, np.uint64)
    padded = raw + b"\0" * (length + 32)
    anchor = np.empty(total, np.int64)
    for lo in range(0, total, _BLOCK):
        n = min(_BLOCK, total - lo)
        grams = n + kinds - 1
        words = np.ndarray((grams + 16,), "<u8", padded, lo, (1,)).copy()
        key = _gram_hash(words[:grams], words[8:grams + 8], words[16:grams + 16])
        key = key >> np.uint64(18) << np.uint64(18) | np.arange(grams, dtype=np.uint64)
        span = 1
        while span * 2 <= kinds:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        if span < kinds:
            key = np.minimum(key[:span - kinds], key[kinds - span:])
        anchor[lo:lo + n] = (key[:n] & np.uint64((1 << 18) - 1)).astype(np.int64) + lo
    # windows that run over the end of their text are none
    stop = np.cumsum(sizes)
    for a, b in zip((stop - np.minimum(sizes, length - 1)).tolist(), stop.tolist()):
        anchor[a:b] = -1
    new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    many = np.diff(np.append(new, total))
    place = anchor[new]
    good = place >= 0
    new, many, place = new[good], many[good], place[good]
    words = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
    return new, many, _gram_hash(words[place], words[place + 8], words[place + 16])


# chunks

CHUNKS = "chunk long, ids binary, nulls binary, sizes binary, raw binary"


def _store_chunks(docs: DataFrame, buckets: int, id_col: str, text_col: str) -> DataFrame:
    """Rows of several documents each (ids, which of them are null, sizes, bytes), bucketed by chunk."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId() << 32, 0
        ids, texts, size = [], [], 0

        def row() -> pa.RecordBatch:
            known = np.array([NO_ID if i is None else i for i in ids], np.int64)
            return pa.RecordBatch.from_pydict({
                "chunk": [part + count], "ids": [known.tobytes()], "nulls": [np.array([i is None for i in ids]).tobytes()],
                "sizes": [np.array([len(t) for t in texts], np.int64).tobytes()], "raw": [b"".join(texts)]})

        for batch in batches:
            for i, t in zip(batch["doc_id"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist()):
                if texts and size + len(t or b"") > CHUNK_BYTES:
                    yield row()
                    ids, texts, size, count = [], [], 0, count + 1
                ids.append(i)
                texts.append(t or b"")
                size += len(texts[-1])
        if texts:
            yield row()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, CHUNKS)
    name = f"voxframe_chunks_{uuid.uuid4().hex}"
    rows.write.bucketBy(buckets, "chunk").option("compression", "zstd").option(
        "path", f"{scratch_root(spark)}/voxframe/{name}").saveAsTable(name)
    chunks = spark.table(name)
    # the frame knows files and buckets from here on; the name, which only a catalogue can give buckets, need not stay
    spark.sql(f"DROP TABLE {name}")
    return chunks


# which anchors occur elsewhere

def _chunk_anchors(raw: bytes, sizes: bytes, length: int) -> tuple[np.ndarray, ...]:
    """Stretches of a chunk, and their anchors as (distinct, number of each stretch's, counts)."""
    start, many, anchor = stretches(raw, np.frombuffer(sizes, np.int64), length)
    return (start, many, *np.unique(anchor, return_inverse=True, return_counts=True))


def _ask(chunks: DataFrame, bits: int, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, raw, sizes in zip(*(batch[c].to_pylist() for c in ("chunk", "raw", "sizes"))):
                *_, known, _, counts = _chunk_anchors(raw, sizes, length)
                low = (known >> np.uint64(32 - bits) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                some = np.minimum(counts, 255).astype(np.uint8)
                edge = np.searchsorted(known >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
                used = np.flatnonzero(np.diff(edge))
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array(used, pa.int32()), "chunk": pa.array([chunk] * len(used), pa.int64()),
                    "low": pa.array([low[edge[b]:edge[b + 1]].tobytes() for b in used], pa.binary()),
                    "many": pa.array([some[edge[b]:edge[b + 1]].tobytes() for b in used], pa.binary())})

    return chunks.select("chunk", "raw", "sizes").mapInArrow(run, "bucket int, chunk long, low binary, many binary")


def _answer(asked: DataFrame, heavy: int) -> DataFrame:
    """Per request one byte an anchor: 0 it stands nowhere else, 1 it may, 2 it is frequent."""

    def run(table: pa.Table) -> pa.Table:
        low = [np.frombuffer(x, np.uint32) for x in table["low"].to_pylist()]
        sizes = np.array([len(x) for x in low])
        many = np.frombuffer(b"".join(table["many"].to_pylist()), np.uint8)
        _, which, seen = np.unique(np.concatenate(low), return_inverse=True, return_counts=True)
        total = np.bincount(which, weights=many)
        flags = ((seen > 1) | (total > 1)).astype(np.uint8) + (total > heavy)
        edge = np.append(0, np.cumsum(sizes))
        found = flags[which].astype(np.uint8)
        return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "flags": [found[a:b].tobytes() for a, b in zip(edge, edge[1:])]})

    return asked.groupBy("bucket").applyInArrow(run, "chunk long, bucket int, flags binary")


# strings of the shards

def _candidates(raw: bytes, sizes: bytes, flags: list, length: int) -> tuple[dict[bytes, int], np.ndarray, np.ndarray, list[int]]:
    """Distinct strings of a chunk in order of first place, (number, place) of all their occurrences, and their shards."""
    from xxhash import xxh64_intdigest

    start, many, known, which, _ = _chunk_anchors(raw, sizes, length)
    flag = np.frombuffer(b"".join(f["flags"] for f in sorted(flags, key=lambda f: f["bucket"])), np.uint8)
    shared = np.flatnonzero(flag[which] > 0) if len(which) else which
    strings: dict[bytes, int] = {}
    shards: list[int] = []
    numbers, places = [], []
    signed = known.view(np.int64)
    for a, n, w in zip(start[shared].tolist(), many[shared].tolist(), which[shared].tolist()):
        one_by_one = flag[w] == 2
        for at, stop in ([(p, p + length) for p in range(a, a + n)] if one_by_one else [(a, a + n + length - 1)]):
            string = raw[at:stop]
            k = strings.setdefault(string, len(strings))
            if k == len(shards):
                shards.append(xxh64_intdigest(string, 7) - (1 << 63) if one_by_one else int(signed[w]))
            numbers.append(k)
            places.append(at)
    return strings, np.array(numbers, np.int64), np.array(places, np.int64), shards


def _documents_of(places: np.ndarray, ids: bytes, sizes: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(row in the chunk, document) of each place."""
    row = np.searchsorted(np.cumsum(np.frombuffer(sizes, np.int64)), places, side="right")
    return row, np.frombuffer(ids, np.int64)[row]


def _send(chunks: DataFrame, length: int) -> DataFrame:
    """shard, string, least and most (documents of the chunk that hold it), chunk, number (in the chunk)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, ids, raw, sizes, flags in zip(*(batch[c].to_pylist() for c in ("chunk", "ids", "raw", "sizes", "flags"))):
                strings, number, place, shards = _candidates(raw, sizes, flags, length)
                _, doc = _documents_of(place, ids, sizes)
                least, most = np.full(len(strings), NO_ID), np.full(len(strings), -NO_ID - 1)
                np.minimum.at(least, number, doc)
                np.maximum.at(most, number, doc)
                yield pa.RecordBatch.from_pydict({
                    "shard": pa.array(shards, pa.int64()), "string": pa.array(list(strings), pa.binary()), "least": least, "most": most,
                    "chunk": np.full(len(strings), chunk), "number": np.arange(len(strings), dtype=np.int32)})

    return chunks.mapInArrow(run, "shard long, string binary, least long, most long, chunk long, number int")


# the index

_SYMBOLS = 7  # of 9 bits each in a word: 0 ends a string, bytes are 1 to 256
_EDGES = np.array([1 << 9 * k for k in range(_SYMBOLS)], np.int64)


def _symbols(strings: list[bytes]) -> np.ndarray:
    """All strings, each ended by a 0, with one 0 before the first."""
    sizes = np.array([len(s) for s in strings], np.int64)
    out = np.zeros(1 + int(sizes.sum()) + len(strings), np.int64)
    inside = np.ones(len(out), bool)
    inside[np.concatenate([[0], np.cumsum(sizes + 1)])] = False
    out[inside] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64) + 1
    return out


def _packed(text: np.ndarray) -> np.ndarray:
    """The next seven symbols of each place in one integer, in the order of the text."""
    padded = np.concatenate([text, np.zeros(_SYMBOLS, np.int64)])
    out = np.zeros(len(text), np.int64)
    for k in range(_SYMBOLS):
        out <<= 9
        out |= padded[k:k + len(text)]
    return out


def _suffix_order(words: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and for each row whether it agrees with the row before in ``length`` symbols.

    Ranks of the first h symbols give those of the first 2h; only rows still tied are sorted again.
    ``length`` is at least that of a word.
    """
    n = len(words)
    order = np.argsort(words)
    tied = words[order[1:]] == words[order[:-1]]
    h, half = _SYMBOLS, None
    while True:
        first = np.concatenate([[True], ~tied])
        rank = np.empty(n + 1, np.int64)
        rank[order] = np.flatnonzero(first)[np.cumsum(first) - 1]
        rank[n] = -1
        if half is None and h * 2 > length:
            half = rank, length - h
        open_ = np.flatnonzero(np.concatenate([[False], tied]) | np.concatenate([tied, [False]]))
        if not len(open_):
            break
        mine = order[open_]
        key = rank[mine] * (n + 1) + rank[np.minimum(mine + h, n)] + 1
        turn = np.argsort(key)
        order[open_] = mine[turn]
        key = key[turn]
        tied[open_[1:] - 1] &= (key[1:] == key[:-1])
        h *= 2
    if half is None:
        return order, np.zeros(n, bool)
    # two prefixes of h symbols that overlap cover the first ``length``
    begin = half[0][order]
    end = half[0][np.minimum(order + half[1], n)]
    return order, np.concatenate([[False], (begin[1:] == begin[:-1]) & (end[1:] == end[:-1])])


class _Rank:
    """Number of set marks at or before a row, less one: the run that holds the row."""

    def __init__(self, first: np.ndarray):
        bits = np.packbits(np.append(first, np.zeros(-len(first) % 64, bool)), bitorder="little").view("<u8")
        ones = np.bitwise_count(bits).astype(np.int64)
        self.bits, self.before = bits, np.cumsum(ones) - ones

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        word = rows >> 6
        seen = self.bits[word] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (63 - (rows & 63)).astype(np.uint64))
        return self.before[word] + np.bitwise_count(seen) - 1


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of some strings, each with a document.

    ``heads`` are the bytes of the runs, ``starts`` their first rows, ``maps`` the rows that
    these lead to, ``first_sample`` and ``last_sample`` the text places of their end rows.
    ``least`` is the least document of each range of rows that agree in ``length`` bytes.
    """

    def __init__(self, strings: list[bytes], docs: np.ndarray, length: int = LENGTH):
        self.length = length
        text = _symbols(strings)
        self.words = np.append(_packed(text), 0)
        order, alike = _suffix_order(self.words[:-1], length)
        n = len(order)
        before = text[order - 1]
        first = np.concatenate([[True], before[1:] != before[:-1]])
        self.starts = np.flatnonzero(first)
        self.ends = np.append(self.starts[1:], n) - 1
        self.heads = before[self.starts]
        self.run_of = _Rank(first)
        self.first_sample, self.last_sample = order[self.starts], order[self.ends]
        by_head = np.argsort(self.heads, kind="stable")
        sizes = (self.ends - self.starts + 1)[by_head]
        self.maps = np.empty(len(by_head), np.int64)
        self.maps[by_head] = np.cumsum(sizes) - sizes
        self.places = self.heads[by_head] * len(by_head) + by_head  # runs in order of (head, run)
        self.range_of = _Rank(~alike)
        owner = np.repeat(np.arange(len(strings)), [len(s) + 1 for s in strings])
        mine = np.asarray(docs, np.int64)[np.concatenate([[0], owner])[order]]
        self.least = np.minimum.reduceat(mine, np.flatnonzero(~alike))

    def _extension(self, place: np.ndarray, words: np.ndarray, at: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Symbols, at most ``most``, that the text from ``place`` and the query from ``at`` have in common."""
        out, left, k = np.zeros(len(place), np.int64), np.arange(len(place)), 0
        while len(left):
            differ = self.words[np.minimum(place[left] + k, len(self.words) - 1)] ^ words[np.minimum(at[left] + k, len(words) - 1)]
            out[left] += _SYMBOLS - np.searchsorted(_EDGES, differ, side="right")
            k += _SYMBOLS
            left = left[(differ == 0) & (most[left] > k)]
        return np.minimum(out, most)

    def matching_statistics(self, queries: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """From the last byte to the first, for all queries at once: (query, place in it, length of the
        longest match there, capped at ``length``, and a row of the transform where it stands)."""
        sizes = np.array([len(q) for q in queries], np.int64)
        turn = np.argsort(-sizes, kind="stable")
        text = _symbols(queries)
        words = np.append(_packed(text), 0)
        stop = np.cumsum(sizes + 1)[turn]  # place of the 0 behind each query
        row, size = np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64)
        runs = len(self.heads)
        for step in range(int(sizes.max(initial=0))):
            live = int(np.searchsorted(-sizes[turn], -step, side="left"))
            row, size = row[:live], size[:live]
            at = stop[:live] - 1 - step
            want = text[at]
            run = self.run_of(row)
            miss = np.flatnonzero(self.heads[run] != want)
            if len(miss):
                key = want[miss] * runs + run[miss]
                after = np.searchsorted(self.places, key)
                before = np.maximum(after - 1, 0)
                after = np.minimum(after, runs - 1)
                ahead, behind = self.places[after] // runs == want[miss], self.places[before] // runs == want[miss]
                ahead_run, behind_run = self.places[after] % runs, self.places[before] % runs
                near = np.full((2, len(miss)), -1, np.int64)
                for side, fits, sample in ((0, ahead, self.first_sample[ahead_run]), (1, behind, self.last_sample[behind_run])):
                    some = np.flatnonzero(fits)
                    near[side, some] = self._extension(sample[some], words, at[miss[some]] + 1, size[miss[some]])
                down = near[1] > near[0]
                run[miss] = np.where(down, behind_run, ahead_run)
                row[miss] = np.where(down, self.ends[behind_run], self.starts[ahead_run])
                size[miss] = np.maximum(near[0], near[1])
            lost = size < 0  # a byte that no string holds
            row = np.where(lost, 0, self.maps[run] + row - self.starts[run])
            size = np.minimum(np.where(lost, 0, size + 1), self.length)
            yield turn[:live], sizes[turn[:live]] - 1 - step, size, row

    def least_documents(self, queries: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, place, least document) of all places whose longest match has the full length."""
        out: list[tuple[np.ndarray, ...]] = []
        for query, place, size, row in self.matching_statistics(queries):
            full = np.flatnonzero(size >= self.length)
            if len(full):
                out.append((query[full], place[full], self.least[self.range_of(row[full])]))
        if not out:
            return tuple(np.zeros(0, np.int64) for _ in range(3))
        query, place, least = (np.concatenate(x) for x in zip(*out))
        turn = np.lexsort((place, query))
        return query[turn], place[turn], least[turn]


REPLIES = "chunk long, number int, begin int, windows int, least long"


def _index(shard: np.ndarray, string: list[bytes], least: np.ndarray, most: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, first window, windows, least document) of the matches of the rows in documents before their ``most``."""
    numbers: dict[bytes, int] = {}
    which = np.array([numbers.setdefault(s, len(numbers)) for s in string], np.int64)
    distinct = list(numbers)
    low, high = np.full(len(distinct), NO_ID), np.full(len(distinct), -NO_ID - 1)
    np.minimum.at(low, which, least)
    np.maximum.at(high, which, most)
    _, group = np.unique(shard, return_inverse=True)
    of = np.zeros(len(distinct), np.int64)
    of[which] = group
    lowest, highest = np.full(group.max() + 1, NO_ID), np.full(group.max() + 1, -NO_ID - 1)
    np.minimum.at(lowest, of, low)
    np.maximum.at(highest, of, high)
    # a string of the last document alone is of use to nobody, one of the first alone can find nothing
    kept, asked = np.flatnonzero(low < highest[of]), np.flatnonzero(high > lowest[of])
    none = np.zeros(0, np.int64)
    if not len(kept) or not len(asked):
        return none, none, none, none
    index = RunLengthIndex([distinct[k] for k in kept], low[kept], length)
    query, place, doc = index.least_documents([distinct[k] for k in asked])
    if not len(query):
        return none, none, none, none
    new = np.flatnonzero(np.concatenate([[True], (query[1:] != query[:-1]) | (place[1:] != place[:-1] + 1) | (doc[1:] != doc[:-1])]))
    windows = np.diff(np.append(new, len(query)))
    query, place, doc = asked[query[new]], place[new], doc[new]
    # every row of a string gets the runs of that string
    by_string = np.argsort(which, kind="stable")
    edge = np.searchsorted(which[by_string], np.arange(len(distinct) + 1))
    many = edge[query + 1] - edge[query]
    run = np.repeat(np.arange(len(query)), many)
    row = by_string[edge[query][run] + np.arange(len(run)) - np.repeat(np.cumsum(many) - many, many)]
    useful = doc[run] < most[row]
    run, row = run[useful], row[useful]
    return row, place[run], windows[run], doc[run]


def _search(sent: DataFrame, parts: int, length: int) -> DataFrame:
    """For the strings of each chunk the runs of windows that a smaller document holds, with the least one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(table: pa.Table) -> pa.RecordBatch:
            row, begin, windows, doc = _index(
                table["shard"].to_numpy(), table["string"].to_pylist(), table["least"].to_numpy(), table["most"].to_numpy(), length)
            return pa.RecordBatch.from_pydict({
                "chunk": pa.array(table["chunk"].to_numpy()[row], pa.int64()), "number": pa.array(table["number"].to_numpy()[row], pa.int32()),
                "begin": pa.array(begin, pa.int32()), "windows": pa.array(windows, pa.int32()), "least": pa.array(doc, pa.int64())})

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch["string"].nbytes
            if size < INDEX_BYTES:
                continue
            table = pa.Table.from_batches(held)
            shard = table["shard"].to_numpy()
            cut = int(np.flatnonzero(shard != shard[-1]).max(initial=-1)) + 1
            if cut:
                yield found(table.slice(0, cut))
            held = [b for b in table.slice(cut).combine_chunks().to_batches() if len(b)]
            size = sum(b["string"].nbytes for b in held) if cut else 0
        if held:
            yield found(pa.Table.from_batches(held))

    return sent.repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(run, REPLIES)


# results

def _spans(chunk: dict, length: int) -> list[list[tuple[int, int]]]:
    """Maximal runs (start, stop) of bytes that go, for each document of a chunk."""
    _, number, place, _ = _candidates(chunk["raw"], chunk["sizes"], chunk["flags"] or [], length)
    sizes = np.frombuffer(chunk["sizes"], np.int64)
    out: list[list[tuple[int, int]]] = [[] for _ in sizes]
    if not len(number) or not chunk["replies"]:
        return out
    replies = np.array([tuple(r.values()) for r in chunk["replies"]], np.int64)  # number, begin, windows, least
    replies = replies[np.argsort(replies[:, 0], kind="stable")]
    lo = np.searchsorted(replies[:, 0], number)
    many = np.searchsorted(replies[:, 0], number, side="right") - lo
    at = np.repeat(np.arange(len(number)), many)
    reply = replies[lo[at] + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)]
    row, doc = _documents_of(place[at], chunk["ids"], chunk["sizes"])
    hit = reply[:, 3] < doc
    begin = place[at][hit] + reply[hit, 1]
    stop, row = begin + reply[hit, 2] + length - 1, row[hit]
    turn = np.argsort(begin, kind="stable")
    begin, stop, row = begin[turn], np.maximum.accumulate(stop[turn]), row[turn]
    if not len(begin):
        return out
    new = np.flatnonzero(np.concatenate([[True], (begin[1:] > stop[:-1]) | (row[1:] != row[:-1])]))
    last = stop[np.append(new[1:], len(begin)) - 1]
    first = (np.cumsum(sizes) - sizes)[row[new]]
    for r, a, b in zip(row[new].tolist(), (begin[new] - first).tolist(), (last - first).tolist()):
        out[r].append((a, b))
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, heavy: int = HEAVY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (array of start, stop of the maximal runs that go) and kept (the other bytes) for every row."""
    total = docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0
    # joins keep the table's buckets only if they are as many as the session's shuffle partitions
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = _store_chunks(docs, max(least, -(-total // BUCKET_BYTES)), id_col, text_col)
    bits = max(1, (total // 16 // BUCKET_ANCHORS).bit_length())
    flags = materialize(_answer(_ask(chunks, bits, length), heavy), "anchor-flags").groupBy("chunk").agg(
        F.collect_list(F.struct("bucket", "flags")).alias("flags"))
    sent = _send(chunks.join(flags.hint("shuffle_hash"), "chunk").select("chunk", "ids", "raw", "sizes", "flags"), length)
    replies = materialize(_search(sent, max(1, total // SHARD_BYTES), length), "index-replies").groupBy("chunk").agg(
        F.collect_list(F.struct("number", "begin", "windows", "least")).alias("replies"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in batch.to_pylist():
                raw, sizes = chunk["raw"], np.frombuffer(chunk["sizes"], np.int64)
                first, rows = (np.cumsum(sizes) - sizes).tolist(), _spans(chunk, length)
                kept = [b"".join(raw[at + a:at + b] for a, b in zip([0, *(y for _, y in spans)], [*(x for x, _ in spans), n]))
                        for at, n, spans in zip(first, sizes.tolist(), rows)]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(np.frombuffer(chunk["ids"], np.int64), pa.int64(), mask=np.frombuffer(chunk["nulls"], bool)),
                    "n_bytes": sizes, "spans": pa.array([[{"start": a, "stop": b} for a, b in s] for s in rows],
                                                        pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                    "kept": pa.array(kept, pa.binary())})

    return chunks.join(flags.hint("shuffle_hash"), "chunk", "left").join(replies.hint("shuffle_hash"), "chunk", "left").mapInArrow(
        run, "doc_id long, n_bytes long, spans array<struct<start: long, stop: long>>, kept binary")
