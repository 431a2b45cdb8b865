"""Language identification, the conversation trie and hard negatives against brute force, with nulls, ties, repeats and clashing names."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from voxframe.llm import entries, language, negatives, trie

CLASH = "c d pc pd kids pos digest chars at part first row n s1 block stream side no q id who score anchor rank positives h base taken p0"


def clashing(spark, rows, schema):
    """A table with further columns that are named as the operators' own."""
    names = CLASH.split()
    return spark.createDataFrame([(*r, *range(len(names))) for r in rows], schema + ", " + ", ".join(f"{n} int" for n in names)).repartition(3)


# language

PHRASES = {"one": "zwischen und nicht wurde ein haus gegen über schön", "two": "between and which would have the house against though",
           "three": "entre pero cuando está una casa contra ñandú porque"}


def tongue(rng, lang, n):
    return " ".join(rng.choice(PHRASES[lang].split()) for _ in range(n))


def labelled(n=240):
    rng = random.Random(5)
    return [(i, tongue(rng, lang, rng.randint(6, 60)), lang) for i in range(n) for lang in [list(PHRASES)[i % 3]]]


def test_language_of_held_out_rows(spark):
    rows = labelled()
    odd = [(1000, None, "one"), (1001, "", "two"), (1002, "12 34 !?", "two"), (None, rows[0][1], "one"), (5, rows[5][1], None), (5, rows[5][1], None), (1003, "x" * 3_000_000, None)]
    got = language.identify(clashing(spark, rows + odd, "doc_id long, text string, lang string")).collect()
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(r[0] for r in rows + odd)
    truth = {d: x for d, _, x in rows}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 30 and np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and (r["lang_pred"] in PHRASES or r["doc_id"] in (1000, 1001, 1002))
        if r["doc_id"] in (1000, 1001, 1002):
            assert (r["lang_pred"], r["score"], r["accepted"]) == ("und", 0.0, False)


def test_held_out_labels_teach_nothing(spark):
    rows = labelled()
    held = lambda d: zlib.crc32(str(d).encode()) % 4 == 2
    other = [(d, t, "wrong" if held(d) else x) for d, t, x in rows]
    a, b = (language.identify(spark.createDataFrame(r, "doc_id long, text string, lang string")).orderBy("doc_id").collect() for r in (rows, other))
    assert a == b


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {(r["lang_pred"], r["score"]) for r in language.identify(docs).collect()} == {("und", 0.0)}
    assert language.identify(docs.limit(0)).count() == 0


def test_language_on_the_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.97
    assert np.mean([r["lang_pred"] == r["lang"] for r in got if r["accepted"]]) > 0.98


def slow_subwords(text):
    """Subwords of a text character by character, as a count of strings."""
    words = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text).split()
    line = " " + "".join(w + " " for w in words)
    if not words:
        return collections.Counter()
    return collections.Counter(line[i:i + n] for n in range(1, language.MAX_GRAM + 1) for i in range(len(line) - n + 1)
                               if " " not in line[i + 1:i + n - 1] and line[i:i + n].strip())


@pytest.mark.parametrize("block", [1 << 19, 7, 1])
def test_subwords_and_blocks(monkeypatch, block):
    texts = ["", "  Ab  c!", "é😀xyz", " ", "aaa bbb\tAAA", "q"]
    rng = np.random.default_rng(0)
    votes = rng.normal(size=(language.BUCKETS, 3))
    model = language.Model(["a", "b", "c"], votes, np.zeros(3), 0.5)
    monkeypatch.setattr(language, "BLOCK", block)
    z, letters = model.logits(texts)
    for k, text in enumerate(texts):
        grams = slow_subwords(text)
        want, n = np.zeros(3), 0
        for gram, count in grams.items():
            codes = np.array([ord(c) for c in gram], np.uint32)
            bucket = [b for places, b in language.subwords(codes, 1) if len(b)]
            full = list(language.subwords(codes, 1))[len(gram) - 1][1]
            assert bucket is not None and len(full) == 1
            want += count * votes[full[0]]
            n += count
        assert np.allclose(z[k], want / max(1, n)), text
        assert letters[k] == sum(c for g, c in grams.items() if len(g) == 1)


# conversation trie

def slow_trie(rows, rebuild=True):
    convs = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), (role or "", text or "")))
    turns = {c: [x[3] for x in sorted(v)] for c, v in convs.items()}
    if rebuild:
        def rebuilt(c):
            h, base = zlib.crc32(str(c).encode()) % 6, c - int(math.fmod(c, 100))
            return turns.get(base, [])[:h] + turns[c][h:]
        turns = {c: rebuilt(c) for c in turns}
    members = collections.defaultdict(list)
    for c, seq in turns.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    ends = lambda p: ",".join(map(str, sorted(c for c in members[p] if turns[c] == list(p))))
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends(p).encode()).hexdigest()) for p, m in members.items())


TRIE_COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_rows(df):
    return sorted((tuple(r[c] for c in TRIE_COLUMNS) for r in df.collect()), key=lambda r: (r[0], r[1]))


def conversation_rows():
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["hi", "yes", "no é", ""])) for c in [*range(0, 40), *range(100, 130), -5, -100, 1 << 40] for t in range(rng.randint(1, 7))]
    rows += [(3, None, None, "late"), (3, None, "user", None), (3, 1, "user", "tie"), (3, 1, "user", "tie"), (None, 1, "user", "nobody"), (None, None, None, None)]
    rows += [(250, t, "user", "w" * (t % 5)) for t in range(45)] + [(251, t, "user", "w" * (t % 5)) for t in range(40)]
    return rows


def test_trie_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(trie, "STRETCH", 8)
    monkeypatch.setattr(trie, "PIECE_IDS", 3)
    rows = conversation_rows()
    table = clashing(spark, rows, "conv_id long, turn long, role string, text string")
    assert trie_rows(trie.rebuilt_trie(table)) == sorted(slow_trie(rows), key=lambda r: r[:2])


def test_trie_of_conversations_as_they_stand(spark):
    rows = [(c, t, "user", "same") for c in range(30) for t in range(3)] + [(c, 9, "user", str(c % 4)) for c in range(30)]
    assert trie_rows(trie.conversation_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))) == sorted(slow_trie(rows, False), key=lambda r: r[:2])


def test_one_long_conversation_among_ranges(spark):
    rows = [(1, t, "user", str(t // 2)) for t in range(60)]
    spread = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    turns, counts = trie.number_turns(spread)
    assert [(r["pos"], r["digest"]) for r in turns.orderBy("pos").collect()] == [
        (t + 1, hashlib.sha256(f"4:user{t // 2}".encode()).hexdigest()) for t in range(60)]
    assert counts.collect() == [(1, 60)]


@pytest.mark.parametrize("kind", ["chain", "star", "random", "comb"])
def test_subtree_totals(spark, kind):
    rng = random.Random(4)
    n = 70
    parent = {0: None} | {k: {"chain": k - 1, "star": 0, "random": rng.randrange(k), "comb": k - 1 if k % 2 else max(0, k - 2)}[kind] for k in range(1, n)}
    weight, kids = {k: rng.randint(0, 9) for k in parent}, collections.Counter(parent.values())
    want = dict(weight)
    for k in sorted(parent, reverse=True):
        if parent[k] is not None:
            want[parent[k]] += want[k]
    nodes = spark.createDataFrame([(k, 0, p, None if p is None else 0, kids[k], weight[k]) for k, p in parent.items()], "c long, d long, pc long, pd long, kids long, w long")
    assert {r["c"]: r["w"] for r in trie.subtree_totals(nodes, ["w"]).collect()} == want


def test_no_conversations(spark):
    none = spark.createDataFrame([(None, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    assert trie.rebuilt_trie(none).count() == 0 and trie.rebuilt_trie(none.limit(0)).count() == 0


# hard negatives

@pytest.mark.parametrize("shape", [(1, 1, 1), (5, 3, 7), (130, 65, 201), (257, 64, 129), (300, 0, 4), (16, 17, 1000)])
def test_strassen_is_exact(shape):
    m, k, n = shape
    rng = np.random.default_rng(1)
    a, b = rng.integers(-(1 << 20), 1 << 20, (m, k)), rng.integers(-(1 << 20), 1 << 20, (k, n))
    assert (negatives.strassen(a, b, 8) == a @ b).all() and negatives.strassen(a, b, 8).shape == (m, n)


def slow_negatives(rows):
    usable = [(i, (y + 1) % 10 if i % 7 == 0 else y, [math.floor(256 * x) for x in v]) for i, v, y in rows
              if None not in (i, v, y) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, la, qa in usable:
        if a % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(qa, q)), i, y) for i, y, q in usable if i != a)
        for s, p, _ in [x for x in scored if x[2] == la][:5]:
            fits = [(i, -t) for t, i, y in scored if y != la and 50 * -s <= 100 * -t <= 95 * -s]
            out += [(a, p, k + 1, i, -s, t) for k, (i, t) in enumerate(fits[:3])]
    return sorted(out)


def vector_rows():
    rng = random.Random(8)
    rows = [(i, [rng.choice([0.5, 0.25, -0.125, 0.8, 1.0]) for _ in range(6)], rng.randrange(3)) for i in range(160)]
    rows += [(200 + i, [0.5] * 6, i % 2) for i in range(30)] + [(250, [0.5] * 6, 0), (300, [1.0, 2.0], 1), (301, [1.0] * 9, 1), (350, [], 2)]
    return rows + [(None, [1.0], 1), (401, None, 1), (402, [1.0], None), (403, [float("nan")], 1), (404, [float("inf")], 1), (405, [None, 1.0], 1), (7, rows[7][1], rows[7][2])]


@pytest.mark.parametrize("block,stream,tile", [(2048, 4096, 1024), (2, 30, 7)])
def test_negatives_against_brute_force(spark, block, stream, tile):
    from pyspark.sql import functions as F

    rows = vector_rows()
    table = clashing(spark, rows, "vec_id long, embedding array<float>, label int")
    known = negatives.quantised(table).withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    got = negatives.mine(known, F.col("vec_id") % 50 == 0, block_anchors=block, stream_rows=stream, tile_rows=tile).collect()
    want = slow_negatives([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], y) for i, v, y in rows])
    assert sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in got) == want and want


def test_vectors_too_large_are_refused(spark):
    with pytest.raises(Exception, match="too large"):
        negatives.quantised(spark.createDataFrame([(1, [5000.0], 1)], "vec_id long, embedding array<double>, label int")).collect()


def test_repeat_index_leaves_no_table_behind(spark):
    from voxframe.llm import suffix_dedup

    docs = spark.createDataFrame([(n, "the same long passage of words that stands in every one of these documents " * 2 + str(n)) for n in range(6)], "doc_id long, text string")
    assert suffix_dedup.remove_repeats(docs).count() == 6
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("voxframe_chunks")]


# the registered queries and their SQL

@pytest.mark.parametrize("name", sorted(entries.oracle_sql()))
def test_queries_match_their_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for table in ("conversations", "embeddings"):
        con.sql(f"create view {table} as select * from '{sf}/{table}.parquet'")
    got, want = entries.queries()[name](spark, sf).toArrow(), con.sql(entries.oracle_sql()[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names) and got.num_rows
    key = lambda t: sorted(str([r[c] for c in sorted(t.column_names)]) for r in t.to_pylist())
    assert key(got) == key(want)
