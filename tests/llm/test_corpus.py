"""Corpus operators against brute force on small fixtures, with nulls, ties, repeats and clashing names."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from voxframe.llm import decontaminate, entries, line_dedup, near_sets, packing, sharding, simhash, suffix_dedup, tiff, token_counts, toxicity, wrapper
from voxframe.llm.tokens import bpe, default_vocabulary

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus():
    rng = random.Random(7)
    texts = [prose(rng, rng.randint(5, 160)) for _ in range(36)]
    texts += [texts[0], texts[3], texts[5] + " extra", "  " + texts[2], "one\n\ntwo  three \n four", "", "   ", None, "é" * 70, "word " * 400]
    texts += [texts[4] + "\n" + texts[6], texts[6] + "\n" + texts[9] + "\nshared tail line of six words", texts[8] + "\nshared tail line of seven words", "a" * 300]
    rows = [(i * 3 + 1, t, "en", f"src{i % 2}") for i, t in enumerate(texts)]
    return rows + [(None, texts[1], "en", None), (4, texts[1], None, "again"), (None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string").repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


# tokens, packing

def test_ids_equal_the_tokenizers_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [t or "" for _, t, *_ in corpus()] + ["a  b", "a \n b", "x\t\ty z", " lead", "trail ", "don't stop", "a<|endoftext|>b", "日本 語", "\n\n\n", "1234 5x"]
    want = [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe(default_vocabulary()).encode_batch(texts)] == want


@pytest.mark.parametrize("capacity", [16, 1024])
def test_packing_is_gapless_and_lossless(docs, empty, capacity):
    pieces = [r.asDict() for r in packing.pack_documents(docs, capacity, with_ids=True).collect()]
    texts = {}
    for d, t, *_ in corpus():
        texts.setdefault(d, []).append(np.append(np.frombuffer(bpe(default_vocabulary()).encode_batch([t or ""])[0], "<u4"), 0))
    assert sum(p["length"] for p in pieces) == sum(len(x) for xs in texts.values() for x in xs)
    for p in pieces:
        ids = np.frombuffer(bytes(p["ids"]), "<u4")
        assert len(ids) == p["length"] <= capacity and zlib.crc32(bytes(p["ids"])) == p["ids_crc32"]
        assert any(np.array_equal(x[p["start"]:p["start"] + p["length"]], ids) for x in texts[p["doc_id"]])
    windows = collections.defaultdict(list)
    for p in pieces:
        windows[p["sequence_id"]].append((p["offset"], p["length"]))
    for spans in windows.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(windows) == list(range(len(windows)))
    assert packing.pack_documents(empty).count() == 0


def test_best_fill_equals_exhaustive_search():
    rng = random.Random(1)
    for _ in range(60):
        counts = {rng.randint(1, 12): rng.randint(1, 3) for _ in range(4)}
        room = rng.randint(1, 30)
        sums = {0}
        for length, n in counts.items():
            sums = {s + length * k for s in sums for k in range(n + 1)}
        used = packing.best_fill(counts, room)
        assert sum(k * n for k, n in used.items()) == max(s for s in sums if s <= room)
        assert all(n <= counts[k] for k, n in used.items())


# sharding

def test_shards_are_even_gapless_and_seeded(docs, empty):
    rows = [r.asDict() for r in sharding.shuffle_into_shards(docs, 5, seed=1).collect()]
    assert sorted(str((r["doc_id"], r["text"], r["lang"], r["source"])) for r in rows) == sorted(map(str, corpus()))
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = sharding.shuffle_into_shards(docs.repartition(2), 5, seed=1).collect()
    place = lambda rs: sorted(str((r["doc_id"], r["text"], r["shard"], r["slot"])) for r in rs)
    assert place(rows) == place(again) != place(sharding.shuffle_into_shards(docs, 5, seed=2).collect())
    assert sharding.shuffle_into_shards(empty).count() == 0


def test_fisher_yates_is_a_permutation():
    assert sorted(sharding.fisher_yates(50, "a")) == list(range(50))
    seen = collections.Counter(tuple(sharding.fisher_yates(3, str(s))) for s in range(6000))
    assert len(seen) == 6 and max(seen.values()) < 1.2 * min(seen.values())


# token counts

@pytest.mark.parametrize("block", [2, 14, 1 << 18])
def test_separator_scan_over_any_block_size(docs, empty, block):
    from voxframe.llm.common import materialize

    flat = materialize(token_counts.write_flat(docs, block_bytes=block), "flat-test")
    counts = token_counts.scan_separators(flat.filter("data is not null"))
    got = sorted(str((r["doc_id"], r["n_tokens"])) for r in counts.join(token_counts.document_names(flat), ["file", "ordinal"]).collect())
    assert got == sorted(str((d, len(bpe(default_vocabulary()).encode_batch([t or ""])[0]) // 4)) for d, t, *_ in corpus())
    assert token_counts.scan_separators(token_counts.write_flat(empty).filter("data is not null")).count() == 0


def test_separator_string_in_a_text_does_not_split_it(spark):
    from voxframe.llm.common import materialize

    texts = ["a<|endoftext|>b", "plain text", "x  y <|endoftext|> z", "<|endoftext|>", "mid <|endoftext|> dle", "last one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    flat = materialize(token_counts.write_flat(docs), "flat-test")
    counts = token_counts.scan_separators(flat.filter("data is not null"))
    got = {r["doc_id"]: r["n_tokens"] for r in counts.join(token_counts.document_names(flat), ["file", "ordinal"]).collect()}
    encoder = bpe(default_vocabulary())
    assert got == {i: len(encoder._enc.encode(t, disallowed_special=())) for i, t in enumerate(texts)}
    assert counts.count() == len(texts) and got[3] > 1
    # the special id stays for packing, whatever was encoded before
    assert np.frombuffer(encoder.encode_batch(["mid <|endoftext|> dle"])[0], "<u4").tolist().count(50256) == 1


def test_raw_files_and_unfinished_documents(spark, tmp_path):
    np.array([5, 6, 50256, 50256, 7, 8, 9], "<u2").tofile(tmp_path / "a.bin")
    got = token_counts.scan_separators(token_counts.read_flat(spark, str(tmp_path), block_bytes=4)).orderBy("ordinal").collect()
    assert [(r["start"], r["n_tokens"], r["ended"]) for r in got] == [(0, 2, True), (3, 0, True), (4, 3, False)]


# TIFF

@pytest.mark.parametrize("compression", list(tiff.CODECS))
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (32, 16)])
def test_pages_round_trip(compression, predictor, tile):
    rng = np.random.default_rng(1)
    pages = [rng.integers(0, 256, (37, 50), dtype=np.uint8), rng.integers(0, 9, (5, 70, 3), dtype=np.uint8)]
    back = list(tiff.decode(tiff.encode(pages, compression, predictor, 8, tile)))
    assert [(c, p) for c, p, _ in back] == [(compression, predictor)] * 2
    assert np.array_equal(back[0][2][:, :, 0], pages[0]) and np.array_equal(back[1][2], pages[1])


def test_long_lzw_fills_its_table():
    data = np.random.default_rng(2).integers(0, 256, 60_000, dtype=np.uint8).tobytes() + b"ab" * 20_000
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data


def test_page_rows_and_broken_files(spark):
    two = tiff.encode([np.zeros((2, 3), np.uint8), np.ones((4, 5), np.uint8)])
    df = spark.createDataFrame([(1, bytearray(two), 9), (2, bytearray(b"II*\0zz"), 9), (3, None, 9), (4, bytearray(b""), 9)], "id long, content binary, width int")
    rows = tiff.tiff_pages(df).orderBy("id", "page").collect()
    assert [(r["id"], r["page"], r["width"], r["height"]) for r in rows[:2]] == [(1, 0, 3, 2), (1, 1, 5, 4)]
    assert all(r["error"] and r["pixels"] is None for r in rows[2:]) and len(rows) == 5


def test_stored_texts_come_back(docs):
    for _, t, *_ in corpus():
        raw = (t or "").encode()
        n, content = tiff.store_text(t)
        pixels = next(tiff.decode(content))[2].tobytes()
        assert n == len(raw) and pixels[:n] == raw and set(pixels[n:]) <= {255} and len(pixels) % 576 == 0 and pixels


# SimHash

def slow_fingerprint(text, words):
    from xxhash import xxh64_intdigest

    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    shingles = [b" ".join(parts[i:i + words]) for i in range(max(1, len(parts) - words + 1))]
    counts = [sum(xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def test_fingerprints_and_components(docs, empty):
    rows = corpus()
    fps = [slow_fingerprint(t, 4) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    want = sorted(str((d, "%016x" % fps[i], least.get(find(i)))) for i, (d, *_) in enumerate(rows))
    got = sorted(str((r["doc_id"], r["fingerprint"], r["component_id"])) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("budget", [1, 4])
def test_trie_links_keep_all_components(budget):
    rng = np.random.default_rng(budget)
    base = rng.integers(0, 1 << 62, 60, dtype=np.uint64)
    near = np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) for _ in range(6)])
    fps = np.unique(near)
    keys = (fps % np.uint64(3)).astype(np.int64)
    order = np.lexsort((fps, keys))
    fps, keys = fps[order], keys[order]

    def groups(pairs):
        parent = list(range(len(fps)))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            a, b = find(int(a)), find(int(b))
            parent[max(a, b)] = min(a, b)
        return [find(i) for i in range(len(fps))]

    a, b = simhash.trie_links(keys, fps, budget)
    assert all((fps[i] ^ fps[j]).bit_count() <= budget and keys[i] == keys[j] for i, j in zip(a, b))
    brute = [(i, j) for i in range(len(fps)) for j in range(i) if keys[i] == keys[j] and int(fps[i] ^ fps[j]).bit_count() <= budget]
    assert groups(zip(a, b)) == groups(brute) and len(a) < len(fps)


def test_block_masks_cover_every_pair_within_the_budget():
    rng = random.Random(3)
    for n in (10, 10**6, 10**9):
        masks = simhash.block_masks(n, 4)
        for _ in range(200):
            x = rng.getrandbits(64)
            y = x
            for b in rng.sample(range(64), 4):
                y ^= 1 << b
            assert any(not (x ^ y) & m for m in masks)


def test_keep_one_leaves_one_of_each_group(docs):
    kept = simhash.keep_one(docs).collect()
    ids = [r["doc_id"] for r in kept if r["doc_id"] is not None]
    assert len(ids) == len(set(ids)) and 1 in ids and 1 + 3 * 36 not in ids


@pytest.mark.parametrize("frequent", [1, 2, 10**6])
def test_near_groups_equal_brute_force_at_jaccard_08(spark, monkeypatch, frequent):
    import corpus_pipeline

    monkeypatch.setattr(near_sets, "FREQUENT", frequent)
    rng = random.Random(13)
    texts = [prose(rng, n) for n in (1, 3, 5, 6, 40, 90, 200, 200, 300)]
    passage = prose(rng, 60)
    for base in list(texts):
        for edits in (1, 2, 3, 4, 6, 9):
            words = base.split()
            for _ in range(min(edits, len(words))):
                words[rng.randrange(len(words))] = rng.choice(["omega", "psi", "chi"])
            texts.append(" ".join(words))
        texts.append(base + " " + prose(rng, len(base.split()) // 5))
    texts += [passage + " " + prose(rng, n) for n in (5, 10, 14, 16, 20, 60)] + ["", None, "  ", texts[4].upper(), texts[5]]
    rows = list(enumerate(texts)) + [(None, texts[6])]

    def grams(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, parent = [grams(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    missed = 0
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                missed += a != b and (simhash.fingerprint(rows[i][1], 4) ^ simhash.fingerprint(rows[j][1], 4)).bit_count() > 4
                parent[max(find(i), find(j))] = min(find(i), find(j))
    want = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            want[find(i)] = min(want.get(find(i), d), d)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert sorted(d for d in got if d is not None) == sorted(want.values()) and got.count(None) == 1
    assert missed > 20
    assert near_sets.keep_one(docs.limit(0)).count() == 0


def test_frequent_shingles_are_counted_over_all_texts(spark, monkeypatch):
    """No text is left out, and counts of several blocks and ranges add up."""
    monkeypatch.setattr(near_sets, "COUNTED", 7)
    monkeypatch.setattr(near_sets, "SAMPLE", 10, raising=False)
    rng = random.Random(5)
    common = [prose(rng, 12) for _ in range(6)]
    texts = [" ".join([prose(rng, 8), *rng.sample(common, rng.randrange(4))]) for _ in range(120)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    counts = collections.Counter(int(h) >> 32 for t in texts for h in np.unique(near_sets.shingles(t)))
    want = sorted(h for h, n in counts.items() if n >= near_sets.FREQUENT)
    assert len(want) > 40 and near_sets._frequent(docs).tolist() == want
    monkeypatch.setattr(near_sets, "LATE", 5)
    assert sorted(counts[h] for h in near_sets._frequent(docs).tolist()) == sorted(counts.values())[-5:]


def test_prefixes_of_near_sets_meet_often_enough():
    rng = np.random.default_rng(2)
    for _ in range(400):
        n = int(rng.integers(1, 120))
        both = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        a, b = (np.unique(np.r_[both, rng.integers(0, 1 << 63, int(rng.integers(0, n // 8 + 1))).astype(np.uint64)]) for _ in range(2))
        late = np.unique((rng.choice(both, len(both) // 3) >> np.uint64(32)).astype(np.uint32))
        if 5 * len(both) >= 4 * len(np.union1d(a, b)):
            met = np.intersect1d(near_sets.prefix(a, late), near_sets.prefix(b, late))
            assert len(met) >= near_sets.least_shared(min(len(a), len(b)))


# lines

def slow_lines(rows):
    def split(line):
        words = tuple(w for w in line.split(" ") if w)
        return ("words", words) if len(words) >= 5 else ("signs", tuple(line))

    blank = lambda line: not line.strip(" \t\r\f")
    first = {}
    for d, t, *_ in sorted(rows, key=lambda r: r[0]):
        for n, line in enumerate((t or "").split("\n")):
            if not blank(line):
                first.setdefault(line, (d, n))

    def near(a, b):
        (p, a), (q, b) = split(a), split(b)
        if p != q or max(len(a), len(b)) < 5 or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) <= 1
        a, b = sorted((a, b), key=len, reverse=True)
        return any(a[:i] + a[i + 1:] == b for i in range(len(a)))

    gone = {a for a in first if any(first[b] < first[a] and near(a, b) for b in first if b != a)}
    return {d: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if blank(x) or (first[x] == (d, n) and x not in gone)) for d, t, *_ in rows}, gone


def test_lines_against_brute_force(docs, empty):
    rows = [r for r in corpus() if r[0] is not None and r[3] != "again"]
    want, gone = slow_lines(rows)
    frame = docs.sparkSession.createDataFrame(rows, docs.schema)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(frame).collect()}
    assert got == want and gone
    assert line_dedup.dedup_lines(empty).count() == 0
    assert sorted(map(str, (r["lang"] for r in line_dedup.dedup_lines(docs).collect()))) == sorted(map(str, (r[2] for r in corpus())))


def test_short_and_unspaced_lines_are_compared_by_characters(spark):
    rng = random.Random(9)
    lines = ["今天天气很好我们去公园散步吧大家一起", "今天天气很好我们去公园散步吧大家一齐", "今天天气很好我们去公园散步大家一起", "abcd efgh ijkl mnop", "abcd efgh ijkl mnoq", "abcd efgh ijkl mno",
             "a b c d e", "abcde", "abcd", "abce", "ab", "x y z w v u", "x y z w v", "naïve 😀 text", "naïve 😁 text", "naive 😁 text", "word" * 30, "word" * 30 + "s"]
    lines += ["".join(rng.choices("ab", k=rng.randint(4, 7))) for _ in range(40)]
    rows = [(i, "\n".join(rng.sample(lines, 3))) for i in range(60)]
    want, gone = slow_lines(rows)
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, _kept int, _id int, _lines int").repartition(3)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    assert got == want and len(gone) > 10


def test_line_dedup_runs_no_python(docs):
    plan = line_dedup.dedup_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


# benchmark

def edit_in(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern):
            new.append(min(row[i] + (p != c), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_leaks_equal_plain_edit_distance(spark, monkeypatch):
    rng = random.Random(5)
    items = [(i, prose(rng, rng.randint(8, 20))) for i in range(6)] + [(90, None), (91, ""), (92, "too short"), (93, "xi"), (94, "zet")]
    texts = []
    for n in range(24):
        body = prose(rng, 30)
        if n % 2:
            leak = list(items[n % 6][1].upper() if n % 3 else items[n % 6][1])
            for _ in range(n % 9):
                leak[rng.randrange(len(leak))] = rng.choice("xyz")
            body = prose(rng, 8) + ".. " + "".join(leak) + "! " + prose(rng, 9)
        texts.append((n, body))
    texts += [(100, None), (101, ""), (102, "that is Too--short"), (103, "xi"), (104, "taxi xis")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.leaks(docs, bench).collect()}
    want = {}
    for d, t in texts:
        for i, item in items:
            p = decontaminate.normalize(item)
            q = decontaminate.normalize(t)
            if 0 < len(p) < 24:
                if f" {p} " in f" {q} ":
                    want[(d, i)] = 0
            elif p:
                e = edit_in(p, q)
                if e <= len(p) // decontaminate.CHARS_PER_ERROR:
                    want[(d, i)] = e
    assert got == want and {i for _, i in want} > {92, 93}
    for r in decontaminate.leaks(docs, bench).filter("distance = 0").collect():
        p, q = decontaminate.normalize(dict(items)[r["item_id"]]), decontaminate.normalize(dict(texts)[r["doc_id"]])
        assert q[:r["end"]].endswith(p)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 100)
    assert {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.leaks(docs, bench).collect()} == want
    assert decontaminate.decontaminate(docs, bench).count() == len(texts) - len({d for d, _ in want})
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0 == decontaminate.leaks(docs.limit(0), bench).count()


# toxicity

def test_toxicity_on_held_out_rows(spark, empty):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(700):
        words = prose(rng, 60).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(5):
                words.insert(rng.randrange(len(words)), rng.choice(["blockhead", "nincompoop", "scoundrel"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 0, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, marked)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(700) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (i % 4 == 0) for i in held]) > 0.95
    assert all(0 <= s <= 1 for s in got.values())
    kept = toxicity.drop_toxic(docs, marked)
    assert kept.columns == docs.columns and 500 <= kept.count() <= 560
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "x")], "doc_id long, text string")
    assert toxicity.score(odd, model).count() == 3
    assert toxicity.score(docs, toxicity.fit(docs, marked.limit(0))).first()["score"] == 0.0
    assert toxicity.score(empty, model).count() == 0


# pages

PAGE = """<html><head><title>t</title><style>p{{}}</style></head><body><nav><ul><li><a href="/x">Home {n}</a></li></ul></nav>
<div class="ad">Buy {n} now</div><div class="sidebar"><p>Side {n}</p></div><article><h1>Title {n}</h1><p>First &amp; <b>bold</b>  text {n}<br>more<p>Second
line {n} of a long enough article body to count as the content of the page.</p></article><div id="comments"><p>reader {n} says a lot of things here</p></div>
<form><p>mail {n}</p></form><footer>&copy; site</footer></body></html>"""


def test_wrapper_finds_the_article(spark):
    rows = [(n, f"http://h{n % 2}.example.org/{n}", PAGE.format(n=n)) for n in range(30)] + [(100, "http://h0.example.org/e", None), (101, None, ""), (102, "http://solo.example.org/a", PAGE.format(n=102))]
    got = {r["page_id"]: r["text"] for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for n in [*range(30), 102]:
        assert got[n] == f"Title {n}\n\nFirst & bold text {n} more\n\nSecond line {n} of a long enough article body to count as the content of the page."
    assert got[100] == got[101] == "" and len(got) == 33
    assert wrapper.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


BODY = "Paragraph {n} with a good deal of text, {n} times as much as anything else on the page, and some more of it."


def extracted(spark, pages):
    rows = [(n, f"http://one.example.org/{n}", p) for n, p in enumerate(pages)]
    return [r["text"] for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).orderBy("page_id").collect()]


@pytest.mark.parametrize("name", ["content no-sidebar", "post has-footer", "entry-content share", "article-header", "post comments-open", "navy-theme", "sidebar", "post-17 header-9"])
def test_class_names_do_not_lose_the_article(spark, name):
    pages = [f'<body><div class="menu">Home {n}</div><div class="{name}"><p>{BODY.format(n=n)}</p></div><div id="comment-list">me too {n}</div></body>' for n in range(8)]
    assert extracted(spark, pages) == [BODY.format(n=n) for n in range(8)]


@pytest.mark.parametrize("name", ["ad", "site-footer", "cookie-notice", "sidebar-left", "comments", "top menu", "ad_banner"])
def test_named_parts_go(spark, name):
    pages = [f'<div id="wrap"><div class="x"><p>{BODY.format(n=n)}</p><div class="{name}">Part {n}</div></div><div class="{name}">Again {n}</div></div>' for n in range(8)]
    assert extracted(spark, pages) == [BODY.format(n=n) for n in range(8)]


def test_two_layouts_titles_and_constant_blocks(spark):
    notice = "This notice stands on each page of the site and is longer than four hundred characters. " * 6
    one = '<body><div class="k1"><h1>Title {n}</h1><div class="lead">Lead {n} of it</div><div class="b"><p>{body}</p><p>{notice}</p><p>Read on.</p></div></div></body>'
    two = '<body><table><tr><td class="k2"><p>{body}</p></td></tr></table><p>{notice}</p></body>'
    body = lambda n: " ".join([BODY.format(n=n)] * 8)
    pages = [(one if n % 4 else two).format(n=n, body=body(n), notice=notice) for n in range(40)]
    want = [f"Title {n}\n\nLead {n} of it\n\n{body(n)}" if n % 4 else body(n) for n in range(40)]
    assert extracted(spark, pages) == want


def test_deep_and_wide_pages(spark):
    deep = [f"<div>" * 5000 + BODY.format(n=n) + "</div>" * 5000 for n in range(3)]
    assert extracted(spark, deep) == [BODY.format(n=n) for n in range(3)]
    # one more paragraph in front shifts all others; the trailing constant block is still seen
    wide = ["<div>" + f"<p>{BODY.format(n=n)} first</p>" * (n + 1) + "".join(f"<p>{BODY.format(n=n)} {k}</p>" for k in range(450)) + "<ul><li>Trailing line of the site</li></ul></div>" for n in range(6)]
    for n, text in enumerate(extracted(spark, wide)):
        assert text.count("first") == n + 1 and text.endswith(f"{BODY.format(n=n)} 449")


def test_copies_of_one_page_keep_their_text(spark):
    page = f"<body><div><p>{BODY.format(n=1)}</p><p>{BODY.format(n=2)}</p></div></body>"
    assert set(extracted(spark, [page] * 5 + [page.replace("</body>", " </body>")] * 5)) == {BODY.format(n=1) + "\n\n" + BODY.format(n=2)}


def test_tree_matching_is_the_largest(monkeypatch):
    a = wrapper.parse("<div><p>a</p><ul><li>1</li></ul><p>b</p></div>")
    b = wrapper.parse("<div><p>x</p><p>y</p><ul><li>2</li><li>3</li></ul></div>")
    # root, div, one p and the list with one item
    assert len(wrapper.match_trees(a, b)) == 5

    def slow(x, y):
        if x.label != y.label:
            return 0
        best = {}

        def go(i, j):
            if i == len(x.kids) or j == len(y.kids):
                return 0
            if (i, j) not in best:
                take = slow(x.kids[i], y.kids[j])
                best[i, j] = max(go(i + 1, j), go(i, j + 1), take + go(i + 1, j + 1) if take else 0)
            return best[i, j]

        return 1 + go(0, 0)

    rng = random.Random(4)
    grow = lambda d: "".join(f"<{t}>{grow(d - 1) if d else ''}</{t}>" for t in rng.choices(["div", "ul", "span"], k=rng.randint(0, 4)))
    for _ in range(80):
        x, y = wrapper.parse(grow(3)), wrapper.parse(grow(3))
        pairs = wrapper.match_trees(x, y)
        assert len(pairs) == slow(x, y) and all(p.label == q.label for p, q in pairs)
        xs, ys = wrapper.in_order(x)[1:30], wrapper.in_order(y)[1:30]
        common = wrapper.common_labels(xs, ys)
        table = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
        for i, p in enumerate(xs):
            for j, q in enumerate(ys):
                table[i + 1][j + 1] = table[i][j] + 1 if p.label == q.label else max(table[i][j + 1], table[i + 1][j])
        assert len(common) == table[-1][-1] and all(xs[i].label == ys[j].label for i, j in common)
        assert all(a < c and b < d for (a, b), (c, d) in zip(common, common[1:]))


@pytest.mark.parametrize("n", [150, 320])
def test_long_lists_are_matched_as_short_ones(monkeypatch, n):
    """The largest set of pairs whatever the number of children, and the same pairs however the table is filled."""
    rng = random.Random(n)
    kinds = ["<p>a</p>", "<p>a<b>x</b></p>", "<ul><li>1</li></ul>", "<ul><li>1</li><li>2<i>c</i></li></ul>", "<h2>t</h2>"]
    x, y = ("<div>" + "".join(rng.choices(kinds, k=n)) + "</div>" for _ in range(2))
    inner = {("p", "p"): 1, ("ul", "ul"): 2, ("h2", "h2"): 1}

    def matched(cells):
        monkeypatch.setattr(wrapper, "TABLE_CELLS", cells)
        for known in ("_MATCHED", "_PLACES"):
            getattr(wrapper, known, {}).clear()
        a, b = wrapper.parse(x), wrapper.parse(y)
        pairs = wrapper.match_trees(a, b)
        places = [{id(k): i for i, k in enumerate(wrapper.in_order(t))} for t in (a, b)]
        return a.kids[0].kids, b.kids[0].kids, sorted((places[0][id(p)], places[1][id(q)]) for p, q in pairs)

    xs, ys, got = matched(400)
    weight = lambda p, q: inner[p.tag, q.tag] + (len(p.kids) == len(q.kids) == 2) * (1 + 1) + (p.tag == "p" and len(p.kids) == len(q.kids) == 1)
    best = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
    for i, p in enumerate(xs):
        for j, q in enumerate(ys):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + weight(p, q) if p.tag == q.tag else 0)
    assert len(got) == 2 + best[-1][-1]
    assert got == matched(0)[2] == matched(1 << 40)[2]


# repeated spans

def slow_repeats(rows, length=50):
    key = lambda d: (1 << 63) - 1 if d is None else d
    least = {}
    for d, t, *_ in rows:
        raw = (t or "").encode()
        for i in range(len(raw) - length + 1):
            w = raw[i:i + length]
            least[w] = min(least.get(w, key(d)), key(d))
    want = []
    for d, t, *_ in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            if least[raw[i:i + length]] < key(d):
                gone[i:i + length] = True
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        want.append(str((d, len(raw), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())))
    return sorted(want)


def repeats(docs, **kw):
    return sorted(str((r["doc_id"], r["n_bytes"], len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()))
                  for r in suffix_dedup.remove_repeats(docs, **kw).collect())


@pytest.mark.parametrize("chunk, heavy", [(1 << 20, 10_000), (600, 10_000), (600, 3)])
def test_repeats_against_brute_force(docs, empty, monkeypatch, chunk, heavy):
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", chunk)
    assert repeats(docs, heavy=heavy) == slow_repeats(corpus())
    assert suffix_dedup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("heavy", [4, 10_000])
def test_repeats_with_a_line_that_every_text_holds(spark, monkeypatch, heavy):
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 2000)
    rng = random.Random(5)
    hot, short = "a line of some length that stands in each and every text here", "only thirty-two bytes, no match."
    texts = ["\n".join([prose(rng, 12), hot if i % 3 else hot + " and on", short, prose(rng, 9), "\0" * (i % 4) * 30, "ü" * (20 + i % 9)]) for i in range(60)]
    texts += ["".join(texts[k:k + 2]) for k in range(0, 60, 7)]
    rows = [((i * 37) % 101 if i % 11 else (1 << 53) + i, t) for i, t in enumerate(texts)] + [(None, texts[3]), (None, texts[4]), (9, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert repeats(docs, heavy=heavy) == slow_repeats(rows)


def test_matching_statistics_against_brute_force():
    rng = random.Random(3)
    letters = b"ab\0\xff"
    for _ in range(60):
        strings = list(dict.fromkeys(bytes(rng.choices(letters, k=rng.randint(1, 40))) for _ in range(rng.randint(1, 8))))
        strings += [s for s in (strings[0] + b"x", strings[0][3:] + b"ab") if s not in strings]
        docs, cap = [rng.randint(0, 5) for _ in strings], rng.choice([7, 8, 15, 20])
        index = suffix_dedup.RunLengthIndex(strings, np.array(docs), cap)
        queries = [bytes(rng.choices(letters + b"z", k=rng.randint(1, 30))) for _ in range(4)] + strings[:2] + [rng.choice(strings) * 2]
        got = {(q, p): n for qs, ps, ns, _ in index.matching_statistics(queries) for q, p, n in zip(qs, ps, ns)}
        least = {(q, p): d for q, p, d in zip(*index.least_documents(queries))}
        for q, query in enumerate(queries):
            for i in range(len(query)):
                want = max(k for k in range(min(cap, len(query) - i) + 1) if any(query[i:i + k] in s for s in strings))
                assert got[(q, i)] == want
                holders = [d for s, d in zip(strings, docs) if query[i:i + cap] in s] if want == cap else []
                assert least.get((q, i)) == min(holders, default=None)


def test_runs_of_a_repetitive_text_are_few():
    base = bytes(random.Random(1).choices(b"acgt", k=90))
    index = suffix_dedup.RunLengthIndex([base + bytes([i]) for i in range(200)], np.arange(200))
    assert len(index.heads) < len(index.words) / 20
    assert np.array_equal(index.starts[1:], index.ends[:-1] + 1)


# the registered queries

BIG = (1 << 53) + 1


@pytest.fixture(scope="module")
def odd_tables(spark, tmp_path_factory):
    """Documents with nulls, repeated rows, ids beyond 2^53 and extra columns named as an operator's own."""
    rng = random.Random(3)
    clash = ["bucket", "bucket_start", "start", "size", "shard", "kept", "id", "lines", "rank", "key", "fp", "page", "width", "content", "score", "chunk", "raw", "least", "host", "length"]
    base = [(BIG + 2 * i if i % 3 else i, prose(rng, 8 + 7 * i)) for i in range(30)]
    base += [base[3], base[3], (None, base[5][1]), (None, None), (BIG + 400, None), (BIG + 402, ""), (BIG + 404, "x <|endoftext|> y"), (7, "é😀\0" * 40), (8, base[2][1])]
    folder = tmp_path_factory.mktemp("odd")
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in clash)
    spark.createDataFrame([(d, t, "en", None, None, *range(len(clash))) for d, t in base], schema).repartition(2).write.parquet(f"{folder}/documents.parquet")
    labels = [(d, 0, k % 2) for k, (d, _) in enumerate(base)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, base[9][1]), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    pages = [(BIG + 2 * i, f"http://h{i % 2}.org/{i}", f"<p>{t}</p>") for i, (_, t) in enumerate(base[:9])] + [(None, None, None), (None, "x", "<div>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    talk = [(BIG, 1, "user", "hi"), (BIG, None, None, None), (BIG, 1, "user", "hi"), (None, 1, "user", "x"), (7, 1, "user", "hi")]
    spark.createDataFrame([(*r, 1) for r in talk], "conv_id long, turn long, role string, text string, pos int").write.parquet(f"{folder}/conversations.parquet")
    vectors = [(50 * k, [0.5, 1.0], k % 2, 1) for k in range(1, 9)] + [(None, [1.0], 1, 1), (1, None, 1, 1), (2, [1.0], None, 1)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int, block int").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder), base, pages


@pytest.mark.parametrize("name", sorted(entries.queries()))
def test_registered_queries_on_odd_tables(spark, odd_tables, name):
    folder, base, pages = odd_tables
    rows = entries.queries()[name](spark, folder).collect()
    if name.startswith("op9_"):
        assert sorted(str((r["page_id"], r["url"])) for r in rows) == sorted(str(p[:2]) for p in pages)
        assert all(r["n_chars"] == len(r["text"]) for r in rows)
        return
    if name.startswith("op12_"):
        assert {r["conv_id"] for r in rows} <= {7, BIG} and [(r["conv_id"], r["n_convs"]) for r in rows if r["depth"] == 0] == [(7, 2)]
        return
    if name.startswith("op13_"):
        assert all(r["anchor_id"] != r["negative_id"] for r in rows)
        return
    ids = collections.Counter(d for d, _ in base)
    got = collections.Counter(r["doc_id"] for r in rows)
    if name.startswith("op2_"):
        assert {(r["doc_id"], r["item_id"]) for r in rows} == {(base[9][0], 1)}
    elif name.startswith("op1_"):
        assert set(got) == set(ids)
        assert sum(r["length"] for r in rows) == sum(r["doc_tokens"] for r in rows if r["start"] == 0)
    else:
        assert got == ids
    if name.startswith("op5_"):
        texts = collections.defaultdict(list)
        for d, t in base:
            raw = (t or "").encode()
            payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
            texts[d].append((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])))
        for r in rows:
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) in texts[r["doc_id"]]
    if name.startswith("op8_"):
        for r in rows:
            assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
            assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    if name.startswith("op10_"):
        want = collections.Counter(slow_repeats(base))
        assert collections.Counter(str((r["doc_id"], r["n_bytes"], r["n_spans"], r["kept_sha256"])) for r in rows) == want


@pytest.mark.parametrize("name", sorted(entries.queries()))
def test_registered_queries_on_empty_tables(spark, odd_tables, tmp_path_factory, name):
    folder = tmp_path_factory.mktemp("none")
    for table in ("documents", "labels", "benchmark", "pages", "conversations", "embeddings"):
        spark.read.parquet(f"{odd_tables[0]}/{table}.parquet").limit(0).write.parquet(f"{folder}/{table}.parquet")
    assert entries.queries()[name](spark, str(folder)).count() == 0


def test_stages_keep_odd_rows_and_columns(spark, odd_tables):
    folder, base, _ = odd_tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for keep in (line_dedup.dedup_lines, simhash.keep_one, near_sets.keep_one):
        kept = keep(docs)
        assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} <= {d for d, _ in base}
    kept = decontaminate.decontaminate(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))
    assert kept.columns == docs.columns and kept.count() == len(base) - 1


# the pipeline

def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), out.schema)
            assert 0 < docs.count() <= n
    assert {"doc_id", "sequence_id", "offset"} <= set(out.columns) and out.count() >= docs.count()
