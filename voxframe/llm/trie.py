"""Prefix trie of conversations, with totals of every subtree by parallel tree contraction.

A node is a distinct sequence of first turns (role and text); it is named by its smallest
member and its depth. Turns are numbered, and the sums that name a prefix are run, in two
levels (within a stretch of a conversation, then over the stretches), so that a
conversation of any length is spread over tasks. Only digests and lengths are moved, no
texts. A prefix is known by the sums of four 28-bit pieces of SHA-256 values, one value for
each place and turn, 112 bits in all.

``subtree_totals`` contracts the tree in rounds of joins. A round rakes all leaves into
their parents and then compresses chains: a node with one child left whose coin shows head
and whose parent's coin shows tail is spliced out, its weight goes to its parent, and its
child hangs on there. Both are stored as they go; afterwards the rounds are read backwards
and each spliced node gets its own weight plus the total of the child it had. Rounds are
about the logarithm of the node count, and the tables shrink by a constant share a round.
A node with very many children is only ever summed, with partial sums before the shuffle.

Defined cases: a null role or text is empty; turns of equal number (or all null) are
ordered by the digest of role and text, so that ties and repeated rows give one result;
rows without a conversation id belong to none and are left out; conversations whose
rebuilt form has no turns are members of the root; an empty table gives no rows, not even a
root. Very long texts are digested where they stand. Further columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

#: Turns summed in one stretch, and ids joined in one piece of an end list.
STRETCH = 4096
PIECE_IDS = 8192
SUMS = ["s1", "s2", "s3", "s4"]
EMPTY_DIGEST = hashlib.sha256(b"").hexdigest()


def turn_digest(role: Column, text: Column) -> Column:
    """SHA-256 of a turn; the role's length keeps role and text apart."""
    return F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)


def number_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos from 1, digest, chars of every turn; conv_id, n_turns), both stored.

    Turns are sorted by ranges of (conv_id, turn, digest, row), so that one conversation may lie in many tasks; a
    range's share of a conversation starts behind the turns that earlier ranges hold of it.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    order = [F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), F.col("digest").asc()]
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_digest(role, text).alias("digest"), F.length(text).cast("long").alias("chars"))
    # rows that agree in all of these may be dealt to several ranges by their own number
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    ranged = materialize(rows.repartitionByRange(*order, "row").sortWithinPartitions(*order, "row").select(
        "conv_id", "digest", "chars", F.monotonically_increasing_id().alias("at")), "turn-ranges")
    part = F.shiftright("at", 33)
    shares = materialize(ranged.groupBy("conv_id", part.alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("first")), "turn-shares")
    behind = Window.partitionBy("conv_id").orderBy("part")
    shares_at = shares.select("conv_id", "part", "first", (F.sum("n").over(behind) - F.col("n")).alias("before"))
    turns = ranged.withColumn("part", part).join(shares_at, ["conv_id", "part"]).select(
        "conv_id", (F.col("at") - F.col("first") + F.col("before") + 1).alias("pos"), "digest", "chars")
    out = materialize(turns, "turns"), materialize(shares.groupBy("conv_id").agg(F.sum("n").alias("n_turns")), "turn-counts")
    discard(ranged, shares)
    return out


def shared_openings(turns: DataFrame, counts: DataFrame, family: int = 100, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on the opening of their family's first one: (conv_id, pos, digest, chars; conv_id, n_turns).

    With h = crc32(decimal id) % (most + 1), a conversation c gets the first h turns of c - c % family (all of them,
    if fewer) and then its own from turn h + 1 on. A family's opening meets at most 2 x family conversations.
    """
    known = counts.select("conv_id", "n_turns", (F.col("conv_id") - F.col("conv_id") % family).alias("base"),
                          (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).alias("h"))
    bases = counts.filter(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.col("n_turns").alias("of_base"))
    plan = materialize(known.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("of_base", F.lit(0)))), "openings")
    opening = turns.filter((F.col("pos") <= most) & (F.col("conv_id") % family == 0)).withColumnRenamed("conv_id", "base")
    borrowed = plan.select("conv_id", "base", "taken").join(opening, "base").filter("pos <= taken").select("conv_id", "pos", "digest", "chars")
    own = turns.join(plan.select("conv_id", "h", "taken"), "conv_id").filter("pos > h").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "chars")
    return own.unionByName(borrowed), plan.select("conv_id", (F.col("taken") + F.greatest(F.col("n_turns") - F.col("h"), F.lit(0))).alias("n_turns"))


def prefix_sums(turns: DataFrame) -> DataFrame:
    """conv_id, pos, chars, the four sums of the prefix that ends there (s1..s4) and of the one before (b1..b4)."""
    name = F.sha2(F.concat_ws(":", F.col("pos").cast("string"), "digest"), 256)
    pieces = turns.withColumn("_name", name).select("conv_id", "pos", "chars", F.floor(F.col("pos") / STRETCH).alias("stretch"), *(
        F.conv(F.substring("_name", 7 * k + 1, 7), 16, 10).cast("long").alias(f"t{k + 1}") for k in range(4)))
    pieces = materialize(pieces, "prefix-pieces")
    behind, within = Window.partitionBy("conv_id").orderBy("stretch"), Window.partitionBy("conv_id", "stretch").orderBy("pos")
    totals = pieces.groupBy("conv_id", "stretch").agg(*(F.sum(f"t{k}").alias(f"t{k}") for k in range(1, 5)))
    before = totals.select("conv_id", "stretch", *((F.sum(f"t{k}").over(behind) - F.col(f"t{k}")).alias(f"c{k}") for k in range(1, 5)))
    run = pieces.withColumns({f"r{k}": F.sum(f"t{k}").over(within) for k in range(1, 5)}).join(before, ["conv_id", "stretch"])
    return run.select("conv_id", "pos", "chars", *((F.col(f"r{k}") + F.col(f"c{k}")).alias(f"s{k}") for k in range(1, 5)),
                      *((F.col(f"r{k}") + F.col(f"c{k}") - F.col(f"t{k}")).alias(f"b{k}") for k in range(1, 5)))


def end_digests(ends: DataFrame, by: list[str]) -> DataFrame:
    """``by``, ends_sha256: SHA-256 of the ascending decimal ids (conv_id), joined by commas, of each group.

    Ids are sorted by ranges of (by, conv_id) and joined to pieces there; a digest reads the pieces of its group one
    by one, so no group is held as a list. A SHA-256 is one chain, which no further split can shorten.
    """
    keys = pa.schema([(c, pa.int64()) for c in by])
    piece_schema = keys.append(pa.field("first", pa.int64())).append(pa.field("ids", pa.string()))
    end_schema = keys.append(pa.field("ends_sha256", pa.string()))
    ddl = ", ".join(f"{c} long" for c in by)

    def join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch[c].to_pylist() for c in by]
            ids, rows, low = batch["conv_id"].to_pylist(), [], 0
            for k in range(1, len(ids) + 1):
                if k == len(ids) or k - low == PIECE_IDS or any(x[k] != x[low] for x in lists):
                    rows.append((*(x[low] for x in lists), ids[low], ",".join(map(str, ids[low:k]))))
                    low = k
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), piece_schema)], schema=piece_schema)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            rows = []
            for *now, ids in zip(*(batch[c].to_pylist() for c in [*by, "ids"])):
                if now != key:
                    if key is not None:
                        rows.append((*key, state.hexdigest()))
                    key, state = now, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), end_schema)], schema=end_schema)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip([*key, state.hexdigest()], end_schema)], schema=end_schema)

    sorted_ids = ends.select(*by, "conv_id").repartitionByRange(*by, "conv_id").sortWithinPartitions(*by, "conv_id")
    pieces = sorted_ids.mapInArrow(join_ids, f"{ddl}, first long, ids string")
    return pieces.repartition(*by).sortWithinPartitions(*by, "first").mapInArrow(digest, f"{ddl}, ends_sha256 string")


def subtree_totals(nodes: DataFrame, weights: list[str]) -> DataFrame:
    """c, d and the sum of every weight over the subtree of each node, itself included, by rake and compress.

    ``nodes``: c, d name a node, pc, pd its parent (null at the root), kids counts its children; ``weights`` are longs.
    """
    state = materialize(nodes.select("c", "d", "pc", "pd", "kids", *weights), "tree")
    rounds, coin = [], lambda c, d: F.pmod(F.xxhash64(F.col(c), F.col(d), F.lit(len(rounds))), F.lit(2))
    zero = F.lit(0).cast("long")
    while True:
        rounds.append(state)
        if not state.filter("kids > 0").limit(1).count():
            break
        # rake
        leaves = state.filter("kids = 0").groupBy(F.col("pc").alias("c"), F.col("pd").alias("d")).agg(
            F.count("*").alias("_lost"), *(F.sum(w).alias(f"_{w}") for w in weights))
        rest = state.filter("kids > 0").select("c", "d", "pc", "pd", "kids", *weights).join(leaves, ["c", "d"], "left").select(
            "c", "d", "pc", "pd", (F.col("kids") - F.coalesce("_lost", zero)).alias("kids"), *((F.col(w) + F.coalesce(f"_{w}", zero)).alias(w) for w in weights))
        rest = rest.withColumn("out", (F.col("kids") == 1) & F.col("pc").isNotNull() & (coin("c", "d") == 1) & (coin("pc", "pd") == 0))
        rest = materialize(rest, "raked")
        # compress
        spliced = rest.filter("out")
        moved = spliced.select(F.col("c").alias("pc"), F.col("d").alias("pd"), F.col("pc").alias("_pc"), F.col("pd").alias("_pd"), *(F.col(w).alias(f"via_{w}") for w in weights))
        given = spliced.groupBy(F.col("pc").alias("c"), F.col("pd").alias("d")).agg(*(F.sum(w).alias(f"_{w}") for w in weights))
        state = materialize(rest.filter("not out").join(moved, ["pc", "pd"], "left").join(given, ["c", "d"], "left").select(
            "c", "d", F.coalesce("_pc", "pc").alias("pc"), F.coalesce("_pd", "pd").alias("pd"), "kids",
            *((F.col(w) + F.coalesce(f"_{w}", zero)).alias(w) for w in weights),
            F.when(F.col("_pc").isNotNull(), F.col("pc")).alias("via_c"), F.when(F.col("_pc").isNotNull(), F.col("pd")).alias("via_d"), *(f"via_{w}" for w in weights)), "tree")
        discard(rest)
    # backwards: every node that is live after a round has its total when the round's spliced nodes ask for it
    done = state.filter("kids = 0").select("c", "d", *weights)
    for k in range(len(rounds) - 1, 0, -1):
        live = rounds[k]
        raised = live.filter("via_c is not null").select("c", "d", "via_c", "via_d", *(f"via_{w}" for w in weights)).join(done, ["c", "d"]).select(
            F.col("via_c").alias("c"), F.col("via_d").alias("d"), *((F.col(w) + F.col(f"via_{w}")).alias(w) for w in weights))
        later = done
        done = materialize(done.unionByName(raised).unionByName(rounds[k - 1].filter("kids = 0").select("c", "d", *weights)), "totals")
        discard(live)
        if k < len(rounds) - 1:
            discard(later)
    return done


def prefix_trie(turns: DataFrame, counts: DataFrame) -> DataFrame:
    """One row per node of the trie of numbered turns (conv_id, pos, digest, chars; conv_id, n_turns)."""
    sums = materialize(prefix_sums(turns), "prefixes")
    inner = sums.groupBy("pos", *SUMS).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"),
                                           *(F.min(f"b{k}").alias(f"b{k}") for k in range(1, 5)))
    root = counts.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0").select(
        F.lit(0).cast("long").alias("pos"), *(F.lit(0).cast("long").alias(s) for s in SUMS), "conv_id", "n_convs", F.lit(0).cast("long").alias("chars"),
        *(F.lit(None).cast("long").alias(f"b{k}") for k in range(1, 5)))
    named = materialize(inner.unionByName(root), "trie-names")
    above = named.select((F.col("pos") + 1).alias("pos"), *(F.col(f"s{k}").alias(f"b{k}") for k in range(1, 5)), F.col("conv_id").alias("parent_conv_id"))
    nodes = named.join(above, ["pos", "b1", "b2", "b3", "b4"], "left")
    kids = nodes.filter("parent_conv_id is not null").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("pos") - 1).alias("pos")).agg(F.count("*").alias("n_children"))
    nodes = materialize(nodes.join(kids, ["conv_id", "pos"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "trie-nodes")
    totals = subtree_totals(nodes.select(
        F.col("conv_id").alias("c"), F.col("pos").alias("d"), F.col("parent_conv_id").alias("pc"), (F.col("pos") - 1).alias("pd"), F.col("n_children").alias("kids"),
        (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens")), ["n_leaves", "saved_tokens"])
    ends = sums.join(counts.withColumnRenamed("n_turns", "pos"), ["conv_id", "pos"], "left_semi").select("pos", *SUMS, "conv_id").unionByName(
        counts.filter("n_turns = 0").select(F.lit(0).cast("long").alias("pos"), *(F.lit(0).cast("long").alias(s) for s in SUMS), "conv_id"))
    return nodes.join(end_digests(ends, ["pos", *SUMS]), ["pos", *SUMS], "left").join(
        totals.withColumnsRenamed({"c": "conv_id", "d": "pos"}), ["conv_id", "pos"]).select(
        "conv_id", F.col("pos").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY_DIGEST)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations as they stand."""
    return prefix_trie(*number_turns(conversations))


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations rebuilt on shared openings (``shared_openings``)."""
    return prefix_trie(*shared_openings(*number_turns(conversations)))
