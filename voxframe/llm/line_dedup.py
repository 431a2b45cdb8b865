"""Near-duplicate lines across documents by a deletion-neighbourhood join.

The unit of an edit is a word in lines of LEAST_UNITS words or more, and a character in
shorter ones, which includes lines of scripts without spaces. Two lines are near when
they have the same unit, one unit inserted, deleted or replaced turns one into the
other, and the longer has at least LEAST_UNITS of them, so that they agree in 0.8 of it
or more; lines of fewer characters are near only if equal. A line goes when an equal or
a near line occurs earlier (by document id, then line number); this is judged on the
input, not on what is left. Blank lines stay, and lines keep their order.

Words are what single spaces separate; a line of white space is blank.

1. Equal lines become one class with its first position.
2. A pair within one edit shares its first or last half. Only classes that share
   a half with another class are read again; this loses none.
3. Each of those emits the hashed variants with one unit deleted. Equal variants
   meet in an aggregate that keeps the earliest line of a key, so a common variant
   gives one row a line and no list of pairs.
4. Every hit is verified on the units before it counts.

Everything runs as DataFrame functions. Null texts stay null; empty texts stay
empty. Rows of one document id are one document (equal positions are one line);
null ids count as one document, after all others. Extra columns are kept, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, free_name, materialize

LEAST_UNITS = 5
#: Pairs up to which both ends are sent to all tasks (two longs a pair).
SENT_HITS = 1_000_000


def units_of(line: Column) -> Column:
    """The words of a line; of a line of fewer than LEAST_UNITS words its characters, each behind a line feed, which no word holds."""
    words = F.array_remove(F.split(line, " "), "")
    signs = F.transform(F.array_remove(F.split(line, ""), ""), lambda x: F.concat(F.lit("\n"), x))
    return F.when(F.size(words) >= LEAST_UNITS, words).otherwise(signs)


def is_blank(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r\f")) == ""


def _half_keys(words: Column, n: Column) -> list[Column]:
    """Hashes of the first and last half, for the line as the longer or equal one (r = n) and as the shorter (r = n + 1)."""
    keys = []
    for grown in (0, 1):
        r = n + grown
        head = F.floor(r / 2).cast("int")
        tail = r - head
        for side, part in ((0, F.slice(words, F.lit(1), head)), (1, F.slice(words, n - tail + 1, tail))):
            keys.append(F.when(r >= LEAST_UNITS, F.xxhash64(r, F.lit(side), part)))
    return keys


def line_classes(docs: DataFrame) -> DataFrame:
    """One row per distinct line that is not blank: its 128-bit key, word count, half keys, first position."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).filter(~is_blank(F.col("line")))
    keyed = lines.select(
        F.col("doc_id").isNull().alias("no_id"), "doc_id", "line_no", F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), "line").alias("k2"),
        units_of(F.col("line")).alias("w")).withColumn("n", F.size("w"))
    return keyed.select("no_id", "doc_id", "line_no", "k1", "k2", "n", *(
        k.alias(f"h{i}") for i, k in enumerate(_half_keys(F.col("w"), F.col("n"))))).groupBy("k1", "k2", "n", "h0", "h1", "h2", "h3").agg(
        F.min(F.struct("no_id", "doc_id", "line_no")).alias("first")).select("k1", "k2", "n", "h0", "h1", "h2", "h3", "first.*")


#: What a candidate has to emit: variants with a word of its first half (head) or last half (tail)
#: deleted, to meet lines as long (same) or shorter by one (less); or itself, to meet longer ones.
ROLES = ("same_tail", "same_head", "less_tail", "less_head", "whole")


def _candidates(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Classes that share a half with another class, with their words, their roles and ``ord``, a number in order of first position."""
    halves = classes.select("k1", "k2", F.posexplode(F.array("h0", "h1", "h2", "h3")).alias("which", "half")).filter("half is not null")
    shared = halves.groupBy("half").agg(
        F.min(F.expr("case when which < 2 then k1 end")).alias("lo"), F.max(F.expr("case when which < 2 then k1 end")).alias("hi"),
        F.max(F.expr("which >= 2")).alias("shorter")).filter("lo <> hi or (lo is not null and shorter)")
    role = {"same_tail": "which = 0 and lo <> hi", "same_head": "which = 1 and lo <> hi",
            "less_tail": "which = 0 and shorter", "less_head": "which = 1 and shorter", "whole": "which >= 2"}
    wanted = halves.join(shared, "half").groupBy("k1", "k2").agg(*(F.max(F.expr(role[r])).alias(r) for r in ROLES)).filter(
        " or ".join(ROLES))
    roles = materialize(wanted, "roles")
    places = classes.select("no_id", "doc_id", "line_no", "k1", "k2", "n").join(roles, ["k1", "k2"])
    # numbered while narrow: texts are not moved for their order
    position = [F.col("no_id"), F.col("doc_id"), F.col("line_no"), F.col("k1")]
    placed = materialize(places.repartitionByRange(*position).sortWithinPartitions(*position).withColumn("ord", F.monotonically_increasing_id()), "places")
    by_doc = placed.groupBy("doc_id").agg(F.collect_list(F.struct("line_no", "k1", "k2", "n", *ROLES, "ord")).alias("places")).withColumnRenamed("doc_id", "id")
    texts = docs.select("doc_id", F.split("text", "\n").alias("lines")).join(by_doc, F.col("doc_id").eqNullSafe(F.col("id")))
    found = texts.select("lines", F.explode("places").alias("p")).select("p.*", F.get("lines", F.col("p.line_no")).alias("line")).filter(
        (F.xxhash64("line") == F.col("k1")) & (F.xxhash64(F.lit(1), "line") == F.col("k2")))
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count():
        found = found.dropDuplicates(["k1", "k2"])
    lines = materialize(found.select("k1", "k2", "n", *ROLES, "ord", units_of(F.col("line")).alias("w")), "lines")
    discard(roles, placed)
    return lines


#: Kinds of keys: one word deleted, with its place; one word deleted; the line itself, to meet the second.
SAME, LESS, WHOLE = 0, 1, 2


def _variants(lines: DataFrame) -> DataFrame:
    """Hashed keys (ord, key, kind) of the variants that a line's roles ask for.

    The hash of a word list is the exclusive-or of hashes of (word, place). Deleting word i
    moves the later words by one, so the hash of the next deletion follows from the last one
    in two steps, whatever the length.
    """
    here = F.transform("w", lambda x, i: F.xxhash64(x, i))
    moved = F.transform("w", lambda x, i: F.xxhash64(x, i - 1))
    xor = lambda a, x: a.bitwiseXOR(x)
    zero = F.lit(0).cast("long")
    hashed = lines.select("n", "ord", *ROLES, here.alias("v"), moved.alias("u"))
    steps = F.zip_with(F.slice("v", F.lit(1), F.col("n") - 1), F.slice("u", F.lit(2), F.col("n") - 1), xor)
    start = F.aggregate(F.slice("u", F.lit(2), F.greatest(F.col("n") - 1, F.lit(0))), zero, xor)
    deleted = F.aggregate(
        steps, F.struct(start.alias("last"), F.array(start).alias("all")),
        lambda s, x: F.struct(s["last"].bitwiseXOR(x).alias("last"), F.concat(s["all"], F.array(s["last"].bitwiseXOR(x))).alias("all")),
        lambda s: s["all"])
    head = F.floor(F.col("n") / 2).cast("int")
    prepared = hashed.select("n", "ord", head.alias("head"), *ROLES, F.aggregate("v", zero, xor).alias("total"), deleted.alias("deleted"))

    def part(side: str, kind: int):
        cut = F.slice("deleted", F.lit(1), F.col("head")) if side == "head" else F.slice("deleted", F.col("head") + 1, F.col("n"))
        first = F.lit(0) if side == "head" else F.col("head")
        key = (lambda d, i: F.xxhash64("n", first + i, d)) if kind == SAME else (lambda d, i: F.xxhash64(F.col("n") - 1, d))
        made = F.transform(cut, lambda d, i: F.struct(key(d, i).alias("key"), F.lit(kind).alias("kind")))
        return F.when(F.col(("same_" if kind == SAME else "less_") + side), made).otherwise(F.slice(made, 1, 0))

    own = F.array(F.struct(F.xxhash64("n", "total").alias("key"), F.lit(WHOLE).alias("kind")))
    emitted = F.concat(part("head", SAME), part("tail", SAME), part("head", LESS), part("tail", LESS), F.when(F.col("whole"), own).otherwise(F.slice(own, 1, 0)))
    return prepared.select("ord", F.explode(emitted).alias("e")).select("ord", "e.key", "e.kind")


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether two word lists differ by at most one word inserted, deleted or replaced."""
    def without_first_difference(longer: Column, shorter: Column) -> Column:
        at = F.array_position(F.zip_with(longer, shorter, lambda x, y: x.eqNullSafe(y)), False).cast("int")
        return F.concat(F.slice(longer, F.lit(1), at - 1), F.slice(longer, at + 1, F.size(longer))) == shorter

    differing = F.size(F.filter(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda same: ~same))
    return F.when(F.size(a) == F.size(b), differing <= 1).when(F.size(a) == F.size(b) + 1, without_first_difference(a, b)).when(
        F.size(b) == F.size(a) + 1, without_first_difference(b, a)).otherwise(False)


def near_classes(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """k1, k2 of the classes that have a near line earlier than their own first position."""
    lines = _candidates(classes, docs)
    variants = materialize(_variants(lines), "variants")
    least = lambda kind, name: F.min(F.when(F.col("kind") == kind, F.col("ord"))).alias(name)
    meets = variants.groupBy("key").agg(
        least(SAME, "same"), F.max(F.when(F.col("kind") == SAME, F.col("ord"))).alias("most"), least(LESS, "less"), least(WHOLE, "all")).filter(
        "same < most or (less is not null and all is not null)")
    partner = F.when(F.col("kind") == SAME, F.col("same")).when(F.col("kind") == LESS, F.col("all")).otherwise(F.col("less"))
    hits = materialize(variants.join(meets, "key").select("ord", partner.alias("earlier")).filter("earlier < ord").distinct(), "hits")
    discard(variants)
    # few hits are sent to the lines, so that only the lines concerned are moved; many are joined by shuffle
    either = hits.select(F.explode(F.array("ord", "earlier")).alias("ord")).distinct()
    met = lines.select("ord", "k1", "k2", "w").join(F.broadcast(either) if hits.count() <= SENT_HITS else either, "ord", "left_semi")
    pairs = hits.join(met.withColumnRenamed("w", "a"), "ord").join(met.select(F.col("ord").alias("earlier"), F.col("w").alias("b")), "earlier")
    near = materialize(pairs.filter(within_one_edit(F.col("a"), F.col("b"))).select("k1", "k2").distinct(), "near-classes")
    discard(lines, hits)
    return near


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` reduced to the lines kept; all other columns as they are."""
    named = docs.select("doc_id", "text")
    classes = materialize(line_classes(named), "line-classes")
    near = near_classes(classes, named)
    kept_name, id_name, lines_name = (free_name(docs, n) for n in ("kept", "id", "lines"))
    kept = classes.join(near, ["k1", "k2"], "left_anti").groupBy("doc_id").agg(
        F.collect_list("line_no").alias(kept_name)).withColumnRenamed("doc_id", id_name)
    # the lines are split below the join, so that no later expression splits a text again
    split = docs.withColumn(lines_name, F.split("text", "\n")).drop("text")
    joined = split.join(kept, F.col("doc_id").eqNullSafe(F.col(id_name)), "left")
    blank = F.filter(F.transform(lines_name, lambda x, i: F.when(is_blank(x), i)), lambda i: i.isNotNull())
    order = F.array_sort(F.concat(blank, F.coalesce(kept_name, F.array().cast("array<int>"))))
    text = F.array_join(F.transform(order, lambda i: F.get(lines_name, i)), "\n")
    return joined.withColumn("text", F.when(F.col(lines_name).isNotNull(), text)).select(*(f"`{c}`" for c in docs.columns))
