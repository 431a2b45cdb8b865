"""Registered queries of the corpus operators; added by the entry module when this package is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, decontaminate, language, line_dedup, negatives, packing, sharding, simhash, suffix_dedup, tiff, token_counts, toxicity, trie, wrapper


def op1_min_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(common.documents(spark, sf_dir)).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_pigeonhole_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return sharding.shuffle_into_shards(docs, shards=16).select(
        "doc_id", (F.length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = common.materialize(token_counts.write_flat(common.documents(spark, sf_dir)), "flat")
    counts = token_counts.scan_separators(flat.filter("data is not null"))
    return counts.join(token_counts.document_names(flat), ["file", "ordinal"]).select("doc_id", "n_tokens", "start", "ended")


def op5_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = tiff.store_texts(common.documents(spark, sf_dir)).withColumns(
        {"media_bytes": F.length("content").cast("long"), "media_sha256": F.sha2("content", 256)})
    return media_digest(tiff.tiff_pages(stored).drop("content"))


MEDIA = ("doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
         "feature string")


def media_digest(pages: DataFrame) -> DataFrame:
    """One row per file from the rows of its pages, which ``tiff_pages`` leaves next to one another in their task."""
    import zlib
    from hashlib import sha256

    import numpy as np
    import pyarrow as pa

    names = [x.split()[0] for x in MEDIA.split(", ")]

    def run(batches):
        held: list[dict] = []

        def digest() -> tuple:
            if any(p["error"] for p in held):
                raise ValueError(f"stored file of document {held[0]['doc_id']}: {held[-1]['error']}")
            pixels = b"".join(p["pixels"] for p in held)
            sample = np.frombuffer(pixels, np.uint8)
            feature = (f"pages={len(held)} width={held[0]['width']} height={sum(p['height'] for p in held)} mean={sample.mean():.4f} "
                       f"std={sample.std():.4f} spaces={np.count_nonzero(sample == 32)}")
            first = held[0]
            return (first["doc_id"], first["n_bytes"], len(pixels), sha256(pixels).hexdigest(), zlib.crc32(pixels[-32:]),
                    first["media_bytes"], first["media_sha256"], feature)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.string() if n in ("payload_sha256", "media_sha256", "feature") else pa.int64() for n in names]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            rows = []
            for page in batch.to_pylist():
                if held and not page["page"]:
                    rows.append(digest())
                    held.clear()
                held.append(page)
            if rows:
                yield batch_of(rows)
        if held:
            yield batch_of([digest()])

    return pages.mapInArrow(run, MEDIA)


def op6_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(common.documents(spark, sf_dir), words=4, budget=4)


def op7_line_deletion_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return line_dedup.dedup_lines(docs.select("doc_id", "text", F.size(F.split("text", "\n")).alias("n_lines")))


def op8_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return suffix_dedup.remove_repeats(common.documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_subword_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(common.documents(spark, sf_dir))


def op12_contracted_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.rebuilt_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_strassen_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = negatives.quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.mine(rows, F.col("vec_id") % 50 == 0).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: crc32 bit by bit over the decimal digits; prefixes are lists of turns, a node's ancestors the prefixes of its smallest member.
TRIE_SQL = """
WITH o AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS pos, role, text
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
n AS (SELECT conv_id, count(*) AS n, conv_id - conv_id % 100 AS base,
  xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda a, b: list_reduce(list_prepend(xor(a, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)) + y))) % 6 AS h
  FROM o GROUP BY conv_id),
p AS (SELECT n.*, least(h, coalesce(b.nb, 0)) AS taken FROM n LEFT JOIN (SELECT conv_id AS bid, n AS nb FROM n) b ON b.bid = n.base),
r AS (
  SELECT p.conv_id, o.pos - p.h + p.taken AS pos, o.role, o.text FROM o JOIN p ON o.conv_id = p.conv_id WHERE o.pos > p.h
  UNION ALL SELECT p.conv_id, o.pos, o.role, o.text FROM p JOIN o ON o.conv_id = p.base WHERE o.pos <= p.taken),
sizes AS (SELECT conv_id, taken + greatest(n - h, 0) AS n FROM p),
k AS (
  SELECT conv_id, pos, length(text) AS chars, sha256(CAST(list(sha256(length(role) || ':' || role || text)) OVER (PARTITION BY conv_id ORDER BY pos) AS VARCHAR)) AS key FROM r
  UNION ALL SELECT conv_id, 0, 0, '' FROM sizes),
nodes AS (SELECT key, pos AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars FROM k GROUP BY key, pos),
up AS (
  SELECT nodes.*, parent.conv_id AS parent_conv_id FROM nodes LEFT JOIN k ON k.conv_id = nodes.conv_id AND k.pos = nodes.depth - 1
  LEFT JOIN nodes parent ON parent.key = k.key AND parent.depth = k.pos),
kids AS (SELECT parent_conv_id, depth - 1 AS depth, count(*) AS n_children FROM up WHERE parent_conv_id IS NOT NULL GROUP BY ALL),
full_nodes AS (SELECT up.*, coalesce(n_children, 0) AS n_children FROM up LEFT JOIN kids ON kids.parent_conv_id = up.conv_id AND kids.depth = up.depth),
sums AS (
  SELECT k.key, k.pos AS depth, count(*) FILTER (WHERE f.n_children = 0) AS n_leaves, sum((f.n_convs - 1) * f.chars) AS saved_tokens
  FROM full_nodes f JOIN k ON k.conv_id = f.conv_id AND k.pos <= f.depth GROUP BY ALL),
ends AS (
  SELECT k.key, k.pos AS depth, sha256(string_agg(CAST(k.conv_id AS VARCHAR), ',' ORDER BY k.conv_id)) AS ends_sha256
  FROM k JOIN sizes ON sizes.conv_id = k.conv_id AND sizes.n = k.pos GROUP BY ALL)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, f.parent_conv_id, f.n_convs, f.n_children, CAST(sums.n_leaves AS BIGINT) AS n_leaves,
  CAST(sums.saved_tokens AS BIGINT) AS saved_tokens, coalesce(ends.ends_sha256, sha256('')) AS ends_sha256
FROM full_nodes f JOIN sums ON sums.key = f.key AND sums.depth = f.depth LEFT JOIN ends ON ends.key = f.key AND ends.depth = f.depth
"""

NEGATIVES_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, list_sum(list_transform(list_zip(a.q, b.q), lambda t: t[1] * t[2])) AS score
  FROM e a JOIN e b ON b.vec_id <> a.vec_id WHERE a.vec_id % 50 = 0),
pos AS (SELECT anchor_id, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
neg AS (
  SELECT pos.anchor_id, pos.id AS positive_id, s.id AS negative_id, pos.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY pos.anchor_id, pos.id ORDER BY s.score DESC, s.id) AS rank
  FROM pos JOIN s ON s.anchor_id = pos.anchor_id AND NOT s.same AND 50 * pos.score <= 100 * s.score AND 100 * s.score <= 95 * pos.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, CAST(positive_score AS BIGINT) AS positive_score, CAST(negative_score AS BIGINT) AS negative_score
FROM neg WHERE rank <= 3
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_min_bin_slack_packing": op1_min_bin_slack_packing,
        "op2_pigeonhole_decontamination": op2_pigeonhole_decontamination,
        "op3_two_pass_shuffle": op3_two_pass_shuffle,
        "op4_separator_scan": op4_separator_scan,
        "op5_tiff_pages": op5_tiff_pages,
        "op6_simhash_trie": op6_simhash_trie,
        "op7_line_deletion_join": op7_line_deletion_join,
        "op8_compression_toxicity": op8_compression_toxicity,
        "op9_wrapper_induction": op9_wrapper_induction,
        "op10_run_length_index": op10_run_length_index,
        "op11_subword_language": op11_subword_language,
        "op12_contracted_trie": op12_contracted_trie,
        "op13_strassen_negatives": op13_strassen_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {"op12_contracted_trie": TRIE_SQL, "op13_strassen_negatives": NEGATIVES_SQL}
