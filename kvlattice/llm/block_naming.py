"""Exact deduplication by deterministic block naming (DataFrame operations only).

A text is normalised (A-Z lower-cased, null counted as empty) and cut into
blocks of ``block_bytes`` bytes. The distinct blocks are sorted and numbered:
equal blocks, and only they, share an integer name. Then adjacent names are
paired and the distinct pairs numbered in the same way, level by level, until
each text has one name. Two texts are equal exactly when level and name are.

Blocks travel once, to be named; everything after that moves integers. A block
finds its name by a 64-bit hash, which is used only where the naming has shown
that no second block has this hash; blocks with a shared hash are named by
their bytes (``_by_bytes``).

Defined cases: null text is the empty text (one empty block); repeated rows
count one by one in group_size and exactly one of them is kept; a null doc_id
sorts below all others; an empty table gives an empty result; further columns
are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, lookup, materialize, only

BLOCK_BYTES = 4096


def normalised(text: str) -> Column:
    return ascii_lower(F.coalesce(F.col(text).cast("string"), F.lit("")))


def _blocks(docs: DataFrame, text: str, block_bytes: int, hash_bits: int, keep: list[Column]) -> DataFrame:
    cut = f"transform(sequence(0, greatest(0, (octet_length(_norm) - 1) div {block_bytes})), i -> substring(cast(_norm as binary), cast(i * {block_bytes} + 1 as int), {block_bytes}))"
    found = docs.select(*keep, normalised(text).alias("_norm")).select("*", F.expr(cut).alias("_blocks"))
    out = found.select(*[c for c in found.columns if c not in ("_norm", "_blocks")], F.size("_blocks").alias("_size"), F.when(F.lit(bool(keep)), F.sha2("_norm", 256)).alias("_sha"), F.posexplode("_blocks").alias("_at", "_block"))
    h = F.xxhash64("_block")
    return out.withColumn("_h", h if hash_bits == 64 else F.pmod(h, F.lit(1 << hash_bits)))


def _numbered(distinct: DataFrame, by: list[str]) -> DataFrame:
    """Distinct rows sorted within the partitions of their shuffle; the names
    follow that order, so a task that runs again gives the same ones."""
    return distinct.sortWithinPartitions(*by).withColumn("_name", F.monotonically_increasing_id())


def _by_bytes(docs: DataFrame, text: str, block_bytes: int, hash_bits: int, shared: DataFrame, items: DataFrame) -> DataFrame:
    """Names, below zero, for the blocks whose hash another block shares."""
    own = _blocks(docs, text, block_bytes, hash_bits, [F.col("_id"), F.col("_sha0")]).join(shared, "_h", "left_semi").select("_id", "_sha0", "_at", "_block")
    own = materialize(own.distinct(), "shared-hash")
    named = _numbered(own.select("_block").distinct(), ["_block"]).withColumn("_name", -1 - F.col("_name"))
    named = own.join(materialize(named, "shared-names"), "_block").select("_id", "_sha0", "_at", "_name")
    same = items["_doc"].eqNullSafe(named["_id"]) & (items["_sha"] == named["_sha0"]) & (items["_at"] == named["_at"])
    return items.join(named, same).select(items["_row"], items["_at"], items["_size"], named["_name"])


def block_names(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, hash_bits: int = 64) -> DataFrame:
    """One row per input row: _row, _doc, _sha, _level, _name."""
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    keep = [F.monotonically_increasing_id().alias("_row"), F.col("_id").alias("_doc")]
    items = materialize(_blocks(base, "_text", block_bytes, hash_bits, keep).select("_row", "_doc", "_size", "_sha", "_at", "_h"), "block-items")
    distinct = _blocks(base, "_text", block_bytes, hash_bits, []).groupBy("_h", "_block").count()
    names = materialize(_numbered(distinct, ["_h", "_block"]).select("_h", "_name", F.col("count").alias("_n")), "block-names")
    by_hash = materialize(names.groupBy("_h").agg(F.min("_name").alias("_name"), F.sum("_n").alias("_n"), F.count("*").alias("_texts")), "block-hashes")
    now = lookup(items, by_hash.filter("_texts = 1").drop("_texts"), ["_h"], "_n").select("_row", "_at", "_size", "_name")
    if by_hash.filter("_texts > 1").limit(1).count():
        shared = by_hash.filter("_texts > 1").select("_h")
        again = base.withColumn("_sha0", F.sha2(normalised("_text"), 256))
        now = now.unionByName(_by_bytes(again, "_text", block_bytes, hash_bits, shared, items.join(shared, "_h", "left_semi")))
    now = materialize(now, "names-0")
    most = now.agg(F.max("_size")).first()[0] or 1
    done = [now.filter("_size = 1").select("_row", F.lit(0).alias("_level"), "_name")]
    now = now.filter("_size > 1")
    for level in range(1, math.ceil(math.log2(most)) + 1):
        side = lambda odd: F.max(F.when(F.col("_at") % 2 == odd, F.col("_name")))
        pairs = now.groupBy("_row", F.floor(F.col("_at") / 2).alias("_to")).agg(side(0).alias("_a"), side(1).alias("_b"), F.first("_size").alias("_was"))
        pairs = pairs.select("_row", F.col("_to").alias("_at"), F.ceil(F.col("_was") / 2).alias("_size"), "_a", F.struct(F.col("_b").isNull().alias("none"), F.coalesce("_b", F.lit(0)).alias("b")).alias("_b"))
        pairs = materialize(pairs, f"pairs-{level}")
        named = materialize(_numbered(pairs.groupBy("_a", "_b").agg(F.count("*").alias("_n")), ["_a", "_b"]), f"pair-names-{level}")
        now = materialize(lookup(pairs, named, ["_a", "_b"], "_n").select("_row", "_at", "_size", "_name"), f"names-{level}")
        done.append(now.filter("_size = 1").select("_row", F.lit(level).alias("_level"), "_name"))
        now = now.filter("_size > 1")
    named = done[0]
    for x in done[1:]:
        named = named.unionByName(x)
    rows = items.filter("_at = 0").select("_row", "_doc", "_sha")
    return materialize(rows.join(named, "_row"), "identities")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, hash_bits: int = 64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id is kept."""
    each = block_names(docs, id_col, text_col, block_bytes, hash_bits)
    best = F.max(F.struct("_doc", "_row")).alias("_best")
    groups = materialize(each.groupBy("_level", "_name").agg(best, F.count("*").alias("group_size")), "groups")
    return lookup(each, groups, ["_level", "_name"], "group_size").select(
        F.col("_doc").alias("doc_id"),
        F.col("_best._doc").alias("keep_id"),
        "group_size",
        (F.col("_row") == F.col("_best._row")).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that exact_dedup keeps, all columns as they are."""
    found = materialize(exact_dedup(docs, id_col, text_col), "exact")
    kept = found.filter("kept").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"))
    if not found.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        return only(docs, kept, id_col)
    # doc_ids repeat: tell rows apart by text, and keep one of equal rows
    kept = kept.select(F.col("id").alias("_kept_id"), F.col("sha").alias("_kept_sha"))
    same = docs[id_col].eqNullSafe(F.col("_kept_id")) & (F.sha2(normalised(text_col), 256) == F.col("_kept_sha"))
    each = Window.partitionBy("_kept_id", "_kept_sha").orderBy(id_col)
    rows = docs.join(kept, same).withColumn("_kept_rank", F.row_number().over(each))
    return rows.filter("_kept_rank = 1").select(*[docs[c] for c in docs.columns])
