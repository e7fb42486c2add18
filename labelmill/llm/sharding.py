"""Minimax contiguous partition of documents into shards.

Equal texts form an atomic group; groups are ordered by the digest of their text, so that a row knows its place without
a join and no stretch of the order is crowded. The smallest capacity that lets a greedy pass put the ordered groups into
the wanted number of shards is found by binary search. The search never holds all groups: it works on sums over digest
prefixes, tells from them between which groups a cut can lie, and refines only there until the answer is exact.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelmill.llm.common import stored

# Most prefix sums that are on the driver at a time, per level; hex digits of the first level and of row buckets.
BLOCKS, FIRST_DIGITS, ROW_DIGITS = 1 << 16, 4, 3


def text_key(text: Column) -> Column:
    """The digest that orders groups; null texts are a group of their own that comes first."""
    return F.coalesce(F.sha2(text.cast("binary"), 256), F.lit(""))


class Blocks:
    """Sums over consecutive stretches of the order; a stretch with one group can't be cut."""

    def __init__(self, names: list[str], sizes: np.ndarray, groups: np.ndarray):
        order = np.argsort(np.array(names, dtype="U64"), kind="stable") if names else np.empty(0, int)
        self.names = [names[i] for i in order]
        self.sizes, self.whole = sizes[order], groups[order] == 1
        self.upto = np.concatenate(([0], np.cumsum(self.sizes)))

    def filled(self, capacity: int, shards: int, generous: bool) -> list[int]:
        """Bytes before each cut of the greedy pass; generous: stretches with several groups may be cut at any byte."""
        at, cuts = 0, []
        for _ in range(shards):
            goal = at + capacity
            block = int(np.searchsorted(self.upto, goal, side="right")) - 1
            if generous and block < len(self.sizes) and not self.whole[block]:
                at = goal
            else:
                at = max(at, int(self.upto[block]))
            cuts.append(at)
        return cuts

    def smallest(self, shards: int, generous: bool) -> int:
        total = int(self.upto[-1])
        low, high = -(-total // shards), total
        while low < high:
            middle = (low + high) // 2
            if self.filled(middle, shards, generous)[-1] >= total:
                high = middle
            else:
                low = middle + 1
        return low


def capacity_and_cuts(groups: DataFrame, shards: int) -> tuple[int, list[str]]:
    """The smallest capacity, and for each cut a bound: greater digests lie behind it.

    ``groups`` holds ``(key, size)`` and is read once per level; a level collects at most about ``BLOCKS`` sums.
    """

    def sums(where: Column | None, digits: int) -> list:
        part = groups if where is None else groups.where(where)
        return part.groupBy(F.substring("key", 1, digits).alias("name")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()

    held = {row["name"]: (row["size"], row["n"], FIRST_DIGITS) for row in sums(None, FIRST_DIGITS)}
    while True:
        names = list(held)
        blocks = Blocks(names, np.array([held[n][0] for n in names], np.int64), np.array([held[n][1] for n in names], np.int64))
        low, high = blocks.smallest(shards, True), blocks.smallest(shards, False)
        unclear: dict[str, None] = {}
        for first, last in zip(blocks.filled(low, shards, False), blocks.filled(high, shards, True), strict=True):
            begin = max(0, int(np.searchsorted(blocks.upto, first, side="right")) - 1)
            end = int(np.searchsorted(blocks.upto, last, side="left"))
            unclear.update((blocks.names[i], None) for i in range(begin, min(end + 1, len(names))) if not blocks.whole[i])
        if low == high and not unclear or not names:
            break
        # refine the shortest of the unclear prefixes, as far as the bound allows
        digits = min(held[name][2] for name in unclear)
        some = [name for name in unclear if held[name][2] == digits]
        room = max(1, BLOCKS // len(some))
        finer = digits + max(1, (room.bit_length() - 1) // 4)
        ranges: list[list[str]] = []
        place = {name: i for i, name in enumerate(blocks.names)}
        for name in sorted(some):
            if ranges and place[name] == place[ranges[-1][1]] + 1:
                ranges[-1][1] = name
            else:
                ranges.append([name, name])
        where = F.lit(False)
        for a, b in ranges:
            where = where | F.col("key").between(a, b + "g")
        inner = [row for row in sums(where, finer) if row["name"][:digits] in set(some)] if len(ranges) <= 200 else [
            row for row in sums(F.substring("key", 1, digits).isin(some), finer)
        ]
        for name in some:
            del held[name]
        held |= {row["name"]: (row["size"], row["n"], finer) for row in inner}
    cuts = blocks.filled(high, shards, False)[:-1] if names else []
    total = int(blocks.upto[-1])
    bounds = []
    for cut in cuts:
        if cut < total:
            bounds.append(blocks.names[int(np.searchsorted(blocks.upto, cut, side="left")) - 1] + "g" if cut else "")
    return high if names else 0, bounds


def assign_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Every document with its shard and its gapless place there: the law is that sizes in bytes are nearly equal.

    ``(doc_id, size, text_crc32, law, shard, slot, grown_shard)``. The size is the text's UTF-8 bytes plus one; a null
    text has no bytes, checksum 0, and null texts stay together like equal texts do. Shards that the greedy pass does
    not need stay empty. Places follow the digest of the id; among rows of one id the checksum decides, and repeated rows
    are alike. An empty table gives no rows. Texts are read once; what moves is one narrow row per document and group.
    """
    raw = F.col("text").cast("binary")
    rows = stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(raw), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("text_crc32"),
            text_key(F.col("text")).alias("key"),
        ),
        "shard-rows",
    )
    groups = stored(rows.groupBy("key").agg(F.sum("size").alias("size")), "shard-groups")
    _, bounds = capacity_and_cuts(groups, shards)
    shard = sum((F.when(F.col("key") > bound, 1).otherwise(0) for bound in bounds), F.lit(0)).cast("int")
    placed = rows.select("doc_id", "size", "text_crc32", shard.alias("shard"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("_order"))
    placed = placed.withColumn("_bucket", F.substring("_order", 1, ROW_DIGITS))
    counts = placed.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # at most shards * 16**ROW_DIGITS rows
    offsets = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("shard", "_bucket").orderBy("_order", "doc_id", "text_crc32", "size")
    return placed.join(F.broadcast(offsets), ["shard", "_bucket"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_offset") + F.row_number().over(inside) - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
