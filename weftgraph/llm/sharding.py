"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Documents of equal text are a group.  Each group goes to the shard whose residual capacity has the largest dot product
with it, the largest groups first.  Groups beyond LARGE of a shard, of which there are few whatever the input, are packed
on the driver; one that would crowd a shard is dealt into pieces before.  The room that they leave is split among packers:
a packer is a task that has a hash share of the other groups, about GROUPS of them, and places each of them by the dot
product with its own part of every shard's residual capacity.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.llm import jobs
from weftgraph.llm.mixing import words

#: A group beyond LARGE of a shard is placed before the others; beyond CROWDED it goes in pieces of about PIECE.  Groups of
#: a packer, and rows of a cell, in which slots are numbered.
LARGE, CROWDED, PIECE, GROUPS, ROWS = 1 / 32, 9 / 10, 1 / 64, 20_000, 20_000
SIZES = ("bytes", "tokens", "rows")


def pack(items: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """Shard of each item (rows of sizes in each dimension) by the largest dot product with residual capacity.

    residual: capacity of each shard in each dimension, in units of a mean shard; what the items take is subtracted from
    it.  items are in the same units.  A shard that an item would overfill in some dimension is taken only where no other
    is left.  Ties go to the lowest shard; items go by their largest share of a shard, then in the order given.
    """
    place = np.zeros(len(items), dtype=np.int64)
    for k in np.argsort(-items.max(axis=1), kind="stable"):
        item = items[k]
        fits = (residual >= item - 1e-12).all(axis=1)
        best = int(np.argmax(np.where(fits, residual @ item, -np.inf) if fits.any() else residual.min(axis=1)))
        place[k] = best
        residual[best] -= item
    return place


def _packed(groups: DataFrame, room: np.ndarray) -> DataFrame:
    """(group, rows, packer, shard) of the groups (packer, group, bytes, tokens, rows); room: what each shard has for them."""
    shared = groups.sparkSession.sparkContext.broadcast(room)

    def place(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("group").to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        items = np.stack([table.column(c).to_numpy().astype(float) for c in SIZES], axis=1)
        # this packer's part of the room, in units of its mean shard
        unit = np.where(items.sum(axis=0) > 0, items.sum(axis=0) / len(shared.value), 1.0)
        free = np.clip(shared.value, 0.0, None)
        free = free / np.where(free.sum(axis=0) > 0, free.sum(axis=0) / len(free), 1.0)
        return table.select(["packer", "group", "rows"]).append_column("shard", pa.array(pack(items / unit, free), pa.int32()))

    return groups.groupBy("packer").applyInArrow(place, "packer long, group long, rows long, shard int")


def shard(docs: DataFrame, shards: int = 40, overhead: int = 16) -> DataFrame:
    """docs with the columns size, text_crc32, law, shard, slot and grown_shard, which replace columns of these names.

    docs has doc_id and text.  size is the UTF-8 bytes of the text plus `overhead`; a null text has no bytes and the
    checksum of the empty text, with which it shares a group.  law is `bytes`: the shards' sizes come out near equal.
    Rows of equal text share a shard unless they would fill nine tenths of one.  slot numbers a shard's rows from 0
    without gaps.  grown_shard is null.  Null doc_ids and repeated rows are rows like others; an empty table stays so.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    # equal texts agree in two hashes and the length
    base = docs.drop("size", "text_crc32", "law", "shard", "slot", "grown_shard").withColumns(
        {"size": F.octet_length(text).cast("long") + overhead, "text_crc32": F.crc32(text.cast("binary")), "__group": F.xxhash64(text, F.octet_length(text), F.crc32(text.cast("binary")))}
    )
    rest = [c for c in base.columns if c != "__group"]
    parts = base.select(F.col("__group").alias("group"), "size", words(F.col("text")).alias("tokens"))
    groups = jobs.stored(parts.groupBy("group").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")), "groups")
    total = groups.agg(F.count("*").alias("groups"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SIZES]).first()
    mean = np.array([max(1, total[c]) / shards for c in SIZES])
    part = F.greatest(*[F.col(c) / F.lit(float(m)) for c, m in zip(SIZES, mean, strict=True)])
    # at most shards / LARGE groups in each dimension are large
    large = groups.withColumn("part", part).where(F.col("part") > LARGE).orderBy("group").collect()
    units, owner, deals = [], [], []
    for g in large:
        pieces = int(np.ceil(g["part"] / PIECE)) if g["part"] > CROWDED else 1
        units += [[g[c] / pieces for c in SIZES]] * pieces
        owner += [(g["group"], k) for k in range(pieces)]
        deals.append((g["group"], pieces, -(-g["rows"] // ROWS)))
    room = np.ones((shards, len(SIZES)))
    homes = pack(np.array(units, float).reshape(len(units), len(SIZES)) / mean, room)
    home = F.broadcast(spark.createDataFrame([(*o, int(at)) for o, at in zip(owner, homes, strict=True)], "__home long, __at int, __shard int"))
    known = F.broadcast(spark.createDataFrame(deals, "__of_group long, __of_pieces int, __of_cells int"))
    packers = max(1, round(total["groups"] / GROUPS))
    small = groups.join(known.select("__of_group"), F.col("group") == F.col("__of_group"), "left_anti").withColumn("packer", F.pmod(F.xxhash64("group"), F.lit(packers)))
    assigned = jobs.stored(_packed(small, room), "assigned")
    jobs.discard(groups)

    held = base.join(known, F.col("__group") == F.col("__of_group"))
    held = jobs.numbered_in_groups(held, ["__group"], "__n") if large else held.withColumn("__n", F.lit(0).cast("long"))
    piece = (F.col("__n") % F.col("__of_pieces")).cast("int")
    cell = F.floor(F.col("__n") / F.col("__of_pieces")) % F.col("__of_cells")
    dealt = held.withColumns({"__piece": piece, "__cell": F.concat_ws(":", "__group", piece, cell)})
    dealt = dealt.join(home, (F.col("__group") == F.col("__home")) & (F.col("__piece") == F.col("__at")))
    dealt = dealt.select(*[F.col(f"`{c}`") for c in rest], "__group", "__shard", "__cell", "__n")
    rest_of = base.join(known.select("__of_group"), F.col("__group") == F.col("__of_group"), "left_anti")
    others = rest_of.join(assigned.select(F.col("group").alias("__home"), F.col("shard").alias("__shard"), F.col("packer").cast("string").alias("__cell")), F.col("__group") == F.col("__home"))
    others = others.select(*[F.col(f"`{c}`") for c in rest], "__group", "__shard", "__cell", F.lit(0).cast("long").alias("__n"))

    # rows of a shard before a cell, from the counts alone
    counted = assigned.select(F.col("shard").alias("__s"), F.col("packer").cast("string").alias("__c"), "rows").unionByName(dealt.select(F.col("__shard").alias("__s"), F.col("__cell").alias("__c"), F.lit(1).cast("long").alias("rows")))
    counted = counted.groupBy("__s", "__c").agg(F.sum("rows").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("__s").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = jobs.stored(counted.select("__s", "__c", before.alias("__first")), "first")
    inside = Window.partitionBy("__shard", "__cell").orderBy("doc_id", "__group", "__n")
    every = others.unionByName(dealt).withColumn("__own", F.row_number().over(inside) - 1)
    every = every.join(first, (F.col("__shard") == F.col("__s")) & (F.col("__cell") == F.col("__c")))
    return every.select(*[F.col(f"`{c}`") for c in rest], F.lit("bytes").alias("law"), F.col("__shard").alias("shard"), (F.col("__first") + F.col("__own")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole `documents` in 40 shards."""
    placed = shard(jobs.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
