"""SimHash near-duplicates, compared in bit-sliced form.

A bucket of fingerprints is stored as bit planes: word b of a block of 64 fingerprints holds their bits b. The distances
of a fingerprint to all 64 are counted at once by carry-save counters (ones, twos, over); a block is abandoned as soon as
every lane has passed the radius. Buckets come from the pigeonhole principle: two fingerprints within 2 bits agree in at
least two of four 16-bit quarters. A bucket over HOT fingerprints is dealt out again by two of the four bytes that are
left, so that no bucket holds over 2**16 distinct fingerprints, whatever the data.

Defined results: a null text counts as empty; texts without words have fingerprint zero and link to each other; fewer words
than a shingle make one shingle of the whole sequence; a null id never becomes a component's id, unless all are null; rows
are kept one to one; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm import common
from textloom.llm.components import components

SHINGLE, SEED, RADIUS = 3, 42, 2
HOT = 4096
#: Pairs of a fingerprint and a block of 64 that are compared at once.
ROWS = 1 << 16
FULL = np.uint64(2**64 - 1)


def shingle_hashes(words: list[bytes], n: int = SHINGLE, seed: int = SEED) -> list[int]:
    from xxhash import xxh64_intdigest

    if len(words) < n:
        return [xxh64_intdigest(b" ".join(words), seed)] if words else []
    join = b" ".join
    return [xxh64_intdigest(join(x), seed) for x in zip(*(words[k:] for k in range(n)), strict=False)]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprint of each run of hashes: the bits that are set in over half of them; empty runs have zero.

    Eight bits are counted at a time, in the byte lanes of one word; a lane holds 255 at most, so runs are summed up
    in pieces of 255.
    """
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    n = counts[full]
    starts = np.cumsum(n) - n
    parts = -(-n // 255)
    first = np.cumsum(parts) - parts
    at = np.repeat(starts, parts) + 255 * (np.arange(parts.sum()) - np.repeat(first, parts))
    lanes = np.uint64(0x0101010101010101)
    for k in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(k)) & lanes, at).view(np.uint8).reshape(-1, 8)
        bits = np.add.reduceat(sums.astype(np.int64), first, axis=0) * 2 > n[:, None]
        for j in range(8):
            out[full] |= bits[:, j].astype(np.uint64) << np.uint64(8 * j + k)
    return out


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE) -> DataFrame:
    """id_col, text_hash and fp (signed 64-bit) of each row."""

    def run(batches):
        for batch in batches:
            for b in common.pieces(batch, text_col, 4 << 20):
                rows = [shingle_hashes(x.lower().split(), n) for x in common.raw_texts(b, text_col)]
                counts = np.array([len(x) for x in rows], np.int64)
                flat = np.fromiter((h for x in rows for h in x), np.uint64, int(counts.sum()))
                fp = majority(flat, counts).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(id_col), b.column("text_hash"), pa.array(fp)], [id_col, "text_hash", "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(id_col, F.xxhash64(text_col).alias("text_hash"), text_col)
    return common.by_arrow(rows, run, f"`{id_col}` {kind}, text_hash bigint, fp bigint")


def slices(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bit planes [64, blocks] of fingerprints padded to blocks of 64, as [blocks, 64]."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(len(fps), 64, 8), axis=2, bitorder="little")
    planes = np.ascontiguousarray(np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little"))
    return np.ascontiguousarray(planes.view(np.uint64).reshape(len(fps), 64).T)


def within(planes: np.ndarray, block: np.ndarray, query: np.ndarray, lanes: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """For rows (query, block) the lanes at the radius or fewer bits, as (row, word of lanes); lanes: those that count.

    query: one word a row, or as many columns as planes have words. The counters start so far that a carry out of the last means over the radius.
    """
    row, query = np.arange(len(block)), query.reshape(len(block), -1)
    digits = radius.bit_length()
    start = (1 << digits) - 1 - radius
    counters = [np.full(len(block), FULL if start >> k & 1 else np.uint64(0)) for k in range(digits)]
    over = np.zeros(len(block), np.uint64)
    for b in range(len(planes)):
        carry = planes[b][block] ^ (np.uint64(0) - ((query[:, b >> 6] >> np.uint64(b & 63)) & np.uint64(1)))
        for k, x in enumerate(counters):
            counters[k], carry = x ^ carry, x & carry
        over |= carry
        if b % 4 == 3:
            left = (over | ~lanes) != FULL
            if not left.any():
                return row[:0], lanes[:0]
            if left.mean() < 0.6:
                row, block, query, lanes, over, *counters = (a[left] for a in (row, block, query, lanes, over, *counters))
    found = ~over & lanes
    hit = found != 0
    return row[hit], found[hit]


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while True:
        x, y = label[a], label[b]
        if not (apart := x != y).any():
            return
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def linked(buckets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Edges (u, v) that connect what is linked within each bucket of distinct fingerprints: one for each but the least."""
    buckets = [np.sort(x) for x in buckets]
    sizes = np.array([len(x) for x in buckets])
    words = -(-sizes // 64)
    first_item, first_block = np.cumsum(sizes) - sizes, np.cumsum(words) - words
    items = np.concatenate(buckets)
    padded = np.zeros((int(words.sum()), 64), np.int64)
    of = np.repeat(np.arange(len(buckets)), sizes)
    place = np.arange(len(items)) - first_item[of]
    padded[first_block[of] + place // 64, place % 64] = items
    planes = slices(padded.view(np.uint64))
    item_at = np.zeros(padded.shape, np.int64)
    item_at[first_block[of] + place // 64, place % 64] = np.arange(len(items))
    used = np.zeros(padded.shape[0], np.uint64)
    np.bitwise_or.at(used, first_block[of] + place // 64, np.uint64(1) << (place % 64).astype(np.uint64))
    label = np.arange(len(items))
    todo = words[of] - place // 64  # blocks from the item's own on
    stops = np.cumsum(todo)
    at = 0
    while at < len(items):
        end = max(at + 1, int(np.searchsorted(stops, (stops[at - 1] if at else 0) + ROWS)))
        who = np.repeat(np.arange(at, end), todo[at:end])
        step = np.arange(len(who)) - np.repeat(np.cumsum(todo[at:end]) - todo[at:end], todo[at:end])
        block = first_block[of[who]] + place[who] // 64 + step
        later = np.where(place[who] % 64 == 63, np.uint64(0), FULL << ((place[who] % 64 + 1) % 64).astype(np.uint64))
        lanes = used[block] & np.where(step == 0, later, FULL)
        row, found = within(planes, block, items.view(np.uint64)[who], lanes)
        if len(row):
            k, lane = np.nonzero(np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            unite(label, who[row[k]], item_at[block[row[k]], lane])
        at = end
    moved = np.flatnonzero(label != np.arange(len(items)))
    return items[moved], items[label[moved]]


def _bits(value: Column, at: int, n: int) -> Column:
    return F.shiftrightunsigned(value, at).bitwiseAND(F.lit((1 << n) - 1).cast("long"))


def _keys() -> Column:
    """For each pair of quarters: its number and both quarters, in one long."""
    x = F.col("fp")
    return F.array(*[(F.lit(t).cast("long") * (1 << 32) + _bits(x, 16 * i, 16) * (1 << 16) + _bits(x, 16 * j, 16)) for t, (i, j) in enumerate(combinations(range(4), 2))])


def _finer_keys() -> Column:
    """For a bucket of a pair of quarters: keys of each two of the four bytes outside them."""
    x, out = F.col("fp"), None
    for t, pair in enumerate(combinations(range(4), 2)):
        rest = [at for q in range(4) if q not in pair for at in (16 * q, 16 * q + 8)]
        keys = F.array(*[(F.lit(s).cast("long") * (1 << 16) + _bits(x, a, 8) * (1 << 8) + _bits(x, b, 8)) for s, (a, b) in enumerate(combinations(rest, 2))])
        when = F.shiftright("key", 32) == t
        out = F.when(when, keys) if out is None else out.when(when, keys)
    return out


def links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """fps: distinct fingerprints (fp) -> edges (u, v) whose components are those of all links."""

    def run(batches):
        for batch in batches:
            column = batch.column("fps")
            if batch.num_rows:
                flat, ends = column.flatten().to_numpy(), column.offsets.to_numpy() - column.offsets[0].as_py()
                u, v = linked([flat[ends[k] : ends[k + 1]] for k in range(batch.num_rows)])
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    keyed = fps.select("fp", F.explode(_keys()).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    full = keyed.join(sizes, "key")
    cold = full.where(F.col("n") <= hot).groupBy("key").agg(F.collect_list("fp").alias("fps"))
    finer = full.where(F.col("n") > hot).select("fp", "key", F.explode(_finer_keys()).alias("finer"))
    hots = finer.groupBy("key", "finer").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return common.by_arrow(cold.select("fps").unionByName(hots.select("fps")), run, "u bigint, v bigint")


def clustered(prints: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """prints (id_col, fp, ...) -> the same with component_id, the least id that is reachable by links, and root, which names the component even where ids repeat."""
    fps = common.written(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "simhash-least")
    roots = components(links(fps.select("fp"))).select(F.col("u").alias("fp"), "root")
    whole = fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = whole.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(whole.select("fp", "root").join(ids, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, fingerprint (16 hex digits), component_id of each row."""
    prints = common.written(fingerprints(df, id_col, text_col).drop("text_hash"), "simhash-prints")
    return clustered(prints, id_col).select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df with one row of each component, that of its least id; of rows that are alike one stays."""
    prints = common.written(fingerprints(df, id_col, text_col), "simhash-prints")
    groups = clustered(prints, id_col)
    kept = groups.groupBy("root").agg(F.min(F.struct(F.col(id_col).isNull().alias("x"), F.col(id_col).alias("i"), F.col("text_hash").alias("h"))).alias("k"))
    return rows_of(df, kept.select(F.col("k.i").alias("__i"), F.col("k.h").alias("__h")), id_col, text_col)


def rows_of(df: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of df with an id and a text hash of kept (__i, __h); of rows alike in both the one with the least hash of all its columns.

    Hashes of id and text are the only keys, so the join and the choice share one shuffle, and null ids need no case of their own.
    """
    keys = ["__a", "__t"]
    rows = df.withColumns({"__a": F.xxhash64(id_col), "__t": F.xxhash64(text_col)})
    wanted = kept.select(F.xxhash64("__i").alias("__a"), F.col("__h").alias("__t"))
    one = Window.partitionBy(*keys).orderBy(F.xxhash64(*df.columns))
    return rows.join(wanted, keys, "left_semi").withColumn("__n", F.row_number().over(one)).where("__n = 1").select(*df.columns)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir))
