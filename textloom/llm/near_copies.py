"""Near copies by five-word shingles: texts link if the Jaccard similarity of their distinct shingles is 0.8 or more.

The comparison is that of op7, bit-sliced, with this stage's own values: a SimHash of WORDS * 64 bits over the distinct five-word
shingles, and a radius of 47 bits. Every link is found by it, and verified by the whole shingle sets. At a similarity of 0.8 a bit
differs with a chance of 0.1875 at most (four shingles against the same and a fifth; 0.15 for long texts), so a pair is over the radius with a chance of
5.3e-7 at most; two random fingerprints are within it with one of 0.0017. No piece of a fingerprint that is long enough for a bucket stays
equal at such distances, as quarters do at op7's two bits, so what is compared with what is dealt by BANDS keys of ROWS MinHash values each: at a
similarity of just 0.8 a pair shares none with a chance of (1 - 0.8**ROWS)**BANDS, 1.5e-5, and rarer above.

Equal sets are one. First each set of a bucket meets the bucket's least one, so a large group of copies costs no pairs of its members; then, where a
bucket still spans several components, all its members meet in blocks of 64.

Defined results: words are lower-case runs without white space; fewer words than a shingle make one shingle of the whole
sequence; texts without words, null ones too, link to each other; null ids come last; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import common, decontam, simhash
from textloom.llm.components import components

THRESHOLD, ROWS, BANDS = 0.8, 5, 28
#: Words of a fingerprint, and the bits in which linked ones differ at most.
WORDS, RADIUS = 2, 47
#: Bytes of shingles of a bucket's part.
BLOCK = 512 << 10
#: Parts of buckets whose fingerprints are laid out together, and pairs of fingerprints that are compared at once.
GROUPS, PAIRS = 256, 1 << 19
_C = np.uint64(0x94D049BB133111EB)
_SEEDS = np.arange(1, 2 * WORDS, 2, dtype=np.uint64) * _C


class WordHashes(dict):
    """64-bit hash of a word, never 0."""

    def __missing__(self, word: str) -> int:
        from xxhash import xxh64_intdigest

        h = xxh64_intdigest(word.encode(), 42) or 1
        if len(self) < 250_000:
            self[word] = h
        return h


def shingle_sets(texts: list[str], hashes: WordHashes) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    flat, n = decontam.shingled(texts, hashes)
    ends = np.cumsum(n)
    return [np.unique(flat[b - k : b]) for b, k in zip(ends, n, strict=True)]


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """[sets, BANDS] keys of sets that are not empty."""
    flat = np.concatenate(sets)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    starts = np.cumsum(sizes) - sizes
    seeds = decontam._mixed(np.arange(1, ROWS * BANDS + 1, dtype=np.uint64) * _C)
    out = np.zeros((len(sets), BANDS), np.uint64)
    for b in range(BANDS):
        for seed in seeds[b * ROWS : (b + 1) * ROWS]:
            h = (flat ^ seed) * (seed | np.uint64(1))
            h ^= h >> np.uint64(32)
            h *= _C
            out[:, b] = decontam._mixed(out[:, b] * _C + np.minimum.reduceat(h, starts))
        out[:, b] = decontam._mixed(out[:, b] ^ np.uint64(b + 1))
    return out


def signatures(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id_col, text_hash, s (names the shingle set), n (its size) and the keys of its bands, of each row."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            for b in common.pieces(batch, text_col, 1 << 20):
                sets = shingle_sets(common.texts(b, text_col), hashes)
                full = [k for k, x in enumerate(sets) if len(x)]
                keys = band_keys([sets[k] for k in full]) if full else np.zeros((0, BANDS), np.uint64)
                n = np.fromiter(map(len, sets), np.int64, len(sets))
                ends = np.concatenate(([0], np.cumsum((n > 0) * BANDS))).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(id_col), b.column("text_hash"), pa.array(names(sets)), pa.array(n), bands], [id_col, "text_hash", "s", "n", "bands"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(id_col, F.xxhash64(text_col).alias("text_hash"), text_col)
    return common.by_arrow(rows, run, f"`{id_col}` {kind}, text_hash bigint, s bigint, n bigint, bands array<bigint>")


def names(sets: list[np.ndarray]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter((xxh64_intdigest(x.tobytes(), 7) if len(x) else 0 for x in sets), np.uint64, len(sets)).view(np.int64)


def prints_of(sets: list[np.ndarray]) -> np.ndarray:
    """[sets, WORDS] SimHash of each set of shingles, each word of a hash of its own."""
    flat, sizes = np.concatenate([np.zeros(0, np.uint64), *sets]), np.fromiter(map(len, sets), np.int64, len(sets))
    return np.stack([simhash.majority(decontam._mixed(flat ^ seed), sizes) for seed in _SEEDS], axis=1)


def stored_sets(df: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """s, its shingles and its fingerprint, once, for the wanted rows (__i, __h)."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            for b in common.pieces(batch, text_col, 1 << 20):
                sets = shingle_sets(common.texts(b, text_col), hashes)
                fp = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * WORDS), len(sets), [None, pa.py_buffer(prints_of(sets).tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(names(sets)), pa.array([x.tobytes() for x in sets], pa.binary()), fp.cast(pa.binary())], ["s", "shingles", "fp"])

    rows = simhash.rows_of(df, wanted, id_col, text_col).select(text_col)
    return common.written(common.by_arrow(rows, run, "s bigint, shingles binary, fp binary"), "near-copies")


def words_of(column: pa.Array) -> np.ndarray:
    """[rows, WORDS] of a column of fingerprints."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, WORDS)


def laid(fps: np.ndarray, block: np.ndarray, lane: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bit planes [WORDS * 64, blocks] of fingerprints at their blocks and lanes, and the lanes of each block that are taken."""
    n = int(block[-1]) + 1
    out, used = np.zeros((n, 64, WORDS), np.uint64), np.zeros(n, np.uint64)
    out[block, lane] = fps
    np.bitwise_or.at(used, block, np.uint64(1) << lane.astype(np.uint64))
    return np.concatenate([simhash.slices(np.ascontiguousarray(out[:, :, w])) for w in range(WORDS)]), used


def lanes_of(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in found, lane) of the bits that are set."""
    return np.nonzero(np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))


def close(u: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Whether fingerprints a[k] and b[k] are within the radius; a is one for each u, and meets the b of its u in blocks of 64."""
    out = np.zeros(len(u), bool)
    if not len(u):
        return out
    order = np.argsort(u, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], u[order][1:] != u[order][:-1])))
    sizes = np.diff(np.append(first, len(u)))
    blocks = -(-sizes // 64)
    place = np.arange(len(u)) - np.repeat(first, sizes)
    block = np.repeat(np.cumsum(blocks) - blocks, sizes) + place // 64
    planes, used = laid(b[order], block, place % 64)
    row, found = simhash.within(planes, np.arange(len(used)), a[order][np.repeat(first, blocks)], used, radius)
    hit = np.zeros((len(used), 64), bool)
    k, lane = lanes_of(found)
    hit[row[k], lane] = True
    out[order] = hit[block, place % 64]
    return out


def compared(pairs: DataFrame, sets: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The pairs (u, v) whose fingerprints are within the radius."""

    def run(batches):
        for batch in batches:
            mask = close(batch.column("u").to_numpy(), words_of(batch.column("a")), words_of(batch.column("b")), radius)
            yield batch.select(["u", "v"]).filter(pa.array(mask, pa.bool_()))

    a, b = sets.select(F.col("s").alias("u"), F.col("fp").alias("a")), sets.select(F.col("s").alias("v"), F.col("fp").alias("b"))
    return common.by_arrow(pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b"), run, "u bigint, v bigint")


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) at the threshold."""

    def run(batches):
        for batch in batches:
            good = []
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                a, b = (np.frombuffer(x.as_buffer(), np.uint64) for x in (a, b))
                at = np.minimum(np.searchsorted(a, b), len(a) - 1)
                shared = int((a[at] == b).sum())
                good.append(shared >= THRESHOLD * (len(a) + len(b) - shared) - 1e-9)
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    a, b = sets.select(F.col("s").alias("u"), F.col("shingles").alias("a")), sets.select(F.col("s").alias("v"), F.col("shingles").alias("b"))
    return common.by_arrow(pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b"), run, "u bigint, v bigint")


def partners(fps: np.ndarray, sizes: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(a, b), a < b, by a: the places of all fingerprints of one group within the radius, PAIRS at once at most; the groups, of these sizes, stand one after another."""
    blocks = -(-sizes // 64)
    group = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(fps)) - (np.cumsum(sizes) - sizes)[group]
    first = (np.cumsum(blocks) - blocks)[group]
    planes, used = laid(fps, first + place // 64, place % 64)
    at = np.zeros((len(used), 64), np.int64)
    at[first + place // 64, place % 64] = np.arange(len(fps))
    todo = blocks[group] - place // 64  # blocks from the place's own on
    stops, lo = np.cumsum(todo), 0
    while lo < len(fps):
        hi = max(lo + 1, int(np.searchsorted(stops, (stops[lo - 1] if lo else 0) + PAIRS // 64, side="right")))
        who = np.repeat(np.arange(lo, hi), todo[lo:hi])
        step = np.arange(len(who)) - np.repeat(np.cumsum(todo[lo:hi]) - todo[lo:hi], todo[lo:hi])
        block = first[who] + place[who] // 64 + step
        later = np.where(place[who] % 64 == 63, np.uint64(0), simhash.FULL << ((place[who] % 64 + 1) % 64).astype(np.uint64))
        row, found = simhash.within(planes, block, fps[who], used[block] & np.where(step == 0, later, simhash.FULL), radius)
        k, lane = lanes_of(found)
        yield who[row[k]], at[block[row[k]], lane]
        lo = hi


def united(sets: list[np.ndarray], roots: np.ndarray, fps: np.ndarray, groups: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Edges between roots that connect those of all sets of a group at the threshold, among pairs whose fingerprints are within the radius.

    groups: sizes of the groups, which stand one after another. A set that has a partner in another component marks its shingles, and all of its group are counted at once.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    ends = np.cumsum(groups)
    distinct, at = np.unique(roots, return_inverse=True)
    label, now = np.arange(len(distinct)), -1
    for a, b in partners(fps, groups, radius):
        apart = label[at[a]] != label[at[b]]
        a, b = a[apart], b[apart]
        who, first = np.unique(a, return_index=True)
        for k, mates in zip(who, np.split(b, first[1:]), strict=False):
            mates = mates[label[at[mates]] != label[at[k]]]
            if not len(mates):
                continue
            g = int(np.searchsorted(ends, k, side="right"))
            lo, hi = ends[g] - groups[g], ends[g]
            if g != now:
                now, starts = g, np.cumsum(sizes[lo:hi]) - sizes[lo:hi]
                number = np.unique(np.concatenate(sets[lo:hi]), return_inverse=True)[1]
                marked = np.zeros(number.max() + 1, bool)
            own = number[starts[k - lo] : starts[k - lo] + sizes[k]]
            marked[own] = True
            shared = np.add.reduceat(marked[number], starts, dtype=np.int64)[mates - lo]
            marked[own] = False
            near = np.unique(at[mates[shared >= THRESHOLD * (sizes[k] + sizes[mates] - shared) - 1e-9]])
            if len(near):
                simhash.unite(label, np.full(len(near), at[k]), near)
    moved = np.flatnonzero(label != np.arange(len(label)))
    return distinct[moved], distinct[label[moved]]


def across(left: DataFrame, sets: DataFrame, radius: int = RADIUS) -> DataFrame:
    """left (key, s, n, root) -> edges (u, v) of roots that connect what is alike in a bucket.

    A bucket over BLOCK bytes is dealt into parts, and each two parts meet in a task, so a large bucket is spread.
    """

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, GROUPS):
                column = batch.column("x").slice(lo, GROUPS)
                one = column.flatten()
                x = [np.frombuffer(v.as_buffer(), np.uint64) for v in one.field("shingles")]
                u, v = united(x, one.field("root").to_numpy(), words_of(one.field("fp")), column.value_lengths().to_numpy().astype(np.int64), radius)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    parts = left.groupBy("key").agg(F.ceil(F.sum("n") * 8 / BLOCK).cast("int").alias("parts"))
    dealt = left.join(parts, "key").withColumn("own", F.pmod(F.xxhash64("s"), F.col("parts")).cast("int"))
    dealt = dealt.select("key", "s", "root", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    dealt = dealt.select("key", "s", "root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).join(sets, "s")
    groups = dealt.groupBy("key", "i", "j").agg(F.collect_list(F.struct("root", "shingles", "fp")).alias("x")).where(F.size("x") > 1)
    return common.by_arrow(groups.select("x"), run, "u bigint, v bigint")


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of df with one row of each component, that of its least id; of rows that are alike one stays."""
    prints = common.written(signatures(df, id_col, text_col), "near-prints")
    row = F.struct(F.col(id_col).isNull().alias("x"), F.col(id_col).alias("i"), F.col("text_hash").alias("h"))
    keyed = prints.select("s", "n", F.explode("bands").alias("key")).distinct()
    shared = keyed.groupBy("key").agg(F.min("s").alias("u"), F.min_by("n", "s").alias("m"), F.count("*").alias("c")).where("c > 1").drop("c")
    buckets = common.written(keyed.join(shared, "key"), "near-buckets")
    least = prints.groupBy("s").agg(F.min(row).alias("k"))
    wanted = least.join(buckets.select("s").distinct(), "s", "left_semi").select(F.col("k.i").alias("__i"), F.col("k.h").alias("__h"))
    sets = stored_sets(df, wanted, id_col, text_col)
    near = lambda x, y: F.least(x, y) >= THRESHOLD * F.greatest(x, y) - 1e-9
    stars = buckets.where((F.col("u") != F.col("s")) & near("n", "m")).select("u", F.col("s").alias("v")).distinct()
    first = common.written(alike(compared(stars, sets, radius), sets), "near-links")
    roots = components(first)
    placed = buckets.select("key", "s", "n").join(roots.select(F.col("u").alias("s"), "root"), "s", "left").withColumn("root", F.coalesce("root", "s"))
    split = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    left = common.written(placed.join(split, "key"), "near-left")
    links = first.unionByName(across(left, sets, radius))
    whole = components(links).select(F.col("u").alias("s"), "root")
    groups = prints.select(id_col, "text_hash", "s").join(whole, "s", "left").withColumn("root", F.coalesce("root", "s"))
    kept = groups.groupBy("root").agg(F.min(row).alias("k")).select(F.col("k.i").alias("__i"), F.col("k.h").alias("__h"))
    return simhash.rows_of(df, kept, id_col, text_col)
