"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items are put into partitions by their number of shingles; for each partition a document is cut into overlapping windows of
twice its upper size, so that an item's passage lies whole in a window not much larger than itself, where containment
shows as a high enough resemblance. The whole document is one more window. An item and a window are candidates if one of
HASHES MinHash values agrees (bands of one row, which the sizes call for); a candidate counts if the document has
at least THRESHOLD of the item's distinct shingles. A window's MinHash can only agree where it holds the item's least
shingle, so windows without one are never hashed.

Defined results: words are lower-case runs without white space, less punctuation at both ends; fewer words than a shingle
make one shingle of the whole sequence; null texts and items, and those without words, match nothing; repeated items and
repeated ids give a pair each; empty tables give an empty table; other columns are not read.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import common

SHINGLE, THRESHOLD, HASHES = 5, 0.8, 64
#: Bytes of item texts that are broadcast at once; a larger benchmark is searched in several rounds of about so many bytes.
ITEM_BYTES = 32 << 20
_B = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hash of a chunk between spaces, 0 for one without a letter or digit."""

    def __missing__(self, chunk: str) -> int:
        from xxhash import xxh64_intdigest

        a, b = 0, len(chunk)
        while a < b and not chunk[a].isalnum():
            a += 1
        while b > a and not chunk[b - 1].isalnum():
            b -= 1
        h = xxh64_intdigest(chunk[a:b].encode(), 42) or 1 if a < b else 0
        if len(self) < 250_000:
            self[chunk] = h
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingled(texts: list[str], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """The shingle hashes of all texts, and how many each has."""
    chunks = [x.lower().split() for x in texts]
    sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
    words = np.fromiter(map(hashes.__getitem__, chain.from_iterable(chunks)), np.uint64, int(sizes.sum()))
    of = np.repeat(np.arange(len(texts)), sizes)
    real = words != 0
    words, of = words[real], of[real]
    n = np.bincount(of, minlength=len(texts))
    starts = np.cumsum(n) - n
    place = np.arange(len(words)) - starts[of]
    out = np.zeros(len(words), np.uint64)
    for j in range(SHINGLE):
        there = place + j < n[of]
        at = np.minimum(np.arange(len(words)) + j, max(len(words) - 1, 0))
        out = np.where(there, out * _B + words[at], out)
    kept = (place + SHINGLE <= n[of]) | (place == 0)
    return _mixed(out[kept]), np.bincount(of[kept], minlength=len(texts))


def _seeds() -> np.ndarray:
    return _mixed(np.arange(1, HASHES + 1, dtype=np.uint64) * _B)


def size_class(n: int) -> int:
    """Partitions whose upper sizes grow by about a quarter."""
    c = 0
    while upper_size(c) < n:
        c += 1
    return c


def upper_size(c: int) -> int:
    return int(4 * 1.25**c) + c


class Items:
    """Signatures of the items, and for each shingle that is a MinHash of some item: which items and hashes."""

    def __init__(self, ids: list, texts: list[str]) -> None:
        flat, n = shingled(texts, WordHashes())
        starts = np.cumsum(n) - n
        self.ids, self.shingles, self.classes = [], [], []
        owner: dict[int, dict[int, list[int]]] = {}
        seeds = _seeds()
        for k, (i, start, size) in enumerate(zip(ids, starts, n, strict=True)):
            if not size:
                continue
            s = np.unique(flat[start : start + size])
            at = len(self.ids)
            self.ids.append(i)
            self.shingles.append(s)
            self.classes.append(size_class(len(s)))
            least = np.array([_mixed(s ^ seed).argmin() for seed in seeds])
            for h, x in enumerate(s[least].tolist()):
                owner.setdefault(x, {}).setdefault(at, []).append(h)
        self.active = common.Lookup(np.fromiter(owner, np.uint64, len(owner)))
        self.owners = list(owner.values())
        self.seeds = seeds

    def pairs(self, texts: list[str], hashes: WordHashes) -> list[tuple[int, int, int]]:
        """(text, item, shared shingles) of all pairs at the threshold."""
        flat, n = shingled(texts, hashes)
        ends = np.cumsum(n)
        hit = np.flatnonzero((found := self.active(flat)) >= 0)
        out = []
        for t, hits in _runs(np.searchsorted(ends, hit, side="right"), hit):
            s, places = flat[ends[t] - n[t] : ends[t]], hits - (ends[t] - n[t])
            done: set[int] = set()
            tried: dict[tuple, np.ndarray] = {}
            whole: np.ndarray | None = None
            for p, x in zip(places.tolist(), found[hits].tolist(), strict=True):
                for item, hs in self.owners[x].items():
                    if item in done or not any(self._agrees(s, p, a, b, h, tried) for a, b in self._windows(p, len(s), item) for h in hs):
                        continue
                    done.add(item)
                    if whole is None:
                        whole = np.unique(s)
                    own = self.shingles[item]
                    at = np.minimum(np.searchsorted(whole, own), len(whole) - 1)
                    shared = int((whole[at] == own).sum())
                    if shared >= THRESHOLD * len(own):
                        out.append((t, item, shared))
        return out

    def _windows(self, p: int, n: int, item: int):
        """The windows of the item's partition that hold place p, and the whole document."""
        u = upper_size(self.classes[item])
        k = p // u
        for a in (k * u, (k - 1) * u):
            if a >= 0:
                yield a, min(n, a + 2 * u)
        yield 0, n

    def _agrees(self, s: np.ndarray, p: int, a: int, b: int, h: int, tried: dict) -> bool:
        """Whether place p holds the window's MinHash."""
        if (a, b, h) not in tried:
            tried[a, b, h] = _mixed(s[a:b] ^ self.seeds[h]).min()
        return tried[a, b, h] == _mixed(s[p : p + 1] ^ self.seeds[h])[0]


def _runs(of: np.ndarray, values: np.ndarray):
    at = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(of) else of
    for a, b in zip(at, [*at[1:], len(of)], strict=False):
        yield int(of[a]), values[a:b]


def distinct_items(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """__item (a hash of the text), text of each distinct text; equal items are searched once."""
    return items.where(F.col(text_col).isNotNull()).groupBy(F.xxhash64(text_col).alias("__item")).agg(F.first(text_col).alias(text_col))


def item_groups(items: DataFrame, text_col: str = "text"):
    """The distinct texts of the benchmark in groups of about ITEM_BYTES, each small enough to broadcast."""
    once = distinct_items(items, text_col=text_col)
    total = once.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = total // ITEM_BYTES + 1
    for k in range(n):
        part = once if n == 1 else once.where(F.pmod(F.xxhash64("__item"), F.lit(n)) == k)
        got = part.toArrow()
        yield Items(got.column(0).to_pylist(), got.column(1).to_pylist())


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """id_col, item_id, shared and n_shingles (distinct shingles in both, and in the item), containment of each found pair."""
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, __item bigint, shared bigint, n_shingles bigint, containment double"
    out = None
    for group in item_groups(items):
        shipped = docs.sparkSession.sparkContext.broadcast(group)

        def run(batches, shipped=shipped):
            it, hashes = shipped.value, WordHashes()
            for batch in batches:
                for b in common.pieces(batch, text_col):
                    pairs = it.pairs(common.texts(b, text_col), hashes)
                    size = [len(it.shingles[i]) for _, i, _ in pairs]
                    yield pa.RecordBatch.from_arrays([b.column(id_col).take(pa.array([t for t, _, _ in pairs], pa.int64())), pa.array([it.ids[i] for _, i, _ in pairs], pa.int64()), pa.array([s for _, _, s in pairs], pa.int64()), pa.array(size, pa.int64()), pa.array([s / n for (_, _, s), n in zip(pairs, size, strict=True)], pa.float64())], [id_col, "__item", "shared", "n_shingles", "containment"])

        part = common.by_arrow(docs.select(id_col, text_col), run, schema)
        out = part if out is None else out.unionByName(part)
    ids = items.where(F.col("text").isNotNull()).select(F.xxhash64("text").alias("__item"), F.col(item_col).alias("item_id"))
    return out.join(ids, "__item").select(id_col, "item_id", "shared", "n_shingles", "containment")


def cleaned(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all columns, that hold no item."""
    for group in item_groups(items):
        shipped = docs.sparkSession.sparkContext.broadcast(group)

        def keep(hashes, texts, shipped=shipped):
            mask = np.ones(len(texts), bool)
            mask[[t for t, _, _ in shipped.value.pairs(texts, hashes)]] = False
            return mask

        docs = common.kept(docs, WordHashes, keep, text_col)
    return docs


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(common.documents(spark, sf_dir), common.table(spark, sf_dir, "benchmark").select("item_id", "text"))


def _sql_shingles(key: str, source: str) -> str:
    words = r"list_filter(list_transform(string_split_regex(lower(text), '\s+'), lambda x: regexp_replace(x, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')), lambda x: x <> '')"
    return f"SELECT DISTINCT {key}, array_to_string(w[i : i + {SHINGLE - 1}], ' ') AS s FROM (SELECT {key}, w, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) AS i FROM (SELECT {key}, {words} AS w FROM {source}) WHERE len(w) > 0)"


#: The pairs at the threshold, by exact containment alone.
ORACLE_SQL = f"""WITH d AS ({_sql_shingles("doc_id", "documents")}), i AS ({_sql_shingles("item_id", "benchmark")}), n AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS shared, n AS n_shingles, count(*)::DOUBLE / n AS containment FROM d JOIN i USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n HAVING count(*) >= {THRESHOLD} * n"""
