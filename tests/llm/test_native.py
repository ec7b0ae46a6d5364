import hashlib
import random
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F
from textloom.llm import sharding, sketch


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    vocab = ["".join(r.choices("abéß😀", k=r.randint(1, 6))) for _ in range(200)]
    texts = [" ".join(r.choices(vocab, k=r.choice([0, 1, 4, 5, 6, 30, 300]))) for _ in range(120)]
    texts += [None, "", " \n ", texts[3], texts[3], "A b\tC  d e f", "w " * 4000]
    ids = r.sample(range(10**6), len(texts) - 1) + [None]
    return list(zip(ids, texts, strict=True))


def signed(h):
    return h - 2**64 if h >= 2**63 else h


def shingle(words):
    seed = 42
    for w in words:
        seed = xxhash.xxh64_intdigest(w.encode(), seed)
    return signed(seed)


def brute_sketch(text):
    words = text.lower().split()
    hashes = {shingle(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) > 4 else {shingle(words)} if words else set()
    return sorted(hashes)[: sketch.K]


def like(a, b):
    u = sorted(set(a) | set(b))[: sketch.K]
    return len(set(u) & set(a) & set(b)) / len(u) if u else 1.0


@pytest.mark.parametrize("ranges", [1, 5, 40])
def test_fingerprints_match_brute_force(spark, rows, ranges):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    try:
        df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, next string").repartition(3)
        got = {x.doc_id: x for x in sketch.fingerprinted(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    order = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0)))
    assert len(got) == len(order)
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        m = len(t) // 3
        edited = t[: len(t) - m] + after[:m]
        g, own, new = got[i], brute_sketch(t), brute_sketch(edited)
        assert (g.n_chars, g.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert g.fingerprint == "".join(f"{h % 2**64:016x}" for h in own)
        assert g.edited_fingerprint == "".join(f"{h % 2**64:016x}" for h in new)
        assert (g.near_edited, g.near_next) == (like(own, new), like(own, brute_sketch(after)))


def test_sketches_merge_and_estimate(spark):
    texts = [(k, " ".join(f"w{j}" for j in range(300 * k, 300 * k + 900))) for k in range(4)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").withColumn("s", sketch.sketch(F.col("text")))
    whole = sketch.merged_by(df.withColumn("g", F.lit(1)), ["g"], "s").first().s
    assert whole == sorted({h for _, t in texts for h in [shingle(t.split()[k : k + 5]) for k in range(896)]})[: sketch.K]
    two = df.where("doc_id = 0").select(F.col("s").alias("a")).join(df.where("doc_id = 1").select(F.col("s").alias("b")))
    r, c, n = two.select(sketch.resemblance(F.col("a"), F.col("b")), sketch.containment(F.col("a"), F.col("b")), sketch.distinct_shingles(F.col("a"))).first()
    assert abs(r - 0.5) < 0.2 and abs(c - 0.67) < 0.25 and abs(n - 896) < 300


def test_native_plans_have_no_python(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    df.write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    for out in (sketch.fingerprinted(df), sharding.sharded(df)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert sketch.fingerprinted(df).count() == 0 and sharding.sharded(df).count() == 0


def test_shards(spark, rows):
    many = [(k, "x" * (k * 37 % 1900)) for k in range(2000)] + [(None, None), (5, "x" * 185)]
    df = spark.createDataFrame(many, "doc_id bigint, text string").withColumn("size", F.lit("clash"))
    got = sharding.sharded(df).collect()
    assert sorted((x.doc_id or 0, x.size, x.text_crc32) for x in got) == sorted((i or 0, len(t or "") + 1, zlib.crc32((t or "").encode())) for i, t in many)
    load = [sum(x.size for x in got if x.shard == k) for k in range(16)]
    assert max(load) - min(load) < 0.01 * sum(load) / 16
    for k in range(16):
        assert sorted(x.slot for x in got if x.shard == k) == list(range(sum(x.shard == k for x in got)))


def test_growing_moves_only_into_the_new_shard():
    r = random.Random(1)
    weight = [r.randint(0, 1000) for _ in range(512)]
    m = sharding.SlotMap.fresh(512, 8).rebalance(weight).grow(weight)
    old, new = m.versions[-2:]
    assert all(b in (a, 8) for a, b in zip(old, new, strict=True)) and len(m.versions) == 3
    load = [sum(w for w, d in zip(weight, new, strict=True) if d == k) for k in range(9)]
    assert max(load) - min(load) < 0.05 * sum(load) / 9


def test_rebalancing_is_close_and_idle_where_nothing_helps():
    r = random.Random(2)
    for _ in range(5):
        weight = [r.choice([0, 1, 5, r.randint(0, 1000)]) for _ in range(512)]
        m = sharding.SlotMap.fresh(512, 8).rebalance(weight)
        load = [sum(w for w, d in zip(weight, m.now, strict=True) if d == k) for k in range(8)]
        assert max(load) - min(load) <= max(2, 0.001 * sum(load) / 8)
        n = len(m.versions)
        assert len(m.rebalance(weight).versions) == n
    assert len(sharding.SlotMap.fresh(64, 4).rebalance([0] * 64).versions) == 1
    one = sharding.SlotMap.fresh(64, 4).rebalance([10**6] + [0] * 63)
    assert len(one.versions) == 1


def _places(df):
    return {(x.doc_id, x.text_crc32): (x.virtual_slot, x.shard) for x in df.collect()}


def test_the_map_is_stored_and_edited(spark, tmp_path):
    rows = [(k, "x" * (k * 37 % 1900)) for k in range(2000)]
    make = lambda rows, parts=3: spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)
    path = str(tmp_path / "map")
    first = _places(sharding.sharded(make(rows), map_path=path))
    versions = len(sharding.SlotMap.read(spark, path).versions)
    # another layout, and one row more: nothing moves while the map stays
    more = [*rows, (9999, "a row more")]
    again = _places(sharding.sharded(make(more, 7), map_path=path, rebalance=False))
    assert {k: again[k] for k in first} == first and len(sharding.SlotMap.read(spark, path).versions) == versions
    # a lopsided load: only rows of edited slots move, and the old versions stay
    heavy = [*rows, *((10_000 + k, "y" * 1900) for k in range(0, 400) if k % 3)]
    edited = _places(sharding.sharded(make(heavy), map_path=path))
    stored = sharding.SlotMap.read(spark, path)
    assert len(stored.versions) == versions + 1
    moved = {s for s, (a, b) in enumerate(zip(stored.versions[-2], stored.now, strict=True)) if a != b}
    assert all(edited[k] == v or v[0] in moved for k, v in first.items()) and any(edited[k] != v for k, v in first.items())
    # one shard more takes rows only into itself
    grown = _places(sharding.sharded(make(heavy, 2), map_path=path, shards=17, rebalance=False))
    assert all(g in (e, (e[0], 16)) for g, e in ((grown[k], edited[k]) for k in edited)) and any(g[1] == 16 for g in grown.values())
    with pytest.raises(ValueError):
        sharding.sharded(make(rows), map_path=path)


def test_one_id_may_hold_many_rows(spark):
    r = random.Random(6)
    many = [(7, f"text {r.random()} of the heavy id") for _ in range(300)] + [(k, f"light {k} row") for k in range(100, 130)] + [(k, f"less {k}") for k in range(-20, 0)]
    df = spark.createDataFrame(many, "doc_id bigint, text string").withColumn("rank", F.xxhash64("text"))
    order = [x.text for x in df.orderBy(F.desc("doc_id"), F.desc("rank")).collect()]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    try:
        got = {x.text: x.next.text for x in sketch.with_next(df, "doc_id", "rank", lambda d: d, ["text"]).collect()}
        parts = df.groupBy(sketch._ranges(df, "doc_id", "rank", 24).alias("r")).count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == dict(zip(order, order[1:] + order[:1], strict=True))
    assert max(x["count"] for x in parts) < 60


def test_rows_alike_don_t_fill_one_slot(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ALIKE", 700)  # the 3000 and the 5000 are made in parts
    many = [(1, "the same text again")] * 3000 + [(None, None)] * 5000 + [(k, "x" * (k % 40)) for k in range(2, 3000)]
    make = lambda parts: sharding.sharded(spark.createDataFrame(many, "doc_id bigint, text string").repartition(parts))
    got = make(5).collect()
    load = [sum(x.size for x in got if x.shard == k) for k in range(16)]
    assert len(got) == len(many) and max(load) < 1.02 * sum(load) / 16
    assert Counter(x.doc_id for x in got) == Counter(i for i, _ in many)
    assert max(Counter(x.virtual_slot for x in got).values()) < 30
    for k in range(16):
        assert sorted(x.slot for x in got if x.shard == k) == list(range(sum(x.shard == k for x in got)))
    assert Counter(map(tuple, make(2).collect())) == Counter(map(tuple, got))
