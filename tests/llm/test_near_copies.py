import random

import corpus_pipeline
import numpy as np
from textloom.llm import near_copies, simhash


def brute(rows):
    """Ids that stay: the least of each component of all pairs at the threshold."""
    sets = []
    for _, text in rows:
        w = (text or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    comp = list(range(len(rows)))

    def top(k):
        while comp[k] != k:
            k = comp[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (not a and not b) or (a and b and 5 * len(a & b) >= 4 * len(a | b)):
                comp[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for k, (i, _) in enumerate(rows):
        least[top(k)] = min(least.get(top(k), i), i)
    return sorted(least.values())


def test_stage_drops_all_texts_at_the_similarity(spark):
    r = random.Random(4)
    words = ["w%d" % k for k in range(400)]
    texts = [None, "", "a b", "A  b", "a b c"]
    for _ in range(40):  # copies with one to ten of 200 words changed: similarities on both sides of 0.8
        base = r.choices(words, k=200)
        texts.append(" ".join(base))
        for k in (1, 3, 4, 5, 10):
            copy = base[:]
            for at in r.sample(range(200), k):
                copy[at] = "new%d" % r.randrange(10**9)
            texts.append(" ".join(copy))
    chain = r.choices(words, k=300)
    for _ in range(60):
        chain = chain[:]
        chain[r.randrange(300)] = "x%d" % r.randrange(10**9)
        texts.append(" ".join(chain))
    texts += texts[-20:]
    r.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = corpus_pipeline.near_copies(spark, df, "")
    assert got.columns == df.columns
    want = brute(rows)
    assert 40 < len(want) < 250
    assert sorted(x.doc_id for x in got.collect()) == want


def test_empty_table_and_null_ids(spark):
    assert near_copies.deduplicated(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    df = spark.createDataFrame([(None, "a b c"), (3, "a b c"), (None, None)], "doc_id bigint, text string")
    assert sorted(str(x.doc_id) for x in near_copies.deduplicated(df).collect()) == ["3", "None"]


def test_large_buckets_are_dealt_into_parts(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 4000)
    r = random.Random(6)
    base = ["w%d" % k for k in range(100)]
    rows = []
    for i in range(120):  # copies of one text, two changes each: few pairs are at the threshold
        copy = base[:]
        for at in r.sample(range(100), 2):
            copy[at] = "x%d" % r.randrange(30)
        rows.append((i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute(rows)
    assert 1 < len(want) < 120
    assert sorted(x.doc_id for x in near_copies.deduplicated(df).collect()) == want


def bits(x, y):
    return sum(int(a ^ b).bit_count() for a, b in zip(x, y, strict=True))


def test_bit_sliced_comparison_takes_a_wide_radius(monkeypatch):
    r = np.random.default_rng(8)
    fps = r.integers(0, 2**64, (300, near_copies.WORDS), np.uint64)
    for k in range(1, 300):  # distances on both sides of the radius
        fps[k] = fps[k - 1]
        for at in r.choice(128, r.integers(30, 60), replace=False):
            fps[k, at // 64] ^= np.uint64(1) << np.uint64(at % 64)
    for radius in (0, 1, 31, 47, 63):
        u = r.integers(0, 4, 300) * 64
        got = near_copies.close(u, fps[u], fps, radius)
        assert got.tolist() == [bits(fps[a], b) <= radius for a, b in zip(u, fps, strict=True)]
    monkeypatch.setattr(near_copies, "PAIRS", 500)
    sizes = np.array([1, 64, 65, 2, 168])
    got = [(a, b) for x in near_copies.partners(fps, sizes) for a, b in zip(*x, strict=True)]
    ends = np.cumsum(sizes)
    assert got == [(a, b) for lo, hi in zip(ends - sizes, ends, strict=True) for a in range(lo, hi) for b in range(a + 1, hi) if bits(fps[a], fps[b]) <= 47]
    assert 100 < len(got)


def test_links_come_from_the_comparison_of_fingerprints(spark):
    r = random.Random(11)
    rows = []
    for _ in range(12):
        base = ["w%d" % r.randrange(500) for _ in range(150)]
        for k in range(4):
            copy = base[:]
            copy[10 * k] = "x%d" % r.randrange(10**9)
            rows.append((len(rows), " ".join(copy)))
    sets = near_copies.shingle_sets([x for _, x in rows], near_copies.WordHashes())
    fps = near_copies.prints_of(sets)
    for s, fp in zip(sets, fps, strict=True):
        hashes = [near_copies.decontam._mixed(s ^ seed).tolist() for seed in near_copies._SEEDS]
        assert fp.tolist() == [sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) for hs in hashes]
    near = [bits(fps[i], fps[j]) for i in range(48) for j in range(i) if i // 4 == j // 4]
    assert 0 < min(near) and max(near) <= near_copies.RADIUS
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert len(brute(rows)) == 12
    assert sorted(x.doc_id for x in near_copies.deduplicated(df).collect()) == brute(rows)
    assert near_copies.deduplicated(df, radius=0).count() == 48  # all candidates are over that radius
    # in a group the exact check sees only what is within the radius
    alike = [sets[0], sets[0], sets[0]]
    far = np.array([[0, 0], [2**64 - 1, 0], [2**47 - 1, 0]], np.uint64)
    got = near_copies.united(alike, np.array([5, 6, 7]), far, np.array([3]))
    assert [x.tolist() for x in got] == [[6, 7], [5, 5]] and bits(far[1], far[2]) == 17
    got = near_copies.united(alike, np.array([5, 6, 7]), far[:, ::-1].copy(), np.array([2, 1]))
    assert [x.tolist() for x in got] == [[], []]


def test_op7_keeps_its_radius():
    fps = np.array([[0, 1, 3, 7, 15] + [2**64 - 1] * 59], np.uint64)
    row, found = simhash.within(simhash.slices(fps), np.array([0]), np.array([0], np.uint64), np.array([simhash.FULL]))
    assert row.tolist() == [0] and found.tolist() == [0b111]
