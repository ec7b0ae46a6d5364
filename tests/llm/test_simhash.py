import random

import numpy as np
import pytest
import xxhash
from textloom.llm import simhash


def brute(rows):
    fps = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    comp = list(range(len(rows)))

    def top(k):
        while comp[k] != k:
            k = comp[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                comp[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for k, (i, _) in enumerate(rows):
        least[top(k)] = min(least.get(top(k), i), i)
    return {i: (f"{fps[k]:016x}", least[top(k)]) for k, (i, _) in enumerate(rows)}


@pytest.fixture
def rows():
    r = random.Random(5)
    vocab = ["".join(r.choices("abcdeéß", k=r.randint(1, 7))) for _ in range(60)]
    texts = [" ".join(r.choices(vocab, k=r.choice([0, 1, 2, 3, 5, 40, 400]))) for _ in range(80)]
    base = r.choices(vocab, k=900)
    for _ in range(60):  # a chain of near copies
        base = base[:]
        base[r.randrange(900)] = r.choice(vocab)
        texts.append(" ".join(base))
    texts += [None, "", "  \t\n", texts[5], texts[5].upper(), "x " * 3000]
    r.shuffle(texts)
    return list(enumerate(texts))


def test_components_match_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {x.doc_id: (x.fingerprint, x.component_id) for x in simhash.near_duplicates(df).collect()}
    assert got == brute(rows)


def test_hot_buckets_lose_no_link(spark):
    r = random.Random(2)
    base = r.getrandbits(64)
    fps = {base}
    while len(fps) < 400:
        fps.add(base ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)))
    fps = sorted(np.array(list(fps), np.uint64).view(np.int64).tolist())
    df = spark.createDataFrame([(k, x) for k, x in enumerate(fps)], "doc_id bigint, fp bigint")
    cold = {(x.doc_id, x.component_id) for x in simhash.clustered(df).collect()}
    whole = simhash.links
    try:
        simhash.links = lambda d, hot=5: whole(d, 5)
        hot = {(x.doc_id, x.component_id) for x in simhash.clustered(df).collect()}
    finally:
        simhash.links = whole
    comp = list(range(len(fps)))
    for _ in range(10):
        for i in range(len(fps)):
            for j in range(len(fps)):
                if ((fps[i] ^ fps[j]) & (2**64 - 1)).bit_count() <= 2:
                    comp[i] = comp[j] = min(comp[i], comp[j])
    assert cold == hot == set(enumerate(comp))


def test_deduplicated_keeps_one_row_of_each_component(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows] + [(rows[0][0], rows[0][1], "x", 1)], "doc_id bigint, text string, fp string, component_id int")
    got = simhash.deduplicated(df)
    assert got.columns == df.columns
    assert sorted(x.doc_id for x in got.collect()) == sorted({c for _, c in brute(rows).values()})


def test_empty_table_and_null_ids(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    df = spark.createDataFrame([(None, "a b c"), (3, "a b c"), (None, None)], "doc_id bigint, text string")
    assert {(x.doc_id, x.component_id) for x in simhash.near_duplicates(df).collect()} == {(None, 3), (3, 3), (None, None)}
    assert simhash.deduplicated(df).count() == 2
