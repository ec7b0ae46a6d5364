import random

import pytest
from textloom.llm import decontam


def words(text):
    out = []
    for w in (text or "").lower().split():
        while w and not w[0].isalnum():
            w = w[1:]
        while w and not w[-1].isalnum():
            w = w[:-1]
        if w:
            out.append(w)
    return out


def shingles(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(docs, items):
    out = []
    for d, t in docs:
        own = shingles(t)
        for i, x in items:
            item = shingles(x)
            shared = len(item & own)
            if item and shared >= 0.8 * len(item):
                out.append((d, i, shared, len(item)))
    return sorted(out)


@pytest.fixture(scope="module")
def tables():
    r = random.Random(4)
    vocab = ["".join(r.choices("abcdeé", k=r.randint(2, 7))) for _ in range(400)]
    some = lambda n: r.choices(vocab, k=n)
    items = [(k, " ".join(some(r.choice([3, 5, 8, 20, 45, 90, 300])))) for k in range(60)] + [(100, None), (101, ""), (102, "?!")]
    items.append((103, items[5][1]))
    docs = []
    for k in range(150):
        w = some(r.choice([0, 3, 50, 800, 6000]))
        for _ in range(r.choice([0, 0, 1, 2])):
            x = r.choice(items[:60])[1].split()
            how = r.random()
            if how < 0.3 and len(x) > 40:
                x[len(x) // 2] = "changed"
            elif how < 0.5:
                x = [y.upper() + "," for y in x]
            elif how < 0.7:
                x = x[: len(x) // 2]
            at = r.randint(0, len(w))
            w[at:at] = x
        docs.append((k, " ".join(w)))
    docs += [(900, None), (901, ""), (902, items[3][1]), (902, items[3][1])]
    return docs, items


@pytest.mark.parametrize("item_bytes", [decontam.ITEM_BYTES, 4000])
def test_pairs_match_brute_force(spark, tables, monkeypatch, item_bytes):
    monkeypatch.setattr(decontam, "ITEM_BYTES", item_bytes)
    docs, items = tables
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id bigint, text string, item_id string").repartition(3)
    it = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted((x.doc_id, x.item_id, x.shared, x.n_shingles) for x in decontam.contaminated(df, it).collect())
    want = brute(docs, items)
    assert len(want) > 40 and got == want
    clean = decontam.cleaned(df, it)
    assert clean.columns == df.columns
    assert sorted(x.doc_id for x in clean.collect()) == sorted(d for d, _ in docs if d not in {p[0] for p in want})


def test_empty_tables(spark, tables):
    docs = spark.createDataFrame(tables[0], "doc_id bigint, text string")
    none = docs.where("false")
    items = spark.createDataFrame(tables[1], "item_id bigint, text string")
    assert decontam.contaminated(none, items).count() == 0
    assert decontam.contaminated(docs, items.where("false")).count() == 0
    assert decontam.cleaned(docs, items.where("false")).count() == docs.count()
