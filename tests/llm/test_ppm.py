import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from textloom.llm import common, ppm


def brute(train, texts):
    """A trie in dictionaries, scored byte by byte."""
    counts = Counter(t for x in train for t in ppm.tokens((x or "").encode()))
    n = sum(counts.values())
    spell = lambda ts: ppm.START * ppm.ORDER + b" ".join(ts)
    longest = Counter()
    for x in train:
        s = spell(ppm.tokens((x or "").encode()))
        longest.update(s[j - ppm.ORDER : j + 1] for j in range(ppm.ORDER, len(s)))
    trie = {}
    for m in range(ppm.ORDER, -1, -1):
        trie[m] = defaultdict(dict)
        for w, c in longest.items():
            trie[m][w[:-1]][w[-1]] = c
        longest = Counter(w[1:] for w in longest)
    every = {m: [c for kids in x.values() for c in kids.values()] for m, x in trie.items()}
    discount = {m: min(max(x.count(1) / max(len(x), 1), 0.05), 0.95) for m, x in every.items()}

    def score(window):
        shut, out = set(), 0.0
        for m in range(ppm.ORDER, -1, -1):
            kids = trie[m].get(window[ppm.ORDER - m : -1])
            if not kids:
                continue
            free = {b: c for b, c in kids.items() if b not in shut}
            if window[-1] in free:
                return out + math.log10((free[window[-1]] - discount[m]) / sum(free.values()))
            if free:
                out += math.log10(discount[m] * len(free) / sum(free.values()))
            shut |= set(kids)
        return out - math.log10(ppm.ALPHABET - len(shut))

    rows = []
    for x in texts:
        ts = ppm.tokens((x or "").encode())
        base = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (len(counts) + 1))) for t in ts)
        s = spell(ts)
        rows.append((len(ts), sum(counts[t] > 0 for t in ts), n, base, sum(score(s[j - ppm.ORDER : j + 1]) for j in range(ppm.ORDER, len(s)))))
    return rows


@pytest.fixture
def texts():
    r = random.Random(1)
    vocab = ["".join(r.choices(["ab", "an", "é", "tion", "x", "Q", "\x01"], k=r.randint(1, 6))) for _ in range(300)]
    out = [" ".join(r.choices(vocab, weights=[1 / (k + 1) for k in range(300)], k=r.choice([0, 1, 30, 300]))) for _ in range(60)]
    return out + [None, "", "\n\t ", out[3], out[3], "y" * 400, "end\r\nend"]


@pytest.mark.parametrize("nodes,words,block", [(ppm.NODES, ppm.WORDS, ppm.BLOCK), (3000, 200, 1000), (0, 1, 50)])
def test_scores_match_a_plain_trie(spark, texts, monkeypatch, nodes, words, block):
    """Whatever the workers hold, and however texts are cut into blocks."""
    monkeypatch.setattr(ppm, "NODES", nodes)
    monkeypatch.setattr(ppm, "WORDS", words)
    rows = [(k, x, "clash", 1, "clash", "clash") for k, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, word string, uid int, w string, score string").repartition(3)
    train = [x for k, x in enumerate(texts) if zlib.crc32(str(k).encode()) % 10]
    got = ppm.scored(df, df.where(common.id_mod("doc_id", 10) != 0)).orderBy("doc_id").collect()
    want = brute(train, texts)
    assert [x.doc_id for x in got] == list(range(len(texts)))
    for g, w in zip(got, want, strict=True):
        assert (g.n_tokens, g.n_known, g.train_tokens) == w[:3]
        assert g.base_score == pytest.approx(w[3], abs=1e-6)
        assert g.score == pytest.approx(w[4], abs=1e-6)
    monkeypatch.setattr(ppm, "BLOCK", block)
    some = [ppm.tokens((x or "").encode()) for x in texts]
    pieces = list(ppm.windows(some))
    assert len(pieces) >= len(texts) * 5 // block
    flat = [(int(t), int(w)) for w, of in pieces for w, t in zip(w, of, strict=True)]
    spelt = [ppm.START * ppm.ORDER + b" ".join(x) for x in some]
    assert flat == [(t, int.from_bytes(s[j - ppm.ORDER : j + 1])) for t, s in enumerate(spelt) for j in range(ppm.ORDER, len(s))]


def test_probabilities_sum_to_one(texts):
    """Over all bytes and the end, after seen and unseen contexts."""
    train = [ppm.tokens((x or "").encode()) for x in texts]
    rows = brute(texts, [])
    assert rows == []
    levels, level = {}, Counter(int(w) for ws, _ in ppm.windows(train) for w in ws)
    for m in range(ppm.ORDER, -1, -1):
        levels[m] = level
        level = Counter(w & ((1 << (8 * m)) - 1) for w in level)
    rows = defaultdict(list)
    for m, x in levels.items():
        for w, c in x.items():
            rows[m, w >> 8].append((w & 255, c, levels[m - 1][w & ((1 << (8 * m)) - 1)] if m else 0))
    table = [{"m": m, "context": c, "taken": sum(x[2] for x in nodes), "nodes": [{"s": s, "n": n} for s, n, _ in nodes]} for (m, c), nodes in rows.items()]
    held = ppm.Frequent(pa.Table.from_pylist(table, pa.schema([("m", pa.int32()), ("context", pa.int64()), ("taken", pa.int64()), ("nodes", pa.list_(pa.struct([("s", pa.int32()), ("n", pa.int64())])))])), set(), [0.3, 0.4, 0.5, 0.6, 0.2, 0.1])
    for context in (b"\n" * 5, b"an an", b"zzzzz", b"ionab"):
        w = np.array([int.from_bytes(context + bytes([b])) for b in range(256)])
        logp, lacking = held.score(w)
        assert not len(lacking)
        unseen = 10 ** logp.min()  # the 257th symbol of the alphabet stands for no byte
        assert (10**logp).sum() + unseen == pytest.approx(1)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert ppm.scored(df, df).count() == 0
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    row = ppm.scored(docs, df).first()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0)
    assert row.base_score == pytest.approx(0) and row.score == pytest.approx(-math.log10(257) * 5, rel=1e-3)


def test_held_out_texts(spark, sf_dir):
    """With 181 training texts the base, which gives any unseen token the same whatever there is of them, is ahead by less than a tenth; with 917 it is behind."""
    for d, most in ((sf_dir, 1.1), (sf_dir.replace("0.001", "0.01"), 0.995)):
        rows = ppm.op5_ppm(spark, d).where("held_out").collect()
        assert rows and all(x.score < 0 for x in rows)
        assert sum(x.score for x in rows) > most * sum(x.base_score for x in rows)
