import fractions
import functools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from textloom.llm import lang_id, quality, toxicity


@pytest.fixture(scope="module")
def documents(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs, {x.doc_id: x for x in spark.read.parquet(f"{d}/labels.parquet").collect()}, {x.doc_id: x.lang for x in docs.collect()}


def test_toxicity_of_held_out_texts(spark, documents):
    rows = toxicity.op3_toxicity(spark, "/root/testdata/sf0.01").collect()
    labels = documents[1]
    held = [(x.predicted, labels[x.doc_id].toxic) for x in rows if x.held_out and x.doc_id in labels]
    assert len(rows) == documents[0].count() and np.mean([a == b for a, b in held]) > 0.95


def test_inserted_characters_keep_an_insult_near():
    rows = [(f"some plain words{k} here and there.", 0) for k in range(60)] + [(f"some idiot and pathetic words{k}.", 1) for k in range(60)]
    m = toxicity.trained(rows)
    values = dict(zip(words := ["idiot", "id.iot", "idi-ot", "plain", "there"], toxicity.token_scores(m.weight, m.bias, words), strict=True))
    assert min(values["id.iot"], values["idi-ot"]) > max(values["plain"], values["there"])


def test_kernel_sums_common_subsequences():
    def brute(a, b):
        from itertools import combinations

        def phi(s):
            c, out = toxicity._codes(s), {}
            for i, j, k in combinations(range(len(c)), 3):
                u = (c[i], c[j], c[k])
                out[u] = out.get(u, 0) + toxicity.DECAY ** (k - i + 1)
            size = math.sqrt(sum(toxicity.DECAY ** (2 * (k - i + 1)) for i, j, k in combinations(range(len(c)), 3)))
            return {u: v / size for u, v in out.items()}

        x, y = phi(a), phi(b)
        return sum(v * y.get(u, 0) for u, v in x.items())

    words = ["idiot", "id.iot", "aaaa", "a", "ü1"]
    got = toxicity.kernels(words, [toxicity.embedded(w) for w in words])
    assert np.allclose(got, [[brute(a, b) for b in words] for a in words], atol=1e-5)


def test_quality_of_held_out_texts(spark, documents):
    rows = quality.op4_quality(spark, "/root/testdata/sf0.01").collect()
    labels = documents[1]
    held = [(x.predicted, labels[x.doc_id].quality) for x in rows if x.held_out and x.doc_id in labels]
    assert len(rows) == documents[0].count() and np.mean([a == b for a, b in held]) > 0.95


def test_language_of_held_out_texts(spark, documents):
    rows = lang_id.op8_lang_id(spark, "/root/testdata/sf0.01").collect()
    held = [x.lang_pred == documents[2][x.doc_id] for x in rows if x.held_out]
    assert len(rows) == documents[0].count() and np.mean(held) > 0.99


def test_forward_sums_all_segmentations():
    pieces = lang_id.loaded(lang_id.default_path())
    p = lang_id.probabilities(np.random.default_rng(1).random((pieces.size, 2)))
    place = {x: k for k, x in enumerate(pieces.names)}

    def brute(word, g):
        @functools.cache
        def rest(i):
            if i == len(word):
                return fractions.Fraction(1)
            total = fractions.Fraction(0)
            for j in range(i + 1, min(len(word), i + pieces.longest) + 1):
                k = place.get(word[i:j], pieces.size - 1 if j == i + 1 else None)
                if k is not None:
                    total += fractions.Fraction(float(p[k, g])) * rest(j)
            return total

        whole = rest(0)  # too small for a float where the word is long
        return math.log(whole.numerator) - math.log(whole.denominator)

    words = ["the", "straße", "ñandú", "x", "internationalisation", "ꙮꙮ", "straßenbahnhaltestellen" * 12, "ꙮ" * 40]
    got = lang_id.word_scores(pieces, p, words)
    assert np.allclose(got, [[brute("▁" + w, g) for g in range(2)] for w in words])
    assert pieces.longest > 10


EDGES = [(1, None), (2, ""), (3, "?! 12 ² ½ \n"), (4, "the same text here"), (4, "the same text here"), (None, "word " * 30_000), (6, "z" * 100_000)]


def test_edges_have_defined_results(spark):
    df = spark.createDataFrame([(i, t, 0.5, "x") for i, t in EDGES], "doc_id bigint, text string, score double, lang string")
    tox = toxicity.trained([("good words only.", 0), ("nasty idiot.", 1)] * 20)
    good = quality.trained([("A good sentence of plain words. " * 9, 1), ("### @@ $$ " * 30, 0)] * 20)
    lang = lang_id.fitted(spark.createDataFrame([("the words of the text", "en"), ("der Text und die Worte", "de"), (None, "fr"), ("no language", None)], "text string, lang string").withColumn("doc_id", F.xxhash64("text")))
    for got in (toxicity.scored(df, tox), quality.scored(df, good)):
        rows = got.collect()
        assert len(rows) == len(EDGES) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in rows)
        assert len({(x.score, x.predicted) for x in rows if x.doc_id == 4}) == 1
    rows = lang_id.identified(df, lang).collect()
    assert {x.lang_pred for x in rows if x.doc_id in (1, 2, 3)} == {"und"} and {x.lang_pred for x in rows if x.doc_id == 4} == {"en"}
    for got in (toxicity.scored(df, None), quality.scored(df, None), lang_id.identified(df, lang_id.fitted(df.where("false")))):
        assert got.count() == len(EDGES)
    none = df.where("false")
    assert toxicity.scored(none, tox).count() == quality.scored(none, good).count() == lang_id.identified(none, lang).count() == 0
    assert toxicity.without_toxic(df, tox).columns == lang_id.with_language(df, lang).columns == df.columns
    assert sorted(x.doc_id or 0 for x in lang_id.with_language(df, lang).collect()) == [0, 4, 4, 6]


def test_samples_are_bounded_by_rows_and_bytes(spark, monkeypatch):
    rows = [(7, f"text {k % 50} of one id") for k in range(20_000)] + [(k, "clean " * (k % 30 + 1)) for k in range(100, 400)] + [(None, "no id"), (8, None), (9, "both"), (500, "x" * (toxicity.LONGEST_SAMPLE + 1))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("y", F.lit(1))
    labels = spark.createDataFrame([(7, 1), (7, 1), (8, 1), (9, 0), (9, 1), (500, 1), (None, 1)] + [(k, k % 2) for k in range(100, 400)], "doc_id bigint, toxic int")
    got = toxicity.sample(docs, labels)
    assert len(got) == 301 and sum(t.startswith("text") for t, _ in got) == 1
    n = Counter(y for _, y in toxicity.sample(docs, labels, sizes={1: 20, 0: 30}))
    assert 27 <= n[0] <= 30 and 17 <= n[1] <= 20  # less the ids with both labels, or without a text to take
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 2000)
    few = toxicity.sample(docs, labels)
    for y in (0, 1):
        sizes = [len(t) for t, label in few if label == y]
        assert 2000 <= sum(sizes) < 2000 + 180 and len(few) < 300
    assert set(few) <= set(got)


def test_language_sample_is_bounded_and_fair(spark, monkeypatch):
    monkeypatch.setattr(lang_id, "SAMPLE", 100)
    rows = [(k, "the hot text" if k % 3 == 0 else f"text {k}", "en") for k in range(6000)] + [(k, f"selten {k}", "de") for k in range(10)] + [(1, "again and again", "fr")] * 3000 + [(k, f"rue {k}", "fr") for k in range(50)]
    df = spark.createDataFrame(rows, "id bigint, text string, lang string")
    got = lang_id.training_rows(df, {"en": 6000, "de": 10, "fr": 3050}).collect()
    n = Counter(x.lang for x in got)
    assert n["en"] == 100 and n["de"] == 10 and n["fr"] <= 100
    assert 15 < sum(x.text == "the hot text" for x in got) < 55  # its share of the rows, not all or none
    assert sum(x.text == "again and again" for x in got) <= 1  # rows alike count as one
    for k in (10**9, 10**11, 10**14):
        share = (lang_id.cut(k) + 2**63) / 2**64
        assert share * k == pytest.approx(200, rel=1e-3)


def test_quality_scores_match_plain_compression(spark):
    import zstandard

    rows = [(f"Plain words make sentence number {k} of a good text. " * (k % 7 + 1), 1) for k in range(60)] + [(f"$$$ ### {k} @@ !! buy {k * 7} " * (k % 9 + 1), 0) for k in range(60)]
    model = quality.trained(rows)
    texts = [t for t, _ in rows[::7]] + ["", "é" * 700, None]
    got = {x.doc_id: x.score for x in quality.scored(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), model).collect()}
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        sizes = []
        for d in (model.good, model.bad):
            packer = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append(sum(len(packer.compress(raw[j : j + 256])) for j in range(0, len(raw), 256)))
        good, bad = sizes
        both = max(good + bad, 1)
        d, share = 10 * (good - bad) / both, both / max(2 * len(raw), 1)
        z = sum(w * x for w, x in zip(model.weights, (d, d * d, share, share * share, d * share, 4 / math.sqrt(len(raw) + 16), 1), strict=True))
        assert got[k] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), abs=1e-9)


def test_toxicity_scores_match_a_plain_machine(spark):
    """Each subsequence looked up by itself, the strongest window of the strongest token, and the logistic curve."""
    from itertools import combinations

    model = toxicity.trained([(f"plain words number {k} here. And more of them.", 0) for k in range(30)] + [(f"you idiot number {k}. A line.", 1) for k in range(30)])

    def value(window):
        c = toxicity._codes(window)
        parts = [((c[i] * 64 + c[j]) * 64 + c[k], toxicity.DECAY ** (k - i + 1)) for i, j, k in combinations(range(len(c)), 3)]
        size = math.sqrt(sum(w * w for _, w in parts))
        return sum(float(model.weight[u]) * w for u, w in parts) / size if parts else 0.0

    def strongest(token):
        token = token.strip(toxicity._EDGE) or token
        n = toxicity.LONGEST
        windows = [token] if len(token) <= n else [token[k : k + n] for k in range(0, len(token) - n // 2, n // 2)]
        return max(map(value, windows))

    def brute(text):
        found = (text or "").lower().split()
        run, runs = [], []
        for x in [*found, "  "]:
            if len(x) == 1:
                run.append(x)
            else:
                runs += ["".join(run)] if len(run) > 2 else []
                run = []
        best = max(map(strongest, [*found, *runs]), default=-1.0) + model.bias
        return 1 / (1 + math.exp(-max(-30, min(30, model.slope * best + model.offset))))

    texts = ["You IDIOT.", "i d i o t here", "plain words", "", None, "id.iot!", "a" * 21 + "idiot" + "b" * 40, "words of ünïcode 漢字 ß", "x"]
    got = {x.doc_id: x for x in toxicity.scored(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), model).collect()}
    for k, t in enumerate(texts):
        assert got[k].score == pytest.approx(brute(t), abs=1e-4) and got[k].predicted == (got[k].score >= 0.5)


def test_language_scores_match_plain_sums(spark):
    """Posteriors from all segmentations of all words, and a round of expected counts from each segmentation's share."""
    pieces = lang_id.loaded(lang_id.default_path())
    rng = np.random.default_rng(3)
    p = lang_id.probabilities(rng.random((pieces.size, 3)) ** 8)
    place = {x: k for k, x in enumerate(pieces.names)}

    def cuts(word):
        if not word:
            return [[]]
        out = []
        for j in range(1, min(len(word), pieces.longest) + 1):
            k = place.get(word[:j], pieces.size - 1 if j == 1 else None)
            if k is not None:
                out += [[k, *rest] for rest in cuts(word[j:])]
        return out

    def whole(word, g):
        return sum(math.prod(p[k, g] for k in c) for c in cuts("▁" + word))

    texts = ["the words", "Haus und Hof", "über 12 x", "", None, "?!", "a² b³"]
    langs, prior = ["aa", "bb", "cc"], np.log([0.5, 0.3, 0.2])
    got = {x.doc_id: x for x in lang_id.identified(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), (langs, prior, p)).collect()}
    for k, t in enumerate(texts):
        words = ["".join(c for c in w if c.isalpha()) for w in lang_id._WORDS((t or "").lower())]
        words = [w for w in words if w]
        if not words:
            assert (got[k].lang_pred, got[k].score) == ("und", 0)
            continue
        logs = [prior[g] + sum(math.log(whole(w, g)) for w in words) for g in range(3)]
        top = max(range(3), key=logs.__getitem__)
        assert got[k].lang_pred == langs[top] and got[k].score == pytest.approx(1 / sum(math.exp(x - logs[top]) for x in logs))
    words, counts = ["the", "haus", "ꙮa"], rng.random((3, 3))
    want = np.zeros((pieces.size, 3))
    for w, n in zip(words, counts, strict=True):
        for g in range(3):
            for c in cuts("▁" + w):
                for k in c:
                    want[k, g] += n[g] * math.prod(p[j, g] for j in c) / whole(w, g)
    assert np.allclose(lang_id.expected(pieces, p, words, counts), want)
