"""Toxicity by a support vector machine over a gap-weighted subsequence kernel with Nyström landmarks.

The kernel of two tokens sums, over all subsequences of three characters that both have, DECAY to the power of the
stretch that each takes in either; it is divided by what the lengths alone would give. A token with characters put in
between keeps its subsequences, only a little lighter, so "id.iot" stays near "idiot". Landmarks are tokens; a token's
features are its kernels with them, whitened (Nyström). As the kernel is linear in subsequences, the trained machine is
folded into one weight for each of 64**3 subsequences, which costs the same for any number of landmarks.

Training goes by sentences: a sentence has its text's label, and its strongest token stands for it. A toxic text needs one
toxic sentence, so each round takes as positives the strongest sentences of toxic texts, and as negatives the strongest
ones of all others. A text's score is that of its strongest token, made a probability by a logistic fit.

Defined results: a null text counts as empty; an empty text has the score of the weakest possible token; runs of three or more
single characters also count as one token; tokens over LONGEST characters are taken in overlapping windows; without
both labels in the training rows every score is 0; repeated ids and equal texts give one row each; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import chain, combinations, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm import common

DECAY, LONGEST, ALPHABET = 0.45, 22, 64
#: Landmarks: tokens that toxic texts have more often, frequent tokens, and in each round the strongest of clean texts.
LANDMARKS, ROUNDS = (160, 40, 80), 5
#: Tokens that a worker remembers.
KEPT = 200_000
#: Labelled ids to train on, of each label, at most, in the order of a hash of the id; bytes of their texts of each label together,
#: about at most; bytes of a single one, at most.
SAMPLE, SAMPLE_BYTES, LONGEST_SAMPLE = {1: 1500, 0: 2500}, 32 << 20, 1 << 20
_SENTENCES = re.compile(r"[.!?\n]+\s").split
_EDGE = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~«»“”„‘’…"


def tokens(text: str) -> list[str]:
    out = text.lower().split()
    if any(len(x) == 1 for x in out):
        run: list[str] = []
        for x in [*out, "  "]:
            if len(x) == 1:
                run.append(x)
            else:
                if len(run) > 2:
                    out.append("".join(run))
                run = []
    return out


def _codes(token: str) -> list[int]:
    """Letters a to z, 36 classes of all else, and marks at both ends."""
    return [62, *[c - 97 if 97 <= c <= 122 else 26 + c % 36 for c in map(ord, token)], 63]


def _windows(token: str) -> list[str]:
    token = token.strip(_EDGE) or token
    if len(token) <= LONGEST:
        return [token]
    return [token[k : k + LONGEST] for k in range(0, len(token) - LONGEST // 2, LONGEST // 2)]


_TRIPLES: dict[int, tuple] = {}


def _triples(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The places of each subsequence in a token of n characters, and weights of length one."""
    if n not in _TRIPLES:
        i, j, k = np.array(list(combinations(range(n), 3)), np.int64).T
        w = DECAY ** (k - i + 1.0)
        _TRIPLES[n] = i, j, k, (w / np.sqrt((w * w).sum())).astype(np.float32)
    return _TRIPLES[n]


def _by_length(words: list[str]):
    codes: dict[int, tuple[list, list]] = {}
    for k, w in enumerate(words):
        c = _codes(w)
        at, rows = codes.setdefault(len(c), ([], []))
        at.append(k)
        rows.append(c)
    for n, (at, rows) in codes.items():
        if n > 2:
            i, j, k, w = _triples(n)
            step = max(1, 500_000 // len(w))
            for a in range(0, len(at), step):
                c = np.array(rows[a : a + step], np.int32)
                yield np.array(at[a : a + step]), (c[:, i] * ALPHABET + c[:, j]) * ALPHABET + c[:, k], w


def embedded(word: str) -> tuple[np.ndarray, np.ndarray]:
    """The subsequences of a token and their weights."""
    for _, sub, w in _by_length([word]):
        return sub[0], w
    return np.zeros(0, np.int64), np.zeros(0, np.float32)


def kernels(words: list[str], landmarks: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """[word, landmark]; landmarks as from embedded()."""
    out = np.zeros((len(words), len(landmarks)), np.float32)
    dense = np.zeros(ALPHABET**3, np.float32)
    for at, sub, w in _by_length(words):
        for m, (where, v) in enumerate(landmarks):
            np.add.at(dense, where, v)
            out[at, m] = dense[sub] @ w
            dense[where] = 0
    return out


class Kernels:
    """Kernels of tokens with a growing list of landmarks; what was worked out stays."""

    def __init__(self) -> None:
        self.marks: list[str] = []
        self.vectors: list[tuple[np.ndarray, np.ndarray]] = []
        self.rows: dict[str, np.ndarray] = {}

    def add(self, tokens: list[str]) -> None:
        for z in tokens:
            if z not in self.marks:
                self.marks.append(z)
                self.vectors.append(embedded(z))

    def __call__(self, tokens: list[str]) -> np.ndarray:
        """[token, landmark]."""
        known: dict[int, list[str]] = {}
        for w in set(tokens):
            known.setdefault(len(self.rows.get(w, ())), []).append(w)
        for n, words in known.items():
            if n < len(self.vectors):
                new = kernels(words, self.vectors[n:])
                for w, row in zip(words, new, strict=True):
                    self.rows[w] = np.concatenate((self.rows[w], row)) if n else row
        return np.stack([self.rows[w] for w in tokens])


def folded_scores(weight: np.ndarray, words: list[str]) -> np.ndarray:
    out = np.zeros(len(words), np.float32)
    for at, sub, w in _by_length(words):
        out[at] = weight[sub] @ w
    return out


def token_scores(weight: np.ndarray, bias: float, words: list[str]) -> np.ndarray:
    """The machine's value of each token: that of its strongest window."""
    split = [_windows(w) for w in words]
    values = folded_scores(weight, [x for ws in split for x in ws])
    starts = np.cumsum([0] + [len(ws) for ws in split[:-1]])
    return (np.maximum.reduceat(values, starts) if words else values) + np.float32(bias)


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Newton steps; y: 1 or -1."""
    x1 = np.concatenate((x, np.ones((len(x), 1), x.dtype)), axis=1)
    v = np.zeros(x1.shape[1])
    ridge = np.eye(len(v))
    ridge[-1, -1] = 1e-6
    for _ in range(rounds):
        inside = y * (x1 @ v) < 1
        h, g = ridge.copy(), np.zeros(len(v))
        for part in np.array_split(np.flatnonzero(inside), max(1, int(inside.sum()) // 4000)):
            xa, wa = x1[part].astype(np.float64), weight[part] * c
            h += (xa * wa[:, None]).T @ xa
            g += xa.T @ (wa * y[part])
        new = np.linalg.solve(h, g)
        if np.allclose(new, v, atol=1e-6):
            break
        v = new
    return v[:-1], float(v[-1])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 100) -> np.ndarray:
    """Weights and, last, the bias, by Newton steps that are halved until they help; the ridge acts on scaled features."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    x1 = np.concatenate(((x - mean) / scale, np.ones((len(x), 1))), axis=1)
    shrink = np.append(np.full(x.shape[1], ridge), 1e-6)

    def loss(v: np.ndarray) -> float:
        return float(np.logaddexp(0, np.where(y > 0.5, -1, 1) * (x1 @ v)).sum() + (shrink * v * v).sum() / 2)

    v = np.zeros(x1.shape[1])
    now = loss(v)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ v, -40, 40)))
        h = (x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag(shrink)
        step = np.linalg.solve(h, x1.T @ (y - p) - shrink * v)
        while np.abs(step).max() > 1e-9 and loss(v + step) > now:
            step = step / 2
        v = v + step
        before, now = now, loss(v)
        if before - now < 1e-9 * max(1.0, now):
            break
    return np.append(v[:-1] / scale, v[-1] - (v[:-1] * mean / scale).sum())


def _gapped(token: str, times: float) -> list[tuple[str, float]]:
    """A toxic token with one character put in at each inner place, as training examples of little weight."""
    n = len(token)
    return [(token[:k] + "-.*_x"[k % 5] + token[k:], times / n / 8) for k in range(1, n)] if 4 <= n < LONGEST else []


class Model:
    """weight: of each subsequence; bias; slope and offset of the logistic fit."""

    def __init__(self, weight: np.ndarray, bias: float, slope: float, offset: float) -> None:
        self.weight, self.bias, self.slope, self.offset = weight, bias, slope, offset

    def probability(self, strongest: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * strongest + self.offset, -30, 30)))


def trained(rows: list[tuple[str, int]]) -> Model | None:
    """From texts with labels; None unless both labels are there."""
    if len({y for _, y in rows}) < 2:
        return None
    index = common.Index()
    texts = []  # of each text: label, sentences as arrays of token numbers
    for text, y in rows:
        sentences = [np.fromiter(map(index.__getitem__, t), np.int64, len(t)) for t in map(tokens, _SENTENCES(text + " ")) if t]
        if sentences:
            texts.append((y, sentences))
    words, size = list(index), Counter(y for y, _ in texts)
    df = {y: np.zeros(len(words)) for y in (0, 1)}
    for y, sentences in texts:
        df[y][np.unique(np.concatenate(sentences))] += 1
    share = {y: (df[y] + 0.5) / (size[y] + 1) for y in (0, 1)}
    mean = (df[0] + df[1]) * size[1] / (size[0] + size[1])
    sure = (df[1] - mean) / np.sqrt(mean + 1)  # how far toxic texts have the token beyond chance
    score = sure - 2
    lift = share[1] - share[0]
    short = [_windows(w)[0] for w in words]
    kernel = Kernels()
    kernel.add([short[k] for k in [*np.argsort(-lift, kind="stable")[: LANDMARKS[0]], *np.argsort(-(df[0] + df[1]), kind="stable")[: LANDMARKS[1]]]])
    weight, bias = np.zeros(ALPHABET**3, np.float32), 0.0
    positive, negative = Counter(), Counter()
    for _ in range(ROUNDS):
        positive.clear()
        for y, sentences in texts:
            best = sorted(((score[s].max(), int(s[score[s].argmax()])) for s in sentences), reverse=True)
            if y:
                best = sorted(((v, k) for v, k in best if sure[k] > 2), reverse=True) or best[:1]
                positive.update(k for _, k in best[:3])
            else:
                negative.update(k for _, k in best[:10])
                negative.update(int(s[0]) for s in sentences[:3])
        for k in positive.keys() & negative.keys():  # the likelier label stays
            (negative if df[1][k] / size[1] > df[0][k] / size[0] else positive).pop(k)
        if not positive or not negative:
            break
        kernel.add([short[k] for k in sorted(negative, key=lambda k: (-score[k], k))[: LANDMARKS[2]]])
        gram = kernel(kernel.marks).astype(np.float64)
        values, axes = np.linalg.eigh((gram + gram.T) / 2)
        good = values > 1e-4 * values.max()
        whiten = axes[:, good] / np.sqrt(values[good])
        gapped = {w: n for k, v in positive.items() if sure[k] > 2 for w, n in _gapped(short[k], v)}
        x = kernel([*(short[k] for k in [*positive, *negative]), *gapped]) @ whiten.astype(np.float32)
        y = np.array([1.0] * len(positive) + [-1.0] * len(negative) + [1.0] * len(gapped))
        n = np.array([np.sqrt(v) for v in (*positive.values(), *negative.values(), *gapped.values())])
        n[y > 0] /= n[y > 0].sum()
        n[y < 0] /= n[y < 0].sum()
        v, bias = svm(x, y, n * 3000)
        weight = np.zeros(ALPHABET**3, np.float32)
        for share_of, z in zip(whiten @ v, kernel.vectors, strict=True):
            np.add.at(weight, z[0], np.float32(share_of) * z[1])
        score = token_scores(weight, bias, words).astype(np.float64)
    strongest = np.array([max(score[s].max() for s in sentences) for _, sentences in texts])
    slope, offset = logistic(strongest[:, None], np.array([float(y) for y, _ in texts]))
    return Model(weight, bias, float(slope), float(offset))


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sizes: dict[int, int] = SAMPLE) -> list[tuple[str, int]]:
    """So many labelled texts of each label, in the order of a hash of the id, up to SAMPLE_BYTES bytes together.

    The ids come from the labels alone, so only the sample's texts are shuffled. An id with several texts gives one of them, however many rows
    it has; an id with both labels teaches nothing; texts over LONGEST_SAMPLE bytes are passed over.
    """
    ids = None
    for y, n in sizes.items():
        part = labels.where(F.col(label_col) == y).select(F.col(id_col).alias("i")).distinct().orderBy(F.xxhash64("i"), "i").limit(n).withColumn("y", F.lit(y))
        ids = part if ids is None else ids.unionByName(part)
    ids = ids.groupBy("i").agg(F.min("y").alias("y"), F.count("*").alias("n")).where("n = 1").drop("n")
    rows = docs.where(F.octet_length(text_col) <= LONGEST_SAMPLE).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    one = rows.join(F.broadcast(ids), "i").groupBy("i", "y").agg(F.min("t").alias("t"))
    before = Window.partitionBy("y").orderBy(F.xxhash64("i"), "i").rowsBetween(Window.unboundedPreceding, -1)
    taken = one.withColumn("b", F.coalesce(F.sum(F.octet_length("t")).over(before), F.lit(0))).where(F.col("b") < SAMPLE_BYTES)
    got = taken.select("i", "t", "y").toArrow().to_pydict()
    return [(t, y) for _, t, y in sorted(zip(got["i"], got["t"], got["y"], strict=True))]


class Scorer:
    """Probabilities of texts; remembers the values of tokens it has met."""

    def __init__(self, model: Model) -> None:
        self.model, self.known, self.values = model, common.Index(), np.zeros(0, np.float32)

    def __call__(self, texts: list[str]) -> np.ndarray:
        if len(self.known) > KEPT:
            self.known, self.values = common.Index(), self.values[:0]
        rows = list(map(tokens, texts))
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.fromiter(map(self.known.__getitem__, chain.from_iterable(rows)), np.int64, int(sizes.sum()))
        new = list(islice(self.known, len(self.values), None))
        self.values = np.concatenate((self.values, token_scores(self.model.weight, self.model.bias, new)))
        best = np.full(len(rows), self.model.bias - 1.0)
        full = np.flatnonzero(sizes)
        if len(full):
            best[full] = np.maximum.reduceat(self.values[flat], (np.cumsum(sizes) - sizes)[full])
        return self.model.probability(best)


def scored(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, score, predicted of each row."""
    kind = df.schema[id_col].dataType.simpleString()
    if model is None:
        return df.select(id_col, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    shipped = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        machine = Scorer(shipped.value)
        for batch in batches:
            for b in common.pieces(batch, text_col):
                p = machine(common.texts(b, text_col))
                yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [id_col, "score", "predicted"])

    return common.by_arrow(df.select(id_col, text_col), run, f"`{id_col}` {kind}, score double, predicted int")


def without_toxic(df: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of df, with all columns, that are not predicted toxic."""
    if model is None:
        return df
    shipped = df.sparkSession.sparkContext.broadcast(model)
    return common.kept(df, lambda: Scorer(shipped.value), lambda machine, texts: machine(texts) < 0.5, text_col)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    held_out = common.id_mod("doc_id", 5) == 0
    model = trained(sample(docs, common.table(spark, sf_dir, "labels").where(~held_out)))
    return scored(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
