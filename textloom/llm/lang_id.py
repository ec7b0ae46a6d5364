"""Language identification by unigrams of pieces, marginalised over segmentations.

The pieces are those of a fixed public vocabulary. Each language has a probability for each piece; a word's probability is
the sum over all ways to cut it into pieces, by the forward algorithm, and a text's is the product over its words and
the language's share of the training texts. Piece probabilities come from ROUNDS of expectation-maximisation over the
words of the training texts, with the backward algorithm giving the expected counts. The model has one number for each
piece and language.

Defined results: a null text or one without letters is "und" with score 0; so is any text if nothing was learned; a
tie goes to the language that sorts first; words of any length are scored over all segmentations, but teach in runs of LONGEST letters;
repeated ids and equal texts give one row each; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm import common

VOCABULARY = "piece_bpe_32k.model"
LONGEST = 24
ROUNDS = 2
#: Chunks between spaces that a worker remembers.
KEPT = 120_000
#: Training texts of each language, at most, in the order of a hash of id and text; the vocabulary bounds all else.
SAMPLE = 3_000
#: Pseudo-counts that a language gets in proportion to all languages' pieces, and each character without a piece.
SMOOTH, UNKNOWN = 50.0, 1e-7
_WORDS = re.compile(r"[^\W\d_]+").findall
_MARK = "▁"
_B = np.uint64(0x9E3779B97F4A7C15)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def vocabulary(path: str) -> list[str]:
    """The pieces that lower-case words can hold."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i) for i in range(model.get_piece_size())}
    return sorted(p for p in pieces if p == p.lower() and re.fullmatch(r"▁?[^\W\d_]*", p) and p)


def words_of(chunk: str) -> list[str]:
    """The runs of letters of a lower-case chunk."""
    found = _WORDS(chunk)
    if not chunk.isascii() and not all(map(str.isalpha, found)):  # numerals such as a superscript two are no letters
        found = [w for w in ("".join(filter(str.isalpha, w)) for w in found) if w]
    return found


class Pieces:
    """The vocabulary with fast look-up; the last number stands for a character without a piece."""

    def __init__(self, path: str) -> None:
        self.names = vocabulary(path)
        # all beginnings of pieces, with the piece's number or -1, so that a run of characters is dropped once no piece begins with it
        number = {p[:k]: -1 for p in self.names for k in range(1, len(p))} | {p: k for k, p in enumerate(self.names)}
        keys = np.zeros(len(number), np.uint64)
        with np.errstate(over="ignore"):
            for k, p in enumerate(number):
                h = np.uint64(0)
                for c in p:
                    h = h * _B + np.uint64(ord(c) + 1)
                keys[k] = h
        self.number = np.fromiter(number.values(), np.int64, len(number))
        self.find = common.Lookup(keys)
        self.size = len(self.names) + 1
        self.longest = max(map(len, self.names), default=1)
        self.by_name: dict[str, int] = {}

    def spans(self, words: list[str]) -> tuple[int, dict[tuple[int, int], np.ndarray]]:
        """For words of one length, each with its mark: number of characters, and (from, to) -> piece numbers or -1."""
        chars = np.array([list(map(ord, _MARK + w)) for w in words], np.uint64) + np.uint64(1)
        n = chars.shape[1]
        out = {}
        for i in range(n):
            left, h = np.arange(len(words)), np.zeros(len(words), np.uint64)
            for j in range(i, min(n, i + self.longest)):
                h = h * _B + chars[left, j]
                got = self.find(h)
                go = got >= 0
                left, h = left[go], h[go]
                piece = np.full(len(words), self.size - 1 if j == i else -1)
                piece[left] = self.number[got[go]]
                if j == i:
                    piece[piece < 0] = self.size - 1
                if (piece >= 0).any():
                    out[i, j + 1] = piece
                if not len(left):
                    break
        return n, out


def forward(n: int, spans: dict, p: np.ndarray, rows: int) -> np.ndarray:
    """[place, word, language] sums over all segmentations up to each place; p: [piece or none, language]."""
    alpha = np.zeros((n + 1, rows, p.shape[1]))
    alpha[0] = 1
    for (i, j), piece in spans.items():
        alpha[j] += alpha[i] * p[piece]
    return alpha


def backward(n: int, spans: dict, p: np.ndarray, rows: int) -> np.ndarray:
    beta = np.zeros((n + 1, rows, p.shape[1]))
    beta[n] = 1
    for (i, j), piece in sorted(spans.items(), key=lambda x: -x[0][0]):
        beta[i] += beta[j] * p[piece]
    return beta


def by_length(words: list[str], most: int = 8_000):
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    for same in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
        for k in range(0, len(same), most):
            yield same[k : k + most]


def long_score(pieces: Pieces, p: np.ndarray, word: str) -> np.ndarray:
    """[language] natural log-probability of one long word: the forward sum, brought back to a sum of 1 at each place."""
    if not pieces.by_name:
        pieces.by_name = {x: k for k, x in enumerate(pieces.names)}
    number, most, none = pieces.by_name, pieces.longest, pieces.size - 1
    word = _MARK + word
    alpha, log = [np.ones(p.shape[1])], np.zeros(p.shape[1])  # alpha: of the last places, the newest last
    for j in range(1, len(word) + 1):
        now = alpha[-1] * p[number.get(word[j - 1], none)]
        for k in range(2, min(j, most) + 1):
            if (piece := number.get(word[j - k : j])) is not None:
                now = now + alpha[-k] * p[piece]
        alpha = [x / now for x in alpha[1 - most :]] + [np.ones(len(now))]
        log += np.log(now)
    return log


def word_scores(pieces: Pieces, p: np.ndarray, words: list[str]) -> np.ndarray:
    """[word, language] natural log-probabilities; p as from probabilities()."""
    out = np.zeros((len(words), p.shape[1]))
    short = [k for k, w in enumerate(words) if len(w) <= LONGEST]
    if len(short) < len(words):
        out[short] = word_scores(pieces, p, [words[k] for k in short])
        for k, w in enumerate(words):
            if len(w) > LONGEST:
                out[k] = long_score(pieces, p, w)
        return out
    for part in by_length(words):
        n, spans = pieces.spans([words[k] for k in part])
        out[part] = np.log(np.maximum(forward(n, spans, p, len(part))[n], 1e-300))
    return out


def expected(pieces: Pieces, p: np.ndarray, words: list[str], counts: np.ndarray) -> np.ndarray:
    """[piece, language] expected counts; counts: [word, language]."""
    size, langs = pieces.size, p.shape[1]
    out = np.zeros((size, langs))
    for part in by_length(words):
        n, spans = pieces.spans([words[k] for k in part])
        alpha, beta = forward(n, spans, p, len(part)), backward(n, spans, p, len(part))
        scale = counts[part] / np.maximum(alpha[n], 1e-300)
        for (i, j), piece in spans.items():
            share = alpha[i] * p[piece] * beta[j] * scale
            for g in range(langs):
                out[:, g] += np.bincount(piece + 1, share[:, g], size + 1)[1:]
    return out


def probabilities(counts: np.ndarray) -> np.ndarray:
    """[piece + none, language]; at -1, the last row, no piece: 0."""
    whole = counts.sum(axis=1, keepdims=True) + 0.01
    p = counts + SMOOTH * whole / whole.sum()
    p /= p.sum(axis=0)
    p[-1] = UNKNOWN
    return np.concatenate((p, np.zeros((1, counts.shape[1]))))


_PIECES: dict[str, Pieces] = {}


def loaded(path: str) -> Pieces:
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def cut(n: int) -> int:
    """The hash that about twice SAMPLE of n rows are at or below; the highest if there are no more."""
    return min(2**63 - 1, 2**65 * SAMPLE // max(n, 1) - 2**63)


def training_rows(rows: DataFrame, n: dict[str, int]) -> DataFrame:
    """id, text, lang -> text, lang: SAMPLE rows of each language, all if it has fewer, in the order of a hash of id and text.

    n has the rows of each language. A first cut at a hash that twice SAMPLE rows are below keeps the ranking small. Rows alike count as one.
    """
    h = F.xxhash64("id", "text")
    least = F.create_map(*[x for lang, k in n.items() for x in (F.lit(lang), F.lit(cut(k)).cast("long"))])
    few = rows.withColumn("h", h).where(F.col("h") <= F.element_at(least, F.col("lang")))
    one = few.groupBy("lang", "h").agg(F.first("text").alias("text"))  # rows of one hash are alike
    return one.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= SAMPLE).select("text", "lang")


def fitted(labelled: DataFrame, path: str | None = None, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log shares and piece probabilities from rows with text and language, SAMPLE of each language at most."""
    path = path or default_path()
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    share = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()
    langs, n = [x.lang for x in share], np.array([x.n for x in share], float)
    if not langs:
        return [], np.zeros(0), np.zeros((1, 0))
    number = {x: k for k, x in enumerate(langs)}
    taken = training_rows(rows, {x.lang: x.n for x in share})

    def count(batches):
        counts: Counter = Counter()
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), common.texts(batch), strict=True):
                counts.update((lang, w[k : k + LONGEST]) for chunk in text.lower().split() for w in words_of(chunk) for k in range(0, len(w), LONGEST))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(counts.values(), pa.int64())], ["lang", "word", "n"])

    words = common.written(common.by_arrow(taken, count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")), "lang-words")
    pieces = loaded(path)
    p = probabilities(np.ones((pieces.size, len(langs))))
    for _ in range(ROUNDS):
        q = p

        def expect(batches, q=q):
            own = loaded(path)
            sums = np.zeros((own.size, len(langs)))
            for batch in batches:
                index = common.Index()
                word = np.fromiter(map(index.__getitem__, batch.column("word").to_pylist()), np.int64, batch.num_rows)
                counts = np.zeros((len(index), len(langs)))
                np.add.at(counts, (word, [number[x] for x in batch.column("lang").to_pylist()]), batch.column("n").to_numpy())
                sums += expected(own, q, list(index), counts)
            piece, lang = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(lang), pa.array(sums[piece, lang])], ["piece", "lang", "n"])

        got = common.by_arrow(words, expect, "piece bigint, lang bigint, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toArrow()
        sums = np.zeros((pieces.size, len(langs)))
        sums[got.column(0).to_numpy(), got.column(1).to_numpy()] = got.column(2).to_numpy()
        p = probabilities(sums)
    return langs, np.log(n / n.sum()), p


class Scorer:
    """Languages of texts; remembers the scores of the chunks it has met."""

    def __init__(self, langs: list[str], prior: np.ndarray, p: np.ndarray, path: str) -> None:
        self.langs, self.prior, self.p, self.pieces = langs, prior, p, loaded(path)
        self.known, self.table = common.Index(), np.zeros((0, len(langs) + 1))
        self.words, self.scores = common.Index(), np.zeros((0, len(langs)))

    def __call__(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language or und, and posterior or 0."""
        if len(self.known) > KEPT:
            self.known, self.table = common.Index(), self.table[:0]
        if len(self.words) > KEPT:
            self.words, self.scores = common.Index(), self.scores[:0]
        chunks = [x.lower().split() for x in texts]
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        flat = np.fromiter(map(self.known.__getitem__, chain.from_iterable(chunks)), np.int64, int(sizes.sum()))
        split = [words_of(x) for x in islice(self.known, len(self.table), None)]
        at = np.fromiter(map(self.words.__getitem__, chain.from_iterable(split)), np.int64)
        of = np.repeat(np.arange(len(split)), np.fromiter(map(len, split), np.int64, len(split)))
        self.scores = np.concatenate((self.scores, word_scores(self.pieces, self.p, list(islice(self.words, len(self.scores), None)))))
        columns = [np.bincount(of, self.scores[at, g], len(split)) for g in range(len(self.langs))] + [np.bincount(of, minlength=len(split))]
        self.table = np.concatenate((self.table, np.stack(columns, axis=1)))
        text = np.repeat(np.arange(len(chunks)), sizes)
        sums = np.stack([np.bincount(text, self.table[flat, g], len(chunks)) for g in range(len(self.langs) + 1)], axis=1)
        logs, found = sums[:, :-1] + self.prior, sums[:, -1] > 0
        score = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
        names = [self.langs[k] if ok else "und" for k, ok in zip(logs.argmax(axis=1), found, strict=True)]
        return names, np.where(found, score, 0.0)


def identified(df: DataFrame, model: tuple, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred, score (the language's posterior) of each row."""
    path, (langs, prior, p) = path or default_path(), model
    if not langs:
        return df.select(id_col, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shipped = df.sparkSession.sparkContext.broadcast(p)

    def run(batches):
        scorer = Scorer(langs, prior, shipped.value, path)
        for batch in batches:
            for b in common.pieces(batch, text_col):
                names, score = scorer(common.texts(b, text_col))
                yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(names, pa.string()), pa.array(score)], [id_col, "lang_pred", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    return common.by_arrow(df.select(id_col, text_col), run, f"`{id_col}` {kind}, lang_pred string, score double")


def with_language(df: DataFrame, model: tuple, path: str | None = None, text_col: str = "text", wanted: set[str] | None = None) -> DataFrame:
    """The rows of df, with all columns, that are in a wanted language (None: in any that was learned)."""
    path, (langs, prior, p) = path or default_path(), model
    wanted = set(langs) if wanted is None else wanted
    if not langs:
        return df.where(F.lit(False))
    shipped = df.sparkSession.sparkContext.broadcast(p)
    return common.kept(df, lambda: Scorer(langs, prior, shipped.value, path), lambda scorer, texts: np.array([x in wanted for x in scorer(texts)[0]], bool), text_col)


def op8_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = common.id_mod("doc_id", 4) == 2
    found = identified(docs, fitted(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
