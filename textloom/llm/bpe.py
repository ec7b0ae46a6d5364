"""BPE encoding and decoding by a pair occurrence index.

The words of a block of texts are laid out as one sequence of symbols. An index maps each mergeable pair to all places
where it stands; the ranks that occur are taken in ascending order, each is applied at all its places at once (arrays), and the
lists of the pairs that this makes are extended. Places that a later merge has consumed are found stale when their turn comes.

Defined results: a null text counts as empty; an empty text has no ids; special tokens that stand in a text get their own
id; equal texts get equal rows; rows are kept one to one, with their order of columns; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from textloom.llm import common

TOKENIZER = "word_bpe_49k.json"
#: Words that one index covers, and runs and words each that a worker remembers in either of two generations.
BLOCK_WORDS, KEPT_WORDS = 40_000, 150_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in vocabularies of byte-level BPE."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    table = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


#: Number of ids, ids as unsigned 32-bit little-endian, decoded text.
Entry = tuple[int, bytes, bytes]


class Kept(dict):
    """Entries in two generations: a full one becomes the old one, from which entries that are asked for move up, and the rest is forgotten."""

    def __init__(self, most: int) -> None:
        super().__init__()
        self.most, self.old = most, {}

    def missing(self, keys: list) -> list:
        """Those of different keys that are in neither generation; those in the old one move up."""
        out, old = [], self.old
        for k in [k for k in keys if k not in self]:
            if k in old:
                self[k] = old[k]
            else:
                out.append(k)
        return out

    def age(self) -> None:
        """To be called between blocks."""
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


class Partners:
    """Ranks of the pairs that a token makes with others, on one side of it."""

    def __init__(self, tokens: list[int], others: list[int], base: int) -> None:
        by = np.lexsort((others, tokens))
        self.others, self.ranks = np.array(others)[by], by.astype(np.int32)
        self.bounds = np.searchsorted(np.array(tokens)[by], np.arange(base + 1)).tolist()
        self.rank_of = np.full(base + 1, -1, np.int32)  # the last is for -1

    def __call__(self, token: int, syms: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranks of those places whose symbols make a pair with the token, and those places."""
        a, b = self.bounds[token], self.bounds[token + 1]
        if a == b or not len(syms):
            return self.ranks[:0], places[:0]
        self.rank_of[self.others[a:b]] = self.ranks[a:b]
        ranks = self.rank_of[syms]
        self.rank_of[self.others[a:b]] = -1
        found = np.flatnonzero(ranks >= 0)
        return ranks[found], places[found]


def extend(places: dict[int, list[np.ndarray]], heap: list[int], ranks: np.ndarray, at: np.ndarray) -> None:
    """Adds places to the lists of their ranks; ranks that are new to the index go onto the heap."""
    if not len(ranks):
        return
    by = np.argsort(ranks, kind="stable")
    ranks, at = ranks[by], at[by]
    cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
    for r, a, b in zip(ranks[cuts[:-1]].tolist(), cuts, cuts[1:], strict=False):
        if r in places:
            places[r].append(at[a:b])
        else:
            places[r] = [at[a:b]]
            heapq.heappush(heap, r)


def apart(places: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """Of ascending places of a pair of equal symbols, those that a pass from the left takes: none is the second of one taken before."""
    out, second = [], -1
    for p, q in zip(places.tolist(), nxt[places].tolist(), strict=True):
        if p != second:
            out.append(p)
            second = q
    return np.array(out, np.int64)


def strings(values: pa.Array) -> list[str]:
    """Without nulls; to_pylist() would go by a scalar each."""
    return values.to_numpy(zero_copy_only=False).tolist()


def joined(entries: list[bytes], codes: np.ndarray | pa.Array) -> tuple[bytes, np.ndarray]:
    """The entries that the codes name, one after the other, and the place where each begins and the last ends."""
    return laid_out(pa.array(entries, pa.large_binary()).take(pa.array(codes)))


def laid_out(values: pa.Array) -> tuple[bytes, np.ndarray]:
    """The bytes of a large_binary array without offset, and where each of its values begins and the last ends."""
    if not len(values):
        return b"", np.zeros(1, np.int64)
    _, bounds, data = values.buffers()
    return data.to_pybytes() if data else b"", np.frombuffer(bounds, np.int64, len(values) + 1)


class PairIndexBPE:
    """Encoder and decoder for a tokenizer file with word ends, split by a pattern after NFC and lower-casing."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        end = model["end_of_word_suffix"] or ""
        self.tokens = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}") + "| ").findall  # a space ends a run
        letters = byte_alphabet()
        self.inner, self.last = np.array([vocab[c] for c in letters]), np.array([vocab[c + end] for c in letters])
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        self.left, self.right = [vocab[a] for a, _ in pairs], [vocab[b] for _, b in pairs]
        self.made = [vocab[a + b] for a, b in pairs]
        self.base = max(vocab.values()) + 1
        self.following, self.preceding = Partners(self.left, self.right, self.base), Partners(self.right, self.left, self.base)
        rank = {x: r for r, x in enumerate(zip(self.left, self.right, strict=True))}
        seconds = [*self.inner.tolist(), *self.last.tolist()]
        #: Rank of a byte inside a word with the next one, which is inside too (to 255) or ends the word; -1 where there is none.
        self.bytes_rank = np.array([[rank.get((a, b), -1) for b in seconds] for a in self.inner.tolist()], np.int32)
        self.runs: Kept = Kept(KEPT_WORDS)
        self.seen_words: Kept = Kept(KEPT_WORDS)
        self.spelt = pa.array([self.tokens.get(i, "").encode() + b" " for i in range(max(self.tokens) + 1)], pa.large_binary())

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words (none empty), one word's after the other's, and where those of each word end."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        raw = np.frombuffer(b"".join(words), np.uint8)
        n = len(raw)
        sym = self.inner[raw]
        sym[ends - 1] = self.last[raw[ends - 1]]
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        nxt[ends - 1] = -1
        prv[ends - lengths] = -1
        second = raw.astype(np.int16)
        second[ends - 1] += 256
        ranks = self.bytes_rank[raw[:-1], second[1:]]
        ranks[ends[:-1] - 1] = -1
        at = np.flatnonzero(ranks >= 0)
        places: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []
        extend(places, heap, ranks[at], at)
        while heap:
            r = heapq.heappop(heap)
            a, b, new = self.left[r], self.right[r], self.made[r]
            p = places.pop(r)
            p = np.concatenate(p) if len(p) > 1 else p[0]
            q = nxt[p]
            fresh = (sym[p] == a) & (sym[q] == b) & (q >= 0)
            if not fresh.all():
                p = p[fresh]
            if a == b:
                p = apart(np.unique(p), nxt)
            q = nxt[p]
            sym[p], sym[q] = new, -1
            after, before = nxt[q], prv[p]  # a place whose symbol is gone (-1) has no partners
            nxt[p] = after
            inside = after >= 0
            after, p_after = after[inside], p[inside]
            prv[after] = p_after
            extend(places, heap, *self.following(new, sym[after], p_after))
            before = before[before >= 0]
            extend(places, heap, *self.preceding(new, sym[before], before))
        left = sym >= 0
        return sym[left].astype("<u4"), np.cumsum(left)[ends - 1]

    def decode(self, ids: Iterable[int]) -> str:
        """The file names no decoder: tokens, special ones too, with single spaces between."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids])

    def parts(self, text: str) -> list[str | int]:
        """A text as stretches, ready to be split at spaces, and ids of special tokens."""
        if "<|" in text and self.split_special.search(text):
            out: list[str | int] = []
            for x in self.split_special.split(text):
                out += [self.special[x]] if x in self.special else self.parts(x)
            return out
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower-casing goes by single characters
        return [text.lower()]

    def learn(self, runs: list[str]) -> None:
        """Ids of runs that are not known."""
        if not runs:
            return
        found = pa.array(self.words(" ".join(runs) + " "), pa.large_string()).dictionary_encode()
        names = strings(found.dictionary)
        words = self.seen_words
        words.age()
        words[" "] = b""
        todo = words.missing(names)
        for k in range(0, len(todo), BLOCK_WORDS):
            block = todo[k : k + BLOCK_WORDS]
            ids, ends = self.merge([w.encode() for w in block])
            raw, at = ids.tobytes(), 0
            for w, e in zip(block, (4 * ends).tolist(), strict=True):
                words[w] = raw[at:e]
                at = e
        raw, bounds = joined([words[w] for w in names], found.indices)
        known, at = self.runs, 0
        for x, e in zip(runs, bounds[np.flatnonzero(found.indices.to_numpy() == names.index(" "))].tolist(), strict=True):
            known[x] = raw[at:e]
            at = e

    def encode_batch(self, batch: list[str]) -> Iterator[Entry]:
        """For each text the number of ids, the ids and the decoded text."""
        rows = [self.parts(x) for x in batch]
        parts = [x for row in rows for x in row]
        split = pc.split_pattern(pa.array(["" if isinstance(x, int) else x for x in parts], pa.large_string()), " ")
        starts, runs = split.offsets.to_numpy(), split.values.dictionary_encode()
        names = strings(runs.dictionary)
        known = self.runs
        known.age()
        self.learn(known.missing(names))
        entries, codes = [known[x] for x in names], runs.indices.to_numpy()
        if special := [(k, x) for k, x in enumerate(parts) if isinstance(x, int)]:
            codes = codes.copy()
            for k, x in special:  # in the place of its empty run
                codes[starts[k]] = len(entries)
                entries.append(np.array([x], "<u4").tobytes())
        raw, bounds = joined(entries, codes)
        text, spelt = laid_out(self.spelt.take(pa.array(np.frombuffer(raw, "<u4").astype(np.uint32, copy=False))))
        ends = bounds[starts[np.cumsum([len(row) for row in rows], dtype=np.int64)]].tolist()
        at = 0
        for e, a, b in zip(ends, spelt[[0, *(x // 4 for x in ends[:-1])]].tolist(), spelt[[x // 4 for x in ends]].tolist(), strict=False):
            yield (e - at) // 4, raw[at:e], text[a : b - 1] if b > a else b""
            at = e


_LOADED: dict[str, PairIndexBPE] = {}


def tokenizer(path: str) -> PairIndexBPE:
    """One encoder for each worker process and file."""
    if path not in _LOADED:
        _LOADED[path] = PairIndexBPE(path)
    return _LOADED[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def encode(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, ids array<bigint>, decoded string of each row. The file must be at the same path on every machine."""
    path = path or default_path()

    def run(batches):
        bpe = tokenizer(path)
        for batch in batches:
            for b in common.pieces(batch, text_col):
                rows = list(bpe.encode_batch(common.texts(b, text_col)))
                ids = pa.array([np.frombuffer(x[1], "<u4").astype(np.int64) for x in rows], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column(id_col), ids, pa.array([x[2].decode() for x in rows], pa.string())], [id_col, "ids", "decoded"])

    kind = df.schema[id_col].dataType.simpleString()
    return common.by_arrow(df.select(id_col, text_col), run, f"`{id_col}` {kind}, ids array<bigint>, decoded string")


def digests(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, ids_sha256, decoded_sha256 of each row; the ids themselves don't leave the worker."""
    path = path or default_path()

    def run(batches):
        bpe = tokenizer(path)
        for batch in batches:
            for b in common.pieces(batch, text_col):
                n, ids, decoded = [], [], []
                for count, raw, text in bpe.encode_batch(common.texts(b, text_col)):
                    n.append(count)
                    ids.append(hashlib.sha256(raw).hexdigest())
                    decoded.append(hashlib.sha256(text).hexdigest())
                yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[id_col].dataType.simpleString()
    return common.by_arrow(df.select(id_col, text_col), run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.documents(spark, sf_dir))
