"""Token counts that follow edits: a segment tree over the pre-tokens of each document.

A text is split into pre-tokens by the tokenizer's pattern; BPE never merges across them, so a text's token count is the sum of its
pre-tokens' counts. The leaves are runs of pre-tokens; inner nodes hold sums of characters and of tokens. An edit splits anew only from a
little before it, as far as the pattern can see, until the new pre-tokens fall in step with the old ones; only those are
encoded, the leaves they stand in are filled anew, and the sums above those renewed. Only if these leaves overflow is the tree dealt anew.

Trees are kept as a table (trees), edits are a table too (with_edits), and edited makes the next version of the table: it takes the
leaves as they were stored and encodes nothing but what edits touch.

Defined results: a null text counts as empty; edits beyond the end act at the end, null ones of a field as 0 or the empty text; an empty text has no tokens; strings of
special tokens are ordinary text; repeated ids and equal texts give one row each (each gets all edits of its id); edits of ids that have no tree
do nothing; edits that tie in seq go in the order of start, end and text; other columns of trees pass through.
"""

from __future__ import annotations

import base64
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import common

TOKENIZER = "byte_bpe_50k.tiktoken"
#: Pre-tokens in a leaf, about; pre-tokens before an edit that may change with it; pre-tokens that a worker remembers.
LEAF, CONTEXT, KEPT = 128, 2, 400_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


class Counts(dict):
    """Number of tokens of each pre-token."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("pre-tokens", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.pattern = regex.compile(public_tokenizers.PATTERN)

    def __missing__(self, piece: str) -> int:
        n = len(self.encode(piece))
        if len(self) < KEPT:
            self[piece] = n
        return n


class TokenTree:
    """The pre-tokens of one text: their lengths and token counts in leaves, and sums over the leaves."""

    def __init__(self, text: str, counts: Counts) -> None:
        self.text, self.counts, self.encoded = text, counts, 0
        pieces = counts.pattern.findall(text)
        self.leaves = self._cut(list(map(len, pieces)), list(map(counts.__getitem__, pieces)))
        self._build()

    @classmethod
    def stored(cls, text: str, leaves: bytes, lengths: bytes, tokens: bytes, counts: Counts) -> TokenTree:
        """The tree that packed() gave; nothing is encoded."""
        tree = cls.__new__(cls)
        tree.text, tree.counts, tree.encoded = text, counts, 0
        ends = np.cumsum(np.frombuffer(leaves, np.int32)).tolist()
        a, b = (np.frombuffer(x, np.int32).tolist() for x in (lengths, tokens))
        tree.leaves = [(a[i:j], b[i:j]) for i, j in zip([0, *ends], ends, strict=False)]
        tree._build()
        return tree

    def packed(self) -> tuple[bytes, bytes, bytes]:
        """Pre-tokens of each leaf, lengths of all pre-tokens, and their token counts, as 32-bit integers."""
        pack = lambda x: np.fromiter(x, np.int32).tobytes()
        return pack(len(x) for x, _ in self.leaves), pack(chain.from_iterable(x for x, _ in self.leaves)), pack(chain.from_iterable(x for _, x in self.leaves))

    @staticmethod
    def _cut(lengths: list[int], tokens: list[int]) -> list[tuple[list[int], list[int]]]:
        return [(lengths[k : k + LEAF], tokens[k : k + LEAF]) for k in range(0, len(lengths), LEAF)] or [([], [])]

    def _build(self) -> None:
        self.width = 1 << max(0, (len(self.leaves) - 1).bit_length())
        self.sums = [(0, 0)] * (2 * self.width)
        for k, (lengths, tokens) in enumerate(self.leaves):
            self.sums[self.width + k] = sum(lengths), sum(tokens)
        for k in range(self.width - 1, 0, -1):
            (a, b), (c, d) = self.sums[2 * k], self.sums[2 * k + 1]
            self.sums[k] = a + c, b + d

    def _renew(self, first: int, last: int) -> None:
        """Sums of the leaves from first to last, and of the nodes above them."""
        for k in range(first, last + 1):
            lengths, tokens = self.leaves[k]
            self.sums[self.width + k] = sum(lengths), sum(tokens)
        a, b = self.width + first, self.width + last
        while a > 1:
            a, b = a // 2, b // 2
            for k in range(a, b + 1):
                (x, y), (u, v) = self.sums[2 * k], self.sums[2 * k + 1]
                self.sums[k] = x + u, y + v

    @property
    def tokens(self) -> int:
        return self.sums[1][1]

    @property
    def size(self) -> int:
        return sum(len(x) for x, _ in self.leaves)

    def _at(self, char: int) -> tuple[int, int, int]:
        """Leaf, pre-token in it, and start of the pre-token that holds a character; past the end, the last one."""
        k, start = 1, 0
        char = min(char, max(0, self.sums[1][0] - 1))
        while k < self.width:
            k *= 2
            if char >= start + self.sums[k][0]:
                start += self.sums[k][0]
                k += 1
        lengths, i = self.leaves[k - self.width][0], 0
        while i < len(lengths) - 1 and char >= start + lengths[i]:
            start += lengths[i]
            i += 1
        return k - self.width, i, start

    def edit(self, start: int, end: int, new: str) -> TokenTree:
        """Puts new in the place of text[start:end]."""
        start = min(max(start, 0), len(self.text))
        end = min(max(end, start), len(self.text))
        old_size, shift = len(self.text), len(new) - (end - start)
        leaf, i, at = self._at(start)
        for _ in range(CONTEXT):  # the pattern looks one character ahead
            before = leaf
            while not i and before:  # leaves may be empty
                before -= 1
                i = len(self.leaves[before][0])
            if not i:
                break
            leaf, i = before, i - 1
            at -= self.leaves[leaf][0][i]
        first_leaf, first_i, first = leaf, i, at
        self.text = self.text[:start] + new + self.text[end:]
        # old starts from here on, one by one, until a new one meets them behind the edit
        old = first
        lengths, tokens, pos, met = [], [], first, False
        match = self.counts.pattern.match
        while pos < len(self.text):
            while old < pos - shift and old < old_size:
                if i == len(self.leaves[leaf][0]):
                    leaf, i = leaf + 1, 0
                    continue
                old += self.leaves[leaf][0][i]
                i += 1
            if pos >= start + len(new) and old == pos - shift and old >= end and old < old_size:
                met = True
                break
            piece = match(self.text, pos)[0]
            lengths.append(len(piece))
            tokens.append(self.counts[piece])
            pos += len(piece)
        self.encoded += len(lengths)
        if not met:
            leaf, i = len(self.leaves) - 1, len(self.leaves[-1][0])
        head, tail = self.leaves[first_leaf], self.leaves[leaf]
        lengths, tokens = head[0][:first_i] + lengths + tail[0][i:], head[1][:first_i] + tokens + tail[1][i:]
        slots = leaf - first_leaf + 1
        if len(lengths) <= 4 * LEAF * slots:
            per = -(-len(lengths) // slots)
            self.leaves[first_leaf : leaf + 1] = [(lengths[k * per : k * per + per], tokens[k * per : k * per + per]) for k in range(slots)]
            self._renew(first_leaf, leaf)
        else:
            self.leaves[first_leaf : leaf + 1] = self._cut(lengths, tokens)
            self._build()
        return self


_LOADED: dict[str, Counts] = {}


def _counts(path: str) -> Counts:
    if path not in _LOADED:
        _LOADED[path] = Counts(path)
    return _LOADED[path]


_TREE = "n_tokens bigint, n_pieces bigint, leaves binary, lengths binary, tokens binary"
_EDITS = "array<struct<seq:bigint,start:bigint,end:bigint,new:string>>"


def _columns(trees: list[TokenTree]) -> list[pa.Array]:
    packed = [x.packed() for x in trees]
    return [pa.array([x.tokens for x in trees], pa.int64()), pa.array([x.size for x in trees], pa.int64()), *(pa.array([x[k] for x in packed], pa.binary()) for k in range(3))]


def trees(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, text_col, n_tokens, n_pieces, leaves, lengths, tokens of each row: the first version of its tree."""
    path = path or default_path()

    def run(batches):
        counts = _counts(path)
        for batch in batches:
            for b in common.pieces(batch, text_col):
                texts = common.texts(b, text_col)
                yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(texts, pa.string()), *_columns([TokenTree(x, counts) for x in texts])], names)

    names = [id_col, text_col, *(x.split()[0] for x in _TREE.split(", "))]
    kind = df.schema[id_col].dataType.simpleString()
    return common.by_arrow(df.select(id_col, text_col), run, f"`{id_col}` {kind}, `{text_col}` string, {_TREE}")


def with_edits(trees: DataFrame, edits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """trees with the column edits: those of a table with id_col, seq, start, end, new. Edits of one text follow one another, so they come together."""
    one = F.struct(F.col("seq").cast("long").alias("seq"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("new").cast("string").alias("new"))
    grouped = edits.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.sort_array(F.collect_list(one)).alias("edits"))
    return trees.join(grouped, id_col, "left")


def edited(trees: DataFrame, path: str | None = None, text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """The next version: text and tree after the edits, in their order; edits_col goes, and encoded_again (pre-tokens) comes."""
    path = path or default_path()
    fields = [f for f in trees.schema.fields if f.name not in (edits_col, "encoded_again")]
    own = [text_col, *(x.split()[0] for x in _TREE.split(", "))]

    def run(batches):
        counts = _counts(path)
        for batch in batches:
            for b in common.pieces(batch, text_col):
                done = []
                stored = (b.column(x).to_pylist() for x in (text_col, "leaves", "lengths", "tokens", edits_col))
                for text, leaves, lengths, tokens, edits in zip(*stored, strict=True):
                    tree = TokenTree.stored(text, leaves, lengths, tokens, counts)
                    for e in edits or ():
                        tree.edit(e["start"] or 0, e["end"] or 0, e["new"] or "")
                    done.append(tree)
                new = dict(zip(own, [pa.array([x.text for x in done], pa.string()), *_columns(done)], strict=True))
                yield pa.RecordBatch.from_arrays([*(new[f.name] if f.name in new else b.column(f.name) for f in fields), pa.array([x.encoded for x in done], pa.int64())], [*(f.name for f in fields), "encoded_again"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return common.by_arrow(trees, run, f"{schema}, encoded_again bigint")


def standard_edits(text: Column) -> Column:
    """Three edits: 12 characters turned round at a quarter, 8 taken out at the half, and the first 16 put in at three quarters of what is left."""
    n = F.coalesce(F.char_length(text), F.lit(0)).cast("long")
    quarter, half = F.floor(n / 4), F.floor(n / 2)
    left = n - F.least(F.lit(8), n - half)
    edit = lambda seq, start, end, new: F.struct(F.lit(seq).cast("long").alias("seq"), start.alias("start"), end.alias("end"), new.alias("new"))
    return F.array(
        edit(1, quarter, quarter + 12, F.reverse(F.substring(text, quarter.cast("int") + 1, F.lit(12)))),
        edit(2, half, half + 8, F.lit("")),
        edit(3, F.floor(3 * left / 4), F.floor(3 * left / 4), F.substring(text, 1, 16)),
    )


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = trees(common.documents(spark, sf_dir)).withColumns({"edits": standard_edits(F.col("text")), "before": F.struct("n_tokens", "n_pieces")})
    return edited(first).select("doc_id", "before.*", F.col("n_tokens").alias("edited_tokens"), F.col("n_pieces").alias("edited_pieces"), "encoded_again")
