"""Language-model scoring by prediction by partial matching (PPM) over bytes.

A text is the sequence of its tokens: words, each closed by a space, then one end symbol, after ORDER start marks. The
trie holds, for every byte of every training text, the contexts of the ORDER bytes before it and all shorter ones; contexts
run on over spaces into the words before. A longest context counts how often each byte followed; a shorter one counts in how many
contexts one byte longer it did (update exclusion). Of each count a discount goes to the escape; it is the share of an order's
nodes that were counted once, so that an order escapes as often as its own counts, each left out in turn, would have done. After an escape the next
shorter context leaves out the bytes that the longer one has seen (symbol exclusion); below the empty context all bytes
are equally likely. The model is pretrained: it doesn't change while a text is read, so a byte's probability is a function
of its window, the ORDER bytes before it and itself, and a text's score is a sum over its windows.

All counts are kept, in tables of the shared folder: they grow with the corpus. The workers get the contexts that occur most, as
many as have NODES nodes together, and the tokens with at least 1/WORDS of all. A window that meets a context
which the workers lack goes, once for all texts, to a join with the whole tables, so the score is the whole trie's
whatever NODES is; rare tokens likewise meet their counts in a join.

Defined results: a null text counts as empty and has the end token alone; without training texts every byte is equally
likely; repeated ids and equal texts give one row each; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm import common

#: Bytes of the longest context; a window is one longer and fits a long beside its order.
ORDER = 5
#: The least and the greatest discount.
DISCOUNTS = 0.05, 0.95
NODES, WORDS = 1 << 21, 1 << 20
START, END, SPACE = b"\n", b"\r", b" "
ALPHABET = 257
#: Distinct tokens, distinct windows that a task holds before it sends their counts on; places that are worked on at once.
HELD, HELD_WINDOWS, BLOCK = 300_000, 3 << 19, 1 << 19
#: Contexts go to the workers by steps of a quarter of a power of two of their counts.
STEPS = 4


def tokens(text: bytes) -> list[bytes]:
    out = text.lower().split()
    out.append(END)
    return out


def windows(texts: list[list[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows as numbers, their last byte lowest, and the number of each one's text, for a block of places at a time."""
    spelt = [START * ORDER + SPACE.join(x) for x in texts]
    ends = np.cumsum(np.fromiter(map(len, spelt), np.int64, len(spelt)))
    starts = ends - np.fromiter(map(len, spelt), np.int64, len(spelt))
    flat = np.frombuffer(b"".join(spelt), np.uint8)
    for k in range(0, len(flat), BLOCK):
        before = max(0, k - ORDER)
        part = flat[before : k + BLOCK].astype(np.int64)
        w = part.copy()
        for j in range(1, min(ORDER, len(part) - 1) + 1):
            w[j:] |= part[:-j] << (8 * j)
        place = np.arange(k, min(k + BLOCK, len(flat)))
        of = np.searchsorted(ends, place, side="right")
        coded = place - starts[of] >= ORDER
        yield w[k - before :][coded], of[coded]


def summed(w: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows, in order, with the sums of their counts (1 each if n is None)."""
    if n is None:
        w = np.sort(w)
    else:
        order = np.argsort(w, kind="stable")
        w, n = w[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1]))) if len(w) else np.zeros(0, np.int64)
    return w[first], np.diff(np.append(first, len(w))) if n is None else np.add.reduceat(n, first) if len(w) else n


def token_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """word (binary), c of the texts' tokens, as a table."""

    def run(batches):
        counts: Counter = Counter()
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "n"])
        for batch in batches:
            for b in common.pieces(batch, text_col, 4 << 20):
                for x in common.raw_texts(b, text_col):
                    counts.update(tokens(x))
                if len(counts) > HELD:
                    yield flush()
                    counts.clear()
        yield flush()

    words = common.by_arrow(texts.select(text_col), run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("c"))
    return common.written(words, "ppm-words")


def window_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """w, n of the texts' windows, summed up within a task."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        whole = lambda: summed(*map(np.concatenate, zip(*held, strict=True)))
        for batch in batches:
            for b in common.pieces(batch, text_col, BLOCK):
                for w, _ in windows(list(map(tokens, common.raw_texts(b, text_col)))):
                    held.append(summed(w))
                    if sum(len(x) for x, _ in held) > HELD_WINDOWS:
                        held = [whole()]
                        if len(held[0][0]) > HELD_WINDOWS // 4 * 3:
                            yield pa.RecordBatch.from_arrays(list(map(pa.array, held[0])), ["w", "n"])
                            held = []
        if held:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, whole())), ["w", "n"])

    return common.by_arrow(texts.select(text_col), run, "w bigint, n bigint")


def last_bytes(w: Column, n: int) -> Column:
    return w.bitwiseAND(F.lit((1 << (8 * n)) - 1))


def level(counted: DataFrame, m: int) -> DataFrame:
    """The contexts of order m, as a table, from counts n of windows w of m + 1 bytes, which may be in parts.

    context, whole and kinds (sum and number of its nodes), taken (what the next shorter context counts of its bytes), nodes (s, n). One
    shuffle, by the bytes between a window's first and last: both sums over the first and over the last stay within a partition.
    """
    if m < 3:  # few windows, of which one partition gets many
        counted = counted.groupBy("w").agg(F.sum("n").alias("n"))
    parts = counted.select(last_bytes(F.shiftright("w", 8), max(m - 1, 0)).alias("g"), F.shiftright("w", 8 * m if m else 8).alias("a"), last_bytes(F.col("w"), 1).cast("int").alias("s"), "n")
    nodes = parts.repartition("g").groupBy("g", "a", "s").agg(F.sum("n").alias("n"))
    nodes = nodes.withColumn("low", F.count("*").over(Window.partitionBy("g", "s")) if m else F.lit(0))
    contexts = nodes.groupBy("g", "a").agg(F.sum("n").alias("whole"), F.count("*").cast("int").alias("kinds"), F.sum("low").cast("long").alias("taken"), F.collect_list(F.struct("s", "n")).alias("nodes"))
    context = F.shiftleft("a", 8 * (m - 1)).bitwiseOR(F.col("g")) if m else F.lit(0).cast("long")
    return common.written(contexts.select(context.alias("context"), "whole", "kinds", "taken", "nodes"), f"ppm-{m}")


class Trie:
    """The whole trie, as a table of contexts for each order."""

    def __init__(self, counts: DataFrame) -> None:
        self.levels = {}
        for m in range(ORDER, -1, -1):
            self.levels[m] = contexts = level(counts, m)
            if m:
                counts = contexts.select(last_bytes(F.col("context"), m - 1).alias("c"), F.explode("nodes").alias("x")).select(F.shiftleft("c", 8).bitwiseOR(F.col("x.s").cast("long")).alias("w"), F.lit(1).cast("long").alias("n"))

        once = F.sum(F.size(F.filter("nodes", lambda x: x.n == 1)))
        found = {x.m: x.share for x in self.contexts().groupBy("m").agg((once / F.sum("kinds")).alias("share")).collect()}  # a number for each order
        self.discounts = [min(max(found.get(m) or 0.0, DISCOUNTS[0]), DISCOUNTS[1]) for m in range(ORDER + 1)]

    def contexts(self) -> DataFrame:
        out = None
        for m, x in self.levels.items():
            x = x.withColumn("m", F.lit(m))
            out = x if out is None else out.unionByName(x)
        return out

    def frequent(self) -> Frequent:
        """The contexts that occur most, NODES nodes at most."""
        step = F.floor(F.log2("whole") * STEPS)
        sizes = self.contexts().groupBy("m", step.alias("step")).agg(F.sum("kinds").alias("nodes")).collect()  # some hundred rows
        total, least = 0, 0
        for s in sorted({x.step for x in sizes}, reverse=True):
            total += sum(x.nodes for x in sizes if x.step == s)
            if total > NODES:
                least = s + 1
                break
        return Frequent(self.contexts().where(step >= least).select("m", "context", "taken", "nodes").toArrow(), {x.m for x in sizes if x.step < least}, self.discounts)

    def scores(self, found: DataFrame) -> DataFrame:
        """w, logp of the distinct windows in found (w)."""
        orders = range(ORDER + 1)
        here = "coalesce(get(filter(nodes, x -> x.s = s), 0).n, 0)"
        found = found.distinct().select("w", F.shiftright("w", 8).alias("context"), last_bytes(F.col("w"), 1).cast("int").alias("s"))
        top = common.written(found.join(self.levels[ORDER], "context", "left").select("w", F.expr(here).alias("n"), "whole"), "ppm-open")
        seen = top.where("n > 0").select("w", F.log10((F.col("n") - self.discounts[ORDER]) / F.col("whole")).alias("logp"))
        found = top.where("n = 0").select("w")  # these alone go on to shorter contexts
        keys = F.array(*(F.struct(F.lit(m).alias("m"), last_bytes(F.shiftright("w", 8), m).alias("context")) for m in orders))
        met = found.select("w", last_bytes(F.col("w"), 1).cast("int").alias("s"), F.inline(keys)).join(self.contexts(), ["m", "context"])
        met = met.withColumn("n", F.expr(here))
        names = [f"{x}{m}" for m in orders for x in ("n", "whole", "kinds", "taken")]
        wide = found.join(met.groupBy("w").agg(*(F.max(F.when(F.col("m") == int(x[-1]), F.col(x[:-1])).cast("double")).alias(x) for x in names)), "w", "left")

        discounts = self.discounts

        def run(batches):
            for batch in batches:
                col = {x: batch.column(x).to_numpy(zero_copy_only=False).astype(float) for x in names}  # a context that is not there: NaN
                state = State(batch.num_rows)
                for m in reversed(orders):
                    there = np.flatnonzero(~np.isnan(col[f"whole{m}"][state.left]))
                    at = state.left[there]
                    state.step(discounts[m], there, *(col[f"{x}{m}"][at] for x in ("n", "whole", "kinds", "taken")))
                yield pa.RecordBatch.from_arrays([batch.column("w"), pa.array(state.closed())], ["w", "logp"])

        return seen.unionByName(common.by_arrow(wide, run, "w bigint, logp double"))


class State:
    """Windows on their way from long contexts to short ones."""

    def __init__(self, n: int) -> None:
        self.logp, self.taken, self.kinds = np.zeros(n), np.zeros(n), np.zeros(n)
        self.left = np.arange(n)

    def step(self, discount: float, there: np.ndarray, n: np.ndarray, whole: np.ndarray, kinds: np.ndarray, taken: np.ndarray) -> None:
        """Those of left at the places there have a context of this order, with these numbers; n = 0: not this byte."""
        at = self.left[there]
        mass, new = whole - self.taken[at], kinds - self.kinds[at]
        hit = n > 0
        p = np.where(hit, n - discount, discount * new) / np.maximum(mass, 1)
        p[new <= 0] = 1  # nothing that the longer context has not seen
        self.logp[at] += np.log10(p)
        self.taken[at], self.kinds[at] = taken, kinds
        stays = np.ones(len(self.left), bool)
        stays[there[hit]] = False
        self.left = self.left[stays]

    def closed(self) -> np.ndarray:
        self.logp[self.left] -= np.log10(ALPHABET - self.kinds[self.left])
        self.left = self.left[:0]
        return self.logp


class Hashed:
    """Values of keys that are not negative, by open addressing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits)
        left, at = np.arange(len(keys)), self.place(keys)
        while len(left):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[left[free]]
            own = self.keys[at] == keys[left]
            self.values[at[own]] = values[left[own]]
            left, at = left[~own], (at[~own] + 1) & self.mask

    def place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and the places of keys that have none."""
        at = self.place(keys)
        got = self.keys[at]
        out = self.values[at]
        left = np.flatnonzero(got != keys)
        missing = [left[got[left] < 0]]
        left = left[got[left] >= 0]
        at = at[left]
        while len(left):
            at = (at + 1) & self.mask
            got = self.keys[at]
            own = got == keys[left]
            out[left[own]] = self.values[at[own]]
            missing.append(left[got < 0])
            go = ~own & (got >= 0)
            left, at = left[go], at[go]
        return out, np.concatenate(missing)


class Frequent:
    """The part of the trie that workers hold; partial names the orders of which it lacks contexts."""

    def __init__(self, contexts: pa.Table, partial: set[int], discounts: list[float]) -> None:
        self.orders, self.hashed, self.discounts = [], None, discounts
        contexts = contexts.combine_chunks()
        order, context, taken = (contexts.column(x).to_numpy().astype(np.int64) for x in ("m", "context", "taken"))
        nodes = contexts.column("nodes").combine_chunks() if len(order) else pa.array([], pa.list_(pa.struct([("s", pa.int32()), ("n", pa.int64())])))
        flat = nodes.flatten()
        sizes = np.diff(nodes.offsets.to_numpy())
        of = np.repeat(np.arange(len(order)), sizes)
        node, n = context[of] << 8 | flat.field("s").to_numpy(), flat.field("n").to_numpy()
        for m in range(ORDER + 1):
            mine, inner = np.flatnonzero(order == m), np.flatnonzero(order[of] == m)
            mine, inner = mine[np.argsort(context[mine])], inner[np.argsort(node[inner])]
            c, own, count = context[mine], node[inner], n[inner]
            first = np.searchsorted(own >> 8, c)
            whole = np.add.reduceat(count, first) if len(c) else count
            self.orders.append((m not in partial, own, count.astype(np.float64), c, whole.astype(np.float64), sizes[mine].astype(np.float64), taken[mine].astype(np.float64)))

    def score(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probabilities of windows, 0 for those that need contexts that are not here, and the places of those."""
        if self.hashed is None:
            _, own, count, c, whole, *_ = self.orders[ORDER]
            self.hashed = Hashed(own, np.log10((count - self.discounts[ORDER]) / whole[np.searchsorted(c, own >> 8)]) if len(c) else count)
            self.orders[ORDER] = (self.orders[ORDER][0], own[:0], count[:0], *self.orders[ORDER][3:])  # a byte that its longest context has is in the table
        logp, at = self.hashed(w)
        if not len(at):
            return logp, at
        distinct, again = np.unique(w[at], return_inverse=True)
        value, lacking = self.chain(distinct)
        value[lacking] = 0
        logp[at] = value[again]
        return logp, at[lacking[again]]

    def chain(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        state, lacking = State(len(w)), np.zeros(len(w), bool)
        for m in range(ORDER, -1, -1):
            complete, own, count, c, whole, kinds, taken = self.orders[m]
            x = w[state.left] & ((1 << (8 * (m + 1))) - 1)
            at = np.searchsorted(c, x >> 8)
            at[at == len(c)] = 0
            found = c[at] == x >> 8 if len(c) else np.zeros(len(x), bool)
            if not complete:
                lacking[state.left[~found]] = True
                state.left, x, at = state.left[found], x[found], at[found]
                found = np.ones(len(x), bool)
            there = np.flatnonzero(found)
            x, at = x[there], at[there]
            if len(there):
                n = np.zeros(len(x))
                if len(own):
                    node = np.minimum(np.searchsorted(own, x), len(own) - 1)
                    n = np.where(own[node] == x, count[node], 0.0)
                state.step(self.discounts[m], there, n, whole[at], kinds[at], taken[at])
        return state.closed(), lacking


class Model:
    """A trie, the counts of tokens, and what of both the workers hold."""

    def __init__(self, training: DataFrame, text_col: str = "text") -> None:
        self.counts = token_counts(training, text_col)
        n, v = self.counts.agg(F.sum("c"), F.count("*")).first()
        self.n_tokens, self.n_types = n or 0, v
        self.trie = Trie(window_counts(training, text_col))
        self.held = self.trie.frequent()
        self.most = max(1.0, self.n_tokens / WORDS)
        got = self.counts.where(F.col("c") >= self.most).toArrow()
        self.frequent = dict(zip(got.column("word").to_pylist(), got.column("c").to_pylist(), strict=True))

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.1) / (self.n_tokens + 0.1 * (self.n_types + 1)))


_PARTS = "uid bigint, n_tokens bigint, known bigint, base double, score double, words array<binary>, times array<bigint>, ws array<bigint>, wn array<bigint>"


def _lists(of: np.ndarray, rows: int, values: pa.Array) -> pa.Array:
    """A list for each row; of is in order."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(rows + 1)).astype(np.int32)), values)


def scored(df: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id with n_tokens, n_known, train_tokens, base_score and score; learns from the texts of training."""
    model = Model(training, text_col)
    base = model.base(np.fromiter(model.frequent.values(), np.float64, len(model.frequent)))
    unknown = float(model.base(np.zeros(1))[0]) if model.n_tokens else 0.0
    shipped = df.sparkSession.sparkContext.broadcast((dict(zip(model.frequent, range(len(model.frequent)), strict=True)), base, model.held))

    def run(batches):
        numbers, base, trie = shipped.value
        for batch in batches:
            for b in common.pieces(batch, text_col, BLOCK):
                texts = list(map(tokens, common.raw_texts(b, text_col)))
                n = len(texts)
                sizes = np.fromiter(map(len, texts), np.int64, n)
                every, of = list(chain.from_iterable(texts)), np.repeat(np.arange(n), sizes)
                number = np.fromiter(map(numbers.get, every, repeat(-1)), np.int64, len(every))
                rare = np.flatnonzero(number < 0)
                index = common.Index()
                word_of = np.fromiter(map(index.__getitem__, map(every.__getitem__, rare.tolist())), np.int64, len(rare))
                rare_words = list(index)
                common_of, number = of[number >= 0], number[number >= 0]
                known = np.bincount(common_of, minlength=n)
                sums = np.bincount(common_of, base[number], n).astype(float)  # without any, NumPy makes them whole numbers
                kinds = max(1, len(rare_words))
                pair, times = np.unique(of[rare] * kinds + word_of, return_counts=True)
                owner, word = np.divmod(pair, kinds)
                score, open_text, open_window, open_n = np.zeros(n), [], [], []
                for w, text in windows(texts):
                    logp, left = trie.score(w)
                    score += np.bincount(text, logp, n)
                    by = left[np.lexsort((w[left], text[left]))]
                    t, x = text[by], w[by]
                    first = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (x[1:] != x[:-1])))) if len(by) else by
                    open_text.append(t[first])
                    open_window.append(x[first])
                    open_n.append(np.diff(np.append(first, len(by))))
                t, x, c = map(np.concatenate, (open_text, open_window, open_n))
                yield pa.RecordBatch.from_arrays(
                    [b.column(id_col), b.column("uid"), *map(pa.array, (sizes, known, sums, score)),
                     _lists(owner, n, pa.array(rare_words, pa.binary()).take(pa.array(word))), _lists(owner, n, pa.array(times)), _lists(t, n, pa.array(x)), _lists(t, n, pa.array(c))],
                    names,
                )

    kind = df.schema[id_col].dataType.simpleString()
    names = [id_col, *(x.split()[0] for x in _PARTS.split(", "))]
    rows = common.written(common.by_arrow(df.select(F.monotonically_increasing_id().alias("uid"), id_col, text_col), run, f"`{id_col}` {kind}, {_PARTS}"), "ppm-rows")
    none = F.lit(0).cast("long")
    own = rows.select("uid", F.col(id_col), "n_tokens", "known", "base", "score")
    part = lambda x, known, base, score: x.select("uid", F.lit(None).cast(kind).alias(id_col), none.alias("n_tokens"), known.alias("known"), base.alias("base"), score.alias("score"))
    rare = rows.select("uid", F.explode(F.arrays_zip("words", "times")).alias("x")).select("uid", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    rare = rare.join(model.counts.where(F.col("c") < model.most), "word", "left")
    c = F.coalesce("c", F.lit(0))
    value = F.log10((c + 0.1) / F.lit(model.n_tokens + 0.1 * (model.n_types + 1))) if model.n_tokens else F.lit(unknown)
    own = own.unionByName(part(rare, F.when(F.col("c") > 0, F.col("times")).otherwise(none), F.col("times") * value, F.lit(0.0)))
    if any(not x[0] for x in model.held.orders):
        left = rows.select("uid", F.explode(F.arrays_zip("ws", "wn")).alias("x")).select("uid", F.col("x.ws").alias("w"), F.col("x.wn").alias("times"))
        left = left.join(model.trie.scores(left.select("w")), "w")
        own = own.unionByName(part(left, none, F.lit(0.0), F.col("times") * F.col("logp")))
    sums = own.groupBy("uid").agg(
        F.max(id_col).alias(id_col), F.sum("n_tokens").alias("n_tokens"), F.sum("known").alias("n_known"),
        F.lit(int(model.n_tokens)).cast("long").alias("train_tokens"), F.sum("base").alias("base_score"), F.sum("score").alias("score"),
    )
    return sums.drop("uid")


def op5_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    held_out = common.id_mod("doc_id", 10) == 0
    out = scored(docs, docs.where(~held_out))
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
