import random

import public_tokenizers
import pytest
import regex
from textloom.llm import token_tree


@pytest.fixture(scope="module")
def counts():
    return token_tree.Counts(token_tree.default_path())


def whole(text, counts):
    pieces = regex.findall(public_tokenizers.PATTERN, text)
    return sum(len(counts.encode(p)) for p in pieces), len(pieces)


@pytest.mark.parametrize("seed", range(6))
def test_edits_give_what_a_full_count_gives(counts, seed):
    r = random.Random(seed)
    letters = ["a", "the", " ", "  ", "\n", "\t ", "'s", "'", "l", "1", "23", "é", "ß", "!", "?!", "😀", "²", "́", " ", "don't", "<|endoftext|>"]
    some = lambda n: "".join(r.choices(letters, k=n))
    for _ in range(60):
        tree = token_tree.TokenTree(some(r.choice([0, 1, 5, 400, 1500])), counts)
        for _ in range(12):
            n = len(tree.text)
            a = r.randint(0, n + 2)
            b = a + r.choice([0, 0, 1, 3, 50, n])
            new = some(r.choice([0, 1, 2, 8, 300]))
            want = tree.text[: min(a, n)] + new + tree.text[min(max(b, a), n) :]
            tree.edit(a, b, new)
            assert tree.text == want
            assert (tree.tokens, tree.size) == whole(want, counts)
            assert sum(tree.sums[1][:1]) == len(want)


def test_small_edits_touch_little(counts):
    tree = token_tree.TokenTree("one two three four five " * 5000, counts)
    tree.edit(60_000, 60_003, "zzz")
    assert tree.encoded <= 8


def test_edits_renew_the_sums_above_them_alone(counts, monkeypatch):
    tree = token_tree.TokenTree("one two three four five " * 5000, counts)
    monkeypatch.setattr(tree, "_build", None)
    n = len(tree.leaves)
    tree.edit(60_000, 63_000, "zzz " * 300)  # over several leaves
    tree.edit(50, 60_100, "")  # empties leaves
    tree.edit(55, 56, "a b")
    tree.edit(52, 52, "q")
    assert len(tree.leaves) == n and (tree.tokens, tree.size) == whole(tree.text, counts)


def test_stored_trees_take_edits_of_a_table(spark, counts, tmp_path):
    texts = [(1, "Hello world, it's me. " * 90), (2, None), (3, ""), (4, "untouched"), (4, "untouched"), (None, "x " * 20_000)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in texts], "doc_id bigint, text string, tokens string")
    edits = [(1, 2, 5, 5, "abc"), (1, 1, 0, 6, "Bye"), (2, 1, 0, 0, "now there"), (3, 1, 7, 9, "end"), (4, 1, 1, None, None), (9, 1, 0, 0, "no such row"), (None, 1, 0, 0, "no id")]
    table = spark.createDataFrame(edits, "doc_id bigint, seq int, start int, end int, new string")
    versions = [str(tmp_path / f"v{k}") for k in range(3)]
    token_tree.trees(df).write.parquet(versions[0])
    for a, b in zip(versions, versions[1:], strict=False):
        token_tree.edited(token_tree.with_edits(spark.read.parquet(a), table)).write.parquet(b)

    def plain(i, text):
        for _, _, start, end, new in sorted((e for e in edits if e[0] == i and i is not None), key=lambda e: e[1]):
            start = min(start, len(text))
            text = text[:start] + (new or "") + text[max(start, min(end or 0, len(text))) :]
        return text

    want = [(i, t or "") for i, t in texts]
    for path in versions:
        rows = spark.read.parquet(path).collect()
        assert sorted((x.doc_id or 0, x.text) for x in rows) == sorted((i or 0, t) for i, t in want)
        assert all((x.n_tokens, x.n_pieces) == whole(x.text, counts) for x in rows)
        assert path == versions[0] or max(x.encoded_again for x in rows) < 30 and {x.encoded_again for x in rows if x.doc_id is None} == {0}
        want = [(i, plain(i, t)) for i, t in want]
    assert token_tree.edited(token_tree.with_edits(token_tree.trees(df.where("false")), table)).count() == 0


def test_rows(spark, counts, tmp_path):
    texts = [(1, "Hello world, it's me."), (2, None), (3, ""), (1, "Hello world, it's me."), (None, "x " * 20_000), (5, "ab"), (6, "é😀 " * 50)]
    spark.createDataFrame([(i, t, "clash") for i, t in texts], "doc_id bigint, text string, n_tokens string").write.parquet(str(tmp_path / "documents.parquet"))
    got = token_tree.op1_token_counts(spark, str(tmp_path)).collect()
    want = []
    for i, t in texts:
        t = t or ""
        n = len(t)
        new = t[: n // 4] + t[n // 4 : n // 4 + 12][::-1] + t[n // 4 + 12 :]
        new = new[: n // 2] + new[n // 2 + 8 :]
        at = 3 * len(new) // 4
        new = new[:at] + t[:16] + new[at:]
        want.append((i or 0, *whole(t, counts), *whole(new, counts)))
    assert sorted((x.doc_id or 0, x.n_tokens, x.n_pieces, x.edited_tokens, x.edited_pieces) for x in got) == sorted(want)
