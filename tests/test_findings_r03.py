"""What the reviewer of round 3 found, on small inputs."""

import random
from collections import defaultdict

import numpy as np
import pytest


def _sides(spark, folder, query, **tables):
    """The rows of a query and of its SQL over a folder with the given tables."""
    import __spark_entry__ as entry

    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet/*.parquet'")
    ours = entry.queries()[query](spark, str(folder))
    columns = ", ".join(f'"{c}"' for c in ours.columns)
    theirs = con.execute(f"select {columns} from ({entry.oracle_sql()[query]})").fetchall()
    return sorted(map(tuple, ours.collect()), key=repr), sorted(theirs, key=repr)


def test_comment_flags_trims_what_its_sql_trims(spark, tmp_path):
    """a text of 15 characters with its line break counts as long, one of spaces around doesn't."""
    texts = ["!" * 14 + "\n", "!" * 14 + "\u00a0", "\t" + "." * 14, "\u3000" + "." * 15 + "\u2003", "\x85" + "?" * 14, "\u1680" + "," * 14, "abc \n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ours, theirs = _sides(spark, tmp_path, "comment_flags", documents=docs)
    assert ours == theirs and (0, "signs", False, False, True) in ours and (1, "signs", False, False, False) in ours


def test_refetched_comments_keep_lines_that_share_an_id(spark, tmp_path):
    """lines alike in order, number and part are comments of their own."""
    rows = [(1, 1, 5, "R"), (1, 1, 5, "R"), (1, 2, 5, "A"), (2, 1, 5, "A"), (2, 1, 5, "N"), (2, 1, 5, "N"), (3, 1, 6, "R"), (3, 1, 6, "N")]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string")
    ours, theirs = _sides(spark, tmp_path, "refetched_comments", lineitem=lines)
    assert ours == theirs and ours.count(("1-1-5", "new")) == 2 and ours.count(("2-1-5", "old")) == 3 and len(ours) == 6


def test_pairs_are_dealt_to_tasks_by_their_number(spark, monkeypatch):
    """ten times the pairs are ten times the tasks, not more memory in each."""
    from textloom.operators import graph

    monkeypatch.setattr(graph, "PAIRS", 10)
    monkeypatch.setattr(graph, "BLOCK", 7)
    for n in (20, 60):
        df = spark.createDataFrame([(g, m) for g in (1, 2) for m in range(n)] + [(3, 1), (3, 2), (3, 2), (4, n), (None, 1), (4, None)], "g int, m int")
        found = graph.pairs(df, "g", "m")
        got = {(x.a, x.b): x.weight for x in found.collect()}
        assert got == {(a, b): 3 if (a, b) == (1, 2) else 2 for a in range(n) for b in range(a + 1, n)}
        assert found.rdd.getNumPartitions() == -(-(n * (n - 1) + 1) // 10)


def test_last_edges_are_dealt_to_tasks_by_their_number(spark, monkeypatch):
    """F8, F9: the same for the edges of which the last counts."""
    from textloom.operators import graph, metrics

    monkeypatch.setattr(graph, "ROWS", 10)
    monkeypatch.setattr(metrics, "ROWS", 10, raising=False)
    rows = [(f"a{k}", f"b{k}", kind, float(k), ord) for k in range(50) for ord, kind in enumerate(("mention_post", "co_comment"))]
    e = spark.createDataFrame(rows, "source string, target string, edge_type string, weight double, ord int")
    last = graph.collapsed(e)
    assert last.rdd.getNumPartitions() == 10 and {(x.source, x.edge_type, x.weight) for x in last.collect()} == {(f"a{k}", "co_comment", float(k)) for k in range(50)}
    both, directed = metrics.user_graph(e)
    assert directed and both.rdd.getNumPartitions() == 20 and both.count() == 100


def test_edge_sets_of_the_whole_graph_are_made_once(spark):
    """what all, social, hashtag and user read are tables, so no pair is made for each of them anew."""
    from textloom.operators import graph

    posts = spark.createDataFrame([("1", "@p", "hi @bob", "x;y", "x")], "post_id string, profile_username string, caption string, hashtags string, source_hashtag string")
    comments = spark.createDataFrame([(p, u, "#t @eve") for p in ("1", "2") for u in ("ana", "bob")], "post_id string, author_username string, comment_text string")
    enriched = spark.createDataFrame([("ana", "p", "0")], "author_username string, profile_username string, cluster_id string")
    summary = spark.createDataFrame([("0", "Zero", 1, "a; b")], "cluster_id string, discourse_category_label string, n_comments int, top_terms string")
    made = graph.full_graph(posts, comments, enriched, summary)
    for name in ("all", "social", "hashtag", "user"):
        assert "Generate" not in made[name]._jdf.queryExecution().executedPlan().toString()
    assert {(x.source, x.target, x.weight) for x in made["social"].collect() if x.edge_type == "co_comment"} == {("user:ana", "user:bob", 2.0)}
    assert made["all"].count() == made["social"].count() + made["hashtag"].count() + made["user"].where("ord = 1").count()


def _plain_louvain(edges: list[tuple[str, str, float]], nodes: list[str] = ()) -> dict[str, int]:
    """Communities by greedy modularity moves and contraction; nodes are visited in sorted order and ties go to the smaller community, so
    the result is the same each time. Communities are numbered by size, then by their first node."""
    names = sorted({x for a, b, _ in edges for x in (a, b)} | set(nodes))
    place = {x: k for k, x in enumerate(names)}
    weight: list[dict[int, float]] = [defaultdict(float) for _ in names]
    for a, b, w in edges:
        i, j = place[a], place[b]
        weight[i][j] += w
        if i != j:
            weight[j][i] += w
    member = list(range(len(names)))
    while True:
        n = len(weight)
        strength = [sum(x.values()) + x.get(k, 0.0) for k, x in enumerate(weight)]
        total = sum(strength)
        if not total:
            break
        community, inside = np.arange(n), np.array(strength)
        rows = [(np.fromiter(row, np.int64, len(row)), np.fromiter(row.values(), np.float64, len(row))) for row in weight]
        changed, moved = False, True
        while moved:
            moved = False
            for k in range(n):
                own, size = int(community[k]), strength[k]
                near, weights = rows[k]
                inside[own] -= size
                # the communities around, in order, with the weight to each; a node is not its own neighbour
                found, at = np.unique(np.append(community[near], own), return_inverse=True)
                to = np.bincount(at, np.append(np.where(near == k, 0.0, weights), 0.0))
                gain = to - inside[found] * size / total
                top = int(gain.argmax())  # the smaller community in a tie
                mine = gain[np.searchsorted(found, own)]
                best = int(found[top]) if gain[top] > mine + 1e-12 else own
                community[k] = best
                inside[best] += size
                if best != own:
                    moved = changed = True
        if not changed:
            break
        community = community.tolist()
        number = {c: k for k, c in enumerate(sorted(set(community)))}
        smaller: list[dict[int, float]] = [defaultdict(float) for _ in number]
        for k, row in enumerate(weight):
            a = number[community[k]]
            for j, w in row.items():
                b = number[community[j]]
                if k == j or (a == b and k < j) or (a != b):
                    smaller[a][b] += w
        weight = smaller
        member = [number[community[c]] for c in member]
    groups: dict[int, list[str]] = defaultdict(list)
    for x, c in zip(names, member, strict=True):
        groups[c].append(x)
    return {x: k for k, g in enumerate(sorted(groups.values(), key=lambda g: (-len(g), g[0]))) for x in g}


@pytest.mark.parametrize("held", [8_000_000, 40])
def test_communities_by_components_are_those_of_the_whole_graph(spark, monkeypatch, held):
    """the graph falls into components, of which the large ones are held in files; no number of edges is refused."""
    from textloom.operators import metrics

    monkeypatch.setattr(metrics, "HELD", held)
    monkeypatch.setattr(metrics, "MOST_EDGES", 10)
    r = random.Random(5)
    edges = [(f"{c}{a}", f"{c}{b}", float(r.randint(1, 4))) for c, n, m in (("x", 40, 130), ("é", 25, 60), ("a", 6, 5), ("z", 30, 29)) for a, b in ((r.randrange(n), r.randrange(n)) for _ in range(m))]
    edges += [("x1", "x2", 2.0), ("x2", "x1", 1.0), ("q", "q", 3.0)]
    df = spark.createDataFrame(edges, "source string, target string, weight double")
    v = spark.createDataFrame([("lone",), ("x1",)], "node string")
    got = {x.node: x.community for x in metrics.communities(df, vertices=v).collect()}
    assert got == _plain_louvain(edges, ["lone"])
    two = df.selectExpr("*", "'one' as kind").unionByName((spark.createDataFrame([("x1", "m", 1.0, None)], "source string, target string, weight double, kind string")))
    by = {(x.graph, x.node): x.community for x in metrics.communities(two, "kind").collect()}
    assert {k: c for (g, k), c in by.items() if g == "one"} == _plain_louvain(edges) and by[(None, "x1")] == by[(None, "m")] == 0


def test_only_texts_that_composing_changes_go_to_python(spark):
    """F10 to F13, F15: a text of settled characters is composed already, whatever their order, and is never Python's."""
    import re
    import unicodedata

    from pyspark.sql import functions as F
    from textloom.functions import text as T

    ranges = [(int(a, 16), int(b, 16)) for a, b in re.findall(r"\\x\{(\w+)\}-\\x\{(\w+)\}", T.UNSETTLED.split("DFFF}")[1])]
    chars = [chr(k) for a, b in ranges for k in range(a, b + 1)]
    r = random.Random(3)
    assert len(chars) > 2000
    for _ in range(300):
        x = "".join(r.choices(chars, k=200))
        assert unicodedata.normalize("NFKC", x) == x
    texts = ["plain", "señor ß Ä 😀 “q” €", "e\u0301", "\ufb01n", "a\u00a0b", "\u1100\u1161", "ｆｕｌｌ", "\u0344", "", None, "x" * 50 + "²"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = df.select("k", T.composed(F.col("t")).alias("c"), F.col("t").rlike(T.UNSETTLED).alias("u")).orderBy("k").collect()
    assert [x.c for x in got] == [t if t is None else unicodedata.normalize("NFKC", t) for t in texts]
    assert [x.u for x in got] == [False, False, True, True, True, True, True, True, False, None, True]


def test_sign_points_are_counted_once(spark):
    """F16, F6: a language's points are worked out once for a text, not for each of the shares that they are part of."""
    from pyspark.sql import functions as F
    from textloom.operators import language

    rules = language.LanguageRules({"a": ["x"], "b": ["y"], "c": ["z"]}, {"a": ("[ñ]", 1.5), "b": ("[é]", 2.0)})
    df = spark.createDataFrame([("x y ñ é é",), ("",)], "s string").select(language.keyword_shares(F.col("s"), rules).alias("m"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("[ñ]") == 1
    assert [x.m for x in df.collect()] == [{"a": 3.5 / 9.5, "b": 6 / 9.5, "c": 0.0}, {"a": 0.0, "b": 0.0, "c": 0.0}]


def test_blank_texts_count_as_unknown_language(spark, tmp_path):
    """the SQL counts documents without text, which the filter on comments passes over."""
    texts = ["the man and the woman with the dog", "  ", "", "\n", "und die der nicht von das", "para los niños que"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ours, theirs = _sides(spark, tmp_path, "language_filter_reasons", documents=docs)
    assert ours == theirs and ("unknown_language", "unknown", 3) in ours
