"""Times, merges, versions, graphs and streams: what must hold whatever the session, the order of rows or a crash."""

import itertools
import os
import random
from collections import Counter

from pyspark.sql import functions as F
from textloom.functions import values as V
from textloom.operators import graph, merge, metrics
from textloom.sources import tables
from textloom.streaming import upsert


def test_times_are_utc_in_any_session(spark):
    df = spark.createDataFrame([("1700000000",), ("1700000000123",), ("2024-03-10T02:30:00+00:00",), ("0000000001",), ("99999999999999",)], "t string")
    before = spark.conf.get("spark.sql.session.timeZone")
    got = {}
    try:
        for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got[zone] = [(x.iso, str(x.at)) for x in df.select(V.iso_time(F.col("t")).alias("iso"), V.published_at(F.col("t")).alias("at")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got["UTC"] == got["America/New_York"] == got["Asia/Kolkata"]
    assert got["UTC"][0] == ("2023-11-14T22:13:20+00:00", "2023-11-14 22:13:20") == got["UTC"][1]
    assert got["UTC"][2] == ("2024-03-10T02:30:00+00:00", "2024-03-10 02:30:00") and got["UTC"][3][0] == "1970-01-01T00:00:01+00:00"


def test_upsert_keeps_the_last_by_an_order_that_is_no_column(spark):
    rows = [("a", "late", 3), ("a", "early", 1), ("b", "x", 1), ("a", "middle", 2)]
    for order in itertools.permutations(rows):
        new = spark.createDataFrame(order, "k string, v string, o int").coalesce(1)
        got = merge.upsert(new.limit(0), new, "k", ["k", "v", "w"], "o").collect()
        assert sorted(map(tuple, got)) == [("a", "late", ""), ("b", "x", "")]


def test_keep_first_and_status(spark):
    df = spark.createDataFrame([("t", 2, "later"), ("t", 1, "first"), ("u", 5, "only")], "tag string, at int, status string")
    assert {(x.tag, x.status) for x in merge.keep_first(df, "tag", F.col("at")).collect()} == {("t", "first"), ("u", "only")}
    assert {(x.tag, x.status) for x in upsert.status_table(df).collect()} == {("t", "later"), ("u", "only")}


def test_a_version_that_broke_off_does_not_count(spark, tmp_path):
    table = upsert.VersionedTable(spark, str(tmp_path / "t"))
    assert table.read() is None
    for k in range(5):
        table.replace(spark.createDataFrame([(k,)], "k int"))
    assert [x.k for x in table.read().collect()] == [4]
    names = sorted(n for n in os.listdir(tmp_path / "t") if n.startswith("v-"))
    assert names == ["v-000000000003", "v-000000000004", "v-000000000005"]
    (tmp_path / "t" / "v-000000000006").mkdir()  # a job that ended before its last word
    (tmp_path / "t" / "v-000000000006" / "part-0.parquet").write_bytes(b"half")
    assert [x.k for x in table.read().collect()] == [4]
    table.replace(spark.createDataFrame([(9,)], "k int"))
    assert [x.k for x in table.read().collect()] == [9] and not (tmp_path / "t" / "v-000000000006").exists()


def test_small_batches_are_kept_apart_and_then_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(upsert, "APART", 3)
    table, want = upsert.VersionedTable(spark, str(tmp_path / "t")), {}
    r = random.Random(3)
    for k in range(8):
        rows = [(f"k{r.randrange(6)}", f"{k}-{j}", j) for j in range(4)]
        want |= {key: v for key, v, _ in rows}
        upsert.merge_batch(table, spark.createDataFrame(rows, "id string, v string, o int"), k, "id", "o")
        if k == 4:  # a batch that comes again, and one that broke off
            upsert.merge_batch(table, spark.createDataFrame(rows, "id string, v string, o int"), k, "id", "o")
            (tmp_path / "t" / "d-000000000099").mkdir()
        assert {x.id: x.v for x in table.read().collect()} == want
    names = os.listdir(tmp_path / "t")
    assert sum(n.startswith("v-") for n in names) >= 2 and sum(n.startswith("d-") for n in names) < 9 and "d-000000000099" not in names


def test_windows_leave_out_what_is_too_late(spark, tmp_path):
    (tmp_path / "in").mkdir()
    out = str(tmp_path / "out")

    def run(name, *rows):
        (tmp_path / "in" / name).write_text("".join(f'{{"at": "{at}", "kind": "{kind}"}}\n' for at, kind in rows))
        stream = spark.readStream.schema("at timestamp, kind string").json(str(tmp_path / "in"))
        upsert.windowed_counts(stream, "at", "1 hour", "30 minutes", "kind").writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    run("1.json", ("2024-01-01 00:10:00", "a"), ("2024-01-01 00:20:00", "a"), ("2024-01-01 03:00:00", "b"))
    run("2.json", ("2024-01-01 00:30:00", "a"), ("2024-01-01 06:00:00", "b"))
    run("3.json", ("2024-01-01 09:00:00", "b"))
    got = {(str(x.window_start), x.kind): x.n for x in spark.read.parquet(out).collect()}
    assert got == {("2024-01-01 00:00:00", "a"): 2, ("2024-01-01 03:00:00", "b"): 1, ("2024-01-01 06:00:00", "b"): 1}


def test_nodes_without_an_edge_have_a_community(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0)], "source string, target string, weight double")
    v = spark.createDataFrame([("a",), ("x",), ("y",)], "node string")
    got = {x.node: x.community for x in metrics.communities(e, vertices=v).collect()}
    assert set(got) == set("abcxy") and got["a"] == got["b"] == got["c"] == 0 and {got["x"], got["y"]} == {1, 2}
    assert {x.node: x.community for x in metrics.communities(e.limit(0), vertices=v).collect()} == {"a": 0, "x": 1, "y": 2}
    assert metrics.graph_metrics(e, "t", vertices=v).where("community is null").count() == 0
    got = {x.node: x.community for x in metrics.label_propagation(e, vertices=v).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "y"}
    two = spark.createDataFrame([("p", "q", 1.0)], "source string, target string, weight double")  # labels that change places for ever
    assert {x.node: x.community for x in metrics.label_propagation(two).collect()} == {"p": "p", "q": "p"}


def test_pairs_in_blocks_are_all_pairs(spark, monkeypatch):
    r = random.Random(5)
    rows = [("hot", f"m{k}") for k in range(40)] + [(f"g{k}", f"m{r.randrange(60)}") for k in range(30) for _ in range(r.randint(1, 6))] + [(None, "m1"), ("g1", None)]
    groups = {}
    for g, m in rows:
        if g and m:
            groups.setdefault(g, set()).add(m)
    want = Counter(p for s in groups.values() for p in itertools.combinations(sorted(s), 2))
    df = spark.createDataFrame(rows, "g string, m string")
    for block in (7, 2000):
        monkeypatch.setattr(graph, "BLOCK", block)
        for least in (1, 2):
            got = {(x.a, x.b): x.weight for x in graph.pairs(df, "g", "m", least).collect()}
            assert got == {k: v for k, v in want.items() if v >= least}


def test_tag_lists(spark, tmp_path):
    for text, want in (("one, two,three", ["one", "two", "three"]), ("hashtag\none\n# remark\ntwo, rest\none\n", ["one", "two"]), ("alone\n", ["alone"])):
        (tmp_path / "t.csv").write_text(text)
        assert [x.tag for x in tables.read_tags(spark, str(tmp_path / "t.csv")).collect()] == want
