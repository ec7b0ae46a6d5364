import json

import pytest
from pyspark.sql import functions as F
from textloom.operators import filters, merge
from textloom.plans import catalogue, catalogue_more, commands, ingest, publish
from textloom.plans.cli import options, parser
from textloom.sources import payloads, sinks

NOW = "2024-01-01T00:00:00+00:00"
NODE = {"id": "1", "shortcode": "a", "owner": {"id": "7", "username": "ann"}, "edge_media_to_caption": {"edges": [{"node": {"text": "hi #One @Bob"}}]}, "edge_liked_by": {"count": 4}, "taken_at_timestamp": 1700000000}
MEDIA = {"pk": 2, "code": "b", "user": {"pk": 8, "username": "bob"}, "caption": {"text": "x #Two"}, "media_type": 2, "like_count": 5, "taken_at": 1700000001}


def test_payloads(spark):
    feed = {"hashtag": {"edge_hashtag_to_media": {"edges": [{"node": NODE}, {}]}}, "top": {"sections": [{"layout_content": {"medias": [{"media": MEDIA}, {"media": {"pk": 1, "code": "a"}}]}}]}}
    df = spark.createDataFrame([("f", json.dumps(feed)), ("g", "broken")], "file string, payload string")
    got = {x.id: x for x in payloads.tag_items(df, "one").collect()}
    assert set(got) == {"1", "2"}
    assert (got["1"].owner.username, got["1"].likes, got["1"].hashtags, got["1"].mentions, got["1"].url) == ("ann", 4, ["#One"], ["@Bob"], "https://www.instagram.com/p/a/")
    assert (got["2"].is_video, got["2"].owner.id, got["2"].taken_at_timestamp, got["2"].source_search_hashtag) == ("true", "8", "1700000001", "one")
    profile = {"edge_owner_to_timeline_media": {"edges": [{"node": NODE}]}, "edge_felix_video_timeline": {"edges": [{"node": NODE}, {"node": NODE}]}}
    assert [x.owner.username for x in payloads.profile_items(spark.createDataFrame([(json.dumps(profile),)], "payload string"), "me").collect()] == ["me", "me"]
    html = '<script type="application/json">{"q":[{"edge_hashtag_to_media":{"edges":[]}},{"r":{"edge_hashtag_to_media": {"edges":[{"node":%s}]},"s":1}}]}</script>' % json.dumps(NODE)
    assert [x.id for x in payloads.page_items(spark.createDataFrame([(html,), ("<p>",)], "html string"), "t").collect()] == ["1"]
    page = {"comments": [{"pk": 5, "text": "hey", "user": {"username": "c"}}, {"id": "6"}], "next_max_id": "x"}
    pages = spark.createDataFrame([("p1", json.dumps(page)), ("p2", json.dumps(page))], "file string, payload string")
    assert [(x.id, x.text, x.owner.username) for x in payloads.comment_items(pages, 3).collect()][:2] == [("5", "hey", "c"), ("6", "", "")]


def test_ingest_twice_changes_nothing(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    items = [{"id": str(k), "shortcode": f"s{k}", "description": f"#t{k}", "owner": {"username": "@u"}, "likes": k, "comments": k, "source_search_hashtag": "One"} for k in range(5)]
    (tmp_path / "raw" / "hashtag_one.json").write_text(json.dumps(items))
    (tmp_path / "tags.csv").write_text("one\ntwo\n")
    (tmp_path / "c.yaml").write_text("corpora:\n  - {id: x, hashtags_file: tags.csv}\n")
    o = ingest.IngestOptions(minimums={"like_count": 2}, top_by="like_count")
    first = ingest.ingest_corpora(spark, str(tmp_path / "c.yaml"), str(tmp_path / "raw"), str(tmp_path / "out"), NOW, o=o)
    again = ingest.ingest_corpora(spark, str(tmp_path / "c.yaml"), str(tmp_path / "raw"), str(tmp_path / "out"), NOW, only="x", o=o)
    assert first["x"]["posts_added"] == 3 and again["x"]["posts_added"] == 0 and again["x"]["posts_merged"] == 3
    with pytest.raises(ValueError):
        ingest.ingest_corpora(spark, str(tmp_path / "c.yaml"), str(tmp_path / "raw"), str(tmp_path / "out"), NOW, only="y")
    store = ingest.Store(spark, str(tmp_path / "out" / "x"))
    raw = spark.createDataFrame([("c1", "2", "hello"), ("c2", "2", ""), ("", "3", "x")], "id string, post_id string, text string")
    assert ingest.ingest_comments(store, raw, NOW)["comments_added"] == 2
    assert ingest.ingest_comments(store, raw.where("id = 'c1'"), NOW)["comments_merged"] == 1
    status, pending = ingest.to_do(store, spark.createDataFrame([("ONE",), ("two",)], "tag string"))
    assert {x.tag: x.status for x in status.collect()} == {"one": "needs_comments", "two": "pending"}
    assert sorted(x.ref for x in pending.collect()) == ["https://www.instagram.com/p/s3/", "https://www.instagram.com/p/s4/"]
    assert merge.changed(store.posts, store.posts.withColumn("caption", F.when(F.col("post_id") == "2", "new").otherwise(F.col("caption"))), "post_id", "caption") == 1


def test_publish(spark, tmp_path):
    out = sinks.Outputs(spark, str(tmp_path), "x")
    out.write("nodes", spark.createDataFrame([("hashtag:a", "hashtag", "#a", 3), ("hashtag:b", "hashtag", "", 1), ("hashtag:c", "hashtag", "#c", 1)], "node_id string, node_type string, label string, post_count int"))
    out.write("edges_hashtag", spark.createDataFrame([("hashtag:a", "hashtag:b", "hashtag_cooccurrence", 2.0), ("user:u", "hashtag:b", "user_uses_hashtag_comment", 2.0)], "source string, target string, edge_type string, weight double"))
    manifest = json.loads(publish.publish([out], str(tmp_path / "web")))
    assert manifest["datasets"] == [{"corpus_id": "x", "node_count": 3, "edge_count": 1, "community_count": 2}]
    doc = json.loads(publish.web_documents([out]).first().document)
    assert {n["id"]: n["label"] for n in doc["nodes"]}["hashtag:b"] == "#b" and doc["filters"] == {"max_degree": 1, "max_weight": 2}
    with pytest.raises(ValueError):
        publish.publish([], str(tmp_path / "web"))
    sinks.save_items(spark.createDataFrame([("1", ("2", "n"), ["#a", "#b"])], "id string, owner struct<id:string,username:string>, hashtags array<string>"), str(tmp_path / "items"))
    assert spark.read.option("header", True).csv(str(tmp_path / "items.csv")).columns == ["id", "hashtags", "owner.id", "owner.username"]


def test_command_line_and_log():
    a = parser().parse_args(["--input-dir", "i", "--output-dir", "o", "--languages", "es,pt", "--n-clusters", "5"])
    assert options(a).languages == ["es", "pt"] and options(a).n_clusters == 5 and options(a).min_length == 15
    assert filters.described(5, 2, {"like_count": 3}, ["view_count"], 1.5, "like_count") == "engagement filter (like_count >= 3, > 1.5 x profile mean (view_count), by like_count): 5 -> 2 posts"
    assert sinks.corpus_of(None, "/x/output", "/y/My Corpus") == "my_corpus" and sinks.corpus_of("A b", "", "") == "a_b"


def test_entry_has_all_queries():
    import __spark_entry__

    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries()) and "all_nodes" in catalogue_more.C.QUERIES
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_every_query_gives_rows(spark, sf_dir, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    assert len(set(df.columns)) == len(df.columns)
    assert df.count() > 0 or name in ("co_actor_edges", "communities", "basket_pairs", "subgraph_min_degree", "pending_posts", "graphml", "subgraph_without_communities")


def test_oracles_agree(spark):
    """The driver compares all of them on another size; these are the quick ones."""
    import duckdb

    c = duckdb.connect()
    d = "/root/testdata/sf0.001"
    for t in "part orders lineitem events documents".split():
        c.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    for name in ("above_profile_avg", "upsert_keep_last", "tag_cooccurrence", "mention_edges", "edge_collapse_last", "sentiment_documents", "discourse_match", "language_heuristic"):
        df = catalogue.QUERIES[name](spark, d)
        want = c.sql(catalogue.ORACLE[name])
        cols = sorted(df.columns)
        assert cols == sorted(want.columns)
        assert sorted(str(tuple(x[k] for k in cols)) for x in df.collect()) == sorted(str(tuple(dict(zip(want.columns, x, strict=True))[k] for k in cols)) for x in want.fetchall())


def test_commands(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    items = [{"id": str(k), "shortcode": f"s{k}", "description": "#one #two #three", "owner": {"username": "@u"}, "likes": k, "comments": k, "source_search_hashtag": "One"} for k in range(5)]
    (tmp_path / "raw" / "hashtag_one.json").write_text(json.dumps(items))
    (tmp_path / "raw" / "hashtag_two_2024-01-01.json").write_text(json.dumps([{**items[0], "id": "9", "shortcode": "s9"}]))
    (tmp_path / "tags.csv").write_text("one,two, three\n")
    base = ["ingest", "--raw-dir", str(tmp_path / "raw"), "--output-dir", str(tmp_path / "out")]
    a = commands.parser().parse_args([*base, "--hashtag-file", str(tmp_path / "tags.csv"), "--min-likes", "2", "--top-by", "likes", "--keep-top", "2", "--repair-posts"])
    counts = commands.run_ingest(spark, a)
    assert counts["posts_added"] == 2 and counts["repaired"] == 0
    a = commands.parser().parse_args([*base, "--mode", "hashtag", "--query", "#two", "--resume"])
    assert commands.run_ingest(spark, a)["posts_merged"] == 3
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "posts.csv")).count() == 3
    with pytest.raises(ValueError):
        commands.run_ingest(spark, commands.parser().parse_args(base))
    n = spark.createDataFrame([("hashtag:a", "hashtag", "#a"), ("hashtag:b", "hashtag", "#b"), ("hashtag:c", "hashtag", "#c")], "node_id string, node_type string, label string")
    e = spark.createDataFrame([("hashtag:a", "hashtag:b", "hashtag_cooccurrence", 3.0, 0)], "source string, target string, edge_type string, weight double, ord int")
    sinks.save_graphml(n, e, str(tmp_path / "graph_hashtags_x.graphml"))
    path = commands.run_web(spark, commands.parser().parse_args(["web", "--input", str(tmp_path / "graph_hashtags_x.graphml"), "--output", str(tmp_path / "x.json"), "--min-degree", "4"]))
    doc = json.loads(spark.read.text(path).first().value)
    assert doc["corpus_id"] == "x" and doc["node_count"] == 3 and doc["community_count"] == 2 and doc["defaults"]["min_degree"] == 4
    out = sinks.Outputs(spark, str(tmp_path / "analysis" / "first"), "first")
    out.write("nodes", n)
    out.write("edges_hashtag", e)
    a = commands.parser().parse_args(["publish", "--analysis-dir", str(tmp_path / "analysis"), "--output-dir", str(tmp_path / "docs")])
    assert [x["corpus_id"] for x in json.loads(commands.run_publish(spark, a))["datasets"]] == ["first"]
    with pytest.raises(FileNotFoundError):
        commands.run_publish(spark, commands.parser().parse_args(["publish", "--analysis-dir", str(tmp_path / "none")]))
