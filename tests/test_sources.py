import json
import os

import pytest
from pyspark.sql import functions as F
from textloom.plans import analysis
from textloom.functions.lexicons import SentimentLexicon, Taxonomy
from textloom.sources import normalize, sinks, tables
from textloom.streaming import upsert

NOW = "2024-01-01T00:00:00+00:00"


def test_csv_round_trip(spark, tmp_path):
    rows = [('say "hi"', "a,b", "two\nlines", ""), ("", "ñ😀", " x ", None)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string")
    sinks.save_csv(df, str(tmp_path / "t.csv"))
    got = tables.read_csv(spark, str(tmp_path / "t.csv"))
    assert sorted(tuple(x) for x in got.collect()) == sorted(tuple(v or "" for v in r) for r in rows)


def test_tables_of_a_folder(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.read_tables(spark, str(tmp_path))
    sinks.save_csv(spark.createDataFrame([("1", "x")], "comment_id string, other string"), str(tmp_path / "comments.csv"))
    posts, comments = tables.read_tables(spark, str(tmp_path))
    assert posts.columns == tables.POSTS and posts.count() == 0
    assert comments.columns == tables.COMMENTS and comments.first().comment_id == "1" and comments.first().post_id == ""


ITEMS = [
    {"id": "10", "shortcode": "abc", "is_video": True, "description": "hey #One @two", "owner": {"id": "1", "username": "@Me"}, "likes": 3, "taken_at_timestamp": 1700000000, "hashtags": ["#One"], "source_search_hashtag": "#Tag"},
    {"id": "11", "type": "GraphImage", "description": "x #Y", "owner": {"username": "you"}, "taken_at_timestamp": "2024-01-01", "url": "https://www.instagram.com/reel/def/?a=1"},
]


@pytest.mark.parametrize("form", ["list", "collector", "csv"])
def test_raw_posts(spark, tmp_path, form):
    path = tmp_path / ("raw.csv" if form == "csv" else "raw.json")
    if form == "csv":
        path.write_text("id,shortcode,is_video,description,owner.username,likes,taken_at_timestamp,hashtags,source_search_hashtag,url\n10,abc,True,hey #One @two,@Me,3,1700000000,\"['#One']\",#Tag,\n11,,0,x #Y,you,,2024-01-01,,,https://www.instagram.com/reel/def/?a=1\n")
    else:
        path.write_text(json.dumps(ITEMS if form == "list" else {"collector": ITEMS}))
    got = {x.post_id: x for x in normalize.posts(tables.read_raw(spark, str(path)), "hashtags", NOW).collect()}
    a, b = got["10"], got["11"]
    assert (a.profile_username, a.hashtags, a.mentions, a.media_type, a.published_at, a.like_count, a.source_hashtag, a.post_url) == ("Me", "#One", "@two", "video", "2023-11-14T22:13:20+00:00", "3", "tag", "https://www.instagram.com/p/abc/")
    assert (b.hashtags, b.published_at, b.post_url, b.source_hashtag) == ("#Y", "2024-01-01", "https://www.instagram.com/p/def/", "")


def test_broken_and_missing_raw_files(spark, tmp_path):
    (tmp_path / "a.json").write_text("{not json")
    assert tables.read_raw(spark, str(tmp_path / "a.json")).count() == 0
    assert tables.read_raw(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "b.csv").write_text("id,shortcode\n1,x\n")
    assert tables.first_filled(spark, str(tmp_path / "a.json"), str(tmp_path / "b.csv")).first().shortcode == "x"


def test_latest_raw_file_of_each_tag(spark, tmp_path):
    for k, (name, code) in enumerate((("hashtag_One_20240101.json", "old"), ("hashtag_one_20240102.json", "new"), ("hashtag_two.json", "x"))):
        (tmp_path / name).write_text(json.dumps([{"id": "1", "shortcode": code}, {"id": "2", "shortcode": "z"}]))
        os.utime(tmp_path / name, (1000 + k, 1000 + k))
    got = tables.import_tags(spark, str(tmp_path), ["#ONE", "two"], most=1)
    assert sorted((x.tag, x.shortcode) for x in got.collect()) == [("one", "new"), ("two", "x")]
    codes = {x.id: x.shortcode for x in tables.shortcodes(tables.read_raw(spark, str(tmp_path / "*.json")) if False else tables.import_tags(spark, str(tmp_path))).collect()}
    assert codes["2"] == "z"


def test_tag_lists_and_corpora(spark, tmp_path):
    (tmp_path / "t.csv").write_text("﻿hashtag\n# remark\none,x\n two \n\none\n")
    assert [x.tag for x in tables.read_tags(spark, str(tmp_path / "t.csv")).collect()] == ["one", "two"]
    assert tables.tags_of_line('a, "b" ,c') == ["a", '"b"', "c"] or tables.tags_of_line("a,b") == ["a", "b"]
    (tmp_path / "c.yaml").write_text("corpora:\n  - {id: x, hashtags_file: t.csv}\n")
    assert tables.read_corpora(str(tmp_path / "c.yaml"))[0].tags_file == str(tmp_path / "t.csv")
    (tmp_path / "d.yaml").write_text("corpora: []\n")
    with pytest.raises(ValueError):
        tables.read_corpora(str(tmp_path / "d.yaml"))


def test_comments_feeds_and_pages(spark):
    raw = spark.createDataFrame([("1", "hi", ("9", "@ann")), ("", "no id", None)], "id string, text string, owner struct<id:string,username:string>")
    got = normalize.comments(raw, NOW, post_id="7").collect()
    assert len(got) == 1 and (got[0].post_id, got[0].author_username, got[0].comment_text) == ("7", "ann", "hi")
    a, b = spark.createDataFrame([("1", "a"), ("1", "a2")], "id string, v string"), spark.createDataFrame([("1", "b"), ("2", "c"), ("2", "d"), ("", "e")], "id string, v string")
    assert sorted(x.id for x in normalize.merged_feed(a, b).collect()) == ["1", "1", "2"]
    page = spark.createDataFrame([('<script type="application/json">{"a":1}</script><script>x</script>',)], "html string")
    assert page.select(normalize.embedded_json(F.col("html")).alias("j")).first().j == ['{"a":1}']
    row = spark.createDataFrame([([1], [1, 2, 3], None)], "a array<int>, b array<int>, c array<int>")
    assert row.select(normalize.longest([F.col(x) for x in "abc"]).alias("l")).first().l == [1, 2, 3]
    stub = normalize.post_stub(spark.createDataFrame([("https://www.instagram.com/p/abc/",)], "ref string"), "ref", "dual", NOW).first()
    assert stub.post_id == "abc" and stub.source_mode == "dual"


def test_graphml_round_trip(spark, tmp_path):
    n = spark.createDataFrame([("a", "user", 'A & "B"', 3), ("b", "user", None, None)], "node_id string, node_type string, label string, n int")
    e = spark.createDataFrame([("a", "b", "t", 1.0, 0), ("b", "a", "u", 2.5, 1)], "source string, target string, edge_type string, weight double, ord int")
    sinks.save_graphml(n, e, str(tmp_path / "g.graphml"))
    nodes, edges = tables.read_graphml(spark, str(tmp_path / "g.graphml"))
    assert {x.node_id: x.attributes for x in nodes.collect()} == {"a": {"node_type": "user", "label": 'A & "B"', "n": "3"}, "b": {"node_type": "user"}}
    assert [(x.source, x.target, x.attributes) for x in edges.collect()] == [("b", "a", {"weight": "2.5", "edge_type": "u"})]


def test_stream_upserts_and_repeats_nothing(spark, tmp_path):
    src, table = tmp_path / "in", upsert.VersionedTable(spark, str(tmp_path / "out"))
    schema = "id string, v string, o int"

    def run():
        stream = spark.readStream.schema(schema).json(str(src))
        upsert.upsert_stream(stream, table, "id", "o", str(tmp_path / "cp")).awaitTermination()
        return sorted((x.id, x.v) for x in table.read().collect())

    src.mkdir()
    (src / "1.json").write_text('{"id":"1","v":"a","o":1}\n{"id":"1","v":"b","o":2}\n{"id":"2","v":"c","o":1}\n')
    assert run() == [("1", "b"), ("2", "c")]
    (src / "2.json").write_text('{"id":"2","v":"d","o":0}\n')
    assert run() == run() == [("1", "b"), ("2", "d")]
    upsert.merge_batch(table, spark.createDataFrame([("2", "d", 0)], schema), 1, "id", "o")
    assert sorted((x.id, x.v) for x in table.read().collect()) == [("1", "b"), ("2", "d")]


def test_whole_analysis(spark, tmp_path):
    words = ["justicia mujer violencia calle miedo", "trabajo dinero salario empresa jefe"]
    comments = spark.createDataFrame([(f"c{k}", str(k % 4), f"user{k % 5}", f"La {words[k % 2]} número {k} también niña @user{k % 3} #Tag{k % 2}") for k in range(30)], "comment_id string, post_id string, author_username string, comment_text string")
    posts = spark.createDataFrame([(str(k), f"@prof{k % 2}", "Caption #Tag0 #Tag1", "#Tag0;#Tag1", "tag0", "2024-02-01") for k in range(4)], "post_id string, profile_username string, caption string, hashtags string, source_hashtag string, published_at string")
    sinks.save_tables(posts, comments, str(tmp_path / "in"))
    out = sinks.Outputs(spark, str(tmp_path / "out"), sinks.corpus_of(None, str(tmp_path / "out"), "data"))
    o = analysis.Options(languages=["es"], min_confidence=0.1, min_margin=0.05, n_clusters=2, starts=1, rounds=10, metrics=True, date_from="2024-01-01", stopwords={"es": ["la", "número"]}, sentiment=SentimentLexicon(positive={"es": ["justicia"]}, negative={"es": ["miedo"]}), taxonomy=Taxonomy.parse({"categories": [{"id": "work", "label": "Work", "terms": ["salario"]}]}))
    parts = analysis.run_all(spark, str(tmp_path / "in"), out, o)
    assert out.read("comments_enriched").count() == 30 and out.read("clusters_summary").count() == 2
    assert parts["metrics"].count() > 0 and out.read("sentiment_summary").first().n_comments == "30"
    labels = out.read("cluster_labels")
    with pytest.raises(ValueError):
        analysis.apply_labels(posts, out, o)
    filled = [r.asDict() | {"discourse_category_id": "work", "reviewed": "yes"} for r in labels.collect()[:1]]
    sinks.save_csv(spark.createDataFrame(filled, labels.schema), out.path("cluster_labels"))
    done = analysis.apply_labels(posts, out, o)
    assert {x.discourse_source for x in done["comments"].collect()} >= {"cluster"}
    assert done["posts"].count() == 4 and done["summary"].where("narrative_label = 'Work'").count() == 1
