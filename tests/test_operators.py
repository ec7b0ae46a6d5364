import math

import pytest
from pyspark.sql import functions as F
from textloom.functions.lexicons import SentimentLexicon, Taxonomy
from textloom.operators import clusters, discourse, filters, graph, language, merge, metrics, sentiment

LEXICON = SentimentLexicon(
    positive={"es": ["bien hecho", "bien", "justicia", "gracias"], "en": ["great"]},
    negative={"es": ["asco", "asco", "mal", "violencia"], "en": []},
    negators=["no", "nunca"],
    intensifiers=["muy"],
    emoji_positive=["❤"],
    emoji_negative=["😡"],
)


@pytest.mark.parametrize(
    "text,lang,want",
    [
        ("muy bien hecho", "es", ("positive", 1.0, 3.0, 0.0)),
        ("no es justicia", "es", ("negative", -1.0, 0.0, 1.0)),
        ("asco", "es", ("negative", -1.0, 0.0, 2.0)),
        ("GRACIAS AMIGOS!!", "es", ("positive", 0.176, 1.0, 0.7)),
        ("bien pero mal", "es", ("neutral", 0.0, 1.0, 1.0)),
        ("great violencia", "en", ("neutral", 0.0, 1.0, 1.0)),
        ("❤❤😡", "", ("positive", 0.333, 1.6, 0.8)),
        ("", "es", ("neutral", 0.0, 0.0, 0.0)),
        (None, None, ("neutral", 0.0, 0.0, 0.0)),
        ("también", "es", ("neutral", 0.0, 0.0, 0.0)),
    ],
)
def test_sentiment(spark, text, lang, want):
    df = spark.createDataFrame([(text, lang)], "comment_text string, language string")
    x = sentiment.with_sentiment(df, LEXICON).first()
    assert (x.sentiment_label, x.sentiment_polarity, x.sentiment_positive_score, x.sentiment_negative_score) == want


def test_sentiment_signals_and_summaries(spark):
    df = spark.createDataFrame([("no está bien, muy mal??", "es", "a"), ("nunca mal", "es", None), ("nada", "pt", "a")], "comment_text string, language string, g string")
    rows = sentiment.with_sentiment(df, LEXICON)
    signals = {x.comment_text: x.sentiment_signals for x in rows.collect()}
    assert signals["no está bien, muy mal??"] == "-negated_pos:bien;+neg:mal;+punct:??" or signals["no está bien, muy mal??"].startswith("-negated_pos:bien;")
    assert signals["nunca mal"] == "-negated_neg:mal"
    by = {x.group: x for x in sentiment.summarized(rows, "g").collect()}
    assert set(by) == {"a", None} and by["a"].n_comments == 2 and by[None].positive_pct == 100.0
    both = {(x.grouping, x.group): x.n_comments for x in sentiment.summarized_by(rows, "g", "language").collect()}
    assert both == {("all", "all"): 3, ("g", "a"): 2, ("g", None): 1, ("language", "es"): 2, ("language", "pt"): 1}
    assert sentiment.summarized(rows.where("false")).count() == 0


def test_language_ties_and_bounds(spark):
    texts = ["la mujer y la violencia", "the woman and the man really", "hola", "😀😀", "", "não você também gente boa demais"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "comment_id int, comment_text string")
    got = {x.comment_id: x for x in df.select("comment_id", language.detected(F.col("comment_text")).alias("d")).select("comment_id", "d.*").collect()}
    assert got[0].language == "es" and got[0].confidence == 0.225 and math.isclose(got[0].scores["pt"], 0.225)
    assert [got[k].language for k in (1, 2, 3, 4, 5)] == ["en", "unknown", "emoji", "unknown", "pt"]
    kept, out = language.filtered(df, ["es"], min_confidence=0.2, min_margin=0.12)
    assert kept.count() == 0
    assert {x.comment_text: x.exclusion_reason for x in out.collect()} == {texts[0]: "ambiguous_language", texts[1]: "not_es", texts[2]: "unknown_language", texts[3]: "emoji_only", texts[5]: "not_es"}
    model = F.create_map(F.lit("es"), F.lit(0.99), F.lit("pt"), F.lit(0.01))
    kept, _ = language.filtered(df.where("comment_id = 5").withColumn("comment_text", F.lit("la mujer y la violencia en la calle de la ciudad")), ["es"], min_confidence=0.65, statistical=model)
    assert kept.first().language == "es" and kept.first().language_confidence == round(0.55 * 0.99 + 0.45 / 3, 3)
    assert language.filtered(df, None)[0].count() == 5
    assert language.wanted_languages(" ES, pt ") == ["es", "pt"] and language.wanted_languages("all") is None


def test_discourse_order_and_stances(spark):
    t = Taxonomy.parse({"categories": {"b": {"priority": 2, "terms": ["uno dos"]}, "a": {"priority": 1, "terms": ["cero"]}, "feminist": {"priority": 0, "terms": ["fem"]}, "antifeminist": {"priority": 5, "terms": ["anti"]}, "neutral": {"priority": 99, "terms": ["nada"]}}})
    texts = ["fem cero", "uno dos anti", "fem anti", "fem", "anti anti", "nada", " ", None]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, comment_text string")
    got = discourse.with_discourse(df, t).orderBy("k").collect()
    assert [x.discourse_label for x in got] == ["a", "b", "mixed", "feminist", "antifeminist", "neutral", "unlabeled", "unlabeled"]
    assert got[0].discourse_signals == "+feminist:fem;+a:cero" and got[4].discourse_score_antifeminist == 1.0


def test_posts_get_their_comments_label(spark):
    posts = spark.createDataFrame([("1", "p", "t", "cero"), ("2", "p", "t", "x"), ("3", "p", "t", "")], "post_id string, profile_username string, source_hashtag string, caption string")
    c = spark.createDataFrame([("1", "z", "Z"), ("1", "z", "Z"), ("1", "y", "Y"), ("2", " ", "")], "post_id string, discourse_category_id string, discourse_category_label string")
    t = Taxonomy.parse({"categories": [{"id": "a", "terms": ["cero"]}]})
    got = {x.post_id: (x.caption_discourse_label, x.dominant_comment_category_label, x.comment_label_counts, x.n_labeled_comments, x.post_discourse_label) for x in discourse.labelled_posts(posts, c, t).collect()}
    assert got == {"1": ("a", "Z", "z:2;y:1", 3, "z"), "2": ("neutral", "", "", 0, "neutral"), "3": ("unlabeled", "", "", 0, "unlabeled")}


def test_filters(spark):
    posts = spark.createDataFrame([("1", "p", "10", "2024-12-31T23:59:59", "0"), ("2", "p", "20", "2025-01-01", "3"), ("3", "p", "30", "junk", "x"), ("4", "q", "5", "1735689599", "1")], "post_id string, profile_username string, like_count string, published_at string, comment_count string")
    c = spark.createDataFrame([("1", "a"), ("2", "b"), ("9", "c")], "post_id string, comment_id string")
    kept, cs = filters.by_dates(posts, c, date_to="2024-12-31")
    assert sorted(x.post_id for x in kept.collect()) == ["1", "4"] and [x.comment_id for x in cs.collect()] == ["a"]
    assert [x.post_id for x in filters.above_average(posts, ["like_count"]).collect()] == ["3"]
    assert sorted(x.post_id for x in filters.with_activity(posts).collect()) == ["2", "4"]
    assert [x.post_id for x in filters.engaging(posts, {"like_count": 10}, top_by="like_count", most=2).collect()] == ["3", "2"]
    with pytest.raises(ValueError):
        filters.engaging(posts, above=["nope"])
    with pytest.raises(ValueError):
        filters.date_bound("2024/01/01")
    assert filters.look_empty(spark.createDataFrame([(" ",), (None,)], "comment_text string")) and not filters.look_empty(spark.createDataFrame([], "comment_text string"))


def test_merges(spark):
    old = spark.createDataFrame([("1", "a", 1), ("2", "b", 2), ("1", "c", 3)], "post_id string, v string, o int")
    new = spark.createDataFrame([("2", "d", 1), ("3", "e", 2), ("3", "f", 5)], "post_id string, v string, o int")
    m = merge.upsert(old, new, "post_id", order_col="o")
    assert sorted((x.post_id, x.v) for x in m.collect()) == [("1", "c"), ("2", "d"), ("3", "f")]
    assert sorted((x.post_id, x.v) for x in merge.upsert(m, new, "post_id", order_col="o").collect()) == [("1", "c"), ("2", "d"), ("3", "f")]
    assert merge.merge_counts(old, new, m)["added"] == 0
    assert merge.upsert(old, new, "post_id", ["post_id", "v", "extra"]).columns == ["post_id", "v", "extra"]
    posts = spark.createDataFrame([("1", "https://x/p/ab/?q=1"), ("2", "https://cdn/x.jpg"), ("3", "https://instagram.com/tv/zz/"), ("4", "https://cdn/y")], "post_id string, post_url string")
    codes = spark.createDataFrame([("2", "code")], "id string, shortcode string")
    assert [x.post_url for x in merge.repaired_links(posts, codes).orderBy("post_id").collect()] == ["https://x/p/ab/", "https://www.instagram.com/p/code/", "https://www.instagram.com/p/zz/", "https://cdn/y"]


def edges(spark, rows):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in rows], "source string, target string, weight double")


def test_metrics_of_known_graphs(spark):
    path = edges(spark, [("a", "b", 1), ("b", "c", 1), ("c", "d", 1)])
    assert {x.node: round(x.betweenness, 6) for x in metrics.betweenness(path).collect()} == {"a": 0, "b": round(2 / 3, 6), "c": round(2 / 3, 6), "d": 0}
    star = edges(spark, [("hub", x, 1) for x in "abcd"])
    assert {x.node: x.degree for x in metrics.degrees(star).collect()} == {"hub": 4, "a": 1, "b": 1, "c": 1, "d": 1}
    v = {x.node: x.eigenvector for x in metrics.eigenvector(star).collect()}
    assert math.isclose(v["hub"], 1 / math.sqrt(2), abs_tol=1e-4) and math.isclose(v["a"], 1 / math.sqrt(8), abs_tol=1e-4)
    before = metrics.LOCAL_EDGES
    try:
        metrics.LOCAL_EDGES = 1
        w = {x.node: x.eigenvector for x in metrics.eigenvector(edges(spark, [("a", "b", 1), ("b", "c", 1)])).collect()}
    finally:
        metrics.LOCAL_EDGES = before
    assert math.isclose(w["b"], 1 / math.sqrt(2), abs_tol=1e-4)
    cliques = [(f"{s}{i}", f"{s}{j}", 1) for s in "xy" for i in range(5) for j in range(i)] + [("x0", "y0", 1)]
    found = {x.node: x.community for x in metrics.communities(edges(spark, cliques)).collect()}
    assert len({found[f"x{k}"] for k in range(5)}) == len({found[f"y{k}"] for k in range(5)}) == 1 and found["x1"] != found["y1"]
    directed = {x.node: round(x.betweenness, 6) for x in metrics.betweenness(path, directed=True).collect()}
    assert directed["b"] == round(2 / 6, 6)
    lone = spark.createDataFrame([("z",), ("a",)], "node string")
    m = {x.node: x for x in metrics.graph_metrics(path, "g", vertices=lone, with_eigenvector=True).collect()}
    assert m["z"].degree == 0 and m["z"].community == 2 and m["a"].degree == 1


def test_graph_of_posts_and_comments(spark):
    posts = spark.createDataFrame([("1", "@Pro", "hi @ana @x", "#b;A;a", "b"), ("2", "", "", "", " ")], "post_id string, profile_username string, caption string, hashtags string, source_hashtag string")
    c = spark.createDataFrame([("1", "Ana", "@ana @bob #Z #z"), ("1", "bob", "x"), ("2", "ana", ""), ("2", "@Bob", None), ("2", "meta", "y")], "post_id string, author_username string, comment_text string")
    tags = graph.tag_pairs(posts).collect()
    assert [(x.source, x.target, x.weight) for x in tags] == [("hashtag:a", "hashtag:b", 1.0)]
    assert [(x.source, x.target, x.weight) for x in graph.co_commenters(c, 2).collect()] == [("ana", "bob", 2.0)]
    assert sorted((x.source, x.target, x.edge_type) for x in graph.mention_edges(posts, c).collect()) == [("ana", "ana", "mention_comment"), ("ana", "bob", "mention_comment"), ("pro", "ana", "mention_post")]
    assert sorted((x.source, x.target) for x in graph.user_tags(posts, c).collect()) == [("profile:pro", "hashtag:a"), ("profile:pro", "hashtag:b"), ("profile:pro", "hashtag:b"), ("user:ana", "hashtag:z")]
    enriched = c.withColumns({"cluster_id": F.lit("0"), "profile_username": F.lit("Pro"), "discourse_stance": F.col("author_username")})
    summary = spark.createDataFrame([("0", "", 5, "a; b; c"), ("1", "", 2, "b;c;d")], "cluster_id string, discourse_category_label string, n_comments int, top_terms string")
    parts = graph.full_graph(posts, c, enriched, summary)
    like = parts["all"].where("edge_type = 'narrative_similarity'").first()
    assert like.weight == 0.5
    assert {x.node_type for x in parts["nodes"].collect()} == {"profile", "user", "narrative", "hashtag"}
    both = spark.createDataFrame([("a", "b", "t1", 1.0, 0), ("b", "a", "t2", 9.0, 1), ("c", "c", "t3", 2.0, 1)], "source string, target string, edge_type string, weight double, ord int")
    assert sorted((x.source, x.edge_type) for x in graph.collapsed(both).collect()) == [("b", "t2"), ("c", "t3")]
    stances = {x.label: x.discourse_stances for x in graph.user_nodes(posts, c, enriched).where("node_type = 'user'").collect()}
    assert stances["Ana"] == {"Ana": 1}


def test_subgraph_keeps_connected_nodes(spark):
    n = spark.createDataFrame([("a", 3, 0), ("b", 3, 0), ("c", 3, 1), ("d", 1, 1)], "node_id string, degree int, community int")
    e = edges(spark, [("a", "b", 5), ("b", "c", 1), ("c", "d", 9)])
    kept, ke = graph.subgraph(n, e, 2, 2)
    assert sorted(x.node_id for x in kept.collect()) == ["a", "b"] and ke.count() == 1
    assert graph.subgraph(n, e, 1, 1, hidden=[0])[0].count() == 2
    x = graph.shown(n.withColumns({"node_type": F.lit("hashtag"), "label": F.lit(" "), "post_count": F.lit(0)}).withColumn("degree", F.lit(10)).withColumn("community", F.lit(21))).first()
    assert round(x["size"], 3) == 8.818 and x.palette == 1 and x.label == "#a"


def test_cluster_counts():
    assert [clusters.cluster_count(n) for n in (4, 10, 29, 30, 199, 200)] == [2, 2, 5, 8, 8, 12]
    assert clusters.cluster_count(50, 20) == 10 and clusters.cluster_count(3, 20) == 2


def test_clusters_find_topics(spark):
    rows = [(str(k), "p", f"gato perro animal mascota {'leche' if k % 2 else 'hueso'}") for k in range(12)] + [(str(k), "q", f"coche motor rueda carretera {'gasolina' if k % 2 else 'freno'}") for k in range(12, 24)] + [("99", "q", "de la")]
    df = spark.createDataFrame(rows, "comment_id string, profile_username string, comment_text string")
    found = clusters.clustered(df, ["las", "los"], n_clusters=2, starts=2, rounds=20)
    groups = {x.comment_id: x.cluster_id for x in found.enriched.collect()}
    assert "99" not in groups and len({groups[str(k)] for k in range(12)}) == 1 and groups["0"] != groups["12"]
    s = {x.cluster_id: x for x in found.summary.collect()}
    animal = s[groups["0"]]
    assert animal.n_comments == 12 and "gato" in animal.top_terms and animal.top_profiles == "p" and animal.representative_comments.count(" || ") == 2
    with pytest.raises(ValueError):
        clusters.clustered(df.where("comment_id = '99'"), [])


def test_tfidf_weights(spark):
    df = spark.createDataFrame([(0, "uno dos dos"), (1, "uno tres"), (2, "dos tres"), (3, "tres")], "k int, t string")
    v, names = clusters.tfidf(df, "t", [], min_df=1, max_df=1.0)
    from pyspark.ml.functions import vector_to_array

    row = dict(zip(names, v.where("k = 0").select(vector_to_array("features").alias("f")).first().f, strict=True))
    idf = lambda d: math.log(5 / (d + 1)) + 1
    raw = {"uno": idf(2), "dos": (1 + math.log(2)) * idf(2), "uno dos": idf(1), "dos dos": idf(1)}
    size = math.sqrt(sum(x * x for x in raw.values()))
    assert {k: round(x, 9) for k, x in row.items() if x} == {k: round(x / size, 9) for k, x in raw.items()}
