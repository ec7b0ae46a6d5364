"""The analysis as it runs when nothing but the folders is named."""

from textloom.functions import defaults
from textloom.operators import language
from textloom.plans import analysis, cli
from textloom.sources import sinks
from textloom.sources.tables import exists

SPANISH = [
    "Las mujeres de este pueblo siempre han luchado por la justicia y nadie las escuchó cuando denuncia tras denuncia pedían ayuda",
    "Los hombres también pueden hablar de la violencia que viven los niños en la escuela y en la calle, qué tristeza",
    "Está bien que la gente diga la verdad porque el acoso no es normal y las niñas merecen crecer sin miedo",
    "Ningún señor puede decirle a una mujer cómo vestirse, porque usted no manda en la vida de los demás",
]
OTHER = [
    "The women of this town have always fought for justice and nobody listened when they asked for help from the police",
    "What a great post, please check out this shot and follow the profile, people should think about their comments",
    "As mulheres desta cidade sempre lutaram pela justiça e ninguém ouviu quando elas pediram ajuda para a polícia, não é",
    "Você não pode falar isso pra gente porque também existem homens que sofrem, né, mesmo que ninguém veja",
]


def _input(spark, folder):
    rows = [(f"c{k}", str(k % 3), f"user{k % 5}", f"{text} {k}") for k, text in enumerate((SPANISH * 6) + (OTHER * 3))]
    comments = spark.createDataFrame([*rows, ("e", "1", "u", "😀😀"), ("b", "1", "u", " ")], "comment_id string, post_id string, author_username string, comment_text string")
    posts = spark.createDataFrame([(str(k), f"@prof{k}", "Caption #Tag0 #Tag1", "#Tag0;#Tag1", "tag0", "2024-02-01") for k in range(3)], "post_id string, profile_username string, caption string, hashtags string, source_hashtag string, published_at string")
    sinks.save_tables(posts, comments, folder)


def test_a_clear_sentence_passes_with_the_default_bounds(spark):
    df = spark.createDataFrame([(str(k), x) for k, x in enumerate(SPANISH + OTHER)], "comment_id string, comment_text string")
    kept, out = analysis.by_language(df, analysis.Options(languages=["es"]))
    assert sorted(x.comment_id for x in kept.collect()) == ["0", "1", "2", "3"]
    assert {x.exclusion_reason for x in out.collect()} == {"not_es"} and all(x.confidence > 0.72 for x in kept.selectExpr("language_confidence as confidence").collect())


def test_the_model_looks_at_so_many_comments_at_most(spark):
    rows = [(str(k), f"{SPANISH[k % 4]} {k}") for k in range(400)]
    df = spark.createDataFrame(rows, "comment_id string, comment_text string")
    few, whole = (analysis.language_model(df, analysis.Options(model_rows=n)) for n in (40, 500))
    n = [x.groupBy("lang").agg({"none": "min"}).where("lang = 'es'").first()[1] for x in (few, whole)]
    assert n[0] > n[1]  # less text was counted
    kept, _ = analysis.by_language(df, analysis.Options(languages=["es"], model_rows=40))
    assert kept.count() == 400


def test_the_whole_run_keeps_and_clusters_the_wanted_language(spark, tmp_path):
    _input(spark, str(tmp_path / "in"))
    out = sinks.Outputs(spark, str(tmp_path / "out"), "x")
    analysis.run_all(spark, str(tmp_path / "in"), out, analysis.Options(languages=["es"]))
    rows = out.read("comments_enriched").collect()
    assert len(rows) == 24 and {x.language for x in rows} == {"es"} and {x.sentiment_label for x in rows} >= {"negative"}
    assert all(not set(x.text_for_cluster.split()) & set(defaults.STOPWORDS["es"]) for x in rows)
    assert out.read("comments_clustered").count() == 24 and out.read("sentiment_summary").first().n_comments == "24"
    assert {x.exclusion_reason for x in out.read("exclusion_summary").collect()} >= {"not_es"} and out.read("language_summary").first()["count"] == "24"
    for name in ("graph", "graph_hashtags", "graph_users"):
        assert exists(spark, out.path(name, "graphml"))
    assert exists(spark, out.path("discourse_taxonomy", "json")) and out.read("cluster_labels").count() == out.read("clusters_summary").count()


def test_steps_build_on_what_is_stored(spark, tmp_path):
    _input(spark, str(tmp_path / "in"))
    out = sinks.Outputs(spark, str(tmp_path / "out"), "x")
    o = cli.options(cli.parser().parse_args(["--n-clusters", "3", "--overwrite-discourse-templates"]))
    o.starts, o.rounds = 2, 20
    for step in ("lang", "prep", "cluster", "graph", "discourse-init"):
        cli.run_step(spark, step, str(tmp_path / "in"), out, o)
    assert out.read("comments_for_analysis").count() == 24 and out.read("comments_enriched").count() == 24
    assert out.read("clusters_summary").count() == 3 and out.read("cluster_labels").count() == 3 and out.read("nodes").count() > 10
    labels = [r.asDict() | {"discourse_category_id": "work", "reviewed": "yes"} for r in out.read("cluster_labels").collect()]
    sinks.save_csv(spark.createDataFrame(labels), out.path("cluster_labels"))
    o.taxonomy = o.taxonomy.parse({"categories": [{"id": "work", "label": "Work", "terms": ["salario"]}]})
    cli.run_step(spark, "discourse-apply", str(tmp_path / "in"), out, o)
    assert {x.discourse_category_id for x in out.read("comments_discourse").collect()} == {"work"}
    assert out.read("nodes").where("node_id = 'narrative:Work'").count() == 1
    assert cli.main(["--step", "graph", "--input-dir", str(tmp_path / "none"), "--output-dir", str(tmp_path / "out2")]) == 1


def test_equal_texts_have_the_same_statistics_once(spark):
    model = language.trigram_model(language.seed_rows(spark, defaults.SENTENCES))
    rows = [(1, SPANISH[0]), (2, SPANISH[0]), (3, SPANISH[0]), (4, OTHER[0]), (5, None), (6, "")]
    df = spark.createDataFrame(rows, "id int, text string")
    got = {x.id: x.statistical for x in language.with_statistics(df, model).collect()}
    alone = language.with_statistics(df.where("id = 1"), model).first().statistical
    assert got[1] == got[2] == got[3] and all(abs(got[1][k] - alone[k]) < 1e-9 for k in alone) and got[1]["es"] > 0.99 and got[4]["en"] > 0.99 and len(got) == 6
