import corpus_pipeline
from textloom.llm import decontam, lang_id, simhash, toxicity
from textloom.llm.queries import QUERIES

from tests.llm.test_decontam import brute as leaks
from tests.llm.test_near_copies import brute as distinct


def test_stages_work_on_what_is_left(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_copies", "benchmark", "bpe"]
    now, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        before = now
        now = stage(spark, now, d)
        kept[name] = sorted(x.doc_id for x in now.select("doc_id").collect())
        if name == "bpe":
            break
        assert now.columns == docs.columns
        rows = [(x.doc_id, x.text) for x in before.collect()]
        if name == "toxicity":
            model = toxicity.trained(toxicity.sample(before, spark.read.parquet(f"{d}/labels.parquet")))
            want = [x.doc_id for x in toxicity.scored(before, model).where("predicted = 0").collect()]
        elif name == "language":
            want = [x.doc_id for x in lang_id.identified(before, lang_id.fitted(before)).where("lang_pred <> 'und'").collect()]
        elif name == "near_copies":
            want = distinct(sorted(rows))
            assert len(want) < len(rows)
        else:
            items = [(x.item_id, x.text) for x in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
            found = {x[0] for x in leaks(rows, items)}
            assert found
            want = [i for i, _ in rows if i not in found]
        assert kept[name] == sorted(want)
    assert kept["bpe"] == kept["benchmark"]
    assert sorted(x.doc_id for x in corpus_pipeline.run(spark, d).collect()) == kept["bpe"]


def test_every_operator_has_a_query():
    assert {name.split("_")[0] for name in QUERIES} == {f"op{n}" for n in range(1, 11)}
    assert decontam.SHINGLE == 5 and decontam.THRESHOLD == 0.8 and simhash.RADIUS == 2


def test_stages_have_defined_results_on_odd_rows(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    some = [(x.doc_id, x.text, x.lang, x.source, x.n_chars) for x in docs.limit(60).collect()]
    long_text = " ".join(f"the word {k} of a long and plain text" for k in range(20_000))
    odd = [(None, None, None, None, None), (7001, None, "en", "s", 0), (7002, "", "en", "s", 0), (7003, "?! 12", "en", "s", 5), (7004, long_text, "en", "s", None), (7004, long_text, "en", "s", None), (None, "no id but words of the text and more", "en", None, 1), some[0], some[0]]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = spark.createDataFrame(some + odd, schema).selectExpr("*", "'clash' AS label", "1 AS score", "'x' AS __n", "2 AS word").repartition(3)
    now = rows
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, d)
        if name != "bpe":
            assert now.columns == rows.columns
            now.write.parquet(str(tmp_path / name))
            now = spark.read.parquet(str(tmp_path / name))
            if name in ("toxicity",):  # null and empty texts are not toxic
                assert {None, 7001, 7002, 7003} <= {x.doc_id for x in now.collect()}
            ids = [x.doc_id for x in now.collect()]
            if name == "language":
                assert not {7001, 7002, 7003} & set(ids) and ids.count(7004) == 2
            if name in ("near_copies", "benchmark"):
                assert ids.count(7004) == 1 and ids.count(some[0][0]) <= 1
    got = now.collect()
    assert [x.doc_id for x in got].count(7004) == 1 and sorted(x.doc_id or 0 for x in got) == sorted(x or 0 for x in ids)
    # an empty table passes all stages
    now = rows.where("false")
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, d)
        assert now.count() == 0
