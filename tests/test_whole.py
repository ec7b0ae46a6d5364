"""Queries that run their operators whole."""

import math
import re
from collections import Counter

import pytest
from textloom.operators import clusters
from textloom.plans import catalogue
from textloom.plans import standins as S

from tests.test_text import normalized


def test_narrative_clusters_run_with_the_values_of_the_operator(spark, sf_dir, monkeypatch):
    seen = {}

    def clustered(df, stopwords, n_clusters=None, features=clusters.FEATURES, starts=clusters.STARTS, rounds=clusters.ROUNDS, **more):
        seen.update(features=features, starts=starts, rounds=rounds, rows=df.count())
        return clusters.Clustering(df, df, n_clusters)

    monkeypatch.setattr(clusters, "clustered", clustered)
    catalogue.QUERIES["narrative_clusters"](spark, sf_dir)
    assert seen == {"features": 8000, "starts": 10, "rounds": 300, "rows": spark.read.parquet(f"{sf_dir}/conversations.parquet").count()}


def test_texts_and_turns_with_signs_and_runs_are_normalized_whole(spark, tmp_path):
    texts = ["Hola @user.name sooooo good #Tag_1 words", "plain words here", "aaaa ---- ====", "ＦＵＬＬ ｗｉｄｔｈ 😀 12345", "", None, "ÉXITO! 9999 niñoooos"]
    spark.createDataFrame([(k, 0, "user", x) for k, x in enumerate(texts)], "conv_id bigint, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plain = {x.doc_id: x.plain for x in catalogue.QUERIES["text_normalized"](spark, str(tmp_path)).collect()}
    assert plain == {k: normalized(x) for k, x in enumerate(texts)}
    got = {x.conv_id: (x.n_tokens, x.tokens) for x in catalogue.QUERIES["text_tokens"](spark, str(tmp_path)).collect()}
    want = {}
    for k, x in enumerate(texts):
        words = [w for w in re.findall(r"\w{3,}", re.sub(r"[^\w\s]", " ", normalized(x))) if not w.isdecimal() and w not in S.STOPWORDS]
        want[k] = (len(words), " ".join(sorted(set(words))))
    assert got == want


def test_tfidf_takes_texts_with_accents_and_digits_whole(spark, tmp_path):
    texts = ["Façade über 2024 façade", "über 2024 straße", "plain façade words", "plain words_2 über", "été 2024", ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plain = [re.findall(r"\w{3,}", x.lower().translate(str.maketrans(*clusters._ACCENTS))) for x in texts]
    plain = [[w for w in x if w not in S.STOPWORDS] for x in plain]
    tf = [Counter(x + [" ".join(p) for p in zip(x, x[1:], strict=False)]) for x in plain]
    df = Counter(t for x in tf for t in x)
    want = {}
    for k, x in enumerate(tf):
        raw = {t: (1 + math.log(c)) * (math.log((len(texts) + 1) / (df[t] + 1)) + 1) for t, c in x.items() if 2 <= df[t] <= 0.85 * len(texts)}
        size = math.sqrt(sum(v * v for v in raw.values()))
        want |= {(k, t): v / size for t, v in raw.items()}
    got = {(x.doc_id, x.term): x.weight for x in catalogue.QUERIES["tfidf_weights"](spark, str(tmp_path)).collect()}
    assert (0, "facade") in want and (4, "2024") in want
    assert got == pytest.approx(want, abs=1e-6)  # six places are shown
