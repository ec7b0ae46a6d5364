import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from textloom.functions import text as T
from textloom.functions import values as V

CASES = ["", "   ", None, "Hola #Tag_1 y #ÉXITO con @user.name y @x", "visita https://a.b/c?d=1 ya", "www.x.y zzz", "aaaaab bbbb!!!!", "😀😀", "😀 123 !!", "😀 a", "123", "!!", "Send me this post please", "ＦＵＬＬ ｗｉｄｔｈ ﬁ", "ñandú ¿qué?", "a b　c", "line\nbreak\ttab", "https://only.link"]


def rows(spark, texts, **columns):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [r for r in df.select("k", *[c.alias(n) for n, c in columns.items()]).orderBy("k").collect()]


EMOJI = re.compile("[\U0001f300-\U0001faff\U00002600-\U000027bf\U0001f1e0-\U0001f1ff\U0000fe00-\U0000fe0f\U0000200d]+")


def normalized(t):
    t = unicodedata.normalize("NFKC", (t or "").strip().lower())
    for p in (r"https?://\S+|www\.\S+", r"@([A-Za-z0-9._]{2,30})", r"#\w+"):
        t = re.sub(p, " ", t)
    t = re.sub(r"(.)\1{3,}", r"\1\1", EMOJI.sub(" ", t))
    return re.sub(r"\s+", " ", t).strip()


def test_normalized_text(spark):
    got = rows(spark, CASES, n=T.normalized(F.col("t")))
    assert [x.n for x in got] == [normalized(t) for t in CASES]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.sampled_from("ab AB#@._éñ1!\n😀aaaa"), max_size=25), min_size=1, max_size=30))
def test_any_text_is_normalized_like_the_plain_form(spark, texts):
    got = rows(spark, texts, n=T.normalized(F.col("t")), h=T.hashtags(F.col("t")), m=T.mentions(F.col("t")))
    assert [x.n for x in got] == [normalized(t) for t in texts]
    assert [x.h for x in got] == [";".join(sorted(set(re.findall(r"#\w+", t)))) for t in texts]
    assert [x.m for x in got] == [";".join(sorted({m.lower() for m in re.findall(r"@([A-Za-z0-9._]{2,30})", t)})) for t in texts]


def test_flags(spark):
    got = rows(spark, CASES, e=T.emoji_only(F.col("t")), s=T.spam(F.col("t")))
    assert {CASES[x.k] for x in got if x.e} == {"😀😀", "😀 123 !!"}
    assert {CASES[x.k] for x in got if x.s} == {"Send me this post please"}


def test_tokens_and_usable(spark):
    texts = ["The quick brown fox 123 jumps", "the the 12345 cat", "x" * 20, "Great please see these three good words"]
    got = rows(spark, texts, t=T.tokens(F.col("t"), ["the"]), u=T.usable(F.col("t"), ["the"]))
    assert [x.t for x in got] == [["quick", "brown", "fox", "jumps"], ["cat"], ["xx"] if len("xx") > 2 else [], ["great", "please", "see", "these", "three", "good", "words"]]
    assert [x.u for x in got] == [True, False, False, False]


@pytest.mark.parametrize("value,want", [("12", 12.0), (" 3.5 ", 3.5), ("1d", 0.0), ("abc", 0.0), ("", 0.0), (None, 0.0), ("-4", -4.0), ("1e3", 1000.0)])
def test_numbers(spark, value, want):
    assert rows(spark, [value], n=V.number(F.col("t")))[0].n == want
    assert rows(spark, [value], n=V.count_value(F.col("t")))[0].n == max(int(want), 0)


def test_times(spark):
    texts = ["1700000000", "1700000000123", "2024-01-02T03:04:05+02:00", "2024-01-02T03:04:05Z", "2024-01-02", "junk", "", None]
    got = rows(spark, texts, i=V.iso_time(F.col("t")), p=V.published_at(F.col("t")))
    assert [x.i for x in got] == ["2023-11-14T22:13:20+00:00"] * 2 + texts[2:6] + ["", ""]
    assert [str(x.p) for x in got] == ["2023-11-14 22:13:20"] * 2 + ["2024-01-02 03:04:05"] * 2 + ["2024-01-02 00:00:00", "None", "None", "None"]


def test_lists_and_names(spark):
    got = rows(spark, ["['a', 'b']", "a,b", "see #x and #y", "#x,#y", "", "[broken"], j=V.joined_list(F.col("t"), "#"))
    assert [x.j for x in got] == ["a;b", "", "#x;#y", "#x;#y", "", ""]
    got = rows(spark, ["#B; a ;#a;;##C"], t=V.split_tags(F.col("t")))
    assert got[0].t == ["a", "b", "c"]
    got = rows(spark, ["@User.X", " y ", None], u=V.user_name(F.col("t")))
    assert [x.u for x in got] == ["user.x", "y", ""]
