"""Lexicon sentiment and its summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.lexicons import LANGUAGES, SentimentLexicon
from textloom.functions.values import number, stripped
from textloom.operators import phrases as P

# Weights and bounds of the score.
NEUTRAL, INTENSIFIED, EMOJI_WEIGHT = 0.15, 1.5, 0.8
NEGATION_WINDOW, INTENSIFIER_WINDOW, SIGNALS = 4, 2, 25
EXCLAIMED, QUESTIONED, SHOUTED = 0.3, 0.2, 0.4
CASED = "a-zA-ZáéíóúüñÁÉÍÓÚÜÑ"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def _lexicon_hits(text: Column, language: Column, lexicon: SentimentLexicon, languages: tuple[str, ...]) -> Column:
    """Signed weights and signals of the phrases that the text has, for its language or else the fallback."""
    distinct = P.words(text)
    code = F.split(F.lower(F.coalesce(language, F.lit(""))), "-")[0]
    out = None
    for lang in languages:
        listed = lexicon.phrases(lang)
        found = P.matched(text, P.entries(listed), distinct, P.single_words(listed))
        out = F.when(code == lang, found) if out is None else out.when(code == lang, found)
    listed = lexicon.phrases(lexicon.fallback)
    found = P.matched(text, P.entries(listed), distinct, P.single_words(listed))
    found = found if out is None else out.otherwise(found)

    def weighed(e: Column) -> Column:
        def body(before: Column) -> Column:
            weight = F.when(P.any_of_last(before, INTENSIFIER_WINDOW, lexicon.intensifiers), INTENSIFIED).otherwise(1.0)
            negated = P.any_of_last(before, NEGATION_WINDOW, lexicon.negators)
            name = F.when(e.tag > 0, F.lit("pos:")).otherwise(F.lit("neg:"))
            signal = F.concat(F.when(negated, F.lit("-negated_")).otherwise(F.lit("+")), name, e.phrase)
            return F.struct((F.when(negated, -e.tag).otherwise(e.tag) * weight).alias("w"), signal.alias("s"))

        return _let(P.last_words_before(text, e, max(NEGATION_WINDOW, INTENSIFIER_WINDOW)), body)

    return F.transform(found, weighed)


def _emoji_hits(raw: Column, lexicon: SentimentLexicon) -> Column:
    rows = [F.struct(F.lit(sign).alias("sign"), F.lit(e).alias("e")) for sign, es in ((1.0, lexicon.emoji_positive), (-1.0, lexicon.emoji_negative)) for e in es]
    if not rows:
        return F.array().cast("array<struct<w:double,s:string>>")
    size = lambda x: F.length(x)

    def counted(x: Column) -> Column:
        n = ((size(raw) - size(F.replace(raw, x.e, F.lit("")))) / size(x.e)).cast("int")
        name = F.when(x.sign > 0, F.lit("+emoji_pos:")).otherwise(F.lit("+emoji_neg:"))
        return F.struct((n * x.sign * EMOJI_WEIGHT).alias("w"), F.concat(name, x.e, F.lit("x"), n.cast("string")).alias("s"))

    return F.filter(F.transform(F.array(*rows), counted), lambda h: h.w != 0)


def _sign_hits(raw: Column) -> Column:
    # taking out long runs and counting what is gone is far quicker than taking out all between them
    letters = F.length(raw) - F.length(F.regexp_replace(raw, f"[{CASED}]+", ""))
    upper = F.regexp_count(raw, F.lit("[A-ZÁÉÍÓÚÜÑ]"))
    shouted = _let(letters, lambda n: (n >= 8) & (upper > 0.6 * n))
    rules = [(raw.rlike("!{2,}"), EXCLAIMED, "+punct:!!"), (raw.rlike(r"\?{2,}"), QUESTIONED, "+punct:??"), (shouted, SHOUTED, "+punct:caps")]
    return F.filter(F.array(*[F.when(rule, F.struct(F.lit(-w).alias("w"), F.lit(s).alias("s"))) for rule, w, s in rules]), lambda h: h.isNotNull())


def sentiment(text: Column, language: Column, lexicon: SentimentLexicon, languages: tuple[str, ...] = LANGUAGES, compose: bool = True) -> Column:
    """Struct of label, polarity, positive, negative and signals. Blank text is neutral; of text with nothing but emoji only they count."""
    raw = F.coalesce(text, F.lit(""))

    def total(hits: Column) -> Column:
        sums = lambda sign: F.aggregate(hits, F.lit(0.0), lambda a, h: a + F.greatest(F.lit(0.0), h.w * sign))
        return F.struct(sums(1.0).alias("pos"), sums(-1.0).alias("neg"), F.array_join(F.slice(F.transform(hits, lambda h: h.s), 1, SIGNALS), ";").alias("signals"))

    def labelled(t: Column) -> Column:
        whole = t.pos + t.neg
        polarity = F.when(whole == 0, 0.0).otherwise((t.pos - t.neg) / whole)
        label = F.when(polarity > NEUTRAL, "positive").when(polarity < -NEUTRAL, "negative").otherwise("neutral")
        return F.struct(label.alias("label"), F.round(polarity, 3).alias("polarity"), F.round(t.pos, 3).alias("positive"), F.round(t.neg, 3).alias("negative"), t.signals.alias("signals"))

    emoji = _emoji_hits(raw, lexicon)
    plain = T.plain_text(raw, compose)
    hits = _let(plain, lambda p: F.concat(_lexicon_hits(p, language, lexicon, languages), emoji, _sign_hits(raw)))
    hits = F.when(T.emoji_only(raw), emoji).otherwise(hits)
    return _let(_let(hits, total), labelled)


def with_sentiment(df: DataFrame, lexicon: SentimentLexicon, text_col: str = "comment_text", language_col: str = "language", languages: tuple[str, ...] = LANGUAGES, compose: bool = True) -> DataFrame:
    """df with the five sentiment columns."""
    language = F.col(language_col) if language_col in df.columns else F.lit("")
    names = {"label": "sentiment_label", "polarity": "sentiment_polarity", "positive": "sentiment_positive_score", "negative": "sentiment_negative_score", "signals": "sentiment_signals"}
    out = df.select("*", F.explode(F.array(sentiment(F.col(text_col), language, lexicon, languages, compose))).alias("__s"))
    return out.select(*[c for c in df.columns if c not in names.values()], *[F.col(f"__s.{k}").alias(v) for k, v in names.items()])


def _summary() -> list[Column]:
    n = F.count("*")
    of = {x: F.count_if(F.col("sentiment_label") == x) for x in ("positive", "negative", "neutral")}
    polarity = F.avg(number(F.col("sentiment_polarity")))
    return [
        n.alias("n_comments"),
        *[c.alias(x) for x, c in of.items()],
        *[F.round(100.0 * c / n, 1).alias(f"{x}_pct") for x, c in of.items()],
        F.round(polarity, 3).alias("mean_polarity"),
        F.round((of["positive"] + of["negative"]) / n, 3).alias("polarization_index"),
    ]


def summarized(df: DataFrame, group_col: str | None = None) -> DataFrame:
    """Counts, shares, mean polarity and polarization of each group, a null one too, as `group`; None: of all, if there is any."""
    if group_col is None:
        return df.agg(*_summary()).where("n_comments > 0").select(F.lit("all").alias("group"), "*")
    return df.groupBy(F.col(group_col).cast("string").alias("group")).agg(*_summary())


def summarized_by(df: DataFrame, *group_cols: str) -> DataFrame:
    """The summaries of all rows and of each column's groups in one pass, with `grouping`, the column's name or `all`."""
    keys = list(group_cols)
    sets = df.groupingSets([[], *[[k] for k in keys]], *keys).agg(*_summary(), F.grouping_id().alias("__g"))
    full, n = (1 << len(keys)) - 1, len(keys)
    group, name = F.lit("all"), F.lit("all")
    for k, key in enumerate(keys):
        mine = F.col("__g") == full - (1 << (n - 1 - k))
        group, name = F.when(mine, F.col(key).cast("string")).otherwise(group), F.when(mine, F.lit(key)).otherwise(name)
    return sets.select(name.alias("grouping"), group.alias("group"), *[c for c in sets.columns if c not in (*keys, "__g")])


def with_cluster_sentiment(summary: DataFrame, by_cluster: DataFrame) -> DataFrame:
    """A cluster summary with its clusters' shares, mean polarity and polarization; clusters are matched as text."""
    mine = by_cluster.select(stripped(F.col("group")).alias("__id"), *[F.col(f"{x}_pct").alias(f"sentiment_{x}_pct") for x in ("positive", "negative", "neutral")], "mean_polarity", "polarization_index")
    return summary.join(mine, stripped(summary["cluster_id"]) == mine["__id"], "left").drop("__id")
