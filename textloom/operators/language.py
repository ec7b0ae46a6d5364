"""Language scores from keywords, mixed with those of a statistical model, and the filter on them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.text import WORD_CHAR
from textloom.functions.values import stripped


@dataclass
class LanguageRules:
    """keywords and signs by language, in the order that settles ties; a keyword counts 2, a sign its weight."""

    keywords: dict[str, list[str]]
    signs: dict[str, tuple[str, float]] = field(default_factory=dict)
    keyword_weight: float = 2.0


# The keywords and signs of the default rules, and all weights and bounds.
DEFAULT_RULES = LanguageRules(
    keywords={
        "es": "mujer mujeres hombre hombres también tambien está esta están estan niño niña niños niñas qué que porque usted ustedes señor señora violencia acoso denuncia justicia vergüenza verguenza ningún ningun algún algun había habia señal chicas".split(),
        "pt": "nao não você voce vocês voces pra pro tambem também entao então mesmo mesma gente mulher mulheres homem homens isso essa esse estao estão estamos fazer faz pq qnd tb tbm né ne la lá aqui ai aí ninguem ninguém beleza obrigad parabens parabéns denunciar policia polícia".split(),
        "en": "the and you your woman women man men dont cant really please this that with have from they what when where why how send post shot great love nice check follow profile comment comments people think about would should could been being their there these those".split(),
    },
    signs={"es": ("[ñ¿¡]", 2.0), "pt": ("[ãõâêô]", 1.5)},
)
STATISTICAL, KEYWORDS = 0.55, 0.45
STATISTICAL_LENGTH, LETTERS = 30, 10
EMOJI_SHARE, EMOJI_LENGTH, EMOJI_PENALTY = 0.35, 50, 0.6
MIN_CONFIDENCE, MIN_MARGIN, RIVAL_GUARD = 0.72, 0.12, 0.08
CUT = 400


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def _among(listed: list[str]) -> Callable[[Column], Column]:
    return lambda w: w.isin(*listed)


def keyword_shares(sample: Column, rules: LanguageRules = DEFAULT_RULES) -> Column:
    """Map of each language's share of all keyword and sign points; all 0 without any."""

    def body(words: Column) -> Column:
        points = []
        for lang, listed in rules.keywords.items():
            hits = F.size(F.filter(words, _among(listed))) * F.lit(rules.keyword_weight)
            if lang in rules.signs:
                pattern, weight = rules.signs[lang]
                hits = hits + F.regexp_count(sample, F.lit(pattern)) * F.lit(weight)
            points.append(hits)
        # bound by a lambda, since what is used twice within one is worked out twice
        return _let(F.array(*points), lambda ps: _let(sum((ps[k] for k in range(1, len(points))), ps[0]), lambda total: shares(ps, total)))

    def shares(points: Column, total: Column) -> Column:
        return F.create_map(*[x for k, lang in enumerate(rules.keywords) for x in (F.lit(lang), F.when(total == 0, 0.0).otherwise(points[k] / total))])

    every = sorted({w for listed in rules.keywords.values() for w in listed})
    found = F.filter(F.regexp_extract_all(sample, F.lit(WORD_CHAR + "+"), F.lit(0)), _among(every))
    return _let(found, body)  # of all words only the keywords are looked at language by language


def detected(text: Column, statistical: Column | None = None, rules: LanguageRules = DEFAULT_RULES, compose: bool = True) -> Column:
    """Struct of language, confidence and scores by language.

    statistical: a map of probabilities by language from any model, which counts for samples that are long enough. `emoji` is a
    text of emoji alone, `unknown` one with too few letters or no score. Ties go to the language that the rules name first.
    """
    raw = F.coalesce(text, F.lit(""))
    langs = list(rules.keywords)
    empty = F.create_map().cast("map<string,double>")

    def scored(sample: Column) -> Column:
        def mixed(shares: Column) -> Column:
            model = statistical if statistical is not None else F.lit(None).cast("map<string,double>")
            ready = F.length(sample) >= STATISTICAL_LENGTH
            damped = F.when((F.length(sample) < EMOJI_LENGTH) & (T.emoji_share(raw) > EMOJI_SHARE), EMOJI_PENALTY).otherwise(1.0)
            score = lambda x: (F.when(ready, F.coalesce(F.element_at(model, x), F.lit(0.0))).otherwise(0.0) * STATISTICAL + F.element_at(shares, x) * KEYWORDS) * damped
            return F.create_map(*[y for x in langs for y in (F.lit(x), score(F.lit(x)))])

        def ranked(scores: Column) -> Column:
            best = F.array_max(F.map_values(scores))
            winner = F.filter(F.array(*map(F.lit, langs)), lambda x: F.element_at(scores, x) == best)[0]
            none = best <= 0
            return F.struct(F.when(none, "unknown").otherwise(winner).alias("language"), F.when(none, 0.0).otherwise(F.round(best, 3)).alias("confidence"), scores.alias("scores"))

        few = F.struct(F.lit("unknown").alias("language"), F.lit(0.0).alias("confidence"), empty.alias("scores"))
        return F.when(T.letter_count(sample) < LETTERS, few).otherwise(_let(_let(keyword_shares(sample, rules), mixed), ranked))

    emoji = F.struct(F.lit("emoji").alias("language"), F.lit(1.0).alias("confidence"), F.create_map(F.lit("emoji"), F.lit(1.0)).alias("scores"))
    return F.when(T.emoji_only(raw), emoji).otherwise(_let(T.detection_text(raw, compose), scored))


def wanted_languages(value: str) -> list[str] | None:
    """A comma list; None, for all languages, if empty or `all`."""
    value = (value or "").strip().lower()
    return None if value in ("", "all") else [x.strip() for x in value.split(",") if x.strip()]


def allowed(d: Column, wanted: list[str] | None, min_confidence: float = MIN_CONFIDENCE, min_margin: float = MIN_MARGIN, keep_unknown: bool = False) -> Column:
    """Whether a detection (language, confidence, scores) passes."""
    if wanted is None:
        return F.lit(True)
    listed = [x.lower() for x in wanted]
    top = F.sort_array(F.map_values(d.scores), asc=False)
    margin = (F.size(top) < 2) | ((F.get(top, F.lit(0)) - F.get(top, F.lit(1))) >= min_margin)
    score = lambda x: F.coalesce(F.element_at(d.scores, x), F.lit(0.0))
    rival = F.lit("es" in listed) & (d.language == "es") & (score("pt") > score("es") + RIVAL_GUARD)
    known = d.language.isin(*listed) & (d.confidence >= min_confidence) & margin & ~rival
    return F.when(d.language == "unknown", keep_unknown).when(d.language == "emoji", F.lit("emoji" in listed or not listed)).otherwise(known)


def reason(d: Column, wanted: list[str] | None, min_confidence: float = MIN_CONFIDENCE, min_margin: float = MIN_MARGIN) -> Column:
    """Why a detection was turned down."""
    first = (wanted or [""])[0]
    top = F.sort_array(F.map_values(d.scores), asc=False)
    close = (F.size(top) >= 2) & ((F.get(top, F.lit(0)) - F.get(top, F.lit(1))) < min_margin)
    return F.when(d.language == "unknown", "unknown_language").when(d.language == "emoji", "emoji_only").when(~d.language.isin(*(wanted or [])), f"not_{first}").when(d.confidence < min_confidence, "low_confidence").when(close, "ambiguous_language").otherwise("language_filter")


def rendered_scores(scores: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(scores)), lambda e: F.concat(e.key, F.lit(":"), F.format_number(e.value, 3))), ";")


def judged(df: DataFrame, text_col: str = "comment_text", statistical: Column | None = None, rules: LanguageRules = DEFAULT_RULES, compose: bool = True, blank: bool = False) -> DataFrame:
    """Rows with text, with the struct `detection`; both sides of the filter come from this one frame. blank: rows without text stay too, of unknown language."""
    found = detected(F.col(text_col), statistical, rules, compose)
    # an exploded column is worked out once: neither filters nor projections above are merged with it
    rows = df if blank else df.where(stripped(F.col(text_col)) != "")
    return rows.select("*", F.explode(F.array(found)).alias("detection"))


def split(d: DataFrame, columns: list[str], wanted: list[str] | None, text_col: str = "comment_text", min_confidence: float = MIN_CONFIDENCE, min_margin: float = MIN_MARGIN, keep_unknown: bool = False) -> tuple[DataFrame, DataFrame]:
    """Judged rows (with `detection`) into kept ones, of the named columns with language and confidence, and excluded ones with the reason and their text cut.

    Both sides read d: a plan that writes both writes d first, so that detection runs once.
    """
    ok = allowed(F.col("detection"), wanted, min_confidence, min_margin, keep_unknown)
    kept = d.where(ok).select(*[c for c in columns if c not in ("language", "language_confidence")], F.col("detection.language").alias("language"), F.col("detection.confidence").alias("language_confidence"))
    ids = [c for c in ("comment_id", "post_id") if c in columns]
    out = d.where(~ok).select(*ids, F.col("detection.language").alias("language"), F.col("detection.confidence").alias("language_confidence"), rendered_scores(F.col("detection.scores")).alias("language_scores"), F.substring(text_col, 1, CUT).alias("comment_text"), reason(F.col("detection"), wanted, min_confidence, min_margin).alias("exclusion_reason"))
    return kept, out


def filtered(df: DataFrame, wanted: list[str] | None, text_col: str = "comment_text", min_confidence: float = MIN_CONFIDENCE, min_margin: float = MIN_MARGIN, keep_unknown: bool = False, statistical: Column | None = None, rules: LanguageRules = DEFAULT_RULES, compose: bool = True) -> tuple[DataFrame, DataFrame]:
    """judged and split in one."""
    return split(judged(df, text_col, statistical, rules, compose), df.columns, wanted, text_col, min_confidence, min_margin, keep_unknown)


def seed_rows(spark: SparkSession, sentences: dict[str, list[str]]) -> DataFrame:
    """text, lang of sample sentences."""
    return spark.createDataFrame([(x, lang) for lang, listed in sentences.items() for x in listed], "text string, lang string")


def self_labelled(df: DataFrame, text_col: str = "comment_text", rules: LanguageRules = DEFAULT_RULES, least: float = 2 / 3, compose: bool = True) -> DataFrame:
    """text, lang of the rows whose keywords alone name a language: long enough, and with the share `least` of all points."""
    found = df.select(F.col(text_col).alias("text"), F.explode(F.array(detected(F.col(text_col), None, rules, compose))).alias("d"))
    return found.where((F.col("d.confidence") >= least * KEYWORDS) & F.col("d.language").isin(*rules.keywords) & (F.length("text") >= STATISTICAL_LENGTH)).select("text", F.col("d.language").alias("lang"))


def trigram_model(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = 3000) -> DataFrame:
    """lang, gram, logp: the `most` most frequent letter trigrams of each language, with add-one weights."""
    grams = labelled.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.explode(_trigrams(F.col(text_col))).alias("gram"))
    counts = grams.groupBy("lang", "gram").agg(F.count("*").alias("n"))
    top = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= most)
    total = counts.groupBy("lang").agg(F.sum("n").alias("t"))
    return top.join(F.broadcast(total), "lang").select("lang", "gram", F.ln((F.col("n") + 1.0) / (F.col("t") + 2.0 * most)).alias("logp"), F.ln(1.0 / (F.col("t") + 2.0 * most)).alias("none"))


def _trigrams(c: Column) -> Column:
    # an empty match at each place, whose group looks three characters ahead
    return F.regexp_extract_all(F.concat(F.lit(" "), T.detection_text(c, compose=False), F.lit(" ")), F.lit("(?s)(?=(.{3}))"), F.lit(1))


def with_statistics(df: DataFrame, model: DataFrame, text_col: str = "text", name: str = "statistical") -> DataFrame:
    """df with a map of probabilities by language. The model has 3000 rows for each language and is broadcast, so a text's trigrams meet it where they stand and are
    summed up there: one row of sums for each text is shuffled. Equal texts are one."""
    key = F.xxhash64(text_col)
    grams = df.select(key.alias("__k"), F.explode(F.array_append(_trigrams(F.col(text_col)), F.lit(""))).alias("gram"))
    floors = dict(model.groupBy("lang").agg(F.min("none")).orderBy("lang").collect())  # a number for each language
    per = model.groupBy("gram").agg(*[F.max(F.when(F.col("lang") == x, F.col("logp"))).alias(f"__l{k}") for k, x in enumerate(floors)])
    scored = grams.join(F.broadcast(per), "gram", "left")
    times = F.count_if(F.col("gram") == "")  # the empty gram counts the rows that have this text
    sums = scored.groupBy("__k").agg(*[(F.sum(F.when(F.col("gram") != "", F.coalesce(f"__l{k}", F.lit(floor))).otherwise(0.0)) / times).alias(f"__s{k}") for k, floor in enumerate(floors.values())])
    values = F.array(*[F.col(f"__s{k}") for k in range(len(floors))])
    soft = _let(F.array_max(values), lambda top: F.transform(values, lambda v: F.exp(v - top)))
    shares = _let(soft, lambda e: _let(F.aggregate(e, F.lit(0.0), lambda t, x: t + x), lambda t: F.transform(e, lambda v: v / t)))
    named = F.map_from_arrays(F.array(*map(F.lit, floors)), shares)
    return df.withColumn("__k", key).join(sums.select("__k", named.alias(name)), "__k", "left").drop("__k")
