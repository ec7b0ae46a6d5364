"""Text preparation as Column expressions, with explicit Unicode classes so that other engines read the patterns alike."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textloom.functions.values import SPACE, stripped

# The patterns that results depend on.
WORD_CHAR = r"[\p{L}\p{N}_]"
URL = r"https?://\S+|www\.\S+"
HASHTAG = r"#[\p{L}\p{N}_]+"
MENTION = r"@([A-Za-z0-9._]{2,30})"
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F1E0}-\x{1F1FF}\x{FE00}-\x{FE0F}\x{200D}]"
LETTER = r"[a-zA-ZáéíóúüñãõâêôçÁÉÍÓÚÜÑÃÕÂÊÔÇ]"
SPAM = ("send me this post", "please send me", "this shot is really", "great please", "check out my profile", "follow for follow", "dm me", "link in bio")
RESERVED_NAMES = ("instagram", "facebook", "meta", "threads")


@F.arrow_udf(StringType())
def nfkc(texts: pa.Array) -> pa.Array:
    """Unicode compatibility composition, which Spark has no function for. Few texts at a time are Python's."""
    few = [texts.slice(k, 256).to_pylist() for k in range(0, len(texts), 256)]
    return pa.concat_arrays([pa.array([], pa.string())] + [pa.array([x if x is None or x.isascii() else unicodedata.normalize("NFKC", x) for x in each], pa.string()) for each in few])


def _settled() -> str:
    """Characters, as ranges of a class, that composition leaves as they are whatever stands around them: of common alphabets, signs and emoji."""
    out, last = [], -2
    for low, high in ((0, 0x300), (0x370, 0x530), (0x2010, 0x2028), (0x20A0, 0x20C0), (0x2190, 0x2200), (0x2600, 0x27C0), (0x1F300, 0x1FB00)):
        for k in range(low, high):
            if unicodedata.normalize("NFKC", chr(k)) == chr(k) and not unicodedata.combining(chr(k)):
                if k == last + 1:
                    out[-1][1] = k
                else:
                    out.append([k, k])
                last = k
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in out)


#: A character for whose sake a text is composed; texts without one don't go to Python. Most are told by the first half; half of a pair, which a search may stop at, is none.
UNSETTLED = f"[\\x{{80}}-\\x{{10FFFF}}&&[^\\x{{D800}}-\\x{{DFFF}}{_settled()}]]"


def composed(c: Column) -> Column:
    return F.coalesce(nfkc(F.when(c.rlike(UNSETTLED), c)), c)


def collapsed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def _composed(c: Column, compose: bool) -> Column:
    return composed(c) if compose else c


def plain_text(c: Column, compose: bool = True) -> Column:
    """For lexicons: lower-case, composed, without links, spaces collapsed; emoji, @ and # stay."""
    return collapsed(F.regexp_replace(_composed(F.lower(stripped(c)), compose), URL, " "))


def normalized(c: Column, compose: bool = True) -> Column:
    """For topics: as plain_text, but also without mentions, hashtags and emoji, and runs of over three characters cut to two."""
    out = _composed(F.lower(stripped(c)), compose)
    for pattern in (URL, MENTION, HASHTAG, EMOJI + "+"):
        out = F.regexp_replace(out, pattern, " ")
    return collapsed(F.regexp_replace(out, r"(.)\1{3,}", "$1$1"))


def tokens(c: Column, stopwords: Column | list[str], compose: bool = True) -> Column:
    """Words of three characters or more of the normalised text, without stopwords and numbers."""
    words = F.regexp_extract_all(F.regexp_replace(normalized(c, compose), r"[^\p{L}\p{N}_\s]", " "), F.lit(r"[\p{L}\p{N}_]{3,}"), F.lit(0))
    stop = F.array(*map(F.lit, stopwords)) if isinstance(stopwords, list) else stopwords
    kept = F.filter(words, lambda w: ~w.rlike(r"^\p{Nd}+$"))
    if isinstance(stopwords, list) and not stopwords:
        return kept
    return F.filter(kept, lambda w: ~F.array_contains(stop, w))


def hashtags(c: Column) -> Column:
    """Distinct hashtags with their case and sign, sorted, parted by semicolons."""
    return F.array_join(F.array_sort(F.array_distinct(all_hashtags(c))), ";")


def all_hashtags(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(HASHTAG), F.lit(0))


def mentions(c: Column) -> Column:
    """Distinct mentions in lower case, sorted, parted by semicolons."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(all_mentions(c), F.lower))), ";")


def all_mentions(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(MENTION), F.lit(1))


def valid_mentions(c: Column) -> Column:
    """Mentions in lower case that can be user names, repeats included."""
    return F.filter(F.transform(all_mentions(c), F.lower), valid_name)


def valid_name(c: Column) -> Column:
    return c.rlike(r"^[a-z0-9._]{2,}$") & ~c.isin(*RESERVED_NAMES)


def emoji_only(c: Column) -> Column:
    """An emoji, and no letter or digit-like sign besides white space, digits and punctuation."""
    raw = stripped(c)
    rest = F.regexp_replace(F.regexp_replace(raw, EMOJI + "+", ""), r"[\s\d_]|[^\p{L}\p{N}_]", "")
    return (raw != "") & ~raw.rlike(LETTER) & (rest == "") & raw.rlike(EMOJI)


def spam(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike("(?i)(" + "|".join(SPAM) + ")")


def usable(c: Column, stopwords: list[str], min_length: int = 15, compose: bool = True) -> Column:
    """Neither emoji alone nor spam, long enough, and with three words that say something."""
    return ~emoji_only(c) & ~spam(c) & (F.length(normalized(c, compose)) >= min_length) & (F.size(tokens(c, stopwords, compose)) >= 3)


def detection_text(c: Column, compose: bool = True) -> Column:
    """For language detection: without emoji, links, mentions, hashtags and signs, lower-case."""
    out = _composed(F.coalesce(c, F.lit("")), compose)
    for pattern in (EMOJI + "+", URL, r"@[\p{L}\p{N}_]+", HASHTAG, r"[^\p{L}\p{N}_]+"):  # the last takes signs and space alike
        out = F.regexp_replace(out, pattern, " ")
    return F.lower(F.trim(out))


def letter_count(c: Column) -> Column:
    return F.length(c) - F.length(F.regexp_replace(c, LETTER + "+", ""))  # quicker than taking out all between the letters


def emoji_share(c: Column) -> Column:
    raw = F.coalesce(c, F.lit(""))
    found = F.length(raw) - F.length(F.regexp_replace(raw, EMOJI + "+", ""))
    size = F.length(stripped(raw))
    return F.when(size == 0, F.lit(0.0)).otherwise(found / size)
