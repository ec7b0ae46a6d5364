"""Which phrases of a lexicon a text has, without a user-defined function.

A phrase of one word has to stand as a whole word, one with spaces as a run of characters. Single words are found all at once by an
intersection with the text's distinct words, so the cost follows the text's length, not text times lexicon.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.text import WORD_CHAR

_ONE_WORD = re.compile(r"\w+")


def entries(phrases: list[tuple[int, str]]) -> Column:
    """(tag, phrase) pairs as an array of structs: tag, phrase, kind, pattern."""
    rows = []
    for tag, phrase in phrases:
        kind = 1 if " " in phrase else 0 if _ONE_WORD.fullmatch(phrase) else 2
        # word borders as looks around, which mean the same for any script
        edge = [f"(?<!{WORD_CHAR})" if phrase[:1].isalnum() or phrase[:1] == "_" else f"(?<={WORD_CHAR})", f"(?!{WORD_CHAR})" if phrase[-1:].isalnum() or phrase[-1:] == "_" else f"(?={WORD_CHAR})"]
        pattern = re.escape(phrase) if kind == 1 else f"(?i){edge[0]}{re.escape(phrase)}{edge[1]}"
        rows.append(F.struct(F.lit(tag).alias("tag"), F.lit(phrase).alias("phrase"), F.lit(kind).alias("kind"), F.lit(pattern).alias("pattern")))
    kind = "array<struct<tag:int,phrase:string,kind:int,pattern:string>>"
    return F.array(*rows).cast(kind) if rows else F.array().cast(kind)


def words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(WORD_CHAR + "+"), F.lit(0)))


def matched(text: Column, phrases: Column, distinct_words: Column, single: list[str]) -> Column:
    """The entries that the text has, in their order and with their repeats; single: the one-word phrases among them."""
    hits = F.array_intersect(distinct_words, F.array(*map(F.lit, sorted(set(single)))).cast("array<string>"))

    def among(found: Column) -> Column:
        return F.filter(phrases, lambda e: F.when(e.kind == 0, F.array_contains(found, e.phrase)).when(e.kind == 1, F.contains(text, e.phrase)).otherwise(F.regexp_like(text, e.pattern)))

    return F.transform(F.array(hits), among)[0]  # the intersection is made once, not for each phrase


def single_words(phrases: list[tuple[int, str]]) -> list[str]:
    return [p for _, p in phrases if _ONE_WORD.fullmatch(p)]


def last_words_before(text: Column, entry: Column, n: int) -> Column:
    """The last n tokens before an entry's first place in a text with single spaces between its tokens, as plain_text gives it."""
    at = F.when(entry.kind == 1, F.position(entry.phrase, text)).otherwise(F.regexp_instr(text, entry.pattern))
    return F.split(F.substring_index(F.rtrim(F.substr(text, F.lit(1), at - 1)), " ", -n), " ")


def any_of_last(tokens: Column, n: int, listed: list[str]) -> Column:
    """Whether one of the last n tokens is listed."""
    last = F.slice(tokens, F.greatest(F.size(tokens) - (n - 1), F.lit(1)), F.lit(n))
    return F.arrays_overlap(last, F.array(*map(F.lit, listed)).cast("array<string>"))
