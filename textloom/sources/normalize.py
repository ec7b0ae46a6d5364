"""Raw items of any collector, as posts and comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.values import first_present, iso_time, joined_list, or_null, stripped
from textloom.sources.tables import COMMENTS, POSTS

# The site that links point to, and the names that collectors use for a column.
SITE = "https://www.instagram.com/"
_HOST = r"instagram\.com/(?:p|reel|tv)/([^/?#]+)"
POST_NAMES = {
    "post_id": ("id", "post_id", "pk", "media_id"),
    "shortcode": ("shortcode", "code", "shortCode"),
    "url": ("url", "post_url", "permalink", "link"),
    "profile": ("owner.username", "ownerUsername", "username", "profile_username"),
    "caption": ("description", "caption", "text", "edge_media_to_caption"),
    "hashtags": ("hashtags",),
    "mentions": ("mentions",),
    "media": ("type", "media_type", "is_video"),
    "time": ("taken_at_timestamp", "taken_at", "timestamp", "published_at"),
    "likes": ("likes", "like_count", "likesCount"),
    "comments": ("comments", "comment_count", "commentsCount"),
    "views": ("views", "view_count", "videoViewCount"),
    "source_tag": ("source_search_hashtag", "source_hashtag"),
}
COMMENT_NAMES = {
    "comment_id": ("id", "comment_id", "pk"),
    "parent": ("parent_comment_id", "parentId"),
    "author": ("owner.username", "ownerUsername", "username", "author_username"),
    "text": ("text", "comment_text", "comment"),
    "likes": ("likes", "like_count", "likesCount"),
    "time": ("created_at", "timestamp", "published_at"),
}


def shortcode_of(ref: Column) -> Column:
    """The code in a permalink, or else the text itself without slashes at its end."""
    code = F.regexp_extract(ref, _HOST, 1)
    return F.when(code != "", code).otherwise(F.regexp_replace(stripped(ref), "/+$", ""))


def permalink(shortcode: Column, url: Column) -> Column:
    """A link from the url's code, from the url without its query, or from the code."""
    code = F.regexp_extract(url, _HOST, 1)
    whole = F.concat(F.regexp_replace(F.split(url, r"\?")[0], "/+$", ""), F.lit("/"))
    link = lambda c: F.concat(F.lit(f"{SITE}p/"), c, F.lit("/"))
    on_site = F.contains(F.coalesce(url, F.lit("")), F.lit("instagram.com"))
    return F.when(on_site & (code != ""), link(code)).when(on_site, whole).when(F.coalesce(shortcode, F.lit("")) != "", link(shortcode)).otherwise(F.lit(""))


def post_ref(df: DataFrame) -> Column:
    """What a comment collector needs: a permalink, else an id of digits, else whatever there is."""
    url, code = stripped(F.col("post_url")), first_present(df, "shortcode")
    i = stripped(F.col("post_id"))
    made = permalink(F.coalesce(code, F.nullif(shortcode_of(url), F.lit(""))), F.when(F.contains(url, F.lit("instagram.com")), url))
    return F.coalesce(F.nullif(made, F.lit("")), F.nullif(i, F.lit("")), url)


def media_type(c: Column) -> Column:
    low = F.lower(stripped(c))
    return F.when(low.isin("true", "1"), "video").when(low.isin("false", "0"), "image").otherwise(stripped(c))


def _text(df: DataFrame, name: str) -> Column:
    return F.coalesce(first_present(df, *name), F.lit("")) if isinstance(name, tuple) else F.coalesce(first_present(df, name), F.lit(""))


def _listed(df: DataFrame, name: str, prefix: str, caption: Column) -> Column:
    """A list column, joined; else what the caption has."""
    found = F.array_join(F.regexp_extract_all(caption, F.lit(T.HASHTAG if prefix == "#" else r"@[\p{L}\p{N}_]+"), F.lit(0)), ";")
    if name not in df.columns:
        return found
    kind = df.schema[name].dataType.simpleString()
    own = F.array_join(F.filter(F.transform(name, stripped), lambda x: x != ""), ";") if kind.startswith("array") else joined_list(F.col(name), prefix)
    return F.coalesce(F.nullif(own, F.lit("")), found)


def posts(raw: DataFrame, source_mode: str, scraped_at: str, default_username: str = "", default_tag: str = "", corpus: str = "", platform: str = "instagram") -> DataFrame:
    """Raw posts in the stored form."""
    n = POST_NAMES
    caption = _text(raw, n["caption"])
    code = first_present(raw, *n["shortcode"])
    columns = {
        "platform": F.lit(platform),
        "post_id": F.coalesce(first_present(raw, *n["post_id"]), code, F.lit("")),
        "post_url": permalink(code, first_present(raw, *n["url"])),
        "profile_username": F.regexp_replace(F.coalesce(first_present(raw, *n["profile"]), F.lit(default_username)), "^@+", ""),
        "caption": caption,
        "hashtags": _listed(raw, "hashtags", "#", caption),
        "mentions": _listed(raw, "mentions", "@", caption),
        "media_type": media_type(_text(raw, n["media"])),
        "published_at": iso_time(_text(raw, n["time"])),
        "like_count": _text(raw, n["likes"]),
        "comment_count": _text(raw, n["comments"]),
        "view_count": _text(raw, n["views"]),
        "source_mode": F.lit(source_mode),
        "source_hashtag": F.lower(F.regexp_replace(F.coalesce(first_present(raw, *n["source_tag"]), F.lit(default_tag)), "^#+", "")),
        "corpus_id": F.lit(corpus),
        "scraped_at": F.lit(scraped_at),
    }
    return raw.select(*[columns[c].alias(c) for c in POSTS])


def comments(raw: DataFrame, scraped_at: str, post_id: str | None = None, corpus: str = "", platform: str = "instagram") -> DataFrame:
    """Raw comments in the stored form; those without an id are dropped."""
    n = COMMENT_NAMES
    post = F.lit(post_id) if post_id is not None else F.coalesce(first_present(raw, "post_id", "postId"), F.lit(""))
    columns = {
        "platform": F.lit(platform),
        "post_id": post,
        "comment_id": _text(raw, n["comment_id"]),
        "parent_comment_id": _text(raw, n["parent"]),
        "author_username": F.regexp_replace(_text(raw, n["author"]), "^@+", ""),
        "comment_text": _text(raw, n["text"]),
        "like_count": _text(raw, n["likes"]),
        "published_at": iso_time(_text(raw, n["time"])),
        "corpus_id": F.lit(corpus),
        "scraped_at": F.lit(scraped_at),
    }
    return raw.select(*[columns[c].alias(c) for c in COMMENTS]).where("comment_id <> ''")


def post_stub(df: DataFrame, ref_col: str, mode: str, scraped_at: str, platform: str = "instagram") -> DataFrame:
    """A post row for each reference that is all that is known of it."""
    ref = stripped(F.col(ref_col))
    known = {"platform": F.lit(platform), "post_id": shortcode_of(ref), "post_url": permalink(shortcode_of(ref), ref), "source_mode": F.lit(mode), "scraped_at": F.lit(scraped_at)}
    return df.select(*[known.get(c, F.lit("")).alias(c) for c in POSTS])


def in_corpus(df: DataFrame, corpus: str) -> DataFrame:
    return df.withColumn("corpus_id", F.lit(corpus))


def searched_by(df: DataFrame, tag: str) -> DataFrame:
    return df.withColumn("source_search_hashtag", F.lit(tag))


def merged_feed(first: DataFrame, second: DataFrame, key: str = "id") -> DataFrame:
    """All of the first feed, and what the second has besides, each id once."""
    rest = second.where(or_null(F.col(key)).isNotNull()).dropDuplicates([key]).join(first.select(key).distinct(), key, "left_anti")
    return first.unionByName(rest, allowMissingColumns=True)


def embedded_json(html: Column, kind: str = "application/json") -> Column:
    """The bodies of script elements of a type in a page."""
    return F.regexp_extract_all(html, F.lit(rf'(?is)<script[^>]*type="{kind}"[^>]*>(.*?)</script>'), F.lit(1))


def longest(lists: list[Column]) -> Column:
    """The longest of several lists; the first one in a tie, null lists count as empty."""
    rows = F.array(*[F.struct(F.coalesce(F.size(x), F.lit(-1)).alias("n"), F.lit(-k).alias("k"), x.alias("x")) for k, x in enumerate(lists)])
    return F.filter(rows, lambda r: (r.n == F.array_max(F.transform(rows, lambda q: q.n))))[0]["x"]
