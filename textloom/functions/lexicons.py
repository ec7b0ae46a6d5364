"""Word lists and lexicons. They are data: each operator takes them as a parameter, and loaders read the usual files."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

LANGUAGES = ("es", "pt", "en")


@dataclass
class SentimentLexicon:
    """positive and negative: phrases by language, with repeats, which count twice."""

    positive: dict[str, list[str]] = field(default_factory=dict)
    negative: dict[str, list[str]] = field(default_factory=dict)
    negators: list[str] = field(default_factory=list)
    intensifiers: list[str] = field(default_factory=list)
    emoji_positive: list[str] = field(default_factory=list)
    emoji_negative: list[str] = field(default_factory=list)
    fallback: str = "es"

    @classmethod
    def load(cls, path: str | Path) -> SentimentLexicon:
        """A missing file gives an empty lexicon."""
        if not Path(path).exists():
            return cls()
        data = json.loads(Path(path).read_text(encoding="utf-8"))
        return cls(**{k: data[k] for k in ("positive", "negative", "negators", "intensifiers", "emoji_positive", "emoji_negative") if k in data})

    def phrases(self, language: str) -> list[tuple[int, str]]:
        """(1 or -1, phrase) of a language, then those that only the fallback has."""
        out = []
        for sign, bucket in ((1, self.positive), (-1, self.negative)):
            own, more = bucket.get(language, []), bucket.get(self.fallback, [])
            out += [(sign, p) for p in own] + [(sign, p) for p in more if p not in own]
        return out


@dataclass
class Category:
    id: str
    label: str
    priority: int = 50
    terms: list[str] = field(default_factory=list)
    description: str = ""


def _plain(term: str) -> str:
    import re
    import unicodedata

    return " ".join(re.sub(r"https?://\S+|www\.\S+", " ", unicodedata.normalize("NFKC", str(term).strip().lower())).split())


@dataclass
class Taxonomy:
    """Categories in the order in which they are tried."""

    categories: list[Category] = field(default_factory=list)
    version: int = 1

    @classmethod
    def parse(cls, data: dict, legacy_order: tuple[str, ...] = ()) -> Taxonomy:
        """From a dict with `categories`, as list or as dict by id, or from the older form with three word lists."""
        raw = data.get("categories")
        if raw is None:
            legit = data.get("legitimization", {})
            raw = [{"id": x, "priority": k + 1, "terms": legit.get(x, [])} for k, x in enumerate(legacy_order or tuple(legit))]
            raw += [{"id": x, "priority": p, "terms": data.get(x, [])} for x, p in (("feminist", 20), ("antifeminist", 21), ("neutral", 99))]
        if isinstance(raw, dict):
            raw = [{"id": k, **v} if isinstance(v, dict) else {"id": k, "label": str(v)} for k, v in raw.items()]
        out = []
        for item in raw:
            if i := str(item.get("id", "")).strip():
                terms = [_plain(t) for t in item.get("terms", []) if str(t).strip()]
                out.append(Category(i, str(item.get("label", i)), int(item.get("priority", 50)), terms, str(item.get("description", ""))))
        return cls(sorted(out, key=lambda c: (c.priority, c.id)), data.get("version", 1))

    @classmethod
    def load(cls, path: str | Path) -> Taxonomy:
        return cls.parse(json.loads(Path(path).read_text(encoding="utf-8")))

    def with_terms(self, extra: dict[str, list[str]]) -> Taxonomy:
        """The same with more terms, each once, after its category's own."""
        out = []
        for c in self.categories:
            terms = list(c.terms)
            for t in map(_plain, extra.get(c.id, [])):
                if t and t not in terms:
                    terms.append(t)
            out.append(Category(c.id, c.label, c.priority, terms, c.description))
        return Taxonomy(out, self.version)

    def json(self, indent: int | None = None) -> str:
        body = {"version": self.version, "source": "discourse_taxonomy", "categories": [vars(c) for c in self.categories]}
        return json.dumps(body, ensure_ascii=False, indent=indent)

    def save(self, path: str | Path) -> None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(self.json(2), encoding="utf-8")

    def label(self, i: str) -> str:
        return next((c.label for c in self.categories if c.id == i), i)


def load_stopwords(path: str | Path) -> dict[str, list[str]]:
    """JSON of word lists by language; the key `all` is added to each. Single letters are left out."""
    data = json.loads(Path(path).read_text(encoding="utf-8"))
    more = data.pop("all", [])
    return {k: sorted({w for w in [*v, *more] if len(w) > 1}) for k, v in data.items()}


def stopwords_for(lists: dict[str, list[str]], language: str = "") -> list[str]:
    """A language's list; for unknown ones the union of all."""
    return lists[language] if language in lists else sorted({w for v in lists.values() for w in v})
