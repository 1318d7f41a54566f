"""Text: tokens, normal forms, scores, formatting."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels that say the subject isn't visible.
NOT_VISIBLE = r"(?i)^\s*(none|n/?a|other|not visible|no \w+)\s*\.?\s*$"

#: Words of a scan target that name no subject.
KEY_NOISE = (
    "the", "a", "an", "of", "in", "on", "is", "are", "its", "their", "and", "or", "main", "person", "persons", "current", "state", "wearing", "worn",
    "color", "colour", "style", "garment", "e", "g", "eg", "frame", "visible",
)


def tokens(text: Column) -> Column:
    """Distinct words ``[a-z0-9']+`` of lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9']+)"), F.lit(1)))


def query_tokens(query: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"[a-z0-9']+", query.lower())))


def resolve_category(category: str) -> tuple[list[str], str]:
    """Words of a category, each with its form without trailing s, and how they were resolved."""
    forms = [form for w in re.findall(r"[a-z0-9']+", category.lower()) for form in (w, w.rstrip("s")) if form]
    return list(dict.fromkeys(forms)), "plural-strip"


def collapsed(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def overlap_score(text: Column, query: list[str]) -> Column:
    """Share of the query's words that the text has."""
    if not query:
        return F.lit(0.0)
    words = F.array(*[F.lit(w) for w in query])
    return F.size(F.array_intersect(tokens(text), words)) / F.lit(float(len(query)))


def squeezed(text: Column) -> Column:
    """Lower case, runs of white space as one space, ends trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def state(text: Column) -> Column:
    """A state label's normal form."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9 ]", ""))


def is_visible(text: Column) -> Column:
    return ~text.rlike(NOT_VISIBLE)


def canonical_key(target: Column) -> Column:
    """Identity of a scan target: sorted words without plural s and noise, or a hash where none is left."""
    bare = F.transform(F.split(F.trim(F.regexp_replace(F.lower(target), "[^a-z0-9]+", " ")), " "), lambda w: F.regexp_replace(w, "s+$", ""))
    words = F.array_sort(F.array_distinct(bare))
    noise = F.array(*[F.lit(w) for w in sorted({n.rstrip("s") for n in KEY_NOISE} | {""})])
    key = F.array_join(F.array_except(words, noise), "-")
    return F.when(key != "", key).otherwise(F.concat(F.lit("t"), F.substring(F.sha1(F.array_join(words, " ")), 1, 12)))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two word arrays; null where both are empty."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)).cast("double"), F.lit(0.0))


def snippet(text: Column, limit: int = 50) -> Column:
    """Text on one line, cut to at most limit characters and back to a space, with an ellipsis where cut."""
    flat = F.replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", ""), F.lit("\n"), F.lit(" "))
    cut = F.regexp_replace(F.regexp_replace(F.substring(flat, 1, limit), " [^ ]*$", ""), r"(?U)\s+$", "")
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(cut, F.lit("…")))


def slug(title: Column) -> Column:
    """Words of a title in a path, 32 characters at most; ``video`` where there are none."""
    words = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.coalesce(F.nullif(F.regexp_replace(F.substring(words, 1, 32), "-$", ""), F.lit("")), F.lit("video"))


def key16(source_key: Column) -> Column:
    """First sixteen characters of a key after its scheme, up to the first colon; ``unknown`` where there are none."""
    bare = F.regexp_replace(F.regexp_replace(source_key, "(?s)^[^:]*:", ""), "[^A-Za-z0-9_-]", "")
    return F.coalesce(F.nullif(F.substring(bare, 1, 16), F.lit("")), F.lit("unknown"))


def minutes(seconds: Column) -> Column:
    """``m:ss``."""
    whole = F.floor(seconds).cast("bigint")
    return F.format_string("%d:%02d", F.floor(whole / 60), whole % 60)


def deep_link(source_type: Column, source_key: Column, source_uri: Column, seconds: Column) -> Column:
    link = F.concat(F.lit("https://www.youtube.com/watch?v="), source_key, F.lit("&t="), F.floor(seconds).cast("string"), F.lit("s"))
    return F.when(source_type == "youtube", link).otherwise(F.concat(F.lit("["), minutes(seconds), F.lit(" @ "), source_uri, F.lit("]")))


# How answers begin, and what says that evidence doesn't suffice.
NEGATIVE = r"^\s*(no|nope|not|none|negative|false)\b"
POSITIVE = r"^\s*(yes|yeah|yep|correct|true|sure)\b"
INSUFFICIENT = (
    r"insufficien|not enough|cannot (be )?(determin|count|tell|confirm|verif)"
    r"|can't (determine|tell|count)|unable to|no (relevant )?evidence"
    r"|unclear from|unknown"
)


def verdict(answer: Column) -> Column:
    """Yes, no or unsure, by the word that a verifier's answer begins with."""
    return F.when(answer.rlike(f"(?i){NEGATIVE}"), "no").when(answer.rlike(f"(?i){POSITIVE}"), "yes").otherwise("unsure")


def insufficient(answer: Column) -> Column:
    """Whether an answer says that the evidence doesn't suffice."""
    return F.coalesce(answer.rlike(f"(?i){INSUFFICIENT}"), F.lit(False))


def first_json_object(text: str | None) -> dict | None:
    """The first balanced object in a text without its code fences, braces counted without regard to strings; null if it doesn't parse."""
    text = re.sub(r"```(?:json)?", "", text or "")
    start = text.find("{")
    depth = 0
    for at in range(start, len(text)) if start >= 0 else ():
        depth += {"{": 1, "}": -1}.get(text[at], 0)
        if depth == 0:
            try:
                return json.loads(text[start : at + 1])
            except ValueError:
                return None
    return None


def fingerprint(role: str, settings: dict) -> str:
    """Identity of what shapes a role's output."""
    return hashlib.sha1(json.dumps({"role": role, "settings": settings}, sort_keys=True, default=str).encode()).hexdigest()[:16]
