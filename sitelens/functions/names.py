"""Names: tokens, similarity, search scores, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say nothing about which site is meant.
STOP_WORDS = ["golf", "course", "links", "the", "club", "national", "of", "de", "do", "da"]


def tokens(text: Column) -> Column:
    """Distinct lower-case words of letters and digits, without stop words."""
    words = F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", " "), " ")
    return F.array_except(words, F.array(*[F.lit(w) for w in ["", *STOP_WORDS]]))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two names' tokens, 0 if either has none."""
    x, y = tokens(a), tokens(b)
    both, any_ = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), both / any_).otherwise(0.0)


def search_score(query: str, club: Column, course: Column, gps: Column, holes: Column, distance: Column) -> Column:
    """A hit's score: 4 and 3 if the club's and the course's name hold the query, 0.8 and 0.6 for each word of it that they hold,
    0.5 for GPS, 0.3 for 9 or 18 holes, and up to 2 for a small distance."""
    q = query.strip().lower()
    low = {4.0: F.lower(club), 3.0: F.lower(course)}
    score = F.lit(0.0)
    for points, name in low.items():
        if q:
            score = score + F.when(name.contains(q), points).otherwise(0.0)
    for word in q.split():
        for points, name in zip((0.8, 0.6), low.values(), strict=True):
            score = score + F.when(name.contains(word), points).otherwise(0.0)
    score = score + F.when(gps, 0.5).otherwise(0.0) + F.when(holes.isin(9, 18), 0.3).otherwise(0.0)
    return score + F.coalesce(F.greatest(F.lit(0.0), F.lit(2.0) - distance / 5.0), F.lit(0.0))


def full_name(club: Column, course: Column) -> Column:
    """Club and course joined by a dash; one of them where the club's name says it all."""
    a, b = F.trim(F.coalesce(club, F.lit(""))), F.trim(F.coalesce(course, F.lit("")))
    said = (b == "") | F.lower(a).contains(F.lower(b))
    return F.when(said, F.when(a != "", a).otherwise(b)).otherwise(F.concat(a, F.lit(" — "), b))


def safe_id(text: Column) -> Column:
    """At most 80 characters of letters, digits and ._-, runs of others as one _, none at the ends; unknown if nothing is left."""
    clean = F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")
    return F.when(F.coalesce(clean, F.lit("")) == "", "unknown").otherwise(F.substring(clean, 1, 80))


# Kinds of points of interest by their codes and by their names; the first name that a text holds decides.
KIND_CODES = {"1": "green", "2": "bunker", "3": "bunker", "4": "water", "5": "dogleg", "6": "tree", "9": "tree", "11": "fairway", "12": "tee"}
KIND_NAMES = {
    "green": "green",
    "greens": "green",
    "pin": "pin",
    "flag": "pin",
    "flagstick": "pin",
    "tee": "tee",
    "tees": "tee",
    "teebox": "tee",
    "tee box": "tee",
    "fairway": "fairway",
    "bunker": "bunker",
    "sand": "bunker",
    "water": "water",
    "hazard": "water",
    "dogleg": "dogleg",
    "tree": "tree",
    "trees": "tree",
    "wood": "tree",
    "woods": "tree",
}


def point_kind(raw: Column) -> Column:
    """Kind of a point by its code or name, poi if unknown."""
    text = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    exact = F.create_map(*[F.lit(x) for kv in (KIND_CODES | KIND_NAMES).items() for x in kv])
    out = F.when(text == "", "poi").when(F.try_element_at(exact, text).isNotNull(), F.try_element_at(exact, text))
    for name, kind in KIND_NAMES.items():
        out = out.when(text.contains(name), kind)
    return out.otherwise("poi")


def hole_number(text: Column) -> Column:
    """The number that a text's digits form, where it is 1 to 27, else NULL."""
    number = F.regexp_replace(text, "[^0-9]", "").try_cast("long")
    return F.when(number.between(1, 27), number.cast("int"))


def params_key(path: str, **params: Column) -> Column:
    """The first 24 hex digits of SHA-256 over path?key=value&..., keys sorted, values URL-encoded."""
    joined = F.concat_ws("&", *[F.concat(F.lit(f"{k}="), F.url_encode(v.cast("string"))) for k, v in sorted(params.items())])
    return F.substring(F.sha2(F.concat(F.lit(path + "?"), joined), 256), 1, 24)


def bucket(key: Column) -> Column:
    """A number from 0 to 1 by the first 32 bits of the key's SHA-1."""
    return F.conv(F.substring(F.sha1(key), 1, 8), 16, 10).cast("double") / F.lit(float(0xFFFFFFFF))


def split(kind: Column, key: Column, val: float = 0.15) -> Column:
    """val for the share val of kind:key, train for the others; the same at every run."""
    return F.when(bucket(F.concat_ws(":", kind, key.cast("string"))) < val, "val").otherwise("train")
