"""Column functions that normalise text, codes, links, amounts and dates."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that identify no product: fixed values.
NOISE_WORDS = ("pokemon", "pokémon", "the", "a", "an", "new", "official", "trading", "card", "game", "tcg", "product", "with", "and", "edition")


def _spaced(c: Column, keep: str) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), f"[^{keep}]+", " "))


def norm_text(c: Column) -> Column:
    """Lower case, letters and digits of any script, single blanks between; null gives ''."""
    return _spaced(c, r"\p{L}\p{N}")


def norm_title(c: Column) -> Column:
    """As norm_text, but only a-z and 0-9 stay."""
    return _spaced(c, "a-z0-9")


def norm_day(c: Column) -> Column:
    """norm_text of a stamp's first ten signs."""
    return norm_text(F.substring(F.trim(c.cast("string")), 1, 10))


def _accents() -> tuple[str, str]:
    pairs = {}
    for code in range(0xC0, 0x250):
        base = "".join(x for x in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(x))
        if len(base) == 1 and base != chr(code):
            pairs[chr(code)] = base
    return "".join(pairs), "".join(pairs.values())


def strip_accents(c: Column) -> Column:
    """Latin letters without their accents."""
    return F.translate(c, *_accents())


def identity_tokens(c: Column, shortest: int = 3, noise: Sequence[str] = NOISE_WORDS) -> Column:
    """Distinct accent-free words of a title that are not noise and have `shortest` letters or more, sorted."""
    words = F.split(_spaced(strip_accents(F.coalesce(c, F.lit(""))), "a-z0-9"), " ")
    real = F.filter(words, lambda w: (F.length(w) >= shortest) & ~w.isin(*noise))
    return F.array_sort(F.array_distinct(real))


def norm_sku(c: Column) -> Column:
    """Lower case, blanks and underscores as single dashes, other signs dropped."""
    dashed = F.regexp_replace(F.lower(F.trim(c.cast("string"))), r"[\s_]+", "-")
    return F.btrim(F.regexp_replace(F.regexp_replace(dashed, "[^a-z0-9-]+", ""), "-+", "-"), F.lit("-"))


def norm_code(c: Column) -> Column:
    """Upper case, blanks as single dashes; null gives ''."""
    return F.regexp_replace(F.replace(F.upper(F.trim(F.coalesce(c.cast("string"), F.lit("")))), F.lit(" "), F.lit("-")), "-+", "-")


def norm_value(c: Column) -> Column:
    """Lower case with underscores for dashes and blanks; null gives ''."""
    return F.translate(F.lower(F.trim(F.coalesce(c.cast("string"), F.lit("")))), "- ", "__")


def url_key(c: Column) -> Column:
    """Lower case without fragment and trailing slashes; null gives ''."""
    return F.regexp_replace(F.split_part(F.lower(F.trim(F.coalesce(c, F.lit("")))), F.lit("#"), F.lit(1)), "/+$", "")


def url_valid(c: Column) -> Column:
    return F.coalesce(F.trim(c).rlike("(?i)^https?://[^/?#]+"), F.lit(False))


def norm_url(c: Column) -> Column:
    """Scheme and host in lower case and no fragment; a url that isn't valid stays as it is."""
    text = F.trim(c)
    head = F.lower(F.regexp_extract(text, "^([^:]+://[^/?#]*)", 1))
    rest = F.regexp_extract(text, "^[^:]+://[^/?#]*([^#]*)", 1)
    return F.when(url_valid(c), F.concat(head, rest)).otherwise(c)


def norm_availability(c: Column) -> Column:
    return F.translate(F.lower(F.trim(F.coalesce(c, F.lit("")))), "_- ", "")


#: Classes of availability: fixed values.
AVAILABLE = ("instock", "available", "preorder", "preorderonly", "availablefororder")
UNAVAILABLE = ("soldout", "outofstock", "unavailable", "discontinued", "preorderclosed")


def availability_class(c: Column) -> Column:
    n = norm_availability(c)
    return F.when(n.isin(*AVAILABLE), "available").when(n.isin(*UNAVAILABLE), "unavailable").otherwise("unknown")


def parse_decimal(c: Column) -> Column:
    """The number in a text once all but digits, points and minus signs are gone; null if that is none."""
    return F.regexp_replace(c, r"[^\d.\-]", "").try_cast("double")


def parse_quantity(c: Column) -> Column:
    """parse_decimal rounded half to even; null if negative."""
    n = F.bround(parse_decimal(c), 0).cast("long")
    return F.when(n >= 0, n)


#: Texts that mean yes and no: fixed values.
TRUE_TEXTS = ("true", "yes", "y", "1", "sold", "active", "confirmed", "verified")
FALSE_TEXTS = ("false", "no", "n", "0", "unsold", "inactive", "unconfirmed", "unverified")


def parse_bool(c: Column) -> Column:
    """True, false or, where the text says neither, null."""
    t = F.lower(F.trim(c.cast("string")))
    return F.when(t.isin(*TRUE_TEXTS), True).when(t.isin(*FALSE_TEXTS), False)


CURRENCIES = ("USD", "EUR", "GBP", "JPY", "CAD", "AUD")


def norm_currency(c: Column) -> Column:
    """Three-letter code of a sign or code; null and '' give null."""
    signs = F.create_map(*(F.lit(x) for x in ("$", "USD", "€", "EUR", "£", "GBP", "¥", "JPY")))
    return F.when(F.coalesce(c, F.lit("")) == "", None).otherwise(F.coalesce(signs[c], F.upper(F.trim(c))))


#: Formats of stamps, tried in turn, and the shapes that texts of each have: others aren't parsed, as a failure costs much
#: more than a look.
_DAY = r"[+-]?[0-9]{4,}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])"
_TIME = "[0-9]{2}:[0-9]{2}:[0-9]{2}"
STAMP_FORMATS = {
    "yyyy-MM-dd'T'HH:mm:ssXXX": f"^{_DAY}[Tt]{_TIME}(?:[Zz]|[+-].+)$",
    "yyyy-MM-dd'T'HH:mm:ss": f"^{_DAY}[Tt]{_TIME}$",
    "yyyy-MM-dd HH:mm:ss": f"^{_DAY} {_TIME}$",
    "yyyy-MM-dd": f"^{_DAY}$",
}


def parse_ts(c: Column) -> Column:
    """Timestamp of a stamp in one of STAMP_FORMATS, in UTC; null if it is none."""
    t = F.trim(c)
    return F.coalesce(*(F.when(t.rlike(shape), F.try_to_timestamp(t, F.lit(f))) for f, shape in STAMP_FORMATS.items()))


def canon(c: Column, aliases: Mapping[str, str], valid: Sequence[str]) -> Column:
    """Canonical form of a value: itself in upper case if valid, else what the alias stands for, else unchanged."""
    t = F.trim(c)
    table = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))
    return F.when(F.coalesce(c, F.lit("")) == "", None).when(F.upper(t).isin(*valid), F.upper(t)).otherwise(F.coalesce(table[F.lower(t)], t))


#: Aliases of source types: fixed values.
SOURCE_TYPES = ("OFFICIAL", "RETAILER", "PRESS_RELEASE", "SOCIAL", "COMMUNITY", "MARKETPLACE", "NEWS", "EVENT", "OTHER")
SOURCE_ALIASES = {
    "official": "OFFICIAL",
    "brand": "OFFICIAL",
    "retailer": "RETAILER",
    "store": "RETAILER",
    "press_release": "PRESS_RELEASE",
    "press release": "PRESS_RELEASE",
    "pr": "PRESS_RELEASE",
    "social": "SOCIAL",
    "social_media": "SOCIAL",
    "community": "COMMUNITY",
    "forum": "COMMUNITY",
    "marketplace": "MARKETPLACE",
    "resale": "MARKETPLACE",
    "news": "NEWS",
    "article": "NEWS",
    "event": "EVENT",
    "convention": "EVENT",
    "other": "OTHER",
}


def first_keyword(c: Column, ignore: Sequence[str] = ("the", "and", "new", "official", "available", "coming", "soon")) -> Column:
    """The first word of four letters or more that is not ignored, without punctuation around it, else 'general'."""
    words = F.transform(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: F.btrim(w, F.lit(",.!?()[]")))
    return F.coalesce(F.try_element_at(F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(*ignore)), F.lit(1)), F.lit("general"))


def set_codes(c: Column, patterns: Sequence[str] = (r"\b(OP|ST|EB|PRB)[- ]?(\d{2})\b",)) -> Column:
    """Set codes in a text as PREFIX-NN, in the order of the patterns and of their places, without repeats."""
    found = []
    for p in patterns:
        whole = F.regexp_extract_all(F.upper(F.coalesce(c, F.lit(""))), F.lit(p), F.lit(0))
        found.append(F.transform(whole, lambda m: F.concat(F.regexp_extract(m, "^([A-Z]+)", 1), F.lit("-"), F.regexp_extract(m, r"(\d+)$", 1))))
    return F.array_distinct(F.concat(*found))
