"""Product objects at any depth of the JSON that pages carry in scripts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators.pages import resolved
from larkspur.sources.tables import cut

#: Kinds of objects that are products whatever they hold, and names of values in the order in which they count: fixed values.
PRODUCT_KINDS = ("Product", "IndividualProduct", "Article", "NewsArticle")
TITLE_NAMES = ("name", "headline", "title")
URL_NAMES = ("url", "@id")
DESCRIPTION_NAMES = ("description", "abstract")
DATE_NAMES = ("releaseDate", "datePublished", "dateCreated", "availabilityStarts")
PRICE_NAMES = ("price", "lowPrice", "highPrice")
DETAIL_NAMES = ("offers", "sku", "productID", "releaseDate")

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def script_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, at and json: the texts of JSON-LD scripts in the order of the page, then that of the page state."""
    linked = r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script\s*>"
    state = r"(?is)<script[^>]*\bid\s*=\s*[\"']__NEXT_DATA__[\"'][^>]*>(.*?)</script\s*>"
    texts = F.concat(F.regexp_extract_all("html", F.lit(linked), F.lit(1)), F.slice(F.regexp_extract_all("html", F.lit(state), F.lit(1)), 1, 1))
    return pages.select("page_id", "url", F.posexplode(texts).alias("at", "json")).select("page_id", "url", "at", F.btrim("json").alias("json"))


def nested_values(texts: DataFrame, keep: Sequence[str]) -> DataFrame:
    """All objects and arrays of JSON texts (`json`, and the columns to keep), the texts' own values included: `v` (a variant) and
    `place`, the positions on the way to it, by which a value stands before all that it holds.

    Level by level: each round takes apart what the one before found, until no value holds another; the rounds are as many
    as the deepest text has levels. Names of an object count in alphabetical order. A text that doesn't parse has no values.
    """
    spark = texts.sparkSession
    nested = lambda c: F.try_variant_get(c, "$", "map<string,variant>").isNotNull() | F.try_variant_get(c, "$", "array<variant>").isNotNull()
    parsed = texts.select(*keep, F.try_parse_json("json").alias("v")).withColumn("place", F.array().cast("array<int>"))
    level = cut(parsed.where(F.col("v").isNotNull() & nested(F.col("v"))))
    found = level
    while not level.isEmpty():
        below = spark.sql("SELECT t.*, e.pos AS pos, e.value AS value FROM {t} t, LATERAL variant_explode(t.v) e", t=level)
        below = below.select(*keep, F.col("value").alias("v"), F.array_append("place", F.col("pos")).alias("place"))
        level = cut(below.where(nested(F.col("v"))))
        found = found.unionByName(level)
    return found


def _at(v: Column, name: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, f'$["{name}"]', kind)


def _raw(v: Column, name: str) -> Column:
    return F.to_json(_at(v, name, "variant"))


def _filled(v: Column, name: str) -> Column:
    """Whether a value is there and isn't empty, zero or false."""
    return F.coalesce(~_raw(v, name).isin("null", '""', "[]", "{}", "0", "0.0", "false"), F.lit(False))


def _first(v: Column, names: Sequence[str]) -> Column:
    """The first value that is neither null nor empty, as text."""
    some = lambda n: ~_raw(v, n).isin("null", '""', "[]", "{}")
    return F.coalesce(*(F.when(some(n), _at(v, n)) for n in names))


def _either(v: Column, names: Sequence[str]) -> Column:
    return F.coalesce(*(F.when(_filled(v, n), _at(v, n)) for n in names))


def _clean(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"\s+", " "))


def _is_object(v: Column, name: str) -> Column:
    return _at(v, name, "map<string,variant>").isNotNull()


def structured_objects(pages: DataFrame) -> DataFrame:
    """Products in the scripts of pages (page_id, url, html), at any depth: page_id, title, url, description, retail_price,
    currency, availability, release_date, sku, product_id, image_url and structured_type.

    A product has one of PRODUCT_KINDS, or a title and one of DETAIL_NAMES; those without a title are left out. Prices and
    availability come from the offers (the first of a list), else prices from the object itself; links take the page's
    url. Of objects of a page with the same url (else sku, else title) the first by `place` stays. Null pages and texts that
    don't parse have none.
    """
    v, page = F.col("v"), F.col("url")
    kinds = F.coalesce(_at(v, "@type", "array<string>"), F.array(_at(v, "@type")))
    kind = F.exists(kinds, lambda k: F.coalesce(k.isin(*PRODUCT_KINDS), F.lit(False)))
    either = lambda names: reduce(lambda a, b: a | b, (_filled(v, n) for n in names))
    title = _clean(_first(v, TITLE_NAMES))
    listed = F.try_variant_get(v, "$.offers", "array<variant>")
    offer = F.coalesce(F.try_variant_get(v, "$.offers[0]", "variant"), F.when(listed.isNull(), _at(v, "offers", "variant")))
    rows = nested_values(script_texts(pages), ("page_id", "url", "at")).where(kind | (either(TITLE_NAMES) & either(DETAIL_NAMES))).where(F.coalesce(title, F.lit("")) != "")
    rows = rows.withColumn("offer", offer)
    o = F.col("offer")
    offered = F.try_variant_get(o, "$", "map<string,variant>").isNotNull()

    def number(source: Column, name: str) -> Column:
        text = F.btrim(F.regexp_replace(_at(source, name), "[$,]", ""))
        return F.when(text.rlike(_NUMBER), text.cast("double"))

    price = F.when(offered, F.coalesce(*(number(o, n) for n in PRICE_NAMES))).otherwise(F.coalesce(*(number(v, n) for n in PRICE_NAMES)))
    currency = F.coalesce(F.when(offered & _filled(o, "priceCurrency"), _at(o, "priceCurrency")), _at(v, "priceCurrency"))
    availability = F.when(offered & _filled(o, "availability"), F.element_at(F.split(_at(o, "availability"), "/"), -1))
    link_of = lambda n: F.when(_is_object(v, n), F.coalesce(F.try_variant_get(v, f'$["{n}"]["@id"]', "string"), F.try_variant_get(v, f'$["{n}"].url', "string"))).when(_raw(v, n).startswith('"'), _at(v, n))
    link = F.coalesce(*(F.when(~_raw(v, n).isin("null", '""', "[]", "{}"), F.coalesce(link_of(n), F.lit(""))) for n in URL_NAMES))
    image = F.coalesce(F.try_variant_get(v, "$.image[0]", "variant"), F.when(_at(v, "image", "array<variant>").isNull(), _at(v, "image", "variant")))
    pictured = F.coalesce(F.try_variant_get(image, "$.url", "string"), F.try_variant_get(image, "$.contentUrl", "string"), F.when(F.to_json(image).startswith('"'), F.try_variant_get(image, "$", "string")))
    found = rows.select(
        "page_id",
        F.struct("at", "place").alias("order"),
        title.alias("title"),
        F.when(link != "", resolved(page, link)).alias("url"),
        F.coalesce(_clean(_first(v, DESCRIPTION_NAMES)), F.lit("")).alias("description"),
        price.alias("retail_price"),
        currency.alias("currency"),
        availability.alias("availability"),
        F.nullif(_clean(_first(v, DATE_NAMES)), F.lit("")).alias("release_date"),
        _either(v, ("sku", "productID", "mpn")).alias("sku"),
        _either(v, ("productID", "mpn")).alias("product_id"),
        F.when(pictured.isNotNull(), F.concat(resolved(page, pictured), F.regexp_extract(pictured, "(#.*)$", 1))).alias("image_url"),
        F.array_join(F.array_compact(kinds), ",").alias("structured_type"),
    )
    key = F.coalesce("url", "sku", F.lower("title"))
    values = [c for c in found.columns if c not in ("page_id", "order")]
    return found.groupBy("page_id", key.alias("__key")).agg(F.min_by(F.struct(*values), "order").alias("r")).select("page_id", "r.*")
