"""Stored pages and feeds: visible text, links, items and page quality, with DataFrame functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entities that are spelled out: fixed values; & comes last.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def unescape(c: Column) -> Column:
    for name, sign in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(sign))
    return c


def visible_text(html: Column) -> Column:
    """Text without scripts, styles, comments and tags, entities spelled out, blanks single."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->", " ")
    return F.btrim(F.regexp_replace(unescape(F.regexp_replace(bare, r"(?s)<[^>]*>", " ")), r"\s+", " "))


def _inside(html: Column, tag: str) -> Column:
    found = visible_text(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1))
    return F.when(found != "", found)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, title, h1, body (visible text) and ok (false for pages without any text)."""
    html = F.coalesce("html", F.lit(""))
    body = visible_text(html)
    return pages.select("page_id", _inside(html, "title").alias("title"), _inside(html, "h1").alias("h1"), body.alias("body"), (body != "").alias("ok"))


def resolved(page: Column, href: Column) -> Column:
    """A link of a page as absolute url without fragment: links with a scheme stay, others take the page's scheme (//),
    host (/), path (?) or folder; . and .. steps are gone."""
    bare = F.split_part(href, F.lit("#"), F.lit(1))
    scheme, root = F.regexp_extract(page, "^([^:]+:)//", 1), F.regexp_extract(page, "^([^:]+://[^/?#]*)", 1)
    path = F.regexp_extract(page, "^[^:]+://[^/?#]*([^?#]*)", 1)
    folder = F.when(path == "", "/").otherwise(F.regexp_extract(path, "^(.*/)", 1))
    steps = F.split(F.split_part(F.concat(folder, bare), F.lit("?"), F.lit(1)), "/")
    query = F.regexp_extract(bare, r"(\?.*)$", 1)
    kept = F.aggregate(steps, F.array().cast("array<string>"), lambda a, x: F.when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(1)))).when(x == ".", a).otherwise(F.array_append(a, x)))
    relative = F.concat(root, F.array_join(kept, "/"), query)
    return (
        F.when(bare.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), bare)
        .when(bare.startswith("//"), F.concat(scheme, bare))
        .when(bare.startswith("/"), F.concat(root, bare))
        .when(bare == "", F.split_part(page, F.lit("#"), F.lit(1)))
        .when(bare.startswith("?"), F.concat(root, path, bare))
        .otherwise(relative)
    )


def harvest_links(pages: DataFrame, hosts: Sequence[str], include: Sequence[str] = (), ignore: Sequence[str] = ()) -> DataFrame:
    """(page_id, link, text) of anchors: absolute, without fragment, first of each page; of hosts that end in one of
    `hosts`; whose text holds a term of `include` (if any) and none of `ignore`."""
    anchor = r"(?is)<a\b[^>]*?href\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a\s*>"
    rows = pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(anchor), F.lit(0))).alias("at", "a"))
    href, text = F.btrim(F.regexp_extract("a", anchor, 1)), visible_text(F.regexp_extract("a", anchor, 2))
    links = rows.select("page_id", "at", resolved(F.col("url"), href).alias("link"), text.alias("text"))
    lowered = F.lower("text")
    some = lambda terms: F.exists(F.array(*(F.lit(t) for t in terms)), lambda t: F.contains(lowered, t))
    host = F.lower(F.regexp_extract("link", "^[^:]+://([^/?#:]*)", 1))
    ok = F.exists(F.array(*(F.lit(h) for h in hosts)), lambda h: (host == h) | host.endswith(F.concat(F.lit("."), h)))
    ok = ok & some(include) if include else ok
    ok = ok & ~some(ignore) if ignore else ok
    return links.where(ok).groupBy("page_id", "link").agg(F.min_by("text", "at").alias("text"))


#: Markers of pages that hold no product: fixed values.
BLOCK_MARKERS = ("pardon our interruption", "request unsuccessful. incapsula", "incapsula incident id", "queue-it", "queueit", "virtual queue", "you are in line", "estimated wait", "verify you are human", "are you a robot")


def page_quality(pages: DataFrame, markers: Sequence[str] = BLOCK_MARKERS, shortest: int = 40) -> DataFrame:
    """page_id and quality: BLOCKED (a marker is there), EMPTY (less visible text than `shortest` signs) or OK."""
    lowered = F.lower(F.coalesce("html", F.lit("")))
    blocked = F.exists(F.array(*(F.lit(m) for m in markers)), lambda m: F.contains(lowered, m))
    return pages.select("page_id", F.when(blocked, "BLOCKED").when(F.length(visible_text(F.col("html"))) < shortest, "EMPTY").otherwise("OK").alias("quality"))


#: Hosts and path of links to products: fixed values.
PRODUCT_HOSTS, PRODUCT_PATH = ("www.pokemoncenter.com", "pokemoncenter.com"), "/product/"


def outbound_product(pages: DataFrame, hosts: Sequence[str] = PRODUCT_HOSTS, path: str = PRODUCT_PATH) -> DataFrame:
    """page_id, candidates (number of different product links of a page) and product_url: the link where there is just
    one, else null. Pages without such links have 0. No `hosts` means any."""
    links = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(r"(?is)<a\b[^>]*?href\s*=\s*[\"']([^\"']+)[\"']"), F.lit(1)), lambda h: resolved(F.col("url"), F.btrim(h))))
    hosted = lambda u: F.lower(F.regexp_extract(u, "^[^:]+://([^/?#]*)", 1)).isin(*hosts) if hosts else F.lit(True)
    fits = F.filter(links, lambda u: hosted(u) & F.contains(F.regexp_extract(u, "^[^:]+://[^/?#]*([^?#]*)", 1), F.lit(path)))
    found = F.coalesce(fits, F.array().cast("array<string>"))
    return pages.select("page_id", found.alias("f")).select("page_id", F.size("f").alias("candidates"), F.when(F.size("f") == 1, F.col("f")[0]).alias("product_url"))


def embedded_objects(pages: DataFrame, schema: str = "`@type` string, name string, sku string, url string, offers struct<price:string,availability:string>") -> DataFrame:
    """Objects in JSON-LD scripts (one, an array or an @graph), with page_id; those that don't parse are left out. On one
    page the first of each url, else sku, else name stays."""
    script = r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script\s*>"
    texts = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(script), F.lit(1))).alias("at", "json"))
    as_list = F.when(F.btrim("json").startswith("["), F.from_json("json", f"array<struct<{_fields(schema)}>>"))
    graph = F.from_json("json", f"`@graph` array<struct<{_fields(schema)}>>")["@graph"]
    one = F.array(F.from_json("json", schema))
    objects = texts.select("page_id", "at", F.posexplode(F.coalesce(as_list, graph, one)).alias("n", "o")).select("page_id", "at", "n", "o.*").where("name is not null or sku is not null or url is not null")
    key = F.coalesce("url", "sku", F.lower(F.trim("name")))
    first = F.min_by(F.struct(*[c for c in objects.columns if c not in ("at", "n")]), F.struct("at", "n"))
    return objects.groupBy("page_id", key.alias("__key")).agg(first.alias("r")).select("r.*")


def _fields(ddl: str) -> str:
    import re

    return re.sub(r"(^|, )(`[^`]+`|\w+) ", r"\1\2:", ddl)


FEED_ITEM = "title string, link string, description string, pubDate string, guid string, category array<string>"
FEED_ENTRY = "title string, link struct<_href:string>, summary string, updated string, id string"


def feed_items(feeds: DataFrame) -> DataFrame:
    """Items of RSS and entries of Atom feeds (feed_id, body): feed_id, title, link, summary, published, guid, categories.

    Each item is cut out and parsed on its own, so that a broken one costs no other; those without title and link go.
    """
    rss = feeds.select("feed_id", F.explode(F.regexp_extract_all("body", F.lit(r"(?s)<item\b.*?</item>"), F.lit(0))).alias("x")).select("feed_id", F.from_xml("x", FEED_ITEM).alias("i"))
    atom = feeds.select("feed_id", F.explode(F.regexp_extract_all("body", F.lit(r"(?s)<entry\b.*?</entry>"), F.lit(0))).alias("x")).select("feed_id", F.from_xml("x", FEED_ENTRY).alias("i"))
    a = rss.select("feed_id", "i.title", "i.link", F.col("i.description").alias("summary"), F.col("i.pubDate").alias("published"), "i.guid", F.col("i.category").alias("categories"))
    b = atom.select("feed_id", "i.title", F.col("i.link._href").alias("link"), "i.summary", F.col("i.updated").alias("published"), F.col("i.id").alias("guid"), F.array().cast("array<string>").alias("categories"))
    return a.unionByName(b).where("title is not null or link is not null")


def json_items(documents: DataFrame, path: Sequence[str], schema: str) -> DataFrame:
    """Rows under a path of names in JSON texts (doc_id, body): doc_id and the columns of `schema`; a text that doesn't
    parse or has nothing there gives none."""
    kind = f"array<struct<{_fields(schema)}>>"
    for name in reversed(path):
        kind = f"struct<`{name}`:{kind}>"
    found = F.from_json("body", kind)
    for name in path:
        found = found[name]
    return documents.select("doc_id", F.explode(found).alias("i")).select("doc_id", "i.*")


def xml_items(documents: DataFrame, path: Sequence[str], schema: str) -> DataFrame:
    """Elements under a path of tags below the root of XML texts (doc_id, body): doc_id and the columns of `schema`.

    Repeated tags are arrays, attributes have a leading underscore and the text beside them is `_VALUE`, as the schema
    names them; namespaces are ignored. A text that doesn't parse, or has nothing there, gives no row.
    """
    kind = f"array<struct<{_fields(schema)}>>"
    for name in reversed(path[1:]):
        kind = f"struct<`{name}`:{kind}>"
    found = F.from_xml("body", f"`{path[0]}` {kind}", {"ignoreNamespace": "true", "mode": "PERMISSIVE"})
    for name in path:
        found = found[name]
    return documents.select("doc_id", F.explode(found).alias("i")).select("doc_id", "i.*")
