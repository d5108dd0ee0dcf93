"""URL filters: given host and path rules, and association rules that FP-growth mines from labelled URLs."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import cut, few, lower_ascii

#: (verdict, rule): fixed values. A rule is a host and a path prefix.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
_BLOCK, _ALLOW = "=block", "=allow"


def host(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z lower-cased; null and other texts give ''."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(h: Column, p: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """Struct of rule and verdict of the longest rule whose host is the url's or a parent of it and whose path starts
    the url's; null where none fits."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((h == name) | h.endswith("." + name)) & p.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column) -> Column:
    """Distinct tokens: labels of the host (h:), words of the path (p:) and names in the query (q:); digits are written
    as #, so that numbered pages share a token. Longer paths and queries give more tokens; nothing is cut off."""
    masked = lambda c: F.regexp_replace(lower_ascii(c), "[0-9]+", "#")
    some = lambda mark, words: F.transform(F.filter(words, lambda w: w != ""), lambda w: F.concat(F.lit(mark), w))
    query = F.coalesce(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), F.lit(""))
    names = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))
    return F.array_distinct(F.concat(some("h:", F.split(masked(host(url)), r"\.")), some("p:", F.split(masked(path(url)), r"[^\p{L}\p{N}#]+")), some("q:", F.transform(names, masked))))


def mine(labelled: DataFrame, support: float = 0.005, confidence: float = 0.8, lift: float = 1.2, least: int = 10) -> DataFrame | None:
    """Rules (tokens array, confidence, support) that tell blocked URLs, from labelled (url, block: boolean).

    Tokens that make a rule alone are told by counting. They take no part in what follows, as a URL that has one is blocked
    whatever else it has: so a family of blocked URLs with many names in common makes a rule for each name, not one for
    each set of names. FP-growth counts the other tokens' combinations together with the label. Of tokens that occur in just
    the same URLs one stands for all, and tokens below the support are left out beforehand. Names that most URLs of either
    label have still multiply the combinations. A rule is kept if it holds for at least `support` of
    the URLs and for `least` of them, with at least `confidence`, `lift` times as often as among all. Rows with a null url or label are ignored.
    None if there are fewer rows.
    """
    label = F.when(F.col("block"), F.lit(_BLOCK)).otherwise(F.lit(_ALLOW))
    known = cut(labelled.where("url is not null and block is not null").select(F.monotonically_increasing_id().alias("row"), tokens(F.col("url")).alias("all"), label.alias("label")))
    n = known.count()
    if n < least:
        return None
    share = max(support, least / n)
    single = known.select("row", F.explode("all").alias("token"))
    same_rows = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("row").cast("decimal(38,0)")).alias("rows"))
    blocked = F.count_if(F.col("label") == _BLOCK)
    often = known.select("row", "label", F.explode("all").alias("token")).groupBy("token").agg(same_rows.alias("where"), blocked.alias("bad")).where(F.col("where.n") >= share * n)
    often = cut(often.select("token", "where", "bad", (F.col("bad") / F.col("where.n")).alias("confidence"), (F.col("bad") / F.lit(float(n))).alias("support")))
    every = known.agg(blocked / F.lit(float(n))).first()[0]
    alone = F.expr(f"bad >= {share!r} * {n} - 1e-9") & (F.col("confidence") >= confidence) & (F.col("confidence") >= lift * every)
    single_rules = often.where(alone).select("token", F.array("token").alias("rule_tokens"), "confidence", "support")
    heads = cut(often.where(~alone).groupBy("where").agg(F.min("token").alias("token")).select("token"))  # at most tokens per URL / share
    sets = single.join(few(heads), "token", "left_semi").groupBy("row").agg(F.collect_set("token").alias("some"))
    baskets = known.join(sets, "row", "left").select(F.concat(F.coalesce("some", F.array().cast("array<string>")), F.array("label")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=share, minConfidence=confidence).fit(cut(baskets))
    kept = F.array_contains("consequent", _BLOCK) & ~F.array_contains("antecedent", _ALLOW) & (F.col("lift") >= lift)
    counts = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("item"), "freq")
    rules = model.associationRules.where(kept).select(F.col("antecedent").alias("rule_tokens"), "confidence", "support")
    rarest = rules.select("rule_tokens", "confidence", "support", F.explode("rule_tokens").alias("item")).join(counts, "item")
    longer = rarest.groupBy("rule_tokens", "confidence", "support").agg(F.min(F.struct("freq", "item")).alias("x")).select(F.col("x.item").alias("token"), "rule_tokens", "confidence", "support")
    return single_rules.unionByName(longer)


def judge(pages: DataFrame, labelled: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, support: float = 0.005, confidence: float = 0.8, lift: float = 1.2) -> DataFrame:
    """Judge each url of pages (page_id, url) by the given rules, else by mined ones, else allow it.

    Mined rules form an inverted index by their rarest token: a url meets only rules of which it has that token, and one
    whose tokens it has all blocks it. Returns a row for each row of pages: page_id, host, path, rule (of the given
    ones, else null), verdict, mined (tokens of the surest mined rule that fits, else null), confidence. A null url or
    one without :// has empty host and path and is allowed; repeated rows get equal answers; without labelled rows
    nothing is mined. Other columns are not read.
    """
    urls = pages.select("page_id", "url", F.xxhash64("url").alias("mark"))
    parts = urls.select("page_id", "mark", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    parts = parts.withColumn("given", best_rule(F.col("host"), F.col("path"), rules))
    index = mine(labelled, support, confidence, lift)
    hit = F.lit(None).cast("struct<confidence:double,rule_tokens:array<string>>")
    if index is not None:
        index = cut(index)
        have = urls.where("url is not null").select("page_id", "mark", tokens(F.col("url")).alias("all")).select("page_id", "mark", "all", F.explode("all").alias("token"))
        fits = have.join(few(index), "token").where(F.size(F.array_except("rule_tokens", "all")) == 0)
        best = fits.groupBy("page_id", "mark").agg(F.max(F.struct("confidence", "rule_tokens")).alias("hit")).select(F.col("page_id").alias("hit_id"), F.col("mark").alias("hit_mark"), "hit")
        parts = parts.join(best, F.col("page_id").eqNullSafe(F.col("hit_id")) & (F.col("mark") == F.col("hit_mark")), "left")
        hit = F.col("hit")
    parts = parts.withColumn("surest", hit)
    verdict = F.coalesce("given.verdict", F.when(F.col("surest").isNotNull(), "block"), F.lit("allow"))
    return parts.select("page_id", "host", "path", F.col("given.rule").alias("rule"), verdict.alias("verdict"), F.col("surest.rule_tokens").alias("mined"), F.col("surest.confidence").alias("confidence"))
