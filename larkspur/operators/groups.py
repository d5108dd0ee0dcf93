"""Connected components and similarity joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.sources.tables import cut


def components(links: DataFrame) -> DataFrame:
    """node and root for each node of the links (a, b: longs): root is the smallest node that can be reached.

    Each round moves every node's larger neighbours to its smallest, then its smaller ones; both steps are joins and
    minima, so a node with many links is split by Spark like any skewed key. Rounds end when nothing changes.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    measure = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    state = measure(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        wide = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = wide.groupBy("u").agg(F.min("v").alias("m"))
        pairs = F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = cut(wide.join(low, "u").select(F.explode(pairs).alias("e")).select("e.u", "e.v").where("u <> v").distinct())
        found = measure(edges)
        if found == state:
            break
        state = found
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


#: 64-bit words of the parity map of a set in similar_sets.
PARITY_WORDS = 4


def _parity(tokens: Column) -> list[Column]:
    """Words of a bit map of a set of longs; a bit is the parity of the number of tokens that fall on it."""
    word, bit = lambda x: F.pmod(x, F.lit(64 * PARITY_WORDS)) / 64, lambda x: F.pmod(x, F.lit(64)).cast("int")
    return [F.aggregate(F.filter(tokens, lambda x: F.floor(word(x)) == w), F.lit(0).cast("long"), lambda m, x: m.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit(x)))) for w in range(PARITY_WORDS)]  # noqa: B023


def similar_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a < b, overlap, similarity) of sets (id, tokens: array) whose Jaccard similarity is `threshold` or more.

    Tokens are ordered by rarity; two similar sets share a token among the first n - ceil(threshold * n) + 1 of each, so
    only those are joined. Sizes must fit too, and so must the tokens that are left after the shared one, and the parity
    maps of two sets can't differ in more bits than the sets do in tokens. Candidates are verified on the whole sets,
    where XXH64 stands for each token. Empty sets are similar to none. Equal sets meet once for each of their pairs: give
    distinct sets where copies abound.
    """
    known = sets.where(F.size("tokens") > 0).select("id", F.array_distinct(F.transform("tokens", lambda t: F.xxhash64(t))).alias("tokens"))
    often = known.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    ranked = known.select("id", F.explode("tokens").alias("token")).join(often, "token").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("t"))
    ranked = ranked.select("id", F.transform("t", lambda x: x["token"]).alias("tokens"), F.size("t").alias("size"))
    ranked = cut(ranked.select("*", *(m.alias(f"m{i}") for i, m in enumerate(_parity(F.col("tokens"))))))
    maps = [f"m{i}" for i in range(PARITY_WORDS)]
    keep = F.col("size") - F.ceil(F.lit(threshold) * F.col("size") - 1e-9) + 1
    prefix = ranked.select("id", "size", *maps, F.posexplode(F.slice("tokens", F.lit(1), keep.cast("int"))).alias("pos", "token"))
    a, b = prefix.alias("a"), prefix.alias("b")
    need = F.lit(threshold / (1 + threshold)) * (F.col("a.size") + F.col("b.size")) - 1e-9
    left = F.least(F.col("a.size") - F.col("a.pos"), F.col("b.size") - F.col("b.pos"))
    differ = sum((F.bit_count(F.col(f"a.{m}").bitwiseXOR(F.col(f"b.{m}"))) for m in maps), F.lit(0))
    close = (F.col("a.size") >= F.col("b.size") * threshold - 1e-9) & (F.col("b.size") >= F.col("a.size") * threshold - 1e-9) & (left >= need) & (differ <= F.col("a.size") + F.col("b.size") - 2 * need)
    pairs = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.id") < F.col("b.id"))).where(close).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    x, y = ranked.select(F.col("id").alias("a"), F.col("tokens").alias("x")), ranked.select(F.col("id").alias("b"), F.col("tokens").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    checked = pairs.join(x, "a").join(y, "b").select("a", "b", both.alias("overlap"), (both / (F.size("x") + F.size("y") - both)).alias("similarity"))
    return checked.where(F.col("similarity") >= threshold - 1e-9)


#: Product types that titles name: fixed values, first one wins.
PRODUCT_TYPE_TERMS = {
    "elite trainer box": "etb",
    "booster bundle": "booster_bundle",
    "booster box": "booster_box",
    "premium collection": "premium_collection",
    "special collection": "special_collection",
    "collection box": "collection_box",
    "mini tin": "mini_tin",
    "tin": "tin",
    "plush": "plush",
    "figure": "figure",
    "pin": "pin",
}


def similar_products(items: DataFrame, threshold: float = 0.72, bonus: float = 0.15) -> DataFrame:
    """Pairs (a < b, similarity) of products (id, title, sku, type) that are one: equal sku, or token similarity plus
    `bonus` for a known equal type of `threshold` or more.

    Products with equal tokens and type are compared once, through their smallest id, and expanded to all of them only
    as pairs with it, so the pairs connect the same groups as all pairs would.
    """
    tokens = items.select(F.col("id"), T.identity_tokens(F.col("title")).alias("tokens"), F.coalesce("type", F.lit("unknown")).alias("type"))
    same = tokens.where(F.size("tokens") > 0).groupBy("tokens", "type").agg(F.min("id").alias("rep"))
    members = tokens.join(same, ["tokens", "type"]).where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    reps = cut(same.select(F.col("rep").alias("id"), "tokens", "type"))
    by_tokens = _typed_links(reps, threshold, bonus)
    code = T.norm_sku(F.col("sku"))
    coded = items.select("id", code.alias("code")).where(F.coalesce("code", F.lit("")) != "")
    first = coded.groupBy("code").agg(F.min("id").alias("a"))
    by_sku = coded.join(first, "code").where("id <> a").select("a", F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    return by_tokens.unionByName(members).unionByName(by_sku).groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def group_products(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """id and group (smallest id that pairs connect) for each item."""
    roots = components(pairs.select("a", "b"))
    return items.select("id").join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("group_id"))


def reach(edges: DataFrame) -> DataFrame:
    """(node, ancestor, depth) over a child-parent table (node, parent): each ancestor once, by the shortest way.

    Ways double in length each round: those of just the greatest length so far are continued by all known ones, so that a
    chain of n takes log2(n) rounds. A node in a cycle is its own ancestor; nulls have none.
    """
    done = cut(edges.where("parent is not null and node is not null").select("node", F.col("parent").alias("ancestor")).distinct().withColumn("depth", F.lit(1)))
    length = 1
    while True:
        further = done.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("next"), F.col("depth").alias("more"))
        far = done.where(F.col("depth") == length).select("node", "ancestor", "depth")
        longer = far.join(further, "ancestor").groupBy("node", F.col("next").alias("ancestor")).agg(F.min(F.col("depth") + F.col("more")).alias("depth"))
        new = cut(longer.join(done.select("node", "ancestor"), ["node", "ancestor"], "left_anti").select("node", "ancestor", "depth"))
        if new.isEmpty():
            return done
        done = cut(done.unionByName(new))
        length *= 2


def _typed_links(reps: DataFrame, threshold: float, bonus: float) -> DataFrame:
    """Pairs (a < b, similarity) of products (id, tokens, type) with different tokens or types that match by these."""
    near = similar_sets(reps.select("id", "tokens"), threshold - bonus)
    kinds = reps.select("id", "type")
    typed = near.join(kinds.select(F.col("id").alias("a"), F.col("type").alias("ta")), "a").join(kinds.select(F.col("id").alias("b"), F.col("type").alias("tb")), "b")
    extra = F.when((F.col("ta") == F.col("tb")) & (F.col("ta") != "unknown"), bonus).otherwise(0.0)
    value = F.least(F.lit(1.0), F.floor((F.col("similarity") + extra) * 1000 + 0.5) / 1000)
    return typed.select("a", "b", value.alias("similarity")).where(F.col("similarity") >= threshold)


def leader_groups(items: DataFrame, threshold: float = 0.72, bonus: float = 0.15) -> DataFrame:
    """id and leader of a greedy clustering of products (id, title, sku, type; ids differ): in the order of ids, each joins the
    first leader that it matches by similar_products' rule, else it leads itself. Products without tokens and sku lead
    themselves; rows with a null id are left out.

    All products with equal tokens, type and sku follow the first of them, so only these firsts are decided. Those of one
    sku match each other, and so do those of one token class (equal tokens and type): either has one leader at most.
    A round therefore looks at three things for each first: the leader and the first undecided product of its sku, of its
    token class and of the classes linked to that one. It is settled once its best leader comes before all undecided ones, or
    none of these is left. No pair of products is made; the rounds are as many as the longest chain of undecided ones.
    """
    full = items.where("id is not null").select("id", F.array_sort(T.identity_tokens(F.col("title"))).alias("tokens"), F.coalesce("type", F.lit("unknown")).alias("type"), F.nullif(T.norm_sku(F.col("sku")), F.lit("")).alias("code"))
    full = cut(full.withColumn("tokens", F.when(F.size("tokens") > 0, F.col("tokens"))))
    firsts = full.groupBy("tokens", "type", "code").agg(F.min("id").alias("x"))
    classes = cut(firsts.where("tokens is not null").groupBy("tokens", "type").agg(F.min("x").alias("t")))
    reps = firsts.where("tokens is not null or code is not null").join(classes, ["tokens", "type"], "left").select("x", "t", "code", "tokens", "type")
    reps = cut(reps)
    pairs = _typed_links(classes.select(F.col("t").alias("id"), "tokens", "type"), threshold, bonus).select("a", "b")
    links = cut(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    open_ = reps.select("x", "t", "code")
    done = open_.limit(0).select("x", "t", "code", F.col("x").alias("leader"))
    while True:
        leads = done.where("x = leader")
        best = lambda by: leads.groupBy(by).agg(F.min("x").alias("lead")).where(F.col(by).isNotNull())  # noqa: E731,B023
        wait = lambda by: open_.groupBy(by).agg(F.min("x").alias("undecided")).where(F.col(by).isNotNull())  # noqa: E731,B023
        of_class = cut(best("t").join(wait("t"), "t", "full_outer"))
        of_code = best("code").join(wait("code"), "code", "full_outer").select("code", F.col("lead").alias("code_lead"), F.col("undecided").alias("code_undecided"))
        beside = links.join(of_class, F.col("b") == F.col("t")).groupBy("a").agg(F.min("lead").alias("near_lead"), F.min("undecided").alias("near_undecided"))
        seen = open_.join(of_class, "t", "left").join(beside, F.col("t") == F.col("a"), "left").join(of_code, "code", "left")
        earlier = lambda *names: F.least(*(F.when(F.col(n) < F.col("x"), F.col(n)) for n in names))
        state = seen.select("x", "t", "code", earlier("lead", "near_lead", "code_lead").alias("first"), earlier("undecided", "near_undecided", "code_undecided").alias("waits"))
        state = cut(state.select("x", "t", "code", F.when(F.col("waits").isNull() | (F.col("first") < F.col("waits")), F.coalesce("first", "x")).alias("leader")))
        done = cut(done.unionByName(state.where("leader is not null")))
        open_ = state.where("leader is null").select("x", "t", "code")
        if open_.isEmpty():
            break
    same = full.join(reps.withColumnRenamed("type", "kind").withColumnRenamed("tokens", "words").withColumnRenamed("code", "sign"), F.col("tokens").eqNullSafe(F.col("words")) & (F.col("type") == F.col("kind")) & F.col("code").eqNullSafe(F.col("sign")), "left")
    return same.select("id", "x").join(done.select("x", "leader"), "x", "left").select("id", F.coalesce("leader", "id").alias("leader"))
