"""Signals in texts: keyword detections with negation and certainty, prices, document roll-ups and acceptance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.spans import let, placed

#: Markers: fixed values.
NEGATIONS = ("not", "no", "never", "without", "isn't", "wasn't", "aren't", "weren't", "don't", "doesn't", "didn't", "none")
ESTIMATE_MARKERS = ("approximately", "expected", "projected", "reportedly", "believed to be", "around", "estimated", "roughly", "close to")
RUMOR_MARKERS = ("rumor", "rumored", "leak", "leaked", "unconfirmed", "allegedly", "possibly", "may release", "might release", "supposedly")


#: Signs before a place in which its last words are looked for first, and matches that are taken together for the same.
_TAIL, _STEPS = 200, 8


def _last_words(before: Column, window: int) -> Column:
    """Words at the end of a text, at least `window` whole ones where it has so many. All words are looked for only if its last
    signs don't hold more."""
    words = lambda t: F.regexp_extract_all(F.lower(t), F.lit("[a-z']+"), F.lit(0))
    return let(words(F.right(before, F.lit(_TAIL))), lambda w: F.when((F.size(w) > window) | (F.length(before) <= _TAIL), w).otherwise(words(before)))


def _denied(words: Column, triggers: Sequence[str], window: int) -> Column:
    return let(words, lambda w: F.arrays_overlap(F.slice(w, F.greatest(F.size(w) - window + 1, F.lit(1)), window), F.array(*(F.lit(t) for t in triggers))))


def negated(text: Column, start: Column, triggers: Sequence[str] = NEGATIONS, window: int = 4) -> Column:
    """Whether one of the `window` words before a place (from 0) denies it."""
    return let(F.substring(text, F.lit(1), start), lambda before: _denied(_last_words(before, window), triggers, window))


def first_match(text: Column, pattern: Column, triggers: Sequence[str] = NEGATIONS, window: int = 4) -> Column:
    """The first match (start, end, match) of a pattern that isn't negated; null without one. A text is read up to its first
    match only, and in whole where that is negated; time grows with its length, however many matches it has."""

    def found(start: Column, match: Column) -> Column:
        return let(F.struct(start.alias("s"), match.alias("m")), lambda x: F.struct(x["s"].alias("start"), (x["s"] + F.length(x["m"])).alias("end"), x["m"].alias("match")))

    def later(x: Column) -> Column:
        """x has all matches and pieces. Steps are the texts from one match's begin to the next one's; the last words before a
        match stand in the steps before it, mostly in the last ones."""
        joined = lambda s, first, n: F.array_join(F.slice(s, first, n), "")
        near = lambda s, i: joined(s, F.greatest(i - _STEPS + 2, F.lit(1)), F.least(i + 1, F.lit(_STEPS)))
        words = lambda s, i: let(let(near(s, i), lambda t: _last_words(t, window)), lambda w: F.when((F.size(w) > window) | (i < _STEPS), w).otherwise(let(joined(s, F.lit(1), i + 1), lambda t: _last_words(t, window))))
        place = lambda s: F.array_position(F.transform(x["m"], lambda _, i: _denied(words(s, i), triggers, window)), False).cast("int")
        start = lambda s, k: F.aggregate(F.slice(s, F.lit(1), k), F.lit(0), lambda a, t: a + F.length(t))
        steps = F.transform(x["p"], lambda p, i: F.concat(F.when(i > 0, F.get(x["m"], i - 1)).otherwise(""), p))
        return let(steps, lambda s: let(place(s), lambda k: F.when(k > 0, found(start(s, k), F.get(x["m"], k - 1)))))

    every = F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("m"), F.split(text, pattern).alias("p"))
    first = lambda before: F.when(_denied(_last_words(before, window), triggers, window), let(every, later)).otherwise(found(F.length(before), F.regexp_substr(text, pattern)))
    return let(F.split(text, pattern, F.lit(2)), lambda parts: F.when(F.size(parts) > 1, let(parts[0], first)))


def certainty(text: Column, start: Column, window: int = 70, rumors: Sequence[str] = RUMOR_MARKERS, estimates: Sequence[str] = ESTIMATE_MARKERS) -> Column:
    """rumored, estimated or confirmed, by the markers within `window` signs of a place; rumours win."""
    first = F.greatest(start - window, F.lit(0))
    near = F.lower(F.substring(text, first + 1, start + window - first))
    some = lambda marks: F.exists(F.array(*(F.lit(m) for m in marks)), lambda m: F.contains(near, m))
    return F.when(some(rumors), "rumored").when(some(estimates), "estimated").otherwise("confirmed")


def context(text: Column, start: Column, end: Column, radius: int = 60) -> Column:
    """The lower-cased text from `radius` signs before a place to `radius` after it."""
    first = F.greatest(start - radius, F.lit(0))
    return F.lower(F.substring(text, first + 1, end + radius - first))


#: Signals with their patterns and confidences, in order of preference: fixed values.
KEYWORD_SIGNALS = {
    "ANNIVERSARY": ((r"\b\d+(?:st|nd|rd|th)\s+anniversary\b", 85), (r"\banniversary\s+(?:edition|release|product|collection)\b", 80), (r"\banniversary\b", 60)),
    "EXCLUSIVE_PROMO": ((r"\bexclusive\s+promo(?:tional)?\b", 85), (r"\bexclusive\s+promotional\s+(?:card\s+)?packs?\b", 90)),
    "PROMOTIONAL_PACK": ((r"\bpromotional\s+(?:card\s+)?packs?\b", 80), (r"\bpromo\s+packs?\b", 75), (r"\bpromo\s+cards?\b", 65)),
    "FIRST_EDITION": ((r"\bfirst\s+edition\b", 85),),
    "FIRST_COLLABORATION": ((r"\bfirst[\s-](?:ever\s+)?collaboration\b", 85), (r"\bfirst[\s-]time\s+collaborat\w*\b", 80)),
    "EXCLUSIVE_ARTWORK": ((r"\bexclusive\s+art(?:work)?\b", 80), (r"\bunique\s+artwork\b", 70)),
    "EXCLUSIVE_CHARACTER": ((r"\bexclusive\s+character\b", 80), (r"\bcharacter[\s-]exclusive\b", 80)),
    "EVENT_EXCLUSIVE": ((r"\bevent[\s-]exclusive\b", 85), (r"\bonly\s+available\s+at\s+the\s+event\b", 85), (r"\bexclusive\s+to\s+(?:the\s+)?event\b", 80)),
    "CONVENTION_EXCLUSIVE": ((r"\bconvention[\s-]exclusive\b", 85), (r"\bcon[\s-]exclusive\b", 75)),
    "TOURNAMENT_EXCLUSIVE": ((r"\btournament[\s-]exclusive\b", 85), (r"\btournament[\s-]only\b", 80), (r"\btournament\s+promo\b", 75)),
    "RETAILER_EXCLUSIVE": ((r"\bretailer[\s-]exclusive\b", 85), (r"\bavailable\s+exclusively\s+at\b", 80), (r"\bparticipating\s+[A-Z][\w'&]*\s+locations\b", 75), (r"\bexclusive\s+to\s+[A-Z][\w'&]*\b", 65)),
    "REGION_EXCLUSIVE": ((r"\bregion(?:al)?[\s-]exclusive\b", 80), (r"\bavailable\s+only\s+in\b", 65)),
    "MEMBERSHIP_EXCLUSIVE": ((r"\bmembers?[\s-]only\b", 85), (r"\bmembership[\s-](?:required|exclusive)\b", 85), (r"\bfor\s+members\s+only\b", 85)),
    "LOTTERY_REQUIRED": ((r"\blottery\b", 80), (r"\braffle\b", 75), (r"\bentered\s+into\s+a\s+drawing\b", 70), (r"\bdrawing\s+to\s+win\b", 70)),
    "EVENT_ATTENDANCE_REQUIRED": ((r"\bmust\s+attend\b", 80), (r"\battendance\s+required\b", 85), (r"\bonly\s+available\s+to\s+attendees\b", 85), (r"\bin[\s-]person\s+only\b", 70)),
    "BUNDLE_REQUIRED": ((r"\bbundle\s+required\b", 85), (r"\bonly\s+available\s+as\s+a\s+bundle\b", 85), (r"\bmust\s+(?:purchase|buy)\s+as\s+a\s+bundle\b", 80), (r"\bbundled\s+with\b", 60)),
    "REDEEMABLE_REWARD": ((r"\bredeem(?:able)?\b", 70), (r"\bredemption\b", 70), (r"\breward\s+for\b", 60), (r"\breceive\s+as\s+a\s+reward\b", 70)),
    "STATUS_LIVE": ((r"\bavailable\s+now\b", 75), (r"\bnow\s+available\b", 75), (r"\bon\s+sale\s+now\b", 75), (r"\blaunches\s+today\b", 70)),
    "STATUS_SOLD_OUT": ((r"\bsold\s+out\b", 85), (r"\bout\s+of\s+stock\b", 80)),
    "STATUS_RESTOCKED": ((r"\brestocked\b", 80), (r"\bback\s+in\s+stock\b", 80), (r"\brestock\s+announced\b", 80)),
    "LOW_STOCK": ((r"\blow\s+stock\b", 75), (r"\bfew\s+remaining\b", 65), (r"\balmost\s+sold\s+out\b", 70), (r"\blimited\s+stock\s+remaining\b", 70)),
    "RAPID_SELLOUT": ((r"\bsold\s+out\s+within\b", 90), (r"\bsold\s+out\s+in\s+minutes\b", 90), (r"\bsold\s+out\s+immediately\b", 85), (r"\bsold\s+out\s+fast\b", 75), (r"\bsold\s+quickly\b", 65)),
    "HIGH_DEMAND": ((r"\bhigh\s+demand\b", 70), (r"\bin\s+high\s+demand\b", 70), (r"\bhighly\s+sought[\s-]after\b", 70), (r"\bflying\s+off\s+the\s+shelves\b", 75)),
    "RISING_DEMAND": ((r"\bdemand\s+is\s+rising\b", 70), (r"\brising\s+demand\b", 70), (r"\bgrowing\s+interest\b", 60)),
    "SURGING_DEMAND": ((r"\bdemand\s+is\s+surging\b", 80), (r"\bsurging\s+demand\b", 80), (r"\brapid(?:ly)?\s+(?:growing|rising)\s+demand\b", 75)),
    "COMMUNITY_HYPE": ((r"\bcollectors?\s+(?:are|is)\s+excited\b", 70), (r"\bcommunity\s+(?:demand|buzz|hype)\b", 70), (r"\bhype\b", 55), (r"\bbuzz\b", 50)),
    "SEALED_PRODUCT": ((r"\bfactory\s+sealed\b", 80), (r"\bstill\s+sealed\b", 75), (r"\bsealed\s+product\b", 75), (r"\bunopened\b", 60)),
}


def detect_signals(docs: DataFrame, table: Mapping[str, Sequence[tuple[str, int]]] = KEYWORD_SIGNALS, triggers: Sequence[str] = NEGATIONS) -> DataFrame:
    """(seq, signal, confidence, start, end, match, certainty, context): for each signal the first match that isn't
    negated of the first pattern that has one, with that pattern's confidence. docs has seq and text."""
    text = F.col("text")
    some = text.rlike("(?i)" + "|".join(f"(?:{p})" for patterns in table.values() for p, _ in patterns))
    rules = F.array(*(F.struct(F.lit(signal).alias("signal"), F.lit(confidence).alias("confidence"), F.lit("(?i)" + p).alias("pattern")) for signal, patterns in table.items() for p, confidence in patterns))
    place = lambda r: F.try_element_at(F.filter(placed(text, r["pattern"]), lambda m: ~negated(text, m["start"], triggers)), F.lit(1))
    hits = F.transform(F.filter(rules, lambda r: F.regexp_like(text, r["pattern"])), lambda r: F.struct(r["signal"].alias("signal"), r["confidence"].alias("confidence"), place(r).alias("m")))
    first = let(F.filter(hits, lambda h: h["m"].isNotNull()), lambda all_hits: F.filter(all_hits, lambda h, i: F.array_position(F.transform(all_hits, lambda x: x["signal"]), h["signal"]) == i + 1))
    rows = docs.where(some).select("seq", "text", F.explode(first).alias("d"))
    start, end = F.col("d.m.start"), F.col("d.m.end")
    return rows.select("seq", "d.signal", "d.confidence", start.alias("start"), end.alias("end"), "d.m.match", certainty(text, start).alias("certainty"), context(text, start, end).alias("context"))


def detect_keywords(docs: DataFrame, rules: Sequence[tuple[str, int, tuple[str, ...]]], triggers: Sequence[str] = NEGATIONS, rumors: Sequence[str] = RUMOR_MARKERS, estimates: Sequence[str] = ESTIMATE_MARKERS) -> DataFrame:
    """(seq, signal, confidence, start, end, match, certainty): for each rule (signal, confidence, patterns) the first
    match that isn't negated of the first pattern that has one. docs has seq and text; null texts have no signals."""
    text = F.col("text")
    every = F.array(*(F.struct(F.lit(signal).alias("signal"), F.lit(confidence).alias("confidence"), F.array(*(F.lit("(?i)" + p) for p in patterns)).alias("patterns")) for signal, confidence, patterns in rules))
    first = lambda patterns: F.get(F.filter(F.transform(patterns, lambda p: first_match(text, p, triggers)), lambda m: m.isNotNull()), F.lit(0))
    hits = F.transform(every, lambda r: F.struct(r["signal"].alias("signal"), r["confidence"].alias("confidence"), first(r["patterns"]).alias("hit")))
    # explode() would make Spark look for hits twice, once to leave out rows without.
    rows = docs.where(text.isNotNull()).select("seq", "text", F.explode_outer(hits).alias("d")).where("d.hit is not null")
    return rows.select("seq", "d.signal", "d.confidence", "d.hit.*", certainty(text, F.col("d.hit.start"), 70, rumors, estimates).alias("certainty"))


#: Forms of amounts and words of their roles: fixed values.
_AMOUNT = r"\d[\d,]*(?:\.\d{1,2})?"
CURRENCIES = {
    "USD": rf"\$\s?{_AMOUNT}|USD\s?{_AMOUNT}|{_AMOUNT}\s?USD",
    "EUR": rf"€\s?{_AMOUNT}|{_AMOUNT}\s?(?:EUR|euros?)",
    "GBP": rf"£\s?{_AMOUNT}|{_AMOUNT}\s?(?:GBP|pounds?)",
    "JPY": r"¥\s?\d[\d,]*|\d[\d,]*\s?(?:JPY|yen)",
}
PRICE = "(?i)" + "|".join(CURRENCIES.values())
PRICE_ROLES = (
    ("resale", ("resale", "resold", "reselling", "secondary market", "selling for", "sold for", "going for", "sell for", "sets are selling")),
    ("spend", ("spend", "spent", "spending", "required to spend", "purchase", "purchases", "eligible")),
    ("retail", ("retail", "msrp", "price is", "priced at", "costs", "cost is", "sticker price")),
)


def detect_prices(docs: DataFrame, roles: Sequence[tuple[str, tuple[str, ...]]] = PRICE_ROLES, window: int = 45, pattern: str = PRICE) -> DataFrame:
    """(seq, start, end, match, amount, currency, role, context): each amount with the role whose word lies nearest, from
    middle to middle, within `window` signs on both sides; on ties the first role; 'price' if there is none."""
    rows = docs.where("text is not null").select("seq", "text", F.explode(placed(F.col("text"), F.lit(pattern))).alias("m"))
    start, end = F.col("m.start"), F.col("m.end")
    near = context(F.col("text"), start, end, window)
    middle = (start + end) / 2 - F.greatest(start - window, F.lit(0))
    words = F.array(*(F.struct(F.lit(role).alias("role"), F.lit(i).alias("i"), F.lit(w).alias("word")) for i, (role, w) in enumerate((r, w) for r, each in roles for w in each)))
    away = lambda w: F.array_min(F.transform(placed(near, F.concat(F.lit("\\Q"), w["word"], F.lit("\\E"))), lambda m: F.abs((m["start"] + m["end"]) / 2 - middle)))
    nearest = F.array_min(F.filter(F.transform(words, lambda w: F.struct(away(w).alias("away"), w["i"].alias("i"), w["role"].alias("role"))), lambda x: x["away"].isNotNull()))
    amount = F.regexp_replace("m.match", r"[^\d.]", "").cast("double")
    currency = F.coalesce(*(F.when(F.col("m.match").rlike(f"(?i)^(?:{p})$"), name) for name, p in CURRENCIES.items()))
    return rows.select("seq", start.alias("start"), end.alias("end"), "m.match", amount.alias("amount"), currency.alias("currency"), F.coalesce(nearest["role"], F.lit("price")).alias("role"), context(F.col("text"), start, end).alias("context"))


def doc_signals(detections: DataFrame, weights: dict[str, int], barriers: Sequence[str] = ()) -> DataFrame:
    """For each document: relevance (sum over signals of the largest weight times confidence in percent, 0 to 100), mean
    confidence, signals (sorted), and whether two or more barriers that are no rumours make it hard to get."""
    weight = F.coalesce(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))[F.col("signal")], F.lit(0))
    best = detections.groupBy("seq", "signal").agg(F.max(weight * F.col("confidence")).alias("points"), F.sum("confidence").alias("c"), F.count("*").alias("n"), F.bool_or(F.col("certainty") != "rumored").alias("firm"))
    hard = F.count_if(F.col("signal").isin(*barriers) & F.col("firm")) >= 2 if barriers else F.lit(False)
    return best.groupBy("seq").agg(
        F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.sum("points") / 100)).alias("relevance"), F.floor(F.sum("c") / F.sum("n")).cast("long").alias("mean_confidence"), F.array_join(F.array_sort(F.collect_set("signal")), ",").alias("signals"), hard.alias("hard_to_get")
    )


#: Signals that tell a price, a state of sale, and pairs that contradict each other: fixed values.
PRICE_SIGNALS = ("SPEND_REQUIREMENT", "RETAIL_PRICE", "OBSERVED_RESALE_PRICE")
STATUS_SIGNALS = ("STATUS_LIVE", "STATUS_SOLD_OUT", "STATUS_RESTOCKED", "RELEASE_DATE", "PURCHASE_WINDOW")
STATUS_CONFLICTS = (("STATUS_SOLD_OUT", "STATUS_LIVE"), ("STATUS_SOLD_OUT", "STATUS_RESTOCKED"))


def doc_gaps(detections: DataFrame, identified: DataFrame) -> DataFrame:
    """For each document that `identified` has (seq, has_identity): missing (what no signal tells: product_identity,
    pricing_information, release_or_availability_status) and warnings (pairs of signals that contradict each other, and
    RUMOR_WITHOUT_IDENTITY). Documents without detections have no warnings."""
    seen = detections.groupBy("seq").agg(F.collect_set("signal").alias("seen"))
    have = F.coalesce("seen", F.array().cast("array<string>"))
    some = lambda names: F.arrays_overlap(have, F.array(*(F.lit(n) for n in names)))
    known = F.coalesce("has_identity", F.lit(False))
    missing = F.array(F.when(~known, "product_identity"), F.when(~some(PRICE_SIGNALS), "pricing_information"), F.when(~some(STATUS_SIGNALS), "release_or_availability_status"))
    clashes = [F.when(some((a,)) & some((b,)), f"{a}/{b}") for a, b in STATUS_CONFLICTS]
    warnings = F.array(*clashes, F.when(~known & some(("RUMOR",)), "RUMOR_WITHOUT_IDENTITY"))
    return identified.join(seen, "seq", "left").select("seq", F.array_compact(missing).alias("missing"), F.array_compact(warnings).alias("warnings"))


def accept_docs(signals: DataFrame, threshold: float, strong: Sequence[tuple[str, ...]], alone: Sequence[str], weak: Sequence[str]) -> DataFrame:
    """Add accepted: not if there are only weak signals; else if a strong combination is there, if a signal that counts
    alone is there and relevance reaches 0.6 of the threshold, or if relevance reaches the threshold."""
    have = F.split("signals", ",")
    only_weak = F.size(F.array_except(have, F.array(*(F.lit(w) for w in weak)))) == 0
    combo = F.lit(False)
    for names in strong:
        combo = combo | (F.size(F.array_except(F.array(*(F.lit(n) for n in names)), have)) == 0)
    single = F.arrays_overlap(have, F.array(*(F.lit(a) for a in alone))) & (F.col("relevance") >= 0.6 * threshold)
    return signals.withColumn("accepted", ~only_weak & (combo | single | (F.col("relevance") >= threshold)))


def draft_opportunities(detections: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row for each document with the match of its first detection of each signal as a column."""
    first = [F.min_by("match", F.when(F.col("signal") == f, F.col("start"))).alias(f) for f in fields]
    return detections.where(F.col("signal").isin(*fields)).groupBy("seq").agg(*first)


#: Number words, months and patterns of quantities and dates: fixed values.
WORD_NUMBERS = {"a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12}
_WORDS = "|".join(WORD_NUMBERS)
QUANTITIES = {
    "limited_quantity": (rf"limited to\s+([\d,]+|{_WORDS})\s*(?:pieces|units|copies|pairs)?", r"only\s+([\d,]+)\s*(?:pieces|units|copies|available|made|produced)", r"([\d,]+)\s*(?:pieces|units|copies)\s+(?:only|limited)"),
    "purchase_limit": (r"limit\s+(?:of\s+)?(\d+)\s*per\s*(?:customer|order|household|person)", r"(?:maximum|max)\s+of\s+(\d+)\s*per\s*(?:customer|order|household|person)", r"(\d+)\s*per\s*(?:customer|order|household|person)\s*(?:limit)?"),
    "pack_quantity": (rf"(?:receive|get|includes?)\s+({_WORDS}|\d+)\s+(?:exclusive\s+|promotional\s+)*(?:promotional\s+)?(?:card\s+)?packs?",),
    "numbered": (r"\bindividually numbered\b()", r"\bnumbered\b()", r"#\d+\s*/\s*\d+()", r"\bserial number(?:ed)?\b()"),
}
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
DATES = {
    "date": rf"\b(?:{MONTHS})\s+\d{{1,2}}(?:st|nd|rd|th)?(?:,?\s+\d{{4}})?\b",
    "window": rf"\b(?:{MONTHS})\s+\d{{1,2}}(?:st|nd|rd|th)?\s+(?:through|to|until|-|–)\s+(?:(?:{MONTHS})\s+)?\d{{1,2}}(?:st|nd|rd|th)?\b",
    "duration": r"within\s+\d+\s*(?:minutes?|hours?|days?|seconds?)",
    "time": r"\b\d{1,2}(?::\d{2})?\s*(?:AM|PM|am|pm)\b",
}


def number_of(text: Column) -> Column:
    """A number in digits (with commas) or as a word up to twelve; null for others."""
    words = F.create_map(*(F.lit(x) for kv in WORD_NUMBERS.items() for x in kv))
    return F.coalesce(F.replace(text, F.lit(","), F.lit("")).try_cast("int"), words[F.lower(F.trim(text))])


def detect_quantities(docs: DataFrame, patterns: dict[str, tuple[str, ...]] = QUANTITIES) -> DataFrame:
    """(seq, kind, start, match, value): for each kind the first match that isn't negated, pattern by pattern. Kinds
    without a number in their patterns have no value. docs has seq and text."""
    text, found = F.col("text"), []
    for kind, each in patterns.items():
        first = []
        for p in each:
            hit = F.try_element_at(F.filter(placed(text, F.lit("(?i)" + p)), lambda m: ~negated(text, m["start"])), F.lit(1))
            value = number_of(F.regexp_extract(hit["match"], "(?i)" + p, 1))
            first.append(F.when(hit.isNotNull(), F.struct(F.lit(kind).alias("kind"), hit["start"].alias("start"), hit["match"].alias("match"), value.alias("value"))))
        found.append(F.when(text.rlike("(?i)" + "|".join(f"(?:{p})" for p in each)), F.coalesce(*first)))
    return docs.where(text.isNotNull()).select("seq", F.explode(F.array_compact(F.array(*found))).alias("d")).select("seq", "d.*")


def detect_dates(docs: DataFrame, patterns: dict[str, str] = DATES) -> DataFrame:
    """(seq, kind, start, match): all dates; the first window, duration and time. docs has seq and text."""
    text = F.coalesce("text", F.lit(""))
    tagged = lambda kind, hits: F.transform(hits, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["match"].alias("match")))
    every = [tagged(k, placed(text, F.lit("(?i)" + p)) if k == "date" else F.slice(placed(text, F.lit("(?i)" + p)), 1, 1)) for k, p in patterns.items()]
    return docs.select("seq", F.explode(F.concat(*every)).alias("d")).select("seq", "d.*")
