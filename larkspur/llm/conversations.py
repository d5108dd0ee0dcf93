"""Conversation structure repair: faults of conversations and the cheapest edits that give alternating roles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm import repair_grammar as grammar
from larkspur.llm.common import cut, light_batches

#: Rows of a span that one call parses, and spans that one call joins, are 2 to this power at most.
SPAN = 8

_SOLID = r"[^\x20\x09-\x0D]"
_CELL = "array<struct<p:int,q:int,cost:long,audit:string>>"


def conversation_key(conv_id: Column) -> Column:
    """A text that stands for a conversation, also for that of rows without an id."""
    return F.when(conv_id.isNull(), "-").otherwise(F.concat(F.lit("="), conv_id.cast("string")))


def _cell_of(rows: list) -> grammar.Cell:
    return {(r["p"], r["q"]): (r["cost"], r["audit"]) for r in rows}


def _rows_of(cell: grammar.Cell) -> list[dict]:
    return [{"p": p, "q": q, "cost": cost, "audit": audit} for (p, q), (cost, audit) in cell.items()]


def _parse_rows(codes: pd.Series) -> pd.Series:
    """Cells of rows, each given by two letters: its role's initial (`_` if there is none) and its fault."""
    known: dict[str, list[dict]] = {}
    for text in codes.unique():
        cells = [grammar.row_cell(text[i].strip("_"), "x" if text[i + 1] in "bd" else text[i + 1]) for i in range(0, len(text), 2)]
        known[text] = _rows_of(grammar.parse(cells))
    return codes.map(known)


def _join_spans(spans: pd.Series) -> pd.Series:
    return spans.map(lambda cells: _rows_of(grammar.parse([_cell_of(c["cell"]) for c in cells])))


def _cheapest(cells: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([grammar.cheapest(_cell_of(c)) for c in cells], columns=["cost", "audit"])


def _illegal(before: Column, after: Column) -> Column:
    return (~F.concat(before, after).isin("su", "ua", "au")).cast("long")


def in_order(rows: DataFrame) -> DataFrame:
    """key, pos, turn, role and text of all rows: pos rises with turn (nulls first), then role and text, inside a conversation.

    One sort of the table by ranges, so a long conversation lies in many partitions; only rows that are equal in all
    columns stay together. Null roles and texts are one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    kept = rows.select(conversation_key(F.col("conv_id")).alias("key"), F.col("turn").cast("long").alias("turn"), blank("role"), blank("text"))
    return cut(kept.orderBy("key", F.col("turn").asc_nulls_first(), "role", "text").withColumn("pos", F.monotonically_increasing_id()))


def faults(placed: DataFrame) -> DataFrame:
    """key, pos, initial (of the role; `o` for others than s, u and a, `_` for none) and fault of rows of in_order: b (blank), d (role
    and text stand earlier in the conversation), t (the last solid character isn't one of .!?) or -, the first that
    holds."""
    mark = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    last = F.regexp_extract("text", rf"({_SOLID})[\x20\x09-\x0D]*\z", 1)
    own = F.when(~F.col("text").rlike(_SOLID), "b").when(~last.isin(".", "!", "?"), "t").otherwise("-")
    first = F.substring("role", 1, 1)
    initial = F.when(first.isin("s", "u", "a"), first).when(first == "", "_").otherwise("o")
    light = cut(placed.select("key", "pos", initial.alias("initial"), own.alias("own"), mark.alias("mark")))
    again = light.groupBy("key", "mark").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    fault = F.when((F.col("own") != "b") & (F.col("pos") > F.col("first")), "d").otherwise(F.col("own"))
    return light.join(again, ["key", "mark"], "left").select("key", "pos", "initial", fault.alias("fault"))


def diagnose(placed: DataFrame) -> DataFrame:
    """key, gaps, blank, duplicate, truncated, illegal, cost and audit of each conversation that has rows (of in_order).

    Spans of up to 256 neighbouring rows are parsed first, then spans of spans until each conversation is one."""
    found = faults(placed)
    count = lambda fault: F.count_if(F.col("fault") == fault)
    rows = F.array_sort(F.collect_list(F.struct("pos", "initial", "fault")))
    spans = found.groupBy("key", F.shiftright("pos", SPAN).alias("span")).agg(count("b").alias("blank"), count("d").alias("duplicate"), count("t").alias("truncated"), rows.alias("rows"))
    initials, codes = F.transform("rows", lambda r: r["initial"]), F.array_join(F.transform("rows", lambda r: F.concat(r["initial"], r["fault"])), "")
    spans = spans.select("key", "span", "blank", "duplicate", "truncated", initials.alias("initials"), F.pandas_udf(_parse_rows, _CELL)(codes).alias("cell"))
    begin, end = F.element_at("initials", 1), F.element_at("initials", -1)
    spans = cut(spans.select("key", "span", "blank", "duplicate", "truncated", _pairs("initials").alias("illegal"), begin.alias("begin"), end.alias("end"), "cell"))
    while spans.groupBy("key").count().where("count > 1").limit(1).count():
        spans = cut(_join_level(spans))
    turns = placed.select("key", "turn").distinct().groupBy("key").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    best = spans.select("key", "blank", "duplicate", "truncated", "illegal", F.pandas_udf(_cheapest, "cost long, audit string")("cell").alias("best"))
    return best.join(turns, "key").select("key", F.coalesce("gaps", F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "best.cost", "best.audit")


def _pairs(initials: str) -> Column:
    """Neighbours of an array of initials that may not follow each other."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("string").alias("last"))
    step = lambda s, x: F.struct((s["n"] + F.when(s["last"].isNull(), 0).otherwise(_illegal(s["last"], x))).alias("n"), x.alias("last"))
    return F.aggregate(initials, start, step)["n"]


def _join_level(spans: DataFrame) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")]
    parts = F.array_sort(F.collect_list(F.struct("span", "begin", "end", "cell")))
    joined = spans.groupBy("key", F.shiftright("span", SPAN).alias("wide")).agg(*sums, parts.alias("parts"))
    inner = F.zip_with(F.slice("parts", F.lit(1), F.size("parts") - 1), F.slice("parts", F.lit(2), F.size("parts")), lambda a, b: _illegal(a["end"], b["begin"]))
    between = F.aggregate(inner, F.lit(0).cast("long"), lambda n, x: n + x)
    cells = F.transform("parts", lambda p: F.struct(p["cell"].alias("cell")))
    return joined.select(
        "key",
        F.col("wide").alias("span"),
        "blank",
        "duplicate",
        "truncated",
        (F.col("illegal") + between).alias("illegal"),
        F.element_at("parts", 1)["begin"].alias("begin"),
        F.element_at("parts", -1)["end"].alias("end"),
        F.pandas_udf(_join_spans, _CELL)(cells).alias("cell"),
    )


def _edited(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, str | None, str | None]]:
    """(key, role, text) of repaired rows from sorted batches in which each conversation's audit stands before its rows; a
    row without role and text begins a conversation."""
    key, audit, at, last = None, "", 0, ""

    def inserts() -> Iterator[tuple[str, str, str]]:
        nonlocal at, last
        while at < len(audit) and audit[at] == "I":
            last = "a" if last == "u" else "u"
            at += 1
            yield key, "assistant" if last == "a" else "user", ""

    for batch in batches:
        for now, role, text, edits in zip(batch["key"], batch["role"], batch["text"], batch["audit"], strict=True):
            if edits is not None:
                yield from inserts()
                key, audit, at, last = now, edits, 0, ""
                yield key, None, None
                continue
            yield from inserts()
            edit = audit[at]
            at += 1
            if edit == "R":
                last = "a" if last == "u" else "u"
                yield key, "assistant" if last == "a" else "user", text
            elif edit == "K":
                last = role[:1] or last
                yield key, role, text
    yield from inserts()


def _with_audits(placed: DataFrame, audits: DataFrame) -> DataFrame:
    light_batches(placed.sparkSession, 500)
    heads = audits.select("key", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "audit")
    rows = placed.select("key", "pos", "role", "text", F.lit(None).cast("string").alias("audit")).unionByName(heads)
    return rows.repartition("key").sortWithinPartitions("key", "pos")


def repaired(placed: DataFrame, audits: DataFrame) -> DataFrame:
    """key, place (from 0), role and text of the rows after the edits of `audits` (key, audit). A conversation's rows go
    through one task as a stream, in order; only its audit and a batch of rows are held."""

    def edit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, place = [], 0
        for key, role, text in _edited(batches):
            place = 0 if role is None else place + 1
            if role is not None:
                out.append((key, place - 1, role, text))
            if len(out) >= 1000:
                yield pd.DataFrame(out, columns=["key", "place", "role", "text"], dtype=object)
                out = []
        yield pd.DataFrame(out, columns=["key", "place", "role", "text"], dtype=object)

    return _with_audits(placed, audits).mapInPandas(edit, "key string, place long, role string, text string")


def repaired_digests(placed: DataFrame, audits: DataFrame) -> DataFrame:
    """key and repaired_sha256, the digest of `role:text` of all rows of `repaired`, joined by newlines, for each audit."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, key, state, lines = [], None, None, 0
        for now, role, text in _edited(batches):
            if role is None:
                if state is not None:
                    out.append((key, state.hexdigest()))
                key, state, lines = now, hashlib.sha256(), 0
                if len(out) >= 10_000:
                    yield pd.DataFrame(out, columns=["key", "repaired_sha256"], dtype=object)
                    out = []
                continue
            state.update(("\n" if lines else "").encode() + f"{role}:{text}".encode())
            lines += 1
        if state is not None:
            out.append((key, state.hexdigest()))
        yield pd.DataFrame(out, columns=["key", "repaired_sha256"], dtype=object)

    return _with_audits(placed, audits).mapInPandas(hashed, "key string, repaired_sha256 string")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A report on each conversation of `rows` (conv_id, turn, role, text) and its rows after the cheapest repair.

    The report has key (conversation_key of conv_id), gaps (turns missing between the least and the greatest), blank,
    duplicate and truncated (rows by their first fault), illegal (neighbours whose roles may not follow each other), cost
    and audit (a letter for each edit; of equally cheap ones the least). The repaired rows have key, place, role
    and text. Rows of a turn are taken by role and text, a null turn comes first, null roles and texts are one space,
    rows without conv_id are one conversation, equal rows are duplicates; no rows give no rows. Other columns are not
    read.
    """
    placed = in_order(rows)
    report = cut(diagnose(placed))
    return report, repaired(placed, report)


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after a fault that the row's id and turn choose: a row may go, lose its text or its
    marks of sentence ends, come twice, or become the user's. Nulls of role and text become one space."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text_of("text"), ".!?", "")).otherwise(text_of("text"))
    role = F.when(kind == 4, "user").otherwise(text_of("role"))
    copies = F.when(kind == 0, F.array().cast("array<int>")).when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def repair_report(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """The report of `repair` with repaired_sha256 for each conv_id of `conversations`; one without rows has zeros, an empty
    audit and the digest of the empty text."""
    placed = in_order(rows)
    report = cut(diagnose(placed))
    digests = repaired_digests(placed, report)
    ids = conversations.select("conv_id").distinct().withColumn("key", conversation_key(F.col("conv_id")))
    found = ids.join(report.join(digests, "key"), "key", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
