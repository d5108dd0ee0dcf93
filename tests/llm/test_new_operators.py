"""Conversation repair, the dataset manifest and byte-level BPE against plain Python."""

import hashlib
import heapq
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from larkspur.llm import byte_pairs, conversations, queries, simhash, url_rules
from larkspur.llm import repair_grammar as grammar
from larkspur.llm.bitmap_ranks import bitmap_ranks
from larkspur.llm.merge_replay import MergeReplay

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


# Byte-level BPE


@pytest.fixture(scope="module")
def ranks():
    return byte_pairs.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rng = random.Random(5)
    letters = [chr(c) for c in range(0x20, 0x250)] + list("\x1c\x1d\x1e\x1f\x85\xa0 　​漢字かな😀é́\t\n\r  '") * 6
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(400)]
    texts += ["".join(rng.choice("abcthe ing") for _ in range(rng.randrange(400))) for _ in range(100)]
    return [None, "", " ", "\n\n", "a" * 20_000, " " * 700, "the" * 500, "don't I'll <|endoftext|>", "The same", "The same", *texts, " ".join(texts)]


def test_byte_pairs_match_the_library(spark, ranks, library):
    rows = list(enumerate(odd_texts())) + [(3, "again"), (2**60 + 1, "large id"), (None, "no id"), (None, None)]
    docs = spark.createDataFrame([(i, t, 7, b"x") for i, t in rows], "doc_id long, text string, n_tokens int, ids binary")
    got = byte_pairs.encode_documents(docs, ranks, public_tokenizers.PATTERN).collect()
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), struct.pack(f"<{len(ids)}I", *ids), (t or "").encode()))
    assert Counter((r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in got) == Counter(want)
    assert byte_pairs.encode_documents(docs.limit(0), ranks, public_tokenizers.PATTERN).count() == 0


def test_words_beyond_the_shared_ones(spark, ranks, library, monkeypatch):
    monkeypatch.setattr(byte_pairs, "SHARED_WORDS", 3)
    monkeypatch.setattr(byte_pairs, "HELD_WORDS", 5)
    monkeypatch.setattr(byte_pairs, "HELD_CHARS", 100)
    monkeypatch.setattr(byte_pairs, "COUNTED_WORDS", 10)
    rows = list(enumerate(odd_texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(byte_pairs.shared_words(docs, ranks, public_tokenizers.PATTERN)) == 3
    got = {r.doc_id: bytes(r.ids) for r in byte_pairs.encode_documents(docs, ranks, public_tokenizers.PATTERN).collect()}
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        assert got[i] == struct.pack(f"<{len(ids)}I", *ids)


def test_merges_whose_pairs_have_lower_ranks():
    """Vocabularies in which a merge makes a pair of a lower rank than its own, against one merge at a time."""
    rng = random.Random(11)
    for _ in range(60):
        tokens = {bytes([b]): b for b in range(256)}
        some = {"".join(rng.choice("abc") for _ in range(rng.randrange(2, 5))) for _ in range(14)}
        for rank, token in enumerate(rng.sample(sorted(some), len(some)), 256):
            tokens[token.encode()] = rank
        words = ["".join(rng.choice("abc") for _ in range(rng.randrange(0, 30))).encode() for _ in range(40)]
        for word, got in zip(words, MergeReplay(tokens).encode(words), strict=True):
            parts = [bytes([b]) for b in word]
            if word in tokens:
                parts = [word]
            while True:
                pairs = [(tokens[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in tokens]
                if not pairs:
                    break
                _, i = min(pairs)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            assert got == [tokens[p] for p in parts]


# Dataset manifest


def brute_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text); a Counter of result rows."""
    join = lambda nodes: sha("".join(nodes))
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: sha("".join(map(field, (r[0], r[1], r[2], r[3], text))))

    def tree(nodes):
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, i in enumerate(at):
                run = nodes[i // 8 * 8 : i // 8 * 8 + 8]
                paths[k].append(("".join(run[: i % 8]), "".join(run[i % 8 + 1 :])))
            at = [i // 8 for i in at]
            nodes = [join(nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
        return paths, nodes[0]

    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((-(2**63) if r[0] is None else r[0], leaf(r, r[4]), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    inner = {g: tree([x[1] for x in sorted(groups[g], key=lambda x: x[:2])]) for g in order}
    upper, root = tree([inner[g][1] for g in order])
    out = Counter()
    for g, above in zip(order, upper):
        paths, subroot = inner[g]
        for (_, own, r), path in zip(sorted(groups[g], key=lambda x: x[:2]), paths):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            text = r[4].translate({c: c + 32 for c in range(65, 91)}) if tampered and r[4] is not None else r[4]
            folded = leaf(r, text)
            for left, right in path + above:
                folded = join((left, folded, right))
            out[(r[0], own, subroot, root, join(a + b for a, b in path + above), folded, folded == root)] += 1
    return out


def manifest_rows(n, seed):
    rng = random.Random(seed)
    texts = [None, "", "a", "Ab Ü漢", "Same Text", "lower only", "X" * 5000]
    return [(rng.randrange(-(2**40), 2**40) if rng.random() < 0.5 else i * 3, rng.choice(["s", None, "é"]), rng.choice(["en"] * 8 + ["de", None, "", "日"]), rng.choice([None, 3, -1]), rng.choice(texts)) for i in range(n)]


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(1, "s", "en", 1, "One")],
        [(None, None, None, None, None)] * 3,
        [(5, "s", "en", 1, "Same")] * 20 + [(5, "s", "en", 1, t) for t in "ABCDEFGHIJ"] + [(i, "s", "de", 1, "T") for i in range(9)],
        manifest_rows(700, 1) + [(None, "s", "en", 1, f"T{i % 7}") for i in range(40)] + [(7, "s", "en", 1, f"Z{i}") for i in range(30)] + [(2**63 - 1, "s", "en", 1, "max"), (-(2**63), "s", "en", 1, "min"), (64, "s", "en", 1, "a"), (127, "s", "en", 1, "B")],
    ],
)
def test_manifest_matches_plain_python(spark, tmp_path, rows):
    docs = spark.createDataFrame([(*r, 1, "n", 2) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, pos int, node string, g int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(tuple(r) for r in queries.op12_manifest(spark, str(tmp_path)).collect())
    assert got == (brute_manifest(rows) if rows else Counter())


def test_ranks_of_bitmaps(spark):
    rng = random.Random(2)
    rows = [(g, rng.choice([rng.randrange(200), rng.randrange(-(2**62), 2**62)]), 1 + rng.randrange(3)) for g in "ab" for _ in range(500)]
    got = bitmap_ranks(spark.createDataFrame(rows, "g string, k long, w long"), ["g"], "k", "w").collect()
    for r in got:
        own = [(k, w) for g, k, w in rows if g == r.g]
        assert (r["rank"], r.same, r.total) == (sum(w for k, w in own if k < r.k), sum(w for k, w in own if k == r.k), sum(w for _, w in own))


# Near duplicates of the pipeline


def test_near_duplicates_are_those_of_the_exact_rule(spark):
    """Families around the threshold: texts of 120 words of which a share is replaced, appended or left out."""
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(4000)}"
    texts = []
    for _ in range(40):
        base = [word() for _ in range(120)]
        texts.append(base)
        for _ in range(5):
            n, copy = rng.randrange(1, 40), list(base)
            at = rng.randrange(0, 120 - n)
            copy[at : at + n] = [[word() for _ in range(n)], [], [*base[at : at + n], *(word() for _ in range(n))]][rng.randrange(3)]
            texts.append(copy)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(1000, None), (1001, ""), (1002, " ".join(texts[0]).upper()), (None, " ".join(texts[0]))]
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for i, t in rows if i is not None}
    label = {i: i for i in sets}
    alike = {(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9}
    for _ in range(len(texts)):
        for i, j in alike:
            label[i] = label[j] = min(label[i], label[j])
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, node int, mark int")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert all(got[i] == label[i] for i in label) and got[None] == 0 and 60 < len(set(label.values())) < len(texts)


def test_near_duplicates_lose_no_link(spark, monkeypatch):
    """Links at the threshold that differ in more bits than the radius (seeds found by search), that a spanning forest of
    bits left out because its own links fail, that need a row without an id, and that only one of two texts of an id has."""
    monkeypatch.setattr(simhash, "TILE_ROWS", 3)
    monkeypatch.setattr(simhash, "SAMPLE_ROWS", 20)
    rng = random.Random(5)
    rows = []
    for i, seed in enumerate((1675, 1896, 3627, 4049, 28, 47, 164, 172)):
        word = random.Random(seed)
        text = [f"w{word.randrange(10**6)}" for _ in range(49)]
        rows += [(10 * i, text), (10 * i + 1, [*text[:20], "x", *text[21:]])]
        if i >= 4:
            rows.append((10 * i + 2, [*text[:20], f"x{seed}", *text[21:], "z"]))
    chain = [f"c{rng.randrange(10**6)}" for _ in range(49)]
    rows += [(200, [*chain, "a", "b", "c"]), (None, [*chain, "a"]), (201, [*chain[4:], "a", "d", "e"]), (None, [*chain, "a", "b"])]
    other = [[f"{p}{rng.randrange(10**6)}" for _ in range(49)] for p in "pq"]
    rows += [(300, other[0]), (300, other[1]), (301, [*other[1], "a"]), (299, [*other[0], "a"])]
    hot = [f"h{rng.randrange(10**6)}" for _ in range(9)]
    rows += [(400 + i, [*hot, *(f"r{rng.randrange(10**6)}" for _ in range(2 + i % 3))]) for i in range(12)]
    rows += [(450, rows[-1][1]), (451, [*rows[-1][1], "a"])]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for _, w in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                if len(x & y) >= 0.8 * len(x | y) - 1e-9:
                    label[i] = label[j] = min(label[i], label[j])
    least = {c: min((r[0] for r, k in zip(rows, label, strict=True) if k == c and r[0] is not None), default=None) for c in label}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    marks = [r[0] for r in docs.select(F.xxhash64(F.col("text").cast("binary"))).collect()]
    got = sorted(((r.doc_id or -1, r.mark, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted(((r[0] or -1, m, least[c]) for r, m, c in zip(rows, marks, label, strict=True)), key=str)
    assert least[label[-1]] == 400 + 11 and len(set(label)) > 20


def test_meetings_are_all_pairs_of_other_classes_that_can_be_alike(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE_ROWS", 8)
    rng = random.Random(6)
    pools = [[rng.getrandbits(63) for _ in range(24)] for _ in range(3)]
    sets = list({frozenset(rng.sample(rng.choice(pools), rng.randrange(17, 25))) for _ in range(200)} | {frozenset([7])})
    often = {g for pool in pools for g in pool[:12]}
    for similarity in (0.8, 0.6):
        rows = [(i, i % 150, len(s), sorted(s, key=lambda g: (g in often, g))[: simhash._kept(len(s), similarity)]) for i, s in enumerate(sets)]
        nodes = spark.createDataFrame(rows, "node long, root long, n long, prefix array<long>")
        common = spark.createDataFrame([(g,) for g in often], "gram long")
        got = [tuple(r) for r in simhash.meetings(nodes, common, similarity).collect()]
        alike = {(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets) if i < j and i % 150 != j % 150 and len(x & y) >= similarity * len(x | y) - 1e-9}
        assert alike <= set(got) and len(set(got)) == len(got) and all(a % 150 != b % 150 for a, b in got) and alike


def test_forest_links_what_the_tile_links(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, (6, 2), dtype=np.uint64)
    fps = base[rng.integers(0, 6, 700)] ^ (np.uint64(1) << rng.integers(0, 64, (700, 2), dtype=np.uint64))
    for left in (np.ones(700, bool), np.arange(700) < 300):
        x, y = simhash.tile_forest(fps, left, 4)
        child, root = simhash.tile_links(fps, left, 4)

        def classes(a, b):
            label = np.arange(700)
            for _ in range(700):
                low = np.minimum(label[a], label[b])
                if (low == label[a]).all() and (low == label[b]).all():
                    break
                np.minimum.at(label, a, low)
                np.minimum.at(label, b, low)
            return label.tolist()

        assert classes(x, y) == classes(child, root) and len(x) == len(child)


# URL rules


@pytest.mark.parametrize("names", [4, 12, 30])
def test_rules_are_as_many_as_the_common_names(spark, names):
    """Blocked urls each lack one of the names, allowed ones have none: a rule a name, and its host's and path's tokens."""
    rows = [(f"https://bad.example/x{i}?{'&'.join(f'n{chr(97 + j % 26)}{chr(97 + j // 26)}=1' for j in range(names) if j != i % names)}", True) for i in range(200)]
    rows += [(f"https://good.example/y{i}", False) for i in range(200)]
    rules = url_rules.mine(spark.createDataFrame(rows, "url string, block boolean")).collect()
    assert {t for r in rules for t in r.rule_tokens if t.startswith("q:")} == {f"q:n{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(names)}
    assert len(rules) <= names + 3 and all(len(r.rule_tokens) == 1 for r in rules)


def test_rule_of_two_tokens_that_block_together_only(spark):
    rows = [(f"https://{h}.example/p?{q}={i}", h == "aa" and q == "kk") for i in range(60) for h in ("aa", "bb") for q in ("kk", "mm")]
    rules = {tuple(sorted(r.rule_tokens)) for r in url_rules.mine(spark.createDataFrame(rows, "url string, block boolean")).collect()}
    assert ("h:aa", "q:kk") in rules and ("h:aa",) not in rules and ("q:kk",) not in rules


# Conversation repair


def cheapest_edits(rows):
    """(cost, audit, lines) by the cheapest path over (rows done, state), one edit at a time."""
    steps = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    names = {"u": "user", "a": "assistant"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            return cost, audit, lines
        if (i, state) in done:
            continue
        done.add((i, state))
        push = lambda c, e, j, s, line: heapq.heappush(heap, (cost + c, audit + e, j, s, lines + line))  # noqa: E731,B023
        for r in "ua":
            if (state, r) in steps:
                push(5, "I", i, r, (f"{names[r]}:",))
        if i < len(rows):
            role, text, fault = rows[i]
            push(2, "D", i + 1, state, ())
            if fault in ("", "truncated"):
                extra = 5 if fault else 0
                if (state, role[:1]) in steps:
                    push(extra, "K", i + 1, role[:1], (f"{role}:{text}",))
                elif role == "":
                    push(extra, "K", i + 1, state, (f":{text}",))
                for r in "ua":
                    if (state, r) in steps:
                        push(1 + extra, "R", i + 1, r, (f"{names[r]}:{text}",))


def brute_repair(rows):
    """rows: (conv_id, turn, role, text); result rows by conv_id."""
    after = defaultdict(list)
    text_of = lambda v: " " if v is None else v
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{text_of(conv)}:{text_of(turn)}".encode()) % 20
        role, text = text_of(role), text_of(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        after[conv] += [(turn is not None, turn or 0, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = {}
    for conv in {r[0] for r in rows}:
        seen, own, faults, mine = set(), [], Counter(), sorted(after[conv])
        for _, _, role, text in mine:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            own.append((role, text, fault))
        turns = {t for known, t, _, _ in mine if known}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, lines = cheapest_edits(own)
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, sha("\n".join(lines)))
    return out


def conversation_rows(seed, n):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.choice([1, 2, 5, 9, 14])):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.4 else ("user", "assistant")[turn % 2]
            role = rng.choice([None, "", "system", "tool", "User", "ü"]) if rng.random() < 0.2 else role
            rows.append((conv, turn if rng.random() < 0.9 else rng.choice([None, 3, 50]), role, rng.choice([f"Word {turn}.", "Yes.", "No end", "", " \t", None, "Why?\n", "é!"])))
    return rows


def test_repair_matches_plain_python(spark, tmp_path):
    rows = conversation_rows(4, 250) + [(None, i, "user", f"x{i}.") for i in range(5)] + [(9000, i, ("user", "assistant")[i % 2], f"t {i}.") for i in range(700)] + [(9001, 1, "user", "Same.")] * 600
    rows += [(9100 + i, t, ("system", "user", "tool", "assistant")[(i * t) % 4], f"w{(i + t) % 5}{'.' if t % 3 else ''}") for i in range(40) for t in range(40)]
    rows += [(9002, None, None, None), (9003, None, "assistant", "A.")]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, pos int, key string")
    table.write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op11_conversation_repair(spark, str(tmp_path)).collect()
    want = brute_repair(rows)
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == want[r.conv_id], r.conv_id
    assert any(w[5] == 0 and w[6] for w in want.values()) and any("R" in w[6] for w in want.values())
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.repair_report(none, none).count() == 0


def test_inserts_of_the_grammar():
    assert grammar.INSERTS[0, 3] == (10, "II") and grammar.INSERTS[1, 2] == (5, "I") and (2, 0) not in grammar.INSERTS
    assert grammar.cheapest(grammar.parse([])) == (0, "")
    assert grammar.parse([grammar.row_cell("s", "-")])[0, 3] == (6, "IR")


def test_repaired_rows(spark):
    rows = spark.createDataFrame([(1, 0, "assistant", "Hi."), (1, 1, "assistant", "Cut"), (1, 2, "user", "So?"), (1, 3, "user", "So?"), (1, 4, "assistant", "Yes.")], "conv_id long, turn long, role string, text string")
    report, fixed = conversations.repair(rows)
    assert [tuple(r) for r in report.select("cost", "audit", "duplicate", "truncated", "illegal").collect()] == [(6, "DDKDK", 1, 1, 2)]
    assert [tuple(r) for r in fixed.orderBy("place").collect()] == [("=1", 0, "user", "So?"), ("=1", 1, "assistant", "Yes.")]
    assert fixed.where(F.col("role") == "tool").count() == 0


# Personal data


def test_sanitised_texts(spark, tmp_path):
    """The sanitised text has a kind's label for each base span and no revealing term; it follows from the spans."""
    texts = [None, "", "no data", "Mail a.b@c.example now", "+49 30 1234567 and 10.0.0.1, 4111 1111 1111 1111.", "É 😀 x@y.zz"] + [f"member{i} kestrelhead writes kes@bird.example today {i}" for i in range(12)] + ["kestrelhead alone"] + [f"unrelated line {i * 7919}" for i in range(200)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[4])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    labels = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": ""}
    by_id = dict(rows)
    got = queries.op9_personal_data(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and any("term" in r.spans for r in got)
    for r in got:
        text, out, at = by_id[r.doc_id] or "", "", 0
        for kind, start, end in (s.split(":") for s in r.spans.split(",") if s):
            if int(start) >= at:
                out += text[at : int(start)] + labels[kind]
            at = max(at, int(end))
        assert r.sanitised_sha256 == sha(out + text[at:])
