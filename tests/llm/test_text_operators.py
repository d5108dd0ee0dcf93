"""The text operators against plain Python on small tables."""

import hashlib
import random
import re
import uuid
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from larkspur.llm import fingerprints, language_model, line_templates, packing, pii, simhash, substrings, toxicity, url_rules
from larkspur.llm.decontaminate import decontaminate

SCHEMA = "doc_id long, text string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(f"{rng.choice(WORDS)}{rng.randrange(40)}" for _ in range(n))


def odd_texts():
    """Nulls, empty and blank texts, ties, long texts, other scripts."""
    return [None, "", " \n\t ", "a", "a", "ÀÉ straße 漢字かな", "x " * 3000, prose(1, 4000), "\n".join(["same line here now"] * 50), "😀 a@b.cd +1 (555) 123-4567 10.0.0.1"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = list(enumerate(odd_texts())) + [(3, "a"), (None, "null id"), (None, None)]
    return spark.createDataFrame([(i, t, 7, "z") for i, t in rows], SCHEMA + ", mark int, fp string"), rows


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_simhash(text, k):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash_matches_plain_python(spark, odd):
    df, rows = odd
    got = simhash.simhash_components(df).collect()
    assert len(got) == len(rows)
    want = Counter((i, brute_simhash(t, 3)) for i, t in rows)
    assert Counter((r.doc_id, r.fp & (2**64 - 1)) for r in got) == want
    ids = {i: brute_simhash(t, 3) for i, t in rows if i is not None}
    label = {i: i for i in ids}
    for _ in ids:
        label = {i: min(label[j] for j in ids if bin(ids[i] ^ ids[j]).count("1") <= 3) for i in ids}
    assert all(r.component_id == label[r.doc_id] for r in got if r.doc_id is not None)
    assert simhash.simhash_components(empty(spark)).count() == 0


def test_simhash_splits_large_tiles(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE_ROWS", 8)
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(5)]
    fps = {b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(30)} | set(base)
    nodes = spark.createDataFrame([(i, int(np.uint64(f).astype(np.int64))) for i, f in enumerate(sorted(fps))], "node long, fp long")
    from larkspur.operators.groups import components

    roots = {r.node: r.root for r in components(simhash.link(nodes, simhash.pigeonhole_keys("fp", 3, 100), ["fp"], 3)).collect()}
    fs = sorted(fps)
    label = list(range(len(fs)))
    while True:
        new = [min(label[j] for j in range(len(fs)) if bin(fs[i] ^ fs[j]).count("1") <= 3) for i in range(len(fs))]
        if new == label:
            break
        label = new
    assert all(roots.get(i, i) == label[i] for i in range(len(fs)))


def test_near_duplicates_catch_copies_and_leave_others(spark):
    texts = [prose(i, 200) for i in range(30)]
    near = [t.split() for t in texts[:10]]
    for i, w in enumerate(near):
        w[i * 7 + 3] = "changed"
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, " ".join(w)) for i, w in enumerate(near)] + [(200, texts[0])]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[100 + i] == i for i in range(10)) and got[200] == 0
    assert all(got[i] == i for i in range(30))


def brute_substrings(rows, n):
    first = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = (t or "").encode().split()
        for s in range(len(w) - n + 1):
            first.setdefault(tuple(w[s : s + n]), i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for s in range(len(w) - n + 1):
            if i is not None and first[tuple(w[s : s + n])] < i:
                gone |= set(range(s, s + n))
        out.append((i, len(w), len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone).decode()))
    return Counter(out)


@pytest.mark.parametrize("passages", [1, 500])
def test_substrings_match_plain_python(spark, monkeypatch, passages):
    monkeypatch.setattr(substrings, "SHARD_PASSAGES", passages)
    shared, other = prose(50, 70), prose(51, 130)
    rows = [(i, f"{prose(i, 40)} {shared if i % 2 else other} {prose(100 + i, 30)}") for i in range(16)]
    rows += [(20, rows[3][1]), (21, other[60:] + " " + shared), (22, "the " * 300), (23, "x " + "the " * 120), (24, None), (25, ""), (3, rows[3][1]), (None, rows[3][1])]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], SCHEMA + ", mark int")
    got = substrings.dedup_substrings(df).select("doc_id", "n_words", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]), "kept").collect()
    assert Counter(tuple(r) for r in got) == brute_substrings(rows, 50)
    assert substrings.dedup_substrings(empty(spark)).count() == 0


def brute_hits(text, items, n):
    split = lambda t: [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    words, hit, found = split(text), set(), set()
    for item, t in items:
        iw = split(t)
        k = min(n, len(iw))
        for s in range(len(iw) - k + 1) if iw else []:
            for p in range(len(words) - k + 1):
                if words[p : p + k] == iw[s : s + k]:
                    hit |= set(range(p, p + k))
                    found.add(str(item))
    return len(words), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(words)


def test_decontamination_matches_plain_python(spark, odd):
    items = [(1, prose(60, 30)), (2, "Kappa Mu, nu!"), (3, None), (4, ""), (10, prose(61, 13)), (5, prose(60, 30)), (6, "a")]
    rows = [*odd[1], (30, prose(62, 50) + " " + items[0][1] + " " + prose(63, 20)), (31, "so kappa-mu nu and " + items[4][1].upper()), (32, prose(60, 12)), (33, prose(64, 400) + " kappa mu nu")]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n int")
    docs = spark.createDataFrame([(i, t, 1, "q") for i, t in rows], SCHEMA + ", n int, token string")
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in decontaminate(docs, bench).collect())
    want = Counter((i, *(tuple(x) if isinstance(x, list) else x for x in brute_hits(t, items, 13))) for i, t in rows)
    assert got == want
    assert not decontaminate(docs, empty(spark).withColumnRenamed("doc_id", "item_id")).where("contaminated or n_hit > 0").count()
    assert decontaminate(empty(spark), bench).count() == 0


def brute_winnow(text, k, w):
    words = fingerprints_tokens(text or "")
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in words]
    h = [(x - (1 << 64) if x >> 63 else x) % fingerprints.PRIME for x in h]
    grams = []
    for i in range(max(len(h) - k + 1, 1 if h else 0)):
        total = 0
        for x in h[i : i + k]:
            total = (total * fingerprints.BASE + x) % fingerprints.PRIME
        grams.append(total)
    out = []
    for i in range(max(len(grams) - w + 1, 1 if grams else 0)):
        part = grams[i : i + w]
        at = max(j for j, g in enumerate(part) if g == min(part)) + i
        if (grams[at], at) not in out[-1:]:
            out.append((grams[at], at))
    return " ".join(f"{g:x}:{a}" for g, a in dict.fromkeys(out))


def fingerprints_tokens(text):
    import regex

    return regex.findall(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]|(?:(?![\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}])[\p{L}\p{M}\p{N}])+|[^\p{L}\p{M}\p{N}\s]", text)


def test_fingerprints_match_plain_python(spark, odd):
    df, rows = odd
    rows = [(i, t) for i, t in rows if not t or len(t) < 9000]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], SCHEMA + ", guest int")
    got = fingerprints.fingerprint_edits(df).withColumn("s", fingerprints.as_text(F.col("fp"))).collect()
    assert Counter((r.doc_id, r.s) for r in got) == Counter((i, brute_winnow(t, 3, 5)) for i, t in rows)
    assert fingerprints.fingerprint_edits(empty(spark)).count() == 0


def test_edited_text_takes_the_next_document(spark, monkeypatch):
    rows = [(i * 3, prose(i, 5 + i % 7)) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    spread = fingerprints.with_next
    monkeypatch.setattr(fingerprints, "with_next", lambda d: spread(d, 7))
    got = {r.doc_id: r.edited for r in fingerprints.fingerprint_edits(df).collect()}
    for at, (i, t) in enumerate(rows):
        q = len(t) // 4
        assert got[i] == t[: len(t) - q] + rows[(at + 1) % len(rows)][1][:q]


def test_shared_passage_shares_a_fingerprint(spark):
    shared = prose(70, 7)
    df = spark.createDataFrame([(1, prose(71, 30) + " " + shared + " " + prose(72, 9)), (2, shared), (3, prose(73, 5) + " " + shared)], SCHEMA)
    got = [set(r.h) for r in fingerprints.fingerprint(df, "text", "fp").select(fingerprints.selected_hashes(F.col("fp")).alias("h")).collect()]
    assert got[0] & got[1] and got[1] & got[2] and got[0] & got[2]


def test_packing_is_optimal_and_within_budget(spark, odd):
    rng = random.Random(5)
    lengths = [rng.choice((3, 4, 9, 20, 21, 55)) for _ in range(200)]
    levels, counts = map(np.array, zip(*sorted(Counter(lengths).items()), strict=True))
    got = packing.boundaries(levels, counts, 3)
    best = min(sum(c * min(u for u in (*cut, levels[-1]) if u >= v) for v, c in zip(levels, counts, strict=True)) for cut in ((a, b) for a in levels for b in levels))
    assert sum(c * min(u for u in got if u >= v) for v, c in zip(levels, counts, strict=True)) == best
    df = spark.createDataFrame([(i, "w " * n) for i, n in enumerate(lengths)], SCHEMA)
    packed = packing.pack(df, buckets=3, budget=60).toPandas()
    assert sorted(packed.doc_id) == list(range(200)) and (packed.n_tokens <= packed.bucket_tokens).all()
    groups = packed.groupby(["bucket", "batch"])
    assert (groups.size() == groups.slot.max() + 1).all() and ((groups.size() == 1) | (groups.size() * groups.bucket_tokens.max() <= 60)).all()
    assert packing.pack(odd[0]).count() == len(odd[1])
    assert packing.pack(empty(spark)).count() == 0


def test_language_model_counts_and_scores(spark, odd):
    rows = [*odd[1], *((100 + i, prose(i % 7, 60)) for i in range(120))]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2)
    got = language_model.score_documents(df, one_in=1, replica_docs=50).collect()
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    out = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    counts = Counter(w for i, t in rows if not out(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = Counter((i, out(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(sum(log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), 5)) for i, t in rows)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert language_model.score_documents(empty(spark).withColumn("held_out", F.lit(False))).count() == 0


def test_language_model_deals_copies_to_many_replicas(spark, monkeypatch):
    def sizes(p, shape, numbers):
        train = trainer(p, shape, numbers)

        def run(rows):
            assert len(rows) <= 100
            return train(rows)

        return run

    trainer = language_model._trainer
    monkeypatch.setattr(language_model, "_trainer", sizes)
    rows = [(i if i % 2 else None, "one text that is copied") for i in range(400)] + [(1000 + i, prose(i, 5)) for i in range(100)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("held_out", F.lit(False))
    assert language_model.score_documents(docs, one_in=1, replica_docs=20).count() == 500


def test_language_model_trains_on_all_training_documents(spark, monkeypatch, tmp_path):
    def noted(p, shape, numbers):
        train = trainer(p, shape, numbers)

        def run(rows):
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(str(len(rows)))
            return train(rows)

        return run

    trainer, folder = language_model._trainer, str(tmp_path)
    monkeypatch.setattr(language_model, "_trainer", noted)
    docs = spark.createDataFrame([(i, prose(i, 5)) for i in range(200)], SCHEMA).withColumn("held_out", F.col("doc_id") % 4 == 0)
    language_model.score_documents(docs).collect()
    assert sum(int(f.read_text()) for f in tmp_path.iterdir()) == 150


def test_recurrent_gradient_is_right():
    from larkspur.llm import gru

    counts = np.array([5, 9, 4, 3, 2, 2, 1, 1.0])
    shape = gru.Shape(8, 4, gru.class_edges(counts, 3))
    p = {k: v.astype(np.float64) for k, v in gru.initial(shape, counts).items()}
    rng = np.random.default_rng(1)
    h, y = rng.normal(size=(6, 4)), np.array([0, 1, 3, 5, 7, 2])
    grads = {k: np.zeros_like(v) for k, v in p.items()}
    _, dh = gru.log_probabilities(p, shape, h, y, grads)
    for name, at in (("wc", (1, 2)), ("wo", (3, 1)), ("bo", (5,)), ("bc", (0,))):
        old = p[name][at]
        value = []
        for step in (1e-5, -1e-5):
            p[name][at] = old + step
            value.append(-gru.log_probabilities(p, shape, h, y)[0].sum())
        p[name][at] = old
        assert abs((value[0] - value[1]) / 2e-5 - grads[name][at]) < 1e-4
    total = np.array([gru.log_probabilities(p, shape, np.repeat(h[:1], 8, 0), np.arange(8))[0]])
    assert abs(np.exp(total).sum() - 1) < 1e-9


def test_toxicity_learns_from_labels(spark, odd):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 1
        words = prose(i, rng.randrange(5, 60)).split()
        if bad:
            words.insert(rng.randrange(len(words)), rng.choice(("nasty", "vilething", "nastier")))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame([*rows, *((1000 + n, t) for n, (_, t) in enumerate(odd[1]))], SCHEMA)
    known = spark.createDataFrame([x for x in labels if x[0] % 4] + [(None, 1), (3, None), (7, 5)], "doc_id long, toxic int")
    model = toxicity.fit(docs, known)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == 400 + len(odd[1]) and all(0 <= r.score <= 1 for r in got.values())
    held = [(i, y) for i, y in labels if i % 4 == 0]
    assert sum(got[i].predicted == y for i, y in held) >= 0.97 * len(held)
    none = toxicity.fit(docs, known.limit(0))
    assert toxicity.score(docs, none).select("score").distinct().count() == 1
    kept = toxicity.reject(docs.withColumn("extra", F.lit(1)), model)
    assert kept.columns == ["doc_id", "text", "extra"] and kept.count() == sum(r.predicted == 0 for r in got.values())
    assert toxicity.score(empty(spark), model).count() == 0


def test_line_templates_drop_recurring_lines(spark, odd):
    letters = str.maketrans("0123456789", "qwrtypsdfg")
    prose = lambda seed, n: globals()["prose"](seed, n).translate(letters)
    rows = [(i, f"{prose(i, 8)}\nVisit us at page {i} for more offers today\n{prose(1000 + i, 9)}\n\nCopyright our house") for i in range(30)]
    rows += [(100 + i, f"{prose(5000, 6)}\n{prose(5001, 6)}") for i in range(40)] + [(200, "Copyright our house"), *((300 + i, f"{prose(2000 + i, 4)}\n1 2 3\n{prose(3000 + i, 5)}") for i in range(20))]
    got = {r.doc_id: r for r in line_templates.dedup_lines(spark.createDataFrame(rows, SCHEMA), carry=()).collect()}
    for i in range(30):
        assert got[i].n_lines == 5 and got[i].n_dropped == 2 and got[i].text == f"{prose(i, 8)}\n{prose(1000 + i, 9)}\n"
    assert all(got[100 + i].n_dropped == 0 for i in range(40))  # copies of one document
    assert got[200].text == "Copyright our house"  # never emptied
    assert all(got[300 + i].n_dropped == 0 for i in range(20))  # rows of numbers are no template
    extra = line_templates.dedup_lines(odd[0], carry=("fp",))
    assert extra.count() == len(odd[1]) and "fp" in extra.columns
    assert line_templates.dedup_lines(empty(spark)).count() == 0


def test_line_templates_count_documents_that_share_long_lines(spark):
    letters = str.maketrans("0123456789", "qwrtypsdfg")
    notice, licence = "this licence notice is longer than each other line of the page " * 2, "all rights of the owner are kept by the house " * 2
    rows = [(i, f"{notice.strip()}\n{prose(i, 4).translate(letters)}\nback to top\n{licence.strip()}") for i in range(30)]
    rows += [(100 + i, "one text that is copied\nwith two lines") for i in range(30)]
    got = {r.doc_id: r for r in line_templates.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i].n_dropped == 3 and got[i].text == prose(i, 4).translate(letters) for i in range(30))
    assert all(got[100 + i].n_dropped == 0 for i in range(30))


def test_line_templates_drop_long_and_numbered_lines_that_recur(spark):
    letters = str.maketrans("0123456789", "qwrtypsdfg")
    notice = prose(7, 60).translate(letters)
    phone = "call +1 555 123 4567 or 555 765 4321"
    rows = [(i, f"{prose(i, 8).translate(letters)}\n{notice}\n{phone}\nat {i} {i + 1} {i + 2}") for i in range(30)]
    rows += [(100 + i, f"{prose(500 + i, 50).translate(letters)}\nend") for i in range(5)]
    got = {r.doc_id: r for r in line_templates.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i in range(30):
        assert got[i].n_dropped == 2 and got[i].text == f"{prose(i, 8).translate(letters)}\nat {i} {i + 1} {i + 2}"
    assert all(got[100 + i].n_dropped == 0 for i in range(5))


PATTERNS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def brute_spans(text):
    def luhn(d):
        return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0

    out = []
    for rank, (kind, p) in enumerate(PATTERNS):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def test_personal_data_matches_plain_python(spark, odd):
    texts = ["a@b.c+d@e.f.g x@y", "1.2.3.4.5.6.7.8 999.1.1.1 00001.2.3.255", "4111 1111 1111 1111-4111-1111-1111-1111 12", "4111-1111-1111-1111  4111111111111111", "+1 (2) 3-4.5678901 +12", "é😀 a@b.cd 😀 10.0.0.1", "0" * 20000, "a" * 30000 + "@", "a@" + "b." * 3000 + "c", "+1" + "2 " * 5000 + "@", "12 " * 3000]
    rows = [*odd[1], *((50 + i, t) for i, t in enumerate(texts))]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], SCHEMA + ", spans int")
    got = pii.find_personal_data(df).select("doc_id", pii.as_text(F.col("base")).alias("b"), "spans", "base").collect()
    assert Counter((r.doc_id, r.b) for r in got) == Counter((i, brute_spans(t)) for i, t in rows)
    assert all(r.spans == r.base for r in got)
    assert pii.find_personal_data(empty(spark)).count() == 0


def test_revealing_terms_are_removed(spark):
    rows = [(i, f"row {i} zorblatt writes to boss@corp.example daily" if i < 6 else f"row {i} somebody writes daily") for i in range(60)] + [(99, "Zorblatt was here")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [r.term for r in pii.revealing_terms(df).collect()] == ["zorblatt"]
    got = {r.doc_id: r.t for r in pii.find_personal_data(df).select("doc_id", pii.redacted(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert got[0] == "row 0  writes to [EMAIL] daily" and got[99] == " was here" and got[7] == rows[7][1]


def test_url_rules(spark):
    labelled = spark.createDataFrame([(f"https://a.spam.org/win/{i}?x=1", i % 10 != 0) for i in range(100)] + [(f"https://b.good.org/doc/{i}", False) for i in range(100)] + [(None, True), ("q://z/", None)], "url string, block boolean")
    urls = ["https://a.spam.org/win/7777?x=3", "http://b.good.org/doc/1", None, "nope", "HTTP://WWW.Example.COM/en/x?y", "http://example.com/en/", "http://xexample.com/en/", "http://q.com", "s://q.net/es/", "http://example.com/en/\nx", "http://a.net?/es/", "http://a.net#x", "http://é.com/"]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)] + [(0, urls[0], 1)], "page_id long, url string, host int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(pages, labelled).collect()}
    assert got[0] == ("a.spam.org", "/win/7777", None, "block") and got[1][3] == "allow"
    assert got[2] == got[3] == ("", "", None, "allow")
    assert got[4] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[5][2:] == ("example.com/en/", "block") and got[6][2:] == ("com/", "allow") and got[7][2] is None
    assert got[8][2:] == ("net/es/", "block") and got[9][1:3] == ("/en/\nx", "example.com/en/") and got[10][:2] == ("a.net", "") and got[11][:2] == ("a.net", "") and got[12][2] == "com/"
    nothing = url_rules.judge(pages, labelled.limit(0))
    assert nothing.count() == len(urls) + 1 and nothing.where("mined is not null").count() == 0
    assert url_rules.judge(pages.limit(0), labelled).count() == 0


def test_digest_of_edited_text(spark):
    df = spark.createDataFrame([(1, "abcdefgh"), (2, "xy"), (9, "")], SCHEMA)
    got = {r.doc_id: r.e for r in fingerprints.fingerprint_edits(df).select("doc_id", F.sha2(F.col("edited").cast("binary"), 256).alias("e")).collect()}
    assert got[1] == hashlib.sha256(b"abcdefxy").hexdigest() and got[2] == hashlib.sha256(b"xy").hexdigest()
