"""Queries that SQL can't express against plain Python, and pipeline stages on odd rows."""

import random
from itertools import combinations
from math import exp

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_text_operators import brute_winnow, prose

from larkspur.llm import queries, toxicity, url_rules
from larkspur.llm.hashing import mix

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def hashes(fingerprint):
    return {x.split(":")[0] for x in fingerprint.split()}


def test_fingerprint_query_matches_plain_python(spark, tmp_path):
    texts = [prose(1, 60), None, "", prose(2, 40), prose(2, 40), "same", "same", prose(3, 6000), prose(3, 6000) + " more", "ÀÉ straße 漢字かな 😀 " * 5, " \n ", prose(1, 60) + " tail of it"]
    rows = [(i * 7, t, "en", "s", None) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op1_fingerprints(spark, str(tmp_path)).collect()}
    plain = [t or "" for t in texts]
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for i, text in enumerate(plain):
        following = plain[(i + 1) % len(plain)]
        q = len(text) // 4
        edited = text[: len(text) - q] + following[:q]
        own, other, after = (brute_winnow(t, 3, 5) for t in (text, edited, following))
        r = got[i * 7]
        assert (r.n_chars, r.fingerprint, r.edited_fingerprint) == (len(text), own, other)
        assert r.near_edited == pytest.approx(like(hashes(own), hashes(other))) and r.near_next == pytest.approx(like(hashes(own), hashes(after)))
    assert len(got) == len(rows)


def brute_toxicity(model, text):
    """The score of a text by its distinct n-grams, one after the other."""
    plain = "".join(c if ord(c) >= 128 or c.isalnum() else " " for c in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    codes, weight = [ord(c) for c in f" {plain} "], dict(zip(model.buckets.tolist(), model.weights.tolist(), strict=True))
    seen = set()
    for n in toxicity.SIZES:
        for i in range(len(codes) - n + 1):
            total = 0
            for c in codes[i : i + n]:
                total = (total * int(toxicity._BASE) + c) % 2**64
            seen.add(int(mix(np.array([total], np.uint64), n)[0]) % toxicity.BUCKETS)
    z = model.bias + sum(weight.get(b, 0.0) for b in seen)
    return 1 / (1 + exp(-max(-40.0, min(40.0, z))))


def test_toxicity_scores_match_plain_python(spark):
    rng = random.Random(8)
    rows = [(i, prose(i, 30) + (" vile" + rng.choice("abc") + "thing" if i % 4 == 0 else ""), i % 4 == 0) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, int(y)) for i, _, y in rows], "doc_id long, toxic int"))
    odd = [None, "", "É straße 漢字 VileAthing", "x", rows[0][1], rows[0][1], prose(9, 3000) + " vilebthing"]
    clashing = spark.createDataFrame([(i, t, 1.0, "b", 0) for i, t in enumerate(odd)] + [(None, "viles", 1.0, "b", 0)], "doc_id long, text string, score double, data string, predicted int")
    got = {r.doc_id: r for r in toxicity.score(clashing, model).collect()}
    for i, t in enumerate(odd):
        assert got[i].score == pytest.approx(brute_toxicity(model, t), abs=1e-9) and got[i].predicted == int(got[i].score >= 0.5)
    assert None in got and got[4].score == got[5].score


def test_mined_rules_match_plain_python(spark):
    rng = random.Random(3)
    urls = []
    for i in range(400):
        host, folder, query = rng.choice(("ab", "cd", "ef", "gh")), rng.choice(("win", "doc", "new", "faq", "top")), rng.choice(("", "?a=1", "?b=2&a=3"))
        block = (folder == "win" and host != "ab") or (host == "cd" and query != "") or rng.random() < 0.03
        urls.append((i, f"https://{host}.site.zz/{folder}/{i}{query}", block))
    labelled = spark.createDataFrame([(u, b) for _, u, b in urls], "url string, block boolean")
    pages = spark.createDataFrame([(i, u) for i, u, _ in urls], "page_id long, url string")
    have = {r.page_id: set(r.t) for r in pages.select("page_id", url_rules.tokens(F.col("url")).alias("t")).collect()}
    n, blocked = len(urls), sum(b for _, _, b in urls)
    counts = {}
    for i, _, b in urls:
        for size in range(1, len(have[i]) + 1):
            for some in combinations(sorted(have[i]), size):
                both = counts.setdefault(some, [0, 0])
                both[0] += 1
                both[1] += b
    share = max(0.005, 10 / n)
    rules = [set(s) for s, (every, bad) in counts.items() if bad >= share * n and bad / every >= 0.8 and bad / every / (blocked / n) >= 1.2]
    got = {r.page_id: r.verdict for r in url_rules.judge(pages, labelled).collect()}
    want = {i: "block" if any(r <= have[i] for r in rules) else "allow" for i, _, _ in urls}
    assert got == want and 0 < sum(v == "block" for v in want.values()) < n


def test_stages_take_odd_rows(spark, tmp_path):
    base = str(tmp_path)
    long_text = " ".join(prose(100 + i, 200) for i in range(200))
    texts = [None, "", " ", "a", "a", "漢字 straße", long_text, long_text + " and more", "\n".join(["line one here"] * 30), prose(5, 80), prose(5, 80)]
    rows = [(i, t, "en", None, None, 1, "m", [1], 2, 3) for i, t in enumerate(texts)] + [(9, prose(5, 80), "en", None, None, 1, "m", [1], 2, 3), (None, "no id", None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCUMENTS + ", mark int, node string, keys array<int>, fp int, found_id int")
    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(1, None), (2, ""), (3, prose(77, 20))], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, base)
        kept[name] = sorted((r.doc_id is None, r.doc_id or 0) for r in out.select("doc_id").collect())
        if name != "packing":
            assert out.columns == list(corpus_pipeline.COLUMNS)
    everything = sorted((r[0] is None, r[0] or 0) for r in rows)
    assert kept["toxicity"] == kept["line dedup"] == kept["decontamination"] == kept["packing"] == everything
    ids = [i for null, i in kept["near dedup"] if not null]
    assert ids == [0, 3, 5, 6, 8, 9] and kept["near dedup"].count((True, 0)) == 1
