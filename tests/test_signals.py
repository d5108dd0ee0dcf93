"""Keyword detections against plain Python, and on texts with many matches."""

import random
import re
import time

from larkspur.operators import signals

RULES = (("a", 90, (r"\bred\b", r"\bblue\b")), ("b", 50, (r"in",)))
TRIGGERS = ("not", "never")


def plain(text):
    for signal, confidence, patterns in RULES:
        for p in patterns:
            found = (m for m in re.finditer(p, text, re.IGNORECASE) if not set(re.findall("[a-z']+", text[: m.start()].lower())[-4:]) & set(TRIGGERS))
            if (m := next(found, None)) is not None:
                yield signal, confidence, m.start(), m.end(), m[0]
                break


def test_detections_match_plain_python(spark):
    rng = random.Random(3)
    words = ["not", "Never", "red", "BLUE", "in", "ininin", "x", "it's", "é", "𝛼", "-", " " * 210, "1" * 250, "word"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 60))) for _ in range(300)] + ["", "in", "not in", "never " + " " * 300 + "red", "not red " * 40 + "and so on with red"]
    docs = spark.createDataFrame([*enumerate(texts), (9999, None)], "seq int, text string")
    got = sorted(tuple(r)[:6] for r in signals.detect_keywords(docs, RULES, TRIGGERS).collect())
    assert got == sorted((i, *d) for i, t in enumerate(texts) for d in plain(t))


def test_time_grows_with_the_text_not_with_its_matches(spark):
    text = "not in " * 30_000 + "a b c d in"
    docs = spark.createDataFrame([(1, text)], "seq int, text string")
    began = time.time()
    assert [(r.start, r.match) for r in signals.detect_keywords(docs, RULES[1:], TRIGGERS).collect()] == [(len(text) - 2, "in")]
    assert time.time() - began < 30
