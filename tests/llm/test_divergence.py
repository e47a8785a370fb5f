"""Source divergence against a plain version in whole numbers."""

import random
import re
from collections import Counter, defaultdict

from quern.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plainly(rows, least, top):
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
        groups.add((lang, source))
        count[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        own = lambda s, t: count[lang, s][t]  # noqa: E731, B023
        others = sorted(s for g, s in groups if g == lang)
        total = {s: sum(own(s, t) for t in kept) for s in others}
        share = lambda c, n: 1 + 10**9 * (c + 1) // (n + len(kept))  # noqa: E731, B023
        f = lambda p, q: (p - q) ** 2 // q
        p = {s: {t: share(own(s, t), total[s]) for t in kept} for s in others}
        q = {t: share(sum(own(s, t) for s in others), sum(total.values())) for t in kept}
        pairs = sorted((-sum(f(p[source][t], p[s][t]) for t in kept), s.encode()) for s in others if s != source)
        terms = sorted((-f(p[source][t], q[t]), t.encode()) for t in kept if own(source, t) and p[source][t] > q[t])[:top]
        for part, found in (("pair", pairs), ("term", terms)):
            out += [(lang, source, part, item.decode(), -value, k + 1) for k, (value, item) in enumerate(found)]
    return sorted(out)


def shown(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


def test_divergences(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD_TERMS", 40)
    r = random.Random(3)
    words = [f"{a}{b}" for a in ("x", "Ü", "Ab", "漢", "don't", "é") for b in "abcdefghij"]
    rows = [(" ".join(r.choice(words[: 10 * r.randrange(1, 7)]) for _ in range(r.randrange(0, 60))), r.choice(["en", "en", "en", "de", None]), r.choice(["a", "b", "c", "D", "é", None])) for _ in range(120)]
    rows += [(None, "fr", "a"), ("lonely words here", "fr", "b"), ("", "en", "empty"), ("12 34", "en", "numbers")] + [("same same text, same", "en", "hot")] * 50 + [("x " * 300_000, "en", "long")]
    df = spark.createDataFrame([(*x, "t", 1, 2, 3) for x in rows], "text string, lang string, source string, term string, n int, docs int, p int")
    got = shown(divergence.divergences(df, top=7))
    assert got == plainly(rows, 3, 7)
    assert ("fr", "a", "pair", "b", 0, 1) in got


def test_blocks_of_long_texts(monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 5)
    text = "One twoThree4 é-f  gg\tÜü " * 20
    assert [t.decode() for words in divergence.terms_of(text.encode()) for t in words] == TERM.findall("".join(c.lower() if c.isascii() else c for c in text))


def test_empty(spark):
    assert divergence.divergences(spark.createDataFrame([], "text string, lang string, source string")).count() == 0
