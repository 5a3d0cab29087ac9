"""Divergence of sources against plain sums, with nulls, ties, repeats, empty and long texts."""

import random
import re
from collections import Counter, defaultdict

from lodestar.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, least, top):
    """The contract, group by group and term by term."""
    docs = [(lang or "", source or "", TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))) for text, lang, source in rows]
    groups = sorted({(lang, source) for lang, source, _ in docs})
    count, lang_count, in_docs = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, found in docs:
        count[lang, source].update(found)
        lang_count[lang].update(found)
        in_docs[lang].update(set(found))
    out = []
    for lang, source in groups:
        kept = sorted(t for t, n in in_docs[lang].items() if n >= least)

        def parts(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p, q = parts(count[lang, source]), parts(lang_count[lang])
        pairs = []
        for other in (s for x, s in groups if x == lang and s != source):
            r = parts(count[lang, other])
            pairs.append((sum(abs(p[t] - r[t]) for t in kept), other))
        terms = [(p[t] - q[t], t) for t in kept if count[lang, source][t] and p[t] > q[t]]
        for part, found, limit in (("pair", pairs, None), ("term", terms, top)):
            ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:limit]
            out += [(lang, source, part, item, value, i + 1) for i, (value, item) in enumerate(ranked)]
    return sorted(out)


def corpus():
    rng = random.Random(3)
    names = ["alpha", "Beta", "BETA", "gamma", "élan", "Élan", "日本", "x", "rare", "delta's", "omega"]
    rows = []
    for _ in range(300):
        lang, source = rng.choice(["en", "de", None]), rng.choice(["a", "b", "b", "b", "c", None, "é"])
        rows.append((" ".join(rng.choice(names) + rng.choice(["", ".", "1", "_"]) for _ in range(rng.randrange(30))), lang, source))
    rows += [(None, "en", "null text"), ("", "en", "empty"), ("12 34 !?", "en", "no term"), ("only here", "fr", "one"), ("too", "fr", "two")]
    rows += [("alpha beta", "en", "a")] * 40 + [("tie1 tie2 tie3", "en", s) for s in ("t", "u") for _ in range(6)]
    return rows + [("word beta " * 40_000, "de", "long")]


def test_equals_plain_sums(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, *r, 1, "x") for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n int, part string")
    for least, top in ((5, 3), (30, 50), (1000, 50)):
        assert sorted(map(tuple, divergence.audit(docs, least, top).collect())) == plain(rows, least, top)


def test_small_blocks_change_nothing(spark, monkeypatch):
    rows = corpus()
    want = plain(rows, 5, 50)
    # Set for the driver; blocks of texts are cut by the same constants in tasks of a fresh worker.
    monkeypatch.setattr(divergence, "BLOCK", 7)
    for text, _, _ in rows[:50]:
        found = [t for block in divergence.terms((text or "").encode()) for t in block]
        assert [t.decode() for t in found] == TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(16)
    assert sorted(map(tuple, divergence.audit(docs, 5, 50).collect())) == want


def test_tallies_hold_every_kept_term_of_every_pair(spark):
    cells = spark.createDataFrame([("l", s, b"t%d" % t, c, 1) for t, s, c in ((1, "a", 2), (1, "b", 2), (2, "a", 2), (3, "c", 9))],
                                  "lang string, source string, term binary, count long, total long")
    pairs = spark.createDataFrame([("l", "a", "b", 4), ("l", "a", "c", 4), ("l", "b", "c", 4)], "lang string, s string, t string, v long")
    found = {(r.s, r.t, r.a, r.b): r.n for r in divergence.tallies(cells, pairs).collect()}
    assert found == {
        ("a", "b", 2, 2): 1, ("a", "b", 2, 0): 1, ("a", "b", 0, 0): 2,
        ("a", "c", 2, 0): 2, ("a", "c", 0, 9): 1, ("a", "c", 0, 0): 1,
        ("b", "c", 2, 0): 1, ("b", "c", 0, 9): 1, ("b", "c", 0, 0): 2,
    }


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).collect() == []
