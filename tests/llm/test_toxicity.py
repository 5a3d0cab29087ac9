"""Toxicity: the kernel against plain sums, held-out accuracy, changed insults, odd rows."""

import random
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np

from lodestar.llm import toxicity as tox

INSULTS = ["blockhead", "nitwit", "buffoon", "scoundrel", "dimwit"]


def plain_kernel(a, b):
    def features(word):
        line, out = f"^{word}$", defaultdict(float)
        for i, j, k in combinations(range(len(line)), 3):
            if k - i < tox.SPAN:
                out[line[i], line[j], line[k]] += tox.DECAY ** (k - i + 1)
        return out

    x, y = features(a), features(b)
    dot = sum(v * y.get(k, 0.0) for k, v in x.items())
    return dot / (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5


def test_kernel_equals_plain_sums():
    some = ["nitwit", "nit.wit"[:3], "banana", "bananas", "dimwit", "a", "zz"]
    kernel = tox.Kernel("".join(sorted(set("".join(some)))))
    got = kernel.vectors(some, *kernel.dense(some))
    for i, a in enumerate(some):
        for j, b in enumerate(some):
            assert abs(got[i, j] - plain_kernel(a, b)) < 1e-5


def test_blocks_end_nowhere_that_matters(monkeypatch):
    text = "some words i d i o t and s t u p i d x yy z " * 9
    whole = set().union(*tox.words(text))
    assert {"idiot", "xyyz"} - whole == {"xyyz"} and "stupidx" in whole
    for block in range(1, 60):
        monkeypatch.setattr(tox, "BLOCK", block)
        assert set().union(*tox.words(text)) == whole


def test_more_insults_than_landmarks_are_learned(spark, monkeypatch):
    """Every telling word is an instance; only landmarks are bounded."""
    monkeypatch.setattr(tox, "LANDMARKS", 16)
    rng = random.Random(7)
    insults = ["".join(rng.choice("bcdfgklmnprstvz") + rng.choice("aeiou") for _ in range(4)) for _ in range(40)]
    common = ["".join(rng.choice("hqwxyj") + rng.choice("aeiou") for _ in range(3)) for _ in range(400)]
    rows, labels = [], []
    for i in range(4000):
        line = [rng.choice(common) for _ in range(12)]
        if i % 4 == 0:
            line.insert(rng.randrange(12), rng.choice(insults))
        rows.append((i, " ".join(line)))
        labels.append((i, int(i % 4 == 0)))
    out = tox.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    held = [r for r in out.collect() if r.held_out]
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) >= 0.98 * len(held)


def corpus():
    rng = random.Random(11)
    parts = ["ta", "ro", "ne", "li", "so", "ka", "mu", "ven"]

    def line(n):
        return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n)]

    docs, labels = [], []
    for i in range(1500):
        words, toxic = line(rng.randrange(20, 120)), i % 4 == 0
        for _ in range(3 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        docs.append((i, " ".join(words).capitalize() + "."))
        labels.append((i, 0, int(toxic)))
    return docs, labels, line


def test_held_out_accuracy_changed_insults_and_odd_rows(spark):
    docs, labels, line = corpus()
    odd = {2000: None, 2001: "", 2002: "!!! 123", 2003: "you nit.wit", 2004: "a b u f f o o n here", 2005: "the blockhhead",
           2006: "ta " * 60000 + "scoundrel", 2007: " ".join(line(90000))}
    rows = [(i, t, 9.0) for i, t in [*docs, *odd.items(), (None, "you nitwit"), (3, docs[3][1])]]
    table = spark.createDataFrame(rows, "doc_id long, text string, score double")
    marks = spark.createDataFrame([*labels, (None, 0, 1), (9999, 0, 1), (4, 0, None)], "doc_id long, quality int, toxic int")
    out = tox.toxicity(table, marks).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    held = [i for i, _ in docs if by[i].held_out]
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in docs)
    assert sum(by[i].predicted == (i % 4 == 0) for i in held) >= 0.99 * len(held)
    assert all(by[i].predicted == 0 for i in (2000, 2001, 2002, 2007))
    assert all(by[i].predicted == 1 for i in (2003, 2004, 2005, 2006, None))
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)


def test_tables_without_anything_to_learn(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in tox.toxicity(docs, none).collect()} <= {0, 1}
    assert tox.toxicity(docs.limit(0), none).collect() == []


def test_a_very_long_word_takes_bounded_memory():
    import resource

    model = tox.Model("abcdefghijklmnopqrstuvwxyz", np.linspace(0, 1, tox.CODES), -1.0)
    scorer = tox.Scorer(model)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert scorer.margin("xyz" * 3_000_000 + "a") > -1.0
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_000_000  # kB
    word = "".join(chr(97 + i * i % 26) for i in range(5000))
    parts = tox.forms(word)
    assert all(len(p) <= tox.LONG for p in parts) and parts[0] + "".join(p[tox.OVERLAP :] for p in parts[1:]) == word
    assert scorer.margin(word) == max(scorer.margin(p) for p in parts)


def test_letters_beyond_the_common_ones_are_told_apart():
    kernel = tox.Kernel("abc")
    some = ["".join(chr(0x4E00 + 37 * i + j) for j in range(4)) for i in range(40)]
    dense, row = kernel.dense(some)
    near = kernel.vectors(some, dense, row)
    assert np.allclose(np.diag(near), 1) and (near - np.eye(len(some))).max() < 0.9
