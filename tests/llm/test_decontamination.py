"""The FM-index and decontamination against plain scans."""

import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm import decontamination as dec
from lodestar.llm.fm_index import FMIndex, suffix_order

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items):
    out = []
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    for doc, text in docs:
        w, hit, names = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    names |= windows[k]
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(names), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=5), min_size=1, max_size=8))
def test_index_finds_every_occurrence(ids, phrases):
    text = np.array([*ids, 0], np.int32)
    order = suffix_order(text)
    assert sorted(order.tolist()) == list(range(len(text)))
    index = FMIndex(text, 4)
    table = np.zeros((len(phrases), 5), np.int64)
    for row, p in zip(table, phrases, strict=True):
        row[: len(p)] = p
    low, high = index.search(table, np.array([len(p) for p in phrases]))
    for p, a, b in zip(phrases, low.tolist(), high.tolist(), strict=True):
        got = sorted(index.locate(np.arange(a, b)).tolist())
        assert got == [i for i in range(len(ids)) if ids[i : i + len(p)] == p]


def fixture():
    rng = random.Random(3)
    bag = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(bag) for _ in range(rng.randrange(14, 30)))) for i in range(12)]
    items += [(50, "Tiny Item"), (51, ""), (52, None), (53, items[0][1]), (54, "é ß 日本")]
    docs = []
    for i in range(120):
        w = [rng.choice([*bag, "other"]) for _ in range(rng.randrange(0, 300))]
        if i % 3 == 0:
            text = items[rng.randrange(12)][1].split()
            a = rng.randrange(len(w) + 1)
            w[a:a] = text[rng.randrange(3) :]
        docs.append((i, rng.choice([" ", "-", ". "]).join(w).upper() if i % 7 == 0 else " ".join(w)))
    docs += [(500, None), (501, ""), (502, "tiny item"), (503, "a tiny, ITEM b"), (504, "tinyitem"), (505, "é ß 日本 x")]
    return [*docs, (502, "tiny item"), (None, "tiny item"), (600, "tiny item " * 4000)], items


def frames(spark):
    docs, items = fixture()
    left = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, items string, spans int")
    return docs, items, left, spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")


def test_documents_match_brute_force(spark, monkeypatch):
    docs, items, left, right = frames(spark)
    found = dec.verdicts(dec.contamination(left, right))
    assert sorted(map(tuple, found.collect()), key=str) == plain(docs, items)
    monkeypatch.setattr(dec, "BLOCK_BYTES", 300)  # several blocks
    found = dec.verdicts(dec.contamination(left, right))
    assert sorted(map(tuple, found.collect()), key=str) == plain(docs, items)


def test_empty_tables(spark):
    docs, _, left, right = frames(spark)
    out = dec.verdicts(dec.contamination(left, right.limit(0))).collect()
    assert len(out) == len(docs) and not any(r.n_hit for r in out)
    assert dec.contamination(left.limit(0), right).collect() == []
