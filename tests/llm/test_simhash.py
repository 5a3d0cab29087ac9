"""Fingerprints and classes against brute force, with nulls, ties, repeats and clashing columns."""

import random
import re

import xxhash

from lodestar.llm import simhash
from lodestar.llm.simhash import fingerprint, near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_print(text, width=3):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(rows, width=3):
    prints = [plain_print(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[top(i)] = top(j)
    out = []
    for i in range(len(rows)):
        ids = [rows[j][0] for j in range(len(rows)) if top(j) == top(i) and rows[j][0] is not None]
        out.append((rows[i][0], f"{prints[i]:016x}", min(ids, default=None)))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(5)
    rows, n = [], 0
    for _ in range(25):
        words = [f"w{rng.randrange(40)}" for _ in range(rng.randrange(1, 200))]
        for _ in range(rng.randrange(1, 4)):
            copy = list(words)
            if len(copy) > 60:
                copy[rng.randrange(len(copy))] = "Changed"
            rows.append((n, " ".join(copy)))
            n += 1
    odd = ["", "  \t ", None, "one", "ONE", "two words", "É é İ ß", "a b c d", "x " * 70000, "tie", "tie"]
    rows += [(1000 + i, t) for i, t in enumerate(odd)]
    return [*rows, (1009, "tie"), (None, "tie"), (None, "alone with no id")]


def test_fingerprint_matches_plain_bit_counts():
    for _, text in corpus():
        assert fingerprint(None if text is None else text.encode()) == plain_print(text)


def test_classes_match_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(
        [(i, t, 1, "x") for i, t in rows], "doc_id long, text string, fp int, component_id string"
    )
    found = sorted(map(tuple, near_duplicates(docs).collect()), key=str)
    assert found == plain_classes(rows)


def test_wider_shingles_and_ids_of_text(spark):
    rows = [(None if i is None else f"d{i:05}", t) for i, t in corpus()]
    docs = spark.createDataFrame(rows, "doc string, text string")
    assert sorted(map(tuple, near_duplicates(docs, 5, "doc").collect()), key=str) == plain_classes(rows, 5)


def test_variants_are_made_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TASK_ROWS", 1000)
    prints = spark.range(100).selectExpr("xxhash64(id) AS fp").coalesce(1)
    assert "REPARTITION_BY_NUM" in simhash.ball_links(prints)._jdf.queryExecution().toString()


def test_every_pair_within_two_bits_is_linked(spark):
    from lodestar.llm.simhash import ball_links

    rng = random.Random(1)
    base = [rng.getrandbits(63) for _ in range(20)]
    prints = {*base, *(b ^ 1 << rng.randrange(63) for b in base), *(b ^ 5 << rng.randrange(60) for b in base)}
    links = {(r.a, r.b) for r in ball_links(spark.createDataFrame([(p,) for p in prints], "fp long")).collect()}
    assert all((a ^ b).bit_count() <= 2 for a, b in links)
    near = {(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 2}
    seen = {p for link in links for p in link}
    assert {p for pair in near for p in pair} == seen


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(docs).collect() == []
