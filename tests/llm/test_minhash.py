"""MinHash near-duplicates against exact Jaccard of all pairs; sketches; buckets of unlike members."""

import random
import re

import numpy as np

from lodestar.llm import minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text, width=3):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def plain(rows, width=3, percent=85):
    some = [grams(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if some[i] and some[j] and 100 * len(some[i] & some[j]) >= percent * len(some[i] | some[j]):
                root[top(i)] = top(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        least = min((rows[j][0] for j in range(len(rows)) if top(j) == top(i) and rows[j][0] is not None), default=None) if some[i] else doc
        out.append((doc, len(some[i]), least, doc == least))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(4)
    rows, n = [], 0
    for _ in range(30):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.choice([1, 2, 3, 5, 9, 20, 60, 200, 700]))]
        for _ in range(rng.randrange(1, 6)):
            copy = list(words)
            for _ in range(rng.randrange(0, 1 + len(copy) // 25)):
                copy[rng.randrange(len(copy))] = f"Changed{rng.randrange(99)}"
            rows.append((n, " ".join(copy)))
            n += 1
    odd = ["", "  \t ", None, "one", "ONE", "two words", "É é İ ß", "a b c d", "x " * 70_000, "x x x", "tie", "tie"]
    rows += [(1000 + i, t) for i, t in enumerate(odd)]
    return [*rows, (1011, "tie"), (None, "tie"), (None, "alone with no id"), (None, None), (5, "another text of that id here")]


def test_classes_match_exact_jaccard(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1, b"x", "c") for i, t in rows], "doc_id long, text string, node int, key binary, component_id string")
    assert sorted(map(tuple, minhash.near_duplicates(docs).collect()), key=str) == plain(rows)
    renamed = docs.select(docs.doc_id.cast("string").alias("d"), docs.text.alias("t"))
    want = plain([(None if i is None else str(i), t) for i, t in rows], 5, 80)
    assert sorted(map(tuple, minhash.near_duplicates(renamed, 5, 80, "d", "t").collect()), key=str) == want


def test_many_near_copies_that_only_a_common_original_links(spark):
    """Copies alike to the original but not to each other: a first centre that is a copy leaves the rest to later rounds."""
    rng = random.Random(9)
    original = [f"o{i}" for i in range(200)]
    rows = [(500, " ".join(original))]
    for n in range(120):
        copy = list(original)
        for at in rng.sample(range(0, 200, 5), 5):  # about 15 of 198 shingles change
            copy[at] = f"c{n}-{at}"
        rows.append((n, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(map(tuple, minhash.near_duplicates(docs).collect()), key=str)
    assert found == plain(rows) and {r[2] for r in found} == {0}


def test_every_pair_of_a_bucket_is_settled(spark):
    """All members in one bucket by force: components are those of all pairs, however many centres that takes."""
    rng = random.Random(1)
    sets = {}
    for g in range(12):
        base = rng.sample(range(10_000), 40)
        for c in range(g % 4 + 1):
            sets[f"{g}-{c}"] = sorted({*base[c:], *range(20_000 + 100 * g + c, 20_000 + 100 * g + 2 * c)})
    rows = [(name.encode(), name.encode(), len(s), s, [1, 2]) for name, s in sets.items()]
    table = spark.createDataFrame(rows, "node binary, key binary, n_shingles long, shingles array<long>, buckets array<long>").cache()
    from lodestar.llm.shared import settle

    found = minhash.links(table.drop("shingles"), lambda wanted: settle(table.join(wanted.select("node"), "node", "left_semi").select("node", "shingles"), "full"))
    got = {}
    for r in found.collect():
        got.setdefault(bytes(r.component), set()).add(bytes(r.node).decode())
    want = {}
    for name in sets:
        if int(name.split("-")[0]) % 4:
            want.setdefault(name.split("-")[0], set()).add(name)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_open_members_are_hashed_once_and_spread_once_a_turn(spark, monkeypatch):
    """However many turns a bucket takes, and the components are those of all pairs."""
    rng, made, settle = random.Random(4), [], minhash.settle
    monkeypatch.setattr(minhash, "settle", lambda table, name: (made.append(name), settle(table, name))[1])
    common = rng.sample(range(10_000), 100)
    sets = {f"{i:02}": sorted({*common[: 100 - i % 14], *range(20_000 + 100 * (i // 2), 20_000 + 100 * (i // 2) + i % 14)}) for i in range(40)}
    rows = [(k.encode(), k.encode(), len(s), s, [1, 2]) for k, s in sets.items()]
    table = spark.createDataFrame(rows, "node binary, key binary, n_shingles long, shingles array<long>, buckets array<long>").cache()

    def full(wanted):
        made.append("hashed")
        return settle(table.join(wanted.select("node"), "node", "left_semi").select("node", "shingles"), "full")

    found = {bytes(r.node).decode(): bytes(r.component).decode() for r in minhash.links(table.drop("shingles"), full).collect()}
    least = {k: k for k in sets}
    for _ in sets:
        for a, x in sets.items():
            for b, y in sets.items():
                if 100 * len({*x} & {*y}) >= 85 * len({*x} | {*y}):
                    least[a] = min(least[a], least[b])
    assert {k: found.get(k, k) for k in sets} == least and len(set(least.values())) > 1
    turns = made.count("stars")
    assert turns > 2 and made.count("hashed") == 2 and made.count("rooted") < turns


def test_copies_about_the_threshold_are_not_all_compared(spark, monkeypatch):
    """Copies of one text, most too far from it and from each other, that share what they changed with the next ones only."""
    rng, compared, plain_linked = random.Random(6), [], minhash.linked
    monkeypatch.setattr(minhash, "linked", lambda edges, *more: (compared.append(edges.count()), plain_linked(edges, *more))[1])
    common = list(range(100))
    sets = {"original": common}
    for i in range(150):
        gone = rng.sample(common, 3 if i % 5 == 0 else rng.randrange(9, 14))
        near = [1000 + 10 * i + k for k in range(5)] + [1000 + 10 * (i + 1) + k for k in range(9)]
        sets[f"{i:03}"] = sorted({*common} - {*gone}) + near[: len(gone)]
        if i % 20 == 7:  # alike to that one alone
            sets[f"{i:03}+"] = sorted({*sets[f"{i:03}"][1:], 9000 + i})
    rows = [(k.encode(), k.encode(), len(s), s, [1, 2]) for k, s in sets.items()]
    table = spark.createDataFrame(rows, "node binary, key binary, n_shingles long, shingles array<long>, buckets array<long>").cache()
    from lodestar.llm.shared import settle

    got = minhash.links(table.drop("shingles"), lambda wanted: settle(table.join(wanted.select("node"), "node", "left_semi").select("node", "shingles"), "full"))
    found = {bytes(r.node).decode(): bytes(r.component).decode() for r in got.collect()}
    least, pairs = {k: k for k in sets}, [(a, b) for a, x in sets.items() for b, y in sets.items() if 100 * len({*x} & {*y}) >= 85 * len({*x} | {*y})]
    for _ in range(9):
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    assert {k: found.get(k, k) for k in sets} == least and len(set(least.values())) > 50
    assert sum(compared) < 8 * len(sets)


def test_rare_pairs_lose_no_link(spark):
    """All pairs that are linked, of different roots, for sets of many sizes that share common and rare elements."""
    rng, sets = random.Random(8), {}
    for i in range(160):
        base = sets[rng.choice(sorted(sets))] if sets and rng.random() < 0.7 else rng.sample(range(60), rng.randrange(1, 40))
        sets[f"{i:03}"] = sorted({*rng.sample(base, max(1, len(base) - rng.randrange(4))), *rng.sample(range(400), rng.randrange(4))})
    for percent in (85, 60):
        wanted = {(a, b) for a, x in sets.items() for b, y in sets.items() if a < b and int(a) % 7 != int(b) % 7 and 100 * len({*x} & {*y}) >= percent * len({*x} | {*y})}
        nodes = spark.createDataFrame([(k.encode(), len(s), str(int(k) % 7).encode()) for k, s in sets.items()], "node binary, n long, root binary")
        full = spark.createDataFrame([(k.encode(), s) for k, s in sets.items()], "node binary, shingles array<long>")
        made = {(bytes(r.a).decode(), bytes(r.b).decode()): (r.na, r.nb) for r in minhash.rare_pairs(nodes, full, percent).collect()}
        assert wanted and wanted <= made.keys() and all((len(sets[a]), len(sets[b])) == v for (a, b), v in made.items())
        assert all(int(a) % 7 != int(b) % 7 for a, b in made)


def test_buckets_are_dealt_out_with_numbers_and_members_are_those_of_plain_counts(spark, monkeypatch):
    """Without digests until it is known who meets; a bucket that one node has twice counts twice, as it always did."""
    rng, plans, settle = random.Random(2), {}, minhash.settle
    monkeypatch.setattr(minhash, "small", lambda keys: keys)
    monkeypatch.setattr(minhash, "settle", lambda table, name: (plans.update({name: table._jdf.queryExecution().optimizedPlan().toString()}), settle(table, name))[1])
    held = {f"{i:03}": [rng.randrange(150) for _ in range(3)] for i in range(60)} | {"none": [], "twice": [-1, -1], "alone": [-2]}
    rows = [(k.encode(), k.encode(), len(k), b) for k, b in held.items()]
    table = spark.createDataFrame(rows, "node binary, key binary, n_shingles long, buckets array<long>")
    table = settle(table.selectExpr("*", "monotonically_increasing_id() AS number"), "numbered")
    found = sorted((r.bucket, bytes(r.node).decode(), r.n, r.crowd, bytes(r.root).decode()) for r in minhash._members(table).collect())
    of = {b: sum(x.count(b) for x in held.values()) for bs in held.values() for b in bs}
    crowd = {k: sum(of[b] for b in bs if of[b] > 1) for k, bs in held.items()}
    assert found == sorted((b, k, len(k), crowd[k], k) for k, bs in held.items() for b in bs if of[b] > 1) and len(found) > 60
    dealt = [re.findall(r"\w+(?=#)", line) for line in re.findall(r"Generate explode.*\n\W*(.*)", plans["open"])]
    assert dealt and all(set(columns) == {"number", "buckets"} for columns in dealt), plans["open"]


def test_sketches_estimate_the_similarity():
    rng = np.random.default_rng(3)
    for size in (8, 60, 3000):
        same = []
        for _ in range(300):
            both = np.unique(rng.integers(0, 2**64, size, np.uint64, endpoint=False))
            cut = len(both) // 4
            a, b = minhash.sketch(both[:]), minhash.sketch(np.delete(both, rng.choice(len(both), cut, replace=False)))
            same.append((a == b).mean())
        assert abs(np.mean(same) - 0.75) < 0.03, size
    one = minhash.sketch(np.array([5 << 60], np.uint64))
    assert (one == 5 << 60).all() and len(set(minhash.buckets(one[None])[0].tolist())) == minhash.BANDS


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(docs).collect() == []
