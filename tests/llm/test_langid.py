"""Language ID: the bit-sliced filters against plain sets, held-out accuracy, odd rows."""

import random
import zlib

import numpy as np

from lodestar.llm import langid

SYLLABLES = {"aa": ["ba", "bo", "bi", "ble"], "bb": ["ka", "ko", "ki", "kle"], "cc": ["ña", "ço", "éi", "ße"]}


def text(rng, lang, n=40):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_filters_contain_what_was_put_in_and_little_else():
    rng = np.random.default_rng(1)
    grams = rng.integers(0, 1 << 63, 6000, dtype=np.uint64)
    lang = rng.integers(0, 11, 6000)
    filters = langid.Filters([f"l{i:02}" for i in range(11)], slots=1 << 14).build(grams, lang)
    masks = None
    for at in langid._slots(grams, filters.slots, filters.hashes):
        masks = filters.table[at] if masks is None else masks & filters.table[at]
    assert all(masks[i, lang[i] // 8] >> lang[i] % 8 & 1 for i in range(6000))
    other = rng.integers(0, 1 << 63, 20000, dtype=np.uint64)
    masks = None
    for at in langid._slots(other, filters.slots, filters.hashes):
        masks = filters.table[at] if masks is None else masks & filters.table[at]
    assert np.allclose(filters._per_language(masks) / 20000, filters.false, atol=0.003)


def test_blocks_give_the_same_ngrams(monkeypatch):
    for line in ("Ab, cd1é fG. hij " * 50, "  12 a", "a", "no end" * 40 + "...", "12 3", ""):
        whole = [g for part in langid.ngrams(line) for g in part.tolist()]
        for block in (1, 2, 3, 97):
            monkeypatch.setattr(langid, "BLOCK", block)
            assert [g for part in langid.ngrams(line) for g in part.tolist()] == whole
        monkeypatch.undo()


def plain_grams(text):
    """N-grams as strings, one letter at a time."""
    row = " "
    for c in (text or "").lower():
        if c.isalpha():
            row += c
        elif row[-1] != " ":
            row += " "
    return [(row + "   ")[i : i + 4] for i in range(len(row))] if row.strip() else []


def plain_predictions(rows, learned):
    counts = {}
    for _, t, lang in learned:
        for g in plain_grams(t):
            counts.setdefault(lang, {}).setdefault(g, 0)
            counts[lang][g] += 1
    share = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in counts.items()}
    most = {}
    for c in share.values():
        for g, x in c.items():
            most[g] = max(most.get(g, 0), x)
    held = {lang: {g for g, x in c.items() if x >= langid.MIN_SHARE and x >= langid.MIN_RATIO * most[g]} for lang, c in share.items()}
    out = []
    for _, t, _ in rows:
        grams = plain_grams(t)
        found = {lang: sum(g in c for g in grams) for lang, c in held.items()}
        best = max(sorted(found), key=found.get)
        out.append(("und", 0.0) if not grams else (best, found[best] / sum(found.values())))
    return out


def test_predictions_equal_plain_sets(spark):
    rng = random.Random(8)
    rows = [(i, text(rng, lang := rng.choice(sorted(SYLLABLES)), 12), lang) for i in range(300)]
    rows += [(300 + i, f"{text(rng, 'aa', 3)} {text(rng, 'bb', 5 + i)}, {text(rng, 'cc', 4)}!", "bb") for i in range(40)]
    rows += [(400, None, None), (401, "12", "aa"), (402, "ba ka", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = [r for r in rows if r[2] and r[1] and zlib.crc32(str(r[0]).encode()) % 5]
    by = {r.doc_id: r for r in langid.languages(docs).collect()}
    for (i, _, _), (lang, score) in zip(rows, plain_predictions(rows, learned), strict=True):
        assert by[i].lang_pred == lang and abs(by[i].score - score) < 0.01


def test_held_out_accuracy_and_odd_rows(spark):
    rng = random.Random(2)
    rows = [(i, text(rng, lang := rng.choice(sorted(SYLLABLES))), lang, 0.5) for i in range(900)]
    odd = [(1000, None, "aa"), (1001, "", None), (1002, "123 !!", "bb"), (1003, "ωψχ", None), (1004, "ba", None)]
    odd += [(None, text(rng, "bb"), "bb"), (5, rows[5][1], rows[5][2]), (1005, text(rng, "cc", 90000), None)]
    docs = spark.createDataFrame([*rows, *((*r, 0.5) for r in odd)], "doc_id long, text string, lang string, score double")
    out = langid.languages(docs).collect()
    assert len(out) == len(rows) + len(odd)
    by = {r.doc_id: r for r in out}
    assert all(by[i].lang_pred == lang for i, _, lang, _ in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out if r.doc_id is not None)
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3
    assert by[1003].lang_pred in SYLLABLES and by[1003].score == 0
    assert by[1004].lang_pred == "aa" and by[1005].lang_pred == "cc" and by[None].lang_pred == "bb"
    assert all(0 <= r.score <= 1 for r in out)


def test_held_out_rows_and_missing_labels_are_not_learned(spark):
    rng = random.Random(4)
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    rows = [(i, text(rng, "aa"), "zz") for i in ids] + [(i, text(rng, "bb"), "bb") for i in range(400) if i not in ids]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.languages(docs).collect()} == {"bb"}


def test_empty_and_unlabelled_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.languages(docs).collect() == []
    docs = spark.createDataFrame([(1, "ba bo", None)], "doc_id long, text string, lang string")
    assert langid.languages(docs).first().lang_pred == "und"
