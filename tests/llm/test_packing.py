"""Packing: exact ids against the plain tokenizer, every id once, gapless sequences, little padding."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestar.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


ODD = [
    "", " ", None, "It's HIGH noon now", "<|endoftext|> a<|startoftext|>b", "é É x", "ß ſ İ Σς",
    "a\x1cb\x85c 12ab34 don't!!", "日本語 text 🙂🙂", "x" * 5000, "word " * 9000, "!!! ??? ...",
]


def test_ids_equal_the_tokenizer_on_whole_texts(plain):
    coder = packing.WordIds(PATH)
    for text in [t for t in ODD if t is not None]:
        got = np.frombuffer(coder.ids(text.encode()), "<u4").tolist()
        assert got == plain.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_ids_equal_on_any_text(text):
    coder, whole = packing.word_ids(PATH), Tokenizer.from_file(PATH) if not hasattr(packing, "_t") else packing._t
    packing._t = whole
    text = text.encode("utf-8", "ignore").decode()
    assert np.frombuffer(coder.ids(text.encode()), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_cache_is_bounded(plain, monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 5)
    coder = packing.WordIds(PATH)
    for text in ("a b c d", "e f g", "a b h i j k l m n"):
        assert np.frombuffer(coder.ids(text.encode()), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
    assert len(coder.cache) <= 9


def test_parts_of_a_text_and_lots_change_nothing(plain, monkeypatch):
    text = "It's a long line, no? (yes!) ¡olé! état... 12 x<|endoftext|> <|EndOfText|> « été. » é, ×, don't. " * 20
    whole = plain.encode(text, add_special_tokens=False).ids
    some = [text, "", "  ", text.replace("<|", ""), "end.", "é."] * 3
    for size in (1, 7, 100, 1 << 20):
        monkeypatch.setattr(packing, "TOGETHER", size)
        coder = packing.WordIds(PATH)
        assert coder.ids(text.encode()).tolist() == whole
        texts, got = packing.pa.array([t.encode() for t in some], packing.pa.large_binary()), []
        for first, last in packing.lots(texts):
            if last - first == 1:
                got.append(coder.ids(texts[first].as_py()).tolist())
            else:
                ids, counts = coder.together(texts.slice(first, last - first), b"\x01\0\0\0")
                got += [x[:-1].tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert got == [plain.encode(t, add_special_tokens=False).ids for t in some]


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 50)))
def test_histogram_packs_every_piece_once(counts):
    slots = packing.pack_histogram(counts, 32)
    used: dict[int, list] = {}
    for length, lo, hi, base, offset in slots:
        for k in range(hi - lo):
            used.setdefault(base + k, []).append((offset, length))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 32
    assert sorted(used) == list(range(len(used)))
    for length, n in counts.items():
        spans = sorted((lo, hi) for x, lo, hi, _, _ in slots if x == length)
        assert spans[0][0] == 0 and spans[-1][1] == n
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_documents(spark, plain):
    rows = [*enumerate(ODD), (3, "twice"), (3, "twice"), (None, "no id"), *((100 + i, "tie tie") for i in range(3000))]
    docs = spark.createDataFrame([(i, t, 7, 8) for i, t in rows], "doc_id long, text string, length int, rank int")
    out = packing.pack_documents(docs, PATH, keep_ids=True).toPandas()
    expected = {(i, t): [*plain.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    assert out.length.sum() == sum(len([*plain.encode(t or "", add_special_tokens=False).ids, 1]) for _, t in rows)
    for doc, part in out[out.doc_id.notna()].groupby("doc_id"):
        if doc != 3:
            ids = [i for x in part.sort_values("start").ids for i in x]
            assert ids == next(v for k, v in expected.items() if k[0] == doc)
            assert (part.doc_tokens == len(ids)).all()
    assert all(zlib.crc32(np.array(x, "<u4").tobytes()) == c for x, c in zip(out.ids, out.ids_crc32, strict=True))
    for _, part in out.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part.offset.tolist() == np.concatenate(([0], part.length.cumsum()[:-1])).tolist()
        assert part.length.sum() <= 2048
    assert out.length.sum() / (2048 * out.sequence_id.nunique()) > 0.9


def test_equal_pieces_spread(spark):
    """Rows that share id, start and length are ranked where they lie; none meet in one place."""
    same = spark.range(20_000, numPartitions=8).selectExpr("cast(null AS long) AS doc_id", "0L AS start", "700L AS length", "id AS rank")
    out = packing.pack(same)
    assert "_rank" not in out.columns and out.columns == ["doc_id", "start", "length", "rank", "sequence_id", "offset"]
    held = packing.numbered(same, packing.SIZE).groupBy("_part").count().collect()
    assert len(held) == 8 and max(r["count"] for r in held) == 2500
    got = out.groupBy("sequence_id").agg({"offset": "collect_list"}).collect()
    assert len(got) == 10_000 and all(sorted(r[1]) == [0, 700] for r in got)
    assert sorted(r.rank for r in out.select("rank").collect()) == list(range(20_000))


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_one_worker_a_task_cuts_and_numbers_small_batches(spark, monkeypatch):
    name, seen, settle = "spark.sql.execution.arrow.maxBytesPerBatch", {}, packing.settle

    def seeing(table, what):
        plan = table._jdf.queryExecution().executedPlan().toString()
        seen[what] = (plan.count("MapInArrow"), int(spark.conf.get(name).rstrip("b")))
        return settle(table, what)

    monkeypatch.setattr(packing, "settle", seeing)
    before = spark.conf.get(name)
    docs = spark.createDataFrame([(i, "some words here " * i) for i in range(50)], "doc_id long, text string")
    got = packing.pack_documents(docs, PATH, 64).collect()
    assert seen["pieces"] == (1, packing.HANDED) and spark.conf.get(name) == before
    assert sum(r.length for r in got) == sum({r.doc_id: r.doc_tokens for r in got}.values())
    held = sorted((r.sequence_id, r.offset, r.length) for r in got)
    assert all(x[1] + x[2] == y[1] if x[0] == y[0] else y[1] == 0 for x, y in zip(held, held[1:]))
