"""The corpus pipeline stage by stage against brute-force versions, and its odd rows."""

import random

import corpus_pipeline
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestar.llm import secrets
from tests.llm.test_decontamination import plain as plain_contamination
from tests.llm.test_simhash import plain_classes

SYLLABLES = {"aa": ["ba", "bo", "bi", "ble"], "bb": ["ka", "ko", "ki", "kle"]}
HEX = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    rows = []
    for i in range(300):
        lang = rng.choice(sorted(SYLLABLES))
        rows.append((i, prose(rng, lang, rng.randrange(20, 150)), lang))
    items = [(i, prose(rng, "aa", 20)) for i in range(5)]
    rows += [(300 + i, rows[i][1], rows[i][2]) for i in range(20)]
    rows += [(400 + i, prose(rng, "aa", 30) + " " + text, "aa") for i, text in items]
    rows += [(500, f'{prose(rng, "bb", 40)} token = "{HEX}" {prose(rng, "bb", 5)}', "bb")]
    rows += [(600, None, "aa"), (601, "", "aa"), (602, "123", "aa"), (603, prose(rng, "bb", 80), "aa"), (604, prose(rng, "bb", 50), None)]
    rows += [(605, "twice here " + prose(rng, "bb", 30), "bb")] * 2 + [(None, prose(rng, "bb", 60), "bb")]
    path = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame([(i, t, g, "src", len(t or "")) for i, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, items


def test_stages_equal_brute_force(spark, folder):
    path, rows, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)

    docs = stages["language_id"](spark, docs, path)
    assert docs.columns == columns
    kept = {(r.doc_id, r.text) for r in docs.collect()}
    assert kept == {(i, t) for i, t, _ in rows if i not in (600, 601, 602, 603)}

    docs = stages["near_dedup"](spark, docs, path)
    assert docs.columns == columns
    once = sorted(kept, key=str)
    stay = {(int(i), f) for i, f, c in plain_classes(once, corpus_pipeline.SHINGLE) if i is not None and i == c}
    got = [r.doc_id for r in docs.collect()]
    assert sorted(i for i in got if i is not None) == sorted(i for i, _ in stay) and got.count(None) == 1

    before = [(r.doc_id, r.text) for r in docs.collect()]
    docs = stages["decontamination"](spark, docs, path)
    clean = {r[0] for r in plain_contamination(before, items) if not r[5]}
    assert docs.columns == columns and sorted((r.doc_id for r in docs.collect()), key=str) == sorted(clean, key=str)
    assert not clean & set(range(400, 405))

    before = {r.doc_id: r.text for r in docs.collect()}
    docs = stages["secret_scan"](spark, docs, path)
    after = {r.doc_id: (r.text, r.n_chars) for r in docs.collect()}
    assert docs.columns == columns
    masked = {i: t.replace(HEX, secrets.MASK) for i, t in before.items()}
    assert after == {i: (t, len(t)) for i, t in masked.items()}

    tokenizer = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    out = stages["packing"](spark, docs, path).collect()
    tokens = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in masked.items()}
    assert {r.doc_id: r.doc_tokens for r in out} == tokens and sum(r.length for r in out) == sum(tokens.values())
    whole = corpus_pipeline.run(spark, path).collect()
    assert sorted((str(r.doc_id), r.start, r.length, r.ids_crc32) for r in whole) == sorted((str(r.doc_id), r.start, r.length, r.ids_crc32) for r in out)


def test_empty_documents(spark, folder, tmp_path):
    path, _, _ = folder
    spark.read.parquet(f"{path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{path}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_extra_columns_are_carried(spark, folder):
    path, rows, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").selectExpr("*", "doc_id AS score", "lang AS component_id", "1 AS kept_id", "text AS row",
        "1 AS id", "2 AS other", "'k' AS key", "true AS stays", "3 AS same", "4 AS root", "5 AS n")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).columns == docs.columns, name
