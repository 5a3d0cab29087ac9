"""Benchmark decontamination with an FM-index per shard of the training documents.

Phrases are windows of consecutive benchmark words. A shard is some whole documents of one
partition, about ``SHARD_WORDS`` words; runs of words that no phrase has become one
separator before it is indexed. All phrases are searched backward in the shard's index,
their occurrences located, mapped to documents and merged to spans. A large benchmark is
taken in blocks of bounded size: documents pass through one map, whose shards take up one
block's phrases after another.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fm_index import FMIndex
from .shared import kept, settle, trimmed

WINDOW = 13
SHARD_WORDS = 500_000
#: Benchmarks are taken in blocks of about so many bytes, each broadcast on its own.
BLOCK_BYTES = 4 << 20

_SAME = "0123456789abcdefghijklmnopqrstuvwxyz"
_FOLD = bytes(
    b if b > 0x7F or chr(b) in _SAME else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)  # A-Z lower-cased, all other ASCII but letters and digits is white space

SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def words_of(text: bytes | None) -> list[bytes]:
    return bytes(text or b"").translate(_FOLD).split()


class Phrases:
    """The distinct windows of some benchmark items, as word ids, and the items of each."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int) -> None:
        self.ids: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            line = [self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text)]
            width = min(window, len(line))
            for i in range(len(line) - width + 1 if line else 0):
                found.setdefault(tuple(line[i : i + width]), set()).update(() if item is None else (item,))
        self.lengths = np.array([len(p) for p in found], np.int64)
        self.table = np.zeros((len(found), window), np.int64)
        for row, phrase in zip(self.table, found, strict=True):
            row[: len(phrase)] = phrase
        self.items = [sorted(x) for x in found.values()]


class Shard:
    """Documents gathered until they are searched together."""

    def __init__(self) -> None:
        self.rows: list = []
        self.texts: list[bytes] = []
        self.sizes: list[int] = []
        self.size = 0

    def add(self, row: object, text: bytes | None) -> None:
        """Words are joined by single blanks, which takes far less room than a list of them."""
        words = words_of(text)
        self.texts.append(b" ".join(words))
        self.sizes.append(len(words))
        self.rows.append(row)
        self.size += len(words) + 1

    def matches(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document's row, first word, phrase) of every occurrence."""
        none = np.zeros(0, np.int64)
        if not len(phrases.lengths) or not self.rows:
            return none, none, none
        # Each document ends with a separator, so that place - row counts words of the shard.
        text = np.zeros(self.size, np.int32)
        begin = np.cumsum([0, *(n + 1 for n in self.sizes)])
        for line, a in zip(self.texts, begin.tolist(), strict=False):
            words = line.split()
            text[a : a + len(words)] = list(map(phrases.ids.get, words, repeat(0)))
        kept = text != 0
        kept[1:] |= text[:-1] != 0
        kept[-1] = True
        where = np.flatnonzero(kept)
        index = FMIndex(text[where], len(phrases.ids) + 1)
        low, high = index.search(phrases.table, phrases.lengths)
        phrase = np.repeat(np.arange(len(low)), high - low)
        ahead = np.arange(len(phrase)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
        at = where[index.locate(low[phrase] + ahead)]
        row = np.searchsorted(begin, at, "right") - 1
        return row, at - begin[row], phrase

    def results(self, blocks: Iterator[Phrases]) -> list[tuple]:
        """(row, words, spans, items) of every document, in order, over all blocks of phrases."""
        spans: dict[int, list] = {}
        items: dict[int, set[str]] = {}
        for phrases in blocks:
            row, first, phrase = self.matches(phrases)
            for r, a, p in zip(row.tolist(), first.tolist(), phrase.tolist(), strict=True):
                spans.setdefault(r, []).append([a, a + int(phrases.lengths[p])])
                items.setdefault(r, set()).update(phrases.items[p])
            # One block's occurrences are merged before the next one's come.
            for r in set(row.tolist()):
                spans[r] = merged(spans[r])
        return [(row, n, spans.get(r, []), sorted(items.get(r, ()))) for r, (row, n) in enumerate(zip(self.rows, self.sizes, strict=True))]


def merged(spans: list) -> list:
    """The union of spans, in order."""
    out: list = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _search(docs: DataFrame, phrases: Callable[[], Iterator[Phrases]], id_col: str) -> DataFrame:
    """``<id_col>, spans, items, n_words`` of rows ``<id_col>, text``."""

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("decontamination", lambda: None)
        shard, kind = Shard(), None

        def done() -> pa.RecordBatch:
            docs, n, spans, items = zip(*shard.results(phrases()), strict=True)
            spans = [[{"start": a, "end": b} for a, b in x] for x in spans]
            kinds = [kind, SPANS, pa.list_(pa.string()), pa.int64()]
            arrays = [pa.array(v, k) for v, k in zip((docs, spans, items, n), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, [id_col, "spans", "items", "n_words"])

        for batch in batches:
            kind = batch.column(0).type
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                shard.add(doc.as_py(), text.as_py())
                if shard.size >= SHARD_WORDS:
                    yield done()
                    shard = Shard()
        if shard.rows:
            yield done()

    kind_of = docs.schema[id_col].dataType.simpleString()
    return docs.mapInArrow(trimmed(searched), f"`{id_col}` {kind_of}, spans array<struct<start:long,end:long>>, items array<string>, n_words long")


def _blocks(items: DataFrame, window: int) -> Callable[[], Iterator[Phrases]]:
    """The phrases of benchmark rows ``item, words``, block by block.

    A block's rows are read together with the block's number alone, so the driver holds one
    block, and a task takes up one block's phrases at a time.
    """
    size = items.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    held = []
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == block).collect()
        held.append(items.sparkSession.sparkContext.broadcast(Phrases([(r[0], r[1]) for r in part], window)))

    def taken() -> Iterator[Phrases]:
        for one in held:
            yield one.value
            if len(held) > 1:
                vars(one).pop("_value", None)  # read anew from the executor's copy when next asked for

    return taken


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``<id_col>, n_words, n_hit, spans, items`` of every document.

    ``spans`` are the merged removal spans, in words; ``items`` the benchmark items with an
    occurring window, as sorted strings. A null text has no words. An item without words has
    no window; a null item id hits words but is not listed. Repeated rows stay. Empty tables
    give no rows, or no hits.

    Benchmark rows that repeat count once. The benchmark is broadcast in blocks of
    ``BLOCK_BYTES`` (or one longer item). Other columns of ``docs`` are left out.
    """
    items = benchmark.select(
        F.col(item_col).cast("string").alias("item"), F.col(item_text).cast("string").cast("binary").alias("words")
    )
    own = docs.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").cast("binary").alias("text"))
    found = _search(own, _blocks(settle(items.distinct(), "benchmark"), window), id_col)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(id_col, "n_words", hit.alias("n_hit"), "spans", "items")


def verdicts(found: DataFrame) -> DataFrame:
    """Replace spans and items by digests and judge: contaminated where a twentieth of the words is hit."""
    return found.select(
        *(c for c in found.columns if c not in ("spans", "items")),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (
  SELECT item_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i + 1:i + n], ' ') AS k
  FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(0, len(w) - least(13, len(w)) + 1)) AS i
        FROM b WHERE len(w) > 0)),
dw AS (
  SELECT rid, i, n, array_to_string(w[i + 1:i + n], ' ') AS k
  FROM (SELECT rid, w, n, unnest(range(0, len(w) - n + 1)) AS i
        FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
occ AS (SELECT rid, i, dw.n, item_id FROM dw JOIN win ON dw.n = win.n AND dw.k = win.k),
hit AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM occ) GROUP BY rid),
its AS (
  SELECT rid, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS x FROM occ WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)
"""
