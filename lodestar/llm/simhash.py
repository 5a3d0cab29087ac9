"""SimHash near-duplicates: fingerprints of word shingles, linked by meet-in-the-middle ball hashing.

Two fingerprints at most ``2 * half`` bits apart have a value in common that is at most
``half`` bits from each. So every distinct fingerprint emits all values in the ball of
radius ``half`` around it; fingerprints that meet at a value are linked. Copies fall
together before the balls are emitted, and at most as many distinct fingerprints as a ball
has values can meet at one, so no group grows with the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import kept, settle, trimmed

BITS = 64
SEED = 42
#: Variants that one task makes at about most.
TASK_ROWS = 1_000_000
#: Shingles hashed at a time, which bounds the memory of a very long text.
BLOCK = 1 << 16


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """SimHash of one text in UTF-8, as an unsigned integer; 0 without words.

    ``bytes.lower`` changes A-Z only and ``bytes.split`` parts at 0x20 and 0x09-0x0D.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    line, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    width = min(shingle, len(words))
    n, digest = len(words) - width + 1, xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), (ends[width - 1 :] - 1).tolist(), strict=True)
    ones = np.zeros(BITS, np.int64)
    while block := [digest(line[a:b], SEED) for a, b in islice(spans, BLOCK)]:
        hashes = np.array(block, dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(hashes, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, fp``: the 64-bit fingerprint of every whole text, as a signed long; ids keep their type.

    A null or empty text has fingerprint 0; a text of fewer words than a shingle is one shingle.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("fingerprints", lambda: None)
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], [id_col, "fp"])

    own = docs.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").cast("binary"))
    return own.mapInArrow(trimmed(hashed), f"`{id_col}` {own.schema[0].dataType.simpleString()}, fp long")


def ball_links(fps: DataFrame) -> DataFrame:
    """``a, b``: links between distinct fingerprints (column ``fp``) at 1 or 2 differing bits.

    Every fingerprint emits itself and its 64 one-bit variants. Which fingerprints met at a
    variant is a mask of flipped bits, merged by ``bit_or``; the members are read off the
    mask. They are linked to the least of them as a star, which keeps every component: any
    two that meet at a variant are at most two bits apart. Each link is verified.
    """
    # Every row becomes 65, so the rows are dealt to as many tasks as their number asks for.
    tasks = fps.count() * (BITS + 1) // TASK_ROWS + 1
    flips = fps.repartition(tasks, "fp").select("fp", F.explode(F.sequence(F.lit(-1), F.lit(BITS - 1))).alias("bit"))
    mask = F.when(F.col("bit") >= 0, F.expr("shiftleft(1L, bit)")).otherwise(F.lit(0).cast("long"))
    met = (
        flips.withColumn("mask", mask)
        .select(F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"), "mask")
        .groupBy("variant")
        .agg(F.bit_or("mask").alias("masks"), F.max(F.col("mask") == 0).alias("own"))
        .where(F.bit_count("masks") + F.col("own").cast("int") > 1)
    )
    members = F.expr(
        "concat(transform(filter(sequence(0, 63), i -> (shiftrightunsigned(masks, i) & 1L) = 1L),"
        " i -> variant ^ shiftleft(1L, i)), if(own, array(variant), array()))"
    )
    stars = met.select(members.alias("met")).select(F.array_min("met").alias("a"), F.explode("met").alias("b"))
    return stars.where("a != b").distinct().where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)


def near_duplicates(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, fingerprint, component_id`` for every row; other columns are left out.

    Rows whose fingerprints differ in 2 bits or fewer are linked; ``component_id`` is the
    smallest id reachable over links. Repeated rows stay and share a component; a row with a
    null id gets the component of its fingerprint, null if no row there has an id. An empty
    table gives an empty result.
    """
    prints = settle(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    distinct = settle(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct")
    found = components(ball_links(distinct), "a", "b").withColumnsRenamed({"node": "fp", "component": "root"})
    rooted = settle(distinct.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    # Settled, so that a component of very many fingerprints is a plain join, which Spark can split.
    ids = settle(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "ids")
    classes = settle(rooted.select("fp", "root").join(ids, "root").select("fp", "component_id"), "classes")
    return prints.join(classes, "fp").select(
        id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
