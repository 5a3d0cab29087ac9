"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded buckets, star edges.

One hash of every shingle serves all bins: its top bits name the bin, and a bin keeps its
least hash. An empty bin borrows from a bin that a hash of its own number and of the attempt
names, until one isn't empty, so the borrowed values are as good as drawn anew. Bands of bins
are buckets. In a bucket every member is compared with one centre, not with every other;
the links that hold on the full sets are joined to components, and a bucket whose members
still lie in several components gets another centre, as long as that finds many links. What
is left open then is settled exactly: pairs of different components are made from the rare
shingles that two sets must share to be linked. So all pairs that share a bucket are settled,
and a group of near copies costs about as many comparisons as it has members.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.sources.tables import drop

from .components import components
from .shared import kept, settle, small, trimmed

SEED = 42
#: Two sets at the similarity of the threshold share no bucket with probability (1 - 0.85 ** 4) ** 32 < 1e-10.
BANDS = 32
WIDTH = 4
BINS_LOG2 = 7
BINS = 1 << BINS_LOG2
SIMILAR = 85
ODD = np.uint64(0x9E3779B97F4A7C15)
CACHED_WORDS = 150_000
#: Attempts at borrowing that are drawn at a time.
ATTEMPTS = 64
#: Turns that compare centres at least; a later one is the last if it compares more pairs a link than this.
TURNS = 3
FRUITFUL = 20


class Words(dict):
    """XXH64 of words, those of late ones kept."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return value


def shingles(text: bytes | None, width: int = 3, known: Words | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; of fewer words, of all as one; none without words.

    A shingle's hash is a polynomial in the XXH64 of its words, mixed. ``bytes.lower`` changes
    A-Z only and ``bytes.split`` parts at 0x20 and 0x09-0x0D.
    """
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map((Words() if known is None else known).__getitem__, words), np.uint64, n)
    width = min(width, n)
    total = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        total = total * ODD + hashes[i : n - width + 1 + i]
    return np.unique(_mixed(total))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of integers (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64) + ODD
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def donors(attempt: int, n: int = ATTEMPTS) -> np.ndarray:
    """For every bin the bins it asks in attempts ``attempt`` to ``attempt + n``."""
    asked = np.arange(BINS, dtype=np.uint64)[:, None] << np.uint64(32) | np.arange(attempt, attempt + n, dtype=np.uint64)
    return (_mixed(asked) >> np.uint64(64 - BINS_LOG2)).astype(np.int64)


FIRST_DONORS = donors(0)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The bins' least hashes, empty bins borrowing; ``hashes`` are sorted and not empty."""
    bins = (hashes >> np.uint64(64 - BINS_LOG2)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    values, full = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    values[bins[first]], full[bins[first]] = hashes[first], True
    empty, attempt, asked = np.flatnonzero(~full), 0, FIRST_DONORS
    while len(empty):
        found = full[asked[empty]]
        at = found.argmax(axis=1)
        done = found[np.arange(len(empty)), at]
        values[empty[done]] = values[asked[empty[done], at[done]]]
        empty, attempt = empty[~done], attempt + ATTEMPTS
        asked = donors(attempt) if len(empty) else asked
    return values


def buckets(values: np.ndarray) -> np.ndarray:
    """One 64-bit key a band of every row of bins."""
    rows = values.reshape(len(values), BANDS, WIDTH)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), rows.shape[:2])
    for i in range(WIDTH):
        key = _mixed(key * np.uint64(31) + rows[:, :, i])
    return key.view(np.int64)


def sketches(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """``<id_col>, key, n_shingles, node, buckets`` of every row.

    ``key`` is a digest of the text, ``node`` one of its set, null if that is empty.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = kept("minhash", Words)
        for b in batches:
            size, nodes, bins = np.zeros(b.num_rows, np.int64), [], []
            for i, text in enumerate(b.column(2)):
                h = shingles(text.as_py(), width, known)
                size[i] = len(h)
                nodes.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                bins += [sketch(h)] if len(h) else []
            keys = buckets(np.array(bins)).reshape(-1) if bins else np.zeros(0, np.int64)
            ends = np.concatenate(([0], np.cumsum((size > 0) * BANDS))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(size), pa.array(nodes, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys))],
                [id_col, "key", "n_shingles", "node", "buckets"],
            )

    own = docs.select(F.col(id_col).alias(id_col), _text_key(text_col), _text(text_col).alias("text"))
    return own.mapInArrow(trimmed(hashed), f"`{id_col}` {kind}, key binary, n_shingles bigint, node binary, buckets array<bigint>")


def _text(text_col: str):
    return F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")


def _text_key(text_col: str):
    return F.unhex(F.md5(_text(text_col))).alias("key")


def full_sets(docs: DataFrame, wanted: DataFrame, width: int, text_col: str) -> DataFrame:
    """``node, shingles`` of the wanted nodes (``node, key``), from a text with that key each."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = kept("minhash", Words)
        seen: set[bytes] = set()
        for b in batches:
            keys, found = [], []
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if key not in seen:
                    seen.add(key)
                    keys.append(key)
                    found.append(shingles(text.as_py(), width, known).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.list_(pa.int64()))], ["key", "shingles"])

    few = small(wanted)
    rows = docs.select(_text_key(text_col), _text(text_col).alias("text")).join(few.select("key"), "key", "left_semi")
    made = settle(rows.mapInArrow(trimmed(hashed), "key binary, shingles array<bigint>"), "shingles")
    full = settle(made.join(few, "key").select("node", "shingles").dropDuplicates(["node"]), "full")
    drop(made)
    return full


Sets = Callable[[DataFrame], DataFrame]


def linked(edges: DataFrame, distinct: DataFrame, sets: Sets, full: DataFrame | None, percent: int) -> DataFrame:
    """The edges (``a, b, na, nb``, with the sizes of the sets) whose full sets are so similar, as ``a, b``.

    ``full`` has the sets already, if they were made for these nodes.
    """
    own = full
    if full is None:
        nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        own = sets(settle(distinct.select("node", "key").join(nodes, "node", "left_semi"), "wanted"))
    rows = edges.join(own.toDF("b", "sb"), "b").join(own.toDF("a", "sa"), "a")
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    found = settle(rows.where(100 * common >= percent * (F.col("na") + F.col("nb") - common)).select("a", "b"), "links")
    if full is None:
        drop(own)
    return found


def most(shared: Column, size: Column, percent: int) -> Column:
    """The largest set that one of a size can be linked with, if it has no more than ``shared`` shingles in common with any.

    Sets of sizes n and m with c in common are linked if (100 + percent) * c >= percent * (n + m).
    """
    return F.floor(shared * (100 + percent) / percent).cast("long") - size


def _members(distinct: DataFrame) -> DataFrame:
    """``bucket, node, n, crowd, root`` of the members of buckets that have others.

    ``crowd`` sums the sizes of a node's buckets: of many near copies, the one that the others were made of meets most.
    All buckets of all nodes are dealt out here, and most have no other, so a node's number goes with them, not its digest.
    """
    spread = distinct.select("number", F.explode("buckets").alias("bucket"))
    many = settle(spread.groupBy("bucket").agg(F.count("*").alias("of")).where("of > 1"), "shared")
    crowd = F.sum("of").over(Window.partitionBy("number"))
    met = spread.join(small(many), "bucket").select("bucket", "number", crowd.alias("crowd"))
    nodes = distinct.select("number", "node", F.col("n_shingles").alias("n"))
    members = settle(met.join(nodes, "number").select("bucket", "node", "n", "crowd", F.col("node").alias("root")), "open")
    drop(many)
    return members


def _ends(rows: DataFrame, node: str, n: str) -> DataFrame:
    """``a, b, na, nb`` of pairs of a ``node`` of size ``n`` and another, once each, the smaller node first."""
    first = F.col("node") < F.col(node)
    ends = [F.when(first, F.col(x)).otherwise(F.col(y)).alias(name) for x, y, name in
            (("node", node, "a"), (node, "node", "b"), ("n", n, "na"), (n, "n", "nb"))]
    return rows.select(*ends).distinct()


def _stars(left: DataFrame, centres: DataFrame, percent: int) -> DataFrame:
    """``a, b, na, nb`` of every member and its bucket's centre, if they lie in different components and their sizes let them be linked."""
    sizes = 100 * F.least("n", "c_n") >= percent * F.greatest("n", "c_n")
    fits = (left["bucket"] == centres["bucket"]) & F.expr("root != c_root") & sizes
    return _ends(left.join(centres, fits), "c_node", "c_n")


def _unsettled(members: DataFrame, centres: DataFrame, found: DataFrame) -> DataFrame:
    """The members but the centres, with their roots now, of buckets in which several components meet."""
    rest = members.drop("root").join(centres.select("bucket", F.col("c_node").alias("node")), ["bucket", "node"], "left_anti")
    now = rest.join(found.toDF("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = settle(now.select(*members.columns), "rooted")
    apart = rooted.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("bucket")
    left = settle(rooted.join(apart, "bucket", "left_semi"), "open")
    drop(rooted)
    return left


def rare_pairs(nodes: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """``a, b, na, nb`` of all pairs of ``nodes`` (``node, n, root``) that may be linked, of different roots; ``full`` has their sets.

    Shingles are ordered by how many of the nodes have them, rarest first. If the first one
    that two sets share has ``before`` others before it in one of them, they share ``n -
    before`` at most, so they are paired only on a shingle that lies so early in both that
    this, with both sizes, leaves them a chance. No pair that can be linked is lost.
    """
    few = small(nodes)
    each = full.join(few.select("node"), "node", "left_semi").select("node", F.explode("shingles").alias("shingle"))
    # Settled, so that a shingle of very many sets is a plain join, which Spark can split.
    often = settle(each.groupBy("shingle").agg(F.count("*").alias("of")).where("of > 1"), "often")
    own = Window.partitionBy("node")
    # Those that no other has come before all of these, so this is n - before.
    rest = F.count("*").over(own) - F.row_number().over(own.orderBy("of", "shingle")) + 1
    placed = each.join(often, "shingle").select("node", "shingle", rest.alias("rest")).join(few, "node")
    early = placed.select("shingle", "node", "n", "root", most(F.col("rest"), F.col("n"), percent).alias("most"))
    early = settle(early.where(100 * F.col("most") >= percent * F.col("n")), "early")
    roots = early.groupBy("shingle", "root").agg(F.count("*").alias("of"), F.min("n").alias("n"), F.max("most").alias("most"))
    span = [F.count("*").alias("roots"), F.max_by("root", "of").alias("main"), F.min("n").alias("least_n"), F.max("most").alias("most_most")]
    spans = settle(roots.groupBy("shingle").agg(*span).where("roots > 1"), "spans")
    hopeful = early.join(spans, "shingle").where("most >= least_n and n <= most_most")
    hopeful = settle(hopeful.select(*early.columns, "main"), "hopeful")
    # One of a pair is outside the commonest component, so the members of that aren't matched with each other.
    others = hopeful.drop("main").toDF("shingle", "o_node", "o_n", "o_root", "o_most")
    pairs = hopeful.where("root != main").join(others, "shingle").where("root != o_root and n <= o_most and o_n <= most")
    made = settle(_ends(pairs.where("o_root = main or node < o_node"), "o_node", "o_n"), "pairs")
    for table in (often, early, spans, hopeful):
        drop(table)
    return made


def merged(found: DataFrame | None, new: DataFrame) -> DataFrame:
    """``node, component`` after new links: only the components that they join are worked on."""
    if found is None:
        return settle(components(new, "a", "b"), "components")
    joined = new.join(found.toDF("a", "ra"), "a", "left").join(found.toDF("b", "rb"), "b", "left")
    between = settle(joined.select(F.coalesce("ra", "a").alias("u"), F.coalesce("rb", "b").alias("v")).where("u != v").distinct(), "between")
    if between.isEmpty():
        return found
    moved = settle(components(between, "u", "v").toDF("root", "to"), "moved")
    alone = moved.join(found, moved["root"] == found["node"], "left_anti").select(F.col("root").alias("node"), F.col("root").alias("component"))
    every = found.union(alone)
    after = every.join(moved, every["component"] == moved["root"], "left")
    return settle(after.select("node", F.coalesce("to", "component").alias("component")), "components")


def links(distinct: DataFrame, sets: Sets, percent: int = SIMILAR) -> DataFrame:
    """``node, component`` over all links between distinct sets that share a bucket.

    ``distinct`` has ``node, key, n_shingles, buckets``, and ``number`` if its nodes are numbered
    already; ``sets`` gives the full sets of nodes.
    ``left`` holds the members of buckets that are not yet compared. A turn compares a centre
    with the others; it leaves the bucket then, and a bucket goes once its members lie in one
    component. When a turn finds few links, all pairs that are left and may be linked are made
    from rare shingles.
    """
    if "number" not in distinct.columns:
        distinct = settle(distinct.withColumn("number", F.monotonically_increasing_id()), "numbered")
    left = _members(distinct)
    found: DataFrame | None = None
    full: DataFrame | None = None
    turn = 0
    while not left.isEmpty():
        if turn and full is None:
            # Who is open later is open now, so the texts are hashed once.
            nodes = left.select("node").distinct()
            full = sets(settle(distinct.select("node", "key").join(nodes, "node", "left_semi"), "wanted"))
        turn += 1
        order = F.struct((-F.col("crowd")).alias("less"), F.xxhash64("node").alias("mix"), "node", "n", "root")
        centres = left.groupBy("bucket").agg(F.min(order).alias("c")).select("bucket", "c.*")
        centres = settle(centres.select("bucket", *(F.col(c).alias(f"c_{c}") for c in ("node", "n", "root"))), "centres")
        edges = settle(_stars(left, centres, percent), "stars")
        new = linked(edges, distinct, sets, full, percent)
        found = merged(found, new)
        if turn >= TURNS and new.count() * FRUITFUL < edges.count():
            break
        before = [left, centres, edges]
        left = _unsettled(left, centres, found)
        for table in before:
            drop(table)
    if found is None:
        return distinct.select("node", F.col("node").alias("component")).limit(0)
    if left.isEmpty():
        return found
    nodes = left.select("node", "n").distinct().join(found.toDF("node", "root"), "node", "left")
    nodes = settle(nodes.select("node", "n", F.coalesce("root", "node").alias("root")), "nodes")
    return merged(found, linked(rare_pairs(nodes, full, percent), distinct, sets, full, percent))


def near_duplicates(
    docs: DataFrame, width: int = 3, percent: int = SIMILAR, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``<id_col>, n_shingles, component_id, kept`` for every row; other columns are left out.

    Texts are linked whose sets of distinct word shingles have ``100 * intersection >= percent
    * union``. ``component_id`` is the smallest id reachable; ``kept`` marks the rows that have
    it. Texts without words, null or empty, have an empty set and are linked with nothing.
    Repeated rows stay and share a component; rows that share an id too are kept alike. A row
    with a null id takes part: it gets the smallest id of its component, and is kept only if
    no row of it has an id. An empty table gives an empty result.
    """
    own = settle(sketches(docs, width, id_col, text_col), "sketches")
    sets_of = own.where("node is not null").groupBy("node")
    distinct = sets_of.agg(F.min(id_col).alias("least"), F.min("key").alias("key"), F.first("n_shingles").alias("n_shingles"), F.first("buckets").alias("buckets"))
    # Settled with the numbers, so that they are the same wherever they are read.
    distinct = settle(distinct.withColumn("number", F.monotonically_increasing_id()), "distinct")
    found = links(distinct.drop("least"), lambda wanted: full_sets(docs, wanted, width, text_col), percent)
    least = distinct.select("node", "least")
    rooted = least.join(found, "node", "left").select("node", "least", F.coalesce("component", "node").alias("root"))
    rooted = settle(rooted, "rooted")
    # Settled, so that a component of very many texts is a plain join, which Spark can split.
    ids = settle(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "ids")
    classes = settle(rooted.select("node", "root").join(ids, "root").select("node", "component_id"), "classes")
    rows = own.select(id_col, "n_shingles", F.col("node").alias("own_node"))
    rows = rows.join(classes, F.col("own_node") == F.col("node"), "left")
    reached = F.when(F.col("own_node").isNull(), F.col(id_col)).otherwise(F.col("component_id"))
    return rows.select(id_col, "n_shingles", reached.alias("component_id"), F.col(id_col).eqNullSafe(reached).alias("kept"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM d),
n AS MATERIALIZED (SELECT r, doc_id, len(g) AS n, list_sort(g) AS g FROM s),
e AS (SELECT g, min(r) AS r, any_value(n) AS n FROM n WHERE n > 0 GROUP BY g),
x AS MATERIALIZED (SELECT r, n, unnest(g) AS h FROM e),
near AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM x a JOIN x b ON a.h = b.h AND a.r < b.r AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
reach AS (SELECT r AS a, r AS b FROM e UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
ids AS (SELECT e.r, min(n.doc_id) AS least FROM e JOIN n USING (g) GROUP BY e.r),
comp AS (SELECT reach.a AS r, min(least) AS component_id FROM reach JOIN ids ON ids.r = reach.b GROUP BY reach.a)
SELECT doc_id, n.n AS n_shingles, CASE WHEN n.n = 0 THEN doc_id ELSE component_id END AS component_id,
  doc_id IS NOT DISTINCT FROM CASE WHEN n.n = 0 THEN doc_id ELSE component_id END AS kept
FROM n LEFT JOIN e ON n.g = e.g LEFT JOIN comp ON comp.r = e.r
"""
