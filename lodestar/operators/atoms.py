"""Facts as single complex vectors, and facts read off vectors whose predicate and arity are unknown.

A fact is ``tag x (predicate + sum of role_i x argument_i)``, of length 1. Roles are powers of
one base vector. A symbol's angles depend on its space and name alone, so any task can make
them, and what is known of a vector can be subtracted from it anywhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions import phases
from lodestar.operators.vectors import FEW, SLICE, _unit, best
from lodestar.plans.rules import Atom, Var
from lodestar.sources.tables import drop, settle

TAG = ("TAG", "ATOM")
ROLE = ("ARG", "ROLE")
#: Least similarity at which a symbol is read off.
THRESHOLD = 0.2
MOST_ARGS = 5
#: Vectors that are read first, to learn which entities are common.
SAMPLE = 512
#: Share of a vector's length below which nothing is left of it.
NOTHING = 1e-6
#: Signs of so many components make a key; so many keys are looked up.
KEY_PARTS, KEYS = 12, 10
#: Vectors that are read at once for common entities.
PIECE = 256
#: Similarity at which a symbol is the nearest one for certain, in so many dimensions or more.
SURE, SURE_FROM = 0.9, 512


@lru_cache(maxsize=4096)
def symbol(space: str, name: str, dimension: int) -> np.ndarray:
    """A symbol's unit complex numbers."""
    seed = hashlib.blake2b(f"{space}\0{name}".encode(), digest_size=16).digest()
    return np.exp(1j * np.random.Generator(np.random.Philox(int.from_bytes(seed, "little"))).uniform(-np.pi, np.pi, dimension))


@lru_cache(maxsize=256)
def role(place: int, dimension: int) -> np.ndarray:
    """The role of the ``place``-th argument, from 1."""
    return symbol(*ROLE, dimension) ** place


def _flat(v: np.ndarray) -> np.ndarray:
    """Real and imaginary parts one after the other: their dot product is the real part of the complex one."""
    return np.concatenate((v.real, v.imag))


def _complex(v: list[float] | bytes) -> np.ndarray:
    x = np.frombuffer(v) if isinstance(v, bytes) else np.asarray(v, float)
    return x[: len(x) // 2] + 1j * x[len(x) // 2 :]


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows spread over tasks while they are short: those of a few bytes lie in one task, and get a vector each.

    What makes the vectors is called nondeterministic, lest Spark make them a second time for a filter below this.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def symbols(names: DataFrame, space: str, dimension: int) -> DataFrame:
    """``space, name, vec`` of distinct names."""
    rows = _dealt(names.select(F.col(names.columns[0]).cast("string").alias("name")).where("name is not null").distinct())

    @F.pandas_udf("array<double>")
    def made(some: pd.Series) -> pd.Series:
        return pd.Series([_flat(symbol(space, n, dimension)) for n in some])

    return rows.select(F.lit(space).alias("space"), "name", made.asNondeterministic()("name").alias("vec"))


def role_similarities(spark, places: int, dimension: int) -> DataFrame:
    """``a, b, similarity`` of every two roles."""
    base = phases.random_phases(F.lit(ROLE[0]), F.lit(ROLE[1]), dimension)
    rows = spark.range(1, places + 1).select(F.col("id").cast("int").alias("a"), phases.complex_of(phases.power(base, F.col("id"))).alias("u"))
    both = rows.join(rows.toDF("b", "v"), F.col("b") <= places)  # as many rows as places
    return both.select("a", "b", phases.similarity(F.col("u"), F.col("v")).alias("similarity"))


def encode(facts: DataFrame, dimension: int) -> DataFrame:
    """Add ``vec`` to facts in long form (``predicate, args``); a null argument leaves its place empty."""

    @F.pandas_udf("array<double>")
    def coded(predicates: pd.Series, args: pd.Series) -> pd.Series:
        out = []
        for p, some in zip(predicates, args, strict=True):
            total = symbol("P", p, dimension).copy()
            for i, a in enumerate(some):
                if a is not None:
                    total += role(i + 1, dimension) * symbol("E", a, dimension)
            total *= symbol(*TAG, dimension)
            out.append(_flat(total / np.linalg.norm(total)))
        return pd.Series(out)

    return _dealt(facts).withColumn("vec", coded.asNondeterministic()(F.col("predicate"), F.col("args").cast("array<string>")))


def _solved(gram: np.ndarray, products: np.ndarray) -> np.ndarray:
    """Least squares by normal equations; different symbols of many dimensions are nearly orthogonal."""
    try:
        return np.linalg.solve(gram, products)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(gram, products, rcond=None)[0]


def _rest(vec: list[float] | bytes, predicate: str | None, args: list[str | None], without: int) -> np.ndarray:
    """The untagged vector less what is known of it, all but the argument at a place (from 0)."""
    v = _complex(vec)
    dimension = len(v)
    v = v * symbol(*TAG, dimension).conj()
    known = [symbol("P", predicate, dimension)] if predicate is not None else []
    known += [role(i + 1, dimension) * symbol("E", a, dimension) for i, a in enumerate(args) if i != without and a is not None]
    if known:
        # All that is known at once by least squares, so that symbols alike aren't taken off twice.
        basis = np.stack(known, axis=1)
        v = v - basis @ (_solved(basis.conj().T @ basis, basis.conj().T @ v) if dimension >= SURE_FROM else np.linalg.lstsq(basis, v, rcond=None)[0])
    return v


def _nothing_left(v: np.ndarray, vec: bytes) -> bool:
    return bool(np.linalg.norm(v) <= NOTHING * np.linalg.norm(np.frombuffer(vec)))


def _packed(vectors: DataFrame) -> DataFrame:
    """``id, vec`` with vectors as bytes, which are read and written as one value; null ones are left out."""
    kind = vectors.schema["id"].dataType.simpleString()

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "vec": [None if v is None else np.asarray(v, float).tobytes() for v in b["vec"]]})

    return settle(vectors.select("id", "vec").mapInPandas(made, f"id {kind}, vec binary").where("vec is not null"), "vectors")


def _nearest(asked: DataFrame, names: DataFrame, space: str, threshold: float) -> DataFrame:
    """``query, name, near``: the nearest of all symbols, if it is as near as the threshold.

    ``asked`` has ``query, vec``, vectors as bytes. Symbols are made from their names where they
    are compared: names alone are dealt out, a block of vectors to the tasks of each block of names.
    """
    kind = asked.schema["query"].dataType.simpleString()

    def compared(b: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query": [], "name": [], "near": []}, dtype=object)]
        names, sizes = np.sort(some["name"].to_numpy()), b["vec"].map(len).to_numpy() // 8
        for size in sorted({int(n) for n in sizes if n}):
            own = b[sizes == size]
            unit = _unit(own["vec"].map(np.frombuffer), size)
            for start in range(0, len(names), SLICE):
                part = names[start : start + SLICE]
                # Made once each, so kept out of the cache.
                rows = np.stack([_flat(symbol.__wrapped__(space, x, size // 2)) for x in part]) / np.sqrt(size // 2)
                at, which, value = best(unit, rows, 1)
                out.append(pd.DataFrame({"query": own["query"].to_numpy()[at], "name": part[which], "near": value}, dtype=object))
        return pd.concat(out)

    names = names.select("name").where("name is not null")
    n = asked.count()
    if n <= FEW:
        held = asked.toPandas()
        held["vec"] = [bytes(v) for v in held["vec"]]
        scored = _dealt(names).mapInPandas(lambda batches: (compared(held, b) for b in batches), f"query {kind}, name string, near double")
    else:
        n, m = n // FEW + 1, names.count() // (16 * SLICE) + 1
        every = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
        left = asked.withColumn("_q", F.pmod(F.xxhash64("query"), F.lit(n)).cast("int")).withColumn("_s", every(m))
        right = names.withColumn("_s", F.pmod(F.xxhash64("name"), F.lit(m)).cast("int")).withColumn("_q", every(n))
        scored = left.groupBy("_s", "_q").cogroup(right.groupBy("_s", "_q")).applyInPandas(
            lambda b, some: compared(b, some)[["query", "name", "near"]], f"query {kind}, name string, near double"
        )
    first = scored.groupBy("query").agg(F.min(F.struct((-F.col("near")).alias("far"), "name")).alias("s"))
    return first.select("query", "s.name", (-F.col("s.far")).alias("near")).where(F.col("near") >= threshold)


def decode(
    vectors: DataFrame, predicates: DataFrame, entities: DataFrame, threshold: float = THRESHOLD, most_args: int = MOST_ARGS
) -> DataFrame:
    """``id, predicate, args, similarity`` of vectors (``id, vec``) of which nothing is known.

    ``predicates`` and ``entities`` are symbol tables as ``symbols`` makes them, so names do. The predicate is the symbol nearest to
    the untagged vector; it is subtracted, and place by place the nearest entity is read off
    what is left, known arguments being subtracted as well, until one is farther than the
    threshold or nothing is left. In a last round every argument is read again with all others
    subtracted. A vector whose predicate is farther than the threshold is left out.
    ``similarity`` is that of the least sure symbol.

    Where there are many vectors, most need no comparison with all entities. Entities that a
    sample has more than once are read off all places at once, and one argument that is left
    over is looked up by signs of its components. Such a reading counts only if it explains the
    whole vector, nothing being left of it; all other vectors are read round by round, each
    round comparing them with all symbols, which Spark deals out.
    """
    vectors = _packed(vectors)
    n = vectors.count()
    if n <= 4 * SAMPLE or predicates.count() > FEW:
        return _in_rounds(vectors, predicates, entities, threshold, most_args)
    sample = vectors.where(F.pmod(F.xxhash64("id"), F.lit(n // SAMPLE)) == 0)
    read = _in_rounds(sample, predicates, entities, threshold, most_args)
    often = read.select("id", F.explode("args").alias("name")).distinct().groupBy("name").count().where("count > 1")
    common = sorted(r.name for r in often.collect())
    told = _at_once(vectors, sorted(r.name for r in predicates.select("name").collect()), common, entities, threshold, most_args)
    rest = told.where("vec is not null").select("id", "vec")
    whole = told.where("vec is null").drop("vec")
    return whole if rest.isEmpty() else whole.union(_in_rounds(rest, predicates, entities, threshold, most_args))


def _at_once(vectors: DataFrame, predicates: list[str], common: list[str], entities: DataFrame, threshold: float, most_args: int) -> DataFrame:
    """``id, predicate, args, similarity, vec``: vectors read whole, ``vec`` being null; of the others ``id, vec`` alone."""
    kind = vectors.schema["id"].dataType.simpleString()

    def guess(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            out: dict[str, list] = {x: [] for x in ("id", "predicate", "args", "hole", "keys")}
            sizes = b["vec"].map(len).to_numpy() // 8
            for size in sorted({int(n) // 2 for n in sizes if n >= 2 * SURE_FROM}):
                if size not in known:
                    tables = [np.array([_flat(symbol(s, x, size)) for x in names]).reshape(len(names), 2 * size).astype(np.float32) for s, names in (("P", predicates), ("E", common))]
                    known[size] = tables[0], tables[1]
                own = b[sizes == 2 * size]
                for start in range(0, len(own), PIECE):
                    piece = own[start : start + PIECE]
                    for i, vec, found in zip(piece["id"], piece["vec"], _first_reading(np.stack([np.frombuffer(v) for v in piece["vec"]]), *known[size]), strict=True):
                        predicate, args = predicates[found[0]], [common[c] if c >= 0 else None for c in found[1:]]
                        while args and args[-1] is None:
                            args.pop()
                        v = _rest(vec, predicate, args, -1)
                        if None not in args and not _nothing_left(v, vec) and len(args) < most_args:
                            args.append(None)
                        if args.count(None) > 1:
                            continue
                        hole = args.index(None) if None in args else -1
                        out["id"].append(i)
                        out["predicate"].append(predicate)
                        out["args"].append(args)
                        out["hole"].append(hole)
                        out["keys"].append(_keys(v * role(hole + 1, size).conj()) if hole >= 0 else [])
            yield pd.DataFrame(out, dtype=object)

    def _first_reading(vecs: np.ndarray, named: np.ndarray, often: np.ndarray) -> np.ndarray:
        """The place of each row's predicate, and of its common argument at every place, -1 where there is none."""
        size = vecs.shape[1] // 2
        v = (vecs[:, :size] + 1j * vecs[:, size:]) * symbol(*TAG, size).conj()
        read = np.full((len(v), 1 + most_args), -1)
        wide = lambda x: np.concatenate((x.real, x.imag), axis=1).astype(np.float32)
        read[:, 0] = np.abs(wide(v) @ named.T).argmax(axis=1)
        base = (named[:, :size] + 1j * named[:, size:])[read[:, 0]]
        v = v - base * ((base.conj() * v).sum(axis=1) / size)[:, None]
        length = np.linalg.norm(v, axis=1) * np.sqrt(size)
        for place in range(most_args if len(often) else 0):
            near = np.abs(wide(v * role(place + 1, size).conj()) @ often.T)
            read[:, 1 + place] = np.where(near.max(axis=1) >= threshold * length, near.argmax(axis=1), -1)
        return read

    guessed = settle(vectors.mapInPandas(guess, f"id {kind}, predicate string, args array<string>, hole int, keys array<bigint>"), "guessed")

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"name": b["name"], "keys": [_keys(symbol.__wrapped__("E", x, size)) for x in b["name"]]}, dtype=object)

    size = vectors.agg(F.max(F.length("vec"))).first()[0] // 16
    held = _dealt(entities.select("name").where("name is not null")).mapInPandas(named, "name string, keys array<bigint>").select("name", F.posexplode("keys").alias("part", "key"))
    open_ = guessed.where("hole >= 0").select("id", "predicate", "args", "hole", F.posexplode("keys").alias("part", "key"))
    filled = F.transform("args", lambda a, i: F.when(i == F.col("hole"), F.col("name")).otherwise(a)).alias("args")
    met = open_.join(held, ["part", "key"]).select("id", "predicate", filled).distinct()
    guesses = guessed.where("hole < 0").select("id", "predicate", "args").union(met)
    # Ids that meet more than one name by chance try each.
    guesses = guesses.groupBy("id").agg(F.collect_list(F.struct("predicate", "args")).alias("guesses"))

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: dict[str, list] = {x: [] for x in ("id", "predicate", "args", "similarity", "vec")}
            for i, vec, some in zip(b["id"], b["vec"], b["guesses"], strict=True):
                found: tuple = (None, None, None, vec)
                for g in some if some is not None else []:
                    if (least := _explained(vec, g["predicate"], list(g["args"]))) >= threshold:
                        found = (g["predicate"], list(g["args"]), least, None)
                        break
                out["id"].append(i)
                for name, value in zip(("predicate", "args", "similarity", "vec"), found, strict=True):
                    out[name].append(value)
            yield pd.DataFrame(out, dtype=object)

    told = vectors.join(guesses, "id", "left").select("id", "vec", "guesses")
    return settle(told.mapInPandas(judged, f"id {kind}, predicate string, args array<string>, similarity double, vec binary"), "told")


def _keys(v: np.ndarray) -> list[int]:
    """Numbers made of the signs of some components, ``KEYS`` of them; those of alike vectors agree in one at least."""
    signs = np.stack((v.real > 0, v.imag > 0), axis=1)[np.arange(KEYS * KEY_PARTS) % len(v)].reshape(KEYS, 2 * KEY_PARTS)
    return (signs @ (1 << np.arange(2 * KEY_PARTS))).tolist()


def _explained(vec: bytes, predicate: str, args: list[str]) -> float:
    """The similarity of the least sure symbol when read in turn, if nothing of the vector is left in the end; else -1."""
    v = _complex(vec)
    dimension = len(v)
    v = v * symbol(*TAG, dimension).conj()
    basis = np.stack([symbol("P", predicate, dimension), *(role(i + 1, dimension) * symbol("E", a, dimension) for i, a in enumerate(args))], axis=1)
    gram, products = basis.conj().T @ basis, basis.conj().T @ v
    if not np.any(v) or not _nothing_left(v - basis @ _solved(gram, products), vec):
        return -1.0
    least, whole = 1.0, np.linalg.norm(v) ** 2
    for n in range(basis.shape[1]):
        x = _solved(gram[:n, :n], products[:n])
        left = whole - (products[:n].conj() @ x).real
        least = min(least, abs((products[n] - gram[n, :n] @ x).real) / np.sqrt(left * gram[n, n].real))
    return float(least)


def _in_rounds(vectors: DataFrame, predicates: DataFrame, entities: DataFrame, threshold: float, most_args: int) -> DataFrame:
    """``decode`` with a comparison of all vectors with all symbols for each symbol that is read."""
    kind = vectors.schema["id"].dataType.simpleString()

    def asked(state: DataFrame, place: int, again: bool) -> DataFrame:
        def left(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                ids, out = [], []
                for i, vec, predicate, args in zip(b["id"], b["vec"], b["predicate"], b["args"], strict=True):
                    v = _rest(vec, predicate, list(args), place)
                    if place >= 0:
                        if _nothing_left(v, vec):
                            continue
                        v = v * role(place + 1, len(v)).conj()
                        # Different symbols are nearly orthogonal, so none is nearer than one as near as that.
                        if again and len(v) >= SURE_FROM and abs(_flat(v) @ _flat(symbol("E", args[place], len(v)))) >= SURE * np.linalg.norm(v) * np.sqrt(len(v)):
                            continue
                    ids.append(i)
                    out.append(_flat(v).tobytes())
                yield pd.DataFrame({"query": ids, "vec": out}, dtype=object)

        rows = state.select("id", "vec", "predicate", "args")
        return rows.mapInPandas(left, f"query {kind}, vec binary")

    start = vectors.select("id", "vec", F.lit(None).cast("string").alias("predicate"), F.array().cast("array<string>").alias("args"), F.lit(1.0).alias("similarity"))
    # What is asked is settled, as it is counted and then dealt out.
    rows = settle(asked(start, -1, False), "asked")
    named = start.join(_nearest(rows, predicates, "P", threshold), F.col("id") == F.col("query"))
    least = F.least("similarity", "near")
    state = settle(named.select("id", "vec", F.col("name").alias("predicate"), "args", least.alias("similarity")), "decoded")
    drop(rows)
    for place in range(most_args):
        open_ = state.where(F.size("args") == place)
        if open_.isEmpty():
            break
        rows = settle(asked(open_, place, False), "asked")
        if rows.isEmpty():
            continue
        found = _nearest(rows, entities, "E", threshold)
        joined = state.join(found, F.col("id") == F.col("query"), "left")
        more = F.when(F.col("name").isNotNull(), F.concat("args", F.array("name"))).otherwise(F.col("args"))
        after = settle(joined.select("id", "vec", "predicate", more.alias("args"), F.coalesce(least, "similarity").alias("similarity")), "decoded")
        drop(state)
        drop(rows)
        state = after
    for place in range(most_args):
        again = state.where(F.size("args") > place)
        if again.isEmpty():
            break
        rows = settle(asked(again, place, True), "asked")
        if rows.isEmpty():
            continue
        found = _nearest(rows, entities, "E", threshold)
        joined = state.join(found, F.col("id") == F.col("query"), "left")
        other = F.when(F.col("name").isNotNull(), F.transform("args", lambda a, i: F.when(i == place, F.col("name")).otherwise(a))).otherwise(F.col("args"))
        after = settle(joined.select("id", "vec", "predicate", other.alias("args"), "similarity"), "decoded")
        drop(state)
        drop(rows)
        state = after
    return state.select("id", "predicate", "args", "similarity")


def matching(decoded: DataFrame, pattern: Atom) -> DataFrame:
    """The decoded facts that fit a pattern: its predicate, arity, constants and repeated variables."""
    rows = decoded.where((F.col("predicate") == pattern.predicate) & (F.size("args") == len(pattern.args)))
    first: dict[str, int] = {}
    for i, x in enumerate(pattern.args):
        if not isinstance(x, Var):
            rows = rows.where(F.col("args")[i] == F.lit(str(x)))
        elif x.name != "_":
            rows = rows.where(F.col("args")[i] == F.col("args")[first.setdefault(x.name, i)])
    return rows
