"""Facts arriving and leaving as a stream, folded into a closure batch by batch."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lodestar.plans.base import Base, Key
from lodestar.plans.rules import Atom, Rule, Var, among, without
from lodestar.plans.strata import stratify
from lodestar.plans.upkeep import upkeep
from lodestar.sources.tables import Ledger, drop, settle

#: Files of a relation beyond which they are written anew as few.
MOST_FILES = 256


def _name(key: Key) -> str:
    return f"{key[0]}/{key[1]}{'-not' * key[2]}"


class LiveBase:
    """A base that streams feed and take from; what follows is kept up from each micro-batch's rows alone.

    ``feeds`` names the predicates that streams bring, with their schemas. Rules need strata and
    may ask for absence; heads may not sum up. Relations that change are kept as files in
    ``folder``, which must be shared, under versions: a batch writes its files aside and becomes
    visible by one rename at its end, so after a failure at any point the batch is as if it had
    never come, and is folded whole when it is delivered again. A batch of a stream that was
    folded already is left out. A deleted row takes with it what no longer follows; files that
    hold none of the rows that go are kept.

    A base made anew over the same folder goes on where the last one ended. Facts of feeds that
    it is given then and that aren't held are folded in; if its other facts, or the rules, are
    not those of before, what follows is derived anew.
    """

    def __init__(self, base: Base, rules: list[Rule], feeds: dict[str, str], folder: str) -> None:
        spark = base.spark
        if not stratify(rules).stratified or any(r.aggregates for r in rules):
            raise ValueError("a live base needs rules with strata and without heads that sum up")
        self.ledger, self.heads = Ledger(spark, folder), {r.head.key for r in rules}
        self.files: dict[Key, list[str]] = {}
        self.schemas: dict[Key, StructType] = {}
        self.feeds: dict[str, Key] = {}
        given = Base(spark, base.relations, base.trace)
        rules = list(rules)
        for key in sorted(self.heads & set(given.relations)):
            # Facts of a derived predicate hold without a rule, so no deletion may take them.
            args = tuple(Var(f"X{i}") for i in range(key[1]))
            given.relations["given " + key[0], key[1], key[2]] = dict.pop(given.relations, key)
            rules.append(Rule(Atom(key[0], args, key[2]), (Atom("given " + key[0], args, key[2]),)))
        self.rules = rules
        at_once: dict[Key, DataFrame] = {}
        for predicate, schema in feeds.items():
            rows = spark.createDataFrame([], schema)
            key = (predicate, len(rows.columns), False)
            self.feeds[predicate] = key
            empty = rows.toDF(*(f"a{i + 1}" for i in range(key[1])))
            at_once[key] = given.relations[key].distinct() if key in given.relations else empty
            self.schemas[key] = at_once[key].schema
        if fed := self.heads & set(at_once):
            raise ValueError(f"a stream can't bring what rules derive: {', '.join(k[0] for k in fed)}")
        self.base = Base(spark, {k: df for k, df in given.relations.items() if k not in at_once}, base.trace)
        about = self._about()
        versions = self.ledger.versions()
        self.version = versions[-1] if versions else 0
        last = self.ledger.read(self.version) if versions else {"files": {}, "batches": {}, "schemas": {}, "about": None}
        self.batches: dict[str, int] = last["batches"]
        if versions:
            self.ledger.tidy([last])
        same = last["about"] == about
        for key in at_once.keys() | (self.heads if same else set()):
            if _name(key) in last["files"]:
                self._hold(key, last["files"][_name(key)], StructType.fromJson(last["schemas"][_name(key)]))
        more = {}
        for key, rows in at_once.items():
            if key not in self.files:
                self._hold(key, self.ledger.part(rows), rows.schema)
            elif key in given.relations:
                more[key] = rows
        if not same:
            self._derive_anew(about)
        self.about = about
        for key, rows in more.items():
            self._fold({key: without(rows, self.base.relations[key])}, {}, {})

    def _about(self) -> str:
        """A digest of the rules and of the facts that don't come by streams."""
        seen = [repr(self.rules)]
        for key, df in sorted(self.base.relations.items()):
            row = df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*df.columns)).alias("x"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("s")).first()
            seen.append(f"{key} {row.n} {row.x} {row.s}")
        return hashlib.sha256("\n".join(seen).encode()).hexdigest()

    def _hold(self, key: Key, files: list[str], schema: StructType) -> None:
        self.files[key], self.schemas[key] = files, schema
        self.base.relations[key] = self._read(key, files)

    def _read(self, key: Key, files: list[str]) -> DataFrame:
        spark = self.ledger.spark
        return spark.read.schema(self.schemas[key]).parquet(*files) if files else spark.createDataFrame([], self.schemas[key])

    def _derive_anew(self, about: str) -> None:
        run = self.base.derive(self.rules)
        for key in sorted(self.heads):
            if key in run.base.relations:
                rows = run.base.relations[key]
                self._hold(key, self.ledger.part(rows), rows.schema)
        self._commit(self.files, self.schemas, self.batches, about)

    def _commit(self, files: dict[Key, list[str]], schemas: dict[Key, StructType], batches: dict[str, int], about: str) -> None:
        content = {
            "files": {_name(k): v for k, v in files.items()},
            "schemas": {_name(k): schemas[k].jsonValue() for k in files},
            "batches": batches,
            "about": about,
        }
        before = [self.ledger.read(self.version)] if self.version else []
        self.ledger.commit(self.version + 1, content)
        self.version += 1
        # Files of the last version stay for those who still read them.
        self.ledger.tidy([*before, content])

    def fold(self, predicate: str, batch: DataFrame, deleted: str | None = None, order: str | None = None) -> None:
        """Add a batch's rows, or take away those marked in the column ``deleted``, and keep up what follows.

        Of a row that a batch names more than once, what comes last by the column ``order``
        counts; where orders tie, or there is none, a row that is added stays.
        """
        self._fold_batch(predicate, batch, deleted, order, {})

    def _fold_batch(self, predicate: str, batch: DataFrame, deleted: str | None, order: str | None, seen: dict[str, int]) -> None:
        key = self.feeds[predicate]
        values = [c for c in batch.columns if c not in (deleted, order)]
        gone = F.coalesce(F.col(deleted).cast("boolean"), F.lit(False)) if deleted else F.lit(False)
        last = F.struct((F.col(order) if order else F.lit(0)).alias("at"), (~gone).alias("stays"))
        named = [F.col(c).cast(f.dataType).alias(f"a{i + 1}") for i, (c, f) in enumerate(zip(values, self.schemas[key], strict=True))]
        rows = batch.select(*named, gone.alias("_gone"), last.alias("_last"))
        args = [f"a{i + 1}" for i in range(key[1])]
        told = settle(rows.groupBy(*args).agg(F.max_by("_gone", "_last").alias("_gone")), "batch")
        held = self.base.relations[key]
        plus = {key: without(told.where("not _gone").select(*args), held)}
        minus = {key: among(held, told.where("_gone").select(*args)).distinct()} if deleted else {}
        self._fold(plus, minus, seen)
        drop(told)

    def _fold(self, plus: dict[Key, DataFrame], minus: dict[Key, DataFrame], seen: dict[str, int]) -> None:
        """One version further: nothing of this base changes before all is written."""
        scratch: list[DataFrame] = []
        files, schemas = dict(self.files), dict(self.schemas)

        def some(changes: dict[Key, DataFrame]) -> dict[Key, DataFrame]:
            kept = {}
            for key, rows in changes.items():
                table = settle(rows, "batch")
                scratch.append(table)
                if not table.isEmpty():
                    kept[key] = table
            return kept

        def revise(key: Key, more: DataFrame | None, gone: DataFrame | None) -> DataFrame:
            own = files.get(key, [])
            if gone is not None:
                place = F.col("_metadata.file_path")
                rows = self._read(key, own).select("*", place.alias("_file"))
                met = among(rows, gone).select("_file").distinct().collect()
                ends = {r[0].rsplit("/", 1)[-1] for r in met}  # names of files hold a number of their own each
                hit = [f for f in own if f.rsplit("/", 1)[-1] in ends]
                own = [f for f in own if f not in set(hit)] + self.ledger.part(without(self._read(key, hit), gone))
            if more is not None:
                schemas.setdefault(key, more.schema)
                own = own + self.ledger.part(more)
            self.schemas.setdefault(key, schemas[key])
            if len(own) > MOST_FILES:
                own = self.ledger.part(self._read(key, own).coalesce(max(1, MOST_FILES // 4)))
            files[key] = own
            return self._read(key, own)

        plus, minus = some(plus), some(minus)
        if plus or minus or seen:
            new, _, _ = upkeep(self.base, self.rules, plus, minus, revise, scratch)
            batches = {**self.batches, **seen}
            self._commit(files, schemas, batches, self.about)
            self.files, self.schemas, self.batches = files, schemas, batches
            for key in files:
                new.relations[key] = self._read(key, files[key])
            self.base = new
        for table in scratch:
            drop(table)

    def follow(self, stream: DataFrame, predicate: str, checkpoint: str, deleted: str | None = None, order: str | None = None) -> StreamingQuery:
        """Start folding a stream's rows; the checkpoint folder must be shared."""

        def folded(batch: DataFrame, number: int) -> None:
            if number > self.batches.get(checkpoint, -1):
                self._fold_batch(predicate, batch, deleted, order, {checkpoint: number})

        return (
            stream.writeStream.option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .foreachBatch(folded)
            .start()
        )
