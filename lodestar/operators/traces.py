"""Events of a run as a DataFrame, and the events that led to one."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from lodestar.plans.base import Base
from lodestar.plans.rules import Var, atom, rule

SCHEMA = "id string, ts double, type string, payload string, parent_ids array<string>"


@dataclass
class Trace:
    """A driver-side log of what was asked and derived: a few rows a query."""

    events: list[tuple] = field(default_factory=list)

    def record(self, kind: str, payload: dict, parents: tuple[str, ...] = ()) -> str:
        event = uuid.uuid4().hex
        self.events.append((event, time.time(), kind, json.dumps(payload, default=str), list(parents)))
        return event

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.events, SCHEMA)

    def clear(self) -> None:
        self.events.clear()

    @classmethod
    def of(cls, events: DataFrame) -> Trace:
        """A log of stored events, in order of time; a trace has a few rows a query."""
        rows = events.select(*(x.split()[0] for x in SCHEMA.split(", "))).orderBy("ts", "id").collect()
        return cls([(r.id, r.ts, r.type, r.payload, list(r.parent_ids)) for r in rows])


def ancestors(events: DataFrame, event: str) -> DataFrame:
    """The ids of the events that led to one, itself included."""
    links = events.selectExpr("id", "explode(parent_ids) AS parent")
    base = Base(events.sparkSession).register("parent", links)
    x, y, z = Var("X"), Var("Y"), Var("Z")
    rules = [rule(atom("led", x, y), atom("parent", x, y)), rule(atom("led", x, z), atom("led", x, y), atom("parent", y, z))]
    before = base.answers(atom("led", event, y), rules).selectExpr("Y AS id")
    return events.where(events["id"] == event).select("id").union(before)
