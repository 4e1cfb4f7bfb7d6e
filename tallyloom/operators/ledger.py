"""The event ledger: corrections, the causal frontier, order, observations, validation and differences.

events: (event_id string, event_type string, inputs array<string>, payload struct or columns). Nothing is ever deleted: corrections are
events, and what is current is what no correction names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.operators.graph import components
from tallyloom.sources.scratch import cut

# The event types that writers may submit, and those that only the projector makes.
WRITABLE = """
source.discovered source.identity.resolved source.rights.assessed source.fetch.observed source.archive.requested source.archive.confirmed
observation.created observation.representation.computed observation.measured observation.stability.measured observation.invalidated
observation.declined observation.flagged
evidence.support.observed evidence.challenge.observed evidence.equivalence.proposed evidence.distinction.proposed evidence.relation.observed
event.retracted event.superseded selector.corrected
exemplar.candidate.scored exemplar.basis.selected
grammar.candidate.proposed grammar.candidate.evaluated
calibration.run.recorded
label.resource.proposed label.resource.evaluated
""".split()
PROJECTED = """
holon.emerged holon.split.projected holon.merge.projected holon.dissolved
projection.completed projection.published
policy.activated projector.activated
exemplar.basis.activated
compressor_pack.activated
grammar.pack.selected grammar.pack.activated
calibration.pack.selected calibration.pack.activated
label.resource.activated
prior.snapshot.proposed prior.snapshot.validated prior.snapshot.published prior.snapshot.superseded
compatibility.assessed leakage.audit.completed rights.audit.completed
""".split()
UNKNOWN_SOURCE = "unknown-source"


def event_types(spark: SparkSession) -> DataFrame:
    """(event_type, class): 50 rows to broadcast."""
    return spark.createDataFrame([(t, "writable") for t in WRITABLE] + [(t, "projected") for t in PROJECTED], "event_type string, class string")


def type_class(event_type: Column) -> Column:
    return F.when(event_type.isin(WRITABLE), "writable").when(event_type.isin(PROJECTED), "projected").otherwise("unknown")


def corrections(events: DataFrame, retracted: str = "retracted_event_id", superseded: str = "superseded_event_id") -> DataFrame:
    """(event_id, how): the events that a retraction or supersession names, whether it is itself corrected or not."""
    gone = events.filter("event_type = 'event.retracted'").select(F.col(retracted).alias("event_id"), F.lit("retracted").alias("how"))
    new = events.filter("event_type = 'event.superseded'").select(F.col(superseded).alias("event_id"), F.lit("superseded").alias("how"))
    return gone.unionByName(new).filter("event_id is not null").distinct()


def resolve(events: DataFrame, corrected: DataFrame) -> DataFrame:
    """The current events. A retracted retraction still retracts."""
    return events.join(corrected.select("event_id").distinct(), "event_id", "left_anti")


def edges(events: DataFrame) -> DataFrame:
    """(event_id, input_id): the causal edges whose input is there."""
    all_edges = events.select("event_id", F.explode("inputs").alias("input_id"))
    return all_edges.join(events.select(F.col("event_id").alias("input_id")), "input_id", "left_semi").select("event_id", "input_id")


def head(resolved: DataFrame) -> DataFrame:
    """(event_id): the current events that no current event names as an input."""
    named = resolved.select(F.explode("inputs").alias("event_id")).distinct()
    return resolved.select("event_id").join(named, "event_id", "left_anti")


def _kahn(ins: dict[str, list[str]]) -> list[tuple[str, int, str | None]]:
    """(event, pos, reach) of one component, given by the inputs of its events: of those whose inputs are placed, the smallest id goes next."""
    waits = {e: len(i) for e, i in ins.items()}
    after: dict[str, list[str]] = {}
    for e, before in ins.items():
        for i in before:
            after.setdefault(i, []).append(e)
    ready = [e for e, n in waits.items() if n == 0]
    heapq.heapify(ready)
    out, reach = [], ""
    while ready:
        e = heapq.heappop(ready)
        reach = max(reach, e)
        out.append((e, len(out), reach))
        for d in after.get(e, ()):
            waits[d] -= 1
            if waits[d] == 0:
                heapq.heappush(ready, d)
    placed = {e for e, _, _ in out}
    return out + [(e, -1, None) for e in sorted(waits) if e not in placed]


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The order of each component of rows (component, event_id, ins) that come component by component."""
    names = ["event_id", "component", "pos", "reach"]
    rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns], strict=True))
    out: list[tuple] = []
    for component, members in groupby(rows, key=lambda row: row[0]):
        out += [(e, component, pos, reach) for e, pos, reach in _kahn({e: ins for _, e, ins in members})]
        if len(out) >= 10_000:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _ORDER, strict=True)], names)
            out = []
    if out:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _ORDER, strict=True)], names)


_ORDER = [pa.string(), pa.string(), pa.int64(), pa.string()]


def topological(events: DataFrame) -> DataFrame:
    """(event_id, component, pos, reach): ordering all events by (reach, pos) gives the one order in which, of the events whose
    inputs are all placed, the smallest id always goes next. Events on a cycle, and what follows them, have pos -1.

    Events without edges are placed in the JVM. Each other component is ordered by one task, as each step depends on the one
    before; only ids and edges go there. Inputs outside the ledger are ignored.
    """
    linked = cut(edges(events))
    part = components(linked, "event_id", "input_id")
    ins = linked.groupBy("event_id").agg(F.sort_array(F.collect_list("input_id")).alias("ins"))
    placed = part.withColumnRenamed("node", "event_id").join(ins, "event_id", "left").withColumn("ins", F.coalesce("ins", F.array().cast("array<string>")))
    together = placed.repartition("component").sortWithinPartitions("component").select("component", "event_id", "ins")
    ordered = together.mapInArrow(_ordered, "event_id string, component string, pos long, reach string")
    alone = events.select("event_id").distinct().join(part.select(F.col("node").alias("event_id")), "event_id", "left_anti")
    return ordered.unionByName(alone.select("event_id", F.col("event_id").alias("component"), F.lit(0).cast("long").alias("pos"), F.col("event_id").alias("reach")))


def sources_of(resolved: DataFrame, order: Column) -> DataFrame:
    """(observation_id, source_id) from the last event in the given order that created each observation."""
    made = resolved.filter("event_type = 'observation.created' and observation_id is not null")
    return made.groupBy("observation_id").agg(F.max_by(F.coalesce("source_id", F.lit(UNKNOWN_SOURCE)), order).alias("source_id"))


def observations(resolved: DataFrame, sources: DataFrame, invalidated: DataFrame) -> DataFrame:
    """The current measurements with their source, unknown-source where no event created the observation; invalidated ones go."""
    current = resolved.filter("event_type = 'observation.measured' and observation_id is not null").drop("source_id")
    current = current.join(invalidated.select("observation_id").distinct(), "observation_id", "left_anti")
    return current.join(sources, "observation_id", "left").withColumn("source_id", F.coalesce("source_id", F.lit(UNKNOWN_SOURCE)))


def lens_id(basis: Column) -> Column:
    """basis- and the start of the basis's hash, 24 characters in all; unset without a basis."""
    return F.when(basis.isNull() | (basis == ""), "unset").otherwise(F.substring(F.regexp_replace(basis, "^exemplar-basis:sha256:", "basis-"), 1, 24))


def violations(batches: DataFrame) -> DataFrame:
    """(file, event_id, violation) of events (file, place, event_id, event_type, payload JSON): projected types, unknown types,
    ids that came before (the first by file and place stays), and a ledger_position anywhere. An event of a wrong type is checked no further."""
    kinds = batches.withColumn("class", type_class(F.col("event_type")))
    wrong = kinds.filter("class <> 'writable'").select("file", "event_id", F.concat(F.col("class"), F.lit("-type")).alias("violation"))
    fine = kinds.filter("class = 'writable'")
    first = fine.groupBy("event_id").agg(F.count("*").alias("n"), F.min(F.struct("file", "place")).alias("first")).filter("n > 1")
    again = fine.join(first, "event_id").filter("file <> first.file or place <> first.place").select("file", "event_id", F.lit("duplicate-id").alias("violation"))
    placed = fine.filter(F.col("payload").rlike('"ledger_position"\\s*:')).select("file", "event_id", F.lit("ledger-position").alias("violation"))
    return wrong.unionByName(again).unionByName(placed)


def differences(previous: DataFrame, following: DataFrame) -> DataFrame:
    """(name, change): added, dissolved, changed (other members) or same, of (name, members array)."""
    a = previous.select("name", F.array_sort(F.array_distinct("members")).alias("before"))
    b = following.select("name", F.array_sort(F.array_distinct("members")).alias("after"))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "dissolved").when(F.col("before") != F.col("after"), "changed").otherwise("same")
    return a.join(b, "name", "full").select("name", change.alias("change"))


def last_by(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """The value that was written last for each key."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def unseen_batches(submitted: DataFrame, known: DataFrame) -> DataFrame:
    """Create only: submitted batches whose id isn't known; of repeated submissions the earliest, then the first by file."""
    first = F.row_number().over(Window.partitionBy("batch_id").orderBy("submitted_at", "file"))
    return submitted.join(known.select("batch_id"), "batch_id", "left_anti").withColumn("r", first).filter("r = 1").drop("r")
