"""Current listings in Spark's state store: every batch touches the listings that it saw, and no others.

The state of a listing holds the latest value of each column with the time that it is from, so repeated and late rows
change nothing that is newer, and batches may come in any order. The store keeps its versions and changes by itself;
`read_current` reads it back from a query's checkpoint, so nothing is rewritten as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Columns by how they are folded: the latest value, the latest known one, the latest that isn't empty.
LATEST = ["url", "price_czk", "currency", "category"]
KNOWN = ["make", "model", "year", "mileage_km", "fuel", "transmission", "body", "power_kw", "region", "title", "thumb_key"]
FILLED = ["feature_keys"]
TYPES = {"price_czk": "bigint", "year": "int", "mileage_km": "bigint", "power_kw": "int", "feature_keys": "array<string>"}
COLUMNS = [*LATEST, *KNOWN, *FILLED]
#: What may happen to a listing: sightings with their columns, probes that found it, what takes it off the market, and its picture's key alone.
SIGHTINGS, LIVE, OFF, PICTURES = ["seen"], ["live"], ["gone", "rejected", "missing"], ["thumb"]
PICTURE_COLUMNS = ["thumb_key"]

OBSERVED = "source string, external_id string, kind string, observed_at timestamp, seq bigint, " + ", ".join(f"{c} {TYPES.get(c, 'string')}" for c in COLUMNS)
CURRENT = "first_seen timestamp, last_seen timestamp, status string, status_at timestamp, status_seq bigint, " + ", ".join(
    f"{c} {TYPES.get(c, 'string')}, {c}_at timestamp, {c}_seq bigint" for c in COLUMNS
)
OUT = "source string, external_id string, " + CURRENT


class Fold(StatefulProcessor):
    """Keeps one value per listing: its columns, each with the time and number of the row that it is from."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.current = handle.getValueState("current", CURRENT)
        self.names = [f.strip().split(" ")[0] for f in CURRENT.split(", ")]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = dict(zip(self.names, self.current.get(), strict=True)) if self.current.exists() else dict.fromkeys(self.names)

        def newer(name: str, at: pd.Timestamp, seq: int) -> bool:
            old = held[f"{name}_at"]
            return old is None or (at, seq) >= (pd.Timestamp(old), held[f"{name}_seq"])

        for batch in rows:
            for row in batch.to_dict("records"):
                at, seq = row["observed_at"], int(row["seq"])
                if row["kind"] in SIGHTINGS + LIVE:
                    held["last_seen"] = at if held["last_seen"] is None else max(at, pd.Timestamp(held["last_seen"]))
                if row["kind"] in SIGHTINGS:
                    held["first_seen"] = at if held["first_seen"] is None else min(at, pd.Timestamp(held["first_seen"]))
                for name in COLUMNS if row["kind"] in SIGHTINGS else PICTURE_COLUMNS if row["kind"] in PICTURES else []:
                    value = row[name]
                    known = hasattr(value, "__len__") or (value is not None and value == value)
                    if (name in KNOWN and not known) or (name in FILLED and (not known or not len(value))):
                        continue
                    if newer(name, at, seq):
                        held[name] = (list(value) if name in FILLED else int(value) if TYPES.get(name) in ("int", "bigint") else value) if known else None
                        held[f"{name}_at"], held[f"{name}_seq"] = at, seq
                if row["kind"] not in PICTURES and newer("status", at, seq):
                    held["status"], held["status_at"], held["status_seq"] = "removed" if row["kind"] in OFF else "active", at, seq
        value = tuple(None if held[n] is None else pd.Timestamp(held[n]).to_pydatetime() if n.endswith(("_at", "_seen")) else held[n] for n in self.names)
        self.current.update(value)
        yield pd.DataFrame([[*key, *value]], columns=["source", "external_id", *self.names]).astype(object)


def fold_stream(observed: DataFrame) -> DataFrame:
    """The new state of every listing that a batch touches. Rows without a key, a time or a known kind must be gone before (see `sound`)."""
    grouped = observed.groupBy("source", "external_id")
    return grouped.transformWithStateInPandas(statefulProcessor=Fold(), outputStructType=OUT, outputMode="Update", timeMode="None")


def sound(observed: DataFrame) -> DataFrame:
    """Rows that can be folded."""
    return observed.where(F.col("source").isNotNull() & F.col("external_id").isNotNull() & F.col("observed_at").isNotNull() & F.col("kind").isin([*SIGHTINGS, *LIVE, *OFF, *PICTURES]) & F.col("seq").isNotNull())


def run(spark: SparkSession, observed: DataFrame, path: str) -> None:
    """Folds what has arrived since the last call into the state below `path`, then stops."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    changed = fold_stream(sound(observed)).writeStream.outputMode("update").option("checkpointLocation", f"{path}/checkpoint")
    changed.format("noop").trigger(availableNow=True).start().awaitTermination()


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """The current listings, straight from the state store."""
    stored = spark.read.format("statestore").option("stateVarName", "current").load(f"{path}/checkpoint")
    return stored.select("key.source", "key.external_id", "value.first_seen", "value.last_seen", "value.status", *(f"value.{c}" for c in COLUMNS))


def fold_batch(observed: DataFrame) -> DataFrame:
    """The same listings from all observations at once, as one aggregation."""
    order, rows = F.struct("observed_at", "seq"), sound(observed)
    sighting = F.col("kind").isin(SIGHTINGS)
    when = {c: sighting for c in LATEST} | {c: (F.col("kind").isin(SIGHTINGS + PICTURES) if c in PICTURE_COLUMNS else sighting) & F.col(c).isNotNull() for c in KNOWN} | {c: sighting & (F.size(c) > 0) for c in FILLED}
    return rows.groupBy("source", "external_id").agg(
        F.min(F.when(sighting, F.col("observed_at"))).alias("first_seen"),
        F.max(F.when(F.col("kind").isin(SIGHTINGS + LIVE), F.col("observed_at"))).alias("last_seen"),
        # null for a listing that has a picture's key alone
        F.max_by(F.when(F.col("kind").isin(OFF), "removed").otherwise("active"), F.when(~F.col("kind").isin(PICTURES), order)).alias("status"),
        *(F.max_by(c, F.when(when[c], order)).alias(c) for c in COLUMNS),
    )
