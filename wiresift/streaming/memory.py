"""What a stream remembers: captured hashes and inputs, each reported at its first sighting.

Keys are dealt into slots; a slot keeps its keys with the time of their first sighting, packed
by some dozens, as each visit to the state store is a message to the JVM and back.  A key
is forgotten a given time (of the exchanges, not of the clock) after that; repeats don't
refresh it.  A control row empties all slots before the rows of its own micro-batch.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Parts into which the remembered keys are dealt.
SLOTS = 256
#: Keys in a pack, on the average of a slot, up to which its packs are not dealt anew.
FULL = 64
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Memory(StatefulProcessor):
    """A slot's keys with the time of their first sighting, in microseconds."""

    def __init__(self, ttl: timedelta, columns: list[str]):
        self.ttl, self.columns = int(ttl.total_seconds() * 1e6), columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "key string", "at long")
        self.swept = handle.getValueState("swept", "at long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        rows = list(rows)
        if any(r["_clear"] for r in rows):
            self.seen.clear()
        rows = sorted((r for r in rows if not r["_clear"]), key=lambda r: (r["_at"] is None, r["_at"] or 0))
        for r in rows:
            yield Row(**{c: r[c] for c in self.columns}, fresh=r["_lead"] and self.is_new(r["_key"], r["_at"]))
        self.sweep(max((r["_at"] for r in rows if r["_at"] is not None), default=None))

    def is_new(self, key: str, at: int | None) -> bool:
        if self.seen.containsKey((key,)):
            first = self.seen.getValue((key,))[0]
            if at is None or first is None or at - first <= self.ttl:
                return False
        self.seen.updateValue((key,), (at,))
        return True

    def sweep(self, now: int | None) -> None:
        """Once in the keys' lifetime, what has expired is taken out."""
        if now is None:
            return
        last = self.swept.get()[0] if self.swept.exists() else None
        if last is None:
            self.swept.update((now,))
        elif now - last > self.ttl:
            old = [k for k, v in self.seen.iterator() if v[0] is not None and now - v[0] > self.ttl]
            for k in old:
                self.seen.removeKey(k)
            self.swept.update((now,))

    def close(self) -> None:
        pass


class Packs:
    """A slot's map of keys in packs by hash: a pack is read at most once and written at most once in a micro-batch.

    The number of packs doubles with the keys, so what a micro-batch writes is bounded by some
    FULL keys for each of its own, and dealing anew costs every key a bounded number of times.
    """

    def __init__(self, handle: StatefulProcessorHandle):
        self.packs = handle.getMapState("packs", "pack int", "pairs string")
        self.shape = handle.getValueState("shape", "bits int, many long")

    def open(self, more: int) -> None:
        """Begins a micro-batch of a slot that may bring so many new keys."""
        self.bits, self.many = self.shape.get() if self.shape.exists() else (0, 0)
        self.held, self.changed = {}, set()
        bits = self.bits
        while self.many + more > FULL << bits:
            bits += 1
        if bits > self.bits:
            pairs = list(self.iterator())
            self.packs.clear()
            self.bits, self.held = bits, {i: {} for i in range(1 << bits)}
            for (key,), (at,) in pairs:
                i = self.place(key)
                self.held[i][key] = at
                self.changed.add(i)

    def place(self, key: str) -> int:
        return zlib.crc32(key.encode()) & ((1 << self.bits) - 1)

    def pack(self, i: int) -> dict:
        if i not in self.held:
            self.held[i] = dict(json.loads(self.packs.getValue((i,))[0])) if self.packs.containsKey((i,)) else {}
        return self.held[i]

    def containsKey(self, key: tuple) -> bool:
        return key[0] in self.pack(self.place(key[0]))

    def getValue(self, key: tuple) -> tuple:
        return (self.pack(self.place(key[0]))[key[0]],)

    def updateValue(self, key: tuple, value: tuple) -> None:
        i = self.place(key[0])
        pack = self.pack(i)
        self.many += key[0] not in pack
        pack[key[0]] = value[0]
        self.changed.add(i)

    def removeKey(self, key: tuple) -> None:
        i = self.place(key[0])
        del self.pack(i)[key[0]]
        self.many -= 1
        self.changed.add(i)

    def iterator(self) -> Iterator[tuple]:
        if self.many:
            for (i,), (pairs,) in list(self.packs.iterator()):
                if i not in self.held:
                    self.held[i] = dict(json.loads(pairs))
        return iter([((key,), (at,)) for pack in self.held.values() for key, at in pack.items()])

    def clear(self) -> None:
        self.packs.clear()
        self.held, self.changed, self.many = {}, set(), 0
        self.shape.update((self.bits, 0))

    def save(self) -> None:
        for i in self.changed:
            if self.held[i]:
                self.packs.updateValue((i,), (json.dumps(list(self.held[i].items())),))
            elif self.packs.containsKey((i,)):
                self.packs.removeKey((i,))
        if self.changed:
            self.shape.update((self.bits, self.many))
        self.held, self.changed = {}, set()


class PackedMemory(Memory):
    """The same with the keys in packs."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = Packs(handle)
        self.swept = handle.getValueState("swept", "at long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        rows = list(rows)
        self.seen.open(sum(r["_lead"] for r in rows))
        yield from super().handleInputRows(key, rows, timerValues)
        self.seen.save()


def leads(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Marks the first row of each key in a batch; only those ask the key's slot, so no slot meets all rows of a frequent key."""
    for f in frames:
        yield f.assign(_lead=~f.sort_values("_at", na_position="last").duplicated("_key").reindex(f.index))


def first_sightings(rows: DataFrame, ttl: timedelta, clear: DataFrame | None = None) -> DataFrame:
    """`rows` (a stream of what, ts, name, value, ...) and `fresh`: is it the first sighting of its key?

    The key is what and value, for inputs `name=value`.  Each row of the stream `clear` (ts) is a control row.
    """
    uses(rows.sparkSession)
    columns = rows.columns
    key = F.concat_ws(":", "what", F.when(F.col("what") == "input", F.concat_ws("=", F.coalesce("name", F.lit("")), "value")).otherwise(F.col("value")))
    keyed = rows.withColumns({"_key": key, "_at": F.unix_micros("ts"), "_clear": F.lit(False)})
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema)
    keyed = keyed.mapInPandas(leads, f"{shape}, _lead boolean")
    own = F.when(F.col("_lead"), F.xxhash64("_key")).otherwise(F.xxhash64(*columns))
    keyed = keyed.withColumn("_slot", F.pmod(own, F.lit(SLOTS)).cast("int"))
    if clear is not None:
        every = F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))).alias("_slot")
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in keyed.schema if f.name not in ("_slot", "_clear", "_lead")]
        keyed = keyed.unionByName(clear.select(every, *empty, F.lit(True).alias("_clear"), F.lit(False).alias("_lead")))
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return keyed.groupBy("_slot").transformWithState(PackedMemory(ttl, columns), f"{out}, fresh boolean", "Append", "None")


def uses(spark: SparkSession) -> None:
    """Map state needs the RocksDB store."""
    if not spark.conf.get(STORE, "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set(STORE, ROCKS)
