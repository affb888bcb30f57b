"""Live capture: repeats, expiry, clearing on demand, restart and replayed batches."""

import hashlib
import random
from datetime import datetime, timedelta

from wiresift import schema
from wiresift.jobs import audit
from wiresift.sources import exchanges
from wiresift.streaming import live, memory

DAY = datetime(2024, 1, 1)


def digest(x):
    return hashlib.sha256(str(x).encode()).hexdigest()


def put(spark, folder, *rows):
    """A file of exchanges (hours, hash, user)."""
    made = [
        (i, DAY + timedelta(hours=h), "t", "POST", f"https://a.example/x?user={user}", ["Content-Type: text/plain"], f"sum {digest(x)} end".encode(), None, None)
        for i, (h, x, user) in enumerate(rows)
    ]
    spark.createDataFrame(made, schema.EXCHANGES).coalesce(1).write.mode("append").parquet(folder)


def run(spark, top, clear=None, ttl=timedelta(hours=24)):
    stream = exchanges.read_stream(spark, f"{top}/in")
    live.write_live_captures(stream, f"{top}/out", f"{top}/state", ttl=ttl, clear=clear).awaitTermination()


def written(spark, top, name):
    return live.committed(spark, f"{top}/out", name)


def test_memory_of_a_stream(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(memory, "SLOTS", 16)
    top = str(tmp_path)
    control = f"{top}/control"
    spark.createDataFrame([], "ts timestamp").write.parquet(control)
    clear = spark.readStream.schema("ts timestamp").parquet(control)

    def counts():
        hashes = [r["value"] for r in written(spark, top, "hashes").collect()]
        inputs = [r["value"] for r in written(spark, top, "inputs").collect()]
        return hashes.count(digest("a")), hashes.count(digest("b")), inputs.count("ann"), inputs.count("bob"), written(spark, top, "findings").count()

    put(spark, f"{top}/in", (0, "a", "ann"), (1, "a", "ann"), (2, "a", "bob"))
    run(spark, top, clear)
    assert counts() == (1, 0, 1, 1, 3)
    put(spark, f"{top}/in", (20, "a", "ann"), (21, "b", "bob"))  # a restart: repeats are known and don't refresh
    run(spark, top, clear)
    assert counts() == (1, 1, 1, 1, 5)
    put(spark, f"{top}/in", (30, "a", "ann"), (31, "b", "bob"))  # a, ann and bob have expired since their first sighting, b hasn't
    run(spark, top, clear)
    assert counts() == (2, 1, 2, 2, 7)
    spark.createDataFrame([(DAY,)], "ts timestamp").write.mode("append").parquet(control)
    put(spark, f"{top}/in", (32, "a", "ann"), (33, "b", "bob"))
    run(spark, top, clear)
    assert counts() == (3, 2, 3, 3, 9)
    put(spark, f"{top}/in", (34, "a", "ann"))
    run(spark, top, clear)
    assert counts() == (3, 2, 3, 3, 10)


def test_replayed_batches_change_nothing_and_equal_the_batch_job(spark, tmp_path):
    top = str(tmp_path)
    for k in range(3):
        put(spark, f"{top}/in", *[(k, i % 4, f"user{i % 3}") for i in range(k, k + 6)])
    rows = exchanges.read(spark, f"{top}/in")
    captured = live.live_captures(rows)
    for number in (0, 1, 1, 0):  # the second batch is written again, and the first late
        live.commit(captured.where(f"hour(ts) {'= 0' if number == 0 else '> 0'}"), number, f"{top}/out")
    hashes, inputs = audit.capture_job(rows)
    assert sorted(map(str, live.committed_hashes(spark, f"{top}/out").collect())) == sorted(map(str, hashes.collect()))
    assert sorted(map(str, live.committed_inputs(spark, f"{top}/out").collect())) == sorted(map(str, inputs.collect()))
    assert written(spark, top, "findings").count() == 18

    class Unfinished(Exception):
        pass

    try:  # a batch that fails before its commit isn't seen
        broken = captured.where("hour(ts) = 2").selectExpr("*", "1 AS x")
        parts = live.capture.distinct_inputs
        live.capture.distinct_inputs = lambda df: (_ for _ in ()).throw(Unfinished())
        live.commit(broken, 2, f"{top}/out")
    except Unfinished:
        pass
    finally:
        live.capture.distinct_inputs = parts
    assert written(spark, top, "findings").count() == 18


def test_expired_keys_are_swept():
    class Map(dict):
        containsKey = dict.__contains__
        getValue = dict.__getitem__
        updateValue = dict.__setitem__
        removeKey = dict.__delitem__

        def iterator(self):
            return iter(self.items())

    class Value:
        v = None

        def exists(self):
            return self.v is not None

        def get(self):
            return self.v

        def update(self, v):
            self.v = v

    m = memory.Memory(timedelta(seconds=10), ["what"])
    m.seen, m.swept = Map(), Value()

    def rows(*pairs):
        return [{"what": "hash", "_key": k, "_at": None if at is None else at * 1_000_000, "_clear": False, "_lead": True} for k, at in pairs]

    def fresh(*pairs):
        return [r["fresh"] for r in m.handleInputRows((0,), iter(rows(*pairs)), None)]

    assert fresh(("a", 0), ("b", 5), ("a", 9), ("c", None), ("c", None)) == [True, True, False, True, False]
    assert fresh(("d", 12)) == [True] and len(m.seen) == 4
    assert fresh(("e", 20)) == [True] and set(m.seen) == {("c",), ("d",), ("e",)}


def test_packs_hold_what_a_plain_map_holds_with_few_visits():
    """Of a micro-batch's keys each asked the state store two or three times before."""
    visits = []

    class Map(dict):
        def containsKey(self, k):
            visits.append(k)
            return k in self

        def getValue(self, k):
            visits.append(k)
            return self[k]

        def updateValue(self, k, v):
            visits.append(k)
            self[k] = v

        def removeKey(self, k):
            visits.append(k)
            del self[k]

        def iterator(self):
            return iter(self.items())

    class Value:
        v = None

        def exists(self):
            return self.v is not None

        def get(self):
            return self.v

        def update(self, v):
            self.v = v

    class Handle:
        def getMapState(self, *_):
            return Map()

        def getValueState(self, *_):
            return Value()

    def rows(n, clear=False):
        made = [{"what": "hash", "_key": f"{rng.randrange(4000)} é", "_at": rng.choice([None, clock + rng.randrange(5)]), "_clear": False, "_lead": True} for _ in range(n)]
        return made + [{"what": None, "_key": None, "_at": None, "_clear": True, "_lead": False}] * clear

    rng, clock = random.Random(2), 0
    packed, plain = (kind(timedelta(microseconds=40), ["what"]) for kind in (memory.PackedMemory, memory.Memory))
    packed.init(Handle())
    plain.seen, plain.swept = Map(), Value()
    for n, clear in ((2000, False), (1, False), (900, False), (3, True), (500, False), (0, True), (3000, False), (50, False), (2, False)):
        batch = rows(n, clear)
        visits.clear()
        got = [r["fresh"] for r in packed.handleInputRows((0,), iter(batch), None)]
        assert len(visits) <= 3 * max(n, 1) and (n < 2000 or len(visits) <= n / 8)
        assert got == [r["fresh"] for r in plain.handleInputRows((0,), iter(batch), None)]
        packed.seen.open(0)
        assert dict(packed.seen.iterator()) == dict(plain.seen) and packed.seen.many == len(plain.seen)
        clock += 15
