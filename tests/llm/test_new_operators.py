"""Whitening, prefix trie and WARC against plain versions, on odd rows too."""

import gzip
import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from wiresift.llm import prefix_trie, queries, shared, warc, whitening

NAN, INF = float("nan"), float("inf")


# --- whitening -------------------------------------------------------------


def plain_whitening(rows, most=8):
    kept = [(i, v) for i, v in rows if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    lengths = [len(v) for _, v in kept]
    d = max(set(lengths), key=lambda n: (lengths.count(n), n))
    kept = [(i, [math.floor(1024 * c) + 100_000 for c in v]) for i, v in kept if len(v) == d]
    n, sums = len(kept), [sum(x[k] for _, x in kept) for k in range(d)]
    z = np.array([[(n * x[k] - sums[k]) / n for k in range(d)] for _, x in kept])
    values, axes = np.linalg.eigh(z.T @ z / n)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(most, int((values > values[0] * d * np.finfo(float).eps).sum()))
    deviations = [sum((n * x[j] - sums[j]) ** 2 for j in range(d)) for _, x in kept]
    return [i for i, _ in kept], deviations, z @ axes[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def whitened_rows(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df = df.selectExpr("*", "'x' AS v", "1 AS component", "2 AS n")
    return whitening.whiten(df, **more).collect()


def check_whitening(got, rows, most=8):
    ids, deviations, w, explained = plain_whitening(rows, most)
    assert len(got) == w.size
    n, k = w.shape
    signs = {}
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], int(r["deviation"])), {}).setdefault(r["component"], []).append(r)
    for i, dev, row in zip(ids, deviations, w):
        for c in range(k):
            r = by[i, dev][c + 1][0]
            assert r["n"] == n and abs(r["explained"] - explained[c]) < 1e-9 and r["identity_error"] < 1e-4
            if abs(row[c]) > 1e-6:
                assert signs.setdefault(c, np.sign(r["whitened"] * row[c])) == np.sign(r["whitened"] * row[c])
            assert abs(abs(r["whitened"]) - abs(row[c])) < 1e-7


def test_whitening_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1 + 3 * (k % 5)) for k in range(37)]) for i in range(300)]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in rows]
    rows += [(7, rows[7][1])] * 90 + [(None, rows[8][1])]
    odd = [(900, None), (901, [None] + [0.5] * 36), (902, [NAN] * 37), (903, [INF] * 37), (904, []), (905, [1.0, 2.0])]
    check_whitening(whitened_rows(spark, rows + odd), rows)


def test_whitening_of_huge_entries_is_exact(spark):
    rows = [(i, [float(np.float32(c)) for c in (3e9 * i, -1e9 * i * i, 0.25)]) for i in range(6)]
    got = whitened_rows(spark, rows)
    ids, deviations, w, _ = plain_whitening(rows)
    assert {r["vec_id"]: int(r["deviation"]) for r in got} == dict(zip(ids, deviations))
    assert max(deviations) > 1 << 63
    beyond = whitened_rows(spark, [(0, [3e38, 0.0]), (1, [-3e38, 1.0])])
    assert len(beyond) == 2 and {r["component"] for r in beyond} == {1}


def test_whitening_without_spread(spark):
    assert whitened_rows(spark, []) == []
    assert whitened_rows(spark, [(1, None)]) == []
    assert whitened_rows(spark, [(1, [1.0, 2.0])]) == []
    assert whitened_rows(spark, [(i, [1.0, 2.0]) for i in range(4)]) == []
    assert {r["component"] for r in whitened_rows(spark, [(i, [float(i), 2.0, 2.0 * i]) for i in range(9)])} == {1}


def test_whitening_tiles_of_any_width(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(40, 7)).astype(np.float32))]
    df = whitening.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    data = np.array([v for _, v in rows])
    centred = data - data.mean(0)
    for tile in (1, 3, 7, 50):
        got = whitening.covariance(df, 7, 40, lambda v: v - data.mean(0), tile)
        assert np.allclose(got, centred.T @ centred / 40, atol=1e-12)


def test_whitening_query(spark):
    rows = queries.op11_embedding_whitening(spark, "/root/testdata/sf0.001")
    table = [(r["vec_id"], r["embedding"]) for r in shared.read(spark, "/root/testdata/sf0.001", "embeddings").collect()]
    assert rows.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert dict(rows.dtypes)["deviation"] == "bigint"
    check_whitening(rows.collect(), table)


# --- prefix trie -----------------------------------------------------------


def plain_trie(rows):
    said = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            said.setdefault(c, []).append(((turn is not None, turn or 0), digest, (role, text)))
    said = {c: [t for *_, t in sorted(ts, key=lambda t: t[:2])] for c, ts in said.items()}
    built = {}
    for c, own in said.items():
        base, h = int(math.fmod(c, 100)), zlib.crc32(str(c).encode()) % 6
        built[c] = said.get(c - base, [])[:h] + own[h:]
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = set()
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(path))
        out.add(
            (
                min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), sum(len(p) == len(path) + 1 for p in below),
                sum(not any(len(q) == len(p) + 1 and q[:-1] == p for q in below) for p in below),
                sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in below if p), hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return out


def trie_rows(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.selectExpr("*", "'x' AS family", "1 AS digest", "2 AS node", "3 AS depth")
    got = prefix_trie.build(df).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()
    assert len(set(got)) == len(got)
    return {tuple(r) for r in got}


def test_trie_equals_brute_force(spark):
    rng = random.Random(2)
    ids = [*range(-230, -180), *range(-6, 40), *range(90, 130), 300, 305, 1_000_000, 1_000_007, 2_999]
    rows = []
    for c in ids:
        for t in range(rng.randrange(1, 9)):
            rows.append((c, rng.choice([t, t, t, None, 1]), rng.choice(["user", "assistant", None, ""]), rng.choice(["a", "bb", "", None, "ünï😀"])))
    rows += [(c, t, "user", "the same words") for c in range(5000, 5800) for t in range(3)]
    rows += [(c, 0, "user", "one turn") for c in range(30_000, 90_000, 300)]
    rows += [(None, 0, "user", "lost"), (7, 0, "user", "a"), (7, 0, "user", "a")]
    rng.shuffle(rows)
    assert trie_rows(spark, rows) == plain_trie(rows)


def test_trie_of_runs_of_families(spark):
    """More families end at one node than stand in one piece."""
    rows = [(c, 0, "user", "x") for c in range(0, 100 * prefix_trie.PIECE * 2 + 700, 100)]
    assert trie_rows(spark, rows) == plain_trie(rows)


def test_trie_of_long_and_lone_conversations(spark):
    rows = [(4, t, "user", "word " * 3) for t in range(400)] + [(101, 0, "user", "long " * 20_000)]
    assert trie_rows(spark, rows) == plain_trie(rows)
    assert trie_rows(spark, []) == set()
    assert trie_rows(spark, [(1, None, None, None)]) == plain_trie([(1, None, None, None)])


def test_trie_texts(spark):
    rows = [(c, t, "user", f"{c % 3}{t}") for c in range(20) for t in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = prefix_trie.with_texts(prefix_trie.build(df), df).collect()
    assert {(r["role"], r["text"]) for r in got} >= {(None, None), ("user", "00"), ("user", "12")}
    assert all((r["text"] is None) == (r["depth"] == 0) for r in got)


# --- WARC ------------------------------------------------------------------


def plain_warc(rows):
    data = [(i, (h or "").encode()) for i, _, h in rows]
    least = {}
    for i, b in data:
        if i is not None and len(b) >= 100:
            least[b] = min(i, least.get(b, i))
    out = []
    for i, b in data:
        again = b in least and i != least[b]
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", least[b] if again else None))
    return sorted(out, key=repr)


FIELDS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def pages_of(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.selectExpr("*", "'x' AS digest", "'y' AS payload", "3 AS least", "4 AS refers_to", "5 AS n")


def round_trip(spark, rows, split=warc.SPLIT, most=warc.ARCHIVE, payload=False):
    folder = shared.shared_folder(spark)
    made = warc.write(pages_of(spark, rows).repartition(3), folder, most=most)
    if not made.head(1):
        return made, []
    return made, warc.read(warc.archives(spark, folder), split, payload).collect()


ODD_PAGES = [
    (0, "http://a/", "x" * 100), (3, "http://b/", "x" * 100), (2, None, "x" * 100), (None, "http://c/", "x" * 100), (4, "http://d/", "x" * 99),
    (5, "http://e/", "x" * 99), (6, "http://evil/\r\nWARC-Type: metadata\r\n\r\n", None), (7, "", ""), (8, "http://ü/ <>", "ü😀\r\n\r\n" * 50),
    (9, "http://f/", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n" * 9), (10, "u" * 70_000, "long " * 300_000),
    (11, "http://g/", "dup " * 40), (11, "http://h/", "dup " * 40), (12, "http://g/", "dup " * 40), (13, "http://g/", "q"), (13, "http://g/", "r"),
]


@pytest.mark.parametrize("split", [1, 97, 4096, warc.SPLIT])
def test_warc_round_trip(spark, split):
    rows = ODD_PAGES if split > 1 else [r for r in ODD_PAGES if r[0] != 10]
    rows = rows + [(100 + i, f"http://x/{i}", f"page {i} " * (i % 40)) for i in range(60)]
    made, got = round_trip(spark, rows, split, most=2000)
    assert sorted([tuple(r[f] for f in FIELDS) for r in got], key=repr) == plain_warc(rows)
    assert sum(r["records"] for r in made.collect()) == len(rows)
    assert made.count() > 3


def test_warc_payloads_and_ids(spark):
    made, got = round_trip(spark, ODD_PAGES, payload=True)
    texts = {(r["page_id"], r["payload_digest"]): r["payload"] for r in got if r["record_type"] == "response"}
    for i, _, h in ODD_PAGES:
        b = (h or "").encode()
        assert texts.get((i, hashlib.sha256(b).hexdigest()), b) == b
    revisits = [r for r in got if r["record_type"] == "revisit"]
    assert revisits and all(r["payload"] is None for r in revisits)
    assert len({r["record_id"] for r in got}) == len(got) - 1  # 11 twice with one payload
    assert {r["target_uri"] for r in got} >= {None, "http://evil/%0D%0AWARC-Type:%20metadata%0D%0A%0D%0A"}


def test_warc_none(spark):
    assert round_trip(spark, [])[1] == []


def test_warc_is_read_by_gzip(spark):
    made, _ = round_trip(spark, ODD_PAGES[:3])
    for r in made.collect():
        whole = gzip.open(r["path"].removeprefix("file://")).read()
        assert whole.count(b"WARC/1.1\r\n") == r["records"]


def test_warc_damage_and_foreign_bytes():
    def rec(i):
        return warc.member(warc.page_record(i, "u", b"some text " * 50, hashlib.sha256(b"some text " * 50).hexdigest(), None))

    a, b, c = rec(1), rec(2), rec(3)
    bad = bytearray(b)
    bad[-6] ^= 1  # its checksum
    data = b"junk" + a + warc.MAGIC + b"not a member" + bytes(bad) + gzip.compress(b"no record") + c + c[:-10]
    rows = list(warc.owned(warc.Bytes(data), "x", 0, len(data), False))
    assert [(r[3], r[6]) for r in rows] == [("response", 1), ("damaged", 2), ("response", 3), ("damaged", 3)]
    for cut in range(0, len(data), 111):  # every record has one owner
        parts = list(warc.owned(warc.Bytes(data), "x", 0, cut, False)) + list(warc.owned(warc.Bytes(data), "x", cut, len(data), False))
        assert parts == rows


def test_warc_member_holds_no_other():
    inner = warc.member(warc.page_record(1, "u", random.Random(1).randbytes(300), "d", None))
    outer = warc.member(warc.page_record(2, "u", inner + random.Random(2).randbytes(3000), "d", None))
    at = outer.find(warc.MAGIC, 1)
    while at >= 0:
        assert warc.Member(warc.Bytes(outer), at).header() is None
        at = outer.find(warc.MAGIC, at + 1)
    assert [r[6] for r in warc.owned(warc.Bytes(outer), "x", 0, len(outer), False)] == [2]


# --- tiling of repetitive texts --------------------------------------------


def test_tiling_in_stretches_equals_tiling_at_once(monkeypatch):
    import pyarrow as pa

    from wiresift.llm import decontaminate
    from wiresift.llm.kernel import WORDY, buffers, grams, words

    def parts(text):
        w = words(*buffers(pa.array([text])), WORDY)
        h, ok = grams(w, 4)
        return w, h[: int(ok.sum())]

    rng = random.Random(9)
    for trial in range(60):
        letters = rng.choice(["a", "ab", "abc"])
        doc = " ".join(rng.choice(letters) for _ in range(rng.randrange(4, 220)))
        item = " ".join(rng.choice(letters) for _ in range(rng.randrange(4, 60)))
        (d, seeds), (t, _) = parts(doc), parts(item)
        monkeypatch.setattr(decontaminate, "PAIRS", 1 << 40)
        want = decontaminate.tiles_of(d, seeds, t, 4)
        for pairs in (0, 1, 7, 100):
            monkeypatch.setattr(decontaminate, "PAIRS", pairs)
            assert decontaminate.tiles_of(d, seeds, t, 4) == want, (doc, item, pairs)


def test_tiling_of_one_word_repeated_is_bounded():
    import tracemalloc

    import pyarrow as pa

    from wiresift.llm import decontaminate
    from wiresift.llm.kernel import WORDY, buffers, grams, words

    d, t = (words(*buffers(pa.array(["word " * n])), WORDY) for n in (200_000, 500))
    seeds, ok = grams(d, 4)
    tracemalloc.start()
    tiles = decontaminate.tiles_of(d, seeds[: int(ok.sum())], t, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert tiles == [(500, 0, 0)]
    assert peak < 300e6
