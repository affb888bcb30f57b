"""Prefix trie of conversations, merged family by family.

A conversation c is rebuilt from the opening of its family's base conversation, c - c % 100
(towards zero), and its own turns after as many.  A family is shuffled to one task, base
first; the task rebuilds its conversations and builds their small trie.  Only the families'
combined nodes travel on: nodes of all families merge by name, a digest of the path, and each
gets an owner, the family of its smallest member.  Families and the nodes they own are
cogrouped again to sum up subtrees, so every node is counted once, in one family, and the
sums of all families are added.  No step goes level by level, and turns travel as digests.

Turns are ordered by turn, null first, repeated ones by the digest of role and text; null
roles and texts are empty.  Rows without a conv_id belong to no conversation and are left
out.  An empty table gives no nodes.  Columns other than the four named are ignored.  A task
holds the trie of one family: some 300 bytes for each of its turns.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

FAMILY, OPENINGS = 100, 6
ROOT = bytes(16)
#: Families whose members' ids are put together in one piece of text.
PIECE = 256
#: Nodes of a batch.
BATCH = 8192

NODES = pa.schema(
    [("node", pa.binary()), ("parent", pa.binary()), ("turn", pa.binary()), ("family", pa.int64()), ("depth", pa.int64()), ("chars", pa.int64()), ("n", pa.int64()), ("first", pa.int64()), ("inner", pa.bool_()), ("ends", pa.string())]
)
SUMS = pa.schema([("node", pa.binary()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64())])


def ddl(schema: pa.Schema) -> str:
    names = {pa.binary(): "binary", pa.int64(): "long", pa.bool_(): "boolean", pa.string(): "string"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def opening(conv_id: int) -> int:
    """How many turns a conversation takes from its family's base."""
    return zlib.crc32(str(conv_id).encode()) % OPENINGS


def digest_of():
    """128 bits that stand for a turn's role and text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    return F.substring(F.unhex(F.sha2(said, 256)), 1, 16)


def turns(conversations: DataFrame) -> DataFrame:
    """(family, conv_id, turn, chars, digest) of all turns."""
    c, chars = F.col("conv_id").cast("long"), F.length(F.coalesce("text", F.lit(""))).cast("long")
    rows = conversations.where(c.isNotNull())
    return rows.select((c - c % FAMILY).alias("family"), c.alias("conv_id"), "turn", chars.alias("chars"), digest_of().alias("digest"))


class Trie:
    """One family's trie: nodes as rows of NODES, parents before children."""

    def __init__(self, family: int):
        self.family, self.rows, self.ends = family, [], []
        self.place: dict[bytes, int] = {}
        self.base: list[tuple[bytes, int]] = []

    def step(self, at: int, turn: bytes, chars: int, conv_id: int) -> int:
        """Conversation conv_id goes on from node `at` (-1: from nowhere, to the root) by a turn."""
        parent = self.rows[at][0] if at >= 0 else None
        node = ROOT if at < 0 else hashlib.sha256(parent + turn).digest()[:16]
        found = self.place.get(node)
        if found is None:
            found = self.place[node] = len(self.rows)
            self.rows.append([node, parent, turn, self.family, self.rows[at][4] + 1 if at >= 0 else 0, chars, 0, conv_id, False, ""])
            self.ends.append([])
            if at >= 0:
                self.rows[at][8] = True
        row = self.rows[found]
        row[6] += 1
        row[7] = min(row[7], conv_id)
        return found

    def done(self) -> list[list]:
        for row, ends in zip(self.rows, self.ends):
            row[9] = ",".join(map(str, sorted(ends)))
        return self.rows


def family_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of NODES from sorted turns: families one after another, in each the base first."""
    trie, conv, at, seen, skip, out = None, None, -1, 0, 0, []
    for b in batches:
        for family, c, chars, turn in zip(*(b.column(x).to_pylist() for x in ("family", "conv_id", "chars", "digest"))):
            if trie is None or family != trie.family or c != conv:
                if trie is not None:
                    trie.ends[at].append(conv)
                    if family != trie.family:
                        out += trie.done()
                        trie = None
                        while len(out) >= BATCH:
                            yield batch(out[:BATCH], NODES)
                            out = out[BATCH:]
                if trie is None:
                    trie = Trie(family)
                conv, seen, skip = c, 0, opening(c)
                at = trie.step(-1, b"", 0, c)
                if c != family:
                    for said in trie.base[:skip]:
                        at = trie.step(at, *said, c)
            if c == family and seen < OPENINGS - 1:
                trie.base.append((turn, chars))
            if c == family or seen >= skip:
                at = trie.step(at, turn, chars, c)
            seen += 1
    if trie is not None:
        trie.ends[at].append(conv)
        out += trie.done()
        for i in range(0, len(out), BATCH):
            yield batch(out[i : i + BATCH], NODES)


def batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def family_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a family's own nodes add to each node above them: rows of SUMS.

    Rows come by family and depth; a node that the family owns comes twice, the owned row with its value.
    """
    now, nodes = None, {}
    for b in batches:
        names = ("family", "node", "parent", "owned", "leaf", "saved")
        for family, node, parent, owned, leaf, saved in zip(*(b.column(x).to_pylist() for x in names)):
            if family != now:
                yield from summed(nodes)
                now, nodes = family, {}
            row = nodes.setdefault(node, [parent, 0, 0, 0, 0])
            if owned:
                row[1:] = [1, 0, int(leaf), saved]
    yield from summed(nodes)


def summed(nodes: dict) -> Iterator[pa.RecordBatch]:
    """`nodes` (name to parent, owned, children, leaves, saved), parents first, with the subtrees' sums."""
    for parent, owned, _, leaves, saved in reversed(nodes.values()):
        if parent is not None:
            up = nodes[parent]
            up[2] += owned
            up[3] += leaves
            up[4] += saved
    rows = [[node, *row[2:]] for node, row in nodes.items() if any(row[2:])]
    for i in range(0, len(rows), BATCH):
        yield batch(rows[i : i + BATCH], SUMS)


def end_digests(nodes: DataFrame) -> DataFrame:
    """(node, ends_sha256) of nodes where conversations end.

    Families are ranges of ids, so a node's ids are put together by runs of families, of a
    bounded number each, and one pass over the runs in order, as the digest asks for, ends it.
    """
    rows = nodes.where(F.col("ends") != "").select("node", "family", "ends", F.floor(F.col("family") / (FAMILY * PIECE)).alias("run"))
    pieces = F.array_sort(F.collect_list(F.struct("family", "ends")))
    rows = rows.groupBy("node", "run").agg(F.array_join(F.transform(pieces, lambda p: p["ends"]), ",").alias("ends"))

    def digest(batches):
        now, state = None, None
        for b in batches:
            for node, ends in zip(b.column("node").to_pylist(), b.column("ends").to_pylist()):
                if node == now:
                    state.update(b"," + ends.encode())
                    continue
                if now is not None:
                    yield pa.RecordBatch.from_pydict({"node": [now], "ends_sha256": [state.hexdigest()]})
                now, state = node, hashlib.sha256(ends.encode())
        if now is not None:
            yield pa.RecordBatch.from_pydict({"node": [now], "ends_sha256": [state.hexdigest()]})

    width = shared.shuffle_width(nodes.sparkSession)
    return rows.repartition(width, "node").sortWithinPartitions("node", "run").mapInArrow(digest, "node binary, ends_sha256 string")


def build(conversations: DataFrame) -> DataFrame:
    """All nodes: node, parent, turn (digests), conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    width = shared.shuffle_width(conversations.sparkSession)
    said = turns(conversations).repartition(width, "family")
    order = [F.col("family"), F.col("conv_id") != F.col("family"), F.col("conv_id"), F.asc_nulls_first("turn"), F.col("digest")]
    nodes = shared.written(said.sortWithinPartitions(*order).mapInArrow(family_nodes, ddl(NODES)))

    same = [F.min(c).alias(c) for c in ("parent", "turn", "depth", "chars")]
    merged = nodes.groupBy("node").agg(*same, F.sum("n").alias("n_convs"), F.min("first").alias("conv_id"), F.max("inner").alias("inner"))
    merged = shared.written(merged)
    member = nodes.select("family", "node", "parent", "depth", F.lit(False).alias("owned"), F.lit(False).alias("leaf"), F.lit(0).cast("long").alias("saved"))
    own = merged.select(
        (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("family"), "node", "parent", "depth", F.lit(True).alias("owned"),
        (~F.col("inner")).alias("leaf"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
    )
    both = member.unionByName(own).repartition(width, "family").sortWithinPartitions("family", "depth")
    sums = both.mapInArrow(family_sums, ddl(SUMS))

    known = ("parent", "turn", "depth", "n_convs", "conv_id")
    parts = merged.select("node", *known).unionByName(sums, allowMissingColumns=True).unionByName(end_digests(nodes), allowMissingColumns=True)
    adds = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("n_children", "n_leaves", "saved_tokens")]
    ends = F.coalesce(F.max("ends_sha256"), F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")
    whole = shared.written(parts.groupBy("node").agg(*[F.max(c).alias(c) for c in known], *adds, ends))
    above = whole.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    return shared.looked_up(whole, above, "parent", "n_children", F.col("node"))


def with_texts(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """`nodes` of build() with `role` and `text` of each node's last turn; null at the root."""
    asked = nodes.groupBy("turn").agg(F.count("*").alias("asked"))
    said = conversations.where(F.col("conv_id").isNotNull()).select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")], digest_of().alias("turn"))
    said = said.groupBy("turn").agg(F.min("role").alias("role"), F.min("text").alias("text")).join(asked, "turn")
    return shared.looked_up(nodes, said, "turn", "asked", F.col("node"))
