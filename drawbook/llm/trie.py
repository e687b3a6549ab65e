"""Prefix trie of conversations by splitters and a skeleton.

A conversation is one key: the digests of its turns, in order, then its number. Splitters taken from a sample of keys deal
the keys out to shards by range. A trie node whose path starts no splitter's path has all its members in one shard; the
others, the prefixes of splitter paths, form the skeleton, a small trie that is sent to every task. A shard, sorted by key,
finishes all its own nodes in one pass that holds only the open path, and hands partial aggregates of skeleton nodes on;
these are added up per node, and then up the skeleton.

A first conversation that a third of all rows repeat is split too, since the number is part of the key.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawbook.session import write_table

WORD = r"[^\x20\x09-\x0D]+"
DIGEST = 16
#: Keys sampled for each shard; only the balance of shards depends on the sample.
SAMPLED = 16
#: Splitter paths stop here, so the skeleton has at most this many nodes for each splitter.
SPLITTER_TURNS = 256
IDS_PER_CHUNK = 16_384
NODE, PARTIAL, ENDS = 0, 1, 2
EMPTY = hashlib.sha256(b"").hexdigest()
ROWS = ("kind int, shard int, seq long, skel int, skel_parent int, depth int, conv_id long, n_convs long, n_children long, n_leaves long, "
        "saved long, words long, ends string, parent_conv_id long")


def turn_digest(role: Column, text: Column) -> Column:
    """128 bits, as hexadecimal text, of role and text; the length keeps them apart."""
    return F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST)


def rebuilt_paths(conversations: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """One row per conversation: ``conv_id``, ``path`` (digests of its rebuilt turns) and ``words`` of each turn.

    A conversation is rebuilt from the first ``h`` turns of the first conversation of its group of ``group`` numbers and
    its own turns after its first ``h``, where ``h`` is the CRC-32 of its decimal number modulo ``most``.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = turn_digest(role, text)
    turn = F.struct(F.col("turn").isNotNull().alias("numbered"), F.col("turn").alias("turn"), role.alias("role"), digest.alias("digest"),
                    F.regexp_count(text, F.lit(WORD)).cast("int").alias("words"))
    whole = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(
        F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("own"))
    heads = whole.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("own", 1, most - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    nothing = F.array().cast("array<struct<digest:string,words:int>>")
    joined = whole.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).join(heads, "base", "left").withColumn("h", h)
    turns = F.concat(F.slice(F.coalesce("head", nothing), F.lit(1), F.col("h")), F.slice("own", F.col("h") + 1, F.size("own")))
    return joined.select("conv_id", turns.alias("turns")).select(
        "conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("path"), F.transform("turns", lambda t: t["words"]).alias("words"))


def splitters(paths: DataFrame, per_shard: int, most_shards: int) -> list[tuple[bytes, int]]:
    """Sorted keys that bound the shards: at most ``most_shards`` - 1 paths of ``SPLITTER_TURNS`` turns each."""
    turns = paths.agg(F.sum(F.size("words") + 1).alias("n")).first()["n"] or 0
    shards = max(1, min(most_shards, -(-turns // per_shard)))
    if shards == 1:
        return []
    sample = paths.select(F.substring("path", 1, SPLITTER_TURNS * DIGEST).alias("path"), "conv_id").orderBy(F.xxhash64("conv_id"), "conv_id").limit(shards * SAMPLED)
    keys = sorted((bytes(r["path"]), r["conv_id"]) for r in sample.collect())
    return sorted({keys[len(keys) * i // shards] for i in range(1, shards)})


def skeleton_of(keys: list[tuple[bytes, int]]) -> tuple[dict[tuple[int, bytes], int], list[int], list[int]]:
    """Numbers of the skeleton's nodes by (parent's number, digest), and the parent and depth of each; 0 is the root."""
    child: dict[tuple[int, bytes], int] = {}
    parent, depth = [-1], [0]
    for path, _ in keys:
        at = 0
        for i in range(0, len(path), DIGEST):
            step = (at, path[i:i + DIGEST])
            if step not in child:
                child[step] = len(parent)
                parent.append(at)
                depth.append(depth[at] + 1)
            at = child[step]
    return child, parent, depth


class Shard:
    """One pass over sorted keys. ``open`` holds the nodes of the current path below the skeleton, outermost first."""

    def __init__(self, child: dict[tuple[int, bytes], int]):
        self.child, self.out, self.seq, self.shard = child, [], 0, None
        self.path, self.skeleton, self.open, self.partial = b"", [0], [], {}
        self.ids: list[int] = []
        self.ids_of = 0

    def emit(self, kind: int, **values) -> None:
        self.seq += 1
        self.out.append({"kind": kind, "shard": self.shard, "seq": self.seq, **values})

    def close(self, keep: int) -> None:
        """Finish all nodes deeper than ``keep`` turns."""
        bottom = len(self.skeleton) - 1
        while self.open and bottom + len(self.open) > keep:
            node, depth = self.open.pop(), bottom + len(self.open) + 1
            leaves = node["n_leaves"] if node["n_children"] else 1
            saved = node["saved"] + (node["n_convs"] - 1) * node["words"]
            above = self.open[-1] if self.open else self.aggregate(self.skeleton[-1], bottom)
            above["conv_id"] = node["conv_id"] if above["conv_id"] is None else min(above["conv_id"], node["conv_id"])
            above["n_convs"] += node["n_convs"]
            above["n_children"] += 1
            above["n_leaves"] += leaves
            above["saved"] += saved
            self.emit(NODE, skel_parent=None if self.open else self.skeleton[-1], depth=depth, conv_id=node["conv_id"], n_convs=node["n_convs"],
                      n_children=node["n_children"], n_leaves=leaves, saved=saved, ends=node["ends"].hexdigest() if node["ends"] else None)
        del self.skeleton[max(keep, 0) + 1:]

    def aggregate(self, number: int, depth: int) -> dict:
        if number not in self.partial:
            self.partial[number] = {"conv_id": None, "n_convs": 0, "n_children": 0, "n_leaves": 0, "saved": 0, "words": 0, "depth": depth}
        return self.partial[number]

    def flush_ids(self) -> None:
        if self.ids:
            self.emit(ENDS, skel=self.ids_of, ends=",".join(map(str, self.ids)))
            self.ids = []

    def end_shard(self) -> None:
        if self.shard is not None:
            self.close(-1)
            self.flush_ids()
            for number, values in self.partial.items():
                self.emit(PARTIAL, skel=number, **values)
        self.path, self.skeleton, self.partial = b"", [0], {}

    def add(self, shard: int, path: bytes, conv_id: int, words: list[int]) -> None:
        if shard != self.shard:
            self.end_shard()
            self.shard = shard
            self.aggregate(0, 0)
        same, length = 0, min(len(path), len(self.path))
        if path == self.path:
            same = length
        while same < length and path[same:same + DIGEST] == self.path[same:same + DIGEST]:
            same += DIGEST
        self.close(same // DIGEST)
        for at in range(same, len(path), DIGEST):
            number = None if self.open else self.child.get((self.skeleton[-1], path[at:at + DIGEST]))
            if number is None:
                self.open.append({"conv_id": None, "n_convs": 0, "n_children": 0, "n_leaves": 0, "saved": 0, "words": words[at // DIGEST], "ends": None})
            else:
                self.skeleton.append(number)
                self.aggregate(number, len(self.skeleton) - 1)["words"] = words[at // DIGEST]
        self.path = path
        if self.open:
            node = self.open[-1]
            if node["ends"] is None:
                node["ends"] = hashlib.sha256(str(conv_id).encode())
            else:
                node["ends"].update(b",%d" % conv_id)
        else:
            node = self.aggregate(self.skeleton[-1], len(self.skeleton) - 1)
            if self.ids_of != self.skeleton[-1] or len(self.ids) >= IDS_PER_CHUNK:
                self.flush_ids()
            self.ids_of = self.skeleton[-1]
            self.ids.append(conv_id)
        node["conv_id"] = conv_id if node["conv_id"] is None else min(node["conv_id"], conv_id)
        node["n_convs"] += 1


def _arrow(schema: pa.Schema, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


ARROW = pa.schema([(part.split()[0], {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[part.split()[1]]) for part in ROWS.split(", ")])


def shard_rows(dealt: DataFrame, child: dict[tuple[int, bytes], int]) -> DataFrame:
    """Finished nodes, partial aggregates of skeleton nodes, and the numbers that end at skeleton nodes, in pieces.

    Nodes leave the pass after all their descendants; read backwards, parents come first and a second pass names them.
    """

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Shard(child)
        for batch in batches:
            for shard, path, conv_id, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                state.add(shard, path, conv_id, words)
                if len(state.out) >= 4096:
                    yield _arrow(ARROW, state.out)
                    state.out = []
        state.end_shard()
        yield _arrow(ARROW, state.out)

    def name_parents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path: dict[int, int] = {}
        for batch in batches:
            kinds, depths, convs, tops = (batch.column(ARROW.get_field_index(c)).to_pylist() for c in ("kind", "depth", "conv_id", "skel_parent"))
            parents = []
            for kind, depth, conv_id, top in zip(kinds, depths, convs, tops, strict=True):
                if kind == NODE:
                    path[depth] = conv_id
                parents.append(path[depth - 1] if kind == NODE and top is None else None)
            yield batch.set_column(ARROW.get_field_index("parent_conv_id"), "parent_conv_id", pa.array(parents, pa.int64()))

    return dealt.mapInArrow(finish, ROWS).sortWithinPartitions(F.desc("seq")).mapInArrow(name_parents, ROWS)


def end_hashes(pieces: DataFrame) -> DataFrame:
    """SHA-256 of the joined numbers of each skeleton node; a hash is fed piece by piece, in the order of the keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            for skel, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if skel != at:
                    if at is not None:
                        yield pa.RecordBatch.from_pydict({"skel": pa.array([at], pa.int32()), "ends": [state.hexdigest()]})
                    at, state = skel, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
        if at is not None:
            yield pa.RecordBatch.from_pydict({"skel": pa.array([at], pa.int32()), "ends": [state.hexdigest()]})

    ordered = pieces.repartition("skel").sortWithinPartitions("skel", "shard", "seq").select("skel", "ends")
    return ordered.mapInArrow(run, "skel int, ends string")


def prefix_trie(conversations: DataFrame, per_shard: int = 20_000, most_shards: int = 4096) -> DataFrame:
    """One row per trie node: ``conv_id``, ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` and ``ends_sha256``.

    * ``conversations`` has ``conv_id``, ``turn``, ``role`` and ``text``; other columns, whatever their names, are not
      read. Rows without a ``conv_id`` belong to no conversation. Null roles and texts are empty. Turns stand by number,
      nulls first; equal numbers by role, then by digest. Repeated rows are repeated turns.
    * An empty table gives an empty one. A conversation without any turn left ends at the root.
    * A shard takes about ``per_shard`` turns, or more where there would be over ``most_shards`` of them; it is sorted and
      streamed, so its size costs no memory. What is held whole is one conversation's digests (about 40 bytes a turn),
      the open path, and the skeleton.
    * Turns are told apart by 128 bits of SHA-256.
    """
    spark = conversations.sparkSession
    paths, _ = write_table(rebuilt_paths(conversations), "trie-paths")
    keys = splitters(paths, per_shard, most_shards)
    child, parent, depth = skeleton_of(keys)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = [bisect_right(keys, key) for key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), *batch.columns], ["shard", "path", "conv_id", "words"])

    dealt = paths.select("path", "conv_id", "words").mapInArrow(deal, "shard int, path binary, conv_id long, words array<int>")
    dealt = dealt.repartition("shard").sortWithinPartitions("shard", "path", "conv_id")
    rows, _ = write_table(shard_rows(dealt, child), "trie-rows")

    tops = skeleton_nodes(rows, parent, depth)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    above = spark.createDataFrame([(n["skel"], n["conv_id"]) for n in tops], "skel_parent int, top_conv_id long")
    nodes = rows.where(F.col("kind") == NODE).join(F.broadcast(above), "skel_parent", "left").select(
        "conv_id", F.col("depth").cast("long").alias("depth"), F.coalesce("parent_conv_id", "top_conv_id").alias("parent_conv_id"), "n_convs", "n_children",
        "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"))
    return nodes.unionByName(spark.createDataFrame([tuple(n[c] for c in columns) for n in tops], nodes.schema))


def skeleton_nodes(rows: DataFrame, parent: list[int], depth: list[int]) -> list[dict]:
    """Skeleton nodes with whole aggregates: partials are added up by Spark, then children into parents here.

    There are at most ``SPLITTER_TURNS`` of them for each splitter.
    """
    parts = rows.where(F.col("kind") == PARTIAL).groupBy("skel").agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")], F.max("words").alias("words"))
    ends = {r["skel"]: r["ends"] for r in end_hashes(rows.where(F.col("kind") == ENDS).select("skel", "shard", "seq", "ends")).collect()}
    found = {r["skel"]: r.asDict() for r in parts.collect()}
    for number in sorted(found, reverse=True):  # children have larger numbers than their parents
        node = found[number]
        node["n_leaves"] = node["n_leaves"] if node["n_children"] else 1
        node["saved_tokens"] = node.pop("saved") + (node["n_convs"] - 1) * node["words"]
        node |= {"depth": depth[number], "ends_sha256": ends.get(number, EMPTY)}
        if number:
            above = found[parent[number]]
            above["conv_id"] = node["conv_id"] if above["conv_id"] is None else min(above["conv_id"], node["conv_id"])
            above["n_convs"] += node["n_convs"]
            above["n_children"] += 1
            above["n_leaves"] += node["n_leaves"]
            above["saved"] += node["saved_tokens"]
    for number, node in found.items():
        node["parent_conv_id"] = found[parent[number]]["conv_id"] if number else None
    return list(found.values())
