"""Similarity join of documents on word shingles: a blocked sparse matrix product with size-derived bounds.

The documents by shingles matrix is never multiplied whole. Its rows are the different shingle sets (equal sets are one
row), and of each row only the rarest columns are kept: two sets of similarity ``t`` share at least one of the first
``n - ceil(t n) + 1`` shingles of each, in any one order of shingles. Rare first keeps common passages out. The order
comes from a table of counts of fixed size.

The kept entries are cut into blocks of columns, which travel as arrays. A block's task lists which rows meet in a column;
columns with the same rows count as one. A pair of rows is dropped where their sizes and the places of the shared column
show that they can't reach the overlap that their sizes require. What is left is verified on whole sets.

Links are only needed up to reachability, so a group of many copies isn't multiplied out at once: each row is paired first
with one hub of each of its columns, and where that leaves components apart, with some more. Rows that verified pairs join need no further comparison.
Where many pairs would still be left, the rows outside a column's largest component meet growing samples of the column first: a row that
links to a small share of a large group joins it after few comparisons. Of columns that still hold several components, blocks of rows
list the pairs that lie apart and may match; these are verified too. No pair is capped or left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawbook.llm.rows import free_name
from drawbook.llm.components import components
from drawbook.llm.sieve import sieved
from drawbook.llm.shingles import chunks, mix, shingle_sets
from drawbook.llm.workers import tidy_driver, tidy_group, tidy_task
from drawbook.session import write_table

SLICES = 256
ORDER_BITS = 20
FIRST_HUBS, HUBS, HUB_TURNS = 1, 8, 2
SAMPLED_HUBS, OPEN_PAIRS_A_ROW = (32, 128, 512), 4
CHUNK_ROWS = 1024
MEET_ROWS, MEET_PAIRS = 200_000, 4_000_000
BLOCK_ENTRIES = 1_000_000
FLUSH_ENTRIES = 1_000_000


def signatures(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One hash per set; 0 for an empty one."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    out = mix((total[bounds[1:]] - total[bounds[:-1]]) + np.diff(bounds).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
    out[np.diff(bounds) == 0] = 0
    return out.view(np.int64)


def narrow(x: np.ndarray) -> bytes:
    """Whole numbers in the least width that holds the largest."""
    return x.astype(np.min_scalar_type(int(x.max()))).tobytes()


def widened(data: bytes, count: int) -> np.ndarray:
    """``count`` numbers written by :func:`narrow`."""
    return np.frombuffer(data, f"u{len(data) // count}").astype(np.uint32)


def sets_of(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    for first, end, data, offsets in chunks(batch.column(1)):
        hashes, bounds = shingle_sets(data, offsets, width)
        yield first, end, hashes, bounds, signatures(hashes, bounds)


def shingle_rows(docs: DataFrame, width: int) -> DataFrame:
    """(``key``, ``th``, ``n``, ``sig``) of every document, and the task's counts of shingles in ``SLICES`` rows (``slice``, ``counts``)."""
    key = docs.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << ORDER_BITS, np.uint32)
        names, kind = ["key", "th", "n", "sig", "slice", "counts"], pa.int64()
        for batch in batches:
            kind = batch.schema.field(0).type
            for first, end, hashes, bounds, sigs in sets_of(batch, width):
                counts += np.bincount((hashes >> np.uint64(64 - ORDER_BITS)).astype(np.int64), minlength=1 << ORDER_BITS).astype(np.uint32)
                rows = end - first
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, rows), batch.column(2).slice(first, rows), pa.array(np.diff(bounds)), pa.array(sigs),
                                                  pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names=names)
        if counts.any():
            parts = [x.tobytes() for x in np.split(counts, SLICES)]
            yield pa.RecordBatch.from_arrays([pa.nulls(SLICES, kind), *(pa.nulls(SLICES, pa.int64()) for _ in range(3)),
                                              pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], names=names)

    return docs.mapInArrow(tidy_task(run), f"key {key}, th long, n long, sig long, slice int, counts binary")


def shingle_order(rows: DataFrame) -> np.ndarray:
    """Counts of all documents' shingles by leading bits of the hash: an array of ``2 ** ORDER_BITS`` whatever the input."""

    def add(keys: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((1 << ORDER_BITS) // SLICES, np.uint64)
        for x in frame["counts"]:
            part = np.frombuffer(x, np.uint64 if len(x) == total.nbytes else np.uint32)
            total += part
        return pd.DataFrame({"slice": [keys[0]], "counts": [total.tobytes()]})

    parts = rows.where("slice is not null").select("slice", "counts", (F.spark_partition_id() % 1024).alias("part"))
    parts = parts.groupBy("slice", "part").applyInPandas(tidy_group(add), "slice int, counts binary")
    whole = parts.groupBy("slice").applyInPandas(tidy_group(add), "slice int, counts binary")
    out = np.zeros((SLICES, (1 << ORDER_BITS) // SLICES), np.uint64)
    for row in whole.collect():
        out[row["slice"]] = np.frombuffer(row["counts"], np.uint64)
    return np.minimum(out.ravel(), np.uint64(0xFFFFFFFF)).astype(np.uint32)


def prefix_blocks(docs: DataFrame, order, width: int, percent: int, blocks: int) -> DataFrame:
    """Kept entries as arrays, row after row: (``block``, ``hashes``, ``places``), and of each row ``counts`` of entries, ``sigs``, ``sizes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = order.value
        held: list[tuple[np.ndarray, np.ndarray]] = []
        sigs: list[int] = []
        sizes: list[int] = []
        seen: set[int] = set()
        entries = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal entries
            if not held:
                return
            hashes = np.concatenate([h for h, _ in held])
            places = np.concatenate([p for _, p in held])
            rows = np.repeat(np.arange(len(held), dtype=np.uint32), [len(h) for h, _ in held])
            block = (hashes % np.uint64(blocks)).astype(np.int32)
            turn = np.argsort(block, kind="stable")
            cuts = np.searchsorted(block[turn], np.arange(blocks + 1))
            every_sig, every_size = np.array(sigs, np.int64), np.array(sizes, np.uint32)
            out = []
            for b in range(blocks):
                own = turn[cuts[b]: cuts[b + 1]]
                if len(own):
                    used, counts = np.unique(rows[own], return_counts=True)
                    out.append((b, hashes[own].tobytes(), narrow(counts), narrow(places[own]), every_sig[used].tobytes(), narrow(every_size[used])))
            held.clear(), sigs.clear(), sizes.clear(), seen.clear()
            entries = 0
            for row in out:
                yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int32()), *(pa.array([x], pa.binary()) for x in row[1:])],
                                                 names=["block", "hashes", "counts", "places", "sigs", "sizes"])

        for batch in batches:
            for first, end, hashes, bounds, sig in sets_of(batch, width):
                commonness = rank[(hashes >> np.uint64(64 - ORDER_BITS)).astype(np.int64)]
                for d in range(end - first):
                    a, b = bounds[d], bounds[d + 1]
                    n = int(b - a)
                    if not n or int(sig[d]) in seen:
                        continue
                    seen.add(int(sig[d]))
                    kept = n - -(-percent * n // 100) + 1
                    first_ones = np.argsort(commonness[a:b], kind="stable")[:kept]
                    held.append((hashes[a:b][first_ones], np.arange(kept, dtype=np.uint32)))
                    sigs.append(int(sig[d]))
                    sizes.append(n)
                    entries += kept
                if entries >= FLUSH_ENTRIES:
                    yield from flush()
        yield from flush()

    return docs.mapInArrow(tidy_task(run), "block int, hashes binary, counts binary, places binary, sigs binary, sizes binary")


def multiply_block(frame: pd.DataFrame) -> pd.DataFrame:
    """The rows that meet in the block's columns: (``g``, ``sig``, ``n``, ``place``).

    ``g`` stands for the columns in which just these rows meet, ``place`` is the row's first place among them.
    """
    empty = pd.DataFrame({c: np.zeros(0, np.int64) for c in ("g", "sig", "n", "place")})
    counts = [widened(c, len(s) // 8) for c, s in zip(frame["counts"], frame["sigs"], strict=True)]
    sig = np.concatenate([np.repeat(np.frombuffer(s, np.int64), c) for s, c in zip(frame["sigs"], counts, strict=True)])
    size = np.concatenate([np.repeat(widened(s, len(c)), c) for s, c in zip(frame["sizes"], counts, strict=True)])
    column = np.concatenate([np.frombuffer(x, np.uint64) for x in frame["hashes"]])
    place = np.concatenate([widened(p, len(x) // 8) for p, x in zip(frame["places"], frame["hashes"], strict=True)])
    turn = np.argsort(column, kind="stable")
    met = column[turn]
    same = met[1:] == met[:-1]
    keep = turn[np.concatenate([[False], same]) | np.concatenate([same, [False]])]  # columns with two entries at least
    if not len(keep):
        return empty
    keep = keep[np.lexsort((sig[keep], column[keep]))]
    once = np.ones(len(keep), bool)  # a set that several tasks have sent counts once
    once[1:] = (column[keep][1:] != column[keep][:-1]) | (sig[keep][1:] != sig[keep][:-1])
    keep = keep[once]
    column, sig, size, place = column[keep], sig[keep], size[keep], place[keep]
    starts = np.flatnonzero(np.concatenate([[True], column[1:] != column[:-1]]))
    lengths = np.diff(np.concatenate([starts, [len(column)]]))
    members = mix(np.add.reduceat(mix(sig.view(np.uint64)), starts) + lengths.astype(np.uint64)).view(np.int64)
    out = pd.DataFrame({"g": np.repeat(members, lengths), "sig": sig, "n": size.astype(np.int64), "place": place.astype(np.int64)})
    out = out[np.repeat(lengths > 1, lengths)]
    if not len(out):
        return empty
    return out.groupby(["g", "sig", "n"], as_index=False, sort=False).agg(place=("place", "min"))


def whole_sets(texts: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(``sig``, ``members`` as sorted hashes) of the documents in ``wanted`` (``key``), and of few others.

    Texts of other ids are sieved out before they are cut into shingles, and no text is shuffled.
    """
    chosen = sieved(texts, texts.columns[0], wanted, "key").select(*texts.columns[:2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for first, end, hashes, bounds, sigs in sets_of(batch, width):
                own = []
                for d in range(end - first):
                    if int(sigs[d]) not in seen:
                        seen.add(int(sigs[d]))
                        own.append(d)
                yield pa.RecordBatch.from_arrays([pa.array(sigs[own]), pa.array([hashes[bounds[d]: bounds[d + 1]].tobytes() for d in own], pa.binary())],
                                                 names=["sig", "members"])

    return chosen.mapInArrow(tidy_task(run), "sig long, members binary")


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) whose sets reach the similarity."""
    left, right = sets.select(F.col("sig").alias("a"), F.col("members").alias("x")), sets.select(F.col("sig").alias("b"), F.col("members").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = np.zeros(batch.num_rows, bool)
            for k in range(batch.num_rows):
                x, y = np.frombuffer(batch.column(2)[k].as_buffer(), np.uint64), np.frombuffer(batch.column(3)[k].as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                shared = int((y[at] == x).sum())
                linked[k] = 100 * shared >= percent * (len(x) + len(y) - shared)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(linked))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(tidy_task(run), "a long, b long")


def needed(n1: str, n2: str, percent: int) -> Column:
    """Shared shingles that sets of two sizes need: 100 x >= percent (n1 + n2 - x)."""
    return F.expr(f"({percent} * ({n1} + {n2}) + {99 + percent}) div {100 + percent}")


def possible(n1: str, n2: str, place1: str, place2: str, percent: int) -> Column:
    """Neither size nor the places of a shared shingle rule out the overlap that the sizes require."""
    need = needed(n1, n2, percent)
    return (F.least(n1, n2) >= need) & (F.col(n1) - F.col(place1) >= need) & (F.col(n2) - F.col(place2) >= need)


def unsettled(met: DataFrame, joined: DataFrame | None) -> DataFrame:
    """Rows of the columns that rows of more than one component share, with their component ``joined``."""
    if joined is None:
        return met.withColumn("joined", F.col("sig"))
    placed = met.join(joined, "sig", "left").withColumn("joined", F.coalesce("joined", "sig"))
    mixed = placed.groupBy("g").agg(F.min("joined").alias("lo"), F.max("joined").alias("hi")).where("lo < hi").select("g")
    return placed.join(mixed, "g")


def hub_pairs(rows: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs (``a``, ``b``) of each row with the hubs of its columns that lie in other components.

    A column's hubs are its least rows under ``HUBS`` hash functions, so that columns with mostly the same rows have mostly
    the same hubs, and each is an aggregate with map-side combine.
    """
    fields = ("sig", "n", "place", "joined")
    hub = lambda k: F.min(F.struct(F.xxhash64("sig", F.lit(turn * HUBS + k)).alias("h"), *fields))
    hubs = rows.groupBy("g").agg(F.array(*(hub(k) for k in range(HUBS if turn else FIRST_HUBS))).alias("hubs"))
    apart = F.filter("hubs", lambda h: h["joined"] != F.col("joined"))
    return (
        rows.join(hubs, "g").select("sig", "n", "place", F.explode(F.array_distinct(apart)).alias("h"))
        .select("sig", "n", "place", *(F.col(f"h.{c}").alias(f"h_{c}") for c in ("sig", "n", "place")))
        .where(possible("n", "h_n", "place", "h_place", percent))
        .select(F.least("sig", "h_sig").alias("a"), F.greatest("sig", "h_sig").alias("b")).distinct()
    )


def matchable(rows: DataFrame, percent: int) -> DataFrame:
    """``rows`` without those that no row of the column could match, given the least size there and the row's place."""
    least = rows.groupBy("g").agg(F.min("n").alias("m"))
    partner = f"greatest(m, ({percent} * n + 99) div 100)"
    able = rows.join(least, "g").where(F.expr(f"n - place >= ({percent} * (n + {partner}) + {99 + percent}) div {100 + percent}")).drop("m")
    mixed = able.groupBy("g").agg(F.min("joined").alias("lo"), F.max("joined").alias("hi")).where("lo < hi").select("g")
    return able.join(mixed, "g")


def column_sizes(rows: DataFrame) -> DataFrame:
    """(``g``, ``held``, ``most``, ``largest``): a column's rows, those of its largest component, and that component."""
    return rows.groupBy("g", "joined").agg(F.count("*").alias("own")).groupBy("g").agg(
        F.sum("own").alias("held"), F.max(F.struct("own", "joined")).alias("m")).select("g", "held", F.col("m.own").alias("most"), F.col("m.joined").alias("largest"))


def many_pairs(rows: DataFrame) -> bool:
    """Whether the rows outside their columns' largest components would make many more pairs than there are rows."""
    size = column_sizes(rows).agg(F.sum("held").alias("rows"), F.sum((F.col("held") - F.col("most")).cast("double") * F.col("held")).alias("pairs")).first()
    return (size["pairs"] or 0) > OPEN_PAIRS_A_ROW * (size["rows"] or 0)


def sampled_pairs(rows: DataFrame, turn: int, hubs: int, percent: int) -> DataFrame:
    """Pairs (``a``, ``b``) of each row outside its column's largest component with about ``hubs`` rows of the column in other ones.

    The sample goes by a hash of the row alone, so that columns with mostly the same rows have mostly the same sample.
    """
    sized = rows.join(column_sizes(rows), "g")
    sample = sized.where(F.pmod(F.xxhash64("sig", F.lit(-turn)), F.lit(1 << 20)) * F.col("held") < hubs << 20)
    sample = sample.select("g", *(F.col(c).alias(f"h_{c}") for c in ("sig", "n", "place", "joined")))
    return (
        sized.where("joined <> largest").join(sample, "g").where("joined <> h_joined").where(possible("n", "h_n", "place", "h_place", percent))
        .select(F.least("sig", "h_sig").alias("a"), F.greatest("sig", "h_sig").alias("b")).distinct()
    )


def open_pairs(rows: DataFrame, percent: int, blocks: int) -> DataFrame:
    """Distinct pairs (``a``, ``b``) of rows that share a column, lie in different components and may match.

    The rows of a column are cut into chunks of bounded size, and each pair of chunks is a block of its own. Tasks take many
    small blocks or a few large ones, by the rows and pairs they may hold, and list a pair once, as arrays dealt by its hash
    to the tasks that drop repeats.
    """
    parts = rows.groupBy("g").agg(F.count("*").alias("held")).withColumn("parts", F.ceil(F.col("held") / CHUNK_ROWS).cast("int"))
    held = parts.agg(F.sum(F.col("held") * F.col("parts")).alias("rows"), F.sum(F.col("held").cast("double") * F.col("held") / 2).alias("pairs")).first()
    deals = max(rows.sparkSession.sparkContext.defaultParallelism, int((held["rows"] or 0) // MEET_ROWS), int((held["pairs"] or 0) // MEET_PAIRS))
    dealt = (
        rows.select("g", "sig", "n", "place", "joined").join(parts, "g").withColumn("part", F.pmod(F.xxhash64("sig"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("g", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), (F.col("part") > F.col("other")).alias("right"),
                "sig", "n", "place", "joined")
        .withColumn("deal", F.pmod(F.xxhash64("g", "lo", "hi"), F.lit(deals)))
    )

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        g, lo, hi, right = (frame[c].to_numpy() for c in ("g", "lo", "hi", "right"))
        turn = np.lexsort((right, hi, lo, g))
        g, lo, hi, right = g[turn], lo[turn], hi[turn], right[turn]
        sig, n, place, joined = (frame[c].to_numpy()[turn] for c in ("sig", "n", "place", "joined"))
        cuts = np.flatnonzero((g[1:] != g[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
        firsts, seconds = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for start, end in zip([0, *cuts], [*cuts, len(g)], strict=True):
            own = other = slice(start, end)
            alike = lo[start] == hi[start]
            if not alike:
                middle = start + int(np.count_nonzero(~right[own]))
                own, other = slice(start, middle), slice(middle, end)
            need = -(-percent * (n[own, None] + n[None, other]) // (100 + percent))
            may = (joined[own, None] != joined[None, other]) & (np.minimum(n[own, None], n[None, other]) >= need)
            may &= ((n[own] - place[own])[:, None] >= need) & ((n[other] - place[other])[None, :] >= need)
            if alike:
                may &= sig[own, None] < sig[None, other]
            i, j = np.nonzero(may)
            if len(i):
                firsts.append(sig[own][i])
                seconds.append(sig[other][j])
        x, y = np.concatenate(firsts), np.concatenate(seconds)
        both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
        a, b = both[:, 0].copy(), both[:, 1].copy()
        block = (mix(a.view(np.uint64) ^ mix(b.view(np.uint64))) % np.uint64(blocks)).astype(np.int64)
        turn = np.argsort(block, kind="stable")
        cuts = np.searchsorted(block[turn], np.arange(blocks + 1))
        lists = [(k, turn[cuts[k]: cuts[k + 1]]) for k in np.flatnonzero(np.diff(cuts))]
        return pd.DataFrame({"block": np.array([k for k, _ in lists], np.int32), "a": [a[x].tobytes() for _, x in lists], "b": [b[x].tobytes() for _, x in lists]})

    def once(frame: pd.DataFrame) -> pd.DataFrame:
        both = np.stack([np.concatenate([np.frombuffer(x, np.int64) for x in frame[c]]) for c in ("a", "b")], axis=1)
        both = np.unique(both, axis=0)
        return pd.DataFrame({"a": both[:, 0], "b": both[:, 1]})

    lists = dealt.groupBy("deal").applyInPandas(tidy_group(meet), "block int, a binary, b binary")
    return lists.groupBy("block").applyInPandas(tidy_group(once), "a long, b long")


def text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def labelled_rows(docs: DataFrame, width: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``key``, ``th``, ``n``, ``root``, ``least``) of every row: id, hash of the text, size of the set, component, its smallest id.

    Two documents are linked when 100 times their shared shingles reach ``percent`` times the shingles of both together.
    ``root`` is a number shared by a component's rows; ``least`` is null for rows without shingles.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col), F.col(text_col).cast("string"), text_hash(text_col).alias("th"))
    rows, _ = write_table(shingle_rows(texts, width), "shingle-rows")
    order = spark.sparkContext.broadcast(shingle_order(rows))
    documents = rows.where("slice is null").select("key", "th", "n", "sig")
    total = documents.agg(F.sum("n")).first()[0] or 0
    blocks = max(spark.sparkContext.defaultParallelism, -(-total * (100 - percent) // 100 // BLOCK_ENTRIES))
    entries = prefix_blocks(texts, order, width, percent, blocks)
    met = entries.groupBy("block").applyInPandas(tidy_group(multiply_block), "g long, sig long, n long, place long")
    met, _ = write_table(met, "met-rows")
    order.destroy()
    met = met.groupBy("g", "sig", "n").agg(F.min("place").alias("place"))

    reps = documents.where("n > 0").groupBy("sig").agg(F.min("key").alias("key"))

    def verified(pairs: DataFrame) -> DataFrame:
        """The links among ``pairs``, written."""
        wanted = reps.join(pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).distinct(), "sig")
        return write_table(verify(pairs, whole_sets(texts, wanted, width), percent), "links")[0]

    seen = joined = None

    def merged(found: DataFrame) -> DataFrame:
        """The components that ``found`` links make of those before, each a star of its rows, so that few rounds are left."""
        if joined is None:
            return components(found).withColumnsRenamed({"node": "sig", "root": "joined"})
        if found.isEmpty():
            return joined
        stars = joined.select(F.col("sig").alias("a"), F.col("joined").alias("b"))
        return components(found.union(stars)).withColumnsRenamed({"node": "sig", "root": "joined"})

    def tried(pairs: DataFrame) -> DataFrame:
        """The new links among ``pairs``, which with all before make the components."""
        nonlocal seen, joined
        pairs, _ = write_table(pairs if seen is None else pairs.join(seen, ["a", "b"], "left_anti"), "hub-pairs")
        found = verified(pairs)
        seen = pairs if seen is None else seen.union(pairs)
        joined = merged(found)
        tidy_driver(spark)
        return found

    for turn in range(HUB_TURNS):
        tried(hub_pairs(unsettled(met, joined), turn, percent))
    open_rows, _ = write_table(matchable(unsettled(met, joined), percent), "open-rows")
    for turn, hubs in enumerate(SAMPLED_HUBS, HUB_TURNS):
        if not many_pairs(open_rows) or tried(sampled_pairs(open_rows, turn, hubs, percent)).isEmpty():
            break
        open_rows, _ = write_table(matchable(unsettled(open_rows.drop("joined"), joined), percent), "open-rows")

    rest, _ = write_table(open_pairs(open_rows, percent, blocks).join(seen, ["a", "b"], "left_anti"), "open-pairs")
    roots = merged(verified(rest)).withColumnsRenamed({"joined": "root"})
    tidy_driver(spark)

    labelled = documents.join(roots, "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    least = labelled.where("n > 0").groupBy("root").agg(F.min("key").alias("least"))
    return labelled.join(least, "root", "left").select("key", "th", "n", "root", F.when(F.col("n") > 0, F.col("least")).alias("least"))


def ngram_components(docs: DataFrame, width: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, ``n_shingles``, ``component_id``): one row per row of ``docs``.

    Two documents are linked when 100 times their shared shingles reach ``percent`` times the shingles of both together.
    ``component_id`` is the smallest id reachable by links. Null and empty texts have no shingles and no links, and are
    their own component. Repeated rows are linked copies. A row without an id gets the smallest id of its component, null
    if there is none. Extra columns are not read. An empty table gives an empty one.
    """
    return labelled_rows(docs, width, percent, id_col, text_col).select(
        F.col("key").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("key")).alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that with the smallest id (no id: with the smallest hash of its text).

    Rows without shingles all stay. Of rows that repeat the id and the text of a component's first row, one stays.
    """
    rows, _ = write_table(labelled_rows(docs, width, percent, id_col, text_col), "labelled-rows")
    first = rows.where("n > 0").where(F.col("key").eqNullSafe(F.col("least"))).groupBy("root").agg(F.min(F.struct("key", "th")).alias("m"), F.count("*").alias("copies"))
    first = first.select("root", F.col("m.key").alias("f_key"), F.col("m.th").alias("f_th"), "copies")
    chosen = F.col("key").eqNullSafe(F.col("f_key")) & (F.col("th") == F.col("f_th"))
    judged = rows.where("n > 0").join(first, "root")
    gone = judged.where(~chosen).select("key", "th").distinct()
    twice = judged.where(chosen & (F.col("copies") > 1)).select("key", "th").distinct()
    th = free_name(docs, "__th")
    marked = docs.withColumn(th, text_hash(text_col))
    same = lambda other: marked[id_col].eqNullSafe(other["key"]) & (marked[th] == other["th"])
    kept = marked.join(gone, same(gone), "left_anti")
    some, _ = write_table(twice, "twice")
    if some.isEmpty():
        return kept.drop(th)
    once = kept.join(some, kept[id_col].eqNullSafe(some["key"]) & (kept[th] == some["th"]), "left_semi").dropDuplicates([id_col, th])
    return kept.join(some, kept[id_col].eqNullSafe(some["key"]) & (kept[th] == some["th"]), "left_anti").union(once).drop(th)
