"""Linking rows that share buckets, and connected components by alternating large-star and small-star.

Nothing here emits all pairs of a bucket or gathers a bucket, a component or the links in one place. Each member is first
compared with three pivots at most, the smallest and largest members of its buckets: that settles groups of copies, however
large. Buckets that still hold more than one component form families, in which all members are compared in blocks of a
bounded number, save the largest component with itself; only links come out. So in the end every pair of a bucket that is
not already connected has been compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatstream.llm.common import stored

BLOCK = 512


def _stars(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the smallest node m among u and its neighbours. The minima are stored: Spark can then split the join of a node with very many links."""
    least = stored(edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
    return edges.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for each node of the undirected edges (a, b).

    Loops and repeated edges are harmless. Nodes without an edge to another node are left out.
    """
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = stored(_stars(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "large")
        small = _stars(large).select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        now = stored(small.filter("u <> v").distinct(), "small")
        # done when the edges are stars: each node with an edge to a smaller one has only that, and its end has none
        ends = now.groupBy("u").agg(F.count("*").alias("n")).join(now.select(F.col("v").alias("u")).distinct().withColumn("end", F.lit(True)), "u", "left")
        if ends.filter("n > 1 or end").isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v")).distinct())


Similar = Callable[[memoryview, memoryview], bool]


def linked_components(
    buckets: DataFrame, signatures: DataFrame, kind: type, least: int,
    contents: Callable[[DataFrame], DataFrame] | None = None, similar: Similar | None = None,
) -> DataFrame:
    """Components (see there) of all nodes that are linked within a bucket.

    ``buckets`` has (bucket, node), ``signatures`` (node, signature): arrays of ``kind`` as bytes, of which ``least``
    values have to be equal in a link. ``contents`` gives (node, content) for a table of nodes, and ``similar`` says of
    two contents whether they are linked; without them the signatures decide.
    """
    ends = stored(buckets.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high"), "ends")
    members = stored(buckets.join(ends, "bucket"), "members")
    held = None
    if contents is not None:
        held = stored(contents(members.select("node").distinct()), "contents")

    def links(pairs: DataFrame) -> DataFrame:
        near = _agreeing(pairs, signatures, kind, least)
        return stored(near if held is None else _similar(stored(near, "likely"), held, similar), "links")

    def with_links(found: DataFrame, more: DataFrame) -> DataFrame:
        return found if more.isEmpty() else components(more.union(found.select("node", "component")))

    found = components(links(_ordered(members.groupBy("node").agg(F.min("low").alias("pivot")))))
    others = F.array(F.max("low"), F.min("high"))
    found = with_links(found, links(_apart(_ordered(members.groupBy("node").agg(others.alias("p")).select("node", F.explode("p").alias("pivot"))), found)))
    rows = _open(members, found)
    if rows.isEmpty():
        return found
    # members that share open buckets, directly or not, meet once and not in each bucket
    lowest = stored(rows.groupBy("bucket").agg(F.min("node").alias("b")), "lowest")
    family = components(rows.join(lowest, "bucket").select(F.col("node").alias("a"), "b")).withColumnRenamed("component", "family")
    rows = stored(rows.select("node", "component").distinct().join(family, "node"), "family")
    parts = rows.groupBy("family", "component").agg(F.count("*").alias("n"))
    main = F.max(F.struct("n", "component"))
    sizes = stored(parts.groupBy("family").agg(main["component"].alias("main"), main["n"].alias("n_main"), (F.sum("n") - main["n"]).alias("n_rest")), "sizes")
    return with_links(found, stored(_blocks(rows.join(sizes, "family"), signatures, kind, least, held, similar).distinct(), "links"))


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs (a, b) that are not in one component."""
    first, second = (found.select(F.col("node").alias(k), F.col("component").alias(f"of_{k}")) for k in "ab")
    both = pairs.join(first, "a", "left").join(second, "b", "left")
    return both.filter(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")


def _similar(pairs: DataFrame, held: DataFrame, similar: Similar) -> DataFrame:
    first, second = (held.select(F.col("node").alias(k), F.col("content").alias(v)) for k, v in (("a", "x"), ("b", "y")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = [similar(x.as_buffer(), y.as_buffer()) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(mask, pa.bool_()))

    return pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct()


def _open(members: DataFrame, found: DataFrame) -> DataFrame:
    """bucket, node and component in the buckets that hold more than one component."""
    known = members.join(found, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    several = stored(known.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("bucket"), "open")
    return stored(known.join(several, "bucket"), "rows")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.filter("node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()


def _agreeing(pairs: DataFrame, signatures: DataFrame, kind: type, least: int) -> DataFrame:
    first, second = (signatures.select(F.col("node").alias(k), F.col("signature").alias(v)) for k, v in (("a", "x"), ("b", "y")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = [np.count_nonzero(np.frombuffer(x.as_buffer(), kind) == np.frombuffer(y.as_buffer(), kind)) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array([n >= least for n in same], pa.bool_()))

    return pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _blocks(rows: DataFrame, signatures: DataFrame, kind: type, least: int, held: DataFrame | None, similar: Similar | None) -> DataFrame:
    """Links between different components: each family's blocks of members two by two, those of its main component with the rest only."""
    rest, all_ = F.ceil(F.col("n_rest") / BLOCK), F.ceil(F.col("n_rest") / BLOCK) + F.ceil(F.col("n_main") / BLOCK)
    is_main, place = F.col("component") == F.col("main"), F.xxhash64("node")
    own = F.when(is_main, rest + F.pmod(place, all_ - rest)).otherwise(F.pmod(place, rest))
    known = rows.join(signatures, "node")
    known = known.withColumn("content", F.lit(None).cast("binary")) if held is None else known.join(held, "node")
    dealt = known.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(is_main, rest).otherwise(all_) - 1)))
    dealt = dealt.select("family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "component", "signature", "content")
    dealt = dealt.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j")

    def compared(held: list[tuple]) -> list[list[int]]:
        i, j = held[0][1], held[0][2]
        table = np.array([np.frombuffer(r[6], kind) for r in held])
        own, node, component = (np.array([r[k] for r in held], np.int64) for k in (3, 4, 5))
        right = np.flatnonzero(own == j)
        out = []
        for k in np.flatnonzero(own == i).tolist():
            with_ = right[(component[right] != component[k]) & ((node[right] > node[k]) | (i != j))]
            near = with_[(table[with_] == table[k]).sum(1) >= least].tolist()
            out.extend(sorted((int(node[k]), int(node[n]))) for n in near if similar is None or similar(held[k][7], held[n][7]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][:3] != row[:3]:
                    yield _pairs(compared(held))
                    held = []
                held.append(row)
        if held:
            yield _pairs(compared(held))

    return dealt.mapInArrow(run, "a long, b long")


def _pairs(pairs: list[list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])
