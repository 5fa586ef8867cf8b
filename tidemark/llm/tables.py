"""Tables in the shared folder, and connected components of link tables."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_checkpoint_dir


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: no executor holds the only copy."""
    spark = df.sparkSession
    path = f"{shared_checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_names(frame: DataFrame, *wanted: str) -> list[str]:
    """Names like ``wanted`` that no column of ``frame`` has, in any case."""
    taken, out = {c.lower() for c in frame.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Rows up to which a frame that grows with sources or groups, not with documents, is broadcast.
FEW = 10_000


def few(frame: DataFrame, rows: int) -> DataFrame:
    """``frame`` of so many counted rows, broadcast where these are few; else its joins are left to adaptive execution, which splits hot keys."""
    return F.broadcast(frame) if rows <= FEW else frame


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes that the links (a, b) touch, and the smallest node reachable from each over these links."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a):]
    root = np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        open_ = low != high
        if not open_.any():
            break
        x, y = x[open_], y[open_]
        np.minimum.at(root, high[open_], low[open_])
        while (root[root] != root).any():
            root = root[root]
    return nodes, nodes[root]


def _contract(batches):
    """Links of a task become links to their local root; emptied whenever a bounded buffer is full."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def star():
        nodes, roots = local_roots(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
        keep = nodes != roots
        return nodes[keep], roots[keep]

    def out(nodes, roots):
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], ["src", "dst"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
        size += batch.num_rows
        if size >= 2_000_000:
            held = [star()]
            size = len(held[0][0])
            if size >= 1_000_000:
                yield out(*held[0])
                held, size = [], 0
    if held:
        yield out(*star())


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links`` (src, dst long, not null): (node, root) for every linked node.

    ``root`` is the smallest node of the component. Links are first contracted inside each task; then
    large-star and small-star steps alternate until the stars no longer change. Both steps only take a
    minimum per node (combined before the shuffle) and join it back, so no node's links are gathered in
    one task. Loops and repeated links are ignored; an empty table gives an empty result.
    """
    stars = cut(links.select("src", "dst").filter("src <> dst").mapInArrow(_contract, "src long, dst long").distinct())
    print_ = None
    while True:
        mark = stars.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if mark == print_ or mark[0] == 0:
            return stars.select(F.col("src").alias("node"), F.col("dst").alias("root")).union(
                stars.select(F.col("dst").alias("node"), F.col("dst").alias("root")).distinct())
        print_ = mark
        both = stars.select(F.col("src").alias("u"), F.col("dst").alias("v")).union(stars.select("dst", "src"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("src"), F.col("m").alias("dst")).distinct()
        # every link of ``large`` points down: the small step takes the smallest end of each upper node
        low = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = large.join(low, "src").select(
            F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("m").alias("b")), F.struct(F.col("dst").alias("a"), F.col("m").alias("b")))).alias("p"))
        stars = cut(small.select(F.col("p.a").alias("src"), F.col("p.b").alias("dst")).filter("src <> dst").distinct())
