"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace


#: Edges that one task may work off by itself: 16 MB of ids.  More are worked off in rounds over all tasks.
LOCAL_EDGES = 1_000_000
#: Tasks that one hub's rows are dealt to.
SALTS = 8


def salt(column: str):
    """The number that deals rows of one key to SALTS tasks."""
    return F.pmod(F.xxhash64(F.lit(29), F.col(column)), F.lit(SALTS)).cast("int")


def every_salt():
    """A row for each salt: the other side of such a join."""
    return F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """One star round on pairs (u, v) with u > v."""
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else pairs
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # a hub of very many neighbours is dealt to several tasks
    told = both.withColumn("salt", salt("v")).join(low.withColumn("salt", every_salt()), ["u", "salt"]).drop("salt")
    if large:
        return told.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
    return told.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u > v").distinct()


def _forest(batches):
    """(node, root) of all edges of one task: every node takes the least root of its neighbours until nothing changes."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    table = pa.Table.from_batches(parts)
    nodes, place = np.unique(np.concatenate([table["u"].to_numpy(), table["v"].to_numpy()]), return_inverse=True)
    a, b = place[: table.num_rows], place[table.num_rows :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], least)  # the roots themselves are hooked, so trees merge whole
        np.minimum.at(new, root[b], least)
        while (new[new] != new).any():
            new = new[new]
        new = new[root]
        if (new == root).all():
            break
        root = new
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "root"])


def components(edges: DataFrame, work: Workspace, name: str, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `edges` (columns a, b), root being the least node of its component.

    Each round is two group-bys and joins; its result is written to the shared
    folder, so lineage stays short.  Paths shorten geometrically, so the number
    of rounds grows with the logarithm of the longest path.  Up to LOCAL_EDGES edges,
    which are counted first, are worked off in one task without rounds.  The tables
    lie in the folder `name` of the workspace, which the caller drops once it has
    written the result.
    """
    now = work.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}/0")
    if now.count() <= LOCAL_EDGES:
        return now.repartition(1).mapInArrow(_forest, "node long, root long")
    seen = None
    for i in range(1, rounds + 1):
        now = work.keep(_star(_star(now, True), False), f"{name}/{i}")
        work.drop(f"{name}/{i - 1}")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    else:
        raise RuntimeError(f"components of {name} did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
