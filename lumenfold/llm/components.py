"""Connected components of an edge table, by alternating large-star and small-star steps.

Edges point from the larger node to the smaller. A round first replaces each edge's end by the least neighbour of
that end (large star), then links each node's smaller neighbours to the least of them (small star). Both look up the
least smaller neighbour of a node, which has a row a node; aggregations combine before they shuffle. Where there are
over LARGE edges, these rows are written first: then a hub's edges are the skewed side of a plain equi-join, which
adaptive execution splits. Below, a hub has at most LARGE edges of two numbers, which a task can take.

Nothing is collected. The edges of each step are written to the shared folder, so the plan doesn't grow and lost
executors cost one step at most. Each round at least halves the depth of what isn't a star yet; it runs until
nothing changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lumenfold.llm.common import counted, drop_written, written

#: Edges from which the least neighbours are written.
LARGE = 2_000_000


def _step(now: DataFrame, n: int, end: str, replaced: F.Column) -> tuple[DataFrame, dict]:
    """The edges (u, v) in `replaced` of each edge of `now` (n of them) and `least`, the least smaller neighbour of its
    end; written. Also their number and a sum of their hashes."""
    least = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("least"))
    if n > LARGE:
        least = written(least, "least")
    made = now.join(least, now[end] == least["node"], "left").select(F.explode(replaced).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
    seen = Observation()
    made = made.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("total"))
    out = written(made, "edges", 2 * n)
    drop_written(now)
    if n > LARGE:
        drop_written(least)
    return out, seen.get


def components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(node, component) of every node of edges (u, v: long), component being its least node. Loops and repeats are
    allowed. most: how many edges there are at most, if that is known."""
    ordered, seen = counted(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    now = written(ordered, "edges", most)
    u, v, least = F.col("u"), F.col("v"), F.col("least")
    edge = lambda a, b: F.struct(a.alias("u"), b.alias("v"))
    mark, found = None, seen.get
    while found != mark:
        mark = found
        now, found = _step(now, found["n"], "v", F.array(edge(u, F.coalesce(least, v))))
        # each node itself, and its smaller neighbours, at the least of these
        now, found = _step(now, found["n"], "u", F.array(edge(u, least), edge(v, least)))
    # at rest every edge links a node to the least of its component
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
