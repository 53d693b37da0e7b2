"""Two-dimensional phase unwrapping in blocks that are joined over a table of seams.

Pixels are rated by how much their wrapped gradients change (the less the more
reliable).  A block's reliable pixels are joined in a task, the most reliable
neighbours first, to patches that are each unwrapped; pixels that no reliable
edge reaches are patches of their own.  Neighbouring pixels of two patches vote
for the whole number of turns between them; the votes are added up in a table,
and the patches are joined by a maximum spanning forest of it: each round every
component takes its weightiest seam, and the turns add up along the way to the
root.  No path over a block's border or around a residue depends on how the
pixels were cut into blocks, as long as reliable seams agree.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import cut

TURN = 2 * math.pi
#: Sides of a block, and the greatest change of gradients (radians) of a pixel that its block relies on.
BLOCK, RELIABLE = 128, 1.0


def wrapped(x: Column) -> Column:
    """An angle between -pi and pi."""
    return x - TURN * F.round(x / TURN)


def gradients(df: DataFrame, keys: Sequence[str], row: str, col: str, phase: str) -> DataFrame:
    """df with across and down: the wrapped differences to the next pixel of the row and of the column, null without one."""
    along, below = Window.partitionBy(*keys, row).orderBy(col), Window.partitionBy(*keys, col).orderBy(row)
    step = lambda w, at: F.when(F.lead(at).over(w) == F.col(at) + 1, wrapped(F.lead(phase).over(w) - F.col(phase)))
    return df.withColumns({"across": step(along, col), "down": step(below, row)})


def residues(df: DataFrame, keys: Sequence[str], row: str, col: str, phase: str) -> DataFrame:
    """(keys, row, col, residue): the whole turns around the four pixels from (row, col) on, where all four are there."""
    g = gradients(df, keys, row, col, phase)
    along, below = Window.partitionBy(*keys, row).orderBy(col), Window.partitionBy(*keys, col).orderBy(row)
    next_down = F.when(F.lead(col).over(along) == F.col(col) + 1, F.lead("down").over(along))
    next_across = F.when(F.lead(row).over(below) == F.col(row) + 1, F.lead("across").over(below))
    turns = F.round((F.col("across") + next_down - next_across - F.col("down")) / TURN).cast("int")
    return g.select(*keys, row, col, turns.alias("residue")).where("residue IS NOT NULL")


def reliability(df: DataFrame, keys: Sequence[str], row: str, col: str, phase: str) -> DataFrame:
    """df with change: the root of the squared changes of the wrapped gradients at a pixel, both ways; pixels at an edge
    count with what they have, and pi where they have nothing."""
    g = gradients(df, keys, row, col, phase)
    along, below = Window.partitionBy(*keys, row).orderBy(col), Window.partitionBy(*keys, col).orderBy(row)
    change = lambda w, at, d: F.when(F.lag(at).over(w) == F.col(at) - 1, F.col(d) - F.lag(d).over(w))
    h, v = change(along, col, "across"), change(below, row, "down")
    total = F.sqrt(F.coalesce(h * h, F.lit(0.0)) + F.coalesce(v * v, F.lit(0.0)))
    return g.withColumn("change", F.when(h.isNull() & v.isNull(), math.pi).otherwise(total)).drop("across", "down")


class _Turns:
    """Union of pixels with the whole turns of each against its root."""

    def __init__(self, n: int):
        self.parent, self.turns, self.size = list(range(n)), [0] * n, [1] * n

    def root(self, i: int) -> tuple[int, int]:
        path, turns = [], 0
        while self.parent[i] != i:
            path.append(i)
            i = self.parent[i]
        for j in reversed(path):
            turns += self.turns[j]
            self.parent[j], self.turns[j] = i, turns
        return i, (self.turns[path[0]] if path else 0)

    def join(self, a: int, b: int, k: int) -> None:
        """b with k more turns continues a."""
        (ra, ta), (rb, tb) = self.root(a), self.root(b)
        if ra == rb:
            return
        k += ta - tb  # turns that rb's pixels get to go with ra's
        if self.size[ra] < self.size[rb]:
            ra, rb, k = rb, ra, -k
        self.parent[rb], self.turns[rb] = ra, k
        self.size[ra] += self.size[rb]


def unwrapped_block(rows: np.ndarray, cols: np.ndarray, phase: np.ndarray, change: np.ndarray, reliable: float) -> tuple[np.ndarray, np.ndarray]:
    """(patch, whole turns) of the pixels of a block; a patch is named by its first pixel."""
    r, c = rows - rows.min(), cols - cols.min()
    at = np.full((r.max() + 1, c.max() + 1), -1)
    at[r, c] = np.arange(len(rows))
    a = np.concatenate([at[:, :-1].ravel(), at[:-1].ravel()])
    b = np.concatenate([at[:, 1:].ravel(), at[1:].ravel()])
    good = (a >= 0) & (b >= 0)
    a, b = a[good], b[good]
    cost = change[a] + change[b]
    good = (change[a] <= reliable) & (change[b] <= reliable)
    a, b, cost = a[good], b[good], cost[good]
    k = np.round((phase[a] - phase[b]) / TURN).astype(np.int64)
    order = np.lexsort((b, a, cost))
    joined = _Turns(len(rows))
    for x, y, n in zip(a[order].tolist(), b[order].tolist(), k[order].tolist(), strict=True):
        joined.join(x, y, n)
    found = [joined.root(i) for i in range(len(rows))]
    root, turns = np.array([f[0] for f in found]), np.array([f[1] for f in found])
    _, first, patch = np.unique(root, return_index=True, return_inverse=True)
    return first[patch], turns


def _patches(df: DataFrame, keys: Sequence[str], row: str, col: str, phase: str, block: int, reliable: float) -> DataFrame:
    """(keys, row, col, phase, change, patch, turns); a patch is named by its block and its first pixel."""
    br, bc = F.floor(F.col(row) / block).alias("__br"), F.floor(F.col(col) / block).alias("__bc")
    rated = reliability(df.select(*keys, row, col, phase).where(F.col(phase).isNotNull() & ~F.isnan(phase)), keys, row, col, phase).select("*", br, bc)
    schema = T.StructType([*(f for f in rated.schema if not f.name.startswith("__b")), T.StructField("patch", T.StringType()), T.StructField("turns", T.LongType())])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(row, "ascending"), (col, "ascending")])
        own = [table[c].to_numpy() for c in (row, col, phase, "change")]
        first, turns = unwrapped_block(*own, reliable)
        name = "/".join(str(table[k][0].as_py()) for k in [*keys, "__br", "__bc"])
        patch = pa.array([f"{name}/{i}" for i in first.tolist()])
        return table.drop_columns(["__br", "__bc"]).append_column("patch", patch).append_column("turns", pa.array(turns, pa.int64()))

    return rated.groupBy(*keys, "__br", "__bc").applyInArrow(run, schema)


def _votes(pixels: DataFrame, keys: Sequence[str], row: str, col: str, phase: str) -> DataFrame:
    """(a, b, k, weight): b with k more turns continues a, by the neighbouring pixels of the two; a < b."""
    own = F.col(phase) + TURN * F.col("turns")
    parts = []
    for w, at in ((Window.partitionBy(*keys, row).orderBy(col), col), (Window.partitionBy(*keys, col).orderBy(row), row)):
        ahead = lambda c: F.lead(c).over(w)  # noqa: B023, E731
        parts.append(
            pixels.withColumn("__own", own)
            .select("patch", ahead("patch").alias("other"), (ahead(at) == F.col(at) + 1).alias("beside"), F.round((F.col("__own") - ahead("__own")) / TURN).cast("long").alias("k"), (1 / (0.01 + F.col("change") + ahead("change"))).alias("weight"))
            .where("beside AND patch != other")
        )
    both = parts[0].union(parts[1])
    turned = F.col("patch") > F.col("other")
    both = both.select(F.least("patch", "other").alias("a"), F.greatest("patch", "other").alias("b"), F.when(turned, -F.col("k")).otherwise(F.col("k")).alias("k"), "weight")
    return both.groupBy("a", "b", "k").agg(F.sum("weight").alias("weight"))


def joined_patches(votes: DataFrame, patches: DataFrame) -> DataFrame:
    """(patch, component, turns) of patches (patch) joined by votes (a, b, k, weight): a maximum spanning forest in rounds.
    Of the turns that two components could have between them, those with most weight count."""
    nodes = cut(patches.select("patch", F.col("patch").alias("component"), F.lit(0).cast("long").alias("turns")))
    while True:
        side = lambda n: nodes.select(F.col("patch").alias(n), F.col("component").alias(f"c{n}"), F.col("turns").alias(f"t{n}"))  # noqa: B023, E731
        seams = votes.join(side("a"), "a").join(side("b"), "b").where("ca != cb")
        # turns that the component of b gets to go with that of a, the smaller name first
        turned, k = F.col("ca") > F.col("cb"), F.col("ta") + F.col("k") - F.col("tb")
        seams = seams.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"), F.when(turned, -k).otherwise(k).alias("k"), "weight")
        seams = seams.groupBy("a", "b", "k").agg(F.sum("weight").alias("weight")).groupBy("a", "b").agg(F.max(F.struct("weight", "k")).alias("best"))
        seams = cut(seams.select("a", "b", "best.*"))
        if not seams.limit(1).count():
            return nodes
        both = seams.select(F.col("a").alias("component"), F.col("b").alias("parent"), (-F.col("k")).alias("k"), "weight", "a", "b")
        both = both.union(seams.select(F.col("b").alias("component"), F.col("a").alias("parent"), "k", "weight", "a", "b"))
        picks = both.groupBy("component").agg(F.max(F.struct("weight", "a", "b", "parent", "k")).alias("best")).select("component", "best.parent", "best.k")
        # of two that picked each other the smaller one is a root
        back = picks.select(F.col("component").alias("parent"), F.col("parent").alias("beyond"))
        root = (F.col("beyond") == F.col("component")) & (F.col("component") < F.col("parent"))
        picks = picks.join(back, "parent", "left")
        up = cut(picks.select("component", F.when(root, F.col("component")).otherwise(F.col("parent")).alias("parent"), F.when(root, 0).otherwise(F.col("k")).alias("k")))
        while True:  # every pointer takes the pointer of where it points to
            ahead = up.select(F.col("component").alias("parent"), F.col("parent").alias("beyond"), F.col("k").alias("more"))
            further = cut(up.join(ahead, "parent").select("component", F.col("beyond").alias("parent"), (F.col("k") + F.col("more")).alias("k"), (F.col("beyond") != F.col("parent")).alias("moved")))
            up = further.drop("moved")
            if not further.where("moved").limit(1).count():
                break
        moved = nodes.join(up, "component", "left")
        nodes = cut(moved.select("patch", F.coalesce("parent", "component").alias("component"), (F.col("turns") + F.coalesce("k", F.lit(0))).alias("turns")))


def unwrapped(df: DataFrame, keys: Sequence[str], row: str = "row", col: str = "col", phase: str = "phase", block: int = BLOCK, reliable: float = RELIABLE) -> DataFrame:
    """(keys, row, col, phase, unwrapped, component) of wrapped images.  Pixels without a phase are left out; parts that no
    neighbouring pixels join are components, each up to its own whole turns; the first pixel of a component keeps its phase."""
    pixels = cut(_patches(df, keys, row, col, phase, block, reliable))
    found = joined_patches(cut(_votes(pixels, keys, row, col, phase)), pixels.select("patch").distinct())
    placed = pixels.join(found.select("patch", "component", F.col("turns").alias("more")), "patch").withColumn("all", F.col("turns") + F.col("more"))
    first = placed.groupBy("component").agg(F.min_by("all", F.struct(row, col)).alias("zero"))
    placed = placed.join(first, "component")
    return placed.select(*keys, row, col, phase, (F.col(phase) + TURN * (F.col("all") - F.col("zero"))).alias("unwrapped"), "component")
