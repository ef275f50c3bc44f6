"""Full-domain generalisation: the best node of a lattice of levels.

Rows are counted once at the base values; all nodes are grouped from these counts. A node
is allowed if at most max_suppressed of the rows are in classes below k. Of the allowed
nodes the one with the least precision loss (mean of level / highest level) wins, then the
least node id.
"""

from __future__ import annotations

from functools import reduce
from itertools import product
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def node_counts(df: DataFrame, levels: dict[str, list[Column]], k: int) -> DataFrame:
    """node, loss, n_classes, n_suppressed, n_rows for each combination of levels; levels[c][0] is the value itself."""
    cols = list(levels)
    fine = df.groupBy(
        *[g.cast("string").alias(f"{c}_{i}") for c, f in levels.items() for i, g in enumerate(f)]
    ).agg(F.count("*").alias("__n"))
    nodes = list(product(*[range(len(levels[c])) for c in cols]))
    rows = F.array(
        *[
            F.struct(
                F.lit("-".join(map(str, node))).alias("node"),
                F.lit(round(sum(l / max(1, len(levels[c]) - 1) for l, c in zip(node, cols, strict=True)) / len(cols), 9)).alias("loss"),
                F.array(*[F.col(f"{c}_{l}") for l, c in zip(node, cols, strict=True)]).alias("key"),
            )
            for node in nodes
        ]
    )
    each = fine.select(F.explode(rows).alias("x"), "__n").groupBy("x.node", "x.loss", "x.key").agg(F.sum("__n").alias("n"))
    return each.groupBy("node", "loss").agg(
        F.count("*").alias("n_classes"),
        F.coalesce(F.sum(F.when(F.col("n") < k, F.col("n"))), F.lit(0)).cast("long").alias("n_suppressed"),
        F.sum("n").alias("n_rows"),
    )


def best_node(counts: DataFrame, max_suppressed: float = 0.05) -> DataFrame:
    return counts.where(F.col("n_suppressed") <= F.lit(max_suppressed) * F.col("n_rows")).orderBy("loss", "n_suppressed", "node").limit(1)


def generalize(df: DataFrame, levels: dict[str, list[Column]], node: str, k: int) -> DataFrame:
    """df at a node; rows of classes below k get * in all these columns."""
    at = dict(zip(levels, map(int, node.split("-")), strict=True))
    out = df.withColumns({f"__g_{c}": levels[c][i].cast("string") for c, i in at.items()})
    sizes = out.groupBy(*[F.col(f"__g_{c}").alias(f"__k_{c}") for c in at]).agg(F.count("*").alias("__n"))
    same = reduce(and_, [F.col(f"__g_{c}").eqNullSafe(F.col(f"__k_{c}")) for c in at])
    out = out.join(sizes, same).withColumns({c: F.when(F.col("__n") >= k, F.col(f"__g_{c}")).otherwise("*") for c in at})
    return out.drop("__n", *[f"__{x}_{c}" for c in at for x in "gk"])
