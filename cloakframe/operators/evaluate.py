"""What a release keeps and loses, and sweeps over k, quasi-identifiers and sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import groups as G
from . import rules as R


def evaluate(
    before: DataFrame,
    after: DataFrame,
    columns: list[str],
    k: int,
    min_support: float,
    min_confidence: float,
    rid: str = "rid",
) -> DataFrame:
    """One row: classes, rows, unsafe classes and mean class size over k of the release; and rules mined from both tables, compared."""
    def mined(df: DataFrame) -> DataFrame:
        return R.rules_of(R.frequent_itemsets(R.transactions(df, columns, rid), min_support), df.count(), min_confidence)

    return G.cavg(G.sizes(after, columns), k).crossJoin(R.compare(mined(before), mined(after)))


def _measures(k: Column) -> list[Column]:
    return [F.count("*").alias("n_groups"), F.sum("n").alias("n_rows"), F.count_if(F.col("n") < k).alias("n_unsafe")]


def _with_cavg(df: DataFrame, k: Column) -> DataFrame:
    return df.withColumn("cavg", F.round(F.col("n_rows") / F.col("n_groups") / k, 6))


def sweep_k(sizes: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """k, n_groups, n_rows, n_unsafe, cavg for each k, from classes with their sizes n."""
    each = sizes.select("n", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    return _with_cavg(each.groupBy("k").agg(*_measures(F.col("k"))), F.col("k"))


def sweep_qi(sizes: DataFrame, qi: list[str], k: int) -> DataFrame:
    """n_qi, n_groups, n_rows, n_unsafe, cavg for the first one, two, ... quasi-identifiers, from classes by all of them."""
    parts = F.array(
        *[F.struct(F.lit(i).alias("n_qi"), F.array(*[F.col(c).cast("string") for c in qi[:i]]).alias("key")) for i in range(1, len(qi) + 1)]
    )
    each = sizes.select("n", F.explode(parts).alias("x")).groupBy("x.n_qi", "x.key").agg(F.sum("n").alias("n"))
    return _with_cavg(each.groupBy("n_qi").agg(*_measures(F.lit(k))), F.lit(k))


def sweep_size(df: DataFrame, qi: list[str], k: int, shares: tuple[float, ...], rid: str = "rid", seed: int = 0) -> DataFrame:
    """share, n_groups, n_rows, n_unsafe, cavg for samples of these shares, each inside the next, in one pass over the rows."""
    from cloakframe import functions as X

    counts = df.dropna(subset=qi).withColumn("__u", X.hash_share(rid, seed=seed)).groupBy(*qi).agg(
        *[F.count_if(F.col("__u") < p).alias(f"__n{i}") for i, p in enumerate(shares)]
    )
    each = counts.select(
        F.explode(F.array(*[F.struct(F.lit(p).alias("share"), F.col(f"__n{i}").alias("n")) for i, p in enumerate(shares)])).alias("x")
    ).select("x.*").where("n > 0")
    return _with_cavg(each.groupBy("share").agg(*_measures(F.lit(k))), F.lit(k))
