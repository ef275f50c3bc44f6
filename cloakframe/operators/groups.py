"""Equivalence classes over quasi-identifiers, and what is measured on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloakframe import functions as X

from .keep import kept, running_sum


def known(df: DataFrame, qi: list[str]) -> DataFrame:
    return df.dropna(subset=qi)


def sizes(df: DataFrame, qi: list[str]) -> DataFrame:
    """qi columns and n; rows with an unknown quasi-identifier belong to no group."""
    return known(df, qi).groupBy(*qi).agg(F.count("*").alias("n"))


def numbered(groups: DataFrame, qi: list[str]) -> DataFrame:
    """gid: the group's place in key order, from 0."""
    return running_sum(groups, qi, F.lit(1).cast("long"), "gid").withColumn("gid", F.col("gid") - 1)


def build_groups(df: DataFrame, qi: list[str], k: int) -> DataFrame:
    """gid, qi, n, class flags, risk, and quasi: the attr=value texts of the group."""
    n = F.col("n")
    out = numbered(sizes(df, qi), qi)
    quasi = F.array(*[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in qi])
    return out.select(
        "gid",
        *qi,
        "n",
        X.is_safe(n, k).alias("safe"),
        X.is_unsafe(n, k).alias("unsafe"),
        X.is_small(n, k).alias("small"),
        X.group_risk(n, k).alias("risk"),
        quasi.alias("quasi"),
    )


def assigned(df: DataFrame, groups: DataFrame, qi: list[str]) -> DataFrame:
    """df's rows with their gid."""
    return df.join(
        groups.select("gid", *[F.col(c).alias(f"__{c}") for c in qi]),
        [F.col(c) == F.col(f"__{c}") for c in qi],
    ).drop(*[f"__{c}" for c in qi])


def free_counts(groups: DataFrame, k: int) -> DataFrame:
    return groups.where(F.col("n") > k).select("gid", (F.col("n") - k).alias("free"))


def free_tuples(rows: DataFrame, k: int, gid: str = "gid", rid: str = "rid", salts: int = 64) -> DataFrame:
    """The first n - k rows of each safe group: all but the k last. These are found among the k last of each of its
    `salts` shares, so no task orders a whole group."""
    last = rows.select(F.col(gid).alias("__g"), F.col(rid).alias("__r")).withColumn("__s", F.pmod(F.xxhash64("__r"), F.lit(salts)))
    for by in (("__g", "__s"), ("__g",)):
        last = last.withColumn("__i", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("__r")))).where(F.col("__i") <= k)
    return rows.join(last.select("__g", "__r"), (F.col(gid) == F.col("__g")) & (F.col(rid) == F.col("__r")), "left_anti")


def cavg(groups: DataFrame, k: int) -> DataFrame:
    """One row: groups, rows, unsafe groups, the mean size of groups that aren't empty over k."""
    full = F.when(F.col("n") > 0, F.col("n"))
    return groups.agg(
        F.count(full).alias("n_groups"),
        F.sum("n").alias("n_rows"),
        F.count_if(X.is_unsafe(F.col("n"), k)).alias("n_unsafe"),
        F.round(F.avg(full) / k, 6).alias("cavg"),
    )


def match_free(groups: DataFrame, k: int) -> DataFrame:
    """Supply of free rows against demand of unsafe groups, by overlapping intervals of their running sums.

    dst, src, m: how many rows the unsafe group dst takes from the safe group src. Unsafe
    groups come by size, then gid; a group whose demand can't be met in full takes none.
    """
    groups = kept(groups.select("gid", "n"))
    need = groups.where(X.is_unsafe(F.col("n"), k)).withColumn("need", k - F.col("n"))
    give = groups.where(F.col("n") > k).withColumn("free", F.col("n") - k)
    total = give.agg(F.coalesce(F.sum("free"), F.lit(0)).alias("x")).first()["x"]
    # Intervals on the line of all free rows; those of a side don't overlap, so a stretch of the line meets few of them.
    stretch = F.lit(4 * k)
    over = lambda a, b: F.explode(F.sequence(F.floor(a / stretch), F.floor((b - 1) / stretch)))
    d = running_sum(need, [F.desc("n"), "gid"], F.col("need"), "d_end").where(F.col("d_end") <= total)
    d = d.select(F.col("gid").alias("dst"), (F.col("d_end") - F.col("need")).alias("d_start"), "d_end").withColumn(
        "d_on",
        over(F.col("d_start"), F.col("d_end")),
    )
    s = running_sum(give, ["gid"], F.col("free"), "s_end").select(
        F.col("gid").alias("src"),
        (F.col("s_end") - F.col("free")).alias("s_start"),
        "s_end",
    )
    last = d.agg(F.coalesce(F.max("d_end"), F.lit(0)).alias("x")).first()["x"]
    s = s.where(F.col("s_start") < last).withColumn("s_on", over(F.col("s_start"), F.least("s_end", F.lit(last))))
    first = F.greatest("d_start", "s_start")
    both = d.join(s, (F.col("d_on") == F.col("s_on")) & (F.col("d_start") < F.col("s_end")) & (F.col("s_start") < F.col("d_end")))
    return both.where(F.floor(first / stretch) == F.col("d_on")).select("dst", "src", (F.least("d_end", "s_end") - first).alias("m"))


def frequencies(df: DataFrame, columns: list[str]) -> DataFrame:
    """attr, value, n, share of each column's values, in one pass over the rows."""
    each = df.select(F.explode(F.array(*[X.item(c, F.col(c)) for c in columns])).alias("x")).select("x.*").where("value is not null")
    counts = each.groupBy("attr", "value").agg(F.count("*").alias("n"))
    totals = counts.groupBy(F.col("attr").alias("__a")).agg(F.sum("n").alias("__t"))  # a row per column
    return counts.join(F.broadcast(totals), F.col("attr") == F.col("__a")).withColumn("share", F.col("n") / F.col("__t")).drop("__a", "__t")


def diversity(df: DataFrame, group: list[str], sensitive: str) -> DataFrame:
    return df.groupBy(*group).agg(F.count("*").alias("n"), F.count_distinct(sensitive).alias("diversity"))


def t_closeness(df: DataFrame, group: list[str], sensitive: str, whole_domain: bool = False) -> DataFrame:
    """group, n, t: the largest difference between a value's share in the group and overall.

    Over values present in the group; with whole_domain, over all.
    """
    df = df.where(F.col(sensitive).isNotNull())
    local = df.groupBy(*group, F.col(sensitive).alias("__v")).agg(F.count("*").alias("__c"))
    overall = df.groupBy(F.col(sensitive).alias("__w")).agg(F.count("*").alias("__g"))
    total = overall.agg(F.sum("__g").alias("__all_rows"))
    overall = overall.crossJoin(F.broadcast(total)).withColumn("__q", F.col("__g") / F.col("__all_rows")).drop("__all_rows")
    sized = local.withColumn("__n", F.sum("__c").over(Window.partitionBy(*group)))
    joined = sized.join(overall, F.col("__v") == F.col("__w")).withColumn("__d", F.abs(F.col("__c") / F.col("__n") - F.col("__q")))
    out = joined.groupBy(*group).agg(F.first("__n").alias("n"), F.max("__d").alias("t"), F.collect_set("__w").alias("__seen"))
    if whole_domain:
        missing = overall.agg(F.collect_list(F.struct("__w", "__q")).alias("__all"))
        gap = F.array_max(F.transform(F.filter("__all", lambda x: ~F.array_contains("__seen", x["__w"])), lambda x: x["__q"]))
        out = out.crossJoin(F.broadcast(missing)).withColumn("t", F.greatest("t", gap))
    return out.select(*group, "n", F.round("t", 6).alias("t"))


def best_partners(groups: DataFrame, k: int) -> DataFrame:
    """For each unsafe group its best migration with any other group, either way.

    Most risk reduction first, then fewest rows, then gids. What a migration is worth depends
    on the sizes alone, and is the same for all sizes from 2 k on: of all groups of a size only
    the two with the least gids can be best. So unsafe groups are paired with sizes, of which
    there are at most 2 k; two groups each go to all tasks.
    """
    sized = groups.select("gid", F.least(F.col("n"), F.lit(2 * k)).cast("long").alias("n"))
    least = sized.groupBy("n").agg(F.min("gid").alias("p_gid"))
    second = sized.join(
        F.broadcast(least.select(F.col("n").alias("l_n"), F.col("p_gid").alias("l_gid"))),
        (F.col("n") == F.col("l_n")) & (F.col("gid") != F.col("l_gid")),
    ).groupBy("n").agg(F.min("gid").alias("p_gid"))
    other = least.unionByName(second).select("p_gid", F.col("n").alias("p_n"))
    one = groups.where(X.is_unsafe(F.col("n"), k)).select("gid", "n")
    pairs = one.join(F.broadcast(other), F.col("gid") != F.col("p_gid"))
    out = pairs.select(
        "gid",
        F.explode(
            F.array(
                F.struct(F.col("gid").alias("i_gid"), F.col("n").alias("i_n"), F.col("p_gid").alias("j_gid"), F.col("p_n").alias("j_n")),
                F.struct(F.col("p_gid").alias("i_gid"), F.col("p_n").alias("i_n"), F.col("gid").alias("j_gid"), F.col("n").alias("j_n")),
            )
        ).alias("x"),
    ).select("gid", "x.*")
    m = X.migrant_count(F.col("i_n"), F.col("i_n"), F.col("j_n"), k)
    out = out.withColumn("m", m).where("m > 0")
    out = out.withColumn("reduction", X.risk_reduction(F.col("i_n"), F.col("j_n"), F.col("m"), k)).withColumn(
        "most_useful",
        X.most_useful(F.col("i_n"), F.col("j_n"), F.col("m"), k),
    )
    best = F.min_by(
        F.struct("i_gid", "j_gid", "m", "reduction", "most_useful"),
        F.struct(-F.col("reduction"), F.col("m"), F.col("i_gid"), F.col("j_gid")),
    )
    return out.groupBy("gid").agg(best.alias("b")).select("gid", "b.*")


def fewest_hits(asking: DataFrame, targets: DataFrame, hits: DataFrame) -> DataFrame:
    """gid, dst, hits: for each asking gid the target gid with the fewest hits, then the least gid.

    hits: gid, dst, c; pairs without a row have none. A gid's first target without a hit is the
    first gap in the numbers of its targets with one, so pairs without hits are never made.
    """
    numbered_ = kept(running_sum(targets.select(F.col("gid").alias("t_gid")), ["t_gid"], F.lit(1).cast("long"), "t_no"))
    n = numbered_.count()
    known = hits.join(numbered_, F.col("dst") == F.col("t_gid")).withColumn(
        "__k",
        F.row_number().over(Window.partitionBy("gid").orderBy("t_no")),
    )
    gap = F.coalesce(F.min(F.when(F.col("t_no") > F.col("__k"), F.col("__k"))), F.count("*") + 1)
    own = known.groupBy(F.col("gid").alias("h_gid")).agg(gap.alias("gap"), F.min(F.struct("c", "dst")).alias("least"))
    each = asking.select("gid").join(own, F.col("gid") == F.col("h_gid"), "left").withColumn("gap", F.coalesce("gap", F.lit(1)))
    free = each.where(F.col("gap") <= n).join(numbered_, F.col("gap") == F.col("t_no")).select(
        "gid",
        F.col("t_gid").alias("dst"),
        F.lit(0).cast("long").alias("hits"),
    )
    return free.unionByName(
        each.where((F.col("gap") > n) & F.col("least").isNotNull()).select(
            "gid",
            F.col("least.dst").alias("dst"),
            F.col("least.c").alias("hits"),
        )
    )
