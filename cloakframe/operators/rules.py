"""Frequent itemsets, association rules with consequents of any size, and their comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe import functions as X

from .keep import kept

MIN_SUPPORT = MIN_CONFIDENCE = 0.5


def transactions(df: DataFrame, columns: list[str], rid: str = "rid") -> DataFrame:
    return df.select(rid, F.transform(X.items_of(columns), X.item_key).alias("items"))


def item_counts(baskets: DataFrame, items: str = "items") -> DataFrame:
    return baskets.select(F.explode(F.array_distinct(items)).alias("item")).groupBy("item").agg(F.count("*").alias("n"))


def frequent_itemsets(
    baskets: DataFrame,
    min_support: float,
    items: str = "items",
    sample_factor: float = 1.0,
    strict: bool = False,
) -> DataFrame:
    """items (sorted), freq: all itemsets with at least min_support * sample_factor of the rows, by parallel FP-growth. strict: more than that."""
    from pyspark.ml.fpm import FPGrowth

    rows = baskets.select(F.array_distinct(items).alias("__items"))
    model = FPGrowth(itemsCol="__items", minSupport=min_support * sample_factor, minConfidence=1.0).fit(rows)
    out = model.freqItemsets.select(F.sort_array("items").alias("items"), "freq")
    return out.where(F.col("freq") > F.lit(min_support * sample_factor) * rows.count()) if strict else out


def sampled(baskets: DataFrame, fraction: float, rid: str = "rid", seed: int = 0) -> DataFrame:
    """A share of the baskets, by the md5 of the row's id: the same rows on any cluster."""
    return baskets.where(X.hash_share(rid, seed=seed) < fraction)


def candidates(frequent: DataFrame) -> DataFrame:
    """items: sets with one item more, of which all subsets of one item less are frequent. frequent: items (sorted), all of one size."""
    size = F.size("items")
    a = frequent.select(F.col("items").alias("p"), F.slice("items", F.lit(1), size - 1).alias("head"), F.element_at("items", -1).alias("x"))
    b = frequent.select(F.slice("items", F.lit(1), size - 1).alias("head2"), F.element_at("items", -1).alias("y"))
    made = a.join(b, (F.col("head") == F.col("head2")) & (F.col("x") < F.col("y"))).select(F.concat("p", F.array("y")).alias("items"))
    without = F.transform(
        F.sequence(F.lit(1), F.size("items")),
        lambda i: F.concat(F.slice("items", F.lit(1), i - 1), F.slice("items", i + 1, F.size("items"))),
    )
    known = made.select("items", F.explode(without).alias("sub")).join(
        frequent.select(F.col("items").alias("known")),
        F.col("sub") == F.col("known"),
    )
    return known.groupBy("items").agg(F.count("*").alias("n")).where(F.col("n") == F.size("items")).select("items")


def levelwise(baskets: DataFrame, min_count: float, items: str = "items", rid: str = "rid") -> DataFrame:
    """items (sorted), freq: all itemsets with at least min_count rows, a level at a time until one is empty.

    A level's matches are rows (rid, items). The next level's extend them by the later items of
    their own basket, a join on rid, and only where the set is a candidate; so no item, however
    frequent, is a key that rows meet on before they are counted.
    """
    single = baskets.select(F.col(rid).alias("__r"), F.explode(F.array_distinct(items)).alias("__i"))
    frequent = kept(
        single.groupBy("__i").agg(F.count("*").alias("freq")).where(F.col("freq") >= min_count).select(
            F.array("__i").alias("items"),
            "freq",
        )
    )
    single = kept(single.join(frequent.select(F.col("items")[0].alias("__f")), F.col("__i") == F.col("__f"), "left_semi"))
    out, matches = frequent, single.select(F.col("__r").alias("rid"), F.array("__i").alias("items"))
    while not frequent.isEmpty():
        more = candidates(frequent).select(F.col("items").alias("__c"))
        longer = matches.join(single, (F.col("rid") == F.col("__r")) & (F.col("__i") > F.element_at("items", -1))).select(
            "rid",
            F.concat("items", F.array("__i")).alias("items"),
        )
        matches = kept(longer.join(more, F.col("items") == F.col("__c"), "left_semi"))
        frequent = kept(matches.groupBy("items").agg(F.count("*").alias("freq")).where(F.col("freq") >= min_count))
        matches = matches.join(frequent.select(F.col("items").alias("__k")), F.col("items") == F.col("__k"), "left_semi")
        out = out.unionByName(frequent)
    return out


def rules_of(itemsets: DataFrame, n_rows: int, min_confidence: float, quasi: list[str] | None = None) -> DataFrame:
    """All rules A => B of each itemset: every proper subset as A, the rest as B.

    a, b (sorted item arrays attr=value), support, lhs_support, support_share, confidence,
    hash, quasi. Items with the value * are dropped first; of rules that become equal the one
    from the smallest itemset stays.
    """
    n = F.size("items")
    masks = F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), n) - 2)
    split = itemsets.where(n >= 2).select("items", "freq", F.explode(masks).alias("mask"))
    split = split.select(
        "items",
        "freq",
        F.filter("items", lambda x, i: F.call_function("shiftright", F.col("mask"), i).bitwiseAND(1) == 1).alias("a"),
    )
    split = split.withColumn("b", F.array_except("items", "a"))
    lhs = itemsets.select(F.col("items").alias("l_items"), F.col("freq").alias("lhs_support"))
    out = split.join(lhs, F.col("a") == F.col("l_items")).withColumn(
        "confidence",
        F.col("freq") / F.col("lhs_support"),
    ).where(F.col("confidence") >= min_confidence)
    decode = lambda s: F.transform(
        s,
        lambda x: F.struct(
            F.substring_index(x, "=", 1).alias("attr"),
            F.substring(x, F.length(F.substring_index(x, "=", 1)) + 2, F.length(x)).alias("value"),
        ),
    )
    out = out.withColumn("ai", X.without_roots(decode(F.col("a")))).withColumn(
        "bi",
        X.without_roots(decode(F.col("b"))),
    ).where((F.size("ai") > 0) & (F.size("bi") > 0))
    out = out.withColumn("hash", X.rule_hash(F.col("ai"), F.col("bi")))
    first = F.min_by(F.struct("ai", "bi", "freq", "lhs_support", "confidence"), F.struct(F.size("items"), F.col("items"), F.col("a")))
    out = out.groupBy("hash").agg(first.alias("r")).select(
        "hash",
        F.col("r.ai").alias("a"),
        F.col("r.bi").alias("b"),
        F.col("r.freq").alias("support"),
        F.col("r.lhs_support").alias("lhs_support"),
        (F.col("r.freq") / F.lit(n_rows)).alias("support_share"),
        F.col("r.confidence").alias("confidence"),
    )
    return out.withColumn("quasi", X.quasi_of(F.concat("a", "b"), quasi or []))


def with_budget(rules: DataFrame, min_confidence: float, quasi: list[str], min_support: float = 0.5, exact: bool = False) -> DataFrame:
    return rules.withColumn(
        "budget",
        X.rule_budget(F.col("support"), F.col("confidence"), X.contains_quasi(F.col("b"), quasi), min_confidence, min_support, exact),
    )


def care_rules(rules: DataFrame, min_confidence: float, quasi: list[str], min_support: float = 0.5, exact: bool = False) -> DataFrame:
    """The rules that a change of quasi-identifiers can touch, with their budgets."""
    return with_budget(rules.where(F.size("quasi") > 0), min_confidence, quasi, min_support, exact)


def recount(df: DataFrame, rules: list[dict], paths: dict | None = None) -> DataFrame:
    """Support, lhs support, share and confidence of given rules in one pass over df.

    rules: dicts with name, a and b, each a list of (attr, value); a value may be a range or,
    with paths (attr -> column with the row's root path), an inner node.
    """
    row = {c: F.col(f"`{c}`") for c in df.columns}
    lit = lambda side: F.array(*[F.struct(F.lit(x).alias("attr"), F.lit(v).alias("value")) for x, v in side])
    aggs = []
    for r in rules:
        mine = {c: row[c] for c, _ in [*r["a"], *r["b"]]}
        a, b = X.supports(lit(r["a"]), mine, paths), X.supports(lit(r["b"]), mine, paths)
        aggs.append(
            F.struct(
                F.lit(r["name"]).alias("rule"),
                F.count_if(a & b).alias("support"),
                F.count_if(a).alias("lhs_support"),
                F.count("*").alias("__n"),
            )
        )
    out = df.agg(F.array(*aggs).alias("x")).select(F.inline("x"))
    safe = lambda p, q: F.coalesce(F.try_divide(p, q), F.lit(0.0))
    return out.select(
        "rule",
        "support",
        "lhs_support",
        F.round(safe(F.col("support"), F.col("__n")), 6).alias("support_share"),
        F.round(safe(F.col("support"), F.col("lhs_support")), 6).alias("confidence"),
    )


def compare(before: DataFrame, after: DataFrame, key: str = "hash") -> DataFrame:
    """One row: rules before and after, lost, new and different as shares of the rules before."""
    p, q = before.select(key).distinct().withColumn("__p", F.lit(1)), after.select(F.col(key).alias("__k")).distinct().withColumn("__q", F.lit(1))
    x = p.join(q, F.col(key) == F.col("__k"), "full").agg(
        F.count("__p").alias("n_before"),
        F.count("__q").alias("n_after"),
        F.count_if(F.col("__q").isNull()).alias("n_lost"),
        F.count_if(F.col("__p").isNull()).alias("n_new"),
    )
    share = lambda c: F.round(F.coalesce(F.try_divide(F.col(c), F.col("n_before")), F.lit(0.0)), 6)
    return x.select(
        "*",
        share("n_lost").alias("lost"),
        share("n_new").alias("new"),
        F.round(F.coalesce(F.try_divide(F.col("n_lost") + F.col("n_new"), F.col("n_before")), F.lit(0.0)), 6).alias("different"),
    )


def surviving(rules: DataFrame, n_rows: int, min_support: float, min_confidence: float) -> DataFrame:
    """Rules that still have support and confidence, as one row of counts."""
    lost = (F.col("support") < F.lit(min_support) * n_rows) | (F.col("confidence") < min_confidence)
    return rules.agg(F.count_if(lost).alias("lost"), F.count_if(~lost).alias("kept"))


def group_rules(groups: DataFrame, rules: DataFrame) -> DataFrame:
    """gid, hash: rules that share an attr=value with a group, by an equi-join of these texts."""
    g = groups.select("gid", F.explode("quasi").alias("q"))
    r = rules.select("hash", F.explode("quasi").alias("rq"))
    return g.join(r, F.col("q") == F.col("rq")).select("gid", "hash").distinct()


def affected(givers: DataFrame, groups: DataFrame, rules: DataFrame) -> DataFrame:
    """i_gid, j_gid, hash: rules of giver i that hold a value which j has and i hasn't.

    Goes from rules to groups by equal values, so only pairs that a rule joins are ever made.
    """
    each = lambda g: g.select("gid", F.explode("quasi").alias("q"))
    wanted = rules.select(F.col("hash").alias("rh"), F.explode("quasi").alias("rq"))
    own = group_rules(givers, rules).select(F.col("gid").alias("i_gid"), "hash")
    missing = own.join(wanted, F.col("hash") == F.col("rh")).select("i_gid", "hash", "rq")
    has = each(givers).select(F.col("gid").alias("hg"), F.col("q").alias("hq"))
    missing = missing.join(has, (F.col("i_gid") == F.col("hg")) & (F.col("rq") == F.col("hq")), "left_anti")
    return missing.join(each(groups), F.col("rq") == F.col("q")).select("i_gid", F.col("gid").alias("j_gid"), "hash").distinct()


def first_rules(rules: DataFrame, n: int = 10) -> DataFrame:
    """The first n rules by hash, with their place: the order of the published reports. A top-k, so no global sort."""
    cols = rules.columns
    top = rules.orderBy("hash").limit(n)
    return top.agg(F.sort_array(
        F.collect_list(F.struct("hash", *[c for c in cols if c != "hash"]))
    ).alias("__x")).select(F.posexplode("__x").alias("place", "__r")).select(
        (F.col("place") + 1).alias("place"),
        "__r.*",
    )
