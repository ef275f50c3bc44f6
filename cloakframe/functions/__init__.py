"""Column expressions: bins, items, rule hashes and budgets, group risk, hierarchies, distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- bins and items ----


def bin_index(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """The right-closed equal-width bin of x, from 0; the least value is in bin 0."""
    width = (hi - lo) / F.lit(bins)
    return F.when(hi == lo, F.lit(0)).otherwise(F.least(F.lit(bins - 1), F.greatest(F.ceil((x - lo) / width) - 1, F.lit(0)))).cast("int")


def bin_label(index: Column, lo: Column, hi: Column, bins: int) -> Column:
    width = (hi - lo) / F.lit(bins)
    edge = lambda i: F.round(lo + width * i, 3).cast("string")
    return F.concat(F.lit("("), edge(index), F.lit("-"), edge(index + 1), F.lit("]"))


def binned(df: DataFrame, columns: list[str], bins: int = 10, compat: bool = False) -> DataFrame:
    """df with each numeric column replaced by its bin label over the observed range; one pass finds all ranges.

    compat: as pandas does, the least value is outside all bins unless it is 0, and the edge 0 becomes -0.1.
    """
    ranges = df.agg(
        *[f(F.col(f"`{c}`")).cast("double").alias(f"__{n}_{i}") for i, c in enumerate(columns) for n, f in (("lo", F.min), ("hi", F.max))]
    )
    out = df.crossJoin(F.broadcast(ranges))
    for i, c in enumerate(columns):
        lo, hi, x = F.col(f"__lo_{i}"), F.col(f"__hi_{i}"), F.col(f"`{c}`")
        label = bin_label(bin_index(x, lo, hi, bins), lo, hi, bins)
        if compat:
            label = F.when((x == lo) & (lo != 0), F.lit("nan")).when(
                lo == 0,
                F.regexp_replace(label, r"^\(0\.0-", "(-0.1-"),
            ).otherwise(label)
        out = out.withColumn(c, label)
    return out.drop(*ranges.columns)


def item(attr: str, value: Column) -> Column:
    return F.struct(F.lit(attr).alias("attr"), value.cast("string").alias("value"))


def items_of(columns: list[str]) -> Column:
    """array<struct<attr,value>> of the row, without nulls."""
    return F.filter(F.array(*[item(c, F.col(f"`{c}`")) for c in columns]), lambda x: x["value"].isNotNull())


def item_key(x: Column) -> Column:
    return F.concat_ws("=", x["attr"], x["value"])


# ---- rules ----


def rule_hash(a: Column, b: Column) -> Column:
    """md5 of both sides' attr:value texts, each side sorted by attribute, joined without separators, with => between."""
    side = lambda s: F.array_join(F.transform(F.array_sort(s), lambda x: F.concat(x["attr"], F.lit(":"), x["value"])), "")
    return F.md5(F.concat(side(a), F.lit("=>"), side(b)))


def rule_budget(
    support: Column,
    confidence: Column,
    b_has_quasi: Column,
    min_conf: float,
    min_support: float | Column = 0.5,
    exact: bool = False,
) -> Column:
    """How many migrations a rule survives. Literal: the published expression. exact: the losses until confidence or support falls short."""
    s, c, cm = support.cast("double"), confidence, F.lit(min_conf)
    spare = s * (c - cm) / c
    floor = F.lit(min_support) if not isinstance(min_support, Column) else min_support
    if exact:
        return F.least(s - floor, F.when(b_has_quasi, F.floor(spare)).otherwise(F.floor(spare / (1 - cm))).cast("double"))
    return F.least(s - floor, F.when(b_has_quasi, spare.cast("long")).otherwise((spare * (1 - cm)).cast("long")).cast("double"))


def contains_quasi(items: Column, quasi: list[str]) -> Column:
    return F.exists(items, lambda x: x["attr"].isin(quasi))


def quasi_of(items: Column, quasi: list[str]) -> Column:
    """attr=value of the items over quasi-identifiers."""
    return F.array_distinct(F.transform(F.filter(items, lambda x: x["attr"].isin(quasi)), item_key))


def allows(items: Column, attr: str, value: Column) -> Column:
    """No item has this attribute with another value."""
    return F.forall(items, lambda x: (x["attr"] != attr) | (x["value"] == value))


def without_roots(items: Column, root: str = "*") -> Column:
    return F.filter(items, lambda x: x["value"] != root)


#: Comparators by bracket of a range's ends.
COMPARE = {"[": lambda x, lo: x >= lo, "(": lambda x, lo: x > lo, "]": lambda x, hi: x <= hi, ")": lambda x, hi: x < hi}


def range_bounds(text: Column) -> Column:
    """struct(open, lo, hi, close) of a range such as (-0.1-2523.6], [0-25] or 30-39; signs are kept."""
    pattern = r"^([\[(]?)(-?[0-9.]+)-(-?[0-9.]+)([\])]?)$"
    part = lambda i: F.regexp_extract(text, pattern, i)
    return F.when(
        text.rlike(pattern),
        F.struct(
            F.when(part(1) == "", "[").otherwise(part(1)).alias("open"),
            part(2).cast("double").alias("lo"),
            part(3).cast("double").alias("hi"),
            F.when(part(4) == "", "]").otherwise(part(4)).alias("close"),
        ),
    )


def in_range(x: Column, bounds: Column) -> Column:
    low = F.when(bounds["open"] == "(", COMPARE["("](x, bounds["lo"])).otherwise(COMPARE["["](x, bounds["lo"]))
    high = F.when(bounds["close"] == ")", COMPARE[")"](x, bounds["hi"])).otherwise(COMPARE["]"](x, bounds["hi"]))
    return low & high


def supports(items: Column, row: dict[str, Column], paths: dict[str, Column] | None = None) -> Column:
    """The row matches all items: equal, in a numeric range, or below an inner node. paths: the row's root path per attribute."""
    def one(x):
        ok = F.lit(False)
        for attr, value in row.items():
            match = (x["value"] == value.cast("string")) | F.coalesce(
                in_range(value.try_cast("double"), range_bounds(x["value"])),
                F.lit(False),
            )
            if paths and attr in paths:
                match = match | F.array_contains(paths[attr], x["value"])
            ok = ok | (x["attr"] == attr) & match
        return F.coalesce(ok, F.lit(False))

    return F.forall(items, one)


# ---- groups ----


def is_safe(n: Column, k: int) -> Column:
    return n >= k


def is_unsafe(n: Column, k: int) -> Column:
    return (n > 0) & (n < k)


def is_small(n: Column, k: int) -> Column:
    return is_unsafe(n, k) & (n <= F.lit(k / 2))


def group_risk(n: Column, k: int) -> Column:
    return F.when(n >= k, F.lit(0)).otherwise(F.lit(2 * k) - n).cast("long")


def risk_after(n: Column, k: int) -> Column:
    """Risk once moves are made: an empty group has none."""
    return F.when((n >= k) | (n <= 0), F.lit(0)).otherwise(F.lit(2 * k) - n).cast("long")


def migrant_count(ni: Column, oi: Column, nj: Column, k: int) -> Column:
    """Rows to move from group i (n, origin rows left) to group j."""
    i_safe, j_safe = ni >= k, nj >= k
    return F.when(i_safe & ~j_safe, F.least(F.lit(k) - nj, ni - k, oi)).when(
        ~i_safe & ~j_safe,
        F.least(ni, F.lit(k) - nj),
    ).when(~i_safe & j_safe, ni).otherwise(F.lit(0)).cast("long")


def risk_reduction(ni: Column, nj: Column, m: Column, k: int) -> Column:
    return group_risk(ni, k) + group_risk(nj, k) - risk_after(ni - m, k) - risk_after(nj + m, k)


def most_useful(ni: Column, nj: Column, m: Column, k: int) -> Column:
    return is_unsafe(ni, k) & is_unsafe(nj, k) & (risk_reduction(ni, nj, m, k) == group_risk(ni, k) + group_risk(nj, k))


# ---- hierarchies and distances ----


def lca(p: Column, q: Column) -> Column:
    """The first node of one root path that is also on the other."""
    return F.element_at(F.array_intersect(p, q), 1)


def depth_distance(p: Column, q: Column, depth: int | Column) -> Column:
    """How far up the lowest common node is, as a share of the tree's depth."""
    node = lca(p, q)
    up = F.greatest(F.array_position(p, node), F.array_position(q, node)) - 1
    return up.cast("double") / depth


def width(leaves: Column, total: Column | int) -> Column:
    """A node's share of a hierarchy's leaves; 0 for a leaf."""
    return F.when(leaves <= 1, F.lit(0.0)).otherwise(leaves.cast("double") / total)


def nodes(hier: DataFrame) -> DataFrame:
    """attr, value, level (from the root), leaves: the nodes of root paths (attr, leaf, path)."""
    up = hier.select("attr", "leaf", F.size("path").alias("__n"), F.posexplode("path").alias("__i", "value"))
    return up.groupBy("attr", "value").agg(F.max(F.col("__n") - 1 - F.col("__i")).alias("level"), F.count_distinct("leaf").alias("leaves"))


def grade(numeric: list[Column], frequencies: list[Column], k: int) -> Column:
    """A row's grade: its numbers over k, and the shares of its categories."""
    out = F.lit(0.0)
    for x in numeric:
        out = out + x.cast("double") / F.lit(k)
    for f in frequencies:
        out = out + f
    return out


def hash_order(*columns: str, seed: int = 0) -> Column:
    """A text to sort by that mixes the rows, the same on any cluster."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns], F.lit(str(seed))))


def hash_share(*columns: str, seed: int = 0) -> Column:
    """A number from 0 to below 1 that the columns' values fix."""
    return F.conv(F.substring(hash_order(*columns, seed=seed), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def pick(df: DataFrame, n: int, *key: str, seed: int = 0) -> DataFrame:
    """An exact-size random sample without replacement, the same each time."""
    return df.orderBy(hash_order(*key, seed=seed), *key).limit(n)


def natural_order(text: Column) -> Column:
    """A key that sorts texts that are numbers by their value, before all others, which go by their characters."""
    number = F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"), text.try_cast("double"))
    return F.struct(number.isNull().alias("not_number"), number.alias("number"), text.alias("text"))


# Full-domain levels of three census attributes.
AGE_LEVELS = [(25, "[0-25]"), (50, "[26-50]"), (75, "[51-75]"), (100, "[76-100]")]


def generalize_age(x: Column) -> Column:
    out = F.when(x <= AGE_LEVELS[0][0], AGE_LEVELS[0][1])
    for most, label in AGE_LEVELS[1:]:
        out = out.when(x <= most, label)
    return out.otherwise("[101-)")


def star(x: Column) -> Column:
    return F.lit("*")


def level_of(path: Column, level: int) -> Column:
    """The value that is `level` steps up a root path; the root beyond it."""
    return F.element_at(path, F.least(F.lit(level + 1), F.size(path)))
