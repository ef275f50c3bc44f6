"""Sources and sinks: census CSV, transactions, hierarchies, rules, anonymised tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The census file's column names, in file order, and those that are kept.
CENSUS_COLUMNS = [
    "age",
    "workclass",
    "fnlwgt",
    "education",
    "education-num",
    "marital-status",
    "occupation",
    "relationship",
    "race",
    "sex",
    "capital-gain",
    "capital-loss",
    "hours-per-week",
    "native-country",
]
RETAINED_COLUMNS = ["age", "sex", "marital-status", "native-country", "race", "education", "hours-per-week", "capital-gain", "workclass"]
QUASI_ATTRIBUTES = RETAINED_COLUMNS[:6]
NUMERIC = {"age", "fnlwgt", "education-num", "capital-gain", "capital-loss", "hours-per-week"}
UNKNOWN = "?"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; a temporary one where all runs in one process and none is named."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.conf.get("cloakframe.shared.dir", "")
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="cloakframe-")
        spark.conf.set("cloakframe.shared.dir", base)
    return base.rstrip("/") + "/cloakframe"


def census_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.IntegerType() if c in NUMERIC else T.StringType()) for c in columns])


def read_census(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Headerless CSV; the token ? is null, spaces around values go, surplus fields are ignored."""
    return spark.read.schema(census_schema(columns or CENSUS_COLUMNS)).csv(
        path,
        ignoreLeadingWhiteSpace=True,
        ignoreTrailingWhiteSpace=True,
        nullValue=UNKNOWN,
    )


def with_rid(df: DataFrame, *order: str) -> DataFrame:
    """A stable row number column rid. With order columns it is a hash-free rank; without, file order within splits."""
    if not order:
        return df.withColumn("rid", F.monotonically_increasing_id())
    from cloakframe.operators.keep import running_sum

    return running_sum(df, list(order), F.lit(1).cast("long"), "rid").withColumn("rid", F.col("rid") - 1)


def clean(df: DataFrame, retained: list[str] | None = None) -> DataFrame:
    """The retained columns of rows that know all of them."""
    keep = retained or RETAINED_COLUMNS
    return df.select(*[F.col(f"`{c}`") for c in keep]).dropna(subset=keep)


def unknown_to_null(df: DataFrame, *columns: str, token: str = UNKNOWN) -> DataFrame:
    return df.withColumns({c: F.when(F.trim(F.col(c).cast("string")) != token, F.col(c)) for c in columns})


def read_transactions(spark: SparkSession, path: str, separator: str = ", ", fraction: float | None = None, seed: int = 0) -> DataFrame:
    """rid, items: each value tagged with its position; fraction keeps that share of rows by a hash."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0).withColumn("rid", F.monotonically_increasing_id())
    values = F.transform(F.split("value", separator), lambda x, i: F.concat(F.trim(x), F.lit("_"), i.cast("string")))
    out = lines.select("rid", values.alias("items"))
    return out if fraction is None else out.where(F.pmod(F.xxhash64("value", F.lit(seed)), F.lit(1_000_000)) < int(fraction * 1_000_000))


def read_hierarchy(spark: SparkSession, path: str, attr: str) -> DataFrame:
    """attr, leaf, path (from the leaf to the root) of a file with one `leaf;...;*` line per leaf. Blank lines anywhere are passed over: a file that is read in splits has no first one to stop at."""
    parts = F.transform(F.split("value", ";"), lambda x: F.trim(x))
    return spark.read.text(path).where(F.length(F.trim("value")) > 0).select(
        F.lit(attr).alias("attr"),
        parts[0].alias("leaf"),
        parts.alias("path"),
    )


def write_rules(rules: DataFrame, path: str) -> None:
    rules.write.mode("overwrite").parquet(path)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_dataset(df: DataFrame, path: str, columns: list[str]) -> None:
    """Headerless CSV of the columns; ranges and sets are rendered by render()."""
    df.select(*[F.col(f"`{c}`") for c in columns]).write.mode("overwrite").csv(path, header=False)


def write_release(df: DataFrame, path: str, columns: list[str], gid: str = "gid", source: str = "src_gid", rid: str = "rid") -> None:
    """Headerless CSV of a migrated table: by group, its own rows first, then those that came from others. Files follow each other in this order."""
    came = F.col(gid) != F.col(source)
    rows = df.repartitionByRange(F.col(gid), came, F.col(rid)).sortWithinPartitions(F.col(gid), came, F.col(rid))
    rows.select(*[F.col(f"`{c}`") for c in columns]).write.mode("overwrite").csv(path, header=False)


def render_range(lo, hi):
    """A generalised number as text: lo-hi, or the number itself."""
    show = lambda x: F.when(x == F.floor(x), F.floor(x).cast("long").cast("string")).otherwise(x.cast("string"))
    return F.when(lo == hi, show(lo)).otherwise(F.concat(show(lo), F.lit("-"), show(hi)))


def numeric_domain(df: DataFrame, *columns: str) -> DataFrame:
    """attr, lo, hi, range, n_values per numeric column, in one pass."""
    aggs = [
        F.struct(
            F.lit(c).alias("attr"),
            F.min(c).cast("double").alias("lo"),
            F.max(c).cast("double").alias("hi"),
            (F.max(c) - F.min(c)).cast("double").alias("range"),
            F.count_distinct(c).alias("n_values"),
        )
        for c in columns
    ]
    return df.agg(F.array(*aggs).alias("x")).select(F.inline("x"))


def users_with_conditions(users: DataFrame, conditions: DataFrame, key: str, order: str, code: str) -> DataFrame:
    """The first row of each user joined with the sorted distinct codes of its conditions."""
    first = users.groupBy(key).agg(F.min_by(F.struct(*[c for c in users.columns if c != key]), order).alias("u")).select(key, "u.*")
    codes = conditions.groupBy(F.col(key).alias("__key")).agg(F.sort_array(F.collect_set(code)).alias("codes"))
    return first.join(codes, F.col(key) == F.col("__key")).drop("__key")
