"""Near duplicates by SuperMinHash, banding, verification and grouping.

A document's set are its distinct shingles of `shingle` words, as 64-bit hashes. In
SuperMinHash each element walks through its own random permutation of the m slots, one
slot a step, and offers step + uniform number there; a slot keeps the least offer. Slots
of one element get different steps, so the estimates vary less than those of independent
hashes. A document stops after the first step at which no slot is empty, as later offers
are larger. Steps run over all documents of a slice at once.

1. Documents with equal sets (128-bit fingerprints) form a class, which gets a number of
   its own. A group of exact copies of any size costs one row in what follows.
2. Each band of `rows` slots puts a class into a bucket. Buckets with one class go. Joins on
   buckets are salted in proportion to the bucket's classes, `salt` of them to a part.
3. Round 1 pairs each class of a bucket with the bucket's centre, its class with the most
   neighbours over all its buckets: in a group of near copies, the text they come from.
   Pairs whose sizes allow the threshold are verified on the full sets. Groups of any
   size join here by a number of pairs in proportion to them.
4. Round 2 takes the buckets in which more than one group is left. In buckets of up to
   `small` classes every pair of different groups is verified. In larger ones two classes
   are verified if they share one of their rarest shingles; a set has so many of these
   that sets with the threshold's similarity can't miss (prefix filtering), and shingles
   that no other class has bound the intersection. So no link is lost, and common
   passages bring few pairs. Pairs inside a group can't change it, and aren't made: of the
   classes with a shingle, those of the group that has most of them meet only the others.
5. Groups are the connected components of the links.

A pair with the threshold's similarity is in no common bucket with a probability of
(1 - 0.85^5)^20 = 0.00001 by the defaults.

Null texts and texts without words have an empty set and link with nothing. A text with
fewer words than a shingle is one shingle. Repeated rows are copies. Rows with one id and
different texts are different documents: links go by the text, never by the id. Very long
texts are slices of their own. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, batch_of, drop, mix64, prepare, slices, stored, text_buffers, word_hashes, word_spans
from .components import components

_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, one text after another, and their numbers."""
    low = LOWER[data]
    starts, ends, per = word_spans(low, offsets)
    words = word_hashes(low, starts, ends)
    n_docs = len(per)
    n = np.maximum(per - size + 1, (per > 0).astype(np.int64))
    total = int(n.sum())
    first = np.cumsum(per) - per
    at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(total)
    doc = np.repeat(np.arange(n_docs), n)
    take = np.repeat(np.minimum(per, size), n)
    with np.errstate(over="ignore"):
        h = mix64(take.astype(np.uint64) * _STEP)
        last = max(0, len(words) - 1)
        for k in range(size):
            w = words[np.minimum(at + k, last)] if len(words) else h
            h = np.where(k < take, mix64(h * np.uint64(0xD6E8FEB86659FD93) + w), h)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(total, bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.bincount(doc[new], minlength=n_docs).astype(np.int64)


def signatures(sets: np.ndarray, sizes: np.ndarray, slots: int) -> np.ndarray:
    """SuperMinHash signatures, one row of `slots` 64-bit values per set; sets without elements have all ones."""
    n_docs, m = len(sizes), slots
    out = np.full(n_docs * m, np.uint64(0xFFFFFFFFFFFFFFFF))
    doc = np.repeat(np.arange(n_docs), sizes)
    elements, places = sets, None
    with np.errstate(over="ignore"):
        for step in range(m):
            r = mix64(elements + np.uint64(2 * step + 1) * _STEP)
            k = step + (mix64(elements + np.uint64(2 * step + 2) * _STEP) % np.uint64(m - step)).astype(np.int64)
            if places is None:
                slot = k
            else:
                rows = np.arange(len(elements))
                slot = places[rows, k].astype(np.int64)
                places[rows, k] = places[:, step]
            np.minimum.at(out, doc * m + slot, np.uint64(step) << np.uint64(56) | r >> np.uint64(8))
            empty = (out.reshape(n_docs, m) == np.uint64(0xFFFFFFFFFFFFFFFF)).any(1)
            on = empty[doc]
            if not on.any():
                break
            if places is None:
                elements, doc, k = elements[on], doc[on], k[on]
                places = np.tile(np.arange(m, dtype=np.uint16), (len(elements), 1))
                places[np.arange(len(elements)), k] = 0
            elif not on.all():
                elements, doc, places = elements[on], doc[on], places[on]
    return out.reshape(n_docs, m)


def fingerprints(sets: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set's elements."""
    ends = np.cumsum(sizes)
    out = []
    with np.errstate(over="ignore"):
        for salt in (1, 2):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(sets + np.uint64(salt) * _STEP), dtype=np.uint64)])
            out.append((total[ends] - total[ends - sizes]).view(np.int64))
    return out[0], out[1]


_SIGNED = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("text_hash", pa.int64()),
        ("n", pa.int64()),
        ("f1", pa.int64()),
        ("f2", pa.int64()),
        ("bands", pa.list_(pa.int64())),
    ]
)
_SETS = pa.schema([("f1", pa.int64()), ("f2", pa.int64()), ("elements", pa.list_(pa.int64()))])


def text_hash(text_col: str) -> Column:
    """Tells texts of one id apart."""
    return F.xxhash64(F.col(f"`{text_col}`").cast("string"))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.col(f"`{text_col}`").cast("string").alias("text"),
        text_hash(text_col).alias("text_hash"),
    )


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Bucket keys, one row of `bands` per signature."""
    sig = sig.reshape(len(sig), bands, rows)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(mix64(np.arange(1, bands + 1, dtype=np.uint64)), sig.shape[:2])
        for k in range(rows):
            key = mix64(key * np.uint64(0xD6E8FEB86659FD93) + sig[:, :, k])
    return key


def signed(docs: DataFrame, shingle: int = 5, bands: int = 20, rows: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, n (set size), f1 and f2 (the set's fingerprint), bands (bucket keys, none for an empty set)."""
    prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for i, j in slices(offsets):
                sets, sizes = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle)
                f1, f2 = fingerprints(sets, sizes)
                key = band_keys(signatures(sets, sizes, bands * rows), bands, rows)
                full = sizes > 0
                ends = np.concatenate([[0], np.cumsum(np.where(full, bands, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(key[full].ravel().view(np.int64)))
                yield batch_of(_SIGNED, [batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), sizes, f1, f2, lists])

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, text_hash long, n long, f1 long, f2 long, bands array<long>")


def element_sets(rows: DataFrame, shingle: int) -> DataFrame:
    """f1, f2 (the fingerprint) and the whole set of each row's column text."""
    prepare(rows.sparkSession)

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for i, j in slices(offsets):
                sets, sizes = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle)
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield batch_of(
                    _SETS,
                    [*fingerprints(sets, sizes), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(sets.view(np.int64)))],
                )

    return rows.select("text").mapInArrow(run, "f1 long, f2 long, elements array<long>")


def rare_prefixes(classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """cid, n, grp, rest, element: for each class its elements that are rarest over all classes given, as many as a set
    must share one of with any set of this similarity (n - ceil(n * percent / 100) + 1), without those that no other class
    has. rest: how many elements from this one on others have; if it is the first that two sets share, their intersection
    isn't larger."""
    each = classes.join(sets, F.col("cid") == F.col("set_of")).select("cid", "n", "grp", F.explode("elements").alias("element"))
    seen = each.groupBy("element").agg(F.count("*").alias("seen")).select(F.col("element").alias("e"), "seen")
    ranked = each.join(seen, F.col("element") == F.col("e")).groupBy("cid", "n", "grp").agg(
        F.sort_array(F.collect_list(F.struct("seen", "element"))).alias("by")
    )
    length = (F.col("n") - F.ceil(F.col("n") * percent / F.lit(100)) + 1).cast("int")
    known = F.size(F.filter("by", lambda x: x["seen"] > 1)).alias("known")
    return ranked.select("cid", "n", "grp", known, F.posexplode(
        F.filter(F.slice("by", F.lit(1), length), lambda x: x["seen"] > 1)
    ).alias("at", "x")).select(
        "cid",
        "n",
        "grp",
        (F.col("known") - F.col("at")).alias("rest"),
        F.col("x.element").alias("element"),
    )


def cross_pairs(prefixes: DataFrame, percent: int, salt: int = 256) -> DataFrame:
    """a, b: classes of different groups that share an element and could reach the similarity; no pair inside a group is made.

    Of an element's classes those of its largest group meet only the others, so the rows made
    are classes times classes outside the largest group. An element's classes are dealt to
    parts of about `salt`, each of which gets those others.
    """
    own = prefixes.groupBy("element", "grp").agg(F.count("*").alias("c"))
    tops = own.groupBy("element").agg(
        F.max(F.struct("c", "grp")).alias("top"),
        F.count("*").alias("groups"),
        F.sum("c").alias("c"),
    ).where("groups > 1")
    tops = tops.select(
        F.col("element").alias("e"),
        F.col("top.grp").alias("main"),
        F.ceil(F.col("c") / F.lit(salt)).cast("int").alias("parts"),
    )
    left = prefixes.join(tops, F.col("element") == F.col("e")).select(
        "element",
        "cid",
        "n",
        "grp",
        "rest",
        (F.col("grp") == F.col("main")).alias("in_main"),
        "parts",
        F.pmod(F.xxhash64("cid", F.lit(2)), "parts").alias("part"),
    )
    other = left.where("not in_main").select(
        F.col("element").alias("k"),
        F.col("cid").alias("b"),
        F.col("n").alias("m"),
        F.col("grp").alias("g"),
        F.col("rest").alias("l"),
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("k_part"),
    )
    most, n, m = F.least("rest", "l"), F.col("n"), F.col("m")
    fit = (F.lit(100) * F.least(n, m) >= F.lit(percent) * F.greatest(n, m)) & (F.lit(100) * most >= F.lit(percent) * (n + m - most))
    once = F.col("in_main") | (F.col("cid") < F.col("b"))
    return left.join(other, (F.col("element") == F.col("k")) & (F.col("part") == F.col("k_part")) & (F.col("grp") != F.col("g")) & once & fit).select(
        F.least("cid", "b").alias("a"),
        F.greatest("cid", "b").alias("b"),
    )


def classified(
    docs: DataFrame,
    percent: int = 85,
    shingle: int = 5,
    bands: int = 20,
    rows: int = 5,
    small: int = 32,
    salt: int = 256,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """near_duplicates() with two columns more: text_hash, which with the id names a row up to repetition, and stays: true
    for one (id, text) of each group, and for what isn't linked. A group's is the one with the smallest id, then hash."""
    signs = stored(signed(docs, shingle, bands, rows, id_col, text_col), "signed")
    full = signs.where("n > 0 and doc_id is not null")
    heads = full.groupBy("f1", "f2").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("head"),
        F.first("n").alias("n"),
        F.first("bands").alias("bands"),
    )
    heads = stored(  # numbers hold as the table is read, not made, from here on
        heads.select("f1", "f2", "head", "n", "bands", F.monotonically_increasing_id().alias("cid")),
        "classes",
    )
    own = full.select("doc_id", "text_hash", "n", "f1", "f2").join(
        heads.select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), "cid", "head"),
        (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")),
    )
    members = stored(own.select("doc_id", "text_hash", "n", "cid", "head"), "members")
    entries = heads.select("cid", "n", F.posexplode("bands").alias("band", "bucket"))
    crowds = entries.groupBy("band", "bucket").agg(F.count("*").alias("crowd")).where("crowd > 1").select(
        F.col("band").alias("s_band"),
        F.col("bucket").alias("s_bucket"),
        "crowd",
    )
    placed = stored(
        entries.join(
            crowds,
            (F.col("band") == F.col("s_band")) & (F.col("bucket") == F.col("s_bucket")),
        ).select("cid", "n", "bucket", "crowd"),
        "placed",
    )
    parts = F.ceil(F.col("crowd") / F.lit(salt)).cast("int")
    part = F.pmod(F.xxhash64("cid", F.lit(1)), parts)
    salts = F.explode(F.sequence(F.lit(0), parts - 1))

    def by_bucket(x: DataFrame, of: DataFrame, how: str) -> DataFrame:
        """x (with bucket, crowd and cid) joined with the one row per bucket k of `of` (with crowd), each bucket in parts."""
        of = of.withColumn("k_part", salts).drop("crowd")
        return x.withColumn("part", part).join(
            of,
            (F.col("bucket") == F.col("k")) & (F.col("part") == F.col("k_part")),
            how,
        ).drop("part", "k_part")

    weights = placed.groupBy("cid").agg(F.sum("crowd").alias("weight")).select(F.col("cid").alias("w"), "weight")
    weighed = placed.join(weights, F.col("cid") == F.col("w"))
    centres = weighed.groupBy(F.col("bucket").alias("k")).agg(F.first("crowd").alias("crowd"), F.max(
        F.struct("weight", F.xxhash64("cid").alias("h"), F.col("cid").alias("id"), F.col("n").alias("n"))
    ).alias("centre")).select(
        "k",
        "crowd",
        F.col("centre.id").alias("centre"),
        F.col("centre.n").alias("m"),
    )
    sizes_fit = F.lit(100) * F.least("n", "m") >= F.lit(percent) * F.greatest("n", "m")
    first = by_bucket(placed, centres, "inner").select(
        F.least("cid", "centre").alias("a"),
        F.greatest("cid", "centre").alias("b"),
        "n",
        "m",
    ).where(F.col("a") < F.col("b")).where(sizes_fit).select("a", "b").distinct()
    wanted = heads.join(placed.select(F.col("cid").alias("w")).distinct(), F.col("cid") == F.col("w"), "left_semi").select(
        F.col("head.doc_id").alias("i"),
        F.col("head.text_hash").alias("h"),
        F.col("f1").alias("g1"),
        F.col("f2").alias("g2"),
        F.col("cid").alias("set_of"),
    )
    needed = _rows(docs, id_col, text_col).join(
        wanted,
        (F.col("doc_id") == F.col("i")) & (F.col("text_hash") == F.col("h")),
        "left_semi",
    ).dropDuplicates(["doc_id", "text_hash"])
    sets = stored(
        element_sets(needed, shingle).join(wanted, (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2"))).select("set_of", "elements"),
        "sets",
    )

    def verified(pairs: DataFrame) -> DataFrame:
        x = sets.select(F.col("set_of").alias("a_id"), F.col("elements").alias("a_set"))
        y = sets.select(F.col("set_of").alias("b_id"), F.col("elements").alias("b_set"))
        both = pairs.join(x, F.col("a") == F.col("a_id")).join(y, F.col("b") == F.col("b_id"))
        common = F.size(F.array_intersect("a_set", "b_set"))
        return both.select("a", "b", common.alias("common"), (F.size("a_set") + F.size("b_set") - common).alias("all")).where(
            F.lit(100) * F.col("common") >= F.lit(percent) * F.col("all")
        ).select("a", "b")

    tried = stored(first, "pairs")
    links = stored(verified(tried), "links")
    groups = components(links, "a", "b")
    grouped = stored(
        placed.join(groups, F.col("cid") == F.col("node"), "left").select(
            "bucket",
            "crowd",
            "cid",
            "n",
            F.coalesce("root", "cid").alias("grp"),
        ),
        "grouped",
    )
    mixed = grouped.groupBy(F.col("bucket").alias("k")).agg(
        F.first("crowd").alias("crowd"),
        F.min("grp").alias("lo"),
        F.max("grp").alias("hi"),
    ).where("lo < hi").select("k", "crowd")
    left = stored(by_bucket(grouped, mixed, "left_semi"), "mixed")
    other = left.select(F.col("bucket").alias("k"), F.col("cid").alias("b"), F.col("n").alias("m"), F.col("grp").alias("g"))
    few = left.where(F.col("crowd") <= small).join(
        other,
        (F.col("bucket") == F.col("k")) & (F.col("cid") < F.col("b")) & (F.col("grp") != F.col("g")) & sizes_fit,
    ).select(F.col("cid").alias("a"), "b")
    many = left.where(F.col("crowd") > small).select("cid", "n", "grp").distinct()
    prefixes = stored(rare_prefixes(many, sets, percent), "prefixes")
    second = few.union(cross_pairs(prefixes, percent, salt)).distinct()
    second = stored(
        second.join(
            tried.select(F.col("a").alias("ta"), F.col("b").alias("tb")),
            (F.col("a") == F.col("ta")) & (F.col("b") == F.col("tb")),
            "left_anti",
        ),
        "pairs",
    )
    more = stored(verified(second), "links")
    if not more.isEmpty():
        drop(groups)
        groups = components(links.union(more), "a", "b")
    least = groups.join(
        heads.select("cid", "head"),
        F.col("node") == F.col("cid"),
    ).groupBy(F.col("root").alias("r")).agg(F.min("head").alias("least"))
    named = stored(groups.join(least, F.col("root") == F.col("r")).select("node", "least"), "groups")
    drop(heads, placed, sets, tried, links, grouped, left, prefixes, second, more, groups)
    first_of = F.coalesce("least", "head")
    out = members.join(named, F.col("cid") == F.col("node"), "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.col("head.doc_id").alias("class_id"),
        first_of["doc_id"].alias("component_id"),
        "text_hash",
        (F.struct("doc_id", "text_hash") == first_of).alias("stays"),
    )
    alone = signs.where("n = 0 or doc_id is null").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.col("doc_id").alias("class_id"),
        F.col("doc_id").alias("component_id"),
        "text_hash",
        F.lit(True).alias("stays"),
    )
    return out.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_duplicates(
    docs: DataFrame,
    percent: int = 85,
    shingle: int = 5,
    bands: int = 20,
    rows: int = 5,
    small: int = 32,
    salt: int = 256,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id (smallest id with the same set), component_id, kept.

    Links are pairs with 100 * intersection >= percent * union. A row without an id isn't
    linked and stays. small: up to so many classes a bucket's pairs are tried one by one.
    """
    return classified(docs, percent, shingle, bands, rows, small, salt, id_col, text_col).select(
        "doc_id",
        "n_shingles",
        "class_id",
        "component_id",
        "kept",
    )
