"""The registered queries of this subpackage: each applies one operator to a whole table.

The operators give texts, spans and files; the queries derive digest columns from them.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bwt_dedup, chat, decontam, edit_counts, licenses, packing, pii, repetition, superminhash, wavelet
from .common import batch_of, new_path, prepare, stored

#: A demonstration key; a deployment passes its own.
PII_KEY = "cloakframe-demo"


def word_tokenizer() -> str:
    """The path of the tokenizer that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _is(kind: str):
    return lambda k: k == kind


def op1_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pii.pseudonymize(docs, PII_KEY)
    counts = [F.size(F.filter("pii", _is(kind))).cast("long").alias(f"n_{kind}") for kind in ("email", *pii.KINDS)]
    return out.select("doc_id", "text", F.size("pii").cast("long").alias("n_replaced"), *counts)


#: Sequences of 2,048 tokens, 256 segments and 1,984 tokens with loss.
PACKED = packing.Limits(2048, 256, 1984)


def first_line(text: str) -> Column:
    """The rule for prompts: the first of several lines bears no loss."""
    t = F.col(text)
    return F.when(t.contains("\n"), F.substring_index(t, "\n", 1))


def op2_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, word_tokenizer(), PACKED, prompt=first_line("text"), with_ids=False).drop("ids")


def sample_edits(n_chars: Column, seed: str) -> Column:
    """Three edits per document that its id and length fix: (start, characters removed, new text)."""
    new = F.array(*[F.lit(x) for x in ("", " ", "a new phrase ", "x", "\n\nAnother line, longer than the rest.\n", "é")])

    def one(i):
        h = F.xxhash64(F.col(seed), F.lit(i))
        return F.struct(
            F.pmod(h, n_chars + 1).alias("start"),
            F.pmod(F.shiftright(h, 20), F.lit(40)).cast("long").alias("length"),
            F.element_at(new, (F.pmod(F.shiftright(h, 40), F.lit(6)) + 1).cast("int")).alias("new"),
        )

    return F.array(*[one(i) for i in range(3)])


def op3_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plants and keeps the trees of all documents, then edits each document and updates its tree."""
    trees = stored(edit_counts.plant(table(spark, sf_dir, "documents"), word_tokenizer()), "trees")
    out = edit_counts.update_counts(trees.withColumn("edits", sample_edits(edit_counts.n_chars(), "doc_id")), word_tokenizer())
    return out.select(
        "doc_id",
        "n_tokens_before",
        "n_tokens",
        "n_chars",
        "n_leaves",
        "n_leaves_touched",
        "n_chars_reencoded",
        F.sha2(edit_counts.edited_text(), 256).alias("edited_sha256"),
    )


def op4_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = stored(wavelet.tokenized(table(spark, sf_dir, "documents"), word_tokenizer()), "tokens")
    path = new_path(spark, "shards")
    wavelet.write_shards(tokens, path)
    return wavelet.read_shards(spark, path)


def op5_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda s, r: s + r["past"] - r["first"])
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return out.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.size("runs") > 0).alias("contaminated"),
    )


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt_dedup.deduplicate(table(spark, sf_dir, "documents"), min_bytes=100).select(
        "doc_id",
        "n_bytes",
        "n_removed",
        "n_spans",
        "kept_sha256",
    )


def op8_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed, kept = repetition.verdicts()
    return repetition.measure(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        kept.alias("kept"),
    )


#: The conversation that the query adds to the table's own.
ADDED = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]
_READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_READ_ARROW = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("n_turns", pa.int64()),
        ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()),
        ("formatted_chars", pa.int64()),
    ]
)


def read_windows(windows: DataFrame) -> DataFrame:
    """Per conversation, from its windows alone: turns, loss text and size. Windows stream by in order; a digest is all that is kept of a conversation."""
    prepare(windows.sparkSession)
    rows = chat.streamed(windows.select("conv_id", "window", "n_repeated", "text", "loss"), "conv_id", "window")

    def run(batches):
        cols, own = [[] for _ in range(6)], None

        def close():
            for c, v in zip(cols, (own[0], own[1], own[2].hexdigest(), own[3], own[4].hexdigest(), own[5]), strict=True):
                c.append(v)

        for batch in batches:
            for conv, _, again, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own is None or conv != own[0]:
                    if own:
                        close()
                    own = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in chat.parse(text)[again:]:
                    own[2].update(f"{role}\n{said}\n".encode())
                    own[1] += 1
                for x in spans:
                    said = chat.unescape(text[x["start"] : x["end"]])
                    own[3] += len(said)
                    own[4].update(said.encode())
                own[5] += len(text)
            yield batch_of(_READ_ARROW, cols)
            cols = [[] for _ in range(6)]
        if own:
            close()
            yield batch_of(_READ_ARROW, cols)

    return rows.mapInArrow(run, _READ)


def op9_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        "role",
        "text",
    )
    rows = convs.union(spark.createDataFrame(ADDED, "conv_id long, turn long, role string, text string"))
    path = new_path(spark, "windows")
    chat.format_windows(rows, word_tokenizer()).write.option("compression", "zstd").parquet(path)
    return read_windows(spark.read.parquet(path))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document all notices in order, and the one with the most matched words: of equal ones the best covered, then the first."""
    out = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    rank = lambda x: F.struct(
        x["matched"].alias("matched"),
        x["coverage"].alias("coverage"),
        (-x["first_word"]).alias("at"),
        x["license"].alias("license"),
        x["past_word"].alias("past"),
    )
    best = F.array_max(F.transform("licenses", rank))
    names = F.array_join(F.transform("licenses", lambda x: x["license"]), ",")
    return out.select(
        "doc_id",
        "n_words",
        F.size("licenses").cast("long").alias("n_licenses"),
        names.alias("licenses"),
        best["license"].alias("license"),
        best["matched"].alias("matched"),
        best["coverage"].alias("coverage"),
        (-best["at"]).alias("first_word"),
        best["past"].alias("past_word"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_feistel_pseudonyms,
        op2_vector_packing,
        op3_edit_counts,
        op4_wavelet_shards,
        op5_superminhash,
        op6_benchmark_leaks,
        op7_repeated_passages,
        op8_repetition_rules,
        op9_chat_windows,
        op10_license_scan,
    )
}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP5_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\\x20\\x09-\\x0D]+') AS a FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(a) = 0 THEN [] WHEN len(a) < 5 THEN [array_to_string(a, ' ')] ELSE [array_to_string(a[i:i+4], ' ') FOR i IN range(1, len(a) - 3)] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS b FROM r GROUP BY 1),
q AS (SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS f FROM s GROUP BY 1),
k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY f) AS class_id FROM q)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(k.class_id, w.doc_id) AS class_id, least(w.doc_id, coalesce(m.b, w.doc_id)) AS component_id, w.doc_id = least(w.doc_id, coalesce(m.b, w.doc_id)) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.a = w.doc_id LEFT JOIN k ON k.doc_id = w.doc_id
"""

_WORDS6 = "regexp_extract_all(" + _LOW + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP6_SQL = f"""
WITH b AS (SELECT item_id, {_WORDS6} AS a FROM benchmark),
bw AS (SELECT item_id, least(10, len(a)) AS n, unnest([array_to_string(a[i:i+least(10, len(a))-1], ' ') FOR i IN range(1, len(a) - least(10, len(a)) + 2)]) AS g FROM b WHERE len(a) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
d AS (SELECT doc_id, {_WORDS6} AS a FROM documents),
pos AS (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM d),
dw AS (SELECT doc_id, i, n, array_to_string(a[i:i+n-1], ' ') AS g FROM pos, sizes WHERE i + n - 1 <= len(a)),
h AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1)
SELECT d.doc_id, len(a) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""

OP8_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS a FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(a[i:i+7], ' ')) AS g FROM (SELECT doc_id, a, unnest(range(1, len(a) - 6)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
rep AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 8)) AS k FROM twice) GROUP BY 1),
big AS (SELECT doc_id, a, greatest(51, CAST(floor(0.2 * len(a)) AS BIGINT) + 1) AS w FROM d WHERE doc_id IN (SELECT doc_id FROM twice)),
longer AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, md5(array_to_string(a[i:i+w-1], ' ')) AS g FROM (SELECT doc_id, a, w, unnest(range(1, len(a) - w + 2)) AS i FROM big)) GROUP BY doc_id, g HAVING count(*) > 1),
ln AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
o AS (SELECT d.doc_id, len(a) AS n_words, length(array_to_string(a, '')) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, coalesce(ln.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, longer.doc_id IS NOT NULL AS bad
FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN ln USING (doc_id) LEFT JOIN longer USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT bad AS kept FROM o
"""



def _op7_sql(size: int = 100) -> str:
    """Windows of `size` bytes by doubling: the rank of the first half and that of the second name a window of twice the bytes."""
    lead = "SELECT d, i, r, lead(r, {}) OVER (PARTITION BY d ORDER BY i) AS s FROM r{}"
    ranks, n = "", 1
    while 2 * n <= size:
        ranks += f"r{2 * n} AS (SELECT d, i, dense_rank() OVER (ORDER BY r, s) AS r FROM ({lead.format(n, n)}) WHERE s IS NOT NULL),\n"
        n *= 2
    return f"""
WITH t AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST) AS d, doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS a FROM documents),
b AS (SELECT d, unnest(a) AS h, generate_subscripts(a, 1) AS i FROM t),
r1 AS (SELECT d, i, h AS r FROM b),
{ranks}w AS (SELECT d, i, row_number() OVER (PARTITION BY r, s ORDER BY d, i) > 1 AS again FROM ({lead.format(size - n, n)}) WHERE s IS NOT NULL),
e AS (SELECT d, i, sum(x) AS x FROM (SELECT d, i, 1 AS x FROM w WHERE again UNION ALL SELECT d, i + {size}, -1 FROM w WHERE again) GROUP BY 1, 2),
c AS (SELECT b.d, b.i, h, sum(coalesce(x, 0)) OVER (PARTITION BY b.d ORDER BY b.i) > 0 AS gone FROM b LEFT JOIN e ON e.d = b.d AND e.i = b.i),
g AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY d ORDER BY i), false) AS head FROM c),
o AS (SELECT d, count(*) FILTER (gone) AS n_removed, count(*) FILTER (head) AS n_spans, string_agg(h, '' ORDER BY i) FILTER (NOT gone) AS kept FROM g GROUP BY 1)
SELECT doc_id, len(a) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM t LEFT JOIN o USING (d)
"""


ORACLES = {
    "op7_repeated_passages": _op7_sql(),
    "op5_superminhash": OP5_SQL,
    "op6_benchmark_leaks": OP6_SQL,
    "op8_repetition_rules": OP8_SQL,
}
