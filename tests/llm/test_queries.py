"""Each registered query against its brute-force version on the small tables, and its SQL on the driver's."""

import hashlib
import random
import re
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cloakframe.llm import bwt_dedup, edit_counts, licenses, packing, pii, queries, superminhash, wavelet

from . import brute


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(queries.word_tokenizer())


def ids_of(plain, docs):
    return {i: [*plain.encode(t or "", add_special_tokens=False).ids, 1] for i, t in docs.items()}


def rows(df, *cols):
    return {r["doc_id"]: tuple(r[c] for c in cols) for r in df.collect()}


def test_op1(spark, sf):
    d, docs, _, _ = sf
    got = {r["doc_id"]: r for r in queries.op1_feistel_pseudonyms(spark, d).collect()}
    assert set(got) == set(docs)
    for i, t in docs.items():
        if t and "@mail3" in t:
            new = got[i]["text"]
            assert got[i]["n_replaced"] == 4 and not re.search(r"bob\.7@|4785380592391139|743\) 555-3824|10\.20\.30\.40", new)
            assert re.search(r"mail [a-z]{3}\.\d@mail3\.example\.com card \d{16} call \+1 \(\d{3}\) \d{3}-\d{4} at \d+\.\d+\.\d+\.\d+ ", new)
        else:
            assert got[i]["text"] == t and got[i]["n_replaced"] == 0


def test_op1_against_plain_networks(spark, sf, tmp_path):
    """Texts and kinds equal those of a version that walks through the matches in plain Python."""
    d, docs, _, _ = sf
    texts = [t for t in docs.values() if t is None or len(t) < 5000]
    texts += ["IBAN DE89370400440532013000 and GB82 WEST 1234 5698 7654 32, DE89370400440532013001", "1990-02-28 28/02/1990 02/28/1990 28.02.1990 12/11/2001 1990-02-30 1899-01-01", "123-45-6789 666-12-1234 667-01-0001 899-99-9999"]
    texts += ["4785 3805 9239 1139 4785380592391138 4785-3805-9239-1139", "+49 30 1234567 743-555-3824 (743) 555-3824 +1 743.555.3824 143-555-3824 +1 143-555-3824", "1.2.3.256 1.2.3.4 255.255.255.255", "A.B9@x.org ción.é7@mail.co.uk ünïcödé@x.org 中文@x.org абв12@x.org"]
    texts += ["a" * 60 + "@x.org " + "7" * 70 + "z@x.org", "é@x.org İx@x.org ß@x.org ²@x.org 𝒜b@x.org", "", " @ @x.org a@b"]
    data = list(enumerate(texts))
    got = {r["doc_id"]: (r["text"], list(r["pii"])) for r in pii.pseudonymize(spark.createDataFrame(data, "doc_id long, text string"), "k").collect()}
    assert got == {i: brute.pseudonyms(t, "k") for i, t in data}
    if Path("/root/testdata/sf0.001").exists():
        table = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
        got = {r["doc_id"]: (r["text"], r["n_replaced"]) for r in queries.op1_feistel_pseudonyms(spark, "/root/testdata/sf0.001").collect()}
        want = {i: brute.pseudonyms(t, queries.PII_KEY) for i, t in table.items()}
        assert got == {i: (t, len(k)) for i, (t, k) in want.items()} and sum(len(k) for _, k in want.values()) > 20


def test_different_names_stay_apart(spark):
    """All names of one letter of several scripts, pairs of them, and names longer than a network takes."""
    scripts = [[chr(c) for c in range(a, b) if chr(c).isalpha() and chr(c).lower() == chr(c)] for a, b in ((0xDF, 0x100), (0x3AC, 0x3CF), (0x430, 0x450), (0x5D0, 0x5EB), (0x4E00, 0x4E40), (0x30A1, 0x30D0))]
    names = [c for s in scripts for c in s] + [a + b for s in scripts for a in s[:12] for b in s[:12]] + [f"{a}x{b}" for a in "éüñ" for b in "abcdefgé"]
    names += ["a" * 30 + x for x in "abcdefgh"] + [x + "a" * 30 for x in "bcdefgh"] + ["1" * 40 + x for x in "0123456789"]
    out = pii.pseudonymize(spark.createDataFrame([(f"{n}@x.org",) for n in names], "text string"), "k").select("text").collect()
    made = [r["text"].split("@")[0] for r in out]
    assert len(set(made)) == len(set(names)) == len(names)
    assert all(len(m) == len(n) and [c.isascii() for c in m] == [c.isascii() for c in n] for m, n in zip(made, names, strict=True))
    assert sum(m == n for m, n in zip(made, names, strict=True)) < 0.1 * len(names)


def test_pseudonyms_beside_columns_of_any_name(spark):
    df = spark.createDataFrame([("a@x.org", 1, 2, 3, 4)], "text string, pii int, __mail int, __first int, __NUMBER int")
    out = pii.pseudonymize(df, "k")
    assert out.columns == ["text", "__mail", "__first", "__NUMBER", "pii"] and out.first()["pii"] == ["email"]


def test_op2(spark, sf, plain):
    d, docs, _, _ = sf
    want, seen, bins, loss = ids_of(plain, docs), {}, {}, {}
    heads = {i: len(plain.encode(t.split("\n")[0], add_special_tokens=False).ids) if t and "\n" in t else 0 for i, t in docs.items()}
    for r in queries.op2_vector_packing(spark, d).collect():
        assert r["loss_tokens"] == sum(k >= heads[r["doc_id"]] for k in range(r["start"], r["start"] + r["length"]))
        loss[r["sequence_id"]] = loss.get(r["sequence_id"], 0) + r["loss_tokens"]
        assert r["doc_tokens"] == len(want[r["doc_id"]])
        assert r["ids_crc32"] == brute.crc(want[r["doc_id"]][r["start"] : r["start"] + r["length"]])
        seen.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans, total in [(seen[i], len(want[i])) for i in want] + [(b, None) for b in bins.values()]:
        at = 0
        for s, n in sorted(spans):
            assert s == at and n > 0
            at += n
        assert at == total if total else at <= 2048
    sizes = [sum(n for _, n in b) for b in bins.values()]
    assert all(n in {1 << k for k in range(12)} or n >= 2048 - 16 for n in sizes) and 0 < sum(heads.values())
    assert max(loss.values()) <= 1984 and max(map(len, bins.values())) <= 256


def test_op2_tiny_texts(spark):
    """4,096 texts of three tokens: segments bind, and under 1 % is padding."""
    df = spark.createDataFrame([(i, "ab cd") for i in range(4096)], "doc_id long, text string").coalesce(1)
    rows = packing.pack(df, queries.word_tokenizer(), queries.PACKED).collect()
    assert sum(r["length"] for r in rows) == 3 * 4096 and sum(r["padding"] for r in rows) < 0.01 * 3 * 4096


def test_op2_with_a_tokenizer_that_keeps_white_space(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["Hello  world.\n\tfoo bar", None, "", " x " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain, got = Tokenizer.from_file(path), {}
    for r in packing.pack(df, path).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["ids"]))
    assert {i: b"".join(x for _, x in sorted(v)) for i, v in got.items()} == {i: np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for i, t in enumerate(texts)}


def test_op3(spark, sf, plain):
    d, docs, _, _ = sf
    out = queries.op3_edit_counts(spark, d).collect()
    table = spark.read.parquet(f"{d}/documents.parquet")
    edits = {r["doc_id"]: r["e"] for r in table.select("doc_id", queries.sample_edits(F.length(F.coalesce("text", F.lit(""))).cast("long"), "doc_id").alias("e")).collect()}
    for r in out:
        t = docs[r["doc_id"]] or ""
        assert r["n_tokens_before"] == len(plain.encode(t, add_special_tokens=False).ids)
        for e in edits[r["doc_id"]]:
            a = min(e["start"], len(t))
            t = t[:a] + e["new"] + t[a + e["length"] :]
        assert (r["n_tokens"], r["n_chars"], r["edited_sha256"]) == (len(plain.encode(t, add_special_tokens=False).ids), len(t), hashlib.sha256(t.encode()).hexdigest())
    assert max(r["n_chars_reencoded"] for r in out if r["n_chars"] > 20_000) < 10_000


def test_kept_trees_are_updated_again(spark, plain):
    """Two updates in a row, on trees that were written and read in between; the second finds what the first left."""
    texts = {1: "one two three " * 300, 2: None, 3: "", 4: "x" * 3000, None: "no id"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    trees = queries.stored(edit_counts.plant(docs, queries.word_tokenizer()), "t")
    edit = lambda *e: F.expr("array(" + ", ".join(f"named_struct('start', {a}, 'length', {n}, 'new', '{x}')" for a, n, x in e) + ")")
    for edits in ([(0, 3, "ONE!"), (9**9, 0, " end"), (5, 4, "")], [(2, 1, "a b"), (9**9, 0, "ing")]):
        trees = queries.stored(edit_counts.update_counts(trees.withColumn("edits", edit(*edits)), queries.word_tokenizer()), "t")
        for k, t in texts.items():
            for a, n, x in edits:
                t = (t or "")[: min(a, len(t or ""))] + x + (t or "")[min(a, len(t or "")) + n :]
            texts[k] = t
        for r in trees.collect():
            t = texts[r["doc_id"]]
            assert "".join(r["leaves"]) == t and r["n_tokens"] == len(plain.encode(t, add_special_tokens=False).ids) and r["n_chars"] == len(t)
            assert r["n_chars_reencoded"] < 2000 or r["doc_id"] == 4


def test_trees_refuse_tokenizers_that_keep_white_space(spark):
    import public_tokenizers

    with pytest.raises(Exception, match="keeps white space"):
        edit_counts.plant(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), public_tokenizers.path("byte_bpe_50k.json")).collect()


def test_op4(spark, sf, plain):
    d, docs, _, _ = sf
    want, at = {}, 0
    for i, ids in sorted(ids_of(plain, docs).items()):
        want[i] = (at, len(ids), brute.crc(ids))
        at += len(ids)
    assert rows(queries.op4_wavelet_shards(spark, d), "start", "n_tokens", "ids_crc32") == want


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_op4_counts_and_places(spark, sf, name):
    """Counts and places of ids over all shards, with small shards, and with a tokenizer that keeps white space."""
    import public_tokenizers

    d, docs, _, _ = sf
    path, out = public_tokenizers.path(name), queries.new_path(spark, "s")
    wavelet.write_shards(queries.stored(wavelet.tokenized(spark.read.parquet(f"{d}/documents.parquet"), path), "t"), out, 3, 2000)
    ids = ids_of(Tokenizer.from_file(path), docs)
    assert rows(wavelet.read_shards(spark, out), "n_tokens", "ids_crc32", "n_end_ids") == {i: (len(x), brute.crc(x), x.count(1)) for i, x in ids.items()}
    asked = [1, 269, next(iter(ids.values()))[0], 65_000, 1 << 30]
    assert {tuple(r) for r in wavelet.count_ids(spark, out, asked).collect()} == {(k, sum(x.count(k) for x in ids.values())) for k in asked}
    assert {tuple(r) for r in wavelet.find_ids(spark, out, asked).collect()} == {(k, i, p) for k in asked for i, x in ids.items() for p, y in enumerate(x) if y == k}


def test_op4_wide_ids(spark):
    """Ids of over 16 bits, in tokens of four bytes."""
    ids = np.array([70_000, 1, 70_000, 2**31, 5, 1], "<u4")
    df = spark.createDataFrame([(1, 4, bytearray(ids[:2].tobytes())), (2, 4, bytearray(ids[2:].tobytes()))], "doc_id long, width int, ids binary")
    out = queries.new_path(spark, "s")
    wavelet.write_shards(queries.stored(df, "t"), out, 1)
    assert rows(wavelet.read_shards(spark, out), "start", "n_tokens", "ids_crc32") == {1: (0, 2, brute.crc(ids[:2])), 2: (2, 4, brute.crc(ids[2:]))}
    assert {tuple(r) for r in wavelet.find_ids(spark, out, [70_000]).collect()} == {(70_000, 1, 0), (70_000, 2, 0)}


def test_op4_edges(spark, edges, nothing, plain):
    """Nulls, empty, long and repeated texts, rows without an id, and an empty table."""
    for df in (edges, nothing):
        out = queries.new_path(spark, "s")
        wavelet.write_shards(queries.stored(wavelet.tokenized(df, queries.word_tokenizer()), "t"), out, 2, 100)
        got = sorted((r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in wavelet.read_shards(spark, out).collect())
        ids = [(r["doc_id"] or 0, [*plain.encode(r["text"] or "", add_special_tokens=False).ids, 1]) for r in df.select("doc_id", "text").collect()]
        assert got == sorted((i, len(x), brute.crc(x)) for i, x in ids)


def test_op5(spark, sf):
    d, docs, _, _ = sf
    want = brute.groups(docs)
    assert len({v[1] for v in want.values()}) < len(want)
    assert rows(queries.op5_superminhash(spark, d), "n_shingles", "component_id", "kept") == want


def test_op5_large_buckets(spark, sf):
    """Round 2 by rare prefixes finds what pairs of whole buckets find."""
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(150)]
    docs = {}
    for i in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 7)):
            w[rng.randrange(150)] = rng.choice(["q", f"z{rng.randint(0, 30)}", f"n{rng.randint(0, 10**6)}"])
        docs[i] = " ".join(w)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    want = brute.groups(docs)
    for small in (0, 1000):
        assert rows(superminhash.near_duplicates(df, small=small), "n_shingles", "component_id", "kept") == want


def test_one_id_with_two_texts(spark):
    """Links go by the text: documents that share only an id stay apart, in the operator and in the pipeline's stage."""
    rng = random.Random(1)
    a, b, c = ("".join(f"{rng.randint(0, 10**6)} " for _ in range(40)) for _ in range(3))
    data = [(1, a), (1, b), (2, a), (3, b), (4, c), (4, c), (2, c + "x"), (None, a), (None, a), (5, c.upper())]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"], r["component_id"], r["stays"]) for r in superminhash.classified(df).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 2, False), (4, 2, False), (2, 2, True), (5, 2, False), (None, None, True), (None, None, True)], key=str)
    left = corpus_pipeline.near_duplicates(spark, df, "").select("doc_id", "text").collect()
    assert sorted(map(tuple, left), key=str) == sorted([(1, a), (1, b), (2, c + "x"), (None, a), (None, a)], key=str)
    once = corpus_pipeline.near_duplicates(spark, df.where("doc_id = 4"), "").collect()
    assert len(once) == 1


def test_pairs_of_a_large_group_with_an_outsider(spark):
    """20,000 classes of one group and two outsiders share an element: 40,001 pairs, not 200 million."""
    rows = spark.range(20_000).select(F.col("id").alias("cid"), F.lit(100).alias("n"), F.lit(0).alias("grp"), F.lit(100).alias("rest"), F.lit(7).alias("element"))
    rows = rows.union(spark.createDataFrame([(20_000, 100, 20_000, 100, 7), (20_001, 100, 20_001, 100, 7), (20_002, 50, 20_002, 50, 7), (20_003, 100, 20_003, 100, 8)], "cid long, n int, grp int, rest int, element int"))
    got = superminhash.cross_pairs(rows, 85)
    assert got.count() == 40_001 and got.where("a >= b or b < 20000").count() == 0
    assert got.where("a >= 20000").collect() == [(20_000, 20_001)]


def test_near_copies_of_one_text_and_an_outsider(spark):
    rng = random.Random(2)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(100)]
    data = [(10 + i, " ".join(base[:50] + [f"q{i}"] + base[51:])) for i in range(1500)] + [(1, " ".join(base[:60] + [f"z{i}" for i in range(40)])), (2, " ".join(base[:48] + ["q1", "q2", "q3"] + base[51:]))]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in superminhash.near_duplicates(df, salt=50).collect()}
    sets = brute.shingle_sets({1: data[-2][1], 2: data[-1][1], 10: data[0][1]})
    close = 100 * len(sets[2] & sets[10]) >= 85 * len(sets[2] | sets[10])
    assert got[1] == 1 and {got[i] for i in range(10, 1510)} == {2 if close else 10}


def test_op6(spark, sf):
    d, docs, bench, _ = sf
    want = brute.leaks(docs, bench)
    assert any(v[4] for v in want.values())
    assert rows(queries.op6_benchmark_leaks(spark, d), "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want


def test_op6_blocks_and_offsets(spark, sf):
    from cloakframe.llm import decontam

    d, docs, bench, _ = sf
    t, b = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    one, *more = (sorted(decontam.find_leaks(t, b, block_chars=n, run_chars=m).collect(), key=lambda r: r["doc_id"]) for n, m in ((10**6, 0), (40, 1 << 20), (40, 100)))
    assert more == [one, one]
    for r in one:
        for run in r["runs"]:
            words = brute.ALNUM.findall(docs[r["doc_id"]][run["start"] : run["end"]])
            assert len(brute.ALNUM.findall(docs[r["doc_id"]][run["start"] : run["end"]].translate(brute.LOW))) == run["past"] - run["first"] and words
    with pytest.raises(ValueError, match="characters"):
        decontam.find_leaks(t, b, most_chars=10)


def test_op6_edges(spark, edges, nothing):
    """Nulls, empty, long and repeated texts, rows without an id; empty tables and an empty benchmark."""
    from cloakframe.llm import decontam

    b = spark.createDataFrame([(1, "same text that is repeated here for all to see"), (None, "row without an id"), (2, None), (3, "")], "item_id long, text string")
    got = {(r["doc_id"], r["n_words"], sum(x["past"] - x["first"] for x in r["runs"]), tuple(r["items"])) for r in decontam.find_leaks(edges, b).collect()}
    assert got == {(1, 0, 0, ()), (2, 0, 0, ()), (3, 0, 0, ()), (4, 10, 10, (1,)), (5, 10, 10, (1,)), (None, 5, 4, (None,)), (6, 1, 0, ()), (7, 30_000, 0, ())}
    assert decontam.find_leaks(edges, b).count() == edges.count() and decontam.find_leaks(nothing, b).count() == 0
    assert all(r["runs"] == r["items"] == [] for r in decontam.find_leaks(edges, b.where("false")).collect())
    clash = edges.withColumn("__text", F.lit(1)).withColumn("__b_n_words", F.lit(2))
    assert decontam.annotate(clash, b, prefix="new_").columns == [*clash.columns, "new_n_words", "new_runs", "new_items"]


def test_op7(spark, sf):
    d, docs, _, _ = sf
    want = brute.passages(docs)
    assert sum(v[1] for v in want.values()) > 1000
    assert rows(queries.op7_repeated_passages(spark, d), "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    table = spark.read.parquet(f"{d}/documents.parquet")
    for crowd, size, parts in ((2, 40, 1), (4096, 33, 7)):
        got = bwt_dedup.deduplicate(table.repartition(parts), size, crowd=crowd, buckets=3)
        assert rows(got, "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.passages(docs, size)


def test_op7_crowded_anchors(spark):
    """A 40-byte passage in different surroundings, of which some are shared by two documents, and a log with lines that differ in a number."""
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    middle, sides = word(40), [word(70) for _ in range(6)]
    docs = {i: (rng.choice(sides) if rng.random() < 0.5 else word(70)) + middle + (rng.choice(sides) if rng.random() < 0.5 else word(70)) for i in range(120)}
    docs |= {200 + i: f"line {rng.randint(0, 99):03d} of a log that says the same thing each time it writes, but for the number at the start, the end: {rng.randint(0, 9)}" for i in range(80)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    want = brute.passages(docs)
    assert 2000 < sum(v[1] for v in want.values()) < sum(v[0] for v in want.values())
    for crowd in (1, 40):
        assert rows(bwt_dedup.deduplicate(df, crowd=crowd, buckets=3), "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_op8(spark, sf):
    d, docs, _, _ = sf
    want = brute.quality(docs)
    assert {v[5] for v in want.values()} == {True, False}
    assert rows(queries.op8_repetition_rules(spark, d), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept") == want


def test_op8_edges(spark, edges, nothing):
    """Nulls, empty, long and repeated texts, rows without an id; an empty table; a rule of its own."""
    from cloakframe.llm import repetition

    got = {(r["doc_id"], r["n_words"], r["word_chars"], r["n_repeat_words"]) for r in repetition.measure(edges).collect()}
    assert got == {(1, 0, 0, 0), (2, 0, 0, 0), (3, 0, 0, 0), (4, 10, 37, 0), (5, 10, 37, 0), (None, 5, 15, 0), (6, 1, 200_000, 0), (7, 30_000, 30_000, 30_000)}
    assert repetition.measure(edges).count() == edges.count() and repetition.measure(nothing).count() == 0
    tight = repetition.verdicts(repetition.Rules(max_covered=0.0))[1]
    rows = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(100))), (2, " ".join(f"w{i % 80}" for i in range(100)))], "doc_id long, text string")
    assert [r["k"] for r in repetition.measure(rows).orderBy("doc_id").select(tight.alias("k")).collect()] == [True, False]
    clash = edges.withColumn("__q_n_words", F.lit(1)).withColumn("__text", F.lit(2))
    assert repetition.annotate(clash, prefix="own_").columns[: len(clash.columns)] == clash.columns


def test_op9(spark, sf):
    d, _, _, conv = sf
    want = brute.chats([*conv, *queries.ADDED])
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in queries.op9_chat_windows(spark, d).collect()}
    assert got == want


def test_op9_edges(spark):
    """Nulls in every column, repeated rows, one id for all, a very long conversation, columns with clashing names, an empty table."""
    from cloakframe.llm import chat

    conv = [(None, 0, "user", "a"), (None, None, None, None), (1, 0, "system", "s"), (1, 1, "assistant", "x"), (1, 1, "assistant", "x"), (1, 1, "assistant", "x"), (2, 0, "assistant", ""), (3, 0, "system", "word " * 3000)]
    conv += [(9, i, ["user", "assistant"][i % 2], f"turn {i} " * (i % 40)) for i in range(3000)]
    df = spark.createDataFrame(conv, "conv_id long, turn long, role string, text string").withColumn("window", F.lit(1)).withColumn("hash", F.lit(2)).withColumn("tokens", F.lit("z"))
    out = queries.stored(chat.format_windows(df, queries.word_tokenizer(), 200, 50), "w")
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in queries.read_windows(out).collect()}
    assert got == brute.chats(conv) and out.where("conv_id = 9").count() > 100
    assert out.where("n_tokens > 200 and conv_id <> 3").select("n_repeated").distinct().count() <= 1
    assert chat.format_windows(df.where("false"), queries.word_tokenizer()).count() == 0


def test_op10(spark, sf):
    d, docs, _, _ = sf
    got = {r["doc_id"]: r for r in queries.op10_license_scan(spark, d).collect()}
    assert set(got) == set(docs)
    for i, t in docs.items():
        names = ["MIT-notice"] * (t or "").count("Released under the MIT License.") + ["Apache-2.0-notice"] * (t or "").count("Licensed under the Apache")
        assert got[i]["licenses"] == ",".join(names) and got[i]["n_words"] == len(licenses.words_of(t))


LINES = {"All rights reserved.": "all-rights-reserved", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0-notice", "Licensed under the Apache License, Version 2.0.": "Apache-2.0-notice", "Released under the MIT License.": "MIT-notice", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-notice"}


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no tables")
def test_op10_finds_every_notice_line(spark):
    """Each line of the tables that is a notice, by its name and in the order of the lines."""
    d = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    want = {i: ",".join(LINES[x] for x in t.split("\n") if x in LINES) for i, t in docs.items()}
    assert set(",".join(filter(None, want.values())).split(",")) == set(LINES.values())
    assert {r["doc_id"]: r["licenses"] for r in queries.op10_license_scan(spark, d).collect()} == want


def test_rights_reserved(spark):
    texts = ["All rights reserved.", "Copyright (c) 2019-2021 John Smith, Jane Doe and others. All rights reserved. All rights reserved.", "all rights", None]
    got = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [[texts[r["doc_id"]][x["start"] : x["end"]] for x in r["licenses"]] for r in got] == [["All rights reserved"], ["All rights reserved"] * 2, [], []]


def test_pipeline(spark, sf, plain):
    d, docs, bench, _ = sf
    kept = {i: docs[i] for i, v in brute.quality(docs).items() if v[6]}
    kept = {i: kept[i] for i, v in brute.groups(kept).items() if v[2]}
    kept = {i: kept[i] for i, v in brute.leaks(kept, bench).items() if not v[4]}
    table = spark.createDataFrame(list(kept.items()), "doc_id long, text string")
    texts = {r["doc_id"]: r["text"] for r in pii.pseudonymize(table, queries.PII_KEY).collect()}
    want = {i: (len(x), brute.crc(x)) for i, x in ids_of(plain, texts).items()}
    got = {}
    for r in corpus_pipeline.run(spark, d).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["ids"]))
    joined = {i: np.frombuffer(b"".join(x for _, x in sorted(v)), "<u4") for i, v in got.items()}
    assert {i: (len(x), brute.crc(x)) for i, x in joined.items()} == want and 10 < len(want) < len(docs)
    stage = spark.read.parquet(f"{d}/documents.parquet")
    for _, f in corpus_pipeline.STAGES[:-1]:
        assert f(spark, stage, d).columns == stage.columns


OPERATORS = {
    "pii": lambda df: pii.pseudonymize(df, "k"),
    "pack": lambda df: packing.pack(df, queries.word_tokenizer()),
    "edits": lambda df: edit_counts.update_counts(edit_counts.plant(df, queries.word_tokenizer()).withColumn("edits", F.expr("CASE WHEN doc_id > 3 THEN array(named_struct('start', 3L, 'length', 2L, 'new', 'q'), null, named_struct('start', null, 'length', null, 'new', null)) END")), queries.word_tokenizer()),
    "near": superminhash.near_duplicates,
    "dedup": bwt_dedup.deduplicate,
    "licenses": licenses.scan_licenses,
    "tokens": lambda df: wavelet.tokenized(df, queries.word_tokenizer()),
    **{f"stage_{n}": (lambda df, f=f: f(df.sparkSession, df, "/root/testdata/sf0.001")) for n, f in corpus_pipeline.STAGES},
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_edges_and_empty_tables(edges, nothing, name):
    assert OPERATORS[name](nothing).count() == 0
    out = OPERATORS[name](edges)
    ids = [r["doc_id"] for r in out.select("doc_id").collect()]
    if name in ("pii", "edits", "near", "dedup", "licenses", "tokens", "stage_pii"):
        assert sorted(ids, key=str) == sorted((r["doc_id"] for r in edges.select("doc_id").collect()), key=str)
    if name == "near":
        kept = {(r["doc_id"], r["component_id"], r["kept"]) for r in out.collect()}
        assert {(4, 4, True), (5, 4, False), (None, None, True), (1, 1, True)} <= kept
    if name == "dedup":
        by = {r["doc_id"]: r for r in out.collect()}
        assert by[6]["n_removed"] == 200_000 - 1 and by[7]["n_removed"] == 60_000 - 2 and by[1]["n_bytes"] == 0


def test_pseudonyms(spark):
    texts = ["IBAN DE89370400440532013000 and DE89370400440532013001", "DE89 3704 0044 0532 0130 00", "1990-02-28 28/02/1990 28.02.1990 1990-02-30 1990-13-01", "123-45-6789 666-12-1234", "4785 3805 9239 1139 4785380592391138", "+49 30 1234567 743-555-3824", "1.2.3.256 1.2.3.4", "A.B9@x.org a.b9@x.org ción@x.org @x.org İx@x.org"]
    got = [r["text"] for r in pii.pseudonymize(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), "k").orderBy("doc_id").collect()]
    iban = re.search(r"DE\d{20}", got[0])[0]
    assert int(iban[4:] + "1314" + iban[2:4]) % 97 == 1 and "DE89370400440532013001" in got[0]
    assert got[1].replace(" ", "") == iban and got[1].count(" ") == 5
    iso, slash, dot, bad1, bad2 = got[2].split()
    assert iso.split("-")[::-1] == slash.split("/") == dot.split(".") and iso != "1990-02-28" and (bad1, bad2) == ("1990-02-30", "1990-13-01")
    assert re.fullmatch(r"\d{3}-\d\d-\d{4} 666-12-1234", got[3]) and not got[3].startswith("123-45")
    card, other = got[4].rsplit(" ", 1)
    digits = [int(x) for x in card.replace(" ", "")][::-1]
    assert sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(digits)) % 10 == 0 and other == "4785380592391138"
    assert re.fullmatch(r"\+49 \d\d \d{7} [2-9]\d\d-[2-9]\d\d-\d{4}", got[5])
    assert got[6].startswith("1.2.3.256 ") and got[6] != texts[6]
    a, b, c, d, e = got[7].split()
    assert e.count("@") == 1 and e.endswith("@x.org") and e[0] != "İ"
    assert a == b != "a.b9@x.org" and len(c) == len("ción@x.org") and d == "@x.org"
    key2 = [r["text"] for r in pii.pseudonymize(spark.createDataFrame([(0, texts[1])], "doc_id int, text string"), "other").collect()]
    assert key2 != [got[1]]


@pytest.mark.parametrize(("size", "tweak"), [(73049, "date"), (1000, "x"), (7, "y")])
def test_permutations(spark, size, tweak):
    out = spark.range(size).select(pii.permute(F.col("id"), size, "k", tweak).alias("x")).agg(F.count_distinct("x"), F.min("x"), F.max("x")).first()
    assert tuple(out) == (size, 0, size - 1)


def test_dates_stay_apart(spark):
    """Each day of 200 years, written with slashes: days after the 12th once day first, once month first."""
    days = spark.range(73049).select(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    texts = days.select(F.date_format("d", "dd/MM/yyyy").alias("text")).union(days.where("dayofmonth(d) > 12").select(F.date_format("d", "MM/dd/yyyy")))
    out = pii.pseudonymize(texts, "k").agg(F.count("*"), F.count_distinct("text"), F.sum(F.size("pii"))).first()
    assert out[0] == out[1] == out[2] == 73049 + 73049 - 200 * 12 * 12


def test_permuted_digits_and_letters(spark):
    for n in (1, 2, 3):
        out = spark.range(10**n).select(pii.permute_digits(F.lpad(F.col("id").cast("string"), n, "0"), "k", "t").alias("x"))
        assert out.distinct().count() == 10**n and out.where(F.length("x") != n).count() == 0
    two = spark.range(676).select(F.concat(F.char((F.col("id") / 26).cast("int") + 97), F.char(F.col("id") % 26 + 97)).alias("s"))
    assert two.select(pii._letters26(F.col("s"), "k").alias("x")).where("x rlike '^[a-z]{2}$'").distinct().count() == 676


DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DIR).exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    c = duckdb.connect()
    for p in Path(DIR).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    a, b = queries.QUERIES[name](spark, DIR).toPandas(), c.sql(queries.ORACLES[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    assert sorted(map(str, a[cols].itertuples(index=False, name=None))) == sorted(map(str, b[cols].itertuples(index=False, name=None)))
