import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest


def prose(rng, n):
    part = ["the", "and", "thing", "ou", "er", "ation", "né", "über", "ción", "st"]
    words = ["".join(rng.choice(part) for _ in range(rng.randint(1, 3))) for _ in range(n)]
    return " ".join(w + rng.choice(["", "", "", ",", ".", "!\n"]) for w in words)


@pytest.fixture(scope="session")
def sf(tmp_path_factory):
    """A small copy of the tables with the cases that matter: nulls, empty and long texts, copies, leaks, personal data."""
    rng, d = random.Random(5), tmp_path_factory.mktemp("sf")
    bench = [(i, prose(rng, n)) for i, n in enumerate([30, 12, 10, 4, 1])] + [(5, None), (6, "  !! "), (7, prose(rng, 15))]
    bench += [(8, bench[0][1]), (None, prose(rng, 14)), (None, "zebra quagga okapi"), (10, bench[3][1])]
    base = prose(rng, 120)
    shared = prose(rng, 70)
    texts = [prose(rng, rng.choice([3, 25, 60, 200])) for _ in range(40)]
    texts += [base, base, base + " extra words at the end", base.replace("the", "The", 1), base.upper()]
    texts += [prose(rng, 20) + "\n" + shared + "\n" + prose(rng, 20) for _ in range(6)]
    texts += [prose(rng, 30) + " " + bench[0][1].upper() + " " + prose(rng, 30), bench[1][1], "x " + bench[3][1].replace(" ", "-") + " y"]
    texts += [prose(rng, 12) + " " + bench[9][1] + " " + prose(rng, 12), "a Zebra, quagga; okapi? b"]
    texts += ["line one is here\n" * 30, "word " * 400, None, "", " \n\t ", "one", "a b c", "# $ % & | < > *", "é" * 300]
    texts += [prose(rng, 40) + " mail bob.7@mail3.example.com card 4785380592391139 call +1 (743) 555-3824 at 10.20.30.40 " + prose(rng, 10)]
    texts += [prose(rng, 20) + "\nReleased under the MIT License.\n" + prose(rng, 20) + "\nReleased under the MIT License.", "Licensed under the Apache License, Version 2.0.", prose(rng, 9000)]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    docs = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()), "lang": ["en"] * len(rows), "source": ["s"] * len(rows), "n_chars": pa.array([len(r[1] or "") for r in rows], pa.int64())})
    (d / "documents.parquet").mkdir()
    half = len(rows) // 2
    pq.write_table(docs.slice(0, half), d / "documents.parquet" / "a.parquet")
    pq.write_table(docs.slice(half), d / "documents.parquet" / "b.parquet")
    pq.write_table(pa.table({"item_id": pa.array([b[0] for b in bench], pa.int64()), "text": pa.array([b[1] for b in bench], pa.string())}), d / "benchmark.parquet")
    conv = []
    for c in range(12):
        turns = rng.randint(1, 12)
        for t in range(turns):
            role = "system" if c % 3 == 0 and t == 0 else ["user", "assistant"][t % 2]
            conv.append((c, t, role, rng.choice([prose(rng, rng.choice([5, 80, 400])), "", None, "### user\n\\</turn> \\\\ # < x", "\\"])))
    conv.append((3, 1, "assistant", "a second row for this turn"))
    rng.shuffle(conv)
    pq.write_table(pa.table({"conv_id": pa.array([c[0] for c in conv], pa.int64()), "turn": pa.array([c[1] for c in conv], pa.int64()), "role": [c[2] for c in conv], "text": pa.array([c[3] for c in conv], pa.string())}), d / "conversations.parquet")
    return str(d), dict(rows), bench, conv


EDGES = [(1, None), (2, ""), (3, " \n "), (4, "same text that is repeated here for all to see"), (4, "same text that is repeated here for all to see"), (5, "same text that is repeated here for all to see"), (None, "a row without an id"), (6, "x" * 200_000), (7, "w " * 30_000)]


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls in any column, empty and very long texts, repeated rows, and columns with clashing names."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(EDGES, "doc_id long, text string")
    return df.withColumn("n", F.lit(1)).withColumn("k", F.lit("z")).withColumn("h", F.lit(None).cast("int")).withColumn("ids", F.lit("q")).withColumn("lang", F.lit("en")).withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.length("text").cast("long"))


@pytest.fixture(scope="session")
def nothing(edges):
    return edges.where("false")
