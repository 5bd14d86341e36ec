"""Byte expressions against plain Python."""
import math
import random
from collections import Counter

from pyspark.sql import functions as F

from mendframe.functions import bytes as B
from mendframe.functions.bytes import sampled


def find_all(data, mark):
    out, at = [], data.find(mark)
    while at >= 0:
        out.append(at)
        at = data.find(mark, at + 1)
    return out


def test_positions_and_counts(spark):
    rnd = random.Random(1)
    blobs = [bytes(rnd.choice([0xFF, 0xD8, 0xDA, 0x0A, 0x41]) for _ in range(rnd.randrange(60))) for _ in range(60)] + [b""]
    rows = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(blobs)], "i int, content binary")
    text = B.latin(F.col("content"))
    for mark in ("FFD8", "FFDA", "0A"):
        got = {r["i"]: (r["p"], r["n"]) for r in rows.select("i", B.positions(text, mark).alias("p"), B.count_of(text, mark).alias("n")).collect()}
        want = {i: (find_all(b, bytes.fromhex(mark)), len(find_all(b, bytes.fromhex(mark)))) for i, b in enumerate(blobs)}
        assert got == want


def test_sampling_has_its_edges(spark):
    cases = [(n, limit) for limit in (3, 4, 6, 8, 16, 24) for n in (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 16, 17, 24, 25, 26, 40, 101)]
    rows = spark.createDataFrame([(n, [3 * i for i in range(n)]) for n in sorted({n for n, _ in cases})], "n int, pos array<int>")
    for limit in sorted({c[1] for c in cases}):
        got = {r["n"]: r["s"] for r in rows.select("n", B.sample(F.col("pos"), limit).alias("s")).collect()}
        for n in got:
            assert got[n] == sampled([3 * i for i in range(n)], limit), (n, limit)
    assert len(sampled(list(range(40)), 4)) == 6


def test_entropy_integers_and_errors(spark):
    data = bytes(range(40)) * 3 + b"aaaa"
    row = spark.createDataFrame([(bytearray(data), "a\r\n\n  b \nc\nd\ne" )], "content binary, e string").select(
        B.entropy(F.col("content")).alias("h"), B.little_endian(F.col("content"), F.lit(1)).alias("u"), B.little_endian(F.col("content"), F.lit(len(data) - 2)).alias("past"), B.compact_error(F.col("e")).alias("e")
    ).first()
    want = -sum(c / len(data) * math.log2(c / len(data)) for c in Counter(data).values())
    assert abs(row["h"] - want) < 1e-9 and row["u"] == int.from_bytes(data[1:5], "little") and row["past"] is None
    assert row["e"] == "a | b | c | d"
    long = spark.createDataFrame([("x" * 500,)], "e string").select(B.compact_error(F.col("e"))).first()[0]
    assert len(long) == 400 and long.endswith("...")
