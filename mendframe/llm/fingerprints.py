"""Document fingerprints by one-permutation MinHash with optimal densification (DataFrame functions only).

A text's shingles (five words, fewer words give one shingle) are hashed once; the top bits of a hash name a bin, and
each bin keeps its smallest hash. An empty bin i takes over the bin that comes first in an order fixed by i alone (the
least hash of i and the bin's number), so that equal choices collide exactly as often as optimal densification asks.
Of each bin the low LOW_BITS bits are kept, packed as hexadecimal digits. Two fingerprints agree in a share p of bins;
as unequal bins agree by chance in one of 2^LOW_BITS cases, likeness is (p - c) / (1 - c) with c that chance, at least 0.

Neighbours in descending order of doc_id come from a sort within ranges of ids, not from one sorted list: range bounds
are ids that exist, so a range's last document finds its successor as the bound document of the next range, which is
dealt to both.

Defined cases: null and empty texts, and texts without words, have the empty fingerprint, which is wholly like itself
and wholly unlike others; rows that tie in doc_id are ordered by a hash of the text; equal rows are adjacent; an empty
table gives an empty result; extra columns stay out of the way; a single document is its own successor.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mendframe.llm.shared import own_name, words

SHINGLE = 5
BIN_BITS = 7
LOW_BITS = 8
RANGE_ROWS = 400
MOST_RANGES = 100_000  # from 40 million documents on ranges grow, to some 100,000 documents at 1e10


def bin_of(hashed: Column, bits: int = BIN_BITS) -> Column:
    return F.shiftrightunsigned(hashed, 64 - bits).cast("int")


def shingle_hashes(text: Column, shingle: int = SHINGLE) -> Column:
    """Sorted hashes of all shingles of a text; an empty array without words."""
    split = words(F.lower(text))

    def hashed(own: Column) -> Column:
        last = F.greatest(F.size(own) - (shingle - 1), F.lit(1))
        return F.array_sort(F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(own, i, shingle))))

    return F.transform(F.array(split), lambda own: F.when(F.size(own) > 0, hashed(own)).otherwise(F.array().cast("array<bigint>")))[0]


def bin_minima(hashes: Column, bits: int = BIN_BITS) -> Column:
    """The smallest hash of each bin that has one, from sorted hashes: those whose bin differs from the one before."""
    return F.filter(hashes, lambda h, i: (i == 0) | (bin_of(h, bits) != bin_of(F.get(hashes, i - 1), bits)))


def signature(minima: Column, bits: int = BIN_BITS, low: int = LOW_BITS) -> Column:
    """2^bits low-order values, empty bins filled; an empty array for no minima."""
    mask = (1 << low) - 1

    def value(i: Column, held: Column, bins: Column) -> Column:
        at = F.array_position(bins, i)
        # the order of bins for an empty bin i is that of these hashes; the value to take over rides in the low bits
        borrowed = F.array_min(F.transform(held, lambda h: F.xxhash64(i, bin_of(h, bits)).bitwiseAND(F.lit(~mask)).bitwiseOR(h.bitwiseAND(F.lit(mask)))))
        return F.when(at > 0, F.element_at(held, F.greatest(at, F.lit(1)).cast("int"))).otherwise(borrowed).bitwiseAND(F.lit(mask)).cast("int")

    def filled(pair: Column) -> Column:
        every = F.sequence(F.lit(0), F.lit((1 << bits) - 1))
        return F.transform(every, lambda i: value(i, pair["held"], pair["bins"]))

    pair = F.struct(minima.alias("held"), F.transform(minima, lambda h: bin_of(h, bits)).alias("bins"))
    return F.transform(F.array(pair), lambda p: F.when(F.size(p["held"]) > 0, filled(p)).otherwise(F.array().cast("array<int>")))[0]


def packed(values: Column, low: int = LOW_BITS) -> Column:
    """A signature as hexadecimal digits, LOW_BITS / 4 of them a bin."""
    return F.array_join(F.transform(values, lambda v: F.lower(F.substring(F.hex((v + (1 << low)).cast("long")), 2, low // 4))), "")


def likeness(one: Column, two: Column, low: int = LOW_BITS) -> Column:
    """The estimated Jaccard similarity of two signatures."""
    chance = 1.0 / (1 << low)
    same = F.size(F.filter(F.zip_with(one, two, lambda a, b: a == b), lambda x: x))
    estimate = F.greatest(F.lit(0.0), (same / F.greatest(F.size(one), F.lit(1)) - chance) / (1 - chance))
    empty_one, empty_two = F.size(one) == 0, F.size(two) == 0
    return F.when(empty_one & empty_two, 1.0).when(empty_one | empty_two, 0.0).otherwise(estimate)


def with_signature(docs: DataFrame, text: str, name: str) -> DataFrame:
    """Adds name, the signature of the text column; each step is a column of its own, so none is evaluated twice."""
    out = docs.withColumn(f"{name}_hashes", shingle_hashes(F.col(text)))
    out = out.withColumn(f"{name}_minima", bin_minima(F.col(f"{name}_hashes")))
    return out.withColumn(name, signature(F.col(f"{name}_minima"))).drop(f"{name}_hashes", f"{name}_minima")


def fingerprint(docs: DataFrame) -> DataFrame:
    """Adds fingerprint string to documents; a column of this name is replaced."""
    held = own_name(docs, "signature")
    return with_signature(docs, "text", held).withColumn("fingerprint", packed(F.col(held))).drop(held)


def constants(numbers: list[int]) -> Column:
    """Numbers as one constant array, which is written as a single literal however many there are."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>") if numbers else F.array().cast("array<bigint>")


def range_of(doc_id: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds lie below doc_id, in two short scans instead of one long one."""
    step = max(1, int(len(bounds) ** 0.5))
    jumps = F.size(F.filter(constants(bounds[::step]), lambda b: b < doc_id))
    start = F.greatest(jumps - 1, F.lit(0)) * step
    return (start + F.size(F.filter(F.slice(constants(bounds), start + 1, step), lambda b: b < doc_id))).cast("int")


def with_next(docs: DataFrame, *carried: str) -> DataFrame:
    """Adds next_<column> for each carried column: its value in the next document in descending doc_id, cyclically."""
    summary = docs.agg(F.count("doc_id").alias("n"), F.max("doc_id").alias("largest")).first()
    ranges = max(1, min(MOST_RANGES, summary["n"] // RANGE_ROWS))
    cuts = [i / ranges for i in range(1, ranges)]
    found = docs.agg(F.percentile_approx("doc_id", cuts, 10 * ranges).alias("b")).first()["b"] if cuts else []
    bounds = sorted(set(found or []))
    own = range_of(F.col("doc_id"), bounds) if bounds else F.lit(0)
    # range k holds ids above bound k - 1 up to bound k: that bound is its first document and follows range k + 1
    follows = F.when(F.col("doc_id").eqNullSafe(F.lit(summary["largest"])), 0)
    for_bound = F.when(F.get(constants(bounds), F.col("own_range")) == F.col("doc_id"), F.col("own_range") + 1) if bounds else F.lit(None).cast("int")
    dealt = docs.withColumn("own_range", own)
    dealt = dealt.withColumn("place", F.explode(F.array_compact(F.array(
        F.struct(F.col("own_range").alias("range"), F.lit(False).alias("guest")),
        F.when(for_bound.isNotNull(), F.struct(for_bound.alias("range"), F.lit(True).alias("guest"))),
        F.when(follows.isNotNull(), F.struct(follows.alias("range"), F.lit(True).alias("guest"))),
    ))))
    dealt = dealt.withColumns({"range": F.col("place.range"), "guest": F.col("place.guest"), "tie": F.xxhash64("text")}).drop("place", "own_range")
    # one window over all carried columns at once: its exchange is the only one of texts
    order = W.partitionBy("range").orderBy(F.col("guest"), F.col("doc_id").desc_nulls_last(), F.col("tie"))
    found = dealt.withColumn("next", F.lead(F.struct(*carried)).over(order)).where("not guest")
    return found.select("*", *[F.col(f"next.{c}").alias(f"next_{c}") for c in carried]).drop("range", "guest", "tie", "next")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of documents.

    The edited text has its last third replaced by the beginning of the next document in descending doc_id.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    signed = with_signature(rows, "text", "signature")
    paired = with_next(signed, "text", "signature").withColumn("n_chars", F.length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - third), F.substring("next_text", F.lit(1), third))
    changed = with_signature(paired.withColumn("edited", edited), "edited", "edited_signature")
    return changed.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), packed(F.col("signature")).alias("fingerprint"),
        packed(F.col("edited_signature")).alias("edited_fingerprint"), likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"),
        likeness(F.col("signature"), F.col("next_signature")).alias("near_next"),
    )
