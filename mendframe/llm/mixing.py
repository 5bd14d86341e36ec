"""Mixing sources to target weights by Efraimidis-Spirakis sampling (DataFrame functions only).

Every document gets the key -ln(u) / quality, an exponential variable whose rate is its quality weight; u is a hash of
the document, so reruns agree. Sorted by key, the documents of a source come in the order of weighted sampling without
replacement. A source whose target is several times its size gets whole epochs first (every document once each); the
rest of the target goes down the sorted list, and the document at its end gives only as many leading words as are left.

The sort within a source never meets in one task: keys fall into KEY_BUCKETS buckets by their quantile, buckets are
summed and prefix-summed, and only the rows of one bucket of one source are sorted together.

Defined cases: null or empty texts have size 0 and give 0 words; a null source is a source of its own, last in order;
equal rows share key and place and are taken one after the other; an empty table gives an empty result; extra columns
stay; a source whose texts have no words has target 0.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mendframe.llm.shared import materialise, own_name, word_count, words

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2
KEY_BUCKETS = 1024
QUALITIES = (1.0, 0.25)
TWO_52 = 1 << 52


def word_length_quality(text: Column, size: Column) -> Column:
    """Documents whose mean word has 3 to 12 characters weigh 1, others a quarter."""
    mean = F.length(F.coalesce(text, F.lit(""))) / F.greatest(size, F.lit(1))
    return F.when((mean >= 3) & (mean <= 13), QUALITIES[0]).otherwise(QUALITIES[1])


def uniform(doc_id: Column, text: Column) -> Column:
    """A number in (0, 1), fixed by the document: 52 bits of an MD5."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("\n"), F.coalesce(text, F.lit(""))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(TWO_52)


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """Targets of sources (source, source_size): weights in code point order, filled like water under caps of most * size.

    A source is capped exactly if its cap is at most its weight times the final level; sorted by cap / weight, capped
    sources come first, so the level follows from prefix sums. One row a source: the only global window of this module.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    order = [F.col("fill").asc(), F.col("rank").asc()]
    everything = W.partitionBy(F.lit(0))
    before = everything.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    ranked = (
        totals.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())))
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size").cast("double") * most)
        .withColumn("fill", F.col("cap") / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(everything).cast("double") * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weights_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("weights_left"))
    )
    open_level = F.min(F.when(F.col("fill") > F.col("level"), F.struct("fill", "rank", "level"))).over(everything)
    return ranked.withColumn("final", open_level["level"]).select(
        "source", "source_size", F.least("cap", F.coalesce(F.col("weight") * F.col("final"), F.col("cap"))).alias("target")
    )


def key_bucket(key: Column, buckets: int, qualities: tuple[float, ...] = QUALITIES) -> Column:
    """Buckets in the order of keys: the quantile among equal shares of all qualities.

    Whatever the real shares, a bucket expects at most len(qualities) / buckets of a source's documents.
    """
    beyond = sum((F.exp(-key * q) for q in qualities), F.lit(0.0)) / len(qualities)
    return F.least(F.floor((1.0 - beyond) * buckets), F.lit(buckets - 1)).cast("int")


def mix(rows: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, buckets: int = KEY_BUCKETS) -> DataFrame:
    """Adds source_size, target, epochs, selected and taken to rows (source, size, key and any others); these are replaced.

    epochs is how often the document comes whole, taken the words of all its copies.
    """
    bucket, before, key = (own_name(rows, n) for n in ("bucket", "before", "source_key"))
    rows = rows.drop("source_size", "target", "epochs", "selected", "taken")
    # a key without nulls, by which the join and the window below share one exchange
    keyed = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    kept = materialise(rows.withColumn(bucket, key_bucket(F.col("key"), buckets)), "mix").withColumn(key, keyed)
    per_bucket = kept.groupBy("source", F.col(key).alias("plan_key"), F.col(bucket).alias("plan_bucket")).agg(F.sum("size").alias("words"))
    goals = targets(per_bucket.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share).withColumn("goal_key", keyed).drop("source")
    earlier = W.partitionBy("plan_key").orderBy("plan_bucket").rowsBetween(W.unboundedPreceding, -1)
    places = per_bucket.select("plan_key", "plan_bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("plan_before"))
    # one row a source and bucket at most, so the size of this side is that of sources, not documents
    plan = places.join(goals, F.col("plan_key") == F.col("goal_key")).select("plan_key", "plan_bucket", "plan_before", "source_size", "target")
    found = kept.join(plan, (kept[key] == plan.plan_key) & (kept[bucket] == plan.plan_bucket))
    found = found.select(*[kept[c] for c in kept.columns], plan.plan_before.alias(before), plan.source_size, plan.target)
    within = W.partitionBy(key, bucket).orderBy("key", "size", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    goal = F.floor(F.col("target") + 0.5).cast("long")
    size = F.greatest(F.col("source_size"), F.lit(1))
    return (
        found.withColumn(before, F.col(before) + F.coalesce(F.sum("size").over(within), F.lit(0)))
        .withColumn("epochs", F.floor(goal / size).cast("long"))
        .withColumn("selected", F.greatest(F.lit(0), F.least(F.col("size"), goal - F.col("epochs") * size - F.col(before))))
        .withColumn("taken", F.col("epochs") * F.col("size") + F.col("selected"))
        .drop(before, bucket, key)
    )


def sized(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, source, size, key and the kept columns of documents."""
    quality = word_length_quality(F.col("text"), F.col("size"))
    return (
        docs.withColumn("size", word_count(F.col("text")))
        .withColumn("key", -F.log(uniform(F.col("doc_id"), F.col("text"))) / quality)
        .select("doc_id", "source", "size", "key", *keep)
    )


def repeat_documents(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """The mix itself: documents as often as the mix takes them, the last copy cut to its leading words that are left.

    A cut copy has its words joined by single blanks, and n_chars of its own; whole copies are unchanged. Columns are those of docs.
    """
    names = {c: f"of_{i}" for i, c in enumerate(docs.columns)}
    carried = docs.select("*", *[F.col(c).alias(n) for c, n in names.items()])
    mixed = mix(sized(carried, *names.values()), share)
    copies = F.concat(
        F.array_repeat(F.lit(-1).cast("long"), F.col("epochs").cast("int")),
        F.when(F.col("selected") > 0, F.array(F.col("selected"))).otherwise(F.array().cast("array<bigint>")),
    )
    text = F.col(names["text"])
    out = mixed.withColumn("cut", F.explode(copies))
    is_cut = (F.col("cut") >= 0) & (F.col("cut") < F.col("size"))
    lead = F.array_join(F.slice(words(text), F.lit(1), F.greatest(F.col("cut"), F.lit(0)).cast("int")), " ")
    shown = {c: F.col(n) for c, n in names.items()} | {"text": F.when(is_cut, lead).otherwise(text)}
    if "n_chars" in names:
        shown["n_chars"] = F.when(is_cut, F.length(lead).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(names["n_chars"]))
    return out.select(*[v.alias(c) for c, v in shown.items()])
