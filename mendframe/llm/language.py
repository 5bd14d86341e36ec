"""Language identification by interpolated Kneser-Ney character models, one a language, in shared sorted hash arrays.

Texts are lower-cased, letters stay and every run of other characters is one blank. For each order the n-grams that any
language has seen stand in one sorted array of 64-bit hashes, with a row of log probabilities by language; contexts and
their back-off weights stand in another. A text's cross-entropy per character under each model comes from binary
searches: n-grams that no language has seen go on to the next lower order. The lowest cross-entropy wins.

Rejection is calibrated on chunks that the counts leave out: a text is rejected if its cross-entropy lies DEVIATIONS
standard deviations (widened for short texts) and MARGIN nats above the mean of its language's chunks. score is the
posterior of the winner over the other languages times how far within that limit it lies, 0.5 at the limit.

Models learn from a bounded sample of labelled rows: CHUNKS chunks of CHUNK characters a language, ALL_CHUNKS in all,
dealt by a hash from whole texts; every text is scored whole.

Defined cases: texts that are null or have no letter are `und` with score 0 and rejected, as is every text if nothing
is labelled; equal texts get equal results; an empty table gives an empty result; extra columns stay.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mendframe.llm.shared import slices, small_batches, tidied

ORDER = 4
CHUNK = 400
CHUNKS = 3000
ALL_CHUNKS = 60_000
HELD_BACK = 10
DEVIATIONS = 8.0
WIDEST = 1.5
MARGIN = 0.5
SCORED_AT_ONCE = 1 << 18
UNDETERMINED = "und"
BLANK = 32


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """The lower-case form of each code point that is a letter, and a blank for all others."""
    out = np.full(0x110000, BLANK, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def symbols_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts, each text led by a blank, where each begins (one more at the end), and its letters' count."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lengths = np.asarray(pc.utf8_length(texts)).astype(np.int64)
    points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    plain = letter_table()[points]
    owner = np.repeat(np.arange(len(lengths)), lengths)
    blank = plain == BLANK
    first = np.zeros(len(plain), bool)
    begin = np.cumsum(lengths) - lengths
    first[begin[lengths > 0]] = True
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1] & ~first[1:]  # of a run of blanks the first stays, and none at the text's start
    plain, owner = plain[keep], owner[keep]
    letters = np.bincount(owner[plain != BLANK], minlength=len(lengths))
    sizes = np.bincount(owner, minlength=len(lengths)) + 1
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    out = np.full(starts[-1], BLANK, np.uint32)
    led = np.ones(len(out), bool)
    led[starts[:-1]] = False
    out[led] = plain
    return out, starts, letters


def spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def gram_hashes(symbols: np.ndarray, starts: np.ndarray, order: int) -> list[np.ndarray]:
    """hashes[k] of the k symbols that end at each position, for k up to order; before a text stand blanks."""
    at = np.arange(len(symbols)) - np.repeat(starts[:-1], np.diff(starts))
    out = [np.zeros(len(symbols), np.uint64)]
    with np.errstate(over="ignore"):
        for k in range(order):
            back = symbols[np.maximum(np.arange(len(symbols)) - k, 0)] if k else symbols
            there = np.where(at >= k, back, BLANK).astype(np.uint64)
            out.append(spread(out[-1] * np.uint64(0x9E3779B97F4A7C15) + there + np.uint64(1)))
    return out


def context_hashes(symbols: np.ndarray, starts: np.ndarray, order: int) -> list[np.ndarray]:
    """hashes[k] of the k symbols before each position."""
    own = gram_hashes(symbols, starts, order)
    blanks = gram_hashes(np.full(1, BLANK, np.uint32), np.array([0, 1]), order)
    out = []
    for k in range(order + 1):
        before = np.empty_like(own[k])
        before[1:] = own[k][:-1]
        before[starts[:-1][np.diff(starts) > 0]] = blanks[k][0]
        out.append(before)
    return out


@dataclass
class Models:
    """Sorted hashes with a row of values by language, for grams of each order and for contexts of each order."""

    languages: list[str]
    gram_keys: list[np.ndarray]
    gram_logs: list[np.ndarray]
    context_keys: list[np.ndarray]
    context_logs: list[np.ndarray]
    floor: np.ndarray
    means: np.ndarray
    spreads: np.ndarray

    def entropies(self, symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Mean negative log probability of a symbol for each text and language."""
        order = len(self.gram_keys) - 1
        total = np.zeros((len(starts) - 1, len(self.languages)))
        ends = np.searchsorted(starts, np.arange(0, starts[-1] + SCORED_AT_ONCE, SCORED_AT_ONCE))
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            b = min(b, len(starts) - 1)
            if b > a:
                piece = starts[a : b + 1]
                total[a:b] = self._sums(symbols[piece[0] : piece[-1]], piece - piece[0], order)
        if ends[-1] < len(starts) - 1:
            piece = starts[ends[-1] :]
            total[ends[-1] :] = self._sums(symbols[piece[0] : piece[-1]], piece - piece[0], order)
        return -total / np.diff(starts)[:, None]

    def _sums(self, symbols: np.ndarray, starts: np.ndarray, order: int) -> np.ndarray:
        grams = gram_hashes(symbols, starts, order)
        logs = np.zeros((len(symbols), len(self.languages)), np.float32)
        left = np.arange(len(symbols))
        contexts = None
        for k in range(order, 0, -1):
            at, found = looked_up(self.gram_keys[k], grams[k][left])
            logs[left[found]] += self.gram_logs[k][at[found]]
            left = left[~found]
            if not len(left):
                break
            if contexts is None:
                contexts = context_hashes(symbols, starts, order - 1)
            at, found = looked_up(self.context_keys[k], contexts[k - 1][left])
            logs[left[found]] += self.context_logs[k][at[found]]
        logs[left] += self.floor
        return np.add.reduceat(logs, starts[:-1], axis=0, dtype=np.float64)

    def limits(self, lengths: np.ndarray, language: np.ndarray) -> np.ndarray:
        """The cross-entropy beyond which a text of so many symbols is rejected."""
        wider = np.clip(np.sqrt(CHUNK / np.maximum(lengths, 1)), 1.0, WIDEST)
        return self.means[language] + DEVIATIONS * self.spreads[language] * wider + MARGIN


def looked_up(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted key stands in the sorted keys, and whether it does."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def fit(samples: dict[str, list[str]], order: int = ORDER) -> Models:
    """Models of chunks by language; every HELD_BACK-th chunk is for calibration alone (none if there are fewer)."""
    languages = sorted(samples)
    count = len(languages)
    told, kept = {}, {}
    for name in languages:
        chunks = sorted(samples[name])
        kept[name] = chunks[::HELD_BACK] if len(chunks) >= 2 * HELD_BACK else chunks
        told[name] = [c for i, c in enumerate(chunks) if i % HELD_BACK] if len(chunks) >= 2 * HELD_BACK else chunks
    grams: list[list[tuple]] = [[] for _ in range(order + 1)]  # by order and language: hash, context hash, suffix hash, count
    for name in languages:
        symbols, starts, _ = symbols_of(pa.array(told[name], pa.string()))
        own, before = gram_hashes(symbols, starts, order), context_hashes(symbols, starts, order)
        for k in range(1, order + 1):
            keys, first, n = np.unique(own[k], return_index=True, return_counts=True)
            grams[k].append((keys, before[k - 1][first], own[k - 1][first], n.astype(np.float64)))
    gram_keys, gram_logs = [np.empty(0, np.uint64)] * (order + 1), [np.empty((0, count), np.float32)] * (order + 1)
    context_keys, context_logs = list(gram_keys), list(gram_logs)
    alphabet = max(2, len(np.unique(np.concatenate([g[0] for g in grams[1]]))) + 1) if languages else 2
    below: list[np.ndarray] = []  # probabilities of the lower order's keys by language, aligned with its union of keys
    floor = np.full(count, -np.log(alphabet))
    union_below = np.empty(0, np.uint64)
    for k in range(1, order + 1):
        union = np.unique(np.concatenate([g[0] for g in grams[k]])) if languages else np.empty(0, np.uint64)
        heads = np.unique(np.concatenate([g[1] for g in grams[k]])) if languages else np.empty(0, np.uint64)
        probability, weight = np.zeros((len(union), count)), np.ones((len(heads), count))
        contexts_of, suffix_of = np.zeros(len(union), np.uint64), np.zeros(len(union), np.uint64)
        for keys, context, _, _ in grams[k]:
            contexts_of[np.searchsorted(union, keys)] = context
        for keys, _, suffix, _ in grams[k]:
            suffix_of[np.searchsorted(union, keys)] = suffix
        for i, (keys, context, _, n) in enumerate(grams[k]):
            if k < order:  # continuation counts: how many symbols come before this gram
                longer_suffix = grams[k + 1][i][2]
                n = np.bincount(np.searchsorted(keys, longer_suffix), minlength=len(keys)).astype(np.float64)
            once, twice = float((n == 1).sum()), float((n == 2).sum())
            discount = once / (once + 2 * twice) if once and twice else 0.5
            at = np.searchsorted(heads, context)
            mass, kinds = np.bincount(at, n, len(heads)), np.bincount(at, minlength=len(heads))
            mass = np.maximum(mass, 1e-9)
            share = np.where(kinds > 0, np.minimum(1.0, discount * kinds / mass), 1.0)
            weight[:, i] = np.maximum(share, 1e-6)
            lower = np.full(len(union), 1.0 / alphabet) if k == 1 else below[-1][np.searchsorted(union_below, suffix_of), i]
            place = np.searchsorted(union, keys)
            probability[:, i] = weight[np.searchsorted(heads, contexts_of), i] * lower
            probability[place, i] += np.maximum(n - discount, 0) / mass[at]
        gram_keys[k], gram_logs[k] = union, np.log(np.maximum(probability, 1e-12)).astype(np.float32)
        context_keys[k], context_logs[k] = heads, np.log(weight).astype(np.float32)
        below.append(probability)
        union_below = union
    models = Models(languages, gram_keys, gram_logs, context_keys, context_logs, floor, np.zeros(count), np.ones(count))
    for i, name in enumerate(languages):
        symbols, starts, letters = symbols_of(pa.array(kept[name], pa.string()))
        own = models.entropies(symbols, starts)[letters > 0, i]
        models.means[i], models.spreads[i] = (own.mean(), max(0.02, own.std())) if len(own) else (0.0, 1.0)
    return models


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample_chunks(docs: DataFrame, chunks: int = CHUNKS, most: int = ALL_CHUNKS) -> dict[str, list[str]]:
    """Chunks of labelled, not held out texts by language: at most about `chunks` a language and `most` in all."""
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    pieces = F.ceil(F.length("text") / CHUNK).cast("int")
    counted = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum(pieces).alias("n")).collect()}  # a row a language
    counted = {k: n for k, n in counted.items() if n}
    if not counted:
        return {}
    goal = max(1, min(chunks, most // len(counted)))
    share = F.create_map(*[F.lit(x) for k, n in counted.items() for x in (k, min(1.0, goal / n))])
    lot = lambda i: F.pmod(F.xxhash64("doc_id", "text", i), F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * float(1 << 30)
    taken = F.filter(F.sequence(F.lit(0), F.greatest(pieces, F.lit(1)) - 1), lot)
    cut = rows.select("lang", "text", F.explode(taken).alias("i")).select("lang", F.substring("text", F.col("i") * CHUNK + 1, F.lit(CHUNK)).alias("chunk"))
    out: dict[str, list[str]] = {}
    for r in cut.toLocalIterator():
        out.setdefault(r["lang"], []).append(r["chunk"])
    return out


def identify(docs: DataFrame, models: Models) -> DataFrame:
    """Adds lang_pred string, score double and rejected boolean to docs, from text alone; columns of these names are replaced."""
    small_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score", "rejected")
    shared = docs.sparkSession.sparkContext.broadcast(models)
    where = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for batch in (part for whole in batches for part in slices(whole, where)):
            symbols, starts, letters = symbols_of(batch.column(where))
            names = np.array([*models.languages, UNDETERMINED], object)
            n = batch.num_rows
            best, score, rejected = np.full(n, len(models.languages)), np.zeros(n), np.ones(n, bool)
            known = letters > 0
            if models.languages and n:
                entropy = models.entropies(symbols, starts)
                lengths = np.diff(starts)
                best = np.where(known, entropy.argmin(axis=1), best)
                own = entropy.min(axis=1)
                odds = np.exp(-(entropy - own[:, None]) * np.minimum(lengths, 50)[:, None]).sum(axis=1)
                limit = models.limits(lengths, np.where(known, best, 0))
                within = 1 / (1 + np.exp(np.clip((own - limit) / (MARGIN / 4), -50, 50)))
                score = np.where(known, within / odds, 0.0)
                rejected = ~known | (own > limit)
            more = [pa.array(names[best].tolist(), pa.string()), pa.array(score, pa.float64()), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "lang_pred", "score", "rejected"])

    more = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    return docs.mapInArrow(tidied(run), T.StructType([*docs.schema.fields, *more]))


def accepted(docs: DataFrame, models: Models) -> DataFrame:
    """Documents whose language is not rejected, with their own columns."""
    columns = docs.columns
    inner = docs.select(*[F.col(c).alias(c if c == "text" else f"own_{i}") for i, c in enumerate(columns)])
    kept = identify(inner, models).where("not rejected")
    return kept.select(*[F.col("text" if c == "text" else f"own_{i}").alias(c) for i, c in enumerate(columns)])
