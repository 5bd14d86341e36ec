"""Language models against a Kneser-Ney model of dictionaries, and their accuracy on rows that they haven't seen."""
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from mendframe.llm import language

SF = "/root/testdata/sf0.01"


class KneserNey:
    """Interpolated Kneser-Ney with one discount an order, by dictionaries."""

    def __init__(self, texts, order, alphabet):
        self.order, self.alphabet = order, alphabet
        grams = [Counter() for _ in range(order + 1)]
        for t in texts:
            padded = [language.BLANK] * order + t
            for at in range(order, len(padded)):
                for k in range(1, order + 1):
                    grams[k][tuple(padded[at - k + 1 : at + 1])] += 1
        self.tables = [None]
        for k in range(1, order + 1):
            counts = grams[k] if k == order else Counter(g[1:] for g in grams[k + 1])
            once, twice = (sum(n == m for n in counts.values()) for m in (1, 2))
            discount = once / (once + 2 * twice) if once and twice else 0.5
            mass, kinds = Counter(), Counter()
            for g, n in counts.items():
                mass[g[:-1]] += n
                kinds[g[:-1]] += 1
            self.tables.append((counts, discount, mass, kinds))

    def probability(self, gram):
        if not gram:
            return 1 / self.alphabet
        counts, discount, mass, kinds = self.tables[len(gram)]
        lower, context = self.probability(gram[1:]), gram[:-1]
        if context not in mass:
            return lower
        weight = max(1e-6, min(1.0, discount * kinds[context] / mass[context]))
        return max(counts[gram] - discount, 0) / mass[context] + weight * lower

    def entropy(self, text):
        padded = [language.BLANK] * self.order + text
        return -sum(math.log(max(1e-12, self.probability(tuple(padded[at - self.order + 1 : at + 1])))) for at in range(self.order, len(padded))) / len(text)


def symbols(texts):
    flat, starts, _ = language.symbols_of(pa.array(texts, pa.string()))
    return [flat[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)]


def test_models_are_kneser_ney_models():
    rnd = random.Random(3)
    samples = {
        "x": ["".join(rnd.choice("abcde ") for _ in range(60)) for _ in range(6)], "y": ["".join(rnd.choice("deéfgh  ") for _ in range(60)) for _ in range(6)],
        "z": ["aaaa bbbb", "aaaa", "Ab, ab!"],
    }
    asked = [*(t for own in samples.values() for t in own[:2]), "abc fgh qqq", "É", "zzzz", "a" * 40, "déja vu 12 x"]
    for order in (1, 2, 4):
        models = language.fit(samples, order)
        alphabet = len({s for own in samples.values() for t in symbols(own) for s in t}) + 1
        flat, starts, _ = language.symbols_of(pa.array(asked, pa.string()))
        got = models.entropies(flat, starts)
        for i, name in enumerate(models.languages):
            brute = KneserNey(symbols(sorted(samples[name])), order, alphabet)
            want = [brute.entropy(t) for t in symbols(asked)]
            assert np.allclose(got[:, i], want, rtol=1e-4, atol=1e-4), (order, name)


def test_probabilities_sum_to_one():
    samples = {"x": ["abab cab", "bca cab", "abc"], "y": ["xyz", "zyx xyz"]}
    models = language.fit(samples, 3)
    every = sorted({s for own in samples.values() for t in symbols(own) for s in t})
    for head in ("", "a", "ab", "ca", "xy", "zq"):
        base = language.symbols_of(pa.array([head], pa.string()))[0]
        before = -models.entropies(base, np.array([0, len(base)]))[0] * len(base)
        total = np.zeros(2)
        for s in [*every, 0x4E2D]:  # the last stands for any symbol that no model knows
            more = np.append(base, np.uint32(s))
            total += np.exp(-models.entropies(more, np.array([0, len(more)]))[0] * len(more) - before)
        assert np.allclose(total, 1, atol=1e-3), (head, total)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    models = language.fit(language.sample_chunks(docs))
    rows = language.identify(docs.withColumn("unseen", language.held_out(F.col("doc_id"))), models).where("unseen and lang is not null and text is not null").select("lang", "lang_pred", "rejected").collect()
    right, seen = defaultdict(int), defaultdict(int)
    for r in rows:
        seen[r["lang"]] += 1
        right[r["lang"]] += r["lang"] == r["lang_pred"]
    assert len(rows) > 200 and len(seen) >= 4 and all(right[k] >= 0.95 * n for k, n in seen.items()), (dict(right), dict(seen))


def test_clashing_names_and_odd_rows(spark):
    rows = [(i, t, "en" if i % 2 else "fr", "own") for i, t in enumerate(["the cat", "le chat", None, "", "123 !?", "the cat", "the" * 4000])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").withColumns({"lang_pred": F.lit("own"), "rejected": F.lit("own")})
    got = language.identify(docs, language.fit(language.sample_chunks(docs)))
    assert sorted(got.columns) == ["doc_id", "lang", "lang_pred", "rejected", "score", "text"] and dict(got.dtypes)["score"] == "double"
    told = {r["doc_id"]: (r["lang_pred"], r["score"], r["rejected"]) for r in got.collect()}
    assert told[0] == told[5] and all(told[i] == ("und", 0.0, True) for i in (2, 3, 4))
    assert language.identify(docs.limit(0), language.fit({})).count() == 0
    assert {r["lang_pred"] for r in language.identify(docs, language.fit({})).collect()} == {"und"}
