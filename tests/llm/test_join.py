"""The n-gram join on hard groups: many copies, hubs that link to few, batches of a few rows, equal digests."""
import random

import pytest
from pyspark.sql import functions as F

from mendframe.llm import components, ngram_join
from tests.llm.test_operators import docs_of, linked


@pytest.fixture
def tiny_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def words(rnd, n, prefix):
    return [f"{prefix}{rnd.randrange(10**9)}" for _ in range(n)]


def edited(rnd, base, edits):
    own = list(base)
    for at in rnd.sample(range(len(base)), edits):
        own[at] = f"e{rnd.randrange(10**9)}"
    return own


def components_of(spark, rows):
    return {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_components(docs_of(spark, rows)).collect()}


def test_hard_groups(spark, monkeypatch, tiny_batches):
    """Edited copies that link to the original alone, chains, passages that unrelated texts share, and lists in parts."""
    rnd = random.Random(11)
    base, rows = words(rnd, 60, "a"), []
    rows += [(i, " ".join(edited(rnd, base, 1)), "en", "a") for i in range(40)] + [(90 + i, " ".join(base), "en", "a") for i in range(5)]
    chain = words(rnd, 80, "c")
    for i in range(12):
        rows.append((200 + i, " ".join(chain), "en", "a"))
        chain = edited(rnd, chain, 1)
    passage = words(rnd, 30, "p")
    rows += [(300 + i, " ".join(words(rnd, 5, "q") + passage + words(rnd, rnd.randrange(20), "q")), "en", "a") for i in range(25)]
    rows += [(400 + i, " ".join(words(rnd, 2, "s") + passage), "en", "a") for i in range(10)]
    want = linked(rows)
    for parts, chunk in ((400, 60_000), (3, 5)):
        monkeypatch.setattr(ngram_join, "PART_ROWS", parts)
        monkeypatch.setattr(ngram_join, "CHUNK_ROWS", chunk)
        monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 4 if parts == 3 else 4096)
        assert components_of(spark, rows) == want


def test_pairs_grow_with_rows(spark, monkeypatch):
    """Copies of a text and texts that differ from it in one word, of which few link to each other: no quadratic candidates."""
    counted = []
    real = ngram_join.linked

    def counting(pairs, sets, percent):
        counted.append(pairs.count())
        return real(pairs, sets, percent)

    monkeypatch.setattr(ngram_join, "linked", counting)
    found = []
    for copies, edits in ((150, 100), (600, 400)):
        rnd, counted[:] = random.Random(5), []
        base = words(rnd, 60, "b")
        rows = [(10_000 + i, " ".join(base), "en", "a") for i in range(copies)] + [(i, " ".join(edited(rnd, base, 1)), "en", "a") for i in range(edits)]
        assert set(components_of(spark, rows).values()) == {0}
        found.append(sum(counted) / (copies + edits))
    assert found[1] < 2 * found[0] + 20, found


def test_sets_of_one_digest(spark):
    """Sets whose first digests are equal go by the second one, in members and in shared sets alike."""
    rnd = random.Random(2)
    texts = [words(rnd, 30, "t") for _ in range(4)]
    rows = [(i, " ".join(t), "en", "a") for i, t in enumerate(texts)] + [(10 + i, " ".join(edited(rnd, t, 1)), "en", "a") for i, t in enumerate(texts)]
    told = ngram_join.answered(ngram_join.chunked(docs_of(spark, rows).select("doc_id", "text"), 5, 8))
    members = {r["doc_id"]: r for r in ngram_join.members_of(told).collect()}
    twins = [members[0]["id"], members[11]["id"]]  # as if other sets had these, too
    ids = {r["doc_id"]: r["id"] for r in ngram_join.shared_sets(told, 60, twins).collect()}
    assert len(ids) == 8 and all(ids[i] == members[i]["other" if i in (0, 11) else "id"] for i in ids)


def test_rows_without_id_and_clashing_columns(spark):
    rows = [(None, "a b c d e f", "en", "a"), (None, "a b c d e f", "en", "a"), (5, "a b c d e f", "en", "a"), (6, None, "en", "a"), (7, "   ", "en", "a"), (None, "x y z u v w", "en", "a"), (5, "a b c d e f", "en", "a")]
    docs = docs_of(spark, rows).withColumns({c: F.lit("own") for c in ("token", "id", "part", "mark_place", "doubtful", "component_id")})
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in ngram_join.ngram_components(docs).collect())
    assert got == [("5", 2, "5"), ("5", 2, "5"), ("6", 0, "6"), ("7", 0, "7"), ("None", 2, "5"), ("None", 2, "5"), ("None", 2, "None")]
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["5", "6", "7", "None", "None", "None"]


def test_local_stars_keep_components(spark, monkeypatch):
    rnd = random.Random(1)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)]
    up = list(range(300))
    for _ in range(300):
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    for block in (1 << 20, 7):
        monkeypatch.setattr(components, "BLOCK_LINKS", block)
        got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long").repartition(3)).collect()}
        assert got == {x: up[x] for a, b in links if a != b for x in (a, b)}
