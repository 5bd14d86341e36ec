"""The pipeline's stages one by one against plain Python, and the whole of it on odd tables."""
import random
from collections import Counter

import corpus_pipeline
import pytest
from mendframe.llm import language, mixing, pii
from mendframe.llm.queries import tokenizer_path
from tests.llm.test_operators import languages, linked

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows, columns=COLUMNS):
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], columns)


def corpus():
    rnd = random.Random(8)
    rows = [(i, t, lang, rnd.choice(["hot", "hot", "cold", None])) for i, t, lang in languages(60)]
    rows += [(100 + i, rows[i][1], rows[i][2], "cold") for i in range(6)]  # exact copies
    rows += [(200 + i, rows[10 + i][1].replace(" ", "  ", 1) + " tail", rows[10 + i][2], "hot") for i in range(6)]  # near copies
    rows += [(300, None, None, "hot"), (301, "", "aa", "hot"), (302, "12 ! 34", "aa", None), (303, "write ann@example.com or call 10.0.0.1 " + " ".join(rows[0][1].split()[::-1]), "aa", "hot")]
    return rows


def test_stages_against_plain_python(spark):
    tokenizers = pytest.importorskip("tokenizers")
    rows, docs = corpus(), table(spark, corpus())
    names = [n for n, _ in corpus_pipeline.STAGES]
    stage = dict(corpus_pipeline.STAGES)
    assert names == ["language", "near duplicates", "personal data", "mixing", "tokens"]
    models = language.fit(language.sample_chunks(docs))
    told = {r["doc_id"]: r["rejected"] for r in language.identify(docs.select("doc_id", "text"), models).collect()}
    kept = stage["language"](spark, docs, "")
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, gone in told.items() if not gone} and told[300] and told[301] and told[302]
    own = [tuple(r) for r in kept.collect()]
    single = stage["near duplicates"](spark, kept, "")
    want = {i for i, c in linked([r[:4] for r in own]).items() if i == c}
    assert single.columns == docs.columns and {r["doc_id"] for r in single.collect()} == want and not want & {100, 200}
    clean = stage["personal data"](spark, single, "")
    texts = {r[0]: r[1] for r in rows}
    assert clean.columns == docs.columns
    for r in clean.collect():
        assert r["text"] == pii.redacted(texts[r["doc_id"]], pii.find_all(texts[r["doc_id"]])[1]) and r["n_chars"] == len(r["text"])
    assert any("<email>" in r["text"] and "<ip>" in r["text"] for r in clean.collect())
    mixed = stage["mixing"](spark, clean, "")
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(mixing.sized(clean)).collect()}
    got = Counter()
    for r in mixed.collect():
        got[r["doc_id"]] += len(r["text"].split())
        assert r["n_chars"] == len(r["text"])
    assert mixed.columns == docs.columns and got == Counter({k: v for k, v in taken.items() if v})
    library = tokenizers.Tokenizer.from_file(tokenizer_path(corpus_pipeline.VOCABULARY))
    encoded = [(r["doc_id"], r["n_tokens"], list(r["tokens"])) for r in stage["tokens"](spark, mixed, "").collect()]
    wanted = [(r["doc_id"], library.encode(r["text"], add_special_tokens=False).ids) for r in mixed.collect()]
    assert sorted(encoded) == sorted((i, len(ids), ids) for i, ids in wanted)


def test_the_whole_pipeline(spark, tmp_path):
    pytest.importorskip("tokenizers")
    folder = f"file://{tmp_path}/a"
    table(spark, corpus()).write.parquet(f"{folder}/documents.parquet")
    found = corpus_pipeline.run(spark, folder)
    assert found.columns == ["doc_id", "n_tokens", "tokens"] and 0 < found.count() and found.where("n_tokens <> size(tokens)").count() == 0
    again = corpus_pipeline.run(spark, folder)
    assert sorted(map(tuple, found.select("doc_id", "n_tokens").collect())) == sorted(map(tuple, again.select("doc_id", "n_tokens").collect()))


def test_odd_tables(spark, tmp_path):
    """No rows, nothing but nulls, repeated rows and rows without doc_id, one very long text, columns of clashing names."""
    pytest.importorskip("tokenizers")
    long = " ".join(t for _, t, lang in languages(80) if lang == "aa") * 3
    base = [r for r in corpus() if r[0] < 40]
    extra = COLUMNS + ", size string, bucket string, token string, lang_pred string, component_id string"
    odd = [(*r, len(r[1] or ""), *["own"] * 5) for r in [*base, *base[:3], (None, base[5][1] + " more", "aa", "hot"), (None, None, None, None), (900, long, "aa", "hot")]]
    tables = {"none": table(spark, base).limit(0), "nulls": table(spark, [(None, None, None, None)] * 3), "odd": spark.createDataFrame(odd, extra)}
    counts = {}
    for name, docs in tables.items():
        docs.write.parquet(f"file://{tmp_path}/{name}/documents.parquet")
        counts[name] = [r["doc_id"] for r in corpus_pipeline.run(spark, f"file://{tmp_path}/{name}").collect()]
    assert counts["none"] == counts["nulls"] == [] and 900 in counts["odd"] and None in counts["odd"]
