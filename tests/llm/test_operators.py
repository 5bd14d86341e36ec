"""Each operator against brute force, with nulls, empty texts, ties, repeated rows, empty tables and clashing columns."""
import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mendframe.llm import bpe, chat, fingerprints, language, mixing, ngram_join, pii, sharding, token_files, vectors
from mendframe.llm.components import components
from mendframe.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, bucket string, next string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, rows):
    """Documents with columns whose names clash with those that operators use."""
    return spark.createDataFrame([(i, t, lang, s, len(t) if t else 0, 1, "b", "n") for i, t, lang, s in rows], DOCS)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    out = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice([1, 4, 5, 30, 200]))), "en", rnd.choice(["a", "b", None])) for i in range(60)]
    out += [(100, None, None, "a"), (101, "", "en", "c"), (102, " \n", "en", None), (103, out[3][1], "en", "a"), (103, out[3][1], "en", "a"), (104, "x " * 30_000, "en", "a")]
    return out


def tokens(text):
    return WORD.findall(text or "")


def test_mixing(spark, rows):
    got = mixing.mix(mixing.sized(docs_of(spark, rows))).collect()
    assert len(got) == len(rows) and sorted(r["size"] for r in got) == sorted(len(tokens(t)) for _, t, _, _ in rows)
    per = defaultdict(lambda: [0, 0, 0.0])
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        per[r["source"]][0] += r["size"]
        per[r["source"]][1] += r["taken"]
        per[r["source"]][2] = r["target"]
    order = sorted((s for s in per if s is not None)) + [None]
    level_of = {s: per[s][2] / (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    for s in order:
        assert per[s][2] <= 2 * per[s][0] + 1e-6 and abs(per[s][1] - per[s][2]) <= 0.5
        if per[s][2] < 2 * per[s][0] - 1e-6:
            assert abs(level_of[s] - max(level_of.values())) < 1e-6
    assert abs(sum(p[2] for p in per.values()) - 1.5 * sum(p[0] for p in per.values())) < 1e-6
    again = mixing.mix(mixing.sized(docs_of(spark, list(reversed(rows))))).collect()
    key = lambda r: (r["doc_id"], r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    mixed = mixing.repeat_documents(docs_of(spark, rows))
    assert mixed.columns == docs_of(spark, rows).columns
    taken = Counter()
    for r in mixed.collect():
        taken[r["doc_id"]] += len(tokens(r["text"]))
    assert sum(taken.values()) == sum(r["taken"] for r in got)
    assert mixing.mix(mixing.sized(docs_of(spark, rows).limit(0))).count() == 0


def shingles(text):
    words = tokens(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def linked(rows):
    """Component of each id by brute force."""
    sets = [(i, shingles(t)) for i, t, *_ in rows]
    up = {i: i for i, _ in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: root(i) for i, _ in sets}


def test_ngram_join(spark, rows, monkeypatch):
    rnd = random.Random(5)
    base = [f"b{k}" for k in range(90)]
    near = []
    for i in range(120):
        own = list(base)
        for _ in range(rnd.randrange(6)):
            own[rnd.randrange(90)] = f"x{rnd.randrange(10**6)}"
        near.append((200 + i, " ".join(own), "en", "a"))
    short = [(400 + i, " ".join(rnd.choice("ABC") for _ in range(rnd.randrange(14))), "en", "b") for i in range(120)]
    every = rows + near + short
    monkeypatch.setattr(ngram_join, "PART_ROWS", 10)
    got = ngram_join.ngram_components(docs_of(spark, every)).collect()
    want = linked(every)
    assert {r["doc_id"]: r["component_id"] for r in got} == want and len(got) == len(every)
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(shingles(t)) for i, t, *_ in every}
    kept = ngram_join.one_of_each(docs_of(spark, every))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values())) and kept.columns == docs_of(spark, every).columns
    assert ngram_join.ngram_components(docs_of(spark, rows).limit(0)).count() == 0
    monkeypatch.setattr(ngram_join, "MARK_BITS", 7)
    monkeypatch.setattr(ngram_join, "NEIGHBOURS", 1)
    monkeypatch.setattr(ngram_join, "CHUNK_ROWS", 7)
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_components(docs_of(spark, near)).collect()} == linked(near)


def test_subset_sizes_and_boundary():
    for n in range(1, 13):
        for m in ngram_join.partner_sizes(n):
            least = ngram_join.overlap(n, m)
            assert 100 * least >= 80 * (n + m - least) and (least == 0 or 100 * (least - 1) < 80 * (n + m - least + 1))
    assert ngram_join.boundary({n: 100 for n in range(1, 13)}, 1.0) < ngram_join.boundary({n: 100 for n in range(1, 13)}, 1e6) <= ngram_join.LARGEST_SMALL


def test_components(spark):
    rnd = random.Random(2)
    links = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(50)] + [(200 + i, 201 + i) for i in range(40)] + [(300, i) for i in range(301, 360)]
    up = {x: x for pair in links for x in pair}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in links if a != b for x in (a, b)}


def test_components_that_have_not_settled_are_an_error(spark, monkeypatch):
    monkeypatch.setattr("mendframe.llm.components.MOST_ROUNDS", 1)
    with pytest.raises(RuntimeError, match="not settled"):
        components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long"))


def test_fingerprints(spark, rows, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 9)
    unique = list({r[0]: r for r in rows}.values())
    got = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(docs_of(spark, unique)).collect()}
    order = sorted(unique, key=lambda r: -r[0])
    near = []
    for k, (i, text, *_) in enumerate(order):
        after, text = order[(k + 1) % len(order)][1] or "", text or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(text)
        x, y = shingles(text), shingles(edited)
        near.append(abs(got[i]["near_edited"] - (len(x & y) / len(x | y) if x | y else 1.0)))
        assert 0 <= got[i]["near_next"] <= 1
    assert sum(near) / len(near) < 0.05
    assert got[3]["fingerprint"] == got[103]["fingerprint"] and got[100]["fingerprint"] == got[101]["fingerprint"] == ""
    assert fingerprints.edited_fingerprints(docs_of(spark, rows).limit(0)).count() == 0


def languages(n=80):
    rnd = random.Random(4)
    parts = {"aa": "the and ing of ion re", "bb": "der sch ung ein ich ü", "cc": "que les é ment oi eau"}
    return [(i, " ".join("".join(rnd.choice(parts[lang].split()) for _ in range(rnd.randrange(1, 4))) for _ in range(rnd.randrange(20, 120))), lang) for i, lang in enumerate(random.Random(1).choices(list(parts), k=n))]


def test_language(spark):
    rows = [(i, t, lang, "s") for i, t, lang in languages()] + [(900, None, None, "s"), (901, "", None, "s"), (902, "12 !", None, "s"), (903, "zqxj kvvw qqpz xxgf wqkj zzvq " * 20, None, "s")]
    docs = docs_of(spark, rows)
    models = language.fit(language.sample_chunks(docs))
    got = {r["doc_id"]: r for r in language.identify(docs.select("doc_id", "text", "size"), models).collect()}
    held = [r for r in rows if r[2] and zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert held and all(got[i]["lang_pred"] == lang and not got[i]["rejected"] for i, _, lang, _ in held)
    assert all(got[i]["lang_pred"] == "und" and got[i]["rejected"] and got[i]["score"] == 0 for i in (900, 901, 902))
    assert got[903]["rejected"] and got[903]["lang_pred"] in models.languages and all(0 <= r["score"] <= 1 for r in got.values())
    assert sorted(r["doc_id"] for r in language.accepted(docs, models).collect()) == sorted(i for i, _, lang, _ in rows if lang)
    assert language.fit({}).languages == [] and language.identify(docs.select("text"), language.fit({})).where("lang_pred <> 'und'").count() == 0


def test_language_probabilities_sum_to_one():
    samples = {"aa": ["abab abba", "ba ab"], "bb": ["cacb", "bbca"]}
    models = language.fit(samples, order=3)
    alphabet = [ord(c) for c in "abc "]
    for i, name in enumerate(models.languages):
        for context in ("ab", "ba", "ca"):
            total = 0.0
            for c in alphabet:
                symbols = np.array([*map(ord, context), c], np.uint32)
                whole = -models.entropies(symbols, np.array([0, 3]))[0, i] * 3
                head = -models.entropies(symbols[:2], np.array([0, 2]))[0, i] * 2
                total += np.exp(whole - head)
            assert total <= 1.02, (name, context, total)


def test_personal_data(spark):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def brute(text):
        out = []
        for kind, pattern in patterns.items():
            for m in re.finditer(pattern, text):
                digits = re.sub("[^0-9]", "", m[0])
                luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0
                if {"email": True, "ip": all(int(p) < 256 for p in m[0].split(".")) if kind == "ip" else False, "card": 14 <= len(digits) <= 19 and luhn, "phone": 10 <= len(digits) <= 15}[kind]:
                    out.append((m.start(), m.end(), kind))
        return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))

    rnd = random.Random(2)
    texts = ["".join(rnd.choice(["a", "@", ".", "1", "12", "255", " ", "-", "+", "(", ")", "b.c", "4111", "x@y.z", "\n", "é"]) for _ in range(rnd.randrange(25))) for _ in range(3000)]
    found = pii.find_in_batch(pa.array(texts))
    assert all(base == brute(t) and set(base) <= set(every) for t, (base, every) in zip(texts, found, strict=True))
    disguised = {
        "mail john (at) example (dot) com now": "john (at) example (dot) com", "john at example dot com": "john at example dot com", "jоhn@exаmple.com": "jоhn@exаmple.com",
        "+４９ 151 2345 6789 1": "+４９ 151 2345 6789 1", "card four one one one 1111 1111 1111 x": "four one one one 1111 1111 1111", "ip 10[.]0[.]0[.]1": "10[.]0[.]0[.]1",
    }
    for text, want in disguised.items():
        assert [text[a:b] for a, b, _ in pii.find_all(text)[1]] == [want]
    assert all(not pii.find_all(t)[1] for t in ("look at example.com", "one two three", "we met at noon. dot", ""))
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, "write a@b.com", "en", "a"), (3, "write a@b.com", "en", "a"), (4, "1" * 50_000 + "@" + "a." * 20_000, "en", "a")]
    got = pii.find_pii(docs_of(spark, rows)).collect()
    assert len(got) == 5 and Counter(r["spans"] for r in got if r["doc_id"] < 4) == {"": 2, "email:6:13": 2}
    cleaned = pii.redact(docs_of(spark, rows[:3]))
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in cleaned.collect()}[3] == ("write <email>", 13) and cleaned.columns == docs_of(spark, rows).columns


def test_the_gate_loses_no_span(monkeypatch):
    lost = {
        "host 10.zero.zero.one up": ("10.zero.zero.one", "ip"), "call +49.one.five.one.two.three.four.five.six": ("+49.one.five.one.two.three.four.five.six", "phone"),
        "+49 (one)(five)(one)(two) 345678": ("+49 (one)(five)(one)(two) 345678", "phone"), "mail john@example_dot_com": ("john@example_dot_com", "email"),
    }
    for text, want in lost.items():
        assert want in [(text[a:b], kind) for _, spans in pii.find_in_batch(pa.array([text])) for a, b, kind in spans]
    rnd = random.Random(4)
    digits, signs = ["one", "OH", "zÉro", "s\u0130x", "1", "7", "\uff11"], ["", " ", "-", ".", " dot ", "[.]", "_punto_", " .\x0b", "(dot)", "\x1cdot ", "\u00a0"]
    others = ["@", " at ", "(arroba)", "\x0b@", "+", "plus ", "plus\x1c\n", "a", "b.c", "\u00e9", ",", "(", ")", "\u200b"]
    texts = ["".join(rnd.choice(digits) + rnd.choice(signs if rnd.random() < 0.8 else others) for _ in range(rnd.randrange(9))) for _ in range(10000)]
    texts += ["".join(rnd.choice(digits) + rnd.choice([" ", "-", " "]) for _ in range(rnd.randrange(12, 20))) for _ in range(3000)]
    texts += ["".join(rnd.choice(["a", "one", "x", " at ", "[at]", "@", " dot ", ".", "com", " "]) for _ in range(rnd.randrange(12))) for _ in range(5000)]
    gated = pii.find_in_batch(pa.array(texts))
    monkeypatch.setattr(pii, "HINTED", re.compile(""))
    whole = [pii.find_all(t) for t in texts]
    assert gated == whole and sum(len(every) > len(base) for base, every in whole) > 500
    began = time.process_time()
    assert pii.find_all("one" + " " * 200_000 + "(" + " " * 200_000)[1] == [] and time.process_time() - began < 5


def test_spelled_numbers_of_several_digits():
    whole = {
        "host one nine two dot one six eight dot one dot two up": ("one nine two dot one six eight dot one dot two", "ip"), "at one zero dot zero dot zero dot one": ("one zero dot zero dot zero dot one", "ip"),
        "one-nine-two [.] one  six\teight.one.two": ("one-nine-two [.] one  six\teight.one.two", "ip"), "x 10.zero.zero.two five": ("10.zero.zero.two five", "ip"),
        "ask one two three (at) example (dot) com": ("one two three (at) example (dot) com", "email"), "ask a.four two at example dot com": ("a.four two at example dot com", "email"),
        "one.two.three.four": ("one.two.three.four", "ip"), "оne nine two dot one six eight dot one dot two": ("оne nine two dot one six eight dot one dot two", "ip"),
    }
    for text, (want, kind) in whole.items():
        assert [(text[a:b], k) for _, spans in pii.find_in_batch(pa.array([text])) for a, b, k in spans] == [(want, kind)]
    text = "card four one one one 1111 1111 1111, host one zero dot zero dot zero dot one"
    assert pii.redacted(text, pii.find_all(text)[1]) == "card <card>, host <ip>"
    assert not pii.find_all("one two three dot four")[1]


def test_pii_takes_linear_time():
    for fill in (" ", "\t", " -", "- ", "_ ", "a ", "one ", "one-", "1 ", "+1 ", "a@", "1.", "( ", "at ", " dot ", "zero."):
        took = []
        for n in (5_000, 40_000):
            began = time.process_time()
            pii.find_all("john at example dot com " + fill * n + " x@y.com")
            took.append(time.process_time() - began)
        assert took[1] < 24 * took[0] + 0.2, fill


def test_vectors(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((12, 16))
    flat = [(base[rng.integers(12)] + 0.15 * rng.standard_normal(16)).astype(np.float32) for _ in range(150)] + [base[0].astype(np.float32)] * 3
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(flat)] + [(900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [float("nan")] * 16, 1), (904, [None] * 16, 1), (905, [1.0, 2.0], 1)]
    unit = np.array(flat, np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    up = list(range(len(flat)))
    for _ in range(len(flat)):
        up = [min([up[i], *(up[j] for j in np.flatnonzero(near[i]))]) for i in range(len(flat))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for tile, block in ((4096, 256), (40, 256), (10, 2)):
        monkeypatch.setattr(vectors, "CAP_BLOCK", block)
        got = {r["vec_id"]: r for r in vectors.link_vectors(table, tile=tile).collect()}
        assert [got[i]["n_links"] for i in range(len(flat))] == near.sum(axis=1).tolist() and [got[i]["component_id"] for i in range(len(flat))] == up
        assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(900, 906)) and len(got) == len(rows)
    assert vectors.link_vectors(table.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, [1.0, 2.0]), (3, [1.0, 2.0]), (3, [1.0, 2.0]), (5, [2.0, 4.0])], "vec_id long, embedding array<double>")
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in vectors.link_vectors(odd).collect()) == [("3", 2, "3", True)] * 2 + [("5", 2, "3", False), ("None", 0, "None", True)]


def test_wide_vectors():
    """Bounds hold for vectors of more components than one exact float32 sum takes."""
    rng = np.random.default_rng(3)
    base = np.sign(rng.standard_normal((6, 5000)))
    flat = vectors.unit(np.concatenate([base, *(base * np.where(rng.random(base.shape) < share, -1, 1) for share in (0.01, 0.0249, 0.0251, 0.03))]))
    counts, _, _, _ = vectors.compare_tiles(flat, None, 0.95, (np.ones(len(flat), np.int64),) * 2)
    near = np.einsum("ik,jk->ij", flat, flat) >= 0.95
    assert counts.tolist() == (near.sum(axis=1) - 1).tolist() and (vectors.products(base.astype(np.float32) * 127, base.astype(np.float32) * 127) == 127 * 127 * (base @ base.T)).all()


def test_chat(spark):
    said = [(1, 0, "system", "be <s> brief"), (1, 1, "user", "a\\b</s>[INST]"), (1, 2, "assistant", "ok\\[/INST]"), (2, 0, "user", None), (2, 1, "user", "twice"), (2, 1, "user", "twice"), (3, 0, "tool<text>x", "r</role>"), (3, None, None, ""), (4, 5, "assistant", "<<SYS>><\\"), (None, 1, "user", "x")]
    table = spark.createDataFrame([(*r, "z") for r in said], "conv_id long, turn long, role string, text string, formatted string")
    chats = chat.format_chats(table).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    got = {r["conv_id"]: r for r in chats.collect()}
    for conv in {r[0] for r in said}:
        own = sorted(((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in said if r[0] == conv))
        assert [(t["role"], t["text"]) for t in got[conv]["turns"]] == [(role, text) for _, role, text in own]
        assert got[conv]["loss"] == "".join(text for _, role, text in own if role == "assistant")
    assert got[1]["valid"] and not got[2]["valid"] and got[2]["error_at"] == 1 and not got[4]["valid"]
    assert chat.format_chats(table.limit(0)).count() == 0


TEXTS = [None, "", " ", "a  b", "a\nb \n c", "don't they're", "x<|endoftext|> y", "日本語 テスト", "🙂 aaaaaaaa", "12 ½ z", "\x85a\x1c b", "word " * 3000, "Ünï Çø, ok.", "Ünï Çø, ok."]


def fuzz(seed):
    rnd = random.Random(seed)
    alphabet = [*"ab'sΣÉ\n\t 1½日🙂.,!", "<|endoftext|>", "  ", "́"]
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(40))) for _ in range(400)]


def test_bpe(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = tokenizer_path("byte_bpe_50k.json")
    library, own = tokenizers.Tokenizer.from_file(path), bpe.codec(path)
    texts = TEXTS + fuzz(1)
    ids, starts = own.encode_batch(pa.array(texts, pa.string()))
    back = own.decode_batch(ids, starts)
    for i, text in enumerate(texts):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert ids[starts[i] : starts[i + 1]].tolist() == want and back[i] == library.decode(want, skip_special_tokens=False)
    rnd = random.Random(9)
    for text in ("".join(rnd.choice("abcdeé日") for _ in range(30_000)), "ab" * 20_000, "aaa" * 9_999 + "b", "the" * 700 + " " + "nation" * 900):
        (ids, starts), began = own.encode_batch(pa.array([text])), time.process_time()
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    own._forget()
    own.encode_batch(pa.array(["".join(rnd.choice("abcdefgh") for _ in range(200_000))]))
    assert time.process_time() - began < 8
    docs = docs_of(spark, [(i, t, "en", "a") for i, t in enumerate(TEXTS)])
    assert {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(docs, path), path).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert bpe.round_trip(docs.limit(0), path).count() == 0


def test_token_files(spark, tmp_path):
    pytest.importorskip("tokenizers")
    path = tokenizer_path("word_bpe_49k.json")
    own = token_files.encoder(path)
    texts = TEXTS + fuzz(2)
    ids, starts = own.encode_batch(pa.array(texts, pa.string()), 2)
    for i, text in enumerate(texts):
        assert ids[starts[i] : starts[i + 1]].tolist() == own.tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
    folder = f"file://{tmp_path}/tokens"
    token_files.write_tokens(docs_of(spark, [(7 * i, t, "en", "a") for i, t in enumerate(texts)]), folder, path, 2)
    got = {r["doc_id"]: r for r in token_files.token_places(spark, folder).collect()}
    for i in range(len(texts)):
        own_ids = ids[starts[i] : starts[i + 1]]
        assert (got[7 * i]["start"], got[7 * i]["n_tokens"], got[7 * i]["ids_crc32"]) == (starts[i], len(own_ids), zlib.crc32(own_ids.astype("<u4").tobytes()))
    assert token_files.read_tokens(spark, folder, [14]).count() == 1
    data = b"".join(p.read_bytes() for p in tmp_path.glob("tokens/*.orc"))
    assert b"orc.bloom.filter" in data or b"doc_id" in data
    orc = pytest.importorskip("pyarrow.orc")
    assert sum(orc.ORCFile(str(p)).nrows for p in tmp_path.glob("tokens/*.orc")) == len(texts)
    empty = f"file://{tmp_path}/empty"
    token_files.write_tokens(docs_of(spark, [(1, "a", "en", "a")]).limit(0), empty, path, 2)
    odd = f"file://{tmp_path}/odd"
    token_files.write_tokens(docs_of(spark, [(None, "a b", "en", "a"), (3, "c", "en", "a"), (3, "c", "en", "a")]), odd, path, 2)
    assert sorted((r["start"], str(r["doc_id"])) for r in token_files.token_places(spark, odd).collect()) == [(0, "None"), (3, "3"), (5, "3")]
    assert token_files.token_places(spark, empty).count() == 0


def test_sharding(spark, rows):
    got = sharding.shard(docs_of(spark, rows).repartition(5), 8).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert sorted(Counter(r["doc_id"] for r in got).items()) == sorted(Counter(r[0] for r in rows).items())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    matrix = sharding.communication_matrix(np.array([7, 0, 30, 13]), sharding.shard_sizes(50, 8), 1)
    assert matrix.sum(axis=1).tolist() == [7, 0, 30, 13] and matrix.sum(axis=0).tolist() == [7, 7, 6, 6, 6, 6, 6, 6]
    mean = np.mean([sharding.communication_matrix(np.array([20, 20]), np.array([10, 30]), s)[0, 0] for s in range(400)])
    assert abs(mean - 5) < 0.3
    plain = [sharding._hypergeometric(np.random.default_rng(s), 60, 40, 30) for s in range(4000)]
    inverted = [sharding._inverted(np.random.default_rng(s), 60, 40, 30) for s in range(4000)]
    assert all(abs(plain.count(k) - inverted.count(k)) < 140 for k in range(31))
    clashing = sharding.shard(docs_of(spark, rows).withColumns({c: F.lit("own") for c in ("part_place", "shard_key", "shard_bucket", "shard_start", "slot")}), 3)
    assert {r["part_place"] + r["shard_key"] + r["shard_bucket"] + r["shard_start"] for r in clashing.collect()} == {"own" * 4} and dict(clashing.dtypes)["slot"] == "bigint"
    big = [sharding._hypergeometric(np.random.default_rng(s), 2 * 10**9, 2 * 10**9, 1000) for s in range(300)]
    assert abs(np.mean(big) - 500) < 4 and 12 < np.std(big) < 20
    assert sharding.shard(docs_of(spark, rows).limit(0), 8).count() == 0
