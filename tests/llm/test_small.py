"""The training-data operators on tiny tables: nulls, empties, ties, repeats, clashing names, and exact round trips."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.llm import ann, bpe, dac, minhash, mixing, pii, quality_model, quality_rules, queries, sharding, token_files, toxicity, wordhash
from tarn.llm.common import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, id string, node long, _tie long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def rows():
    long = " ".join(WORDS)
    texts = [None, "", " \n\t", "one", long, long, long + " extra", "é ü\n\nmail a@b.co now", "x" * 300_000, long.upper(), "1 | 2 | 3\n1 | 2 | 3\n" + long]
    out = [(k, t, "en" if k % 2 else None, "s", 1, "z", "y", 7, 7) for k, t in enumerate(texts)]
    return [*out, (None, long, None, None, None, None, None, None, None), out[4], out[4]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def by_hand_sets(texts, width):
    out = []
    for t in texts:
        w = (t or "").encode().translate(bytes((c + 32 if 65 <= c <= 90 else c) for c in range(256))).split()
        out.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    return out


def by_hand_components(ids, sets, percent):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            s, t = sets[a], sets[b]
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((find(ids[a]), find(ids[b])))
                up[y] = x
    return {i: find(i) for i in ids}


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    texts = []
    for _ in range(12):
        base = [WORDS[k] + str(rng.integers(40)) for k in rng.integers(0, 20, int(rng.integers(1, 90)))]
        for _ in range(8):
            own = list(base)
            for _ in range(int(rng.integers(0, 4))):
                own[int(rng.integers(len(own)))] = "new" + str(rng.integers(1000))
            texts.append(" ".join(own))
    texts += ["", None, "a", "A", "a b", "b a"]
    ids = [3 * k + 1 for k in range(len(texts))]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    for width, percent in ((3, 85), (5, 80)):
        sets = by_hand_sets(texts, width)
        want = by_hand_components(ids, sets, percent)
        got = {r["doc_id"]: r for r in minhash.near_duplicates(docs, width, percent).collect()}
        assert {i: r["component_id"] for i, r in got.items()} == want
        assert [got[i]["n_shingles"] for i in ids] == [len(s) for s in sets]
        assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())


def test_near_duplicates_blocks_equal_pairs(spark, monkeypatch):
    monkeypatch.setattr(minhash, "FEW_PAIRS", 0)
    monkeypatch.setattr(minhash, "BLOCK", 3)
    test_near_duplicates_equal_brute_force(spark)


def test_near_duplicates_edges(docs, empty):
    got = minhash.near_duplicates(docs, 3, 85).collect()
    assert len(got) == docs.count() and minhash.near_duplicates(empty).count() == 0
    assert {(r["doc_id"], r["component_id"]) for r in got if r["n_shingles"] == 0} == {(0, 0), (1, 1), (2, 2), (None, None)}
    assert {r["doc_id"] for r in got if r["component_id"] == 4} >= {4, 5, 6, 9}


def test_token_files(spark, docs, empty):
    from tokenizers import Tokenizer

    j = queries.tokenizer_json(queries.WORD_TOKENIZER)
    t, start, want = Tokenizer.from_str(j), 0, []
    for i, text in sorted(((r[0], r[1]) for r in rows()), key=lambda r: -1 if r[0] is None else r[0]):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(r)[:4] for r in token_files.token_table(docs, j, 2).orderBy("start").collect()]
    assert got == want and token_files.token_table(empty, j, 2).count() == 0


def test_segments_give_any_token():
    rng = np.random.default_rng(2)
    for n in (0, 1, 511, 512, 513, 5000):
        ids = (rng.integers(0, 1 << 32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        s = dac.Segment(dac.encode(ids, [1, None], np.array([0, n // 2, n])))
        assert (s.all() == ids).all() and s.doc_ids == [1, None] and [s.access(k) for k in range(0, n, 97)] == ids[::97].tolist()
        assert (s.tokens(n // 3, n // 2) == ids[n // 3 : n // 2]).all()


ODD = ["", "  \n\n a", "it's I'LL don't 'Tis", "a<|endoftext|>b  <|endoftext|> c", "voilà café,x", "a  b \n c", "日本語 　 y", "a\x1cb \x85 c", "!'s ''s don''t", "J̌ H̱ x́", "tab\t\tend \n"]


@pytest.mark.parametrize("text", ODD)
def test_encoders_equal_the_library(text):
    from tokenizers import Tokenizer

    for name, make in ((queries.WORD_TOKENIZER, lambda j: lambda t: token_files.WordEncoder(j)([t.encode()])[0].tolist()), (queries.BYTE_TOKENIZER, lambda j: bpe.ForcedBoundaryBpe(j).encode)):
        j = queries.tokenizer_json(name)
        assert make(j)(text) == Tokenizer.from_str(j).encode(text, add_special_tokens=False).ids


def test_bpe_digests(docs, empty):
    from tokenizers import Tokenizer

    j = queries.tokenizer_json(queries.BYTE_TOKENIZER)
    t = Tokenizer.from_str(j)
    for r, (_, text, *_rest) in zip(sorted(bpe.encoded(docs, j, True).collect(), key=str), sorted(rows(), key=str), strict=True):
        ids = t.encode(text or "", add_special_tokens=False).ids if r["doc_id"] is not None else None
        if ids is not None and r["doc_id"] == _:
            assert r["ids"] == ids and r["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.encoded(empty, j).count() == 0


def test_quality_counts_by_hand(docs, empty):
    got = {r["doc_id"]: r for r in quality_rules.quality(docs).collect()}
    assert got[0]["n_words"] == 0 and got[0]["base_failed"] and not got[0]["kept"]
    assert got[10]["n_dup_lines"] == 1 and got[10]["n_symbols"] == 4 and got[10]["n_words"] == 30 and got[10]["n_repeat_words"] == 10
    assert got[7]["word_chars"] == 2 + 4 + 6 + 3 and got[4]["kept"]
    assert quality_rules.quality(empty).count() == 0
    kept = quality_rules.kept_documents(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {4, 5, 6, 9, None}


def test_compression_bands_reject_noise_and_repetition():
    c, rng = quality_rules.Compressor(), np.random.default_rng(3)
    assert not c.verdict(b"the same words again " * 500)[2]
    assert not c.verdict(bytes(rng.integers(33, 127, 20_000).astype(np.uint8)))[2]
    assert c.verdict(b"")[2]


def test_words_are_the_same_in_pieces(monkeypatch):
    texts = [b"a bb  ccc\n", b"", b"dd", b"x" * 50 + b" y " + b"z" * 70]
    want = wordhash.words(texts)
    monkeypatch.setattr(wordhash, "_PIECE", 7)
    got = wordhash.words(texts)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all() and want[1].tolist() == [0, 3, 3, 4, 7]


def test_pii_base_and_redaction(docs, empty):
    text = "mail a.b@c.org or a@b@c.de, ip 10.0.0.1 and 300.1.1.1, card 4111 1111 1111 1111, call +1 (555) 555-1234 now"
    base, every = pii.all_spans(text, {})
    assert [(k, text[a:b]) for k, a, b in base] == [("email", "a.b@c.org"), ("email", "b@c.de"), ("ip", "10.0.0.1"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (555) 555-1234")] and every == base
    assert pii.redacted(text, every).count("<EMAIL>") == 2
    out = pii.redacted_documents(docs)
    assert out.columns == docs.columns and out.where("doc_id = 7").first()["text"] == "é ü\n\nmail <EMAIL> now"
    assert pii.spans(empty, {}).count() == 0 and pii.redacted_documents(empty).count() == 0


def test_sharding_by_hand(docs, empty):
    got = sharding.shard_documents(docs, 4, 64).collect()
    assert len(got) == docs.count() and sharding.shard_documents(empty, 4, 64).count() == 0
    for shard in {r["shard"] for r in got}:
        assert sorted(r["position"] for r in got if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in got)))
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got}[7] == (len("é ü\n\nmail a@b.co now".encode()) + 1, zlib.crc32("é ü\n\nmail a@b.co now".encode()))
    assert {r["doc_id"]: r["size"] for r in got}[0] == 1


def test_slot_maps_balance_and_grow(spark):
    sized = spark.range(5000).select((F.col("id") % 512).cast("int").alias("slot"), (F.col("id") % 97 + 1).alias("size"))
    sizes = sharding.slot_bytes(spark, sized, 512)
    one = sharding.first_map(sizes, 8)
    two = sharding.rebalanced(one, 8)
    loads = [r[0] for r in two.groupBy("shard").agg(F.sum("bytes")).select(F.col("sum(bytes)")).collect()]
    assert len(loads) == 8 and max(loads) - min(loads) < 0.01 * sum(loads) / 8 and two.count() == 512
    before, after = dict(two.select("slot", "shard").collect()), dict(sharding.grown(two, 8).select("slot", "shard").collect())
    assert all(after[s] in (before[s], 8) for s in before) and 8 in after.values()


def test_mixing_hits_its_targets(spark, docs, empty):
    rng = np.random.default_rng(4)
    cells = spark.createDataFrame([(s, lang, t, int(rng.integers(1, 1000))) for s in "abc" for lang in "xy" for t in "pq"], "_source string, _lang string, _topic string, n long")
    dims = ("_source", "_lang", "_topic")
    out = mixing.calibrated(mixing.raked(cells, dims, 0.5, 30), dims, 0.6).collect()
    total = sum(r["n"] for r in out)
    for d in dims:
        own = {v: sum(r["n"] for r in out if r[d] == v) for v in {r[d] for r in out}}
        goal = sum((n / total) ** 0.5 for n in own.values())
        for v, n in own.items():
            assert sum(r["raked"] for r in out if r[d] == v) == pytest.approx(total * (n / total) ** 0.5 / goal, rel=1e-6)
    assert sum(r["n"] * r["probability"] for r in out) == pytest.approx(0.6 * total, rel=1e-6)
    assert mixing.mixed(docs).count() == docs.count() and mixing.mixed(empty).count() == 0
    assert mixing.drawn_documents(docs).columns == docs.columns


def test_quality_model_orders_held_out_rows(spark, sf, docs, empty):
    got = quality_model.scored(table(spark, sf, "documents"), table(spark, sf, "labels")).join(table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    good, bad = [r["score"] for r in got if r["quality"] == 1], [r["score"] for r in got if r["quality"] == 0]
    assert good and (not bad or np.mean([g > b for g in good for b in bad]) > 0.9)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality_model.scored(docs, none).collect()} == {0.5} and quality_model.scored(empty, none).count() == 0


def test_toxicity_chain(spark, empty):
    rng = np.random.default_rng(6)
    texts = [(k, " ".join(WORDS[j] for j in rng.integers(0, 20, 30)) + (" Vile! vileness" if k % 5 == 0 else ""), int(k % 7 > 0), int(k % 5 == 0)) for k in range(300)]
    docs = spark.createDataFrame([(k, t) for k, t, _, _ in texts] + [(1000, None), (1001, "such VILE vileness")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, q, t) for k, _, q, t in texts], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["toxic"] for r in toxicity.scored(docs, toxicity.fit(docs, labels)).collect()}
    assert all(got[k] == bool(t) for k, _, _, t in texts) and not got[1000] and got[1001]
    chain = toxicity.fit(empty.select("doc_id", "text"), labels)
    assert not any(r["toxic"] for r in toxicity.scored(docs, chain).collect())


def test_neighbours_equal_brute_force_or_nearly(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(600, 24)).astype(np.float32)
    x[100:140] = x[50]
    data = [(k, v.tolist(), 0) for k, v in enumerate(x)] + [(700, None, 0), (750, [0.0] * 24, 0), (800, [float("nan")] * 24, 0), (850, [1.0], 0)]
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<float>, rank int")
    x = x.astype(float)
    s = (x @ x.T) / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(x, axis=1)[None]
    np.fill_diagonal(s, -9)
    want = {q: np.argsort(-np.round(s[q], 12), kind="stable")[:5].tolist() for q in range(0, 600, 50)}
    for exact in (2048, 10):
        monkeypatch.setattr(ann, "EXACT_ROWS", exact)
        got: dict = {}
        for r in ann.neighbours(vectors, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["vec_id"])
        assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
        found = np.mean([len(set(got[q]) & set(want[q])) / 5 for q in want])
        assert got[50] == want[50] and (found == 1 if exact > 600 else found >= 0.8)
    assert ann.neighbours(vectors.where("false"), F.col("vec_id") % 50 == 0).count() == 0
