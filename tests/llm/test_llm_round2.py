"""Brute force, hot keys and clashes beyond test_small.py."""

import hashlib
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tarn.llm import ann, bpe, mixing, pii, quality_rules, queries, token_files
from tarn.llm.common import Remembered, table


def test_word_encoder_equals_the_library_beside_every_character():
    from tokenizers import Tokenizer

    j = queries.tokenizer_json(queries.WORD_TOKENIZER)
    texts = [f.format(chr(c)) for c in [*range(1, 0x2B0), 0x300, 0x2028, 0x212A, 0x3042, 0xFB01] for f in ("a{0}b", "1{0}2", ".{0}.", "{0}.", "A{0} {0}B Hello")]
    library, encoder = Tokenizer.from_str(j), token_files.WordEncoder(j)
    assert [x.tolist() for x in encoder([t.encode() for t in texts])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_remembered_is_bounded():
    held = Remembered(3)
    for step in ({b"a", b"b"}, {b"a", b"b", b"c", b"x" * 99}, {b"a", b"b", b"c", b"d"}):
        new = held.unknown(step)
        held.update({k: b"" for k in new})
        assert step <= held.keys()
        held.settle(new)
    assert len(held) <= 3 and b"x" * 99 not in held


def test_hot_doc_id_is_dealt_and_tokens_are_found_by_position(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = [(7, "the same row again")] * 400 + [(k, f"row {k} of many") for k in range(100)] + [(None, "nobody's")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    j = queries.tokenizer_json(queries.WORD_TOKENIZER)
    t, path = Tokenizer.from_str(j), f"file://{tmp_path}/tokens"
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    token_files.write_tokens(docs, j, 2, path, 64)
    got = token_files.read_documents(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda d: -1 if d is None else d)
    assert len({(r["shard"]) for r in got if r["doc_id"] == 7}) > 4
    ids = {text: [*t.encode(text, add_special_tokens=False).ids, 2] for _, text in rows}
    assert sorted(r["ids_crc32"] for r in got) == sorted(zlib.crc32(np.array(ids[x], "<u4").tobytes()) for _, x in rows)
    total = sum(r["n_tokens"] for r in got)
    found = dict(token_files.read_tokens(spark, path, spark.range(0, total + 5, 7).withColumnRenamed("id", "position")).collect())
    assert found.keys() == set(range(0, total, 7))
    starts = [(r["start"], r["n_tokens"], r["doc_id"]) for r in got]
    for position, token in found.items():
        start, _, doc = max(s for s in starts if s[0] <= position)
        assert token in {own[position - start] for (d, text) in rows if d == doc for own in (ids[text],) if position - start < len(own)}
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == batch


def test_bpe_digests_by_doc_id(spark):
    from tokenizers import Tokenizer

    texts = {k: t for k, t in enumerate([None, "", "a b", "naïve — 日本語", "x" * 5000, " \n\n it's", "日本語" * 900])}
    j = queries.tokenizer_json(queries.BYTE_TOKENIZER)
    library = Tokenizer.from_str(j)
    got = {r["doc_id"]: r for r in bpe.encoded(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), j, True).collect()}
    for k, text in texts.items():
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[k]["ids"] == ids and got[k]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[k]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def base_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    hit = {k + i for k, w in enumerate(windows) if windows.count(w) > 1 for i in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:k] for k, x in enumerate(lines)), len(hit)


def test_quality_base_equals_brute_force(spark, sf):
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, sf, "documents").collect()}
    got = {r["doc_id"]: r for r in queries.op4_quality_rules(spark, sf).collect()}
    for k, text in texts.items():
        if len(text) < 6000:
            want = base_by_hand(text)
            assert tuple(got[k][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
            assert got[k]["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])


def test_bands_reject_what_the_base_keeps():
    rng, c = np.random.default_rng(5), quality_rules.Compressor()
    noise = " ".join("".join(chr(33 + x) for x in rng.integers(0, 94, 9)) for _ in range(400))
    rows = " ".join(f"item {k} of the list is here" for k in range(400))
    got = quality_rules.measured([noise.encode(), rows.encode()], c)
    assert got["base_failed"][0] is False and got["kept"] == [False, False]


def test_pii_base_equals_the_patterns_and_long_digits_end(spark, sf):
    def plain(text):
        out = [("email", *m.span()) for m in pii.EMAIL.finditer(text)]
        out += [("ip", *m.span()) for m in pii.IP.finditer(text) if all(p.lstrip("0") == "" or len(p.lstrip("0")) <= 3 and int(p.lstrip("0")) <= 255 for p in m.group().split("."))]
        out += [("card", *m.span()) for m in pii.CARD.finditer(text) if 12 <= len(d := re.sub("[^0-9]", "", m.group())) <= 19 and pii.luhn(d)]
        return sorted(out + [("phone", *m.span()) for m in pii.PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15])

    rng = np.random.default_rng(8)
    texts = [r["text"] or "" for r in table(spark, sf, "documents").collect() if len(r["text"] or "") < 8000]
    texts += ["".join("0125.9 +@a-("[k] for k in rng.integers(0, 12, 60)) for _ in range(3000)] + ["0" * 5000 + ".1.1.1", "1.2.3.4.5.6.7.8.9"]
    for text in texts:
        assert sorted(pii.base_spans(text)) == plain(text)
    assert pii.base_spans("7" * 200_000) == [] and pii.all_spans("0" * 5000 + ".1.1.1", {})[1]


def test_pii_adds_planted_spans_and_leaves_clean_text_alone():
    rng = np.random.default_rng(9)
    say = lambda k: ["call us on {} today", "my number is {} thanks", "phone: {} ."][k % 3]
    number = lambda: "+" + " ".join(str(rng.integers(100, 999)) for _ in range(4))
    mail = lambda: f"{''.join(chr(97 + x) for x in rng.integers(0, 26, 6))}@mail{rng.integers(9)}.org"
    clean = ["we met at the dot of noon in 1999 with 25 of 300 people"] * 60 + [f"table {k} has 12.5 of {k * 37} rows" for k in range(60)]
    models = pii.trained([say(k).format(number()) + " or write to " + mail() for k in range(300)] + clean)
    assert {"email", "phone"} <= models.keys()
    planted = [f"please write to {mail().replace('@', ' at ').replace('.', ' dot ')} soon" for _ in range(50)]
    caught = [len(e) > len(b) for b, e in (pii.all_spans(t, models) for t in planted)]
    assert np.mean(caught) >= 0.8 and not any(pii.all_spans(t, models)[1] for t in clean)


def test_neighbours_at_production_settings(spark):
    sf, want = "/root/testdata/sf0.1", {}
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, sf, "embeddings").collect() if r["embedding"]]
    ids, x = np.array([k for k, _ in rows]), np.array([v for _, v in rows], float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in np.flatnonzero(ids % 50 == 0):
        s = u @ u[q]
        s[ids == ids[q]] = -9
        want[int(ids[q])] = set(ids[np.lexsort((ids, -np.round(s, 12)))[:5]].tolist())
    for least, floor in ((ann.EXACT_ROWS, 1.0), (0, 0.9)):
        kept, ann.EXACT_ROWS = ann.EXACT_ROWS, least
        try:
            got = {}
            for r in queries.op10_ann(spark, sf).collect():
                got.setdefault(r["query_id"], set()).add(r["vec_id"])
        finally:
            ann.EXACT_ROWS = kept
        assert got.keys() == want.keys() and np.mean([len(got[q] & want[q]) / 5 for q in want]) >= floor


def test_neighbours_of_an_id_with_two_vectors(spark):
    data = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [0.1, 1.0]), (3, [-1.0, 0.0])]
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.neighbours(spark.createDataFrame(data, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, 2).orderBy("rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2)]


def test_mixing_with_clashing_names(spark):
    docs = spark.createDataFrame([(k, "a b c", "en", "s", 1, 2.0, 0.5) for k in range(20)], "doc_id long, text string, lang string, source string, n long, raked double, probability double")
    out = mixing.drawn_documents(docs)
    assert out.columns == docs.columns and all(r["probability"] == 0.5 and r["n"] == 1 for r in out.collect())


def test_dedup_stage_keeps_one_row_of_a_doc_id_and_always_the_same(spark, sf):
    long = "one two three four five six seven eight nine ten"
    rows = [(1, long + " b", "x"), (1, long + " a", "y"), (2, long.replace("one", "uno"), "z"), (None, long, "w"), (None, long, "w"), (3, "other words here", "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    got = [sorted(map(tuple, corpus_pipeline.dedup_stage(spark, d, sf).collect()), key=str) for d in (docs, docs.orderBy(F.desc("shard")).repartition(3))]
    assert got[0] == got[1] and [r for r in got[0] if r[0] == 1] == [(1, long + " a", "y")] and len(got[0]) == 5


def test_run_equals_its_operators_by_hand(spark, sf):
    """run() against the stages' results held in Python: what each decides, row by row."""
    texts = {r["doc_id"]: r for r in table(spark, sf, "documents").collect()}
    quality = {r["doc_id"] for r in queries.op4_quality_rules(spark, sf).where("kept").collect()}
    docs = table(spark, sf, "documents").where(F.col("doc_id").isin(*quality))
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if (w := re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), texts[k]["text"]))) else set() for k in quality}
    up = {k: k for k in quality}

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    order = sorted(quality)
    for i, a in enumerate(order):
        for b in order[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    left = {k for k in quality if find(k) == k}
    docs = docs.where(F.col("doc_id").isin(*left))
    models = pii.fitted(docs)
    redacted = {k: pii.redacted(texts[k]["text"], pii.all_spans(texts[k]["text"], models)[1]) for k in left}
    drawn = {r["doc_id"] for r in mixing.mixed(spark.createDataFrame([(k, redacted[k], texts[k]["lang"], texts[k]["source"]) for k in left], "doc_id long, text string, lang string, source string")).where("_drawn").collect()}
    got = {r["doc_id"]: r["decoded_sha256"] for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == {k: hashlib.sha256(redacted[k].encode()).hexdigest() for k in drawn}
