"""The operators on what the reviewer of round 1 found: labelled junk, targets, disguises, small tables."""

import numpy as np
import pytest

from tarn.llm import mixing, pii, quality_rules


def junk_and_clean(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{x}.parquet") for x in ("documents", "labels"))
    return quality_rules.quality(docs).where("not base_failed").join(labels, "doc_id").select("quality", "kept").toPandas()


def test_bands_reject_labelled_junk_that_the_base_keeps(spark):
    seen = junk_and_clean(spark, "/root/testdata/sf0.1")
    junk, clean = seen[seen.quality == 0].kept, seen[seen.quality == 1].kept
    assert (~junk).mean() > 0.4 and (~clean).mean() < 0.002


def test_one_chunk_out_of_band_rejects_a_long_text(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{x}.parquet") for x in ("documents", "labels"))
    long = docs.join(labels, "doc_id").where("quality = 1 and octet_length(text) > 3 * 8192").orderBy("doc_id").first()["text"].encode()
    size, c = quality_rules.CHUNK_BYTES, quality_rules.Compressor()
    assert c.verdict(long)[1:] == (0.0, True)
    noise = bytes(np.random.default_rng(5).integers(33, 127, size).astype(np.uint8))
    for place in (0, size, 2 * size):
        _, share, fine = c.verdict(long[:place] + noise + long[place + size :])
        assert 0 < share < 0.5 and not fine


def test_repeated_documents_have_the_target_mix(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    given = {"_lang": {"en": 1, "de": 3}, "_topic": {"article": 1, "long": 1}}
    for targets in (None, given):
        out = mixing.repeated(docs, ["doc_id"], targets=targets).toPandas()
        every = out._tokens.sum()
        assert (out._tokens * out._expected).sum() / every == pytest.approx(mixing.RATE, rel=1e-6)
        for d in ("_lang", "_topic"):
            asked, copied = (x.groupby(out[d], dropna=False).sum() / every for x in (out._weight, out._tokens * out._copies / mixing.RATE))
            assert (asked - copied).abs().max() < 0.06
            if targets:
                goal = {k: v / sum(given[d].values()) for k, v in given[d].items()}
                assert all(v == pytest.approx(goal.get(k, 0), abs=0.02) for k, v in asked.items())
    assert {r["marginal"] for r in mixing.mix(mixing.repeated(docs, ["doc_id"])).collect()} == {"source", "lang", "topic"}


def test_two_cards_and_disguised_addresses_are_found(spark):
    text = "card 7536784127813050 4845168114407329 then, host 10 dot 1 dot 2 dot 3 or 192[.]168[.]7[.]9 here"
    found = {(k, text[a:b]) for k, a, b in pii.candidates(text)}
    cards, ips = {"7536784127813050", "4845168114407329"}, {"10 dot 1 dot 2 dot 3", "192[.]168[.]7[.]9"}
    assert {("card", c) for c in cards} | {("ip", i) for i in ips} <= found
    models = pii.fitted(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    _, every = pii.all_spans(text, models)
    assert {("card", c) for c in cards} | {("ip", i) for i in ips} <= {(k, text[a:b]) for k, a, b in every}
