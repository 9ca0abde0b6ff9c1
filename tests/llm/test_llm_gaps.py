"""What was asked against what was raked, and personal data in long texts."""

import time

import numpy as np
import pytest

from tarn.llm import mixing, pii


def test_mix_tells_what_was_asked_from_what_was_raked(spark):
    rows = [(k, "word " * 20, "en" if k % 2 else "de", "s0" if k % 2 else "s1") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    good = mixing.mix(mixing.mixed(docs))
    assert mixing.largest_gap(good, 1e-5) <= 1e-5
    against = {"_lang": {"en": 9, "de": 1}, "_source": {"s0": 1, "s1": 9}}  # en is s0 throughout
    report = mixing.mix(mixing.mixed(docs, targets=against), targets=against)
    asked = {(r["marginal"], r["value"]): r["asked"] for r in report.collect()}
    assert asked["lang", "en"] == pytest.approx(0.9) and asked["source", "s0"] == pytest.approx(0.1)
    assert mixing.largest_gap(report) > 0.3
    with pytest.raises(ValueError, match="off its target"):
        mixing.largest_gap(report, 0.01)
    absent = {"_lang": {"en": 1, "xx": 9}}
    shown = {r["value"]: (r["natural"], r["asked"], r["target"]) for r in mixing.mix(mixing.mixed(docs, targets=absent), targets=absent).where("marginal = 'lang'").collect()}
    assert shown["xx"] == (0.0, pytest.approx(0.9), 0.0) and shown["en"][1:] == (pytest.approx(0.1), 1.0) and shown["de"][1:] == (0.0, 0.0)
    assert mixing.largest_gap(mixing.mix(mixing.mixed(docs.where("false")))) == 0.0


def test_stretches_meet_as_all_pairs_do():
    rng = np.random.default_rng(4)
    for _ in range(200):
        spans = [("ip", int(a), int(a + n)) for a, n in zip(rng.integers(0, 60, 8), rng.integers(1, 9, 8), strict=True)]
        taken, alone, own = pii.Taken(spans), pii.Taken(), []
        for s in [("ip", int(a), int(a + n)) for a, n in zip(rng.integers(0, 70, 20), rng.integers(1, 9, 20), strict=True)]:
            assert taken.meets(s) == any(s[1] < e and b < s[2] for _, b, e in spans)
            assert alone.meets(s) == any(s[1] < e and b < s[2] for _, b, e in own)
            if not alone.meets(s):
                alone.add(s)
                own.append(s)


def test_spans_of_a_long_text_take_time_that_grows_with_it():
    one = "write to a.b@mail.org or +49 170 1234567, host 10.1.2.3, number 555 0100 222 then. "
    models = pii.trained([one.replace("1", str(k % 10)) for k in range(200)] + ["table 12 of 37 has 4500 rows of 19"] * 100)
    taken = []
    for n in (1500, 12000):  # 0.12 and 1 MB
        began = time.process_time()
        base, every = pii.all_spans(one * n, models)
        taken.append(time.process_time() - began)
        assert len(base) == 3 * n and len(every) >= len(base)
    assert taken[1] < 8 * taken[0] * 2.5
