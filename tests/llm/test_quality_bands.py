"""Compression bands: the limits against a count by hand, and on manuals from outside the tables."""

import base64

import numpy as np
import pytest
from pydoc_data.topics import topics

from tarn.llm import quality_rules, wordhash
from tarn.llm.common import table


def passing(texts):
    hashes, first = wordhash.words(texts)
    parts = [hashes[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
    return [t for t, h in zip(texts, parts, strict=True) if not quality_rules.base_fails(len(h), quality_rules.repeated_words(h))]


def test_limits_equal_a_count_by_hand(spark, sf):
    docs = table(spark, sf, "documents")
    c, seen = quality_rules.Compressor(), {}
    for text in set(passing([(r["text"] or "").encode() for r in docs.collect()])):
        for x in (text, *quality_rules.chunks(text)):
            seen.setdefault(quality_rules.class_of(x), {})[x] = int(quality_rules.STEP * c.ratio(x)) / quality_rules.STEP
    got = quality_rules.fitted(docs.union(docs))
    assert got.keys() == seen.keys()
    for kind, ratios in seen.items():
        quartiles = np.quantile(list(ratios.values()), [0.25, 0.5, 0.75], method="inverted_cdf")
        assert got[kind] == pytest.approx(quality_rules.limits_of(kind, len(ratios), *quartiles))


def manuals():
    """The language's manual in pieces, without those that hold drawn tables (repetitive, and rejected as such)."""
    out = []
    for text in topics.values():
        data, at = text.encode(), 0
        while at < len(data):
            size = 700 + 613 * (len(out) % 13)
            out.append(data[at : at + size])
            at += size
    return passing([x for x in out if len(x) > 300 and b"+---" not in x])


def test_prose_from_outside_is_kept_and_junk_is_not(spark):
    prose, rng = manuals(), np.random.default_rng(11)
    noise = [base64.b64encode(rng.bytes(3 * n)).decode() for n in (400, 900, 2500)]
    noise = [" ".join(x[k : k + 9] for k in range(0, len(x), 9)) for x in noise]
    rows = [" ".join(f"row {k} holds {k + 1} and {2 * k}" for k in range(n)) for n in (100, 300, 900)]
    texts = [x.decode(errors="ignore") for x in prose] + noise + rows
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "doc_id long, text string")
    got = quality_rules.quality(docs).toPandas().set_index("doc_id")
    assert not got.base_failed[len(prose) :].any() and not got.kept[len(prose) :].any()
    assert len(prose) > 100 and got.kept[: len(prose)].mean() >= 0.99


def test_copies_of_one_text_do_not_narrow_the_limits(spark):
    prose = [x.decode(errors="ignore") for x in manuals()]
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(prose)], "doc_id long, text string")
    copies = spark.createDataFrame([(-k, prose[0]) for k in range(len(prose))], "doc_id long, text string")
    assert quality_rules.fitted(docs) == quality_rules.fitted(docs.union(copies))


def test_nothing_and_nulls_have_the_limits_of_prose(spark):
    none = spark.createDataFrame([(1, None), (2, ""), (None, "a b")], "doc_id long, text string")
    assert quality_rules.fitted(none) == quality_rules.fitted(none.where("false")) == {}
    assert [r["kept"] for r in quality_rules.quality(none).collect()] == [False] * 3
