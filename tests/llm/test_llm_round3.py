"""Jaccard join, hard negatives and lexical search against brute force."""

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tarn.llm import hard_negatives, jaccard_join, lexical, minhash

WORD, TERM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def shingles(text, width=5):
    w = WORD.findall(lowered(text))
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def classes(rows, percent=80):
    """doc_id: (least size of its sets, smallest doc_id reachable), rows of one doc_id as one document."""
    sets = [(d, shingles(t)) for d, t in rows if d is not None]
    least = {d: d for d, _ in sets}
    links = [(a, b) for k, (a, s) in enumerate(sets) for b, t in sets[:k] if s and t and (a == b or 100 * len(s & t) >= percent * len(s | t))]
    while any(least[a] != least[b] for a, b in links):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    return least


def test_heap_merge_that_skips_counts_like_a_counter():
    rng = np.random.default_rng(1)
    for _ in range(300):
        lists = [sorted(set(rng.integers(0, 40, rng.integers(0, 25)).tolist())) for _ in range(rng.integers(1, 12))]
        least = int(rng.integers(1, len(lists) + 2))
        counts = Counter(x for own in lists for x in own)
        assert jaccard_join.merged_short(lists, least) == {x: n for x, n in counts.items() if n >= least}


def test_divide_skip_finds_the_linked_sets():
    rng = np.random.default_rng(2)
    for _ in range(60):
        base = rng.integers(0, 1 << 60, rng.integers(1, 80)).astype(np.uint64)
        sets = [np.unique(np.where(rng.random(len(base)) < rng.choice([0, 0.05, 0.1, 0.3]), rng.integers(0, 1 << 60, len(base)).astype(np.uint64), base)) for _ in range(12)]
        sets += [np.zeros(0, np.uint64), base[:3]]
        asked, percent = np.unique(base), int(rng.choice([50, 80, 85, 100]))
        want = [k for k, s in enumerate(sets) if len(s) and 100 * len(set(s.tolist()) & set(asked.tolist())) >= percent * len(set(s.tolist()) | set(asked.tolist()))]
        assert jaccard_join.Lists(sets).linked(asked, percent) == want
    assert jaccard_join.Lists([base]).linked(np.zeros(0, np.uint64), 80) == []


def test_frequent_shingles_come_last_and_the_list_is_bounded(spark):
    docs = spark.createDataFrame([(k, f"own{k} a b c d e f g h i j tail{k}") for k in range(40)], "node long, text string")
    known = jaccard_join.frequencies(docs, 5, 40 * 8)
    common = minhash.shingle_sets([b"a b c d e f g h i j"], 5)[0]
    own = minhash.shingle_sets([b"own1 a b c d e f g h i j tail1"], 5)[0]
    assert len(known.keys) == 6 and set(known.ordered(own)[2:].tolist()) == set(common.tolist())
    assert len(jaccard_join.frequencies(docs, 5, 40 * 8, listed=3).keys) == 0


def test_jaccard_join_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    say = lambda n: [f"W{x}" for x in rng.integers(0, 4000, n)]
    passage, rows = say(50), []
    for k in range(12):
        base = say(int(rng.integers(5, 90)))
        for _ in range(int(rng.integers(1, 14))):
            words = [w if rng.random() > 0.02 else f"x{rng.integers(9999)}" for w in base]
            rows.append(" ".join(words))
    rows += [" ".join(passage + say(int(rng.integers(0, 12)))) for _ in range(60)]  # a frequent passage, at the border of the rule
    rows += ["one two", "One  TWO", "three", "", " \n", None, "one two three four five", "one two three four five six"] + rows[:20]
    table = [(int(d), t) for d, t in zip(rng.permutation(len(rows)) + 5, rows, strict=True)]
    table += [(3, rows[0]), (3, rows[70]), (3, rows[0]), (None, rows[0]), (4, "long " * 30_000), (2, "long " * 30_001)]
    docs = spark.createDataFrame([(d, t, 1, 2, 3) for d, t in table], "doc_id long, text string, node int, bucket int, component_id int")
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.joined(docs).collect()]
    least = classes(table)
    want = [(d, len(shingles(t)) if d is not None else 0, least.get(d)) for d, t in table]
    order = lambda x: sorted(x, key=lambda r: (r[0] is not None, r))
    # a row without anything in it stands alone even if another row has its doc_id
    assert order(got) == order(want)


def test_jaccard_join_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.joined(empty).collect() == []
    assert [tuple(r) for r in jaccard_join.joined(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).orderBy("doc_id").collect()] == [(1, 0, 1), (2, 0, 2)]


def mined_by_hand(rows, n_pos=5, n_neg=3):
    vectors = sorted({(i, c, tuple(math.floor(256 * x) for x in v)) for i, c, v in rows})
    dot, out = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)), []
    for i, c, v in vectors:
        if i % 50:
            continue
        scored = sorted((-dot(v, w), j, d) for j, d, w in vectors if j != i)
        for p, j, _ in [s for s in scored if s[2] == c][:n_pos]:
            fine = [(s, k) for s, k, d in scored if d != c and 50 * -p <= 100 * -s <= 95 * -p][:n_neg]
            out += [(i, j, r, k, -p, -s) for r, (s, k) in enumerate(fine, 1)]
    return sorted(out)


def test_hard_negatives_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    for size, spread, dims in ((700, 0.3, 6), (300, 3.0, 40), (120, 0.0, 3)):
        centers = rng.normal(size=(5, dims))
        rows = [(k, int(rng.integers(0, 4)), (centers[k % 5] + spread * rng.normal(size=dims)).tolist()) for k in range(size)]
        rows += rows[:30]  # repeated rows, and equal vectors under other ids
        rows += [(1000 + k, c, v) for k, (_, c, v) in enumerate(rows[:60])]
        odd = [(None, 1, rows[0][2]), (2050, None, rows[0][2]), (2100, 1, None), (2150, 1, [float("nan")] * dims), (2200, 1, [None] * dims), (2250, 1, [float("inf")] + [0.0] * (dims - 1)), (2300, 1, [1.0])]
        table = spark.createDataFrame([(*r, "id", "cell") for r in [*rows, *odd]], "vec_id long, label int, embedding array<double>, id string, cell string")
        got = hard_negatives.mined(table, F.col("vec_id") % 50 == 0, F.col("label"), pivots=5)
        assert sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()) == mined_by_hand(rows)


def test_hard_negatives_of_large_components_few_rows_and_none(spark):
    big = [(0, 1, [3e9, 1.0]), (1, 1, [3e9, 7.0]), (2, 2, [2e9, 5.0]), (3, 2, [2e9, 6.0]), (50, 3, [0.0, 0.0]), (51, 3, [1.0, 1.0])]
    kind = "vec_id long, label int, embedding array<double>"
    mine = lambda rows: sorted(tuple(r) for r in hard_negatives.mined(spark.createDataFrame(rows, kind), F.col("vec_id") % 50 == 0, F.col("label")).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    limit = (1 << 63) - 1
    assert [r for r in mined_by_hand(big) if max(r[4:]) <= limit] == [r for r in mine(big) if r[4] < limit]
    assert mine([]) == mine([(0, 1, [1.0, 2.0])]) == mine([(0, None, None)]) == mine([(0, 1, [])]) == []


def test_brackets_hold_and_prune():
    rng = np.random.default_rng(5)
    rows = np.floor(256 * (np.repeat(rng.normal(size=(8, 10)), 40, axis=0) + 0.02 * rng.normal(size=(320, 10))))
    longest = float((rows * rows).sum(axis=1).max())
    known = hard_negatives.Pivots(np.zeros((0, 0)), longest)
    known.points = hard_negatives.farthest(known.lifted(rows), 16)
    far, to, kept = known.distances(known.lifted(rows)), known.of_anchors(rows), 0
    for q in range(0, 320, 7):
        lower, upper = known.bracket(rows[q], to[q], far, far)
        exact = rows @ rows[q]
        assert (lower <= exact).all() and (exact <= upper).all()
        kept += (upper >= np.sort(exact)[-5]).mean()
    assert kept / len(range(0, 320, 7)) < 0.5


def ranked_by_hand(docs, items, k=10):
    terms = [(d, Counter(TERM.findall(lowered(t)))) for d, t in docs]
    terms = [(d, c, sum(c.values())) for d, c in terms if c]
    count, total, out = len(terms), sum(n for _, _, n in terms), []
    df = Counter(t for _, c, _ in terms for t in c)
    for item in sorted({i for i, _ in items if i is not None}):
        asked = Counter(x for t in {t for i, t in items if i == item} for x in TERM.findall(lowered(t)))
        scored = []
        for d, c, n in terms:
            m = 25 + 75 * n * count // total
            score = sum(times * math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, times in asked.items() if c[t])
            if score > 0 and d is not None:
                scored.append((-score, d))
        out += [(item, r, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return out


def test_lexical_search_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    weight = 1 / np.arange(1, 301)
    say = lambda n: " ".join(f"{'Ä' if x % 9 == 0 else 'T'}{x}{'-' if x % 5 else '. '}" for x in rng.choice(300, n, p=weight / weight.sum()))
    docs = [(k, say(int(rng.integers(1, 60)))) for k in range(900)] + [(None, say(20)), (901, None), (902, ""), (903, " -- "), (904, "only904 " * 50_000)]
    docs += docs[:5]
    items = [(k, say(int(rng.integers(1, 12)))) for k in range(25)] + [(3, "T1 T2"), (3, "T1 T2"), (None, "T1"), (30, None), (31, "nowhere"), (32, "only904 only904 T7")]
    table = spark.createDataFrame([(*d, 7, 8) for d in docs], "doc_id long, text string, n int, score int").repartition(3)
    asked = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, rank string")
    want = ranked_by_hand(docs, items)
    for block in (1 << 19, 20):
        assert sorted(tuple(r) for r in lexical.search(table, asked, asked=block).collect()) == want


def test_shards_prune_without_loss():
    rng = np.random.default_rng(7)
    rows, terms = np.nonzero(rng.random((4000, 30)) < 1 / np.arange(2, 32))
    impact = rng.integers(1, 900, len(rows))
    shard, ids = lexical.Shard(terms, rows, impact, 30), rng.permutation(4000)
    for _ in range(20):
        asked, weight = np.sort(rng.choice(30, 8, replace=False)), rng.integers(0, 50, 8)
        score = np.zeros(4000, np.int64)
        for t, w in zip(asked, weight, strict=True):
            score[rows[terms == t]] += w * impact[terms == t]
        best = [(s, d) for s, d in sorted(zip((-score).tolist(), ids.tolist(), strict=True))[:10] if s]
        got = shard.best(asked, weight, ids, (np.zeros(0, np.int64), np.zeros(0, np.int64)), 10, chunk=64)
        assert list(zip((-got[0]).tolist(), got[1].tolist(), strict=True)) == best


def test_lexical_search_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(docs.limit(0), items).collect() == lexical.search(docs, items.limit(0)).collect() == lexical.search(docs, items.withColumn("text", F.lit(None).cast("string"))).collect() == []
