"""Mixing sources to target weights: raking (iterative proportional fitting), then calibrated sampling.

Documents fall into cells of source, language and topic. SWEEPS rounds scale the cells' token weights to the target
share of each source, language and topic in turn. A target is a value's natural share to the power `temper`, made to
sum to 1 again, unless weights for the marginal are given in `targets`; then values without a weight get none. The sample is to hold `rate` of all tokens: a cell's documents are
drawn with probability min(1, lambda * raked / natural tokens), and lambda is what makes the expected tokens right; it
is exact, from the cells in order of their ratio. A document is drawn when a hash of seed and doc_id, as a number in
[0, 1), is below its probability, so every rerun draws the same ones.

Drawn so, a cell with too few documents is taken whole and falls short of its target, and the others get its tokens.
repeated() does not fall short: each document comes rate * raked / natural tokens times, the whole part of it always and
the rest by the same hash. mix() holds the drawn marginals of either against what raking came to and what was asked
for; largest_gap() tells how far raking is off, as it is where targets contradict each other.

All of it is DataFrame functions in one plan: documents are summed to cells before the shuffle, and only cells, of
which there are as many as combinations occur, are raked. Cells are broadcast back if there are at most
BROADCAST_CELLS of them, else joined by shuffle, where the session's skew handling splits hot cells.

A null source or language is a value of its own; so is a null text's topic, 'empty'. Documents without words weigh one
token. Rows that share a doc_id are drawn together. Very long texts count whole. Columns of docs may have any names but
those that mixed() adds, which replace them. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.common import written

SWEEPS, TEMPER, RATE, SEED, BROADCAST_CELLS = 12, 0.7, 0.8, "mix-1", 50_000
#: Stands for a null source or language.
MISSING = "\x00"


def tokens(text: str = "text") -> Column:
    """Runs of characters between white space, 1 at least."""
    blank = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.greatest(F.size(F.array_remove(F.split(blank, " "), "")), F.lit(1)).cast("long")


def topic(text: str = "text") -> Column:
    """A coarse topic by form, from the text's first matching trait."""
    t = F.coalesce(text, F.lit(""))
    n = F.char_length(t)
    return (
        F.when(F.trim(t) == "", "empty")
        .when((n - F.char_length(F.translate(t, "|", ""))) * 40 > n, "tables")
        .when((n - F.char_length(F.translate(t, "#*$%&<>", ""))) * 40 > n, "markup")
        .when((n - F.char_length(F.translate(t, "0123456789", ""))) * 40 > n, "numbers")
        .when(t.contains("Licensed") | t.contains("Copyright"), "licensed")
        .when(n < 600, "short")
        .when(n < 4000, "article")
        .otherwise("long")
    )


def uniform(seed: str, key: str) -> Column:
    """A number in [0, 1) of 52 bits from an MD5 of seed and key."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def weight(dim: str, given: dict[str | None, float]) -> Column:
    """The weight of the dim's value; 0 where none is given."""
    if not given or min(given.values()) < 0 or not sum(given.values()) > 0:
        raise ValueError(f"weights of {dim} must be 0 or more, and not all 0")
    out = F.lit(0.0)
    for value, w in given.items():
        out = F.when(F.col(dim) == F.lit(MISSING if value is None else value), F.lit(float(w))).otherwise(out)
    return out


def raked(cells: DataFrame, dims: tuple[str, ...], temper: float, sweeps: int, targets: dict[str, dict[str | None, float]] | None = None) -> DataFrame:
    """cells (dims, n) with `raked`, whose sums over each dim come to its target share of all tokens."""
    every = Window.partitionBy()
    out = cells
    targets = targets or {}
    if not set(targets) <= set(dims):
        raise ValueError(f"targets are of {dims}")
    for d in dims:
        own = weight(d, targets[d]) if d in targets else F.pow(F.sum("n").over(Window.partitionBy(d)) / F.sum("n").over(every), F.lit(temper))
        # each value's target once: its first cell carries it into the total
        out = out.withColumn(f"_p_{d}", own).withColumn(f"_f_{d}", F.row_number().over(Window.partitionBy(d).orderBy(*dims)) == 1)
        out = out.withColumn(f"_t_{d}", F.col(f"_p_{d}") / F.sum(F.when(F.col(f"_f_{d}"), F.col(f"_p_{d}")).otherwise(0.0)).over(every) * F.sum("n").over(every)).drop(f"_p_{d}", f"_f_{d}")
    out = out.withColumn("raked", F.col("n").cast("double"))
    for _ in range(sweeps):
        for d in dims:
            held = F.sum("raked").over(Window.partitionBy(d))
            # a weight of 0 leaves nothing to scale
            out = out.withColumn("raked", F.col("raked") * F.col(f"_t_{d}") / (F.nullif(held, F.lit(0.0)) if targets else held))
            out = out.withColumn("raked", F.coalesce("raked", F.lit(0.0))) if targets else out
    return out.select(*dims, "n", "raked")


def calibrated(cells: DataFrame, dims: tuple[str, ...], rate: float) -> DataFrame:
    """cells with `probability`; in order of ratio, the first k are taken whole where that is what rate asks for."""
    every, above = Window.partitionBy(), Window.orderBy(F.desc("ratio"), *dims).rowsBetween(Window.unboundedPreceding, -1)
    out = cells.withColumn("ratio", F.col("raked") / F.col("n"))
    left = F.sum("n").over(every) * rate - F.coalesce(F.sum("n").over(above), F.lit(0))
    rest = F.sum("raked").over(every) - F.coalesce(F.sum("raked").over(above), F.lit(0.0))
    out = out.withColumn("lam", F.when((left > 0) & (rest > 0), left / rest))
    # the first cell that its lambda does not take whole has the right one; without such a cell all are taken
    out = out.withColumn("lam", F.max(F.when(F.col("lam") * F.col("ratio") < 1, F.struct("ratio", F.col("lam").alias("v")))).over(every)["v"])
    return out.withColumn("probability", F.round(F.least(F.lit(1.0), F.coalesce(F.col("lam") * F.col("ratio"), F.lit(1.0))), 9)).select(*dims, "n", "raked", "probability")


def mixed(docs: DataFrame, columns: list[str] | None = None, temper: float = TEMPER, rate: float = RATE, seed: str = SEED, sweeps: int = SWEEPS, targets: dict[str, dict[str | None, float]] | None = None) -> DataFrame:
    """docs with _source, _lang, _topic, _tokens, _weight (raked tokens of the document), _probability, _drawn, and
    targets by _source, _lang or _topic.

    Where `columns` are only some of docs' and the text isn't one of them, texts are gone through once, not twice.
    """
    columns = docs.columns if columns is None else columns
    dims = ("_source", "_lang", "_topic")
    keys = docs.withColumns({"_source": F.coalesce("source", F.lit(MISSING)), "_lang": F.coalesce("lang", F.lit(MISSING)), "_topic": topic(), "_tokens": tokens()})
    if "text" not in columns:
        keys = written(keys.select("doc_id", *[c for c in columns if c != "doc_id"], *dims, "_tokens"), "keys")
    cells = written(keys.groupBy(*dims).agg(F.sum("_tokens").alias("n")), "cells")
    few = cells.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS
    fit = written(calibrated(written(raked(cells, dims, temper, sweeps, targets), "raked"), dims, rate), "probabilities")
    fit = fit.select(*dims, F.col("raked").alias("_raked"), F.col("n").alias("_natural"), F.col("probability").alias("_probability"))
    out = keys.drop("_raked", "_natural", "_probability").join(F.broadcast(fit) if few else fit, list(dims))
    out = out.withColumns({"_weight": F.col("_tokens") * F.col("_raked") / F.col("_natural"), "_drawn": uniform(seed, "doc_id") < F.col("_probability")})
    out = out.withColumns({d: F.when(F.col(d) != MISSING, F.col(d)) for d in ("_source", "_lang")})
    return out.select(*columns, *dims, "_tokens", "_weight", "_probability", "_drawn")


def drawn_documents(docs: DataFrame, **settings) -> DataFrame:
    """The rows that are drawn, with docs' columns."""
    return mixed(docs, **settings).where("_drawn").select(*docs.columns)


def repeated(docs: DataFrame, columns: list[str] | None = None, rate: float = RATE, seed: str = SEED, **settings) -> DataFrame:
    """mixed() without _probability and _drawn, but with _expected and _copies, how often a document is to come."""
    out = mixed(docs, columns, rate=rate, seed=seed, **settings)
    expected = F.round(F.col("_weight") / F.col("_tokens") * rate, 9)
    whole = F.floor(expected)
    out = out.withColumns({"_expected": expected, "_copies": whole + (uniform(seed, "doc_id") < expected - whole).cast("long")})
    return out.drop("_probability", "_drawn")


def mix(out: DataFrame, temper: float = TEMPER, targets: dict[str, dict[str | None, float]] | None = None) -> DataFrame:
    """(marginal, value, natural, asked, target, drawn): shares of tokens in what mixed() or repeated() gives.

    `asked` is the target share by temper and targets, which are to be those of the run, and `target` what raking came
    to. They differ where targets contradict each other or speak of values that no document has, which have a row too.
    """
    copies = F.col("_copies") if "_copies" in out.columns else F.col("_drawn").cast("long")
    dims = ("_source", "_lang", "_topic")
    cells = written(out.groupBy(*dims).agg(F.sum("_tokens").alias("natural"), F.sum("_weight").alias("target"), F.sum(F.col("_tokens") * copies).alias("drawn")), "mix")
    every = F.explode(F.array(*[F.struct(F.lit(d[1:]).alias("marginal"), F.col(d).alias("value")) for d in dims])).alias("m")
    sums = cells.select(every, "natural", "target", "drawn").select("m.marginal", "m.value", "natural", "target", "drawn", F.lit(0.0).alias("w"))
    given = [(d[1:], value, 0, 0.0, 0, float(w)) for d, weights in (targets or {}).items() for value, w in weights.items()]
    sums = sums.unionByName(out.sparkSession.createDataFrame(given, "marginal string, value string, natural long, target double, drawn long, w double"))
    sums = sums.groupBy("marginal", "value").agg(*[F.sum(c).alias(c) for c in ("natural", "target", "drawn", "w")])
    whole = Window.partitionBy("marginal")
    of = lambda c: c / F.nullif(F.sum(c).over(whole), F.lit(0.0))
    sums = sums.withColumn("asked", F.when(F.col("marginal").isin(*[d[1:] for d in targets or {}]), F.col("w")).otherwise(F.pow(of(F.col("natural")), F.lit(temper))))
    return sums.select("marginal", "value", *[F.round(of(F.col(c)), 6).alias(c) for c in ("natural", "asked", "target", "drawn")])


def largest_gap(report: DataFrame, tolerance: float | None = None) -> float:
    """The largest difference of asked and target shares in what mix() gives; above the tolerance an error."""
    gap = report.agg(F.max(F.abs(F.col("asked") - F.col("target"))).alias("gap")).first()["gap"] or 0.0
    if tolerance is not None and gap > tolerance:
        raise ValueError(f"raking leaves a share {gap:.6f} off its target, more than {tolerance}")
    return gap


def oracle(temper: float = TEMPER, rate: float = RATE, seed: str = SEED, sweeps: int = SWEEPS) -> str:
    """The same as DuckDB SQL over `documents`."""
    dims = ("source", "lang", "topic")
    steps = [f"""d AS (SELECT doc_id, coalesce(source, chr(1)) AS source, coalesce(lang, chr(1)) AS lang,
      CASE WHEN trim(t) = '' THEN 'empty' WHEN (length(t) - length(replace(t, '|', ''))) * 40 > length(t) THEN 'tables'
        WHEN (length(t) - length(translate(t, '#*$%&<>', ''))) * 40 > length(t) THEN 'markup'
        WHEN (length(t) - length(translate(t, '0123456789', ''))) * 40 > length(t) THEN 'numbers'
        WHEN contains(t, 'Licensed') OR contains(t, 'Copyright') THEN 'licensed'
        WHEN length(t) < 600 THEN 'short' WHEN length(t) < 4000 THEN 'article' ELSE 'long' END AS topic,
      greatest(len(string_split_regex(regexp_replace(t, '^[\\t-\\r ]+|[\\t-\\r ]+$', '', 'g'), '[\\t-\\r ]+')), 1)::BIGINT AS tokens,
      ('0x' || substr(md5(concat('{seed}:', coalesce(doc_id::VARCHAR, 'null'))), 1, 13))::UBIGINT::DOUBLE / {1 << 52}.0 AS u
      FROM (SELECT *, coalesce(text, '') AS t FROM documents))""", "c AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS n FROM d GROUP BY ALL)"]
    for d in dims:
        steps.append(f"t_{d} AS (SELECT {d}, p / sum(p) OVER () * (SELECT sum(n) FROM c) AS target_{d} FROM (SELECT {d}, pow(sum(n) / (SELECT sum(n) FROM c), {temper}) AS p FROM c GROUP BY {d}))")
    steps.append("r0 AS MATERIALIZED (SELECT *, n AS raked FROM c JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic))")
    for k, d in enumerate(dims * sweeps):
        steps.append(f"r{k + 1} AS MATERIALIZED (SELECT * REPLACE (raked * target_{d} / sum(raked) OVER (PARTITION BY {d}) AS raked) FROM r{k})")
    steps.append(f"""q AS (SELECT *, raked / n AS ratio, (sum(n) OVER () * {rate} - coalesce(sum(n) OVER w, 0)) AS l, sum(raked) OVER () - coalesce(sum(raked) OVER w, 0) AS r
      FROM r{3 * sweeps} WINDOW w AS (ORDER BY raked / n DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""")
    steps.append("m AS (SELECT arg_max(l / r, ratio) AS lam FROM q WHERE l > 0 AND r > 0 AND l / r * ratio < 1)")
    steps.append("f AS (SELECT q.*, round(least(1.0, coalesce(lam * ratio, 1.0)), 9) AS probability FROM q, m)")
    return f"""WITH {", ".join(steps)} SELECT doc_id, nullif(d.source, chr(1)) AS source, nullif(d.lang, chr(1)) AS lang, d.topic, tokens, round(probability, 6) AS probability, u < probability AS drawn
      FROM d JOIN f USING (source, lang, topic)"""
