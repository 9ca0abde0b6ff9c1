"""The facility layer: filter cascade, brands, buckets, reclassification, verification, coordinate repair."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions import geo, text
from tarn.plans import fixed, packs, rules
from tarn.plans.rulebook import Rulebook
from tarn.plans.rules import Rule, contains_any, matches, starts_with_any
from tarn.sources.scratch import sent_if_small


def cascade(pack: packs.FacilityPack = packs.FACILITY, name: str = "n", operator: str = "op", owner: str = "ot", code: str = "ct", naics: str = "na") -> Column:
    """The rule that decides a record; ids that begin with kept_ keep it."""
    n = F.lower(text.text(name))
    all_ = F.concat_ws(" ", n, F.lower(text.text(operator)), F.lower(text.text(owner)))
    codes = rules.naics_codes(F.col(naics))
    has = lambda *c: F.arrays_overlap(codes, F.array(*[F.lit(x) for x in c]))
    positive, negative = contains_any(n, pack.positive), contains_any(n, pack.negative)
    renders = matches(n, pack.rendering)
    return rules.first_match(
        [
            Rule("kept_consolidator", F.coalesce(F.col(code).isin(*pack.brand_codes), F.lit(False)) | contains_any(all_, pack.brands)),
            Rule("dropped_treatment_works", contains_any(n, pack.treatment_works)),
            Rule("dropped_municipal", starts_with_any(F.trim(n), pack.municipal_starts) | contains_any(n, pack.municipal_parts)),
            Rule("dropped_negative", negative & ~positive),
            Rule("kept_562991", has("562991")),
            Rule("kept_311613_brand", has("311613") & matches(all_, pack.renderer_brands)),
            Rule("kept_311613_term", has("311613") & renders),
            Rule("dropped_311613_meat", has("311613") & matches(n, pack.meat)),
            Rule("kept_311613", has("311613")),
            Rule("kept_562219", has("562219")),
            Rule("kept_562111_positive", has("562111", "221320") & positive),
            Rule("dropped_562111", has("562111", "221320")),
            Rule("kept_positive", positive),
        ],
        "dropped_no_signal",
    )


def is_collector(keywords=fixed.COLLECTING, weak=fixed.COLLECTING_WEAK, strong=fixed.COLLECTING_STRONG, municipal: str = "|".join(fixed.NOT_COLLECTING_MUNICIPAL), works=fixed.NOT_COLLECTING_WORKS, negative=fixed.NOT_COLLECTING, naics: str = "na", name: str = "n") -> Column:
    """NAICS 562991 or a keyword (a weak one needs a strong one beside it), and nothing that speaks against; a name."""
    n = F.lower(text.text(name))
    keyword = contains_any(n, [k for k in keywords if k not in weak]) | (contains_any(n, weak) & contains_any(n, strong))
    return (F.trim(n) != "") & (F.array_contains(rules.naics_codes(F.col(naics), ";"), "562991") | keyword) & ~matches(n, municipal) & ~contains_any(n, works) & ~contains_any(n, negative)


def brand(families, name: Column) -> Column:
    """struct(parent, type) of the first family (pattern, parent, type) that the name matches, else itself, independent.

    For a few families; a rulebook takes hundreds.
    """
    out = None
    for pattern, parent, kind in families:
        one = F.struct(F.lit(parent).alias("parent"), F.lit(kind).alias("type"))
        out = F.when(matches(name, pattern), one) if out is None else out.when(matches(name, pattern), one)
    return out.otherwise(F.struct(name.alias("parent"), F.lit("Independent").alias("type")))


#: Rules of families, whose kind is the family's number: patterns as whole words, and words as they are.
FAMILY_RULES = Rulebook([(str(k), rf"\b(?:{p})\b") for k, (*_, patterns) in enumerate(fixed.FAMILIES) for p in patterns])
OWNER_RULES = Rulebook([(str(k), rf"\b{re.escape(w)}\b") for k, (*_, words) in enumerate(fixed.COLLECTOR_OWNERS) for w in words])


def _family(rulebook: Rulebook, name: Column, values: list[tuple[str, ...]], columns: tuple[str, ...]) -> Column:
    """A struct of the values of the first family that a rule finds, or null."""
    every = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(columns, row, strict=True)]) for row in values])
    number = rulebook.first_kind(rulebook.found(name)).cast("int")
    return F.when(number.isNotNull(), F.element_at(every, number + 1))


def consolidator(name: Column) -> Column:
    """struct(code, type, parent) of the first consolidator whose patterns the name matches, or null."""
    return _family(FAMILY_RULES, name, [f[:3] for f in fixed.FAMILIES], ("code", "type", "parent"))


def collector_owner(name: Column) -> Column:
    """struct(parent, type) of the collector's owner by the name; else the name itself, independent."""
    found = _family(OWNER_RULES, name, [f[:2] for f in fixed.COLLECTOR_OWNERS], ("parent", "type"))
    return F.coalesce(found, F.struct(F.coalesce(name, F.lit("")).alias("parent"), F.lit("Independent").alias("type")))


def entity(name: Column, naics: Column) -> Column:
    """plant or pumper, by codes and words; plants first, and plant where nothing says."""
    n, codes = F.lower(F.coalesce(name, F.lit(""))), rules.naics_codes(naics)
    has = lambda some: F.arrays_overlap(codes, F.array(*[F.lit(c) for c in some]))
    return F.when(has(fixed.PLANT_CODES) | contains_any(n, fixed.PLANT_WORDS), "plant").when(has(fixed.PUMPER_CODES) | contains_any(n, fixed.PUMPER_WORDS), "pumper").otherwise("plant")


def supplements(registry: DataFrame, existing: DataFrame) -> DataFrame:
    """Consolidators' facilities of a registry (i, n, na, lat, lng as texts, ..) that existing (i) lacks: with numbers as
    coordinates, within the country's frame, rounded, and op, ot, ct, e by name and codes. Rows without id or name go."""
    lat, lng = F.col("lat").try_cast("double"), F.col("lng").try_cast("double")
    fine = (F.coalesce("i", F.lit("")) != "") & F.col("n").isNotNull() & (lat > 17) & (lat < 72) & (lng > -180) & (lng < -64)
    rows = registry.where(fine).join(existing.select("i").distinct(), "i", "left_anti").withColumn("_c", consolidator(F.col("n"))).where("_c is not null")
    others = [c for c in registry.columns if c not in ("lat", "lng")]
    return rows.select(*others, F.round(lat, 5).alias("la"), F.round(lng, 5).alias("lo"), F.col("_c.parent").alias("op"), F.col("_c.type").alias("ot"), F.col("_c.code").alias("ct"), entity(F.col("n"), F.col("na")).alias("e"))


def bucket(o: Column) -> Column:
    """The owner bucket of an owner type."""
    o = F.coalesce(o, F.lit(""))
    return (
        F.when(o == "", "LOC").when(o.startswith("Wind River"), "WRE").when(o.startswith("LES"), "LES").when(o.contains("Darling"), "DAR").when(o.startswith("Baker"), "BAK")
        .when(o.startswith("WRM") | o.contains("WRM ("), "WRM").when(o.contains("Eazy Grease"), "REG").when(o.startswith("Momentum") | o.contains("Septic Blue"), "PE").when(o.contains("Barrel") | o.contains("Public:"), "PUB")
        .when(o.contains("PE-Backed:") | o.startswith("Heritage") | o.startswith("Chuck"), "PE").when(o.contains("Regional:"), "REG").when(o.contains("Local:") | (o == "Independent"), "LOC").otherwise("PE")
    )


def legacy_owner(o: Column) -> Column:
    return F.when(o.startswith("Local:") | o.startswith("Regional:"), "Independent").when(o.startswith("Public:"), o).when(o.startswith("PE-Backed:"), F.trim(F.regexp_replace(o, "^PE-Backed:", ""))).otherwise(o)


def reclassified(rows: DataFrame, false_public: list[str], by_code: dict[str, tuple[str, str]], by_owner: list[tuple[str, str]], fallback: tuple[str, str], later: list[tuple[str, str, str, bool]]) -> DataFrame:
    """rows (n, op, ot, ct) with new ct and ot: public first, then each of `later` (pattern, ct, ot, skip public ones).

    A false public name goes back to local owners; else its code, else (for PE) its owner text, else the fallback
    pattern decides.
    """
    n, both = F.lower(text.text("n")), F.concat_ws(" ", text.text("n"), text.text("op"))
    state = F.struct(F.col("ct").alias("ct"), F.col("ot").alias("ot"))
    made = lambda ct, ot: F.struct(F.lit(ct).alias("ct"), ot.alias("ot") if isinstance(ot, Column) else F.lit(ot).alias("ot"))
    demoted = F.when((F.col("ct") == "PUB") | F.coalesce(F.col("ot").contains("Public:"), F.lit(False)), made("LOC", F.concat(F.lit("Local: "), text.title_cased("n")))).otherwise(state)
    out = F.when(contains_any(n, false_public), demoted)
    for code, (ct, label) in by_code.items():
        out = out.when(F.col("ct") == code, made(ct, label))
    for part, label in by_owner:
        out = out.when((F.col("ct") == "PE") & F.lower(text.text("ot")).contains(part), made("PUB", label))
    rows = rows.withColumn("_s", out.when(matches(both, fallback[0]), made("PUB", fallback[1])).otherwise(state))
    for pattern, ct, label, skip in later:
        hit = matches(both, pattern)
        rows = rows.withColumn("_s", F.when(hit & ~F.coalesce(F.col("_s.ct") == "PUB", F.lit(False)) if skip else hit, made(ct, label)).otherwise(F.col("_s")))
    return rows.withColumns({"ct": F.col("_s.ct"), "ot": F.col("_s.ot")}).drop("_s")


def verified(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """rows with vs: C or U; refuted ones go, unknown ones stay with null. No verdicts at all change nothing."""
    if verdicts.isEmpty():
        return rows.withColumn("vs", F.lit(None).cast("string"))
    vs = F.when(F.col("classification") == "CONFIRMED_FOG", "C").when(F.col("classification") == "NOT_FOG", "N").otherwise("U")
    return rows.join(verdicts.select("id", vs.alias("vs")), "id", "left").where(F.col("vs").isNull() | (F.col("vs") != "N"))


def merged_verdict(found: Column, reason: Column, branded: Column) -> Column:
    """struct(classification, reason): a refuted brand is unclear; no valid verdict is unclear too."""
    valid = found.isin("CONFIRMED_FOG", "NOT_FOG", "UNCLEAR")
    made = lambda c, r: F.struct(c.alias("classification"), r.alias("reason"))
    return F.when(~F.coalesce(valid, F.lit(False)), made(F.lit("UNCLEAR"), F.lit("no verdict returned"))).when((found == "NOT_FOG") & branded, made(F.lit("UNCLEAR"), F.substring(F.concat(F.lit("DEMOTED: "), reason), 1, 200))).otherwise(made(found, F.substring(reason, 1, 200)))


def crosstab(results: DataFrame) -> DataFrame:
    """Tier by classification with a total row and the share of refuted ones in percent."""
    one = lambda c: F.count_if(F.col("classification") == c).alias(c.lower())
    out = results.rollup("tier").agg(F.count("*").alias("checked"), one("CONFIRMED_FOG"), one("NOT_FOG"), one("UNCLEAR"))
    return out.select(F.coalesce("tier", F.lit("TOTAL")).alias("tier"), "checked", "confirmed_fog", "not_fog", "unclear", F.round(F.col("not_fog") * 100.0 / F.col("checked"), 4).alias("fp_rate"))


def stratified(rows: DataFrame, quotas: dict[str, int], key: str = "id", seed: int = 42) -> DataFrame:
    """Of each tier its quota, in the order of a seeded MD5.

    Ranks above the largest quota are cut off in every task before the shuffle, so a hot tier is no one task's.
    """
    from pyspark.sql import Window

    quota = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])[F.col("tier")]
    place = F.row_number().over(Window.partitionBy("tier").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key))
    most = max(quotas.values(), default=0)
    return rows.where(F.col("tier").isin(*quotas)).withColumn("_p", place).where(F.col("_p") <= most).where(F.col("_p") <= quota).drop("_p")


def shortfall(sample: DataFrame, quotas: dict[str, int]) -> DataFrame:
    """(tier, quota, taken, missing) for every tier with a quota, those that nothing was taken of too."""
    asked = sample.sparkSession.createDataFrame(list(quotas.items()), "tier string, quota long")
    taken = sample.groupBy("tier").agg(F.count("*").alias("taken"))
    out = F.broadcast(asked).join(taken, "tier", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
    return out.withColumn("missing", F.col("quota") - F.col("taken"))


def repaired(rows: DataFrame, boxes: DataFrame, zips: DataFrame) -> DataFrame:
    """rows (.., s, z, lat, lng) with coordinates out of their state's box set to the ZIP's point, if that is inside, or
    to the box's middle; `fix` says which. boxes (s, south, north, west, east) and zips (zip, z_lat, z_lng)."""
    r = rows.join(sent_if_small(boxes), "s", "left").withColumn("zip", text.first_zip("z")).join(zips, "zip", "left")
    box = [F.col(c) for c in ("south", "north", "west", "east")]
    fine = geo.in_box(F.col("lat"), F.col("lng"), *box)
    by_zip = F.col("z_lat").isNotNull() & geo.in_box(F.col("z_lat"), F.col("z_lng"), *box)
    fix = F.when(fine, F.lit(None).cast("string")).when(by_zip, "zip").otherwise("state_centroid")
    pick = lambda own, z, a, b: F.when(F.col("fix").isNull(), F.col(own)).when(F.col("fix") == "zip", F.col(z)).otherwise((F.col(a) + F.col(b)) / 2).alias(own)
    return r.withColumn("fix", fix).select(*[c for c in rows.columns if c not in ("lat", "lng")], pick("lat", "z_lat", "south", "north"), pick("lng", "z_lng", "west", "east"), "fix")
