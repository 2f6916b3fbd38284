"""Matching organisations by name: exact, contained, alias and manual, and the greedy month cover."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywell import fixed_values as fixed
from tallywell.functions import names
from tallywell.session import materialise

GRAM = 3


def _grams(text: Column, size: int) -> Column:
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(text, i, F.lit(size)))


def contained_pairs(needles: DataFrame, haystacks: DataFrame, group: str) -> DataFrame:
    """(group, needle, haystack) for every non-empty needle that is a substring of a haystack of its group.

    A needle can only be inside texts that share its rarest character triple, so only those pairs are compared;
    a group is never multiplied out. Needles shorter than a triple use their whole text, and pieces of their length
    are indexed only where there are such needles.
    """
    needle, hay = F.col("needle"), F.col("haystack")
    needles = needles.select(group, "needle").filter(F.length("needle") > 0).distinct()
    haystacks = haystacks.select(group, "haystack").filter(F.length("haystack") > 0).distinct()
    lengths = needles.filter(F.length("needle") < GRAM).select(F.collect_set(F.length("needle"))).scalar()
    short = [F.when(F.array_contains(lengths, size), _grams(hay, size)).otherwise(F.array().cast("array<string>")) for size in range(1, GRAM)]
    parts = F.array_distinct(F.concat(*short, _grams(hay, GRAM)))
    index = haystacks.select(group, "haystack", F.explode(parts).alias("gram"))
    frequency = index.groupBy(group, "gram").agg(F.count(F.lit(1)).alias("texts"))
    keys = F.when(F.length(needle) >= GRAM, F.array_distinct(_grams(needle, GRAM))).otherwise(F.array(needle))
    rarest = (
        needles.select(group, "needle", F.explode(keys).alias("gram"))
        .join(frequency, [group, "gram"], "left")
        .groupBy(group, "needle")
        .agg(F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "gram")).alias("best"))
        .filter("best.texts > 0")
        .select(group, "needle", F.col("best.gram").alias("gram"))
    )
    return rarest.join(index, [group, "gram"]).filter(hay.contains(needle)).select(group, "needle", "haystack")


def match_units(targets: DataFrame, units: DataFrame, fallback: bool = True) -> DataFrame:
    """Place targets (agency, target) on units (agency, name, code), all names being match keys.

    An equal name wins, the lowest code on ties. Otherwise a unit whose name contains the target or is contained
    in it is taken if it is the only one. With `fallback` the rest goes to the agency itself.
    """
    wanted = targets.select("agency", "target").distinct()
    exact = units.groupBy("agency", F.col("name").alias("target")).agg(F.min("code").alias("exact"))
    unit_names = units.select("agency", "name").distinct()
    inside = contained_pairs(unit_names.withColumnRenamed("name", "needle"), wanted.withColumnRenamed("target", "haystack"), "agency").select(
        "agency", F.col("haystack").alias("target"), F.col("needle").alias("name"))
    around = contained_pairs(wanted.withColumnRenamed("target", "needle"), unit_names.withColumnRenamed("name", "haystack"), "agency").select(
        "agency", F.col("needle").alias("target"), F.col("haystack").alias("name"))
    hits = (
        inside.unionByName(around)
        .join(units.select("agency", "name", "code"), ["agency", "name"])
        # Lowest and highest are equal exactly when one unit fits, and combine before the shuffle.
        .groupBy("agency", "target").agg(F.min("code").alias("contained"), F.max("code").alias("_last"))
        .filter("contained = _last")
    )
    placed = wanted.join(exact, ["agency", "target"], "left").join(hits.drop("_last"), ["agency", "target"], "left")
    last = F.col("agency") if fallback else F.lit(None).cast("string")
    return placed.select(
        "agency", "target",
        F.coalesce("exact", "contained", last).alias("node"),
        F.when(F.col("exact").isNotNull(), "normalized")
        .when(F.col("contained").isNotNull(), "contains")
        .when(F.lit(fallback), "agency").alias("method"),
    )


def keep_manual(found: DataFrame, manual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hand-made entries replace found ones."""
    columns = list(found.columns)
    return found.join(manual.select(*keys), list(keys), "left_anti").unionByName(
        manual.withColumn("method", F.lit("manual")).select(*columns)
    )


def split_residual(units: DataFrame, code: str) -> tuple[DataFrame, DataFrame]:
    """(real units, residual 'all other' units, which are no organisation)."""
    residual = F.col(code).endswith(fixed.RESIDUAL_SUFFIX)
    return units.filter(~residual), units.filter(residual)


def resolve_agency(
    agency_names: DataFrame, aliases: DataFrame, hints: Mapping[str, str], umbrella: str = "EXECUTIVE OFFICE"
) -> DataFrame:
    """Agency code of each name, or null, by a cascade of ever looser keys.

    `aliases` is (source, key, code) with source in index, component and folded. Every key a name could match is
    listed with its place in the cascade; one join and a minimum pick the first that exists. Hints, tried last,
    look for a phrase inside the name.
    """
    name = F.col("agency_name")
    split = F.instr(name, " - ")
    head = F.when(split > 0, F.substring(name, F.lit(1), split - 1))
    tail = F.when(split > 0, F.substring(name, split + 3, F.length(name)))
    whole, rest, bare_rest, bare = names.match_key(name), names.match_key(tail), names.unit_key(tail), names.unit_key(name)
    below = names.match_key(head).contains(umbrella)

    def attempt(step: int, source: str, key: Column, when: Column | None = None) -> Column:
        usable = key if when is None else F.when(when, key)
        return F.struct(F.lit(step).alias("step"), F.lit(source).alias("source"), usable.alias("key"))

    attempts = F.array(
        attempt(1, "index", whole),
        attempt(2, "component", rest, below),
        attempt(3, "component", bare_rest, below & (split > 0)),
        attempt(4, "index", rest),
        attempt(5, "folded", rest),
        attempt(6, "folded", bare_rest, split > 0),
        attempt(7, "folded", whole),
        attempt(8, "component", whole),
        attempt(9, "folded", bare),
    )
    distinct_names = agency_names.select("agency_name").distinct()
    keyed = distinct_names.select("agency_name", F.explode(attempts).alias("a")).filter(F.col("a.key").isNotNull())
    found = (
        keyed.select("agency_name", "a.step", "a.source", "a.key").join(aliases, ["source", "key"])
        .groupBy("agency_name").agg(F.min(F.struct("step", "code")).alias("best"))
    )
    return distinct_names.join(found, "agency_name", "left").select(
        "agency_name", F.coalesce("best.code", names.contains_any(whole, dict(hints))).alias("agency"),
        F.coalesce("best.step", F.lit(10)).alias("step"),
    ).withColumn("step", F.when(F.col("agency").isNotNull(), F.col("step")))


def existing_only(resolved: DataFrame, agencies: DataFrame) -> DataFrame:
    """Resolved codes that no record file carries become unplaced."""
    known = agencies.select(F.col("code").alias("agency"), F.lit(True).alias("_known"))
    return resolved.join(known, "agency", "left").withColumn(
        "agency", F.when(F.col("_known"), F.col("agency"))
    ).select(*resolved.columns)


def match_quality(placed: DataFrame, weight: str | None = None) -> DataFrame:
    """Targets and weight per method, with the share of all."""
    amount = F.sum(weight) if weight else F.count(F.lit(1))
    by_method = placed.groupBy(F.coalesce("method", F.lit("unmatched")).alias("method")).agg(
        F.count(F.lit(1)).alias("targets"), amount.alias("weight")
    )
    # There are four methods at most, so the total is a window over four rows.
    total = F.sum("weight").over(Window.partitionBy(F.lit(0)))
    return by_method.withColumn("share", F.try_divide(F.col("weight").cast("double"), total))


def seed_groups(curated: DataFrame, agencies: DataFrame, sources: Mapping[str, DataFrame]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """First draft of the groups and what is left over.

    `curated` is (gid, kind, label) with kind 'agency' or a source name; `agencies` is (code, name); each source is
    (label). Agencies not curated become a group of their own and take the equally named label of every source.
    """
    free = agencies.join(
        curated.filter("kind = 'agency'").select(F.col("label").alias("code")), "code", "left_anti"
    ).select(F.lower("code").alias("gid"), "code", names.match_key("name").alias("key"))
    own = free.select("gid", F.lit("agency").alias("kind"), F.col("code").alias("label"))
    rows, left = curated.select("gid", "kind", "label").unionByName(own), {}
    for kind, source in sources.items():
        taken = curated.filter(F.col("kind") == kind).select("label")
        by_key = source.groupBy(names.match_key("label").alias("key")).agg(F.max("label").alias("label"))
        matched = free.join(by_key, "key").select("gid", F.lit(kind).alias("kind"), "label")
        rows = rows.unionByName(matched)
        left[kind] = source.select("label").join(taken, "label", "left_anti").join(matched.select("label"), "label", "left_anti")
    return rows, left


def covering_months(observed: DataFrame) -> list[tuple]:
    """(month, newly covered codes) of the fewest months, greedily, in which every code is seen; the later month on ties.

    Codes with the same set of months are counted together and stored once, so a round is one small aggregate over
    those sets that returns one row. There are at most as many rounds as months. A code that is seen in no month at all
    can't be covered; `uncovered` lists such codes.
    """
    patterns = materialise(
        observed.select("code", "month").where("month IS NOT NULL").distinct()
        .groupBy("code").agg(F.array_sort(F.collect_list("month")).alias("months"))
        .groupBy("months").agg(F.count(F.lit(1)).alias("codes")), "patterns")
    chosen: list[tuple] = []
    while True:
        picked = F.array(*[F.lit(month) for month, _ in chosen]).cast(patterns.schema["months"].dataType)
        best = (
            patterns.filter(~F.arrays_overlap("months", picked)).select(F.explode("months").alias("month"), "codes")
            .groupBy("month").agg(F.sum("codes").alias("gain"))
            .agg(F.max(F.struct("gain", "month")).alias("best")).first()["best"]
        )
        if best is None:
            return chosen
        chosen.append((best["month"], best["gain"]))


def uncovered(observed: DataFrame) -> DataFrame:
    """Codes that no month shows."""
    return observed.groupBy("code").agg(F.max("month").alias("_last")).filter(F.col("_last").isNull()).select("code")
