"""Provenance rules over a registry (source_id, tier, role, family, commercial, attribution, pin,
licence) and manifests (tile, source_id, role, version)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def plain_families(registry: DataFrame) -> DataFrame:
    """Families up to their comment; none in whatever case is none."""
    plain = F.trim(F.split("family", "#")[0])
    return registry.withColumn("family", F.when(F.lower(plain) == "none", "none").otherwise(plain))


def findings(registry: DataFrame) -> DataFrame:
    """finding, source_id: what speaks against a source, in one pass."""
    rules = {
        "tier": F.col("tier").isin("quarantined", "research"),
        "attribution": F.col("attribution").isNull(),
        "vintage": F.lower("licence").contains("verify per vintage") & F.col("pin").isNull(),
        "role": (F.col("tier") != "quarantined") & F.col("role").isNull(),
        "commercial": ~F.col("commercial"),
    }
    found = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return registry.select(F.explode(found).alias("finding"), "source_id")


def unknown(manifests: DataFrame, registry: DataFrame) -> DataFrame:
    return manifests.select("source_id").distinct().join(registry, "source_id", "left_anti")


def unpinned(manifests: DataFrame, registry: DataFrame) -> DataFrame:
    """source_id, version, pin: versions other than the pinned one."""
    own = manifests.select("source_id", "version").distinct()
    return own.join(registry.select("source_id", "pin"), "source_id").where("pin is not null and pin <> version")


def not_for_export(manifests: DataFrame, registry: DataFrame) -> DataFrame:
    """tile, source_id: inputs that are for training only."""
    own = manifests.where("role = 'input'").select("tile", "source_id").distinct()
    return own.join(registry.where("role = 'training_only'").select("source_id"), "source_id", "left_semi").select("tile", "source_id")


def redistribution(manifests: DataFrame, registry: DataFrame) -> DataFrame:
    """tile, all_roles, inputs: share-alike if any source is unknown or not core."""
    own = manifests.join(registry.select("source_id", "tier"), "source_id", "left")
    bad = F.coalesce("tier", F.lit("")) != "core"
    named = lambda c: F.when(c, "share-alike").otherwise("attribution-only")
    return own.groupBy("tile").agg(named(F.bool_or(bad)).alias("all_roles"), named(F.bool_or(bad & (F.col("role") == "input"))).alias("inputs"))


def conflicts(manifests: DataFrame, registry: DataFrame, families: tuple[str, str] = ("ODbL", "CC-BY-SA")) -> DataFrame:
    """tile, sources: tiles that combine two families which exclude each other."""
    own = manifests.select("tile", "source_id").distinct().join(plain_families(registry).select("source_id", "family"), "source_id")
    got = own.groupBy("tile").agg(F.collect_set("family").alias("families"), F.sort_array(F.collect_set(F.when(F.col("family") != "none", F.col("source_id")))).alias("ids"))
    return got.where(F.size(F.array_except(F.array(*map(F.lit, families)), "families")) == 0).select("tile", F.array_join("ids", ",").alias("sources"))


def attribution(manifests: DataFrame, registry: DataFrame) -> DataFrame:
    """line, first_id, n: distinct attribution lines of what was used, white space made even."""
    used = manifests.select("source_id").distinct()
    own = registry.where("attribution is not null").join(used, "source_id", "left_semi")
    line = F.trim(F.regexp_replace("attribution", r"\s+", " "))
    return own.groupBy(line.alias("line")).agg(F.min("source_id").alias("first_id"), F.count("*").alias("n"))
