"""Queries over provenance: which sources may be used, shipped and attributed how."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import policy as P
from . import relations as rel
from .catalog import query

FAMILY = "CASE WHEN lower(trim(split_part(family, '#', 1))) = 'none' THEN 'none' ELSE trim(split_part(family, '#', 1)) END"


def registry(spark, sf_dir) -> DataFrame:
    """With the family read up to its comment (v15)."""
    return P.plain_families(rel.registry(spark, sf_dir))


@query("registry", sql="SELECT source_id, CASE WHEN tier = 'quarantined' THEN 'quarantined' WHEN NOT commercial THEN 'not commercially clear' ELSE 'ok' END AS verdict FROM registry")
def v1_ingestible(spark, sf_dir):
    verdict = F.when(F.col("tier") == "quarantined", "quarantined").when(~F.col("commercial"), "not commercially clear").otherwise("ok")
    return registry(spark, sf_dir).select("source_id", verdict.alias("verdict"))


@query("registry", "manifests", sql="SELECT DISTINCT m.source_id, m.version, r.pin FROM manifests m JOIN registry r USING (source_id) WHERE r.pin IS NOT NULL AND r.pin <> m.version")
def v10_version_pins(spark, sf_dir):
    """Versions that aren't the pinned one (v2); a source without a pin is fine."""
    return P.unpinned(rel.manifests(spark, sf_dir), registry(spark, sf_dir))


@query("registry", "manifests", sql="SELECT DISTINCT source_id FROM manifests WHERE source_id NOT IN (SELECT source_id FROM registry)")
def v4_unknown_sources(spark, sf_dir):
    return P.unknown(rel.manifests(spark, sf_dir), registry(spark, sf_dir))


@query("registry", sql="""SELECT 'tier' AS finding, source_id FROM registry WHERE tier IN ('quarantined', 'research') UNION ALL SELECT 'attribution', source_id FROM registry WHERE attribution IS NULL
  UNION ALL SELECT 'vintage', source_id FROM registry WHERE contains(lower(licence), 'verify per vintage') AND pin IS NULL UNION ALL SELECT 'role', source_id FROM registry WHERE tier <> 'quarantined' AND role IS NULL
  UNION ALL SELECT 'commercial', source_id FROM registry WHERE NOT commercial""")
def v11_check_registry(spark, sf_dir):
    """All findings in one pass over the registry: tier (v5), attribution (v6), vintage (v7), role (v8), commercial (v9)."""
    return P.findings(registry(spark, sf_dir))


@query("registry", "manifests", sql="""SELECT DISTINCT m.tile, m.source_id FROM manifests m JOIN registry r USING (source_id) WHERE r.role = 'training_only' AND m.role = 'input'""")
def v8_export_roles(spark, sf_dir):
    """Sources for training only that a tile would ship (v3's blocking findings)."""
    return P.not_for_export(rel.manifests(spark, sf_dir), registry(spark, sf_dir))


@query("registry", "manifests", sql="""SELECT m.tile, CASE WHEN bool_or(coalesce(r.tier, '') <> 'core') THEN 'share-alike' ELSE 'attribution-only' END AS all_roles,
  CASE WHEN coalesce(bool_or(coalesce(r.tier, '') <> 'core') FILTER (m.role = 'input'), false) THEN 'share-alike' ELSE 'attribution-only' END AS inputs FROM manifests m LEFT JOIN registry r USING (source_id) GROUP BY m.tile""")
def v12_redistribution(spark, sf_dir):
    """A tile's class: share-alike if any source is unknown or not core (j21), over all roles and for inputs."""
    return P.redistribution(rel.manifests(spark, sf_dir), registry(spark, sf_dir))


@query("registry", "manifests", sql=f"""WITH f AS (SELECT m.tile, m.source_id, {FAMILY} AS family FROM manifests m JOIN registry USING (source_id))
  SELECT tile, string_agg(DISTINCT source_id, ',' ORDER BY source_id) FILTER (family <> 'none') AS sources FROM f GROUP BY tile HAVING bool_or(family = 'ODbL') AND bool_or(family = 'CC-BY-SA')""")
def a32_share_alike_conflicts(spark, sf_dir):
    """Tiles that combine two licence families which exclude each other (u5)."""
    return P.conflicts(rel.manifests(spark, sf_dir), rel.registry(spark, sf_dir))


@query("registry", "manifests", sql="""SELECT trim(regexp_replace(attribution, '\\s+', ' ', 'g')) AS line, min(source_id) AS first_id, count(*) AS n FROM registry WHERE attribution IS NOT NULL AND source_id IN (SELECT source_id FROM manifests) GROUP BY 1""")
def a33_attribution_lines(spark, sf_dir):
    return P.attribution(rel.manifests(spark, sf_dir), registry(spark, sf_dir))


@query("registry", "manifests", sql="SELECT tile, source_id, count(*) AS n FROM manifests GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT -1, source_id, 1 FROM registry WHERE source_id = 'src0000'")
def v13_repeated_records(spark, sf_dir):
    m = rel.manifests(spark, sf_dir).groupBy("tile", "source_id").agg(F.count("*").alias("n")).where("n > 1")
    return m.unionByName(registry(spark, sf_dir).where("source_id = 'src0000'").select(F.lit(-1).alias("tile"), "source_id", F.lit(1).cast("long").alias("n")))


@query("registry", sql=f"SELECT {FAMILY} AS family, count(*) AS n, count(*) FILTER (tier = 'core') AS core FROM registry GROUP BY 1")
def v15_licence_families(spark, sf_dir):
    return registry(spark, sf_dir).groupBy("family").agg(F.count("*").alias("n"), F.count_if(F.col("tier") == "core").alias("core"))


@query("registry", sql="SELECT source_id, role FROM registry WHERE tier = 'core' AND commercial AND role = 'input'")
def v14_redistributable_core(spark, sf_dir):
    return registry(spark, sf_dir).where("tier = 'core' and commercial and role = 'input'").select("source_id", "role")


@query("tiles", "manifests", sql="SELECT DISTINCT tile FROM manifests EXCEPT SELECT tile FROM tiles")
def u2_orphan_tiles(spark, sf_dir):
    """Tiles outside every site: a difference; those in both are the intersection (u3)."""
    return rel.manifests(spark, sf_dir).select("tile").distinct().join(rel.tiles(spark, sf_dir), "tile", "left_anti")


@query("tiles", "manifests", sql="SELECT DISTINCT tile FROM manifests INTERSECT SELECT tile FROM tiles")
def u3_shared_tiles(spark, sf_dir):
    return rel.manifests(spark, sf_dir).select("tile").intersect(rel.tiles(spark, sf_dir).select("tile"))
