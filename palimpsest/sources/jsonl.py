"""JSON lines: export and import of episodes, gold sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.schemas import EPISODE_COLUMNS, EPISODES

GOLD = "text string, triples array<struct<subject:string,predicate:string,object:string>>, notes string"


def export_rows(episodes: DataFrame, signatures: DataFrame | None = None) -> DataFrame:
    """(value): one JSON object per episode, {episode, hv}; hv is null without signatures (id, hv)."""
    row = F.struct(*EPISODE_COLUMNS).alias("episode")
    if signatures is None:
        return episodes.select(F.to_json(F.struct(row, F.lit(None).cast("array<bigint>").alias("hv"))).alias("value"))
    joined = episodes.join(signatures.select("id", "hv"), "id", "left")
    return joined.select(F.to_json(F.struct(row, F.col("hv"))).alias("value"))


def export(episodes: DataFrame, path: str, signatures: DataFrame | None = None) -> None:
    """Writes the JSON lines of the episodes, one part file per task."""
    export_rows(episodes, signatures).write.mode("overwrite").text(path)


def parse(lines: DataFrame) -> DataFrame:
    """Episodes and hv from JSON lines (value); blank lines are skipped, lines that are no JSON raise an error."""
    schema = f"episode struct<{_ddl_fields(EPISODES)}>, hv array<bigint>"
    rows = lines.filter(F.trim("value") != "").select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"))
    return rows.select("r.episode.*", "r.hv")


def _ddl_fields(ddl: str) -> str:
    """Column list of a table as the fields of a struct type."""
    from pyspark.sql.types import StructType

    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in StructType.fromDDL(ddl).fields)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Episodes from exported JSON lines."""
    return parse(spark.read.text(path))


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """A gold set of texts with their facts."""
    return spark.read.schema(GOLD).json(path)
