"""JSON artifacts, a store of inputs by content, and verified snapshots of tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import canonical
from corpusloom.functions.calibration import Invalid, Target


def write_json(spark: SparkSession, path: str, document) -> None:
    spark.createDataFrame([(json.dumps(document, indent=2, ensure_ascii=False, allow_nan=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str):
    """A document of one file or folder, strictly read."""
    return canonical.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))


def read_target(spark: SparkSession, path: str) -> Target:
    """A target, on its own or beside its provenance."""
    return Target.of(read_json(spark, path)).validated()


# Inputs by content -----------------------------------------------------------------------------

INPUTS = "id string, body string"


def split(inputs: DataFrame, shared: str = "model") -> tuple[DataFrame, DataFrame]:
    """`inputs` (id, body: JSON) as (id, digest, reference, body) without a part that inputs share,
    and (digest, body) of each distinct such part."""
    part = F.get_json_object("body", f"$.{shared}")
    digest = F.when(part.isNotNull(), F.concat(F.lit("sha256:"), F.sha2(part, 256)))
    marked = inputs.select("id", "body", part.alias("part"), digest.alias("reference"), F.concat(F.lit("sha256:"), F.sha2("body", 256)).alias("digest"))
    fields = F.map_filter(F.from_json("body", "map<string,string>"), lambda k, v: k != shared)
    slim = marked.select("id", "digest", "reference", F.to_json(fields).alias("body"))
    return slim, marked.where("reference IS NOT NULL").groupBy(F.col("reference").alias("digest")).agg(F.first("part").alias("body"))


def hydrated(slim: DataFrame, objects: DataFrame) -> DataFrame:
    """(id, digest, reference, body, part): the inputs with the parts that they refer to. An error for
    a part that is missing or whose content isn't what its name says."""
    named = objects.select(F.col("digest").alias("reference"), F.col("body").alias("part"))
    found = slim.join(named, "reference", "left")
    sound = F.col("reference").isNull() | (F.concat(F.lit("sha256:"), F.sha2("part", 256)) == F.col("reference"))
    return found.withColumn("part", F.when(F.coalesce(sound, F.lit(False)), F.col("part")).otherwise(F.raise_error(F.concat(F.lit("missing or changed: "), F.col("reference")))))


# Snapshots -------------------------------------------------------------------------------------


def content(table: DataFrame) -> tuple[int, str]:
    """The number of rows, and a sum of their hashes that doesn't depend on their order."""
    row = table.select(F.xxhash64(*table.columns).cast("decimal(38,0)").alias("h")).agg(F.count("*"), F.coalesce(F.sum("h"), F.lit(0))).first()
    return row[0], str(row[1])


def snapshot(tables: dict[str, DataFrame], folder: str, made_at: int) -> dict:
    """Writes tables and a manifest of their contents; the manifest comes last, so a folder without
    one is no snapshot."""
    manifest = {"made_at": made_at, "tables": {}}
    spark = next(iter(tables.values())).sparkSession
    for name, table in tables.items():
        table.write.parquet(f"{folder}/{made_at}/{name}")
        rows, digest = content(spark.read.parquet(f"{folder}/{made_at}/{name}"))
        manifest["tables"][name] = {"rows": rows, "digest": digest}
    write_json(spark, f"{folder}/{made_at}/manifest", manifest)
    return manifest


def restored(spark: SparkSession, folder: str, made_at: int) -> dict[str, DataFrame]:
    """The tables of a snapshot, each held against the manifest."""
    manifest = read_json(spark, f"{folder}/{made_at}/manifest")
    tables = {name: spark.read.parquet(f"{folder}/{made_at}/{name}") for name in manifest["tables"]}
    for name, known in manifest["tables"].items():
        if content(tables[name]) != (known["rows"], known["digest"]):
            raise Invalid(f"table {name} differs from the snapshot's manifest")
    return tables


def expired(made_at: list[int], now: int, days: int = 30) -> list[int]:
    """Snapshots beyond their time; the newest stays whatever its age."""
    return sorted(t for t in made_at if t < now - days * 86_400 and t != max(made_at))
