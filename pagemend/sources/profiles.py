"""Profiles: JSON files of canonical slots and standing lines by format."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemend.operators.review import Profile
from pagemend.schema import PROFILE


def profile_tables(profiles: DataFrame) -> Profile:
    """The tables of a (profile) column of PROFILE structs. Slot names that aren't side:number are ignored."""
    each = profiles.select(F.explode("profile.clusters").alias("cluster_key", "e")).filter("e is not null")
    named = each.select("cluster_key", F.explode("e.slots").alias("slot", "text")).withColumn("__k", F.substring_index("slot", ":", -1))
    slots = named.filter(F.contains("slot", F.lit(":")) & F.expr("substr(slot, instr(slot, ':') + 1)").rlike(r"^[0-9]+$"))
    side = F.when(F.substring_index("slot", ":", 1) == "top", "top").otherwise("bottom")
    lines = each.select("cluster_key", F.posexplode("e.lines").alias("pos", "text"))
    some = each.filter((F.coalesce(F.size("e.slots"), F.lit(0)) > 0) | (F.coalesce(F.size("e.lines"), F.lit(0)) > 0))
    return Profile(slots.select("cluster_key", side.alias("side"), F.col("__k").cast("int").alias("k"), "text"), lines.filter("text is not null"), some.select("cluster_key").distinct())


def _checked(text: str, path: str) -> dict:
    try:
        raw = json.loads(text.removeprefix("﻿"))
    except ValueError as e:
        raise ValueError(f"profile {path} is not valid JSON: {e}") from e
    if not isinstance(raw, dict):
        raise ValueError(f"profile {path} must be a JSON object")
    if not isinstance(raw.get("clusters"), dict):
        raise ValueError(f"profile {path} has no clusters object")
    return raw


def load_profile(spark: SparkSession, path: str) -> Profile:
    """A profile file; entries of the wrong kind count as empty. ValueError as for any broken profile."""
    (row,) = spark.read.text(path, wholetext=True).collect()  # one file that people write and read
    raw, clean = _checked(row.value, path), {}
    for key, entry in raw["clusters"].items():
        entry = entry if isinstance(entry, dict) else {}
        slots, lines = entry.get("slots"), entry.get("lines")
        clean[key] = {"slots": {k: str(v) for k, v in slots.items()} if isinstance(slots, dict) else {}, "lines": [str(x) for x in lines] if isinstance(lines, list) else []}
    table = spark.createDataFrame([(json.dumps({"version": 1, "clusters": clean}),)], "j string")
    return profile_tables(table.select(F.from_json("j", PROFILE).alias("profile")))


def counts_of(profile: Profile) -> tuple[int, int]:
    return profile.slots.count(), profile.lines.count()
