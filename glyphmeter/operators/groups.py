"""Language metadata: groups of languages, names, and measures by group."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Languages:
    """languages: lang, name, iso_code, data_path; groups: group_type, group_name, lang."""

    def __init__(self, spark: SparkSession, languages: Mapping, groups: Mapping[str, Mapping[str, list[str]]] | None = None) -> None:
        rows = []
        for code, info in languages.items():
            info = {"data_path": info} if isinstance(info, str) else dict(info)
            rows.append((code, info.get("name", "Unknown"), info.get("iso_code"), info.get("data_path")))
        self.languages = spark.createDataFrame(sorted(rows), "lang string, name string, iso_code string, data_path string")
        self.groups = group_table(spark, groups or {})
        unknown = self.groups.join(self.languages, "lang", "left_anti").select("lang").distinct().collect()
        if unknown:
            raise ValueError(f"groups name undeclared languages: {sorted(r[0] for r in unknown)}")

    @classmethod
    def from_file(cls, spark: SparkSession, path: str) -> Languages:
        with open(path, encoding="utf-8") as f:
            try:
                config = json.load(f)
            except json.JSONDecodeError as e:
                raise ValueError(f"{path} is no JSON") from e
        return cls(spark, config.get("languages", {}), config.get("analysis_groups", {}))

    def named(self, rows: DataFrame) -> DataFrame:
        """rows with the languages' names, 'Unknown' for undeclared ones."""
        return rows.join(F.broadcast(self.languages.select("lang", "name")), "lang", "left").withColumn("name", F.coalesce("name", F.lit("Unknown")))

    def in_group(self, rows: DataFrame, group_type: str, column: str | None = None) -> DataFrame:
        """rows with the first group of this type that has their language (a script family, a resource level), else 'Unknown'."""
        own = self.groups.where(F.col("group_type") == group_type).groupBy("lang").agg(F.min("group_name").alias("group"))
        name = column or group_type
        return rows.join(F.broadcast(own), "lang", "left").withColumn(name, F.coalesce("group", F.lit("Unknown"))).drop(*({"group"} - {name}))

    def select(self, group_type: str, group_name: str) -> DataFrame:
        return self.groups.where((F.col("group_type") == group_type) & (F.col("group_name") == group_name)).select("lang").distinct()


def group_table(spark: SparkSession, groups: Mapping[str, Mapping[str, list[str]]]) -> DataFrame:
    rows = [(kind, name, lang) for kind, by_name in groups.items() for name, langs in by_name.items() for lang in langs]
    return spark.createDataFrame(rows, "group_type string, group_name string, lang string")


def by_group(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows once for each group of their language: every group is then measured in one job.

    The groups go to every worker: a join by so few languages would bring all rows of one to one task.
    """
    return rows.join(F.broadcast(groups), "lang")


def in_languages(rows: DataFrame, languages: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(languages), "lang", "left_semi")


def group_statistics(groups: DataFrame) -> DataFrame:
    """Members of each group, in order, and how many."""
    return groups.groupBy("group_type", "group_name").agg(F.count("*").alias("languages"), F.array_join(F.array_sort(F.collect_list("lang")), ",").alias("members"))
