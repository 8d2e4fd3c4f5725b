"""Search results, the rounds of a search that can be resumed, and the summary."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT = "problem_idx long, problem string, final_answer string, final_score double"


def append_results(results: DataFrame, path: str) -> None:
    """Add finished problems to a folder of JSON lines; earlier files stay."""
    results.select("problem_idx", "problem", "final_answer", "final_score").write.mode("append").json(path)


class RoundLog:
    """Committed rounds of one search under a folder of a shared file system.

    A round is written beside its place and moved there by one rename, so it is
    there as a whole or not at all. ``rounds/round=N`` holds the state of the
    problems that were active in round N, ``results/round=N`` the ones that it
    finished, as JSON lines. A crash between the two is mended when the log is
    opened: what a committed round finished is published once, whatever
    happened. One search at a time may write to a folder.
    """

    def __init__(self, spark: SparkSession, path: str, settings: dict[str, object] | None = None):
        self.spark, self.path = spark, path
        self._root = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._files = self._root.getFileSystem(spark._jsc.hadoopConfiguration())
        if settings is not None:
            self._same_settings(json.dumps(settings, sort_keys=True))
        for number in self.numbers():
            self._publish(number)

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _same_settings(self, wanted: str) -> None:
        if self._files.exists(self._at("settings")):
            stored = self.spark.read.text(f"{self.path}/settings").first()["value"]
            if stored != wanted:
                raise ValueError(f"the search in {self.path} was begun with {stored}, not with {wanted}")
            return
        self._place(self.spark.createDataFrame([(wanted,)], "value string").coalesce(1), "text", "settings")

    def _place(self, rows: DataFrame, kind: str, name: str) -> None:
        """Write and move into place; a folder that is there already is never touched."""
        draft = f"_drafts/{uuid.uuid4().hex}"
        rows.write.format(kind).save(f"{self.path}/{draft}")
        target = self._at(name)
        self._files.mkdirs(target.getParent())
        if self._files.exists(target) or not self._files.rename(self._at(draft), target):
            raise FileExistsError(f"{self.path}/{name} was written by another search")

    def numbers(self) -> list[int]:
        """Committed rounds in order."""
        if not self._files.exists(self._at("rounds")):
            return []
        names = (status.getPath().getName() for status in self._files.listStatus(self._at("rounds")))
        found = sorted(int(m.group(1)) for m in (re.fullmatch(r"round=(\d+)", n) for n in names) if m)
        if found != list(range(len(found))):
            raise ValueError(f"a round is missing in {self.path}: {found}")
        return found

    def commit(self, number: int, judged: DataFrame) -> DataFrame:
        """Store a round for good, publish what it finished, and give it as stored."""
        self._place(judged, "parquet", f"rounds/round={number}")
        self._publish(number)
        return self.read(number)

    def _publish(self, number: int) -> None:
        if self._files.exists(self._at(f"results/round={number}")):
            return
        done = self.read(number).where(F.col("reason").isNotNull()).select(
            F.col("problem_id").alias("problem_idx"), "problem", F.col("text").alias("final_answer"), F.col("score").alias("final_score")
        )
        self._place(done, "json", f"results/round={number}")

    def read(self, number: int | None = None) -> DataFrame:
        """The state of one round, or of all."""
        numbers = self.numbers() if number is None else [number]
        return self.spark.read.parquet(*[f"{self.path}/rounds/round={n}" for n in numbers])

    def results(self) -> DataFrame:
        """Finished problems as published."""
        return self.spark.read.schema(RESULT).json(f"{self.path}/results").select("problem_idx", "problem", "final_answer", "final_score")


def result_summary(results: DataFrame, config: dict[str, object] | None = None) -> DataFrame:
    """Count, mean final score (null without results) and the run's settings."""
    pairs = [F.lit(x) for k, v in (config or {}).items() for x in (k, str(v))]
    settings = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return results.agg(
        F.count(F.lit(1)).alias("num_problems"), F.avg("final_score").alias("avg_final_score")
    ).withColumn("config", settings)
