"""A ranking kept up to date while files of sites and features arrive, in any order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.operators import completeness
from sitelens.operators.spatial import assign_to_sites
from sitelens.sources.scratch import scratch_path

SITES = "site long, name string, holes string, golf string, lon double, lat double, west double, south double, east double, north double"
FEATURES = "feat long, layer string, way boolean, lon double, lat double"
ELEMENTS = f"{SITES}, feat long, layer string, way boolean"


class Ranking:
    """State of a ranking in the shared folder, a folder per batch, so a batch that runs again replaces what it wrote.

    sites and features: what a batch brought that was not there; counts: counters of the features that found a site in it; waiting: those
    that found none so far, which the next batch tries again; ranking: sites by score after it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self, what: str, schema: str, numbers: range) -> DataFrame:
        if not len(numbers):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{what}/{n}" for n in numbers])

    def _write(self, df: DataFrame, what: str, number: int) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{what}/{number}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{what}/{number}")

    def step(self, batch: DataFrame, number: int) -> None:
        earlier = range(number)
        names = [c.split()[0] for c in SITES.split(", ")], [c.split()[0] for c in FEATURES.split(", ")]
        seen = self._read("sites", SITES, earlier)
        # of a site or feature that comes again the first one counts
        self._write(batch.where("site IS NOT NULL").select(*names[0]).dropDuplicates(["site"]).join(seen.select("site"), "site", "left_anti"), "sites", number)
        known = self._read("features", FEATURES, earlier).select("feat")
        new = self._write(batch.where("feat IS NOT NULL").select(*names[1]).dropDuplicates(["feat"]).join(known, "feat", "left_anti"), "features", number)
        open_ = new.unionByName(self._read("waiting", FEATURES, range(max(number - 1, 0), number)))
        sites = self._read("sites", SITES, range(number + 1))
        found = self._write(assign_to_sites(open_, sites).select("feat", "site", "layer", "way"), "found", number)
        self._write(open_.join(found.select("feat"), "feat", "left_anti"), "waiting", number)
        counts = self._write(completeness.counts(found), "counts", number)
        every = self.spark.read.schema(counts.schema).parquet(*[f"{self.path}/counts/{n}" for n in range(number + 1)])
        total = every.groupBy("site").agg(*[F.sum(c).alias(c) for c in every.columns if c != "site"])
        self._write(completeness.ranked_counts(sites, total), "ranking", number)

    def snapshot(self, number: int) -> DataFrame:
        """The ranking after a batch."""
        return self.spark.read.parquet(f"{self.path}/ranking/{number}")

    def waiting(self, number: int) -> DataFrame:
        return self._read("waiting", FEATURES, range(number, number + 1))

    def final(self, batches: int) -> DataFrame:
        """The ranking with every feature assigned again, to all sites: a feature may have met a farther one before its own came."""
        sites = self._read("sites", SITES, range(batches))
        return completeness.ranked(sites, assign_to_sites(self._read("features", FEATURES, range(batches)), sites))


def rank_arrivals(spark: SparkSession, folder: str, files_at_once: int = 1) -> tuple[Ranking, int]:
    """A ranking of what is in a folder of element files (ELEMENTS) by a stream that takes some files a batch; and the number of batches."""
    path = scratch_path(spark, "ranking")
    state, done = Ranking(spark, path), []

    def step(batch: DataFrame, number: int) -> None:
        state.step(batch, number)
        done.append(number)

    stream = spark.readStream.schema(ELEMENTS).option("maxFilesPerTrigger", files_at_once).parquet(folder)
    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/stream").trigger(availableNow=True).start()
    query.awaitTermination()
    return state, max(done, default=-1) + 1
