"""Plug-in points: discovery methods, benchmarks, vector sources, metrics; what is installed is asked at run time."""

from __future__ import annotations

import importlib.util
from abc import ABC, abstractmethod
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoloom.operators import discover, embed, modules
from genoloom.runtime import materialize
from genoloom.sources import gmt


class NotFitted(RuntimeError):
    """Programs were asked for before ``fit``."""


class Discovery(ABC):
    """A method that turns vectors (gene, v) into programs. A subclass gives ``find``; the rest follows from its labels."""

    needs: tuple[str, ...] = ()

    def __init__(self) -> None:
        self._scored: DataFrame | None = None
        self._labelled: DataFrame | None = None

    @abstractmethod
    def find(self, vectors: DataFrame) -> DataFrame:
        """(gene, label) of (gene, v)."""

    @classmethod
    def available(cls) -> bool:
        """Whether the packages that the method needs are installed."""
        return all(importlib.util.find_spec(name) is not None for name in cls.needs)

    def fit(self, vectors: DataFrame) -> "Discovery":
        if not self.available():
            raise ImportError(f"{type(self).__name__} needs {', '.join(self.needs)}")
        self._labelled = materialize(vectors.select("gene", "v").join(self.find(vectors).select("gene", "label"), "gene"))
        self._scored = None
        return self

    def _fitted(self) -> DataFrame:
        if self._labelled is None:
            raise NotFitted(type(self).__name__)
        return self._labelled

    def scores(self) -> DataFrame:
        """program, gene, score, position: membership by cosine to the program's centroid, in [0, 1]."""
        if self._scored is None:
            named = embed.program_scores(self._fitted()).withColumn("program", F.concat(F.lit("program_"), F.col("label").cast("string")))
            self._scored = materialize(named.select("program", "gene", "score", "position"))
        return self._scored

    def programs(self) -> DataFrame:
        """program, gene."""
        return self.scores().select("program", "gene")

    def soft(self) -> DataFrame:
        """program, gene, weight: every gene in every program, weights of a gene summing to 1."""
        out = embed.soft_membership(self._fitted())
        return out.select(F.concat(F.lit("program_"), F.col("centroid").cast("string")).alias("program"), "gene", "weight")

    def memberships(self, least: float = 0.0) -> DataFrame:
        """gene, programs: the programs of a gene with a weight of ``least`` or more, the heaviest first."""
        held = self.soft().where(F.col("weight") >= least)
        rows = F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("order"), F.col("program"), F.col("weight"))))
        return held.groupBy("gene").agg(F.transform(rows, lambda x: F.struct(x["program"].alias("program"), x["weight"].alias("weight"))).alias("programs"))

    def summary(self) -> DataFrame:
        return modules.program_summary(self.programs())

    def to_gmt(self, path: str) -> None:
        gmt.write_gmt(self.scores().select(F.col("program").alias("set_name"), F.col("position").alias("pos"), F.col("gene").cast("string").alias("gene")), path)

    def to_weighted_gmt(self, path: str) -> None:
        gmt.write_weighted_gmt(self.scores().select(F.col("program").alias("set_name"), F.col("gene").cast("string").alias("gene"), F.col("score").alias("weight")), path)


class KMeans(Discovery):
    def __init__(self, k: int = 20, seed: int = 42):
        super().__init__()
        self.k, self.seed = k, seed

    def find(self, vectors: DataFrame) -> DataFrame:
        return discover.kmeans_programs(vectors, self.k, self.seed)


class Communities(Discovery):
    def __init__(self, k: int = 15, resolution: float = 1.0):
        super().__init__()
        self.k, self.resolution = k, resolution

    def find(self, vectors: DataFrame) -> DataFrame:
        return discover.communities(embed.symmetric_edges(embed.neighbours(vectors.select("gene", "v"), self.k)), self.resolution)


class Density(Discovery):
    def __init__(self, least: int = 5):
        super().__init__()
        self.least = least

    def find(self, vectors: DataFrame) -> DataFrame:
        return modules.density_clusters(vectors.select("gene", "v"), self.least)


class Given(Discovery):
    """Any function from vectors to (gene, label)."""

    def __init__(self, function: Callable[[DataFrame], DataFrame]):
        super().__init__()
        self.find = function  # type: ignore[method-assign]

    def find(self, vectors: DataFrame) -> DataFrame:
        raise NotImplementedError


DISCOVERY: dict[str, type[Discovery]] = {"kmeans": KMeans, "communities": Communities, "density": Density}


class Benchmark(ABC):
    """A figure table of programs. A subclass gives ``run``; results are kept in order."""

    def __init__(self, name: str):
        self.name, self.history = name, []

    @abstractmethod
    def run(self, members: DataFrame, **inputs) -> DataFrame:
        """The table of (program, gene) programs."""

    def __call__(self, members: DataFrame, **inputs) -> DataFrame:
        self.history.append(materialize(self.run(members, **inputs)))
        return self.history[-1]

    def results(self) -> DataFrame:
        if not self.history:
            raise NotFitted(self.name)
        return self.history[-1]

    def compare(self, collections: dict[str, DataFrame], **inputs) -> DataFrame:
        """The tables of several collections in one, with the collection's name."""
        out = None
        for name, members in collections.items():
            one = self(members, **inputs).withColumn("collection", F.lit(name))
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
        return out


#: Vector sources by name: a function from its options to (gene, v).
VECTORS: dict[str, Callable[..., DataFrame]] = {}


def vector_source(name: str):
    def add(function):
        VECTORS[name.lower()] = function
        return function

    return add


def vectors_from(name: str, **options) -> DataFrame:
    key = name.strip().lower()
    if key not in VECTORS:
        raise ValueError(f"no vector source {name!r}; there are {', '.join(sorted(VECTORS))}")
    return VECTORS[key](**options)


@vector_source("table")
def _from_table(spark, path: str, gene: str = "gene", vector: str = "v") -> DataFrame:
    """Vectors as another program wrote them."""
    return spark.read.parquet(path).select(F.col(gene).alias("gene"), F.col(vector).cast("array<double>").alias("v"))


@vector_source("expression")
def _from_expression(values: DataFrame, samples: DataFrame, n_components: int = 30) -> DataFrame:
    """Principal components of the genes over the samples."""
    from genoloom.plans.pipeline import expression_vectors

    return embed.principal_components(expression_vectors(values, samples), n_components)


def resampled_metric(rows: DataFrame, metric: Callable[[DataFrame], DataFrame], n: int = 1000, seed: int = 42, confidence: float = 0.95) -> DataFrame:
    """metric columns' mean, low and high over ``n`` joint resamples of the rows.

    ``metric`` maps (resample, columns of the rows) to one row a resample with a column ``value``;
    so all resamples are one plan. Draw j takes the row at place md5(seed|b|j) mod the number of rows.
    """
    from genoloom.runtime import dense_ids

    placed = dense_ids(rows, "_i")
    size = placed._genoloom_rows
    draws = placed.select(F.col("_i").alias("_j"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("resample"))
    key = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("resample").cast("string"), F.col("_j").cast("string"))), 1, 12), 16, 10).cast("long")
    drawn = draws.select("resample", F.pmod(key, F.lit(max(size, 1))).alias("_i")).join(placed, "_i").drop("_i")
    tail = (1 - confidence) / 2
    return metric(drawn).agg(F.avg("value").alias("mean"), F.percentile("value", tail).alias("low"), F.percentile("value", 1 - tail).alias("high"))
