"""Delimited matrices, rankings, metadata, MatrixMarket triples, vectors; run folders and manifests."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from genoloom.functions import labels
from genoloom.operators import gsea


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on any file system that Spark can reach."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def sniffed(spark: SparkSession, path: str) -> str:
    """The delimiter of a text file, from its first line."""
    head = spark.read.text(path).first()
    return max([",", "\t", ";", "|"], key=(head[0] if head else "").count)


def read_table(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    return spark.read.csv(path, header=True, sep=sep or sniffed(spark, path))


def _loud(column: Column, ok: Column, message: str) -> Column:
    return F.when(ok, column).otherwise(F.raise_error(F.concat(F.lit(message + ": "), F.coalesce(column.cast("string"), F.lit("null")))))


def wide_to_long(matrix: DataFrame, id_col: str, genes_by_samples: bool = True) -> DataFrame:
    """sample, gene, value of a wide text matrix: missing cells are 0, text is an error."""
    others = [c for c in matrix.columns if c != id_col]
    row, col = ("gene", "sample") if genes_by_samples else ("sample", "gene")
    long = matrix.unpivot([id_col], others, col, "_raw").withColumnRenamed(id_col, row)
    raw = F.nullif(F.trim(F.col("_raw").cast("string")), F.lit(""))
    value = raw.try_cast("double")
    value = F.when(raw.isNull(), F.lit(0.0)).otherwise(F.when(value.isNotNull(), value).otherwise(F.raise_error(F.concat(F.lit("not a number: "), raw)).cast("double")))
    return long.select("sample", "gene", value.alias("value"))


def ranked_table(df: DataFrame, gene_col: str = "gene", score_col: str = "score", universe: DataFrame | None = None) -> DataFrame:
    """gene, score, rank_no, n_genes of an external ranking; a missing gene or a score that is no finite number is an error."""
    missing = [c for c in (gene_col, score_col) if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    gene = F.nullif(F.trim(F.col(gene_col).cast("string")), F.lit(""))
    score = F.col(score_col).cast("string").try_cast("double")
    fine = score.isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf"))
    rows = df.select(_loud(gene, gene.isNotNull(), "missing gene").alias("gene"), F.when(fine, score).otherwise(F.raise_error(F.concat(F.lit("not a finite score: "), F.coalesce(F.col(score_col).cast("string"), F.lit("null")))).cast("double")).alias("score"))
    if universe is not None:
        rows = rows.join(universe.select("gene").distinct(), "gene", "left_semi")
    return gsea.ranking(rows, [])


def first_metadata(df: DataFrame, sample_col: str, order_col: str) -> DataFrame:
    """One row a sample, the first by ``order_col``."""
    w = Window.partitionBy(sample_col).orderBy(order_col)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def read_10x(spark: SparkSession, folder: str, names: str = "symbol") -> DataFrame:
    """cell, gene, value of a MatrixMarket folder (matrix.mtx, barcodes.tsv, features.tsv, each maybe gzipped)."""

    def part(name: str) -> str:
        for tail in ("", ".gz"):
            if exists(spark, f"{folder}/{name}{tail}"):
                return f"{folder}/{name}{tail}"
        raise FileNotFoundError(f"{folder}/{name}")

    def numbered(path: str) -> DataFrame:
        df = spark.read.text(path).withColumn("_m", F.monotonically_increasing_id())
        return df.withColumn("i", F.row_number().over(Window.orderBy("_m")))  # an axis file, read by one task

    features = next(n for n in ("features.tsv", "genes.tsv") if exists(spark, f"{folder}/{n}") or exists(spark, f"{folder}/{n}.gz"))
    cells = numbered(part("barcodes.tsv")).select(F.col("i").alias("c"), F.trim("value").alias("cell"))
    cut = F.split("value", "\t")
    genes = numbered(part(features)).select(F.col("i").alias("g"), F.trim(F.coalesce(F.get(cut, F.lit(1 if names == "symbol" else 0)), F.get(cut, F.lit(0)))).alias("gene"))
    lines = spark.read.text(part("matrix.mtx")).where("not value like '\\%%'").withColumn("x", F.split(F.trim("value"), r"\s+"))
    # the size line is the first that is no comment
    size = lines.select("x").first()
    if size is None:
        raise ValueError("matrix.mtx has no size line")
    n_g, n_c, n_v = (int(v) for v in size["x"])
    if (n_g, n_c) != (genes.count(), cells.count()):
        raise ValueError("matrix size does not fit barcodes and features")
    head = F.monotonically_increasing_id() == 0
    body = lines.withColumn("_head", head).where("not _head")
    triples = body.select(F.col("x")[0].cast("int").alias("g"), F.col("x")[1].cast("int").alias("c"), F.col("x")[2].cast("double").alias("value"))
    return triples.join(cells, "c").join(genes, "g").select("cell", "gene", "value")


def stacked_10x(parts: dict[str, DataFrame]) -> DataFrame:
    """Union of many inputs, cells prefixed by sample; a gene that an input lacks is simply absent."""
    out = None
    for sample, df in parts.items():
        df = df.select(F.concat_ws(":", F.lit(sample), "cell").alias("cell"), "gene", "value", F.lit(sample).alias("sample"))
        out = df if out is None else out.unionByName(df)
    return out


def with_cell_metadata(counts: DataFrame, meta: DataFrame, barcode: str) -> DataFrame:
    """Left join of cell metadata; a repeated or missing barcode is an error, as is no overlap at all."""
    checked = meta.agg(F.count("*").alias("n"), F.countDistinct(barcode).alias("d")).first()
    if checked["n"] != checked["d"]:
        raise ValueError("metadata has missing or repeated barcodes")
    if counts.join(meta, counts["cell"] == meta[barcode], "left_semi").isEmpty():
        raise ValueError("no cell has metadata")
    return counts.join(meta.withColumnRenamed(barcode, "cell"), "cell", "left")


def save_vectors(vectors: DataFrame, path: str) -> None:
    vectors.select("gene", F.col("v").cast("array<float>").alias("v")).write.mode("overwrite").parquet(path)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    """gene, v; vectors of unlike length are an error."""
    df = spark.read.parquet(path).select("gene", F.col("v").cast("array<double>").alias("v"))
    lengths = df.agg(F.min(F.size("v")).alias("a"), F.max(F.size("v")).alias("b")).first()
    if lengths["a"] != lengths["b"]:
        raise ValueError("vectors have unlike lengths")
    return df


def compact_programs(df: DataFrame) -> DataFrame:
    """program, gene of either form: a comma list in ``genes`` or one ``gene`` a row (names without regard to case)."""
    names = {c.lower(): c for c in df.columns}
    if "genes" in names:
        df = df.select(F.col(names["program"]).alias("program"), F.explode(F.split(names["genes"], ",")).alias("gene"))
    else:
        df = df.select(F.col(names["program"]).alias("program"), F.col(names["gene"]).alias("gene"))
    df = df.select(F.trim("program").alias("program"), F.trim("gene").alias("gene"))
    return df.where("program <> '' and gene <> '' and lower(gene) <> 'nan'").distinct()


def claim_support(df: DataFrame) -> DataFrame:
    """program, supported: an explicit column, or the conjunction of gate_ columns where nulls pass; true if any row is."""
    names = {c.lower(): c for c in df.columns}
    if "claim_supported" in names:
        one = labels.flag(F.col(names["claim_supported"]))
    else:
        one = F.lit(True)
        for c in names:
            if c.startswith("gate_"):
                one = one & F.coalesce(labels.flag_or_null(F.col(names[c])), F.lit(True))
    return df.select(F.col(names["program"]).alias("program"), one.alias("s")).groupBy("program").agg(F.bool_or("s").alias("supported"))


def context_metric(df: DataFrame) -> DataFrame:
    """program, gene, metric: the mean context_evidence, or context_shift where that column is absent."""
    column = next(c for c in ("context_evidence", "context_shift") if c in df.columns)
    v = F.col(column).cast("string").try_cast("double")
    return df.select("program", "gene", F.when(~F.isnan(v), v).alias("v")).where("v is not null").groupBy("program", "gene").agg(F.avg("v").alias("metric"))


def changed_settings(baseline: str, variant: str, ignored: tuple[str, ...] = ()) -> list[tuple[str, str | None, str | None]]:
    """Keys of two JSON configurations whose values differ."""
    a, b = json.loads(baseline), json.loads(variant)
    text = lambda x: None if x is None else json.dumps(x, sort_keys=True)
    return [(k, text(a.get(k)), text(b.get(k))) for k in sorted({*a, *b} - set(ignored)) if a.get(k) != b.get(k)]


def write_manifest(path: str, settings: dict, **counts: int) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"config": settings, **counts}, f, indent=2, sort_keys=True)
