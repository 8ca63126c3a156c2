"""Gene-set text formats: GMT, weighted GMT and GMX, plain or compressed, as scans and sinks."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from genoloom.runtime import clean_gene, clean_name


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no, line: in file order; a zip archive gives the lines of its members."""
    if path.endswith(".zip"):

        def unzip(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for name, data in zip(frame.path, frame.content):
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        for member in sorted(z.namelist()):
                            text = z.read(member).decode("utf-8", "replace").splitlines()
                            yield pd.DataFrame({"file": f"{name}/{member}", "line_no": range(len(text)), "line": text})

        return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unzip, "file string, line_no long, line string")
    df = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))
    return df


def _set_lines(spark: SparkSession, path: str, strict: bool) -> DataFrame:
    df = _lines(spark, path).where("trim(line) <> '' and not ltrim(line) like '#%'").withColumn("cells", F.split("line", "\t"))
    short = F.size("cells") < 3
    if strict:
        # a short line is an error when its row is read; no extra pass looks for one
        message = F.concat(F.lit("GMT line has fewer than 3 columns: "), F.substring("line", 1, 80))
        return df.withColumn("cells", F.when(short, F.raise_error(message)).otherwise(F.col("cells")))
    return df.where(~short)


def read_gmt(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """set_name, description, pos, gene. Sets of one name are merged: genes once, in file order.

    Blank and # lines are skipped; a line of fewer than three columns is an error, or skipped
    when not strict.
    """
    df = _set_lines(spark, path, strict)
    name, text = F.trim(F.col("cells")[0]), F.trim(F.col("cells")[1])
    rows = df.select(name.alias("set_name"), text.alias("description"), "file", "line_no", F.posexplode(F.slice("cells", 3, F.size("cells"))).alias("k", "gene"))
    rows = rows.withColumn("gene", clean_name("gene")).where("gene is not null")
    first = rows.groupBy("set_name", "gene").agg(F.min(F.struct("file", "line_no", "k", "description")).alias("at"))
    order = Window.partitionBy("set_name").orderBy("at")
    head = F.first("at").over(order)["description"]
    return first.select("set_name", head.alias("description"), (F.row_number().over(order) - 1).alias("pos"), "gene")


def read_gmt_last_wins(spark: SparkSession, path: str) -> DataFrame:
    """The lenient reading: short lines skipped, of sets of one name only the last counts."""
    df = _set_lines(spark, path, False).withColumn("set_name", F.trim(F.col("cells")[0]))
    last = Window.partitionBy("set_name").orderBy(F.desc("file"), F.desc("line_no"))
    df = df.withColumn("_k", F.row_number().over(last)).where("_k = 1")
    out = df.select("set_name", F.trim(F.col("cells")[1]).alias("description"), F.posexplode(F.slice("cells", 3, F.size("cells"))).alias("pos", "gene"))
    return out.withColumn("gene", clean_name("gene")).where("gene is not null")


def _joined(members: DataFrame, entry, order: str) -> DataFrame:
    rows = members.groupBy("set_name").agg(
        F.max("description").alias("description"), F.array_sort(F.collect_list(F.struct(order, entry.alias("e")))).alias("x")
    )
    return rows.select(F.concat_ws("\t", "set_name", F.coalesce("description", "set_name"), F.array_join(F.col("x.e"), "\t")).alias("value"))


def write_gmt(members: DataFrame, path: str) -> None:
    """One line a set: name, description (the name where it is null), genes by position. An empty input is an error."""
    if members.isEmpty():
        raise ValueError("no gene sets to write")
    if "description" not in members.columns:
        members = members.withColumn("description", F.lit(None).cast("string"))
    _joined(members, F.col("gene"), "pos").write.mode("overwrite").text(path)


def write_weighted_gmt(members: DataFrame, path: str) -> None:
    """Entries gene,weight with six decimals, the largest weight first."""
    if "description" not in members.columns:
        members = members.withColumn("description", F.lit(None).cast("string"))
    df = members.withColumn("_o", F.row_number().over(Window.partitionBy("set_name").orderBy(F.desc("weight"), "gene")))
    _joined(df, F.format_string("%s,%.6f", "gene", "weight"), "_o").write.mode("overwrite").text(path)


def read_weighted_gmt(spark: SparkSession, path: str) -> DataFrame:
    """set_name, pos, gene, weight; an entry without a readable weight has weight 1; short lines are skipped."""
    df = _set_lines(spark, path, False)
    df = df.select(F.trim(F.col("cells")[0]).alias("set_name"), F.posexplode(F.slice("cells", 3, F.size("cells"))).alias("pos", "e")).where("trim(e) <> ''")
    number = F.regexp_extract("e", r",([^,]*)$", 1).try_cast("double")
    return df.select("set_name", "pos", F.trim(F.regexp_replace("e", r",[^,]*$", "")).alias("gene"), F.coalesce(number, F.lit(1.0)).alias("weight"))


def read_gmx(spark: SparkSession, path: str) -> DataFrame:
    """set_name, description, pos, gene of a column-oriented file: names, descriptions, then ragged genes."""
    df = _lines(spark, path).withColumn("row", F.row_number().over(Window.partitionBy("file").orderBy("line_no")) - 1)  # a set file is small
    cell = df.select("file", "row", F.posexplode(F.split("line", "\t")).alias("col", "text")).withColumn("text", F.trim("text"))
    head = cell.where("row = 0").select("file", "col", F.col("text").alias("set_name"))
    note = cell.where("row = 1").select("file", "col", F.col("text").alias("description"))
    genes = cell.where("row > 1 and text <> ''").select("file", "col", (F.col("row") - 2).alias("pos"), F.col("text").alias("gene"))
    return genes.join(head, ["file", "col"]).join(note, ["file", "col"], "left").where("set_name <> ''").select("set_name", "description", "pos", "gene")


def gmx_lines(members: DataFrame) -> DataFrame:
    """row, value: the lines of a GMX file; sets are columns in name order, short ones padded."""
    sets = members.groupBy("set_name").agg(F.max("description").alias("description")) if "description" in members.columns else members.select("set_name").distinct().withColumn("description", F.lit(None).cast("string"))
    names = sets.withColumn("col", F.row_number().over(Window.orderBy("set_name")))  # one row a set
    n = names.agg(F.max("col").alias("n"))
    cells = (
        names.select("col", F.lit(0).alias("row"), F.col("set_name").alias("text"))
        .unionByName(names.select("col", F.lit(1).alias("row"), F.coalesce("description", "set_name").alias("text")))
        .unionByName(members.join(names.select("set_name", "col"), "set_name").select("col", (F.row_number().over(Window.partitionBy("set_name").orderBy("pos")) + 1).alias("row"), F.col("gene").alias("text")))
    )
    by = cells.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("m")).join(F.broadcast(n))
    return by.select("row", F.array_join(F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.coalesce(F.element_at("m", i), F.lit(""))), "\t").alias("value"))


def write_gmx(members: DataFrame, path: str) -> None:
    gmx_lines(members).orderBy("row").select("value").coalesce(1).write.mode("overwrite").text(path)


def membership_matrix(members: DataFrame) -> DataFrame:
    """gene and one 0/1 column for each set (for reports; keep the long form for work)."""
    return members.groupBy("gene").pivot("set_name").agg(F.lit(1)).na.fill(0).orderBy("gene")


def normalized_sets(members: DataFrame, prefix: str, uppercase: bool = True, least: int = 3) -> DataFrame:
    """PREFIX::name, pos, gene: trimmed, optionally upper case, ordered and distinct, sets of ``least`` genes or more."""
    gene = clean_gene("gene") if uppercase else clean_name("gene")
    df = members.withColumn("gene", gene).where("gene is not null").groupBy("set_name", "gene").agg(F.min("pos").alias("pos"))
    part = Window.partitionBy("set_name")
    df = df.withColumn("n", F.count("*").over(part)).where(F.col("n") >= least)
    return df.select(F.concat(F.lit(prefix + "::"), "set_name").alias("set_name"), (F.row_number().over(part.orderBy("pos", "gene")) - 1).alias("pos"), "gene")


def stacked_sets(collections: list[DataFrame]) -> DataFrame:
    """Union of collections; of sets of one name the later collection's counts."""
    out = None
    for i, df in enumerate(collections):
        df = df.select("set_name", "pos", "gene").withColumn("_i", F.lit(i))
        out = df if out is None else out.unionByName(df)
    last = F.max("_i").over(Window.partitionBy("set_name"))
    return out.withColumn("_l", last).where("_i = _l").select("set_name", "pos", "gene")


def universe_restricted(members: DataFrame, universe: DataFrame, least: int = 3) -> DataFrame:
    """Only genes of the universe, and only sets that keep ``least`` of them."""
    df = members.join(universe.select("gene").distinct(), "gene", "left_semi")
    return df.withColumn("_n", F.count("*").over(Window.partitionBy("set_name"))).where(F.col("_n") >= least).drop("_n")


#: Names of public collections and what their files' names begin with, by species.
COLLECTIONS = {
    "human": {
        "hallmark": "h.all", "kegg": "c2.cp.kegg_legacy", "kegg_legacy": "c2.cp.kegg_legacy", "kegg_medicus": "c2.cp.kegg_medicus", "biocarta": "c2.cp.biocarta", "pid": "c2.cp.pid",
        "reactome": "c2.cp.reactome", "msigdb_reactome": "c2.cp.reactome", "wikipathways": "c2.cp.wikipathways", "msigdb_wikipathways": "c2.cp.wikipathways", "c2_cp": "c2.cp.v",
        "go_bp": "c5.go.bp", "go_cc": "c5.go.cc", "go_mf": "c5.go.mf", "c7": "c7.all", "c7_immunesigdb": "c7.immunesigdb", "immunesigdb": "c7.immunesigdb", "c7_vax": "c7.vax", "vax": "c7.vax",
    },
    "mouse": {
        "hallmark": "mh.all", "kegg": "m2.cp.v", "c2_cp": "m2.cp.v", "reactome": "m2.cp.reactome", "msigdb_reactome": "m2.cp.reactome", "wikipathways": "m2.cp.wikipathways",
        "msigdb_wikipathways": "m2.cp.wikipathways", "go_bp": "m5.go.bp", "go_cc": "m5.go.cc", "go_mf": "m5.go.mf",
    },
}


def supported_collections(species: str = "human") -> list[str]:
    if species not in COLLECTIONS:
        raise ValueError(f"no species {species!r}; there are {', '.join(COLLECTIONS)}")
    return sorted(COLLECTIONS[species])


def load_collection(spark: SparkSession, name: str, folder: str, species: str = "human") -> DataFrame:
    """collection, set_name, description, pos, gene of a collection whose GMT file lies in the folder; nothing is downloaded."""
    if name not in supported_collections(species):
        raise ValueError(f"no collection {name!r}; there are {', '.join(supported_collections(species))}")
    path = f"{folder}/{COLLECTIONS[species][name]}*.gmt*"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    if not found:
        raise FileNotFoundError(path)
    return read_gmt(spark, path).withColumn("collection", F.lit(name))


def load_all_collections(spark: SparkSession, folder: str, species: str = "human", names: list[str] | None = None) -> DataFrame:
    """The named (or all supported) collections of a species, each file once."""
    out, seen = None, set()
    for name in names or supported_collections(species):
        stem = COLLECTIONS[species].get(name)
        if stem in seen:
            continue
        seen.add(stem)
        one = load_collection(spark, name, folder, species)
        out = one if out is None else out.unionByName(one)
    return out
