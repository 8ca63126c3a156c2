"""A report page and figures of a run: HTML tables and SVG drawings of a bounded number of rows, written through Spark's file systems."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table and marks of a figure that a page shows; the tables themselves are published whole beside it.
SHOWN = 200
INK, FILL, LOW = "#222222", "#2a78d6", "#eef3f9"


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One text file at the path, on any file system that Spark can reach."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _cell(value) -> str:
    if value is None:
        return ""
    return f"{value:.4g}" if isinstance(value, float) else escape(str(value))


def table(df: DataFrame, shown: int = SHOWN) -> str:
    """The first rows of a frame in its own order as an HTML table, with a note where more follow."""
    rows = df.limit(shown + 1).collect()
    head = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{_cell(v)}</td>" for v in r) + "</tr>" for r in rows[:shown])
    more = f"<p>The first {shown} rows.</p>" if len(rows) > shown else ""
    return f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>{more}"


def bars(df: DataFrame, label: str, value: str, title: str, shown: int = 20) -> str:
    """A horizontal bar chart of the largest values as SVG; values below 0 or missing are left out."""
    rows = df.where(F.col(value) > 0).orderBy(F.desc(value), label).limit(shown).select(label, value).collect()
    top = max((r[1] for r in rows), default=1.0)
    marks = []
    for i, (name, x) in enumerate(rows):
        y = 40 + 22 * i
        marks.append(
            f'<text x="232" y="{y + 12}" text-anchor="end">{escape(str(name))[:36]}</text><rect x="240" y="{y}" width="{400 * x / top:.1f}" height="16" rx="2" fill="{FILL}"/>'
            f'<text x="{246 + 400 * x / top:.1f}" y="{y + 12}">{x:.3g}</text>'
        )
    return _svg(720, 60 + 22 * len(rows), title, marks)


def heatmap(df: DataFrame, row: str, column: str, value: str, title: str, shown: int = 30) -> str:
    """Values in [0, 1] of at most ``shown`` rows and columns by name, the darker the larger."""
    cells = df.select(row, column, value).where(F.col(value).isNotNull()).orderBy(F.desc(value), row, column).limit(shown * shown).collect()
    rows, columns = ([*dict.fromkeys(r[i] for r in cells)][:shown] for i in (0, 1))
    marks = [f'<text x="200" y="{52 + 18 * i}" text-anchor="end">{escape(str(r))[:30]}</text>' for i, r in enumerate(rows)]
    marks += [f'<text transform="translate({219 + 18 * j},{56 + 18 * len(rows)}) rotate(60)">{escape(str(c))[:30]}</text>' for j, c in enumerate(columns)]
    for r, c, v in cells:
        if r in rows and c in columns:
            x, y = 208 + 18 * columns.index(c), 40 + 18 * rows.index(r)
            marks.append(f'<rect x="{x}" y="{y}" width="17" height="17" fill="{FILL}" fill-opacity="{min(max(float(v), 0), 1):.2f}"><title>{escape(str(r))}, {escape(str(c))}: {v:.3g}</title></rect>')
    return _svg(240 + 18 * len(columns) + 120, 260 + 18 * len(rows), title, marks)


def curve(points: DataFrame, x: str, y: str, title: str, shown: int = 400) -> str:
    """A line through the points in order of x."""
    rows = points.select(x, y).orderBy(x).limit(shown).collect()
    if not rows:
        return _svg(640, 300, title, [])
    lo, hi = min(r[0] for r in rows), max(r[0] for r in rows)
    low, high = min(0.0, *(r[1] for r in rows)), max(0.0, *(r[1] for r in rows))
    place = lambda a, b: f"{40 + 560 * (a - lo) / max(hi - lo, 1e-12):.1f},{270 - 220 * (b - low) / max(high - low, 1e-12):.1f}"
    line = " ".join(place(*r) for r in rows)
    return _svg(640, 300, title, [f'<polyline points="{line}" fill="none" stroke="{FILL}" stroke-width="2"/>', f'<polyline points="{place(lo, 0.0)} {place(hi, 0.0)}" stroke="{INK}" stroke-width="0.5"/>'])


def _svg(width: int, height: int, title: str, marks: list[str]) -> str:
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" font-family="sans-serif" font-size="11" fill="{INK}"><rect width="100%" height="100%" fill="white"/><text x="12" y="22" font-size="14">{escape(title)}</text>{"".join(marks)}</svg>'


def figures(results: dict[str, DataFrame]) -> dict[str, str]:
    """The figures that a run's tables give: programs by FDR, overlaps with references, program sizes."""
    out = {}
    if "enrichment_gsea_with_claim_gates" in results:
        tested = results["enrichment_gsea_with_claim_gates"].withColumn("evidence", -F.log10(F.greatest("fdr", F.lit(1e-300))))
        out["programs_by_fdr"] = bars(tested, "program", "evidence", "Programs by -log10 FDR")
    if "reference_overlap_long" in results:
        out["overlap_heatmap"] = heatmap(results["reference_overlap_long"], "program", "set_name", "jaccard", "Jaccard of programs and references")
    if "dynamic_programs_long" in results:
        out["program_sizes"] = bars(results["dynamic_programs_long"].groupBy("program").agg(F.count("*").alias("n")), "program", "n", "Genes in each program")
    return out


def publish(spark: SparkSession, results: dict[str, DataFrame], folder: str, title: str = "Gene programs") -> list[str]:
    """index.html with the figures and the head of every table; figures as SVG files, tables whole as CSV folders. The paths written."""
    paths, drawn = [], figures(results)
    for name, svg in drawn.items():
        paths.append(f"{folder}/{name}.svg")
        write_text(spark, paths[-1], svg)
    for name, df in results.items():
        flat = df.select([F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes])
        paths.append(f"{folder}/{name}")
        flat.write.mode("overwrite").csv(paths[-1], header=True)
    links = "".join(f'<li><a href="#{escape(n)}">{escape(n)}</a></li>' for n in results)
    parts = [f"<h2>{escape(n)}</h2>{svg}" for n, svg in drawn.items()] + [f'<h2 id="{escape(n)}">{escape(n)}</h2>{table(df)}' for n, df in results.items()]
    style = f"body{{font-family:sans-serif;color:{INK};margin:2em}}table{{border-collapse:collapse}}td,th{{padding:2px 8px;text-align:left;border-bottom:1px solid #ddd}}th{{background:{LOW}}}"
    page = f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{escape(title)}</title><style>{style}</style></head><body><h1>{escape(title)}</h1><ul>{links}</ul>{"".join(parts)}</body></html>'
    paths.append(f"{folder}/index.html")
    write_text(spark, paths[-1], page)
    return paths


def program_overview(gates: DataFrame, best: DataFrame, members: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """One row a program: size, test, gates, best reference and the mean context evidence of its genes."""
    out = members.groupBy("program").agg(F.count("*").alias("n_genes"))
    out = out.join(gates.select("program", "nes", "fdr", "claim_supported"), "program", "left")
    out = out.join(best.select("program", F.col("set_name").alias("best_reference"), F.col("jaccard").alias("best_jaccard")), "program", "left")
    if context is not None:
        out = out.join(context.groupBy("program").agg(F.avg("context_evidence").alias("mean_evidence"), F.avg("context_shift").alias("mean_shift")), "program", "left")
    return out
