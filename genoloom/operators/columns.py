"""Which column of a cell table holds the donor, the condition, the cell type, the batch and covariates."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names by which a role's column is known, the most likely first.
SAMPLE = ("donor_id", "donor", "sample_id", "sample", "patient_id", "patient", "subject_id", "subject", "individual", "orig_ident", "orig.ident")
GROUP = ("condition", "group", "diagnosis", "disease", "status", "case_control", "casecontrol", "phenotype")
CELL_TYPE = (
    "cell_type", "celltype", "broad_cell_type", "major_cell_type", "annotation", "cell_label", "celllabel", "cell_ontology_class", "cluster_annotation", "cell_class",
)
BATCH = ("batch", "batch_id", "library", "library_id", "dataset", "run", "plate", "pool", "chemistry", "lane")
COVARIATE = ("age", "sex", "gender", "pmi", "rin")


@dataclass
class Roles:
    sample: str | None = None
    group: str | None = None
    cell_type: str | None = None
    batch: str | None = None
    covariates: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def bare(name: str) -> str:
    return re.sub("[^a-z0-9]", "", name.lower())


def column_counts(cells: DataFrame) -> dict[str, tuple[int, int]]:
    """Column -> (values that are not null, distinct ones): one pass over the table."""
    wide = [F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(cells.columns)]
    wide += [F.countDistinct(F.col(f"`{c}`").cast("string")).alias(f"d{i}") for i, c in enumerate(cells.columns)]
    row = cells.agg(*wide).first()
    return {c: (row[f"n{i}"], row[f"d{i}"]) for i, c in enumerate(cells.columns)}


def best_column(counts: dict[str, tuple[int, int]], names: tuple[str, ...], repeated: bool = False, least: int = 2, most: int | None = None, taken: frozenset[str] | set[str] = frozenset()) -> str | None:
    """The column nearest the names: an exact name beats a name within it, an earlier name a later one, few values many."""

    def score(place: int, column: str) -> tuple[int, int] | None:
        filled, distinct = counts[column]
        if column in taken or not filled or distinct < least or (repeated and distinct >= filled) or (most is not None and distinct > most):
            return None
        own = bare(column)
        fits = [(200 if own == bare(n) else 120) - rank for rank, n in enumerate(names) if bare(n) in own]
        return (-(max(fits) + 10 * repeated - distinct // 100), place) if fits else None

    scored = {c: s for place, c in enumerate(counts) if (s := score(place, c))}
    return min(scored, key=scored.get) if scored else None


def detect(cells: DataFrame, sample: str | None = None, group: str | None = None, cell_type: str | None = None, batch: str | None = None, covariates: tuple[str, ...] = ()) -> Roles:
    """The roles of the columns; named ones must exist, the others are looked for, no column has two roles."""
    given = [c for c in (sample, group, cell_type, batch, *covariates) if c]
    absent = [c for c in given if c not in cells.columns]
    if absent:
        raise KeyError(f"no column {', '.join(absent)}")
    counts, n = column_counts(cells), cells.count()
    out, taken = Roles(), set()

    def settle(role: str, named: str | None, names: tuple[str, ...], hint: str, **limits) -> None:
        found = named or best_column(counts, names, taken=taken, **limits)
        setattr(out, role, found)
        if found:
            taken.add(found)
        elif hint:
            out.warnings.append(f"no column for the {hint} was found; name it")

    settle("group", group, GROUP, "condition", most=12)
    settle("sample", sample, SAMPLE, "donor", repeated=True, most=max(2, min(n - 1, 100_000)))
    settle("cell_type", cell_type, CELL_TYPE, "cell type", most=max(2, min(200, n - 1)))
    settle("batch", batch, BATCH, "", most=max(2, min(96, n - 1)))
    out.covariates = list(covariates)
    if not covariates:
        for name in COVARIATE:
            fits = [c for c in cells.columns if bare(c) == bare(name) and c not in taken and c not in out.covariates and counts[c][1] >= 2]
            out.covariates += fits[:1]
    return out


def selected_types(plan: DataFrame, requested: tuple[str, ...] = (), most: int = 5, every: bool = False) -> DataFrame:
    """The eligible cell types: those requested (at least one must be), all, or the ``most`` of most cells."""
    ok = plan.where("eligible")
    if requested:
        ok = ok.where(F.col("cell_type").isin(*requested))
        if ok.isEmpty():
            raise ValueError("none of the requested cell types is eligible")
        return ok
    return ok if every else ok.orderBy(F.desc("n_cells"), "cell_type").limit(most)
