"""Set metrics, label agreement, soft metrics."""

from pyspark.sql import functions as F

from genoloom.operators import sets
from genoloom.plans import frames as f
from genoloom.plans.registry import query

_OVERLAP = f.with_(f.PROGRAMS, f.REFERENCES) + """,
 a as (select program, count(distinct gene) as n from programs group by 1), b as (select set_name, count(distinct gene) as n from refs group by 1),
 k as (select program, set_name, count(*) as k from (select distinct program, gene from programs) join (select distinct set_name, gene from refs) using (gene) group by 1, 2),
 o as (select program, set_name, k as overlap_n, a.n as program_n, b.n as reference_n, k / (a.n + b.n - k) as jaccard from k join a using (program) join b using (set_name))
"""


def _overlap(s, d):
    left = f.programs(s, d).select("program", "gene").distinct()
    right = f.references(s, d).select("set_name", "gene").distinct()
    return sets.overlap(left, right, ["program"], ["set_name"], collection=True).withColumnsRenamed({"size_a": "program_n", "size_b": "reference_n"})


@query(_OVERLAP + "select program, set_name, overlap_n, program_n, reference_n, round(jaccard, 6) as jaccard from o")
def overlap_long(s, d):
    return _overlap(s, d).withColumn("jaccard", F.round("jaccard", 6)).select("program", "set_name", "overlap_n", "program_n", "reference_n", "jaccard")


@query(_OVERLAP + """select program, set_name, overlap_n, round(jaccard, 6) as jaccard from o
 qualify row_number() over (partition by program order by round(jaccard, 12) desc, overlap_n desc, set_name) = 1""")
def best_reference(s, d):
    best = sets.best_match(_overlap(s, d), ["program"], "set_name", [F.desc("overlap_n")])
    return best.select("program", "set_name", "overlap_n", F.round("jaccard", 6).alias("jaccard"))


@query(f.with_(f.PROGRAMS, f.REFERENCES) + """select collection_name, count(*) as n_genes, count(p.gene) as n_covered, round(count(p.gene) / count(*), 6) as coverage
 from (select distinct collection_name, gene from refs) r left join (select distinct gene from programs) p on p.gene = r.gene group by 1""")
def reference_coverage(s, d):
    return sets.coverage(f.programs(s, d), f.references(s, d), ["collection_name"]).withColumn("coverage", F.round("coverage", 6))


@query(f.with_(f.PROGRAMS, f.REFERENCES) + """select run_id, count(*) as n_memberships, round(1 - count(r.gene) / count(*), 6) as novelty
 from programs p left join (select distinct gene from refs) r on p.gene = r.gene group by 1""")
def run_novelty(s, d):
    return sets.novelty(f.programs(s, d), f.references(s, d), ["run_id"]).withColumn("novelty", F.round("novelty", 6))


@query(f.with_(f.PROGRAMS) + """, z as (select run_id, program, count(*) as n from programs group by 1, 2),
 k as (select a.run_id, a.program as p, b.program as q, count(*) as k from programs a join programs b on a.run_id = b.run_id and a.gene = b.gene and a.program < b.program group by 1, 2, 3),
 t as (select k.run_id, sum(k / (x.n + y.n - k)) as total from k join z x on x.run_id = k.run_id and x.program = p join z y on y.run_id = k.run_id and y.program = q group by 1),
 c as (select run_id, count(*) as n_sets from z group by 1)
select run_id, n_sets, round(case when n_sets < 2 then 0 else coalesce(total / (n_sets * (n_sets - 1) / 2), 0) end, 6) as redundancy from c left join t using (run_id)""")
def run_redundancy(s, d):
    return sets.mean_pairwise_jaccard(f.programs(s, d), ["run_id"], "program").withColumn("redundancy", F.round("redundancy", 6))


@query(f.with_(f.PROGRAMS) + """, z as (select *, count(*) over (partition by run_id, gene) as n from programs),
 p as (select run_id, program, avg(case when n = 1 then 1.0::double else 0.0::double end) as share from z group by 1, 2)
select run_id, count(*) as n_sets, round(avg(share), 6) as specificity from p group by 1""")
def run_specificity(s, d):
    return sets.specificity(f.programs(s, d), ["run_id"], "program").withColumn("specificity", F.round("specificity", 6))


_LABELS = f.with_(f.PROGRAMS) + """, l as (select run_id, gene, min(program) as label from programs group by 1, 2),
 e as (select distinct run_id, ensemble_id from discovery_runs where run_id is not null and ensemble_id is not null),
 h as (select ensemble_id, min(run_id) as first_run from e group by 1)
"""


@query(_LABELS + "select run_id, gene, label from l")
def program_labels(s, d):
    return sets.first_labels(f.programs(s, d), ["run_id"], "program")


@query(_LABELS + """, j as (select e.ensemble_id, e.run_id, a.label as la, b.label as lb from e join h using (ensemble_id) join l a on a.run_id = first_run
   join l b on b.run_id = e.run_id and a.gene = b.gene where e.run_id <> first_run),
 c as (select ensemble_id, run_id, la, lb, count(*) as n from j group by all),
 ra as (select ensemble_id, run_id, la, sum(n) as a from c group by all), rb as (select ensemble_id, run_id, lb, sum(n) as b from c group by all),
 x as (select ensemble_id, run_id, sum(n) as n, sum(n * (n - 1) / 2) as sc, sum(n * ln(n)) as lc from c group by all),
 y as (select ensemble_id, run_id, sum(a * (a - 1) / 2) as sa, sum(a * ln(a)) as lx, count(*) as ka from ra group by all),
 w as (select ensemble_id, run_id, sum(b * (b - 1) / 2) as sb, sum(b * ln(b)) as ly, count(*) as kb from rb group by all),
 t as (select *, case when n < 2 then 0 else sa * sb / (n * (n - 1) / 2) end as ex, (sa + sb) / 2 as top from x join y using (ensemble_id, run_id) join w using (ensemble_id, run_id))
select ensemble_id, run_id, n::bigint as n_genes, round(case when abs(top - ex) < 1e-12 then 1 else (sc - ex) / (top - ex) end, 6) as ari,
 round(case when ka = 1 and kb = 1 then 1 else coalesce(greatest(ln(n) + (lc - lx - ly) / n, 0) / nullif((2 * ln(n) - (lx + ly) / n) / 2, 0), 0) end, 6) as nmi from t""")
def label_agreement(s, d):
    """The first run of each ensemble against its other runs."""
    labels = sets.first_labels(f.programs(s, d), ["run_id"], "program")
    runs = f.load(s, d, "discovery_runs").select("run_id", "ensemble_id").where("run_id is not null and ensemble_id is not null").distinct()
    first = runs.groupBy("ensemble_id").agg(F.min("run_id").alias("first_run"))
    pairs = runs.join(first, "ensemble_id").where("run_id <> first_run")
    a = labels.select(F.col("run_id").alias("first_run"), "gene", F.col("label").alias("label_a"))
    b = labels.select("run_id", "gene", F.col("label").alias("label_b"))
    out = sets.label_agreement(pairs.join(a, "first_run").join(b, ["run_id", "gene"]), ["ensemble_id", "run_id"])
    return out.withColumns({"ari": F.round("ari", 6), "nmi": F.round("nmi", 6)})


@query(f.with_(f.CONTEXT) + """, w as (select run_id, program, gene, greatest(base_membership, 0) as weight from context where base_membership is not null),
 p as (select *, coalesce(weight / nullif(sum(weight) over (partition by run_id, gene), 0), 0) as p from w),
 g as (select run_id, gene, greatest(-sum(p * ln(p + 1e-12)), 0) as entropy, max(weight) as top, count(*) filter (weight >= 0.1) as n_over from p group by 1, 2),
 n as (select run_id, count(distinct program) as n_programs from w group by 1),
 o as (select run_id, count(*) as n_genes, count(*) filter (top >= 0.1) as n_covered, avg(case when n_over > 0 then n_over end) as mo, avg(entropy) as mean_entropy from g group by 1)
select run_id, n_programs, n_genes, n_covered, round(coalesce(mo, 1) - 1, 6) as redundancy, round(mean_entropy, 6) as mean_entropy,
 round(case when n_programs < 2 then 1 else 1 - mean_entropy / ln(n_programs) end, 6) as specificity from o join n using (run_id)""")
def soft_metrics(s, d):
    w = f.context(s, d).where("base_membership is not null").select("run_id", "program", "gene", F.greatest("base_membership", F.lit(0.0)).alias("weight"))
    out = sets.soft_metrics(w, ["run_id"])
    return out.withColumns({c: F.round(c, 6) for c in ("redundancy", "mean_entropy", "specificity")})
