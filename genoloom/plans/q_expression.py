"""Normalisation, contrasts, rankings, pseudobulk and quality filters."""

from pyspark.sql import functions as F

from genoloom.operators import expression as ex
from genoloom.plans import frames as f
from genoloom.plans.registry import query

_CPM = f.with_(f.EXPRESSION, f.SAMPLES) + """, cpm as (select sample, gene, ln(1 + value * 1e6 / sum(value) over (partition by sample)) as value from expr)"""


def _cpm(s, d):
    return ex.log_cpm(f.expression(s, d))


@query(_CPM + " select sample, gene, round(value, 6) as value from cpm")
def log_cpm(s, d):
    return _cpm(s, d).select("sample", "gene", F.round("value", 6).alias("value"))


_PANELS = 600
_SIMPSON = f"""(list_sum(list_transform(range(0, {_PANELS + 1}), lambda i: case when i in (0, {_PANELS}) then 1 when i % 2 = 1 then 4 else 2 end *
   pow(cos(least(lo + (pi() / 2 - lo) * i / {_PANELS}, pi() / 2)), dof - 1))) * (pi() / 2 - lo))
 / (list_sum(list_transform(range(0, {_PANELS + 1}), lambda i: case when i in (0, {_PANELS}) then 1 when i % 2 = 1 then 4 else 2 end *
   pow(cos(least(pi() / 2 * i / {_PANELS}, pi() / 2)), dof - 1))) * (pi() / 2))"""

_DE = _CPM + f""", n as (select count(*) filter (grp = 'case') as n_a, count(*) filter (grp = 'control') as n_b from samples),
 g as (select gene, coalesce(sum(value) filter (grp = 'case'), 0) as sa, coalesce(sum(value * value) filter (grp = 'case'), 0) as qa,
   coalesce(sum(value) filter (grp = 'control'), 0) as sb, coalesce(sum(value * value) filter (grp = 'control'), 0) as qb from cpm join samples using (sample) group by 1),
 m as (select *, sa / n_a as mean_a, sb / n_b as mean_b from g, n),
 w as (select *, greatest((qa - n_a * mean_a * mean_a) / (n_a - 1), 0) / n_a as a, greatest((qb - n_b * mean_b * mean_b) / (n_b - 1), 0) / n_b as b from m),
 t as (select *, (mean_a - mean_b) / sqrt(a + b) as t, (a + b) * (a + b) / (a * a / (n_a - 1) + b * b / (n_b - 1)) as dof from w),
 p0 as (select *, atan(abs(t) / sqrt(dof)) as lo from t),
 p as (select gene, mean_a, mean_b, mean_a - mean_b as logfc, t, dof, greatest(least({_SIMPSON}, 1), 1e-300) as p_value from p0),
 de as (select *, least(1.0, min(p_value * k / r) over (order by r desc)) as fdr from (select *, count(*) over () as k, row_number() over (order by p_value, gene) as r from p))
"""


def de_rows(s, d):
    return ex.two_group_test(_cpm(s, d), f.samples(s, d), ("case", "control"))


@query(_DE + "select gene, round(mean_a, 6) as mean_a, round(mean_b, 6) as mean_b, round(logfc, 6) as logfc, round(t, 5) as t, round(dof, 4) as dof, round(p_value, 4) as p_value, round(fdr, 3) as fdr from de")
def differential_expression(s, d):
    return de_rows(s, d).select("gene", *[F.round(c, n).alias(c) for c, n in (("mean_a", 6), ("mean_b", 6), ("logfc", 6), ("t", 5), ("dof", 4), ("p_value", 4), ("fdr", 3))])


@query(_DE + "select gene, round(-log10(p_value) * sign(logfc), 4) as score from de")
def de_ranking(s, d):
    return ex.rank_score(de_rows(s, d)).select("gene", F.round("score", 4).alias("score"))


@query(f.with_(f.EXPRESSION, f.SAMPLES) + """, n as (select count(*) as n from samples), sz as (select grp, count(*) as n_in from samples group by 1),
 v as (select expr.*, grp, rank() over (partition by gene order by value) + (count(*) over (partition by gene, value) - 1) / 2 as r, count(*) over (partition by gene) as nz,
   count(*) over (partition by gene, value) as ties from expr join samples using (sample) where value > 0),
 g as (select gene, max(nz) as nz, sum(ties * ties - 1.0::double) + pow(max(n) - max(nz), 3) - (max(n) - max(nz)) as tie, max(n) as n from v, n group by 1),
 o as (select gene, grp, sum(r) as rs, count(*) as k from v group by 1, 2),
 z as (select grp, gene, n_in, rs + k * (n - nz) + (n_in - k) * (n - nz + 1) / 2 as total, n_in * (n - n_in) / 12 * (n + 1 - tie / (n * (n - 1.0::double))) as var, n, n - n_in as b from o join g using (gene) join sz using (grp))
select grp, gene, n_in, round(case when var > 0 and b > 0 then (total - n_in * (n + 1) / 2) / sqrt(var) else 0 end, 6) as z from z""")
def rank_sum_scores(s, d):
    out = ex.rank_sums(f.expression(s, d), f.samples(s, d).select("sample", "grp"))
    return out.withColumn("z", F.round("z", 6))


@query(f.with_(f.EXPRESSION) + """, n as (select count(*) as n from supplier), v as (select gene, sum(value * value) / max(n) - pow(sum(value) / max(n), 2) as variance from expr, n group by 1)
select gene, round(variance, 6) as variance, row_number() over (order by round(variance, 9) desc, gene) as position from v qualify position <= 500""")
def top_variance_genes(s, d):
    out = ex.top_variance(f.expression(s, d), f.load(s, d, "supplier").count(), 500)
    return out.withColumn("variance", F.round("variance", 6))


_CELLS = """cells as (select o_orderkey as cell, o_custkey as donor, case when c_acctbal >= 4500 then 'case' else 'control' end as condition, o_orderpriority as cell_type
  from orders join customer on c_custkey = o_custkey), counts as (select l_orderkey as cell, l_partkey as gene, sum(l_quantity) as value from lineitem group by 1, 2)"""


def cells(s, d):
    """Orders stand for cells, customers for donors, priorities for cell types."""
    c = f.load(s, d, "customer").select(F.col("c_custkey").alias("donor"), F.when(F.col("c_acctbal") >= 4500, "case").otherwise("control").alias("condition"))
    o = f.load(s, d, "orders").select(F.col("o_orderkey").alias("cell"), F.col("o_custkey").alias("donor"), F.col("o_orderpriority").alias("cell_type"))
    return o.join(c, "donor").select("cell", "donor", "condition", "cell_type")


def counts(s, d):
    df = f.load(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("cell"), F.col("l_partkey").alias("gene"))
    return df.agg(F.sum("l_quantity").alias("value"))


@query(f.with_(_CELLS) + "select donor, cell_type, gene, sum(value) as value from counts join cells using (cell) group by 1, 2, 3")
def pseudobulk_sums(s, d):
    return ex.pseudobulk(counts(s, d), cells(s, d), ["donor", "cell_type"])[0]


@query(f.with_(_CELLS) + "select donor, cell_type, count(distinct cell) as n_cells from cells group by 1, 2")
def pseudobulk_cells(s, d):
    return ex.pseudobulk(counts(s, d), cells(s, d), ["donor", "cell_type"])[1]


@query(f.with_(_CELLS) + """, x as (select cell_type, donor, condition, count(*) as n from cells group by 1, 2, 3)
select cell_type, sum(n)::bigint as n_cells, count(*) filter (n >= 3 and condition = 'case') as donors_a, count(*) filter (n >= 3 and condition = 'control') as donors_b,
 donors_a >= 2 and donors_b >= 2 as eligible from x group by 1""")
def cell_type_plan(s, d):
    return ex.cell_type_plan(cells(s, d), ("case", "control"), 3)


@query(f.with_(_CELLS) + """, a as (select * from counts where value > 0 qualify count(*) over (partition by cell) >= 4), b as (select * from a qualify count(*) over (partition by gene) >= 20)
select cell as sample, gene, value from b""")
def quality_filter(s, d):
    return ex.quality_filter(counts(s, d).withColumnRenamed("cell", "sample"), 4, 20)


@query(_CPM + """, n as (select count(*) as n from part), m as (select sample, sum(value) as s, sum(value * value) as q from cpm group by 1),
 dp as (select x.sample as a, y.sample as b, sum(x.value * y.value) as dd from cpm x join cpm y on x.gene = y.gene and x.sample < y.sample group by 1, 2),
 r as (select a, b, (dd - p.s * o.s / n) / nullif(sqrt(greatest((p.q - p.s * p.s / n) * (o.q - o.s * o.s / n), 0)), 0) as r from dp join m p on p.sample = a join m o on o.sample = b, n)
select k.batch = l.batch as same_batch, count(*) as n_pairs, round(avg(r), 6) as mean_r from r join samples k on k.sample = a join samples l on l.sample = b group by 1""")
def batch_correlation(s, d):
    """Mean correlation of samples within and between batches; the SQL leaves out pairs without a common gene."""
    out = ex.batch_correlation(_cpm(s, d), f.samples(s, d), f.load(s, d, "part").count())
    return out.withColumn("mean_r", F.round("mean_r", 6))


@query(f.with_(f.SAMPLES) + "select batch, count(*) filter (grp = 'case') as n_case, count(*) filter (grp = 'control') as n_control, n_case = 0 or n_control = 0 as confounded from samples group by 1")
def batch_contingency(s, d):
    one = lambda g: F.count(F.when(F.col("grp") == g, 1))
    out = f.samples(s, d).groupBy("batch").agg(one("case").alias("n_case"), one("control").alias("n_control"))
    return out.withColumn("confounded", (F.col("n_case") == 0) | (F.col("n_control") == 0))


