"""Every query of the survey operators by name, with the SQL it is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veyra.operators import guard as G
from veyra.operators import resample as R
from veyra.operators import selection as S
from veyra.operators import survey as V
from veyra.sources import manifest as M

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
CUTS, LABELS = (35000.0, 70000.0), ("Low", "Medium", "High")
PVS = range(1, 11)


def add(name: str, sql: str | None = None):
    """Registers a query, with the SQL that gives its rows where there is one."""
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return keep


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to digits places and whole numbers as long, for comparison by value."""
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, digits).alias(c) if kinds[c] == "double" else F.col(c).cast("long").alias(c) if kinds[c] in ("int", "bigint") else F.col(c) for c in df.columns])


def pv(i: int):
    return F.col("l_extendedprice") * (1 + 0.02 * (((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13 + i * 31) % 11) - 5))


PV_SQL = "l_extendedprice*(1+0.02*(((l_orderkey*7+l_linenumber*13+{i}*31)%11)-5))"
CASE = "case when {x} is null then null when {x} < 35000 then 'Low' when {x} < 70000 then 'Medium' else 'High' end"


def factors() -> list:
    return [F.when(((F.col("l_suppkey") * r) % 83) % 2 == 0, 1.5).otherwise(0.5) for r in range(1, 81)]


def replicates() -> list:
    return [F.col("l_quantity") * f for f in factors()]


BRR_SQL = """with x as (select {by} as g, {value} as v, l_quantity as w, l_suppkey from lineitem), r as (select unnest(range(0, 81)) as r),
t as (select g, r, sum(v*w*f)/sum(case when v is not null then w*f end) as t from (select *, case when r = 0 then 1.0 when ((l_suppkey*r)%83)%2 = 0 then 1.5 else 0.5 end as f from x, r) group by g, r),
f as (select g, max(case when r = 0 then t end) as e from t group by g), s as (select t.g, e, sqrt(sum((t-e)*(t-e))/(count(*)*0.25)) as se, count(*) as n from t join f on t.g = f.g where r > 0 group by t.g, e)
select g as {name}, round(e,6) as estimate, round(se,6) as brr_se, round(e-1.96*se,6) as ci_low, round(e+1.96*se,6) as ci_high, n as n_replicates_used from s"""


@add("brr_proportions", BRR_SQL.replace("{by}", "c.column0").replace("select c.column0 as g, {value} as v, l_quantity as w, l_suppkey from lineitem", "select c.g, case when k = c.g then 1.0 else 0.0 end as v, l_quantity as w, l_suppkey from (select *, " + CASE.format(x=PV_SQL.format(i=1)) + " as k from lineitem), (values ('Low'),('Medium'),('High')) c(g)").format(name="category"))
def brr_proportions(spark, d):
    rows = read(spark, d, "lineitem")
    return rounded(V.brr_shares(rows, [], V.categorize(pv(1), CUTS, LABELS), LABELS, F.col("l_quantity"), replicates()).drop("brr_variance", "fay_k"))


@add("brr_means", BRR_SQL.format(by="l_returnflag", value="case when l_partkey%11 = 0 then null else l_discount end", name="l_returnflag"))
def brr_means(spark, d):
    return rounded(V.brr(read(spark, d, "lineitem"), ["l_returnflag"], F.when(F.col("l_partkey") % 11 != 0, F.col("l_discount")), F.col("l_quantity"), factors(), cluster="l_suppkey").drop("brr_variance", "fay_k"))


@add("weighted_moments", "with x as (select *, case when l_partkey%11 = 0 then null else l_discount end as v from lineitem), m as (select l_returnflag, l_linestatus, sum(v*l_quantity)/sum(case when v is not null then l_quantity end) as m from x group by all) select x.l_returnflag, x.l_linestatus, round(m,6) as wmean, round(sum(power(v-m,2)*l_quantity)/sum(case when v is not null then l_quantity end),6) as wvar, round(sqrt(sum(power(v-m,2)*l_quantity)/sum(case when v is not null then l_quantity end)),6) as wstd from x join m on x.l_returnflag = m.l_returnflag and x.l_linestatus = m.l_linestatus group by x.l_returnflag, x.l_linestatus, m")
def weighted_moments(spark, d):
    rows = read(spark, d, "lineitem").withColumn("v", F.when(F.col("l_partkey") % 11 != 0, F.col("l_discount")))
    return rounded(V.weighted_moments(rows, ["l_returnflag", "l_linestatus"], "v", "l_quantity"))


@add("pv_category_counts", " union all ".join(f"select {i} as pv, {CASE.format(x=PV_SQL.format(i=i))} as category, count(*) as n from lineitem group by 2" for i in PVS))
def pv_category_counts(spark, d):
    rows = V.pv_categories(read(spark, d, "lineitem").select(*[pv(i).alias(f"PV{i}MATH") for i in PVS]), "PV{i}MATH", 10, CUTS, LABELS)
    long = rows.select(F.posexplode(F.array(*[f"cat_pv{i}" for i in PVS])).alias("pv", "category"))
    return rounded(long.groupBy((F.col("pv") + 1).alias("pv"), "category").agg(F.count("*").alias("n")))


@add("task_labels", "select label, count(*) as n from (select case k when 'Low' then 0 when 'High' then 1 end as label from (select " + CASE.format(x="l_extendedprice") + " as k from lineitem)) group by 1")
def task_labels(spark, d):
    k = V.categorize(F.col("l_extendedprice"), CUTS, LABELS)
    return rounded(read(spark, d, "lineitem").select(V.task_label(k, "Low", "High").alias("label")).groupBy("label").agg(F.count("*").alias("n")))


@add("category_instability", "with c as (select l_quantity as w, [" + ",".join(CASE.format(x=PV_SQL.format(i=i)) for i in PVS) + "] as c from lineitem), s as (select w, case when len(list_distinct(c)) > 1 then 1.0 else 0.0 end as u, greatest(len(list_filter(c, lambda x: x = 'Low')), len(list_filter(c, lambda x: x = 'Medium')), len(list_filter(c, lambda x: x = 'High')))/10.0 as m from c) select round(sum(u*w)/sum(w),6) as unstable, round(sum(m*w)/sum(w),6) as modal_share, round(sum((1-u)*w)/sum(w),6) as stable from s")
def category_instability(spark, d):
    rows = read(spark, d, "lineitem").select("l_quantity", *[V.categorize(pv(i), CUTS, LABELS).alias(f"c{i}") for i in PVS])
    return rounded(V.instability(rows, [f"c{i}" for i in PVS], LABELS, F.col("l_quantity")))


@add("rubin_by_flag", "with e as (" + " union all ".join(f"select l_returnflag, {i} as pv, avg({PV_SQL.format(i=i)}) as e, var_samp({PV_SQL.format(i=i)})/count(*) as v from lineitem group by 1" for i in PVS) + "), s as (select l_returnflag, avg(e) as q, avg(v) as u, var_samp(e) as b, count(*) as m from e group by 1) select l_returnflag, round(q,4) as q_bar, round(u,4) as within, round(b,4) as between, m, round(u+(1+1.0/m)*b,4) as total_var, round(sqrt(u+(1+1.0/m)*b),4) as se, round((1+1.0/m)*b/u,4) as riv, round((1+1.0/m)*b/(u+(1+1.0/m)*b),4) as fmi from s")
def rubin_by_flag(spark, d):
    aggs = [x for i in PVS for x in (F.avg(pv(i)).alias(f"e{i}"), (F.var_samp(pv(i)) / F.count("*")).alias(f"v{i}"))]
    wide = read(spark, d, "lineitem").groupBy("l_returnflag").agg(*aggs)
    long = wide.select("l_returnflag", F.explode(F.array(*[F.struct(F.col(f"e{i}").alias("e"), F.col(f"v{i}").alias("v")) for i in PVS])).alias("x")).select("l_returnflag", "x.*")
    return rounded(V.rubin(long, ["l_returnflag"], "e", "v"), 4).drop("df")


@add("sample_flow", " union all ".join(f"select {t} as threshold, count(*) as n, count(distinct o_custkey) as n_psu from orders where o_orderkey%7 <= {t}" for t in (2, 4, 6)))
def sample_flow(spark, d):
    return rounded(V.sample_flow(read(spark, d, "orders").withColumn("missing", F.col("o_orderkey") % 7), "missing", "o_custkey", (2, 4, 6)))


@add("design_diagnostics", "with p as (select l_suppkey, count(*) as c from lineitem group by 1) select count(*) as n, (select count(*) from p) as n_psu, (select round(avg(c),6) from p) as mean_per_psu, (select min(c) from p) as min_per_psu, (select max(c) from p) as max_per_psu, round(sum(l_quantity),6) as sum_w, min(l_quantity) as min_w, max(l_quantity) as max_w, round(sum(l_quantity)*sum(l_quantity)/sum(l_quantity*l_quantity),6) as kish_n, round(count(*)/(sum(l_quantity)*sum(l_quantity)/sum(l_quantity*l_quantity)),6) as deff, count(distinct l_returnflag) as n_strata, round(stddev_pop(l_quantity)/avg(l_quantity),6) as cv_w, 80 as n_replicates from lineitem")
def design_diagnostics(spark, d):
    return rounded(V.design_diagnostics(read(spark, d, "lineitem"), "l_suppkey", "l_quantity", "l_returnflag", 80))


@add("normalised_weights", "with w as (select l_returnflag, l_quantity*(select count(*) from lineitem)/(select sum(l_quantity) from lineitem) as v from lineitem) select l_returnflag, round(sum(v),4) as total from w group by 1")
def normalised_weights(spark, d):
    return rounded(V.normalised_weights(read(spark, d, "lineitem"), "l_quantity").groupBy("l_returnflag").agg(F.sum("w_norm").alias("total")), 4)


AUC_SQL = """with s as (select {by} as g, {score} as s, sum(case when {y} = 1 then {w} else 0 end) as p, sum(case when {y} = 0 then {w} else 0 end) as n from {table} group by 1, 2),
c as (select *, sum(n) over (partition by g order by s rows unbounded preceding) as b from s) select g as {name}, round(sum(p*(b-n/2.0))/(sum(p)*sum(n)),6) as auc from c group by 1"""
URGENT = "case when o_orderpriority in ('1-URGENT','2-HIGH') then 1 else 0 end"


def orders(spark, d):
    return read(spark, d, "orders").withColumn("y", F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int"))


@add("auc_by_status", AUC_SQL.format(by="o_orderstatus", score="o_totalprice", y=URGENT, w="1.0", table="orders", name="o_orderstatus"))
def auc_by_status(spark, d):
    return rounded(V.auc(orders(spark, d), ["o_orderstatus"], "y", "o_totalprice"))


@add("weighted_auc", AUC_SQL.format(by="o_orderstatus", score="o_totalprice", y=URGENT, w="(1.0+o_orderkey%5)", table="orders", name="o_orderstatus"))
def weighted_auc(spark, d):
    return rounded(V.auc(orders(spark, d), ["o_orderstatus"], "y", "o_totalprice", 1.0 + F.col("o_orderkey") % 5))


@add("average_precision", f"with s as (select o_orderstatus as g, o_totalprice as s, sum({URGENT}) as p, sum(1-{URGENT}) as n from orders group by 1, 2), c as (select *, sum(p) over w as cp, sum(n) over w as cn from s window w as (partition by g order by s desc rows unbounded preceding)) select g as o_orderstatus, round(sum(p*cp/(cp+cn))/sum(p),6) as ap from c group by 1")
def average_precision(spark, d):
    return rounded(V.average_precision(orders(spark, d), ["o_orderstatus"], "y", "o_totalprice"))


METRICS_SQL = f"""with o as (select o_orderstatus, {URGENT} as y, o_totalprice/500000 as s, 1.0+o_orderkey%5 as w from orders),
c as (select o_orderstatus, sum(case when y=1 and s>=0.5 then w else 0 end)::double as tp, sum(case when y=1 and s<0.5 then w else 0 end)::double as fn, sum(case when y=0 and s>=0.5 then w else 0 end)::double as fp, sum(case when y=0 and s<0.5 then w else 0 end)::double as tn, count(*) as n, sum(w*power(greatest(0,least(1,s))-y,2))/sum(w) as brier from o group by 1),
k as (select o_orderstatus, s, sum(y*w) as p, sum((1-y)*w) as q from o group by 1, 2), u as (select *, sum(q) over a as b, sum(p) over z as cp, sum(q) over z as cq from k window a as (partition by o_orderstatus order by s rows unbounded preceding), z as (partition by o_orderstatus order by s desc rows unbounded preceding)),
r as (select o_orderstatus, sum(p*(b-q/2))/(sum(p)*sum(q)) as auc, sum(p*cp/(cp+cq))/sum(p) as ap from u group by 1)
select c.o_orderstatus, tp, fn, fp, tn, n, round(brier,6) as brier, round((tp+tn)/(tp+fn+fp+tn),6) as accuracy, round(coalesce(tp/nullif(tp+fn,0),0),6) as recall, round(coalesce(tp/nullif(tp+fp,0),0),6) as precision, round(coalesce(tn/nullif(tn+fp,0),0),6) as specificity, round(coalesce(fn/nullif(tp+fn,0),0),6) as fnr, round(coalesce(fp/nullif(tn+fp,0),0),6) as fpr, round((tp+fn)/(tp+fn+fp+tn),6) as prevalence, round(coalesce(2*tp/nullif(2*tp+fp+fn,0),0),6) as f1, round((coalesce(tp/nullif(tp+fn,0),0)+coalesce(tn/nullif(tn+fp,0),0))/2,6) as balanced_accuracy, 0.5::double as threshold, round(auc,6)::double as auc, round(ap,6)::double as ap, true as weighted from c join r on c.o_orderstatus = r.o_orderstatus"""


@add("classification_metrics", METRICS_SQL)
def classification_metrics(spark, d):
    rows = orders(spark, d).withColumn("s", F.col("o_totalprice") / 500000)
    return rounded(V.classification_metrics(rows, ["o_orderstatus"], "y", "s", 0.5, 1.0 + F.col("o_orderkey") % 5))


GRID = [x / 20 for x in range(1, 20)]


@add("select_threshold", f"with t as (select g.t, coalesce(avg(case when y=1 then case when s >= t then 1.0 else 0 end end),0) as r, coalesce(avg(case when y=0 then case when s < t then 1.0 else 0 end end),0) as q from (select {URGENT} as y, o_totalprice/500000 as s from orders), (values {','.join(f'({x}::double)' for x in GRID)}) g(t) group by 1) select t as threshold, round((r+q)/2,6) as value from t order by round((r+q)/2,12) desc, t limit 1")
def select_threshold(spark, d):
    return rounded(V.select_threshold(orders(spark, d), "y", F.col("o_totalprice") / 500000, GRID))


FEATURES = ("l_quantity", "l_discount", "l_tax", "l_linenumber")
LONG_SQL = "select feature, value, y from (" + " union all ".join(f"select '{f}' as feature, {f}::double as value, case when l_returnflag = 'R' then 1 else 0 end as y from lineitem" for f in FEATURES) + ")"


def long(spark, d):
    rows = read(spark, d, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    return S.unpivot(rows, ["y"], FEATURES)


@add("screen_auc", f"with x as ({LONG_SQL}), s as (select feature, value, sum(y) as p, sum(1-y) as n from x group by 1, 2), c as (select *, sum(n) over (partition by feature order by value rows unbounded preceding) as b from s), a as (select feature, sum(p*(b-n/2.0))/(sum(p)*sum(n)) as a, sum(p+n) as k from c group by 1) select feature, round(a,6) as auc_signed, round(greatest(a,1-a),6) as auc, k::bigint as n_used, greatest(a,1-a) > 0.95 as flagged, 0.95::double as ceiling from a")
def screen_auc(spark, d):
    return rounded(G.single_variable_screen(long(spark, d), "y"))


BIN_SQL = f"with x as ({LONG_SQL}), q as (select feature, list_distinct(quantile_cont(value, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9])) as cuts, list_sort(list_distinct(list(value))) as vals from x group by 1), m as (select feature, case when len(vals) <= 10 then vals else cuts end as marks, case when len(vals) <= 10 then 1 else 0 end as dense from q), b as (select x.feature, y, len(list_filter(marks, lambda c: c <= value)) - dense as bin from x join m on x.feature = m.feature)"


@add("decile_bins", BIN_SQL + " select feature, bin, count(*) as n from b group by 1, 2")
def decile_bins(spark, d):
    return rounded(S.decile_bins(long(spark, d)).groupBy("feature", "bin").agg(F.count("*").alias("n")))


@add("entropy", BIN_SQL + ", n as (select feature, bin, count(*) as c from b group by 1, 2), t as (select *, sum(c) over (partition by feature) as t from n) select feature, round(sum(-c/t*ln(c/t)),6) as entropy from t group by 1")
def entropy(spark, d):
    return rounded(S.entropy(S.decile_bins(long(spark, d)), ["feature"], "bin"))


@add("symmetric_uncertainty", BIN_SQL + ", n as (select feature, bin, y, count(*)::double as c from b group by 1, 2, 3), t as (select *, sum(c) over (partition by feature) as t, sum(c) over (partition by feature, bin) as xx, sum(c) over (partition by feature, y) as yy from n), s as (select feature, sum(c/t*ln(c*t/(xx*yy))) as mi, sum(-c/t*ln(xx/t)) as hx, sum(-c/t*ln(yy/t)) as hy from t group by 1) select feature, round(greatest(mi,0),8) as mi, round(2*mi/(hx+hy),8) as su from s")
def symmetric_uncertainty(spark, d):
    return rounded(S.symmetric_uncertainty(S.decile_bins(long(spark, d)), "y"), 8)


CHI_SQL = f"with x as ({LONG_SQL}), s as (select feature, y, sum(value) as o, count(*) as k from x group by 1, 2), e as (select *, sum(o) over (partition by feature)*k/sum(k) over (partition by feature) as e from s), c as (select feature, sum((o-e)*(o-e)/e) as chi2 from e group by 1)"


@add("chi2_scores", CHI_SQL + " select feature, round(chi2,6) as chi2 from c")
def chi2_scores(spark, d):
    return rounded(S.chi2(long(spark, d), "y"))


@add("chi2_top_k", CHI_SQL + " select feature, round(chi2,6) as chi2, row_number() over (order by chi2 desc, feature) as rank from c order by chi2 desc, feature limit 2")
def chi2_top_k(spark, d):
    return rounded(S.top_k(S.chi2(long(spark, d), "y"), "chi2", 2))


@add("group_differences", f"with x as ({LONG_SQL}), s as (select feature, avg(value) filter (y=1) - avg(value) filter (y=0) as m, sqrt(((count(*) filter (y=1)-1)*var_samp(value) filter (y=1)+(count(*) filter (y=0)-1)*var_samp(value) filter (y=0))/(count(*)-2)) as sd, count(*) as n from x group by 1) select feature, round(m/sd,6) as d, round(m/sd*(1-3/(4.0*(n-2)-1)),6) as hedges_g, case when abs(m/sd) < 0.2 then 'negligible' when abs(m/sd) < 0.5 then 'small' when abs(m/sd) < 0.8 then 'medium' else 'large' end as band from s")
def group_differences(spark, d):
    return rounded(S.group_differences(long(spark, d), "y"))


FOLDS_SQL = "f as (select event_type, user_id, avg(value) as v from events group by 1, 2), d as (select a.event_type, a.v-b.v as d from f a join f b on a.user_id = b.user_id and b.event_type = 'purchase' and a.event_type <> 'purchase'), s as (select event_type, count(*) as n, avg(d) as m, var_samp(d) as v from d group by 1)"


def folds(spark, d):
    return read(spark, d, "events").groupBy("event_type", "user_id").agg(F.avg("value").alias("v"))


@add("paired_contrasts", f"with {FOLDS_SQL} select event_type, n, round(m,6) as mean_diff, round(m/sqrt(v),6) as d_paired, round(m/sqrt((1.0/n+0.25)*v),6) as t_corrected, round(m/sqrt(v/n),6) as t_plain, n-1 as df, case when abs(m/sqrt(v)) < 0.2 then 'negligible' when abs(m/sqrt(v)) < 0.5 then 'small' when abs(m/sqrt(v)) < 0.8 then 'medium' else 'large' end as band from s")
def paired_contrasts(spark, d):
    return rounded(S.paired_contrasts(folds(spark, d), ["user_id"], "event_type", "v", "purchase", 0.25).drop("p_corrected", "p_plain", "p_wilcoxon", "ci_low", "ci_high"))


@add("holm_and_bh", "with p as (select p_brand, p_type, (p_partkey%97)/100.0::double as p, p_partkey from part), r as (select *, count(*) over (partition by p_brand) as m, row_number() over (partition by p_brand order by p, p_partkey) as i from p) select p_partkey, round(least(1, max((m-i+1)*p) over (partition by p_brand order by p, p_partkey rows unbounded preceding)),6)::double as holm, round(least(1, min(m/i*p) over (partition by p_brand order by p, p_partkey rows between current row and unbounded following)),6)::double as bh from r")
def holm_and_bh(spark, d):
    rows = read(spark, d, "part").select("p_partkey", "p_brand", ((F.col("p_partkey") % 97) / 100.0).alias("p"))
    return rounded(S.adjust(rows, ["p_brand"], "p", "p_partkey").select("p_partkey", "holm", "bh"))


SETS_SQL = "m as (select user_id%5 as task, (user_id//5)%12 as fold, event_type, avg(value) as v from events group by 1, 2, 3), u as (select task, fold, coalesce(list(event_type) filter (v > 50), []) as names from m group by 1, 2)"


def subsets(spark, d):
    """The event types that each fold of users chose, of a task: those with a mean above 50. All rows take part."""
    means = read(spark, d, "events").groupBy((F.col("user_id") % 5).alias("task"), (F.floor(F.col("user_id") / 5) % 12).alias("fold"), "event_type").agg(F.avg("value").alias("v"))
    return means.groupBy("task", "fold").agg(F.collect_list(F.when(F.col("v") > 50, F.col("event_type"))).alias("names"))


STABILITY_SQL = f"""with {SETS_SQL}, p as (select a.task, len(list_intersect(a.names, b.names))::double as i, len(a.names)::double as k, len(b.names)::double as l from u a join u b on a.task = b.task and a.fold < b.fold),
q as (select task, i/nullif(k+l-i,0) as j, case when k = l and k > 0 and k < 5 then (i*5-k*k)/(k*(5-k)) end as c from p),
s as (select task, count(*) as n_pairs, round(avg(j),6) as jaccard_mean, round(stddev_samp(j),6) as jaccard_sd, count(j) as jaccard_n_pairs, round(avg(c),6) as kuncheva_mean, round(stddev_samp(c),6) as kuncheva_sd, count(c) as kuncheva_n_pairs from q group by 1),
z as (select task, count(*) as n_subsets, round(avg(len(names)),6) as size_mean, round(coalesce(stddev_samp(len(names)),0),6) as size_sd, min(len(names)) as size_min, max(len(names)) as size_max from u group by 1)"""


@add("pairwise_stability", STABILITY_SQL + " select * from z left join s using (task)")
def pairwise_stability(spark, d):
    return rounded(S.pairwise_stability(subsets(spark, d), ["task"], "fold", "names", 5))


TYPES_SQL = "(select distinct event_type as feature from events union select 'never')"


def types(spark, d):
    return read(spark, d, "events").select(F.col("event_type").alias("feature")).union(spark.createDataFrame([("never",)], "feature string"))


@add("stability_table", STABILITY_SQL.replace("k < 5 then (i*5-k*k)/(k*(5-k))", "k < 6 then (i*6-k*k)/(k*(6-k))") + f", f as (select z.task, feature, (select count(*) from u where u.task = z.task and list_contains(names, feature))::double/n_subsets as p from z, {TYPES_SQL}), a as (select task, count(*) as n_consensus, string_agg(feature, ', ' order by p desc, feature) as consensus_features from f where p >= 0.5 group by 1) select z.*, s.* exclude (task), coalesce(n_consensus,0) as n_consensus, coalesce(consensus_features,'') as consensus_features from z left join s using (task) left join a using (task)")
def stability_table(spark, d):
    return rounded(S.stability_table(subsets(spark, d), ["task"], "fold", "names", types(spark, d), threshold=0.5))


@add("selection_frequency", f"with {SETS_SQL}, n as (select count(*)::double as n from u), c as (select feature, (select count(*) from u where list_contains(names, feature))::double as c from {TYPES_SQL}), z as (select feature, c, c/n as p, n, 1.959963984540054 as z from c, n) select feature, c as count, round(p,6) as p, round((p+z*z/(2*n)-z*sqrt(p*(1-p)/n+z*z/(4*n*n)))/(1+z*z/n),6)+0.0 as low, round((p+z*z/(2*n)+z*sqrt(p*(1-p)/n+z*z/(4*n*n)))/(1+z*z/n),6) as high, p >= 0.8 as consensus from z")
def selection_frequency(spark, d):
    return rounded(S.selection_frequency(subsets(spark, d), "names", types(spark, d)))


@add("islands", "with m as (select p_partkey as i from part where p_size > 15), g as (select i, i - row_number() over (order by i) as g from m) select min(i) as start, count(*) as length from g group by g")
def islands(spark, d):
    return rounded(S.islands(read(spark, d, "part"), "p_partkey", F.col("p_size") > 15))


@add("country_filter", "select n_name, count(*) as n, round(sum(o_totalprice),2) as total from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name in ('ASIA','EUROPE') group by 1")
def country_filter(spark, d):
    dims = read(spark, d, "nation").join(read(spark, d, "region").where(F.col("r_name").isin("ASIA", "EUROPE")), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(dims, F.col("c_nationkey") == F.col("n_nationkey"))
    return rounded(rows.groupBy("n_name").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total")), 2)


@add("group_disjoint", "select count(*) as shared from (select distinct l_suppkey from lineitem where l_returnflag = 'R' intersect select distinct l_suppkey from lineitem where l_returnflag = 'A')")
def group_disjoint(spark, d):
    rows = read(spark, d, "lineitem")
    return rounded(G.shared_clusters(rows.where("l_returnflag = 'R'"), rows.where("l_returnflag = 'A'"), "l_suppkey").agg(F.count("*").alias("shared")))


@add("manifest_compare", "select count(*) filter (a.s = b.s) as common, count(*) filter (a.s <> b.s) as differing, count(*) filter (b.k is null) as only_a, count(*) filter (a.k is null) as only_b from (select p_partkey as k, p_size as s from part where p_partkey%3 <> 0) a full join (select p_partkey as k, p_size + (p_partkey%5=0)::int as s from part where p_partkey%4 <> 0) b on a.k = b.k")
def manifest_compare(spark, d):
    part = read(spark, d, "part").select(F.col("p_partkey").alias("path"), F.col("p_size").alias("sha256"))
    other = part.withColumn("sha256", F.col("sha256") + (F.col("path") % 5 == 0).cast("int"))
    return rounded(M.summary(M.compare(part.where("path % 3 <> 0"), other.where("path % 4 <> 0"))))


@add("jackknife_auc", f"""with o as (select o_custkey%25 as g, o_totalprice as s, {URGENT} as y from orders), c as (select g, s, sum(y)::double as p, sum(1-y)::double as n from o group by 1, 2), k as (select distinct g from o),
x as (select k.g, c.s, sum(p) as p, sum(n) as n from k join c on c.g <> k.g group by 1, 2), w as (select *, sum(n) over (partition by g order by s rows unbounded preceding) as b from x) select g, round(sum(p*(b-n/2))/(sum(p)*sum(n)),6) as auc from w group by 1""")
def jackknife_auc(spark, d):
    return rounded(G.jackknife_auc(orders(spark, d).withColumn("g", F.col("o_custkey") % 25), "g", "y", "o_totalprice"))


@add("spearman", "with r as (select l_returnflag, rank() over (partition by l_returnflag order by l_quantity) + (count(*) over (partition by l_returnflag, l_quantity)-1)/2.0 as x, rank() over (partition by l_returnflag order by l_discount) + (count(*) over (partition by l_returnflag, l_discount)-1)/2.0 as y from lineitem) select l_returnflag, round(corr(x,y),6) as rho from r group by 1")
def spearman(spark, d):
    return rounded(G.spearman(read(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_discount"))


@add("impute_and_scale", "with x as (select case when l_partkey%11 = 0 then null else l_discount end as v, l_returnflag from lineitem), f as (select l_returnflag, coalesce(v, (select median(v) from x)) as v, case when v is null then 1.0 else 0.0 end as i from x), z as (select l_returnflag, (v-(select avg(v) from f))/(select stddev_pop(v) from f) as v, (i-(select avg(i) from f))/(select stddev_pop(i) from f) as i from f) select l_returnflag, round(avg(v),6) as v, round(avg(i),6) as missing from z group by 1")
def impute_and_scale(spark, d):
    rows = read(spark, d, "lineitem").select("l_returnflag", F.when(F.col("l_partkey") % 11 != 0, F.col("l_discount")).alias("v"))
    return rounded(G.impute_and_scale(rows, ["v"]).groupBy("l_returnflag").agg(F.avg("v").alias("v"), F.avg("missingindicator_v").alias("missing")))


MIX_SQL = "(('0x'||substr(md5({seed}||'|'||{key}),1,15))::bigint)"


@add("permuted_labels", f"with o as (select o_orderkey, o_orderstatus, {URGENT} as y from orders), a as (select *, row_number() over (partition by o_orderstatus order by {MIX_SQL.format(seed=0, key='o_orderkey')}) as i, row_number() over (partition by o_orderstatus order by {MIX_SQL.format(seed=4, key='o_orderkey')}) as j from o) select a.o_orderkey, a.o_orderstatus, b.y from a join a b on a.o_orderstatus = b.o_orderstatus and a.i = b.j")
def permuted_labels(spark, d):
    return rounded(G.permute_within(orders(spark, d).select("o_orderkey", "o_orderstatus", "y"), ["o_orderstatus"], "y", "o_orderkey", 3))


NAMES_SQL = "(select distinct ['PV'||p_size||'MATH', 'log_ math_score', 'ST0'||p_size||'Q01TA', 'CNTSCHID', 'W_FSTURWT'||p_size, 'stratum_'||p_size||'.0', 'noise_control', 'escs_Z', 'z_'||p_size, 'pv'||p_size||'read_imputed'][p_partkey%10+1] as name from part)"


def names(spark, d):
    size = F.col("p_size").cast("string")
    kinds = F.array(F.concat(F.lit("PV"), size, F.lit("MATH")), F.lit("log_ math_score"), F.concat(F.lit("ST0"), size, F.lit("Q01TA")), F.lit("CNTSCHID"), F.concat(F.lit("W_FSTURWT"), size), F.concat(F.lit("stratum_"), size, F.lit(".0")), F.lit("noise_control"), F.lit("escs_Z"), F.concat(F.lit("z_"), size), F.concat(F.lit("pv"), size, F.lit("read_imputed")))
    return read(spark, d, "part").select(kinds[(F.col("p_partkey") % 10).cast("int")].alias("name")).distinct()


WHOLE_SQL = "upper(regexp_replace(name, '\\s+', '', 'g'))"
FORMS_SQL = "list_filter(list_distinct([" + ", ".join([WHOLE_SQL, *[f"case when starts_with({WHOLE_SQL}, '{p}') then substr({WHOLE_SQL}, {len(p) + 1}) end" for p in G.PREFIXES], *[f"case when ends_with({WHOLE_SQL}, '{p}') then left({WHOLE_SQL}, -{len(p)}) end" for p in G.SUFFIXES], f"regexp_replace({WHOLE_SQL}, '_[^_]*$', '')"]) + "]), lambda f: f is not null and f <> '')"


@add("name_forms", f"select name, unnest({FORMS_SQL}) as form from {NAMES_SQL}")
def name_forms(spark, d):
    return names(spark, d).select("name", F.explode(G.name_forms(F.col("name"))).alias("form"))


FIRST_SQL = ", ".join(f"case when len(list_filter(forms, lambda f: regexp_full_match(f, '{p}', 'i'))) > 0 then '{p}' end" for p in G.FORBIDDEN)


@add("forbidden_names", f"select name, coalesce({FIRST_SQL}) as pattern from (select name, {FORMS_SQL} as forms from {NAMES_SQL}) where pattern is not null")
def forbidden_names(spark, d):
    return G.forbidden_names(names(spark, d), "name")


@add("column_classes", "select name, case " + " ".join(f"when regexp_full_match(name, '{p}') then '{c}'" for p, c, _ in G.CLASSES) + " else 'candidate predictor' end as classification from " + NAMES_SQL)
def column_classes(spark, d):
    return G.classify_columns(names(spark, d), "name").drop("justification")


@add("fold_summary", "select event_type, round(avg(v),6) as mean, round(stddev_samp(v),6) as sd, count(*) as n from (select event_type, user_id, avg(value) as v from events group by 1, 2) group by 1")
def fold_summary(spark, d):
    return rounded(folds(spark, d).groupBy("event_type").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.count("*").alias("n")))


@add("missing_counts", "select n_missing, count(*) as n from (select (l_partkey%11=0)::int + (l_suppkey%7=0)::int + (l_orderkey%5=0)::int as n_missing from lineitem) group by 1")
def missing_counts(spark, d):
    rows = read(spark, d, "lineitem").select(F.when(F.col("l_partkey") % 11 != 0, F.col("l_partkey")).alias("a"), F.when(F.col("l_suppkey") % 7 != 0, F.col("l_tax")).otherwise(float("nan")).alias("b"), F.when(F.col("l_orderkey") % 5 != 0, F.col("l_orderkey")).alias("c"))
    return rounded(rows.select(V.missing_count(rows.columns, dict(rows.dtypes)).alias("n_missing")).groupBy("n_missing").agg(F.count("*").alias("n")))


MEAN_SQL = "((" + "+".join(PV_SQL.format(i=i) for i in PVS) + ")/10)"


@add("legacy_reclassified", f"select count(*) as n, count(*) filter ((case when {MEAN_SQL} <= 35000 then 'Low' when {MEAN_SQL} <= 70000 then 'Medium' else 'High' end) <> (" + CASE.format(x=PV_SQL.format(i=1)) + ")) as changed from lineitem")
def legacy_reclassified(spark, d):
    rows = read(spark, d, "lineitem").select(*[pv(i).alias(f"PV{i}MATH") for i in PVS])
    rows = V.pv_categories(rows, "PV{i}MATH", 10, CUTS, LABELS)
    old = V.legacy_category([F.col(f"PV{i}MATH") for i in PVS], CUTS, LABELS)
    return rounded(rows.agg(F.count("*").alias("n"), F.count_if(old != F.col("cat_pv1")).alias("changed")))


@add("bootstrap_auc", f"""with o as (select o_custkey%25 as g, o_totalprice as s, {URGENT} as y from orders), m as (select r.r as rep, k.g, (k.g*7+r.r*13)%3 as m from (select distinct g from o) k, (select unnest(range(0,5)) as r) r),
c as (select rep, s, sum(y*m)::double as p, sum((1-y)*m)::double as n from o join m on o.g = m.g group by 1, 2), w as (select *, sum(n) over (partition by rep order by s rows unbounded preceding) - n/2 as b from c) select rep, round(sum(p*b)/(sum(p)*sum(n)),6) as auc from w group by 1""")
def bootstrap_auc(spark, d):
    rows = orders(spark, d).withColumn("g", F.col("o_custkey") % 25)
    m = rows.select("g").distinct().withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("m", (F.col("g") * 7 + F.col("rep") * 13) % 3)
    return rounded(R.bootstrap_auc(rows, "g", "y", "o_totalprice", m))


@add("null_summary", "select round(avg(value),6) as mean, round(stddev_samp(value),6) as sd, round(quantile_cont(value,0.025),6) as q025, round(quantile_cont(value,0.975),6) as q975, max(value) as max, round((count(*) filter (value >= 50)+1)/(count(*)+1.0),6)::double as p from events")
def null_summary(spark, d):
    return rounded(R.null_summary(read(spark, d, "events"), "value", 50.0))
