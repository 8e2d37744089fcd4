"""Queries of inference, selection, search, models and explanations by name; they join those of the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from veyra.ml import explain, models, selectors, swarm
from veyra.operators import guard as G
from veyra.operators import neighbours, ordered
from veyra.operators import resample as R
from veyra.operators import selection as S
from veyra.operators import survey as V
from veyra.sources import codebook, tables
from veyra.streaming.windows import weighted_windows

from .catalogue import BIN_SQL, CHI_SQL, FEATURES, FOLDS_SQL, LONG_SQL, MIX_SQL, PV_SQL, PVS, URGENT, add, factors, folds, long, names, orders, pv, read, rounded

# ---- weights and replicates
O_REPLICATES = range(1, 81)


def order_replicates() -> list:
    return [(1.0 + F.col("o_orderkey") % 5) * F.when(((F.col("o_custkey") * r) % 83) % 2 == 0, 1.5).otherwise(0.5) for r in O_REPLICATES]


@add("brr_auc", f"""with x as (select o_totalprice as s, {URGENT} as y, 1.0+o_orderkey%5 as w, o_custkey from orders), r as (select unnest(range(0, 81)) as r),
c as (select r, s, sum(y*w*f) as p, sum((1-y)*w*f) as n from (select *, case when r = 0 then 1.0 when ((o_custkey*r)%83)%2 = 0 then 1.5 else 0.5 end as f from x, r) group by 1, 2),
u as (select *, sum(n) over (partition by r order by s rows unbounded preceding) as b from c), t as (select r, (sum(p*(b-n/2))/(sum(p)*sum(n)))::double as t from u group by 1), e as (select t as e from t where r = 0)
select round(e,6) as estimate, round(sqrt(sum((t-e)*(t-e))/(count(*)*0.25)),6) as brr_se, count(*) as n_replicates_used from t, e where r > 0 group by e""")
def brr_auc(spark, d):
    got = V.brr_auc(orders(spark, d), [], "y", "o_totalprice", 1.0 + F.col("o_orderkey") % 5, order_replicates())
    return rounded(got.select("estimate", "brr_se", "n_replicates_used"))


WD_SQL = "(m1-m0)/sqrt(((n1-1)*(q1/n1-m1*m1)+(n0-1)*(q0/n0-m0*m0))/greatest(n1+n0-2,1e-9))"


@add("brr_group_differences", f"""with x as (select feature, value, y, l_quantity as w, l_suppkey from (select *, case when l_returnflag = 'R' then 1 else 0 end as y from (unpivot (select l_discount::double as l_discount, l_tax::double as l_tax, l_linenumber::double as l_linenumber, l_quantity, l_suppkey, l_returnflag from lineitem) on l_discount, l_tax, l_linenumber into name feature value value))),
r as (select unnest(range(0, 81)) as r), a as (select feature, r, sum(y*w*f) as n1, sum((1-y)*w*f) as n0, sum(y*w*f*value) as s1, sum((1-y)*w*f*value) as s0, sum(y*w*f*value*value) as q1, sum((1-y)*w*f*value*value) as q0 from (select *, case when r = 0 then 1.0 when ((l_suppkey*r)%83)%2 = 0 then 1.5 else 0.5 end as f from x, r) group by 1, 2),
m as (select *, s1/n1 as m1, s0/n0 as m0 from a), t as (select feature, r, {WD_SQL} as t from m), e as (select feature, t as e from t where r = 0)
select feature, round(e,6) as d, round(sqrt(sum((t-e)*(t-e))/(count(*)*0.25)),6) as brr_se, case when abs(e) < 0.2 then 'negligible' when abs(e) < 0.5 then 'small' when abs(e) < 0.8 then 'medium' else 'large' end as band from t join e using (feature) where r > 0 group by feature, e""")
def brr_group_differences(spark, d):
    rows = read(spark, d, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    wide = S.unpivot(rows, ["y", "l_quantity", "l_suppkey"], ["l_discount", "l_tax", "l_linenumber"])
    return rounded(S.group_differences(wide, "y", F.col("l_quantity"), factors(), "l_suppkey").select("feature", "d", "brr_se", "band"))


@add("rubin_intervals")
def rubin_intervals(spark, d):
    wide = read(spark, d, "lineitem").groupBy("l_returnflag").agg(*[x for i in PVS for x in (F.avg(pv(i)).alias(f"e{i}"), (F.var_samp(pv(i)) / F.count("*")).alias(f"v{i}"))])
    each = wide.select("l_returnflag", F.explode(F.array(*[F.struct(F.col(f"e{i}").alias("e"), F.col(f"v{i}").alias("v")) for i in PVS])).alias("x")).select("l_returnflag", "x.*")
    return rounded(V.rubin_intervals(each, ["l_returnflag"], "e", "v"), 4)


PERCENTS = ",".join(str(i / 100) for i in range(1, 100))


@add("percentile_threshold", f"with o as (select {URGENT} as y, o_totalprice as s from orders), g as (select distinct unnest(quantile_cont(s, [{PERCENTS}])) as t from o), c as (select t, sum(case when y=1 and s>=t then 1.0 else 0 end) as tp, sum(case when y=1 and s<t then 1.0 else 0 end) as fn, sum(case when y=0 and s>=t then 1.0 else 0 end) as fp from o, g group by 1) select round(t,4) as threshold, round(2*tp/(2*tp+fp+fn),4) as value from c order by round(2*tp/(2*tp+fp+fn),12) desc, t limit 1")
def percentile_threshold(spark, d):
    return rounded(V.select_threshold(orders(spark, d), "y", F.col("o_totalprice"), metric="f1"), 4)


# ---- information
GAPS_SQL = "select feature, case when k%7 = 0 then null else value end as value, case when k%5 = 0 then null else y end as y from (select *, l_orderkey as k from (" + " union all ".join(f"select '{f}' as feature, {f}::double as value, case when l_returnflag = 'R' then 1 else 0 end as y, l_orderkey from lineitem" for f in FEATURES) + "))"


def gaps(spark, d):
    rows = read(spark, d, "lineitem").withColumn("y", F.when(F.col("l_orderkey") % 5 != 0, (F.col("l_returnflag") == "R").cast("int")))
    return S.unpivot(rows.select("y", "l_orderkey", *FEATURES), ["y", "l_orderkey"], FEATURES).withColumn("value", F.when(F.col("l_orderkey") % 7 != 0, F.col("value"))).drop("l_orderkey")


BIN_OF = "len(list_filter(marks, lambda c: c <= value)) - dense"
GAP_BINS_SQL = BIN_SQL.replace(LONG_SQL, GAPS_SQL).replace(BIN_OF, f"case when value is not null then {BIN_OF} end")


@add("conditional_entropy", GAP_BINS_SQL + ", n as (select feature, bin, y, count(*)::double as c from b where bin is not null and y is not null group by 1, 2, 3), t as (select *, sum(c) over (partition by feature) as t, sum(c) over (partition by feature, y) as s from n) select feature, round(sum(-c/t*ln(c/s)),6) as conditional_entropy from t group by 1")
def conditional_entropy(spark, d):
    return rounded(S.conditional_entropy(S.decile_bins(gaps(spark, d)), ["feature"], "bin", "y"))


@add("information_with_gaps", GAP_BINS_SQL + """, hx as (select feature, sum(-c/t*ln(c/t)) as hx from (select feature, c, sum(c) over (partition by feature) as t from (select feature, bin, count(*)::double as c from b where bin is not null group by 1, 2)) group by 1),
hy as (select feature, sum(-c/t*ln(c/t)) as hy from (select feature, c, sum(c) over (partition by feature) as t from (select feature, y, count(*)::double as c from b where y is not null group by 1, 2)) group by 1),
hc as (select feature, sum(-c/t*ln(c/s)) as hc from (select *, sum(c) over (partition by feature) as t, sum(c) over (partition by feature, y) as s from (select feature, bin, y, count(*)::double as c from b where bin is not null and y is not null group by 1, 2, 3)) group by 1)
select feature, round(greatest(hx-hc,0),6) as mi, round(least(1,greatest(0,2*greatest(hx-hc,0)/(hx+hy))),6) as su from hx join hy using (feature) join hc using (feature)""")
def information_with_gaps(spark, d):
    return rounded(S.symmetric_uncertainty(S.decile_bins(gaps(spark, d)), "y"))


CODES_SQL = "with l as materialized (select *, row_number() over () as rid from lineitem), " + BIN_SQL.removeprefix("with ").replace(LONG_SQL, " union all ".join(f"select '{f}' as feature, {f}::double as value, rid as y from l" for f in FEATURES))


@add("su_matrix", CODES_SQL + """, p as (select u.feature as a, v.feature as b, u.bin as i, v.bin as j, count(*)::double as c from b u join b v on u.y = v.y and u.feature < v.feature group by all),
t as (select *, sum(c) over (partition by a, b) as t, sum(c) over (partition by a, b, i) as si, sum(c) over (partition by a, b, j) as sj from p),
s as (select a, b, 2*sum(c/t*ln(c*t/(si*sj)))/(sum(-c/t*ln(si/t))+sum(-c/t*ln(sj/t))) as su from t group by 1, 2)
select a, b, round(least(1,greatest(0,su)),6) as su from s union all select b, a, round(least(1,greatest(0,su)),6) from s union all select feature, feature, 1.0 from (select distinct feature from x)""")
def su_matrix(spark, d):
    return rounded(S.su_matrix(read(spark, d, "lineitem"), FEATURES))


@add("su_filter", BIN_SQL + ", n as (select feature, bin, y, count(*)::double as c from b group by 1, 2, 3), t as (select *, sum(c) over (partition by feature) as t, sum(c) over (partition by feature, bin) as xx, sum(c) over (partition by feature, y) as yy from n), s as (select feature, 2*sum(c/t*ln(c*t/(xx*yy)))/(sum(-c/t*ln(xx/t))+sum(-c/t*ln(yy/t))) as su from t group by 1) select feature, round(su,6) as score from s order by su desc, feature limit 2")
def su_filter(spark, d):
    return chosen(spark, selectors.SymmetricUncertainty(2), d)


@add("mi_filter", BIN_SQL + ", n as (select feature, bin, y, count(*)::double as c from b group by 1, 2, 3), t as (select *, sum(c) over (partition by feature) as t, sum(c) over (partition by feature, bin) as xx, sum(c) over (partition by feature, y) as yy from n), s as (select feature, sum(c/t*ln(c*t/(xx*yy))) as mi from t group by 1) select feature, round(mi,6) as score from s order by mi desc, feature limit 2")
def mi_filter(spark, d):
    return chosen(spark, selectors.MutualInformation(2), d)


@add("chi2_filter", CHI_SQL + " select feature, round(chi2,6) as score from c order by chi2 desc, feature limit 2")
def chi2_filter(spark, d):
    return chosen(spark, selectors.ChiSquared(2), d)


@add("identity_selector", "select feature, 1.0::double as score from (values " + ",".join(f"('{f}')" for f in FEATURES) + ") v(feature)")
def identity_selector(spark, d):
    return chosen(spark, selectors.Identity(), d)


def chosen(spark, selector, d):
    rows = read(spark, d, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    got = selector.fit(rows, list(FEATURES), "y")
    return rounded(spark.createDataFrame([(f, float(got.scores_[f])) for f in got.selected_], "feature string, score double"))


P_FEATURES = ("p_size", "p_retailprice", "p_kind")
PARTS_SQL = "p as (select p_partkey as k, case when p_size > 25 then 1 else 0 end as y, p_size::double as p_size, p_retailprice::double as p_retailprice, (p_partkey%13)::double as p_kind from part)"


def parts(spark, d):
    return read(spark, d, "part").select("p_partkey", (F.col("p_size") > 25).cast("int").alias("y"), F.col("p_size").cast("double").alias("p_size"), F.col("p_retailprice").cast("double").alias("p_retailprice"), (F.col("p_partkey") % 13).cast("double").alias("p_kind"))


NEAR_SQL = "z as (select k, y, p_size/(select max(p_size)-min(p_size) from p) as a, p_retailprice/(select max(p_retailprice)-min(p_retailprice) from p) as b, p_kind/(select max(p_kind)-min(p_kind) from p) as c from p)"


@add("relieff", f"with {PARTS_SQL}, {NEAR_SQL}, q as (select * from z order by {MIX_SQL.format(seed=0, key='k')} limit 60), n as (select q.k as query, z.k, q.y as own, z.y as label, abs(q.a-z.a) as a, abs(q.b-z.b) as b, abs(q.c-z.c) as c, row_number() over (partition by q.k, z.y order by round(abs(q.a-z.a)+abs(q.b-z.b)+abs(q.c-z.c),9), z.k) as r from q join z on q.k <> z.k), m as (select query, own, label, avg(a) as a, avg(b) as b, avg(c) as c from n where r <= 10 group by all), w as (select y, count(*)/(select count(*) from z) as prior from z group by 1), v as (select m.*, case when own = label then -1.0 else l.prior/(1-o.prior+1e-12) end/(select count(*) from q) as w from m join w l on l.y = label join w o on o.y = own) select 'p_size' as feature, round(sum(w*a),6) as score from v union all select 'p_retailprice', round(sum(w*b),6) from v union all select 'p_kind', round(sum(w*c),6) from v")
def relieff(spark, d):
    return rounded(neighbours.relief_f(parts(spark, d), P_FEATURES, "y", "p_partkey", samples=60))


@add("nearest_rows", f"with {PARTS_SQL}, n as (select q.k as query, z.k as p_partkey, z.y as label, round(sqrt(power(q.p_size-z.p_size,2)+power(q.p_kind-z.p_kind,2)),6) as distance, row_number() over (partition by q.k, z.y order by round(sqrt(power(q.p_size-z.p_size,2)+power(q.p_kind-z.p_kind,2)),9), z.k) as rank from p q join p z on q.k <> z.k where q.k <= 50) select * from n where rank <= 5")
def nearest_rows(spark, d):
    rows = parts(spark, d)
    got = neighbours.nearest(rows, rows.where("p_partkey <= 50"), ["p_size", "p_kind"], "p_partkey", 5, label="y")
    return rounded(got.withColumnRenamed("key", "p_partkey"))


# ---- resampling and nulls
@add("stratified_sample", f"with o as (select o_orderkey, o_orderstatus, row_number() over (partition by o_orderstatus order by {MIX_SQL.format(seed=5, key='o_orderkey')})-1 as i from orders), t as (select o_orderstatus, greatest(1, round(200*count(*)/(select count(*)::double from orders))) as take from orders group by 1) select o_orderkey, o.o_orderstatus from o join t on o.o_orderstatus = t.o_orderstatus where i < take order by (i+0.5)/take, o.o_orderstatus limit 200")
def stratified_sample(spark, d):
    return rounded(R.stratified_sample(read(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey", 200, 5))


SLICES_SQL = "e as (select quantile_cont(o_totalprice, [" + ",".join(str(i / 12) for i in range(13)) + "]) as c from orders), s as (select unnest(range(0, 12)) as slice), l as (select slice, c[slice+1] as lo, c[slice+2] as hi from e, s)"


@add("quantile_picks", f"with {SLICES_SQL}, m as (select slice, o_orderkey, o_totalprice, row_number() over (partition by slice order by {MIX_SQL.format(seed=2, key="slice||'|'||o_orderkey")}, o_orderkey) as i from orders join l on o_totalprice between lo and hi) select distinct o_orderkey, round(o_totalprice,6) as o_totalprice from m where i = 1")
def quantile_picks(spark, d):
    return rounded(R.quantile_picks(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 12, 2))


@add("extreme_instances", "(select o_orderkey, round(o_totalprice,6) as o_totalprice from orders order by orders.o_totalprice, o_orderkey limit 1) union all (select o_orderkey, round(o_totalprice,6) from orders order by orders.o_totalprice desc, o_orderkey limit 1)")
def extreme_instances(spark, d):
    return rounded(R.local_instances(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "y", "o_orderkey", strategy="extremes")[0])


NULL_SQL = f"""with o as (select o_orderkey, o_totalprice as s, {URGENT} as y from orders), r as (select unnest(range(0, 5)) as r),
a as (select r, s, row_number() over (partition by r order by {MIX_SQL.format(seed=0, key='o_orderkey')}) as i from o, r), b as (select r, y, row_number() over (partition by r order by {MIX_SQL.format(seed='(r+1)', key='o_orderkey')}) as j from o, r),
c as (select a.r, s, sum(y)::double as p, sum(1-y)::double as n from a join b on a.r = b.r and i = j group by 1, 2), u as (select *, sum(n) over (partition by r order by s rows unbounded preceding) - n/2 as b from c), t as (select r, sum(p*b)/(sum(p)*sum(n)) as t from u group by 1)"""


@add("permutation_null", NULL_SQL + " select round(avg(t),6) as mean, round(stddev_samp(t),6) as sd, round(quantile_cont(t,0.025),6) as q025, round(quantile_cont(t,0.975),6) as q975, round(max(t),6) as max, round((count(*) filter (t >= 0.5)+1)/(count(*)+1.0),6)::double as p, 5::bigint as n_permutations, false as within_groups from t")
def permutation_null(spark, d):
    rows = orders(spark, d).select("o_orderkey", "o_totalprice", "y")
    null = R.permutation_null(lambda t, seed: V.auc(t, [], "y", "o_totalprice").first()[0], rows, "y", "o_orderkey", 0.5, n=5)
    return rounded(R.permutation_table(spark, [null]).drop("observed"))


@add("decomposed_performance", "with f as (select event_type, avg(value) as o, avg(value) filter (user_id%2=0) as w, avg(value) filter (user_id%3=0) as u from events group by 1) select event_type, round(o-u,6) as total_above_chance, round(w-u,6) as between_component, round(o-w,6) as within_component, round((w-u)/(o-u),6) as between_share, round((o-w)/(o-u),6) as within_share from f")
def decomposed_performance(spark, d):
    v, u = F.col("value"), F.col("user_id")
    rows = read(spark, d, "events").groupBy("event_type").agg(F.avg(v).alias("o"), F.avg(F.when(u % 2 == 0, v)).alias("w"), F.avg(F.when(u % 3 == 0, v)).alias("u"))
    return rounded(R.decompose(rows, "o", "w", "u").drop("o", "w", "u"))


@add("bootstrap_interval")
def bootstrap_interval(spark, d):
    got = R.cluster_interval(orders(spark, d).withColumn("g", F.col("o_custkey") % 25), "g", "y", "o_totalprice", replicates=200)
    return spark.createDataFrame([tuple(got.values())], "estimate double, ci_low double, ci_high double, boot_mean double, boot_sd double, n_usable long, n_clusters long, method string")


@add("greedy_folds")
def greedy_folds(spark, d):
    rows = orders(spark, d).withColumn("g", F.col("o_custkey") % 25)
    return models.repeated_splits(rows, "g", "y", 5, 2)


@add("fold_sizes", "with c as (select o_custkey%25 as g, count(*) as n from orders group by 1) select sum(n)::bigint as n, count(*) as clusters from c")
def fold_sizes(spark, d):
    """Rows and clusters over the folds: each cluster stands in one fold of a repeat."""
    rows = orders(spark, d).withColumn("g", F.col("o_custkey") % 25)
    table = models.fold_table(rows, "g", "y", 5, 1)
    per = rows.join(F.broadcast(table), "g").groupBy("fold").agg(F.count("*").alias("n"), F.countDistinct("g").alias("c"))
    return rounded(per.agg(F.sum("n").alias("n"), F.sum("c").alias("clusters")))


# ---- contrasts
@add("contrast_table")
def contrast_table(spark, d):
    rows = folds(spark, d).withColumn("task", F.col("user_id") % 3)
    return rounded(S.contrast_table(rows, ["user_id"], "event_type", "v", "purchase", 0.25, by=["task"]))


@add("contrast_counts", f"with {FOLDS_SQL} select user_id%3 as task, event_type, count(*) as n, round(avg(d),6) as mean_diff from (select a.user_id, a.event_type, a.v-b.v as d from f a join f b on a.user_id = b.user_id and b.event_type = 'purchase' and a.event_type <> 'purchase') group by 1, 2")
def contrast_counts(spark, d):
    rows = folds(spark, d).withColumn("task", F.col("user_id") % 3)
    return rounded(S.contrast_table(rows, ["user_id"], "event_type", "v", "purchase", 0.25, by=["task"], test="wilcoxon", correction="bh").select("task", "event_type", "n", "mean_diff"))


# ---- sources
@add("analytic_frame", "select c_mktsegment, sum((c_custkey%4=0)::int + (c_custkey%9=0)::int)::bigint as missing, count(*) as n from customer where c_mktsegment in ('BUILDING','MACHINERY') group by 1")
def analytic_frame(spark, d):
    source = read(spark, d, "customer").select("c_mktsegment", F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey")).alias("a"), F.when(F.col("c_custkey") % 9 != 0, F.lit(1.0)).otherwise(float("nan")).alias("b"))
    rows = tables.analytic_frame(source, "c_mktsegment", ["BUILDING", "MACHINERY"])
    return rounded(rows.groupBy("c_mktsegment").agg(F.sum("n_missing_allcols").alias("missing"), F.count("*").alias("n")))


BOOK = {"items": {"ST004Q01TA": {"block": "ST004", "question_stem": "Are you", "item_label": "Sex", "page_pdf": 3}, "ST005Q01TA": {"block": "ST005", "question_stem": "Mother", "item_label": "", "page_pdf": 4}}}
OVERRIDES = {"items": {"ST005Q01TA": {"label": "Schooling"}}, "blocks": {"ST005": {"scale_type": "ordinal", "response_categories": {1: "a", 2: "b"}}}, "non_questionnaire": {"PV1MATH..PV10MATH": {"role": "outcome"}, "CNTSCHID / CNTSTUID": {"role": "identifier"}}}


@add("codebook_roles", "select name, case when regexp_full_match(name, 'PV\\d+MATH') then 'outcome' when name in ('CNTSCHID', 'CNTSTUID') then 'identifier' end as role, case when regexp_full_match(name, 'ST004Q01TA') then 'Sex' when regexp_full_match(name, 'ST005Q01TA') then 'Schooling' else '' end as label, regexp_replace(name, '_([^A-Za-z].*|$)', '') as base from (select * from (select distinct ['PV'||p_size||'MATH', 'log_ math_score', 'ST0'||p_size||'Q01TA', 'CNTSCHID', 'W_FSTURWT'||p_size, 'stratum_'||p_size||'.0', 'noise_control', 'escs_Z', 'z_'||p_size, 'pv'||p_size||'read_imputed'][p_partkey%10+1] as name from part) union all select 'ST004Q01TA' union all select 'ST005Q01TA')")
def codebook_roles(spark, d):
    every = names(spark, d).union(spark.createDataFrame([("ST004Q01TA",), ("ST005Q01TA",)], "name string"))
    book = codebook.Codebook(spark, BOOK, OVERRIDES)
    return book.describe(every, "name").select("name", "role", "label", codebook.base_name(F.col("name")).alias("base"))


@add("questionnaire_items")
def questionnaire_items(spark, d):
    """Pages made of the parts: a block, an instruction, a scale and an item each."""
    code = F.concat(F.lit("ST"), F.lpad(F.col("p_size").cast("string"), 3, "0"), F.lit("Q0"), (F.col("p_partkey") % 9 + 1).cast("string"), F.lit("TA"))
    text = F.concat_ws("\n", F.lit("CY7_2018_QST"), F.concat(F.lit("How often "), F.col("p_brand")), F.regexp_extract(code, "^(ST[0-9]{3})", 1), F.lit("(Please select one response.)"), F.lit("Never Often"), F.concat(code, F.lit(" "), F.col("p_type")), F.lit("01 02"), F.lit("7"))
    return codebook.extract_items(read(spark, d, "part").select(F.col("p_partkey").alias("page"), text.alias("text")))


@add("weighted_windows", "select event_type, count(*) as windows, sum(n)::bigint as n, round(sum(m),4) as means from (select time_bucket(interval 1 day, ts) as b, event_type, count(*) as n, avg(value) as m from events group by 1, 2) group by 1")
def weighted_windows_query(spark, d):
    got = weighted_windows(read(spark, d, "events"), "ts", "value", None, ["event_type"], width="1 day")
    return rounded(got.groupBy("event_type").agg(F.count("*").alias("windows"), F.sum("n").alias("n"), F.sum("wmean").alias("means")), 4)


# ---- models, search and explanations
@add("stump", f"with c as (select o_totalprice as x, sum({URGENT}) as p, sum(1-{URGENT}) as q from orders group by 1), u as (select x, sum(p) over () as sp, sum(q) over () as sq, coalesce(sum(p) over a, 0) as bp, coalesce(sum(q) over a, 0) as bq from c window a as (order by x rows between unbounded preceding and 1 preceding)), r as (select x, bq+sp-bp as r, sp+sq as n from u) select round(x,6) as threshold, round(greatest(r,n-r)/n,6) as accuracy, (2*r >= n)::int as above from r order by round(greatest(r,n-r)/n,12) desc, x limit 1")
def stump(spark, d):
    return rounded(models.stump(orders(spark, d), "o_totalprice", "y"))


D_FEATURES = ("chars", "words", "commas", "digits")


def scored_documents(spark, d):
    """Labelled documents with a few counts of their texts; whole texts are read."""
    docs = read(spark, d, "documents").join(F.broadcast(read(spark, d, "labels").select("doc_id", "quality")), "doc_id")
    t = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", "source", F.col("quality").cast("int").alias("y"), F.length(t).cast("double").alias("chars"), F.size(F.split(t, r"\s+")).cast("double").alias("words"), F.regexp_count(t, F.lit(",")).cast("double").alias("commas"), F.regexp_count(t, F.lit("[0-9]")).cast("double").alias("digits"))


@add("nested_cv")
def nested_cv(spark, d):
    cfg = models.NestedCV(outer_splits=2, outer_repeats=1, inner_splits=2)
    pick = {"LogisticRegression_L2": models.Spec(models.get_models(["LogisticRegression_L2"])["LogisticRegression_L2"].make, {"C": [1]})}
    rows = models.run_nested(scored_documents(spark, d).cache(), D_FEATURES, "y", "source", pick, cfg, selector=lambda: selectors.SymmetricUncertainty(3), key="doc_id")
    keep = ("rep", "fold", "best_model", "inner_score", "threshold", "n_train", "n_test", "n_selected", "auc", "balanced_accuracy")
    return spark.createDataFrame([tuple(r[k] for k in keep) for r in rows], "rep int, fold int, best_model string, inner_score double, threshold double, n_train long, n_test long, n_selected long, auc double, balanced_accuracy double")


def vectors(spark, d, n: int = 12):
    rows = read(spark, d, "embeddings").where("vec_id is not null")
    return rows.select("vec_id", (F.col("label") < 5).cast("int").alias("y"), *[F.col("embedding")[i].cast("double").alias(f"e{i:02d}") for i in range(n)]), [f"e{i:02d}" for i in range(n)]


def _swarm(spark, d, search):
    rows, features = vectors(spark, d)
    got = search.fit(rows, features, "y", "vec_id")
    return spark.createDataFrame([(f, float(got.scores_[f]), f in got.selected_) for f in features], "feature string, score double, selected boolean")


@add("binary_swarm")
def binary_swarm(spark, d):
    return _swarm(spark, d, swarm.BinarySwarm(population_size=8, max_iter=4, fitness_subsample=400, max_cardinality=6))


@add("variable_length_swarm")
def variable_length_swarm(spark, d):
    return _swarm(spark, d, swarm.VariableLengthSwarm(population_size=8, max_iter=5, divisions=4, beta_stagnation=2, fitness_subsample=400))


COEFFICIENTS = {"l_quantity": 0.5, "l_discount": -2.0, "l_tax": 3.0}


def shap_values(spark, d):
    rows = read(spark, d, "lineitem").withColumn("weight", F.lit(1.0)).withColumn("key", F.col("l_orderkey"))
    return explain.linear_shap(rows, COEFFICIENTS, rows, "key")


SHAP_SQL = "s as (" + " union all ".join(f"select l_orderkey as instance, '{f}' as feature, {b}*({f}-(select avg({f}) from lineitem)) as v from lineitem" for f, b in COEFFICIENTS.items()) + ")"


@add("linear_shap", f"with {SHAP_SQL} select feature, round(avg(abs(v)),6) as mean_abs_shap, round(abs(avg(v)),6) as bias, count(*) as n from s group by 1")
def linear_shap(spark, d):
    return rounded(shap_values(spark, d).groupBy("feature").agg(F.avg("abs_shap").alias("mean_abs_shap"), F.abs(F.avg("shap_value")).alias("bias"), F.count("*").alias("n")))


@add("top_contributors", f"with {SHAP_SQL} select feature, round(v,6) as shap_value from s where instance = (select min(l_orderkey) from lineitem) order by abs(v) desc, feature limit 2")
def top_contributors(spark, d):
    values = shap_values(spark, d)
    first = read(spark, d, "lineitem").agg(F.min("l_orderkey")).first()[0]
    return rounded(explain.top_contributors(values, first, 2).select("feature", "shap_value"))


IMPORTANCE_SQL = "i as (select event_type as feature, avg(value) as m, row_number() over (order by avg(value) desc, event_type) as rank from events group by 1)"


def importances(spark, d):
    rows = read(spark, d, "events").groupBy(F.col("event_type").alias("feature")).agg(F.avg("value").alias("mean_abs_shap"))
    order = ordered.numbered(rows.withColumn("_d", -F.col("mean_abs_shap")), [], "_d", "rank", ["feature"])
    return order.withColumn("rank", F.col("rank") + 1).drop("_d")


@add("noise_benchmark", f"with {IMPORTANCE_SQL}, n as (select rank as r, m from i where feature = 'purchase') select true as available, r as noise_rank, (select count(*) from i) as n_features, round(m,6) as noise_mean_abs_shap, (select count(*) from i where rank > r) as n_features_below_noise, coalesce((select string_agg(feature, ', ' order by feature) from i where rank > r), '') as features_below_noise from n")
def noise_benchmark(spark, d):
    return rounded(explain.noise_benchmark(importances(spark, d), "purchase"))


@add("rank_agreement", f"with {IMPORTANCE_SQL}, l as (select event_type as feature, avg(abs(value-50)) as w from events group by 1), b as (select i.feature, rank() over (order by m) as x, rank() over (order by w) as y from i join l using (feature)), t as (select (select list(feature order by m desc, feature)[1:3] from i) as a, (select list(feature order by w desc, feature)[1:3] from l) as c) select round(corr(x,y),6) as spearman_rho, count(*) as n_features, 3::bigint as top_k, (select len(list_intersect(a,c))::bigint from t) as top_k_overlap, (select round(len(list_intersect(a,c))/len(list_distinct(a||c))::double,6) from t) as top_k_jaccard from b")
def rank_agreement(spark, d):
    other = read(spark, d, "events").select(F.col("event_type").alias("feature"), F.abs(F.col("value") - 50).alias("weight_mean"))
    return rounded(explain.rank_agreement(importances(spark, d), other, 3))


def linear_model(df):
    return df.withColumn("score", sum((F.lit(b) * F.col(f) for f, b in COEFFICIENTS.items()), F.lit(0.0)))


@add("permutation_importance")
def permutation_importance(spark, d):
    rows = read(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), *COEFFICIENTS, F.xxhash64(*read(spark, d, "lineitem").columns).alias("k"))
    return explain.permutation_importance(linear_model, rows, list(COEFFICIENTS), "y", "k", repeats=2)


@add("sampled_shap")
def sampled_shap(spark, d):
    rows, features = vectors(spark, d, 4)
    model = lambda t: t.withColumn("score", F.col("e00") * F.col("e01") + F.col("e02"))
    sample = R.stratified_sample(rows, "y", "vec_id", 50)
    return rounded(explain.importance(explain.sampled_shap(sample, model, explain.background(rows, features, "vec_id", 20, "random"), features, "vec_id", permutations=8), n_bootstrap=200))


@add("local_surrogates")
def local_surrogates(spark, d):
    rows, features = vectors(spark, d, 4)
    model = lambda t: t.withColumn("score", F.col("e00") - 2 * F.col("e02"))
    picked = R.stratified_sample(rows, "y", "vec_id", 3)
    weights = explain.local_surrogates(picked, model, rows, features, "vec_id", n_repeats=3, n_samples=200)
    return rounded(explain.surrogate_stability(weights)[1])
