"""Queries of metrics and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumdf.functions import arrays as A
from quorumdf.operators import metrics as M
from quorumdf.operators import route as R
from quorumdf.plans.register import registrar
from quorumdf.sources import answers as S
from quorumdf.sources.tables import table

REGISTER: dict = {}
query = registrar(REGISTER)

_ARG = "list_position({0}, list_max({0})) - 1"
_SCORED = f"{S.SQL}, scored as (select v.pool_id, v.question, v.teacher, v.p, g.y from votes v join gold g using (pool_id, question))"
#: The same with the best teacher's choice as truth, for all questions.
_AGAINST = f"{S.SQL}, truth as (select pool_id, question, {_ARG.format('p')} as y from votes where teacher = 'heron-2'), scored as (select v.pool_id, v.question, v.teacher, v.p, t.y from votes v join truth t using (pool_id, question) where teacher in ('curlew-mini', 'plover-xl', 'teal-lite'))"
_GROUP = ["teacher", "question"]


def _topic(spark: SparkSession, d: str) -> DataFrame:
    return S.votes(spark, d).join(S.gold(spark, d), ["pool_id", "question"])


def _against(spark: SparkSession, d: str) -> DataFrame:
    rows = S.votes(spark, d)
    truth = rows.filter("teacher = 'heron-2'").select("pool_id", "question", A.argmax(F.col("p")).alias("y"))
    return rows.filter(F.col("teacher").isin("curlew-mini", "plover-xl", "teal-lite")).join(truth, ["pool_id", "question"])


def _r(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


_LABELS = "labels as (select unnest(options) as label from kinds where question = 'topic')"
_HARD = f"""{S.SQL}, {_LABELS},
hard as (select k.options[y + 1] as gold, k.options[{_ARG.format("p")} + 1] as said from votes v join gold using (pool_id, question) join kinds k using (question) where teacher = 'curlew-mini')"""


def _hard(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    asked = S.questions(spark, d).filter("question = 'topic'")
    rows = _topic(spark, d).filter("teacher = 'curlew-mini'").join(asked.select("question", "options"), "question")
    return rows.select(F.get("options", F.col("y")).alias("gold"), F.get("options", A.argmax(F.col("p"))).alias("said")), asked.select(F.explode("options").alias("label"))


@query(f"""with {_HARD}, grid as (select a.label as gold, b.label as said from labels a cross join (select label from labels union all select '__invalid__') b)
select gold, said, count(h.g) as n from grid left join (select gold as g, said as s from hard) h on h.g = gold and h.s = said group by 1, 2""")
def q_confusion(spark: SparkSession, d: str) -> DataFrame:
    return M.confusion(*_hard(spark, d))


@query(f"""with {_HARD}, c as (select label, (select count(*) from hard where gold = label and said = label) as tp, (select count(*) from hard where gold = label) as support, (select count(*) from hard where said = label) as claimed from labels)
select label, case when claimed > 0 then round(tp / claimed, 6) else 0 end as precision, case when support > 0 then round(tp / support, 6) else 0 end as recall, case when claimed + support > 0 then round(2 * tp / (claimed + support), 6) else 0 end as f1, support from c""")
def q_f1_per_class(spark: SparkSession, d: str) -> DataFrame:
    return _r(M.per_class(*_hard(spark, d)), "precision", "recall", "f1")


@query(f"""with {_HARD}, c as (select label, (select count(*) from hard where gold = label and said = label) as tp, (select count(*) from hard where gold = label) + (select count(*) from hard where said = label) as both_ from labels)
select round(avg(case when both_ > 0 then 2 * tp / both_ else 0 end), 6) as macro_f1 from c""")
def q_macro_f1(spark: SparkSession, d: str) -> DataFrame:
    return _r(M.macro_f1(*_hard(spark, d)), "macro_f1")


@query(f"with {_SCORED} select teacher, question, y, cast(i - 1 as integer) as option_idx, round(sum(p[i]), 6) as mass from scored, unnest(range(1, len(p) + 1)) as u(i) group by 1, 2, 3, 4")
def q_soft_confusion(spark: SparkSession, d: str) -> DataFrame:
    return _r(M.soft_confusion(S.votes(spark, d), S.gold(spark, d), ["pool_id"]), "mass")


@query(f"""with {_AGAINST}, s as (select *, p[y + 1] as py, {_ARG.format("p")} as said, len(p) as k from scored)
select teacher, question, count(*) as n, round(avg(case when said = y then 1.0::double else 0 end), 6) as accuracy,
  round(avg(case when k = 2 then p[2] else list_max(p) end), 6) as mean_confidence,
  round(-avg(ln(least(greatest(py, 1e-12), 1.0))), 6) as nll,
  round(avg(list_sum(list_transform(range(1, k + 1), lambda i: power(p[i] - case when i = y + 1 then 1 else 0 end, 2)))), 6) as brier,
  round(avg(1 - py / sqrt(list_sum(list_transform(p, lambda x: x * x)))), 6) as spherical,
  round(avg(list_sum(list_transform(range(1, k), lambda i: power(list_sum(p[1:i]) - case when i >= y + 1 then 1 else 0 end, 2))) / (k - 1)), 6) as rps
from s group by 1, 2""")
def q_scoring_rules(spark: SparkSession, d: str) -> DataFrame:
    return _r(M.scoring_rules(_against(spark, d), _GROUP), "accuracy", "mean_confidence", "nll", "brier", "spherical", "rps")


_STATED = f"stated as (select teacher, question, pool_id, case when len(p) = 2 then p[2] else list_max(p) end as conf, case when len(p) = 2 then (y = 1)::int::double else ({_ARG.format('p')} = y)::int::double end as hit from scored), binned as (select *, ntile(10) over (partition by teacher, question order by conf, pool_id) as bin from stated), bins as (select teacher, question, bin, min(conf) as low, max(conf) as high, count(*) as n, avg(conf) as stated, avg(hit) as actual from binned group by 1, 2, 3)"


@query(f"with {_AGAINST}, {_STATED} select teacher, question, cast(bin as integer) as bin, round(low, 6) as low, round(high, 6) as high, n, round(stated, 6) as stated, round(actual, 6) as actual from bins")
def q_reliability(spark: SparkSession, d: str) -> DataFrame:
    return _r(M.binned(_against(spark, d), _GROUP, "pool_id"), "low", "high", "stated", "actual")


@query(f"with {_AGAINST}, {_STATED} select teacher, question, round(sum(n * abs(stated - actual)) / sum(n), 6) as ece from bins group by 1, 2")
def q_ece(spark: SparkSession, d: str) -> DataFrame:
    return _r(M.ece(_against(spark, d), _GROUP, "pool_id"), "ece")


@query(f"""with {_SCORED}, flat as (select teacher, question, pool_id, i, p[i] as x, (y = i - 1)::int::double as o from scored, unnest(range(1, len(p) + 1)) as u(i)),
b as (select *, ntile(10) over (partition by teacher, question, i order by x, pool_id) as bin from flat),
c as (select teacher, question, i, bin, count(*) as n, avg(x) as f, avg(o) as a, sum(o) as s from b group by 1, 2, 3, 4),
e as (select *, sum(s) over w / sum(n) over w as base from c window w as (partition by teacher, question, i)),
per as (select teacher, question, i, sum(n * power(f - a, 2)) / sum(n) as rel, sum(n * power(a - base, 2)) / sum(n) as res, max(base * (1 - base)) as unc from e group by 1, 2, 3)
select teacher, question, round(sum(rel), 6) as reliability, round(sum(res), 6) as resolution, round(sum(unc), 6) as uncertainty, round(sum(res) / sum(unc), 6) as share from per group by 1, 2""")
def q_murphy(spark: SparkSession, d: str) -> DataFrame:
    return _r(M.murphy(_topic(spark, d), _GROUP, "pool_id"), "reliability", "resolution", "uncertainty", "share")


@query(f"""with {_AGAINST}, e as (select teacher, question, pool_id, list_max(p) as conf, ({_ARG.format("p")} <> y)::int::double as err from scored),
r as (select teacher, question, sum(err) over w / row_number() over w as x from e window w as (partition by teacher, question order by conf desc, pool_id rows unbounded preceding))
select teacher, question, round(avg(x), 6) as aurc from r group by 1, 2""")
def q_aurc(spark: SparkSession, d: str) -> DataFrame:
    return _r(M.aurc(_against(spark, d), _GROUP, "pool_id"), "aurc")


@query(f"""with {_AGAINST}, s as (select teacher, p[2] as x, y from scored where question = 'upset'),
r as (select *, rank() over (partition by teacher order by x) + (count(*) over (partition by teacher, x) - 1) / 2.0 as rk from s),
c as (select teacher, sum(rk) filter (y = 1) as ranks, count(*) filter (y = 1) as a, count(*) filter (y = 0) as b from r group by 1)
select teacher, round((ranks - a * (a + 1) / 2.0) / (a * b), 6) as auroc from c""")
def q_auroc(spark: SparkSession, d: str) -> DataFrame:
    rows = _against(spark, d).filter("question = 'upset'").select("teacher", F.get("p", F.lit(1)).alias("x"), "y")
    return _r(M.auroc(rows, ["teacher"], "x", "y"), "auroc")


@query(f"""with {_AGAINST}, s as (select teacher, question, list_max(p) as conf, ({_ARG.format("p")} = y)::int::double as hit from scored),
c as (select teacher, question, unnest([1.0, 0.9, 0.8, 0.7, 0.5]::double[]) as coverage, unnest(quantile_cont(conf, [1 - 1.0::double, 1 - 0.9::double, 1 - 0.8::double, 1 - 0.7::double, 1 - 0.5::double])) as cutoff from s group by 1, 2)
select teacher, question, coverage, round(min(conf), 6) as threshold, count(*) as kept, round(avg(hit), 6) as accuracy from s join c using (teacher, question) where conf >= cutoff - 1e-12 group by 1, 2, 3""")
def q_selective_curve(spark: SparkSession, d: str) -> DataFrame:
    rows = _against(spark, d).withColumn("p", F.transform("p", lambda x: x + 0.0))
    return _r(M.selective(rows, _GROUP), "threshold", "accuracy")


@query(f"""with {_AGAINST}, s as (select teacher, list_sum(list_transform(range(1, len(p) + 1), lambda i: p[i] * (i - 1))) as level, {_ARG.format("p")} as said, y from scored where question = 'severity')
select teacher, round(avg(abs(level - y)), 6) as mae, round(avg((said = y)::int::double), 6) as exact, round(avg((abs(said - y) <= 1)::int::double), 6) as within_one, round(avg(level), 6) as mean_score, round(avg(y::double), 6) as true_mean from s group by 1""")
def q_score_mae(spark: SparkSession, d: str) -> DataFrame:
    return _r(M.level_errors(_against(spark, d).filter("question = 'severity'"), ["teacher"]), "mae", "exact", "within_one", "mean_score", "true_mean")


@query("""with e as (select label, count(*)::double as e from seed_dev where label is not null group by 1), o as (select label, count(*)::double as o from pool_labeled where label is not null group by 1),
b as (select e, coalesce(o, 0) as o from e left join o using (label)), t as (select sum(e) as E_, sum(o) as O_ from b)
select round(sum(power(o - e * O_ / E_, 2) / (e * O_ / E_)), 4) as statistic, count(*) as cells from b, t""")
def q_chi_square_shift(spark: SparkSession, d: str) -> DataFrame:
    out = M.chi_square(table(spark, d, "pool_labeled", "label").filter("label is not null"), table(spark, d, "seed_dev", "label").filter("label is not null"))
    return out.withColumn("statistic", F.round("statistic", 4))


@query(f"""with {S.SQL}, w as (select pool_id, max(case when question = 'upset' then p[2] end) as upset, max(case when question = 'topic' then p[5] end) as feedback, max(case when question = 'severity' then p[4] end) as blocked from votes where teacher = 'plover-xl' group by 1)
select 'blocked implies upset' as rule, round(avg(greatest(blocked - upset, 0)), 6) as violation, round(avg((greatest(blocked - upset, 0) > 0.3)::int::double), 6) as share from w where blocked is not null and upset is not null and feedback is not null
union all select 'feedback is calm', round(avg(abs(feedback - (1 - upset))), 6), round(avg((abs(feedback - (1 - upset)) > 0.3)::int::double), 6) from w where blocked is not null and upset is not null and feedback is not null""")
def q_consistency_rules(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda q, i: F.max(F.when(F.col("question") == q, F.get("p", F.lit(i))))
    wide = S.votes(spark, d).filter("teacher = 'plover-xl'").groupBy("pool_id").agg(pick("upset", 1).alias("upset"), pick("topic", 4).alias("feedback"), pick("severity", 3).alias("blocked")).dropna()
    rules = {"blocked implies upset": ("implies", F.col("blocked"), F.col("upset")), "feedback is calm": ("same", F.col("feedback"), 1 - F.col("upset"))}
    return _r(M.consistency(wide, rules), "violation", "share")


@query(f"with {S.SQL} select pool_id, question, round(list_sort(p, 'desc')[1] - list_sort(p, 'desc')[2], 6) as margin, round(case when len(p) < 2 then 1 else 1 + list_sum(list_transform(p, lambda x: least(greatest(x, 1e-12), 1.0) * ln(least(greatest(x, 1e-12), 1.0)))) / ln(len(p)) end, 6) as confidence from votes where teacher = 'heron-2'")
def q_margin_confidence(spark: SparkSession, d: str) -> DataFrame:
    rows = S.votes(spark, d).filter("teacher = 'heron-2'")
    return rows.select("pool_id", "question", F.round(A.margin(F.col("p")), 6).alias("margin"), F.round(A.shape_confidence(F.col("p")), 6).alias("confidence"))


@query()
def q_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    rows, labels = _hard(spark, d)
    names = [r[0] for r in labels.collect()]
    return M.bootstrap_macro_f1(spark, M.confusion(rows, labels), names)


# -- routing ---------------------------------------------------------------------------------------------------------
def _checks(spark: SparkSession, d: str) -> DataFrame:
    rows = S.votes(spark, d)
    return R.document_checks(rows.filter("teacher = 'plover-xl'"), rows.filter("teacher = 'heron-2'"), ["pool_id"])


_CHECKS = f"""{S.SQL}, checks as (
  select a.pool_id, min(list_max(a.p)) as score, coalesce(max(({_ARG.format("a.p")} <> {_ARG.format("b.p")})::int), 0) as disagree
  from votes a left join votes b on b.teacher = 'heron-2' and a.pool_id = b.pool_id and a.question = b.question where a.teacher = 'plover-xl' group by 1)"""


@query(f"with {S.SQL} select pool_id, round(min(list_max(p)), 6) as score from votes where teacher = 'plover-xl' group by 1")
def q_doc_scores(spark: SparkSession, d: str) -> DataFrame:
    return _r(R.document_scores(S.votes(spark, d).filter("teacher = 'plover-xl'"), ["pool_id"]), "score")


def _route_sql(budget: str) -> str:
    """The largest count of disagreements that certifies the budget, by the binomial sum, then the filter on running counts."""
    return f"""with recursive {_CHECKS}, n as (select count(*) as n from checks),
terms as (select 0 as k, n * ln(1 - {budget}) as l from n union all select k + 1, l + ln((n - k) * {budget} / ((k + 1) * (1 - {budget}))) from terms, n where k < n),
cdf as (select k, sum(exp(l)) over (order by k) as c from terms), allowed as (select coalesce(max(k) filter (c <= 0.05), -1) as a from cdf),
run as (select distinct score, sum(disagree) over w as bad, count(*) over w as kept from checks window w as (order by score desc range unbounded preceding)),
best as (select min(score) as t, max(kept) as kept, max(bad) as bad from run, allowed where bad <= a)
select {budget}::double as budget, n, round(t, 6) as threshold, round(coalesce(kept, 0) / n, 6) as coverage, cast(coalesce(bad, 0) as bigint) as disagreements from best, n"""


@query(_route_sql("0.3"))
def q_route_threshold(spark: SparkSession, d: str) -> DataFrame:
    out = R.threshold(_checks(spark, d), 0.3, 0.05)
    return _r(out.select("budget", "n", "threshold", "coverage", "disagreements"), "threshold", "coverage")


@query(" union all ".join(f"(select * from ({_route_sql(b)}))" for b in ("0.1", "0.3", "0.5")))
def q_route_curve(spark: SparkSession, d: str) -> DataFrame:
    out = R.curve(_checks(spark, d), (0.1, 0.3, 0.5))
    return _r(out.select("budget", "n", "threshold", "coverage", "disagreements"), "threshold", "coverage")


@query(f"""with {_CHECKS}, r as (select score, sum(disagree) over w as bad, row_number() over w as k from checks window w as (order by score desc, pool_id rows unbounded preceding))
select 0.4::double as budget, round(min(score), 6) as threshold from r where bad / k <= 0.4""")
def q_route_naive(spark: SparkSession, d: str) -> DataFrame:
    return _r(R.naive_threshold(_checks(spark, d), "pool_id", 0.4), "threshold")


@query(f"with {_CHECKS} select count(*) as n, count(*) filter (score >= 0.6) as n_local, round(avg((score >= 0.6)::int::double), 6) as coverage, round(avg(case when score >= 0.6 then disagree::double end), 6) as local_error from checks")
def q_routing_check(spark: SparkSession, d: str) -> DataFrame:
    return _r(R.routing_check(_checks(spark, d), 0.6), "coverage", "local_error")
