"""Queries of voting, pooling and combining."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumdf.functions import arrays as A
from quorumdf.operators import combine as C
from quorumdf.operators import votes as V
from quorumdf.plans.register import registrar
from quorumdf.sources import answers as S
from quorumdf.sources.tables import table

REGISTER: dict = {}
query = registrar(REGISTER)

KEYS = ["pool_id"]
_ARG = "list_position({0}, list_max({0})) - 1"


def _round(c: str):
    return F.transform(c, lambda x: F.round(x + 1e-10, 6)).alias(c)


def _ballots(spark: SparkSession, d: str) -> DataFrame:
    return S.stored(spark, d).filter("question = 'topic'").select("pool_id", "question", "teacher", F.get("options", A.argmax(F.col("p"))).alias("label"), F.struct(F.col("created_at").cast("double").alias("c"), F.coalesce(F.col("loaded_at").cast("double"), F.lit(0.0)).alias("l")).alias("at"))


def _numbered(spark: SparkSession, d: str) -> DataFrame:
    return _ballots(spark, d).select("pool_id", "question", "teacher", "label", (F.col("at.c") * 1000000).cast("long").alias("at"))


@query(f"""with {S.SQL},
b as (select pool_id, question, teacher, options[{_ARG.format("p")} + 1] as label, epoch_us(created_at) as seen from stored where question = 'topic'),
c as (select pool_id, teacher, label, count(*) as n, min(seen) as early from b group by 1, 2, 3),
r as (select *, sum(n) over (partition by pool_id, teacher) as total, row_number() over (partition by pool_id, teacher order by (label is null), n desc, early, label desc) as k from c)
select pool_id, teacher, case when label is null then '__invalid__' else label end as label, case when label is null then 0.0 else round(n / total, 2) end as confidence from r where k = 1""")
def q_majority_vote(spark: SparkSession, d: str) -> DataFrame:
    return V.majority(_numbered(spark, d), ["pool_id", "teacher"], "label", "at")


@query(f"""with {S.SQL},
b as (select v.pool_id, v.question, k.options[{_ARG.format("v.p")} + 1] as label, dense_rank() over (order by teacher) as seen from votes v join kinds k using (question)),
c as (select pool_id, question, label, count(*) as n, min(seen) as early from b group by 1, 2, 3),
r as (select *, sum(n) over (partition by pool_id, question) as total, row_number() over (partition by pool_id, question order by n desc, early) as k from c)
select pool_id, question, label, round(n / total, 2) as confidence from r where k = 1""")
def q_majority_teachers(spark: SparkSession, d: str) -> DataFrame:
    rows = S.votes(spark, d)
    names = sorted(r[0] for r in rows.select("teacher").distinct().collect())  # one entry per teacher
    at = F.array_position(F.array(*map(F.lit, names)), F.col("teacher"))
    said = rows.join(S.questions(spark, d).select("question", "options"), "question").select("pool_id", "question", F.get("options", A.argmax(F.col("p"))).alias("label"), at.alias("at"))
    return V.majority(said, ["pool_id", "question"], "label", "at")


@query(f"""with {S.SQL},
b as (select v.pool_id, v.question, k.options[{_ARG.format("v.p")} + 1] as label from votes v join kinds k using (question))
select pool_id, question, label, round(count(*) / sum(count(*)) over (partition by pool_id, question), 6) as share from b group by 1, 2, 3""")
def q_vote_shares(spark: SparkSession, d: str) -> DataFrame:
    said = S.votes(spark, d).join(S.questions(spark, d).select("question", "options"), "question").select("pool_id", "question", F.get("options", A.argmax(F.col("p"))).alias("label"))
    return V.shares(said, ["pool_id", "question"], "label").withColumn("share", F.round("share", 6))


_SUMS = """flat as (select pool_id, question, teacher, i, p[i] as x from votes, unnest(range(1, len(p) + 1)) as u(i)),
sums as (select pool_id, question, i, sum({w} * x) as x, count(*) as n from flat {join} group by 1, 2, 3)
select pool_id, question, list(round(x / s + 1e-10, 6) order by i) as p, cast(max(n) as integer) as n from (select *, sum(x) over (partition by pool_id, question) as s from sums) group by 1, 2"""


@query(f"with {S.SQL}, " + _SUMS.format(w="1", join=""))
def q_average_combine(spark: SparkSession, d: str) -> DataFrame:
    return V.average(S.votes(spark, d), ["pool_id", "question"], S.width(spark, d)).select("pool_id", "question", _round("p"), "n")


_WEIGHTS = {"heron-2": 3.0, "plover-xl": 2.0, "curlew-mini": 1.0}


@query(f"with {S.SQL}, w as (select * from (values ('heron-2', 0.5), ('plover-xl', 0.3333333333333333), ('curlew-mini', 0.16666666666666666)) as t(teacher, w)), " + _SUMS.format(w="w", join="join w using (teacher)"))
def q_ensemble_pool(spark: SparkSession, d: str) -> DataFrame:
    return V.ensemble(S.votes(spark, d), ["pool_id", "question"], _WEIGHTS, S.width(spark, d)).select("pool_id", "question", _round("p"), "n")


@query(f"""with {S.SQL}, s as (select pool_id, question, teacher, {_ARG.format("p")} as said from votes)
select a.teacher as teacher_a, b.teacher as teacher_b, count(*) filter (a.said = b.said) as same, count(*) as total, round(count(*) filter (a.said = b.said) / count(*), 4) as agreement
from s a join s b on a.pool_id = b.pool_id and a.question = b.question and a.teacher < b.teacher group by 1, 2""")
def q_pairwise_agreement(spark: SparkSession, d: str) -> DataFrame:
    return V.pairwise(S.votes(spark, d), KEYS)


@query(f"""with {S.SQL}, avgs as (select pool_id, question, list(x order by i) as p from (select pool_id, question, i, avg(p[i]) as x from votes, unnest(range(1, len(p) + 1)) as u(i) group by 1, 2, 3) group by 1, 2),
s as (select pool_id, question, count(distinct {_ARG.format("p")}) as kinds, count(*) as n from votes group by 1, 2),
r as (select pool_id, max(case when kinds > 1 then 3 when n < 9 then 2 when list_max(a.p) / list_sum(a.p) < 0.6 then 1 else 0 end) as r from s join avgs a using (pool_id, question) group by 1)
select ['agree', 'unsure', 'missing', 'split'][r + 1] as state, count(*) as n from r group by 1""")
def q_pool_status(spark: SparkSession, d: str) -> DataFrame:
    rows = S.votes(spark, d)
    return V.status(rows, V.average(rows, ["pool_id", "question"], S.width(spark, d)), KEYS, 9).groupBy("state").agg(F.count("*").alias("n"))


_THREE = ("curlew-mini", "heron-2", "plover-xl")


@query(f"""with {S.SQL}, three as (select * from votes where teacher in {_THREE}),
allof as (select pool_id, question from three group by 1, 2 having count(*) = 3),
flat as (select t.pool_id, t.question, teacher, i, p[i] as x from three t join allof using (pool_id, question), unnest(range(1, len(p) + 1)) as u(i)),
sums as (select pool_id, question, i, sum(x) as s from flat group by 1, 2, 3),
moved as (select teacher, pool_id, question, sum(abs(s / 3 - (s - x) / 2)) / 2 as m from flat join sums using (pool_id, question, i) group by 1, 2, 3),
m as (select teacher, avg(m) as m from moved group by 1)
select teacher, round(m / sum(m) over (), 6) as influence from m""")
def q_influence(spark: SparkSession, d: str) -> DataFrame:
    rows = S.votes(spark, d).filter(F.col("teacher").isin(*_THREE))
    return V.influence(rows, KEYS, 3, S.width(spark, d)).withColumn("influence", F.round("influence", 6))


@query(f"""with {S.SQL},
pooled as (select pool_id, question, list(x order by i) as p from (select pool_id, question, i, sum(p[i]) as x from votes, unnest(range(1, len(p) + 1)) as u(i) group by 1, 2, 3) group by 1, 2),
w as (select question, y, list_position(list_transform(p, lambda x: round(x / list_sum(p), 12)), list_max(list_transform(p, lambda x: round(x / list_sum(p), 12)))) - 1 as said, count(*) as n from pooled join gold using (pool_id, question) group by 1, 2, 3)
select question, options[y + 1] as gold, options[said + 1] as said, n, row_number() over (partition by question order by n desc, y, said) as rank
from w join kinds using (question) where said <> y qualify rank <= 5""")
def q_gold_disagreements(spark: SparkSession, d: str) -> DataFrame:
    rounded = V.average(S.votes(spark, d), ["pool_id", "question"], S.width(spark, d)).withColumn("p", F.transform("p", lambda x: F.round(x, 12)))
    out = V.gold_disagreements(rounded.select("pool_id", "question", "p"), S.gold(spark, d), KEYS, S.questions(spark, d), width=S.width(spark, d))
    return out.withColumn("rank", F.col("rank").cast("long"))


# -- fitted combination ----------------------------------------------------------------------------------------------
_THETA = f"""{S.SQL},
labelled as (select v.*, g.y, len(v.p) as k from votes v join gold g using (pool_id, question)),
prior as (select question, y, count(*) as n from (select distinct pool_id, question, y from labelled) group by 1, 2),
total as (select question, sum(n) as n, 5 as k from prior group by 1),
mass as (select teacher, question, y, i - 1 as s, sum(p[i]) as m from labelled, unnest(range(1, 6)) as u(i) group by 1, 2, 3, 4),
acc as (select teacher, question, (sum(m) filter (y = s) + 1) / (sum(m) + 2) as a from mass group by 1, 2),
shaped as (select teacher, question, g.y, h.s, coalesce(m, 0) + 4 * case when g.y = h.s then a else (1 - a) / 4 end as c
  from acc cross join (select unnest(range(0, 5)) as y) g cross join (select unnest(range(0, 5)) as s) h left join mass using (teacher, question, y, s)),
theta as (select teacher, question, y, s, 0.98 * c / sum(c) over (partition by teacher, question, y) + 0.02 / 5 as t from shaped),
"""

_POSTERIOR = """like_ as (select v.pool_id, v.question, v.y, sum(v.x * ln(t.t)) as l, count(distinct v.teacher) as n
  from (select pool_id, question, teacher, g.y, i - 1 as s, p[i] as x from votes, unnest(range(1, len(p) + 1)) as u(i), unnest(range(0, 5)) as g(y) where question = 'topic') v
  join theta t on t.teacher = v.teacher and t.question = v.question and t.y = v.y and t.s = v.s group by 1, 2, 3),
z as (select like_.pool_id, like_.question, like_.y, like_.n, ln((coalesce(prior.n, 0) + 1) / (total.n + 5)) + {t} * l as z from like_ join total using (question) left join prior using (question, y)),
post as (select *, exp(z - max(z) over (partition by pool_id, question)) as e from z)
"""


@query("with " + _THETA + _POSTERIOR.format(t="1.0") + "select pool_id, question, list(round(e / s + 1e-10, 6) order by y) as p, cast(max(n) as integer) as n from (select *, sum(e) over (partition by pool_id, question) as s from post) group by 1, 2")
def q_choice_combiner(spark: SparkSession, d: str) -> DataFrame:
    votes = S.votes(spark, d).filter("question = 'topic'")
    model = C.fit(votes, S.gold(spark, d), KEYS, "topic", 5)
    return C.posterior(votes, KEYS, "topic", model).select("pool_id", "question", _round("p"), "n")


@query("with " + _THETA.rstrip().rstrip(",") + " select teacher, cast(y as integer) as gold, cast(s as integer) as said, round(t, 6) as theta from theta")
def q_combiner_theta(spark: SparkSession, d: str) -> DataFrame:
    theta, _ = C.fit(S.votes(spark, d), S.gold(spark, d), KEYS, "topic", 5)
    rows = [(t, g, s, float(m[g, s])) for t, m in theta.items() for g in range(5) for s in range(5)]
    return spark.createDataFrame(rows, "teacher string, gold int, said int, theta double").withColumn("theta", F.round("theta", 6))


@query()
def q_combiner_temperature(spark: SparkSession, d: str) -> DataFrame:
    best, curve = C.pick_temperature(S.votes(spark, d), S.gold(spark, d), KEYS, "topic", 5)
    return spark.createDataFrame([(t, loss, t == best) for t, loss in curve], "temperature double, loss double, best boolean")


@query()
def q_combiner_patterns(spark: SparkSession, d: str) -> DataFrame:
    return C.combine_by_pattern(S.votes(spark, d), S.gold(spark, d), KEYS, "topic", 5)


@query()
def q_combiner_crossfit(spark: SparkSession, d: str) -> DataFrame:
    return C.cross_fit(S.votes(spark, d), S.gold(spark, d), KEYS, "topic", 5)


def _ordinal_gold(spark: SparkSession, d: str) -> DataFrame:
    """The best teacher's level as the truth of the severity question."""
    return S.votes(spark, d).filter("question = 'severity' and teacher = 'heron-2'").select("pool_id", "question", A.argmax(F.col("p")).alias("y"))


@query()
def q_score_combiner(spark: SparkSession, d: str) -> DataFrame:
    votes = S.votes(spark, d).filter("question = 'severity' and teacher <> 'heron-2'")
    return C.posterior(votes, KEYS, "severity", C.fit(votes, _ordinal_gold(spark, d), KEYS, "severity", 4, "score"))


@query()
def q_noul_stack(spark: SparkSession, d: str) -> DataFrame:
    votes = S.votes(spark, d).filter("question = 'upset'")
    truth = votes.filter("teacher = 'heron-2'").select("pool_id", A.argmax(F.col("p")).alias("y"))
    x = C.noul_features(votes, KEYS, "upset", ["curlew-mini", "plover-xl"])
    coefficients, intercept = C.fit_noul(x, truth, KEYS)
    return x.select("pool_id", C.apply_noul(x, coefficients, intercept).alias("p"))


@query(f"""with {S.SQL}, s as (select pool_id, min(list_max(p)) as score from votes where teacher = 'curlew-mini' group by 1),
sure as (select pool_id from s where score >= 0.8)
select 'settled' as part, pool_id, question, teacher from votes where teacher = 'curlew-mini' and pool_id in (from sure)
union all select 'asked', pool_id, question, teacher from votes where teacher <> 'curlew-mini' and pool_id not in (from sure)""")
def q_cascade(spark: SparkSession, d: str) -> DataFrame:
    rows = S.votes(spark, d)
    settled, asked = C.cascade(rows.filter("teacher = 'curlew-mini'"), rows.filter("teacher <> 'curlew-mini'"), KEYS, 0.8)
    cols = ["pool_id", "question", "teacher"]
    return settled.select(F.lit("settled").alias("part"), *cols).unionByName(asked.select(F.lit("asked").alias("part"), *cols))


@query("select s.source, s.channel, count(*) as n, count(*) filter (p.label is null) as unlabelled from pool_labeled p left join (select source, min(channel) as channel from sources group by 1) s using (source) group by 1, 2")
def q_source_report(spark: SparkSession, d: str) -> DataFrame:
    dim = table(spark, d, "sources", "source", "channel").groupBy("source").agg(F.min("channel").alias("channel"))
    pool = table(spark, d, "pool_labeled", "source", "label").withColumnRenamed("source", "s")
    rows = pool.join(dim, F.col("s") == F.col("source"), "left")
    return rows.groupBy("source", "channel").agg(F.count("*").alias("n"), F.count_if(F.col("label").isNull()).alias("unlabelled"))
