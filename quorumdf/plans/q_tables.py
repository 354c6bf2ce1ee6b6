"""Queries of the row operators: duplicates, guards, shape, relabelling, splits, review."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumdf.functions import arrays as A
from quorumdf.functions import text as X
from quorumdf.operators import review as R
from quorumdf.operators import tables as O
from quorumdf.plans.register import registrar
from quorumdf.sources import answers as S
from quorumdf.sources.tables import table

REGISTER: dict = {}
query = registrar(REGISTER)
Frame = DataFrame

TOPICS = "(select unnest(options) as label from questions where question = 'topic')"


def _topics(spark: SparkSession, d: str) -> DataFrame:
    return S.questions(spark, d).filter("question = 'topic'").select(F.explode("options").alias("label"))


@query("select min(pool_id) as pool_id, text from pool_labeled group by text")
def q_pool_dedup(spark: SparkSession, d: str) -> Frame:
    return O.keep_first(table(spark, d, "pool_labeled", "pool_id", "text"), ["text"], "pool_id")


@query("select text, seed_id, label from seed_dev qualify row_number() over (partition by text order by seed_id desc) = 1")
def q_dedup_keep_last(spark: SparkSession, d: str) -> Frame:
    return O.keep_last(table(spark, d, "seed_dev", "text", "seed_id", "label").dropDuplicates(["seed_id"]), ["text"], "seed_id")


@query("select pool_id from pool_labeled p where not exists (select 1 from seed_test s where s.text = p.text) and not exists (select 1 from seed_dev s where s.text = p.text)")
def q_leak_anti_join(spark: SparkSession, d: str) -> Frame:
    return O.without(table(spark, d, "pool_labeled", "pool_id", "text"), table(spark, d, "seed_test", "text"), table(spark, d, "seed_dev", "text")).select("pool_id")


@query("select count(*) as n from pool_labeled where text in (select text from seed_test)")
def q_seed_overlap_count(spark: SparkSession, d: str) -> Frame:
    return O.overlap_count(table(spark, d, "pool_labeled", "pool_id", "text"), table(spark, d, "seed_test", "text"))


_BLANK = "count(*) filter ({0} is null or regexp_full_match({0}, '[\\s\\x{{00A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\x{{0085}}\\x{{000B}}\\x{{001C}}-\\x{{001F}}]*'))"


@query(" union all ".join(f"select '{c}' as \"column\", {_BLANK.format(c)} as blank, count(*) as rows from documents" for c in ("text", "lang", "source")))
def q_blank_rows(spark: SparkSession, d: str) -> Frame:
    return O.blank_rows(table(spark, d, "documents", "text", "lang", "source"), "text", "lang", "source")


@query(f"select label, count(*) as n from pool_labeled where label is not null and label not in (select label from {TOPICS}) group by 1")
def q_unknown_labels(spark: SparkSession, d: str) -> Frame:
    return O.unknown_labels(table(spark, d, "pool_labeled", "label"), _topics(spark, d))


@query(f"select t.label, count(s.label) as n, count(s.label) >= 8 as enough from {TOPICS} t left join seed_test s using (label) group by 1")
def q_label_class_guard(spark: SparkSession, d: str) -> Frame:
    return O.class_sizes(table(spark, d, "seed_test", "label"), _topics(spark, d))


@query("select label, count(*) as n, round(avg(confidence), 6) as confidence from pool_labeled where confidence >= 0.7 and label <> '__invalid__' group by 1")
def q_confidence_filter(spark: SparkSession, d: str) -> Frame:
    rows = table(spark, d, "pool_labeled", "label", "confidence").filter((F.col("confidence") >= 0.7) & (F.col("label") != X.INVALID))
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query(f"with {S.SQL} select v.pool_id, v.question, v.teacher, k.options[i] as option, i - 1 as option_idx, round(v.p[i], 6) as prob from votes v join kinds k using (question), unnest(range(1, len(v.p) + 1)) as u(i)")
def q_answers_long(spark: SparkSession, d: str) -> Frame:
    rows = O.to_options(S.votes(spark, d), S.questions(spark, d))
    return rows.select("pool_id", "question", "teacher", "option", F.col("option_idx").cast("long").alias("option_idx"), F.round("prob", 6).alias("prob"))


@query(f"with {S.SQL} select pool_id, teacher, round(p[1], 6) as upset__no, round(p[2], 6) as upset__yes from votes where question = 'upset'")
def q_answers_wide(spark: SparkSession, d: str) -> Frame:
    wide = O.to_wide(S.votes(spark, d), ["pool_id", "teacher"], "upset", ["no", "yes"])
    return wide.select("pool_id", "teacher", F.round("upset__no", 6).alias("upset__no"), F.round("upset__yes", 6).alias("upset__yes"))


@query(f"with {S.SQL} select pool_id, teacher, list_transform([p[1] + p[3], p[2], p[4], p[5]], lambda x: round(x, 6)) as p from votes where question = 'topic'")
def q_merge_options(spark: SparkSession, d: str) -> Frame:
    rows = S.votes(spark, d).filter("question = 'topic'")
    return rows.select("pool_id", "teacher", F.transform(O.merge_options(F.col("p"), 2, 0), lambda x: F.round(x, 6)).alias("p"))


@query(f"with {S.SQL} select pool_id, teacher, case when 1 - p[5] > 1e-12 then list_transform(p[1:4], lambda x: round(x / list_sum(p[1:4]), 6)) end as p from votes where question = 'topic'")
def q_drop_option(spark: SparkSession, d: str) -> Frame:
    rows = S.votes(spark, d).filter("question = 'topic'")
    return rows.select("pool_id", "teacher", F.when(1 - F.get("p", F.lit(4)) > 1e-12, F.transform(O.drop_option(F.col("p"), 4), lambda x: F.round(x, 6))).alias("p"))


@query("select case when label = 'access' then 'payment' else label end as label, count(*) as n from pool_labeled where label is distinct from 'feedback' group by 1")
def q_merge_labels(spark: SparkSession, d: str) -> Frame:
    return O.relabel(table(spark, d, "pool_labeled", "label"), {"access": "payment", "feedback": None}).groupBy("label").agg(F.count("*").alias("n"))


_UNIT = "('0x' || substr(sha256(concat({seed}, '|', {text})), 1, 12))::bigint / 281474976710656.0"


@query(f"select seed_id, case when {_UNIT.format(seed=42, text='text')} < 0.35 then 'test' else 'dev' end as split from seed_dev where text is not null")
def q_hash_split(spark: SparkSession, d: str) -> Frame:
    return O.hash_split(table(spark, d, "seed_dev", "seed_id", "text").filter("text is not null"), 0.35).select("seed_id", "split")


@query(
    """select seed_id, label, case when k <= floor(n * 0.35 + 0.5) then 'test' else 'dev' end as split from (
  select seed_id, label, row_number() over (partition by label order by sha256(concat('42|', seed_id)), seed_id) as k, count(*) over (partition by label) as n
  from (select distinct seed_id, label from seed_dev))"""
)
def q_stratified_split(spark: SparkSession, d: str) -> Frame:
    return O.stratified_split(table(spark, d, "seed_dev", "seed_id", "label").distinct(), "label", "seed_id", 0.35).select("seed_id", "label", "split")


@query(f"select pool_id, cast(floor({_UNIT.format(seed=42, text='pool_id')} * 5) as integer) as fold from pool_labeled")
def q_kfold(spark: SparkSession, d: str) -> Frame:
    return O.folds(table(spark, d, "pool_labeled", "pool_id"), "pool_id").select("pool_id", "fold")


@query("select count(*) as n, cast(sum(('0x' || substr(sha256(concat(coalesce(text, ''), chr(9), coalesce(label, ''))), 1, 12))::bigint) as varchar) as lock from seed_test")
def q_lock_hash(spark: SparkSession, d: str) -> Frame:
    return O.lock_hash(table(spark, d, "seed_test", "text", "label"))


@query("select pool_id from pool_labeled where text is not null and text <> '' and label = 'payment' union all select seed_id from seed_dev where label = 'payment' except all select seed_id from seed_dev where source is null")
def q_set_operations(spark: SparkSession, d: str) -> Frame:
    pool = table(spark, d, "pool_labeled").filter("text is not null and text <> '' and label = 'payment'").select("pool_id")
    dev = table(spark, d, "seed_dev")
    return pool.unionByName(dev.filter("label = 'payment'").select(F.col("seed_id").alias("pool_id"))).exceptAll(dev.filter("source is null").select(F.col("seed_id").alias("pool_id")))


# -- review ----------------------------------------------------------------------------------------------------------
#: A ledger made from the tables: the pool rows of every seventh hash, decided twice.
def _ledger(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pool_labeled", "pool_id", "label").filter(X.hash_unit(F.lit("ledger"), F.col("pool_id").cast("string")) < 0.15)
    first = rows.select("pool_id", F.lit(1).alias("seq"), F.lit("defect").alias("label"))
    second = rows.filter("pool_id % 2 = 0").select("pool_id", F.lit(2).alias("seq"), F.lit("access").alias("label"))
    return first.unionByName(second)


_LEDGER = f"""ledger as (
  select pool_id, 1 as seq, 'defect' as label from pool_labeled where {_UNIT.format(seed="'ledger'", text="pool_id")} < 0.15
  union all select pool_id, 2, 'access' from pool_labeled where {_UNIT.format(seed="'ledger'", text="pool_id")} < 0.15 and pool_id % 2 = 0
), last as (select pool_id, max(seq) as seq, arg_max(label, seq) as label from ledger group by 1)"""


@query(f"with {_LEDGER} select pool_id, seq, label from last")
def q_ledger_latest(spark: SparkSession, d: str) -> Frame:
    return R.current(_ledger(spark, d), ["pool_id"])


@query(f"with {_LEDGER} select p.pool_id, coalesce(l.label, p.label) as label, case when l.label is not null then 1.0 else confidence end as confidence from pool_labeled p left join last l using (pool_id)")
def q_review_apply(spark: SparkSession, d: str) -> Frame:
    return R.apply_labels(table(spark, d, "pool_labeled", "pool_id", "label", "confidence"), _ledger(spark, d), ["pool_id"]).select("pool_id", "label", "confidence")


@query(f"with {_LEDGER} select p.pool_id, case when pool_id % 4 = 0 then p.label else coalesce(l.label, p.label) end as label, case when l.label is not null and pool_id % 4 <> 0 then 1.0 else confidence end as confidence from pool_labeled p left join last l using (pool_id)")
def q_unreview(spark: SparkSession, d: str) -> Frame:
    pool = table(spark, d, "pool_labeled", "pool_id", "label", "confidence")
    ledger = R.undo(_ledger(spark, d), pool.filter("pool_id % 4 = 0"), ["pool_id"])
    return R.apply_labels(pool, ledger, ["pool_id"]).select("pool_id", "label", "confidence")


@query("select pool_id, label, confidence from pool_labeled where confidence < 1.0 or label = '__invalid__'")
def q_review_queue(spark: SparkSession, d: str) -> Frame:
    return R.majority_queue(table(spark, d, "pool_labeled", "pool_id", "label", "confidence"), "pool_id")


@query(f"""with {S.SQL}
select v.pool_id, v.question, k.options[list_position(p, list_max(p))] as answer, round(list_max(p), 6) as top
from votes v join kinds k using (question) where teacher = 'heron-2' and list_max(p) < 0.6""")
def q_review_single(spark: SparkSession, d: str) -> Frame:
    own = S.votes(spark, d).filter("teacher = 'heron-2'")
    return R.single_queue(own, S.questions(spark, d), ["pool_id"]).select("pool_id", "question", "answer", F.round("top", 6).alias("top"))


@query(f"select pool_id from pool_labeled where {_UNIT.format(seed=42, text='pool_id')} < 0.05")
def q_audit_sample(spark: SparkSession, d: str) -> Frame:
    return R.audit(table(spark, d, "pool_labeled", "pool_id"), "pool_id")


# -- store and cost --------------------------------------------------------------------------------------------------
@query("select pool_id, question from (select distinct pool_id from answers) cross join (select distinct question from questions) except select pool_id, question from answers where regexp_replace(lower(model), '^.*/|\\s+', '', 'g') = 'heron-2'")
def q_cache_misses(spark: SparkSession, d: str) -> Frame:
    rows = table(spark, d, "answers", "pool_id", "question", "model")
    asked = S.questions(spark, d).agg(F.collect_list("question").alias("q"))
    names = F.array(*[F.lit(x) for x in sorted(asked.first()["q"])])
    wanted = rows.select("pool_id").distinct().select("pool_id", F.explode(names).alias("question"))
    return wanted.join(rows.filter(X.short_name(F.col("model")) == "heron-2").select("pool_id", "question").distinct(), ["pool_id", "question"], "left_anti")


@query("select count(*) as calls, cast(floor(sum(120 + length(text)) / 4) as bigint) as prompt_tokens, count(*) * 12 as answer_tokens from (select distinct text from pool_labeled where text is not null)")
def q_cost_estimate(spark: SparkSession, d: str) -> Frame:
    from quorumdf.operators.teacher import estimate

    return estimate(table(spark, d, "pool_labeled", "text"), "x" * 120, None, None).drop("cost")


@query("select key, arg_max(probs, struct_pack(c := created_at, l := loaded_at, p := probs)) as probs from (select key, coalesce(probs, '-') as probs, created_at, coalesce(loaded_at, timestamptz '1970-01-01 00:00:00+00') as loaded_at from answers) group by 1")
def q_store_latest(spark: SparkSession, d: str) -> Frame:
    rows = table(spark, d, "answers", "key", "probs", "created_at", "loaded_at")
    rows = rows.select("key", F.coalesce("probs", F.lit("-")).alias("probs"), "created_at", F.coalesce("loaded_at", F.expr("timestamp '1970-01-01 00:00:00'")).alias("loaded_at"))
    return rows.groupBy("key").agg(F.max_by("probs", F.struct("created_at", "loaded_at", "probs")).alias("probs"))


@query(f"with {S.SQL} select pool_id, question, teacher, round(list_max(p), 6) as top from votes where list_max(p) > 1e-9")
def q_answered(spark: SparkSession, d: str) -> Frame:
    return S.votes(spark, d).filter(A.top(F.col("p")) > 1e-9).select("pool_id", "question", "teacher", F.round(A.top(F.col("p")), 6).alias("top"))


@query("select seed_id, label, cast((row_number() over (partition by label order by sha256(concat('42|', seed_id)), seed_id) - 1) % 5 as integer) as fold from (select distinct seed_id, label from seed_dev)")
def q_stratified_folds(spark: SparkSession, d: str) -> Frame:
    return O.stratified_folds(table(spark, d, "seed_dev", "seed_id", "label").distinct(), "label", "seed_id").select("seed_id", "label", "fold")


@query("select label, pool_id from pool_labeled qualify row_number() over (partition by label order by pool_id) <= 5")
def q_group_head(spark: SparkSession, d: str) -> Frame:
    return O.head_per_group(table(spark, d, "pool_labeled", "label", "pool_id"), "label", "pool_id", 5)


@query(f"with {S.SQL} select pool_id, round(avg((p[2] > 0.5)::int::double), 6) as rate, count(*) as raters from votes where question = 'upset' group by 1 having count(*) >= 3")
def q_rater_aggregate(spark: SparkSession, d: str) -> Frame:
    rows = S.votes(spark, d).filter("question = 'upset'").select("pool_id", (F.get("p", F.lit(1)) > 0.5).cast("int").alias("v"))
    return O.rate(rows, "pool_id", "v").withColumn("rate", F.round("rate", 6))


@query("""with r as (select round, count(*) as n, avg(confidence) as c from pool_labeled where round is not null group by 1)
select round, n, round(c, 6) as confidence, round(c - lag(c) over (order by round), 6) as gain, round(max(c) over (order by round rows 2 preceding), 6) as best_of_three from r""")
def q_learning_curve(spark: SparkSession, d: str) -> Frame:
    from pyspark.sql import Window

    per = table(spark, d, "pool_labeled", "round", "confidence").filter("round is not null").groupBy("round").agg(F.count("*").alias("n"), F.avg("confidence").alias("c"))
    w = Window.orderBy("round")  # one row per labelling round
    return per.select("round", "n", F.round("c", 6).alias("confidence"), F.round(F.col("c") - F.lag("c").over(w), 6).alias("gain"), F.round(F.max("c").over(w.rowsBetween(-2, 0)), 6).alias("best_of_three"))
