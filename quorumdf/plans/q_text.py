"""Queries of text functions, n-gram features, similarity, embeddings and streaming windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumdf.functions import arrays as A
from quorumdf.functions import text as X
from quorumdf.operators import features as E
from quorumdf.operators import calibrate as K
from quorumdf.plans.register import registrar
from quorumdf.sources import answers as S
from quorumdf.sources.tables import table

REGISTER: dict = {}
query = registrar(REGISTER)

_WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')"


@query(f"select w as word, count(*) as n, count(distinct doc_id) as docs from documents, unnest({_WORDS}) as u(w) group by 1")
def q_tokens_word(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.explode(X.words(F.col("text"))).alias("word"))
    return rows.groupBy("word").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


@query(f"""with d as (select doc_id, {_WORDS} as w from documents), g as (select unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as term from d)
select term, count(*) as n from g group by 1""")
def q_word_ngrams(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents", "text").select(F.explode(X.word_ngrams(F.col("text"))).alias("term"))
    return rows.groupBy("term").agg(F.count("*").alias("n"))


@query("""with w as (select ' ' || x || ' ' as w from pool_labeled, unnest(regexp_split_to_array(lower(text), '[\\s\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{0085}\\x{000B}\\x{001C}-\\x{001F}]+')) as u(x) where x <> ''),
g as (select unnest(case when len(w) <= 3 then [w] else list_concat(
  list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2]),
  list_transform(range(1, len(w) - 2), lambda i: w[i:i + 3]),
  case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4]) else [] end) end) as gram from w)
select gram, count(*) as n from g group by 1""")
def q_char_wb_ngrams(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pool_labeled", "text").select(F.explode(X.char_ngrams(F.col("text"))).alias("gram"))
    return rows.groupBy("gram").agg(F.count("*").alias("n"))


@query(f"""with tf as (select seed_id, w as term, count(*) as tf from seed_dev, unnest({_WORDS}) as u(w) group by 1, 2),
n as (select count(*) as n from seed_dev), df as (select term, count(*) as df from tf group by 1),
w as (select seed_id, term, tf * (ln((1.0 + n) / (1.0 + df)) + 1) as w from tf join df using (term), n)
select seed_id, term, round(w / sqrt(sum(w * w) over (partition by seed_id)), 6) as weight from w""")
def q_tfidf_weights(spark: SparkSession, d: str) -> DataFrame:
    return E.tfidf(table(spark, d, "seed_dev", "seed_id", "text"), "seed_id", X.words(F.col("text"))).withColumn("weight", F.round("weight", 6))


@query("""with b as (select 'l' as side, seed_id as id, text from seed_test union all select 'r', seed_id, text from seed_dev),
tf as (select side, id, w as term, count(*) as tf from b, unnest(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda w: len(w) >= 2 and not regexp_matches(w, '\\p{Nd}'))) as u(w) group by 1, 2, 3),
n as (select count(*) as n from b), df as (select term, count(*) as df from tf group by 1),
w as (select side, id, term, (1 + ln(tf)) * (ln((1.0 + n) / (1.0 + df)) + 1) as w from tf join df using (term), n),
u as (select side, id, term, w / sqrt(sum(w * w) over (partition by side, id)) as w from w),
c as (select a.id as test_id, b.id as dev_id, sum(a.w * b.w) as cosine from u a join u b on a.side = 'l' and b.side = 'r' and a.term = b.term group by 1, 2)
select test_id, dev_id, round(cosine, 6) as cosine from c where cosine >= 0.9 - 1e-9 qualify row_number() over (partition by test_id order by cosine desc, dev_id) = 1""")
def q_near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    left = table(spark, d, "seed_test", "seed_id", "text").select(F.col("seed_id").alias("test_id"), "text").dropDuplicates(["test_id"])
    right = table(spark, d, "seed_dev", "seed_id", "text").select(F.col("seed_id").alias("dev_id"), "text").dropDuplicates(["dev_id"])
    return E.near_duplicates(left, right, "test_id", "dev_id").withColumn("cosine", F.round("cosine", 6))


@query("""with x as (select label, i, avg(embedding[i]::double) as x from embeddings, unnest(range(1, 65)) as u(i) group by 1, 2)
select label, list(round(x / s, 6) order by i) as centroid from (select *, sqrt(sum(x * x) over (partition by label)) as s from x) group by 1""")
def q_embedding_mean(spark: SparkSession, d: str) -> DataFrame:
    out = E.mean_vector(table(spark, d, "embeddings", "label", "embedding"), ["label"], "embedding")
    return out.select("label", F.transform("centroid", lambda x: F.round(x, 6)).alias("centroid"))


@query("""with x as (select label, i, avg(embedding[i]::double) as x from embeddings, unnest(range(1, 65)) as u(i) group by 1, 2),
c as (select label, list(x order by i) as c from x group by 1),
s as (select e.vec_id, e.label, c.label as near, list_dot_product(e.embedding::double[], c.c) / (sqrt(list_dot_product(e.embedding::double[], e.embedding::double[])) * sqrt(list_dot_product(c.c, c.c))) as s from embeddings e, c)
select label, near, count(*) as n from (select * from s qualify row_number() over (partition by vec_id order by round(s, 9) desc, near) = 1) group by 1, 2""")
def q_embedding_knn(spark: SparkSession, d: str) -> DataFrame:
    """Nearest class centroid of every vector; the centroids (one per class) are broadcast as one array."""
    rows = table(spark, d, "embeddings", "vec_id", "label", "embedding")
    centres = E.mean_vector(rows, ["label"], "embedding").agg(F.collect_list(F.struct("label", "centroid")).alias("all"))
    met = rows.join(F.broadcast(centres), F.size("all") > 0)
    near = F.array_sort(F.transform("all", lambda c: F.struct((-F.round(E.cosine(F.col("embedding"), c["centroid"]), 9)).alias("d"), c["label"].alias("label"))))
    return met.select("label", F.get(near, F.lit(0))["label"].alias("near")).groupBy("label", "near").agg(F.count("*").alias("n"))


@query("""select doc_id, trim(regexp_replace(regexp_replace(text, '[\\s\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{0085}\\x{000B}\\x{001C}-\\x{001F}]+', ' ', 'g'), '^$', '')) as cleaned from documents where text is not null""")
def q_clean_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").filter("text is not null").select("doc_id", X.clean(F.col("text")).alias("cleaned"))


_REPLIES = """replies as (
  select seed_id, label, case seed_id % 5 when 0 then '```json' || chr(10) || '{"label": "' || upper(label) || '"}' || chr(10) || '```' when 1 then 'I think {"label": "' || label || '"} fits' when 2 then '"' || label || '".' when 3 then '{"label": "nothing"}' else 'no idea' end as reply
  from (select distinct seed_id, label from seed_dev where label is not null))"""


@query(f"with {_REPLIES} select seed_id, case when seed_id % 5 < 3 and label in ('payment', 'defect', 'access', 'delivery', 'feedback') then label end as parsed from replies")
def q_parse_label(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "seed_dev", "seed_id", "label").filter("label is not null").distinct()
    low = F.col("label")
    kind = F.col("seed_id") % 5
    reply = (
        F.when(kind == 0, F.concat(F.lit('```json\n{"label": "'), F.upper(low), F.lit('"}\n```')))
        .when(kind == 1, F.concat(F.lit('I think {"label": "'), low, F.lit('"} fits')))
        .when(kind == 2, F.concat(F.lit('"'), low, F.lit('".')))
        .when(kind == 3, F.lit('{"label": "nothing"}'))
        .otherwise("no idea")
    )
    return rows.select("seed_id", X.parse_label(reply, ["payment", "defect", "access", "delivery", "feedback"]).alias("parsed"))


@query("select key, sha256(concat(regexp_replace(lower(model), '^.*/|\\s+', '', 'g'), '|', question, '|', pool_id)) as cache_key from (select distinct key, model, question, pool_id from answers)")
def q_cache_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "answers", "key", "model", "question", "pool_id").distinct()
    return rows.select("key", X.cache_key(X.short_name(F.col("model")), F.col("question"), F.col("pool_id")).alias("cache_key"))


# -- calibration as expressions --------------------------------------------------------------------------------------
_RESCALE = """case when len(p) = 2 then [1 - m, m] else list_transform(range(1, len(p) + 1), lambda i: case when i = w then t when rest > 1e-12 then p[i] * (1 - t) / rest else (1 - t) / (len(p) - 1) end) end"""
_MOVED = """moved as (select *, greatest(m, least(case when rest > 1e-12 then o / (rest + o) else 0 end + 1e-9, 1 - 1e-12)) as t from (
  select *, list_position(p, list_max(p)) as w, list_sort(p, 'desc')[2] as o, list_sum(p) - list_max(p) as rest from mapped))"""


def _apply(spark: SparkSession, d: str, params: dict) -> DataFrame:
    return S.votes(spark, d).select("pool_id", "question", "teacher", F.transform(K.expression(params, F.col("p")), lambda x: F.round(x + 1e-10, 6)).alias("p"))


_OWN = f"{S.SQL}, own as (select pool_id, question, teacher, p from votes)"


@query(f"with {_OWN}, e as (select *, list_transform(p, lambda x: power(greatest(x, 1e-12), 1 / 1.7)) as e from own) select pool_id, question, teacher, list_transform(e, lambda x: round(x / list_sum(e) + 1e-10, 6)) as p from e")
def q_calibrate_apply_temperature(spark: SparkSession, d: str) -> DataFrame:
    return _apply(spark, d, {"method": "temperature", "t": 1.7})


@query(f"""with {_OWN}, c as (select *, case when len(p) = 2 then p[2] else list_max(p) end as c from own),
mapped as (select *, 1 / (1 + exp(-(0.8 * ln(least(greatest(c, 1e-12), 1 - 1e-9) / least(greatest(1 - c, 1e-12), 1.0)) - 0.3))) as m from c), {_MOVED}
select pool_id, question, teacher, list_transform({_RESCALE}, lambda x: round(x + 1e-10, 6)) as p from moved""")
def q_calibrate_apply_platt(spark: SparkSession, d: str) -> DataFrame:
    return _apply(spark, d, {"method": "platt", "a": 0.8, "b": -0.3})


@query(f"""with {_OWN}, c as (select *, case when len(p) = 2 then p[2] else list_max(p) end as c from own),
mapped as (select *, case when c <= 0.2 then 0.1 when c < 0.6 then 0.1 + (0.5 - 0.1) * (c - 0.2) / (0.6 - 0.2) when c < 0.9 then 0.5 + (0.8 - 0.5) * (c - 0.6) / (0.9 - 0.6) else 0.8 end as m from c), {_MOVED}
select pool_id, question, teacher, list_transform({_RESCALE}, lambda x: round(x + 1e-10, 6)) as p from moved""")
def q_calibrate_apply_isotonic(spark: SparkSession, d: str) -> DataFrame:
    return _apply(spark, d, {"method": "isotonic", "xs": [0.2, 0.6, 0.9], "ys": [0.1, 0.5, 0.8]})


@query(f"""with {_OWN}, e as (select *, [exp(0.9 * ln(greatest(p[1], 1e-12)) + 0.1), exp(1.1 * ln(greatest(p[2], 1e-12)) - 0.1)] as e from own where question = 'upset')
select pool_id, question, teacher, list_transform(e, lambda x: round(x / list_sum(e) + 1e-10, 6)) as p from e""")
def q_calibrate_apply_vector(spark: SparkSession, d: str) -> DataFrame:
    rows = _apply(spark, d, {"method": "vector", "w": [[0.9, 0.0], [0.0, 1.1]], "b": [0.1, -0.1]})
    return rows.filter("question = 'upset'")


@query(f"""with {S.SQL} select cast(epoch(time_bucket(interval '1 hour', created_at)) as bigint) as start, question, count(*) as n, round(avg(list_max(p)) + 1e-10, 6) as mean_confidence from stored where p is not null group by 1, 2""")
def q_confidence_by_hour(spark: SparkSession, d: str) -> DataFrame:
    from quorumdf.streaming.serve import drift

    return drift(S.stored(spark, d).filter("p is not null"), "created_at").withColumn("mean_confidence", F.round(F.col("mean_confidence") + 1e-10, 6)).withColumn("start", F.unix_timestamp("start"))
