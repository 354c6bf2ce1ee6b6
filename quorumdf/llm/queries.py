"""The registered queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumdf.llm import bpe, consensus, duplicates, languages, lookalike, overlap, packing, pii
from quorumdf.llm.chars import CASE_ONLY, LOOKALIKES
from quorumdf.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus(table(spark, d, "answers"), table(spark, d, "questions")).select("pool_id", "question", "answer")


def p1_consensus(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus(table(spark, d, "answers"), table(spark, d, "questions"))


def p1_plain(spark: SparkSession, d: str) -> DataFrame:
    """The consensus by the textbook mixture, for comparison."""
    return consensus.consensus(table(spark, d, "answers"), table(spark, d, "questions"), plain=True).select("pool_id", "question", "answer")


def p1_reliability(spark: SparkSession, d: str) -> DataFrame:
    return consensus.reliability(table(spark, d, "answers"), table(spark, d, "questions"))


def p1_votes(spark: SparkSession, d: str) -> DataFrame:
    voted = consensus.votes(table(spark, d, "answers"), table(spark, d, "questions"))
    return voted.select("pool_id", "question", F.size("votes").alias("n"), F.array_join(F.transform("votes", lambda v: F.concat(v["model"], F.lit("="), v["label"].cast("string"))), ",").alias("votes"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.found(table(spark, d, "pool_labeled", "pool_id", "text"))


def p2_distinct(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.distinct(table(spark, d, "pool_labeled", "pool_id", "text"))


def _personal(spark: SparkSession, d: str) -> dict[str, tuple[DataFrame, str]]:
    return {"pool_labeled": (table(spark, d, "pool_labeled", "pool_id", "text"), "pool_id"), "seed_dev": (table(spark, d, "seed_dev", "seed_id", "text"), "seed_id")}


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.found(_personal(spark, d), table(spark, d, "name_list"))


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact(pii.gathered(_personal(spark, d)), table(spark, d, "name_list"), ["table_name", "row_id"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.pairs(table(spark, d, "pool_labeled", "pool_id", "text"))


def p4_normal(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.normalize(table(spark, d, "pool_labeled", "pool_id", "text"), "pool_id").select("pool_id", "normal")


def _splits(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "seed_test").select(F.col("seed_id").alias("id"), "text"), table(spark, d, "pool_labeled").select(F.col("pool_id").alias("id"), "text")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.pairs(*_splits(spark, d)).select(F.col("eval_id").alias("seed_id"), F.col("train_id").alias("pool_id"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Overlaps per source: rows of the training pool and of the test split that have a partner in the other, and pairs."""
    met = p5_found(spark, d)
    pool = table(spark, d, "pool_labeled", "pool_id", "source").join(met, "pool_id").groupBy("source").agg(F.countDistinct("pool_id").alias("rows"), F.count("*").alias("pairs"))
    test = table(spark, d, "seed_test", "seed_id", "source").distinct().join(met, "seed_id").groupBy("source").agg(F.countDistinct("seed_id").alias("rows"), F.count("*").alias("pairs"))
    return pool.select(F.lit("pool_labeled").alias("split"), "source", "rows", "pairs").unionByName(test.select(F.lit("seed_test").alias("split"), "source", "rows", "pairs"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents", "doc_id", "text"))


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "containers"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p7_packed(spark, d), table(spark, d, "containers"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return languages.found(table(spark, d, "documents", "doc_id", "text", "lang"))


def p8_languages(spark: SparkSession, d: str) -> DataFrame:
    return languages.assign(table(spark, d, "documents", "doc_id", "text", "lang")).select("doc_id", "labelled", "lang", "confidence", F.size("stretches").alias("n"))


def p8_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every stretch of one language of every document, with its place in the text and its confidence."""
    documents = table(spark, d, "documents", "doc_id", "text", "lang")
    return languages.stretches(documents, languages.fit(documents)).withColumn("confidence", F.round("confidence", 6))


QUERIES = {f.__name__: f for f in (p1_found, p1_consensus, p1_plain, p1_reliability, p1_votes, p2_found, p2_distinct, p3_found, p3_redacted, p4_found, p4_normal, p5_found, p5_report, p6_ids, p7_packed, p7_fill, p8_found, p8_languages, p8_segments)}

_WORDS = "list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'))"

_OVERLAP = f"""
with e as (select seed_id, {_WORDS} as w from seed_test),
t as (select pool_id, {_WORDS} as w from pool_labeled),
met as (
  select a.seed_id, b.pool_id, count(*) as n
  from (select distinct seed_id, unnest(w) as x from e) a join (select pool_id, unnest(w) as x from t) b using (x) group by 1, 2
),
met2 as (
  select e.seed_id, m.pool_id from met m join e using (seed_id) join t using (pool_id)
  where 5 * m.n >= 4 * (len(e.w) + len(t.w) - m.n)
)
"""


def _look_sql(column: str) -> str:
    """A text as it looks, in DuckDB: invisible characters out, width forms, special spaces and look-alikes to their ordinary form, accents composed."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    ordinary = "".join(chr(c) for c in range(0x21, 0x7F))
    spaces = "\u00a0\u2007\u202f\u3000"
    latin = {c: k for k, v in LOOKALIKES.items() for c in v}
    for c in map(chr, [*range(0x370, 0x530), *range(0x1F00, 0x2000)]):  # letters that are a look-alike with an accent
        base, *marks = unicodedata.normalize("NFD", c)
        if marks and base in latin and len(one := unicodedata.normalize("NFC", latin[base] + "".join(marks))) == 1:
            latin[c] = one
    odd, plain = "".join(latin), "".join(latin.values())
    quote = lambda s: s.replace("'", "''")
    bare = f"regexp_replace({column}, '[\\x{{00AD}}\\x{{200B}}\\x{{200C}}\\x{{2060}}\\x{{FEFF}}\\x{{FE0F}}]', '', 'g')"
    for _ in range(2):
        bare = f"regexp_replace({bare}, '([^\\x{{2190}}-\\x{{2BFF}}\\x{{1F000}}-\\x{{1FAFF}}])\\x{{200D}}', '\\1', 'g')"
    return f"nfc_normalize(translate(nfc_normalize({bare}), '{quote(wide + spaces + odd)}', '{quote(ordinary + ' ' * len(spaces) + plain)}'))"


def _bare_sql(column: str) -> str:
    """Letters, digits and accents of a folded text in lower case; letters alike only as capitals fall together."""
    odd, plain = "".join(CASE_ONLY.values()), "".join(CASE_ONLY)
    return f"translate(regexp_replace(replace(replace(lower({column}), 'ß', 'ss'), 'ς', 'σ'), '[^\\p{{L}}\\p{{N}}\\x{{0300}}-\\x{{036F}}]+', '', 'g'), '{odd}', '{plain}')"


_FIELD = "^[-*•\\s\"''{{,]*(\\p{{L}}[\\p{{L}}\\p{{N}}_. ]{{0,38}}?)\\s*[:=]\\s*((?s:.*))$".replace("{{", "{").replace("}}", "}")

_CONTENT = f"""
looks as (select pool_id, regexp_replace({_look_sql("text")}, '^\\s+|\\s+$', '', 'g') as body from pool_labeled where text is not null),
cut as (select pool_id, body, body like '{{%}}' and json_valid(body) as json, list_filter(regexp_split_to_array(body, '\\s*(?:\\r?\\n|\\r|[|;])\\s*'), lambda x: regexp_matches(x, '[\\p{{L}}\\p{{N}}]')) as parts from looks),
forms as (select *, not json and len(parts) > 1 and len(list_filter(parts, lambda x: regexp_matches(x, '{_FIELD}') and len(regexp_split_to_array(trim(regexp_extract(x, '{_FIELD}', 1)), '\\s+')) <= 4)) = len(parts) as form from cut),
keyed as (select pool_id, case
  when json then array_to_string(list_sort(list_transform(json_keys(body), lambda k: {_bare_sql("k")} || chr(31) || {_bare_sql("json_extract_string(body, '$.\"' || k || '\"')")})), chr(30))
  when form then array_to_string(list_sort(list_transform(parts, lambda x: {_bare_sql(f"regexp_extract(x, '{_FIELD}', 1)")} || chr(31) || {_bare_sql(f"regexp_extract(x, '{_FIELD}', 2)")})), chr(30))
  else {_bare_sql("body")} end as content from forms)
"""

ORACLES = {
    "p2_found": f"with {_CONTENT} select keep_id, pool_id as copy_id from (select pool_id, min(pool_id) over (partition by content) as keep_id from keyed) where pool_id <> keep_id",
    "p2_distinct": f"with {_CONTENT} select min(pool_id) as keep_id, count(*) as copies from keyed group by content union all select pool_id, 1 from pool_labeled where text is null",
    "p1_votes": """
with kinds as (select question, max(options) as options from questions where len(options) > 0 group by 1),
rows as (
  select a.pool_id, a.question, regexp_replace(lower(a.model), '^.*/|\\s+', '', 'g') as model, a.created_at, a.loaded_at,
         len(k.options) as k, a.probs,
         case when a.probs is not null and regexp_matches(a.probs, '^\\s*\\[.*\\]\\s*$')
              then list_transform(string_split(trim(trim(a.probs), '[]'), ','), lambda x: try_cast(trim(x) as double)) end as v
  from answers a join kinds k using (question)
),
labelled as (
  select *, case when len(v) = k and len(list_filter(v, lambda x: x is not null and not isnan(x) and not isinf(x))) = k and list_sum(v) > 0
                 then list_position(v, list_max(v)) - 1 end as label
  from rows where pool_id is not null and question is not null and model is not null
),
latest as (
  select pool_id, question, model, label from labelled
  qualify row_number() over (partition by pool_id, question, model order by created_at desc nulls last, label desc nulls last) = 1
)
select pool_id, question, cast(count(*) as integer) as n, string_agg(model || '=' || label, ',' order by model) as votes
from latest where label is not null group by 1, 2
""",
    "p4_found": f"""
with t as (select pool_id, text, {_look_sql("text")} as look from pool_labeled where text is not null)
select a.pool_id as pool_id_a, b.pool_id as pool_id_b from t a join t b on a.look = b.look and a.pool_id < b.pool_id and a.text <> b.text
""",
    "p5_found": _OVERLAP + "select seed_id, pool_id from (select s.seed_id, m.pool_id from met2 m join seed_test s using (seed_id))",
    "p5_report": _OVERLAP
    + """
, pairs as (select s.seed_id, m.pool_id from met2 m join seed_test s using (seed_id)),
test as (select distinct seed_id, source from seed_test)
select 'pool_labeled' as split, p.source, count(distinct pool_id) as rows, count(*) as pairs from pairs join pool_labeled p using (pool_id) group by 2
union all
select 'seed_test' as split, t.source, count(distinct seed_id) as rows, count(*) as pairs from pairs join test t using (seed_id) group by 2
""",
}
