"""Duplicates hidden by formatting: one row per distinct content, with its number of copies."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorumdf.llm.chars import content_fold, fold
from quorumdf.plans.skew import cut, join_groups

_SEPARATOR = re.compile(r"\s*(?:\r?\n|\r|[|;])\s*")
_FIELD = re.compile(r"[-*•\s\"'{,]*([^\W\d_][\w. ]{0,38}?)\s*[:=]\s*(.*)", re.S)
_OTHER = re.compile("[^\\w\u0300-\u036f]+|_+")
#: A character that the JVM does not fold: anything but ASCII without colon and equals sign, and signs that are left out anyway.
_SLOW = r"[^\x00-9;<>-\x7f€£«»¿¡’‘“”„…–—\u00a0]"
#: Words that a field's name may have.
NAME_WORDS = 4


def _bare(text: str) -> str:
    """Letters, digits and their accents only, case folded."""
    return _OTHER.sub("", content_fold(text))


def _fields(text: str) -> list[tuple[str, str]] | None:
    """Named fields of a form record in any of its styles, or None for a message."""
    body = text.strip()
    if body[:1] == "{" and body[-1:] == "}":
        try:
            found = json.loads(body, object_pairs_hook=list)
            if found and all(isinstance(x, tuple) for x in found):
                return [(str(k), v if isinstance(v, str) else json.dumps(v)) for k, v in found]
        except ValueError:
            pass
    parts = [p for p in _SEPARATOR.split(body) if _bare(p)]
    if len(parts) < 2:
        return None
    out = []
    for part in parts:
        m = _FIELD.match(part)
        if not m or len(m[1].split()) > NAME_WORDS:
            return None
        out.append((m[1], m[2]))
    return out


def canonical_content(text: str) -> str:
    """The content of a text: letters and digits only, case and look-alikes folded, form fields sorted.

    Fields keep name and value bound together, so swapped values are another content.
    """
    text = fold(text)
    fields = _fields(text)
    if fields is None:
        return _bare(text)
    return "\x1e".join(sorted(f"{_bare(k)}\x1f{_bare(v)}" for k, v in fields))


@F.pandas_udf(T.StringType())
def _canonical(texts: pd.Series) -> pd.Series:
    return texts.map(canonical_content, na_action="ignore")


def keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    """(``id``, ``content``): the canonical content of every row; null for a null text.

    Messages of ASCII and common signs, which cannot be a form (no ``:`` or ``=``), are folded inside the JVM.
    """
    t = F.col(text)
    other = F.when(F.octet_length(t) == F.length(t), t.contains(":") | t.contains("=")).otherwise(t.rlike(_SLOW))
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("t"), F.coalesce(other, F.lit(False)).alias("slow"))
    plain = F.when(~F.col("slow"), F.lower(F.regexp_replace("t", "[^A-Za-z0-9]+", "")))
    return rows.select("id", F.coalesce(plain, _canonical(F.when(F.col("slow"), F.col("t")))).alias("content"))


def collapse(df: DataFrame, key: str = "pool_id", text: str = "text", hashed=F.md5) -> tuple[DataFrame, DataFrame]:
    """(members, contents): ``members(id, group)`` of every row and ``contents(group, keep_id, copies)``.

    Contents are told apart by 128 bits (``hashed``, MD5).  A group in which a second 64-bit hash of the
    content is not the same throughout is a collision: its rows get the whole content as key.  Null texts have no content and belong to no group; texts without any letter or digit
    (the empty one too) are one content.
    """
    rows = cut(
        keyed(df, key, text).filter("content is not null").select("id", hashed(F.col("content")).alias("group"), F.xxhash64("content").alias("proof"))
    )
    sums = rows.groupBy("group").agg(F.min("id").alias("keep_id"), F.count("*").alias("copies"), F.min("proof").alias("lo"), F.max("proof").alias("hi"))
    sums = cut(sums.filter("copies > 1"))
    clash = sums.filter("lo <> hi")
    if not clash.isEmpty():  # where two contents met, the content itself is the key
        met = keyed(df, key, text).filter("content is not null").withColumn("group", hashed(F.col("content"))).join(clash.select("group"), "group", "left_semi")
        split = met.select("id", F.concat("group", F.lit("-"), "content").alias("group"))
        rows = cut(rows.join(clash.select("group"), "group", "left_anti").select("id", "group").unionByName(split))
        sums = cut(rows.groupBy("group").agg(F.min("id").alias("keep_id"), F.count("*").alias("copies")).filter("copies > 1"))
    return rows.select("id", "group"), sums.select("group", "keep_id", "copies")


def found(df: DataFrame, key: str = "pool_id", text: str = "text") -> DataFrame:
    """(keep_id, copy_id): each row whose content occurred before, with the first row of that content."""
    members, repeated = collapse(df, key, text)
    met = join_groups(members, repeated, ["group"], "copies", members.count())
    return met.filter("id <> keep_id").select("keep_id", F.col("id").alias("copy_id"))


def distinct(df: DataFrame, key: str = "pool_id", text: str = "text") -> DataFrame:
    """(keep_id, copies): one row per distinct content with the number of its rows; null texts are one content each."""
    members, repeated = collapse(df, key, text)
    lone = members.join(repeated.select("group"), "group", "left_anti").select(F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("copies"))
    nulls = df.filter(F.col(text).isNull()).select(F.col(key).alias("keep_id"), F.lit(1).cast("long").alias("copies"))
    return repeated.select("keep_id", "copies").unionByName(lone).unionByName(nulls)
