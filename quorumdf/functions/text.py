"""Text functions: tokens, n-grams, keys, hash units, cleaning and lenient parsing of model replies."""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[\p{L}\p{N}_]{2,}"
RUN = r"[\p{L}\p{N}_]+"
INVALID = "__invalid__"

# Readings of a yes/no answer.
YES, NO = ("yes", "true", "1", "y", "t"), ("no", "false", "0", "n", "f")


def words(text: Column) -> Column:
    """Lower-case runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def word_ngrams(text: Column, most: int = 2) -> Column:
    """The words and their runs of up to ``most``, joined by blanks."""

    def grams(w: Column) -> Column:
        out = [w]
        for n in range(2, most + 1):
            starts = F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(F.expr("cast(array() as array<int>)"))
            out.append(F.transform(starts, _joined(w, n)))
        return F.concat(*out)

    # The words are bound to a variable, else they would be cut anew for each run.
    return F.get(F.transform(F.array(words(text)), grams), F.lit(0))


def _joined(w: Column, n: int):
    return lambda i: F.array_join(F.slice(w, i + 1, n), " ")


def char_ngrams(text: Column, least: int = 3, most: int = 5) -> Column:
    """Character n-grams inside white-space words, each word padded by a blank on both sides; a shorter word counts once and has no longer grams.

    The words are set two blanks apart, so that each place where an n-gram of one padded word starts is found by looking ahead,
    in one pass over the text for each length.
    """
    trimmed = F.regexp_replace(F.lower(text), r"(?U)^\s+|\s+$", "")
    padded = F.concat(F.lit(" "), F.regexp_replace(trimmed, r"(?U)\s+", "  "), F.lit(" "))
    whole = r"(?![\x{DC00}-\x{DFFF}])"  # not in the middle of a character of two units

    def found(grams: str) -> Column:
        return F.regexp_extract_all(padded, F.lit(f"{whole}(?=({grams}))"), F.lit(1))

    parts = [found(f" [^ ]{{{n - 1}}}|[^ ]{{{n}}}|[^ ]{{{n - 1}}} | [^ ]{{{n - 2}}} ") for n in range(least, most + 1)]
    if least > 3:  # whole words that are shorter than any n-gram
        parts.append(found(f" [^ ]{{1,{least - 3}}} "))
    return F.concat(*parts)


def letter_words(text: Column) -> Column:
    """Whole runs of word characters, two or more, without a decimal digit."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(RUN), F.lit(0)), lambda w: (F.length(w) >= 2) & ~w.rlike(r"\p{Nd}"))


def hash_unit(seed: Column, text: Column) -> Column:
    """A number in [0, 1) from the first 48 bits of sha256(seed|text); the same in every engine."""
    return F.conv(F.substring(F.sha2(F.concat(seed.cast("string"), F.lit("|"), text), 256), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def short_name(model: Column) -> Column:
    """What follows the last slash, in lower case and without blanks."""
    return F.regexp_replace(F.lower(model), r"^.*/|\s+", "")


def is_blank(text: Column) -> Column:
    return text.isNull() | text.rlike(r"(?U)^\s*$")


def clean(text: Column, most: int | None = None) -> Column:
    """HTML comments and bot command lines out, white space collapsed, ends trimmed, optionally cut to ``most`` characters."""
    out = F.regexp_replace(text, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?m)^\s*/[a-z][\w-]*.*$", " ")
    out = F.trim(F.regexp_replace(out, r"(?U)\s+", " "))
    return F.substring(out, 1, most) if most else out


def parse_label(reply: Column, labels: list[str]) -> Column:
    """The label that a reply names: in a fenced, whole or embedded JSON object, else the bare reply; null if none of ``labels``."""
    bare = F.trim(F.regexp_replace(F.trim(reply), r"^```[a-zA-Z]*\s*|\s*```$", ""))
    objects = F.regexp_extract_all(bare, F.lit(r"\{[^{}]*\}"), F.lit(0))
    said = F.filter(F.transform(objects, lambda o: F.get_json_object(o, "$.label")), lambda x: x.isNotNull())
    table = F.create_map(*[F.lit(x) for name in labels for x in (name.lower(), name)])
    known = F.filter(F.transform(said, lambda x: F.element_at(table, F.lower(F.trim(x)))), lambda x: x.isNotNull())
    return F.coalesce(F.get(known, F.lit(0)), F.element_at(table, F.lower(F.regexp_replace(bare, r"^[\"'`.\s]+|[\"'`.\s]+$", ""))))


def gold_index(answer: Column, kind: Column, options: Column) -> Column:
    """Index of a hand answer: the option in any case, a yes/no synonym, or a level number (rounded half to even); null if unreadable."""
    said = F.lower(F.trim(answer.cast("string")))
    exact = F.array_position(F.transform(options, F.lower), said).cast("int")
    number = F.bround(F.expr("0D") + said.try_cast("double"), 0).cast("int") if hasattr(said, "try_cast") else F.bround(said.cast("double"), 0).cast("int")
    level = F.when((number >= 0) & (number < F.size(options)), number)
    yes_no = F.when(said.isin(*YES), 1).when(said.isin(*NO), 0)
    return F.when(exact > 0, exact - 1).when(kind == "noul", yes_no).when(kind == "score", level)


def first_object(text: str) -> dict | None:
    """The first balanced JSON object in a text."""
    decoder = json.JSONDecoder()
    for m in re.finditer(r"\{", text):
        try:
            found, _ = decoder.raw_decode(text, m.start())
        except ValueError:
            continue
        if isinstance(found, dict):
            return found
    return None


def coerce_distribution(answer, options: list[str], kind: str) -> list[float] | None:
    """A vector over ``options`` from whatever a model said: a map, a wrapped map, a probability, a level or an option's name."""
    if isinstance(answer, dict):
        inner = next((answer[k] for k in ("probabilities", "distribution") if isinstance(answer.get(k), dict)), None)
        if inner is None:
            single = next((answer[k] for k in ("noul", "probability", "p", "choice", "label", "answer", "score") if k in answer), None)
            if single is not None:
                return coerce_distribution(single, options, kind)
            inner = answer
        names = {o.lower(): i for i, o in enumerate(options)}
        if kind == "noul":
            names |= {x: 1 for x in YES} | {x: 0 for x in NO}
        out = [0.0] * len(options)
        for key, value in inner.items():
            i = names.get(str(key).strip().lower())
            if i is None and kind == "score" and (m := re.match(r"\s*(\d+)\b", str(key))):
                i = int(m[1]) if int(m[1]) < len(options) else None
            if i is not None and isinstance(value, (int, float)) and math.isfinite(value):
                out[i] = max(0.0, float(value))
        if kind == "noul" and sum(out) and out[0] == 0 and out[1] < 1:
            out[0] = 1 - out[1]
        mass = sum(out)
        return [x / mass for x in out] if mass > 0 else None
    if isinstance(answer, bool):
        answer = "yes" if answer else "no"
    if isinstance(answer, (int, float)):
        if not math.isfinite(answer):
            return None
        if kind == "noul":
            p = min(1.0, max(0.0, float(answer)))
            return [1 - p, p]
        i = round(answer)
        return [float(j == i) for j in range(len(options))] if kind == "score" and 0 <= i < len(options) else None
    if isinstance(answer, str):
        said = answer.strip().lower()
        if kind == "noul":
            said = "yes" if said in YES else "no" if said in NO else said
        names = [o.lower() for o in options]
        if said in names:
            return [float(o == said) for o in names]
    return None


@F.pandas_udf(T.MapType(T.StringType(), T.ArrayType(T.DoubleType())))
def parse_answers(replies: pd.Series, questions: pd.Series) -> pd.Series:
    """question → vector of one model reply; ``questions`` is a JSON list of {id, kind, options}.  Absent or unreadable ones are left out."""
    seen: dict[str, list] = {}
    out = []
    for reply, asked in zip(replies, questions):
        if asked not in seen:
            seen[asked] = json.loads(asked)
        found = first_object(reply) if isinstance(reply, str) else None
        found = found.get("answers", found) if found else {}
        got = {}
        for q in seen[asked]:
            if isinstance(found, dict) and q["id"] in found:
                p = coerce_distribution(found[q["id"]], q["options"], q["kind"])
                if p:
                    got[q["id"]] = p
        out.append(got)
    return pd.Series(out)
