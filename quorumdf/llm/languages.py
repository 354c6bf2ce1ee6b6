"""Missing or wrong language labels: rank-order n-gram profiles and the out-of-place distance.

A profile is a language's most frequent n-grams in order.  A stretch of text is ranked the same
way, and the language whose profile holds its n-grams in the nearest places wins.  Documents are
cut into units (sentences and lines), each unit is compared with every profile, and the
cheapest path through a document's units, paying for each change of language, gives its stretches.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from unicodedata import combining, normalize

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumdf.llm.chars import JOINER, fold, joined
from quorumdf.plans.skew import cut, spread

LANGUAGES = ("de", "en", "es", "fr", "nl", "pt", "ru")

# Names of the languages, each with its codes and its own and English names.
NAMES = {
    "de": ("de", "deu", "ger", "german", "deutsch", "allemand", "alemán"),
    "en": ("en", "eng", "english", "englisch", "anglais", "inglés"),
    "es": ("es", "spa", "spanish", "spanisch", "español", "espanol", "castellano"),
    "fr": ("fr", "fra", "fre", "french", "französisch", "français", "francais"),
    "nl": ("nl", "nld", "dut", "dutch", "nederlands", "niederländisch"),
    "pt": ("pt", "por", "portuguese", "portugiesisch", "português", "portugues"),
    "ru": ("ru", "rus", "russian", "russisch", "русский"),
}

#: Labelled documents of one language that the profiles are fitted on, whole texts, at most; chosen by a hash of the id.
SAMPLE_DOCS = 2000
#: n-grams of a profile.
PROFILE = 3000
#: Lengths of the n-grams.
GRAMS = (2, 3)
#: Characters that are compared in one go.
BATCH_CHARS = 150_000
#: Cost of a change of language inside a document, in n-grams that would have to be fully out of place.
SWITCH = 1.5

_UNIT = re.compile(r"(?<=[.!?…])[\"'»)]*\s+|\s*[\r\n]+\s*")
_LETTER = "[A-Za-z\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u02af\\u0300-\\u036f\\u0400-\\u052f\\u1e00-\\u1eff]"
_MARKS = ".,;:!?…\"'()«»¿¡“”„’*>–—-"
#: A token of Latin or Cyrillic letters, perhaps compound; codes, numbers, paths, handles and pictures are none.
_WORD = re.compile(f"{_LETTER}+(?:['’-]{_LETTER}+)*")
_SOLID = re.compile(r"\w")
#: A word with one letter four times in a row, or this long, belongs to no language.
_NOISE = re.compile(r"(.)\1{3}")
LONGEST_WORD = 60


def label_language(label: Column) -> Column:
    """The two-letter code that a label names in any spelling (name, three-letter code, region); null if it names none."""
    bare = F.lower(F.trim(label))
    base = F.regexp_replace(bare, r"[-_ (.].*$", "")
    pairs = [F.lit(x) for code, names in NAMES.items() for name in names for x in (name, code)]
    table = F.create_map(*pairs)
    return F.coalesce(F.element_at(table, bare), F.element_at(table, base))


class _Tokens(dict):
    """Lower-case token to its word if it has one that can tell a language, '' for another token with a letter or digit, None for any other."""

    def __missing__(self, token: str) -> str | None:
        if len(self) > 500_000:
            self.clear()
        w = token.strip(_MARKS)
        if w and (w.isalpha() and w.isascii() or _WORD.fullmatch(w)):
            word = "" if len(w) > LONGEST_WORD or _NOISE.search(w) else w
        else:
            word = "" if _SOLID.search(w) else None
        self[token] = word
        return word


_TOKENS = _Tokens()


def unit_words(unit: str) -> tuple[list[str], int]:
    """Words of a lower-case unit that can tell a language, and the number of its tokens with a letter or digit."""
    found = [_TOKENS[t] for t in unit.split()]
    return [w for w in found if w], len(found) - found.count(None)


def units(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, words) of the sentences and lines of a folded text that have words of a language.

    A line that is mostly codes and numbers (a log line, a table row) has none.
    """
    low = text.lower()
    if len(low) != len(text):  # a letter that grows in lower case would move the offsets
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    out, start = [], 0
    for m in [*_UNIT.finditer(low), None]:
        end = m.start() if m else len(low)
        words, tokens = unit_words(low[start:end])
        if words and 2 * len(words) > tokens - (len(words) > 3) * 2:
            out.append((start, end, words))
        start = m.end() if m else end
    return out


def _plain(word: str) -> str:
    return word if word.isascii() else "".join(c for c in normalize("NFD", word) if not combining(c))


def grams(word: str) -> list[str]:
    padded = f"_{word}_"
    return [padded[i : i + n] for n in GRAMS for i in range(len(padded) - n + 1)]


class _WordGrams(dict):
    """Word to the numbers of its n-grams that stand in some profile."""

    def __init__(self, index: dict[str, int]):
        super().__init__()
        self.index = index

    def __missing__(self, word: str) -> np.ndarray:
        if len(self) > 300_000:
            self.clear()
        ids = self[word] = np.array([i for g in grams(word) if (i := self.index.get(g)) is not None], np.int64)
        return ids

    def __reduce__(self):
        return _WordGrams, (self.index,)  # the words themselves are not sent along


class Profiles:
    """Profiles of all languages as one table: the place of each n-gram in each of them, n-grams in order of their best place."""

    def __init__(self, table: pd.DataFrame, languages: tuple[str, ...] = LANGUAGES):
        self.languages = languages
        best: dict[str, int] = {}
        for gram, place in zip(table["gram"], table["place"]):
            best[gram] = min(best.get(gram, PROFILE), place)
        self.index = {g: i for i, g in enumerate(sorted(best, key=lambda g: (best[g], g)))}
        self.places = np.full((len(best), len(languages)), 2 * PROFILE, np.int16)
        for lang, gram, place in zip(table["lang"], table["gram"], table["place"]):
            self.places[self.index[gram], languages.index(lang)] = place
        self.cache = _WordGrams(self.index)


    def costs(self, found: list[list[str]]) -> np.ndarray:
        """(unit, language): out-of-place distance of each unit, in n-grams fully out of place.

        A unit's n-grams are ranked by falling count, equal ones by their best place in any profile; a known
        n-gram that a profile lacks is fully out of place.  All units are ranked together.
        """
        n, width, size = len(found), len(self.languages), max(1, len(self.index))
        out = np.zeros((n, width))
        known = self.cache
        arrays = [known[w] for words in found for w in words]
        if not arrays or not len(self.index):
            return out
        sizes = np.fromiter(map(len, arrays), np.int64, len(arrays))
        unit_of_word = np.repeat(np.arange(n), [len(words) for words in found])
        key = np.repeat(unit_of_word * size, sizes) + np.concatenate(arrays)
        if not len(key):
            return out
        key.sort()
        fresh = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count = np.diff(np.append(fresh, len(key)))
        unit, gram = np.divmod(key[fresh], size)
        start = np.searchsorted(unit, np.arange(n))
        # Entries stand by unit and best place.  Those counted once follow the others of their unit in that order.
        many = count > 1
        several = np.bincount(unit[many], minlength=n)
        once = np.cumsum(~many)
        rank = once - 1 + (several - np.concatenate([[0], once])[start])[unit]
        at = np.flatnonzero(many)
        order = at[np.lexsort((gram[at], -count[at], unit[at]))]
        rank[order] = np.arange(len(order)) - (np.cumsum(several) - several)[unit[order]]
        apart = self.places[gram]
        apart -= np.minimum(rank, PROFILE).astype(np.int16)[:, None]
        np.minimum(np.abs(apart, out=apart), PROFILE, out=apart)
        used = np.unique(unit)
        out[used] = np.add.reduceat(apart, start[used], axis=0, dtype=np.int64) / PROFILE
        return out


def _sentences(text: str | None) -> tuple[str, list[tuple[int, int, list[str]]]]:
    if not text:
        return "", []
    text = fold(text)
    return text, units(text)


def origins(text: str) -> list[int]:
    """For each character of the folded text, and for its end, the place in the text that it comes from.

    The text is folded by base characters with their accents, which fold independently; only a joiner depends on its neighbours.
    """
    at: list[int] = []
    start, kept = 0, joined(text)
    places = [i for i, c in enumerate(text) if c != JOINER] if len(kept) != len(text) else range(len(text))
    if len(places) != len(kept):  # joiners between pictures stay: match them in order
        places, i = [], 0
        for c in kept:
            while text[i] != c:
                i += 1
            places.append(i)
            i += 1
    while start < len(kept):
        end = start + 1
        while end < len(kept) and combining(kept[end]):
            end += 1
        at += [places[start]] * (len(fold(kept[start:end])) if kept[start] != JOINER else 1)
        start = end
    return [*at, len(text)]


def path(costs: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The language of each unit on the cheapest way through a document's units, each change costing ``switch``."""
    first = costs.argmin(axis=1)
    if (first == first[0]).all():
        return first
    total, back = costs[0].copy(), []
    for row in costs[1:]:
        stay, jump = total, total.min() + switch
        back.append(np.where(stay <= jump, np.arange(len(row)), total.argmin()))
        total = np.minimum(stay, jump) + row
    at = int(total.argmin())
    out = [at]
    for step in reversed(back):
        at = int(step[at])
        out.append(at)
    return np.array(out[::-1])


def paths(profiles: Profiles, texts) -> Iterator[tuple[int, list[tuple[int, int, list[str]]], np.ndarray, np.ndarray]]:
    """(number, units, languages, costs) of each text that has language; texts are compared many at a time."""
    held: list[tuple[int, list]] = []
    size = 0

    def done():
        costs = profiles.costs([u[2] for _, found in held for u in found])
        at = 0
        for number, found in held:
            own = costs[at : at + len(found)]
            at += len(found)
            yield number, found, path(own), own

    for number, text in enumerate(texts):
        found = _sentences(text)[1]
        if found:
            held.append((number, found))
            size += len(text)
            if size > BATCH_CHARS:
                yield from done()
                held, size = [], 0
    if held:
        yield from done()


def _confidence(cost: np.ndarray, best: int, n: int) -> float:
    """How much further out of place the next language is than the chosen one, from 0 to 1."""
    other = np.delete(cost, best).min()
    return float(np.clip((other - cost[best]) / max(other, 1e-9), 0, 1)) if n else 0.0


def _sum_grams(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: Counter = Counter()
    for frame in frames:
        for lang, word, n in zip(frame["lang"], frame["word"], frame["n"]):
            for form in {word, _plain(word)}:
                for g in grams(form):
                    total[lang, g] += n
        if len(total) > 500_000:
            yield pd.DataFrame([(a, b, n) for (a, b), n in total.items()], columns=["lang", "gram", "n"])
            total.clear()
    yield pd.DataFrame([(a, b, n) for (a, b), n in total.items()], columns=["lang", "gram", "n"])


def _top(words: DataFrame) -> pd.DataFrame:
    counted = words.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    ngrams = counted.mapInPandas(_sum_grams, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return ngrams.withColumn("place", place - 1).filter(F.col("place") < PROFILE).select("lang", "gram", "place").toPandas()


def _hash_limits(labelled: DataFrame, sample: int) -> dict[str, int]:
    """The ``sample``-th smallest hash of each language, the largest if it has fewer documents.

    A share of the hashes that holds somewhat more than the sample is read off the counts, so that neither a window nor a task
    ever holds a language's documents; it is doubled until it does hold them.
    """
    counts = {r[0]: r[1] for r in labelled.groupBy("__lang").agg(F.count("*")).collect()}
    limits, share = {}, 1.5
    while counts:
        near = F.lit(False)
        for code, n in counts.items():
            near |= (F.col("__lang") == code) & (F.col("__hash") <= F.lit(min(2**63 - 1, int(-(2**63) + 2**64 * share * (sample + 20) / n))))
        for code, hashes in labelled.filter(near).toPandas().groupby("__lang")["__hash"]:
            if len(hashes) >= min(sample, counts[code]):
                limits[code] = int(np.sort(hashes.to_numpy())[min(sample, counts.pop(code)) - 1])
        share *= 2
    return limits


def fit(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE_DOCS) -> Profiles:
    """Profiles from labelled documents, at most ``sample`` whole documents of each language, those of the smallest hashes of their id.

    Labels may be wrong and documents mixed, so it is done twice: the second profiles count only units
    that the first ones, too, put into the labelled language.  Words without their accents count along.
    """
    known = documents.filter(F.col(text).isNotNull()).withColumn("__lang", label_language(F.col(lang))).filter("__lang is not null").withColumn("__hash", F.xxhash64(key))
    limits = _hash_limits(known.select("__lang", "__hash"), sample)
    within = F.lit(False)
    for code, most in limits.items():
        within |= (F.col("__lang") == code) & (F.col("__hash") <= F.lit(most))
    texts = known.filter(within).select(F.col(text).alias("text"), F.col("__lang").alias("lang"))
    chosen = cut(texts.repartition(texts.sparkSession.sparkContext.defaultParallelism, "text"))

    def count(profiles: Profiles | None):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                total: Counter = Counter()
                if profiles is None:
                    for body, own in zip(frame["text"], frame["lang"]):
                        total.update((own, w) for _, _, words in _sentences(body)[1] for w in words)
                else:
                    langs = list(frame["lang"])
                    for number, found, best, _ in paths(profiles, frame["text"]):
                        own = langs[number]
                        total.update((own, w) for u, b in zip(found, best) if profiles.languages[b] == own for w in u[2])
                yield pd.DataFrame([(a, b, n) for (a, b), n in total.items()], columns=["lang", "word", "n"])

        return run

    first = Profiles(_top(chosen.mapInPandas(count(None), "lang string, word string, n long")))
    return Profiles(_top(chosen.mapInPandas(count(first), "lang string, word string, n long")))


def stretches(documents: DataFrame, profiles: Profiles, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``key``, seg_no, lang, start, end, letters, confidence) of each stretch in one language, numbered from 1.

    ``start`` and ``end`` are places in the text itself.  Texts without language (null, empty,
    blank, codes, logs, pictures) have no row.  ``confidence`` compares the distance of the language with that of the next best.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            ids, bodies = list(frame[key]), list(frame["text"])
            for number, solid, best, costs in paths(profiles, bodies):
                rid, body = ids[number], bodies[number]
                place = range(len(body) + 1) if body.isascii() or fold(body) == body else origins(body)
                edges = np.flatnonzero(np.diff(best)) + 1
                for no, part in enumerate(np.split(np.arange(len(best)), edges), 1):
                    cost = costs[part].sum(axis=0)
                    size = sum(len(w) for i in part for w in solid[i][2])
                    rows.append((rid, no, profiles.languages[best[part[0]]], place[solid[part[0]][0]], place[solid[part[-1]][1]], size, _confidence(cost, best[part[0]], size)))
            yield pd.DataFrame(rows, columns=[key, "seg_no", "lang", "start", "end", "letters", "confidence"])

    rows = spread(documents.select(F.col(key), F.col(text).alias("text")), key)
    return rows.mapInPandas(run, f"{key} {dict(documents.dtypes)[key]}, seg_no int, lang string, start int, end int, letters int, confidence double")


def assign(documents: DataFrame, profiles: Profiles | None = None, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(``key``, labelled, lang, confidence, stretches): every document's label as a code, and the language of most of its text.

    ``lang`` is null for a text without language.  ``stretches`` is an array of the language runs in order.
    """
    profiles = profiles or fit(documents, key, text, lang)
    parts = stretches(documents.select(key, F.col(text).alias("text")), profiles, key)
    by = parts.groupBy(key, "lang").agg(F.sum("letters").alias("letters"), F.sum(F.col("confidence") * F.col("letters")).alias("weight"), F.collect_list(F.struct("seg_no", "lang", "start", "end", "confidence")).alias("runs"))
    main = by.groupBy(key).agg(
        F.max(F.struct("letters", "lang", "weight")).alias("top"), F.sum("letters").alias("all"), F.array_sort(F.flatten(F.collect_list("runs"))).alias("stretches")
    )
    main = main.select(key, F.col("top.lang").alias("lang"), (F.col("top.weight") / F.col("all")).alias("confidence"), "stretches")
    return documents.select(key, label_language(F.col(lang)).alias("labelled")).join(main, key, "left")


def found(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(``key``, seg_no, lang): seg_no 0 where the label is missing or not the language of most of the text; 1, 2, … the stretches of mixed documents."""
    got = assign(documents, None, key, text, lang).filter("lang is not null")
    wrong = F.when(F.col("labelled").isNull() | (F.col("labelled") != F.col("lang")), F.array(F.struct(F.lit(0).alias("seg_no"), F.col("lang").alias("lang"))))
    mixed = F.when(F.size("stretches") > 1, F.transform("stretches", lambda s: F.struct(s["seg_no"].alias("seg_no"), s["lang"].alias("lang"))))
    empty = F.expr("cast(array() as array<struct<seg_no:int,lang:string>>)")
    return got.select(key, F.explode(F.concat(F.coalesce(wrong, empty), F.coalesce(mixed, empty))).alias("x")).select(key, F.col("x.seg_no").alias("seg_no"), F.col("x.lang").alias("lang"))
