"""Same or near-same records across splits: an exact bipartite set-similarity join.

Every text is the set of its distinct lower-case words, each a shingle of its own.  Words are put into one
total order, rarest first by how many evaluation records hold them.  Two sets of similarity t share
a word within the first n - ceil(t * n) + 1 words of either, so only those prefixes are indexed and
probed, and of a training prefix only the words that stand in some evaluation prefix.  What meets is filtered by length, by position and by a 128-bit parity signature, whose distance
is never more than that of the sets, and the survivors are verified on their whole word sets.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorumdf.plans.skew import cut, join_groups

WORD = re.compile(r"\w+")
#: Size of the table of word frequencies that is broadcast: 4 bytes each, whatever the data.
BUCKETS = 1 << 20
#: Bits of the table of words in evaluation prefixes that is broadcast: 2 MB, whatever the data.
MARKS = 1 << 24
#: Candidate pairs up to which they are broadcast to fetch their texts; beyond that the texts are shuffled.
FEW_PAIRS = 200_000


def words(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


class _Hasher(dict):
    """Word to 64-bit hash; starts afresh when it has grown large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASH = _Hasher()


def _hashes(text: str) -> np.ndarray:
    """Sorted hashes of the distinct words."""
    out = np.fromiter((_HASH[w] for w in words(text)), np.uint64)
    out.sort()
    return out.view(np.int64)


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: np.ndarray = np.zeros(BUCKETS, np.int64)
    for frame in frames:
        for text in frame["text"]:
            if text:
                total[np.unique(_hashes(text) & (BUCKETS - 1))] += 1
    at = np.flatnonzero(total)
    yield pd.DataFrame({"bucket": at.astype(np.int32), "n": total[at]})


def frequencies(texts: DataFrame) -> np.ndarray:
    """How many records hold a word, by hash bucket: a vector of fixed length, summed before it reaches the driver."""
    rows = texts.select("text").mapInPandas(_count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS, np.int32)
    out[rows["bucket"].to_numpy()] = np.minimum(rows["n"].to_numpy(), np.iinfo(np.int32).max)
    return out


def prefix_length(n: int, least: float) -> int:
    return n - math.ceil(least * n - 1e-9) + 1


def signature(hashes: np.ndarray) -> tuple[int, int]:
    """For each of 128 bits, whether an odd number of words falls on it: one differing word flips one bit."""
    bits = np.bincount((hashes >> 20) & 127, minlength=128) & 1
    return tuple(int(x) for x in np.packbits(bits.astype(np.uint8)).view(np.int64))


def _ordered(hashes: np.ndarray, table: np.ndarray, least: float) -> np.ndarray:
    """The prefix: the first words in the total order, rarest in the evaluation records first."""
    return hashes[np.lexsort((hashes, table[hashes & (BUCKETS - 1)]))[: prefix_length(len(hashes), least)]]


def _mark(frequency, least: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(MARKS, bool)
        for frame in frames:
            for text in frame["text"]:
                if text and len(hashes := _hashes(text)):
                    seen[_ordered(hashes, frequency.value, least) & (MARKS - 1)] = True
        yield pd.DataFrame({"mark": np.flatnonzero(seen).astype(np.int32)})

    return run


def prefix_words(texts: DataFrame, frequency, least: float) -> np.ndarray:
    """Bits of the words that stand in the prefix of some record, by hash: a vector of fixed length."""
    out = np.zeros(MARKS, bool)
    out[texts.select("text").mapInPandas(_mark(frequency, least), "mark int").distinct().toPandas()["mark"].to_numpy()] = True
    return np.packbits(out)


def _prefixes(frequency, marks, least: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, marked = frequency.value, marks.value
        for frame in frames:
            rows = []
            for rid, text in zip(frame["id"], frame["text"]):
                hashes = _hashes(text) if text else ()
                n = len(hashes)
                if not n:
                    continue
                prefix = _ordered(hashes, table, least)
                at = prefix & (MARKS - 1)
                place = np.flatnonzero(marked[at >> 3] >> (7 - (at & 7)) & 1)
                if len(place):  # else it shares no prefix word with any evaluation record
                    rows.append((rid, xxhash.xxh128_hexdigest(hashes.tobytes()), n, prefix[place], place.astype(np.int32), *signature(hashes)))
            yield pd.DataFrame(rows, columns=["id", "own", "size", "tokens", "places", "s1", "s2"])

    return run


def _classes(rows: DataFrame) -> DataFrame:
    """One row per distinct word set: ``own``, its first row ``rep``, ``n``, and what the join needs."""
    return rows.groupBy("own").agg(F.min("id").alias("rep"), F.count("*").alias("n"), *[F.any_value(c).alias(c) for c in ("size", "tokens", "places", "s1", "s2")])


def _postings(classes: DataFrame, tag: str) -> DataFrame:
    flat = classes.select("rep", "size", "s1", "s2", F.explode(F.arrays_zip("tokens", "places")).alias("x"))
    return flat.select(F.col("x.tokens").alias("token"), F.col("x.places").alias(f"place_{tag}"), *[F.col(c).alias(f"{c}_{tag}") for c in ("rep", "size", "s1", "s2")])


@F.pandas_udf(T.DoubleType())
def _similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([len(x & y) / max(1, len(x | y)) for x, y in zip(map(words, a), map(words, b))], dtype=float)


def class_pairs(evaluation: DataFrame, training: DataFrame, least: float = 0.8) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, eval_members, train_members).

    ``pairs(own_e, own_t, similarity, n_e, n_t)`` links distinct word sets; the members give
    the ``own`` of each row ``id`` that may match.  Both inputs are (id, text).  Rows without any word
    (null, empty, punctuation only) take part in nothing.
    """
    table = evaluation.sparkSession.sparkContext.broadcast(frequencies(evaluation))
    shape = "id {}, own string, size int, tokens array<bigint>, places array<int>, s1 bigint, s2 bigint"
    marks = evaluation.sparkSession.sparkContext.broadcast(prefix_words(evaluation, table, least))
    e_rows, t_rows = (cut(x.mapInPandas(_prefixes(table, marks, least), shape.format(dict(x.dtypes)["id"]))) for x in (evaluation, training))
    e_classes, t_classes = cut(_classes(e_rows)), cut(_classes(t_rows))
    both = F.col("size_e") + F.col("size_t")
    overlap = F.ceil(F.lit(least / (1 + least)) * both - 1e-9)
    # The first word that two sets share has all their common words at or after it in both orders.
    reach = 1 + F.least(F.col("size_e") - F.col("place_e") - 1, F.col("size_t") - F.col("place_t") - 1)
    apart = F.bit_count(F.col("s1_e").bitwiseXOR(F.col("s1_t"))) + F.bit_count(F.col("s2_e").bitwiseXOR(F.col("s2_t")))
    meets = _postings(t_classes, "t").join(_postings(e_classes, "e"), "token").filter(
        (F.col("size_t") >= F.lit(least) * F.col("size_e") - 1e-9) & (F.col("size_e") >= F.lit(least) * F.col("size_t") - 1e-9) & (reach >= overlap) & (apart <= both - 2 * overlap)
    )
    candidates = cut(meets.select("rep_e", "rep_t").distinct())
    few = candidates.count() <= FEW_PAIRS

    def fetch(rows: DataFrame, rep: str) -> DataFrame:
        ids = candidates.select(rep).distinct()
        return rows.join(F.broadcast(ids) if few else ids, F.col("id") == F.col(rep))

    e_text = fetch(evaluation, "rep_e").select("rep_e", F.col("text").alias("text_e")).dropDuplicates(["rep_e"])
    t_text = fetch(training, "rep_t").select("rep_t", F.col("text").alias("text_t")).dropDuplicates(["rep_t"])
    near = candidates.join(e_text, "rep_e").join(t_text, "rep_t").withColumn("similarity", _similarity("text_e", "text_t")).filter(F.col("similarity") >= least - 1e-9)
    near = cut(near.select("rep_e", "rep_t", "similarity"))
    named = near.join(e_classes.select(F.col("rep").alias("rep_e"), F.col("own").alias("own_e"), F.col("n").alias("n_e")), "rep_e").join(t_classes.select(F.col("rep").alias("rep_t"), F.col("own").alias("own_t"), F.col("n").alias("n_t")), "rep_t")
    return cut(named.select("own_e", "own_t", "similarity", "n_e", "n_t")), e_rows.select("id", "own"), t_rows.select("id", "own")


def pairs(evaluation: DataFrame, training: DataFrame, least: float = 0.8) -> DataFrame:
    """(eval_id, train_id, similarity): every pair of rows whose word sets have a Jaccard similarity of ``least`` or more.

    Equal word sets are joined once and expanded at the end; repeated rows each get their pairs.
    """
    linked, e_members, t_members = class_pairs(evaluation, training, least)
    left = linked.join(e_members.select(F.col("own").alias("own_e"), F.col("id").alias("eval_id")), "own_e").select("own_t", "similarity", "n_t", "eval_id")
    many = left.groupBy("own_t").agg(F.max("n_t").alias("n_t"))
    hit = join_groups(t_members.withColumnRenamed("own", "own_t"), many, ["own_t"], "n_t", t_members.count())
    # Rows of one hot class are dealt out over salts; the few evaluation rows it meets are repeated.
    salts = F.ceil(F.col("n_t") / 20_000).cast("int")
    right = hit.select("own_t", F.col("id").alias("train_id"), F.pmod(F.xxhash64("id"), salts).cast("int").alias("salt"))
    left = left.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("n_t")
    return left.join(right, ["own_t", "salt"]).select("eval_id", "train_id", "similarity")
