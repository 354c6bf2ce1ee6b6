"""Visually identical text with different characters: one consistent spelling for all of it.

The vocabulary of the corpus, as it is spelled, is put into tries.  A weighted edit automaton
reads a token sign by sign against a trie: a sign costs nothing where it looks like the letter
of the edge (another script, a width form, an accent written apart), like several edges in a
row (a ligature, a digraph, a Roman numeral) or like nothing at all (an invisible character);
any other step costs one.  The words reached within a budget of zero are the spellings that look like the
token; the canonical one is chosen among them, and a token without any is normalized by the
character table.
"""

from __future__ import annotations

import heapq
import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorumdf.llm.chars import fold, fold_char, joined, script_of
from quorumdf.plans.skew import cut

#: Words and tokens that one trie is built of and asked for, at most, unless more have one skeleton.
TRIE_WORDS = 20_000
#: Words (or spellings, or groups) up to which they are broadcast; beyond that they are joined by a shuffle.
FEW = 200_000
#: Rows of one text that are joined in one task.
PER_SALT = 20_000
SPACES = r"[ \t\n\r\x0b\x0c]+"

# Letters drawn like a second Latin letter besides that of the table.
_SECOND = {"l": "\u04c0\u0406\u0399", "I": "\u04cf"}
_SECOND_OF = {c: letter for letter, others in _SECOND.items() for c in others}


def _digraph(c: str) -> str:
    """The letters that a ligature, digraph or Roman numeral is drawn as; '' for any other character."""
    if "\u0132" <= c <= "\u0149" or "\u01c4" <= c <= "\u01cc" or "\u01f1" <= c <= "\u01f3" or "\u2160" <= c <= "\u217f":
        shape = unicodedata.normalize("NFKD", c)
        return shape if len(shape) > 1 or "\u2160" <= c else ""
    return ""


def readings(token: str) -> list[tuple[str, ...]]:
    """For each sign of the decomposed token what it can be read as: letters in a row, '' for nothing; that of the table first."""
    out = []
    for c in joined(unicodedata.normalize("NFD", token)):
        more = [_SECOND_OF[c]] if c in _SECOND_OF else []
        if wide := _digraph(c):
            more.append("".join(map(fold_char, wide)))
        out.append((fold_char(c) if c != "\u200d" else c, *more))
    return out


def skeleton(token: str) -> str:
    """A form that all tokens share which the automaton could match at no cost, and some more."""
    if not token.isascii():
        token = unicodedata.normalize("NFC", "".join(r[-1] for r in readings(token)))
    return token.replace("I", "l")


class Trie:
    """Words as they are spelled, decomposed; the edges of a node are found by what they look like."""

    def __init__(self, words: Iterable[str] = ()):
        self.kids: list[dict[str, dict[str, int]]] = [{}]  # node -> look -> character -> node
        self.ends: list[list[str]] = [[]]
        for word in words:
            self.add(word)

    def add(self, word: str) -> None:
        node = 0
        for c in unicodedata.normalize("NFD", word):
            alike = self.kids[node].setdefault(fold_char(c), {})
            step = alike.get(c)
            if step is None:
                step = alike[c] = len(self.kids)
                self.kids.append({})
                self.ends.append([])
            node = step
        if word not in self.ends[node]:
            self.ends[node].append(word)

    def _follow(self, node: int, letters: str) -> list[int]:
        nodes = [node]
        for x in letters:
            nodes = [step for n in nodes for step in self.kids[n].get(x, {}).values()]
        return nodes

    def search(self, token: str, budget: int = 0) -> dict[str, int]:
        """All words within ``budget`` of the token and their cost; states (place in the token, node) are settled by rising cost."""
        signs = readings(token)
        best: dict[tuple[int, int], int] = {}
        heap = [(0, 0, 0)]
        found: dict[str, int] = {}
        while heap:
            cost, at, node = heapq.heappop(heap)
            if best.get((at, node), budget + 1) <= cost:
                continue
            best[at, node] = cost
            if at == len(signs):
                for word in self.ends[node]:
                    found.setdefault(word, cost)
            else:
                for letters in signs[at]:
                    for step in self._follow(node, letters):
                        heapq.heappush(heap, (cost, at + 1, step))
            if cost < budget:
                if at < len(signs):
                    heapq.heappush(heap, (cost + 1, at + 1, node))
                for alike in self.kids[node].values():
                    for step in alike.values():
                        heapq.heappush(heap, (cost + 1, at, step))
                        if at < len(signs):
                            heapq.heappush(heap, (cost + 1, at + 1, step))
        return found


def is_clean(token: str) -> bool:
    """A token that may serve as a spelling: composed, nothing invisible or wide, letters of one script."""
    if token.isascii():
        return True
    if unicodedata.normalize("NFC", token) != token:
        return False
    for c in token:
        if unicodedata.category(c) in ("Cf", "Zs") or unicodedata.decomposition(c).startswith("<") or "︀" <= c <= "️":
            return False
    return len({script_of(c) for c in token} - {""}) <= 1


def canonical(token: str, spellings: Iterable[str]) -> str:
    """The spelling to take: one that the table reads like the token before others, the fewest characters beyond ASCII, the first by code point; the table form if there is none."""
    own = fold(token)
    return min(spellings, key=lambda w: (fold(w) != own, sum(c > "\x7f" for c in w), w), default=own)


def split_spaces(text: str) -> list[str]:
    """Tokens and the white space between them, alternating, starting with a token (perhaps empty)."""
    return list(_pieces(text))


def _pieces(text: str) -> Iterator[str]:
    start, space = 0, False
    for i, c in enumerate(text):
        now = c.isspace()
        if now != space:
            yield text[start:i]
            start, space = i, now
    yield text[start:]


def _odd_tokens(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        seen = {t for text in frame["text"] for t in split_spaces(text)[::2] if t and not t.isascii()}
        if seen:
            words = sorted(seen)
            yield pd.DataFrame({"token": words, "skeleton": [skeleton(t) for t in words], "clean": [is_clean(t) for t in words]})


def _walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by skeleton, possible spellings first; a trie holds those of as many skeletons as fill it.

    Only spellings that the table alone would not give are returned.
    """
    last, clean, odd = None, [], []

    def done() -> pd.DataFrame:
        trie = Trie(clean)
        chosen = [(t, canonical(t, trie.search(t))) for t in odd]
        return pd.DataFrame([(t, c) for t, c in chosen if c != fold(t)], columns=["token", "spelling"])

    for frame in frames:
        for token, own, good in zip(frame["token"], frame["skeleton"], frame["clean"]):
            if own != last and len(clean) + len(odd) >= TRIE_WORDS:
                yield done()
                clean, odd = [], []
            elif len(odd) >= 2 * TRIE_WORDS and not good:  # very many tokens of one skeleton: its spellings are all there
                yield done()
                odd = []
            last = own
            if good:
                clean.append(token)
            if not token.isascii():
                odd.append(token)
    if odd:
        yield done()


def beyond_ascii(column: Column) -> Column:
    """Whether a text has a character beyond ASCII: it has more bytes than characters then."""
    return F.octet_length(column) != F.length(column)


def _few(rows: DataFrame) -> DataFrame:
    """``rows``, a written table, marked for broadcast if there are few."""
    return F.broadcast(rows) if rows.count() <= FEW else rows


def spelling_table(texts: DataFrame) -> DataFrame:
    """(token, spelling) of the distinct tokens with a character beyond ASCII in ``texts.text`` whose spelling is not what the table gives.

    Only distinct tokens are shuffled.  A token and the words it can match share a skeleton, by which they are dealt out
    and sorted, so no task and no trie holds more than a bounded number of them.  ASCII tokens are spellings of
    themselves; of them only those with the skeleton of an odd token are sent.
    """
    odd = cut(texts.filter(beyond_ascii(F.col("text"))).select("text").mapInPandas(_odd_tokens, "token string, skeleton string, clean boolean").distinct())
    wanted = cut(odd.filter(~beyond_ascii(F.col("skeleton"))).select("skeleton").distinct())
    plain = (
        texts.filter("text is not null")
        .select(F.explode(F.split("text", SPACES)).alias("token"))
        .filter((F.col("token") != "") & ~beyond_ascii(F.col("token")))
        .withColumn("skeleton", F.translate("token", "I", "l"))
        .join(_few(wanted), "skeleton", "left_semi")
        .select("token", "skeleton", F.lit(True).alias("clean"))
        .distinct()
    )
    both = odd.unionByName(plain).repartition("skeleton").sortWithinPartitions("skeleton", F.desc("clean"))
    return both.mapInPandas(_walk, "token string, spelling string")


def _odd_of_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = [(rid, t) for rid, text in zip(frame["__rid"], frame["text"]) for t in set(split_spaces(text)[::2]) if not t.isascii()]
        yield pd.DataFrame(rows, columns=["__rid", "part"])


def _respelled(text: str, table: dict[str, str]) -> str:
    pieces = split_spaces(text)
    pieces[::2] = [table.get(t) or fold(t) for t in pieces[::2]]
    pieces[1::2] = map(fold, pieces[1::2])
    return "".join(pieces)


@F.pandas_udf(T.StringType())
def _respell(texts: pd.Series, parts: pd.Series, spellings: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else _respelled(t, {} if own is None else dict(zip(own, new))) for t, own, new in zip(texts, parts, spellings)])


def normalize(df: DataFrame, key: str, text: str = "text", out: str = "normal") -> DataFrame:
    """``df`` with a column ``out`` in which texts that look the same are equal.

    ``key`` must be unique.  A null text stays null, an empty one empty.  ASCII texts are
    passed through inside the JVM; only texts with other characters are taken apart,
    respelled token by token with :func:`spelling_table` and put together again.
    White space inside a text is kept; special spaces become ordinary ones.
    """
    column = F.col(text)
    spelled = cut(spelling_table(df.select(column.alias("text"))))
    if out in df.columns and out != text:
        df = df.drop(out)
    if spelled.count() <= FEW:  # the usual case: where it lies, each text is put together with the table of spellings
        shared = df.sparkSession.sparkContext.broadcast(dict(spelled.toPandas().itertuples(index=False, name=None)))

        @F.pandas_udf(T.StringType())
        def respell(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: _respelled(t, shared.value), na_action="ignore")

        return df.withColumn(out, F.coalesce(respell(F.when(beyond_ascii(column), column)), column))
    odd = df.select(F.col(key).alias("__rid"), column.alias("text")).filter(beyond_ascii(F.col("text")))
    parts = odd.mapInPandas(_odd_of_rows, f"__rid {dict(df.dtypes)[key]}, part string")
    tables = parts.join(spelled.withColumnRenamed("token", "part"), "part").groupBy("__rid").agg(F.collect_list(F.struct("part", "spelling")).alias("t"))
    tables = tables.select(F.col("__rid").alias(key), F.col("t.part").alias("__own"), F.col("t.spelling").alias("__new"))
    plain = df.filter(column.isNull() | ~beyond_ascii(column)).withColumn(out, column)
    rest = df.filter(beyond_ascii(column)).join(tables, key, "left").withColumn(out, _respell(column, "__own", "__new")).drop("__own", "__new")
    return plain.unionByName(rest)


def classes(df: DataFrame, key: str = "pool_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(members, links): ``members(id, own)`` of each row that looks like a row of other characters, ``own`` standing for its exact text,
    and ``links(few, many, n_few, n_many)``, each two texts that look the same, the one of fewer rows first.

    Rows are told apart by 128-bit hashes of text and normal form.  In a group of rows that look the same at least one
    differs from its normal form, so only the groups of such rows go on.
    """
    named = normalize(df.select(F.col(key).alias("id"), F.col(text).alias("text")).filter("text is not null"), "id")
    rows = cut(named.select("id", F.md5("normal").alias("group"), F.md5("text").alias("own")))
    changed = cut(rows.filter("own <> group").select("group").distinct())
    texts = rows.join(_few(changed), "group", "left_semi").groupBy("group", "own").agg(F.count("*").alias("n"))
    texts = cut(texts)
    several = cut(texts.groupBy("group").agg(F.count("*").alias("texts")).filter("texts > 1").select("group"))
    texts = texts.join(_few(several), "group", "left_semi")
    a = texts.select("group", F.col("own").alias("few"), F.col("n").alias("n_few"))
    b = texts.select("group", F.col("own").alias("many"), F.col("n").alias("n_many"))
    links = a.join(b, "group").filter((F.col("n_few") < F.col("n_many")) | ((F.col("n_few") == F.col("n_many")) & (F.col("few") < F.col("many"))))
    return rows.join(_few(several), "group", "left_semi").select("id", "own"), links.select("few", "many", "n_few", "n_many")


def pairs(df: DataFrame, key: str = "pool_id", text: str = "text", per_salt: int = PER_SALT) -> DataFrame:
    """(``key``_a, ``key``_b): each pair of rows that look the same but differ in characters, smaller key first.

    Different texts are linked once; equal texts never meet.  Each link is then expanded to its rows: first
    those of the rarer text, which are repeated over salts of about ``per_salt`` rows of the other, so no task holds a hot text.
    Null texts look like nothing and give no pair.
    """
    members, links = classes(df, key, text)
    members, links = cut(members), cut(links)
    left = links.join(members.select(F.col("own").alias("few"), F.col("id").alias("a")), "few")
    salts = F.ceil(F.col("n_many") / per_salt).cast("int")
    left = left.select("a", "many", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    sizes = links.groupBy("many").agg(F.max("n_many").alias("n_many"))
    right = members.select(F.col("own").alias("many"), F.col("id").alias("b")).join(_few(cut(sizes)), "many")
    right = right.select("many", "b", F.pmod(F.xxhash64("b"), salts).cast("int").alias("salt"))
    met = left.join(right, ["many", "salt"])
    return met.select(F.least("a", "b").alias(f"{key}_a"), F.greatest("a", "b").alias(f"{key}_b"))
