"""Filling containers of fixed capacity: first-fit decreasing in randomised groups of documents."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumdf.llm.bpe import TOKENIZERS, lengths
from quorumdf.plans.skew import cut

#: Documents that one group holds on average.  At this size the waste of a group's last bin is far below one per cent.
GROUP_DOCS = 4000
MOST_KINDS = 1000


class BinTree:
    """Tournament tree over the space left in the bins of one group; each inner node holds the larger of its two."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.width = 1
        self.tree = [0, capacity]
        self.bins = 0

    def _grow(self) -> None:
        leaves = self.tree[self.width :] + [self.capacity] * self.width
        self.width *= 2
        self.tree = [0] * self.width + leaves
        for k in range(self.width - 1, 0, -1):
            self.tree[k] = max(self.tree[2 * k], self.tree[2 * k + 1])

    def put(self, size: int) -> int:
        """Put an item into the first bin with room for it and return that bin."""
        if self.tree[1] < size:
            self._grow()
        tree, k = self.tree, 1
        while k < self.width:
            k *= 2
            if tree[k] < size:
                k += 1
        at = k - self.width
        tree[k] -= size
        while k > 1:
            k //= 2
            tree[k] = max(tree[2 * k], tree[2 * k + 1])
        self.bins = max(self.bins, at + 1)
        return at


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item; items of equal size keep their order."""
    tree = BinTree(capacity)
    out = np.empty(len(sizes), np.int32)
    for i in np.argsort(-sizes, kind="stable"):
        out[i] = tree.put(int(sizes[i]))
    return out


def pieces(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, piece number, size): an item above the capacity is cut into full pieces and a rest, any other is one piece."""
    counts = np.maximum(1, -(-sizes // capacity))
    row = np.repeat(np.arange(len(sizes)), counts)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    return row, piece, np.minimum(capacity, sizes[row] - piece * capacity)


def pack(items: DataFrame, containers: DataFrame, key: str = "doc_id", size: str = "tokens", group_docs: int = GROUP_DOCS, seed: int = 7) -> DataFrame:
    """(container, bin_group, bin, ``key``, piece, start, tokens): every item in a bin of every container kind.

    Items are dealt by a hash of their key into groups of about ``group_docs``; each group
    is packed on its own by first-fit decreasing, so a group is one bounded task whatever the
    data.  A bin is named by (container, bin_group, bin).  An item is cut only if it alone exceeds the
    capacity; ``start`` is the offset of a piece in its item.  An item of size zero (a null or empty text) takes no
    room and lies in the first bin with any.  Containers with a null capacity or one below 1 are left out; a
    repeated container row counts once, one with several capacities by its largest.
    """
    kinds = [tuple(r) for r in containers.filter("capacity >= 1").groupBy("container").agg(F.max("capacity").cast("int").alias("capacity")).orderBy("container").take(MOST_KINDS + 1)]
    if len(kinds) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} kinds of container")
    groups = max(1, -(-items.count() // group_docs))
    dealt = items.select(F.col(key).alias("item"), F.coalesce(F.col(size), F.lit(0)).cast("int").alias("tokens"), F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(groups)).cast("int").alias("bin_group"))
    kind = dict(items.dtypes)[key]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("item", kind="stable")
        sizes = frame["tokens"].to_numpy(np.int64)
        out = []
        for name, capacity in kinds:
            row, piece, part = pieces(sizes, capacity)
            out.append(
                pd.DataFrame(
                    {"container": name, "bin_group": frame["bin_group"].iloc[0], "bin": first_fit_decreasing(part, capacity), key: frame["item"].to_numpy()[row], "piece": piece.astype(np.int32), "start": (piece * capacity).astype(np.int32), "tokens": part.astype(np.int32)}
                )
            )
        return pd.concat(out)

    shape = f"container string, bin_group int, bin int, {key} {kind}, piece int, start int, tokens int"
    if not kinds:
        return items.sparkSession.createDataFrame([], shape)
    # The kinds are worked off inside the task, so items are shuffled once and not once a kind.
    # Each group is a task of its own or shares one with a few; small shuffles are else joined into one task for all groups.
    tasks = min(groups, 4 * items.sparkSession.sparkContext.defaultParallelism) if groups < 4096 else 0
    return (dealt.repartition(tasks, "bin_group") if tasks else dealt).groupBy("bin_group").applyInPandas(run, shape)


def pack_documents(documents: DataFrame, containers: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", directory: str = TOKENIZERS, **options) -> DataFrame:
    """:func:`pack` of texts by their number of tokens; texts are tokenized once for all containers."""
    return pack(cut(lengths(documents, key, text, name, directory)), containers, key, "tokens", **options)


def fill(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """(container, bins, tokens, filled): how many bins each kind took and which share of their room is used."""
    bins = packed.groupBy("container", "bin_group", "bin").agg(F.sum("tokens").alias("used"))
    totals = bins.groupBy("container").agg(F.count("*").alias("bins"), F.sum("used").alias("tokens"))
    kinds = containers.filter("capacity >= 1").groupBy("container").agg(F.max("capacity").alias("capacity"))
    return totals.join(F.broadcast(kinds), "container").select("container", "bins", "tokens", (F.col("tokens") / (F.col("bins") * F.col("capacity"))).alias("filled"))
