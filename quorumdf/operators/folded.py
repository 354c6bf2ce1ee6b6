"""Products of tf-idf rows for all folds at once, without a vocabulary in one place.

The students of k folds read mostly the same rows, so each text is cut into terms once.  The terms are dealt out to blocks by a
hash; a block numbers its own terms and counts their documents by fold, so for every fold it has the idf of the rows
outside that fold.  What a step needs of a fold are those idfs and the lengths of the rows under them.  The rows of
the fold itself stand in the blocks too: their product with the coefficients of the others is their score.
"""

from __future__ import annotations

import os
import pickle
import shutil
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumdf.operators import dual
from quorumdf.operators.features import CharTerms, WordTerms
from quorumdf.plans.skew import cut, dropped, local_path, shared_dir

#: Rows whose terms a task deals out at once.
DEALT_ROWS = 2_000
#: Of so many blocks one is of words, the others are of characters.
WORD_SHARE = 8


class FoldedProducts:
    """X X' r for each of ``k`` folds, X being the tf-idf features as a student has them that is fitted on the rows outside the fold.

    ``rows`` is a table with ``__id``, ``fold`` and the text; ``ids`` are its ids in the order of the rows here.  The driver holds
    some numbers a row, a task one block at a time.  Blocks are files where the shared folder has a path, else a table.
    """

    def __init__(self, rows: DataFrame, text: str, k: int, min_df: float = 1.0):
        self.spark = rows.sparkSession
        self.tasks, self.k = self.spark.sparkContext.defaultParallelism, k
        sizes = {r["fold"]: r["n"] for r in rows.groupBy("fold").agg(F.count("*").alias("n")).collect()}
        self.n = sum(sizes.values())
        self.seen = [self.n - sizes.get(f, 0) for f in range(k)]
        self.least = [min_df if min_df >= 1 else min_df * n for n in self.seen]
        self.blocks = max(4 * self.tasks, -(-self.n // dual.BLOCK_ROWS))
        at = shared_dir(self.spark)
        self.folder = f"{local_path(at)}/folded-{uuid.uuid4().hex}" if at.startswith(("file:", "/")) else None
        if self.folder:
            os.makedirs(self.folder)
        self.stored = self._stored(rows, text)
        self.ids = np.frombuffer(self.stored.filter("part = 0").select("ids").first()[0], np.int64)
        self.scale = self.spark.sparkContext.broadcast(self._scale())

    def _stored(self, rows: DataFrame, text: str) -> DataFrame:
        count, folder, k, seen, least = self.blocks, self.folder, self.k, self.seen, self.least
        words = max(1, count // WORD_SHARE)
        kept = ["ids", "folds", "sizes", "cols", "tf", "terms"]

        def deal(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, DEALT_ROWS):
                    yield from dealt(batch.slice(at, DEALT_ROWS))

        def dealt(batch):
            ids, folds = batch.column("__id").to_numpy(), batch.column("fold").to_numpy().astype(np.int32)
            n = len(ids)
            for name, first, own in (("__word", 0, words), ("__char", words, count - words)):
                listed = batch.column(name)
                coded = listed.flatten().dictionary_encode()
                terms = coded.dictionary.to_pylist()
                row = np.repeat(np.arange(n), np.diff(listed.offsets.to_numpy()))
                pair, tf = np.unique(row * max(1, len(terms)) + coded.indices.to_numpy(), return_counts=True)
                row, term = np.divmod(pair, max(1, len(terms)))
                part = np.fromiter((zlib.crc32(t.encode()) % own for t in terms), np.int64, len(terms))
                place, of_part = np.zeros(len(terms), np.int64), []  # the terms of a part are numbered inside it
                for p in range(own):
                    inside = np.flatnonzero(part == p)
                    place[inside] = np.arange(len(inside))
                    of_part.append("\n".join(terms[i] for i in inside).encode())  # no term holds a line break
                owner = part[term]
                order = np.argsort(owner, kind="stable")  # the rows stay in order inside a part
                edges = np.searchsorted(owner[order], np.arange(own + 1))
                out = []
                for p in range(own):
                    at = order[edges[p] : edges[p + 1]]
                    arrays = ids.astype(np.int64)[: n if first + p == 0 else 0], folds, np.bincount(row[at], minlength=n).astype(np.int32), place[term[at]].astype(np.int32), tf[at].astype(np.int32)
                    out.append((first + p, int(ids[0]), *[x.tobytes() for x in arrays], of_part[p]))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int64(), *[pa.binary()] * 6))], ["part", "first", *kept])

        def join(batches):
            pieces = sorted((tuple(r.values()) for b in batches for r in b.to_pylist()), key=lambda r: r[:2])
            if not pieces:
                return
            part, numbers = pieces[0][0], {}
            cols = []
            for piece in pieces:
                terms = piece[7].decode().split("\n") if piece[7] else []
                number = np.fromiter((numbers.setdefault(t, len(numbers)) for t in terms), np.int64, len(terms))
                cols.append(number[np.frombuffer(piece[5], np.int32)])
            folds, sizes, tf = (np.frombuffer(b"".join(r[i] for r in pieces), np.int32) for i in (3, 4, 6))
            cols = np.concatenate(cols)
            by_fold = np.bincount(cols * k + np.repeat(folds, sizes), minlength=len(numbers) * k).reshape(-1, k).T
            idf = np.zeros((k, len(numbers)))
            for f in range(k):
                df = by_fold.sum(axis=0) - by_fold[f]
                known = (df > 0) & (df >= least[f])
                idf[f, known] = np.log((1.0 + seen[f]) / (1.0 + df[known])) + 1.0
            held = np.flatnonzero(sizes)
            slim = lambda x: x.astype(np.min_scalar_type(int(x.max()))) if len(x) else x.astype(np.uint8)
            block = pickle.dumps((int(part >= words), slim(held), slim(sizes[held]), slim(cols), slim(tf), idf), 5)
            if folder:
                with tempfile.NamedTemporaryFile(dir=folder, delete=False) as file:
                    file.write(block)
                os.replace(file.name, f"{folder}/{part}")  # a task that runs twice leaves the same
            ids = b"".join(r[2] for r in pieces)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *[pa.array([x], pa.binary()) for x in (ids, b"" if folder else block)]], ["part", "ids", "block"])

        few = rows.select("__id", "fold", text).repartition(max(self.tasks, -(-self.n // DEALT_ROWS)), "__id")  # the terms of a task are twenty times its texts
        tokens = WordTerms(text, "__word").transform(CharTerms(text, "__char").transform(few))
        dealt_out = tokens.select("__id", "fold", "__word", "__char").mapInArrow(deal, "part int, first long, " + ", ".join(f"{c} binary" for c in kept))
        return cut(dealt_out.repartitionById(count, F.col("part")).mapInArrow(join, "part int, ids binary, block binary"))

    def _sum(self, step, shape: tuple[int, ...]) -> np.ndarray:
        """The sum over all blocks of what ``step`` adds to an array of that shape for (kind, rows with terms, their numbers of terms, columns, tf, idf)."""
        folder = self.folder

        def summed(blocks):
            out = np.zeros(shape)
            for kind, held, sizes, cols, tf, idf in map(pickle.loads, blocks):
                if len(cols):
                    step(out, kind, held.astype(np.intp), sizes.astype(np.intp), cols.astype(np.intp), tf.astype(np.float64), idf)
            return out.tobytes()

        def mapped(parts):
            def each():
                for part in parts:
                    with open(f"{folder}/{part}", "rb") as file:
                        yield file.read()

            yield summed(each())

        def run(batches):
            yield pa.RecordBatch.from_arrays([pa.array([summed(x.as_py() for b in batches for x in b.column(0))], pa.binary())], ["x"])

        if folder:
            got = self.spark.sparkContext.parallelize(range(self.blocks), self.tasks).mapPartitions(mapped).collect()
        else:
            got = self.stored.select("block").coalesce(self.tasks).mapInArrow(run, "x binary").toArrow().column("x").to_pylist()
        total = np.zeros(shape)
        for x in got:
            total += np.frombuffer(x).reshape(shape)
        return total

    def _scale(self) -> np.ndarray:
        """One over the length of each row's block of words and of characters under the idfs of each fold; of empty rows nothing."""
        k = self.k

        def step(out, kind, held, sizes, cols, tf, idf):
            starts = np.cumsum(sizes) - sizes
            for f in range(k):
                out[kind, f, held] += np.add.reduceat((tf * idf[f][cols]) ** 2, starts)

        squares = self._sum(step, (2, k, self.n))
        return np.where(squares > 0, 1 / np.sqrt(np.where(squares > 0, squares, 1.0)), 0.0)

    def times(self, asked: dict[tuple, np.ndarray]) -> dict[tuple, np.ndarray]:
        """The product of each r, under a key that begins with the fold; all in one job."""
        folds, widths, scale = [j[0] for j in asked], [r.shape[1] for r in asked.values()], self.scale
        sent = self.spark.sparkContext.broadcast(np.concatenate([r.T for r in asked.values()]))

        def step(out, kind, held, sizes, cols, tf, idf):
            starts, r, at = np.cumsum(sizes) - sizes, sent.value, 0
            for f, m in zip(folds, widths):
                own, square = scale.value[kind, f, held], idf[f] ** 2
                for i in range(at, at + m):
                    v = np.bincount(cols, tf * np.repeat(r[i, held] * own, sizes), len(square)) * square
                    out[i, held] += np.add.reduceat(tf * v[cols], starts) * own
                at += m

        total = self._sum(step, (sum(widths), self.n))
        sent.destroy()
        edges = np.cumsum(widths)
        return {j: total[e - m : e].T.copy() for j, e, m in zip(asked, edges, widths)}

    def gram(self, fold: int) -> np.ndarray:
        """X X' itself, for few rows."""
        n, scale = self.n, self.scale

        def step(out, kind, held, sizes, cols, tf, idf):
            row = np.repeat(held, sizes)
            out += dual.gram(row, cols, tf * idf[fold][cols] * scale.value[kind, fold, row], n)

        return self._sum(step, (n, n))

    def close(self) -> None:
        dropped(self.stored)
        if self.folder:
            shutil.rmtree(self.folder, ignore_errors=True)
