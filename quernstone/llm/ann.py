"""Nearest neighbours of every vector by a block matrix join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import col, cut, kind_of, shuffle_partitions, small

def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scale, error) of each row: x is about codes * scale, and error is the length of what is left."""
    scale = np.abs(x).max(axis=1) / 127.0
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(x - codes * scale[:, None], axis=1)
    return codes, scale, error


class Heaps:
    """The k greatest (similarity, then least number) of each row, as bounded heaps held in arrays."""

    def __init__(self, rows: int, k: int):
        self.k = k
        self.similarity, self.numbers = np.full((rows, k), -np.inf), np.full((rows, k), np.iinfo(np.int64).max)

    def least(self) -> np.ndarray:
        return self.similarity[:, -1]

    def push(self, row: np.ndarray, numbers: np.ndarray, similarity: np.ndarray) -> None:
        """Merge candidates (row, number, similarity) into their rows' heaps."""
        if not len(row):
            return
        touched = np.unique(row)
        rows = np.concatenate([np.repeat(touched, self.k), row])
        every = np.concatenate([self.numbers[touched].reshape(-1), numbers])
        values = np.concatenate([self.similarity[touched].reshape(-1), similarity])
        order = np.lexsort((every, -values, rows))
        rows, every, values = rows[order], every[order], values[order]
        begins = np.searchsorted(rows, touched)
        take = begins[:, None] + np.arange(self.k)
        self.similarity[touched], self.numbers[touched] = values[take], every[take]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact products of the rows of two int8 matrices, as float32 or float64.

    127 * 127 * 1040 is below 2**24, so sums over 1040 columns are exact in float32, which is the
    fast way; wider ones are summed in float64.
    """
    kind = np.float32 if a.shape[1] <= 1040 else np.float64
    return a.astype(kind) @ b.astype(kind).T


#: Queries of a block are met by a tile so many at a time.
ROWS = 2048


def _nearest(k: int, tile: int):
    """Rows (dim, block, strip, side, id, vector), the queries of a block first and both sides by id, to its k nearest of the strip."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kind = None, pa.int64()
        asked, ids, waiting, size = [], [], [], 0
        state: dict = {}

        def begin() -> None:
            x = np.concatenate([v for _, v in asked])
            codes, scale, error = quantise(x)
            state.update(ids=pa.concat_arrays([i for i, _ in asked]), codes=codes, scale=scale, error=error, x=x, heaps=Heaps(len(x), k), seen=0)

        def product() -> None:
            """One tile: int8 products, the pairs that their error bounds let live in float, and those into the heaps."""
            nonlocal waiting, size
            if not waiting:
                return
            if not state:
                begin()
            x = np.concatenate(waiting)
            number = state["seen"] + np.arange(len(x))
            state["seen"] += len(x)
            waiting, size = [], 0
            codes, scale, error = quantise(x)
            heaps = state["heaps"]
            for low in range(0, len(state["x"]), ROWS):
                mine = slice(low, low + ROWS)
                about = products(state["codes"][mine], codes)
                about *= scale.astype(about.dtype)
                about *= state["scale"][mine].astype(about.dtype)[:, None]
                # Of unit vectors: |x.y - x'.y'| <= |x - x'| + |x'| |y - y'|; and float32 rounds.
                own = state["error"][mine]
                bound = (own + (1.0 + own) * error.max() + 1e-5).astype(about.dtype)
                floor = heaps.least()[mine].astype(about.dtype) - np.asarray(1e-6, about.dtype)
                if np.isinf(floor).any() and len(x) > k:
                    first = about - bound[:, None]
                    floor = np.maximum(floor, np.partition(first, len(x) - k - 1, axis=1)[:, len(x) - k - 1])
                row, column = np.nonzero(about >= (floor - bound)[:, None])
                for a in range(0, len(row), 1 << 18):
                    r, c = row[a : a + (1 << 18)] + low, column[a : a + (1 << 18)]
                    heaps.push(r, number[c], np.einsum("ij,ij->i", state["x"][r], x[c]))

        def finish() -> Iterator[pa.RecordBatch]:
            product()
            if state:
                heaps, every = state["heaps"], pa.concat_arrays(ids)
                for low in range(0, len(heaps.similarity), ROWS):
                    row, at = np.nonzero(np.isfinite(heaps.similarity[low : low + ROWS]))
                    row += low
                    yield pa.RecordBatch.from_arrays([state["ids"].take(pa.array(row)), every.take(pa.array(heaps.numbers[row, at])), pa.array(heaps.similarity[row, at])], names=["vec_id", "neighbour_id", "similarity"])
            state.clear()
            asked.clear()
            ids.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            group = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(4)], axis=1)
            edges = np.flatnonzero(np.append(True, (group[1:] != group[:-1]).any(axis=1)))
            for a, b in zip(edges, np.append(edges[1:], len(group))):
                dim, block, strip, side = group[a]
                if (dim, block, strip) != now:
                    yield from finish()
                    now = (dim, block, strip)
                mine = batch.column(4).slice(a, b - a)
                x = unit(batch.column(5).slice(a, b - a), dim)
                if side == 0:
                    asked.append((mine, x))
                elif asked:
                    ids.append(mine)
                    for i in range(0, b - a, tile):
                        waiting.append(x[i : i + tile])
                        size += len(waiting[-1])
                        if size >= tile:
                            product()
        yield from finish()

    return run


def unit(vectors: pa.Array, dim: int) -> np.ndarray:
    """Vectors of one dimension at length 1, in float64."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x


def _merge(k: int):
    """Rows (vec_id, neighbour_id, similarity) in the order of vec_id, merged by a heap each; a row's own id is left out."""
    import heapq

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, found, kind = None, [], pa.int64()
        out: list[tuple] = []

        def finish() -> None:
            for rank, (minus, other) in enumerate(heapq.nsmallest(k, found), 1):
                out.append((now, other, rank, -minus))

        def made() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * 4
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind, kind, pa.int32(), pa.float64()))], names=["vec_id", "neighbour_id", "rank", "similarity"])

        for batch in batches:
            kind = batch.column(0).type
            for one, other, similarity in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if one != now:
                    finish()
                    now, found = one, []
                if other != one:
                    found.append((-similarity, other))
            yield made()
        finish()
        yield made()

    return run


def _one_each(rows: DataFrame) -> DataFrame:
    """rows (id, v, ask) with one of each id, the least v; vectors are shuffled only for ids that repeat."""
    twice = cut(rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"))
    n = twice.count()
    if n == 0:
        return rows
    again = rows.join(small(twice, n, 64), "id", "left_semi").groupBy("id").agg(F.min("v").alias("v"), F.max("ask").alias("ask"))
    return rows.join(small(twice, n, 64), "id", "left_anti").select("id", "v", "ask").unionByName(again)


def nearest_neighbours(vectors: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", asking: str | None = None, block: int = 1 << 17, strip: int = 1 << 20, tile: int = 1024) -> DataFrame:
    """(vec_id, neighbour_id, rank, similarity): the k other vectors of the greatest cosine similarity to each.

    asking is an SQL condition on vectors for those that are queries; all are where it is None.
    A matrix join: every block of queries meets every strip of all vectors in one group, in
    which the strip streams by in tiles.  A tile's product of int8 codes gives similarities
    to within the lengths of the quantisation errors; pairs whose upper bound reaches the
    block's k-th best so far are recomputed in float64 and merged into bounded heaps, and
    strips' heaps are merged at the end.  The bounds make the result exact; there is no cap
    on survivors.  Vectors go as they were stored, once a block of queries, and queries
    once a strip, so blocks are large; strips are at most ``strip`` vectors, and as many as there are
    tasks to run.  Every query meets all vectors, so work grows with queries times vectors.

    Ranks count from 1, ties by neighbour id.  Ids keep their type.  Vectors that are null or empty, have a null, NaN or infinite
    element or no length, are left out, as are those of a null id; a null condition isn't met; of repeated ids one vector is
    kept, the least as an array, and asks if any of them does; vectors are held against others of the same dimension; fewer than
    k others give fewer rows; an empty table gives no rows; other columns are ignored,
    whatever their names.
    """
    ship()
    kind = kind_of(vectors, id_col)
    ask = F.lit(True) if asking is None else F.coalesce(F.expr(asking), F.lit(False))
    rows = vectors.select(col(id_col).alias("id"), col(vector_col).alias("v"), ask.alias("ask")).where("id IS NOT NULL AND v IS NOT NULL")
    rows = _one_each(rows)
    sound = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    n, asked = rows.agg(F.count("*"), F.count_if("ask")).first()
    blocks = max(1, -(-asked // block))
    wanted = max(1, -(-shuffle_partitions(vectors) // blocks))
    strips = max(1, -(-n // strip), min(wanted, n // 2048))
    rows = rows.where(sound).withColumn("dim", F.size("v"))
    spread = lambda seed, parts: F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    queries = rows.where("ask").select("dim", spread(1, blocks).alias("block"), each(strips).alias("strip"), F.lit(0).alias("side"), "id", "v")
    answers = rows.select("dim", each(blocks).alias("block"), spread(2, strips).alias("strip"), F.lit(1).alias("side"), "id", "v")
    grid = queries.unionByName(answers).repartitionById(blocks * strips, F.col("block") * strips + F.col("strip")).sortWithinPartitions("dim", "block", "strip", "side", "id")
    # One more than k, as a query meets itself.
    found = grid.mapInArrow(_nearest(k + 1, tile), f"vec_id {kind}, neighbour_id {kind}, similarity double")
    return found.repartition("vec_id").sortWithinPartitions("vec_id").mapInArrow(_merge(k), f"vec_id {kind}, neighbour_id {kind}, rank int, similarity double")


def sql(k: int = 10, asking: str = "TRUE") -> str:
    return f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v),
p AS (SELECT a.vec_id, b.vec_id AS neighbour_id, list_dot_product(a.e, b.e) / (a.n * b.n) AS s FROM (SELECT * FROM u WHERE {asking}) a JOIN u b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, neighbour_id) AS rank FROM p)
SELECT vec_id, neighbour_id, rank::INTEGER AS rank, round(s, 6) AS similarity FROM r WHERE rank <= {k}"""
