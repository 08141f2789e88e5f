"""Vector bin packing under limits on tokens, segments and loss-bearing tokens."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import col, cut, kind_of, words

def split_runs(runs: Iterable[tuple[int, bool]], tokens: int, loss: int) -> Iterator[tuple[int, int, int]]:
    """(first token, tokens, loss-bearing tokens) of the pieces of an example, each as long as the limits let it be."""
    first, n, bear = 0, 0, 0
    for length, bears in runs:
        while length > 0:
            room = min(tokens - n, loss - bear) if bears else tokens - n
            if room == 0:
                yield first, n, bear
                first, n, bear = first + n, 0, 0
                continue
            take = min(room, length)
            n, bear, length = n + take, bear + take * bears, length - take
    if n:
        yield first, n, bear


class Bins:
    """Bins filled one at a time from a window of waiting items, by the dot-product heuristic.

    Of the waiting items that fit in what is left of the open bin, that with the greatest weighted
    dot product of its demand and what is left is placed; where none fits, the bin is closed.
    A dimension weighs as much as its mean demand among the items that fill the window first.
    Ties go to the item that came first.  The window is refilled after each placing, and the open bin
    goes on, so nothing is closed for the window's sake.
    """

    def __init__(self, limits: np.ndarray, window: int):
        self.limits, self.window = limits.astype(np.int64), window
        self.sizes, self.rank = np.zeros((window, len(limits)), np.int64), np.zeros(window, np.int64)
        self.demand = np.zeros((window, len(limits)))
        self.live, self.fit = np.zeros(window, bool), np.zeros(window, bool)
        self.weight: np.ndarray | None = None
        self.waiting, self.came = 0, 0
        self.bin, self.slot, self.left = 0, 0, self.limits.copy()

    def add(self, size: tuple[int, ...]) -> tuple[int, int, int] | None:
        """Let an item wait; where the window is full, (number of an item, bin, slot) of the one placed to make room."""
        placed = None
        if self.waiting == self.window:
            placed, at = self._place()
        else:
            at = self.waiting
        self.sizes[at], self.rank[at] = size, self.came
        self.demand[at] = self.sizes[at] / self.limits
        if self.weight is not None:
            self.demand[at] *= self.weight
        self.live[at], self.fit[at] = True, bool((self.sizes[at] <= self.left).all())
        self.waiting, self.came = self.waiting + 1, self.came + 1
        return placed

    def finish(self) -> Iterator[tuple[int, int, int]]:
        """(number, bin, slot) of all that still wait."""
        while self.waiting:
            yield self._place()[0]

    def _place(self) -> tuple[tuple[int, int, int], int]:
        if self.weight is None:
            self.weight = self.demand[self.live].mean(axis=0)
            self.demand *= self.weight
        if not self.fit.any():
            self.bin, self.slot, self.left = self.bin + 1, 0, self.limits.copy()
            self.fit = self.live.copy()
        score = self.demand @ (self.left / self.limits)
        score[~self.fit] = -1.0
        best = np.flatnonzero(score == score.max())
        at = int(best[0]) if len(best) == 1 else int(best[self.rank[best].argmin()])
        placed = (int(self.rank[at]), self.bin, self.slot)
        self.slot += 1
        self.left = self.left - self.sizes[at]
        self.live[at] = False
        self.fit &= self.live & (self.sizes <= self.left).all(axis=1)
        self.waiting -= 1
        return placed, at


def _packer(tokens: int, segments: int, loss: int, window: int):
    limits = np.array([tokens, segments, loss], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kind = None, pa.int64()
        bins, wait, done = Bins(limits, window), {}, []

        def made() -> pa.RecordBatch:
            columns = list(zip(*done)) or [()] * 7
            done.clear()
            kinds = (kind, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["id", "piece", "first_token", "n_tokens", "n_loss", "bin", "slot"])

        def put(placed: tuple[int, int, int]) -> None:
            number, where, slot = placed
            done.append((*wait.pop(number), (now << 32) + where, slot))

        def finish() -> None:
            for placed in bins.finish():
                put(placed)

        for batch in batches:
            kind = batch.column(1).type
            group, ids, lengths, bears = (batch.column(k).to_pylist() for k in range(4))
            for k in range(len(ids)):
                if group[k] != now:
                    finish()
                    now, bins = group[k], Bins(limits, window)
                for piece, x in enumerate(split_runs(zip(lengths[k], bears[k]), tokens, loss)):
                    wait[bins.came] = (ids[k], piece, *x)
                    placed = bins.add((x[1], 1, x[2]))
                    if placed:
                        put(placed)
                    if len(done) >= 1 << 14:
                        yield made()
            yield made()
        finish()
        yield made()

    return run


def pack(examples: DataFrame, tokens: int = 2048, segments: int = 16, loss: int = 1536, window: int = 1024, group_rows: int = 16384, seed: int = 1) -> DataFrame:
    """(id, piece, first_token, n_tokens, n_loss, bin, slot) of every piece of the examples (id, lengths, bears).

    lengths has the tokens of an example's runs, bears whether they bear loss.  An example
    beyond a limit is split into pieces, so no token is lost; a piece names its first token in
    its example.  Pieces are placed in bins of at most ``tokens`` tokens, ``segments`` pieces and
    ``loss`` loss-bearing tokens by the dot-product heuristic (Bins), which looks at ``window`` waiting
    pieces at a time.

    Examples are counted and spread over groups of about group_rows by a hash of their id, one
    task each; bins don't cross groups, so each has one unfilled bin at its end.  A task holds one
    window of pieces and the pieces of one example as they are split.  Only ids and lengths are shuffled.

    Ids keep their type; null ids are kept as nulls; examples of null or no runs, or no tokens, have no piece;
    null lengths count as 0 and null bears as false; repeated rows are each placed; ties
    are ordered by id and lengths; an empty table gives no rows; other columns are ignored,
    whatever their names.
    """
    ship()
    rows = examples.select(col("id").alias("id"), F.transform("lengths", lambda x: F.greatest(F.coalesce(x.cast("bigint"), F.lit(0).cast("bigint")), F.lit(0).cast("bigint"))).alias("lengths"), F.transform("bears", lambda x: F.coalesce(x, F.lit(False))).alias("bears")).where("lengths IS NOT NULL AND bears IS NOT NULL AND size(lengths) > 0")
    rows = cut(rows)
    groups = max(1, round(rows.count() / group_rows))
    key = F.xxhash64(F.lit(seed), "id", "lengths")
    keyed = rows.select(F.pmod(key, F.lit(groups)).cast("int").alias("group"), "id", "lengths", "bears", key.alias("key"))
    spread = keyed.repartitionById(groups, "group").sortWithinPartitions("group", "key", "id", "lengths", "bears")
    return spread.select("group", "id", "lengths", "bears").mapInArrow(_packer(tokens, segments, loss, window), f"id {kind_of(rows, 'id')}, piece int, first_token bigint, n_tokens bigint, n_loss bigint, bin bigint, slot int")


def conversation_examples(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(id, lengths, bears) of each conversation: the words of its turns, of which those of loss_role bear loss.

    Turns are ordered by turn, role and text; a null turn comes first, a null role is a user's, a null text has no words.
    Rows of a null conversation are left out; repeated rows count once; an empty table gives no rows; other columns are ignored.
    """
    turn = F.coalesce(F.col("turn").cast("bigint"), F.lit(-(1 << 63)))
    turns = conversations.select(F.col("conv_id").alias("id"), turn.alias("turn"), F.coalesce("role", F.lit("user")).alias("role"), words("text").alias("n"), F.xxhash64("text").alias("of")).where("id IS NOT NULL")
    made = turns.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("turn", "role", "of", "n"))).alias("turns"))
    return made.select("id", F.transform("turns", lambda t: t["n"]).alias("lengths"), F.transform("turns", lambda t: t["role"] == loss_role).alias("bears"))


def document_examples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lengths, bears) of each document: one run of its words but the first, which bears no loss as nothing predicts it.

    A null or empty text, or one of spaces alone, gives no row; a null id is kept; repeated rows
    give a row each; an empty table gives no rows; other columns are ignored.
    """
    n = words(text_col)
    rows = docs.select(col(id_col).alias("id"), n.alias("n")).where("n > 0")
    return rows.select("id", F.array(F.lit(1).cast("bigint"), F.col("n") - 1).alias("lengths"), F.array(F.lit(False), F.lit(True)).alias("bears"))
