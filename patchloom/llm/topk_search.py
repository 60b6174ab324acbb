"""Exact top-k inner-product search by MaxScore over vector components taken as weighted terms.

Each component is a term, each block of vectors a shard with one posting column a term. In a shard, component
values are shifted by the term's smallest (for a negative query weight, largest) value there, so that every
term adds at least nothing and at most |weight| times the term's range: its score bound. Per query, terms
in order of their bounds split into non-essential ones, whose bounds together can't lift a row over the
query's threshold (its k-th best score so far), and essential ones. Essential postings are traversed in full;
then the rows whose partial score plus the bounds left still competes are probed term by term, the largest
bound first, and the threshold rises as they finish. Shard results merge into the k best of each query.

Shards are cut inside scan tasks, whatever the keys, so no key or group of equal vectors makes a large task.
The query set meets the shards in a grid: groups of shards by groups of query blocks, a task a cell. A cell holds its
query blocks and reads its shards one by one, and a query's k best so far are the threshold for the next shard. There are
about as many cells as shards, their sides so that either side's copies take as many bytes: with n rows, what is
shuffled grows with n to the power 1.5, up to some 800 million rows; from there on a cell's memory is what bounds its
queries, so there are more cells. Sums are 64-bit integers; components whose products pass 2**62 raise an error
instead of wrapping.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom.llm.saved import saved

#: Rows in a shard, and queries in a block.
SHARD_ROWS, BLOCK_ROWS = 16384, 1024
#: Rows scored in full before a query meets a shard, which give its first threshold.
SEED_ROWS = 64
#: Query blocks that a cell of the grid holds at most.
HELD_BLOCKS = 512
#: Groups of cells whose results merge first, so that no query's results from all cells meet in one row.
MERGE_PARTS = 256

_BLOCK = "block long, n int, width int, ids binary, values binary"


def quantised(vector: pa.ListArray | pa.LargeListArray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Which rows take part, and their components as floor(scale * x); shorter rows end in zeros."""
    flat = vector.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.asarray(vector.value_lengths().fill_null(0), np.int64)
    row = np.repeat(np.arange(len(vector)), size)
    ok = np.asarray(vector.is_valid()).copy()
    ok[row[~np.isfinite(values)]] = False
    out = np.zeros((len(vector), int(size[ok].max(initial=0))), np.int64)
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    use = ok[row]
    scaled = np.floor(scale * values[use])
    if len(scaled) and np.abs(scaled).max() >= 2.0**31:
        raise OverflowError("a component of 2**31 or more after scaling")
    out[row[use], place[use]] = scaled.astype(np.int64)
    return ok, out[ok]


def _blocks(rows: DataFrame, id_column: str, vector_column: str, scale: float, size: int) -> DataFrame:
    """One row for each ``size`` taking-part vectors of a scan task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, values, held = TaskContext.get().partitionId() << 32, [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number, held
            width = max(v.shape[1] for v in values)
            all_values = np.concatenate([np.pad(v, ((0, 0), (0, width - v.shape[1]))) for v in values])
            out = [[number], [held], [width], [np.concatenate(ids).tobytes()], [np.ascontiguousarray(all_values.T).tobytes()]]
            number, held = number + 1, 0
            ids.clear()
            values.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["block", "n", "width", "ids", "values"])

        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                ok, found = quantised(part.column(1), scale)
                keys = np.asarray(part.column(0).cast(pa.int64()))[ok]
                while len(keys):
                    room = size - held
                    ids.append(keys[:room])
                    values.append(found[:room].astype(np.int32))
                    held += len(ids[-1])
                    keys, found = keys[room:], found[room:]
                    if held == size:
                        yield flush()
        if held:
            yield flush()

    return rows.filter(F.col(id_column).isNotNull()).select(id_column, vector_column).mapInArrow(run, _BLOCK)


def _opened(ids: bytes, values: bytes, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(values, np.int32).reshape(width, n).astype(np.int64)


class Shard:
    """Posting columns of one block of vectors, with each term's smallest and largest value."""

    def __init__(self, ids: np.ndarray, postings: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.postings = ids[order], np.ascontiguousarray(postings[:, order])
        self.low, self.high = self.postings.min(axis=1), self.postings.max(axis=1)

    def search(self, own_id: int, weights: np.ndarray, k: int, floor: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores that may be among the query's k best, by score and then id; the shard's k best from ``floor`` on are among them."""
        n, width = len(self.ids), min(len(weights), len(self.postings))
        weights = weights[:width]
        if float(np.abs(weights).sum()) * float(max(-self.low.min(initial=0), self.high.max(initial=0))) >= 2.0**62:
            raise OverflowError("scores pass 2**62")
        base = np.where(weights >= 0, weights * self.low[:width], weights * self.high[:width])
        bounds = np.abs(weights) * (self.high - self.low)[:width]
        other = self.ids != own_id
        seed = np.flatnonzero(other)[:SEED_ROWS]
        if len(seed) < k:
            rows = np.flatnonzero(other)
            scores = weights @ self.postings[:width, rows]
            return self._best(rows, scores, k)
        scores = weights @ self.postings[:width, seed]
        threshold = int(np.partition(scores, len(scores) - k)[len(scores) - k])
        if floor is not None:
            threshold = max(threshold, floor)
        terms = np.argsort(-bounds, kind="stable")
        left = int(bounds.sum())  # what the terms not yet visited can add
        total = np.full(n, int(base.sum()), np.int64)
        at = 0
        while at < width and int(base.sum()) + left >= threshold:  # essential: without them no row would compete
            t = terms[at]
            if weights[t]:
                total += weights[t] * self.postings[t] - base[t]
            left -= int(bounds[t])
            at += 1
        rows = np.flatnonzero((total + left >= threshold) & other)
        total = total[rows]
        while at < width and len(rows):
            t = terms[at]
            if weights[t]:
                total = total + (weights[t] * self.postings[t, rows] - base[t])
            left -= int(bounds[t])
            at += 1
            if len(rows) > k:  # every row has at least its partial score
                threshold = max(threshold, int(np.partition(total, len(total) - k)[len(total) - k]))
            keep = total + left >= threshold
            rows, total = rows[keep], total[keep]
        return self._best(rows, total, k)

    def _best(self, rows: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows[best]], scores[best]


class Held:
    """A block of queries and the k best of each over the shards seen so far."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, k: int):
        self.ids, self.values, self.k = ids, values, k
        self.found, self.score, self.n = np.zeros((len(ids), k), np.int64), np.zeros((len(ids), k), np.int64), np.zeros(len(ids), np.int64)

    def meet(self, shard: Shard) -> None:
        for q, own in enumerate(self.ids):
            n = self.n[q]
            ids, scores = shard.search(own, self.values[:, q].astype(np.int64), self.k, int(self.score[q, n - 1]) if n == self.k else None)
            if n:
                ids, scores = np.concatenate([self.found[q, :n], ids]), np.concatenate([self.score[q, :n], scores])
                best = np.lexsort((ids, -scores))[: self.k]
                ids, scores = ids[best], scores[best]
            self.found[q, : len(ids)], self.score[q, : len(ids)], self.n[q] = ids, scores, len(ids)

    def results(self, part: int, names: list[str]) -> pa.RecordBatch:
        use = np.arange(self.k) < self.n[:, None]
        columns = np.repeat(self.ids, self.n), self.found[use], self.score[use], np.full(int(self.n.sum()), part, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=names)


def grid_sides(shards: int, blocks: int, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> tuple[int, int]:
    """How many groups of shards and of query blocks: some ``shards`` cells, either side's copies of about the same size."""
    across = max(math.isqrt(max(0, blocks * block_rows // shard_rows - 1)) + 1, -(-blocks // HELD_BLOCKS))
    across = max(1, min(across, blocks))
    return max(1, -(-shards // across)), across


def _dealt(sides: int) -> Column:
    """A block's group: the blocks of a task, and those of tasks one after the other, go round all groups."""
    return F.pmod(F.shiftright("block", 32) + F.col("block").bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(sides)).cast("int")


def top_k(rows: DataFrame, is_query: Column, k: int, id_column: str = "vec_id", vector_column: str = "embedding", scale: float = 256.0, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank (from 1), <id>, score: the k highest inner products of each query, ties to smaller ids.

    Vectors that are null or hold null or non-finite components take no part, nor do rows without an id; an empty
    vector scores 0 with every other, and of two widths the shorter counts as ending in zeros. A query meets
    every row of another id; rows that share an id are candidates one by one. Fewer than k others give fewer rows.
    """
    shards = saved(_blocks(rows, id_column, vector_column, scale, shard_rows), "shards")  # numbered by task, so read once
    queries = saved(_blocks(rows.filter(is_query), id_column, vector_column, scale, block_rows), "queries")
    down, across = grid_sides(shards.count(), queries.count(), shard_rows, block_rows)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sent = queries.select(F.lit(False).alias("is_shard"), _dealt(across).alias("column"), each(down).alias("line"), "n", "width", "ids", "values")
    sent = sent.unionByName(shards.select(F.lit(True).alias("is_shard"), each(across).alias("column"), _dealt(down).alias("line"), "n", "width", "ids", "values"))
    cells = sent.repartitionById(down * across, F.col("line") * across + F.col("column")).sortWithinPartitions("is_shard").drop("column", "line")
    names = ["query_id", id_column, "score", "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: list[Held] = []
        for batch in batches:
            for row in range(batch.num_rows):
                n, width = batch.column("n")[row].as_py(), batch.column("width")[row].as_py()
                ids, values = (batch.column(c)[row].as_buffer() for c in ("ids", "values"))
                if not batch.column("is_shard")[row].as_py():
                    blocks.append(Held(np.frombuffer(ids, np.int64).copy(), np.frombuffer(values, np.int32).reshape(width, n).copy(), k))
                elif blocks:
                    shard = Shard(*_opened(ids, values, n, width))
                    for block in blocks:
                        block.meet(shard)
        part = TaskContext.get().partitionId() % MERGE_PARTS
        for block in blocks:
            yield block.results(part, names)

    found = saved(cells.mapInArrow(run, f"query_id long, {id_column} long, score long, part long"), "found", batch_rows=8)
    entry = F.struct((-F.col("score")).alias("minus"), F.col(id_column).alias("id"))
    best = found.groupBy("query_id", "part").agg(F.slice(F.sort_array(F.collect_list(entry)), 1, k).alias("best"))
    best = best.groupBy("query_id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("place", "one")).select("query_id", (F.col("place") + 1).alias("rank"), F.col("one.id").alias(id_column), (-F.col("one.minus")).alias("score"))
