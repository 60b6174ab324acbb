"""Hard negatives by a Voronoi-partitioned distributed join of anchors with all rows, exact.

Inner products become distances: with M the largest norm, a candidate x gets the component sqrt(M**2 - |x|**2), an anchor a
zero, and then |a - x|**2 = M**2 + |a|**2 - 2<a, x>. Candidates are assigned to the nearest of some pivots (rows of the table) and
packed into blocks of one cell, each with the smallest and largest distance to its pivot. Anchors are packed into groups, each
with its smallest and largest distance to every pivot. By the triangle inequality these bound every distance between a
group and a block, and a block is sent to just those groups that it might serve:

* positives: each anchor's k-th best row of its label among some seed rows bounds how far its k best can lie;
* negatives: the bands below an anchor's positives bound near and far, and seeds in a band bound it closer.

A group and a chunk of its blocks are the unit of the local join, so neither a crowded cell nor a group that all blocks may
serve makes a large task. The local join scores a block with a matrix product in whole numbers (exact below 2**53, else in 64-bit
integers; an error beyond 2**62). Pivots and seeds change how much is sent, never what comes out: bounds are widened by far
more than their rounding.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchloom.llm.textbatch import release
from patchloom.llm.topk_search import quantised
from patchloom.sources.saved import saved

#: Rows of a block and anchors of a group at most; bytes of vectors in either at most; blocks that one unit of the local join reads, on average.
BLOCK_ROWS, GROUP_ROWS, PACK_BYTES, CHUNK_BLOCKS = 4096, 1024, 8 << 20, 64
#: Rows (by the hash of their numbers) whose scores give first bounds, and pivots among them at most.
SEED_ROWS, MOST_PIVOTS = 1024, 512
#: Shares that one cell's blocks are dealt into before they meet groups.
CELL_SHARES = 16
#: What distances are widened by, in shares of the largest norm.
SLACK = 1e-6

_NOTHING = np.iinfo(np.int64).min
_PACKED = "number long, cell int, n int, width int, ids binary, labels binary, values binary"


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in ddl.split(", ")])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: column[i].as_py() for name, column in zip(batch.schema.names, batch.columns, strict=True)}


def _vectors(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and components (a row each) of a packed block or group."""
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64), np.frombuffer(row["values"], np.int32).reshape(row["n"], row["width"])


def _wide(values: np.ndarray, width: int) -> np.ndarray:
    return values if values.shape[1] == width else np.pad(values, ((0, 0), (0, width - values.shape[1])))


def scores_of(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """All inner products of two sets of whole vectors, exact; the narrower set counts as ending in zeros."""
    width = max(anchors.shape[1], rows.shape[1])
    bound = float(width) * float(np.abs(anchors).max(initial=0)) * float(np.abs(rows).max(initial=0))
    if bound >= 2.0**62:
        raise OverflowError("scores pass 2**62")
    kind = np.float64 if bound < 2.0**53 else np.int64
    return (_wide(anchors, width).astype(kind) @ _wide(rows, width).astype(kind).T).astype(np.int64)


class Space:
    """The augmented space: pivots, seeds, and distances between them and vectors."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, values: np.ndarray, most: int, n_pivots: int):
        self.ids, self.labels, self.values, self.most = ids, labels, values, float(most)
        self.slack = SLACK * math.sqrt(self.most) + 1e-9
        self.pivots = np.unique(values[:n_pivots], axis=0) if len(values) else np.zeros((1, 1), np.int32)

    def _products(self, values: np.ndarray) -> np.ndarray:
        width = max(values.shape[1], self.pivots.shape[1])
        return _wide(values, width).astype(np.float64) @ _wide(self.pivots, width).astype(np.float64).T

    def _lift(self, values: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, self.most - (values.astype(np.float64) ** 2).sum(axis=1)))

    def of_rows(self, values: np.ndarray) -> np.ndarray:
        """Distances of candidates to all pivots."""
        products = self._products(values) + np.outer(self._lift(values), self._lift(self.pivots))
        return np.sqrt(np.maximum(0.0, 2 * self.most - 2 * products))

    def of_anchors(self, values: np.ndarray) -> np.ndarray:
        """Distances of anchors to all pivots."""
        own = (values.astype(np.float64) ** 2).sum(axis=1)
        return np.sqrt(np.maximum(0.0, self.most + own[:, None] - 2 * self._products(values)))

    def at_score(self, values: np.ndarray, score: np.ndarray) -> np.ndarray:
        """How far from each anchor a row lies that has this score with it."""
        return np.sqrt(np.maximum(0.0, self.most + (values.astype(np.float64) ** 2).sum(axis=1) - 2.0 * score))


def best(scores: np.ndarray, use: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest of the scores in ``use``, in order; the earlier place wins a tie."""
    at = np.flatnonzero(use)
    if len(at) > k:
        at = at[scores[at] >= np.partition(scores[at], len(at) - k)[len(at) - k]]
    return at[np.argsort(-scores[at], kind="stable")[:k]]


def _packed(rows: DataFrame, taken: Column, vector: str, scale: float) -> DataFrame:
    """Slices of scan tasks: vectors that take part as whole numbers, their largest squared norm, and how many are anchors."""
    ddl = f"{_PACKED}, anchors binary, most long, n_anchors long"
    schema = _schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                widest = int(max(1, np.asarray(batch.column("vector").slice(at, 1 << 16).value_lengths().fill_null(0)).max(initial=1)))
                part = batch.slice(at, max(1, min(1 << 16, PACK_BYTES // (4 * widest))))
                at += part.num_rows
                ok, values = quantised(part.column("vector"), scale)
                if not ok.any():
                    continue
                ids, labels = (np.asarray(part.column(c))[ok].astype(np.int64) for c in ("id", "label"))
                anchors = np.asarray(part.column("anchor").fill_null(False).cast(pa.int8()))[ok]
                norms = (values.astype(np.float64) ** 2).sum(axis=1)
                if norms.max() >= 2.0**62:
                    raise OverflowError("a squared norm passes 2**62")
                row = (number, 0, len(ids), values.shape[1], ids.tobytes(), labels.tobytes(), values.astype(np.int32).tobytes(), anchors.astype(np.int8).tobytes(), int((values**2).sum(axis=1).max()), int(anchors.sum()))
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)
                number += 1
        release()

    return rows.filter(taken).select("id", "label", "anchor", F.col(vector).alias("vector")).mapInArrow(run, ddl)


def _cells(slices: DataFrame, space: Space) -> DataFrame:
    """Blocks of one cell each, with the distances to the cell's pivot between which their rows lie; a block's rows are in the order of their numbers."""
    ddl = f"{_PACKED}, low double, high double"
    schema = _schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for row in _rows(batches):
            ids, labels, values = _vectors(row)
            distance = space.of_rows(values)
            cell = distance.argmin(axis=1)
            own = distance[np.arange(len(ids)), cell]
            order = np.lexsort((ids, own, cell))
            edges = [0, *(np.flatnonzero(np.diff(cell[order])) + 1).tolist(), len(ids)]
            for a, b in zip(edges, edges[1:], strict=False):
                for begin in range(a, b, BLOCK_ROWS):
                    at = order[begin : min(b, begin + BLOCK_ROWS)]
                    at = at[np.argsort(ids[at], kind="stable")]
                    out = (number, int(cell[at[0]]), len(at), row["width"], ids[at].tobytes(), labels[at].tobytes(), values[at].tobytes(), float(own[at].min()), float(own[at].max()))
                    yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(out, schema, strict=True)], schema=schema)
                    number += 1

    return slices.select(*[f.split()[0] for f in _PACKED.split(", ")]).mapInArrow(run, ddl)


def _groups(slices: DataFrame, space: Space) -> DataFrame:
    """Anchors in groups of neighbours: dealt by ranges of (nearest pivot, distance, number), so a crowded cell is many groups."""
    one = "cell int, distance double, id long, label long, width int, values binary"
    kind = _schema(one)

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            ids, labels, values = _vectors(row)
            at = np.flatnonzero(np.frombuffer(row["anchors"], np.int8))
            if not len(at):
                continue
            distance = space.of_anchors(values[at])
            cell = distance.argmin(axis=1)
            out = (cell, distance[np.arange(len(at)), cell], ids[at], labels[at], np.full(len(at), row["width"]), [values[i].tobytes() for i in at])
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, kind, strict=True)], schema=kind)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        schema = _schema(_PACKED)

        def flush() -> pa.RecordBatch:
            width = max(x["width"] for x in held)
            values = np.concatenate([_wide(np.frombuffer(x["values"], np.int32).reshape(1, x["width"]), width) for x in held])
            row = (number, held[0]["cell"], len(held), width, np.array([x["id"] for x in held], np.int64).tobytes(), np.array([x["label"] for x in held], np.int64).tobytes(), values.tobytes())
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

        for x in _rows(batches):
            if held and (len(held) == GROUP_ROWS or size + len(x["values"]) > PACK_BYTES):
                yield flush()
                number, held, size = number + 1, [], 0
            held.append(x)
            size += len(x["values"])
        if held:
            yield flush()

    dealt = slices.filter("n_anchors > 0").mapInArrow(single, one).repartitionByRange("cell", "distance", "id").sortWithinPartitions("cell", "distance", "id")
    return dealt.mapInArrow(pack, _PACKED)


def _with_bounds(groups: DataFrame, space: Space, reach: Callable[[dict], tuple[np.ndarray, np.ndarray]], extra: str) -> DataFrame:
    """``groups`` with distances to every pivot, and between which distances rows may serve any of their anchors; groups that nothing can serve are left out."""
    ddl = f"{_PACKED}, {extra}from_pivot array<double>, to_pivot array<double>, near double, far double"
    schema = _schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            near, far = reach(row)
            live = near <= far
            if not live.any():
                continue
            distance = space.of_anchors(_vectors(row)[2][live])
            row |= {"from_pivot": (distance.min(axis=0) - space.slack).tolist(), "to_pivot": (distance.max(axis=0) + space.slack).tolist(), "near": float(near[live].min() - space.slack), "far": float(far[live].max() + space.slack)}
            yield pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in schema], schema=schema)

    return groups.mapInArrow(run, ddl)


def _met(groups: DataFrame, blocks: DataFrame, n_chunks: int, join: Callable[[dict, Iterator[dict]], Iterator[pa.RecordBatch]], result: str, carried: str) -> DataFrame:
    """``join`` of each group with the blocks that may serve it, chunk by chunk.

    A block may serve a group if the least distance of the two is not beyond ``far`` and the largest not below ``near``. Which
    do is found on the bounds alone; then every block goes to those groups, and every group to its chunks.
    """
    share = F.pmod(F.xxhash64("number"), F.lit(CELL_SHARES))
    rings = blocks.select(F.col("number").alias("block"), "cell", "low", "high", share.alias("share"))
    wide = groups.select(F.col("number").alias("group"), "near", "far", F.posexplode(F.arrays_zip("from_pivot", "to_pivot")).alias("cell", "to")).select("group", "near", "far", "cell", "to.*")
    cells = blocks.groupBy("cell").agg(F.min("low").alias("inner"), F.max("high").alias("outer"))
    least = lambda low, high: F.greatest(F.col("from_pivot") - F.col(high), F.col(low) - F.col("to_pivot"), F.lit(0.0))
    serves = lambda low, high: (least(low, high) <= F.col("far")) & (F.col("to_pivot") + F.col(high) >= F.col("near"))
    coarse = wide.join(F.broadcast(cells), "cell").filter(serves("inner", "outer")).drop("inner", "outer")  # a row a pivot, MOST_PIVOTS at most
    dealt = coarse.withColumn("share", F.explode(F.array(*[F.lit(s).cast("long") for s in range(CELL_SHARES)])))
    pairs = saved(dealt.join(rings, ["cell", "share"]).filter(serves("low", "high")).select("group", "block", F.pmod(F.xxhash64("block"), F.lit(n_chunks)).alias("chunk")), "pairs")
    names = [f.split()[0] for f in f"{_PACKED}, {carried}".strip(", ").split(", ")]
    bare = [F.lit(None).cast("binary").alias(c) if c not in blocks.columns else F.col(c) for c in names]
    sent = pairs.join(blocks.withColumnRenamed("number", "block"), "block").withColumn("number", F.col("block")).select("group", "chunk", F.lit(1).alias("kind"), *bare)
    asked = pairs.select("group", "chunk").distinct().join(groups.withColumnRenamed("number", "group"), "group").withColumn("number", F.col("group")).select("group", "chunk", F.lit(0).alias("kind"), *names)
    parts = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number that is given: bytes don't tell how long a unit takes
    both = asked.unionByName(sent).repartition(parts, "group", "chunk").sortWithinPartitions("group", "chunk", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _rows(batches)
        ahead = next(rows, None)
        while ahead is not None:
            group, ahead = ahead, None

            def its() -> Iterator[dict]:
                nonlocal ahead
                for row in rows:
                    if row["kind"] == 0:
                        ahead = row
                        return
                    yield row

            yield from join(group, its())
        release()

    return both.mapInArrow(run, result)


def mine(rows: DataFrame, is_anchor: Column, label: Column, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95, id_column: str = "vec_id", vector_column: str = "embedding", scale: float = 256.0) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score of each anchor's hard negatives.

    An anchor's positives are its ``n_positives`` best other rows of its label; a positive's negatives are the anchor's
    ``n_negatives`` best rows of another label whose score lies from ``low`` to ``high`` hundredths of the positive's score. Best is the
    higher inner product of floor(``scale`` * component), then the smaller id. Rows without an id, label or vector, or with a null
    or non-finite component, take no part; ``label`` is a column of whole numbers. An empty vector scores 0; of two widths the
    shorter counts as ending in zeros. Rows of the anchor's own id are no candidates; rows that share another id are
    candidates one by one, and anchors that share an id are mined one by one. An anchor without other rows of its label, and a
    positive with a score below 0 or without rows in its band, give no rows; nor does an empty table.
    """
    typed = rows.select(F.col(id_column).cast("long").alias("id"), label.cast("long").alias("label"), is_anchor.alias("anchor"), F.col(vector_column).alias("__vector"))
    whole = F.col("id").isNotNull() & F.col("label").isNotNull()
    slices = saved(_packed(typed, whole, "__vector", scale), "vectors")
    counts = slices.agg(F.max("most").alias("most"), F.sum("n_anchors").alias("anchors"), F.sum("n").alias("n")).first()
    n_pivots = min(MOST_PIVOTS, max(1, math.isqrt(counts["anchors"] or 0) // 2))
    space = Space(*_seeds(slices), counts["most"] or 0, n_pivots)
    blocks = saved(_cells(slices, space), "blocks")
    n_chunks = max(1, blocks.count() // CHUNK_BLOCKS)
    groups = saved(_groups(slices, space), "anchors")

    def reach_positives(row: dict) -> tuple[np.ndarray, np.ndarray]:
        ids, labels, values = _vectors(row)
        least = np.full(len(ids), -float(2**62))
        if len(space.ids):
            scores = scores_of(values, space.values)
            use = (labels[:, None] == space.labels) & (ids[:, None] != space.ids)
            scores = np.where(use, scores, _NOTHING)
            if scores.shape[1] >= n_positives:
                kth = np.partition(scores, scores.shape[1] - n_positives, axis=1)[:, scores.shape[1] - n_positives]
                least = np.where(kth == _NOTHING, least, kth)
        return np.zeros(len(ids)), space.at_score(values, least)

    def find_positives(group: dict, found: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        ids, labels, values = _vectors(group)
        top: list[list[tuple[int, int]]] = [[] for _ in ids]
        for block in found:
            b_ids, b_labels, b_values = _vectors(block)
            scores = scores_of(values, b_values)
            use = (labels[:, None] == b_labels) & (ids[:, None] != b_ids)
            most = np.where(use, scores, _NOTHING).max(axis=1)
            for a in np.flatnonzero(most != _NOTHING):
                if len(top[a]) < n_positives or -most[a] <= top[a][-1][0]:
                    top[a] = sorted([*top[a], *((-int(scores[a, i]), int(b_ids[i])) for i in best(scores[a], use[a], n_positives))])[:n_positives]
        out = [(group["number"], a, i, -s) for a, x in enumerate(top) for s, i in x]
        yield _batch(out, ("group", "place", "positive_id", "positive_score"))

    near_positives = saved(_with_bounds(groups, space, reach_positives, ""), "groups")
    positives = _met(near_positives, blocks, n_chunks, find_positives, "group long, place long, positive_id long, positive_score long", "")
    order = Window.partitionBy("group", "place").orderBy(F.col("positive_score").desc(), "positive_id")
    chosen = positives.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= n_positives)
    wanted = chosen.groupBy("group").agg(F.to_json(F.sort_array(F.collect_list(F.array("place", F.col("nth").cast("long"), "positive_id", "positive_score")))).cast("binary").alias("wanted"))
    asking = groups.join(wanted.withColumnRenamed("group", "number"), "number").select(*groups.columns, "wanted")

    def bands(row: dict) -> list[list[tuple[int, int, int, int, int]]]:
        """For each anchor: number, id and score of its positives, lowest and highest score of their negatives."""
        import json

        out: list[list[tuple[int, int, int, int, int]]] = [[] for _ in range(row["n"])]
        for place, nth, positive, score in json.loads(row["wanted"]):
            if score >= 0:
                out[place].append((nth, positive, score, -(-low * score // 100), high * score // 100))
        return out

    def reach_negatives(row: dict) -> tuple[np.ndarray, np.ndarray]:
        ids, labels, values = _vectors(row)
        lowest, highest = np.full(len(ids), float(2**62)), np.full(len(ids), -float(2**62))
        scores = scores_of(values, space.values) if len(space.ids) else np.zeros((len(ids), 0), np.int64)
        for a, own in enumerate(bands(row)):
            seeds = np.sort(scores[a][space.labels != labels[a]])
            for _, _, _, least, most in own:
                upto = int(np.searchsorted(seeds, most, "right"))
                known = int(seeds[upto - n_negatives]) if upto >= n_negatives else least
                lowest[a], highest[a] = min(lowest[a], max(least, known)), max(highest[a], most)
        near, far = space.at_score(values, highest), space.at_score(values, lowest)
        return np.where(lowest <= highest, near, np.inf), np.where(lowest <= highest, far, -np.inf)

    def find_negatives(group: dict, found: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        ids, labels, values = _vectors(group)
        asked = bands(group)
        top: dict[tuple[int, int], list[tuple[int, int]]] = {(a, j): [] for a, own in enumerate(asked) for j in range(len(own))}
        for block in found:
            b_ids, b_labels, b_values = _vectors(block)
            scores = scores_of(values, b_values)
            other = (labels[:, None] != b_labels) & (ids[:, None] != b_ids)
            for a, own in enumerate(asked):
                if not own:
                    continue
                at = np.flatnonzero(other[a] & (scores[a] >= min(x[3] for x in own)) & (scores[a] <= max(x[4] for x in own)))
                if not len(at):
                    continue
                its = scores[a, at]
                for j, (_, _, _, least, most) in enumerate(own):
                    use = (its <= most) & (its >= (least if len(top[a, j]) < n_negatives else max(least, -top[a, j][-1][0])))
                    if use.any():
                        top[a, j] = sorted([*top[a, j], *((-int(its[i]), int(b_ids[at[i]])) for i in best(its, use, n_negatives))])[:n_negatives]
        out = [(group["number"], a, asked[a][j][0], int(ids[a]), asked[a][j][1], asked[a][j][2], i, -s) for (a, j), x in top.items() for s, i in x]
        yield _batch(out, ("group", "place", "nth", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"))

    in_reach = saved(_with_bounds(asking, space, reach_negatives, "wanted binary, "), "groups")
    negatives = _met(in_reach, blocks, n_chunks, find_negatives, "group long, place long, nth long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long", "wanted binary")
    order = Window.partitionBy("group", "place", "nth").orderBy(F.col("negative_score").desc(), "negative_id")
    return negatives.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n_negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _batch(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    columns = np.array(rows, np.int64).reshape(len(rows), len(names)).T
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=list(names))


def _seeds(slices: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and components of the SEED_ROWS rows whose ids hash lowest; no more of them come from any task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _schema("hash long, id long, label long, width int, values binary")
        for row in _rows(batches):
            ids, labels, values = _vectors(row)
            with np.errstate(over="ignore"):
                mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(2)
            at = np.argsort(mixed, kind="stable")[:SEED_ROWS]
            out = (mixed[at].astype(np.int64), ids[at], labels[at], np.full(len(at), row["width"]), [values[i].tobytes() for i in at])
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)

    rows = slices.mapInArrow(run, "hash long, id long, label long, width int, values binary").orderBy("hash", "id", "label", "values").limit(SEED_ROWS).collect()
    width = max((r["width"] for r in rows), default=1)
    values = [_wide(np.frombuffer(bytes(r["values"]), np.int32).reshape(1, r["width"]), width) for r in rows]
    return np.array([r["id"] for r in rows], np.int64), np.array([r["label"] for r in rows], np.int64), np.concatenate(values) if values else np.zeros((0, 1), np.int32)
