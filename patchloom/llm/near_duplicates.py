"""Near-duplicate documents by a signature-coordinate inverted join, confirmed on whole shingle sets.

1. Each document becomes its set of 5-word shingles (64-bit hashes) and a MinHash signature. Documents with equal
   sets form a class; only its smallest document goes on.
2. Each class is posted under each (coordinate, value). A pair with the wanted similarity agrees in at least
   ``matches_at`` of ``COORDINATES`` places (it fails to with a chance of ``LOST`` at most), so it shares one of the
   COORDINATES - matches + 1 rarest values of either class: only those prefixes are kept as postings. Values held once are
   skipped; classes whose prefix has no others drop out.
3. In each posting every class meets one class, the pivot: the most central in the posting (its values are the most
   shared), or, at first, the most central that can be reached from it in two such steps, so that a group has few
   pivots. Whole sets tell their similarity and their difference, and linked classes become components. That joins
   a large group of near copies with about as many pairs as it has members.
4. Two classes that one pivot doesn't link can only be similar if they differ from the pivot alike: of one's difference
   about half must be in the other's too. So the rarer half of each difference is looked up in the whole differences of
   classes that aren't linked with the pivot; pairs that meet there and lie in different components are confirmed on
   signatures and whole sets.
5. Classes far from their posting's pivot can't be similar to those near it. They go on as a posting of their own,
   with a new pivot. What is left after ``ROUNDS`` rounds shares frequent values only; similar ones among it must share
   one of the rarest shingles of either, as many as leave fewer than the wanted similarity needs, and meet there.

Whatever way a pair has met, it is kept only if its signatures collide in ``matches_at`` coordinates and if whole sets confirm it.

Sets are made again for classes with postings, from the table; pairs, links and components are DataFrames.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.llm.components import components
from patchloom.llm.saved import saved
from patchloom.llm.textbatch import buffer_of, lowered, mix, release, slices, span_hashes, word_spans

#: Words in a shingle.
SHINGLE = 5
#: MinHash coordinates, and the chance at most that a pair with just the wanted similarity isn't looked at.
COORDINATES, LOST = 64, 4e-7
#: Rounds of pivots. Below FAR per cent of similarity with its pivot a class goes on to the next one.
ROUNDS, FAR = 3, 56
#: The least similarity that may be asked for, in per cent.
LEAST_PERCENT = 80
#: Classes of exact copies with more than this share of all rows (or HOT_ROWS) are joined to their rows by broadcast; there are HOT at most.
HOT, HOT_ROWS = 50_000, 1000
#: Classes with postings up to which their ids (8 bytes each) are broadcast to the second reading of the texts.
BROADCAST_IDS = 2_000_000
#: Rows in an Arrow batch that holds whole texts or sets.
BATCH_ROWS = 1000

_rng = np.random.default_rng(77)
_FACTORS = _rng.integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = _rng.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_NUMBERS = np.arange(COORDINATES, dtype=np.int64) << 32


def matches_at(percent: int) -> int:
    """Coordinates that must agree: a pair with a similarity of ``percent`` agrees in fewer with a chance of ``LOST`` at most."""
    s, lost, m = percent / 100, 0.0, 0
    while m < COORDINATES and (lost := lost + comb(COORDINATES, m) * s**m * (1 - s) ** (COORDINATES - m)) <= LOST:
        m += 1
    return m


def near_at(percent: int) -> int:
    """Per cent of similarity with a pivot from which differences are compared.

    It lies further below FAR than the allowed distance: a class below it is similar to none from FAR on.
    """
    return FAR - (101 - percent)


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """Sorted hashes of each text's distinct shingles of lower-cased words (A-Z only).

    With fewer words than a shingle has, the whole sequence is the one shingle; without words the set is empty.
    """
    raw, offsets = buffer_of(column)
    raw = lowered(raw)
    starts, stops, first = word_spans(raw, offsets)
    words = span_hashes(raw, starts, stops)
    with np.errstate(over="ignore"):
        runs = np.zeros(0, np.uint64)
        if len(words) >= SHINGLE:
            runs = words[: len(words) - SHINGLE + 1] * _PLACES[0]
            for k in range(1, SHINGLE):
                runs += words[k : len(words) - SHINGLE + 1 + k] * _PLACES[k]
            runs = mix(runs)
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= SHINGLE:
                out.append(np.unique(runs[a : b - SHINGLE + 1]))
            elif b > a:
                out.append(mix(np.array([(words[a:b] * _PLACES[: b - a]).sum() + np.uint64(b - a)], np.uint64)))
            else:
                out.append(runs[:0])
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """Smallest 32-bit hash by coordinate, with the coordinate's number above it."""
    low = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for a in range(0, len(shingles), 2048):
            low = np.minimum(low, (shingles[a : a + 2048, None] * _FACTORS).min(axis=0))
    return (low >> np.uint64(32)).astype(np.int64) | _NUMBERS


def _ints(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64), kind))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_a, set_b (128 bits that tell sets apart), sig: one row for each of ``docs``."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"))
                with np.errstate(over="ignore"):
                    marks = np.array([(mix(x ^ np.uint64(0x5851F42D4C957F2D)).sum(), mix(x * np.uint64(0x2545F4914F6CDD1D)).sum()) for x in sets], np.uint64).reshape(-1, 2).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), pa.array(marks[:, 0]), pa.array(marks[:, 1]), _ints([signature(x) if len(x) else np.zeros(0, np.int64) for x in sets], pa.int64())],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "sig"],
                )
        release()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, n_shingles long, set_a long, set_b long, sig array<long>")


def _whole_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, shingles (sorted 64-bit hashes) of the documents of ``wanted`` (doc_id, sig), with sig."""
    key = docs.schema["doc_id"].dataType.simpleString()
    ids = wanted.select("doc_id")
    if wanted.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x.tobytes() for x in sets], pa.binary()), _ints([signature(x) if len(x) else np.zeros(0, np.int64) for x in sets], pa.int64())], names=["doc_id", "shingles", "sig"])
        release()

    return docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").mapInArrow(run, f"doc_id {key}, shingles binary, sig array<long>")


def _pairs_with_sets(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """Pairs (u, v) with the columns of u's and then v's row of ``sets``."""
    one = lambda x: sets.select(F.col("doc_id").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in columns])
    return pairs.join(one("u"), "u").join(one("v"), "v").select("u", "v", *[f"{x}_{c}" for c in columns for x in "uv"])


def _within(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of sorted ``a`` are in sorted ``b``."""
    return b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose signatures collide often enough and whose whole sets are similar enough."""
    key, matches = sets.schema["doc_id"].dataType.simpleString(), matches_at(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for row in range(batch.num_rows):
                x, y = (batch.column(k)[row].values.to_numpy() for k in (2, 3))
                if (x == y).sum() < matches:
                    continue
                a, b = (np.frombuffer(batch.column(k)[row].as_buffer(), np.uint64) for k in (4, 5))
                shared = int(_within(a, b).sum())
                if 100 * shared >= percent * (len(a) + len(b) - shared):
                    keep.append(row)
            yield batch.select(["u", "v"]).take(pa.array(keep, pa.int64()))
        release()

    return _pairs_with_sets(pairs, sets, "sig", "shingles").mapInArrow(run, f"u {key}, v {key}")


def _met(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """u, v, linked, far, probe, whole: each class u with its pivot v, and their difference if they are near.

    Linked are those whose signatures collide often enough and whose whole sets are similar enough.

    With p the pivot's set, r of it missing in x and a added, x and another class s are similar only if their differences
    share at least (1 + 100 * r + percent * a) / (100 + percent) elements, given that s isn't linked with the pivot. So one
    shared element is among any ``probe`` elements of x's difference, as many as leave fewer than that.
    """
    key, near, matches = sets.schema["doc_id"].dataType.simpleString(), near_at(percent), matches_at(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, far, probe, whole, sizes = [], [], [], [], []
            for row in range(batch.num_rows):
                x, pivot = (np.frombuffer(batch.column(k)[row].as_buffer(), np.uint64) for k in (4, 5))
                collide = (batch.column(2)[row].values.to_numpy() == batch.column(3)[row].values.to_numpy()).sum() >= matches
                own = _within(x, pivot)
                shared = int(own.sum())
                union = len(x) + len(pivot) - shared
                linked.append(bool(collide) and 100 * shared >= percent * union)
                far.append(100 * shared < FAR * union)
                full, part = x[:0], 0
                if 100 * shared >= near * union:
                    added, missing = x[~own], pivot[~_within(pivot, x)]
                    with np.errstate(over="ignore"):
                        full = np.concatenate([added, mix(missing + np.uint64(1))])
                    least = -(-(1 + 100 * len(missing) + percent * len(added)) // (100 + percent))
                    part = max(0, len(full) - least + 1)
                probe.append(part)
                sizes.append((len(pivot), len(pivot) - shared, len(x) - shared))
                whole.append(full.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_()), pa.array(far, pa.bool_()), pa.array(probe, pa.int32()), _ints(whole, pa.int64()), *(pa.array([x[k] for x in sizes], pa.int64()) for k in range(3))], names=["u", "v", "linked", "far", "probe", "whole", "n", "r", "a"])
        release()

    return _pairs_with_sets(pairs, sets, "sig", "shingles").mapInArrow(run, f"u {key}, v {key}, linked boolean, far boolean, probe int, whole array<long>, n long, r long, a long")


def _postings(classes: DataFrame, percent: int) -> DataFrame:
    """key, doc_id, weight: each class under the rarest values of its signature that others hold too.

    weight tells how widely the class's values are shared.
    """
    entries = classes.select("doc_id", F.explode("sig").alias("key"))
    shared = entries.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    held = entries.join(shared, "key").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("held"), F.sum("n").alias("weight"))
    skip, size = COORDINATES - F.size("held"), COORDINATES - matches_at(percent) + 1
    prefix = held.filter(size > skip).select("doc_id", "weight", F.explode(F.slice("held", F.lit(1), F.lit(size) - skip)).alias("one"))
    return prefix.select(F.col("one.key").alias("key"), "doc_id", "weight")


def _by_rare_shingles(classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs u < v of ``classes`` (u, component) of different components that share one of their rarest shingles.

    Two sets with the wanted similarity share at least ``percent`` per cent of either, so they share one among the rarest of
    either, as many as leave fewer than that. Shingles that no other class in question holds are the rarest and meet nothing.
    """
    key = sets.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _ints([np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(2)], pa.int64())], names=["u", "component", "e"])
        release()

    own = classes.join(sets.select(F.col("doc_id").alias("u"), "shingles"), "u").select("u", "component", "shingles").mapInArrow(run, f"u {key}, component {key}, e array<long>")
    entries = saved(own.select("u", "component", F.size("e").alias("size"), F.explode("e").alias("e")), "shingles", BATCH_ROWS)
    shared = entries.groupBy("e").agg(F.count("*").alias("holders")).filter("holders > 1")
    held = entries.join(shared, "e").groupBy("u", "component", "size").agg(F.sort_array(F.collect_list(F.struct("holders", "e"))).alias("held"))
    needed = F.floor((F.lit(percent) * F.col("size") + 99) / 100)
    room = F.size("held") - needed + 1
    prefix = saved(held.filter(room > 0).select("u", "component", F.explode(F.slice("held", F.lit(1), room.cast("int"))).alias("one")).select("u", "component", "one.e"), "rare")
    other = prefix.select("e", F.col("u").alias("v"), F.col("component").alias("other"))
    return prefix.join(other, "e").filter("u < v AND component != other").select("u", "v")


def link_components(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each row of ``docs``.

    Two documents are linked if 100 * |A and B| >= ``percent`` * |A or B| of their shingle sets; component_id is the
    smallest doc_id reachable by links, kept is true for it alone. Texts without words, and null texts, have no
    shingles and are linked with nothing. Rows that share a doc_id are linked by either text. Rows without a doc_id have
    no component and aren't kept. ``percent`` is ``LEAST_PERCENT`` to 100; a pair at just ``percent`` is missed with a chance of
    ``LOST`` at most, a closer one with a smaller chance.
    """
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"a similarity of {LEAST_PERCENT} to 100 per cent can be asked for")
    sigs = saved(signatures(docs), "signatures", BATCH_ROWS)
    full = sigs.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    mark = ["set_a", "set_b", "n_shingles"]
    classes = saved(full.groupBy(*mark).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")), "classes")
    chosen = full.join(classes.select(F.col("first_id").alias("doc_id"), *mark), ["doc_id", *mark], "left_semi").dropDuplicates(["doc_id", *mark])
    postings = saved(_postings(chosen.select("doc_id", "sig"), percent), "postings")
    sets = saved(_whole_sets(docs, postings.select("doc_id").distinct()), "sets", BATCH_ROWS)

    met, rest = None, postings
    for turn in range(ROUNDS):
        centre = rest.groupBy("key").agg(F.max(F.struct("weight", (-F.col("doc_id")).alias("minus"))).alias("top"), F.count("*").alias("n")).filter("n > 1").select("key", "top")
        if turn == 0:  # up from each pivot to the most central one of its own postings, twice
            up = saved(rest.join(centre, "key").groupBy("doc_id").agg(F.max("top").alias("top")).select((-F.col("doc_id")).alias("minus"), "top"), "up")
            for _ in range(2):
                centre = centre.select("key", F.col("top.minus").alias("minus")).join(up, "minus").select("key", "top")
        star = rest.withColumnRenamed("doc_id", "u").join(centre.select("key", (-F.col("top.minus")).alias("v")), "key").filter("u != v")
        round_met = saved(_met(star.select("u", "v").distinct(), sets, percent), "met", BATCH_ROWS)
        met = round_met if met is None else met.unionByName(round_met)
        rest = saved(star.join(round_met.filter("far").select("u", "v"), ["u", "v"], "left_semi").select("key", F.col("u").alias("doc_id"), "weight"), "far")
        if not rest.limit(1).count():
            break
    found = saved(met.filter("linked").select("u", "v"), "links")

    label = components(found).withColumnRenamed("node", "u")
    labelled = lambda x: x.join(label, "u", "left").withColumn("component", F.coalesce("component", "u"))
    apart = labelled(met.filter("probe > 0"))
    # two classes with the same main pivot, the one that most others met, are compared in its group alone
    members_of = apart.groupBy("v").agg(F.count("*").alias("many"))
    main = apart.select("u", "v").join(members_of, "v").groupBy("u").agg(F.max(F.struct("many", "v")).alias("main")).select("u", F.col("main.v").alias("main"))
    apart = apart.join(main, "u")
    groups = apart.groupBy("v").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.min("linked").alias("linked")).filter("least != most AND NOT linked").select("v")
    apart = saved(apart.join(groups, "v", "left_semi"), "differences")
    holders = apart.filter("NOT linked").select("v", F.explode("whole").alias("e")).groupBy("v", "e").agg(F.count("*").alias("holders"))
    own = F.struct("component", "main", "linked", "probe", "n", "r", "a", F.size("whole").alias("size")).alias("own")
    entries = apart.select("v", "u", own, F.explode("whole").alias("e")).join(holders, ["v", "e"])
    held = entries.groupBy("v", "u").agg(F.first("own").alias("own"), F.sort_array(F.collect_list(F.struct("holders", "e"))).alias("held"))
    # elements that no class in question holds come first in every order; "left" are an element and those behind it
    placed = saved(held.select("v", "u", "own.*", F.size("held").alias("m"), F.posexplode("held").alias("k", "one")).select("v", "u", "component", "main", "linked", "probe", "n", "r", "a", "size", F.col("one.e").alias("e"), (F.col("m") - F.col("k")).alias("left")), "placed")
    probes = placed.filter(F.col("size") - F.col("left") < F.col("probe"))
    wholes = placed.filter("NOT linked").select("v", "e", *[F.col(c).alias(f"{c}_w") for c in ("u", "component", "main", "r", "a", "left")])
    wanted = (percent - 100) * F.col("n") + 100 * (F.col("r") + F.col("r_w")) + percent * (F.col("a") + F.col("a_w"))
    most = F.least("left", "left_w", F.least("r", "r_w") + F.least("a", "a_w"))
    once = F.when(F.col("main") == F.col("main_w"), F.col("v") == F.col("main")).otherwise(True)
    alike = probes.join(wholes, ["v", "e"]).filter(once & (F.col("component") != F.col("component_w")) & ((100 + percent) * most >= wanted)).select(F.least("u", "u_w").alias("u"), F.greatest("u", "u_w").alias("v"))
    left = labelled(rest.select("key", F.col("doc_id").alias("u")))
    mixed = left.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least != most").select("key")
    between = _by_rare_shingles(left.join(mixed, "key", "left_semi").select("u", "component").distinct(), sets, percent)
    links = saved(_confirmed(alike.unionByName(between).distinct(), sets, percent), "links", BATCH_ROWS)
    joined = components(found.unionByName(links)).withColumnRenamed("node", "first_id")
    named = classes.join(joined, "first_id", "left").select(*mark, "copies", F.coalesce("component", "first_id").alias("component"))
    # a class with a large share of all rows meets them by broadcast (no more than HOT classes can have such a share), so no task holds them all
    many = F.col("copies") > max(HOT_ROWS, sigs.count() // HOT)
    hot = F.broadcast(named.filter(many).select(*mark, "component"))
    members = full.select("doc_id", *mark)
    whole = members.join(hot, mark).select("doc_id", "component").unionByName(members.join(hot, mark, "left_anti").join(named.filter(~many), mark).select("doc_id", "component"))
    whole = whole.groupBy("doc_id").agg(F.min("component").alias("component"))
    out = sigs.select("doc_id", "n_shingles").join(whole, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def first_of_each(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The documents that stay when one of each group of near duplicates does, with their own columns.

    Rows that share a doc_id stay or go together; rows without one stay.
    """
    name = "gone"
    while name in docs.columns:
        name += "_"
    gone = saved(link_components(docs, percent).filter("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias(name)).distinct(), "gone")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")
