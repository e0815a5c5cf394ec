"""Exact top-k inner products by norm-bucketed retrieval.

Vectors become integers, floor(SCALE * x). They are grouped by length (buckets whose
lengths differ by a factor of at most ``RATIO``); a bucket with many rows is dealt into
blocks by hash. Blocks are visited from the longest on, in rounds. Before each round a
query's theta is its k-th best score so far; against a block whose greatest length is l,
only vectors with a cosine of at least theta / (|q| l), the local threshold, can matter:

* above 1: the pair is skipped. A block of queries is not even sent to the blocks of
  vectors that are too short for all its queries;
* from the block's own bound on: coordinate pruning. On the query's largest coordinates,
  a vector with such a cosine lies in a known interval; only vectors in all intervals
  remain;
* else: length pruning. Of the block, sorted by length, only the head with
  |q| |v| >= theta remains.

A block is read in parts that double in size, each of which raises theta for the next.
The bound and the number of coordinates are chosen for each part on a few of its
queries, by what either pruning would cost (``tuned``). What remains is verified by
exact products, so pruning never changes a result. The first theta comes from ``SEEDS``
of the longest vectors, a fixed number.

Blocks and blocks of queries are rows of stored tables, a file each, and bounded in rows and
bytes. A task reads some of either from there and compares all pairs of them (a Cartesian
product), so vectors are neither shuffled to their pairs nor broadcast, and none passes the
driver.

Vectors that are null or hold null or non-finite components take no part. Vectors of
different dimensions are compared as if shorter ones ended in zeros; empty ones have
length 0. Rows alike in id and vector count once. An id with several vectors is one
query and one candidate, and the best score between any of the vectors of two ids is
theirs; rows with the query's own id are no candidates. Null ids take no part. No
candidates: no rows. Scores are exact in 64 bits for components up to 2**26 / dimension;
beyond, arithmetic is on Python integers and a score outside 64 bits becomes the nearest
one inside.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptloom.llm.common import parts, store

SCALE, RATIO, SEEDS = 64, 1.1, 2048
BLOCK, QUERY_BLOCK = 8192, 2048
#: Components of a block; it has fewer rows if they are wide.
BLOCK_VALUES, QUERY_VALUES = 1 << 21, 1 << 19
#: Shares of the blocks after which thetas are raised.
ROUNDS = (1 / 16, 1 / 4)
#: The first part of a block that is read, as a divisor.
LEAD = 16
#: Queries that a part is tuned on, the numbers of coordinates it chooses from, and costs,
#: where one component of a product within a matrix product costs 1: looking at a
#: coordinate of a vector, verifying a component of a gathered vector, a query by itself.
TUNED_ON, FOCUS, LOOK, GATHER, ALONE = 8, (1, 2, 3, 4, 6), 12.0, 10.0, 300_000.0


def integers(vector: Column) -> Column:
    """The vector's integers as doubles (exact to 2**53); null if it takes no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("double")))


class Block:
    """Vectors of a block, longest first."""

    def __init__(self, ids, rows: list[np.ndarray], dim: int):
        matrix = np.zeros((len(rows), dim))
        for i, r in enumerate(rows):
            matrix[i, : len(r)] = r
        length = np.sqrt((matrix * matrix).sum(axis=1))
        order = np.lexsort((ids, -length))
        self.ids, self.matrix, self.length = np.asarray(ids, np.int64)[order], matrix[order], length[order]
        self._units: dict[int, np.ndarray] = {}

    def coordinate(self, f: int) -> np.ndarray:
        """One coordinate of all unit vectors."""
        if f not in self._units:
            self._units[f] = self.matrix[:, f] / np.where(self.length > 0, self.length, 1)
        return self._units[f]

    def head(self, theta: float, length: float) -> int:
        """Vectors that are long enough for the score."""
        if theta <= 0 or not length:
            return len(self.length) if theta <= 0 else 0
        return int(np.searchsorted(-self.length, -(theta / length) * (1 - 1e-12), side="right"))

    def near(self, unit: np.ndarray, cosine: float, focus: int, begin: int, end: int) -> np.ndarray:
        """Places from ``begin`` to ``end`` of the vectors that the query's largest
        coordinates allow to have such a cosine."""
        at = None
        for f in np.argsort(-np.abs(unit), kind="stable")[:focus].tolist():
            mid, half = unit[f] * cosine, np.sqrt(max(0.0, (1 - unit[f] ** 2) * (1 - cosine**2)))
            low = -1.0 if unit[f] < 0 and -unit[f] >= cosine else mid - half
            high = 1.0 if unit[f] >= cosine else mid + half
            values = self.coordinate(f)[begin:end] if at is None else self.coordinate(f)[at]
            inside = np.flatnonzero((values >= low - 1e-9) & (values <= high + 1e-9))
            at = begin + inside if at is None else at[inside]
        return np.arange(begin, end) if at is None else at


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact integer inner products as int64."""
    most = max(1.0, np.abs(queries).max(initial=0)) * max(1.0, np.abs(vectors).max(initial=0)) * max(1, queries.shape[1])
    if most < 2**53:
        return np.rint(queries @ vectors.T).astype(np.int64)
    exact = np.array([[int(x) for x in q] for q in queries], object) @ np.array([[int(x) for x in v] for v in vectors], object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def _best(ids: np.ndarray, scores: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of distinct ids other than ``own``: by score, ties to the smaller id."""
    keep = ids != own
    ids, scores = ids[keep], scores[keep]
    if len(ids) > 4 * k:
        bar = np.partition(scores, len(scores) - 2 * k)[len(scores) - 2 * k]
        head = scores >= bar
        if len(np.unique(ids[head])) >= k:
            ids, scores = ids[head], scores[head]
    order = np.lexsort((ids, -scores))
    ids, scores = ids[order], scores[order]
    _, first = np.unique(ids, return_index=True)
    first = np.sort(first)[:k]
    return ids[first], scores[first]


def tuned(block: Block, begin: int, end: int, queries: np.ndarray, lengths: np.ndarray, heads: np.ndarray, cosine: np.ndarray) -> tuple[float, int]:
    """(least cosine for coordinate pruning, number of coordinates) for a part of a block:
    of the sample, the split that costs least. Above 1: never."""
    steepest = np.argsort(-cosine, kind="stable")
    some = steepest[np.unique(np.linspace(0, len(steepest) - 1, TUNED_ON).astype(int))]
    dim = block.matrix.shape[1]
    by_length = (heads[some] - begin) * float(dim)
    best = (0.0, 2.0, 1)
    for focus in FOCUS:
        left = np.array([len(block.near(queries[i] / lengths[i], cosine[i], focus, begin, end)) for i in some])
        saved = np.cumsum(by_length - (LOOK * (end - begin) * (1 + focus / 8) + GATHER * left * dim + ALONE))
        at = int(np.argmax(saved))
        if saved[at] > best[0]:
            best = (saved[at], float(cosine[some[at]]), focus)
    return best[1:]


def search(query_ids, queries: np.ndarray, theta: np.ndarray, block: Block, k: int, tally: Counter | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, ids, scores) of each query's best in a block, no worse than theta, in
    several parts. The block is read from its longest vectors on in parts that double;
    what a part yields raises theta for the next. ``tally`` counts the products that
    each way was spared or has verified."""
    lengths = np.sqrt((queries * queries).sum(axis=1))
    theta, n, counts = theta.copy(), len(block.length), Counter()
    end = 0
    while end < n:
        begin, end = end, min(n, max(2 * end, n // LEAD, 4 * k))
        room = lengths * block.length[begin]
        able = np.flatnonzero(theta <= room * (1 + 1e-12))
        counts["skipped"] += (len(theta) - len(able)) * (end - begin)
        if not len(able):
            continue
        heads = np.array([min(end, max(begin, block.head(theta[i], lengths[i]))) for i in able])
        cosine = np.minimum(1.0, np.divide(theta[able], room[able], out=np.zeros(len(able)), where=room[able] > 0))
        steep, focus = (2.0, 1)
        if (known := np.flatnonzero(cosine > 0)).size:
            steep, focus = tuned(block, begin, end, queries[able[known]], lengths[able[known]], heads[known], cosine[known])
        alone = cosine >= steep
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        for i, c in zip(able[alone].tolist(), cosine[alone].tolist(), strict=True):
            at = block.near(queries[i] / lengths[i], c, focus, begin, end)
            counts["pruned by coordinates"] += end - begin - len(at)
            counts["verified after coordinates"] += len(at)
            found.append((i, block.ids[at], products(queries[i][None, :], block.matrix[at])[0]))
        whole, heads = able[~alone], heads[~alone]
        counts["pruned by length"] += int((end - heads).sum())
        counts["verified after length"] += int((heads - begin).sum())
        for a in range(0, len(whole), 256):
            some, most = whole[a : a + 256], heads[a : a + 256]
            scored = products(queries[some], block.matrix[begin : most.max()])
            found += [(i, block.ids[begin:h], x[: h - begin]) for i, h, x in zip(some.tolist(), most.tolist(), scored, strict=True)]
        for i, ids, scores in found:
            good = scores >= theta[i]
            ids, scores = _best(ids[good], scores[good], query_ids[i], k)
            if len(scores) == k:
                theta[i] = max(theta[i], scores[-1])
            if len(ids):
                yield query_ids[i], ids, scores
    if tally is not None:
        tally.update(counts)


def _matrix(rows: list[np.ndarray], dim: int) -> np.ndarray:
    out = np.zeros((len(rows), dim))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _vectors(lists) -> list[np.ndarray]:
    values = lists.values.to_numpy(zero_copy_only=False)
    offsets = lists.offsets.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


_MADE = "query_id long, vec_id long, score long"
_ASKED = "qpart long, query_ids array<long>, queries array<array<double>>, lengths array<double>, theta array<double>"


def _number(bucket: Column, firsts: dict[int, tuple[int, int]], spread: Column) -> Column:
    """The block of a row: one of its bucket's."""
    first, many = (F.create_map(*[F.lit(x) for b, f in firsts.items() for x in (b, f[at])])[bucket] for at in (0, 1))
    return (first + F.pmod(spread, many)).cast("int")


def _first_thetas(k: int):
    """Query blocks with their lengths and the thetas that the seeds give, from rows (qpart,
    ids, vectors, seed ids, seeds)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, ids, vectors, seed_ids, seeds in zip(*[batch.column(i) for i in range(5)], strict=True):
                rows, seed_rows = _vectors(vectors.values), _vectors(seeds.values)
                dim = max(map(len, rows + seed_rows), default=0)
                queries, query_ids = _matrix(rows, dim), ids.values.to_numpy(zero_copy_only=False)
                theta, block = np.full(len(rows), -np.inf), Block(seed_ids.values.to_numpy(zero_copy_only=False), seed_rows, dim)
                for a in range(0, len(rows), 256):
                    for i, scores in enumerate(products(queries[a : a + 256], block.matrix), a):
                        _, best = _best(block.ids, scores, query_ids[i], k)
                        if len(best) == k:
                            theta[i] = best[-1]
                columns = [pa.array([part.as_py()], pa.int64()), pa.array([query_ids.tolist()], pa.list_(pa.int64())), pa.array([vectors.as_py()], pa.list_(pa.list_(pa.float64())))]
                columns += [pa.array([x.tolist()], pa.list_(pa.float64())) for x in (np.sqrt((queries * queries).sum(axis=1)), theta)]
                yield pa.RecordBatch.from_arrays(columns, names=["qpart", "query_ids", "queries", "lengths", "theta"])

    return run


def _verify(k: int):
    """The best of each query from rows (ids, vectors, query_ids, queries, theta)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, vectors, query_ids, queries, theta in zip(*[batch.column(i) for i in range(5)], strict=True):
                block_rows, asked_rows = _vectors(vectors.values), _vectors(queries.values)
                dim = max(map(len, block_rows + asked_rows), default=0)
                block = Block(ids.values.to_numpy(zero_copy_only=False), block_rows, dim)
                found = list(search(query_ids.values.to_numpy(zero_copy_only=False), _matrix(asked_rows, dim), theta.values.to_numpy(zero_copy_only=False), block, k))
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat([int(q) for q, _, _ in found], [len(i) for _, i, _ in found])), pa.array(np.concatenate([i for _, i, _ in found])), pa.array(np.concatenate([s for _, _, s in found]))],
                        names=["query_id", "vec_id", "score"],
                    )

    return run


def top_k(vectors: DataFrame, id_col: str, vector_col: str, is_query: Column, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows for every row of the query
    set, all if there are fewer."""
    read = vectors.select(F.col(id_col).cast("long").alias("vec_id"), integers(F.col(vector_col)).alias("q"), is_query.alias("asks"))
    once = read.where("q is not null and vec_id is not null").groupBy("vec_id", "q").agg(F.bool_or("asks").alias("asks"))
    rows = once.withColumn("length", F.sqrt(F.aggregate("q", F.lit(0.0), lambda s, x: s + x * x)))
    rows = store(rows.withColumn("bucket", F.when(F.col("length") < 1, F.lit(-1)).otherwise(F.floor(F.log("length") / F.log(F.lit(RATIO)))).cast("int")))
    # lengths span at most log(2**1024) / log(RATIO) buckets
    sizes = {r.bucket: r for r in rows.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.size("q")).alias("values"), F.max("length").alias("longest")).collect()}
    if not sizes:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).limit(0)
    firsts, total, reaches = {}, 0, []
    for b in sorted(sizes, reverse=True):
        firsts[b] = (total, parts(sizes[b].n, BLOCK, parts(sizes[b]["values"], BLOCK_VALUES)))
        total += firsts[b][1]
        reaches.append((float(sizes[b].longest), total))
    spread = F.xxhash64("vec_id", "q")
    blocks = rows.groupBy(_number(F.col("bucket"), firsts, spread).alias("block")).agg(F.collect_list(F.struct("vec_id", "q")).alias("rows"))
    blocks = store(blocks.select("block", F.col("rows.vec_id").alias("ids"), F.col("rows.q").alias("vectors")), per_file=1)

    seeds = rows.select("vec_id", "q", "length").orderBy(F.desc("length"), "vec_id", "q").limit(SEEDS).agg(F.collect_list(F.struct("vec_id", "q")).alias("rows"))
    seeds = store(seeds.select(F.col("rows.vec_id").alias("seed_ids"), F.col("rows.q").alias("seeds")))
    asked = rows.where("asks")
    asks = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("q")), F.lit(0)).alias("values")).first()
    per = parts(asks.n, QUERY_BLOCK, parts(asks["values"], QUERY_VALUES))
    packed = asked.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(per)).alias("qpart")).agg(F.collect_list(F.struct("vec_id", "q")).alias("rows"))
    packed = packed.select(F.col("qpart").cast("long"), F.col("rows.vec_id").alias("ids"), F.col("rows.q").alias("vectors"))
    asking = store(packed.hint("shuffle_replicate_nl").crossJoin(seeds).mapInArrow(_first_thetas(k), _ASKED), per_file=1)

    # the blocks that are long enough for one of the queries, from the longest on
    needed = F.zip_with("theta", "lengths", lambda t, n: F.when(n > 0, t / n).when(t > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf"))))
    least = F.array_min(needed) * (1 - 1e-9)
    reach = F.aggregate(F.array(*[F.struct(F.lit(x).alias("l"), F.lit(n).alias("n")) for x, n in reaches]), F.lit(0), lambda s, r: F.when(r["l"] >= least, F.greatest(s, r["n"])).otherwise(s))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    cuts = sorted({-(-total * share // 1) for share in ROUNDS} | {total})
    best, low = None, 0
    for high in map(int, cuts):
        sent = asking.select("*", F.least(reach, F.lit(high)).alias("to")).where(F.col("to") > low)
        visited = blocks.where((F.col("block") >= low) & (F.col("block") < high)).hint("shuffle_replicate_nl")
        made = visited.join(sent, F.col("block") < F.col("to")).select("ids", "vectors", "query_ids", "queries", "theta").mapInArrow(_verify(k), _MADE)
        made = made if best is None else made.unionAll(best.select("query_id", "vec_id", "score"))
        scored = made.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", place).where(F.col("rank") <= k)
        if high == total:
            return scored.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
        best, low = store(scored), high
        raised = best.where(F.col("rank") == k).select("query_id", "score", F.pmod(F.xxhash64("query_id"), F.lit(per)).cast("long").alias("qpart"))
        raised = raised.groupBy("qpart").agg(F.map_from_entries(F.collect_list(F.struct("query_id", F.col("score").cast("double")))).alias("bars"))
        higher = F.zip_with("query_ids", "theta", lambda i, t: F.greatest(t, F.coalesce(F.col("bars")[i], t)))
        asking = store(asking.join(raised, "qpart", "left").select("qpart", "query_ids", "queries", "lengths", F.when(F.col("bars").isNull(), F.col("theta")).otherwise(higher).alias("theta")), per_file=1)
    raise AssertionError("the last round returns")
