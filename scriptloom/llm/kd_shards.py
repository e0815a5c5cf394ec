"""Sharding by a k-d tree over metadata: law ``bytes``, shard sizes near equal.

The rows are split recursively at weighted quantiles (medians, where a node's shards
halve) of the node's widest metadata dimension, until every leaf holds the target bytes,
total / shards. A quantile is found by histograms: all nodes of a level share each pass,
a pass sums sizes by (node, bin), and only the bin with the quantile is looked at more
closely. The driver sees at most NODES * BINS sums. Where one value (a source with a
third of all rows, say) holds more than the tolerance, the cut goes on within that value
over a hash of the row, so no group must fit a shard and no row moves before the end.

Everything is DataFrame operations. The metadata is written once; each pass reads it.

Size is the text's UTF-8 bytes (null: none) plus 8. Null metadata counts as 0 or ''.
Repeated rows are rows of their own and are dealt by their place in the table. An empty
table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from os.path import commonprefix

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptloom.llm.common import parts, sized, store

BINS = 4096
#: Share of a shard's target that a cut may be off.
TOLERANCE = 0.0005
TIES = 1 << 52
ROWS_PER_SLOT_BUCKET = 200_000


def dimensions(docs: DataFrame, texts: dict[str, Column], numbers: dict[str, Column]) -> dict[str, Column]:
    """Order-preserving longs from 0 to 2**52 of metadata, fitted to its range by one pass:
    of strings the six bytes after what all of them begin with, of numbers the distance
    from the least, in steps that fit. Null is the empty string, or 0. Values that share a code
    are told apart by the tie, so a coarse code costs order within it, never balance."""
    texts = {n: F.coalesce(c.cast("string"), F.lit("")).cast("binary") for n, c in texts.items()}
    numbers = {n: F.coalesce(c.cast("long"), F.lit(0)) for n, c in numbers.items()}
    ends = [f(c).alias(f"{f.__name__}_{n}") for n, c in {**texts, **numbers}.items() for f in (F.min, F.max)]
    found = docs.agg(*ends).first()

    def text_code(n: str, c: Column) -> Column:
        begin = len(commonprefix([bytes(found[f"min_{n}"] or b""), bytes(found[f"max_{n}"] or b"")]))
        head = F.rpad(F.substring(c, begin + 1, 6), 6, F.lit(b"\0"))
        return F.conv(F.hex(head), 16, 10).cast("long")

    def number_code(n: str, c: Column) -> Column:
        low, high = found[f"min_{n}"] or 0, found[f"max_{n}"] or 0
        step = -(-(high - low + 1) // TIES)
        away = c.cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)") if high - low >= 1 << 63 else c - F.lit(low)
        return F.floor(away / step).cast("long") if step > 1 else away.cast("long")

    return {**{n: text_code(n, c) for n, c in texts.items()}, **{n: number_code(n, c) for n, c in numbers.items()}}


@dataclass
class Node:
    first: int
    leaves: int
    total: float = 0.0
    dim: str = ""
    cut: tuple[int, int] = (0, 0)
    left: Node | None = None
    right: Node | None = None

    def leaf_column(self) -> Column:
        """The first shard of the row's node, as nested conditions: five for 24 shards."""
        if self.left is None:
            return F.lit(self.first)
        value, tie = self.cut
        goes_left = (F.col(self.dim) < value) | ((F.col(self.dim) == value) & (F.col("_tie") < tie))
        return F.when(goes_left, self.left.leaf_column()).otherwise(self.right.leaf_column())


@dataclass
class Search:
    """The narrowing interval of one node's quantile."""

    node: Node
    goal: float
    tolerance: float
    low: int
    high: int
    below: float = 0.0
    value: int | None = None  # set once the cut is within one value, over ties
    done: bool = False

    @property
    def width(self) -> int:
        return max(1, -(-(self.high - self.low + 1) // BINS))

    def narrow(self, bins: dict[int, tuple[float, int, int]]) -> None:
        """On to the bin with the quantile. ``bins``: weight, least and greatest value of
        each; the search goes on between the two, so few values take few passes."""
        before = self.below
        for b in sorted(bins):
            if before + bins[b][0] >= self.goal:
                break
            before += bins[b][0]
        weight, least, most = bins[b]
        if weight <= self.tolerance or (least == most and self.value is not None):
            nearer_end = before + weight - self.goal < self.goal - before
            at = most + 1 if nearer_end else least
            self.node.cut = (at, 0) if self.value is None else (self.value, at)
            self.done = True
        elif least == most:
            self.value, self.low, self.high, self.below = least, 0, TIES - 1, before
        else:
            self.low, self.high, self.below = least, most, before


def _by_node(values: dict[int, int | str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("_node")]


def grow(meta: DataFrame, dims: list[str], shards: int) -> Node | None:
    """The tree for a stored table with ``size``, ``_tie`` and the dimensions (longs
    from 0 to 2**52); None if it has no rows."""
    root = Node(0, shards)
    spans: dict[str, int] = {}
    level = [root]
    while level:
        stats = meta.select("size", *dims, root.leaf_column().alias("_node")).groupBy("_node")
        found = {
            r["_node"]: r
            for r in stats.agg(F.sum("size").alias("total"), *[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("min", F.min), ("max", F.max))]).collect()
        }
        if root.first not in found:
            return None
        spans = spans or {d: max(1, found[0][f"max_{d}"] - found[0][f"min_{d}"]) for d in dims}
        searches = {}
        for node in level:
            if node.leaves == 1 or (r := found.get(node.first)) is None:
                continue
            node.total = float(r["total"])
            if node is root:
                target = node.total / shards
            node.dim = max(dims, key=lambda d: (r[f"max_{d}"] - r[f"min_{d}"]) / spans[d])
            goal = node.total * (node.leaves // 2) / node.leaves
            searches[node.first] = Search(node, goal, max(1.0, TOLERANCE * target), r[f"min_{node.dim}"], r[f"max_{node.dim}"])
        while active := {k: s for k, s in searches.items() if not s.done}:
            place = F.col(dims[0])
            for d in dims[1:]:
                place = F.when(F.col("_dim") == d, F.col(d)).otherwise(place)
            rows = meta.select("size", "_tie", *dims, root.leaf_column().alias("_node")).where(F.col("_node").isin(list(active)))
            rows = rows.select("size", "_tie", "_node", *dims, _by_node({k: s.node.dim for k, s in active.items()}).alias("_dim"))
            rows = rows.select("size", "_node", "_tie", place.alias("_place"), _by_node({k: -1 if s.value is None else s.value for k, s in active.items()}).alias("_in"))
            rows = rows.where((F.col("_in") < 0) | (F.col("_in") == F.col("_place")))
            rows = rows.select("size", "_node", F.when(F.col("_in") < 0, F.col("_place")).otherwise(F.col("_tie")).alias("_at"))
            rows = rows.where(F.col("_at").between(_by_node({k: s.low for k, s in active.items()}), _by_node({k: s.high for k, s in active.items()})))
            bin_ = F.floor((F.col("_at") - _by_node({k: s.low for k, s in active.items()})) / _by_node({k: s.width for k, s in active.items()}))
            sums: dict[int, dict[int, tuple[float, int, int]]] = {k: {} for k in active}
            for r in rows.groupBy("_node", bin_.alias("_bin")).agg(F.sum("size").alias("w"), F.min("_at").alias("least"), F.max("_at").alias("most")).collect():
                sums[r["_node"]][int(r["_bin"])] = (float(r["w"]), r["least"], r["most"])
            for k, s in active.items():
                s.narrow(sums[k])
        level = []
        for s in searches.values():
            n = s.node
            half = n.leaves // 2
            n.left, n.right = Node(n.first, half), Node(n.first + half, n.leaves - half)
            level += [n.left, n.right]
    return root


def shard(docs: DataFrame, columns: dict[str, Column], size: Column, dims: dict[str, Column], shards: int = 24) -> DataFrame:
    """``columns`` of every row with its size (long), shard (int) and slot (long, gapless
    from 0 in each shard)."""
    dim_names = [f"_dim{i}" for i in range(len(dims))]
    read = docs.select(*[c.alias(n) for n, c in columns.items()], size.cast("long").alias("size"), *[c.alias(n) for n, c in zip(dim_names, dims.values(), strict=True)])
    read = read.withColumn("_row", F.monotonically_increasing_id())
    meta = store(read.withColumn("_tie", F.shiftrightunsigned(F.xxhash64("_row", *columns), 12)))
    tree = grow(meta, dim_names, shards)
    placed = meta.select(*columns, "size", "_tie", "_row", (tree.leaf_column() if tree else F.lit(0)).alias("shard"))
    buckets = parts(meta.count(), ROWS_PER_SLOT_BUCKET * shards)
    placed = store(placed.withColumn("_bucket", F.pmod("_tie", F.lit(buckets)).cast("int")))
    counts = placed.groupBy("shard", "_bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = store(counts.select("shard", "_bucket", F.coalesce(before, F.lit(0)).alias("start")))
    within = F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy("_tie", "_row")) - 1
    numbered = placed.withColumn("_within", within).join(sized(starts), ["shard", "_bucket"])
    return numbered.select(*columns, "size", F.col("shard").cast("int").alias("shard"), (F.col("_within") + F.col("start")).cast("long").alias("slot"))
