"""SimHash near-duplicate classes by meet-in-the-middle ball hashing.

Two fingerprints link at ``RADIUS`` = 3 or fewer differing bits. Half the radius is one
and a half. The odd bit is met by masking: the 64 bits fall into three blocks, and for
each block in turn the bits outside it (the key) are varied by every single flip. Of up
to three differing bits

* one in the masked block leaves two outside: each side flips one, both meet;
* none outside and three inside the block: the unflipped keys meet.

With the block chosen among the three, every pair meets in some bucket, and what meets
is verified. A fingerprint emits 131 keys, where unmasked balls of radius two would be
2,081. A bucket links in linear time: fingerprints alike in the masked block lie within
two bits, those one masked bit apart within three; chains of such links are enough for
classes, so no bucket emits all its pairs.

Equal fingerprints are one row throughout; texts are never shuffled.

Null and empty texts have fingerprint zero and are one class. Repeated rows are rows of
their own in the result. A class id is the smallest doc_id (nulls aside) of the class.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptloom.llm.common import store, words_of
from scriptloom.llm.components import components

RADIUS = 3
#: (first bit, bits) of the masked block.
BLOCKS = ((0, 21), (21, 21), (42, 22))
_HASHED_AT_ONCE = 1 << 14


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash: a bit is set if over half of the shingles' XXH64 have
    it set. Shingles repeat; fewer words than a shingle count as one shingle."""
    words = words_of(text)
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    first, last = starts[:n].tolist(), (ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]).tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _HASHED_AT_ONCE):
        h = [digest(line[a:b], seed) for a, b in zip(first[at : at + _HASHED_AT_ONCE], last[at : at + _HASHED_AT_ONCE], strict=True)]
        counts += np.unpackbits(np.array(h, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, shingle: int = 3, seed: int = 42) -> Column:
    """The fingerprint's bits as a (signed) long."""

    @F.arrow_udf("long")
    def bits(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t.as_py(), shingle, seed) for t in texts], dtype=np.uint64).view(np.int64))

    return bits(text)


def _turned(fp: np.ndarray, block: int) -> np.ndarray:
    """Rotated so that the masked block is lowest."""
    first, _ = BLOCKS[block]
    return (fp >> np.uint64(first)) | (fp << np.uint64(64 - first)) if first else fp


def _keys(fp: np.ndarray, block: int) -> np.ndarray:
    return _turned(fp, block) >> np.uint64(BLOCKS[block][1])


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        every = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(every), 2048):
            fp = every[at : at + 2048]
            keys = []
            for block, (_, bits) in enumerate(BLOCKS):
                flips = np.concatenate(([0], 1 << np.arange(64 - bits, dtype=np.uint64))).astype(np.uint64)
                keys.append((_keys(fp, block)[:, None] ^ flips[None, :]) | np.uint64(block << 60))
            made = np.concatenate(keys, axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(made.ravel().view(np.int64)), pa.array(np.repeat(fp, made.shape[1]).view(np.int64))], names=["key", "fp"]
            )


_NEAR = [sum(1 << b for b in bits) for n in (1, 2, 3) for bits in combinations(range(22), n)]


def _bucket(key: int, fp: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Verified links that join what belongs together in a bucket of distinct fingerprints."""
    block = key >> 60
    bits = BLOCKS[block][1]
    z = _turned(fp, block) & np.uint64((1 << bits) - 1)
    order = np.argsort(z, kind="stable")
    fp, z = fp[order], z[order]
    heads, at, inverse = np.unique(z, return_index=True, return_inverse=True)
    links = [(fp, fp[at[inverse]])]
    for b in range(bits):
        other = heads ^ np.uint64(1 << b)
        up = other > heads
        found = np.minimum(np.searchsorted(heads, other), len(heads) - 1)
        up &= heads[found] == other
        links.append((fp[at[up]], fp[at[found[up]]]))
    same = np.sort(fp[_keys(fp, block) == np.uint64(key & ((1 << 60) - 1))])
    if 1 < len(same) <= 256:
        a, b = np.triu_indices(len(same), 1)
        links.append((same[a], same[b]))
    elif len(same) > 256:
        first = np.uint64(BLOCKS[block][0])
        for near in _NEAR:
            if near >> bits == 0:
                other = same ^ (np.uint64(near) << first)
                found = np.minimum(np.searchsorted(same, other), len(same) - 1)
                hit = (same[found] == other) & (other > same)
                links.append((same[hit], other[hit]))
    return links


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links from rows (key, fp) that come sorted by key; a bucket may span batches."""

    def links(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.append(starts, len(key)))
        two = starts[sizes == 2]
        found = [(fp[two], fp[two + 1])]
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            found += _bucket(int(key[s]), fp[s : s + n])
        a, b = np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])
        ok = (a != b) & (np.bitwise_count(a ^ b) <= RADIUS)
        if ok.any():
            pairs = np.unique(np.stack([np.minimum(a[ok], b[ok]), np.maximum(a[ok], b[ok])]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0].view(np.int64)), pa.array(pairs[1].view(np.int64))], names=["a", "b"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        key, fp = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1))
        if not len(key):
            continue
        if key[0] == key[-1]:
            if held and held[-1][0][-1] != key[0]:
                yield from links(*map(np.concatenate, zip(*held, strict=True)))
                held = []
            held.append((key, fp))
            continue
        cut = int(np.searchsorted(key.view(np.int64), key.view(np.int64)[-1]))
        held.append((key[:cut], fp[:cut]))
        yield from links(*map(np.concatenate, zip(*held, strict=True)))
        held = [(key[cut:], fp[cut:])]
    if held:
        yield from links(*map(np.concatenate, zip(*held, strict=True)))


def fingerprint_links(fingerprints: DataFrame) -> DataFrame:
    """Verified links (a, b) among distinct fingerprints (one long column): not all, but
    enough to join every class."""
    n = int(fingerprints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    emitted = fingerprints.mapInArrow(_emit, "key long, fp long")
    return emitted.repartition(n, "key").sortWithinPartitions("key", "fp").mapInArrow(_meet, "a long, b long")


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, also: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``, and the columns ``also``;
    other columns are ignored."""
    more = [c.alias(name) for name, c in (also or {}).items()]
    prints = store(docs.select(F.col(id_col).alias("doc_id"), *more, fingerprint_column(F.col(text_col), shingle).alias("fp")))
    firsts = store(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc")))
    roots = components(fingerprint_links(firsts.select("fp"))).withColumnRenamed("node", "fp")
    linked = store(firsts.join(roots, "fp"))
    smallest = linked.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    joined = linked.join(smallest, "root").select("fp", "component_id")
    classes = store(firsts.join(joined, "fp", "left").select("fp", F.coalesce("component_id", "first_doc").alias("component_id")))
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id", *(also or {}))


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
