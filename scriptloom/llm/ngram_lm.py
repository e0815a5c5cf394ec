"""Language-model scores from an Elias-Fano n-gram trie.

Learning. Words (lower-cased [^\\x20\\x09-\\x0D]+, then one end token a text) are counted
by their 64-bit hash. Level 1 of the trie is the sorted hashes of all words, with exact
counts. A node's number is its place in its level. Every text is written once as its
word numbers; counting and scoring read these, so texts are split and words looked up
only once. Level k holds the n-grams of k words that occur at least ``least`` times (1:
all of them). No n-gram is more frequent than a part of it, so those with a part below
``least`` are left out before they are counted; nothing else is.

A level is sorted by (context, word) and cut into chunks, each written by one task as
one file of plain bytes: the contexts, the pointers to the children of each and the
children's word numbers made monotone by a base for each context are Elias-Fano
sequences; probabilities and back-off weights are quantised to 16 bits. Workers map the
files into memory, from the shared folder where it is mounted, else from the executor's
copy that Spark fetches; a search finds the context, then the successor of base + word in
the context's range.

Probabilities are interpolated absolute discounting with the pruned mass in the
back-off, down to P(w) = (c + 1/2) / (N + (V + 1) / 2), which is exact and gives the
base score; so they sum to one over the words and one unknown.

Null and empty texts have the end token only. Without training rows N and V are 0.
Hashes of different words are taken as different: with 10 million words one pair in a
million corpora collides.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptloom.llm.common import file_system, parts, pieces, shared_dir, store, words_of
from scriptloom.llm.elias_fano import EliasFano, U, pack, unpack

ORDER, LEAST, DISCOUNT = 3, 2, 0.75
WORDS_PER_CHUNK, NODES_PER_CHUNK = 1 << 20, 1 << 19
#: Tokens for each partition that sums n-grams; it has no more rows than tokens.
ROWS_PER_PARTITION = 1 << 20
#: Tokens that a task counts or scores at once.
AT_ONCE = 1 << 21
END = "\n"  # no word holds white space
#: Fetch chunks even where they could be mapped from the shared folder.
FETCHED = False
QUANTA = (1 << 16) - 1


def quantise(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """16-bit codes with the offset and step of the codebook."""
    low, high = (float(x.min()), float(x.max())) if len(x) else (0.0, 0.0)
    step = (high - low) / QUANTA or 1.0
    return np.rint((x - low) / step).astype(np.uint16), low, step


def _bytes(*arrays: np.ndarray) -> bytes:
    """Arrays as 64-bit words after a directory of their lengths."""
    words = []
    for a in arrays:
        raw = np.ascontiguousarray(a).tobytes()
        words.append(np.frombuffer(raw + b"\0" * (-len(raw) % 8), U))
    return np.concatenate([np.array([len(words), *map(len, words)], U), *words]).tobytes()


def _arrays(words: np.ndarray) -> list[np.ndarray]:
    n = int(words[0])
    ends = np.cumsum(words[1 : 1 + n].astype(np.int64)) + 1 + n
    return [words[a:b] for a, b in zip([1 + n, *ends[:-1]], ends, strict=True)]


def word_chunk(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    """Level-1 chunk of sorted unsigned hashes."""
    width = max(1, int(counts.max(initial=0)).bit_length())
    return _bytes(EliasFano.build(hashes - hashes[0]), np.array([hashes[0], hashes[-1], width], U), pack(counts, width))


class WordChunk:
    def __init__(self, words: np.ndarray):
        ef, head, self.counts = _arrays(words)
        self.keys, (self.first, self.last, width) = EliasFano(ef), (head[0], head[1], int(head[2]))
        self.width, self.n = width, self.keys.n

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places of hashes, -1 where there is none."""
        inside = (hashes >= self.first) & (hashes <= self.last)
        at = self.keys.successor(np.where(inside, hashes - self.first, U(0)))
        at = np.minimum(at, self.n - 1)
        return np.where(inside & (self.keys.access(at) == hashes - self.first), at, -1)

    def count(self, at: np.ndarray) -> np.ndarray:
        return unpack(self.counts, self.width, at).astype(np.int64)


def gram_chunk(context: np.ndarray, word: np.ndarray, logp: np.ndarray, count: np.ndarray, back: np.ndarray) -> bytes:
    """Chunk of level k > 1; rows sorted by (context, word), ``back`` for each row's context."""
    owners, begin = np.unique(context, return_index=True)
    ends = np.append(begin[1:], len(context))
    base = np.concatenate(([0], np.cumsum(word[ends - 1].astype(np.int64) + 1)[:-1]))
    values = word + np.repeat(base, ends - begin)
    p, p_low, p_step = quantise(logp)
    b, b_low, b_step = quantise(back[begin])
    width = max(1, int(count.max(initial=0)).bit_length())
    head = np.array([context[0], word[0], context[-1], word[-1], width, len(owners)], np.int64).view(U)
    scales = np.array([p_low, p_step, b_low, b_step]).view(U)
    return _bytes(
        head, scales, EliasFano.build(owners - owners[0]), EliasFano.build(np.append(begin, len(context))), EliasFano.build(values), p, b, pack(count, width)
    )


class GramChunk:
    def __init__(self, words: np.ndarray):
        head, scales, owners, begins, values, p, b, self.counts = _arrays(words)
        h = head.view(np.int64)
        self.first, self.last, self.width = (int(h[0]), int(h[1])), (int(h[2]), int(h[3])), int(h[4])
        self.p_low, self.p_step, self.b_low, self.b_step = scales.view(np.float64)
        self.owners, self.begins, self.values = EliasFano(owners), EliasFano(begins), EliasFano(values)
        self.p, self.b, self.n = p.view(np.uint16), b.view(np.uint16), self.values.n

    def contexts(self, context: np.ndarray) -> np.ndarray:
        inside = (context >= self.first[0]) & (context <= self.last[0])
        at = np.minimum(self.owners.successor(np.where(inside, context - self.first[0], 0).astype(U)), self.owners.n - 1)
        return np.where(inside & (self.owners.access(at).astype(np.int64) == context - self.first[0]), at, -1)

    def find(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the n-gram or -1, place of its context or -1)."""
        # each context once: what is asked comes sorted
        new = np.concatenate(([True], context[1:] != context[:-1]))
        group = np.cumsum(new) - 1
        owner = self.contexts(context[new])
        o = np.maximum(owner, 0)
        begin, end = self.begins.access(o).astype(np.int64), self.begins.access(o + 1).astype(np.int64)
        base = np.where(begin > 0, self.values.access(np.maximum(begin - 1, 0)).astype(np.int64) + 1, 0)
        owner, begin, end, base = owner[group], begin[group], end[group], base[group]
        wanted = (base + word).astype(U)
        at = self.values.successor(wanted)
        likely = np.flatnonzero((owner >= 0) & (at >= begin) & (at < end))
        hit = likely[self.values.access(at[likely]) == wanted[likely]]
        found = np.full(len(at), -1, np.int64)
        found[hit] = at[hit]
        return found, owner

    def logp(self, at: np.ndarray) -> np.ndarray:
        return self.p_low + self.p_step * self.p[at]

    def back(self, owner: np.ndarray) -> np.ndarray:
        return self.b_low + self.b_step * self.b[owner]

    def count(self, at: np.ndarray) -> np.ndarray:
        return unpack(self.counts, self.width, at).astype(np.int64)


class Trie:
    """The levels written so far: addresses of chunk files, in order, and totals."""

    def __init__(self, levels: list[list[str]], total: int, distinct: int, least: int = LEAST):
        self.names, self.total, self.distinct, self.least = levels, total, distinct, least
        self.levels: list[list] | None = None

    def __getstate__(self):
        return self.names, self.total, self.distinct, self.least

    def __setstate__(self, state):
        self.names, self.total, self.distinct, self.least = state
        self.levels = None

    @property
    def kind(self) -> np.dtype:
        """Of word numbers plus one, as texts are written."""
        return np.dtype("<u4" if self.distinct < (1 << 32) - 1 else "<u8")

    def open(self) -> Trie:
        if self.levels is None:
            self.levels = []
            for k, names in enumerate(self.names):
                maps = [np.memmap(_local(n), np.uint8, "r").view(np.ndarray) for n in names]
                self.levels.append([(WordChunk if k == 0 else GramChunk)(m[:-1].view(U)) for m in maps])
            self.levels = self.levels or [[]]
            self.starts = [np.concatenate(([0], np.cumsum([c.n for c in level]))).astype(np.int64) for level in self.levels]
        return self

    def words(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of words, -1 for unknown ones."""
        out = np.full(len(hashes), -1, np.int64)
        chunks = self.levels[0]
        if chunks:
            of = np.searchsorted(np.array([c.first for c in chunks], U), hashes, side="right") - 1
            for i, sel in _by_chunk(of):
                at = chunks[i].find(hashes[sel])
                out[sel] = np.where(at >= 0, at + self.starts[0][i], -1)
        return out

    def _each(self, level: int, number: np.ndarray, of: str) -> np.ndarray:
        out = np.zeros(len(number))
        for i, sel in _by_chunk(np.searchsorted(self.starts[level], number, side="right") - 1):
            out[sel] = getattr(self.levels[level][i], of)(number[sel] - self.starts[level][i])
        return out

    def counts(self, level: int, number: np.ndarray) -> np.ndarray:
        return self._each(level, number, "count").astype(np.int64)

    def grams(self, level: int, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number or -1, log10 probability, log10 back-off weight) of n-grams given as
        context number and word number; 0 where there is none."""
        n = len(context)
        number, logp, back = np.full(n, -1, np.int64), np.zeros(n), np.zeros(n)
        chunks = self.levels[level] if level < len(self.levels) else []
        if not chunks or not n:
            return number, logp, back
        contexts, words = np.array([c.first[0] for c in chunks]), np.array([c.first[1] for c in chunks])
        of = np.searchsorted(contexts, context, side="right") - 1
        while (later := (of >= 0) & (contexts[of] == context) & (words[of] > word)).any():
            of = of - later
        # a context may begin in a later chunk than the one that would hold the n-gram
        of = np.where((of < 0) | ((contexts[np.minimum(of + 1, len(chunks) - 1)] == context) & (np.array([c.last[0] for c in chunks])[np.maximum(of, 0)] < context)), np.minimum(of + 1, len(chunks) - 1), of)
        for i, sel in _by_chunk(of):
            at, owner = chunks[i].find(context[sel], word[sel])
            back[sel] = np.where(owner >= 0, chunks[i].back(np.maximum(owner, 0)), 0)
            number[sel] = np.where(at >= 0, at + self.starts[level][i], -1)
            logp[sel] = np.where(at >= 0, chunks[i].logp(np.maximum(at, 0)), 0)
        return number, logp, back

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.total + 0.5 * (self.distinct + 1)))


def _by_chunk(of: np.ndarray) -> Iterator[tuple[int, np.ndarray | slice]]:
    """(chunk, places) for each chunk that occurs; places below 0 are in none."""
    if not len(of):
        return
    low, high = int(of.min()), int(of.max())
    if low == high >= 0:
        yield low, slice(None)
        return
    for i in np.flatnonzero(np.bincount(of[of >= 0])) if high >= 0 else ():
        yield int(i), np.flatnonzero(of == i)


class Words:
    """Numbers of words for a worker. Words that are frequent in training are
    kept, up to KEEP of them; the others are looked up for each batch."""

    KEEP, FREQUENT = 300_000, 8

    def __init__(self, trie: Trie):
        self.trie = trie.open()
        self.number: dict[bytes, int] = {}

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(word numbers, -1 for unknown ones, with the end token after each text; tokens
        of each text)."""
        every: list[bytes] = []
        lengths = []
        end = END.encode()
        for t in texts:
            words = words_of(t)
            every += words
            every.append(end)
            lengths.append(len(words) + 1)
        kept = self.number.get
        number = np.array([kept(w, -2) for w in every], np.int64)
        missed = np.flatnonzero(number == -2)
        if len(missed):
            asked = [every[i] for i in missed.tolist()]
            new = list(dict.fromkeys(asked))
            found = self.trie.words(np.array([xxhash.xxh64_intdigest(w, 42) for w in new], U))
            local = dict(zip(new, found.tolist(), strict=True))
            number[missed] = np.fromiter(map(local.__getitem__, asked), np.int64, len(asked))
            if (room := self.KEEP - len(self.number)) > 0:
                known = np.flatnonzero(found >= 0)
                frequent = known[self.trie.counts(0, found[known]) >= self.FREQUENT][:room]
                self.number.update((new[i], int(found[i])) for i in frequent.tolist())
        return number, np.array(lengths, np.int64)


def _number_of_end(trie: Trie) -> int:
    return int(trie.words(np.array([xxhash.xxh64_intdigest(END.encode(), 42)], U))[0])


def _numbers(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """(word numbers, tokens of each text) of a column that ``words_column`` made."""
    if not len(column):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind)
    return data.astype(np.int64) - 1, np.diff(ends).astype(np.int64) // kind.itemsize


def _gathered(columns: Iterator[pa.Array], kind: np.dtype) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same of whole texts with about AT_ONCE tokens together."""
    held, size = [], 0
    for column in columns:
        held.append(_numbers(column, kind))
        size += len(held[-1][0])
        if size >= AT_ONCE:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, size = [], 0
    if size:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _before(numbers: np.ndarray, lengths: np.ndarray, start: int) -> np.ndarray:
    """The word before each; ``start`` before the first of a text."""
    out = np.empty_like(numbers)
    out[1:] = numbers[:-1]
    out[np.concatenate(([0], np.cumsum(lengths)[:-1]))] = start
    return out


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    wide = int(b.max(initial=0)) + 2
    if (int(a.max(initial=0)) + 2) * wide < 2**62:
        order = np.argsort((a + 1) * wide + b + 1)
    else:
        order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    group = np.empty(len(a), np.int64)
    group[order] = np.cumsum(new) - 1
    return a[new], b[new], group


def _grams(trie: Trie, level: int, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``Trie.grams``, each distinct n-gram looked up once; a word -1 is in none."""
    c, w, group = _distinct(context, word)
    number, logp, back = trie.grams(level, c, np.maximum(w, 0))
    return np.where(w < 0, -1, number)[group], logp[group], back[group]


def _local(address: str) -> str:
    """Where a worker finds a chunk. A folder of the file system that driver and executors
    share is mounted on each of them; other stores' files were fetched by Spark."""
    where = urlsplit(address)
    return SparkFiles.get(where.path) if where.scheme == "fetched" else unquote(where.path)


def _write_chunks(made: DataFrame) -> list[str]:
    """Write rows (chunk binary), one a partition, as one file each; their addresses in the
    order of partitions. From stores that cannot be mapped into memory every executor
    fetches them."""
    spark = made.sparkSession
    folder = shared_dir(spark)
    made.select(F.col("chunk").cast("string").alias("value")).write.text(folder)
    fs, path = file_system(spark, folder)
    files = sorted(str(s.getPath().toString()) for s in fs.listStatus(path) if s.getPath().getName().startswith("part-") and s.getLen() > 1)
    if files and urlsplit(files[0]).scheme == "file" and not FETCHED:
        return files
    for f in files:
        spark.sparkContext.addFile(f)
    return [f"fetched:{f.rpartition('/')[2]}" for f in files]


def _all(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray] | None:
    held = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
    return [np.concatenate(c) for c in zip(*held, strict=True)] if held else None


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 0, 32 << 20):
        counts: Counter = Counter()
        for t in batch.column(0):
            counts.update(words_of(t.as_py()))
        counts[END.encode()] += batch.num_rows
        hashes = np.array([xxhash.xxh64_intdigest(w, 42) for w in counts], U)
        yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(counts.values(), pa.int64())], names=["h", "n"])


def words_column(text: Column, trie: Trie) -> Column:
    """Column of a text's word numbers plus one (0: unknown word), the end token last, as
    little-endian integers of ``trie.kind``."""
    state: dict[str, Words] = {}

    @F.arrow_udf("binary")
    def numbers(texts: pa.Array) -> pa.Array:
        if "words" not in state:
            state["words"] = Words(trie)
        made = [pa.array([], pa.binary())]
        for batch in pieces([pa.RecordBatch.from_arrays([texts], names=["t"])], 0):
            number, lengths = state["words"].read(batch.column(0).to_pylist())
            raw = (number + 1).astype(trie.kind)
            ends = np.concatenate(([0], np.cumsum(lengths * trie.kind.itemsize))).astype(np.int32)
            made.append(pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw.tobytes())]))
        return pa.concat_arrays(made)

    return numbers(text)


def fit(texts: DataFrame, order: int = ORDER, least: int = LEAST) -> Trie:
    """The trie of the texts (column text)."""
    return fit_rows(texts.select("text"), F.lit(True), order, least)[0]


def fit_rows(docs: DataFrame, training: Column, order: int = ORDER, least: int = LEAST) -> tuple[Trie, DataFrame]:
    """The trie of the rows of ``docs`` (column text) for which ``training`` holds, and all
    rows as a written table, with the column ``words`` for ``score_column`` in place of
    the text."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    trie = vocabulary(docs.where(training).select("text"), least)
    read = docs.select(F.struct(*others, F.lit(0)).alias("row"), F.coalesce(training, F.lit(False)).alias("training"), words_column(F.col("text"), trie).alias("words"))
    rows = store(read, "zstd")
    for level in range(1, order if trie.total else 0):
        if not _add_level(rows.where("training").select("words"), trie, level):
            break
    return trie, rows.select(*[F.col("row")[c].alias(c) for c in docs.columns if c != "text"], "words")


def vocabulary(texts: DataFrame, least: int = LEAST) -> Trie:
    """The first level, of the texts (column text)."""
    unigrams = store(texts.mapInArrow(_count_words, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    sums = unigrams.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    trie = Trie([], sums.n, sums.v, least)
    if not sums.v:
        return trie
    chunks = parts(sums.v, WORDS_PER_CHUNK)

    def first_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if columns := _all(batches):
            hashes, counts = columns[0].view(U), columns[1]
            order_ = np.argsort(hashes)
            yield pa.RecordBatch.from_arrays([pa.array([word_chunk(hashes[order_], counts[order_])])], names=["chunk"])

    # unsigned ranges of the hash: its top 31 bits, in equal parts
    part = F.floor(F.shiftrightunsigned("h", 33) * chunks / (1 << 31)).cast("int")
    trie.names.append(_write_chunks(unigrams.repartitionById(chunks, part).mapInArrow(first_level, "chunk binary")))
    return trie


def _counted(context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams, sorted, and how often each occurs."""
    bits = int(word.max(initial=0)).bit_length()
    if int(context.max(initial=0)).bit_length() + bits <= 62:
        key = np.sort(context << bits | word)
        new = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
        return key[new] >> bits, key[new] & ((1 << bits) - 1), np.diff(np.append(new, len(key)))
    c, w, group = _distinct(context, word)
    return c, w, np.bincount(group, minlength=len(c))


def _spread(context: np.ndarray, word: np.ndarray, over: int) -> np.ndarray:
    """The partition of each n-gram, by hash."""
    with np.errstate(over="ignore"):
        x = (context.astype(U) * U(0x9E3779B97F4A7C15)) ^ (word.astype(U) * U(0xC2B2AE3D27D4EB4F))
        x = (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)
    part = ((x >> U(32)) % U(over)).astype(np.int64)
    return part.astype(np.uint16) if over <= 1 << 16 else part


def _squeeze(context: np.ndarray, word: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted n-grams with their counts, compressed: steps between contexts, and all
    numbers by their bytes of like weight, so that the empty ones vanish."""
    columns = np.stack([np.diff(context, prepend=0), word, n]).astype("<i8")
    return zstandard.compress(np.ascontiguousarray(columns.view(np.uint8).reshape(3, -1, 8).transpose(0, 2, 1)).tobytes(), 1)


def _spread_out(grams: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same n-grams again."""
    raw = np.frombuffer(zstandard.decompress(grams), np.uint8).reshape(3, 8, -1)
    steps, word, n = np.ascontiguousarray(raw.transpose(0, 2, 1)).reshape(3, -1).view("<i8")
    return np.cumsum(steps), word, n


def _known(trie: Trie, numbers: np.ndarray) -> np.ndarray:
    """Word numbers, -1 for words that are unknown or below ``trie.least``."""
    return np.where((numbers >= 0) & (trie.counts(0, np.maximum(numbers, 0)) >= trie.least), numbers, -1)


def _add_level(rows: DataFrame, trie: Trie, level: int) -> bool:
    # an n-gram's counts meet in one of many small partitions
    spread_over = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts(trie.total, ROWS_PER_PARTITION))

    def sum_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (context, word, n) summed by n-gram; those below ``least`` go."""
        held = [_spread_out(x.as_py()) for b in batches for x in b.column(1)]
        if not held:
            return
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        c, w, group = _distinct(columns[0], columns[1])
        n = np.bincount(group, weights=columns[2], minlength=len(c)).astype(np.int64)
        keep = n >= trie.least
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (c, w, n)], names=["context", "word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = trie.open()
        start = _number_of_end(t)
        for numbers, lengths in _gathered((b.column(0) for b in batches), t.kind):
            kept = _known(t, numbers)
            context = _before(kept, lengths, start)
            for below in range(1, level):
                known = np.full(len(kept), -1, np.int64)
                ok = np.flatnonzero((context >= 0) & (kept >= 0))
                known[ok] = _grams(t, below, context[ok], kept[ok])[0]
                context = _before(known, lengths, -1)
                kept = np.where(known >= 0, kept, -1)
            ok = np.flatnonzero((context >= 0) & (kept >= 0))
            counted = _counted(context[ok], kept[ok])
            part = _spread(*counted[:2], spread_over)
            order = np.argsort(part, kind="stable")
            starts = np.flatnonzero(np.diff(part[order].astype(np.int64), prepend=-1))
            rows = [_squeeze(*(x[some] for x in counted)) for some in np.split(order, starts[1:])] if len(order) else []
            yield pa.RecordBatch.from_arrays([pa.array(part[order[starts]], pa.int32()), pa.array(rows, pa.binary())], names=["part", "grams"])

    counted = rows.mapInArrow(count, "part int, grams binary").repartitionById(spread_over, F.col("part"))
    grams = store(counted.mapInArrow(sum_grams, "context long, word long, n long"))
    size = grams.count()
    if not size:
        return False
    kept = store(grams.groupBy("context").agg(F.sum("n").alias("kept"), F.count("*").alias("types")))
    nodes = store(grams.join(kept, "context").select("context", "word", "n", "kept", "types"))

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = _all(batches)
        if columns is None:
            return
        t = trie.open()
        context, word, n, kept_, types = columns
        uses = t.counts(level - 1, context)
        back = 1 - (kept_ - DISCOUNT * types) / uses
        p = (n - DISCOUNT) / uses + back * 10 ** _lower(t, level, context, word)
        yield pa.RecordBatch.from_arrays([pa.array([gram_chunk(context, word, np.log10(p), n, np.log10(np.maximum(back, 1e-12)))])], names=["chunk"])

    spread = nodes.repartitionByRange(parts(size, NODES_PER_CHUNK), "context", "word").sortWithinPartitions("context", "word")
    trie.names.append(_write_chunks(spread.mapInArrow(chunk, "chunk binary")))
    trie.levels = None
    return True


def _lower(trie: Trie, level: int, context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """log10 probability of the words after their contexts less the first word."""
    if level == 1:
        return trie.unigram(trie.counts(0, word))
    # the context (u, v) as numbers of the level below: its own word v is its suffix
    suffix = _last_word(trie, level - 1, context)
    number, logp, back = trie.grams(1, suffix, word)
    return np.where(number >= 0, logp, back + trie.unigram(trie.counts(0, word)))


def _last_word(trie: Trie, level: int, number: np.ndarray) -> np.ndarray:
    """The last word of the n-grams with these numbers."""
    out = np.zeros(len(number), np.int64)
    for i, sel in _by_chunk(np.searchsorted(trie.starts[level], number, side="right") - 1):
        c = trie.levels[level][i]
        at = number[sel] - trie.starts[level][i]
        begins = c.begins.access(np.arange(c.begins.n)).astype(np.int64)
        begin = begins[np.searchsorted(begins[:-1], at, side="right") - 1]
        base = np.where(begin > 0, c.values.access(np.maximum(begin - 1, 0)).astype(np.int64) + 1, 0)
        out[sel] = c.values.access(at).astype(np.int64) - base
    return out


SCORED = "struct<n_tokens:long,n_known:long,base_score:double,score:double>"


def score_numbers(trie: Trie, numbers: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """(tokens, known tokens, base score, score) of texts given as word numbers."""
    counts = np.where(numbers >= 0, trie.counts(0, np.maximum(numbers, 0)), 0) if trie.total else np.zeros(len(numbers), np.int64)
    base = trie.unigram(counts)
    score = base.copy()
    # rare and unknown words are in no n-gram, but back off from their contexts as well
    kept = np.where(counts < trie.least, -1, numbers)
    context = _before(kept, lengths, _number_of_end(trie))
    for level in range(1, len(trie.levels)):
        at = np.flatnonzero(context >= 0)
        number, logp, back = _grams(trie, level, context[at], kept[at])
        score[at] = np.where(number >= 0, logp, score[at] + back)
        known = np.full(len(kept), -1, np.int64)
        known[at] = number
        context = _before(known, lengths, -1)
    first = np.cumsum(lengths) - lengths
    return lengths, np.add.reduceat((counts > 0).astype(np.int64), first), np.add.reduceat(base, first), np.add.reduceat(score, first)


def score_column(words: Column, trie: Trie) -> Column:
    """Column of struct<n_tokens, n_known, base_score, score> of ``words_column``."""

    @F.arrow_udf(SCORED)
    def score(column: pa.Array) -> pa.Array:
        t = trie.open()
        made = [score_numbers(t, *x) for x in _gathered((column.slice(a, 256) for a in range(0, len(column), 256)), t.kind)]
        columns = [np.concatenate(c) for c in zip(*made, strict=True)] if made else [np.zeros(0)] * 4
        kinds = (np.int64, np.int64, np.float64, np.float64)
        return pa.StructArray.from_arrays([pa.array(c.astype(k)) for c, k in zip(columns, kinds, strict=True)], names=["n_tokens", "n_known", "base_score", "score"])

    return score(words)
