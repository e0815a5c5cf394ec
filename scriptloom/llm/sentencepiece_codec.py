"""SentencePiece BPE encoding and decoding without the library's encoder.

Encoding is exact and of merge type, by backtracking. Per segment:

* an Aho-Corasick automaton over the reachable pieces gives the longest piece that
  starts at every position;
* pieces are taken greedily; a new piece must be compatible with the one before it,
  that is, merging the characters of both from scratch gives just these two back;
* when no piece fits, the next shorter prefix piece is tried, then the last piece is
  taken back and its position is marked in a bitfield, so that no position fails twice.

A sequence whose neighbours are all compatible is the one that the merges make.
Words of a column are encoded many at once, by the same steps on arrays (``_bulk``).
Characters outside the vocabulary never merge; they become byte pieces.

Texts: null counts as empty, an empty text has only the end id. Texts of any length
work: they are cut where no piece can reach across (before a space mark, at a line
end that is in no piece), so memory grows with the text, time linearly.
"""

from __future__ import annotations

import re
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptloom.llm.common import pieces, runs

MARK = "▁"
ENCODED = "struct<ids:array<int>,decoded:string>"


def _fields(data: bytes):
    """(number, value) of each field of a protocol-buffers message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield key >> 3, data[at : at + n]
            at += n


class Segments(dict):
    """Ids (as bytes) of segments after a prefix. Two generations: when one is full it
    becomes the older, and what is used again moves back, so frequent segments stay."""

    __slots__ = ("codec", "prefix", "older", "touching", "plain", "longest", "room")

    def __init__(self, codec: PieceCodec, prefix: str):
        super().__init__()
        self.codec, self.prefix, self.older = codec, prefix, {}
        self.touching, self.longest, self.room = codec.touching, codec.SEGMENT, codec.CACHE
        self.plain = self if not prefix else codec.plain

    def __missing__(self, segment: str) -> bytes:
        ids = self.older.get(segment)
        if len(segment) > self.longest:
            return self._encoded(segment)
        if ids is None:
            if segment[-2:] not in self.touching and len(segment) > 1:
                # no piece holds the last two characters side by side: no merge joins them
                head, tail = segment[:-1], self.plain[segment[-1]]
                ids = self.get(head)
                if ids is None:  # a rare word: its bare form is kept
                    return self[head] + tail
                ids += tail
            else:
                ids = self._encoded(segment)
        if len(self) >= self.room:
            self.older = dict(self)
            self.clear()
        self[segment] = ids
        return ids

    def _encoded(self, segment: str) -> bytes:
        text = segment.replace(" ", MARK) if " " in segment else segment
        return array("i", self.codec.encode_segment(self.prefix + text)).tobytes()


class PieceCodec:
    """Encoder and decoder of one model file.

    Supported: BPE models with byte fallback and an identity normaliser that keeps
    white space (others raise ValueError).
    """

    #: Cached segments and pairs per worker, each at most SEGMENT characters.
    CACHE, SEGMENT = 300_000, 48
    #: Words that ``_bulk`` encodes at once, and places (a power of two) for its pairs.
    AT_ONCE, PLACES = 20_000, 1 << 20

    def __init__(self, model_path: str):
        import struct

        names, scores, kinds = [], [], []
        normalizer: dict[int, object] = {}
        trainer: dict[int, object] = {}
        with open(model_path, "rb") as f:
            for number, value in _fields(f.read()):
                if number == 1:
                    piece = dict(_fields(value))
                    names.append(piece.get(1, b"").decode())
                    scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                    kinds.append(piece.get(3, 1))
                elif number == 2:
                    trainer = dict(_fields(value))
                elif number == 3:
                    normalizer = dict(_fields(value))
        if trainer.get(3, 1) != 2 or not trainer.get(35, 0):
            raise ValueError("only BPE models with byte fallback are supported")
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1) or 4 in kinds:
            raise ValueError("only identity normalisation that keeps white space is supported")
        self.dummy_prefix = bool(normalizer.get(3, 1))
        self.names, self.scores, self.kinds = names, scores, kinds
        self.ids = {n: i for i, n in enumerate(names) if kinds[i] in (1, 5)}
        self.byte_id = [0] * 256
        for i, n in enumerate(names):
            if kinds[i] == 6:
                self.byte_id[int(n[3:5], 16)] = i
        self.end = next(i for i, n in enumerate(names) if n == "</s>" and kinds[i] == 3)
        self.raw = [self._raw(i) for i in range(len(names))]
        self.pairs: dict[int, bool] = {}
        reachable = [i for n, i in self.ids.items() if self.merge(n) == [n]]
        self.tokens = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i in reachable:
            self.tokens.add_word(names[i], i)
        self.tokens.make_automaton()
        self.chars = {names[i] for i in reachable if len(names[i]) == 1}
        # merge order, alike for pieces of one score, -1 for what no merge makes, and the last merge of each piece
        order = {score: r for r, score in enumerate(sorted({scores[i] for i in self.ids.values()}, reverse=True))}
        self.rank = [-1] * len(names)
        for i in self.ids.values():
            if len(names[i]) > 1:
                self.rank[i] = order[scores[i]]
        self.split = [(-1, -1)] * len(names)
        for i in reachable:
            if len(names[i]) > 1:
                left, right = self.merge(names[i], stop=2)
                self.split[i] = (self.ids[left], self.ids[right])
        self.size = [len(n) for n in names]
        known = set(reachable)
        self.shorter = [-1] * len(names)
        for i in reachable:
            for n in range(len(names[i]) - 1, 0, -1):
                j = self.ids.get(names[i][:n], -1)
                if j in known:
                    self.shorter[i] = j
                    break
        crossing = any(re.search(f"[^{MARK}]{MARK}", n) for n in self.ids)
        # a line end that is in no piece parts segments as well
        self.line = b"" if any("\n" in n for n in self.ids) else array("i", [self.byte_id[10]]).tobytes()
        line = "\n" if self.line else ""
        self.segments = None if crossing else re.compile(f" *[^ {line}]+| +" + ("|\n" if line else ""))
        self.touching = {n[i : i + 2] for n in self.ids for i in range(len(n) - 1)} | {f" {n[i + 1]}" for n in self.ids for i in range(len(n) - 1) if n[i] == MARK}
        self.touching |= {x.replace(MARK, " ") for x in self.touching}
        self.plain = Segments(self, "")
        self.marked = Segments(self, MARK)
        self._size, self._shorter = np.array(self.size, np.int64), np.array(self.shorter, np.int64)
        self._trie(reachable)
        self._pairs, self._holds = np.full(self.PLACES, -1, np.int64), np.zeros(self.PLACES, bool)

    def _raw(self, i: int) -> bytes:
        if self.kinds[i] == 6:
            return bytes([int(self.names[i][3:5], 16)])
        if self.kinds[i] == 3:
            return b"\xff"  # in no UTF-8 text; see decode
        if self.kinds[i] == 2:
            return " ⁇ ".encode()
        return self.names[i].replace(MARK, " ").encode()

    def merge(self, text: str, stop: int = 1) -> list[str]:
        """Plain merging from single characters: best score first, leftmost among equals,
        down to ``stop`` parts at least."""
        parts = list(text)
        while len(parts) > stop:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the characters of both pieces from scratch gives them back.

        Only merges across the border can spoil that. Both pieces are re-merged in
        thought, latest merge first: at each moment the pieces at the border are the
        right spine of ``a`` and the left spine of ``b``, and a merge of the two that
        comes before the merge just undone (of equals the left one is first) would have
        happened."""
        key = a << 32 | b
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= 2 * self.CACHE:
                self.pairs.clear()
            found = self.pairs[key] = self._border_holds(a, b)
        return found

    def _border_holds(self, a: int, b: int) -> bool:
        names, ids, rank, split = self.names, self.ids, self.rank, self.split
        latest = len(names)
        while True:
            joined = ids.get(names[a] + names[b])
            if joined is not None and rank[joined] < latest:
                return False
            if rank[a] > rank[b]:
                latest = rank[a]
                a = split[a][1]
            elif rank[b] >= 0:
                latest = rank[b] + 1
                b = split[b][0]
            else:
                return True

    def encode_segment(self, text: str) -> list[int]:
        """Ids of a text in which spaces are already marks."""
        if self.chars.issuperset(text):
            return self._merged(text)
        ids: list[int] = []
        start = 0
        for k, c in enumerate(text):
            if c not in self.chars:
                if k > start:
                    ids += self._merged(text[start:k])
                ids += [self.byte_id[b] for b in c.encode("utf-8", "surrogatepass")] if c not in self.ids else [self.ids[c]]
                start = k + 1
        return ids + self._merged(text[start:]) if start < len(text) else ids

    def _merged(self, text: str) -> list[int]:
        """Ids of known characters. Mostly the automaton's longest matches, one after the
        other, are compatible and so the answer; backtracking starts where they are not."""
        chosen = [token for _, token in self.tokens.iter_long(text)]
        known, k, a = self.pairs.get, 0, -1
        for b in chosen:
            if k:
                fits = known(a << 32 | b)
                if fits is None:
                    fits = self.compatible(a, b)
                if not fits:
                    return self._backtrack(text, chosen, k)
            k += 1
            a = b
        return chosen

    def _backtrack(self, text: str, greedy: list[int], k: int) -> list[int]:
        """Ids of a text whose greedy pieces fit up to the k-th."""
        n = len(text)
        tokens, size, shorter = self.tokens, self.size, self.shorter
        longest: dict[int, int] = {n: -1}
        place = at = 0
        for i, token in enumerate(greedy):
            if i == k:
                at = place
            longest[place] = token
            place += size[token]
        failed = bytearray(n // 8 + 1)
        chosen, token = greedy[:k], shorter[greedy[k]]  # the k-th did not fit
        known, compatible = self.pairs.get, self.compatible
        while at < n:
            before = chosen[-1] << 32 if chosen else -1
            while token >= 0:
                end = at + size[token]
                if not failed[end >> 3] >> (end & 7) & 1:
                    if before < 0:
                        break
                    fits = known(before | token)
                    if fits is None:
                        fits = compatible(before >> 32, token)
                    if fits:
                        break
                token = shorter[token]
            if token >= 0:
                chosen.append(token)
                at = end
                if at not in longest:
                    longest[at] = next(tokens.iter_long(text, at))[1]
                token = longest[at]
                continue
            if not chosen:
                raise AssertionError("no encoding; the vocabulary lacks a character")
            failed[at >> 3] |= 1 << (at & 7)
            last = chosen.pop()
            at -= size[last]
            token = shorter[last]
        return chosen

    def _fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``compatible`` of many pairs. Each pair has one place in a table, where it may
        be replaced by another."""
        keys = a * len(self.names) + b
        places = (keys * 0x9E3779B1 >> 12) & (self.PLACES - 1)
        fits, new = self._holds[places], np.flatnonzero(self._pairs[places] != keys)
        if len(new):
            each, back = np.unique(keys[new], return_inverse=True)
            found = np.fromiter((self._border_holds(*divmod(k, len(self.names))) for k in each.tolist()), bool, len(each))
            fits[new] = found[back]
            at = places[new]
            self._pairs[at] = keys[new]
            self._holds[at] = fits[new]
        return fits

    def _children(self, keys: np.ndarray) -> np.ndarray:
        """Nodes of the trie below others, keys (node << 21 | character); -1 where there is none."""
        places, found = (keys * 0x9E3779B1 >> 12) & (len(self._keys) - 1), np.full(len(keys), -1)
        left = np.arange(len(keys))
        while len(left):
            here = self._keys[places]
            hit = here == keys[left]
            found[left[hit]] = self._nodes[places[hit]]
            on = ~hit & (here >= 0)
            left, places = left[on], (places[on] + 1) & (len(self._keys) - 1)
        return found

    def _trie(self, pieces_: list[int]) -> None:
        """Children by hash, the piece that ends at each node, and the nodes of first characters."""
        nodes: dict[int, int] = {}
        ends: list[int] = [-1]
        for i in pieces_:
            node = 0
            for c in self.names[i]:
                key = node << 21 | ord(c)
                node = nodes.get(key, 0)
                if not node:
                    node = nodes[key] = len(ends)
                    ends.append(-1)
            ends[node] = i
        self._ends = np.array(ends)
        keys, values = np.fromiter(nodes, np.int64, len(nodes)), np.fromiter(nodes.values(), np.int64, len(nodes))
        room = 1 << (4 * len(keys)).bit_length()
        self._keys, self._nodes = np.full(room, -1, np.int64), np.zeros(room, np.int64)
        places = (keys * 0x9E3779B1 >> 12) & (room - 1)
        while len(keys):
            free = np.flatnonzero(self._keys[places] < 0)
            _, first = np.unique(places[free], return_index=True)
            put = free[first]
            self._keys[places[put]], self._nodes[places[put]] = keys[put], values[put]
            keys, values, places = (np.delete(x, put) for x in (keys, values, places))
            places = (places + 1) & (room - 1)
        self._first = np.zeros(1 << 21, np.int32)  # by character; 0 where it is in no piece
        for c in self.chars:
            self._first[ord(c)] = nodes[ord(c)]

    def _bulk(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after the other, and how many each has. A word follows a mark,
        or a line end with which it begins. ``_backtrack`` of all side by side: each step
        takes, shortens or takes back a piece of every word that is not done."""
        size, shorter, stopper = self._size, self._shorter, (1 << 21) - 1
        n = pc.utf8_length(words).to_numpy().astype(np.int64)
        stop = np.cumsum(n + 2) - 1
        start = stop - n - 1
        chars = np.full(int(stop[-1]) + 1, stopper, np.int64)
        chars[start] = ord(MARK)
        chars[runs(start + 1, n)] = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), "<u4")
        lines = (n > 0) & (chars[start + 1] == 10)
        begin = start + 2 * lines
        node = self._first[chars].astype(np.int64)
        # the rest, in which characters are unknown, or which is long, goes one by one
        odd = (n > self.SEGMENT) | (np.add.reduceat(node == 0, start) > 1 + lines)
        longest = np.full(len(chars), -1)
        at = np.flatnonzero(node)
        node, depth = node[at], 0
        while len(at):
            longest[at] = np.where(self._ends[node] >= 0, self._ends[node], longest[at])
            depth += 1
            node = self._children(node << 21 | chars[at + depth])
            at, node = at[node >= 0], node[node >= 0]
        failed = np.zeros(len(chars), bool)
        chosen, many = np.zeros((len(n), int(n[~odd].max(initial=0)) + 2), np.int32), lines.astype(np.int64)
        chosen[lines, 0] = self.byte_id[10]
        at, token = begin.copy(), longest[begin]
        live = np.flatnonzero(~odd & (begin < stop))
        while len(live):
            t, k, here = token[live], many[live], at[live]
            before = chosen[live, k - 1].astype(np.int64)  # without one before it, the last column
            end = here + size[t]
            takes = (t >= 0) & ~failed[np.where(t >= 0, end, 0)]
            asked = np.flatnonzero(takes & (k > lines[live]))
            takes[asked] = self._fit(before[asked], t[asked])
            back = t < 0
            if (back & (k <= lines[live])).any():
                raise AssertionError("no encoding; the vocabulary lacks a character")
            failed[here[back]] = True
            chosen[live[takes], k[takes]] = t[takes]
            many[live] = k + takes - back
            at[live] = here = np.where(takes, end, np.where(back, here - size[before], here))
            token[live] = np.where(takes, longest[here], shorter[np.where(back, before, t)])
            live = live[here < stop[live]]
        many[odd] = 0
        ids = chosen[np.arange(chosen.shape[1]) < many[:, None]]
        if not odd.any():
            return ids, many
        plain, line, rest = self.plain, self.line, {}
        for i in np.flatnonzero(odd).tolist():
            w = words[i].as_py()
            rest[i] = np.frombuffer(self.marked[w] if w[:1] != "\n" else line + plain[w[1:]], "<i4")
        together = many.copy()
        together[list(rest)] = [len(x) for x in rest.values()]
        starts = np.cumsum(together) - together
        each = np.zeros(int(together.sum()), np.int32)
        each[runs(starts, many)] = ids
        for i, found in rest.items():
            each[starts[i] : starts[i] + len(found)] = found
        return each, together

    def _parts(self, text: str) -> list[bytes]:
        """Ids of a text's segments in order, without the end id."""
        if MARK in text:
            text = text.replace(MARK, " ")
        if not (self.line and self.dummy_prefix) or text[0] == " " or "  " in text:
            found = self.segments.findall(" " + text if self.dummy_prefix else text)
            return [self.marked[x[1:]] if x[0] == " " and x[1:2] != " " else self.plain[x] for x in found]
        # single spaces: each but the first word of a later line follows a mark
        marked, parts, first = self.marked.__getitem__, [], True
        for line in text.split("\n"):
            words = line.split(" ")
            if first:
                first = False
                parts.extend(map(marked, words))
                continue
            parts.append(self.line)
            if words[0]:
                parts.append(self.plain[words[0]])
            parts.extend(map(marked, words[1:]))
        return parts

    def encode(self, text: str | None, end: bool = True) -> np.ndarray:
        """All ids of a text as int32, with the end id unless ``end`` is false."""
        tail = self.end.to_bytes(4, "little") if end else b""
        if not text:
            return np.frombuffer(tail, dtype="<i4")
        if self.segments is None:
            body = array("i", self.encode_segment(((MARK if self.dummy_prefix else "") + text).replace(" ", MARK))).tobytes()
        else:
            body = b"".join(self._parts(text))
        return np.frombuffer(body + tail, dtype="<i4")

    def encode_all(self, texts: pa.Array, end: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts, one text after the other, and how many each has.

        Texts with single spaces fall into words at the spaces, where a line end begins a
        word. Each distinct word of the column is encoded once, and its ids are laid out
        wherever it occurs."""
        lengths, ids = np.full(len(texts), int(end), np.int64), np.zeros(0, np.int32)
        plain_spaces = np.zeros(len(texts), bool)
        if self.segments is not None and self.line and self.dummy_prefix and len(texts):
            odd = pc.or_(pc.or_(pc.match_substring(texts, MARK), pc.match_substring(texts, "  ")), pc.or_(pc.starts_with(texts, " "), pc.equal(texts, "")))
            plain_spaces = ~pc.fill_null(odd, True).to_numpy(zero_copy_only=False)
        if plain_spaces.any():
            split = pc.split_pattern(pc.replace_substring(texts.filter(pa.array(plain_spaces)), "\n", " \n"), " ")
            coded = split.flatten().dictionary_encode()
            words = coded.dictionary
            made = [self._bulk(words.slice(a, self.AT_ONCE)) for a in range(0, len(words), self.AT_ONCE)]
            each, many = (np.concatenate(x) for x in zip(*made, strict=True))
            at = coded.indices.to_numpy()
            ids = each[runs((np.cumsum(many) - many)[at], many[at])]
            lengths[plain_spaces] += np.add.reduceat(many[at], split.offsets.to_numpy()[:-1])
        others = {i: self.encode(texts[i].as_py(), False) for i in np.flatnonzero(~plain_spaces).tolist()}
        for i, found in others.items():
            lengths[i] += len(found)
        ends = np.cumsum(lengths)
        out = np.full(int(ends[-1]) if len(ends) else 0, self.end, np.int32)
        begins = ends - lengths
        out[runs(begins[plain_spaces], lengths[plain_spaces] - end)] = ids
        for i, found in others.items():
            out[begins[i] : begins[i] + len(found)] = found
        return out, lengths

    def count(self, text: str | None, end: bool = True) -> int:
        """Number of the ids that ``encode`` gives, without joining them."""
        if not text:
            return int(end)
        if self.segments is None:
            return len(self.encode(text, end))
        return sum(map(len, self._parts(text))) // 4 + end

    def decode(self, ids) -> str:
        """Text of ids, as the library decodes them; control ids vanish, each byte
        that is not UTF-8 becomes U+FFFD."""
        ids = ids.tolist() if isinstance(ids, np.ndarray) else list(ids)
        data = b"".join(map(self.raw.__getitem__, ids)).rstrip(b"\xff")
        try:
            text = data.decode()
        except UnicodeDecodeError:
            text = "".join(self._runs(ids))
        if self.dummy_prefix and text[:1] == " ":  # the prefix goes, once
            first = next((i for i in ids if self.kinds[i] != 3), -1)
            if first >= 0 and self.names[first].startswith(MARK):
                return text[1:]
        return text

    def _runs(self, ids):
        run = bytearray()
        for i in [*ids, -1]:
            if i >= 0 and self.kinds[i] == 6:
                run += self.raw[i]
                continue
            while run:
                for n in range(1, 5):
                    try:
                        yield bytes(run[:n]).decode()
                        del run[:n]
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    yield "�"
                    del run[:1]
            if i >= 0 and self.kinds[i] != 3:
                yield self.raw[i].decode()


_codecs: dict[str, PieceCodec] = {}


def codec(model_path: str) -> PieceCodec:
    """The codec of a model file, built once in each Python worker."""
    if model_path not in _codecs:
        _codecs[model_path] = PieceCodec(model_path)
    return _codecs[model_path]


def _lists(ids: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))


def _sliced(texts: pa.Array) -> list[pa.Array]:
    """A column in slices of a bounded size."""
    return [b.column(0) for b in pieces([pa.RecordBatch.from_arrays([texts], names=["t"])], 0)]


def encode(text: Column, model_path: str, end: bool = True) -> Column:
    """Column of id arrays."""

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        c = codec(model_path)
        return pa.concat_arrays([pa.array([], pa.list_(pa.int32())), *[_lists(*c.encode_all(t, end)) for t in _sliced(texts)]])

    return ids(text)


def decode(ids: Column, model_path: str) -> Column:
    """Column of texts of id arrays; a null array gives an empty text."""

    @F.arrow_udf("string")
    def texts(arrays: pa.Array) -> pa.Array:
        c = codec(model_path)
        return pa.array([c.decode(a.as_py() or []) for a in arrays], pa.string())

    return texts(ids)


def encode_decode(text: Column, model_path: str, end: bool = True) -> Column:
    """Column of struct<ids, decoded>: both directions in one pass to the workers."""

    @F.arrow_udf(ENCODED)
    def both(texts: pa.Array) -> pa.Array:
        c = codec(model_path)
        lists, decoded = [pa.array([], pa.list_(pa.int32()))], [pa.array([], pa.string())]
        for some in _sliced(texts):
            ids, lengths = c.encode_all(some, end)
            lists.append(_lists(ids, lengths))
            decoded.append(pa.array([c.decode(a) for a in np.split(ids, np.cumsum(lengths)[:-1])], pa.string()))
        return pa.StructArray.from_arrays([pa.concat_arrays(lists), pa.concat_arrays(decoded)], names=["ids", "decoded"])

    return both(text)
