"""Secret scans with corpus-wide ownership frequency.

One pass over the texts finds the base matches and further candidates (long mixed
tokens). Candidates are hashed; the hashes are aggregated over the whole corpus by
distinct owners and repositories. A credential is an example that was copied around
(``example``) if ``WIDE`` owners hold it, or if several do and it lies in ``WIDE_REPOS``
repositories. Any other that looks random is likely live (``live``): an owner's own key
stays one however many of its repositories repeat it. Both add spans; base spans always
stay.

Texts never move: only spans and hashes are shuffled. A hash that a third of all rows
share is pre-aggregated before its exchange, and rows meet verdicts in a join that
Spark can split.

Null and empty texts have no spans. Positions are code points, ends exclusive.
Repeated rows and ids are rows of their own. A null owner or repository counts as one
of the name ''.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptloom.llm.common import store

#: Owners, and repositories of more than one owner, from which on a credential counts as a
#: copied example.
WIDE, WIDE_REPOS = 3, 6
#: A live-looking value has at least so many characters and bits of entropy a character.
LEAST, ENTROPY = 16, 3.0

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
MIXED = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}={0,2}")
_KEYWORD = re.compile(r"passw|secret|token|api_?key", re.I | re.A)

SPAN = "struct<kind:string,start:int,stop:int>"
FOUND = f"struct<base:array<{SPAN}>,candidates:array<struct<start:int,stop:int,hash:long,random:boolean>>>"
_ORDER = {"assign": 0, "access": 1, "hex": 2, "live": 3, "example": 4}


def random_looking(value: str) -> bool:
    """Long, of letters and digits, with the entropy of a random string."""
    n = len(value)
    if n < LEAST or value.isalpha() or value.isdigit():
        return False
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) >= ENTROPY


@dataclass(frozen=True)
class Match:
    kind: str
    start: int
    stop: int
    value: str
    at: int  # where the value begins


def base_matches(text: str | None) -> list[Match]:
    """The three base kinds, by start, then kind. A maximal run that is long enough is
    all that can match ``access`` and ``hex``; ``assign`` matches are found first and
    dropped after if their value is short, for a failing match also consumes text."""
    text = text or ""
    found = []
    if _KEYWORD.search(text):
        found = [Match("assign", m.start(), m.end(), m[2], m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [Match("access", m.start(), m.end(), m[0], m.start()) for m in ACCESS.finditer(text)]
    found += [Match("hex", m.start(), m.end(), m[0], m.start()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda m: (m.start, _ORDER[m.kind]))


def candidates(text: str | None, base: list[Match]) -> list[tuple[int, int, str]]:
    """(start, stop, value) of the base values and of further long mixed tokens."""
    found = {(m.at, m.at + len(m.value)): m.value for m in base}
    covered, at, reach = sorted(found), 0, 0
    for m in MIXED.finditer(text or ""):
        while at < len(covered) and covered[at][0] < m.end():
            reach = max(reach, covered[at][1])
            at += 1
        if reach <= m.start():
            found[m.span()] = m[0]
    return [(a, b, v) for (a, b), v in sorted(found.items())]


def find_column(text: Column) -> Column:
    @F.arrow_udf(FOUND)
    def find(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts:
            text = t.as_py()
            base = base_matches(text)
            rows.append(
                {
                    "base": [{"kind": m.kind, "start": m.start, "stop": m.stop} for m in base],
                    "candidates": [
                        {"start": a, "stop": b, "hash": xxhash.xxh64_intdigest(v.encode()) - 2**63, "random": random_looking(v)}
                        for a, b, v in candidates(text, base)
                    ],
                }
            )
        span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])
        cand = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("hash", pa.int64()), ("random", pa.bool_())])
        return pa.array(rows, pa.struct([("base", pa.list_(span)), ("candidates", pa.list_(cand))]))

    return find(text)


def ownership(found: DataFrame) -> DataFrame:
    """(hash, owners, repositories) over rows (hash, owner, repo). A repository belongs to
    its owner: one name under two owners is two."""
    per_owner = found.select("hash", "owner", "repo").distinct().groupBy("hash", "owner").agg(F.count("*").alias("repos"))
    return per_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repositories"))


def scan(docs: DataFrame, keys: list[str], text: Column, owner: Column, repo: Column) -> DataFrame:
    """A row for each of ``docs``: the ``keys`` columns, ``base`` and ``added`` spans
    (arrays of kind, start, stop in code points)."""
    none = F.lit("")
    read = docs.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.coalesce(owner.cast("string"), none).alias("owner"),
        F.coalesce(repo.cast("string"), none).alias("repo"),
        find_column(text).alias("found"),
    )
    # the ids are fixed by the write; what is read later is never computed again
    rows = store(read.select("*", F.monotonically_increasing_id().alias("row")))
    each = rows.select("row", "owner", "repo", F.explode("found.candidates").alias("c")).select("row", "owner", "repo", "c.*")
    verdicts = store(ownership(each))
    copied = (F.col("owners") >= WIDE) | ((F.col("owners") > 1) & (F.col("repositories") >= WIDE_REPOS))
    kind = F.when(copied, "example").when(F.col("random"), "live")
    judged = each.select("row", "hash", "start", "stop", "random").join(verdicts, "hash").withColumn("kind", kind).where("kind is not null")
    added = judged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "kind"))).alias("added"))
    named = F.transform(F.coalesce("added", F.array()), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))
    return rows.join(added, "row", "left").select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], F.col("found.base").alias("base"), named.alias("added"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined, by start, then kind as listed."""
    rank = F.create_map(*[F.lit(x) for pair in _ORDER.items() for x in pair])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(text: str, spans: list[tuple[int, int]], mark: str = "[secret]") -> str:
    """The text with the (merged) spans replaced by a mark."""
    out, at = [], 0
    for a, b in sorted(spans):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join(out) + text[at:]


def redact_column(text: Column, spans: Column) -> Column:
    @F.arrow_udf("string")
    def clean(texts: pa.Array, lists: pa.Array) -> pa.Array:
        return pa.array(
            [
                t.as_py() if not s.as_py() or t.as_py() is None else redact(t.as_py(), [(x["start"], x["stop"]) for x in s.as_py()])
                for t, s in zip(texts, lists, strict=True)
            ],
            pa.string(),
        )

    return clean(text, spans)
