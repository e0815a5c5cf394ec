import re
from itertools import permutations

from scriptloom.llm import filter_audit, queries, sql
from tests.llm.harness import rows_of, rows_of_sql

SF = "/root/testdata/sf0.001"


def by_hand(docs, labels):
    """Every order applied to every document, one filter after the other."""
    good, toxic = ({d for d, *v in labels if d is not None and v[k] == 1} for k in (0, 1))
    failing, parts = [], {}
    for doc_id, text, source in docs:
        t = text or ""
        words = re.findall(r"[^ \t-\r]+", t)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": doc_id is not None and any(i is not None and i < doc_id and (u or "") == t for i, u, _ in docs),
        }
        failing.append((doc_id, fails))
        parts.setdefault(source or "", []).append((doc_id, fails))
    rows = {}
    for part, held in parts.items():
        totals = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = list(held)
            for step, x in enumerate(order, 1):
                out = [r for r in left if r[1][x]]
                before = order[: step - 1]
                rows[part, order, step] = [
                    len(left) - len(out),
                    len(out),
                    sum(r[1][x] and any(r[1][y] for y in before) for r in held),
                    sum([y for y in "ABCDE" if r[1][y]] == [x] for r in held),
                    sum(r[0] in good for r in out),
                    sum(r[0] in toxic for r in out),
                ]
                totals[x] += len(out)
                left = [r for r in left if not r[1][x]]
        for (p, order, step), row in rows.items():
            if p == part:
                row.append(totals[order[step - 1]])
    return {k: tuple(v) for k, v in rows.items()}


LONG = " ".join(f"w{i}" for i in range(300))
DOCS = [
    (1, LONG, "s"), (2, LONG, "s"), (2, LONG, "s"), (3, LONG, None), (4, None, "s"), (5, "", ""), (6, "", "s"), (None, LONG, "s"), (None, None, None),
    (7, "x " * 400, "t"), (8, "AB c\u000b\u000cd e 😀", "t"), (9, LONG + " 10% # | x", "t"), (10, "AAAA " * 100_000, "t"), (11, "A# " + LONG, "s"), (11, "other", "u"),
    (0, "late and least", "u"), (12, "late and least", "v"), (12, "late and least", "v"), (13, "late and least", "u"),
]
LABELS = [(1, 1, 0), (2, 1, None), (2, 0, 1), (2, None, 1), (7, 1, 1), (11, 1, 1), (99, 1, 1), (None, 1, 1), (12, 1, 1), (6, None, 1)]


def found(df):
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in df.collect()}


def test_equals_every_order_by_hand(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, source string")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    want = by_hand(DOCS, LABELS)
    assert found(filter_audit.audit(docs.repartition(5), labels)) == want
    more = docs.selectExpr("*", "1 as mask", "'x' as part", "2 as n", "3 as id", "4 as good", "5 as quality")
    assert found(filter_audit.audit(more, labels.selectExpr("*", "'y' as text", "7 as id"))) == want


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, source string")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs.limit(0), labels).collect() == []
    assert found(filter_audit.audit(docs, labels.limit(0))) == by_hand(DOCS, [])


def test_query_and_sql(spark):
    import duckdb

    rows = duckdb.sql(f"select doc_id, text, source from '{SF}/documents.parquet'").fetchall()
    labels = duckdb.sql(f"select doc_id, quality, toxic from '{SF}/labels.parquet'").fetchall()
    query = queries.op13_filter_audit(spark, SF)
    assert found(query) == by_hand(rows, labels)
    assert rows_of(query) == rows_of_sql(sql.FILTER_AUDIT, SF)


def test_no_python_workers(spark):
    plan = queries.op13_filter_audit(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))
