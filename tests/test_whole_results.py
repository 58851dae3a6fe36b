"""Queries of the catalogue against plain Python versions, on small tables whose rows must all count."""

import html
import itertools

from deckhand.plans import catalog


def results(spark, folder, name, table, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{table}.parquet")
    return [r.asDict() for r in catalog.QUERIES[name](spark, str(folder)).collect()]


def test_html_escape_takes_whole_texts(spark, tmp_path):
    texts = ["x" * 199 + "<&>\"'" + "y" * 300 + "<b>'&amp;'</b>", "a < b", "", None]
    got = results(spark, tmp_path, "html_escape", "documents", list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["html"] for r in got} == {k: t if t is None else html.escape(t) for k, t in enumerate(texts)}


def test_merged_cell_compaction_keeps_repeated_lines(spark, tmp_path):
    lines = [(1, 1, 3, "A"), (1, 1, 4, "N"), (1, 1, 3, "R"), (1, 2, 5, "N"), (1, 7, 6, "A"), (2, 4, 1, "A"), (2, 4, 1, "A"), (2, 4, 1, "A"), (3, 2, 3, None), (3, 2, 3, "A")]
    got = results(spark, tmp_path, "merged_cell_compaction", "lineitem", lines[::-1], "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string")
    expected = []
    for order in (1, 2, 3):
        cover, logical = -1, 0
        for col, (_, _, part, flag) in enumerate(sorted((x for x in lines if x[0] == order), key=lambda x: (x[1], x[2], x[3] or ""))):
            span = 1 + part % 3
            if col > cover:
                expected.append({"l_orderkey": order, "col": col, "span": span, "value": flag, "logical_col": logical})
                logical += 1
            cover = max(cover, col + span - 1)
    assert sorted(got, key=lambda r: (r["l_orderkey"], r["col"])) == expected
    assert [r["value"] for r in expected] == ["A", "R", "N", "A", None, "A"]


def test_flat_pivot_has_all_orders_and_lines(spark, tmp_path):
    lines = [(1, 1, 5.0), (1, 3, 7.0), (1, 3, 9.0), (1, 7, 2.0), (2, 4, 1.0), (2, 5, 3.0), (3, 2, None), (3, 6, 8.0)]
    got = results(spark, tmp_path, "flat_pivot", "lineitem", lines, "l_orderkey long, l_linenumber int, l_quantity double")
    whole = [{"l_orderkey": o} | {f"h{n}": max((q for k, m, q in lines if (k, m) == (o, n) and q is not None), default=None) for n in range(1, 8)} for o in (1, 2, 3)]
    assert sorted(got, key=lambda r: r["l_orderkey"]) == whole


def test_partial_sequence_has_all_users_and_scores(spark, tmp_path):
    pattern = ["signup", "view", "error", "purchase"]
    logs = [list(x) for n in (1, 2, 3) for x in itertools.product(["click", *pattern], repeat=n)]
    logs += [pattern, ["view", "signup", "signup", "view", "click", "error", "view", "purchase"], pattern[::-1], [None, "signup"]]
    events = [(u, 100 * u + k, t) for u, steps in enumerate(logs) for k, t in enumerate(steps)]
    got = results(spark, tmp_path, "partial_sequence", "events", events[::-1], "user_id long, event_id long, event_type string")
    # Brute force: the longest beginning of the pattern among all choices of steps in order.
    share = lambda steps: max(k for k in range(5) if any(list(x) == pattern[:k] for x in itertools.combinations(steps, k))) / 4
    assert {r["user_id"]: r["score"] for r in got} == {u: share(steps) for u, steps in enumerate(logs)}
    assert {r["score"] for r in got} == {0, 0.25, 0.5, 0.75, 1}
