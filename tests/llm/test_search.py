"""Ranked search against a plain version, over odd rows and the whole test table."""

import math
import re
from collections import Counter, defaultdict
from random import Random

import numpy as np
import pytest

from evalloom.llm import ranked_search as rs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def plain_search(docs, items, k):
    bags = [(i, Counter(plain_terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, n_all = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= set(plain_terms(t))
    rows = []
    for item, held in asked.items():
        found = []
        for i, b in bags:
            m = 100 - 90 + (90 * sum(b.values()) * n_docs) // n_all
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * b[t]) // (1000 * b[t] + 8 * m)) for t in held if t in b
            )
            if score > 0:
                found.append((-score, i is None, i if i is not None else 0))
        for r, (score, missing, i) in enumerate(sorted(found)[:k]):
            rows.append((item, r + 1, None if missing else i, -score))
    return sorted(rows)


def found(df):
    return sorted(tuple(r) for r in df.collect())


def test_terms():
    for text in ("", "a", "A-b_c D9", "ÄÖ İ x y z", "a\x00b\x7fc~d\u0080", "  one,two\tTHREE \n"):
        assert [t.decode() for t in rs.terms(text.encode())] == plain_terms(text)


def test_shared_sums_are_the_items():
    """Adding along the graph gives every item the sum of its own terms, and shared sets are found."""
    rng = Random(3)
    items = [rng.sample(range(60), rng.randrange(0, 40)) for _ in range(50)] + [[], [5], list(range(60))]
    graph = rs.share(items, 70)
    value = np.array([rng.randrange(1 << 40) for _ in range(70)])
    sums = np.zeros(graph.nodes, np.int64)
    np.add.at(sums, graph.class_of, value)
    for made, left, right in graph.levels:
        sums[made] = sums[left] + sums[right]
    assert [int(sums[p].sum()) for p in graph.parts] == [int(value[i].sum()) for i in items]
    assert sum(len(made) for made, _, _ in graph.levels) > 20
    assert sum(len(p) for p in graph.parts) < sum(len(i) for i in items) / 2
    alike = rs.share([[1, 2, 3, 4], [1, 2, 3, 4, 5], [9]], 10)  # one class: nothing to add for the first item
    assert len(alike.parts[0]) == 1 and len(alike.parts[1]) == 2 and not alike.levels


def test_length_factor_is_exact_beyond_64_bits():
    n = np.array([1, 10**9], np.int64)
    assert rs.length_factor(n, 10**12, 10**15).tolist() == [10 + 90 * int(x) * 10**12 // 10**15 for x in n]


@pytest.mark.parametrize("limit", [rs.TERMS, 4])
def test_odd_rows(spark, odd, limit):
    """Null and empty texts, a long text, ties, repeated rows and ids, clashing columns; with small passes too."""
    items = [(1, "THE cat"), (2, None), (3, ""), (None, "cat"), (4, "mat, Mat! password wörd1 wörd2"), (4, "id"), (5, "nowhere"), (1, "the cat"), (6, "the sat cat on")]
    asked = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, score string, rank int")
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = found(rs.top_documents(odd, asked, k=3, limit=limit))
    assert got == plain_search(docs, items, 3)
    assert {r[0] for r in got} == {1, 4, 6} and [r for r in got if r[2] is None]


def test_no_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "cat")], "item_id long, text string")
    assert found(rs.top_documents(none, items)) == [] and found(rs.top_documents(odd, items.limit(0))) == []


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(300).select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = [tuple(r) for r in docs.collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(rs.top_documents(docs, items)) == plain_search(rows, [tuple(r) for r in items.collect()], 10)
