"""Lines, documents and vectors against brute force on small tables."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from sparkloom.llm.cap_filters import CAPS, cap_members, code_shape, embedding_near_duplicates, op3_cap_filter_near_dedup
from sparkloom.llm.components import connected_components
from sparkloom.llm.edit_distance import edit_distance, within_edits
from sparkloom.llm.odd_sketch import near_duplicates, op2_odd_sketch_near_dedup

BLANKS = " \t\n\x0b\x0c\r"


def union(pairs, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def word_set(text, width):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in BLANKS:
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute_documents(rows, width, percent):
    sets = {i: word_set(t, width) for i, t in rows}
    ids = sorted(sets)
    links = [
        (a, b) for k, a in enumerate(ids) for b in ids[k + 1 :]
        if sets[a] and sets[b] and 100 * (n := len(sets[a] & sets[b])) >= percent * (len(sets[a]) + len(sets[b]) - n)
    ]
    root = union(links, ids)
    return {i: (len(sets[i]), root[i], root[i] == i) for i in ids}


def test_documents_against_all_pairs(spark, small):
    table = pq.read_table(f"{small}/documents.parquet").to_pylist()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in op2_odd_sketch_near_dedup(spark.read.parquet(f"{small}/documents.parquet")).collect()}
    assert got == brute_documents([(r["doc_id"], r["text"]) for r in table], 3, 85)


def test_documents_odd_cases(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, "one"), (4, "ONE"), (5, "one two"), (6, long), (7, long + " more"), (8, "a b c d e f g"), (9, "\x1f a")]
    rows += [(20 + i, "same text of quite some words that is copied again and again " + "x" * (i % 3)) for i in range(60)]
    df = spark.createDataFrame([(*r, "t") for r in rows], "doc_id long, text string, bucket string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(df, "doc_id", "text", 3, 80).collect()}
    assert got == brute_documents(rows, 3, 80)
    ids = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (3, "a b c d"), (3, "a b c d")], "doc_id long, text string")
    odd = near_duplicates(ids, "doc_id", "text").collect()
    assert len(odd) == 4 and all(r["kept"] for r in odd) and sum(r["component_id"] is None for r in odd) == 2
    assert near_duplicates(df.limit(0), "doc_id", "text").collect() == []


@pytest.mark.parametrize("a, b", [("", ""), ("abc", ""), ("kitten", "sitting"), ("flaw", "lawn"), ("a" * 300, "a" * 290 + "b" * 9)])
def test_edit_distance(a, b):
    table = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        table, last = [i], table
        for j, y in enumerate(b, 1):
            table.append(min(last[j] + 1, table[-1] + 1, last[j - 1] + (x != y)))
    assert edit_distance(a, b) == table[-1]
    assert within_edits(a, b, table[-1]) and not (table[-1] and within_edits(a, b, table[-1] - 1))


def brute_vectors(rows, cosine=0.95):
    good = {i: np.array(v, dtype=np.float64) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids, links = sorted(good), []
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = good[a], good[b]
            if len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= cosine:
                links.append((a, b))
    root = union(links, [i for i, _ in rows])
    return {i: (sum(i in p for p in links), root[i]) for i, _ in rows}


def test_vectors_against_all_pairs(spark, small):
    rows = [(r["vec_id"], r["embedding"]) for r in pq.read_table(f"{small}/embeddings.parquet").to_pylist()]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in op3_cap_filter_near_dedup(spark.read.parquet(f"{small}/embeddings.parquet")).collect()}
    assert got == brute_vectors(rows)


def test_vectors_odd_cases(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal(32)
    rows = [(1, None), (2, []), (3, [0.0] * 32), (4, [float("nan")] + [1.0] * 31), (5, [None] + [1.0] * 31), (6, v.tolist()), (7, (v * 2).tolist()), (8, (-v).tolist()), (9, [1.0, 2.0])]
    rows += [(100 + i, (v + 0.05 * rng.standard_normal(32)).tolist()) for i in range(700)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_near_duplicates(df, "vec_id", "embedding").collect()}
    assert got == brute_vectors(rows)
    assert embedding_near_duplicates(df.limit(0), "vec_id", "embedding").collect() == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 200)] + [(500, 400), (400, 450), (7, 7)]
    edges += [(1000 + i, 1000 + 37 * i % 101) for i in range(1, 101)]
    want = union(edges, {i for e in edges for i in e})
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want and got[200] == 1 and got[500] == 400


def test_planted_vectors_share_a_cap_of_three_blocks(spark):
    rng, n, cosine = np.random.default_rng(7), 2000, 0.9501
    x, z = rng.standard_normal((2, n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = cosine * x + np.sqrt(1 - cosine**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    shape = code_shape(450_000)
    assert shape[0] == 3
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(i + n, v.tolist()) for i, v in enumerate(y)]
    members = cap_members(spark.createDataFrame(rows, "id long, v array<double>").repartition(8), shape, CAPS)
    left, right = members.where(f"id < {n}"), members.where(f"id >= {n}").selectExpr("space", "bucket", f"id - {n} as id")
    assert left.join(right, ["space", "bucket", "id"]).select("id").distinct().count() == n
