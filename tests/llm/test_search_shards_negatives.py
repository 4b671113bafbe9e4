"""Block-max search, label propagation and tiled hard negatives against brute force in plain Python."""

import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import block_max, hard_negatives, label_shards, queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_search(docs, items, limit=10):
    counts = {i: Counter(terms_of(t)) for i, t in enumerate(t for _, t in docs)}
    n = sum(bool(c) for c in counts.values())
    total = sum(c.total() for c in counts.values())
    df = Counter(t for c in counts.values() for t in c)
    asked = {}
    for i, text in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms_of(text))
    out = set()
    for item, terms in asked.items():
        scored = []
        for (doc, _), c in zip(docs, counts.values()):
            m = 10 + 90 * c.total() * n // max(1, total)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0 and doc is not None:
                scored.append((-score, doc))
        out |= {(item, rank, doc, -s) for rank, (s, doc) in enumerate(sorted(scored)[:limit], 1)}
    return out


ODD_DOCS = [(1, "Alpha beta, ALPHA"), (2, None), (3, ""), (4, "--- !!"), (5, "alpha" + " gamma" * 40_000), (6, "betaÉ été \U0001f600x"), (6, "beta gamma"), (None, "alpha beta gamma"), (8, "delta delta"), (9, "delta delta")]
ODD_ITEMS = [(1, "alpha ALPHA été"), (1, "Beta"), (2, None), (3, "? !"), (4, "delta"), (None, "alpha"), (5, "nothing here"), (6, "betaÉ \U0001f600X")]


def test_search_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(block_max, "BLOCK", 2)
    docs = spark.createDataFrame(ODD_DOCS, "doc_id long, text string").withColumns({"term": F.lit("x"), "block": F.lit(1), "score": F.lit(2)})
    items = spark.createDataFrame(ODD_ITEMS, "item_id long, text string").withColumns({"item": F.lit(7), "weight": F.lit(0)})
    found = [tuple(r) for r in block_max.op11_block_max_search(docs, items).collect()]
    assert len(found) == len(set(found)) and set(found) == brute_search(ODD_DOCS, ODD_ITEMS)
    assert block_max.op11_block_max_search(docs.where("false"), items).count() == 0 == block_max.op11_block_max_search(docs, items.where("false")).count()


def test_search_prunes_and_keeps_the_best(spark, small, monkeypatch):
    """Small blocks and waves: some pairs of item and block are never scored, and the result is still that of brute force."""
    monkeypatch.setattr(block_max, "BLOCK", 4)
    monkeypatch.setattr(block_max, "WAVES", (1, 4))
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    rare = [(10_000 + i, f"needle{i % 7} " * (i % 5 + 1) + "the") for i in range(60)]
    items = [(i, f"needle{i} the") for i in range(7)] + [(100 + i, t[:200]) for i, (_, t) in enumerate(docs[:5])]
    scored = []
    whole = block_max.score_blocks
    monkeypatch.setattr(block_max, "score_blocks", lambda index, wanted, *rest: scored.append(wanted.count()) or whole(index, wanted, *rest))
    df = spark.createDataFrame(docs + rare, "doc_id long, text string")
    found = {tuple(r) for r in block_max.op11_block_max_search(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == brute_search(docs + rare, items)
    assert sum(scored) < 0.8 * len(items) * -(-len(docs + rare) // 4)


@pytest.mark.parametrize("name", ["op11_block_max_search", "op13_summa_hard_negatives"])
def test_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    found = queries.queries()[name](spark, small)
    said = con.execute(queries.oracle_sql()[name])
    assert found.columns == [x[0] for x in said.description]
    rows = sorted(map(tuple, found.collect()))
    assert rows and rows == sorted(said.fetchall())


def brute_negatives(rows, positives=5, negatives=5):
    held = {}
    for i, vector, label in rows:
        if i is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        held[i] = min(held.get(i, (label, vector)), (label, vector))
    q = {i: (label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, (label, v) in held.items()}
    out = set()
    for a in (i for i in q if i % 100 == 0):
        score = {i: sum(x * y for x, y in zip(q[a][1], v)) for i, (_, v) in q.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if q[i][0] == q[a][0]][:positives]:
            fits = [i for i in order if q[i][0] != q[a][0] and 80 * score[p] <= 100 * score[i] <= 100 * score[p]][:negatives]
            out |= {(a, p, n, i, score[p], score[i]) for n, i in enumerate(fits, 1)}
    return out


def test_hard_negatives_odd_rows(spark, monkeypatch):
    """Ties, copies, repeated ids, odd vectors and uneven lengths; several tiles and chunks."""
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    monkeypatch.setattr(hard_negatives, "ROWS", 16)
    monkeypatch.setattr(hard_negatives, "CHUNK", 4)
    rng = np.random.default_rng(5)
    center = rng.standard_normal(10)
    rows = [(int(i), [float(np.float32(x)) for x in (center + 0.3 * rng.standard_normal(10))], int(rng.integers(0, 4))) for i in rng.permutation(900)[:400]]
    rows += [(100 * i, rows[i][1], 1) for i in range(9, 13)]  # copies of other rows as anchors
    rows += [(901, None, 1), (902, [float("nan")] * 10, 1), (903, [None] * 10, 1), (904, [1.0] * 10, None), (None, [1.0] * 10, 1), (905, [float("inf")] * 10, 2), (906, [], 1), (1000, [0.5, 0.25], 2), (907, rows[0][1], 3), (907, rows[0][1], 3)]
    seen = {}
    for r in rows:
        seen.setdefault(r[0], r)
    rows = [*seen.values(), (907, rows[0][1], 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"id": F.lit(1), "q": F.lit("x"), "k": F.lit(0)})
    found = [tuple(r) for r in hard_negatives.mine(df, "vec_id", "embedding", "label").collect()]
    assert len(found) == len(set(found)) and set(found) == brute_negatives(rows) and len(found) > 30
    assert hard_negatives.mine(df.where("false"), "vec_id", "embedding", "label").count() == 0


def test_hard_negatives_of_large_components(spark):
    rows = [(i, [float(v), 1.0], label) for i, v, label in ((0, 80_000, 1), (1, 70_000, 1), (2, 65_000, 2), (3, -90_000, 2), (4, 1e30, 3))]
    found = {(r["positive_id"], r["negative_id"]) for r in hard_negatives.mine(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), "vec_id", "embedding", "label").collect()}
    assert found == {(1, 2)}


def checked(rows, shards=8):
    """The law of counts, gapless slots and the columns that follow from the text."""
    counts = Counter(r["shard"] for r in rows)
    sizes = [counts.get(s, 0) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and set(counts) <= set(range(shards))
    for s in counts:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
    return sizes


def test_shards_keep_groups_together(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = label_shards.op12_label_propagation_shards(docs).collect()
    texts = {r["doc_id"]: (r["text"] or "") for r in docs.collect()}
    checked(rows)
    groups = {}
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
        groups.setdefault(raw, set()).add(r["shard"])
    assert sum(len(s) > 1 for s in groups.values()) == 0
    again = label_shards.op12_label_propagation_shards(docs).collect()
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in rows} == {(r["doc_id"], r["shard"], r["slot"]) for r in again}


def test_shards_of_a_group_that_exceeds_one(spark):
    """A third of all rows are copies, the rest mostly pairs: the group fills few shards, pairs stay whole."""
    rows = [(i, "hot") for i in range(1000)] + [(1000 + i, f"pair {i // 2}") for i in range(1600)] + [(2600 + i, f"single {i}") for i in range(400)]
    found = label_shards.op12_label_propagation_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    checked(found)
    of = {r["doc_id"]: r["shard"] for r in found}
    hot = Counter(of[i] for i in range(1000))
    assert sum(sorted(hot.values())[-4:]) >= 900
    assert sum(of[1000 + 2 * i] != of[1001 + 2 * i] for i in range(800)) <= 40


def test_shards_of_a_graph(spark):
    """Rows with several links: a ring of 40 cliques of 10; far fewer links are cut than at random."""
    rows = spark.createDataFrame([(i, i) for i in range(400)], "doc_id long, row long")
    links = [(i, i // 10) for i in range(400)] + [(10 * c + 9, 1000 + c) for c in range(40)] + [(10 * ((c + 1) % 40), 1000 + c) for c in range(40)]
    found = label_shards.shard_documents(rows, spark.createDataFrame(links, "row long, link long"), 8).collect()
    checked(found)
    of = {r["doc_id"]: r["shard"] for r in found}
    cut = sum(len({of[10 * c + k] for k in range(10)}) > 1 for c in range(40))
    assert cut <= 8


def test_shards_odd_rows(spark):
    rows = [(1, None), (1, ""), (None, "a"), (None, "a"), (2, "x" * 300_000), (3, "é"), (3, "é")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"shard": F.lit(99), "row": F.lit("r"), "link": F.lit(0), "slot": F.lit(1)})
    found = label_shards.op12_label_propagation_shards(df).collect()
    checked(found)
    assert sorted((r["doc_id"] or 0, r["size"]) for r in found) == [(0, 2), (0, 2), (1, 1), (1, 1), (2, 300_001), (3, 3), (3, 3)]
    assert label_shards.op12_label_propagation_shards(df.where("false")).count() == 0
