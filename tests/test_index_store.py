"""The versioned index: guards, incremental syncs, and a crash before each step."""

import pytest
from pyspark.sql import functions as F

from sparkloom.sources import index_store
from sparkloom.sources.index_store import EmptyCorpus, IncompleteIndex, IndexStore


class Crash(Exception):
    pass


def corpus(spark, texts):
    rows = spark.createDataFrame([(k, t, n) for k, v in texts.items() for n, t in enumerate(v)] or [("x", "", 0)], "source string, text string, n int").where(F.lit(bool(texts)))
    snapshot = rows.groupBy("source").agg(F.md5(F.array_join(F.sort_array(F.collect_list("text")), "|")).alias("value"))
    return snapshot, lambda wanted: rows.join(wanted, "source", "left_semi")


def held(store):
    found = {}
    for r in store.nodes().collect():
        found.setdefault(r["source"], []).append(r["text"])
    return {k: sorted(v) for k, v in found.items()}


ONE = {"a": ["a1", "a2"], "b": ["b1"], "c": ["c1"]}
TWO = {"a": ["a1", "a2"], "b": ["b8", "b9"], "d": ["d1"]}


def test_incremental(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    loaded = []

    def sync(texts, **more):
        snapshot, load = corpus(spark, texts)
        return store.sync(snapshot, lambda wanted: loaded.append({r["source"] for r in wanted.collect()}) or load(wanted), **more)

    assert store.current() is None and store.nodes() is None
    assert sync(ONE) == {"added": 3, "version": 0} and held(store) == ONE
    assert sync(ONE) == {"version": 0}
    assert sync(TWO) == {"added": 1, "modified": 1, "removed": 1, "version": 1} and held(store) == TWO
    assert loaded == [{"a", "b", "c"}, {"b", "d"}]  # what did not change is not loaded again
    assert sync({"a": ["a3"]}) == {"modified": 1, "removed": 2, "version": 2} and held(store) == {"a": ["a3"]}
    assert sorted(p.name for p in (tmp_path / "index/nodes").iterdir()) == ["version=2"] == sorted(p.name for p in (tmp_path / "index/manifest").iterdir())


def test_guards(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    with pytest.raises(IncompleteIndex):
        store.sync(*corpus(spark, ONE), read_only=True)
    with pytest.raises(EmptyCorpus):
        store.sync(*corpus(spark, {}))
    snapshot, load = corpus(spark, ONE)
    with pytest.raises(EmptyCorpus):
        store.sync(snapshot, lambda wanted: load(wanted).where("false"))
    assert store.current() is None
    store.sync(snapshot, load)
    with pytest.raises(EmptyCorpus):
        store.sync(*corpus(spark, {}))
    assert store.sync(*corpus(spark, TWO), read_only=True) == {"added": 1, "modified": 1, "removed": 1, "version": 0}
    assert held(store) == ONE


@pytest.mark.parametrize("step", index_store.STEPS)
def test_crash_before_a_step(spark, tmp_path, step):
    """Readers see the old index until the pointer is swapped and the new one after; the next sync ends the work."""
    store = IndexStore(spark, str(tmp_path / "index"))
    store.sync(*corpus(spark, ONE))

    def fail(at):
        if at == step:
            raise Crash

    with pytest.raises(Crash):
        store.sync(*corpus(spark, TWO), before=fail)
    assert held(IndexStore(spark, store.path)) == (TWO if step == "clear" else ONE)
    after = store.sync(*corpus(spark, TWO))
    assert held(store) == TWO and after["version"] == 1
    other = {"b": ["b0"], "e": ["e1"]}
    store.sync(*corpus(spark, other))
    assert held(store) == other
    assert not [p for p in (tmp_path / "index").iterdir() if p.name.startswith(".CURRENT") and not p.name.endswith(".crc")]
