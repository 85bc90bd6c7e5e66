import datetime

import pytest
from pyspark.sql import functions as F

from stratum import schema
from stratum.operators import kg
from stratum.store import Store


def rows(spark, items):
    when = datetime.datetime(2024, 1, 1)
    full = []
    for i, (id_, source, digest, content) in enumerate(items):
        r = dict.fromkeys(schema.DRAWERS.names) | {"id": id_, "wing": "w", "room": "r", "source_file": source, "source_hash": digest, "content": content, "chunk_index": i, "active": True, "filed_at": when, "drawer_type": "drawer"}
        full.append(tuple(r.values()))
    return spark.createDataFrame(full, schema.DRAWERS)


def active(store):
    return sorted(r.id for r in store.read("drawers").where("active").collect())


def test_refresh_retires_and_repeats_change_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.read("drawers").count() == 0
    first = rows(spark, [("a1", "a", "h1", "x"), ("a2", "a", "h1", "y"), ("b1", "b", "h1", "z"), ("n", "c", None, "q")])
    assert store.refresh(first) == 4 and active(store) == ["a1", "a2", "b1", "n"]
    store.refresh(rows(spark, [("a3", "a", "h2", "x2")]))
    assert active(store) == ["a3", "b1", "n"] and store.read("drawers").count() == 5
    for _ in range(2):
        store.refresh(rows(spark, [("c1", "c", "h9", "new")]))  # a null hash is superseded as well
        assert active(store) == ["a3", "b1", "c1"]
    revisions = {r.source_file: r.source_hash for r in store.read("revisions").collect()}
    assert revisions["c"] == "h9" and revisions["b"] == "h1"
    assert store.delete(["b1", "none"]) == 1 and active(store) == ["a3", "c1"]
    store.views()
    assert spark.sql("SELECT count(*) AS n FROM drawers WHERE active").first().n == 2


def names(rows_):
    return {(r.subject, r.predicate, r.object, r.valid_to, r.confidence) for r in rows_.collect()}


def facts(spark, *items):
    return spark.createDataFrame([(*i, None, None) for i in items], "subject string, predicate string, object string, valid_from string, confidence double, source_closet string, source_file string")


def test_one_open_fact_at_most(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    now = F.current_timestamp()
    t = kg.add(store.read("triples"), facts(spark, ("Kai B", "works on", "Ra", "2024-01", 0.8), ("Kai B", "works on", "Ra", "2024-02", 0.9)), now)
    store.write("triples", t)
    assert names(store.read("triples")) == {("kai_b", "works_on", "ra", None, 0.9)}
    store.write("triples", kg.add(store.read("triples"), facts(spark, ("Kai B", "works_on", "Ra", None, 0.5)), now))
    assert names(store.read("triples")) == {("kai_b", "works_on", "ra", None, 0.9)}
    end = spark.createDataFrame([("Kai B", "works on", "Ra", "2024-06-01")], "subject string, predicate string, object string, ended string")
    store.write("triples", kg.invalidate(store.read("triples"), end))
    store.write("triples", kg.add(store.read("triples"), facts(spark, ("Kai B", "works on", "Ra", "2025-01-01", 0.7)), now))
    assert names(store.read("triples")) == {("kai_b", "works_on", "ra", "2024-06-01", 0.9), ("kai_b", "works_on", "ra", None, 0.7)}
    assert store.read("triples").select("id").distinct().count() == 2
    store.write("entities", kg.with_entities(store.read("entities"), spark.createDataFrame([("Kai B",), ("kai b",), ("Ra",)], "name string"), now))
    assert {(r.id, r.name) for r in store.read("entities").collect()} == {("kai_b", "Kai B"), ("ra", "Ra")}
    found = kg.query(store.read("triples"), store.read("entities"), "kai b", "2024-03-01").collect()
    assert [(r.direction, r.object, r.current) for r in found] == [("outgoing", "Ra", False)]
    assert kg.query(store.read("triples"), store.read("entities"), "kai b", direction="sideways").count() == 0
    assert [r.current for r in kg.timeline(store.read("triples"), store.read("entities"), "Ra").collect()] == [False, True]


class Crash(Exception):
    pass


@pytest.mark.parametrize("step", ["_snapshot", "_publish", "_prune"])
@pytest.mark.parametrize("call", [1, 2, 3])
def test_a_crash_at_any_step_leaves_a_whole_store(spark, tmp_path, monkeypatch, step, call):
    """Before the manifest stands all tables are as they were; after it, all are as they become."""
    store = Store(spark, str(tmp_path / "s"))
    vectors = lambda *ids: spark.createDataFrame([(i, [1.0], "b") for i in ids], schema.VECTORS)
    store.refresh(rows(spark, [("a1", "a", "h1", "x")]), vectors("a1"))
    calls, real = [], getattr(Store, step)

    def broken(self, *args):
        calls.append(args)
        if len(calls) == call:
            if step == "_publish":  # a draft is left behind
                fs, draft = self._fs(f"{self.path}/manifests/draft-x")
                fs.create(draft, False).close()
            raise Crash
        return real(self, *args)

    monkeypatch.setattr(Store, step, broken)
    done = step == "_prune" or call > {"_snapshot": 3, "_publish": 1}[step]
    if call == 1 or step == "_snapshot":
        with pytest.raises(Crash):
            store.refresh(rows(spark, [("a2", "a", "h2", "y")]), vectors("a2"))
    else:
        store.refresh(rows(spark, [("a2", "a", "h2", "y")]), vectors("a2"))
        done = True
    monkeypatch.undo()
    again = Store(spark, store.path)
    state = lambda: (active(again), sorted(r.drawer_id for r in again.read("vectors").collect()), {r.source_file: r.source_hash for r in again.read("revisions").collect()})
    assert state() == ((["a2"], ["a1", "a2"], {"a": "h2"}) if done else (["a1"], ["a1"], {"a": "h1"}))
    again.refresh(rows(spark, [("a3", "a", "h3", "z")]), vectors("a3"))
    assert state() == (["a3"], ["a1", "a2", "a3"] if done else ["a1", "a3"], {"a": "h3"})


def test_a_second_writer_fails_and_readers_keep_their_snapshot(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    store.refresh(rows(spark, [("a1", "a", "h1", "x")]))
    old = store.read("drawers")
    store.refresh(rows(spark, [("b1", "b", "h1", "x")]))
    assert old.count() == 1
    with pytest.raises(RuntimeError, match="another writer"):
        store._publish(2, {})
    assert active(store) == ["a1", "b1"]
    store.retire_source("a")
    assert active(store) == ["b1"]
