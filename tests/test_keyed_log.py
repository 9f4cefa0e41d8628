"""Snapshot and deltas: every reader sees the state of one manifest, whatever is compacted or replayed."""

import random

import pytest

from altscore.streaming.keyed_log import KeyedLog

SCHEMA = "k string, v long, w string"


@pytest.fixture
def log(spark, tmp_path):
    return KeyedLog(spark, str(tmp_path / "log"), ["k"], spark.createDataFrame([], SCHEMA).schema, compact_every=100)


def _batches(n=7, seed=1):
    r = random.Random(seed)
    keys = ["a", "b", "c", "d", None]
    return [[(k, r.randrange(100), r.choice(["x", None])) for k in r.sample(keys, r.randrange(0, 5))] for _ in range(n)]


def _want(batches):
    out = {}
    for b in batches:
        out |= {k: (k, v, w) for k, v, w in b}
    return sorted(map(repr, out.values()))


def _rows(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def test_state_before_during_and_after_compactions(spark, log):
    """After each batch the plain upsert; a reader that came before a compaction keeps what it saw."""
    batches = _batches()
    assert _rows(log.read()) == []
    for i, b in enumerate(batches):
        log.append(spark.createDataFrame(b, SCHEMA), i)
        assert _rows(log.read()) == _want(batches[:i + 1])
        if i in (2, 5):
            before = log.read()
            log.compact()
            assert _rows(before) == _rows(log.read()) == _want(batches[:i + 1])
            assert log.manifest()["deltas"] == {} and log.manifest()["upto"] == i
    log.compact()
    log.compact()
    assert _rows(log.read()) == _want(batches)


def test_replays(spark, log):
    """A batch that failed half-way replaces itself; one in a snapshot is left out."""
    a, b, c = ([("a", 1, "x"), ("b", 1, "x")], [("a", 2, "x")], [("b", 3, None)])
    log.append(spark.createDataFrame(a, SCHEMA), 0)
    log.append(spark.createDataFrame([("a", 99, "half"), ("z", 9, "half")], SCHEMA), 1)
    log.append(spark.createDataFrame(b, SCHEMA), 1)
    assert _rows(log.read()) == _want([a, b])
    log.compact()
    log.append(spark.createDataFrame(b, SCHEMA), 1)
    assert log.manifest()["deltas"] == {}
    log.append(spark.createDataFrame(c, SCHEMA), 2)
    assert _rows(log.read()) == _want([a, b, c])


def test_a_batch_or_replay_that_comes_during_a_compaction(spark, log, monkeypatch):
    a, b, c = ([("a", 1, "x"), ("b", 1, "x")], [("a", 2, "x")], [("b", 3, None), ("c", 1, "y")])
    log.append(spark.createDataFrame(a, SCHEMA), 0)
    write = KeyedLog._write

    def late(self, df, name):
        out = write(self, df, name)
        if name.startswith("snapshot"):
            monkeypatch.setattr(KeyedLog, "_write", write)
            self.append(spark.createDataFrame(b, SCHEMA), 1)
        return out
    monkeypatch.setattr(KeyedLog, "_write", late)
    log.compact()
    assert log.manifest()["upto"] == 0 and list(log.manifest()["deltas"]) == ["1"] and _rows(log.read()) == _want([a, b])

    def replayed(self, df, name):
        out = write(self, df, name)
        if name.startswith("snapshot"):
            monkeypatch.setattr(KeyedLog, "_write", write)
            self.append(spark.createDataFrame(c, SCHEMA), 1)
        return out
    monkeypatch.setattr(KeyedLog, "_write", replayed)
    log.compact()                                              # gives way: its snapshot holds what the replay replaced
    assert log.manifest()["upto"] == 0 and _rows(log.read()) == _want([a, c])


def test_it_compacts_itself_and_vacuum_deletes_what_no_manifest_names(spark, tmp_path):
    log = KeyedLog(spark, str(tmp_path / "log"), ["k"], spark.createDataFrame([], SCHEMA).schema, compact_every=3)
    batches = _batches(8, 5)
    for i, b in enumerate(batches):
        log.append(spark.createDataFrame(b, SCHEMA), i)
        assert len(log.manifest()["deltas"]) < 3
    gone = log.vacuum(keep=1)
    assert len(gone) >= 6 and _rows(log.read()) == _want(batches)
    assert log.vacuum(keep=1) == []


def test_a_crash_between_write_and_commit_changes_nothing(spark, log, monkeypatch):
    log.append(spark.createDataFrame([("a", 1, "x")], SCHEMA), 0)
    with monkeypatch.context() as m:
        m.setattr(KeyedLog, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            log.append(spark.createDataFrame([("a", 2, "y")], SCHEMA), 1)
        with pytest.raises(RuntimeError):
            log.compact()
    assert _rows(log.read()) == _want([[("a", 1, "x")]])


def test_a_number_that_was_taken_and_left_empty_stops_nobody(spark, log):
    log.append(spark.createDataFrame([("a", 1, "x")], SCHEMA), 0)
    open(f"{log.root}/_versions/00000002", "w").close()
    log.append(spark.createDataFrame([("a", 2, "y")], SCHEMA), 1)
    assert _rows(log.read()) == _want([[("a", 2, "y")]]) and log.manifest()["version"] == 3
