"""Stored tables: versions that two writers make, lost writers, upserts, new columns."""

import datetime as dt
import threading

import pytest

from quarryloom.sources import store
from quarryloom.sources.versions import Versions

KEY = ("scan_date", "symbol")


def day(k):
    return None if k is None else dt.date(2024, 1, 1) + dt.timedelta(days=k)


def rows(spark, *items, more="score double"):
    return spark.createDataFrame([(day(k), *x) for k, *x in items], f"scan_date date, symbol string, {more}")


def shown(df, *names):
    return sorted((tuple(r[n] for n in ("scan_date", "symbol", *names)) for r in df.collect()), key=str)


def test_upserts_replace_by_key_and_keep_the_rest(spark, tmp_path):
    table = store.Stored(spark, str(tmp_path / "t"), KEY)
    assert table.read().count() == 0
    table.upsert(rows(spark, (0, "A", 1.0), (0, "B", 2.0), (1, "A", 3.0), (None, "A", 4.0)))
    table.upsert(rows(spark, (0, "B", 20.0), (2, "C", 5.0), (2, "C", 5.0), (None, "Z", 6.0)))
    assert shown(table.read(), "score") == sorted([(day(0), "A", 1.0), (day(0), "B", 20.0), (day(1), "A", 3.0), (day(2), "C", 5.0), (None, "A", 4.0), (None, "Z", 6.0)], key=str)
    assert shown(table.read(1), "score") == sorted([(day(0), "A", 1.0), (day(0), "B", 2.0), (day(1), "A", 3.0), (None, "A", 4.0)], key=str)
    untouched = table.manifest()["parts"]["p" + str(day(1)).encode().hex().upper()]
    assert untouched == table.manifest(1)["parts"]["p" + str(day(1)).encode().hex().upper()]
    table.upsert(rows(spark))
    assert table.read().count() == 6


def test_columns_come_and_stay(spark, tmp_path):
    table = store.Stored(spark, str(tmp_path / "t"), KEY)
    table.upsert(rows(spark, (0, "A", 1.0), (1, "A", 2.0)))
    table.upsert(rows(spark, (1, "B", 7), more="rank int"))
    assert shown(table.read(), "score", "rank") == [(day(0), "A", 1.0, None), (day(1), "A", 2.0, None), (day(1), "B", None, 7)]


def test_a_lost_writer_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    table = store.Stored(spark, str(tmp_path / "t"), KEY)
    table.upsert(rows(spark, (0, "A", 1.0)))

    def lost(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(table.versions, "commit", lost)
    with pytest.raises(RuntimeError):
        table.upsert(rows(spark, (0, "A", 9.0)))
    again = store.Stored(spark, str(tmp_path / "t"), KEY)
    assert shown(again.read(), "score") == [(day(0), "A", 1.0)]
    again.upsert(rows(spark, (0, "B", 2.0)))
    assert again.vacuum(kept=1) == 2  # the lost writer's rows and the first version's
    assert shown(again.read(), "score") == [(day(0), "A", 1.0), (day(0), "B", 2.0)]


def test_of_two_writers_the_second_starts_again(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    slow, quick = store.Stored(spark, path, KEY), store.Stored(spark, path, KEY)
    slow.upsert(rows(spark, (0, "A", 1.0), (0, "B", 1.0)))
    commit, calls = slow.versions.commit, []

    def held_up(base, content):
        if not calls:
            quick.upsert(rows(spark, (0, "B", 5.0), (1, "C", 6.0)))
        calls.append(base)
        return commit(base, content)

    monkeypatch.setattr(slow.versions, "commit", held_up)
    assert slow.upsert(rows(spark, (0, "A", 7.0))) == 3 and calls == [1, 2]
    assert shown(slow.read(), "score") == [(day(0), "A", 7.0), (day(0), "B", 5.0), (day(1), "C", 6.0)]


def test_one_of_many_writers_makes_a_version(spark, tmp_path):
    made = [Versions(spark, str(tmp_path / "v")) for _ in range(6)]
    won = []
    threads = [threading.Thread(target=lambda v=v, k=k: won.append(k) if v.commit(0, {"by": k}) else None) for k, v in enumerate(made)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and made[0].read(1) == {"by": won[0], "version": 1} and made[0].numbers() == [1]
    assert [p.name for p in (tmp_path / "v").iterdir() if not p.name.endswith(".crc")] == ["1.json"]


def test_a_lost_claim_is_outdone_and_its_slow_writer_gives_up(spark, tmp_path, monkeypatch):
    slow, other = (Versions(spark, str(tmp_path / "v"), patience=0.5) for _ in range(2))
    create = slow._create

    def sleepy(name, content):
        done = create(name, content)
        if name.startswith("_"):  # has staged the version, and now is slow
            assert other.commit(0, {"by": "other"})
        return done

    monkeypatch.setattr(slow, "_create", sleepy)
    assert not slow.commit(0, {"by": "slow"})
    assert other.read(1)["by"] == "other" and other.last() == 1
    monkeypatch.undo()
    assert slow.commit(1, {"by": "slow"})
    assert other.read(2)["by"] == "slow"


def test_rename_does_not_overwrite(spark, tmp_path):
    versions = Versions(spark, str(tmp_path / "v"))
    assert versions.commit(0, {"by": 1})
    versions._create("_staged", "{}")
    assert not versions._put("_staged", 1) and versions.read(1)["by"] == 1


def test_scan_rows_hide_scores_of_failing_rows_and_fall_back(spark):
    nan, inf = float("nan"), float("inf")
    data = [("A", day(0), True, 1.0, 50.0, 0.2, 0.1), ("A", day(1), True, 2.0, 60.0, 0.0, 0.1), ("B", day(1), False, 3.0, 70.0, None, 0.3), ("C", day(0), True, nan, inf, nan, nan)]
    scored = spark.createDataFrame(data, "symbol string, bar_date date, passes_filters boolean, close double, total_score double, consol_range_60 double, consol_range_15 double")
    found = {r["symbol"]: r for r in store.scan_rows(scored).collect()}
    assert [(r["scan_date"], r["score"], r["price"], r["consol_range_pct"]) for _, r in sorted(found.items())] == [(day(1), 60.0, 2.0, 0.0), (day(1), None, 3.0, 0.3), (day(0), None, None, None)]
    market = spark.createDataFrame([(day(1), "BULL", 77.0, 1.1)], "bar_date date, regime string, score double, multiplier double")
    joined = {r["symbol"]: r["market_regime"] for r in store.scan_rows(scored, conditions=market).collect()}
    assert joined == {"A": "BULL", "B": "BULL", "C": None}
