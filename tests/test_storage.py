from pathlib import Path

from sylva.storage import new_folder, release, scope, stored


def test_scopes_delete_what_is_not_kept(spark):
    outer = stored(spark.range(3), "outer")
    with scope(spark) as kept:
        gone, stays = stored(spark.range(4), "gone"), stored(spark.range(5), "stays")
        with scope(spark) as inner:
            passed, lost = stored(spark.range(6), "passed"), stored(spark.range(7), "lost")
            inner.append(passed)
        assert Path(passed.stored_in).exists() and not Path(lost.stored_in).exists()
        kept.append(stays)
    assert stays.count() == 5 and outer.count() == 3
    assert not Path(gone.stored_in).exists() and not Path(passed.stored_in).exists()
    release(stays, spark.range(1))
    assert not Path(stays.stored_in).exists() and Path(outer.stored_in).exists()


def test_folders_are_new(spark):
    assert new_folder(spark, "a") != new_folder(spark, "a")
