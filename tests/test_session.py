import threading
from pathlib import Path

import pytest

from trackwright import session


def local(path):
    return Path(path.removeprefix("file://"))


def test_scratch_goes_but_for_what_lies_elsewhere(spark):
    df = spark.range(3)
    before = session.materialise(df, "before")
    path = session.scratch(spark, "kept")
    with session.passing_scratch(spark):
        inner = session.scratch(spark, "inner")
        session.written(df, inner)
        kept = session.written(df, path)
        assert local(inner).exists()
    assert not local(inner).exists()
    assert before.count() == kept.count() == 3


def test_scratch_goes_if_a_step_fails(spark):
    with pytest.raises(ZeroDivisionError), session.passing_scratch(spark):
        inner = session.scratch(spark, "inner")
        session.written(spark.range(3), inner)
        raise ZeroDivisionError
    assert not local(inner).exists()


def test_two_threads_leave_each_other_s_scratch(spark):
    inside, ended, paths = threading.Event(), threading.Event(), {}

    def long_run():
        with session.passing_scratch(spark):
            paths["long"] = session.scratch(spark, "long")
            session.written(spark.range(3), paths["long"])
            inside.set()
            ended.wait(60)
            paths["seen"] = local(paths["long"]).exists()

    other = threading.Thread(target=long_run)
    other.start()
    inside.wait(60)
    with session.passing_scratch(spark):
        session.written(spark.range(3), session.scratch(spark, "short"))
    ended.set()
    other.join()
    assert paths["seen"]
    assert not local(paths["long"]).exists()
