"""Tables written on the way."""

import os

import pytest

from tensorloom.llm.common import materialize, scratch


def _folder(df) -> str:
    return os.path.dirname(df.inputFiles()[0].removeprefix("file://"))


def test_scratch_deletes_all_but_what_is_kept(spark):
    with scratch(spark):
        passing = _folder(materialize(spark.range(3), "passing"))
        with scratch(spark):
            inner = _folder(materialize(spark.range(3), "inner"))
        assert not os.path.exists(inner) and os.path.exists(passing)
        kept = materialize(spark.range(3), "kept", keep=True)
    outside = materialize(spark.range(2), "outside")
    assert not os.path.exists(passing)
    assert (kept.count(), outside.count()) == (3, 2)


def test_scratch_deletes_after_an_error(spark):
    with pytest.raises(ValueError), scratch(spark):
        passing = _folder(materialize(spark.range(3), "passing"))
        raise ValueError
    assert not os.path.exists(passing)
