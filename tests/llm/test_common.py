"""Shared helpers."""

import numpy as np
import pyarrow as pa

from canloom.llm import common


def test_membership_loses_nothing(spark):
    rng = np.random.default_rng(1)
    keys = rng.integers(-(2**63), 2**63 - 1, 3000)
    bitmap = common.membership(spark.createDataFrame([(int(k),) for k in keys], "k long"), "k")
    assert common.member(bitmap, keys).all()
    others = rng.integers(-(2**63), 2**63 - 1, 20000)
    assert common.member(bitmap, others).mean() < 0.15
    assert not common.member(common.membership(spark.createDataFrame([], "k long"), "k"), others).any()


def test_steps_and_texts():
    texts = [b"a" * n for n in (5, 5, 50, 0, 1, 9)]
    got = list(common.steps(texts, 10))
    assert got[0][0] == 0 and got[-1][1] == len(texts) and all(a[1] == b[0] for a, b in zip(got, got[1:]))
    assert list(common.steps([], 10)) == []
    assert common.utf8(pa.array(["é", None, ""])) == ["é".encode(), b"", b""]


def test_names(spark):
    df = spark.createDataFrame([], "spans int, _SPANS int")
    assert common.fresh_name(df, "spans") == "__spans" and common.fresh_name(df, "other") == "other"
    path = common.fresh_path(spark, "x")
    assert path.startswith(common.shared_dir(spark)) and path != common.fresh_path(spark, "x")
