"""Intermediates: where they go and that they can be removed; code on the workers."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest

from campaignlens.operators.evaluate import roc_auc
from campaignlens.session import discard, release, scratch, shared_dir, written


def folders(spark):
    base = spark.conf.get("spark.checkpoint.dir") + "/campaignlens"
    return set(os.listdir(base)) if os.path.isdir(base) else set()


def test_scratch_leaves_nothing(spark):
    before = folders(spark)
    scored = spark.createDataFrame([(i, i % 2, i / 10) for i in range(10)], "id long, label int, score double")
    with scratch(spark):
        assert roc_auc(scored).count() == 1
    assert folders(spark) == before
    with pytest.raises(ZeroDivisionError), scratch(spark):
        written(scored, "kept")
        raise ZeroDivisionError
    assert folders(spark) == before


def test_discard_and_release(spark):
    before = folders(spark)
    one, two = (written(spark.range(3), f"t{i}") for i in range(2))
    assert len(folders(spark)) == len(before) + 2 and one.count() == two.count() == 3
    discard(one)
    discard(one)
    assert len(folders(spark)) == len(before) + 1
    assert shared_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    release(spark)
    assert len(folders(spark) - before) == 0


def test_workers_find_the_package_from_any_folder(tmp_path):
    """A session of its own, started elsewhere, with the package on the driver's path alone."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from campaignlens.session import get_spark
spark = get_spark("elsewhere", "local[2]", spark__checkpoint__dir={str(tmp_path)!r})
from campaignlens.operators.neighbors import nearest
df = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(20)], "id long, v array<double>")
print("FOUND", nearest(df, df, 2, "id", "v").count())
spark.stop()
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "FOUND 40" in out.stdout, out.stderr[-2000:]
