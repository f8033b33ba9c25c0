"""Session without a shared folder, and the run folder's life."""

import os
import pathlib
import re
import subprocess
import sys

import pytest

from helpers import SMOKE_DIR
from taxolink.session import release_scratch, scratch_root, write_and_read
from taxolink.sources import bundle as BD

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

BARE = """
import sys
sys.path.insert(0, {root!r})
from taxolink.session import get_session
import __spark_entry__ as E
spark = get_session("local[2]", shuffle_partitions=2)
assert spark.conf.get("spark.checkpoint.dir", None) is None
before = dict(spark.sparkContext.getConf().getAll())
print("rows", E.queries()["truncate_text"](spark, {data!r}).count())
try:
    E.queries()["vocab"](spark, {data!r}).count()
except ValueError as e:
    print("refused", "spark.checkpoint.dir" in str(e))
assert dict(spark.sparkContext.getConf().getAll()) == before
"""


def test_session_without_checkpoint_folder(tmp_path):
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path)}
    out = subprocess.run([sys.executable, "-c", BARE.format(root=ROOT, data=SMOKE_DIR)], env=env, capture_output=True,
                         text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    assert "rows 200" in out.stdout and "refused True" in out.stdout


def test_no_operator_changes_session_settings(spark):
    import __spark_entry__ as E
    E.queries()["truncate_text"](spark, SMOKE_DIR)  # the wrapper pins the clock
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "7")
    try:
        E.queries()["class_cap"](spark, SMOKE_DIR).count()
        assert spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold") == "7"
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")


def test_unfinished_target_is_built_again(spark, tmp_path):
    path = f"{tmp_path}/t"
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    BD.materialize(spark, path, build)
    assert BD.materialize(spark, path, build).count() == 3 and len(built) == 1
    os.rename(f"{path}/_SUCCESS", f"{tmp_path}/gone")   # as a write leaves it that broke off
    BD.materialize(spark, path, build)
    assert len(built) == 2


@pytest.mark.parametrize("name", ["a"])
def test_scratch_tables_sit_in_one_run_folder(spark, name):
    df = write_and_read(spark.range(5), name)
    assert df.count() == 5 and all(scratch_root(spark).split("://")[-1] in f for f in df.inputFiles())
    assert release_scratch(spark) and not release_scratch(spark)


def test_no_test_module_imports_a_conftest_by_name():
    here = pathlib.Path(__file__).parent
    for f in here.rglob("*.py"):
        assert not re.search(r"^\s*(from|import)\s+conftest\b", f.read_text(), re.M), f
