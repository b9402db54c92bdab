"""Plan shapes that the scale design depends on (checked with explain)."""

import contextlib
import io
import re

import __spark_entry__ as E
from conftest import SF_SMALL


def _plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_flagship_plan(spark):
    plan = _plan(E.queries()["reduce_block_means"](spark, SF_SMALL))
    # pruned scan: only the five lineitem columns the adapter uses
    assert "ReadSchema: struct<l_suppkey:bigint,l_linenumber:int,l_quantity:double,l_extendedprice:double," \
           "l_discount:double>" in plan
    # three exchanges, each after a partial aggregate; no sort, join or Python
    assert len(re.findall(r"^\(\d+\) Exchange", plan, re.M)) == 3
    assert plan.count("partial_avg") >= 2 and "partial_sum" in plan
    for bad in ("Sort ", "Join", "Python", "Window"):
        assert bad not in plan


def test_scaling_join_does_not_shuffle_the_vectors(spark):
    plan = _plan(E.queries()["scale_vectors"](spark, SF_SMALL))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert len(re.findall(r"^\(\d+\) Exchange", plan, re.M)) == 0


def test_wide_sum_fuses_explode_and_partial_sum(spark):
    df = E.queries()["vector_sum_nd"](spark, SF_SMALL)
    df.collect()  # codegen ids are shown in the final (executed) plan
    plan = _plan(df)
    gen = re.search(r"^\(\d+\) Generate \[codegen id : (\d+)\]", plan, re.M)
    partial = re.search(r"^\(\d+\) HashAggregate \[codegen id : (\d+)\]\n(?:.*\n){2}Functions \[3\]: "
                        r"\[partial_sum", plan, re.M)
    assert gen and partial and gen.group(1) == partial.group(1)  # one whole-stage codegen span


def test_vec3_blocks_option_prunes_splits(spark, tmp_dir):
    import os

    import numpy as np

    from vecflow.sources.load import read_vec3

    for i in range(4):
        with open(os.path.join(tmp_dir, f"f{i}.bin"), "wb") as f:
            f.write(np.arange(300, dtype=">f8").tobytes())
    df = read_vec3(spark, tmp_dir)
    assert df.rdd.getNumPartitions() == 4
    some = read_vec3(spark, tmp_dir, blocks="2")
    assert some.rdd.getNumPartitions() == 1 and some.count() == 100 and df.count() == 400
