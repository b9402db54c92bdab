import json
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR="/root/testdata/sf0.001", BENCH_CPUS="2", BENCH_REPEAT="1",
               BENCH_GEN_MULTIPLIER="1024", BENCH_GEN_BLOCK_SIZE="2", BENCH_SRC_BLOCK_SIZE="1")
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py")], env=env, capture_output=True,
                         text=True, timeout=1200)
    assert out.returncode == 0, out.stderr[-3000:]
    lines = [ln for ln in out.stdout.splitlines() if ln.strip()]
    assert len(lines) == 1
    d = json.loads(lines[0])
    assert d["unit"] == "sec" and d["sf"] == 0.001 and d["value"] > 0
    assert {"reduce_block_means", "timed_run_lazy_overall", "timed_run_src_eager_map"} <= set(d["queries"])
    assert d["generated_vectors"] == 2 * 2 * 1024
    assert d["input_records"]["reduce_block_means"] > 0
    assert d["shuffle_bytes_written"]["shift_vectors"] == 0  # a projection moves nothing
