import glob
import os
import subprocess
import sys

import pytest

from vecflow.cli import run_parser

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_files_in_and_out():
    a = run_parser().parse_args(["--src", "vectors/in", "--dst", "vectors/out", "--hybrid"])
    assert (a.src, a.dst, a.generate, a.hybrid, a.functional) == ("vectors/in", "vectors/out", False, True, False)
    assert (a.json, a.xml) == (None, None)


def test_bad_values_are_refused(capsys):
    for bad in (["--blocks", "many"], ["--cores", "1.5"], ["--no-such-option"]):
        with pytest.raises(SystemExit):
            run_parser().parse_args(bad)
    capsys.readouterr()


def test_short_options_and_defaults():
    short = run_parser().parse_args("-g -l -b 2 -k 3 -m 5 -n 1 -p 2 -c 4".split())
    assert (short.generate, short.lazy, short.blocks, short.block_size, short.multiplier) == (True, True, 2, 3, 5)
    d = run_parser().parse_args([])
    assert (d.blocks, d.block_size, d.multiplier, d.nodes, d.nparts, d.cores) == (1, 1, 1024 * 1024, 1, 1, 12)


def test_cli_run_and_results(tmp_dir):
    env = dict(os.environ, PYTHONPATH=ROOT)
    logs = os.path.join(tmp_dir, "logs")
    os.makedirs(logs)
    run = [sys.executable, "-m", "vecflow", "run", "--master", "local[2]", "-g", "-b", "1", "-k", "2", "-m", "100",
           "-c", "2", "-j", os.path.join(logs, "job7.json")]
    out = subprocess.run(run, env=env, capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stderr[-2000:]
    assert "counts: {'generate': 400, 'shift': 400, 'average': 2}" in out.stdout
    assert os.listdir(logs) == ["job7.json"]
    table, tsv = os.path.join(tmp_dir, "results.parquet"), os.path.join(tmp_dir, "sorted.tsv")
    res = [sys.executable, "-m", "vecflow", "results", logs, "--master", "local[2]", "--out", table,
           "--export", "sorted", "--export-path", tsv]
    out = subprocess.run(res, env=env, capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stderr[-2000:]
    lines = [ln for f in sorted(glob.glob(os.path.join(tsv, "part-*"))) for ln in open(f) if ln.strip()]
    assert lines[0].rstrip("\n").split("\t") == ["gb", "nparts", "nodes", "blocks", "blk_sz", "rdd", "rdd_shift",
                                                  "rdd_avg"]
    assert lines[1].split("\t")[:5] == ["0", "2", "1", "1", "2"]  # partitions = 1 node * 2 cores * 1
