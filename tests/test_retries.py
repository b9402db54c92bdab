import os
import subprocess
import sys

HERE = os.path.dirname(os.path.abspath(__file__))


def test_writers_survive_task_retries(tmp_dir):
    out = subprocess.run([sys.executable, os.path.join(HERE, "retry_job.py"), tmp_dir], capture_output=True,
                         text=True, timeout=900)
    assert out.returncode == 0 and "RETRIES OK" in out.stdout, (out.stdout[-1500:], out.stderr[-3000:])
    assert "injected task failure" in out.stderr  # the failures really happened
