import json
import os
import subprocess
import sys
import tempfile


def test_results_survive_task_retries():
    script = os.path.join(os.path.dirname(os.path.abspath(__file__)), "retry_job.py")
    env = dict(os.environ, RETRY_MARK_DIR=tempfile.mkdtemp(prefix="tokenmill-retry-"))
    out = subprocess.run([sys.executable, script], capture_output=True, text=True, timeout=600, env=env)
    line = [x for x in out.stdout.splitlines() if x.startswith("{")]
    assert line, out.stderr[-2000:]
    res = json.loads(line[-1])
    assert res["failed_attempts"] >= 2  # the failure really happened, in both jobs
    assert res["equal"] and res["rows"] == 5000 and res["bins"] == 5000
