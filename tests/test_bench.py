"""bench.py prints one JSON line with every registered plan timed."""

import json
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_bench_contract():
    env = {**os.environ, "BENCH_SF_DIR": "/root/testdata/sf0.001", "BENCH_CPUS": "4", "BENCH_RUNS": "1"}
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py")], capture_output=True,
                         text=True, timeout=900, env=env)
    assert out.returncode == 0, out.stderr[-2000:]
    lines = [ln for ln in out.stdout.splitlines() if ln.strip()]
    assert len(lines) == 1
    res = json.loads(lines[0])
    assert res["unit"] == "sec" and res["sf"] == 0.001 and res["value"] > 0
    from rmalytics.plans.registry import QUERIES
    assert set(QUERIES) <= set(res["queries"])
    assert {"load_tables", "render_reports"} <= set(res["queries"])
