"""Streams with state against the same rules applied in one go, in one batch or many, and after a restart."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flockscope.streaming import state as S

EVENTS = "job_id string, kind string, ts timestamp, seq long, worker string, retry boolean"
MINUTE = 60_000_000


def events(seed, n=300):
    """In the order of time, so that batches do not change it."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        kind = rng.choices(["created", "claim", "complete", "fail"], [3, 5, 2, 2])[0]
        out.append((f"j{rng.randint(0, 14)}", kind, i * MINUTE // 2 + rng.randint(0, 1000), i, rng.choice("ab"), rng.random() < 0.7))
    return out


def expected(rows, lease, most, late):
    state = {}
    for job, kind, at, _, worker, retry in rows:
        state[job] = S.step(state.get(job, (None, 0, None, None, 0, 0)), kind, at, worker, retry, lease, most)
    end = max(r[2] for r in rows) // 1000 - late // 1000
    out = {}
    for job, s in state.items():
        if s[0] == "processing" and s[4] // 1000 + 1 <= end:
            s = (*S.returned(s[1], most)[:1], s[1], None, "lease expired", s[4], s[5])
        if s[0]:
            out[job] = s[:4]
    return out


def write(spark, rows, folder, parts):
    size = -(-len(rows) // parts)
    for p in range(parts):
        part = [(j, k, pd.Timestamp(at, unit="us").to_pydatetime(), s, w, r) for j, k, at, s, w, r in rows[p * size : (p + 1) * size]]
        spark.createDataFrame(part, EVENTS).coalesce(1).write.parquet(f"{folder}/p{p}")


@pytest.mark.parametrize("parts", [1, 3])
def test_job_queue(spark, tmp_path, parts):
    rows = events(parts)
    write(spark, rows, tmp_path / "in", parts)
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    out = S.last_states(spark, S.job_states(stream, "10 minutes", 3, "1 minute"), "job_id", str(tmp_path / "work"))
    got = {r.job_id: (r.status, r.attempts, r.worker, r.error) for r in out.collect()}
    want = expected(rows, 10 * MINUTE, 3, MINUTE)
    assert got == want and {s[0] for s in want.values()} >= {"done", "error"} and len(want) > 10


def test_job_queue_goes_on_after_a_restart(spark, tmp_path):
    rows = events(9)
    write(spark, rows[:150], tmp_path / "in/a", 1)
    run = lambda: S.last_states(spark, S.job_states(spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in/*/*"), "10 minutes", 3, "1 minute"), "job_id", str(tmp_path / "work")).collect()
    run()
    write(spark, rows[150:], tmp_path / "in/b", 1)
    assert {r.job_id: (r.status, r.attempts, r.worker, r.error) for r in run()} == expected(rows, 10 * MINUTE, 3, MINUTE)


def test_recent_duplicates(spark, tmp_path):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 6))
    rows = [(i, (base[rng.integers(0, 12)] + rng.normal(0, rng.choice([0.02, 0.6]), 6)).tolist(), i, f"g{i % 3}") for i in range(120)]
    rows[50] = (50, [0.0] * 6, 50, "g2")
    for p in range(3):
        spark.createDataFrame([*rows[p * 40 : (p + 1) * 40], (None, None, 0, "g0")], "id long, v array<double>, at long, place string").coalesce(1).write.parquet(f"{tmp_path}/in/p{p}")
    stream = spark.readStream.schema("id long, v array<double>, at long, place string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = sorted((r.id, r.duplicate_of, r.score) for r in S.found_duplicates(spark, S.recent_duplicates(stream, "place", 0.95, 7)).collect())
    want = []
    for i, v, _, g in rows:
        before = [(j, u) for j, u, _, h in rows[:i] if h == g and np.any(u)][-7:]
        if np.any(v) and before:
            scores = [(-round(float(np.dot(v, u) / np.linalg.norm(v) / np.linalg.norm(u)), 9), j) for j, u in before]
            if -min(scores)[0] >= 0.95:
                want.append((i, min(scores)[1], -min(scores)[0]))
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want] and len(want) > 5
    assert [c for *_, c in got] == pytest.approx([c for *_, c in want])


def test_sessions_over_batches(spark, tmp_path):
    """Rows that come late, but not too late, join sessions of batches before; each batch starts and merges some."""
    rng = random.Random(6)
    rows = sorted((rng.randint(0, 3 * 86_400), f"u{rng.randint(0, 4)}", rng.choice(["a", "b"])) for _ in range(160))
    late = [rows.pop(rng.randrange(40, 60)) for _ in range(10)]
    parts = [rows[:60], [*rows[60:100], *late], rows[100:]]
    for p, part in enumerate(parts):
        frame = [(u, k, pd.Timestamp(t, unit="s").to_pydatetime()) for t, u, k in part]
        spark.createDataFrame([*frame, ("u0", "a", None)], "user string, kind string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/p{p}")
    stream = spark.readStream.schema("user string, kind string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    out = S.sessions(spark, stream, "ts", ["user", "kind"], "2 hours", "2 days")
    got = sorted((r.user, r.kind, r.start.timestamp(), r.end.timestamp(), r.n) for r in out.collect())
    want = []
    for u in range(5):
        for k in "ab":
            last = None
            for t in sorted(t for part in parts for t, x, y in part if (x, y) == (f"u{u}", k)):
                if last is not None and t < last[3]:
                    last[3:] = [t + 7200, last[4] + 1]
                else:
                    last = [f"u{u}", k, t, t + 7200, 1]
                    want.append(last)
    want = sorted(map(tuple, want))
    assert [(u, k, e - s, n) for u, k, s, e, n in got] == [(u, k, e - s, n) for u, k, s, e, n in want]
    assert sum(n for *_, n in got) == 160 and len(want) > 40 and max(n for *_, n in want) > 2


def test_backfill_writes_a_key_once(spark, tmp_path):
    from flockscope.streaming import pipelines as P

    history = spark.createDataFrame([(1, "h"), (2, "h")], "id long, v string")
    for p, rows in enumerate([[(2, "s"), (3, "s")], [(3, "t"), (4, "t"), (4, "u")]]):
        spark.createDataFrame(rows, "id long, v string").coalesce(1).write.parquet(f"{tmp_path}/in/p{p}")
    stream = spark.readStream.schema("id long, v string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    for _ in range(2):  # the second time there is nothing new
        table = P.backfill_then_stream(history, stream, lambda df: df, f"file://{tmp_path}/out", f"{tmp_path}/checkpoint", ["id"], ["v"])
    assert sorted((r.id, r.v) for r in table.read().collect()) == [(1, "h"), (2, "h"), (3, "s"), (4, "t")]


def test_workers_get_the_package(tmp_path):
    """A program elsewhere that only has the package on its own path."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    code = f"""
import sys
sys.path.insert(0, {str(root)!r})
from flockscope.session import session
from flockscope.operators import language
spark = session("elsewhere", spark__master="local[1]", spark__ui__enabled="false")
docs = spark.createDataFrame([("en", "the house and the garden"), ("fr", "la maison et le jardin")], "lang string, text string")
model = language.profiles(docs, ("en", "fr"))
print("told", sorted(r.language for r in language.detect(docs, "text", model, ("en", "fr")).collect()))
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=150)
    assert "told ['en', 'fr']" in done.stdout, done.stderr[-2000:]


def test_recent_duplicates_of_a_folder_of_files(spark, tmp_path):
    """The table may be one file or a folder of part files, and may have none with rows."""
    from oracle import DATA

    from flockscope.plans.all_queries import QUERIES

    table = spark.read.parquet(f"{DATA}/embeddings.parquet")
    table.repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    one, many = (sorted(tuple(r) for r in QUERIES["stream_recent_duplicates"](spark, str(d)).collect()) for d in (DATA, tmp_path))
    assert one == many and len(one) > 10
    table.limit(0).write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert QUERIES["stream_recent_duplicates"](spark, f"{tmp_path}/none").count() == 0
