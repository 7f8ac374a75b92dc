import threading

import pytest
from pyspark.sql import functions as F

from offerlake.operators import jobs
from offerlake.plans.options import SearchSettings
from offerlake.sources import history, settings

LOG = "job string, queue string, state string, at long, seq long"


def states(spark, rows):
    return jobs.job_states(spark.createDataFrame(rows, LOG))


def test_job_states(spark):
    rows = [("a", "q", "running", 2, 2), ("a", "q", "queued", 1, 1), ("a", "q", "failed", 3, 3), ("a", "q", "completed", 3, 4), ("b", "q", "queued", 2, 9), ("b", "q", "queued", 2, 9), ("c", "q", "completed", 7, 7)]
    rows += [(None, "q", "queued", 1, 1), ("d", None, "queued", 1, 1), ("e", "q", "odd", 1, 1), ("f", "q", None, 1, 1)]
    got = {r["job"]: tuple(r)[2:] for r in states(spark, rows).collect()}
    assert got == {"a": ("failed", 1, 2, 3, 3, 1), "b": ("queued", 2, None, None, 2, 9), "c": ("completed", 7, None, 7, 7, 7)}
    assert states(spark, []).count() == 0


def test_next_jobs(spark):
    rows = [("b", "idle", "queued", 1, 2), ("a", "idle", "queued", 1, 2), ("z", "idle", "queued", 1, 1), ("x", "busy", "running", 1, 1), ("y", "busy", "queued", 0, 0), ("w", "done", "failed", 0, 0)]
    assert [tuple(r) for r in jobs.next_jobs(states(spark, rows)).collect()] == [("idle", "z")]


@pytest.mark.parametrize("most", [1, 5, 50])
def test_kept_jobs(spark, most):
    """As one removes the oldest finished job, as long as there are too many."""
    rows = [(f"j{i}", f"q{i % 3 and 1}", ("queued", "running", "completed", "failed")[i * 7 % 4 if i % 5 else 2], i * 13 % 40, i) for i in range(120)]
    made = states(spark, rows)
    want = set()
    for queue in ("q0", "q1"):
        left = sorted((r["created_at"], r["created_seq"], r["job"], r["state"]) for r in made.collect() if r["queue"] == queue)
        while len(left) > most and any(x[3] in ("completed", "failed") for x in left):
            left.remove(next(x for x in left if x[3] in ("completed", "failed")))
        want |= {x[2] for x in left}
    kept = jobs.kept_jobs(made, most)
    assert {r["job"] for r in kept.collect()} == want
    assert kept.columns == made.columns
    assert "WindowGroupLimit" in kept._jdf.queryExecution().toString()


def test_settings_file(spark, tmp_path):
    path = f"file://{tmp_path}/settings"
    first = settings.read_settings(spark, path)
    assert first == settings.DEFAULTS and len(settings.versions(spark, path)) == 1
    given = {"maxResults": "7", "maxPages": 2.5, "limit": -1, "fetchMode": "odd", "ai": "true", "save": False, "sources": " olx ", "condition": "used", "minPrice": "", "maxPrice": "12.5", "browserHumanInLoop": True, "else": 1}
    want = SearchSettings(max_results=7, save=False, human_in_loop=True, sources="olx", condition="used", max_price=12.5)
    assert settings.write_settings(spark, path, given) == settings.read_settings(spark, path) == want
    for odd in (None, [], "x", {"maxResults": None, "sources": None, "minPrice": float("nan")}):
        assert settings.settings_of(odd) == settings.DEFAULTS


def test_readers_never_see_half_a_table(spark, tmp_path):
    """A reader beside a writer gets one version whole; an unfinished version isn't seen; old ones go."""
    path = f"file://{tmp_path}/searches"
    columns = "id string, name string, query string"
    write = lambda n: history.write_searches(spark.createDataFrame([(str(i), str(n), "q") for i in range(20)], columns).repartition(4), path)
    write(0)
    seen, failed = [], []

    def read():
        try:
            while not done.is_set():
                seen.append({(r["name"], r["n"]) for r in history.read_searches(spark, path).groupBy("name").agg(F.count(F.lit(1)).alias("n")).collect()})
        except Exception as e:
            failed.append(e)

    done, reader = threading.Event(), None
    reader = threading.Thread(target=read)
    reader.start()
    for n in range(1, 8):
        write(n)
    done.set()
    reader.join()
    assert not failed and seen and all(len(s) == 1 and next(iter(s))[1] == 20 for s in seen)
    (tmp_path / "searches" / "v-99999999999999999999-half").mkdir()
    assert {r["name"] for r in history.read_searches(spark, path).collect()} == {"7"}
    # What is written may be read from the same place.
    history.write_searches(history.read_searches(spark, path).withColumn("name", F.lit("own")), path)
    assert history.read_searches(spark, path).where("name = 'own'").count() == 20
    for n in range(settings.KEPT_VERSIONS):
        settings.write_version(spark.range(1), path)
    assert len(settings.versions(spark, path)) == settings.KEPT_VERSIONS
