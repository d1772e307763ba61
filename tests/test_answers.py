"""Outside answers: asked once, tried again, rate, and what a broken job leaves for the next."""

from __future__ import annotations

import os
import time
from collections import Counter
from pathlib import Path

import pytest

from weftwork.operators import answers


def logged(folder, fails=lambda r: False):
    """A provider that writes each request down before it answers, and never answers some."""

    def call(requests):
        for r in requests:
            Path(folder, f"{r['a']}-{time.time_ns()}-{os.getpid()}").write_text("")
            if fails(r):
                raise ValueError(r)
        return [{"v": r["a"] * 2, "w": None} for r in requests]

    return call


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(k, k % 30, "have" if k % 10 == 9 else None, None) for k in range(100)], "id int, a int, v string, w string")


def asked(folder):
    return Counter(int(p.name.split("-")[0]) for p in Path(folder).iterdir())


def test_each_request_once(spark, rows, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    kept = answers.Answers(spark, f"file://{tmp_path}/kept", 4)
    missing = rows.select("id", "a", "v")
    got = kept.ask(missing, "id", ["a"], ["v"], logged(log), batch=3)
    assert sorted((r.id, r.v) for r in got.collect()) == [(k, str(k % 30 * 2)) for k in range(100) if k % 10 != 9]
    assert set(asked(log).values()) == {1} and len(asked(log)) == 27
    assert kept.ask(missing, "id", ["a"], ["v"], logged(log)).count() == 90 and set(asked(log).values()) == {1}
    # other fields of the same inputs are another request
    other = kept.ask(rows, "id", ["a"], ["v", "w"], logged(log)).where("id = 1").first()
    assert (other.v, other.w) == ("2", None) and asked(log)[1] == 2


def test_failures_are_tried_and_asked_again_next_time(spark, rows, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    kept = answers.Answers(spark, str(tmp_path / "kept"), 4)
    missing = rows.select("id", "a", "v").where("v is null")
    got = {r.id: r.v for r in kept.ask(missing, "id", ["a"], ["v"], logged(log, lambda r: r["a"] in (3, 4)), batch=5, tries=3, pause=0.01).collect()}
    assert {k for k, v in got.items() if v is None} == {k for k in got if k % 30 in (3, 4)} and len(got) == 90
    assert asked(log)[3] in (2, 3) and max(asked(log).values()) <= 3  # in a batch of five at first, then alone
    before = asked(log)
    got = {r.id: r.v for r in kept.ask(missing, "id", ["a"], ["v"], logged(log)).collect()}
    assert None not in got.values() and {a: n - before[a] for a, n in asked(log).items() if n > before[a]} == {3: 1, 4: 1}


def test_a_broken_job_keeps_its_answers(spark, rows, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    kept = answers.Answers(spark, str(tmp_path / "kept"), 2)
    missing = rows.select("id", "a", "v")

    def dies(requests):
        if len(list(Path(log).iterdir())) >= 12:
            os._exit(1)  # the worker is gone, and with it the task
        return logged(log)(requests)

    with pytest.raises(Exception, match="[Pp]ython worker|crashed|EOF"):
        kept.ask(missing, "id", ["a"], ["v"], dies, at_once=1, flush=1, parts=1)
    done = len(asked(log))
    assert 0 < kept.stored().count() <= done
    got = kept.ask(missing, "id", ["a"], ["v"], logged(log)).collect()
    assert all(r.v == str(r.id % 30 * 2) for r in got) and sum(n > 1 for n in asked(log).values()) <= 1


def test_rate_and_short_answers():
    times = []

    def provider(requests):
        times.append(time.monotonic())
        return [{"v": r["a"]} for r in requests[:1]]  # leaves out all but the first

    a = answers.Asker(provider, 4, 3, 50.0, 2, 0.0)
    got = dict(a.answers((str(k), {"a": k}) for k in range(8)))
    assert got == {str(k): {"v": k} for k in range(8)} and len(times) == 2 + 6
    assert sorted(times)[-1] - min(times) >= 7 / 50 - 0.02


def test_nothing_to_ask(spark, rows, tmp_path):
    kept = answers.Answers(spark, str(tmp_path / "kept"))
    assert kept.ask(rows.where("id < 0").select("id", "a", "v"), "id", ["a"], ["v"], lambda r: 1 / 0).count() == 0
    assert kept.stored().count() == 0
