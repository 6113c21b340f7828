"""The paced stream: its pace, its patience, and what it still knows after a stop."""

import time
from pathlib import Path

import pytest

from tamarack.sources.services import Busy
from tamarack.streaming import paced


class Slow:
    """Busy at its first call; writes down when it answers what."""

    def __init__(self, log):
        self.log = Path(log)

    def bindings(self, query):
        with self.log.open("a") as f:
            f.write(f"{time.time()} {query}\n")
        if self.log.read_text().count("\n") == 1:
            raise Busy
        return [(query, f"label of {query}"), (query, "another")]


def test_requests_keep_their_pace_and_survive_a_stop(spark, tmp_path):
    source, sink, checkpoint, log = (str(tmp_path / x) for x in ("in", "out", "state", "log"))
    arrive = lambda *of: spark.createDataFrame([("one", k, f"Q{k}") for k in of], paced.REQUESTS).write.mode("append").parquet(source)
    make = lambda: Slow(log)
    arrive(0, 1, 2, 3)
    first = paced.work_through(spark, source, make, sink, checkpoint, 2, pause=0.5, wait=1.0, most=120)
    done = first.where("pos = -1").count()
    assert 2 <= done < 6
    arrive(3, 4, 5)  # one of them arrives again
    every = paced.work_through(spark, source, make, sink, checkpoint, 6, pause=0.5, wait=1.0, most=120)
    rows = sorted((r.chunk, r.pos, r.id, r.label) for r in every.where("pos >= 0").collect())
    answered = {r[0] for r in rows}
    assert answered == set(range(6))
    assert {(k, p, i, x) for k, p, i, x in rows} == {(k, p, f"Q{k}", x) for k in range(6) for p, x in ((0, f"label of Q{k}"), (1, "another"))}
    with pytest.raises(TimeoutError):  # there is no seventh
        paced.work_through(spark, source, make, sink, checkpoint, 7, pause=0.5, wait=1.0, most=3)
    assert paced.answered(spark, sink).count() == every.count()
    asked = [float(line.split()[0]) for line in Path(log).read_text().splitlines()]
    assert asked[1] - asked[0] >= 0.8  # it waited when it was told to
    gaps = [b - a for a, b in zip(asked[1:], asked[2:])]
    assert min(gaps) >= 0.3  # and paused after each answer; a batch's clock is read when it begins
