"""Each chunk is sent once, whatever fails."""

import json
import os

import pytest

from spindrift.plans.exports import export_batches
from spindrift.sources.chunk_sink import ChunkWriter, Ledger, send_once


def service(folder):
    """A playlist as a folder of calls; it loses its answer where `lose` names the first item."""

    def send(ids):
        n = len(os.listdir(folder))
        with open(f"{folder}/{ids[0]}-{n}", "w") as f:
            json.dump(ids, f)
        if os.path.exists(f"{folder}.lose-{ids[0]}"):
            os.remove(f"{folder}.lose-{ids[0]}")
            raise OSError("the answer was lost")
        if os.path.exists(f"{folder}.refuse-{ids[0]}"):
            os.remove(f"{folder}.refuse-{ids[0]}")
            os.remove(f"{folder}/{ids[0]}-{n}")
            raise OSError("refused")
        return f"snap-{ids[0]}"

    def find(ids):
        there = [x for f in os.listdir(folder) for x in json.load(open(f"{folder}/{f}"))]
        return f"found-{ids[0]}" if set(ids) <= set(there) else None

    return send, find


def received(folder):
    return sorted(x for f in os.listdir(folder) for x in json.load(open(f"{folder}/{f}")))


def test_a_job_that_fails_after_sending_sends_nothing_twice(spark, tmp_path):
    folder, ledger = str(tmp_path / "calls"), f"file://{tmp_path}/ledger"
    os.mkdir(folder)
    plan = spark.createDataFrame([(f"t{k:03d}", k, "add" if k % 4 else "present") for k in range(200)], "provider_track_id string, ordinal long, bucket string")
    batches = export_batches(plan, 20)
    wanted = sorted(f"t{k:03d}" for k in range(200) if k % 4)
    send, find = service(folder)
    for mark in (f"lose-{wanted[20]}", f"refuse-{wanted[100]}", f"lose-{wanted[140]}"):
        open(f"{folder}.{mark}", "w").close()
    for _ in range(3):  # each failure ends a job, and the next one goes on
        try:
            sent = send_once(batches, send, find, ledger)
            break
        except Exception as e:
            assert "answer was lost" in str(e) or "refused" in str(e)
    else:
        sent = send_once(batches, send, find, ledger)
    assert received(folder) == wanted
    answers = {r.batch: (r.n_items, r.snapshot_id) for r in sent.collect()}
    assert len(answers) == 8 and sum(n for n, _ in answers.values()) == 150
    assert answers[1][1] == f"found-{wanted[20]}" and answers[5][1] == f"snap-{wanted[100]}"
    again = send_once(batches, send, find, ledger)  # a finished job that is repeated
    assert received(folder) == wanted and {r.batch: (r.n_items, r.snapshot_id) for r in again.collect()} == answers
    assert send_once(batches.limit(0), send, find, f"file://{tmp_path}/none").count() == 0


def test_another_plan_under_the_same_ledger_is_refused(tmp_path):
    folder = str(tmp_path / "calls")
    os.mkdir(folder)
    writer = ChunkWriter(Ledger(f"file://{tmp_path}/ledger"), *service(folder))
    assert writer.once(0, ["a", "b"]) == "snap-a" == writer.once(0, ["a", "b"])
    with pytest.raises(ValueError, match="another one"):
        writer.once(0, ["a", "c"])
    assert received(folder) == ["a", "b"]
