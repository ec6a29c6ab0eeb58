"""Log lines as JSON, redacted."""

import datetime as dt
import io
import json
import logging

import pytest
from pyspark.sql import functions as F

from spindrift.logs import event, log_to
from spindrift.plans.runs import Options, run_scan
from spindrift.schemas import CANDIDATE
from spindrift.sources.paged import Paging, fetched, observed
from spindrift.storage import Store

from .fixtures import candidate


@pytest.fixture
def lines():
    out, errors = io.StringIO(), io.StringIO()
    log = log_to(out, errors)
    yield log, lambda: [[json.loads(x) for x in s.getvalue().splitlines()] for s in (out, errors)]
    for handler in log.handlers[:]:
        log.removeHandler(handler)
    log.propagate = True


def test_events_are_json_lines_without_secrets(lines):
    log, read = lines
    event(log, "info", "account.linked", user="é\n", tokens={"a": 1}, nested=[{"clientSecret": "x", "n": 1.5, "at": dt.date(2030, 1, 2)}])
    event(log, "error", "account.failed", password="x", zipcode="1")
    logging.getLogger("spindrift.other").warning("plain %s", "text")
    out, errors = read()
    assert [(r["level"], r["event"]) for r in out] == [("info", "account.linked"), ("warn", "plain text")] and out[0]["timestamp"].endswith("Z")
    assert out[0]["user"] == "é\n" and out[0]["tokens"] == "[REDACTED]" and out[0]["nested"] == [{"clientSecret": "[REDACTED]", "n": 1.5, "at": "2030-01-02"}]
    assert [(r["event"], r["password"], r["zipcode"]) for r in errors] == [("account.failed", "[REDACTED]", "[REDACTED]")]


def test_a_run_says_what_it_did(spark, tmp_path, lines):
    def broken(s, o):
        raise OSError("token=abc")

    sources = {"mock": lambda s, o: s.createDataFrame([candidate(1)], CANDIDATE), "bad": broken}
    run_scan(Store(spark, f"file://{tmp_path}"), sources, Options(now=dt.datetime(2030, 5, 2), dry_run=True))
    out, errors = lines[1]()
    assert [(r["event"], r["provider"]) for r in out] == [("scan.started", "mock"), ("scan.completed", "mock"), ("scan.started", "bad"), ("scan.failed", "bad")] and not errors
    assert out[1]["discovered"] == 1 and "abc" not in json.dumps(out)


def test_a_run_says_how_often_it_asked(spark, tmp_path, lines):
    def mock(s, o):
        keys = s.createDataFrame([("a",), ("b",)], "key string")
        rows, mock.calls = observed(fetched(keys, "key", lambda k, at: {"items": [at], "total": 3}, Paging("total"), metered=True))
        one = s.createDataFrame([candidate(1)], CANDIDATE)
        return one.join(rows.agg(F.count("*").alias("n_items")), F.col("n_items") == 6).select(*one.columns)

    mock.calls = None
    run_scan(Store(spark, f"file://{tmp_path}"), {"mock": mock}, Options(now=dt.datetime(2030, 5, 2), dry_run=True))
    done = lines[1]()[0][-1]
    assert done["event"] == "scan.completed" and done["discovered"] == 1 and done["requests"] == 6 and done["failures"] == 0
