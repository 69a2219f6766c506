"""The commands from generated transcripts on: ingest, then each command over its artifact."""

import json

import pytest

from trailmine.plans.cli import run
from trailmine.sources import generator


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("cli")
    generator.generate(str(at / "transcripts"))
    said = []
    assert run(["ingest", "--root", str(at / "transcripts"), "--data", str(at / "data")], said.append) == 0
    assert any(x.startswith("events") or "events" in x for x in said)
    return str(at / "data")


def output(made, *args):
    said = []
    assert run([args[0], "--data", made, *args[1:]], said.append) == 0
    return "".join(said)


def test_surprise_has_both_ends_and_the_mean(made):
    found = json.loads(output(made, "surprise", "--format", "json", "--min-toks", "1", "--limit", "4"))
    rows = found["rows"] if "rows" in found else next(v for v in found.values() if isinstance(v, list))
    bits = [r["bits"] for r in rows]
    assert bits == sorted(bits) and 2 <= len(bits) <= 4 and min(bits) <= found["mean_bits"] <= max(bits) and found["streams"] >= len(bits)


def test_top_0_is_no_cap(made):
    count = lambda *x: len(next(v for v in json.loads(output(made, "rank", "--format", "json", "--min-support", "3", *x)).values() if isinstance(v, list)))
    assert count("--top", "0") >= count("--top", "1") > 0


def test_a_kind_that_is_none_is_an_error(made):
    with pytest.raises(ValueError, match="no such kind"):
        output(made, "report", "--kind", "nonsense", "--min-support", "3")
