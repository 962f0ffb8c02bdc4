"""Personal data in very long runs: no text ends the job, and the work grows with the text."""

from __future__ import annotations

import random
import re
import time

import pytest

from quern.llm import personal

MB = 1_000_000
WHOLE = re.compile(r"(?<![A-Za-z0-9])[+(]?[0-9](?:[ ()./+-]{0,3}[0-9])++(?![A-Za-z0-9])")


@pytest.mark.parametrize(
    "text",
    ["1 " * (5 * MB) + "1x", "ip 1.2.3." + "0" * (10 * MB), "0" * (10 * MB) + ".1.2.3", "7" * (10 * MB), "1-1 x" * MB],
    ids=["broken run", "zeros at the end", "zeros first", "digits", "short runs"],
)
def test_ten_megabytes_take_seconds(text):
    began = time.process_time()
    personal.all_spans(text, {})
    assert time.process_time() - began < 3 * max(1, len(text) / MB)


def test_leading_zeros_of_any_length_are_an_address(docs_of):
    text = "ip 1.2.3." + "0" * 5000 + "7 end"
    assert personal.base_spans(text) == [(1, 3, 9 + 5001)]
    assert personal.base_spans("1.2.3." + "0" * 5000 + "256") == []
    assert personal.digest(docs_of([(1, text), (2, "call +1 202 555 0100")]), 10).where("doc_id = 1").head()["n_ip"] == 1


def test_zones_are_those_of_the_whole_pattern():
    rng = random.Random(8)
    for _ in range(20_000):
        text = "".join(rng.choice(["1", "23", " ", "-", "(", ")", "+", ".", "a", "é", "/", "٣"]) for _ in range(rng.randrange(25)))
        want = [m.span() for m in WHOLE.finditer(text) if sum(c.isdigit() for c in m.group()) >= 7]
        assert personal.zones(text) == want, text
