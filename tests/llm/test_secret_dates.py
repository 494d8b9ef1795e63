"""A date hides nothing but itself."""

import re

import pytest

from bindery.llm import secretscan

ALLOW = re.compile("|".join(f"(?:{a})" for a in secretscan.ALLOWED))
TOKEN = "q7Rk2ZpX9vLm4TnB8sWd1YhC"


@pytest.mark.parametrize("date", ["2024-05-01", "2024-05-01T12-30-00Z", "2024-05-01-123000", "2024-05-01_12-30"])
def test_token_after_a_date_is_found(date):
    spans = secretscan.find_spans(f"on {date}-{TOKEN}.", ALLOW)
    assert len(spans) == 1
    (start, kind, stop) = spans[0]
    assert kind == 3 and start >= 3 + len(date) and stop == 4 + len(date) + len(TOKEN)
    masked = secretscan.mask_spans(f"on {date}-{TOKEN}.", spans, "[SECRET]")
    assert masked.startswith(f"on {date}") and "ZpX9vLm4TnB8sWd1YhC" not in masked


@pytest.mark.parametrize(
    "name",
    ["2024-05-01T12-30-00-123456Z", "2024-05-01-release-notes-final", "2024-05-01-123e4567-e89b-12d3-a456-426614174000"],
)
def test_dates_alone_and_dated_names_are_no_secrets(name):
    assert secretscan.find_spans(f"on {name}.", ALLOW) == []
