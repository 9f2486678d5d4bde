"""Fetching result pages of bounded size; what they hold is read by operators.enrich."""

from __future__ import annotations

import json
import urllib.request

# Bytes read of an answer, and seconds waited for it.
TEXT_BYTES, TEXT_SECONDS = 2 << 20, 12
JSON_BYTES, JSON_SECONDS = 1 << 20, 10
AGENT = "stackwise"


def fetch_text(url: str, limit: int = TEXT_BYTES, seconds: float = TEXT_SECONDS) -> str:
    """The first ``limit`` bytes of an answer as UTF-8; bytes that aren't are left out. Faults of the network are raised."""
    request = urllib.request.Request(url, headers={"User-Agent": AGENT})
    with urllib.request.urlopen(request, timeout=seconds) as answer:
        return answer.read(limit).decode("utf-8", errors="ignore")


def fetch_json(url: str, limit: int = JSON_BYTES, seconds: float = JSON_SECONDS):
    """An answer in JSON; one that is longer than ``limit`` is an error, as it is cut."""
    return json.loads(fetch_text(url, limit, seconds))
