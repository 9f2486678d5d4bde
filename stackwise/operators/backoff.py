"""The pause that lookups make after many failures in a row: kept in a file, so that it outlives the process."""

from __future__ import annotations

import json
import os
import threading
import time
from collections.abc import Callable

from .enrich import PAUSE_SECONDS, STREAK

# The reason that is kept, and how long after a pause's end lookups go on.
REASON = "豆瓣访问受限或网络连续查询失败，已暂停联网补齐"
LEAST_DELAY, AFTER = 5.0, 2.0


class Backoff:
    """Counts consecutive failures; the STREAK-th begins a pause of PAUSE_SECONDS. Lookups are made one at a time, so one object counts them all."""

    def __init__(self, path: str, clock: Callable[[], float] = time.time):
        self.path, self.clock, self.streak = path, clock, 0
        self._lock, self._timer = threading.Lock(), None

    def status(self) -> dict:
        """active, until, reason. A file that is missing or unreadable is no pause."""
        try:
            with open(self.path, encoding="utf-8") as f:
                kept = json.load(f)
            until, reason = float(kept.get("until") or 0), str(kept.get("reason") or "")
        except (OSError, ValueError, TypeError, AttributeError):
            return {"active": False, "until": 0.0, "reason": ""}
        return {"active": until > self.clock(), "until": until, "reason": reason}

    def pause(self, reason: str = REASON) -> float:
        """Begins a pause and returns its end; the file is replaced whole."""
        until = self.clock() + PAUSE_SECONDS
        os.makedirs(os.path.dirname(self.path) or ".", exist_ok=True)
        with open(f"{self.path}.new", "w", encoding="utf-8") as f:
            json.dump({"until": until, "reason": reason}, f, ensure_ascii=False, indent=2)
        os.replace(f"{self.path}.new", self.path)
        return until

    def seen(self, failed: bool) -> bool:
        """Counts an outcome; whether a pause begins with it. A success ends the streak."""
        self.streak = self.streak + 1 if failed else 0
        if self.streak < STREAK:
            return False
        self.streak = 0
        self.pause()
        return True

    def resume(self, start: Callable[[], object], timer: Callable = threading.Timer) -> float | None:
        """Calls ``start`` in a thread of its own after the pause; returns the delay, None if such a call is waiting already."""
        with self._lock:
            if self._timer and self._timer.is_alive():
                return None
            delay = max(LEAST_DELAY, self.status()["until"] - self.clock() + AFTER)
            self._timer = timer(delay, start)
            self._timer.daemon = True
            self._timer.start()
            return delay
