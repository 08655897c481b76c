"""Structured logging: one JSON object per line."""

from __future__ import annotations

import datetime
import json
import logging
import sys

_PLAIN = set(logging.makeLogRecord({}).__dict__) | {"message", "asctime"}


class JsonLines(logging.Formatter):
    """Time, level, logger, message and whatever ``extra`` holds."""

    def format(self, record: logging.LogRecord) -> str:
        at = datetime.datetime.fromtimestamp(record.created, datetime.UTC).isoformat()
        more = {k: v for k, v in record.__dict__.items() if k not in _PLAIN}
        out = {"time": at, "level": record.levelname, "logger": record.name, "message": record.getMessage()} | more
        if record.exc_info:
            out["error"] = self.formatException(record.exc_info)
        return json.dumps(out, default=str)


def logger(name: str, level: str = "INFO", stream=None) -> logging.Logger:
    log = logging.getLogger(f"tallyweft.{name}")
    if not log.handlers:
        handler = logging.StreamHandler(stream or sys.stderr)
        handler.setFormatter(JsonLines())
        log.addHandler(handler)
        log.propagate = False
    log.setLevel(level)
    return log
