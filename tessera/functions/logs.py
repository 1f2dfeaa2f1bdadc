"""JSON log lines with a correlation id."""

from __future__ import annotations

import contextvars
import json
import logging

_correlation = contextvars.ContextVar("correlation_id", default="-")


def set_correlation_id(value: str) -> None:
    _correlation.set(value)


def get_correlation_id() -> str:
    return _correlation.get()


class JsonFormatter(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        line = {"time": self.formatTime(record), "level": record.levelname, "logger": record.name, "message": record.getMessage(), "correlation_id": get_correlation_id()}
        return json.dumps(line | ({"exception": self.formatException(record.exc_info)} if record.exc_info else {}))


def setup_logger(name: str = "tessera", level: str = "INFO", file: str | None = None) -> logging.Logger:
    logger = logging.getLogger(name)
    logger.setLevel(level)
    for h in list(logger.handlers):
        logger.removeHandler(h)
    for handler in [logging.StreamHandler(), *([logging.FileHandler(file)] if file else [])]:
        handler.setFormatter(JsonFormatter())
        logger.addHandler(handler)
    return logger
