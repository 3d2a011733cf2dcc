"""The library's log: a level and a stream for all of it, on Python's logging."""

from __future__ import annotations

import logging
import sys
from typing import TextIO

# The levels by number; what lies below a level is silent.
LEVELS = {0: logging.DEBUG, 1: logging.INFO, 2: logging.WARNING, 3: logging.ERROR, 10: logging.CRITICAL + 1}
DEFAULT = 2

logger = logging.getLogger("lexiform")
_state: dict[str, object] = {"level": DEFAULT, "file": None, "handler": None}


def get_level() -> int:
    return _state["level"]


def set_level(level: int) -> None:
    if level not in LEVELS:
        raise ValueError(f"unknown level {level}")
    _state["level"] = level
    logger.setLevel(LEVELS[level])


def get_file() -> TextIO:
    return _state["file"] or sys.stderr


def set_file(file: TextIO | None) -> None:
    """Write to this stream from now on; None for standard error."""
    if _state["handler"]:
        logger.removeHandler(_state["handler"])
    _state["file"], _state["handler"] = file, logging.StreamHandler(file)
    logger.addHandler(_state["handler"])


set_level(DEFAULT)
