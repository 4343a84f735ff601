"""Log lines of the driver, to the console and, if asked for, to a file."""

from __future__ import annotations

import logging
import os
import sys

#: fixed values: how a line looks
LINE, DATE = "[%(asctime)s] %(levelname)-8s %(name)s: %(message)s", "%Y-%m-%d %H:%M:%S"


def logger(name: str, level: int = logging.INFO, file: str | None = None) -> logging.Logger:
    """A logger that is set up once; `file` also takes what lies below `level`."""
    log = logging.getLogger(name)
    if not log.handlers:
        log.setLevel(logging.DEBUG if file else level)
        out = [(logging.StreamHandler(sys.stdout), level)]
        if file:
            os.makedirs(os.path.dirname(os.path.abspath(file)), exist_ok=True)
            out.append((logging.FileHandler(file, encoding="utf-8"), logging.DEBUG))
        for handler, least in out:
            handler.setLevel(least)
            handler.setFormatter(logging.Formatter(LINE, DATE))
            log.addHandler(handler)
    return log
