"""Wall-clock times of functions in the debug log."""

from __future__ import annotations

import functools
import logging
import time
from collections.abc import Callable

log = logging.getLogger("loomtext")


def timed(f: Callable) -> Callable:
    """``f``, with its duration logged even if it fails. A lazy DataFrame takes its time later, when it is acted on."""

    @functools.wraps(f)
    def run(*args, **kwargs):
        start = time.perf_counter()
        try:
            return f(*args, **kwargs)
        finally:
            log.debug("%s took %.3f s", f.__qualname__, time.perf_counter() - start)

    return run
