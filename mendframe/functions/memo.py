"""Column expressions that are built once for a JVM: large ones take longer to put together than to run."""
from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext


def once_a_jvm(build: Callable) -> Callable:
    """Keeps the result of a function of plain values for as long as the same gateway is in use."""
    held: dict = {}

    @wraps(build)
    def kept(*args):
        gateway = SparkContext._gateway
        if held.get("gateway") is not gateway:
            held.clear()
            held["gateway"] = gateway
        if args not in held:
            held[args] = build(*args)
        return held[args]

    return kept
