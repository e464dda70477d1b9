"""Steps and convergence of the iterative fits of a thread.

A fit records itself; whoever runs a trial takes the records into its table,
so that a step bound that was used up is seen there and not only as a warning."""

from __future__ import annotations

import threading
import warnings

_LOG = threading.local()


def record(model: str, steps: int, converged: bool) -> None:
    if not hasattr(_LOG, "rows"):
        _LOG.rows = []
    _LOG.rows.append({"model": model, "steps": int(steps), "converged": bool(converged)})
    if not converged:
        warnings.warn(f"the {model} fit used up {steps} steps", RuntimeWarning, stacklevel=3)


def taken() -> list[dict]:
    """The records of this thread since the last call."""
    rows, _LOG.rows = getattr(_LOG, "rows", []), []
    return rows
