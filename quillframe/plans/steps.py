"""Running a list of named cleaning steps."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quillframe.operators import prep
from quillframe.session import write_out

logger = logging.getLogger(__name__)

Step = Callable[..., DataFrame]

STEPS: dict[str, Step] = {
    "drop_high_null": prep.drop_high_null,
    "deduplicate": prep.deduplicate,
    "type_cast": prep.type_cast,
    "outlier_clip": prep.outlier_clip,
    "impute": prep.impute,
    "normalize": prep.normalize,
    "filter_rows": prep.filter_rows,
    "rename_columns": prep.rename_columns,
    "sort": prep.sort,
    "sample": prep.sample,
}


# Steps that look at the whole table before they change it.
STATISTICS = {"drop_high_null", "outlier_clip", "impute", "normalize", "sample"}
# Steps that shuffle the table.
SHUFFLES = {"deduplicate", "sort"}


def register_step(name: str, step: Step) -> None:
    """Add a step: ``step(df, **config) -> DataFrame``."""
    STEPS[name] = step


@dataclass
class StepRun:
    """The result of a list of steps, with its log."""

    df: DataFrame
    entries: list[dict[str, Any]] = field(default_factory=list)
    _counts: list[Observation] = field(default_factory=list)

    def log(self) -> list[dict[str, Any]]:
        """One entry per step; row counts are there once an action has run on ``df``."""
        counts = [o.get["rows"] for o in self._counts]
        done, out = 0, []
        for entry in self.entries:
            entry = dict(entry)
            if counts and entry["status"] == "ok":
                entry |= {"rows_before": counts[done], "rows_after": counts[done + 1]}
                done += 1
            out.append(entry)
        return out


def run_steps(df: DataFrame, steps: Sequence[dict[str, Any]], on_error: str = "raise", count_rows: bool = False) -> StepRun:
    """Apply ``[{"processor": name, "config": {...}}]`` in order; unknown steps are skipped.

    The table is written out before a step that takes statistics and after one that shuffles, so that no step
    runs the steps before it again. ``on_error="skip"`` keeps a failing step's input. ``count_rows`` observes the rows between
    steps during the caller's own action; it keeps filters from moving past the step before.
    """
    run = StepRun(df)

    def observed(frame: DataFrame) -> DataFrame:
        if not count_rows:
            return frame
        seen = Observation()
        run._counts.append(seen)
        return frame.observe(seen, F.count(F.lit(1)).alias("rows"))

    frame, fresh = observed(df), True  # fresh: nothing has been applied since the table was last read
    for i, step in enumerate(steps):
        name = step.get("processor")
        apply = STEPS.get(name)
        if apply is None:
            run.entries.append({"processor": name, "status": "skipped", "reason": "unknown processor"})
            continue
        if name in STATISTICS and not fresh:
            frame, fresh = write_out(frame, "step"), True
        try:
            changed = apply(frame, **step.get("config", {}))
        except Exception as error:
            if on_error != "skip":
                raise
            logger.warning("step %s failed: %s", name, error)
            changed = frame
        run.entries.append({"processor": name, "status": "ok"})
        frame, fresh = observed(changed), False
        if name in SHUFFLES and i + 1 < len(steps):
            frame, fresh = write_out(frame, "step"), True
    run.df = frame
    return run
