"""Headline queries, timed. Prints one JSON line.

The cohort's input tables are prepared from the benchmark tables first and timed apart; ``derive`` then
runs the whole derived layer over all tracks, and the other queries read what it left.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from catalog import QUERIES  # noqa: E402
from catalog import cohort as C  # noqa: E402
from wayfare.plans.derive import cleaned  # noqa: E402
from wayfare.session import local_session  # noqa: E402

HEADLINE = [
    "clean_gap_runs", "event_entry_runs", "event_visits", "kinematics_trial", "strategy_class", "metrics_trial", "quality_report",
    "gold_trials", "gold_events", "gold_quality", "errors_per_group", "cohort_learning_curve", "figure_occupancy",
    "figure_state_runs", "figure_speed_distribution", "review_queue", "timebase_nominal_dt", "timebase_presentation_order",
    "tracking_selection", "background_threshold",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=max(8, int(cpus)))
    seconds: dict[str, float] = {}

    def timed(name: str, fn) -> None:
        t = time.perf_counter()
        fn()
        seconds[name] = round(time.perf_counter() - t, 3)

    t = time.perf_counter()
    inputs = C.inputs(spark, sf_dir)
    frames = inputs.frames.count()
    prepare = round(time.perf_counter() - t, 3)
    timed("clean", lambda: run(cleaned(inputs, C.params())["clean"]))
    timed("derive", lambda: C.derived(spark, sf_dir))
    for name in HEADLINE:
        timed(name, lambda name=name: run(QUERIES[name](spark, sf_dir)))
    print(
        json.dumps(
            {
                "metric": "headline query time", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"), "cpus": cpus, "prepare_sec": prepare, "frames": frames,
                "clean_frames_per_sec": round(frames / seconds["clean"]), "derive_frames_per_sec": round(frames / seconds["derive"]),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
