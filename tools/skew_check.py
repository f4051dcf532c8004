"""Skew evidence: each analysis over role tables in which one key holds a third
of one input, without salting and with it. Reports the shuffle-read records of
the most imbalanced stage's tasks from Spark's event log (in a fresh scratch
folder).

The skewed inputs are derived by Spark from the given tables and spread over 48
map tasks: AQE splits a partition along the map tasks that wrote it, so a table
that lies in one small file could not be split whatever the plan. Usage:

    python tools/skew_check.py [/root/testdata/sf0.1] [case ...]
"""

from __future__ import annotations

import glob
import json
import os
import statistics
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from stagelight.operators.joins import SHARES  # noqa: E402
from stagelight.plans import analyses as A, frames  # noqa: E402
from stagelight.session import build_session  # noqa: E402
from stagelight.sources.roles import Roles  # noqa: E402

MAP_TASKS, SHUFFLE_PARTITIONS = 48, 16
#: Stages whose largest task reads fewer records do not count.
LEAST_RECORDS = 8000
#: Case: the role and column that get the hot value, the value, and what is built.
CASES = {
    "base_transactions": ("transaction_data", "Student_id", 1, lambda r: frames.base(r)),
    "base_bridge": ("course_data", "Student_id", 1, lambda r: frames.base(r)),
    "base_area": ("student_learning_area", "StudentID", 1, lambda r: frames.base(r)),
    "demographics_enrolments": ("course_student", "Student_id", 1, lambda r: frames.demographics(r)),
    "teacher_course": ("course_student", "Course_id", 1, lambda r: frames.teacher_performance(r)),
    "first_course_no_teacher": ("course_history", "Teacher_id", -1, lambda r: A.teacher_first_course(frames.teacher_performance(r))),
    "first_course_hot_teacher": ("course_history", "Teacher_id", 1, lambda r: A.teacher_first_course(frames.teacher_performance(r))),
    "kpi_hot_teacher": ("course_history", "Teacher_id", 1, lambda r: frames.class_teachers(r)),
}


def skewed_roles(spark, sf_dir: str, role: str, column: str, value: int) -> Roles:
    """A third of the role's rows moved onto one key; all inputs spread."""
    parts = {k: v.repartition(MAP_TASKS) if k not in ("course_type", "course_basic") else v
             for k, v in Roles.from_tpch(spark, sf_dir).as_dict().items()}
    third = F.pmod(F.xxhash64(*parts[role].columns), F.lit(3)) == 1
    parts[role] = parts[role].withColumn(column, F.when(third, F.lit(value)).otherwise(F.col(column)))
    return Roles.from_frames(parts)


def task_stats(log_dir: str) -> list[tuple[int, int, int, float]]:
    """(stage, tasks, max records, median records) of shuffle-reading stages."""
    per_stage: dict[int, list[int]] = {}
    for path in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True):
        if os.path.isdir(path):
            continue
        with open(path) as fh:
            for line in fh:
                ev = json.loads(line)
                if ev.get("Event") != "SparkListenerTaskEnd":
                    continue
                read = ev.get("Task Metrics", {}).get("Shuffle Read Metrics", {})
                n = read.get("Total Records Read", 0)
                if n:
                    per_stage.setdefault(ev["Stage ID"], []).append(n)
    return [(s, len(v), max(v), statistics.median(v)) for s, v in sorted(per_stage.items())]


def run(sf_dir: str, case: str, salted: bool) -> None:
    role, column, value, build = CASES[case]
    log_dir = tempfile.mkdtemp(prefix=f"skew-{case}-", dir="/tmp")
    spark = build_session("local[8]", app_name=f"skew-{case}", shuffle_partitions=SHUFFLE_PARTITIONS, extra={
        # the test tables are tiny: AQE may call a partition skewed at this size
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir, "spark.eventLog.compress": "false",
        # the balance of shuffle joins is what is measured
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        # one share: no key can hold more than all rows, so none is salted
        SHARES: str(SHUFFLE_PARTITIONS if salted else 1)})
    spark.sparkContext.setLogLevel("ERROR")
    rows = build(skewed_roles(spark, sf_dir, role, column, value)).count()
    spark.stop()
    many = [s for s in task_stats(log_dir) if s[1] > 1 and s[2] >= LEAST_RECORDS]
    worst = max(many, key=lambda s: s[2] / max(s[3], 1), default=(0, 0, 0, 0))
    print(json.dumps({"case": case, "salted": salted, "rows": rows, "stage": worst[0], "tasks": worst[1],
                      "max_records": worst[2], "median_records": worst[3]}), flush=True)


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    for case in sys.argv[2:] or CASES:
        for salted in (False, True):
            run(sf, case, salted)
