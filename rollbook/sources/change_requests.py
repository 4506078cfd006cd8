"""Write requests as they arrive, turned into the change feeds of the record tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.sources.requests import Param, validate_requests

# The operation of each method, and per record the fields of the feed with their type and
# the operations that demand them.
OPERATIONS = {
    "class": {"POST": "create", "PUT": "rename", "DELETE": "delete"},
    "student": {"POST": "create", "PUT": "patch", "DELETE": "delete"},
    "course": {"POST": "create", "PUT": "patch", "DELETE": "delete"},
    "score": {"POST": "create", "PUT": "patch"},
}
FIELDS = {
    "class": {
        "class_uid": ("string", ("rename", "delete")),
        "class_name": ("string", ("create",)),
    },
    "student": {
        "student_uid": ("string", ("patch", "delete")),
        "student_name": ("string", ("create",)),
        "username": ("string", ()),
        "age": ("int", ()),
        "class_uid": ("string", ("create",)),
    },
    "course": {
        "course_uid": ("string", ("patch", "delete")),
        "class_uid": ("string", ("create", "patch")),
        "course_name": ("string", ("create", "patch")),
    },
    "score": {
        "course_uid": ("string", ("create", "patch")),
        "student_uid": ("string", ("create", "patch")),
        "score": ("decimal(10,2)", ("create", "patch")),
    },
}
# The role that may write.
WRITER = "teacher"


def change_requests(requests: DataFrame, record: str) -> tuple[DataFrame, DataFrame]:
    """Requests of one record type as (change feed, rejected requests with their reasons).

    ``requests`` has ``event_id``, ``ts``, ``method``, ``identity``, ``user_uid`` and the JSON ``body``.
    Courses belong to the user who writes them. A field that is null was sent: it satisfies the operation that
    demands it. A number that its column can't hold exactly is refused. Each frame parses every body once; keep
    the requests' frame first if both are used.
    """
    fields = FIELDS[record]
    op = F.coalesce(
        *[F.when(F.col("method") == m, F.lit(o)) for m, o in OPERATIONS[record].items()]
    )
    params = [Param(name, required=False) for name in fields]
    kept = requests.select("event_id", "ts", "identity", "user_uid", op.alias("op"), "body")
    checked = validate_requests(kept, "body", params, strict=False, presence=True)

    problems = [
        F.when(~F.coalesce(F.col("identity") == WRITER, F.lit(False)), "forbidden"),
        F.when(F.col("op").isNull(), "unknown method"),
    ]
    values = []
    sane = F.size("reasons") == 0
    for name, (kind, demanded) in fields.items():
        if demanded:
            absent = F.col("op").isin(*demanded) & ~F.col(f"_has_{name}")
            problems.append(F.when(sane & absent, f"{name}: required"))
        value = F.col(name).try_cast(kind)
        problems.append(F.when(F.col(name).isNotNull() & value.isNull(), f"{name}: not a number"))
        if kind.startswith("decimal"):
            problems.append(F.when(F.col(name).try_cast("decimal(38,18)") != value, f"{name}: too many digits"))
        values.append(value.alias(name))
    reasons = F.concat("reasons", F.array_compact(F.array(*problems)))
    judged = checked.select(
        "event_id", "ts", "op", "user_uid", *values, reasons.alias("reasons")
    )
    fine = F.size("reasons") == 0
    columns = ["event_id", "ts", "op", *fields]
    if record == "course":
        judged = judged.withColumn("teacher_uid", F.col("user_uid"))
        columns.append("teacher_uid")
    rejected = judged.where(~fine).select("event_id", "ts", "op", "reasons")
    return judged.where(fine).select(*columns), rejected
