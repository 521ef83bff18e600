"""Session documents in parts: a header per session, and videos, frames and corrections as JSON lines beside it.

A session of any size is written and read in parallel; no task holds more than a line. Headers carry the number of lines of
each kind and are written last, so a folder without them is not finished, and a session whose lines were lost or changed in
number is reported instead of read.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.sources import session_json as SJ
from wayfare.sources.session_json import first_problem

KINDS = ("videos", "frames", "corrections")
MANIFEST = "struct<" + ",".join(f"{k}:bigint" for k in KINDS) + ">"
HEADER = (
    "schemaVersion double, toolVersion string, sessionId string, name string, reviewer string, mazeMap string, parameters string, "
    f"parts {MANIFEST}, _bad string"
)
LINES = {
    "videos": f"sessionId string, `order` int, v {SJ.VIDEO}",
    "frames": f"sessionId string, videoId string, pos int, f {SJ.FRAME}",
    "corrections": f"sessionId string, videoId string, e {SJ.ENTRY}",
}


@dataclass
class Parts:
    """The tables of session documents. ``sessions`` has ``problem`` when it was read; the others hold usable sessions only."""

    sessions: DataFrame
    videos: DataFrame
    frames: DataFrame
    corrections: DataFrame


def manifest(parts: Parts) -> DataFrame:
    """session_id and ``parts``: the lines of each kind."""
    return _counts({k: getattr(parts, k) for k in KINDS}).select("session_id", F.struct(*KINDS).alias("parts"))


def _counts(lines: dict[str, DataFrame]) -> DataFrame:
    one = [
        d.groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).select("session_id", *[(F.col("n") if k == kind else F.lit(0)).cast("bigint").alias(k) for k in KINDS])
        for kind, d in lines.items()
    ]
    return reduce(DataFrame.unionByName, one).groupBy("session_id").agg(*[F.sum(k).alias(k) for k in KINDS])


def write_parts(parts: Parts, folder: str, counted: DataFrame | None = None) -> None:
    """Write the tables below a new folder. ``counted``: the manifest, if it is at hand."""
    key = F.col("session_id").alias("sessionId")
    lines = {
        "videos": parts.videos.select(key, F.col("video_order").alias("order"), SJ.video_json(parts.videos).alias("v")),
        "frames": parts.frames.select(key, F.col("video_id").alias("videoId"), "pos", SJ.frame_json().alias("f")),
        "corrections": parts.corrections.select(key, F.col("video_id").alias("videoId"), SJ.entry_json().alias("e")),
    }
    for kind, d in lines.items():
        d.write.json(f"{folder}/{kind}", ignoreNullFields=True)
    none = F.struct(*[F.lit(0).cast("bigint").alias(k) for k in KINDS])
    counted = manifest(parts) if counted is None else counted
    heads = parts.sessions.join(counted, "session_id", "left").withColumn("parts", F.coalesce("parts", none))
    SJ.session_headers(heads).select("value").write.text(f"{folder}/sessions")


def _video_problems(videos: DataFrame, heads: DataFrame) -> DataFrame:
    """session_id and the first check that a video of the session fails."""
    v = videos.join(heads.select("session_id", F.get_json_object("maze_map", "$.holes.n").cast("int").alias("n_holes")), "session_id")
    checks: dict[str, Column] = {
        "a video has no id or filename": F.col("v.id").isNull() | F.col("v.filename").isNull(),
        "a video has no content fingerprint": F.col("v.fingerprint.sha256").isNull(),
        "a video has no valid trial type": F.col("v.trialType").isNull() | ~F.col("v.trialType").isin("acquisition", "probe"),
        "a video names a target that is not a hole number": F.col("v.targetHole") < 0,
        "a video names a target its map does not have": F.col("v.targetHole") >= F.col("n_holes"),
    }
    found = v.groupBy("session_id").agg(*[F.max(F.coalesce(bad, F.lit(False))).alias(f"bad{i}") for i, bad in enumerate(checks.values())])
    return found.select("session_id", first_problem(*[(F.col(f"bad{i}"), m) for i, m in enumerate(checks)]).alias("video_problem"))


def read_parts(spark: SparkSession, folder: str) -> Parts:
    """Read what ``write_parts`` wrote, with a reason for each session that cannot be used."""
    text = spark.read.text(f"{folder}/sessions").select("value", F.from_json("value", HEADER, SJ.OPTIONS).alias("d"))
    c = lambda n: F.col(f"d.{n}")
    own = first_problem(
        (c("_bad").isNotNull() | F.col("d").isNull() | ~F.trim("value").startswith("{"), "not valid JSON"),
        (c("schemaVersion").isNull(), "no schema version"),
        (c("schemaVersion") > SJ.SESSION_VERSION, "written by a newer version"),
        (c("schemaVersion") != SJ.SESSION_VERSION, "written by an older version that has no parts"),
        (c("toolVersion").isNull(), "it records no tool version"),
        (c("name").isNull(), "it has no session name"),
        (c("sessionId").isNull(), "it has no session id"),
        (~c("sessionId").rlike(SJ.UUID), "its session id is not a UUID"),
        (c("parts").isNull(), "it does not say how many lines it has"),
    )
    heads = text.select(
        c("sessionId").alias("session_id"), c("name").alias("name"), c("reviewer").alias("reviewer"), c("toolVersion").alias("tool_version"),
        c("mazeMap").alias("maze_map"), c("parameters").alias("parameters"), c("parts").alias("parts"), own.alias("own_problem"),
    )
    lines = {k: spark.read.schema(schema).json(f"{folder}/{k}").withColumnRenamed("sessionId", "session_id") for k, schema in LINES.items()}
    there = _counts({k: d.select("session_id") for k, d in lines.items()}).select("session_id", F.struct(*KINDS).alias("there"))
    twice = heads.groupBy("session_id").agg(F.count(F.lit(1)).alias("headers"))
    none = F.struct(*[F.lit(0).cast("bigint").alias(k) for k in KINDS])
    d = heads.join(there, "session_id", "left").join(twice, "session_id", "left").join(_video_problems(lines["videos"], heads), "session_id", "left")
    problem = F.coalesce("own_problem", first_problem(
        (F.col("headers") > 1, "another session has its id"),
        (F.coalesce("there", none) != F.col("parts"), "its lines are not those that its header counts"),
    ), "video_problem")
    sessions = d.select("session_id", "name", "reviewer", "tool_version", "maze_map", "parameters", problem.alias("problem"))
    usable = sessions.filter("problem is null").select("session_id")
    read = Parts(sessions, *[lines[k].join(usable, "session_id", "left_semi") for k in KINDS])
    n = lambda *pairs: F.struct(*[F.col(f"v.{a}").alias(b) for a, b in pairs])
    return replace(
        read,
        videos=read.videos.select(
            "session_id", F.col("v.id").alias("video_id"), F.col("order").alias("video_order"), "v.filename",
            n(("fingerprint.byteLength", "byte_length"), ("fingerprint.durationSeconds", "duration_s"), ("fingerprint.frameCount", "frame_count"), ("fingerprint.sha256", "sha256")).alias("fingerprint"),
            F.col("v.referenceResolution").alias("resolution"),
            n(("mazeTransform.translateX", "translate_x"), ("mazeTransform.translateY", "translate_y"), ("mazeTransform.rotationDeg", "rotation_deg"), ("mazeTransform.scale", "scale")).alias("transform"),
            "v.metadata.animal", "v.metadata.day", "v.metadata.trial", "v.metadata.group", F.col("v.trialType").alias("trial_type"), F.col("v.targetHole").alias("target_hole"),
        ),
        frames=read.frames.select("session_id", F.col("videoId").alias("video_id"), "pos", *SJ.frame_columns()),
        corrections=read.corrections.select("session_id", F.col("videoId").alias("video_id"), *SJ.entry_columns()),
    )
