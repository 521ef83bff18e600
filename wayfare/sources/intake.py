"""Video intake: triage by file, content fingerprints and duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Extensions of video files that can be read after conversion.
OTHER_VIDEO = ["avi", "mov", "mkv", "webm", "mpg", "mpeg", "m4v", "wmv", "flv", "mts", "m2ts", "ogv", "3gp"]


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files with their length and content hash; each file is hashed where it is read."""
    df = spark.read.format("binaryFile").load(path)
    return df.select("path", F.col("length").alias("byte_length"), F.sha2("content", 256).alias("sha256"))


def triage(files: DataFrame) -> DataFrame:
    """Accept MP4 files; for others say what they are and whether re-encoding helps."""
    name = F.col("path")
    ok = name.rlike(r"(?i)\.mp4$")
    ext = F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))
    what = F.when(ext != "", F.concat(F.lit("extension "), ext)).otherwise("no extension")
    return files.withColumns(
        {
            "accepted": ok,
            "reason": F.when(~ok, F.concat(F.lit("Only MP4 (H.264) can be read; here: "), what, F.lit("."))),
            "hint": F.when(~ok & ext.isin(OTHER_VIDEO), "convert to MP4 with H.264"),
        }
    )


def duplicates(videos: DataFrame) -> DataFrame:
    """Videos whose content is already in their session: the first in order is kept.

    The first of each content is found by aggregation, so many copies of one file do not meet in one task.
    """
    keys = ["session_id", "byte_length", "sha256"]
    v = videos.select(
        "session_id", "video_id", "video_order", F.col("fingerprint.byte_length").alias("byte_length"), F.col("fingerprint.sha256").alias("sha256")
    )
    first = v.groupBy(*keys).agg(F.min_by("video_id", "video_order").alias("duplicate_of"))
    return v.join(first, keys).filter(F.col("video_id") != F.col("duplicate_of")).select("session_id", "video_id", "duplicate_of")


def match(files: DataFrame, videos: DataFrame) -> DataFrame:
    """Attach files to videos by length and hash, never by name."""
    v = videos.select("session_id", "video_id", F.col("fingerprint.byte_length").alias("byte_length"), F.col("fingerprint.sha256").alias("sha256"))
    return files.join(v, ["byte_length", "sha256"])


