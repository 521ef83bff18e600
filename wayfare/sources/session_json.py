"""Session and maze-map documents: reading with reasons instead of exceptions, migrating, writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SESSION_VERSION = 2
MAP_VERSION = 1
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"

POINT = "struct<x:double,y:double,confidence:double,valid:boolean,source:string>"
FRAME = (
    f"struct<frameIndex:int,t_s:double,centroid:{POINT},nose:{POINT},detectionState:string,reason:string,"
    "blobArea_px2:double,boundingBox:struct<x:double,y:double,width:double,height:double>,noseHeadingConfidence:double>"
)
ENTRY = (
    "struct<kind:string,id:string,timestamp:string,reviewer:string,frameIndex:int,point:string,"
    "value:struct<x:double,y:double,confidence:double,valid:boolean>,rangeType:string,startFrame:int,endFrame:int,"
    "action:string,eventId:string,newKind:string,holeIndex:int,confirmed:boolean,strategy:string,reason:string>"
)
VIDEO = (
    "struct<id:string,filename:string,fingerprint:struct<byteLength:bigint,durationSeconds:double,frameCount:bigint,sha256:string>,"
    "referenceResolution:struct<width:int,height:int>,"
    "mazeTransform:struct<translateX:double,translateY:double,rotationDeg:double,scale:double>,"
    "metadata:struct<animal:string,day:string,trial:string,group:string>,trialType:string,targetHole:int>"
)
SESSION = (
    f"schemaVersion double, toolVersion string, sessionId string, name string, reviewer string, videos array<{VIDEO}>, "
    "mazeMap string, parameters string, analyses map<string,struct<"
    f"auto:struct<parametersHash:string,frames:array<{FRAME}>>,corrections:struct<entries:array<{ENTRY}>>>>, _bad string"
)
MAP = (
    "schemaVersion double, referenceResolution struct<width:double,height:double>, platform struct<cx:double,cy:double,r:double>, "
    "holes struct<n:double,ringRatio:double,holeRadius_px:double,phase_deg:double,"
    "offsets:array<struct<holeIndex:int,dx_px:double,dy_px:double>>>, target struct<holeIndex:double>, "
    "calibration struct<platformDiameter_cm:double>, videos string, analyses string, _bad string"
)
OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}


def first_problem(*checks: tuple[Column, Column | str]) -> Column:
    """The message of the first check that holds; null when none does."""
    return F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(m) if isinstance(m, str) else m) for bad, m in checks])


def read_sessions(texts: DataFrame) -> DataFrame:
    """Parse documents (column ``value``); ``problem`` is null for the usable ones. Other columns are kept.

    Version 1 documents are migrated: acquisition trials without own target or reviewer, a fresh id.
    """
    kept = [c for c in texts.columns if c != "value"]
    d = texts.select(*kept, "value", F.from_json("value", SESSION, OPTIONS).alias("d"))
    d = d.withColumn("d", F.coalesce("d", F.lit(None)))
    c = lambda n: F.col(f"d.{n}")
    v = c("schemaVersion")
    two = v >= 2
    has = lambda key: F.get_json_object("value", f"$.{key}").isNotNull()
    n_holes = F.get_json_object(c("mazeMap"), "$.holes.n").cast("int")
    videos = c("videos")

    def any_video(test) -> Column:
        return F.exists(videos, lambda x: F.coalesce(test(x), F.lit(False)))

    entries = F.map_values(c("analyses"))
    problem = first_problem(
        (c("_bad").isNotNull() | F.col("d").isNull() | ~F.trim("value").startswith("{"), "not valid JSON"),
        (has("platform") & has("holes"), "a maze map, not a session"),
        (has("parts"), "the header of a session in parts"),
        (v.isNull(), "no schema version"),
        (v > SESSION_VERSION, "written by a newer version"),
        (~v.isin(1.0, 2.0), "written by an older version that cannot be read"),
        (c("toolVersion").isNull(), "it records no tool version"),
        (c("name").isNull(), "it has no session name"),
        (two & c("sessionId").isNull(), "it has no session id"),
        (two & ~c("sessionId").rlike(UUID), "its session id is not a UUID"),
        (videos.isNull(), "its video list is missing"),
        (any_video(lambda x: x["id"].isNull() | x["filename"].isNull()), "a video has no id or filename"),
        (any_video(lambda x: x["fingerprint"]["sha256"].isNull()), "a video has no content fingerprint"),
        (two & any_video(lambda x: x["trialType"].isNull() | ~x["trialType"].isin("acquisition", "probe")), "a video has no valid trial type"),
        (two & any_video(lambda x: x["targetHole"] < 0), "a video names a target that is not a hole number"),
        (two & any_video(lambda x: x["targetHole"] >= n_holes), "a video names a target its map does not have"),
        (c("analyses").isNull(), "its analyses section is missing"),
        (F.exists(entries, lambda e: e["auto"]["frames"].isNull()), "an analysis has no tracked frames"),
        (F.exists(entries, lambda e: e["corrections"]["entries"].isNull()), "an analysis has no corrections list"),
    )
    d = d.withColumn("problem", problem)
    legacy = v == 1
    fresh = F.regexp_replace(F.substring(F.sha2("value", 256), 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return d.select(
        *kept,
        "problem",
        F.when(legacy, fresh).otherwise(c("sessionId")).alias("session_id"),
        c("name").alias("name"),
        F.when(~legacy, c("reviewer")).alias("reviewer"),
        c("toolVersion").alias("tool_version"),
        F.lit(SESSION_VERSION).alias("schema_version"),
        legacy.alias("migrated"),
        videos.alias("videos"), c("mazeMap").alias("maze_map"), c("parameters").alias("parameters"), c("analyses").alias("analyses"),
    )


def session_videos(docs: DataFrame) -> DataFrame:
    """The videos of usable documents, with migrated defaults."""
    v = docs.filter("problem is null").select("session_id", "migrated", F.posexplode("videos").alias("video_order", "v"))
    return v.select(
        "session_id", F.col("v.id").alias("video_id"), "video_order", "v.filename", "v.fingerprint", F.col("v.referenceResolution").alias("resolution"),
        F.col("v.metadata.animal").alias("animal"), F.col("v.metadata.day").alias("day"), F.col("v.metadata.trial").alias("trial"),
        F.col("v.metadata.group").alias("group"),
        F.when(F.col("migrated"), "acquisition").otherwise(F.col("v.trialType")).alias("trial_type"),
        F.when(~F.col("migrated"), F.col("v.targetHole")).alias("target_hole"),
    )


def _analyses(docs: DataFrame) -> DataFrame:
    return docs.filter("problem is null").select("session_id", "migrated", F.explode("analyses").alias("video_id", "a"))


def frame_columns() -> list[Column]:
    """The columns of the frame table from a document's frame object ``f``."""
    return [
        F.col("f.frameIndex").alias("frame_index"), F.col("f.t_s").alias("t_s"), F.col("f.centroid").alias("centroid"), F.col("f.nose").alias("nose"),
        F.col("f.detectionState").alias("detection_state"), F.col("f.reason").alias("reason"), F.col("f.blobArea_px2").alias("blob_area_px2"),
        F.col("f.noseHeadingConfidence").alias("nose_heading_confidence"), F.col("f.boundingBox").alias("bounding_box"),
    ]


def entry_columns() -> list[Column]:
    """The columns of the corrections table from a document's entry object ``e``."""
    named = {
        "frameIndex": "frame_index", "rangeType": "range_type", "startFrame": "start_frame", "endFrame": "end_frame", "eventId": "event_id",
        "newKind": "new_kind", "holeIndex": "hole_index", "reason": "reason_text", "value.x": "x", "value.y": "y",
        "value.confidence": "confidence", "value.valid": "valid",
    }
    order = (
        "id", "timestamp", "kind", "reviewer", "frameIndex", "point", "value.x", "value.y", "value.confidence", "value.valid", "rangeType",
        "startFrame", "endFrame", "action", "eventId", "newKind", "holeIndex", "confirmed", "strategy", "reason",
    )
    return [F.col(f"e.{n}").alias(named.get(n, n)) for n in order]


def session_frames(docs: DataFrame) -> DataFrame:
    """The frame table of usable documents."""
    f = _analyses(docs).select("session_id", "video_id", F.posexplode("a.auto.frames").alias("pos", "f"))
    return f.select("session_id", "video_id", "pos", *frame_columns())


def session_corrections(docs: DataFrame) -> DataFrame:
    """The corrections table of usable documents; a migrated entry without a reviewer stays without."""
    e = _analyses(docs).select("session_id", "video_id", F.explode("a.corrections.entries").alias("e"))
    return e.select("session_id", "video_id", *entry_columns())


def auto_layers(docs: DataFrame) -> DataFrame:
    return _analyses(docs).select("session_id", "video_id", F.col("a.auto.parametersHash").alias("tracking_parameters_hash"))


def video_json(videos: DataFrame) -> Column:
    """One video row as the document's video object."""
    del videos
    return F.struct(
        F.col("video_id").alias("id"), "filename",
        F.struct(
            F.col("fingerprint.byte_length").alias("byteLength"), F.col("fingerprint.duration_s").alias("durationSeconds"),
            F.col("fingerprint.frame_count").alias("frameCount"), F.col("fingerprint.sha256").alias("sha256"),
        ).alias("fingerprint"),
        F.col("resolution").alias("referenceResolution"),
        F.struct(
            F.col("transform.translate_x").alias("translateX"), F.col("transform.translate_y").alias("translateY"),
            F.col("transform.rotation_deg").alias("rotationDeg"), F.col("transform.scale").alias("scale"),
        ).alias("mazeTransform"),
        F.struct("animal", "day", "trial", "group").alias("metadata"),
        F.col("trial_type").alias("trialType"), F.col("target_hole").alias("targetHole"),
    )


def frame_json() -> Column:
    """One frame row as the document's frame object."""
    return F.struct(
        F.col("frame_index").alias("frameIndex"), "t_s", "centroid", "nose", F.col("detection_state").alias("detectionState"), "reason",
        F.col("blob_area_px2").alias("blobArea_px2"), F.col("bounding_box").alias("boundingBox"),
        F.col("nose_heading_confidence").alias("noseHeadingConfidence"),
    )


def entry_json() -> Column:
    """One correction row as the document's entry object."""
    return F.struct(
        "kind", "id", "timestamp", "reviewer", F.col("frame_index").alias("frameIndex"), "point", F.struct("x", "y", "confidence", "valid").alias("value"),
        F.col("range_type").alias("rangeType"), F.col("start_frame").alias("startFrame"), F.col("end_frame").alias("endFrame"), "action",
        F.col("event_id").alias("eventId"), F.col("new_kind").alias("newKind"), F.col("hole_index").alias("holeIndex"), "confirmed", "strategy",
        F.col("reason_text").alias("reason"),
    )


def frame_lines(frames: DataFrame) -> DataFrame:
    """Frames as JSON lines, written in parallel beside the session headers."""
    return frames.select("session_id", "video_id", "pos", F.to_json(frame_json(), {"ignoreNullFields": "false"}).alias("value"))


def video_lines(videos: DataFrame) -> DataFrame:
    """Video objects as JSON lines."""
    return videos.select("session_id", "video_id", F.to_json(video_json(videos), {"ignoreNullFields": "false"}).alias("value"))


def session_headers(sessions: DataFrame) -> DataFrame:
    """Session documents without their tracks: what ``session_parts`` writes beside the line files.

    ``sessions`` may have ``maze_map`` and ``parameters`` (JSON text) and ``parts`` (lines of each kind), which readers ask for.
    """
    given = {
        "maze_map": lambda c: F.try_parse_json(c).alias("mazeMap"), "parameters": lambda c: F.try_parse_json(c).alias("parameters"),
        "parts": lambda c: c.alias("parts"),
    }
    return sessions.select(
        "session_id",
        F.to_json(
            F.struct(
                F.lit(SESSION_VERSION).alias("schemaVersion"), F.col("tool_version").alias("toolVersion"), F.col("session_id").alias("sessionId"),
                "name", "reviewer", *[as_json(F.col(n)) for n, as_json in given.items() if n in sessions.columns],
            ),
            {"ignoreNullFields": "false"},
        ).alias("value"),
    )


def read_maps(texts: DataFrame) -> DataFrame:
    """Parse maze-map documents (column ``value``) with the first problem of each."""
    d = texts.select("value", F.from_json("value", MAP, OPTIONS).alias("d"))
    c = lambda n: F.col(f"d.{n}")
    holes, n = c("holes"), c("holes.n")
    target = c("target.holeIndex")
    problem = first_problem(
        (c("_bad").isNotNull() | F.col("d").isNull() | ~F.trim("value").startswith("{"), "not valid JSON"),
        (c("videos").isNotNull() & c("analyses").isNotNull(), "a session, not a maze map"),
        (c("schemaVersion").isNull(), "no schema version"),
        (c("schemaVersion") != MAP_VERSION, "another schema version"),
        (c("referenceResolution.width").isNull() | c("referenceResolution.height").isNull(), "no video size"),
        (c("platform.cx").isNull() | c("platform.cy").isNull(), "its platform has no centre"),
        (c("platform.r").isNull() | (c("platform.r") <= 0), "its platform has no radius"),
        (holes.isNull(), "it has no hole ring"),
        (n.isNull() | (n < 3), "its hole ring has fewer than three holes"),
        (c("holes.ringRatio").isNull() | (c("holes.ringRatio") <= 0), "its hole ring has no radius"),
        (c("holes.holeRadius_px").isNull(), "its holes have no size"),
        (c("holes.phase_deg").isNull(), "its hole ring has no angle"),
        (target.isNull(), "it names no target hole"),
        ((target < 0) | (target >= n), "its target is not one of its holes"),
        (c("calibration.platformDiameter_cm").isNull(), "it has no platform diameter"),
        (c("calibration.platformDiameter_cm") <= 0, "platform diameter must be above zero"),
    )
    return d.select(
        "value", problem.alias("problem"), c("platform").alias("platform"), n.cast("int").alias("n"), c("holes.ringRatio").alias("ring_ratio"),
        c("holes.holeRadius_px").alias("hole_radius_px"), c("holes.phase_deg").alias("phase_deg"),
        F.transform(c("holes.offsets"), lambda o: F.struct(o["holeIndex"].alias("hole_index"), o["dx_px"].alias("dx_px"), o["dy_px"].alias("dy_px"))).alias("offsets"),
        target.cast("int").alias("target_hole"), c("calibration.platformDiameter_cm").alias("platform_diameter_cm"),
    )
