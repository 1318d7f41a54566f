"""Section 2.12's roles: pluggable functions with deterministic defaults, and the column or grouped form each takes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timelens.functions.image import color_embedding, color_key, nearest_color
from timelens.functions.text import overlap_score, query_tokens, verdict
from timelens.functions.vector import hash_embedding
from timelens.operators import intervals, tracks
from timelens.sources import media, sidecars

def scalar_model(load: Callable[[], Callable[[pd.Series], pd.Series]], kind: str) -> Callable[[Column], Column]:
    """A slot for a model over one column: loaded once in each Python worker, called by Arrow batches."""

    @F.pandas_udf(kind)
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            yield model(batch)

    return apply


ROLES: dict[str, Callable] = {
    "scene_detector": intervals.scene_cuts,
    "text_embedder": hash_embedding,
    "visual_embedder": lambda text: color_embedding(color_key(text)),
    "vlm_captioner": lambda r, g, b: F.concat(F.lit("a mostly "), nearest_color(r, g, b), F.lit(" frame")),
    "object_detector": media.synthetic_boxes,
    "object_tracker": tracks.track,
    "action_recognizer": intervals.motion_level,
    "speech_to_text": lambda spark, path: sidecars.read_sidecars(spark, path, "transcript"),
    "speaker_diarizer": lambda spark, path: sidecars.read_sidecars(spark, path, "diarization"),
    "ocr": lambda spark, path: sidecars.read_sidecars(spark, path, "ocr"),
    "motion_source": lambda spark, path: sidecars.read_sidecars(spark, path, "motion"),
    "reranker": lambda text, query: overlap_score(text, query_tokens(query)),
    "vlm_verifier": lambda items: items.withColumn("accepted", F.coalesce(verdict(F.col("answer")) != "no", F.lit(True)) if "answer" in items.columns else F.lit(True)),
}


def backend(role: str, override: Callable | None = None) -> Callable:
    if role not in ROLES:
        raise KeyError(f"no role {role!r}")
    return override or ROLES[role]


def speaker_hints(turns: DataFrame, num: int | None = None, least: int | None = None, most: int | None = None, config: dict | None = None) -> tuple[dict, DataFrame]:
    """hints of a call before those of the configuration, an exact number before bounds; turns in order."""
    config = config or {}
    num = num if num is not None else (None if least is not None or most is not None else config.get("num_speakers"))
    if num is not None:
        return {"num_speakers": num}, turns.orderBy("start_time")
    hints = {"min_speakers": least if least is not None else config.get("min_speakers"), "max_speakers": most if most is not None else config.get("max_speakers")}
    return {k: v for k, v in hints.items() if v is not None}, turns.orderBy("start_time")
