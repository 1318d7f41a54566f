"""Fixed values that results depend on."""

RERANK_WEIGHT = 0.6
EVIDENCE_CAP, RENDER_CAP, KEYFRAME_CAP = 40, 60, 4
CO_OCCURRENCE_GAP, CLUSTER_GAP = 2.0, 30.0
MAX_WINDOW = 120
MAX_BUCKETS = 10_000
MIN_FRAMES = 2
SIMILAR_LABELS = 0.6
TOP_STATES, SHOWN_RUNS = 8, 40
TRACK_IOU, TRACK_GAP = 0.3, 2.5
CUT_DISTANCE, CUT_LEAST_SECONDS = 0.4, 0.6
MIDPOINT_SHOT, LONG_SHOT_STRIDE = 15.0, 4.0
SCAN_FRAMES, SCAN_FPS = 120, 1.0
MIN_SPAN = 0.5
NO_CAMERA = "(no camera)"
