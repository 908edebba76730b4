"""Constants of the engine, in one place."""

# Thresholds that results depend on.
ANALYSIS_VERSION, MATCHER_VERSION = 6, 1
EARTH_RADIUS_M = 6_371_008.8
EFFORT_DISTANCES_M = (1_000, 5_000, 10_000, 20_000, 40_000)
MAX_PLAUSIBLE_MPS = 80 / 3.6
GPS_WARMUP_MS = 60_000
SENSOR_COVERAGE = 0.9
MAX_SENSOR_GAP_MS = 30_000
MIN_POINTS, MIN_DISTANCE_M, MIN_MOVING_S = 10, 200, 60
MOVING_MPS = 2 / 3.6
STOP_MINIMUM_MS = 30_000
GRADE_WINDOW_M, GRADE_LIMIT = 100.0, 40.0
ELEVATION_FLOOR_M = 3.0
CLIMB_GRADE, CLIMB_LENGTH_M, CLIMB_GAIN_M = 2.0, 300.0, 20.0
PEAK_AGREEMENT, MAX_HDOP = 0.8, 10.0
HR_RANGE, CADENCE_RANGE, SPEED_RANGE_MPS, ODOMETER_LIMIT_M = (30.0, 240.0), (0.0, 250.0), (0.0, 150 / 3.6), 10_000_000.0
HR_JUMP_BPM, HR_JUMP_MS, GAP_MS = 30.0, 10_000, 30_000
LOCK_BPM, LOCK_EDGE_BPM, LOCK_MS, LOCK_BREAK_MS = 3.0, 8.0, 60_000, 3_000
HR_DURATIONS_S = (60, 300, 600, 1_200)
HR_WARMUP_MS, HR_SETTLE_MS, SECTORS = 300_000, 60_000, 64
DRIFT_MS, DRIFT_CV, DRIFT_FLAT_SHARE, DRIFT_GRADE = 1_800_000, 0.15, 0.9, 2.0
DEVELOPMENT_BIN_M, DEVELOPMENT_RPM, DEVELOPMENT_MPS, DEVELOPMENT_RANGE_M = 0.25, 30.0, 2.0, (1.0, 12.0)
TERRAIN = (("descent", "Descent", None, -2.0), ("flat", "Flat", -2.0, 2.0), ("rolling", "Rolling", 2.0, 5.0), ("climb", "Climb", 5.0, None))
ROUTE_MIN_M, ROUTE_MIN_QUALITY, ROUTE_SAMPLES = 500.0, 70.0, 64
MATCH_RATIO, MATCH_ENDPOINT_M, MATCH_MEDIAN_M, MATCH_P90_M, LOOP_SCORE = 0.90, 250.0, 120.0, 250.0, 0.95
MATCH_WEIGHTS = (0.40, 0.35, 0.25)
TREND_FLOOR, MAD_SCALE = 0.02, 1.4826
RENDERING_SIZES = {"overview": 600, "detail": 2_500}
ROLLING_ROWS, LEADERS, DELTA_ROWS = 15, 10, 15
LIST_LIMIT, COMPARE_LIMIT, HEATMAP_LIMIT = 500, 4, 8_000
PROCESSING_STATUSES = ("queued", "parsing", "cleaning", "analyzing", "indexing")
MAX_RECORDING_POINTS, MAX_FIT_BYTES, MAX_FILE_BYTES = 500_000, 64 << 20, 256 << 20
MAX_MANIFEST_BYTES, MAX_ARCHIVE_ITEMS, MAX_EXPANDED_BYTES = 20 << 20, 2_000, 5 << 30


def heart_rate_edges(mode: str, maximum: int | None = None, edges: list[int] | None = None) -> list[int] | None:
    """The five lower zone edges of a profile; None for mode ``none``.  An invalid profile raises ValueError."""
    if mode == "none":
        return None
    if mode == "maximum":
        if not isinstance(maximum, int) or not 100 <= maximum <= 240:
            raise ValueError("the maximum heart rate must be a whole number from 100 to 240")
        return [30, *(int(maximum * share / 10 + 0.5) for share in (6, 7, 8, 9))]
    if mode == "custom":
        own = list(edges or [])
        if len(own) != 5 or own[0] != 30 or any(not isinstance(e, int) or not 30 <= e <= 239 for e in own) or any(a >= b for a, b in zip(own, own[1:], strict=False)):
            raise ValueError("custom edges are five rising whole numbers from 30 to 239, the first 30")
        return own
    raise ValueError(f"unknown profile mode {mode!r}")
