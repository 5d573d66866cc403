"""Tunables of the engine; defaults are fixed values that results depend on."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Camera:
    sensor_w_mm: float = 6.3
    sensor_h_mm: float = 4.7
    focal_mm: float = 4.5


@dataclass(frozen=True)
class Settings:
    camera: Camera = Camera()
    # tiles
    tile_px: int = 640
    overlap_px: int = 64
    # detection
    min_bbox_px: int = 8
    nms_overlap: float = 0.50
    tile_cap: int = 8
    mask_containment: float = 0.15
    min_reply_confidence: float = 0.10
    # merging and tracking
    merge_m: float = 3.0
    max_angles: int = 3
    gate_base_m: float = 5.0
    gate_cold_ms: float = 30.0
    gate_speed_factor: float = 1.5
    velocity_alpha: float = 0.6
    moving_ms: float = 1.0
    # novelty
    cell_m: float = 3.0
    min_novelty: float = 0.10
    threshold_low: float = 0.50
    threshold_high: float = 0.95
    novelty_alpha: float = 0.4
    initial_threshold: float = 0.60
    max_cells_per_axis: int = 200
    # motion
    persist: int = 16
    orphan_frames: int = 6
    match_m: float = 6.0
    scene_speed: float = 15.0
    scene_step: float = 5.0
    scene_extra: int = 10
    wf_min_frames: int = 8
    wf_retest: int = 15
    wf_scan: int = 60
    wf_fine: int = 21
    wf_threshold_m: float = 0.5
    aspect_limit: float = 8.0
    min_area_px: float = 4.0
    # scoring
    margin: float = 0.03
    top_segments: int = 5
    search_limit: int = 20
    search_frames: int = 8
    # sampling
    sample_interval_s: float = 2.0
    sample_overlap: float = 0.60
    min_interval_s: float = 0.5
    max_interval_s: float = 10.0


#: Fixed values.
EARTH_RADIUS_M = 6_371_000.0
M_PER_DEG = 111_320.0
DIFFICULTY_THRESHOLD = {"easy": 0.30, "medium": 0.20, "hard": 0.03}
DEFAULT = Settings()

#: What a recording generator assumes where its settings say nothing.
GENERATOR = {"fps": 10, "alt_m": 80.0, "pattern": "lanes", "overlap": 0.6, "out_w": 640, "out_h": 480, "seed": 0, "targets": []}


def load_generator(path: str, defaults: dict = GENERATOR) -> dict:
    """Generator settings from a JSON or (where a reader is installed) YAML file on the driver, over the defaults; unknown keys are an error."""
    import json

    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith((".yml", ".yaml")):
        try:
            import yaml
        except ImportError as e:
            raise ValueError("no YAML reader is installed; use JSON") from e
        given = yaml.safe_load(text) or {}
    else:
        given = json.loads(text or "{}")
    if unknown := set(given) - set(defaults):
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return defaults | given
