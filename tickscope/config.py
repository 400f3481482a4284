"""Settings of the analysis: detection thresholds and physical layout."""

from dataclasses import dataclass


@dataclass(frozen=True)
class AnalysisConfig:
    """Immutable; the values become literals of the plan."""

    # layout: a block never holds more than this many rows of one player
    tick_block: int = 65536
    row_block: int = 4096

    # aim
    snap_threshold: float = 18.0
    jerk_threshold: float = 45.0
    shot_before: int = 5
    shot_after: int = 10
    micro_adjust_threshold: float = 0.05
    aim_min_rows: int = 20
    shot_rows_min: int = 10
    fov_snap_speed: float = 5.0
    fov_still_speed: float = 0.3
    acquisition_speed: float = 3.0
    fit_min_range: float = 2.0

    # jumps
    perfect_ground_ticks: int = 1
    script_ratio: float = 0.55
    script_min_jumps: int = 12
    chain_flag: int = 4
    chain_event: int = 4
    bhop_min_rows_replay: int = 50
    bhop_min_jumps_replay: int = 3
    bhop_min_rows_tabular: int = 5
    bhop_min_jumps_tabular: int = 2
    strafe_min_air_rows: int = 20
    strafe_min_pairs: int = 10
    default_ground_variance: float = 50.0

    # occlusion
    strict_angle: float = 2.5
    wide_angle: float = 5.0
    range_min: float = 200.0
    crowd: int = 64  # rows of a tick beyond which positions are matched by grid cell; layout only
    range_max: float = 2000.0
    preaim_range: float = 1000.0
    preaim_angle: float = 10.0
    turn_angle: float = 15.0
    turn_window: int = 10
    turn_min_rows: int = 20
    motion_yaw: float = 0.1
    motion_pos: float = 1.0
    occlusion_min_rows_replay: int = 50
    esp_strict_ratio: float = 0.12
    esp_strict_run: int = 80
    esp_run: int = 180
    lock_event_ratio: float = 0.5
    lock_event_run: int = 20

    # spin
    spin_min_rows: int = 32
    spin_window: int = 16
    spin_speed: float = 90.0
    pitch_limit: float = 89.5
    jitter_window: int = 8
    jitter_variance: float = 2000.0
    desync_angle: float = 140.0
    desync_run: int = 6

    # trigger
    head_radius: float = 16.0
    eye_height: float = 64.0
    lookback: int = 64
    reaction_median_ms: float = 50.0
    reaction_std_ms: float = 15.0
    burst_ms: float = 30.0
    burst_len: int = 3
    trigger_min_shots: int = 3
    tickrate: float = 64.0

    # verdict
    threshold_high: float = 0.80
    threshold_suspect: float = 0.60
    factors_cheater: int = 2
    factors_suspect: int = 1

    # model
    n_trees: int = 200
    max_depth: int = 6
    min_leaf: int = 2
    seed: int = 42
    contamination: float = 0.04
    iforest_trees: int = 100
    iforest_sample: int = 256

    # results store
    engine_version: str = "2.5.2"
    feature_schema_version: str = "1.0"
    keep_results: int = 500
    max_failure_rate: float = 0.30


DEFAULT = AnalysisConfig()
