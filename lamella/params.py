"""Check catalogue, parameters and thresholds as data.

Fixed values: names, defaults, thresholds and failure types must equal the published check specification for scores to match."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEVERITIES = ("none", "low", "medium", "high", "critical")
LOW, MEDIUM, HIGH, CRITICAL = 1, 2, 3, 4
DEFAULT_THRESHOLDS = {"low": 0.75, "medium": 0.6, "high": 0.4, "critical": 0.2}

# name: (failure type, level, stage, thresholds that differ from the default, parameters)
CHECKS = {
    "missing_slice": ("missing", "slice", "slice_qc", {}, {}),
    "corrupt_slice": ("corrupt", "slice", "slice_qc", {}, {}),
    "blank_slice": ("blank", "slice", "slice_qc", {}, {"std_ref": 0.02, "mode_frac_start": 0.8}),
    "severe_blur": ("blur", "slice", "slice_qc", {"low": 0.75, "medium": 0.55, "high": 0.35, "critical": 0.2},
                    {"min_reference": 1e-6, "absolute_floor": 0.02}),
    "saturation": ("saturation", "slice", "slice_qc", {}, {"frac_ref": 0.20, "thumb_low": 0.005, "thumb_high": 0.995}),
    "crack": ("crack", "slice", "slice_qc", {"low": 0.9, "medium": 0.7, "high": 0.5, "critical": 0.2},
              {"area_ref": 0.02, "area_full": 0.60, "min_frac": 0.002, "elongation_crack": 3.0, "no_coverage_min_frac": 0.15, "no_coverage_max_elong": 6.0}),
    "brightness_jump": ("brightness_jump", "slice", "slice_qc", {}, {"jump_ref": 0.2}),
    "contrast_drift": ("contrast_drift", "slice", "slice_qc", {},
                       {"log2_ref": 1.0, "trend_ref_per_100z": 0.5, "min_slices_for_trend": 8, "min_trend_r2": 0.5}),
    "charging_artifact": ("charging", "slice", "slice_qc", {},
                          {"band_ref": 0.10, "anisotropy_ref": 0.20, "ramp_ref": 0.15, "min_px": 64, "n_bins": 12, "baseline_frac": 0.12,
                           "k_mad": 3.0, "min_spread_band": 0.01, "min_spread_aniso": 0.02, "min_spread_ramp": 0.02}),
    "contamination": ("contamination", "slice", "slice_qc", {},
                      {"area_ref": 0.02, "min_frac": 0.0008, "sigma_k": 3.5, "open_iter": 2, "min_px": 64, "max_blob_frac": 0.25,
                       "flat_quantile": 0.15, "min_blob_px": 12}),
    "slice_jump": ("slice_jump", "serial", "serial_qc", {"low": 0.6, "medium": 0.45, "high": 0.3, "critical": 0.15}, {"min_median_ncc": 0.15}),
    "local_misalignment": ("local_misalign", "serial", "serial_qc", {},
                           {"grid": 4, "min_tile_px": 32, "max_residual_nm": 150.0, "max_residual_frac": 0.03, "min_tile_std": 1e-4,
                            "min_peak": 0.02, "gate_frac": 0.25, "tolerance_thumb_px": 1.0, "max_gap": 2, "min_grid": 2}),
    "global_misalignment": ("global_misalign", "serial", "serial_qc", {},
                            {"max_shift_nm": 200.0, "max_shift_frac": 0.05, "gate_frac": 0.5, "max_gap": 3}),
    "z_order_error": ("z_order", "serial", "serial_qc", {},
                      {"duplicate_ncc": 0.985, "margin": 0.03, "swap_ref": 0.10, "odd_ref": 0.15, "match_frac": 0.8}),
    "local_deformation": ("local_deformation", "serial", "serial_qc", {"low": 0.93, "medium": 0.88, "high": 0.78, "critical": 0.60},
                          {"grid": 4, "min_tile_px": 16, "min_tile_std": 1e-4, "min_peak": 0.02, "tolerance_thumb_px": 0.5,
                           "max_residual_nm": 120.0, "max_residual_frac": 0.02, "gate_frac": 0.2, "max_gap": 2, "min_tiles": 6, "min_grid": 3}),
    "section_deformation": ("section_deformation", "serial", "serial_qc", {"low": 0.70, "medium": 0.55, "high": 0.40, "critical": 0.20},
                            {"grid": 4, "min_tile_px": 16, "min_tile_std": 1e-4, "min_peak": 0.02, "tolerance_thumb_px": 0.5, "strain_ref": 0.03,
                             "k_mad": 3.0, "min_spread": 0.004, "gate_frac": 0.2, "max_gap": 2, "min_tiles": 6, "min_grid": 3}),
}
# checks whose high findings make a section unusable as a reference
REFERENCE_BLOCKERS = ("missing_slice", "corrupt_slice", "blank_slice", "severe_blur", "saturation", "crack")
CONFIG_KEYS = ("thresholds", "params", "thumb_px", "serial_target_nm", "serial_max_px", "serial_min_px", "max_stat_pixels",
               "checks_enabled", "tile_xy", "pass_max_severity", "finding_min_severity")


class Config:
    """Run configuration: per-check overrides on top of the defaults; unknown keys are ignored."""

    def __init__(self, overrides: dict | None = None):
        o = {k: v for k, v in (overrides or {}).items() if k in CONFIG_KEYS and v is not None}
        self.thresholds = o.get("thresholds", {})
        self.overrides = o.get("params", {})
        self.enabled = o.get("checks_enabled")
        self.pass_max = SEVERITIES.index(o.get("pass_max_severity", "high"))
        self.finding_min = SEVERITIES.index(o.get("finding_min_severity", "low"))

    def checks(self) -> list[str]:
        return [c for c in CHECKS if self.enabled is None or c in self.enabled]

    def params(self, check: str) -> dict:
        return {**CHECKS[check][4], **self.overrides.get(check, {})}

    def threshold(self, check: str) -> dict:
        return {**DEFAULT_THRESHOLDS, **CHECKS[check][3], **self.thresholds.get(check, {})}

    def severity(self, check: str, score: Column) -> Column:
        """Severity rank 0..4 of a score; a NULL score is none."""
        t = self.threshold(check)
        return (
            F.when(score < t["critical"], F.lit(4)).when(score < t["high"], F.lit(3)).when(score < t["medium"], F.lit(2))
            .when(score < t["low"], F.lit(1)).otherwise(F.lit(0))
        )


def threshold_table(spark: SparkSession, config: Config | None = None) -> DataFrame:
    """One row per enabled check: bounded by the catalogue, so it is safe to broadcast."""
    config = config or Config()
    rows = []
    for i, c in enumerate(config.checks()):
        ftype, level, stage, _, _ = CHECKS[c]
        t = config.threshold(c)
        rows.append((c, i, ftype, level, stage, t["low"], t["medium"], t["high"], t["critical"]))
    return spark.createDataFrame(
        rows, "check string, check_order int, failure_type string, level string, stage string, t_low double, t_medium double, t_high double, t_critical double")


def severity_label(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), rank + 1)


def clip01(x: Column) -> Column:
    """Clip to [0, 1]; NULL stays NULL (`greatest` alone would turn it into 0)."""
    return F.when(x.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))
