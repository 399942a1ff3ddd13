"""All tunable numbers in one frozen object; its values enter plans as literals."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # Search range per resolution tier (lowest, highest level).
    uhd_range: tuple[int, int] = (25, 55)
    fhd_range: tuple[int, int] = (28, 58)
    hd_range: tuple[int, int] = (32, 62)
    sd_range: tuple[int, int] = (38, 63)

    # Sampling plan of the quality search.
    sample_count: int = 16
    window_seconds: int = 12
    seed: int = 12345

    # Quality gates and the width of the marginal band.
    target_mean: float = 97.0
    target_p05: float = 95.0
    target_p01: float = 90.0
    marginal_band: float = 0.5

    # Score models by resolution.
    standard_model: str = "vmaf_v0.6.1"
    uhd_model: str = "vmaf_4k_v0.6.1"

    # Pool capacities used by the utilisation reports.
    cpu_total: int = 20
    nvenc_total: int = 4
    nvdec_total: int = 4
    cuda_total: int = 4

    # Catalog prefilter, chapter split and event thinning.
    min_file_bytes: int = 10240
    min_duration_s: float = 1.0
    main_chapter_s: float = 360.0
    extra_chapters: int = 2
    long_hold_ms: int = 30000
    checkpoint_ms: int = 300000

    # Physical layout only, never results: how long a run of one key's ordered
    # rows may get before it is cut into slices that are worked on separately.
    frame_slice: int = 1 << 20
    chapter_slice: int = 1 << 16
    tick_slice_ms: int = 3_600_000
    stage_slice: int = 1 << 20

    @property
    def targets(self) -> tuple[tuple[str, float], ...]:
        return (("mean", self.target_mean), ("p05", self.target_p05), ("p01", self.target_p01))

    @property
    def tiers(self) -> tuple[tuple[str, int, int, int, int], ...]:
        """(tier, min width, min height, lowest level, highest level), first match wins."""
        return (
            ("UHD", 3840, 2160, *self.uhd_range),
            ("1080p", 1920, 1080, *self.fhd_range),
            ("720p", 1280, 720, *self.hd_range),
            ("SD", 0, 0, *self.sd_range),
        )


DEFAULTS = Settings()
