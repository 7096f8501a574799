"""Settings of one experiment."""

from dataclasses import dataclass


@dataclass(frozen=True)
class ExperimentConfig:
    zoom_factor: int = 2
    well_spacer_size: int = 500
    vertical_site_displacement: int = 0
    horizontal_site_displacement: int = 0
    tile_size: int = 256

    @property
    def plate_spacer_size(self) -> int:
        return 2 * self.well_spacer_size
