"""Extraction settings, their files, names and grid."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

from onsetframe.functions.periods import UNITS, parse_frequency
from onsetframe.plans.codelists import DISEASES, PREDICTION_WINDOWS
from onsetframe.session import join_path


@dataclass(frozen=True)
class CohortConfig:
    """Settings of one labelled extraction."""

    selected_analyses_ids: list | None = None
    positive_diagnoses: list[str] = field(default_factory=list)
    lab_records_frequency: str = "h"
    backward_window_time_unit: str = "month"
    backward_window_value: int = 1
    gap_days: int = 31
    prediction_window_days: int = 31

    def __post_init__(self):
        parse_frequency(self.lab_records_frequency)
        if self.backward_window_time_unit not in UNITS:
            raise ValueError(f"backward_window_time_unit must be one of {UNITS}")
        if self.backward_window_value < 1 or self.gap_days < 0 or self.prediction_window_days < 0:
            raise ValueError("the window needs a positive length, gap and prediction window none below 0")

    @classmethod
    def from_json(cls, path: str) -> CohortConfig:
        raw = json.loads(Path(path).read_text())
        unknown = set(raw) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings {sorted(unknown)}")
        return cls(**raw)

    def to_json(self, path: str) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=4))

    def key(self, *names: str) -> str:
        """Digest of the named settings (all if none), the folder of a written stage."""
        chosen = {k: v for k, v in asdict(self).items() if not names or k in names}
        return hashlib.md5(json.dumps(chosen, sort_keys=True).encode()).hexdigest()[:16]


# Settings each stage depends on.
RECORD_SETTINGS = ("selected_analyses_ids", "lab_records_frequency")
PERIOD_SETTINGS = (*RECORD_SETTINGS, "backward_window_time_unit")
WINDOW_SETTINGS = (*PERIOD_SETTINGS, "backward_window_value")


@dataclass(frozen=True)
class StagePaths:
    """Output tables of one extraction; None where the result is not written."""

    lab_records: str | None = None
    filtered_analyses: str | None = None
    filtered_lab_records: str | None = None
    rolling_lab_records: str | None = None
    labeled_lab_records: str | None = None
    rolling_ecg_records: str | None = None
    demographics_records: str | None = None

    @classmethod
    def from_json(cls, path: str) -> StagePaths:
        return cls(**json.loads(Path(path).read_text()))

    def to_json(self, path: str) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=4))

    @classmethod
    def derived(cls, root: str, disease: str, category: str, spell: str) -> StagePaths:
        """Table names of a grid cell: records per category, windows per spell, labels per disease."""
        lab = join_path(root, "lab", category)
        return cls(
            lab_records=join_path(lab, "common", f"lab_records_{category}"),
            filtered_analyses=join_path(lab, "common", f"filtered_analyses_{category}"),
            filtered_lab_records=join_path(lab, "common", f"filtered_lab_records_{category}"),
            rolling_lab_records=join_path(lab, spell, f"rolling_lab_records_{category}_{spell}"),
            labeled_lab_records=join_path(root, "labels", disease, spell, f"labeled_lab_records_{disease}_{spell}"),
            # the dates differ between diseases, so the second sources are kept per disease
            rolling_ecg_records=join_path(root, "ecg", disease, spell, f"rolling_ecg_records_{disease}_{spell}"),
            demographics_records=join_path(
                root, "demographics", disease, spell, f"demographics_records_{disease}_{spell}"
            ),
        )


def spell(backward: str, gap: str, prediction: str) -> str:
    return f"B{backward}_G{gap}_P{prediction}"


def extraction_name(condition: str, backward: str, gap: str, prediction: str) -> str:
    """``<condition>_B<..>_G<..>_P<..>``"""
    return f"{condition}_{spell(backward, gap, prediction)}"


@dataclass(frozen=True)
class GridCell:
    disease: str
    category: str
    prediction: str
    config: CohortConfig

    @property
    def spell(self) -> str:
        c = self.config
        return spell(f"{c.backward_window_value}{c.backward_window_time_unit[0]}", self.gap, self.prediction)

    @property
    def gap(self) -> str:
        days = self.config.gap_days
        return f"{days // 30}m" if days and days % 30 == 0 else f"{days}d"

    @property
    def name(self) -> str:
        return f"{self.disease}_{self.spell}"


def config_grid(
    categories: dict[str, list],
    diseases: dict[str, list[str]] | None = None,
    prediction_windows: dict[str, int] | None = None,
    backward_months: int = 24,
    gap_days: int = 90,
) -> list[GridCell]:
    """Every category x disease x prediction window."""
    return [
        GridCell(
            disease,
            category,
            symbol,
            CohortConfig(list(ids), list(codes), "h", "month", backward_months, gap_days, days),
        )
        for disease, codes in (DISEASES if diseases is None else diseases).items()
        for symbol, days in (PREDICTION_WINDOWS if prediction_windows is None else prediction_windows).items()
        for category, ids in categories.items()
    ]


def write_grid(cells: list[GridCell], folder: str, data_root: str) -> None:
    """Settings and paths files of a grid, one folder per cell."""
    for cell in cells:
        directory = Path(folder) / cell.disease / cell.name / cell.category
        directory.mkdir(parents=True, exist_ok=True)
        stem = f"{cell.name}_{cell.category}"
        cell.config.to_json(str(directory / f"{stem}_config.json"))
        paths = StagePaths.derived(data_root, cell.disease, cell.category, cell.spell)
        paths.to_json(str(directory / f"{stem}_paths.json"))


def find_configs(folder: str, first: str | None = None) -> list[tuple[str, str]]:
    """Pairs of settings and paths files, sorted by category (their folder), ``first`` before others."""
    pairs = []
    for config in sorted(Path(folder).rglob("*_config.json")):
        paths = sorted(config.parent.glob("*_paths.json"))
        if paths:
            pairs.append((str(config), str(paths[-1])))
    return sorted(pairs, key=lambda p: (Path(p[0]).parent.name != first, Path(p[0]).parent.name))
