"""Settings of a scan: defaults, TOML files, checks."""

from __future__ import annotations

import dataclasses
import logging
import tomllib
from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import Any

log = logging.getLogger(__name__)

#: The settings file, and the table of pyproject.toml, that are read.
FILE_NAME, TABLE = "dupeloom.toml", "dupeloom"

#: Paths of tests by the usual conventions. Fixed values.
TEST_PATTERNS = ("**/test_*.py", "**/*_test.py", "**/conftest.py", "tests/**/*.py", "**/tests/**/*.py")


class ConfigError(ValueError):
    """A setting that contradicts another or is out of range."""


@dataclass(frozen=True)
class ScanConfig:
    threshold: float = 0.85
    min_lines: int | None = None
    exact_min_lines: int | None = None
    similar_min_lines: int | None = None
    exact_min_stmts: int = 3
    include: tuple[str, ...] = ("**/*.py",)
    exclude: tuple[str, ...] = ("tests/**", "**/conftest.py", "migrations/**")

    @property
    def exact_floor(self) -> int:
        return next(x for x in (self.exact_min_lines, self.min_lines, 5) if x is not None)

    @property
    def similar_floor(self) -> int:
        return next(x for x in (self.similar_min_lines, self.min_lines, 9) if x is not None)

    @property
    def extraction_floor(self) -> int:
        """What is shorter can pass neither tier."""
        return min(self.exact_floor, self.similar_floor)

    def scoped_to_tests(self) -> ScanConfig:
        return dataclasses.replace(self, include=TEST_PATTERNS, exclude=())


@dataclass(frozen=True)
class NormalizationConfig:
    anonymize_locals: bool = True
    anonymize_literals: bool = False
    strip_decorators: bool = True
    strip_type_annotations: bool = True
    sort_commutative: bool = False


@dataclass(frozen=True)
class OutputConfig:
    format: str = "text"
    group_overlapping: bool = True
    max_results: int = 50
    show_source: bool = True
    context_lines: int = 3


@dataclass(frozen=True)
class SuggestConfig:
    enabled: bool = False
    min_quality: float = 0.6
    max_holes: int = 5
    render_python: bool = True


@dataclass(frozen=True)
class SuppressConfig:
    files: tuple[str, ...] = ()
    #: The comment that suppresses is "# <directive>: ignore", or "ignore-file".
    directive: str = "dupeloom"


@dataclass(frozen=True)
class ContainmentConfig:
    enabled: bool = False
    min_fragment_lines: int | None = None
    exact_min_fragment_lines: int | None = None
    similar_min_fragment_lines: int | None = None
    min_ratio: float = 0.30
    threshold: float = 0.85
    size_balance: float = 1.25
    max_run_fraction: float = 0.85
    max_probes_per_function: int = 12

    @property
    def exact_floor(self) -> int:
        return next(x for x in (self.exact_min_fragment_lines, self.min_fragment_lines, 10) if x is not None)

    @property
    def similar_floor(self) -> int:
        return next(x for x in (self.similar_min_fragment_lines, self.min_fragment_lines, 15) if x is not None)

    @property
    def candidate_floor(self) -> int:
        return min(self.exact_floor, self.similar_floor)

    @property
    def balance_floor(self) -> float:
        """Zero switches the guard off."""
        return 1.0 / self.size_balance if self.size_balance > 0 else 0.0


@dataclass(frozen=True)
class Config:
    scan: ScanConfig = field(default_factory=ScanConfig)
    normalization: NormalizationConfig = field(default_factory=NormalizationConfig)
    output: OutputConfig = field(default_factory=OutputConfig)
    suggest: SuggestConfig = field(default_factory=SuggestConfig)
    suppress: SuppressConfig = field(default_factory=SuppressConfig)
    containment: ContainmentConfig = field(default_factory=ContainmentConfig)

    def with_settings(self, section: str, **settings: Any) -> Config:
        return dataclasses.replace(self, **{section: dataclasses.replace(getattr(self, section), **settings)})

    def validate(self) -> Config:
        """Itself, or a ConfigError."""
        for name, part, unit in (("scan", self.scan, "lines"), ("containment", self.containment, "fragment lines")):
            if part.exact_floor > part.similar_floor:
                raise ConfigError(f"{name}: the exact tier may not ask for more {unit} ({part.exact_floor}) than the similar tier ({part.similar_floor})")
            if part.exact_floor < 1:
                raise ConfigError(f"{name}: at least 1 of {unit} is needed, not {part.exact_floor}")
        if self.scan.exact_min_stmts < 1:
            raise ConfigError(f"scan: exact_min_stmts must be at least 1, not {self.scan.exact_min_stmts}")
        return self

    def check(self) -> Config:
        """validate(), with a warning where a tier's own floor hides the common one."""
        for name, common, own in (("scan", "min_lines", ("exact_min_lines", "similar_min_lines")), ("containment", "min_fragment_lines", ("exact_min_fragment_lines", "similar_min_fragment_lines"))):
            part = getattr(self, name)
            if getattr(part, common) is not None:
                for key in own:
                    if getattr(part, key) is not None:
                        log.warning("%s.%s is set, so %s.%s does not apply to it", name, key, name, common)
        return self.validate()


def from_mapping(settings: dict[str, Any], kind: type = Config) -> Any:
    """A dataclass from nested mappings; missing keys take defaults, unknown ones are ignored."""
    out = {}
    for f in fields(kind):
        if f.name in settings:
            value = settings[f.name]
            made = f.default_factory() if f.default_factory is not dataclasses.MISSING else None
            out[f.name] = from_mapping(value, type(made)) if is_dataclass(made) else tuple(value) if isinstance(value, list) else value
    return kind(**out)


def load_config(folder: str | Path) -> Config:
    """Settings of a folder: its own file, else pyproject.toml's table, else defaults; checked."""
    folder = Path(folder)
    if (own := folder / FILE_NAME).exists():
        settings = tomllib.loads(own.read_text(encoding="utf-8"))
    elif (project := folder / "pyproject.toml").exists():
        settings = tomllib.loads(project.read_text(encoding="utf-8")).get("tool", {}).get(TABLE, {})
    else:
        settings = {}
    return from_mapping(settings).validate()
