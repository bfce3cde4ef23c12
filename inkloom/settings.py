"""Settings of a run, from a TOML file or from code."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

CONFIG_NAMES = ("inkloom.toml", ".inkloom.toml", "pyproject.toml")


@dataclass(frozen=True)
class Settings:
    select: tuple[str, ...] = ()
    ignore: tuple[str, ...] = ()
    extend_select: tuple[str, ...] = ()
    extend_ignore: tuple[str, ...] = ()
    semantic: bool = True
    model: str | None = None
    max_sentence_words: int = 45
    max_reading_grade: float = 14.0
    thresholds: dict[str, float] = field(default_factory=dict)
    concurrency: int = 8
    min_words: int | None = None
    classify: bool = True
    forced_type: str | None = None
    source: str | None = None
    rules: tuple[dict, ...] = ()

    def threshold_for(self, code: str, default: float) -> float:
        return self.thresholds.get(code, default)

    def with_options(self, **options) -> Settings:
        """Command-line style overrides: select replaces, ignore and extend_select append."""
        for name in ("ignore", "extend_select", "extend_ignore"):
            if name in options:
                options[name] = (*getattr(self, name), *options[name])
        return replace(self, **options)


def find_config(start: str | Path) -> Path | None:
    """The nearest configuration upward; a pyproject.toml counts if it has our table and can be parsed."""
    here = Path(start).resolve()
    for folder in [here, *here.parents] if here.is_dir() else here.parents:
        for name in CONFIG_NAMES:
            path = folder / name
            if not path.is_file():
                continue
            if name != "pyproject.toml":
                return path
            try:
                if "inkloom" in tomllib.loads(path.read_text(encoding="utf-8")).get("tool", {}):
                    return path
            except (tomllib.TOMLDecodeError, UnicodeDecodeError):
                continue
    return None


def load_settings(path: str | Path | None) -> Settings:
    """Settings of a file: the table [tool.inkloom] or top-level keys, in kebab or snake case. Unknown keys and wrong types are errors."""
    if path is None:
        return Settings()
    data = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    data = data.get("tool", {}).get("inkloom", {k: v for k, v in data.items() if k != "tool"})
    known = {f.name for f in fields(Settings)}
    out: dict = {"source": str(path)}
    for key, value in data.items():
        name = key.replace("-", "_")
        if name not in known:
            raise ValueError(f"{path}: unknown setting {key}")
        out[name] = tuple(value) if isinstance(value, list) else value
    if out.get("min_words") is not None and out["min_words"] < 1:
        raise ValueError("min_words must be at least 1")
    if not all(isinstance(v, (int, float)) for v in out.get("thresholds", {}).values()):
        raise ValueError("thresholds must be numbers")
    return Settings(**out)
