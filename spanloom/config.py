"""Settings of a run: defaults, a YAML or JSON file over them, and overrides over both."""

from __future__ import annotations

import dataclasses
import json


@dataclasses.dataclass(frozen=True)
class Settings:
    """What the commands need; paths may lie on any file system that Spark reads."""

    project: str = "run"
    genome: str | None = None
    sizes: str | None = None
    annotation: str | None = None
    signal: str | None = None
    out: str = "out"
    window_sizes: tuple[int, ...] = (200, 1000, 4000)
    step_fraction: float = 0.5
    seed: int = 4099

    def __post_init__(self):
        if not self.window_sizes or any(int(w) < 1 for w in self.window_sizes):
            raise ValueError("window sizes must be positive")
        if not 0 < self.step_fraction <= 1:
            raise ValueError("the step fraction must be over 0 and at most 1")


def _known(values: dict) -> dict:
    names = {f.name for f in dataclasses.fields(Settings)}
    if unknown := sorted(set(values) - names):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return {k: tuple(v) if k == "window_sizes" else v for k, v in values.items()}


def parse(text: str, yaml: bool) -> dict:
    """The file's mapping; an empty file is an empty one, any other shape an error. YAML needs the package yaml."""
    if yaml:
        import yaml as package

        got = package.safe_load(text)
    else:
        got = json.loads(text) if text.strip() else None
    if got is None:
        return {}
    if not isinstance(got, dict):
        raise ValueError("settings must be a mapping")
    return got


def load(path: str | None = None, **overrides) -> Settings:
    """Settings of a local ``.yaml``, ``.yml`` or ``.json`` file; overrides that are None do not count."""
    values: dict = {}
    if path:
        with open(path, encoding="utf-8") as f:
            values = parse(f.read(), path.lower().endswith((".yaml", ".yml")))
    return Settings(**_known(values | {k: v for k, v in overrides.items() if v is not None}))


def snapshot(settings: Settings) -> str:
    """The settings as JSON text, keys in order."""
    return json.dumps(dataclasses.asdict(settings), sort_keys=True)
