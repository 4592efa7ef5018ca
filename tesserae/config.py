"""Settings of an engine; unknown ones are refused."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

LEVELS = ("off", "errors", "summary", "detailed")


@dataclass(frozen=True)
class Model:
    provider: str | None = None
    model: str | None = None


@dataclass(frozen=True)
class Notify:
    notification: str = "errors"
    error_notification: bool = True

    def __post_init__(self):
        if self.notification not in LEVELS:
            raise ValueError(f"notification must be one of {', '.join(LEVELS)}")
        if not isinstance(self.error_notification, bool):
            raise ValueError("error_notification must be true or false")


@dataclass(frozen=True)
class Config:
    root: str
    embedding: Model = field(default_factory=lambda: Model("auto"))
    llm: Model = field(default_factory=Model)
    consolidation: Notify = field(default_factory=Notify)
    temporal: Notify = field(default_factory=Notify)
    auto_capture: bool = True
    auto_recall: bool = True
    verbose: bool = False
    log_queries: bool = False
    require_embedding: bool = True


PARTS = {"embedding": Model, "llm": Model, "consolidation": Notify, "temporal": Notify}


def parse(values: dict) -> Config:
    """A Config of plain values; parts are given as dicts."""
    if not isinstance(values, dict):
        raise ValueError("settings must be an object")
    _known(values, Config, "settings")
    out = dict(values)
    for name, kind in PARTS.items():
        if name in out:
            if not isinstance(out[name], dict):
                raise ValueError(f"{name} must be an object")
            _known(out[name], kind, name)
            out[name] = kind(**out[name])
    return Config(**out)


def _known(values: dict, kind: type, label: str) -> None:
    extra = sorted(set(values) - {f.name for f in fields(kind)})
    if extra:
        raise ValueError(f"{label} has unknown keys: {', '.join(extra)}")
