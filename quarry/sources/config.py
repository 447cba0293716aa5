"""Settings of an audit, from a strict TOML file or keyword arguments."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields
from pathlib import Path

NAMES = ("quarry.toml", ".quarry.toml")


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Config:
    entrypoint_modules: tuple[str, ...] = ()
    entrypoint_paths: tuple[str, ...] = ()
    protected: tuple[str, ...] = ("**/migrations/**", "**/plugins/**", "**/generated/**", "**/vendor/**")
    exclude: tuple[str, ...] = ()
    import_roots: tuple[str, ...] = ()
    public_modules: tuple[str, ...] = ()
    min_similarity: float = 0.72
    flat_directory_threshold: int = 12
    allow_delete_src: bool = False
    allow_delete_package_modules: bool = False

    def __post_init__(self):
        for f in fields(self):
            value, want = getattr(self, f.name), type(f.default)
            if want is float and type(value) is int:
                object.__setattr__(self, f.name, value := float(value))
            if type(value) is not want:  # exactly: neither "false" nor 0 is a boolean
                raise ConfigError(f"{f.name} must be {want.__name__}")
            if want is tuple and not all(type(x) is str for x in value):
                raise ConfigError(f"{f.name} must hold strings")
        if self.flat_directory_threshold < 4:
            raise ConfigError("flat_directory_threshold must be 4 or more")
        if not 0.3 <= self.min_similarity <= 0.95:
            raise ConfigError("min_similarity must lie in 0.3 to 0.95")


def load(root: str | Path, path: str | Path | None = None) -> Config:
    found = [Path(path)] if path else [p for n in NAMES if (p := Path(root, n)).is_file()]
    if not found:
        return Config()
    try:
        raw = tomllib.loads(found[0].read_text("utf-8"))
    except (OSError, UnicodeDecodeError, tomllib.TOMLDecodeError) as e:
        raise ConfigError(f"{found[0]}: {e}") from e
    if raw.pop("schema", 1) != 1:
        raise ConfigError("schema must be 1")
    if unknown := set(raw) - {f.name for f in fields(Config)}:
        raise ConfigError(f"unknown settings: {', '.join(sorted(unknown))}")
    return Config(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()})
