"""Thresholds, silenced findings and column policies, from TOML or keywords."""

from __future__ import annotations

import dataclasses
import math
import os
import tomllib

# Roles that a column policy may name.
ROLES = ("identifier", "measure", "category", "date", "text", "sensitive")
FILE_NAMES = ("lodestrata.toml", ".lodestrata.toml")


class ConfigError(Exception):
    """A configuration that cannot be used."""


@dataclasses.dataclass
class ColumnPolicy:
    role: str | None = None
    required: bool = False
    allowed_values: list[str] | None = None
    min_value: float | None = None
    max_value: float | None = None


@dataclasses.dataclass
class Config:
    null_warn: float = 0.10
    null_error: float = 0.50
    outlier_z: float = 6.0
    outlier_share: float = 0.05
    max_examples: int = 3
    key: list[str] = dataclasses.field(default_factory=list)
    ignore: list[str] = dataclasses.field(default_factory=list)
    ignore_columns: dict[str, list[str]] = dataclasses.field(default_factory=dict)
    fail_on: str = "error"
    columns: dict[str, ColumnPolicy] = dataclasses.field(default_factory=dict)

    def policy(self, name: str, key: str) -> ColumnPolicy:
        """The policy of a column: by its key first, then by its name."""
        return self.columns.get(key) or self.columns.get(name) or ColumnPolicy()

    def silenced(self, code: str, column: str | None) -> bool:
        return code in self.ignore or (column is not None and code in self.ignore_columns.get(column, ()))


def _number(raw, name: str, low: float | None = None, high: float | None = None) -> float:
    if isinstance(raw, bool) or not isinstance(raw, (int, float)) or not math.isfinite(raw):
        raise ConfigError(f"{name} must be a finite number")
    if low is not None and raw < low or high is not None and raw > high:
        raise ConfigError(f"{name} must be between {low} and {high}")
    return float(raw)


def _strings(raw, name: str) -> list[str]:
    if isinstance(raw, str):
        return [raw]
    if not isinstance(raw, list) or not all(isinstance(x, str) for x in raw):
        raise ConfigError(f"{name} must be a list of strings")
    return list(raw)


def parse(data: dict) -> Config:
    """A Config from a TOML document; anything unknown or out of range is refused."""
    known = {f.name for f in dataclasses.fields(Config)}
    if unknown := set(data) - known:
        raise ConfigError(f"unknown settings: {', '.join(sorted(unknown))}")
    out = Config()
    for name in ("null_warn", "null_error", "outlier_share"):
        if name in data:
            setattr(out, name, _number(data[name], name, 0, 1))
    if "outlier_z" in data:
        out.outlier_z = _number(data["outlier_z"], "outlier_z", 0)
    if out.null_warn > out.null_error:
        raise ConfigError("null_warn must not be above null_error")
    if "max_examples" in data:
        if isinstance(data["max_examples"], bool) or not isinstance(data["max_examples"], int) or data["max_examples"] < 0:
            raise ConfigError("max_examples must be a whole number, 0 or more")
        out.max_examples = data["max_examples"]
    for name in ("key", "ignore"):
        if name in data:
            setattr(out, name, _strings(data[name], name))
    if "fail_on" in data:
        if data["fail_on"] not in ("error", "warning", "info", "never"):
            raise ConfigError("fail_on must be error, warning, info or never")
        out.fail_on = data["fail_on"]
    if "ignore_columns" in data:
        if not isinstance(data["ignore_columns"], dict):
            raise ConfigError("ignore_columns must be a table")
        out.ignore_columns = {k: _strings(v, f"ignore_columns.{k}") for k, v in data["ignore_columns"].items()}
    if not isinstance(data.get("columns", {}), dict):
        raise ConfigError("columns must be a table")
    for name, raw in data.get("columns", {}).items():
        out.columns[name] = _policy(name, raw)
    return out


def _policy(name: str, raw) -> ColumnPolicy:
    if not isinstance(raw, dict):
        raise ConfigError(f"columns.{name} must be a table")
    if unknown := set(raw) - {f.name for f in dataclasses.fields(ColumnPolicy)}:
        raise ConfigError(f"columns.{name}: unknown settings: {', '.join(sorted(unknown))}")
    out = ColumnPolicy()
    if "role" in raw:
        if raw["role"] not in ROLES:
            raise ConfigError(f"columns.{name}.role must be one of {', '.join(ROLES)}")
        out.role = raw["role"]
    if "required" in raw:
        if not isinstance(raw["required"], bool):
            raise ConfigError(f"columns.{name}.required must be true or false")
        out.required = raw["required"]
    if "allowed_values" in raw:
        out.allowed_values = _strings(raw["allowed_values"], f"columns.{name}.allowed_values")
    for bound in ("min_value", "max_value"):
        if bound in raw:
            setattr(out, bound, _number(raw[bound], f"columns.{name}.{bound}"))
    if out.min_value is not None or out.max_value is not None:
        if out.role not in (None, "measure"):
            raise ConfigError(f"columns.{name}: bounds are for measures")
        if None not in (out.min_value, out.max_value) and out.min_value > out.max_value:
            raise ConfigError(f"columns.{name}: min_value is above max_value")
    return out


def load(path: str) -> Config:
    try:
        with open(path, "rb") as f:
            return parse(tomllib.load(f))
    except (OSError, tomllib.TOMLDecodeError) as error:
        raise ConfigError(f"{path}: {error}") from error


def find(start: str) -> str | None:
    """The nearest configuration file at or above a directory."""
    place = os.path.abspath(start)
    while True:
        for name in FILE_NAMES:
            if os.path.isfile(path := os.path.join(place, name)):
                return path
        if (up := os.path.dirname(place)) == place:
            return None
        place = up
