"""Dataset contracts: what a set of CSV files must look like, and where they are."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from pathlib import Path

import yaml

from plumbline.sources.files import is_there, matching

#: Environment variable that moves the data root, and the root that relative paths name by default.
ROOT_VARIABLE, DEFAULT_ROOT = "PLUMBLINE_DATA_ROOT", "data/raw"


class ContractError(ValueError):
    """A contract that is incomplete, contradicts itself, or is broken by the files."""

    def __init__(self, message: str, code: str | None = None):
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class Contract:
    """One dataset: its files, label, order keys, columns that are never features, and split shares."""

    cluster: int
    name: str
    directory: str
    label: str
    mode: str = "directory"  # directory, file, or combined
    files: tuple[str, ...] = ()
    file: str | None = None
    pattern: str = "*.csv"
    missing_code: str | None = None
    order: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()
    excluded_if_present: tuple[str, ...] = ()
    clients: int = 12
    ratios: tuple[float, float, float] = (0.7, 0.15, 0.15)
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.mode not in ("directory", "file", "combined"):
            raise ContractError(f"unknown mode {self.mode}")
        if self.mode != "directory" and not self.file:
            raise ContractError(f"mode {self.mode} needs a file")
        left = [c for c in (self.label, *self.order) if c not in (*self.excluded, *self.excluded_if_present)]
        if left:
            raise ContractError(f"label and order columns must be excluded: {', '.join(left)}")
        if len(self.ratios) != 3 or any(isinstance(r, bool) or not isinstance(r, int | float) or not 0 <= r <= 1 for r in self.ratios) or abs(sum(self.ratios) - 1) > 1e-9:
            raise ContractError("split ratios must be three shares that sum to 1")
        if isinstance(self.clients, bool) or self.clients < 1:
            raise ContractError("clients must be a positive number")


_KINDS = {"cluster": int, "name": str, "directory": str, "label": str, "mode": str, "file": str, "pattern": str, "missing_code": str, "clients": int}
_LISTS = ("files", "order", "excluded", "excluded_if_present", "ratios")


def load_contract(path: str) -> Contract:
    """A contract from a YAML mapping with the fields of ``Contract``; other keys go to ``extra``."""
    values = yaml.safe_load(Path(path).read_text())
    if not isinstance(values, dict):
        raise ContractError(f"{path} holds no mapping")
    for key in ("cluster", "name", "directory", "label"):
        if key not in values:
            raise ContractError(f"{path}: {key} is missing")
    for key, kind in _KINDS.items():
        if values.get(key) is not None and (not isinstance(values[key], kind) or isinstance(values[key], bool)):
            raise ContractError(f"{path}: {key} must be {kind.__name__}")
    for key in _LISTS:
        if key in values and not isinstance(values[key], list):
            raise ContractError(f"{path}: {key} must be a list")
    known = {k: tuple(v) if k in _LISTS else v for k, v in values.items() if k in (*_KINDS, *_LISTS)}
    return Contract(**known, extra={k: v for k, v in values.items() if k not in known})


def resolve(path: str) -> str:
    """A path with its default root moved to the one that the environment names; absolute paths and URLs stay."""
    root = os.environ.get(ROOT_VARIABLE)
    inside = path == DEFAULT_ROOT or path.startswith(DEFAULT_ROOT + "/")
    return root.rstrip("/") + path[len(DEFAULT_ROOT) :] if root and inside else path


def profile_files(contract: Contract) -> list[str]:
    """The listed files in their order; each must exist and be a CSV file."""
    paths = [f"{resolve(contract.directory)}/{f}" for f in contract.files]
    for p in paths:
        if not p.endswith(".csv") or not is_there(p):
            raise ContractError(f"no CSV file at {p}")
    return paths


def training_files(contract: Contract) -> list[str]:
    """The files that training reads: those listed, else all by name; the one file; or the combined file, without a fallback."""
    if contract.mode == "directory":
        found = profile_files(contract) if contract.files else matching(resolve(contract.directory), contract.pattern)
        if not found:
            raise ContractError(f"no files in {contract.directory}")
        return found
    path = resolve(contract.file)
    if not is_there(path):
        raise ContractError(f"no file at {path}", contract.missing_code if contract.mode == "combined" else None)
    return [path]
