"""Settings of an analysis: YAML sections, paths, seeds, a hash of what was set, and what it ran on."""

from __future__ import annotations

import copy
import hashlib
import json
import os
import platform
import random
from dataclasses import dataclass
from pathlib import Path

from .tables import load_yaml

ROOT_VARIABLE = "VEYRA_ROOT"


def project_root(marker: str = "config", start: str | None = None) -> Path:
    """The folder named by VEYRA_ROOT, else the nearest one upwards that holds the marker, else the working folder."""
    if named := os.environ.get(ROOT_VARIABLE):
        return Path(named)
    here = Path(start or os.getcwd()).resolve()
    return next((p for p in (here, *here.parents) if (p / marker).exists()), here)


@dataclass(frozen=True)
class Paths:
    root: Path

    def of(self, *parts: str) -> str:
        return str(self.root.joinpath(*parts))

    @property
    def raw(self) -> str:
        return self.of("data", "raw")

    @property
    def interim(self) -> str:
        return self.of("data", "interim")

    @property
    def results(self) -> str:
        return self.of("results")

    @property
    def checkpoints(self) -> str:
        return self.of("results", "checkpoints")


class Config:
    def __init__(self, values: dict, root: Path | None = None):
        self.values, self.paths = copy.deepcopy(values), Paths(root or project_root())

    @classmethod
    def load(cls, path: str, root: Path | None = None, **changes) -> Config:
        """changes: section__name=value."""
        values = load_yaml(path)
        for name, value in changes.items():
            *sections, last = name.split("__")
            at = values
            for s in sections:
                at = at.setdefault(s, {})
            at[last] = value
        return cls(values, root)

    def section(self, name: str) -> dict:
        if name not in self.values:
            raise KeyError(f"no section {name!r}; there are {sorted(self.values)}")
        return self.values[name]

    @property
    def seed(self) -> int:
        return int(self.values.get("seeds", {}).get("base", self.values.get("seed", 0)))

    def seeds(self, n: int) -> list[int]:
        return [self.seed + i for i in range(n)]

    def hash(self) -> str:
        return hashlib.sha256(json.dumps(self.values, sort_keys=True, default=str).encode()).hexdigest()[:12]


def set_global_seeds(seed: int) -> None:
    """Of Python and NumPy on the driver; operators take seeds of their own, as tasks don't share these."""
    import numpy as np

    random.seed(seed)
    np.random.seed(seed % 2**32)


def environment_report(spark=None) -> dict[str, str]:
    import importlib.metadata as meta

    out = {"python": platform.python_version(), "platform": platform.platform()}
    for name in ("pyspark", "numpy", "pandas", "pyarrow"):
        try:
            out[name] = meta.version(name)
        except meta.PackageNotFoundError:
            out[name] = "absent"
    return out | ({"spark": spark.version, "master": spark.sparkContext.master} if spark else {})
