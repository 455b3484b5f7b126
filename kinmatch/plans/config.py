"""The run configuration, as JSON."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace
from pathlib import Path

from ..operators.blocking import BlockingConfig
from ..operators.features import FEATURES
from ..operators.model import GbtParams


@dataclass(frozen=True)
class RunConfig:
    best_iter: int = 0
    thr2: float = 0.5
    thr3: float = 0.5
    val_f05: float = 0.0
    features: list[str] = field(default_factory=lambda: list(FEATURES))
    one_to_one: bool = True
    block: BlockingConfig = BlockingConfig()
    holdout_country: str | None = None
    max_s1: int | None = None
    gbt: GbtParams = GbtParams()

    def save(self, art_dir: str, tag: str = "run") -> None:
        """Writes config_<tag>.json and config.json, which later runs read."""
        Path(art_dir).mkdir(parents=True, exist_ok=True)
        for name in (f"config_{tag}.json", "config.json"):
            (Path(art_dir) / name).write_text(json.dumps(asdict(self), indent=2))

    @classmethod
    def load(cls, art_dir: str, path: str | None = None) -> RunConfig:
        held = json.loads(Path(path or Path(art_dir) / "config.json").read_text())
        return cls(**{**held, "block": BlockingConfig(**held["block"]), "gbt": GbtParams(**held["gbt"])})

    def with_max_cand(self, max_cand: int | None) -> RunConfig:
        return self if max_cand is None else replace(self, block=replace(self.block, max_cand=max_cand))
