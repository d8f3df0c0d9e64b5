"""Configurations and run folders: driver-side, of a few small files."""

from __future__ import annotations

import json
import shutil
from pathlib import Path


def load_config(*paths: str) -> dict:
    """JSON objects merged in order: later ones win, key by key at the top."""
    merged: dict = {}
    for path in paths:
        merged |= json.loads(Path(path).read_text())
    return merged


def run_folder(root: str, name: str, configs: list[str], overwrite: bool = False, parts: tuple[str, ...] = ("stages", "results", "artifacts")) -> Path:
    """A new folder with parts, copies of the configs and their merger; an existing one is an error unless it may be overwritten."""
    folder = Path(root) / name
    if folder.exists():
        if not overwrite:
            raise FileExistsError(f"{folder} exists")
        shutil.rmtree(folder)
    for part in parts:
        (folder / part).mkdir(parents=True)
    (folder / "configs").mkdir()
    for path in configs:
        shutil.copy(path, folder / "configs")
    (folder / "configs" / "merged.json").write_text(json.dumps(without_secrets(load_config(*configs)), indent=2))
    return folder


def without_secrets(config: dict) -> dict:
    """Without values of keys that name a secret."""
    return {k: without_secrets(v) if isinstance(v, dict) else "***" if any(s in k.lower() for s in ("token", "secret", "api_key", "password")) else v for k, v in config.items()}


def raw_results_folder(config: dict) -> str:
    return f"{config['results_dir'].rstrip('/')}/stages"


def default_cot_path(results: str) -> str | None:
    """The chain-of-thought results beside others, if there are any."""
    path = Path(results) / "fc_notool_cot.jsonl"
    return str(path) if path.exists() else None
