"""Settings of the command line: dataclasses that a JSON file can fill."""

from __future__ import annotations

import argparse
import json
from dataclasses import dataclass, fields
from typing import Any


@dataclass(frozen=True)
class TrainConfig:
    """Walks, pairs and skip-gram training."""

    walks: int = 10
    length: int = 40
    restart: float = 0.1
    window: int = 5
    keep: float = 1.0
    dim: int = 32
    epochs: int = 5
    negatives: int = 5
    lr: float = 0.05
    seed: int = 2025


@dataclass(frozen=True)
class NeighbourConfig:
    """Search of the nearest vectors: exact, or in cells."""

    k: int = 50
    kind: str = "cells"
    recall: float = 0.95
    part_rows: int = 2_000_000


@dataclass(frozen=True)
class ContentConfig:
    """Row and column budgets of a table, neighbours, and the size of the vectors."""

    max_rows: int = 1024
    max_cols: int = 60
    k: int = 50
    dim: int = 64


@dataclass(frozen=True)
class EvalConfig:
    """Length of the evaluated lists."""

    k: int = 20


def add_flags(parser: argparse.ArgumentParser, kind: type) -> None:
    """One flag per field of the dataclass, and ``--config``, a JSON file that takes the place of all of them."""
    for f in fields(kind):
        parser.add_argument(f"--{f.name.replace('_', '-')}", type=type(f.default), default=f.default)
    parser.add_argument("--config", help="JSON file with these settings; then the flags don't count")


def from_flags(args: argparse.Namespace, kind: type) -> Any:
    """The dataclass from parsed flags; unknown names in the JSON file are an error."""
    if args.config:
        with open(args.config) as f:
            given = json.load(f)
        unknown = set(given) - {f.name for f in fields(kind)}
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return kind(**given)
    return kind(**{f.name: getattr(args, f.name) for f in fields(kind)})
