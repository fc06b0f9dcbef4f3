"""All options of the engine, their defaults, and their choice from the data."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.functions.numeric import DropMode

#: Names that options can have on a command line; fixed values.
FLAGS = {
    "auto": ("-auto", "-a"), "prediction": ("-m", "-mode", "-pm", "-prediction_mode", "-prediction"), "averaging": ("-am",), "drop": ("-d", "-drop"), "boost": ("-bm",), "weighing": ("-wm", "-w"), "split": ("-sm",), "norm": ("-n", "-norm"), "trees": ("-t", "-trees"), "tree_glob": ("-tg",), "counts": ("-c", "-counts"), "processors": ("-p",), "output": ("-o",),
    "features": ("-f", "-h"), "samples": ("-s",), "leaf_size": ("-l",), "in_features": ("-if",), "out_features": ("-of",), "feature_sub": ("-fs",), "sample_sub": ("-ss",), "epochs": ("-e",), "epoch_duration": ("-es", "-ed"), "backups": ("-backups", "-bk"), "sampling": ("-sw",),
}

CHOICES = {
    "prediction": ("branch", "truncate", "abort", "auto"), "averaging": ("arithmetic", "stacking"), "weighing": ("flat", "gain", "gain_squared", "dispersion", "dispersion_squared"),
    "split": ("mad", "variance", "mixed"), "norm": ("l1", "l2"), "boost": ("additive", "subsampling"), "drop": ("zeros", "nans", "no"),
}


@dataclass(frozen=True)
class Parameters:
    trees: int = 1
    leaf_size: int = 1
    in_features: int = 1
    out_features: int = 1
    sample_sub: int = 1
    feature_sub: int | None = None
    drop: DropMode = DropMode.ZEROS
    split: str = "mad"
    norm: str = "l1"
    prediction: str = "abort"
    averaging: str = "arithmetic"
    weighing: str = "gain"
    boost: str = "subsampling"
    epochs: int = 1
    epoch_duration: int = 1
    seed: int = 1
    processors: int = 1
    counts: str | None = None
    features: str | None = None
    samples: str | None = None
    output: str | None = None
    tree_glob: tuple[str, ...] = field(default_factory=tuple)
    backups: str | None = None
    sampling: str | None = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "drop", DropMode(self.drop))
        for name, allowed in CHOICES.items():
            if str(getattr(self, name).value if name == "drop" else getattr(self, name)) not in allowed:
                raise ValueError(f"{name} must be one of {', '.join(allowed)}")


def parse(args: Sequence[str]) -> tuple[dict[str, object], bool]:
    """Options given on a command line, by name, and whether the rest should come from the data."""
    names, kinds = {flag: name for name, flags in FLAGS.items() for flag in flags}, {f.name: f.type for f in fields(Parameters)}
    out: dict[str, object] = {}
    auto, i = False, 0
    while i < len(args):
        name = names.get(args[i])
        if name is None:
            raise ValueError(f"unknown option {args[i]}")
        values = []
        i += 1
        while i < len(args) and args[i] not in names:
            values.append(args[i])
            i += 1
        if name == "auto":
            auto = True
        elif name == "tree_glob":
            out[name] = tuple(values)
        elif len(values) != 1:
            raise ValueError(f"{name} takes one value")
        else:
            value = values[0].lower().replace("-", "_") if name in CHOICES else values[0]
            out[name] = int(value) if kinds[name].startswith("int") else value
    return out, auto


def shape_rules(p: int, n: int) -> dict[str, int]:
    """Feature, sample and leaf sizes for p features and n samples."""
    if p < 3:
        inputs = outputs = p
    else:
        outputs = int(min(p / math.log10(p), p))
        inputs = max(int(p * (125 - p) / 125), 1) if p < 100 else max(int(p * max((1500 - p) / 7000, 0.1)), 1)
    samples = n if n < 10 else n // 3 * 2 if n < 1000 else n // 2 if n < 5000 else n // 4
    return {"in_features": inputs, "out_features": outputs, "sample_sub": samples, "leaf_size": int(math.sqrt(samples)), "trees": 100}


def density(matrix: DataFrame) -> DataFrame:
    """``features, samples, cells, nans, zeros`` of a raw long matrix, in one pass."""
    v = F.col("value")
    return matrix.agg(F.countDistinct("feature").alias("features"), F.countDistinct("sample_id").alias("samples"), F.count(F.lit(1)).alias("cells"), F.coalesce(F.sum(F.when(v.isNull() | F.isnan(v), 1)), F.lit(0)).alias("nans"), F.coalesce(F.sum(F.when(v == 0, 1)), F.lit(0)).alias("zeros"))


def auto_parameters(matrix: DataFrame, given: dict[str, object] | None = None) -> Parameters:
    """Parameters from the matrix's shape and density; options that are given stay."""
    d = density(matrix).first()
    filled = 1 - d["zeros"] / d["cells"] if d["cells"] else 1.0
    out: dict[str, object] = shape_rules(d["features"], d["samples"])
    out["drop"] = DropMode.NANS if d["nans"] else DropMode.ZEROS if filled < 0.75 else DropMode.NO
    out["prediction"] = by_density(filled)
    return replace(Parameters(), **(out | (given or {})))


def by_density(filled: float) -> str:
    """The missing-value policy for a share of cells with a value."""
    return "abort" if filled < 0.25 else "truncate" if filled < 0.5 else "branch"
