"""Small text files read on the driver: project settings and behaviour tables.

The format is the part of YAML that these files use: mappings nested by indentation,
scalars, inline lists and lists of dashes.
"""

from __future__ import annotations

import glob
import json
import os
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..operators import behaviors, grading


def _scalar(x: str) -> Any:
    x = x.strip()
    if len(x) > 1 and x[0] == x[-1] and x[0] in "\"'":
        return json.loads(x) if x[0] == '"' else x[1:-1].replace("''", "'")
    if x.startswith("[") and x.endswith("]"):
        return [_scalar(v) for v in x[1:-1].split(",") if v.strip()]
    if x in ("", "null", "~"):
        return None
    if x in ("true", "false"):
        return x == "true"
    for kind in (int, float):
        try:
            return kind(x)
        except ValueError:
            pass
    return x


def parse(text: str) -> dict:
    """Nested mappings of a text; comments are whole lines or follow a blank."""
    root: dict = {}
    open_: list[tuple[int, Any, str | None]] = [(-1, root, None)]  # indent, mapping, key that awaits a value
    for raw in text.split("\n"):
        line = raw.split(" #", 1)[0].rstrip() if '"' not in raw else raw.rstrip()
        body = line.lstrip()
        if not body or body.startswith(("#", "---")):
            continue
        indent = len(line) - len(body)
        while len(open_) > 1 and (open_[-1][0] > indent or open_[-1][0] == indent and not isinstance(open_[-1][1], dict)):
            open_.pop()
        if body.startswith("- "):
            _, holder, key = open_[-1]
            if isinstance(holder, dict):
                holder[key] = items = holder[key] if isinstance(holder.get(key), list) else []
                items.append(_scalar(body[2:]))
            continue
        key, _, value = body.partition(":")
        key = str(_scalar(key))
        holder = open_[-1][1]
        if open_[-1][0] < indent and open_[-1][2] is not None and open_[-1][0] >= 0:
            above = open_[-1][1]
            holder = above[open_[-1][2]] = above[open_[-1][2]] if isinstance(above.get(open_[-1][2]), dict) else {}
            open_.append((indent, holder, None))
        elif open_[-1][0] < 0:
            open_.append((indent, holder, None))
        holder[key] = _scalar(value) if value.strip() else None
        open_[-1] = (open_[-1][0], holder, key)
    return root


def read(path: str) -> dict:
    """The settings in a file; none if it does not exist."""
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        return parse(f.read())


@dataclass(frozen=True)
class Project:
    """A project's settings, with their defaults."""

    ignore_paths: tuple[str, ...] = ()
    impact: dict[str, int] = field(default_factory=lambda: dict(grading.IMPACT))
    combined_top: int = 2
    cosine_significance_threshold: float = 0.15
    max_loo_file_bytes: int | None = 32_768
    max_pairs_per_bucket: int | None = None
    idf_max_freq: float = 1.0

    @classmethod
    def of(cls, settings: dict) -> Project:
        known = {k: settings[k] for k in ("combined_top", "cosine_significance_threshold", "max_loo_file_bytes") if settings.get(k) is not None}
        near = settings.get("near_duplicate_blocks") or {}
        known |= {k: near[k] for k in ("max_pairs_per_bucket", "idf_max_freq") if near.get(k) is not None}
        if settings.get("impact"):
            known["impact"] = dict(grading.IMPACT) | settings["impact"]
        return cls(ignore_paths=tuple(settings.get("ignore_paths") or ()), **known)


@dataclass(frozen=True)
class Report:
    """What a report grades by: thresholds, letters, impact, and sizes of blocks."""

    thresholds: tuple[tuple, ...] = grading.CATEGORIES
    scale: tuple[tuple[int, str], ...] = grading.SCALE
    impact: dict[str, int] = field(default_factory=lambda: dict(grading.IMPACT))
    combined_top: int = 2
    block_min_lines: int = 3
    block_max_lines: int = 20

    @classmethod
    def of(cls, settings: dict) -> Report:
        """Metrics given by category replace those with the same source, or are added."""
        rows = {r[:3]: r for r in grading.CATEGORIES}
        for category, body in (settings.get("categories") or {}).items():
            for name, m in ((body or {}).get("metrics") or {}).items():
                source, _, key = str(m.get("source") or name).partition(".")
                key = key or name
                old = rows.get((category, source, key), (category, source, key, "low", 0, 0, 0, 0, 1.0))
                limits = m.get("thresholds") or {}
                limits = [limits.get(k, o) for k, o in zip("abcd", old[4:8], strict=True)]
                rows[category, source, key] = (category, source, key, m.get("good") or old[3], *limits, m.get("weight", old[8]))
        known = {k: settings[k] for k in ("combined_top", "block_min_lines", "block_max_lines") if settings.get(k) is not None}
        if settings.get("grade_scale"):
            known["scale"] = tuple(sorted(((int(v), str(k)) for k, v in settings["grade_scale"].items()), reverse=True))
        if settings.get("impact"):
            known["impact"] = dict(grading.IMPACT) | settings["impact"]
        return cls(thresholds=tuple(rows.values()), **known)


# -- behaviour tables -----------------------------------------------------------

_ABOUT = {"_languages": "languages", "_excludes_languages": "excludes_languages", "_excludes_block_types": "excludes_kinds", "_log_baseline": "log_baseline", "_fix_hint": "hint", "_doc": "doc"}


def read_behaviors(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Weights and descriptions of a folder of YAML files: one for each category, with
    behaviour -> metric -> key -> scalar, and what is said of a behaviour behind _names."""
    weights, about = [], []
    for path in sorted(glob.glob(os.path.join(folder, "*.yml"))):
        category = os.path.basename(path)[: -len(".yml")]
        for behavior, body in read(path).items():
            if not isinstance(body, dict):
                continue
            said = {v: body.get(k) for k, v in _ABOUT.items()}
            baseline = float(said["log_baseline"] or 0)
            about.append((category, behavior, said["languages"] or [], said["excludes_languages"] or [], said["excludes_kinds"] or [], baseline, said["hint"], said["doc"]))
            weights += [(category, behavior, g, k, float(v)) for g, keys in body.items() if isinstance(keys, dict) for k, v in keys.items()]
    return spark.createDataFrame(weights, "category string, behavior string, grp string, key string, scalar double"), spark.createDataFrame(about, behaviors.ABOUT)


def write_behaviors(weights: DataFrame, about: DataFrame, folder: str) -> None:
    """The same tables as YAML, keys in order, four decimals.  They are dimensions of some
    thousand rows, written by the driver."""
    os.makedirs(folder, exist_ok=True)
    files: dict[str, list[str]] = {}
    scalars = {}
    for r in weights.orderBy("category", "behavior", "grp", "key").collect():
        scalars.setdefault((r["category"], r["behavior"]), {}).setdefault(r["grp"], []).append((r["key"], r["scalar"]))
    for r in about.orderBy("category", "behavior").collect():
        out = files.setdefault(r["category"], [])
        out.append(f"{r['behavior']}:")
        for name, column in sorted(_ABOUT.items()):
            if isinstance(r[column], float):
                out.append(f"  {name}: {r[column]:.4f}")
            elif isinstance(r[column], list) and r[column]:
                out.append(f"  {name}: [{', '.join(r[column])}]")
            elif isinstance(r[column], str):
                out.append(f"  {name}: {json.dumps(r[column], ensure_ascii=False)}")
        for group, keys in sorted(scalars.get((r["category"], r["behavior"]), {}).items()):
            out += [f"  {group}:", *(f"    {k}: {v:.4f}" for k, v in keys)]
    for category, lines in files.items():
        with open(os.path.join(folder, f"{category}.yml"), "w", encoding="utf-8") as f:
            f.write("\n".join(lines) + "\n")
