"""Parameters: defaults that define results, read from ``key = literal`` files."""

from __future__ import annotations

import ast
from dataclasses import dataclass, fields, replace

from cladescope.functions.reconcile import Costs


@dataclass(frozen=True)
class Params:
    evalue: float = 1e-8
    align_cover: float = 0.65
    identity: float = 0.35
    gap_open: int = 12
    gap_extend: int = 1
    synteny_window: int = 8
    synteny_take: int = 3
    core_window: int = 20
    histogram_bins: int = 80
    split_quantile: float = 0.95
    split_times: float = 1.5
    largest_blast_family: int = 8
    largest_initial_family: int = 4
    forced_split_balance: float = 10.0
    synteny_quantile: float = 0.1
    synteny_times: float = 0.5
    proximity_range: int = 2
    proximity_merge: int = 1
    merge_threshold: float = 0.0
    cluster_size: int = 50
    refine_solutions: int = 20
    refine_range: int = 4
    refine_island: int = 2
    bed_tries: int = 100
    D: int = 2
    T: int = 6
    L: int = 1
    O: int = 6  # noqa: E741
    R: int = 7
    focal_root: str = ""

    def __post_init__(self):
        costs = (self.D, self.T, self.L, self.O, self.R)
        if any(not isinstance(c, int) or c < 0 for c in costs):
            raise ValueError("costs must be whole numbers from 0")
        if self.D > self.T:
            raise ValueError("a duplication may not cost more than a transfer")

    @property
    def costs(self) -> Costs:
        return Costs(self.D, self.T, self.L, self.O, self.R)


def parse_assignments(text: str) -> dict[str, object]:
    """Values of ``key = literal`` lines; later ones win. Anything but a literal is an error."""
    out: dict[str, object] = {}
    for statement in ast.parse(text).body:
        if isinstance(statement, ast.Assign) and len(statement.targets) == 1 and isinstance(statement.targets[0], ast.Name):
            out[statement.targets[0].id] = ast.literal_eval(statement.value)
        else:
            raise ValueError(f"line {statement.lineno} is no assignment of a literal")
    return out


def load(*texts: str) -> Params:
    """Defaults, overridden by each text in turn; unknown keys are errors."""
    known = {f.name for f in fields(Params)}
    out = Params()
    for text in texts:
        found = parse_assignments(text)
        if extra := set(found) - known:
            raise ValueError(f"unknown parameters: {sorted(extra)}")
        out = replace(out, **found)
    return out
