"""Work units: one parameter point of a generator family over a range of seeds, and its result.

A unit is a document whose identity is the digest of its canonical JSON. Its random stream leaves
the range of seeds out, so cutting a sweep anew changes no result. Two runs of a unit give the same
result hash, wherever they run.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator, Sequence

from corpusloom.operators import generators

from . import canonical
from .calibration import METRICS, Corpus, Invalid, Target, TargetOptions, build_target, median
from .random import Stream
from .textstats import NAMES, VERSION, fingerprint

#: The schemas' names, which documents may have behind a prefix of their own, and bounds.
UNIT_SCHEMA, RESULT_SCHEMA = "work-unit-0.2", "result-0.2"
LEDGER_SCHEMA = "sweep-ledger-0.1"
CHECKPOINT_SCHEMA = "generation-checkpoint-1"
PROFILE, KERNEL = "python-ieee754-scalar-v1", "corpusloom"
MOST_SEEDS, MOST_LINES, MOST_WORDS = 256, 200_000, 2_000_000
KEY = re.compile(r"[a-z][a-z0-9_]{0,63}")
Layout = Sequence[tuple[int, bool, bool]]


def layout_document(layout: Layout) -> dict:
    return {"lines": [{"words": n, "para_start": a, "para_end": b} for n, a, b in layout]}


def layout_of(document: dict) -> list[tuple[int, bool, bool]]:
    return [(line["words"], line["para_start"], line["para_end"]) for line in document["lines"]]


def resources_document(resources: dict | None) -> dict | None:
    """Resources as JSON: counts by context and glyph, words with counts, null for what is absent."""
    if resources is None:
        return None
    model, bag = resources.get("glyph_model"), resources.get("word_bag")
    return {
        "glyph_model": model and {"order": model["order"], "counts": {c: dict(seen) for c, seen in model["counts"].items()}},
        "word_bag": bag and {"words": [[w, n] for w, n in bag]},
    }


def make(experiment: str, family: str, params: dict, target: Target, layout: Layout, resources: dict | None = None, first: int = 0, seeds: int = 8, metric: str = "z") -> dict:
    """The unit for these artifacts; the metric is named only if it isn't the usual one."""
    unit = {
        "schema_version": UNIT_SCHEMA, "experiment_id": experiment, "family": family, "params": params, "fingerprint_version": VERSION,
        "target_digest": canonical.identity(target.document()), "layout_digest": canonical.identity(layout_document(layout)),
        "resources_digest": None if resources is None else canonical.identity(resources_document(resources)), "seed_start": first, "seed_count": seeds,
    }
    return unit | ({} if metric == "z" else {"metric": metric})


def unit_id(unit: dict) -> str:
    return canonical.identity({k: v for k, v in unit.items() if (k, v) != ("metric", "z")})


def stream_id(unit: dict) -> str:
    """The identity of a unit's random stream: all that defines its corpora but the seeds."""
    return canonical.identity({k: unit[k] for k in ("experiment_id", "family", "params", "fingerprint_version", "layout_digest", "resources_digest")})


def validate(unit: dict, target: Target, layout: Layout, resources: dict | None = None) -> None:
    """Raises Invalid unless the unit can run with these artifacts, and they are those that it names."""
    if not unit["schema_version"].endswith(UNIT_SCHEMA) or unit["fingerprint_version"] != VERSION or target.version != VERSION:
        raise Invalid("the unit's schema or fingerprint version isn't supported")
    if unit["family"] not in generators.FAMILIES:
        raise Invalid(f"unknown family {unit['family']}")
    for key, value in unit["params"].items():
        if not KEY.fullmatch(key) or isinstance(value, (list, dict)) or (isinstance(value, float) and not math.isfinite(value)):
            raise Invalid(f"parameter {key} has another name or value than allowed")
    if not 1 <= unit["seed_count"] <= MOST_SEEDS or unit["seed_start"] + unit["seed_count"] >= 1 << 64:
        raise Invalid(f"a unit has 1 to {MOST_SEEDS} seeds, all in 64 bits")
    if not 1 <= len(layout) <= MOST_LINES or any(n < 1 for n, _, _ in layout) or sum(n for n, _, _ in layout) > MOST_WORDS:
        raise Invalid("the layout has no lines, an empty one, or more lines or words than allowed")
    target.validated()
    if unit.get("metric", "z") not in METRICS or (unit.get("metric") == "mahalanobis" and target.precision is None):
        raise Invalid("the metric is unknown or lacks its matrix")
    found = {"target": target.document(), "layout": layout_document(layout), "resources": resources_document(resources)}
    for what, document in found.items():
        named = unit[f"{what}_digest"]
        if named != (None if document is None else canonical.identity(document)):
            raise Invalid(f"the {what} isn't the one that the unit names")


def corpus(unit: dict, layout: Layout, seed: int, resources: dict | None = None) -> list[list[str]]:
    """The corpus of one seed."""
    fill = generators.build(unit["family"], unit["params"], resources)
    return fill(Stream(stream_id(unit).encode(), seed), [n for n, _, _ in layout])


def seed_result(unit: dict, target: Target, layout: Layout, seed: int, resources: dict | None = None) -> dict:
    values = fingerprint(corpus(unit, layout, seed, resources), {k for k, (_, start, _) in enumerate(layout) if start})
    if not all(map(math.isfinite, values)):
        raise Invalid(f"seed {seed} has a value that isn't finite")
    return {"seed": seed, "fingerprint": values, "distance": target.distance(values, unit.get("metric", "z"))}


def result(unit: dict, seeds: list[dict]) -> dict:
    """The result document of all seeds. The specimen is for show: the nearest seed, the least of equals."""
    distances = [s["distance"] for s in seeds]
    specimen = min(seeds, key=lambda s: (s["distance"], s["seed"]))
    total = 0.0
    for d in distances:
        total += d
    return {
        "schema_version": RESULT_SCHEMA, "work_unit_id": unit_id(unit), "stream_id": stream_id(unit), "kernel_version": KERNEL, "fingerprint_version": VERSION, "numeric_profile": PROFILE,
        "seeds": seeds, "replicates": {"n": len(seeds), "distance_median": median(distances), "distance_mean": total / len(seeds), "distance_min": min(distances), "distance_max": max(distances)},
        "specimen_seed": specimen["seed"], "specimen_distance": specimen["distance"],
        "result_hash": canonical.result_hash([(s["seed"], s["fingerprint"], s["distance"]) for s in seeds]),
    }


def run(unit: dict, target: Target, layout: Layout, resources: dict | None = None) -> dict:
    validate(unit, target, layout, resources)
    return result(unit, [seed_result(unit, target, layout, s, resources) for s in range(unit["seed_start"], unit["seed_start"] + unit["seed_count"])])


def plant(source: str, family: str, params: dict, layout: Layout, seed: int, options: TargetOptions, resources: dict | None = None) -> dict:
    """A corpus made from hidden parameters on a layout, with all that a search for them gets: its
    text, target and layout; the answer is kept apart."""
    lines = generators.build(family, params, resources)(Stream(f"planted:{source}".encode(), seed), [n for n, _, _ in layout])
    made = Corpus.of(lines, {k for k, x in enumerate(layout) if x[1]}, {k for k, x in enumerate(layout) if x[2]})
    text = "".join(".".join(ws) + "\n" * (1 + (k in made.ends)) for k, ws in enumerate(made.lines))
    return {"text": text, "target": build_target(made, options), "layout": made.layout(), "answer": {"family": family, "params": params, "seed": seed, "source": source}}


def step(unit: dict, target: Target, layout: Layout, checkpoint: dict | None = None, resources: dict | None = None) -> dict:
    """A checkpoint with one more seed done, or the same if all are."""
    validate(unit, target, layout, resources)
    identity = unit_id(unit)
    checkpoint = checkpoint or {"version": CHECKPOINT_SCHEMA, "job_digest": identity, "done": 0, "seeds": []}
    if checkpoint["version"] != CHECKPOINT_SCHEMA or checkpoint["job_digest"] != identity or checkpoint["done"] != len(checkpoint["seeds"]) or checkpoint["done"] > unit["seed_count"]:
        raise Invalid("the checkpoint is of another job")
    if checkpoint["done"] == unit["seed_count"]:
        return checkpoint
    more = seed_result(unit, target, layout, unit["seed_start"] + checkpoint["done"], resources)
    return checkpoint | {"done": checkpoint["done"] + 1, "seeds": [*checkpoint["seeds"], more]}


def finish(unit: dict, target: Target, layout: Layout, checkpoint: dict, resources: dict | None = None) -> dict:
    """The result of a whole checkpoint, its distances computed again."""
    validate(unit, target, layout, resources)
    seeds = checkpoint["seeds"]
    if checkpoint["version"] != CHECKPOINT_SCHEMA or checkpoint["job_digest"] != unit_id(unit) or not checkpoint["done"] == len(seeds) == unit["seed_count"]:
        raise Invalid("the checkpoint is incomplete or of another job")
    for k, s in enumerate(seeds):
        if s["seed"] != unit["seed_start"] + k or len(s["fingerprint"]) != len(NAMES) or target.distance(s["fingerprint"], unit.get("metric", "z")) != s["distance"]:
            raise Invalid("a replicate of the checkpoint differs")
    return result(unit, seeds)


def estimate(kind: str, **size: int) -> int:
    """The work of a unit in thousands of steps: a search's proposals times letters, or a
    simulation's words times its thirty statistics."""
    if kind == "search":
        return -(-size["iterations"] * size["length"] // 1000)
    return -(-size["seeds"] * size["words"] * 30 // 1000)


class Grid:
    """A registered grid: axes by name, whose product is enumerated with the last name fastest."""

    def __init__(self, experiment: str, family: str, axes: dict[str, list], fixed: dict | None = None, replicates: int = 8, metric: str = "z", layout_words: int = 0, integers: Sequence[str] = ()):
        self.experiment, self.family, self.fixed, self.replicates, self.metric = experiment, family, fixed or {}, replicates, metric
        self.axes, self.layout_words, self.integers = dict(sorted(axes.items())), layout_words, list(integers)

    def document(self) -> dict:
        found = {"experiment_id": self.experiment, "family": self.family, "fixed": self.fixed, "axes": self.axes, "replicates": self.replicates, "layout_tokens": self.layout_words}
        return found | ({} if self.metric == "z" else {"metric": self.metric}) | ({"integer_axes": self.integers} if self.integers else {})

    def validated(self) -> "Grid":
        if self.metric not in METRICS or self.family not in generators.FAMILIES:
            raise Invalid("unknown metric or family")
        if not 1 <= self.replicates <= MOST_SEEDS:
            raise Invalid(f"replicates must be 1 to {MOST_SEEDS}")
        if not self.axes or not all(self.axes.values()) or any(isinstance(v, (list, dict)) for values in self.axes.values() for v in values):
            raise Invalid("a grid needs axes, each with plain values")
        if set(self.axes) & set(self.fixed) or not set(self.integers) <= set(self.axes):
            raise Invalid("an axis is fixed too, or an integer axis is none")
        return self

    def __len__(self) -> int:
        return math.prod(map(len, self.axes.values()))

    def point(self, index: int) -> dict:
        found = {}
        for name, values in reversed(self.axes.items()):
            index, k = divmod(index, len(values))
            found[name] = values[k]
        return self.fixed | found

    def points(self) -> list[dict]:
        return [self.point(k) for k in range(len(self))]

    def nearest(self, wanted: dict) -> int | None:
        """The point nearest on each axis, the earlier of equals; other than numbers must be equal.
        None if an axis isn't in `wanted` or has no such value."""
        numeric = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
        index = 0
        for name, values in self.axes.items():
            if name not in wanted:
                return None
            want = wanted[name]
            if numeric(want):
                if not all(map(numeric, values)):
                    return None
                k = min(range(len(values)), key=lambda i: (abs(values[i] - want), i))
            elif want in values:
                k = values.index(want)
            else:
                return None
            index = index * len(values) + k
        return index

    def layout(self, layout: Layout) -> Layout:
        return generators.truncated(list(layout), self.layout_words) if self.layout_words else layout


def tidy(x: float) -> float:
    """To ten decimals, halves away from zero."""
    return math.copysign(math.floor(abs(x) * 1e10 + 0.5), x) / 1e10


class Refinement:
    """From the best point of a grid to the next, finer one around it.

    An axis moves in the range of the first grid. Its step shrinks by a factor each time; an integer
    axis keeps whole steps and stays where it is when they fall below one, as one that isn't numeric
    does from the start.
    """

    def __init__(self, grid: Grid, shrink: float):
        if not 0.0 < shrink < 1.0:
            raise Invalid("the factor must be between 0 and 1")
        self.shrink, self.axes = shrink, {}
        for name, values in grid.axes.items():
            if all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in values):
                whole = name in grid.integers if grid.integers else all(isinstance(v, int) for v in values)
                self.axes[name] = {"low": min(values), "high": max(values), "whole": whole, "step": (max(values) - min(values)) / (len(values) - 1) if len(values) > 1 else 0.0}

    def steps(self) -> dict[str, float]:
        return {name: a["step"] for name, a in self.axes.items()}

    def next(self, grid: Grid, best: dict) -> Grid | None:
        """None when no axis can move."""
        axes = {}
        for name in grid.axes:
            at, axis = best[name], self.axes.get(name)
            if axis is None:
                axes[name] = [at]
                continue
            step = axis["step"] * self.shrink
            if axis["whole"]:
                step = float(math.floor(step + 0.5))
            axis["step"] = step if step >= 1.0 or not axis["whole"] else 0.0
            if axis["step"] <= 0.0:
                axes[name] = [at]
                continue
            near = [min(max(at + k * axis["step"], axis["low"]), axis["high"]) for k in (-1.0, 0.0, 1.0)]
            axes[name] = list(dict.fromkeys(int(math.floor(x + 0.5)) if axis["whole"] else tidy(x) for x in near))
        if all(len(v) < 2 for v in axes.values()):
            return None
        return Grid(grid.experiment, grid.family, axes, grid.fixed, grid.replicates, grid.metric, grid.layout_words, grid.integers)


def ledger_header(grid: Grid, target: Target, layout: Layout, resources: dict | None = None) -> dict:
    return {
        "ledger": LEDGER_SCHEMA, "grid_digest": canonical.identity(grid.document()), "experiment_id": grid.experiment, "family": grid.family, "metric": grid.metric,
        "target_digest": canonical.identity(target.document()), "layout_digest": canonical.identity(layout_document(grid.layout(layout))),
        "resources_digest": None if resources is None else canonical.identity(resources_document(resources)),
        "kernel_version": KERNEL, "numeric_profile": PROFILE, "points": len(grid), "replicates": grid.replicates,
    }


def ledger_lines(header: dict, entries: Sequence[dict]) -> Iterator[str]:
    """The ledger as JSON lines: the header, then the entries by index."""
    yield json.dumps(header)
    for entry in sorted(entries, key=lambda e: e["index"]):
        yield json.dumps(entry)


def read_ledger(lines: Sequence[str]) -> tuple[dict, list[dict]]:
    if not lines:
        raise Invalid("an empty ledger")
    header, *entries = [canonical.loads(line) for line in lines if line.strip()]
    if not str(header.get("ledger")).endswith(LEDGER_SCHEMA):
        raise Invalid(f"unsupported ledger schema {header.get('ledger')}")
    return header, sorted(entries, key=lambda e: e["index"])


def bound(header: dict, grid: Grid, target: Target, layout: Layout, resources: dict | None = None) -> bool:
    """Whether a ledger's header is of these artifacts."""
    own = ledger_header(grid, target, layout, resources)
    return all(header[k] == own[k] for k in ("grid_digest", "metric", "target_digest", "layout_digest", "resources_digest", "points", "replicates"))


#: Fixed value: roles in the order that breaks ties.
ROLES = ("discovery", "validation", "confirmation")


def assign(words: dict[str, Sequence[int]], fractions: dict[str, float]) -> dict[str, str]:
    """A role for each group, from its words by stratum: the largest groups first, each to the role
    whose missing words of all strata it fills best."""
    roles = [r for r in ROLES if r in fractions]
    totals = [sum(c) for c in zip(*words.values())]
    have = {r: [0] * len(totals) for r in roles}
    found = {}
    for group in sorted(words, key=lambda g: (-sum(words[g]), g)):
        filled = lambda r: sum(min(max(fractions[r] * t - h, 0.0), float(w)) for t, h, w in zip(totals, have[r], words[group]))  # noqa: E731, B023
        role = max(roles, key=lambda r: (filled(r), -roles.index(r))) if roles else ROLES[0]
        found[group] = role
        if roles:
            have[role] = [h + w for h, w in zip(have[role], words[group])]
    return found
