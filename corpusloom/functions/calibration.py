"""Targets, distances and the rules that replicates of a parameter point are judged by.

All of this is arithmetic over at most a few thousand numbers: vectors of 30 statistics, pools of
replicate distances. It runs on the driver or inside one task; sweeps and targets over tables are
in operators.sweeps.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from .random import Stream
from .textstats import NAMES, VERSION, fingerprint, in_order

#: Fixed value: the normal quantile of the registered interval.
Z = 1.959964
#: A target's scales aren't smaller.
FLOOR = 1e-6


class Invalid(ValueError):
    """A target, unit or panel that can't be used."""


def quantile(ascending: Sequence[float], q: float) -> float:
    """Linear between neighbours; 0 of nothing."""
    if not ascending:
        return 0.0
    at = min(max(q, 0.0), 1.0) * (len(ascending) - 1)
    low = int(at)
    high = min(low + 1, len(ascending) - 1)
    return ascending[low] + (ascending[high] - ascending[low]) * (at - low)


def median(values: Sequence[float]) -> float:
    """The mean of the middle two for an even number; 0 of nothing."""
    xs, n = sorted(values), len(values)
    if not n:
        return 0.0
    return xs[n // 2] if n % 2 else (xs[n // 2 - 1] + xs[n // 2]) / 2.0


def wilson(k: int, n: int, z: float = Z) -> tuple[float, float]:
    """The score interval of k successes in n trials."""
    if not n:
        return 0.0, 1.0
    p, zz = k / n, z * z
    middle, reach = p + zz / (2.0 * n), z * math.sqrt(p * (1.0 - p) / n + zz / (4.0 * n * n))
    return max((middle - reach) / (1.0 + zz / n), 0.0), min((middle + reach) / (1.0 + zz / n), 1.0)


def acceptance(distances: Sequence[float], epsilon: float, level: float = 0.5, z: float = Z) -> dict:
    """Rule A: whether the lower bound of the share of distances up to epsilon is above a level."""
    n, k = len(distances), sum(d <= epsilon for d in distances)
    lower, upper = wilson(k, n, z)
    return {"k": k, "n": n, "p_hat": k / n if n else 0.0, "lower": lower, "upper": upper, "median": median(distances), "compatible": n > 0 and lower > level}


def centroid_test(replicates: Sequence[Sequence[float]], target: Sequence[float], scale: Sequence[float]) -> dict | None:
    """Rule B: the target's distance to the replicates' centroid, ranked among each replicate's
    distance to the centroid of the others. None for fewer than two replicates or unequal lengths."""
    n, size = len(replicates), len(target)
    if n < 2 or not size or len(scale) != size or any(len(r) != size for r in replicates):
        return None
    sums = [in_order(c) for c in zip(*replicates)]
    apart = lambda a, b: math.sqrt(in_order([((x - y) / s) ** 2 for x, y, s in zip(a, b, scale)]) / size)
    own = apart(target, [s / n for s in sums])
    others = [apart(r, [(s - x) / (n - 1) for s, x in zip(sums, r)]) for r in replicates]
    return {"n": n, "r_target": own, "r_replicates_median": median(others), "r_replicates_max": max(others), "p_value": (1 + sum(r >= own for r in others)) / (n + 1)}


def subset_median_quantile(pool: Sequence[float], n: int, q: float = 0.99, draws: int = 2000, seed: int = 1) -> float:
    """Rule C: a quantile of the medians of random subsets of n. A subset is the head of a shuffle
    that goes on from the one before."""
    if not pool or not n:
        return 0.0
    n, pool, rng, medians = min(n, len(pool)), list(pool), Stream(b"subset-median", seed), []
    for _ in range(draws):
        for i in range(n):
            j = i + rng.below(len(pool) - i)
            pool[i], pool[j] = pool[j], pool[i]
        medians.append(median(pool[:n]))
    return quantile(sorted(medians), q)


def subset_medians(pool: Sequence[float], n: int) -> list[tuple[float, int]]:
    """All medians of subsets of an even size n, ascending, each with how many subsets have it."""
    xs, k = sorted(pool), n // 2
    if n % 2 or not 0 < n <= len(xs):
        raise Invalid("subsets must be of an even size up to the pool's")
    counts: dict[float, int] = {}
    # The middle two are at i and j: k - 1 are chosen before i, as many behind j, none between.
    for i in range(k - 1, len(xs) - k):
        for j in range(i + 1, len(xs) - k + 1):
            value = (xs[i] + xs[j]) / 2
            counts[value] = counts.get(value, 0) + math.comb(i, k - 1) * math.comb(len(xs) - 1 - j, k - 1)
    return sorted(counts.items())


def exact_quantile(distribution: Sequence[tuple[float, int]], numerator: int = 99, denominator: int = 100) -> float:
    """The least value that so large a share of all counts doesn't exceed."""
    total, upto = sum(n for _, n in distribution), 0
    for value, n in distribution:
        upto += n
        if upto * denominator >= numerator * total:
            return value
    raise Invalid("an empty distribution has no quantile")


def binomial_tail(n: int, p: float, least: int) -> float:
    """The chance of at least so many successes."""
    return math.fsum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(least, n + 1))


def zero_error_bound(n: int, level: float = 0.05) -> float:
    """The one-sided upper bound of an error rate after n trials without any."""
    return 1.0 - level ** (1.0 / n)


def audit(pool: Sequence[float], threshold: float, sizes: Sequence[int] = (8, 16)) -> dict:
    """For each subset size the exact 0.99 quantile of its medians and the share above a threshold."""
    found = {}
    for n in sizes:
        medians = subset_medians(pool, n)
        found[n] = {"q99": exact_quantile(medians), "above": sum(c for v, c in medians if v > threshold) / sum(c for _, c in medians)}
    return found


def upper_rank(observed: float, simulated: Sequence[float]) -> float:
    """The rank p-value from above."""
    if not math.isfinite(observed) or not simulated or not all(map(math.isfinite, simulated)):
        raise Invalid("a rank test needs finite scores and a panel")
    return (1 + sum(x >= observed for x in simulated)) / (len(simulated) + 1)


def inverse(matrix: Sequence[Sequence[float]]) -> list[list[float]] | None:
    """By elimination with the largest pivot of each column; None if one vanishes or it isn't square."""
    n = len(matrix)
    if not n or any(len(row) != n for row in matrix):
        return None
    rows = [list(map(float, row)) + [float(i == j) for j in range(n)] for i, row in enumerate(matrix)]
    for c in range(n):
        # The first of the largest.
        pivot = max(range(c, n), key=lambda r: (abs(rows[r][c]), -r))
        if abs(rows[pivot][c]) < 1e-300:
            return None
        rows[c], rows[pivot] = rows[pivot], rows[c]
        lead = rows[c][c]
        rows[c] = [x / lead for x in rows[c]]
        for r in range(n):
            if r != c and rows[r][c]:
                by = rows[r][c]
                rows[r] = [x - by * y for x, y in zip(rows[r], rows[c])]
    return [row[n:] for row in rows]


@dataclass(frozen=True)
class Target:
    """What fingerprints are measured against: a mean, scale and weight for each statistic."""

    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weight: tuple[float, ...] = (1.0,) * len(NAMES)
    precision: tuple[tuple[float, ...], ...] | None = None
    names: tuple[str, ...] = NAMES
    version: str = VERSION

    @staticmethod
    def of(document: dict) -> "Target":
        """From JSON: the target itself, or a file that holds it beside its provenance."""
        document = document.get("target", document)
        tuples = {k: tuple(document[k]) for k in ("names", "mean", "scale", "weight")}
        precision = document.get("precision")
        return Target(**tuples, precision=precision and tuple(map(tuple, precision)), version=document["version"])

    def document(self) -> dict:
        found = {"version": self.version, "names": list(self.names), "mean": list(self.mean), "scale": list(self.scale), "weight": list(self.weight)}
        return found | ({"precision": [list(row) for row in self.precision]} if self.precision else {})

    def validated(self) -> "Target":
        n = len(NAMES)
        if self.names != NAMES or not len(self.mean) == len(self.scale) == len(self.weight) == n:
            raise Invalid("target vectors have other names or lengths")
        if not all(map(math.isfinite, (*self.mean, *self.scale, *self.weight))):
            raise Invalid("a target's value isn't finite")
        if min(self.scale) <= 0 or min(self.weight) < 0 or sum(self.weight) <= 0:
            raise Invalid("scales must be positive, weights not negative and not all zero")
        if self.precision is not None and (len(self.precision) != n or any(len(row) != n or not all(map(math.isfinite, row)) for row in self.precision)):
            raise Invalid("the precision matrix has another shape or a value that isn't finite")
        return self

    def residuals(self, values: Sequence[float], version: str = VERSION) -> list[float]:
        self.validated()
        if version != self.version:
            raise Invalid(f"fingerprint version {version} isn't the target's {self.version}")
        if len(values) != len(self.mean) or not all(map(math.isfinite, values)):
            raise Invalid("a fingerprint of another length or with a value that isn't finite")
        return [(v - m) / s for v, m, s in zip(values, self.mean, self.scale)]

    def distance(self, values: Sequence[float], metric: str = "z", version: str = VERSION) -> float:
        """`z`: the weighted root mean square of the residuals. `mahalanobis`: that under the
        precision matrix, which leaves the weights aside."""
        if metric not in METRICS:
            raise Invalid(f"unknown metric {metric}")
        found = METRICS[metric](self, self.residuals(values, version))
        if not math.isfinite(found):
            raise Invalid("the distance isn't finite")
        return found


def _z(target: Target, residuals: list[float]) -> float:
    return math.sqrt(in_order([w * z * z for w, z in zip(target.weight, residuals)]) / in_order(target.weight))


def _mahalanobis(target: Target, residuals: list[float]) -> float:
    if target.precision is None:
        raise Invalid("the target has no precision matrix")
    total = in_order([z * in_order([p * y for p, y in zip(row, residuals)]) for z, row in zip(residuals, target.precision)])
    return math.sqrt(max(total, 0.0) / len(residuals))


#: The registry of metrics. Another one is registered by adding it here.
METRICS = {"z": _z, "mahalanobis": _mahalanobis}


@dataclass(frozen=True)
class Corpus:
    """A small corpus in memory: lines with the flags of their paragraphs."""

    lines: tuple[tuple[str, ...], ...]
    starts: frozenset[int] = frozenset()
    ends: frozenset[int] = field(default_factory=frozenset)

    @staticmethod
    def of(lines: Sequence[Sequence[str]], starts=(), ends=()) -> "Corpus":
        return Corpus(tuple(map(tuple, lines)), frozenset(starts), frozenset(ends))

    @property
    def words(self) -> int:
        return sum(map(len, self.lines))

    def values(self) -> list[float]:
        return fingerprint(self.lines, self.starts)

    def layout(self) -> list[tuple[int, bool, bool]]:
        return [(len(ws), k in self.starts, k in self.ends) for k, ws in enumerate(self.lines) if ws]

    def blocks(self) -> list[tuple[int, int]]:
        """Paragraphs as (first line, line behind the last): cut before a start and behind an end."""
        cuts = sorted({0, len(self.lines)} | {k for k in self.starts} | {k + 1 for k in self.ends})
        return [(a, b) for a, b in zip(cuts, cuts[1:]) if a < len(self.lines)]

    def gathered(self, blocks: Sequence[tuple[int, int]]) -> "Corpus":
        places = [k for a, b in blocks for k in range(a, b)]
        return Corpus(tuple(self.lines[k] for k in places), frozenset(i for i, k in enumerate(places) if k in self.starts), frozenset(i for i, k in enumerate(places) if k in self.ends))

    def resampled(self, rng: Stream) -> "Corpus":
        """Paragraphs drawn with replacement until there are at least as many words."""
        blocks, drawn, words, wanted = self.blocks(), [], 0, self.words
        while blocks and words < wanted:
            a, b = blocks[rng.below(len(blocks))]
            drawn.append((a, b))
            words += sum(map(len, self.lines[a:b]))
        return self.gathered(drawn)

    def subsampled(self, fraction: float, rng: Stream) -> "Corpus":
        """Paragraphs in a random order, without replacement, up to a share of the words."""
        order, drawn, words, wanted = self.blocks(), [], 0, int(self.words * fraction)
        rng.shuffle(order)
        for a, b in order:
            if words >= wanted:
                break
            drawn.append((a, b))
            words += sum(map(len, self.lines[a:b]))
        return self.gathered(drawn)


@dataclass(frozen=True)
class TargetOptions:
    """How a target's scale is found: `block-bootstrap`, or `subsample` of a `fraction` of the words,
    whose spread is corrected for its size. With `covariance_lambda` the target gets a precision
    matrix: the inverse of the residuals' covariance, mixed with that much of the identity."""

    resamples: int = 200
    seed: int = 1
    method: str = "block-bootstrap"
    fraction: float = 1.0
    covariance_lambda: float | None = None


def samples(corpus: Corpus, options: TargetOptions) -> list[list[float]]:
    """The fingerprints of a corpus's resamples."""
    if options.method not in ("block-bootstrap", "subsample"):
        raise Invalid(f"unknown scale method {options.method}")
    if options.method == "subsample" and not 0.0 < options.fraction < 1.0:
        raise Invalid("the subsample's fraction must be between 0 and 1")
    if not corpus.blocks():
        return []
    if options.method == "subsample":
        rng = Stream(b"subsample", options.seed)
        return [corpus.subsampled(options.fraction, rng).values() for _ in range(options.resamples)]
    rng = Stream(b"bootstrap", options.seed)
    return [corpus.resampled(rng).values() for _ in range(options.resamples)]


def target_of(mean: Sequence[float], drawn: Sequence[Sequence[float]], options: TargetOptions) -> Target:
    """A target from a corpus's own values and those of its resamples."""
    n, m = len(mean), len(drawn)
    correction = math.sqrt(options.fraction / (1.0 - options.fraction)) if options.method == "subsample" else 1.0
    means, scale = [0.0] * n, [1.0] * n
    if m > 1:
        means = [in_order(c) / m for c in zip(*drawn)]
        scale = [max(math.sqrt(in_order([(x - a) ** 2 for x in c]) / m) * correction, FLOOR) for c, a in zip(zip(*drawn), means)]
    precision = None
    if (mix := options.covariance_lambda) is not None:
        if not 0.0 <= mix <= 1.0 or m < 2:
            raise Invalid("a covariance needs a share in [0, 1] and two resamples")
        z = [[(x - a) * correction / s for x, a, s in zip(row, means, scale)] for row in drawn]
        covariance = [[(1.0 - mix) * in_order([r[i] * r[j] for r in z]) / m + (mix if i == j else 0.0) for j in range(n)] for i in range(n)]
        precision = inverse(covariance)
        if precision is None:
            raise Invalid("the regularised covariance is singular; raise covariance_lambda")
        precision = tuple(map(tuple, precision))
    return Target(tuple(mean), tuple(scale), (1.0,) * n, precision)


def build_target(corpus: Corpus, options: TargetOptions) -> Target:
    return target_of(corpus.values(), samples(corpus, options), options)


def build_simple_target(corpus: Corpus, resamples: int, seed: int) -> Target:
    """A target whose scale comes from sums and sums of squares, as the first registered ones do."""
    drawn = samples(corpus, TargetOptions(resamples, seed))
    scale, m = [1.0] * len(NAMES), len(drawn)
    if m > 1:
        scale = [max(math.sqrt(max(in_order([x * x for x in c]) / m - (in_order(c) / m) ** 2, 0.0)), FLOOR) for c in zip(*drawn)]
    return Target(tuple(corpus.values()), tuple(scale))


def conditional_target(corpus: Corpus, options: TargetOptions) -> Target:
    """A target that leaves the line length aside, which the layout gives."""
    if options.covariance_lambda is not None:
        raise Invalid("the conditional test takes the weighted z metric only")
    return replace(build_target(corpus, options), weight=tuple(float(n != "line_len_mean") for n in NAMES)).validated()


def self_distances(corpus: Corpus, target: Target, resamples: int, seed: int) -> list[float]:
    """Distances of a corpus's own resamples: the spread that its true generator would show."""
    rng = Stream(b"bootstrap-distance", seed)
    return [target.distance(corpus.resampled(rng).values()) for _ in range(resamples)]


def spread(distances: Sequence[float]) -> dict:
    xs = sorted(distances)
    return {f"q{round(100 * q)}": quantile(xs, q) for q in (0.5, 0.9, 0.95, 0.99)} | {"min": xs[0] if xs else 0.0, "max": xs[-1] if xs else 0.0}
