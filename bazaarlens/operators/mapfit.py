"""Maximum-a-posteriori fits of the multilevel models, with Laplace standard deviations.

Each Newton step is one Spark job: every partition of the cells adds up its part of the
gradient and of the information matrix, Spark sums the parts entry by entry, and only the
p × p system (p = number of labels, checked against `MAX_PARAMETERS`) is solved on the
driver. The cells are sufficient statistics of all three families, built by JVM sums, so a
step costs the same however many rows stand behind them. Labels reach the cells by a join
with their dictionary. Cells with a NULL label, indicator or outcome take no part.

`certificate` restates the optimum: for every coefficient the outcome total seen in the
cells, and the total the fit explains (fitted part plus the pull of the prior). The two
agree exactly where the penalised gradient is zero.
Results are MAP / Laplace approximations, not posterior draws.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions import expressions as ex
from bazaarlens.session import cut_lineage, ship_by_value

ship_by_value(__name__)

# ---- fixed values: priors of the models ----------------------------------------------
WIDE_BAR, BAR, SLOPE = (0.0, 1.5), (0.0, 1.0), (0.0, 1.0)
LOG_SPEND_BAR, LOG_SUBTOTAL = (4.0, 1.5), (0.5, 0.5)
SCALE_RATE = 1.0        # exponential prior on every scale
GAP_SD = 1.5            # half-normal prior on the gaps between cutpoints
# --------------------------------------------------------------------------------------
MAX_STEPS, SCALE_ROUNDS, TOLERANCE = 40, 30, 1e-4
POLISH_STEPS, FLAT = 30, 1e-6  # last steps at settled scales; a gradient this small counts as zero
MAX_PARAMETERS = 3000  # a system of this size takes 70 MB


@dataclass(frozen=True)
class Fixed:
    """One coefficient on a numeric column, with a normal prior."""

    name: str
    column: str
    prior: tuple[float, float] = SLOPE


@dataclass(frozen=True)
class Slope(Fixed):
    """One coefficient on a column that varies inside a cell; the cells hold its sums."""


@dataclass(frozen=True)
class Factor:
    """One deviation per label of `label`, multiplied by the column `times` (1 if unset).

    Deviations have a common scale; `bar` is the normal prior of their common mean, or None
    for deviations around zero.
    """

    name: str
    label: str
    bar: tuple[float, float] | None = None
    times: str | None = None


@dataclass(frozen=True)
class Model:
    family: str  # binomial (successes of trials), gaussian (sums of y) or ordinal (level_0 … level_K)
    terms: tuple[Fixed | Factor, ...]
    levels: int = 0


@dataclass
class Fit:
    """`parameters` has one row per coefficient, scale and cutpoint, see `FIT_SCHEMA`."""

    coefficients: DataFrame  # term, label, estimate, sd
    parameters: DataFrame
    scales: dict[str, float]
    steps: int
    objective: float
    cutpoints: list[float]
    converged: bool
    pulls: dict[tuple[str, str | None], float]  # prior's pull on each coefficient, (value − mean) / sd²


FIT_SCHEMA = "kind string, term string, label string, estimate double, sd double, steps int, converged boolean"


# ---- the six models ------------------------------------------------------------------
BINOMIAL_NAIVE = Model("binomial", (
    Factor("alpha", "category", WIDE_BAR), Factor("beta_tier", "tier"), Factor("gamma_state", "state"),
    Factor("delta_month", "month"), Factor("tau", "category", WIDE_BAR, "treatment"),
))
BINOMIAL_DID = Model("binomial", (
    Factor("alpha", "category", WIDE_BAR), Fixed("eligible", "eligible"), Fixed("post", "post"),
    Factor("delta", "category", WIDE_BAR, "policy"), Factor("gamma_tier", "tier"), Factor("gamma_state", "state"),
))
REPEAT_NAIVE = Model("binomial", (
    Factor("alpha", "category", BAR), Factor("tau", "category", BAR, "treatment"),
))
REPEAT_DID = Model("binomial", (
    Factor("alpha", "category", BAR), Fixed("eligible", "eligible"), Fixed("post", "post"),
    Factor("delta", "category", BAR, "policy"),
))
SPEND_NAIVE = Model("gaussian", (
    Factor("beta", "category", LOG_SPEND_BAR), Factor("delta", "category", BAR, "treatment"),
    Slope("log_first_subtotal", "log_first_subtotal", LOG_SUBTOTAL),
))
SPEND_DID = Model("gaussian", (
    Factor("beta", "category", LOG_SPEND_BAR), Fixed("eligible", "eligible"), Fixed("post", "post"),
    Factor("delta", "category", BAR, "policy"),
    Slope("log_first_subtotal", "log_first_subtotal", LOG_SUBTOTAL),
))
REVIEW_NAIVE = Model("ordinal", (
    Factor("beta", "category", BAR), Factor("tau", "category", BAR, "treatment"), Factor("gamma_tier", "tier"),
    Factor("delta_month", "month"),
), levels=5)
REVIEW_DID = Model("ordinal", (
    Factor("beta", "category", BAR), Fixed("eligible", "eligible"), Fixed("post", "post"),
    Factor("delta", "category", BAR, "policy"), Factor("gamma_tier", "tier"),
), levels=5)


# ---- cells ---------------------------------------------------------------------------
def binomial_cells(df: DataFrame, success, labels: dict[str, str], indicators: Sequence[str], weight: str | None = None) -> DataFrame:
    """Rows (or finer cells, see `expressions.tally`) → trials and successes per (labels, indicators); `labels` renames columns."""
    trials, hits = ex.tally(success, weight)
    keys = [F.col(source).alias(name) for name, source in labels.items()]
    return df.groupBy(*keys, *indicators).agg(ex.total(trials).alias("trials"), ex.total(hits).alias("successes"))


def ordinal_cells(df: DataFrame, labels: dict[str, str], indicators: Sequence[str], levels: int = 5) -> DataFrame:
    keys = [F.col(source).alias(name) for name, source in labels.items()]
    counts = [F.count_if(F.col("score_index") == k).alias(f"level_{k}") for k in range(levels)]
    return df.groupBy(*keys, *indicators).agg(*counts)


def gaussian_cells(df: DataFrame, y, z, labels: dict[str, str], indicators: Sequence[str]) -> DataFrame:
    """Rows → count and first and second moments of outcome `y` and covariate `z`."""
    keys = [F.col(source).alias(name) for name, source in labels.items()]
    moments = {"n": F.lit(1), "y": y, "yy": y * y, "z": z, "zz": z * z, "zy": z * y}
    known = df.where(y.isNotNull() & z.isNotNull())
    return known.groupBy(*keys, *indicators).agg(*[F.sum(v).alias(f"sum_{k}") for k, v in moments.items()])


def with_policy(cells: DataFrame) -> DataFrame:
    return cells.withColumn("policy", F.col("eligible") * F.col("post"))


# ---- design --------------------------------------------------------------------------
class _Layout:
    """Positions of the parameters and their priors."""

    def __init__(self, model: Model, labels: dict[str, list]):
        self.names: list[tuple[str, str | None]] = []
        self.means: list[float] = []
        self.sds: list[float] = []          # nan = deviation with an estimated scale
        self.blocks: dict[str, slice] = {}
        self.bars: dict[str, int] = {}
        for term in model.terms:
            if isinstance(term, Fixed):
                self._add(term.name, None, *term.prior)
                continue
            if term.bar:
                self.bars[term.name] = self._add(term.name, None, *term.bar)
            start = len(self.names)
            for label in labels[term.label]:
                self._add(term.name, str(label), 0.0, float("nan"))
            self.blocks[term.name] = slice(start, len(self.names))

    def _add(self, name: str, label: str | None, mean: float, sd: float) -> int:
        self.names.append((name, label))
        self.means.append(mean)
        self.sds.append(sd)
        return len(self.names) - 1


MOMENTS = ("n", "y", "yy", "z", "zz", "zy")


def _outcomes(model: Model) -> list[str]:
    return {
        "binomial": ["trials", "successes"],
        "gaussian": [f"sum_{k}" for k in MOMENTS],
        "ordinal": [f"level_{k}" for k in range(model.levels)],
    }[model.family]


def _complete(cells: DataFrame, model: Model) -> DataFrame:
    """The columns the model reads, of cells without a NULL among them."""
    used = [t.label for t in model.terms if isinstance(t, Factor)] + [t.times for t in model.terms if isinstance(t, Factor) and t.times]
    used += [t.column for t in model.terms if isinstance(t, Fixed) and not isinstance(t, Slope)]
    columns = list(dict.fromkeys([*used, *_outcomes(model)]))
    return cells.select(*columns).dropna()


def _dictionary(cells: DataFrame, label: str, values: Sequence, columns: dict[str, Sequence]) -> DataFrame:
    """One row per label, of the label's own type, with further columns."""
    kind = cells.schema[label].dataType.simpleString()
    fields = ", ".join(f"{name} {'int' if isinstance(v[0], int) else 'double'}" for name, v in columns.items())
    return cells.sparkSession.createDataFrame(list(zip(values, *columns.values())), f"{label} {kind}, {fields}")


def _sparse_design(cells: DataFrame, model: Model, layout: _Layout, labels: dict[str, list]) -> DataFrame:
    """Each cell's active parameters `idx` and their multipliers `x`, without the slope."""
    idx, x = [], []
    for label, values in labels.items():
        codes = _dictionary(cells, label, values, {f"{label}_at": list(range(len(values)))})
        cells = cells.join(codes, label)
    for term in model.terms:
        if isinstance(term, Slope):
            continue
        if isinstance(term, Fixed):
            idx.append(F.lit(layout.names.index((term.name, None))))
            x.append(F.col(term.column).cast("double"))
            continue
        times = F.col(term.times).cast("double") if term.times else F.lit(1.0)
        if term.name in layout.bars:
            idx.append(F.lit(layout.bars[term.name]))
            x.append(times)
        idx.append((F.col(f"{term.label}_at") + layout.blocks[term.name].start).cast("int"))
        x.append(times)
    values = F.array(*[F.col(c).cast("double") for c in _outcomes(model)])
    return cells.select(F.array(*idx).alias("idx"), F.array(*x).alias("x"), values.alias("outcome"))


# ---- contributions of a batch of rows ------------------------------------------------
def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * v))


def _binomial(eta, outcome, cuts):
    n, k = outcome[:, 0], outcome[:, 1]
    p = np.clip(_sigmoid(eta), 1e-12, 1 - 1e-12)
    loglik = np.sum(k * np.log(p) + (n - k) * np.log1p(-p))
    return loglik, k - n * p, n * p * (1 - p), None


def _ordinal(eta, outcome, cuts):
    """Cumulative link with P(Y ≤ k) = logistic(cut_k − eta); expected information."""
    upper = _sigmoid(cuts[None, :] - eta[:, None])
    slope = upper * (1 - upper)
    padded = np.hstack([np.zeros((len(eta), 1)), upper, np.ones((len(eta), 1))])
    p = np.clip(np.diff(padded, axis=1), 1e-12, None)
    n = outcome.sum(axis=1)
    loglik = np.sum(outcome * np.log(p))
    score = slope * (outcome[:, :-1] / p[:, :-1] - outcome[:, 1:] / p[:, 1:])
    q = len(cuts)
    info = np.zeros((len(eta), q, q))
    for j in range(q):
        info[:, j, j] = n * slope[:, j] ** 2 * (1 / p[:, j] + 1 / p[:, j + 1])
        if j:
            cross = -n * slope[:, j] * slope[:, j - 1] / p[:, j]
            info[:, j, j - 1] = info[:, j - 1, j] = cross
    return loglik, -score.sum(axis=1), info.sum(axis=(1, 2)), (score, info)


_FAMILIES: dict[str, Callable] = {"binomial": _binomial, "ordinal": _ordinal}


def _gaussian(idx, x, outcome, slope, gradient, information) -> float:
    """Adds the normal equations at zero coefficients, from the cells' moments."""
    n, y, yy, z, zz, zy = outcome.T
    np.add.at(gradient, idx, y[:, None] * x)
    for a in range(idx.shape[1]):
        np.add.at(information, (idx[:, a][:, None], idx), (n * x[:, a])[:, None] * x)
    if slope is not None:
        cross = np.zeros(len(gradient))
        np.add.at(cross, idx, z[:, None] * x)
        information[:, slope] += cross
        information[slope, :] += cross
        information[slope, slope] += zz.sum()
        gradient[slope] += zy.sum()
    return -0.5 * float(yy.sum())


def _contributions(family: str, beta: np.ndarray, cuts: np.ndarray, slope: int | None):
    """Partition → rows (position, value): log-likelihood, gradient, information (upper half)."""
    p, q = len(beta), len(cuts)
    size = p + q

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gradient, information, loglik, seen = np.zeros(size), np.zeros((size, size)), 0.0, False
        for pdf in batches:
            if not len(pdf):
                continue
            seen = True
            idx, x, outcome = (np.vstack(pdf[c].to_numpy()) for c in ("idx", "x", "outcome"))
            if family == "gaussian":
                loglik += _gaussian(idx, x, outcome, slope, gradient, information)
                continue
            eta = (beta[idx] * x).sum(axis=1)
            value, g, w, extra = _FAMILIES[family](eta, outcome, cuts)
            loglik += value
            np.add.at(gradient, idx, g[:, None] * x)
            for a in range(idx.shape[1]):
                np.add.at(information, (idx[:, a][:, None], idx), (w * x[:, a])[:, None] * x)
            if extra is not None:
                score, info = extra
                gradient[p:] += score.sum(axis=0)
                information[p:, p:] += info.sum(axis=0)
                # d cut_k and d eta enter as cut_k − eta
                for j in range(q):
                    cross = np.zeros(p)
                    np.add.at(cross, idx, -info[:, j, :].sum(axis=1)[:, None] * x)
                    information[:p, p + j] += cross
                    information[p + j, :p] += cross
        if seen:
            i, j = np.nonzero(np.triu(information))
            yield pd.DataFrame(
                {
                    "pos": np.concatenate([[-1], np.arange(size), size + i * size + j]).astype("int64"),
                    "value": np.concatenate([[loglik], gradient, information[i, j]]),
                }
            )

    return run, size


def _summed(design: DataFrame, family: str, beta: np.ndarray, cuts: np.ndarray, slope: int | None):
    run, size = _contributions(family, beta, cuts, slope)
    parts = design.mapInPandas(run, "pos long, value double")
    # at most 1 + p + p² rows: one per entry of the system
    total = parts.groupBy("pos").agg(F.sum("value").alias("value")).toPandas()
    flat = np.zeros(1 + size + size * size)
    flat[total["pos"].to_numpy() + 1] = total["value"].to_numpy()
    upper = flat[1 + size :].reshape(size, size)
    return flat[0], flat[1 : 1 + size], upper + np.triu(upper, 1).T


def _scale_mode(squares: float, count: float) -> float:
    """Positive root of rate·σ³ + count·σ² − squares = 0: the scale under its exponential prior."""
    squares, count = max(squares, 1e-12), max(count, 1e-6)
    s = min(np.sqrt(squares / count), (squares / SCALE_RATE) ** (1.0 / 3.0))
    for _ in range(50):
        change = (SCALE_RATE * s**3 + count * s**2 - squares) / (3 * SCALE_RATE * s**2 + 2 * count * s)
        s -= change
        if abs(change) < 1e-10 * s:
            break
    return float(max(s, 1e-4))


def map_fit(cells: DataFrame, model: Model, max_steps: int = MAX_STEPS, tolerance: float = TOLERANCE) -> Fit:
    """Penalised Newton steps with halving; between them updates of the scales."""
    spark = cells.sparkSession
    factors = sorted({t.label for t in model.terms if isinstance(t, Factor)})
    stored = cut_lineage(_complete(cells, model))
    labels = {f: [r[0] for r in stored.select(f).distinct().orderBy(f).limit(MAX_PARAMETERS + 1).collect()] for f in factors}
    layout = _Layout(model, labels)
    if len(layout.names) > MAX_PARAMETERS:
        raise ValueError(f"more than {MAX_PARAMETERS} parameters: pool rare labels first")
    if not all(labels.values()):
        raise ValueError("no complete cell to fit")
    design = cut_lineage(_sparse_design(stored, model, layout, labels))
    slope = next((layout.names.index((t.name, None)) for t in model.terms if isinstance(t, Slope)), None)

    p, q = len(layout.names), max(model.levels - 1, 0)
    mean = np.array(layout.means)
    fixed_sd = np.array(layout.sds)
    beta, cuts = mean.copy(), np.arange(q, dtype=float)
    scales = {name: 1.0 for name in layout.blocks}
    noise = 1.0
    rows = float(stored.agg(F.sum("sum_n")).first()[0]) if model.family == "gaussian" else 0.0
    # the Gaussian system does not depend on beta: one pass gives it for good
    base = _summed(design, model.family, np.zeros(p), cuts, slope) if model.family == "gaussian" else None

    def evaluate(b: np.ndarray, c: np.ndarray):
        """Log-likelihood, gradient and information (for Gaussian rows at unit noise)."""
        if base is None:
            return _summed(design, model.family, b, c, slope)
        value, g0, h0 = base
        return value + g0 @ b - 0.5 * b @ h0 @ b, g0 - h0 @ b, h0

    def precision() -> np.ndarray:
        sd = fixed_sd.copy()
        for name, block in layout.blocks.items():
            sd[block] = scales[name]
        return 1.0 / sd**2

    def penalised(value: float, b: np.ndarray, c: np.ndarray) -> float:
        gaps = np.diff(c) if q else np.zeros(0)
        prior = np.sum(precision() * (b - mean) ** 2) + np.sum((gaps / GAP_SD) ** 2)
        return float(value / noise**2 - 0.5 * prior)

    free = np.r_[np.arange(p), p + np.arange(1, q)] if q else np.arange(p)  # first cutpoint stays 0
    to_gaps = np.diff(np.eye(q), axis=0) if q else np.zeros((0, 0))

    def slopes(state) -> np.ndarray:
        """Gradient of the penalised problem at the current scales."""
        gradient = state[1] / noise**2
        gradient[:p] -= precision() * (beta - mean)
        if q:
            gradient[p:] -= to_gaps.T @ (to_gaps @ cuts) / GAP_SD**2
        return gradient

    def newton(state) -> tuple[np.ndarray, np.ndarray]:
        """Step and inverse information of the penalised problem at the current scales."""
        gradient, information = slopes(state), state[2] / noise**2
        information[np.arange(p), np.arange(p)] += precision()
        if q:
            information[p:, p:] += to_gaps.T @ to_gaps / GAP_SD**2
        inverse = np.linalg.inv(information[np.ix_(free, free)] + 1e-9 * np.eye(len(free)))
        step = np.zeros(p + q)
        step[free] = inverse @ gradient[free]
        return step, inverse[:p, :p]

    def line_search(state, step):
        """The longest halving of `step` that loses nothing: new coefficients, cutpoints, state and distance."""
        current, scale = penalised(state[0], beta, cuts), 1.0
        while True:
            new_beta, new_cuts = beta + scale * step[:p], cuts + scale * step[p:]
            if not q or np.all(np.diff(new_cuts) > 1e-6):
                trial = evaluate(new_beta, new_cuts)
                gained = penalised(trial[0], new_beta, new_cuts) - current
                if gained >= -1e-9 * abs(current) or scale < 1e-4:
                    return new_beta, new_cuts, trial, float(np.max(np.abs(scale * step)))
            scale /= 2.0

    state = evaluate(beta, cuts)
    covariance, steps, settled = np.eye(p), 0, False
    for steps in range(1, max_steps + 1):
        # the scales settle on the local quadratic, without another pass over the cells
        for _ in range(SCALE_ROUNDS):
            step, covariance = newton(state)
            proposal, spread, shifted = beta + step[:p], np.diag(covariance), 0.0
            for name, block in layout.blocks.items():
                # squares over effective labels: the fixed point of EM, reached in fewer rounds
                labels_used = block.stop - block.start - float(np.sum(spread[block])) / scales[name] ** 2
                updated = _scale_mode(float(np.sum(proposal[block] ** 2)), labels_used)
                shifted = max(shifted, abs(np.log(updated / scales[name])))
                scales[name] = updated
            if base is not None:
                residual = max(-2.0 * evaluate(proposal, cuts)[0], 1e-12)
                updated = _scale_mode(residual + float(np.sum(base[2] * covariance)), int(rows))
                shifted, noise = max(shifted, abs(np.log(updated / noise))), updated
            if shifted < 1e-3:
                break
        step, covariance = newton(state)
        beta, cuts, state, moved = line_search(state, step)
        if moved < tolerance:
            settled = True
            break
    # at the scales found, on to the exact optimum: the certificate needs it
    def flat() -> float:
        # rounding errors grow with the totals
        return max(FLAT, 1e-13 * float(np.max(np.abs(state[2]))))

    for _ in range(POLISH_STEPS):
        if np.max(np.abs(slopes(state)[free])) <= flat():
            break
        beta, cuts, state, _ = line_search(state, newton(state)[0])
    covariance = newton(state)[1]
    gradient = slopes(state)
    converged = settled and bool(np.max(np.abs(gradient[free])) <= 1e2 * flat())
    objective = penalised(state[0], beta, cuts)
    if base is not None:
        scales["observation"] = noise
    records = _coefficient_rows(layout, beta, covariance)
    frame = spark.createDataFrame(records, "term string, label string, estimate double, sd double")
    end = (steps, converged)
    everything = [("coefficient", *row, *end) for row in records]
    everything += [("scale", name, None, float(value), None, *end) for name, value in scales.items()]
    everything += [("cutpoint", "cutpoint", str(k), float(v), None, *end) for k, v in enumerate(cuts)]
    pulls = dict(zip(layout.names, (precision() * (beta - mean)).tolist()))
    for name, bar in layout.bars.items():
        pulls[(f"{name}_bar", None)] = pulls.pop(layout.names[bar])
    return Fit(frame, spark.createDataFrame(everything, FIT_SCHEMA), scales, steps, float(objective), cuts.tolist(), converged, pulls)


def _coefficient_rows(layout: _Layout, beta: np.ndarray, covariance: np.ndarray) -> list[tuple]:
    """Bars and slopes as they are; labels as bar + deviation, with the joint variance."""
    rows = []
    for i, (term, label) in enumerate(layout.names):
        bar = layout.bars.get(term)
        if label is None or bar is None:
            name = f"{term}_bar" if bar == i else term
            rows.append((name, label, float(beta[i]), float(np.sqrt(covariance[i, i]))))
            continue
        variance = covariance[i, i] + covariance[bar, bar] + 2 * covariance[i, bar]
        rows.append((term, label, float(beta[i] + beta[bar]), float(np.sqrt(max(variance, 0.0)))))
    return rows


# ---- certificate ---------------------------------------------------------------------
def certificate(cells: DataFrame, model: Model, fit: Fit) -> DataFrame:
    """term, label, observed, explained: outcome totals per coefficient, as seen and as fitted.

    `observed` is the total of x · successes (binomial), x · y (Gaussian) or x · rows
    (ordinal) over the cells, x the coefficient's column; `explained` is the fitted total
    and the prior's pull. Cutpoints have 0 and the gradient itself.
    """
    kept, spark = _complete(cells, model), cells.sparkSession
    found = {(r["term"], r["label"]): r["estimate"] for r in fit.coefficients.collect()}  # p rows
    eta, slope = F.lit(0.0), None
    for number, term in enumerate(model.terms):
        if isinstance(term, Slope):
            slope = term
            continue
        if isinstance(term, Fixed):
            eta = eta + F.lit(found[(term.name, None)]) * F.col(term.column)
            continue
        values = [r[0] for r in kept.select(term.label).distinct().collect()]  # at most p rows
        effect = f"effect_{number}"
        codes = _dictionary(kept, term.label, values, {effect: [found[(term.name, str(v))] for v in values]})
        kept = kept.join(codes, term.label)
        eta = eta + F.col(effect) * (F.col(term.times) if term.times else F.lit(1.0))
    kept = kept.withColumn("eta", eta)

    def sigmoid(v):
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-v))

    weight = 1.0
    if model.family == "binomial":
        seen, fitted = F.col("successes"), F.col("trials") * sigmoid(F.col("eta"))
    elif model.family == "gaussian":
        rate = F.lit(found[(slope.name, None)])
        seen, fitted, weight = F.col("sum_y"), F.col("sum_n") * F.col("eta") + rate * F.col("sum_z"), fit.scales["observation"] ** 2
    else:
        below = [sigmoid(F.lit(c) - F.col("eta")) for c in fit.cutpoints]
        ends = [F.lit(0.0), *below, F.lit(1.0)]
        seen = sum((F.col(c) for c in _outcomes(model)), F.lit(0))
        fitted = sum((F.col(c) * (ends[k] + ends[k + 1]) for k, c in enumerate(_outcomes(model))), F.lit(0.0))
        weight = -1.0
    parts = []

    def part(name, label, x, own_seen=seen, own_fitted=fitted):
        label = label.cast("string") if label is not None else F.lit(None).cast("string")
        values = [(x * v).cast("double") for v in (own_seen, own_fitted)]
        parts.append(F.struct(F.lit(name).alias("term"), label.alias("label"), values[0].alias("observed"), values[1].alias("fitted")))

    for term in model.terms:
        if isinstance(term, Slope):
            part(term.name, None, F.lit(1.0), F.col("sum_zy"), F.col("sum_z") * F.col("eta") + rate * F.col("sum_zz"))
        elif isinstance(term, Fixed):
            part(term.name, None, F.col(term.column))
        else:
            times = F.col(term.times) if term.times else F.lit(1)
            part(term.name, F.col(term.label), times)
            if term.bar:
                part(f"{term.name}_bar", None, times)
    for k in range(1, len(fit.cutpoints)):
        # d log-likelihood / d cut_k, less the pull of the gaps beside it
        slope_k = below[k] * (1 - below[k])
        gradient = slope_k * (F.col(f"level_{k}") / (ends[k + 1] - ends[k]) - F.col(f"level_{k + 1}") / (ends[k + 2] - ends[k + 1]))
        part("cutpoint", F.lit(str(k)), F.lit(1.0), F.lit(0.0), gradient)
    pulls = [(term, label, weight * pull) for (term, label), pull in fit.pulls.items()]
    gaps = np.diff(fit.cutpoints) / GAP_SD**2
    for k in range(1, len(fit.cutpoints)):
        pulls.append(("cutpoint", str(k), float((gaps[k] if k < len(gaps) else 0.0) - gaps[k - 1])))
    pull = spark.createDataFrame(pulls, "term string, label string, pull double")
    sums = kept.select(F.inline(F.array(*parts))).groupBy("term", "label").agg(F.sum("observed").alias("observed"), F.sum("fitted").alias("fitted"))
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"p.{c}")) for c in ("term", "label")]
    return sums.alias("s").join(pull.alias("p"), same[0] & same[1]).select(
        "s.term", "s.label", "observed", (F.col("fitted") + F.col("pull")).alias("explained")
    )
