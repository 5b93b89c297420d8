"""Learning context states: EM, conditional random fields by SGD and HMC, self-organising maps, parameter search.

Sums over data are DataFrame aggregations or per-partition partial sums of parameter size; the driver
holds parameters only (states * (1 + width * size + size) numbers), never rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import TINY, window_weights
from . import contexts

# --- EM -------------------------------------------------------------------------------------


#: Numbers of windows times (letters + states) that a task multiplies at a time.
EM_VALUES = 4_000_000


def gathered_windows(windows: DataFrame) -> DataFrame:
    """wid, cells (j, a, v): windows (wid, j, a, v) as one row each, so that a round is a pass without exchange of rows."""
    return windows.groupBy("wid").agg(F.collect_list(F.struct(F.col("j").cast("int").alias("j"), F.col("a").cast("int").alias("a"), F.col("v").cast("double").alias("v"))).alias("cells"))


@dataclass
class Mixture:
    """Parameters of context states on the driver: p (K, W, A), prior (K), background (A) and weights (W), with the ids of each axis."""

    p: np.ndarray
    prior: np.ndarray
    background: np.ndarray
    weights: np.ndarray
    ids: tuple[np.ndarray, np.ndarray, np.ndarray]

    @classmethod
    def of(cls, model: DataFrame, prior: DataFrame, background: DataFrame, weights: DataFrame) -> "Mixture":
        m, s, b, w = (t.toPandas() for t in (model.select("k", "j", "a", "p"), prior.select("k", "prior"), background.select("a", "p"), weights.select("j", "w")))
        ids = tuple(np.unique(m[c].to_numpy()) for c in ("k", "j", "a"))
        p = np.zeros([len(x) for x in ids])
        p[tuple(np.searchsorted(x, m[c].to_numpy()) for x, c in zip(ids, ("k", "j", "a"), strict=True))] = m["p"].to_numpy()
        ordered = [t.set_index(c)[v].loc[x].to_numpy(float) for t, c, v, x in ((s, "k", "prior", ids[0]), (b, "a", "p", ids[2]), (w, "j", "w", ids[1]))]
        return cls(p, *ordered, ids)

    def frames(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """(k, j, a, p) and (k, prior)."""
        import pyarrow as pa

        k, j, a = (x.astype(np.int32) for x in self.ids)
        cells = [np.repeat(k, len(j) * len(a)), np.tile(np.repeat(j, len(a)), len(k)), np.tile(a, len(k) * len(j)), self.p.ravel()]
        return spark.createDataFrame(pa.table(dict(zip(("k", "j", "a", "p"), cells, strict=True)))), spark.createDataFrame(pa.table({"k": k, "prior": self.prior}))


def em_sums(cells: DataFrame, m: Mixture) -> DataFrame:
    """state, cell, n: sums of the E step over windows that have a known letter, formed in the tasks.

    Each task sends numbers of parameter size only: by state and cell (j * A + a) the weighted posteriors, with cell -1 the
    posteriors, and with state -1 the windows (cell 0) and their log evidence (cell 1).
    """
    n_k, n_j, n_a = m.p.shape
    with np.errstate(divide="ignore"):
        table = ((np.log(m.p) - np.log(m.background)) * m.weights[:, None]).reshape(n_k, -1).T.copy()
        lprior = np.log(m.prior)
    table, lprior = np.maximum(table, -1e300), np.maximum(lprior, -1e300)  # what is impossible stays so without 0 * inf
    js, letters, size = m.ids[1], m.ids[2], n_j * n_a

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        stats, total, seen, lse = np.zeros((size, n_k)), np.zeros(n_k), 0, 0.0
        step = max(1, EM_VALUES // (size + n_k))
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                own = batch.column(0).slice(lo, step)
                flat, count = pc.list_flatten(own), pc.list_value_length(own).to_numpy(zero_copy_only=False)
                j, a, v = (pc.struct_field(flat, c).to_numpy(zero_copy_only=False) for c in ("j", "a", "v"))
                row = np.repeat(np.arange(len(count)), count)
                x, y = np.minimum(np.searchsorted(js, j), n_j - 1), np.minimum(np.searchsorted(letters, a), n_a - 1)
                known = (js[x] == j) & (letters[y] == a)
                counts = np.zeros((len(count), size))
                np.add.at(counts, (row[known], (x * n_a + y)[known]), v[known])
                counts = counts[np.bincount(row[known], minlength=len(count)) > 0]
                s = counts @ table + lprior
                top = s.max(1, keepdims=True)
                e = np.exp(s - top)
                z = e.sum(1, keepdims=True)
                e /= z
                stats += counts.T @ e
                total += e.sum(0)
                seen += len(counts)
                lse += float((top + np.log(z)).sum())
        states = np.arange(n_k, dtype=np.int32)
        state = np.concatenate([np.tile(states, size), states, [-1, -1]]).astype(np.int32)
        cell = np.concatenate([np.repeat(np.arange(size), n_k), np.full(n_k, -1), [0, 1]]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(state), pa.array(cell), pa.array(np.concatenate([stats.ravel(), total, [seen, lse]]))], ["state", "cell", "n"])

    return cells.select("cells").mapInArrow(run, "state int, cell int, n double").groupBy("state", "cell").agg(F.sum("n").alias("n"))


def em_round(cells: DataFrame, m: Mixture, pca: float) -> tuple[Mixture, float | None]:
    """One E and M step over gathered windows, and the likelihood before it; without a window the parameters stay as they are."""
    t = em_sums(cells, m).toArrow()
    state, cell, n = (t.column(c).to_numpy() for c in ("state", "cell", "n"))
    n_k, n_j, n_a = m.p.shape
    seen, lse = (float(n[(state == -1) & (cell == c)].sum()) for c in (0, 1))
    if not seen:
        return m, None
    stats, total = np.zeros((n_k, n_j * n_a)), np.zeros(n_k)
    own = (state >= 0) & (cell >= 0)
    stats[state[own], cell[own]] = n[own]
    own = (state >= 0) & (cell == -1)
    total[state[own]] = n[own]
    p = stats.reshape(m.p.shape) + pca * m.background
    return Mixture(p / p.sum(2, keepdims=True), total / total.sum(), m.background, m.weights, m.ids), lse / seen / float(m.weights.sum())


def em_step(windows: DataFrame, model: DataFrame, prior: DataFrame, background: DataFrame, weights: DataFrame, pca: float = 0.01) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One E and M step: (k, j, a, p), (k, prior), one row with ll (null without windows).

    windows (wid, j, a, v): counts of each window. ll is the mean log evidence per weighted column, with
    the background taken off. The model's statistics start from pca * background. The step runs at the call, in one pass.
    """
    spark = windows.sparkSession
    m, ll = em_round(gathered_windows(windows), Mixture.of(model, prior, background, weights), pca)
    return *m.frames(spark), spark.createDataFrame([(ll,)], "ll double")


def em(windows: DataFrame, model: DataFrame, prior: DataFrame, background: DataFrame, weights: DataFrame, pca: float = 0.01, tolerance: float = 1e-4, most: int = 100) -> tuple[DataFrame, DataFrame, list[float]]:
    """EM until the gain is at most the tolerance. Windows are gathered once; each round is one pass over them."""
    m, lls = Mixture.of(model, prior, background, weights), []
    cells = gathered_windows(windows).checkpoint()
    for _ in range(most):
        m, ll = em_round(cells, m, pca)
        if ll is None:
            break
        lls.append(ll)
        if len(lls) > 1 and lls[-1] - lls[-2] <= tolerance:
            break
    return *m.frames(windows.sparkSession), lls


def blended(old: DataFrame, new: DataFrame, eta: float, keys: list[str], v: str = "p") -> DataFrame:
    """(1 - eta) * old + eta * new: the update of block-wise EM."""
    return old.join(new.withColumnRenamed(v, "_n"), keys).select(*keys, ((F.lit(1.0 - eta)) * F.col(v) + F.lit(float(eta)) * F.col("_n")).alias(v))


# --- Conditional models -------------------------------------------------------------------------


@dataclass
class Crf:
    """bias (K), context weights (K, W, A) and emission weights (K, A)."""

    bias: np.ndarray
    cw: np.ndarray
    pcw: np.ndarray

    @classmethod
    def gaussian(cls, k: int, w: int, a: int, sigma: float = 0.2, seed: int = 0) -> "Crf":
        r = np.random.default_rng(seed)
        return cls(r.normal(0, sigma, k), r.normal(0, sigma, (k, w, a)), r.normal(0, sigma, (k, a)))

    def vector(self) -> np.ndarray:
        return np.concatenate([self.bias, self.cw.ravel(), self.pcw.ravel()])

    def with_vector(self, v: np.ndarray) -> "Crf":
        k, w, a = self.cw.shape
        return Crf(v[:k], v[k : k + k * w * a].reshape(k, w, a), v[k + k * w * a :].reshape(k, a))

    def emissions(self) -> np.ndarray:
        e = np.exp(self.pcw - self.pcw.max(1, keepdims=True))
        return np.maximum(e / e.sum(1, keepdims=True), TINY)

    def distance(self, other: "Crf") -> float:
        return float(np.linalg.norm(self.vector() - other.vector()))

    def shrunk(self, k: int) -> "Crf":
        """The k states of the largest bias, in their order."""
        keep = np.sort(np.argsort(-self.bias, kind="stable")[:k])
        return Crf(self.bias[keep], self.cw[keep], self.pcw[keep])


def crf_batch(model: Crf, x: np.ndarray, y: np.ndarray, background: np.ndarray) -> tuple[float, np.ndarray]:
    """Log-likelihood and gradient of windows x (n, W) of codes (A: any letter) and targets y (n, A)."""
    k, w, a = model.cw.shape
    wide = np.concatenate([model.cw, np.zeros((k, w, 1))], 2)
    s = model.bias + sum(wide[:, j, x[:, j]].T for j in range(w))
    s = np.exp(s - s.max(1, keepdims=True))
    pp = s / s.sum(1, keepdims=True) + TINY
    pc = model.emissions()
    pa = pp @ pc
    ll = float((y * (np.log(pa) - np.log(background))).sum())
    ratio = y / pa
    fit = ratio @ pc.T - y.sum(1, keepdims=True)
    g = pp * fit
    cw = np.zeros((k, w, a + 1))
    for j in range(w):
        hot = np.eye(a + 1)[x[:, j]]
        cw[:, j] = g.T @ hot
    pcw = pc * (pp.T @ ratio) - pc * (pp * (ratio @ pc.T)).sum(0)[:, None]
    return ll, np.concatenate([g.sum(0), cw[:, :, :a].ravel(), pcw.ravel()])


def crf_gradient(train: DataFrame, model: Crf, background: np.ndarray) -> tuple[float, np.ndarray]:
    """Over rows (x array of codes, y array of shares): partial sums of each task, added by Spark."""

    def run(it):
        import pandas as pd

        total, grad = 0.0, np.zeros(len(model.vector()))
        for pdf in it:
            if len(pdf):
                ll, g = crf_batch(model, np.stack(pdf["x"].to_numpy()).astype(int), np.stack(pdf["y"].to_numpy()).astype(float), background)
                total, grad = total + ll, grad + g
        yield pd.DataFrame({"i": np.arange(-1, len(grad)), "v": np.append(total, grad)})

    rows = train.select("x", "y").mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(model.vector()) + 1)
    for r in rows:
        out[r["i"] + 1] = r["v"]
    return float(out[0]), out[1:]


def likelihood_terms(pp: DataFrame, central: DataFrame, y: DataFrame, background: DataFrame) -> DataFrame:
    """ll of targets (id, pos, a, y) under posteriors and central columns, by joins."""
    pa = contexts.predicted(pp, central).withColumnRenamed("p", "pa")
    return y.join(pa, ["id", "pos", "a"]).join(background.select("a", F.col("p").alias("bg")), "a").agg(F.sum(F.col("y") * (F.ln("pa") - F.ln("bg"))).alias("ll"))


def fit_terms(pp: DataFrame, central: DataFrame, y: DataFrame) -> DataFrame:
    """id, pos, k, g: posterior times the gain of the state, the factor of all gradients of a window."""
    pa = contexts.predicted(pp, central).withColumnRenamed("p", "pa")
    part = y.join(pa, ["id", "pos", "a"]).join(central.select("k", "a", F.col("p").alias("pc")), "a")
    fit = part.groupBy("id", "pos", "k").agg(F.sum(F.col("y") * (F.col("pc") / F.col("pa") - F.lit(1.0))).alias("fit"))
    return pp.join(fit, ["id", "pos", "k"]).select("id", "pos", "k", (F.col("pp") * F.col("fit")).alias("g"))


def bias_gradient(fit: DataFrame) -> DataFrame:
    return fit.groupBy("k").agg(F.sum("g").alias("g"))


def context_gradient(fit: DataFrame, cells: DataFrame, width: int, size: int) -> DataFrame:
    """k, j, a, g over sequence windows; any letter is left out."""
    w = contexts.windows(cells.filter(F.col("a") < size), width)
    return fit.join(w, ["id", "pos"]).groupBy("k", "j", "a").agg(F.sum("g").alias("g"))


@dataclass
class Prior:
    """Log prior and gradient of a model: gauss, lasso or unsymmetric, with a penalty on columns that are no distributions."""

    kind: str = "gauss"
    sigma_bias: float = 1.0
    sigma_context: float = 0.2
    sigma_decay: float = 0.9
    sigma_pc_max: float = 1.0
    sigma_neg: float = 1.0
    sigma_pos: float = 0.2
    penalty: float = 0.0

    def __call__(self, m: Crf) -> tuple[float, np.ndarray]:
        k, w, a = m.cw.shape
        c = (w - 1) // 2
        decay = self.sigma_decay ** np.abs(np.arange(w) - c)
        sj = (self.sigma_context * decay)[None, :, None]
        centred = m.pcw - m.cw[:, c] / self.sigma_context
        if self.kind == "gauss":
            value = -(m.bias**2).sum() / (2 * self.sigma_bias**2) - (m.cw**2 / (2 * sj**2)).sum()
            gb, gc = -m.bias / self.sigma_bias**2, -m.cw / sj**2
        elif self.kind == "lasso":
            value = -np.abs(m.bias).sum() / self.sigma_bias - (np.abs(m.cw) / sj).sum()
            gb, gc = -np.sign(m.bias) / self.sigma_bias, -np.sign(m.cw) / sj
        else:
            scale = np.where(m.cw < 0, self.sigma_neg, self.sigma_pos) * decay[None, :, None]
            value = -np.abs(m.bias).sum() / self.sigma_bias - (np.abs(m.cw) / scale).sum()
            gb, gc = -np.sign(m.bias) / self.sigma_bias, -np.sign(m.cw) / scale
        value -= (centred**2).sum() / (2 * self.sigma_pc_max**2)
        gp = -centred / self.sigma_pc_max**2  # the coupling with the central context weights is left out, as specified
        if self.penalty:
            e = np.exp(m.cw / sj)
            off = e.sum(2, keepdims=True) - 1
            value -= self.penalty * np.abs(off).sum()
            gc = gc - self.penalty * np.sign(off) * e / sj
        return float(value), np.concatenate([gb, gc.ravel(), gp.ravel()])


@dataclass
class SgdParams:
    blocks: int = 10
    eta: float = 0.001
    decay: float = 2.0
    rate: str = "harmonic"
    mu: float = 0.02
    rho: float = 0.5
    eta_max: float = 0.1
    gamma: float = 0.9
    most_epochs: int = 150
    least_epochs: int = 2
    tolerance: float = 1e-3
    early_delta: float = 0.01
    patience: int = 5
    most_step: float = 1000.0
    history: list = field(default_factory=list)


def with_blocks(train: DataFrame, blocks: int, key: list[str], seed: int = 0) -> DataFrame:
    """A block number for each row from a hash rank: contiguous shares of a reproducible shuffle."""
    return train.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(blocks)).cast("int"))


def sgd(train: DataFrame, validate: DataFrame, model: Crf, background: np.ndarray, prior: Prior, p: SgdParams, key: list[str]) -> tuple[Crf, list[float]]:
    """Block-wise gradient ascent; the best model on the validation rows is returned, and their log-likelihood by epoch.

    One job a block; rows are dealt into blocks once.
    """
    data, v = with_blocks(train, p.blocks, key).checkpoint(), model.vector()
    n, steps = data.count(), 0
    f = (p.decay - 1) * n / (1e6 * p.blocks)
    eta, last, avg = np.full(len(v), p.eta), np.zeros(len(v)), np.zeros(len(v))
    best, best_ll, lls, calm, bumps = model, -np.inf, [], 0, 0
    for epoch in range(p.most_epochs):
        for b in range(p.blocks):
            m = model.with_vector(v)
            _, g = crf_gradient(data.filter(F.col("block") == b), m, background)
            g = g + prior(m)[1] / p.blocks
            if p.rate == "harmonic":
                eta = np.full(len(v), p.eta / (steps * f + 1))
            elif steps:
                avg = p.gamma * avg + (1 - p.gamma) * g**2
                eta = np.minimum(p.eta_max, eta * np.maximum(p.rho, 1 + p.mu * g * last / np.maximum(avg, TINY)))
            step = eta * g
            top = np.abs(step).max()
            v = v + (step * p.most_step / top if top > p.most_step else step)
            last, steps = g, steps + 1
        ll, _ = crf_gradient(validate, model.with_vector(v), background)
        gain = ll - lls[-1] if lls else np.inf
        lls.append(ll)
        if ll > best_ll:
            best, best_ll = model.with_vector(v), ll
        calm = calm + 1 if gain <= p.tolerance else 0
        bumps = bumps + 1 if ll < best_ll - p.early_delta else 0
        if epoch + 1 >= p.least_epochs and (calm >= p.patience or bumps >= p.patience):
            break
    return best, lls


@dataclass
class HmcParams:
    steps: int = 100
    leapfrog: int = 100
    epsilon: float = 1e-3
    up: float = 1.05
    down: float = 0.8
    alpha: float = 1.3
    temperature: float = 1.0


def hmc_step(train: DataFrame, model: Crf, background: np.ndarray, prior: Prior, p: HmcParams, epsilon: float, temperature: float, rng) -> tuple[Crf, float, float, bool]:
    """One leapfrog trajectory and Metropolis decision: (model, ll, next epsilon, accepted)."""

    def energy(m):
        ll, g = crf_gradient(train, m, background)
        pv, pg = prior(m)
        return ll, -ll / temperature - pv, g / temperature + pg

    v, mom = model.vector(), rng.normal(size=len(model.vector()))
    ll0, e, g = energy(model)
    h0 = e + 0.5 * mom @ mom
    for _ in range(p.leapfrog):
        mom = mom + 0.5 * epsilon * g
        v = v + epsilon * mom
        ll, e, g = energy(model.with_vector(v))
        mom = mom + 0.5 * epsilon * g
    ok = bool(np.log(rng.random()) < h0 - (e + 0.5 * mom @ mom))
    return (model.with_vector(v), ll, epsilon * p.up, True) if ok else (model, ll0, epsilon * p.down, False)


def hmc(train: DataFrame, model: Crf, background: np.ndarray, prior: Prior, p: HmcParams, replicas: int = 1, seed: int = 0, sort_exchange: bool = False) -> tuple[Crf, list[float]]:
    """Hamiltonian sampling with parallel tempering: replica r has temperature T * alpha ** r; neighbours may swap."""
    rng = np.random.default_rng(seed)
    models, eps, lls = [model] * replicas, [p.epsilon] * replicas, [0.0] * replicas
    best, trace = (model, -np.inf), []
    for _ in range(p.steps):
        for r in range(replicas):
            models[r], lls[r], eps[r], _ = hmc_step(train, models[r], background, prior, p, eps[r], p.temperature * p.alpha**r, rng)
            if lls[r] > best[1]:
                best = (models[r], lls[r])
        if sort_exchange:
            order = np.argsort([-x for x in lls], kind="stable")
            models, lls = [models[i] for i in order], [lls[i] for i in order]
        elif replicas > 1:
            i = int(rng.integers(replicas - 1))
            t = [p.temperature * p.alpha**x for x in (i, i + 1)]
            if np.log(rng.random()) < (lls[i + 1] - lls[i]) * (1 / t[0] - 1 / t[1]):
                models[i], models[i + 1], lls[i], lls[i + 1] = models[i + 1], models[i], lls[i + 1], lls[i]
        trace.append(lls[0])
    return best[0], trace


def basin_hop(train: DataFrame, validate: DataFrame, model: Crf, background: np.ndarray, prior: Prior, p: HmcParams, s: SgdParams, key: list[str], rng) -> tuple[Crf, float, bool]:
    """A trajectory followed by gradient ascent, accepted by the likelihood of where it ends."""
    moved, _, _, _ = hmc_step(train, model, background, prior, p, p.epsilon, p.temperature, rng)
    settled, _ = sgd(train, validate, moved, background, prior, s, key)
    a, b = crf_gradient(train, model, background)[0], crf_gradient(train, settled, background)[0]
    ok = bool(np.log(rng.random()) < (b - a) / p.temperature)
    return (settled, b, True) if ok else (model, a, False)


# --- Maps, search ----------------------------------------------------------------------------


def som(library: np.ndarray, prior: np.ndarray, background: np.ndarray, side: int, steps: int, weights: list[float] | None = None, sigma: float = 5.0, alpha: float = 0.1, tau1: float | None = None, tau2: float | None = None, seed: int = 0) -> np.ndarray:
    """An online map of side ** 3 cells over states (K, W, A): cells move towards drawn states by lattice distance."""
    rng = np.random.default_rng(seed)
    k, w, a = library.shape
    wj = np.array(weights or window_weights(w))
    cells = library[rng.integers(k, size=side**3)].copy()
    at = np.stack(np.unravel_index(np.arange(side**3), (side,) * 3), 1)
    t1, t2 = tau1 or steps / max(np.log(sigma), 1e-9), tau2 or steps
    for n in range(steps):
        x = library[rng.choice(k, p=prior / prior.sum())]
        best = int(np.argmax((wj * np.log((cells * x / background).sum(2))).sum(1)))
        h = np.exp(-((at - at[best]) ** 2).sum(1) / (2 * (sigma * np.exp(-n / t1)) ** 2))
        cells += (alpha * np.exp(-n / t2) * h)[:, None, None] * (x - cells)
    return cells


def lattice_colours(best: DataFrame, side: int, offset: float = 0.2) -> DataFrame:
    """k, l and the red, green, blue of the lattice cell l (red slowest)."""
    channel = lambda c: F.lit(offset) + F.lit(1.0 - offset) * (c + F.lit(1)) / F.lit(float(side))
    r, g, b = F.floor(F.col("l") / (side * side)), F.floor(F.col("l") / side) % side, F.col("l") % side
    return best.select("k", "l", channel(r).alias("r"), channel(g).alias("g"), channel(b).alias("b"))


def best_match(scores: DataFrame) -> DataFrame:
    """k, l: the cell of the highest score; ties go to the lowest."""
    return scores.groupBy("k").agg((-F.max(F.struct("score", (-F.col("l")).alias("m")))["m"]).alias("l"))


def coordinate_search(metric, start: dict[str, float], steps: dict[str, tuple[str, float]], rounds: int = 2, most: int = 20) -> tuple[dict[str, float], float]:
    """Maximises metric(parameters) one parameter at a time: brackets by additive or multiplicative steps, then a parabola."""
    best, top = dict(start), metric(dict(start))

    def move(x, kind, s, n):
        return x + n * s if kind == "add" else x * s**n

    for _ in range(rounds):
        for name, (kind, s) in steps.items():
            seen = {0: top}
            for way in (1, -1):
                n = way
                while abs(n) <= most:
                    seen[n] = metric(best | {name: move(best[name], kind, s, n)})
                    if seen[n] <= seen[n - way]:
                        break
                    n += way
            n = max(seen, key=lambda i: (seen[i], -abs(i)))
            shift = 0.0
            if n - 1 in seen and n + 1 in seen:
                a, b, c = seen[n - 1], seen[n], seen[n + 1]
                if a - 2 * b + c < 0:
                    shift = 0.5 * (a - c) / (a - 2 * b + c)
            for candidate in (n + shift, n):
                x = move(best[name], kind, s, candidate)
                value = metric(best | {name: x})
                if value >= top:
                    best, top = best | {name: x}, value
                    break
    return best, top


def library_from_first(records: DataFrame, k: int) -> DataFrame:
    """The first k records, each with prior 1 / k: the start of a library by sampling."""
    return records.orderBy("rec_no").limit(k).withColumn("prior", F.lit(1.0 / k))


def gaussian_library(spark: SparkSession, background: list[float], k: int, width: int, sigma: float, seed: int = 0) -> DataFrame:
    """k, j, a, p: background times exp of noise, normalised."""
    rows = spark.range(k * width * len(background)).select((F.col("id") / (width * len(background))).cast("int").alias("k"), ((F.col("id") / len(background)) % width).cast("int").alias("j"), (F.col("id") % len(background)).cast("int").alias("a"), F.randn(seed).alias("z"))
    bg = F.element_at(F.array(*map(F.lit, background)), F.col("a") + 1)
    e = rows.withColumn("e", bg * F.exp(F.lit(float(sigma)) * F.col("z")))
    return e.select("k", "j", "a", (F.col("e") / F.sum("e").over(Window.partitionBy("k", "j"))).alias("p"))
