"""Scoring pass of the two graders over one batch, and the update rule of the weights.

Scoring runs inside Spark tasks on the rows of a batch. Parameters are a plain
dict of arrays; a linear layer ``p`` is stored as ``p.w`` (out, in) and ``p.b``.
"""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, field

import numpy as np

Params = dict[str, np.ndarray]

NORM_EPS = 1e-5
# first layers plainly scaled; the layer closing a residual branch starts small
BRANCH_GAIN = 0.1


@dataclass(frozen=True)
class GraderSpec:
    """Shape of a grader; defaults are those of a run without options."""

    in_dim: int
    residual: bool = False
    hidden_dims: tuple[int, ...] = (512, 256)
    use_batch_norm: bool = False
    hidden_dim: int = 512
    num_layers: int = 3
    use_layer_norm: bool = False
    dropout: float = 0.1
    extra: dict[str, str] = field(default_factory=dict, compare=False)

    def to_args(self) -> dict[str, str]:
        args = {k: v for k, v in asdict(self).items() if k != "extra"}
        args["hidden_dims"] = ",".join(str(d) for d in self.hidden_dims)
        return {**{k: str(v) for k, v in args.items()}, **self.extra}

    @classmethod
    def from_args(cls, args: dict[str, str], in_dim: int | None = None) -> GraderSpec:
        def flag(name: str) -> bool:
            return args.get(name, "False") == "True"

        return cls(
            in_dim=in_dim or int(args["in_dim"]),
            residual=flag("residual"),
            hidden_dims=tuple(int(d) for d in args.get("hidden_dims", "512,256").split(",") if d),
            use_batch_norm=flag("use_batch_norm"),
            hidden_dim=int(args.get("hidden_dim", 512)),
            num_layers=int(args.get("num_layers", 3)),
            use_layer_norm=flag("use_layer_norm"),
            dropout=float(args.get("dropout", 0.1)),
        )


# erf by cubic interpolation between exact nodes; off by less than 1e-12
_STEP = 1e-3
_NODES = np.arange(-6.0, 6.0 + 2 * _STEP, _STEP)
_ERF = np.array([math.erf(x) for x in _NODES])
_SLOPE = 2 / math.sqrt(math.pi) * np.exp(-(_NODES**2))


def erf(x: np.ndarray) -> np.ndarray:
    c = np.clip(x, -6.0, 6.0)
    i = np.minimum(((c + 6.0) / _STEP).astype(np.int64), len(_NODES) - 2)
    t = (c - _NODES[i]) / _STEP
    a, b, sa, sb = _ERF[i], _ERF[i + 1], _SLOPE[i] * _STEP, _SLOPE[i + 1] * _STEP
    return a + t * (sa + t * (3 * (b - a) - 2 * sa - sb + t * (2 * (a - b) + sa + sb)))


def init_params(spec: GraderSpec, seed: int = 42) -> Params:
    """Xavier-uniform weights and zero biases; every block scale 1/sqrt(layers)."""
    rng = np.random.default_rng(seed)
    p: Params = {}

    def linear(name: str, n_in: int, n_out: int, gain: float = 1.0) -> None:
        bound = gain * math.sqrt(6.0 / (n_in + n_out))
        p[f"{name}.w"] = rng.uniform(-bound, bound, (n_out, n_in))
        p[f"{name}.b"] = np.zeros(n_out)

    width = spec.in_dim
    if spec.residual:
        if width != spec.hidden_dim:
            linear("proj", width, spec.hidden_dim)
            width = spec.hidden_dim
        for i in range(spec.num_layers):
            if spec.use_layer_norm:
                p[f"block{i}.norm.g"] = np.ones(width)
                p[f"block{i}.norm.b"] = np.zeros(width)
            linear(f"block{i}.up", width, 4 * width)
            linear(f"block{i}.down", 4 * width, width, BRANCH_GAIN)
            p[f"block{i}.scale"] = np.array([1.0 / math.sqrt(spec.num_layers)])
    else:
        for i, n_out in enumerate(spec.hidden_dims):
            linear(f"layer{i}", width, n_out)
            if spec.use_batch_norm:
                p[f"layer{i}.bn.g"] = np.ones(n_out)
                p[f"layer{i}.bn.b"] = np.zeros(n_out)
            width = n_out
    linear("out", width, 1)
    return p


def init_running(spec: GraderSpec) -> Params:
    """Running batch statistics, kept apart from the trained parameters."""
    if spec.residual or not spec.use_batch_norm:
        return {}
    running: Params = {}
    for i, width in enumerate(spec.hidden_dims):
        running[f"layer{i}.bn.mean"] = np.zeros(width)
        running[f"layer{i}.bn.var"] = np.ones(width)
    return running


def _apply(p: Params, name: str, x: np.ndarray) -> np.ndarray:
    return x @ p[f"{name}.w"].T + p[f"{name}.b"]


def _normed(x: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray]:
    scale = 1.0 / np.sqrt(x.var(axis, keepdims=True) + NORM_EPS)
    return (x - x.mean(axis, keepdims=True)) * scale, scale


def logits(spec: GraderSpec, p: Params, x: np.ndarray, running: Params | None = None) -> np.ndarray:
    """Scoring pass: no dropout, batch statistics from training."""
    h = np.asarray(x, dtype=np.float64)
    if not spec.residual:
        for i in range(len(spec.hidden_dims)):
            h = _apply(p, f"layer{i}", h)
            if spec.use_batch_norm:
                stats = running or {}
                spread = np.sqrt(stats[f"layer{i}.bn.var"] + NORM_EPS)
                h = (h - stats[f"layer{i}.bn.mean"]) / spread * p[f"layer{i}.bn.g"] + p[f"layer{i}.bn.b"]
            h = np.maximum(h, 0.0)
        return _apply(p, "out", h)[:, 0]
    if "proj.w" in p:
        h = _apply(p, "proj", h)
    for i in range(spec.num_layers):
        n = h
        if spec.use_layer_norm:
            n = _normed(h, 1)[0] * p[f"block{i}.norm.g"] + p[f"block{i}.norm.b"]
        a = _apply(p, f"block{i}.up", n)
        gelu = 0.5 * a * (1.0 + erf(a / math.sqrt(2.0)))
        h = h + p[f"block{i}.scale"] * _apply(p, f"block{i}.down", gelu)
    return _apply(p, "out", h)[:, 0]


def batch_sums(
    x: np.ndarray, y: np.ndarray, good: np.ndarray, starts: np.ndarray, weights: np.ndarray, accumulation: int
) -> tuple[np.ndarray, float, np.ndarray, bool]:
    """Sums of a linear grader over batches: gradient, loss, confusion counts, and whether the last batch is finite.

    Rows of a batch stand together from the row in ``starts``; ``weights`` has
    the bias last. A batch whose loss is not finite adds nothing.
    """
    x, sizes = np.asarray(x, dtype=np.float64), np.diff(starts, append=len(y))
    with np.errstate(all="ignore"):
        z = x @ weights[:-1] + weights[-1]
        prob = 1.0 / (1.0 + np.exp(-z))
        loss = np.add.reduceat(np.maximum(z, 0.0) - z * y + np.log1p(np.exp(-np.abs(z))), starts) / sizes
    finite = np.isfinite(loss)
    per_row = np.repeat(sizes * accumulation, sizes)
    if not finite.all():
        kept = np.repeat(finite, sizes)
        x, y, good, prob, per_row = x[kept], y[kept], good[kept], prob[kept], per_row[kept]
    slope, hit = (prob - y) / per_row, prob > 0.5
    cells = np.array([np.count_nonzero(c) for c in (hit & good, hit & ~good, ~hit & ~good, ~hit & good)])
    return np.append(slope @ x, slope.sum()), float(loss[finite].sum()), cells, bool(finite[-1])


@dataclass
class AdamW:
    """Decoupled weight decay on the reduced gradient; holds weights-sized state."""

    weight_decay: float = 0.01
    beta1: float = 0.9
    beta2: float = 0.999
    eps: float = 1e-8
    step: int = 0
    mean: Params = field(default_factory=dict)
    square: Params = field(default_factory=dict)

    def update(self, p: Params, g: Params, rate: float) -> Params:
        self.step += 1
        fresh: Params = {}
        for name, w in p.items():
            d = g[name]
            self.mean[name] = self.beta1 * self.mean.get(name, 0.0) + (1 - self.beta1) * d
            self.square[name] = self.beta2 * self.square.get(name, 0.0) + (1 - self.beta2) * d * d
            m = self.mean[name] / (1 - self.beta1**self.step)
            v = self.square[name] / (1 - self.beta2**self.step)
            fresh[name] = w * (1 - rate * self.weight_decay) - rate * m / (np.sqrt(v) + self.eps)
        return fresh


def clip_by_norm(g: Params, limit: float) -> Params:
    """Scale all gradients together so their joint norm is at most ``limit``."""
    if limit <= 0:
        return g
    norm = math.sqrt(sum(float((d * d).sum()) for d in g.values()))
    factor = min(1.0, limit / (norm + 1e-6))
    return {name: d * factor for name, d in g.items()}
