"""Closed-loop scans over one bounded part, shared by encoding and decoding.

A vertex is predicted from values its earlier neighbours already *decoded to*.
Vertices of equal causal depth do not depend on each other, so a scan goes
depth by depth and treats all of them, and all fields of the block, at once.
A scan only ever talks to a coder: the writing coder quantizes the residual,
the reading coder looks the index up. Both directions run the same statements.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

from fieldloom import SENTINEL
from fieldloom.functions import entropy
from fieldloom.functions.kriging import fit_variograms, kriging_weights, neighbour_distances
from fieldloom.functions.scalars import CAPACITY, RADIUS


@dataclass
class LocalMesh:
    """One part: ragged causal neighbours (nearest first) and centred coordinates."""

    starts: np.ndarray  # n + 1 offsets into slots / raw
    slots: np.ndarray
    raw: np.ndarray  # inverse distances
    pos: np.ndarray  # n x d
    _nearest: dict = field(default_factory=dict, repr=False)

    @property
    def n(self) -> int:
        return len(self.starts) - 1

    def nearest(self, k: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """``table`` of all neighbours and its ``fronts``: made once, for all fields of the part."""
        if k not in self._nearest:
            nbr, w = self.table(k)
            self._nearest[k] = nbr, w, fronts(nbr, w > 0)
        return self._nearest[k]

    def table(self, k: int, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """n x k neighbour slots and normalized weights of the first k kept neighbours."""
        owner = np.repeat(np.arange(self.n), np.diff(self.starts))
        ok = np.ones(len(owner), bool) if keep is None else keep[self.slots] & keep[owner]
        owner, slots, raw = owner[ok], self.slots[ok], self.raw[ok]
        first = np.searchsorted(owner, np.arange(self.n))
        turn = np.arange(len(owner)) - first[owner]
        near = turn < k
        nbr = np.zeros((self.n, k), np.int64)
        w = np.zeros((self.n, k))
        nbr[owner[near], turn[near]] = slots[near]
        w[owner[near], turn[near]] = raw[near]
        total = w.sum(1, keepdims=True)
        return nbr, np.divide(w, total, out=np.zeros_like(w), where=total > 0)


def depth_groups(n: int, owner: np.ndarray, earlier: np.ndarray) -> list[np.ndarray]:
    """Vertices grouped by depth = 1 + the deepest earlier vertex they wait for.

    Pairs (owner, earlier) are sorted by owner and earlier < owner, so one pass
    finds every depth after those it depends on.
    """
    depth = [0] * n
    for o, e in zip(owner.tolist(), earlier.tolist()):
        if depth[e] >= depth[o]:
            depth[o] = depth[e] + 1
    by = np.argsort(np.asarray(depth), kind="stable")
    cuts = np.flatnonzero(np.diff(np.asarray(depth)[by])) + 1
    return np.split(by, cuts)


def fronts(nbr: np.ndarray, used: np.ndarray) -> list[np.ndarray]:
    """Depth groups of an n x k neighbour table."""
    owner, _ = np.nonzero(used)
    return depth_groups(len(nbr), owner, nbr[used])


class Writer:
    """Quantizes residuals of x (n x F) against per-column bounds."""

    def __init__(self, x: np.ndarray, eb: np.ndarray):
        self.x, self.eb = x.astype(np.float32), np.asarray(eb, float)
        self.q = np.zeros(x.shape, np.int32)
        self.notes: list[bytes] = []
        self.facts: dict[str, float] = {}
        self.shape = x.shape

    def code(self, rows, pred, cols=slice(None), scale: float = 1.0) -> np.ndarray:
        at = (rows, cols) if isinstance(cols, slice) else np.ix_(rows, cols)
        x, eb = self.x[at], self.eb[cols] * scale
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            diff = x.astype(float) - pred
            steps = np.abs(diff) / eb + 1.0
            half = np.floor(steps / 2.0)
            signed = np.where(diff > 0, half, -half)
            dec = (pred + 2.0 * signed * eb).astype(np.float32)
            fits = (steps < CAPACITY) & (np.abs(dec.astype(float) - x) < eb)
        self.q[at] = np.where(fits, np.where(fits, signed, 0).astype(np.int64) + RADIUS, 0)
        return np.where(fits, dec, x)

    def note(self, make: Callable[[], np.ndarray]) -> np.ndarray:
        """Side information the reader must see too."""
        value = make()
        self.notes.append(value.tobytes())
        return value

    def payload(self) -> bytes:
        raw = self.x[self.q == 0]
        return entropy.pack([entropy.huffman_encode(self.q.ravel()), raw.tobytes(), *self.notes])


class Reader:
    """Looks indices up in a payload written by :class:`Writer`."""

    def __init__(self, payload: bytes, shape: tuple[int, int], eb: np.ndarray):
        symbols, raw, *self.notes = entropy.unpack(payload)
        self.shape, self.eb = shape, np.asarray(eb, float)
        self.facts: dict[str, float] = {}
        self.q = entropy.huffman_decode(symbols).reshape(shape)
        self.raw = np.zeros(shape, np.float32)
        self.raw[self.q == 0] = np.frombuffer(raw, np.float32)

    def code(self, rows, pred, cols=slice(None), scale: float = 1.0) -> np.ndarray:
        at = (rows, cols) if isinstance(cols, slice) else np.ix_(rows, cols)
        q, eb = self.q[at], self.eb[cols] * scale
        dec = (pred + 2.0 * (q - RADIUS).astype(float) * eb).astype(np.float32)
        return np.where(q == 0, self.raw[at], dec)

    def note(self, make: Callable[[], np.ndarray], dtype=np.uint8) -> np.ndarray:
        return np.frombuffer(self.notes.pop(0), dtype)


@dataclass
class Job:
    """Everything a scan needs besides the coder."""

    mesh: LocalMesh
    k: int = 4
    options: dict = field(default_factory=dict)
    fit: np.ndarray | None = None
    """Per column: use-regression flag followed by the quantized coefficients."""


def blend(nbr: np.ndarray, w: np.ndarray, dec: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Weighted neighbour sums, accumulated neighbour by neighbour."""
    out = np.zeros((len(rows), dec.shape[1]))
    for j in range(nbr.shape[1]):
        out += w[rows, j, None] * dec[nbr[rows, j]]
    return out


def scan_neighbours(job: Job, coder, cols=None, scale: float = 1.0) -> np.ndarray:
    """Inverse-distance prediction; no neighbours predicts zero."""
    nbr, w, order = job.mesh.nearest(job.k)
    cols = slice(None) if cols is None else cols
    width = np.arange(coder.shape[1])[cols]
    dec = np.zeros((job.mesh.n, len(width)), np.float32)
    for rows in order:
        dec[rows] = coder.code(rows, blend(nbr, w, dec, rows), cols, scale)
    return dec


def scan_fitted(job: Job, coder) -> np.ndarray:
    """Regression for flagged columns (no dependency at all), neighbours for the rest."""
    flagged = job.fit[:, 0] > 0
    coder.facts["regression_share"] = float(flagged.mean())
    dec = np.zeros(coder.shape, np.float32)
    rows = np.arange(job.mesh.n)
    fitted = np.flatnonzero(flagged)
    if len(fitted):
        pred = np.zeros((job.mesh.n, len(fitted))) + job.fit[fitted, 1]
        for axis in range(job.mesh.pos.shape[1]):
            pred += job.mesh.pos[:, axis, None] * job.fit[fitted, 2 + axis]
        dec[:, fitted] = coder.code(rows, pred, fitted)
    rest = np.flatnonzero(~flagged)
    if len(rest):
        dec[:, rest] = scan_neighbours(job, coder, rest)
    return dec


def scan_masked(job: Job, coder) -> np.ndarray:
    """Missing samples predict the sentinel, the others use surviving neighbours only.

    The mask is taken at the first step of the block and kept for its length.
    """
    bits = coder.note(lambda: np.packbits(coder.x[:, 0] == np.float32(SENTINEL)))
    gone = np.unpackbits(bits, count=job.mesh.n).astype(bool)
    dec = np.zeros(coder.shape, np.float32)
    lost = np.flatnonzero(gone)
    dec[lost] = coder.code(lost, np.full((len(lost), coder.shape[1]), SENTINEL))
    nbr, w = job.mesh.table(job.k, ~gone)
    for rows in fronts(nbr, w > 0):
        rows = rows[~gone[rows]]
        dec[rows] = coder.code(rows, blend(nbr, w, dec, rows))
    return dec


def scan_kriged(job: Job, coder) -> np.ndarray:
    """Ordinary kriging refitted on decoded values at the first step of the block.

    Vertices with fewer than ``min_neighbors`` neighbours, or an unusable system,
    keep inverse-distance weights; the weights serve all steps of the block.
    """
    nbr, w, order = job.mesh.nearest(job.k)
    count = (w > 0).sum(1)
    lam = w.copy()
    fewest = max(int(job.options["min_neighbors"]), 3)
    coder.facts["kriging_share"] = float((count >= fewest).mean())
    dec = np.zeros(coder.shape, np.float32)
    head, tail = np.arange(1), np.arange(1, coder.shape[1])
    for rows in order:
        for m in range(fewest, job.k + 1):
            at = rows[count[rows] == m]
            if not len(at):
                continue
            near, pair = neighbour_distances(job.mesh.pos, at, nbr[at, :m])
            i, j = np.triu_indices(m, 1)
            seen = dec[nbr[at, :m], 0].astype(float)
            half = (seen[:, i] - seen[:, j]) ** 2 / 2.0
            reach, sill = fit_variograms(pair[:, i, j], half, int(job.options["max_iter"]))
            solved, good = kriging_weights(near, pair, reach, sill)
            lam[at[good], :m] = solved[good]
        dec[rows, :1] = coder.code(rows, blend(nbr, lam, dec[:, :1], rows), head)
    if len(tail):
        for rows in order:
            dec[rows, 1:] = coder.code(rows, blend(nbr, lam, dec[:, 1:], rows), tail)
    return dec


@lru_cache(8)
def interpolation_plan(n: int) -> list[tuple[float, list[tuple[np.ndarray, list[tuple[int, float]]]]]]:
    """Levels of a 1-D interpolation over n slots.

    Every entry is (bound scale, groups); a group is (target slots, [(offset,
    coefficient)]). The coarse levels use half the bound. Cubic weights are the
    four-point ones at distances -3, -1, 1, 3 strides.
    """
    cubic = [(-3, -1 / 16), (-1, 9 / 16), (1, 9 / 16), (3, -1 / 16)]
    middle = [(-1, 0.5), (1, 0.5)]
    previous = [(-1, 1.0)]
    plan = []
    for level in range(int(np.ceil(np.log2(n))) if n > 1 else 0, 0, -1):
        stride = 1 << (level - 1)
        m = (n - 1) // stride + 1
        odd = np.arange(1, m, 2)
        inner = odd[(odd >= 3) & (odd + 3 < m)] if m >= 5 else odd[:0]
        tail = odd[odd == m - 1]
        mid = np.setdiff1d(odd, np.concatenate((inner, tail)))
        groups = [
            (at * stride, [(o * stride, c) for o, c in rule])
            for at, rule in ((mid, middle), (inner, cubic), (tail, previous))
            if len(at)
        ]
        plan.append((0.5 if level >= 3 else 1.0, groups))
    return plan


def scan_interpolated(job: Job, coder, cols=None) -> np.ndarray:
    """Multi-level interpolation along the slot order."""
    cols = slice(None) if cols is None else cols
    width = len(np.arange(coder.shape[1])[cols])
    dec = np.zeros((job.mesh.n, width), np.float32)
    first = np.zeros(1, np.int64)
    dec[first] = coder.code(first, np.zeros((1, width)), cols)
    for scale, groups in interpolation_plan(job.mesh.n):
        for at, rule in groups:
            pred = np.zeros((len(at), width))
            for offset, c in rule:
                pred += c * dec[at + offset]
            dec[at] = coder.code(at, pred, cols, scale)
    return dec


def _trial_size(x: np.ndarray, eb: np.ndarray, scan, job: Job) -> list[int]:
    """Stored bytes per column of a trial run."""
    trial = Writer(x, eb)
    scan(job, trial)
    return [
        len(entropy.pack([entropy.huffman_encode(trial.q[:, c]), trial.x[trial.q[:, c] == 0, c].tobytes()]))
        for c in range(x.shape[1])
    ]


def scan_adaptive(job: Job, coder) -> np.ndarray:
    """Per column the smaller of interpolation (0) and neighbours at half the bound (1)."""

    bits = coder.note(lambda: np.packbits(by_neighbours(job, coder.x, coder.eb)))
    flags = np.unpackbits(bits, count=coder.shape[1]).astype(bool)
    coder.facts["interpolation_share"] = float((~flags).mean())
    return _by_columns(job, coder, flags)


def by_neighbours(job: Job, x: np.ndarray, eb: np.ndarray) -> np.ndarray:
    """Per column, whether neighbours take no more bytes than interpolation."""
    by_interp = _trial_size(x, eb, scan_interpolated, job)
    return np.asarray(_trial_size(x, eb, scan_neighbours, job)) <= np.asarray(by_interp)


def _by_columns(job: Job, coder, flags: np.ndarray) -> np.ndarray:
    dec = np.zeros(coder.shape, np.float32)
    for cols, scan in ((np.flatnonzero(flags), "nbr"), (np.flatnonzero(~flags), "interp")):
        if len(cols):
            dec[:, cols] = (
                scan_neighbours(job, coder, cols, 0.5) if scan == "nbr" else scan_interpolated(job, coder, cols)
            )
    return dec


SCANS = {
    "neighbours": scan_neighbours,
    "fitted": scan_fitted,
    "kriged": scan_kriged,
    "masked": scan_masked,
    "adaptive": scan_adaptive,
    "interpolated": scan_interpolated,
}


def written(method: str, job: Job, xs: list[np.ndarray], ebs: list[np.ndarray], fits: list[np.ndarray]) -> list[Writer]:
    """A writer per field, each with its field scanned.

    Neighbours and interpolation take every column for itself, so there all fields are one scan,
    with as many numpy steps as a single field has.
    """
    writers = [Writer(x, eb) for x, eb in zip(xs, ebs)]
    if method not in ("neighbours", "interpolated", "adaptive"):
        for writer, fit in zip(writers, fits or [None] * len(xs)):
            if fit is not None:
                writer.note(lambda: fit)
            SCANS[method](Job(job.mesh, job.k, job.options, fit), writer)
        return writers
    whole = Writer(np.hstack(xs), np.concatenate(ebs))
    cuts = np.cumsum([x.shape[1] for x in xs])[:-1]
    if method == "adaptive":
        flags = by_neighbours(job, whole.x, whole.eb)
        _by_columns(job, whole, flags)
        for writer, mine in zip(writers, np.split(flags, cuts)):
            writer.note(lambda: np.packbits(mine))
            writer.facts["interpolation_share"] = float((~mine).mean())
    else:
        SCANS[method](job, whole)
    for writer, q in zip(writers, np.split(whole.q, cuts, axis=1)):
        writer.q = q
    return writers
