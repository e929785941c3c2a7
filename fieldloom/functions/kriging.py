"""Gaussian-variogram fits and ordinary-kriging weights for stacks of small systems."""

from __future__ import annotations

import numpy as np

FLOOR = 1e-6  # smallest reach and sill
TOLERANCE = 1e-4


def fit_variograms(lag: np.ndarray, half: np.ndarray, max_iter: int) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares (reach, sill) of sill*(1-exp(-lag^2/reach^2)) per row.

    Levenberg-Marquardt with the analytic derivative; all rows step together and
    a row stops moving once its step is small. ``lag`` and ``half`` are m x pairs.
    """
    reach = np.maximum(lag.max(1) / np.sqrt(3.0), FLOOR)
    sill = np.full(len(lag), 4.0)
    damp = np.full(len(lag), 1e-3)
    live = np.ones(len(lag), bool)

    def residual(r, s):
        return half - s[:, None] * (1.0 - np.exp(-((lag / r[:, None]) ** 2)))

    cost = (residual(reach, sill) ** 2).sum(1)
    for _ in range(max_iter):
        if not live.any():
            break
        e = np.exp(-((lag / reach[:, None]) ** 2))
        res = half - sill[:, None] * (1.0 - e)
        jr = -2.0 * sill[:, None] * e * lag**2 / reach[:, None] ** 3
        js = 1.0 - e
        a, b, c = (jr * jr).sum(1), (jr * js).sum(1), (js * js).sum(1)
        gr, gs = (jr * res).sum(1), (js * res).sum(1)
        a_d, c_d = a * (1 + damp) + 1e-300, c * (1 + damp) + 1e-300
        det = a_d * c_d - b * b
        safe = np.where(np.abs(det) > 1e-300, det, 1.0)
        dr = np.where(live & (np.abs(det) > 1e-300), (c_d * gr - b * gs) / safe, 0.0)
        ds = np.where(live & (np.abs(det) > 1e-300), (a_d * gs - b * gr) / safe, 0.0)
        nr, ns = np.maximum(reach + dr, FLOOR), np.maximum(sill + ds, FLOOR)
        new_cost = (residual(nr, ns) ** 2).sum(1)
        better = live & (new_cost <= cost)
        small = (np.abs(dr) <= TOLERANCE * (1 + np.abs(reach))) & (np.abs(ds) <= TOLERANCE * (1 + np.abs(sill)))
        reach, sill = np.where(better, nr, reach), np.where(better, ns, sill)
        cost = np.where(better, new_cost, cost)
        damp = np.clip(np.where(better, damp * 0.3, damp * 4.0), 1e-12, 1e12)
        live &= ~(better & small)
    return reach, sill


def kriging_weights(
    to_target: np.ndarray, between: np.ndarray, reach: np.ndarray, sill: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Weights (rows x m) and a usable flag, from distances to the target and pairwise.

    Solves the bordered system whose last row makes the weights sum to one.
    """
    rows, m = to_target.shape

    def model(h):
        shape = (rows,) + (1,) * (h.ndim - 1)
        return sill.reshape(shape) * (1.0 - np.exp(-((h / reach.reshape(shape)) ** 2)))

    system = np.ones((rows, m + 1, m + 1))
    system[:, :m, :m] = model(between)
    system[:, m, m] = 0.0
    right = np.ones((rows, m + 1))
    right[:, :m] = model(to_target)
    lam = np.einsum("rij,rj->ri", np.linalg.pinv(system), right)[:, :m]
    good = np.isfinite(lam).all(1) & (np.abs(lam.sum(1) - 1.0) < 1e-6) & (np.abs(lam).max(1) < 1e6)
    return lam, good


def neighbour_distances(pos: np.ndarray, target: np.ndarray, nbr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances target-neighbour (rows x m) and neighbour-neighbour (rows x m x m)."""
    p = pos[nbr]
    near = np.sqrt(((p - pos[target][:, None, :]) ** 2).sum(2))
    pair = np.sqrt(((p[:, :, None, :] - p[:, None, :, :]) ** 2).sum(3))
    return near, pair
