"""NumPy kernels that run inside Arrow batches.

Each kernel prices a whole batch at once; the tree keeps one array per price
level with the rows of the batch along the last axis.
"""

import numpy as np

from voltide import constants as K

STEPS = K.TREE_STEPS
SOLVER_STEPS = K.SOLVER_STEPS
SOLVER_TOL = K.SOLVER_TOL
NEWTON_START = K.NEWTON_START
CHORD_START = K.CHORD_START
BUMP = K.VEGA_BUMP
# rows handled at once: the lattice of a block stays in the processor cache
BLOCK = 2048


def tree_levels(f, k, r, t, v, cp, n, keep=0):
    """American values on a recombining tree, as (values, prices) per level.

    Returns the levels 0..``keep``; level i is an array of shape (i + 1, rows)
    ordered from the highest underlying price to the lowest.
    """
    dt = t / n
    up = np.exp(v * np.sqrt(dt))
    down = 1.0 / up
    disc = np.exp(-r * dt)
    prob = (1.0 - down) / (up - down)
    w_up = disc * prob
    w_down = disc * (1.0 - prob)
    # exercise values depend only on (ups - downs), from -n to n
    ladder = np.empty((2 * n + 1,) + f.shape)
    ladder[n] = f
    for i in range(1, n + 1):
        np.multiply(ladder[n - i + 1], up, out=ladder[n - i])
        np.multiply(ladder[n + i - 1], down, out=ladder[n + i])
    gain = cp * (ladder - k)
    np.maximum(gain, 0.0, out=gain)
    value = gain[0::2].copy()
    kept = {}
    if n <= keep:
        kept[n] = (value.copy(), ladder[0::2])
    for level in range(n - 1, -1, -1):
        nodes = slice(n - level, n + level + 1, 2)
        value = w_up * value[:-1] + w_down * value[1:]
        np.maximum(value, gain[nodes], out=value)
        if level <= keep:
            kept[level] = (value, ladder[nodes])
    return kept


def tree_price(f, k, r, t, v, cp, n=STEPS):
    return tree_levels(f, k, r, t, v, cp, n)[0][0][0]


def tree_greeks(f, k, r, t, v, cp, n, annual_days):
    """Arrays (price, delta, gamma, theta, vega)."""
    levels = tree_levels(f, k, r, t, v, cp, n, keep=2)
    (v0, _), (v1, s1), (v2, s2) = levels[0], levels[1], levels[2]
    slope = (v1[0] - v1[1]) / (s1[0] - s1[1])
    high = (v2[0] - v2[1]) / (s2[0] - s2[1])
    low = (v2[1] - v2[2]) / (s2[1] - s2[2])
    bend = (high - low) / (0.5 * (s2[0] - s2[2]))
    bumped = tree_price(f, k, r, t, v * (1.0 + BUMP), cp, n)
    return (
        v0[0],
        slope * f * 0.01,
        bend * f * f * 1e-4,
        (v2[1] - v0[0]) / (2.0 * (t / n) * annual_days),
        (bumped - v0[0]) / (BUMP * v * 100.0),
    )


def tree_vol(price, f, k, r, t, cp, n=STEPS):
    """Volatility that gives the quoted price on the tree, by Newton steps.

    0 marks a quote without a solution; a NaN input gives NaN.
    """
    out = np.where(np.isnan(price + f + k + r + t + cp), np.nan, 0.0)
    rows = np.flatnonzero((price > 0) & (price > cp * (f - k)) & (t > 0))
    vol = np.full(rows.shape, NEWTON_START)
    for _ in range(SOLVER_STEPS):
        if rows.size == 0:
            break
        args = (f[rows], k[rows], r[rows], t[rows])
        base = tree_price(*args, vol, cp[rows], n)
        vega = (tree_price(*args, vol * (1.0 + BUMP), cp[rows], n) - base) / (vol * BUMP)
        flat = vega == 0
        step = np.where(flat, 0.0, (price[rows] - base) / np.where(flat, 1.0, vega))
        done = flat | (np.abs(step) < SOLVER_TOL)
        out[rows[done]] = np.round(vol[done], 4)
        vol = vol + step
        # not positive (or not finite): no solution, the 0 stays
        go = ~done & (vol > 0) & np.isfinite(vol)
        rows, vol = rows[go], vol[go]
    out[rows] = np.round(vol, 4)
    return out


def normal_cdf(x, num, den, split, cutoff, root_two_pi):
    z = np.minimum(np.abs(x), cutoff + 1.0)
    bell = np.exp(-0.5 * z * z)
    body = bell * np.polyval(num, z) / np.polyval(den, z)
    frac = z + 0.65
    for part in (4.0, 3.0, 2.0, 1.0):
        frac = z + part / frac
    upper = np.where(z < split, body, np.where(z <= cutoff, bell / frac / root_two_pi, 0.0))
    return np.where(x > 0, 1.0 - upper, upper)


def european_price(model, s, k, r, t, v, cp, law):
    root = v * np.sqrt(t)
    drift = 0.5 * v * v if model == "b76" else r + 0.5 * v * v
    disc = np.exp(-r * t)
    d1 = (np.log(s / k) + drift * t) / root
    n1 = normal_cdf(cp * d1, *law)
    n2 = normal_cdf(cp * (d1 - root), *law)
    if model == "b76":
        return cp * (s * n1 - k * n2) * disc
    return cp * (s * n1 - k * n2 * disc)


def european_vol(model, method, price, s, k, r, t, cp, law):
    """Implied volatility of European quotes; 0 marks no solution.

    ``chord`` divides by one fixed slope per row (the vega at d1 = 1) from a
    start of 1 %, and so may stop short of the root far from the money.
    ``newton`` divides by the vega at the current point, starts from the
    Manaster-Koehler seed and takes the model's own lower price bound.
    """
    out = np.where(np.isnan(price + s + k + r + t + cp), np.nan, 0.0)
    disc = np.exp(-r * t)
    if method == "chord":
        floor = np.where(cp > 0, (s - k) * disc, k * disc - s)
    else:
        floor = cp * (s - k) * disc if model == "b76" else cp * (s - k * disc)
    rows = np.flatnonzero((price > 0) & (price > floor) & (t > 0))
    carry = disc if model == "b76" else np.ones_like(disc)
    if method == "chord":
        vol = np.full(rows.shape, CHORD_START)
        chord = (s * carry * np.exp(-0.5) * 0.3989422804014327 * np.sqrt(t))[rows]
    else:
        vol = np.maximum(np.sqrt(2.0 * np.abs(np.log(s[rows] / k[rows])) / t[rows]), 0.1)
        chord = None
    for _ in range(SOLVER_STEPS):
        if rows.size == 0:
            break
        a = (s[rows], k[rows], r[rows], t[rows])
        base = european_price(model, *a, vol, cp[rows], law)
        if chord is not None:
            slope = chord
        else:
            drift = 0.5 * vol * vol if model == "b76" else a[2] + 0.5 * vol * vol
            d1 = (np.log(a[0] / a[1]) + drift * a[3]) / (vol * np.sqrt(a[3]))
            slope = a[0] * carry[rows] * np.exp(-0.5 * d1 * d1) * 0.3989422804014327 * np.sqrt(a[3])
        flat = slope == 0
        step = np.where(flat, 0.0, (price[rows] - base) / np.where(flat, 1.0, slope))
        done = flat | (np.abs(step) < SOLVER_TOL)
        out[rows[done]] = np.round(vol[done], 4)
        vol = vol + step
        go = ~done & (vol > 0) & np.isfinite(vol)
        rows, vol = rows[go], vol[go]
        chord = None if chord is None else chord[go]
    out[rows] = np.round(vol, 4)
    return out


def in_blocks(kernel, width, *arrays):
    """Run ``kernel`` over slices of the batch; ``width`` results per row."""
    size = arrays[0].size
    out = np.empty((width, size))
    for lo in range(0, size, BLOCK):
        cut = slice(lo, lo + BLOCK)
        result = kernel(*[a[cut] for a in arrays])
        out[:, cut] = result
    return out
