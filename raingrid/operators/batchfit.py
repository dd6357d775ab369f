"""Smoothing and searches of its parameters for a batch of series at once, in numpy inside a task.

A fold over an array of a series costs some microseconds for each day and tried point, as Spark
interprets it. Here a day is one step for all series and points of an Arrow batch. The simplex
moves as in ``fitting.simplex_search``, every series by itself.
"""

from __future__ import annotations

import numpy as np

#: Values of all tried points that are held at once.
MOST_CELLS = 8_000_000
#: What stands for the error of a point that gives none (a division by zero).
HOPELESS = 1e300
START, SIMPLEX, REFLECTED, STRETCHED, OUTSIDE, INSIDE, SHRUNK = range(7)


def _ratio(a, b):
    """a / b, not a number where b is 0."""
    return np.where(b == 0, np.nan, a / b)


def beginning(days, kind, m):
    """Level, slope and season that every series starts from."""
    if not m:
        return {"l": days[0].copy(), "b": days[1] - days[0], "s": None}
    mean = lambda part: np.cumsum(part, axis=0)[-1] / m
    level = mean(days[:m])
    season = _ratio(days[:m], level) if kind == "mul" else days[:m] - level
    return {"l": level, "b": (mean(days[m:2 * m]) - level) / m, "s": season}


def run(y, size, state, p, kind, m, trend, ahead=None):
    """Takes ``state`` (l, b, s and sums sse and, if there, sr) through the days ``y``, in place.

    ``y`` is days x series, longest series first. One-step-ahead values are put into ``ahead``.
    """
    level, slope, season, sse = (state[k] for k in ("l", "b", "s", "sse"))
    a, keep = p["alpha"], 1.0 - p["alpha"]
    beta, damp, phi = p["beta"], (1.0 - p["beta"]) * p["phi"], p["phi"]
    gamma, hold = p["gamma"], 1.0 - p["gamma"]
    live = np.searchsorted(-size, -np.arange(len(y)), side="left")
    for t, n in enumerate(live):
        if not n:
            break
        x, l = y[t, :n], level[:n]
        base = l + phi[:n] * slope[:n] if trend else l
        plain = guess = base
        if m:
            due = season[t % m, :n]
            plain = _ratio(x, due) if kind == "mul" else x - due
            guess = base * due if kind == "mul" else base + due
            free = _ratio(x, base) if kind == "mul" else x - base
            season[t % m, :n] = gamma[:n] * free + hold[:n] * due
        else:
            plain = x
        if ahead is not None:
            ahead[t, :n] = guess
        new = a[:n] * plain + keep[:n] * base
        miss = x - guess
        sse[:n] += miss * miss
        if "sr" in state:
            state["sr"][:n] += miss
        if trend:
            slope[:n] = beta[:n] * (new - l) + damp[:n] * slope[:n]
        level[:n] = new


def squared_errors(days, sizes, start, who, p, kind, m, trend):
    """Sums of squared one-step errors of the points ``p`` of the series ``who``.

    ``days`` is days x series, longest series first; ``who`` ascends.
    """
    state = {"l": start["l"][who], "b": start["b"][who], "s": start["s"][:, who] if m else None,
             "sse": np.zeros(len(who))}
    run(days[:, who], sizes[who], state, p, kind, m, trend)
    return np.where(np.isnan(state["sse"]), HOPELESS, state["sse"])


def lots(flat, begins, sizes, points=1):
    """Rows, longest first, with their values as days x series, ``MOST_CELLS`` or one row at a time."""
    order, at = np.argsort(-sizes, kind="stable"), 0
    while at < len(order):
        longest = int(sizes[order[at]])
        rows = order[at:at + max(1, MOST_CELLS // max(1, longest * points))]
        at += len(rows)
        days = np.zeros((len(rows), longest))
        for j, r in enumerate(rows):
            days[j, :sizes[r]] = flat[begins[r]:begins[r] + sizes[r]]
        yield rows, np.ascontiguousarray(days.T)


def fits(flat, begins, sizes, p, kind, m, trend=True, keep=False):
    """Ends of the fits of one kind of season: l, b, sse, sr, the season with the one due next first,
    and the one-step-ahead values of each series, laid end to end like ``flat`` (empty unless
    ``keep``)."""
    out = {k: np.empty(len(sizes)) for k in ("l", "b", "sse", "sr")}
    season = np.empty((len(sizes), m))
    ahead = np.empty(len(flat) if keep else 0)
    for rows, days in lots(flat, begins, sizes):
        state = beginning(days, kind, m) | {"sse": np.zeros(len(rows)), "sr": np.zeros(len(rows))}
        if not trend:
            state["b"] = np.zeros(len(rows))
        held = np.empty(days.shape) if keep else None
        run(days, sizes[rows], state, {k: v[rows] for k, v in p.items()}, kind, m, trend, held)
        for k, v in out.items():
            v[rows] = state[k]
        if m:
            turn = (np.arange(m)[:, None] + sizes[rows]) % m
            season[rows] = np.take_along_axis(state["s"], turn, axis=0).T
        for j, r in enumerate(rows if keep else ()):
            ahead[begins[r]:begins[r] + sizes[r]] = held[:sizes[r], j]
    return out | {"s": season, "fitted": ahead}


def held_out_errors(flat, begins, sizes, cuts, candidates, use, remove_bias):
    """Mean squared errors of all ``candidates`` after the first ``cuts`` values: series x candidates,
    not a number where ``use`` is false."""
    out = np.full((len(sizes), len(candidates)), np.nan)
    for i, c in enumerate(candidates):
        rows = np.flatnonzero(use[:, i])
        if not len(rows):
            continue
        p = {k: np.full(len(rows), float(c[k])) for k in ("alpha", "beta", "gamma", "phi")}
        m, phi, test = c["m"], float(c["phi"]), (sizes - cuts)[rows]
        fit = fits(flat, begins[rows], cuts[rows], p, c["kind"], m)
        bias, error = fit["sr"] / cuts[rows] if remove_bias else 0.0, np.zeros(len(rows))
        for h in range(1, int(test.max()) + 1):
            some = np.flatnonzero(test >= h)
            steps = float(h) if abs(phi - 1.0) < 1e-12 else phi * (1.0 - phi ** float(h)) / (1.0 - phi)
            guess = fit["l"] + steps * fit["b"]
            if m:
                due = fit["s"][:, (h - 1) % m]
                guess = guess * due if c["kind"] == "mul" else guess + due
            miss = flat[begins[rows[some]] + cuts[rows[some]] + h - 1] - (guess + bias)[some]
            error[some] += miss * miss
        out[rows, i] = error / test
    return out


def _sorted(f, x):
    """Points of each series by error, then by place."""
    k = x.shape[2]
    order = np.lexsort((*[x[:, :, i] for i in reversed(range(k))], f), axis=-1)
    return np.take_along_axis(f, order, 1), np.take_along_axis(x, order[:, :, None], 1)


def simplex_search(errors, count, starts, bounds, tries, tolerance=1e-9, restarts=1):
    """Least error, its point and the number of tried points of each of ``count`` series;
    ``errors`` maps the series and the points asked for to numbers."""
    k, (low, high) = len(bounds), np.array(bounds, dtype=float).T
    middle = (low + high) / 2
    f, x = np.full((count, k + 1), np.nan), np.full((count, k + 1, k), np.nan)
    held_f, held_x = np.full(count, np.nan), np.full((count, k), np.nan)
    mode, left, tried = np.full(count, START), np.full(count, restarts), np.zeros(count, dtype=int)
    width = max(len(starts), k + 1)
    ask = np.zeros((count, width, k))
    ask[:, :len(starts)] = np.array(starts)
    asks = np.full(count, len(starts))

    def around(at, size):
        sign = np.where(at > middle, -1.0, 1.0)
        beside = at[:, None, :] + (size[:, None] * (high - low) * sign)[:, None, :] * np.eye(k)
        return np.concatenate([at[:, None, :], beside], 1)

    def along(rows, t):
        total = np.cumsum(x[rows, :k], axis=1)[:, -1]
        return np.clip(total / k + t * (total / k - x[rows, k]), low, high)

    def ask_one(rows, t, new_mode):
        ask[rows, 0], asks[rows], mode[rows] = along(rows, t), 1, new_mode

    for _ in range(tries):
        who, place = np.nonzero(np.arange(width) < asks[:, None])
        if not len(who):
            break
        got = np.full((count, width), np.inf)
        got[who, place] = errors(who, ask[who, place])
        busy, was, tried = asks > 0, mode.copy(), tried + asks
        new, points = got[:, 0].copy(), ask.copy()
        done = np.zeros(count, dtype=bool)

        rows = np.flatnonzero(busy & (was == START))
        if len(rows):
            _, first = _sorted(got[rows, :len(starts)], points[rows, :len(starts)])
            ask[rows, :k + 1], asks[rows], mode[rows] = around(first[:, 0], np.full(len(rows), 0.15)), k + 1, SIMPLEX
        rows = np.flatnonzero(busy & (was == SIMPLEX))
        f[rows], x[rows], done[rows] = got[rows, :k + 1], points[rows, :k + 1], True
        rows = np.flatnonzero(busy & (was == SHRUNK))
        f[rows, 1:], x[rows, 1:], done[rows] = got[rows, :k], points[rows, :k], True
        swap = busy & ((was == STRETCHED) | (was == REFLECTED) & (new >= f[:, 0]) & (new < f[:, k - 1])
                       | (was == OUTSIDE) & (new <= held_f) | (was == INSIDE) & (new < f[:, k]))
        old = swap & (was == STRETCHED) & ~(new < held_f)
        rows = np.flatnonzero(swap)
        f[rows, k] = np.where(old, held_f, new)[rows]
        x[rows, k] = np.where(old[:, None], held_x, points[:, 0])[rows]
        done |= swap

        # What did not better the simplex asks for a point further on, or shrinks it.
        more = busy & ~done & (was != START)
        reflected = more & (was == REFLECTED)
        held_f[reflected], held_x[reflected] = new[reflected], points[reflected, 0]
        far, near = reflected & (new < f[:, 0]), reflected & (new >= f[:, 0]) & (new < f[:, k])
        ask_one(np.flatnonzero(far), 2.0, STRETCHED)
        ask_one(np.flatnonzero(near), 0.5, OUTSIDE)
        ask_one(np.flatnonzero(reflected & ~far & ~near), -0.5, INSIDE)
        rows = np.flatnonzero(more & ~reflected)
        ask[rows, :k], asks[rows], mode[rows] = (x[rows, 1:] + x[rows, :1]) / 2, k, SHRUNK

        rows = np.flatnonzero(done)
        f[rows], x[rows] = _sorted(f[rows], x[rows])
        spread = np.abs(x[rows] - x[rows, :1]).max(axis=(1, 2))
        small = (f[rows, k] - f[rows, 0] <= tolerance * np.abs(f[rows, 0])) & (spread < 1e-3)
        again = small & (left[rows] > 0)
        ask_one(rows[~small], 1.0, REFLECTED)
        asks[rows[small]] = 0
        closer = rows[again]
        # Each time closer by, as a simplex that was held at a bound may have missed a bottom there.
        ask[closer, :k + 1] = around(x[closer, 0], 0.1 * 0.15 ** (restarts - left[closer]).astype(float))
        asks[closer], mode[closer] = k + 1, SIMPLEX
        left[closer] -= 1
    return f[:, 0], x[:, 0], tried


def searched(flat, sizes, model, free, starts, bounds, restarts, tries):
    """Rows alpha, beta, gamma, phi, mse and tried for series laid end to end in ``flat``."""
    out = np.empty((len(sizes), 6))
    fixed, m = {"alpha": 0.0, "beta": 0.0, "gamma": 0.0, "phi": 1.0}, model["m"]
    for rows, days in lots(flat, np.cumsum(sizes) - sizes, sizes, len(starts)):
        n, start = sizes[rows], beginning(days, model["kind"], m)

        def errors(who, x):
            p = {c: x[:, free.index(c)] if c in free else np.full(len(who), v) for c, v in fixed.items()}
            return squared_errors(days, n, start, who, p, model["kind"], m, model["trend"])

        with np.errstate(all="ignore"):
            f, x, tried = simplex_search(errors, len(rows), starts, bounds, tries, restarts=restarts)
        for i, (c, v) in enumerate(fixed.items()):
            out[rows, i] = x[:, free.index(c)] if c in free else v
        out[rows, 4], out[rows, 5] = f / n, tried
    return out
