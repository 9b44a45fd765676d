"""The fewest foods that meet a week's bounds: a small mixed-integer program, solved by branch and bound over a simplex of its own.

Perishable foods come in whole packs, others by the gram. A food in use costs 1; the relaxed cost of g grams is g / limit.
"""

from __future__ import annotations

import time
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.portions import portion
from ..operators.columns import q

EPS = 1e-7


def simplex(cost: np.ndarray, rows: np.ndarray, right: np.ndarray) -> np.ndarray | None:
    """The x >= 0 of least cost with rows @ x <= right; None if there is none. Costs aren't negative."""
    m, n = rows.shape
    t = np.zeros((m + 1, n + m + 1))
    t[:m, :n], t[:m, n : n + m], t[:m, -1], t[m, :n] = rows, np.eye(m), right, cost
    basis = np.arange(n, n + m)
    for _ in range(50 * (m + n)):  # dual simplex: costs stay as they are, right sides become feasible
        r = int(np.argmin(t[:m, -1]))
        if t[r, -1] >= -EPS:
            x = np.zeros(n + m)
            x[basis] = t[:m, -1]
            return x[:n]
        line = t[r, :-1]
        neg = np.nonzero(line < -EPS)[0]
        if len(neg) == 0:
            return None
        c = neg[np.argmin(t[m, neg] / -line[neg])]
        t[r] /= t[r, c]
        t -= np.outer(np.where(np.arange(m + 1) == r, 0, t[:, c]), t[r])
        basis[r] = c
    return None


def solve(amounts: np.ndarray, low: np.ndarray, high: np.ndarray, pack: np.ndarray, most: float = 1000.0, nodes: int = 2000, seconds: float | None = None) -> tuple[np.ndarray | None, str]:
    """(grams of each food, status) after ``nodes`` nodes at most, so the answer doesn't depend on the machine; ``seconds`` is a guard against hopeless cases and off by default. The status says which of them ended the search. ``amounts``: bounds x foods, per gram; ``pack``: pack sizes, 0 for foods by the gram."""
    n = amounts.shape[1]
    use = np.isfinite(high)
    rows = np.concatenate([amounts[use], -amounts[low > 0]])
    right = np.concatenate([high[use], -low[low > 0]])
    scale = np.maximum(np.abs(rows).max(axis=1, initial=1e-12), 1e-12)
    rows, right = rows / scale[:, None], right / scale
    best, best_cost, late, seen, began = None, np.inf, "", 0, time.monotonic()
    # A node: bounds of grams, and which foods are known to be in use.
    todo = [(np.zeros(n), np.full(n, most), np.zeros(n, bool))]
    while todo:
        if seen == nodes or (seconds is not None and time.monotonic() - began > seconds):
            late = "Node Limit" if seen == nodes else "Time Limit"
            break
        seen += 1
        lo, hi, used = todo.pop()
        cap = np.nonzero(hi < np.inf)[0]
        limit_rows = np.zeros((len(cap), n))
        limit_rows[np.arange(len(cap)), cap] = 1
        x = simplex(np.where(used, 1e-9, 1 / most), np.concatenate([rows, limit_rows]), np.concatenate([right - rows @ lo, (hi - lo)[cap]]))
        if x is None:
            continue
        g = lo + x
        bound = used.sum() + (g[~used] / most).sum()
        if np.ceil(bound - 1e-6) >= best_cost:
            continue
        parts = np.where(pack > 0, g / np.maximum(pack, 1e-9), 0.0)
        broken = np.abs(parts - np.rint(parts))
        if broken.max(initial=0) > 1e-5:
            k = int(np.argmax(broken))
            down, up = hi.copy(), lo.copy()
            down[k], up[k] = np.floor(parts[k] + 1e-9) * pack[k], np.ceil(parts[k] - 1e-9) * pack[k]
            if up[k] <= hi[k] + EPS:
                todo.append((up, hi, used | (np.arange(n) == k)))
            if down[k] >= lo[k] - EPS:
                todo.append((lo, down, used))
            continue
        count = int((g > 1e-6).sum())
        if count < best_cost:
            best, best_cost = np.where(g > 1e-6, g, 0.0), count
        free = np.nonzero(~used & (g > 1e-6))[0]
        if len(free) and np.ceil(bound - 1e-6) < best_cost:
            k = int(free[np.argmin(g[free])])
            with_k = used.copy()
            with_k[k] = True
            todo.append((lo, hi, with_k))
            if lo[k] <= 0:
                without = hi.copy()
                without[k] = 0
                todo.append((lo, without, used))
    if best is None:
        return None, late or "Infeasible"
    return best, f"Feasible ({late})" if late else "Optimal"


def plan(foods: DataFrame, profiles: DataFrame, targets: Mapping[str, tuple[float, float | None]], days: int = 7, energy_slack: float = 0.05, slack: float = 0.20, most: float = 1000.0, nodes: int = 2000, seconds: float | None = None, candidates: int = 100) -> DataFrame:
    """(profile_id, food_id, grams, packs, status) of each profile (profile_id, kcal). Profiles of equal energy have one problem, solved once; no plan gives one row without a food.

    Foods: (food_id, name, calories, nutrients), ``candidates`` at most (choose the best sources first), sent along.
    """
    names = ["calories", *targets]
    got = foods.select("food_id", *(F.coalesce(q(n), F.lit(0.0)).cast("double").alias(n) for n in names), portion("name").alias("p")).select("food_id", *map(q, names), "p.*").orderBy("food_id").limit(candidates + 1).toPandas()
    if len(got) > candidates:
        raise ValueError(f"more than {candidates} candidate foods; choose the best sources first")
    amounts = got[names].to_numpy(np.float64).T / 100
    pack = np.where(got["perishable"], got["pack_size"], 0).astype(np.float64)
    ids = got["food_id"].tolist()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kcal = float(pdf["kcal"].iloc[0])
        low = np.array([kcal * (1 - energy_slack), *((t[0] or 0) * (1 - slack) for t in targets.values())]) * days
        high = np.array([kcal * (1 + energy_slack), *((t[1] * (1 + slack)) if t[1] else np.inf for t in targets.values())]) * days
        grams, status = solve(amounts, low, high, pack, most, nodes, seconds)
        if grams is None:
            return pd.DataFrame({"kcal": [kcal], "food_id": [None], "grams": [None], "packs": [None], "status": [status]})
        at = np.nonzero(grams)[0]
        packs = [grams[k] / pack[k] if pack[k] else None for k in at]
        return pd.DataFrame({"kcal": kcal, "food_id": [ids[k] for k in at], "grams": grams[at].round(2), "packs": packs, "status": status})

    solved = profiles.select("kcal").distinct().groupBy("kcal").applyInPandas(run, "kcal double, food_id long, grams double, packs double, status string")
    return profiles.select("profile_id", "kcal").join(solved, "kcal").select("profile_id", "food_id", "grams", "packs", "status")
