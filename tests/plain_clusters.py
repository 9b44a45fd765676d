"""Plain, quadratic versions of the order-dependent clusters."""

import numpy as np

from larder.functions.similarity import token_sort_ratio


def lead(values, share=0.10):
    heads, out = [], []
    for row in values:
        for k, head in enumerate(heads):
            both = ~np.isnan(row) & ~np.isnan(head)
            if (np.abs(row - head) <= share * np.maximum(np.maximum(np.abs(row), np.abs(head)), 1e-9))[both].all():
                heads[k] = np.where(np.isnan(head), row, head)
                out.append(k)
                break
        else:
            heads.append(row.copy())
            out.append(len(heads) - 1)
    return out


def lead_names(names, least):
    """Clusters and scores: a name joins the cluster of the most similar name before it."""
    seen, out, scores, n = {}, [], [], 0
    for name in names:
        if name in seen:
            out.append(seen[name])
            scores.append(100.0)
            continue
        best, at = max(((token_sort_ratio(name, s), -k) for k, s in enumerate(seen)), default=(0.0, 0))
        if seen and best >= least:
            cluster = seen[list(seen)[-at]]
            scores.append(best)
        else:
            cluster, n = n, n + 1
            scores.append(None)
        seen[name] = cluster
        out.append(cluster)
    return out, scores


def lead_taxonomy(names, values, floors, least=85, share=0.15, candidates=5):
    founders, out = [], []
    for i, name in enumerate(names):
        ranked = sorted((-token_sort_ratio(name, names[f]), k) for k, f in enumerate(founders))[:candidates]
        for score, k in ranked:
            a, b = values[i], values[founders[k]]
            both = ~np.isnan(a) & ~np.isnan(b)
            if -score >= least and (np.abs(a - b) <= np.maximum(floors, share * np.maximum(a, b)))[both].all():
                out.append(k)
                break
        else:
            founders.append(i)
            out.append(len(founders) - 1)
    return out


def by_blocks(rows, solve):
    """{id: (first id of the cluster, score)} of (block, id, ...) rows in order; ``solve`` gives clusters and scores of a block's rows."""
    blocks, out = {}, {}
    for r in rows:
        blocks.setdefault(r[0], []).append(r)
    for held in blocks.values():
        k, score = solve(held)
        out |= {r[1]: (held[k.index(c)][1], s) for r, c, s in zip(held, k, score, strict=True)}
    return out
