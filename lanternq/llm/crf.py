"""A linear-chain conditional random field in numpy: hashed features, training by AdaGrad on the likelihood, batched Viterbi."""

from __future__ import annotations

import numpy as np

LOW = np.float32(-1e4)


def pad_groups(lengths: np.ndarray, tokens: int = 24000) -> list[np.ndarray]:
    """Sequences of like length, together at most about `tokens` places (a longer sequence is a group of its own)."""
    order = np.argsort(lengths, kind="stable")
    out, i = [], 0
    while i < len(order):
        j = i + 1
        while j < len(order) and (j + 1 - i) * lengths[order[j]] <= tokens:
            j += 1
        out.append(order[i:j])
        i = j
    return out


def place(group: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, row, column): where the tokens of a group stand in the padded matrix."""
    n = lengths[group]
    row = np.repeat(np.arange(len(group)), n)
    col = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(starts[group], n) + col, row, col


def viterbi(emit: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best labels of all tokens; emit (tokens x labels), the sequences end to end."""
    starts = np.cumsum(lengths) - lengths
    out = np.zeros(len(emit), np.int8)
    labels = emit.shape[1]
    for g in pad_groups(lengths):
        n = lengths[g]
        steps, size = int(n.max()) if len(n) else 0, len(g)
        if not steps:
            continue
        tok, row, col = place(g, starts, lengths)
        e = np.zeros((steps, size, labels), np.float32)
        e[col, row] = emit[tok]
        back = np.zeros((steps, size, labels), np.int8)
        score = e[0]
        for t in range(1, steps):
            s = score[:, :, None] + trans[None]
            back[t] = s.argmax(1)
            new = s.max(1) + e[t]
            score = np.where((t < n)[:, None], new, score)
        best = np.zeros((steps, size), np.int8)
        state = score.argmax(1)
        rows = np.arange(size)
        for t in range(steps - 1, -1, -1):
            best[t] = state
            state = np.where((t < n) & (t > 0), back[t, rows, state], state)
        out[tok] = best[col, row]
    return out


def viterbi_between(emit: np.ndarray, owner: np.ndarray, trans: np.ndarray, quiet: float) -> np.ndarray:
    """viterbi over the stretches between quiet tokens, which get label 0: those where label 0 leads by more than `quiet`, at the
    token and at the next one of its owner. Stretches are as long as the scores leave doubt, so no text is shortened."""
    sure = emit[:, 0] - emit[:, 1:].max(1) > quiet
    calm = sure.copy()
    calm[:-1] &= sure[1:] | (owner[1:] != owner[:-1])
    out = np.zeros(len(emit), np.int8)
    at = np.flatnonzero(~calm)
    if len(at):
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])
        lengths = np.diff(np.append(np.flatnonzero(new), len(at)))
        out[at] = viterbi(emit[at], lengths, trans)
    return out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis)
    return m + np.log(np.exp(x - np.expand_dims(m, axis)).sum(axis))


def train(features: np.ndarray, labels: np.ndarray, lengths: np.ndarray, n_labels: int, dim: int, allowed: np.ndarray, epochs: int = 3, batch: int = 48, rate: float = 0.25, l2: float = 1e-6, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(weights dim x labels, transitions). features (tokens x columns) are indices below dim; allowed marks possible transitions."""
    rng = np.random.default_rng(seed)
    w, trans = np.zeros((dim, n_labels), np.float32), np.where(allowed, 0, LOW).astype(np.float32)
    gw, gt = np.full((dim, n_labels), 1e-6, np.float32), np.full((n_labels, n_labels), 1e-6, np.float32)
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(lengths + rng.random(len(lengths)), kind="stable")  # batches of like length need few steps
    groups = [order[i : i + batch] for i in range(0, len(order), batch)]
    ready = []
    for g in groups:
        tok, row, col = place(g, starts, lengths)
        used, inverse = np.unique(features[tok], return_inverse=True)
        inverse = inverse.ravel().astype(np.int32)
        by_feature = np.argsort(inverse, kind="stable")
        first = np.searchsorted(inverse[by_feature], np.arange(len(used)))
        ready.append((lengths[g], tok, row, col, used, inverse.reshape(len(tok), -1), (by_feature // features.shape[1]).astype(np.int32), first))
    for epoch in range(epochs):
        step = rate / (1 + 0.3 * epoch)
        for k in rng.permutation(len(ready)):
            n, tok, row, col, used, inv, by_feature, first = ready[k]
            steps, size = int(n.max()), len(n)
            local = w[used]
            e = np.zeros((steps, size, n_labels), np.float32)
            score = local[inv[:, 0]]
            for c in range(1, inv.shape[1]):
                score += local[inv[:, c]]
            e[col, row] = score
            alpha = np.empty_like(e)
            alpha[0] = e[0]
            for t in range(1, steps):
                alpha[t] = np.where((t < n)[:, None], _lse(alpha[t - 1][:, :, None] + trans[None], 1) + e[t], alpha[t - 1])
            z = _lse(alpha[-1], 1)
            beta = np.zeros_like(e)
            pair = np.zeros((n_labels, n_labels), np.float32)
            for t in range(steps - 2, -1, -1):
                inside = (t + 1 < n)[:, None]
                nxt = e[t + 1] + beta[t + 1]
                full = trans[None] + nxt[:, None, :]
                beta[t] = np.where(inside, _lse(full, 2), 0)
                pair += (np.exp(alpha[t][:, :, None] + full - z[:, None, None]) * inside[:, :, None]).sum(0)
            p = np.exp(alpha + beta - z[None, :, None])[col, row]
            y = labels[tok]
            p[np.arange(len(tok)), y] -= 1
            inner = np.flatnonzero(col[1:] == col[:-1] + 1)
            np.subtract.at(pair, (y[inner], y[inner + 1]), 1)
            grad = np.add.reduceat(p[by_feature], first, axis=0) / size + l2 * local
            gw[used] += grad * grad
            w[used] = local - step * grad / np.sqrt(gw[used])
            pair /= size
            gt += pair * pair
            trans = np.where(allowed, trans - step * pair / np.sqrt(gt), LOW).astype(np.float32)
    return w, trans
