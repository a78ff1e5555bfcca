"""Linear-chain conditional random fields in numpy: training, Viterbi decoding and forward-backward over many chains at once.

A chain has one score per position and label (the emissions) and one score per pair of neighbouring labels (the
transitions). Chains of a batch lie one after another; `ends` holds their offsets.
"""

from __future__ import annotations

import numpy as np

#: Positions of one block of the blocked forward-backward.
BLOCK = 32


def train(rows: np.ndarray, starts: np.ndarray, labels: np.ndarray, n_features: int, k: int, *, epochs: int = 6, batch: int = 128, rate: float = 0.05, l2: float = 1e-4, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Weights (n_features, k) and transitions (k, k) that maximise the conditional log-likelihood.

    labels: (chains, length). Position p (row by row over labels) has the features rows[starts[p]:starts[p + 1]].
    Gradients are exact (forward-backward), steps are Adam's, the order is fixed by the seed.
    """
    n, length = labels.shape
    weights, moves = np.zeros((n_features, k)), np.zeros((k, k))
    moments = [np.zeros_like(x) for x in (weights, weights, moves, moves)]
    rng, step = np.random.default_rng(seed), 0
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, batch):
            chosen = order[at : at + batch]
            spots = (chosen[:, None] * length + np.arange(length)).ravel()
            counts = starts[spots + 1] - starts[spots]
            owner = np.repeat(np.arange(len(spots)), counts)
            feats = rows[np.repeat(starts[spots] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())]
            emissions = np.zeros((len(spots), k))
            for y in range(k):
                emissions[:, y] = np.bincount(owner, weights[feats, y], len(spots))
            emissions = emissions.reshape(len(chosen), length, k)
            single, pair = _expected(emissions, moves)
            gold = labels[chosen]
            single[np.arange(len(chosen))[:, None], np.arange(length), gold] -= 1
            np.subtract.at(pair, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
            error = single.reshape(-1, k)
            slope = np.stack([np.bincount(feats, error[owner, y], n_features) for y in range(k)], 1) / len(chosen) + l2 * weights
            slopes, step = (slope, pair / len(chosen) + l2 * moves), step + 1
            for x, g, m, v in ((weights, slopes[0], moments[0], moments[1]), (moves, slopes[1], moments[2], moments[3])):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return weights, moves


def _expected(emissions: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of single labels (chains, length, k) and the sum of those of neighbouring pairs (k, k), for chains of one length."""
    n, length, k = emissions.shape
    e, a = np.exp(emissions - emissions.max(2, keepdims=True)), np.exp(moves)
    forward, backward = np.empty_like(e), np.ones_like(e)
    forward[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
    for t in range(1, length):
        x = (forward[:, t - 1] @ a) * e[:, t]
        forward[:, t] = x / x.sum(1, keepdims=True)
    for t in range(length - 2, -1, -1):
        x = (backward[:, t + 1] * e[:, t + 1]) @ a.T
        backward[:, t] = x / x.sum(1, keepdims=True)
    single = forward * backward
    single /= single.sum(2, keepdims=True)
    pair = forward[:, :-1, :, None] * a * (e[:, 1:] * backward[:, 1:])[:, :, None, :]
    return single, (pair / pair.sum((2, 3), keepdims=True)).sum((0, 1))


def viterbi(emissions: np.ndarray, ends: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best label of each position; at equal scores the lower label. Chains advance together, longest first."""
    lengths = np.diff(ends)
    order = np.argsort(-lengths, kind="stable")
    sizes, begin = lengths[order], ends[:-1][order]
    out = np.zeros(len(emissions), np.int64)
    back = np.zeros(emissions.shape, np.int8)
    best = emissions[begin[sizes > 0]].copy()
    final = np.zeros((len(order), emissions.shape[1]))
    for t in range(1, int(sizes[0]) if len(sizes) else 0):
        live = int(np.searchsorted(-sizes, -t, side="left"))  # chains longer than t
        final[live : len(best)] = best[live:]
        paths = best[:live, :, None] + moves
        back[begin[:live] + t] = paths.argmax(1)
        best = paths.max(1) + emissions[begin[:live] + t]
    final[: len(best)] = best
    state = final.argmax(1)
    for t in range(int(sizes[0]) - 1 if len(sizes) else -1, -1, -1):
        live = int(np.searchsorted(-sizes, -t, side="left"))
        out[begin[:live] + t] = state[:live]
        state[:live] = back[begin[:live] + t, state[:live]]
    return out


def posteriors(emissions: np.ndarray, ends: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Exact posteriors (positions, k) by forward-backward.

    Chains are cut into blocks. The product of each block's matrices carries the forward and the backward message
    over it, so only a chain's blocks, not its positions, are passed one after another; the blocks of all chains are
    then filled in together.
    """
    lengths, k = np.diff(ends), emissions.shape[1]
    out = np.zeros_like(emissions, dtype=np.float64)
    blocks = -(-lengths // BLOCK)
    total = int(blocks.sum())
    if not total:
        return out
    first = np.concatenate([[0], np.cumsum(blocks)])
    own = np.repeat(np.arange(len(lengths)), blocks)
    begin = ends[:-1][own] + (np.arange(total) - first[own]) * BLOCK
    size = np.minimum(BLOCK, ends[1:][own] - begin)
    leads = np.arange(total) == first[own]
    e = np.exp(emissions - emissions.max(1, keepdims=True))
    a = np.exp(moves)
    spots = np.minimum(begin[:, None] + np.arange(BLOCK), len(e) - 1)
    filled = np.arange(BLOCK) < size[:, None]
    whole = np.broadcast_to(np.eye(k), (total, k, k)).copy()
    for t in range(BLOCK):
        new = (whole.reshape(-1, k) @ a).reshape(total, k, k) * e[spots[:, t], None, :]
        if t == 0:
            new[leads] = np.eye(k) * e[spots[leads, 0], None, :]
        new /= new.max((1, 2), keepdims=True)
        live = filled[:, t]
        whole[live] = new[live]
    before, after = np.ones((total, k)), np.ones((total, k))
    many = np.argsort(-blocks, kind="stable")
    sizes, head = blocks[many], first[:-1][many]
    for j in range(1, int(sizes[0])):
        at = head[: int(np.searchsorted(-sizes, -j, side="left"))] + j
        x = np.matmul(before[at - 1][:, None, :], whole[at - 1])[:, 0]
        before[at] = x / x.sum(1, keepdims=True)
    for j in range(int(sizes[0]) - 2, -1, -1):
        at = head[: int(np.searchsorted(-sizes, -(j + 1), side="left"))] + j
        x = np.matmul(whole[at + 1], after[at + 1][:, :, None])[:, :, 0]
        after[at] = x / x.sum(1, keepdims=True)
    inner = np.empty((BLOCK, total, k))
    state = before
    for t in range(BLOCK):
        x = (state @ a) * e[spots[:, t]]
        if t == 0:
            x[leads] = e[spots[leads, 0]]
        x /= x.sum(1, keepdims=True)
        state = np.where(filled[:, t : t + 1], x, state)
        inner[t] = state
    state = after
    for t in range(BLOCK - 1, -1, -1):
        live = filled[:, t]
        both = inner[t][live] * state[live]
        out[spots[live, t]] = both / both.sum(1, keepdims=True)
        x = (state * e[spots[:, t]]) @ a.T
        x /= x.sum(1, keepdims=True)
        state = np.where(live[:, None], x, state)
    return out
