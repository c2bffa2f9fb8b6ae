"""A linear-chain conditional random field with two labels, inside and outside a span, in numpy.

A chain's messages are ratios inside : outside. One step maps a ratio by a Moebius map, so a message is a product of 2 x 2
matrices, and all messages of many chains come from a blocked scan: products inside blocks, a scan over the blocks, the messages inside
them. Chains follow each other in one array; a step that starts a chain is a constant map."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Steps in a block of the scan.
STEPS = 64
#: Emissions are kept within this, so that ratios stay finite.
LIMIT = 15.0


def _scan(m: np.ndarray, first: float) -> np.ndarray:
    """Ratios after each map: m is (4, n) with the rows b, a, d, c of r -> (b r + a) / (d r + c), applied from left to right."""
    n = m.shape[1]
    steps = min(STEPS, n)
    blocks = -(-n // steps) if n else 0
    if not n:
        return np.zeros(0)
    if blocks * steps > n:
        pad = np.zeros((4, blocks * steps - n))
        pad[0] = pad[3] = 1
        m = np.concatenate([m, pad], axis=1)
    m = np.ascontiguousarray(m.reshape(4, blocks, steps).transpose(0, 2, 1))
    starts = np.full(blocks, first)
    if blocks > 1:
        whole = m[:, 0].copy()
        for k in range(1, steps):
            b, a, d, c = m[:, k]
            whole = np.stack([b * whole[0] + a * whole[2], b * whole[1] + a * whole[3], d * whole[0] + c * whole[2], d * whole[1] + c * whole[3]])
            whole /= whole.max(axis=0)
        starts[1:] = _scan(whole[:, :-1], first)
    out = np.empty((steps, blocks))
    r = starts
    for k in range(steps):
        b, a, d, c = m[:, k]
        r = (b * r + a) / (d * r + c)
        out[k] = r
    return out.T.reshape(-1)[:n]


@dataclass
class Chain:
    """Log weights of the steps out -> in, in -> out and in -> in (out -> out is 0) and of a chain that starts inside."""

    enter: float = -3.0
    leave: float = 0.0
    stay: float = 0.0
    start: float = -3.0

    def messages(self, emission: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward and backward ratios at each place. begins: where a chain starts."""
        weight = np.exp(np.clip(emission, -LIMIT, LIMIT))
        enter, leave, stay, start = np.exp([self.enter, self.leave, self.stay, self.start])
        one = np.ones(len(weight))
        ahead = np.stack([np.where(begins, 0, stay * weight), np.where(begins, start, enter) * weight, np.where(begins, 0, leave), one])
        forward = _scan(ahead, 0.0)
        ends = np.append(begins[1:], True)[: len(weight)]
        after = np.append(weight[1:], 1.0)[: len(weight)]
        back = np.stack([np.where(ends, 0, stay * after), np.where(ends, 1, leave), np.where(ends, 0, enter * after), one])
        return forward, _scan(back[:, ::-1], 1.0)[::-1]

    def marginals(self, emission: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """The chance that each place is inside a span, by forward and backward messages."""
        forward, backward = self.messages(emission, begins)
        both = forward * backward
        return both / (1 + both)

    def pairs(self, emission: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals, and the chances (3, n) of out -> in, in -> out and in -> in from the place before, 0 where a chain starts."""
        forward, backward = self.messages(emission, begins)
        weight = np.exp(np.clip(emission, -LIMIT, LIMIT)) * backward
        past = np.append(0.0, forward[:-1])[: len(forward)]
        both = np.stack([np.exp(self.enter) * weight, np.exp(self.leave) * past, np.exp(self.stay) * past * weight])
        chance = np.where(begins, 0, both / (1 + both.sum(axis=0)))
        joint = forward * backward
        return joint / (1 + joint), chance


def train(features: np.ndarray, inside: np.ndarray, begins: np.ndarray, buckets: int, epochs: int = 8, batch: int = 400, rate: float = 0.4, penalty: float = 1e-5, seed: int = 7) -> tuple[np.ndarray, float, Chain]:
    """Weights of the features, a bias, and the chain, by gradient steps on the log likelihood of labelled chains, with a step size for each weight.

    features: (places, kinds) bucket numbers, -1 for none; inside: 0 or 1 for each place. No place gives weights of 0."""
    weights, bias, chain = np.zeros(buckets + 1, np.float32), -2.0, Chain()
    if not len(inside):
        return weights[:-1], -LIMIT, chain
    rng = np.random.default_rng(seed)
    # buckets in use, by a table and not by sorting, as the driver holds this
    seen = np.zeros(buckets + 1, bool)
    seen[features + 1] = True
    used = np.flatnonzero(seen) - 1
    place = np.zeros(buckets + 1, np.int32)
    place[used + 1] = np.arange(len(used))
    dense = place[features + 1]
    own, past = np.zeros(len(used)), np.full(len(used), 1e-3)
    none = np.flatnonzero(used < 0)
    small, small_past = np.array([bias, chain.enter, chain.leave, chain.stay, chain.start]), np.full(5, 1.0)
    at = np.flatnonzero(begins)
    stop = np.append(at[1:], len(inside))
    prior = np.append(0, inside[:-1])
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs) + 0.01
        order = rng.permutation(len(at))
        for some in (order[i : i + batch] for i in range(0, len(order), batch)):
            rows = np.concatenate([np.arange(at[k], stop[k]) for k in some])
            f, y, first, before = dense[rows], inside[rows], begins[rows], prior[rows]
            chance, pair = Chain(*small[1:]).pairs(own[f].sum(axis=1) + small[0], first)
            wrong = chance - y
            slope = np.bincount(f.ravel(), np.repeat(wrong, f.shape[1]), len(used)) / len(some) + penalty * own
            slope[none] = 0
            past += slope * slope
            own -= step * slope / np.sqrt(past)
            go = ~first
            held = [go & (before == 0) & (y == 1), go & (before == 1) & (y == 0), go & (before == 1) & (y == 1)]
            slopes = np.array([wrong.sum(), *[p.sum() - s.sum() for p, s in zip(pair, held, strict=True)], wrong[first].sum()]) / len(some) + 1e-3 * small
            small_past += slopes * slopes
            small -= step * slopes / np.sqrt(small_past)
    weights[used[used >= 0]] = own[used >= 0]
    return weights[:-1], float(small[0]), Chain(*map(float, small[1:]))
