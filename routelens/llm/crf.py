"""A linear-chain conditional random field over feature ids, in numpy.

Many sequences are handled in lockstep: sorted by length, the first k of them are advanced together one position at a
time, so a batch costs as many steps as its longest sequence has positions.
"""

from __future__ import annotations

import numpy as np

#: Where AdaGrad starts its sums: features seen in a few sequences only move slowly.
RARE = 1e-4


class Chains:
    """Positions of consecutive sequences, ordered for lockstep."""

    def __init__(self, lengths: np.ndarray):
        first = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
        order = np.argsort(-lengths, kind="stable")
        self.first, self.length = first[order], np.asarray(lengths)[order]
        self.steps = int(self.length[0]) if len(order) else 0
        self.n = int(np.sum(lengths))
        self.active = np.searchsorted(-self.length, -np.arange(self.steps), side="left")  # sequences longer than t
        self.follows = np.ones(self.n, bool)  # is there a position before it in the same sequence?
        self.follows[first[np.asarray(lengths) > 0]] = False


class LinearChain:
    def __init__(self, features: int, tags: int):
        self.weight = np.zeros((features, tags), np.float32)
        self.step = np.zeros((tags, tags))
        self.start = np.zeros(tags)

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """ids: positions x feature slots."""
        out = np.zeros((len(ids), self.weight.shape[1]))
        for slot in range(ids.shape[1]):
            out += self.weight[ids[:, slot]]
        return out

    def marginals(self, emission: np.ndarray, chains: Chains, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Tag probabilities by forward-backward, and with ``pairs`` the expected transitions."""
        ex = np.exp(emission - emission.max(axis=1, keepdims=True))
        step, start = np.exp(self.step - self.step.max()), np.exp(self.start - self.start.max())
        forward, backward = np.empty_like(ex), np.ones_like(ex)
        now = None
        for t in range(chains.steps):
            at = chains.first[: chains.active[t]] + t
            now = start * ex[at] if t == 0 else (now[: len(at)] @ step) * ex[at]
            now /= now.sum(axis=1, keepdims=True)
            forward[at] = now
        for t in range(chains.steps - 2, -1, -1):
            at = chains.first[: chains.active[t + 1]] + t
            now = (ex[at + 1] * backward[at + 1]) @ step.T
            backward[at] = now / now.sum(axis=1, keepdims=True)
        p = forward * backward
        p /= p.sum(axis=1, keepdims=True)
        if not pairs:
            return p, None
        later = np.flatnonzero(chains.follows)
        joint = forward[later - 1][:, :, None] * step[None] * (ex[later] * backward[later])[:, None, :]
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        return p, joint.sum(axis=0)

    def viterbi(self, emission: np.ndarray, chains: Chains, before: np.ndarray | None = None, after: np.ndarray | None = None) -> np.ndarray:
        """Best tags. ``before`` and ``after`` give the fixed tag next to each sequence (-1: none), in lockstep order."""
        tags = emission.shape[1]
        back = np.zeros((len(emission), tags), np.int8)
        ends = np.zeros((len(chains.first), tags))
        now = None
        for t in range(chains.steps):
            k = chains.active[t]
            at = chains.first[:k] + t
            if t == 0:
                begin = np.repeat(self.start[None], k, axis=0)
                if before is not None:
                    known = before[:k] >= 0
                    begin[known] = self.step[before[:k][known]]
                now = begin + emission[at]
            else:
                through = now[:k, :, None] + self.step[None]
                back[at] = through.argmax(axis=1)
                now = through.max(axis=1) + emission[at]
            ends[:k] = now
        if after is not None:
            known = after >= 0
            ends[known] += self.step[:, after[known]].T
        out = np.zeros(len(emission), np.int8)
        tag = ends.argmax(axis=1) if len(ends) else np.zeros(0, int)
        for t in range(chains.steps - 1, -1, -1):
            k = chains.active[t]
            at = chains.first[:k] + t
            ended = chains.length[:k] - 1 == t
            tag[:k] = np.where(ended, ends[:k].argmax(axis=1), tag[:k])
            out[at] = tag[:k]
            tag[:k] = back[at, tag[:k]]
        return out

    def fit(self, ids: np.ndarray, tags: np.ndarray, lengths: np.ndarray, rounds: int = 60, rate: float = 0.5, ridge: float = 1e-4) -> LinearChain:
        """Penalised log-likelihood by AdaGrad over all sequences at once."""
        chains = Chains(lengths)
        if not chains.n:
            return self
        n_tags = self.weight.shape[1]
        truth = np.eye(n_tags)[tags]
        later = np.flatnonzero(chains.follows)
        opening = np.flatnonzero(~chains.follows)
        seen = np.zeros((n_tags, n_tags))
        np.add.at(seen, (tags[later - 1], tags[later]), 1)
        total = [np.full(x.shape, RARE) for x in (self.weight, self.step, self.start)]
        for _ in range(rounds):
            p, joint = self.marginals(self.emissions(ids), chains, pairs=True)
            error = (truth - p) / len(lengths)
            up = np.zeros(self.weight.shape)
            for slot in range(ids.shape[1]):
                for tag in range(n_tags):
                    up[:, tag] += np.bincount(ids[:, slot], error[:, tag], len(up))
            gradients = (up - ridge * self.weight, (seen - joint) / len(lengths) - ridge * self.step, error[opening].sum(axis=0) - ridge * self.start)
            for x, g, s in zip((self.weight, self.step, self.start), gradients, total, strict=True):
                s += g * g
                x += (rate * g / np.sqrt(s)).astype(x.dtype)
        return self
