"""Recursive filters, in blocks: a cascade is one linear system, and its state after a stretch of
samples is a linear function of the state before it and of the samples.

High-pass: first order by the bilinear transform. Peak: second order, with a gain at its centre
(Bristow-Johnson's public formulas).
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

import numpy as np

BLOCK = 256


def high_pass(hz: float, rate: float) -> tuple[float, ...]:
    """b0, b1, b2, a1, a2."""
    w = np.tan(np.pi * hz / rate)
    return 1 / (1 + w), -1 / (1 + w), 0.0, (w - 1) / (w + 1), 0.0


def peak(hz: float, rate: float, gain_db: float, q: float = 1.0) -> tuple[float, ...]:
    """b0, b1, b2, a1, a2."""
    w, gain = 2 * np.pi * hz / rate, 10 ** (gain_db / 40)
    alpha, c = np.sin(w) / (2 * q), -2 * np.cos(w)
    top = 1 + alpha / gain
    return (1 + alpha * gain) / top, c / top, (1 - alpha * gain) / top, c / top, (1 - alpha / gain) / top


def sections(steps: Iterable[tuple[str, float, float]], rate: float) -> tuple[tuple[float, ...], ...]:
    """The cascade of (filter, hz, gain_db) rows; one whose frequency the sample rate can't hold is left out."""
    kinds = {"highpass": lambda hz, _: high_pass(hz, rate), "peak": lambda hz, gain: peak(hz, rate, gain)}
    return tuple(kinds[kind](hz, gain) for kind, hz, gain in steps if 0 < hz < rate / 2)


class Cascade:
    """x' = A x + B u, y = C x + D u for all sections in a row; ``filtered`` runs it over blocks of samples."""

    def __init__(self, parts: tuple[tuple[float, ...], ...], block: int = BLOCK):
        n = 2 * len(parts)
        whole = np.zeros((n + 1, n + 1))  # what a step makes of each unit state and of a unit input
        for k in range(n + 1):
            state, u = np.zeros(n), float(k == n)
            state[k : k + 1] = 1.0
            after = np.zeros(n)
            for j, (b0, b1, b2, a1, a2) in enumerate(parts):
                y = b0 * u + state[2 * j]
                after[2 * j], after[2 * j + 1] = b1 * u - a1 * y + state[2 * j + 1], b2 * u - a2 * y
                u = y
            whole[:n, k], whole[n, k] = after, u
        self.a, self.b, self.c, self.d = whole[:n, :n], whole[:n, n], whole[n, :n], whole[n, n]
        self.order, self.block = n, block
        reach, seen = [self.b], [self.c]  # A^k B and C A^k
        for _ in range(block):
            reach.append(self.a @ reach[-1])
            seen.append(seen[-1] @ self.a)
        self.seen, self.reach = np.array(seen[:block]), np.array(reach[:block][::-1]).T
        answer = np.r_[self.d, np.array(reach[: block - 1]) @ self.c] if n else np.r_[self.d, np.zeros(block - 1)]
        lag = np.arange(block)[:, None] - np.arange(block)
        self.answer = np.where(lag >= 0, answer[np.abs(lag)], 0.0)

    def power(self, n: int) -> np.ndarray:
        """What n samples of silence make of a state."""
        return np.linalg.matrix_power(self.a, n)

    def filtered(self, u: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The output for samples u from a state (rest if none), and the state after them."""
        u, state = np.asarray(u, float), np.zeros(self.order) if state is None else np.asarray(state, float)
        whole = len(u) // self.block
        blocks = u[: whole * self.block].reshape(whole, self.block)
        moved, jump = blocks @ self.reach.T, self.power(self.block)
        states = np.zeros((whole, self.order))
        for k in range(whole):
            states[k] = state
            state = jump @ state + moved[k]
        out = (blocks @ self.answer.T + states @ self.seen.T).ravel()
        rest = u[whole * self.block :]
        if len(rest):
            out = np.r_[out, self.answer[: len(rest), : len(rest)] @ rest + self.seen[: len(rest)] @ state]
            state = self.power(len(rest)) @ state + self.reach[:, self.block - len(rest) :] @ rest
        return out, state


@lru_cache(maxsize=64)
def cascade(parts: tuple[tuple[float, ...], ...]) -> Cascade:
    return Cascade(parts)
