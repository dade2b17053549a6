"""A log-bilinear language model, trained by noise-contrastive estimation.

Classes are the most frequent words, the forms of all other words, and the end of a text. The vector
predicted from the two classes before is the sum of their context vectors, each scaled along its
axes by its position; the score of a class is the product with its own vector, plus a bias.
Scores of two positions only add, so the norms of all pairs of classes come from one product
of two matrices of exponentials.
"""

from dataclasses import dataclass

import numpy as np

CLASSES = 2048
SIZE = 32
BATCH = 1024
NOISE = 64
RATE = 0.1
POSITIONS = 2


@dataclass
class Parameters:
    """Class vectors, context vectors, biases and the scale of each position."""

    target: np.ndarray
    context: np.ndarray
    bias: np.ndarray
    scale: np.ndarray

    def rows(self) -> np.ndarray:
        """All numbers, a row for each class and one for the scales."""
        width = 2 * self.target.shape[1] + 1
        own = np.concatenate([self.target, self.context, self.bias[:, None]], axis=1)
        scales = np.zeros((1, width))
        scales[0, :-1] = self.scale.ravel()
        return np.concatenate([own, scales])

    @classmethod
    def from_rows(cls, rows: np.ndarray) -> "Parameters":
        size = rows.shape[1] // 2
        own = rows[:-1].astype(np.float32)
        scale = rows[-1, :-1].reshape(POSITIONS, size).astype(np.float32)
        return cls(own[:, :size].copy(), own[:, size : 2 * size].copy(), own[:, -1].copy(), scale)

    @classmethod
    def initial(cls, shares: np.ndarray, size: int = SIZE) -> "Parameters":
        """Small random vectors; with the shares' logarithms as biases the model begins as their distribution."""
        random = np.random.default_rng(0)
        vectors = random.normal(0, 0.1, (2, len(shares), size)).astype(np.float32)
        return cls(vectors[0], vectors[1], np.log(shares).astype(np.float32), np.ones((POSITIONS, size), np.float32))


class Trainer:
    """Adagrad on minibatches, with noise from the distribution of classes.

    All rows have the same even width, so that their numbers can be summed in pairs. A class's own row
    holds its vector, its bias less the logarithm of its noise, and zero; behind context vectors and
    scales there are zeros, which have no gradient.
    """

    def __init__(self, parameters: Parameters, shares: np.ndarray, seed: int):
        classes, self._size = parameters.target.shape
        self._width = (self._size + 2) // 2 * 2
        self._log_noise = np.log(NOISE * shares).astype(np.float32)
        self._cumulative = np.cumsum(shares)
        self._random = np.random.default_rng(seed)
        self._own, self._context, self._scale = (
            self._wide(v) for v in (parameters.target, parameters.context, parameters.scale)
        )
        self._own[:, self._size] = parameters.bias - self._log_noise
        self._squares = {n: np.full_like(getattr(self, n), 1e-2) for n in ("_own", "_context", "_scale")}
        # sums of gradients by class; zero between steps
        self._sums = np.zeros((3, classes, self._width), np.float32)
        self._pairs = [s.reshape(-1).view(np.complex64) for s in self._sums]
        self._places = np.arange(classes * self._width // 2).reshape(classes, -1)
        self._met = np.zeros(classes, bool)
        self.tokens = 0

    def _wide(self, rows: np.ndarray) -> np.ndarray:
        made = np.zeros((len(rows), self._width), np.float32)
        made[:, : self._size] = rows
        return made

    @property
    def p(self) -> Parameters:
        own, context, scale = (v[:, : self._size].copy() for v in (self._own, self._context, self._scale))
        return Parameters(own, context, self._own[:, self._size] + self._log_noise, scale)

    def _update(self, name: str, at, gradient: np.ndarray) -> None:
        squares, values = self._squares[name], getattr(self, name)
        moved = squares[at] + gradient * gradient
        squares[at] = moved
        np.sqrt(moved, out=moved)
        np.divide(gradient, moved, out=moved)
        moved *= RATE
        values[at] -= moved

    def _add(self, sums: int, at: np.ndarray, gradient: np.ndarray) -> None:
        """Add each row to the sum of its class."""
        np.add.at(self._pairs[sums], self._places.take(at, 0).reshape(-1), gradient.reshape(-1).view(np.complex64))

    def _classes(self, *met: np.ndarray) -> np.ndarray:
        """Each class once."""
        for at in met:
            self._met[at] = True
        found = np.flatnonzero(self._met)
        self._met[found] = False
        return found

    def _summed(self, sums: int, at: np.ndarray) -> np.ndarray:
        """The sums of these classes, which begin anew."""
        found = self._sums[sums].take(at, 0)
        self._sums[sums][at] = 0
        return found

    def learn(self, word: np.ndarray, last: np.ndarray, before: np.ndarray) -> None:
        """One pass over tokens, each with the two classes before it."""
        for low in range(0, len(word), BATCH):
            self._step(*(x[low : low + BATCH] for x in (word, last, before)))
        self.tokens += len(word)

    def _step(self, word: np.ndarray, last: np.ndarray, before: np.ndarray) -> None:
        drawn = np.searchsorted(self._cumulative, self._random.random(NOISE) * self._cumulative[-1], "right")
        noise = np.minimum(drawn, len(self._cumulative) - 1)
        predicted, earlier = self._context.take(last, 0), self._context.take(before, 0)
        predicted *= self._scale[0]
        earlier *= self._scale[1]
        predicted += earlier
        # meets the bias
        predicted[:, self._size] = 1
        own, false = self._own.take(word, 0), self._own.take(noise, 0)
        # the gradient of either kind is the probability of the wrong answer
        hit = np.einsum("ij,ij->i", predicted, own)
        d_hit = -1 / (1 + np.exp(np.minimum(hit, 60)))
        d_miss = predicted @ -false.T
        with np.errstate(over="ignore"):
            np.exp(d_miss, out=d_miss)
        d_miss += 1
        np.reciprocal(d_miss, out=d_miss)
        d_predicted = d_miss @ false
        own *= d_hit[:, None]
        d_predicted += own
        missed = d_miss.T @ predicted
        predicted *= d_hit[:, None]
        self._add(0, word, predicted)
        self._add(0, noise, missed)
        self._add(1, last, d_predicted)
        self._add(2, before, d_predicted)
        classes, contexts = self._classes(word, noise), self._classes(last, before)
        of_last, of_before = self._summed(1, contexts), self._summed(2, contexts)
        vectors = self._context.take(contexts, 0)
        scale = np.stack([np.einsum("ij,ij->j", of_last, vectors), np.einsum("ij,ij->j", of_before, vectors)])
        of_last *= self._scale[0]
        of_before *= self._scale[1]
        self._update("_own", classes, self._summed(0, classes))
        self._update("_context", contexts, of_last + of_before)
        self._update("_scale", slice(None), scale)


class Scorer:
    """Normalised log probabilities of classes after two others."""

    def __init__(self, p: Parameters):
        self._last = (p.context * p.scale[0]) @ p.target.T + p.bias
        self._before = (p.context * p.scale[1]) @ p.target.T
        high, higher = self._last.max(1), self._before.max(1)
        norms = np.exp(self._last - high[:, None]) @ np.exp(self._before - higher[:, None]).T
        self._norm = np.log(norms) + high[:, None] + higher

    def log_probabilities(self, word: np.ndarray, last: np.ndarray, before: np.ndarray) -> np.ndarray:
        scores = self._last[last, word] + self._before[before, word] - self._norm[last, before]
        return scores.astype(np.float64)
