"""A log-bilinear network over word vectors, trained in numpy by noise-contrastive estimation.

An output is either a head word, which has a vector of its own and is one of a class of head words, or a
tail class, or the end of a text. The probability of a head word is that of its class times its share of the class, so both sums
that normalise are short. The context is the two tokens before: their vectors, weighted
by position and added (Mnih and Hinton 2007; vectors of positions as in Mnih and Teh 2012).

Noise is drawn from the unigram shares, once a batch for all its tokens, so that scores of data and of noise
are matrix products.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WIDTH, NOISE, BATCH, RATE = 24, 64, 4096, 0.1
#: Pairs of contexts whose classes are normalised at once.
AT_ONCE = 1 << 10


@dataclass
class Shape:
    """How many head words, classes of them (word k is in class k mod classes), and tail classes there are."""

    heads: int
    classes: int
    tails: int

    @property
    def outputs(self) -> int:
        """Classes, tail classes, and the end."""
        return self.classes + self.tails + 1

    @property
    def contexts(self) -> int:
        """Head words, tail classes, and what is before a text."""
        return self.heads + self.tails + 1

    def arrays(self) -> dict[str, tuple[int, ...]]:
        return {
            "context": (self.contexts, WIDTH), "one": (1, WIDTH), "two": (1, WIDTH), "output": (self.outputs, WIDTH), "output_bias": (self.outputs,),
            "word": (self.heads, WIDTH), "word_bias": (self.heads,),
        }


@dataclass
class Tokens:
    """Tokens with what stands before them: output, head word (-1 if none), context one and two tokens back."""

    output: np.ndarray
    word: np.ndarray
    one: np.ndarray
    two: np.ndarray

    def take(self, some: np.ndarray) -> Tokens:
        return Tokens(self.output[some], self.word[some], self.one[some], self.two[some])


class Network:
    """Parameters, and the sums of squared gradients that set their rates (Duchi et al. 2011), in one flat array."""

    def __init__(self, shape: Shape, flat: np.ndarray | None = None):
        sizes = shape.arrays()
        n = sum(int(np.prod(s)) for s in sizes.values())
        self.shape, self.flat = shape, np.zeros(2 * n, np.float32) if flat is None else flat
        self.p, self.squares, at = {}, {}, 0
        for name, s in sizes.items():
            m = int(np.prod(s))
            self.p[name], self.squares[name] = self.flat[at : at + m].reshape(s), self.flat[n + at : n + at + m].reshape(s)
            at += m

    @classmethod
    def fresh(cls, shape: Shape, outputs: np.ndarray, words: np.ndarray, seed: int) -> Network:
        """Small random vectors, and biases at the logarithms of the shares of outputs and words."""
        net, rng = cls(shape), np.random.default_rng(seed)
        for name in ("context", "output", "word"):
            net.p[name][:] = rng.normal(0, 0.1, net.p[name].shape)
        net.p["one"][:], net.p["two"][:] = 1.0, 0.7
        net.p["output_bias"][:], net.p["word_bias"][:] = np.log(outputs), np.log(words)
        return net

    def _step(self, name: str, rows: np.ndarray, gradient: np.ndarray) -> None:
        squares = self.squares[name][rows] + gradient * gradient
        self.squares[name][rows] = squares
        self.p[name][rows] += RATE * gradient / np.sqrt(squares + 1e-8)

    def _contrast(self, name: str, r: np.ndarray, target: np.ndarray, noise: np.ndarray, log_share: np.ndarray, scale: np.float32) -> np.ndarray:
        """One step towards telling targets from noise; the objective's gradient by the contexts ``r``."""
        vectors, bias, n = self.p[name], self.p[f"{name}_bias"] - log_share - np.float32(np.log(len(noise))), len(target)
        right, wrong = vectors[target], vectors[noise]
        data = np.einsum("ij,ij->i", r, right) + bias[target]
        up = (1 / (1 + np.exp(np.clip(data, -30, 30))))[:, None]
        down = r @ -wrong.T  # in place from here on, as most of the time goes here
        down -= bias[noise]
        np.minimum(down, 30, out=down)
        np.exp(down, out=down)
        down += 1
        np.divide(-1, down, out=down)
        back = up * right + down @ wrong
        change = np.empty((n + len(noise), WIDTH + 1), np.float32)
        np.multiply(up, r, out=change[:n, :-1])
        change[:n, -1:] = up
        change[n:, :-1], change[n:, -1] = down.T @ r, down.sum(0)
        rows, g = summed(np.concatenate([target, noise]), change)
        self._step(name, rows, g[:, :-1] * scale)
        self._step(f"{name}_bias", rows, g[:, -1] * scale)
        return back

    def learn(self, tokens: Tokens, outputs: np.ndarray, words: np.ndarray, rng: np.random.Generator) -> None:
        """One pass over the tokens in random order. ``outputs``, ``words``: shares of outputs and head words, of which noise is drawn."""
        log_outputs, log_words = np.log(outputs).astype(np.float32), np.log(words).astype(np.float32)
        order, p = rng.permutation(len(tokens.output)), self.p
        to_output, to_word = np.cumsum(outputs), np.cumsum(words)
        draw = lambda upto: np.minimum(np.searchsorted(upto, rng.random(NOISE) * upto[-1], "right"), len(upto) - 1)
        for low in range(0, len(order), BATCH):
            t = tokens.take(order[low : low + BATCH])
            scale = np.float32(1 / len(t.output))
            one, two = p["context"][t.one], p["context"][t.two]
            r = one * p["one"] + two * p["two"]
            back = self._contrast("output", r, t.output, draw(to_output), log_outputs, scale)
            heads = np.flatnonzero(t.word >= 0)
            if len(heads):
                back[heads] += self._contrast("word", r[heads], t.word[heads], draw(to_word), log_words, scale)
            rows, g = summed(np.concatenate([t.one, t.two]), np.concatenate([back * p["one"], back * p["two"]]))
            self._step("context", rows, g * scale)
            for name, x in (("one", one), ("two", two)):
                self._step(name, np.zeros(1, np.int64), (back * x).sum(0)[None] * scale)

    def log_probabilities(self, tokens: Tokens) -> np.ndarray:
        """Normalised natural logarithms: of a head word, or of a tail class or the end."""
        p, shape = self.p, self.shape
        near, far = p["context"] * p["one"], p["context"] * p["two"]
        pair = tokens.two.astype(np.int64) * shape.contexts + tokens.one
        order = np.argsort(pair)
        pair = pair[order]
        fresh = np.ones(len(pair), bool)
        fresh[1:] = pair[1:] != pair[:-1]
        of, starts = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
        pair = pair[starts]
        edge = np.append(starts[::AT_ONCE], len(order))
        out = np.zeros(len(order))
        for k, low in enumerate(range(0, len(pair), AT_ONCE)):
            some, asked = order[edge[k] : edge[k + 1]], pair[low : low + AT_ONCE]
            s = (near[asked % shape.contexts] + far[asked // shape.contexts]) @ p["output"].T
            s += p["output_bias"]
            row = of[edge[k] : edge[k + 1]] - low
            out[some] = s[row, tokens.output[some]]
            out[some] -= normaliser(s)[row]
        heads = np.flatnonzero(tokens.word >= 0)
        heads = heads[_order(tokens.output[heads])]
        edge = np.searchsorted(tokens.output[heads], np.arange(shape.classes + 1))
        for c in range(shape.classes):
            words, bias = np.ascontiguousarray(p["word"][c :: shape.classes].T), p["word_bias"][c :: shape.classes]
            for low in range(edge[c], edge[c + 1], AT_ONCE):
                some = heads[low : min(edge[c + 1], low + AT_ONCE)]
                s = (near[tokens.one[some]] + far[tokens.two[some]]) @ words
                s += bias
                out[some] += s[np.arange(len(some)), tokens.word[some] // shape.classes]
                out[some] -= normaliser(s)
        return out


def normaliser(scores: np.ndarray) -> np.ndarray:
    """Logarithms of the sums of exponentials of each row; ``scores`` are lost."""
    most = scores.max(1)
    scores -= most[:, None]
    np.exp(scores, out=scores)
    return most + np.log((scores @ np.ones(scores.shape[1], scores.dtype)).astype(np.float64))


def _order(rows: np.ndarray) -> np.ndarray:
    """Indexes of the rows in order, stable; numbers of 16 bits are sorted by their digits."""
    return np.argsort(rows.astype(np.uint16) if rows.max(initial=0) < 1 << 16 else rows, kind="stable")


def summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows and the sums of their values."""
    order = _order(rows)
    rows = rows[order]
    heads = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    return rows[heads], np.add.reduceat(values[order], heads, axis=0)
