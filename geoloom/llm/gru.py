"""A gated recurrent language model with a class-factored softmax, in numpy.

The state after the words so far gives the next word's probability as that of its class times that within its class;
classes are runs of words by frequency, about sqrt(n_words) each, so a word costs two short softmaxes in place of one over
the vocabulary. Id n_words is the tail (any other word), a class by itself; id n_words + 1 opens a document.

Training is truncated backpropagation: documents in a row are dealt to lanes in runs of equal length, and windows of WINDOW
steps go over all lanes side by side, the state carried from window to window and cleared where a document starts, with
Adagrad steps. Scoring packs whole documents into lanes and carries the state across windows, so that a document of any
length is scored with all that came before.
"""

from __future__ import annotations

import heapq
import math

import numpy as np

HIDDEN = 16
WINDOW = 16
LANES = 512
#: A lane of training has so many steps at least, so few words make few lanes.
LEAST = 128
SCORE_WINDOW = 32
RATE = 0.1
#: So many rows of one word are added up by a product.
MANY = 16


class Gru:
    def __init__(self, counts: np.ndarray, tail: float, hidden: int = HIDDEN, per_class: int | None = None, seed: int = 3):
        """counts: of the model's words, in descending order; tail: of all other words."""
        n, rng = len(counts), np.random.default_rng(seed)
        per_class = per_class or max(1, math.ceil(math.sqrt(n)))
        self.n, self.m, self.h = n, per_class, hidden
        k = -(-n // per_class)
        self.cls = np.append(np.arange(n) // per_class, [k, k]).astype(np.int64)
        self.pos = np.append(np.arange(n) % per_class, [0, 0]).astype(np.int64)
        c = np.append(counts, np.zeros(k * per_class - n)).astype(np.float64) + 0.5
        by_class = np.append(c.reshape(k, per_class).sum(1), tail + 0.5)
        within = np.log(c / np.repeat(by_class[:k], per_class))
        within[n:] = -30.0
        normal = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
        self.p = {
            "E": normal(n + 2, 3 * hidden), "U": normal(hidden, 3 * hidden), "C": np.zeros((hidden, k + 1), np.float32), "c": np.log(by_class / by_class.sum()).astype(np.float32),
            "W": np.zeros((k, hidden, per_class), np.float32), "w": within.reshape(k, per_class).astype(np.float32),
        }

        self.squares = {name: np.ones_like(x) for name, x in self.p.items()}  # Adagrad's sums

    def vector(self) -> np.ndarray:
        """The weights, then Adagrad's sums."""
        return np.concatenate([x.ravel() for part in (self.p, self.squares) for x in part.values()])

    def load(self, vector: np.ndarray) -> None:
        at = 0
        for part in (self.p, self.squares):
            for name, x in part.items():
                part[name] = np.array(vector[at : at + x.size], np.float32).reshape(x.shape)
                at += x.size

    def _by_class(self, cls: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """The places of words of the model by class, and (class, from, to) in this order."""
        ends = np.cumsum(np.bincount(cls, minlength=len(self.p["W"]) + 1)).tolist()
        order = np.argsort(cls.astype(np.int16), kind="stable")[: ends[-2]]
        return order, [(k, a, b) for k, (a, b) in enumerate(zip([0, *ends[:-2]], ends[:-1], strict=True)) if b > a]

    def _steps(self, h: np.ndarray, x: np.ndarray, keep: np.ndarray, tape: list | None = None) -> np.ndarray:
        """States after each step and a last feature of ones, which the biases weigh, as steps by features by lanes, so that
        each feature's lanes lie side by side; h: features by lanes; x, keep: steps by lanes."""
        n, u_t = self.h, np.ascontiguousarray(self.p["U"].T)
        inputs, out = np.ascontiguousarray(self.p["E"].take(x, 0).transpose(0, 2, 1)), np.empty((len(x), n + 1, x.shape[1]), np.float32)
        out[:, n] = 1
        for t in range(len(x)):
            h = h * keep[t]
            u = u_t @ h
            gates, new = inputs[t, : 2 * n], inputs[t, 2 * n :]  # in place: less memory stays longer in the cache
            gates += u[: 2 * n]
            np.negative(gates, out=gates)
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            z, r = gates[:n], gates[n:]
            new += r * u[2 * n :]
            np.tanh(new, out=new)
            if tape is not None:
                tape.append((h, gates, new, u[2 * n :]))
            h = np.subtract(h, new, out=out[t, :n])
            h *= z
            h += new
        return out

    # --- training -----------------------------------------------------------------------------------------------------

    def train(self, ids: np.ndarray, starts: np.ndarray) -> None:
        """ids: words of documents in a row; starts: whether a document starts there. A lane that begins within a document
        does so without its state."""
        lanes = min(LANES, max(1, len(ids) // LEAST))
        steps = -(-len(ids) // lanes)
        pad = lanes * steps - len(ids)
        before = np.append(self.n + 1, ids[:-1])
        before[starts] = self.n + 1
        shape = lambda x, fill: np.append(x, np.full(pad, fill, x.dtype)).reshape(lanes, steps).T
        x, y, keep, live = map(np.ascontiguousarray, (shape(before, 0), shape(ids, 0), shape(1 - starts.astype(np.float32), 0), shape(np.ones(len(ids), np.float32), 0)))
        h = np.zeros((self.h, lanes), np.float32)
        for t in range(0, steps, WINDOW):
            w = slice(t, t + WINDOW)
            h = self._window(h, x[w], y[w], keep[w], live[w])

    def _window(self, h, x, y, keep, live) -> np.ndarray:
        p, squares, n, tape = self.p, self.squares, self.h, []
        states, cls = self._steps(h, x, keep, tape), self.cls.take(y)
        classes, words = self._with_biases()  # gradients are sums: means are small enough for slow subnormal squares
        back, grad = np.empty((len(x), n, x.shape[1]), classes.dtype), np.zeros_like(classes)
        e = np.empty((x.shape[1], classes.shape[1]), classes.dtype)
        for t in range(len(x)):  # a step's lanes at a time stay in the cache
            total = _powers(np.matmul(states[t].T, classes, out=e))
            e.reshape(-1)[_places(cls[t], e.shape[1])] -= total
            share = live[t] / total  # the softmax is e * share
            grad += (states[t] * share) @ e
            np.multiply(p["C"] @ e.T, share, out=back[t])
        order, parts = self._by_class(cls.ravel())
        mine, pos = _rows(states).take(order, 0), self.pos.take(y.ravel().take(order))
        e, inner, grads = np.empty((len(order), self.m), words.dtype), np.empty((len(order), n), words.dtype), np.zeros_like(words)
        for k, a, b in parts:
            np.matmul(mine[a:b], words[k], out=e[a:b])
        total = _powers(e)
        e.reshape(-1)[_places(pos, self.m)] -= total
        e *= (live.ravel().take(order) / total)[:, None]
        for k, a, b in parts:
            np.matmul(mine[a:b].T, e[a:b], out=grads[k])
            np.matmul(e[a:b], p["W"][k].T, out=inner[a:b])
        rows = np.zeros((x.size, n), inner.dtype)
        rows[order] = inner
        back += rows.reshape(len(x), -1, n).transpose(0, 2, 1)
        grads = {"C": grad[:n], "c": grad[n], "W": grads[:, :n], "w": grads[:, n]}
        # Gradients of a step's recurrent product for the new state, then of the inputs; rows that lie a power of two apart
        # would share places in the cache.
        into = np.empty((len(x), 4 * n, x.shape[1] + 16), back.dtype)[:, :, :-16]
        u_in, u_grad = np.roll(p["U"], n, 1), np.zeros_like(p["U"])  # columns in that order
        dh = np.zeros_like(h)
        for t in range(len(x) - 1, -1, -1):
            was, gates, new, u = tape[t]
            z, d, dn = gates[:n], into[t], into[t, 3 * n :]
            slope = 1 - gates
            dh += back[t]
            np.multiply(dh, slope[:n], out=dn)
            dn *= 1 - new * new
            slope *= gates
            np.multiply(dh, was - new, out=d[n : 2 * n])
            np.multiply(dn, u, out=d[2 * n : 3 * n])
            d[n : 3 * n] *= slope
            np.multiply(dn, gates[n:], out=d[:n])
            u_grad += was @ d[: 3 * n].T
            dh *= z
            dh += u_in @ d[: 3 * n]
            dh *= keep[t]
        grads["U"] = np.roll(u_grad, -n, 1)
        rows, g = _summed(x.ravel(), _rows(into[:, n:]))
        sums = squares["E"].take(rows, 0)
        sums += g * g
        squares["E"][rows] = sums
        g *= RATE
        g /= np.sqrt(sums, out=sums)
        p["E"][rows] = p["E"].take(rows, 0) - g
        for name, g in grads.items():
            squares[name] += g * g
            p[name] -= RATE * g / np.sqrt(squares[name])
        return states[-1, :n]

    def _with_biases(self) -> tuple[np.ndarray, np.ndarray]:
        """The weights of classes and of words in classes, with the biases as a last row."""
        return np.vstack([self.p["C"], self.p["c"]]), np.concatenate([self.p["W"], self.p["w"][:, None]], 1)

    # --- scoring ------------------------------------------------------------------------------------------------------

    def score(self, docs: list[np.ndarray], lanes: int = LANES) -> np.ndarray:
        """The log10 probability of each document."""
        lengths = np.array([len(d) for d in docs], np.int64)
        heap, own = [(0, i) for i in range(min(lanes, len(docs)))], [[] for _ in range(min(lanes, len(docs)))]
        for d in np.argsort(-lengths, kind="stable").tolist():  # the next longest to the shortest lane
            size, lane = heapq.heappop(heap)
            own[lane].append(d)
            heapq.heappush(heap, (size + int(lengths[d]), lane))
        own.sort(key=lambda x: -sum(int(lengths[d]) for d in x))
        row, sizes = np.array([d for x in own for d in x], np.int32), np.array([lengths[x].sum() for x in own], np.int64)
        first, doc = np.cumsum(sizes) - sizes, np.repeat(row, lengths[row])  # lane after lane
        ids = np.concatenate([docs[d] for d in row]) if len(row) else np.zeros(0, np.int64)
        starts = np.append(True, doc[1:] != doc[:-1])
        out, h, packed = np.zeros(len(docs)), np.zeros((self.h, len(own)), np.float32), self._with_biases()
        for t in range(0, int(sizes.max(initial=0)), SCORE_WINDOW):
            active = int((sizes > t).sum())
            steps = np.arange(t, min(t + SCORE_WINDOW, int(sizes[0])))[:, None]
            live = steps < sizes[:active]
            at = np.minimum(first[:active] + steps, len(ids) - 1)  # behind a lane's end any word, which is not counted
            new, y = starts.take(at), ids.take(at)
            states = self._steps(h[:, :active], np.where(new, np.int64(self.n + 1), ids.take(at - 1)), (~new).astype(np.float32))
            h = states[-1, : self.h]
            out += np.bincount(doc[at[live]], self._log_p(packed, states, y, live)[live], len(docs))
        return out / np.log(10)

    def _log_p(self, packed: tuple[np.ndarray, np.ndarray], states: np.ndarray, y: np.ndarray, live: np.ndarray) -> np.ndarray:
        classes, words = packed
        cls, out, e = self.cls.take(y), np.empty(y.shape), np.empty((y.shape[1], classes.shape[1]), classes.dtype)
        for t in range(len(y)):
            out[t] = _log_share(np.matmul(states[t].T, classes, out=e), cls[t])
        order, parts = self._by_class(np.where(live, cls, len(words)).ravel())
        mine, e = _rows(states).take(order, 0), np.empty((len(order), self.m), words.dtype)
        for k, a, b in parts:
            np.matmul(mine[a:b], words[k], out=e[a:b])
        out.ravel()[order] += _log_share(e, self.pos.take(y.ravel().take(order)))
        return out


def _powers(logits: np.ndarray) -> np.ndarray:
    """Turns logits into powers of e, in place; the sum of each row."""
    return np.exp(logits, out=logits) @ np.ones(logits.shape[1], logits.dtype)


def _places(at: np.ndarray, width: int) -> np.ndarray:
    """Of a column in each row, in all rows laid end to end."""
    return np.arange(len(at)) * width + at


def _log_share(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The log of the softmax of each row at a column."""
    own = logits.ravel().take(_places(at, logits.shape[1])).astype(np.float64)
    return own - np.log(_powers(logits))


def _rows(x: np.ndarray) -> np.ndarray:
    """Steps by features by lanes as a row for each step and lane."""
    return np.ascontiguousarray(x.transpose(0, 2, 1)).reshape(-1, x.shape[1])


def _summed(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, the most frequent first, and the sums of their rows: those of MANY rows as products, the others'
    first rows at once, then their second ones, and so on."""
    order = np.argsort(keys.astype(np.uint16) if keys.max(initial=0) < 1 << 16 else keys, kind="stable")  # 16 bits by radix
    found = keys[order]
    at = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
    times = np.diff(np.append(at, len(found)))
    by = np.argsort(-times, kind="stable")
    at, times = at[by], times[by]
    out, ones = rows.take(order[at], 0), np.ones(times[0], rows.dtype)
    more = (len(at) - np.cumsum(np.bincount(times, minlength=MANY))).tolist()  # keys of more rows than that
    many = more[MANY - 1]
    for i, (a, n) in enumerate(zip(at[:many].tolist(), times[:many].tolist(), strict=True)):
        out[i] = ones[:n] @ rows.take(order[a : a + n], 0)
    for j in range(1, MANY - 1):
        out[many : more[j]] += rows.take(order[at[many : more[j]] + j], 0)
    return found[at], out
