"""A character-level bidirectional LSTM with CRF transitions, in numpy.

One-hot characters go through an LSTM in each direction; their states give a
score for each tag and character, and a linear-chain CRF adds scores for
neighbouring tags.  Training maximises the likelihood of the labelled tags
(Adam, gradients by hand); decoding is Viterbi.  Tags are O and, for each
kind, B and I; I may only follow B or I of its kind.
"""

from __future__ import annotations

import numpy as np

HIDDEN = 16
PAD, OTHER, LETTER, SPACE = 0, 1, 2, 3  # codes of non-ASCII and control characters
CODES = 4 + 95  # the printable ASCII characters follow
BARRED = -1e4


def character_codes(text: str):
    """A code per character."""
    at = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    out = np.full(len(at), OTHER, dtype=np.int16)
    plain = (at >= 32) & (at < 127)
    out[plain] = at[plain] - 28
    out[(at >= 0xC0) & (at < 0x250)] = LETTER
    out[(at >= 9) & (at <= 13)] = SPACE
    return out


def tag_transitions(kinds: int):
    """Fixed part of the transition and start scores."""
    n = 1 + 2 * kinds
    step, first = np.zeros((n, n)), np.zeros(n)
    for k in range(kinds):
        inside = 2 + 2 * k
        step[:, inside] = BARRED
        step[inside, inside] = step[inside - 1, inside] = 0.0
        first[inside] = BARRED
    return step, first


def sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1.0)


class Tagger:
    def __init__(self, kinds: int, hidden: int = HIDDEN, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.kinds, self.hidden, self.tags = kinds, hidden, 1 + 2 * kinds
        h = hidden
        self.p = {"out": rng.normal(0, 0.3, (2 * h, self.tags)), "out_b": np.zeros(self.tags)}
        self.p |= {"step": np.zeros((self.tags, self.tags)), "first": np.zeros(self.tags), "last": np.zeros(self.tags)}
        for d in "fb":
            self.p[f"in_{d}"] = rng.normal(0, 0.3, (CODES, 4 * h))
            self.p[f"rec_{d}"] = rng.normal(0, 0.3, (h, 4 * h))
            self.p[f"bias_{d}"] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])  # open forget gates
        self.fixed_step, self.fixed_first = tag_transitions(kinds)

    # -- forward ---------------------------------------------------------
    def _lstm(self, x, mask, d: str, keep: bool):
        """States (length, batch, hidden) of one direction; ``x`` is (length, batch)."""
        n, batch = x.shape
        h = self.hidden
        wx, wh, b = self.p[f"in_{d}"], self.p[f"rec_{d}"], self.p[f"bias_{d}"]
        hs = np.zeros((n, batch, h), dtype=wx.dtype)
        tape = []
        hp = cp = np.zeros((batch, h), dtype=wx.dtype)
        for t in range(n) if d == "f" else range(n - 1, -1, -1):
            z = wx[x[t]] + hp @ wh + b
            gate = sigmoid(z[:, : 3 * h])
            i, f, o, g = gate[:, :h], gate[:, h : 2 * h], gate[:, 2 * h :], np.tanh(z[:, 3 * h :])
            c = f * cp + i * g
            tc = np.tanh(c)
            m = mask[t][:, None]
            if keep:
                tape.append((t, i, f, o, g, cp, hp, tc, m))
            cp, hp = c * m, o * tc * m
            hs[t] = hp
        return hs, tape

    def emissions(self, x, mask, keep: bool = False):
        hf, tf = self._lstm(x, mask, "f", keep)
        hb, tb = self._lstm(x, mask, "b", keep)
        both = np.concatenate([hf, hb], axis=2)
        return both @ self.p["out"] + self.p["out_b"], both, tf, tb

    # -- training --------------------------------------------------------
    def _lstm_back(self, grad, x, tape, d: str, grads: dict) -> None:
        h = self.hidden
        wh = self.p[f"rec_{d}"]
        dh = dc = 0.0
        gh, places, steps = np.zeros_like(wh), [], []
        for t, i, f, o, g, cp, hp, tc, m in reversed(tape):
            dh_t = (grad[t] + dh) * m
            dc_t = dc * m + dh_t * o * (1 - tc * tc)
            dz = np.concatenate(
                [dc_t * g * i * (1 - i), dc_t * cp * f * (1 - f), dh_t * tc * o * (1 - o), dc_t * i * (1 - g * g)], axis=1
            )
            places.append(x[t])
            steps.append(dz)
            gh += hp.T @ dz
            dh, dc = dz @ wh.T, dc_t * f
        dz, at = np.concatenate(steps), np.concatenate(places)
        one_hot = np.zeros((len(at), CODES))
        one_hot[np.arange(len(at)), at] = 1.0
        grads[f"in_{d}"], grads[f"rec_{d}"], grads[f"bias_{d}"] = one_hot.T @ dz, gh, dz.sum(0)

    def loss_and_gradients(self, x, mask, tags):
        """Mean negative log-likelihood of a batch; arrays are (length, batch)."""
        n, batch = x.shape
        e, both, tf, tb = self.emissions(x, mask, keep=True)
        step, first = self.p["step"] + self.fixed_step, self.p["first"] + self.fixed_first
        last = self.p["last"]
        # forward and backward sums, scaled at each step
        top = e.max(axis=2, keepdims=True)
        w, p, end = np.exp(e - top), np.exp(step), np.exp(last)
        alpha, beta, scale = np.zeros_like(e), np.zeros_like(e), np.ones((n, batch, 1))
        for t in range(n):
            new = (alpha[t - 1] @ p if t else np.exp(first)) * w[t]
            scale[t] = np.where(mask[t][:, None] > 0, new.sum(1, keepdims=True), 1.0)
            alpha[t] = np.where(mask[t][:, None] > 0, new / scale[t], alpha[t - 1])
        z = (alpha[n - 1] * end).sum(1, keepdims=True)
        total = np.log(scale).sum((0, 2)) + (top[:, :, 0] * mask).sum(0) + np.log(z[:, 0])
        beta[n - 1] = end / z
        for t in range(n - 2, -1, -1):
            new = (w[t + 1] * beta[t + 1] / scale[t + 1]) @ p.T
            beta[t] = np.where(mask[t + 1][:, None] > 0, new, beta[t + 1])
        live = mask > 0
        at = np.arange(batch)
        de = alpha * beta * mask[:, :, None]
        de.reshape(-1, self.tags)[np.arange(n * batch), tags.ravel()] -= mask.ravel()
        ahead = w * beta / scale * mask[:, :, None]
        dstep = p * (alpha[:-1].reshape(-1, self.tags).T @ ahead[1:].reshape(-1, self.tags))
        go = live[1:]
        np.add.at(dstep, (tags[:-1][go], tags[1:][go]), -1.0)
        final = tags[live.sum(0) - 1, at]
        gold = first[tags[0]] + last[final] + (np.take_along_axis(e, tags[:, :, None], 2)[:, :, 0] * mask).sum(0)
        gold += (step[tags[:-1], tags[1:]] * go).sum(0)
        dfirst = de[0].sum(0)
        dlast = (alpha[n - 1] * beta[n - 1]).sum(0)
        np.add.at(dlast, final, -1.0)
        grads = {"step": dstep, "first": dfirst, "last": dlast}
        grads["out"] = both.reshape(-1, both.shape[2]).T @ de.reshape(-1, self.tags)
        grads["out_b"] = de.sum((0, 1))
        dboth = de @ self.p["out"].T
        self._lstm_back(dboth[:, :, : self.hidden], x, tf, "f", grads)
        self._lstm_back(dboth[:, :, self.hidden :], x, tb, "b", grads)
        return float((total - gold).mean()), {k: g / batch for k, g in grads.items()}

    def fit(self, x, mask, tags, epochs: int = 16, batch: int = 64, rate: float = 0.02, seed: int = 5) -> list[float]:
        """Train on arrays (examples, length); the mean loss of every epoch."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        losses, n = [], 0
        for epoch in range(epochs):
            order, got = rng.permutation(len(x)), []
            for at in range(0, len(x), batch):
                rows = order[at : at + batch]
                loss, grads = self.loss_and_gradients(x[rows].T, mask[rows].T.astype(float), tags[rows].T)
                got.append(loss)
                n += 1
                size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                shrink = min(1.0, 5.0 / max(size, 1e-9))
                lr = rate * (1 - epoch / epochs) + 1e-3
                for k, g in grads.items():
                    g = g * shrink
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] -= lr * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.99**n)) + 1e-8)
            losses.append(float(np.mean(got)))
        return losses

    def single(self) -> Tagger:
        """The same model in single precision, for decoding."""
        self.p = {k: w.astype(np.float32) for k, w in self.p.items()}
        return self

    # -- decoding --------------------------------------------------------
    def decode(self, x, mask):
        """Best tags (examples, length) and, for each character, how far its
        scores stand above those of being outside (tag O after O)."""
        x, mask = np.ascontiguousarray(x.T), np.ascontiguousarray(mask.T)
        n, batch = x.shape
        e = self.emissions(x, mask.astype(np.float32))[0]
        step = (self.p["step"] + self.fixed_step).astype(e.dtype)
        score = (self.p["first"] + self.fixed_first).astype(e.dtype) + e[0]
        came = np.zeros((n, batch, self.tags), dtype=np.int8)
        stay = np.arange(self.tags, dtype=np.int8)
        for t in range(1, n):
            joint = score[:, :, None] + step
            back = joint.argmax(1)
            new = np.take_along_axis(joint, back[:, None, :], 1)[:, 0] + e[t]
            live = mask[t][:, None] > 0
            score = np.where(live, new, score)
            came[t] = np.where(live, back, stay)
        tag = (score + self.p["last"]).argmax(1)
        tags = np.zeros((n, batch), dtype=np.int8)
        at = np.arange(batch)
        for t in range(n - 1, -1, -1):
            tags[t] = tag
            tag = came[t][at, tag]
        own = np.take_along_axis(e, tags[:, :, None].astype(np.int64), 2)[:, :, 0]
        margin = own - e[:, :, 0]
        margin[1:] += step[tags[:-1], tags[1:]] - step[0, 0]
        return tags.T, margin.T
