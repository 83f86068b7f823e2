"""Character-level bidirectional LSTM with a CRF on top, in numpy: training and decoding."""

from __future__ import annotations

import numpy as np

#: Impossible transition.
NEVER = -1e4


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class BiLstmCrf:
    """Symbols -> embedding -> LSTM in both directions -> unary scores -> CRF."""

    def __init__(self, symbols: int, tags: int, allowed: np.ndarray, embed: int = 10, hidden: int = 14, seed: int = 3):
        rng = np.random.default_rng(seed)
        draw = lambda *s: rng.normal(0, 0.25, s)
        self.hidden = hidden
        self.p = {"E": draw(symbols, embed), "U": draw(2 * hidden, tags), "c": np.zeros(tags), "T": np.zeros((tags, tags))}
        for d in ("f", "b"):
            self.p |= {f"W{d}": draw(embed, 4 * hidden), f"R{d}": draw(hidden, 4 * hidden), f"v{d}": np.zeros(4 * hidden)}
            self.p[f"v{d}"][hidden : 2 * hidden] = 1.0  # gates are open to the past at first
        self.barred = np.where(allowed, 0.0, NEVER)

    def float32(self) -> BiLstmCrf:
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.barred = self.barred.astype(np.float32)
        return self

    def _lstm(self, x: np.ndarray, d: str, kept: list | None) -> np.ndarray:
        """x: (time, batch, embed) in reading order of direction d."""
        n = self.hidden
        w = x @ self.p[f"W{d}"] + self.p[f"v{d}"]
        h = np.zeros((x.shape[1], n), x.dtype)
        c = np.zeros_like(h)
        out = np.empty((x.shape[0], x.shape[1], n), x.dtype)
        for t in range(x.shape[0]):
            z = w[t] + h @ self.p[f"R{d}"]
            gates = _sigmoid(z[:, : 3 * n])
            i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
            g = np.tanh(z[:, 3 * n :])
            before = c
            c = f * c + i * g
            tc = np.tanh(c)
            if kept is not None:
                kept.append((i, f, o, g, before, tc, h))
            h = o * tc
            out[t] = h
        return out

    def unary(self, s: np.ndarray, kept: dict | None = None) -> np.ndarray:
        """Scores (time, batch, tags) of symbols (batch, time)."""
        x = self.p["E"][s.T]
        kf, kb = ([], []) if kept is not None else (None, None)
        hf = self._lstm(x, "f", kf)
        hb = self._lstm(x[::-1], "b", kb)[::-1]
        h = np.concatenate([hf, hb], 2)
        if kept is not None:
            kept |= {"x": x, "h": h, "kf": kf, "kb": kb}
        return h @ self.p["U"] + self.p["c"]

    def _lstm_back(self, dh: np.ndarray, x: np.ndarray, kept: list, d: str, grad: dict) -> np.ndarray:
        n = self.hidden
        R = self.p[f"R{d}"]
        dz = np.empty((x.shape[0], x.shape[1], 4 * n))
        next_h, next_c = np.zeros(dh.shape[1:]), np.zeros(dh.shape[1:])
        gR = np.zeros_like(R)
        for t in range(x.shape[0] - 1, -1, -1):
            i, f, o, g, before, tc, h0 = kept[t]
            a = dh[t] + next_h
            dc = next_c + a * o * (1 - tc * tc)
            dz[t, :, :n] = dc * g * i * (1 - i)
            dz[t, :, n : 2 * n] = dc * before * f * (1 - f)
            dz[t, :, 2 * n : 3 * n] = a * tc * o * (1 - o)
            dz[t, :, 3 * n :] = dc * i * (1 - g * g)
            gR += h0.T @ dz[t]
            next_h, next_c = dz[t] @ R.T, dc * f
        grad[f"R{d}"] = gR
        grad[f"W{d}"] = np.einsum("tbe,tbg->eg", x, dz)
        grad[f"v{d}"] = dz.sum((0, 1))
        return dz @ self.p[f"W{d}"].T

    def loss_and_gradients(self, s: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of tags y (batch, time), and gradients."""
        kept: dict = {}
        u = self.unary(s, kept)
        time, batch, k = u.shape
        trans = self.p["T"] + self.barred
        alpha, beta = np.empty_like(u), np.zeros_like(u)
        alpha[0] = u[0]
        for t in range(1, time):
            a = alpha[t - 1][:, :, None] + trans
            top = a.max(1)
            alpha[t] = u[t] + top + np.log(np.exp(a - top[:, None]).sum(1))
        for t in range(time - 2, -1, -1):
            a = trans + (u[t + 1] + beta[t + 1])[:, None, :]
            top = a.max(2)
            beta[t] = top + np.log(np.exp(a - top[:, :, None]).sum(2))
        top = alpha[-1].max(1)
        log_z = top + np.log(np.exp(alpha[-1] - top[:, None]).sum(1))
        yt = y.T
        du = np.exp(alpha + beta - log_z[None, :, None])
        pairs = np.zeros((k, k))
        for t in range(1, time):
            both = alpha[t - 1][:, :, None] + trans + (u[t] + beta[t])[:, None, :] - log_z[:, None, None]
            pairs += np.exp(both).sum(0)
        seen = np.zeros((k, k))
        np.add.at(seen, (yt[:-1].ravel(), yt[1:].ravel()), 1)
        tt, bb = np.meshgrid(range(time), range(batch), indexing="ij")
        gold = u[tt, bb, yt].sum() + trans[yt[:-1], yt[1:]].sum()
        du[tt, bb, yt] -= 1
        du /= batch
        grad = {"T": (pairs - seen) / batch, "c": du.sum((0, 1))}
        grad["U"] = np.einsum("tbh,tbk->hk", kept["h"], du)
        dh = du @ self.p["U"].T
        n = self.hidden
        x = kept["x"]
        dx = self._lstm_back(dh[:, :, :n], x, kept["kf"], "f", grad)
        dx = dx + self._lstm_back(dh[::-1, :, n:], x[::-1], kept["kb"], "b", grad)[::-1]
        grad["E"] = np.zeros_like(self.p["E"])
        np.add.at(grad["E"], s.T, dx)
        return float((log_z.sum() - gold) / batch), grad

    def fit(self, s: np.ndarray, y: np.ndarray, steps: int, batch: int = 48, rate: float = 0.02, seed: int = 4) -> list:
        """Adam over random batches; returns the losses."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        losses = []
        for step in range(1, steps + 1):
            some = rng.choice(len(s), batch)
            loss, grad = self.loss_and_gradients(s[some], y[some])
            losses.append(loss)
            pace = rate * min(1.0, 2.0 * (1 - step / (steps + 1)))
            for k, g in grad.items():
                g = np.clip(g, -5, 5)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                self.p[k] -= pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
        return losses

    def best_paths(self, scores: list[np.ndarray], at_once: int = 1 << 20) -> list[np.ndarray]:
        """The best tag sequence of each (characters, tags) array of scores, whatever their lengths."""
        trans = self.p["T"] + self.barred
        out: list = [None] * len(scores)
        order = sorted(range(len(scores)), key=lambda k: -len(scores[k]))
        while order:
            # As many as fit, the longest first.
            long = max(1, len(scores[order[0]]))
            group, order = order[: max(1, at_once // long)], order[max(1, at_once // long) :]
            size = np.array([len(scores[k]) for k in group])
            u = np.zeros((long, len(group), trans.shape[0]), np.float32)
            for j, k in enumerate(group):
                u[: size[j], j] = scores[k]
            back = np.zeros(u.shape, np.int8)
            best = u[0].copy()
            for t in range(1, long):
                n = int(np.searchsorted(-size, -t, "left"))  # those that go on
                a = best[:n, :, None] + trans
                back[t, :n] = a.argmax(1)
                best[:n] = np.take_along_axis(a, back[t, :n, None].astype(np.int64), 1)[:, 0] + u[t, :n]
            tag = best.argmax(1)
            path = np.zeros((long, len(group)), np.int8)
            for t in range(long - 1, -1, -1):
                n = int(np.searchsorted(-size, -t, "left"))
                path[t, :n] = tag[:n]
                if t:
                    tag[:n] = back[t, np.arange(n), tag[:n]]
            for j, k in enumerate(group):
                out[k] = path[: size[j], j]
        return out

    def decode(self, s: np.ndarray) -> np.ndarray:
        """Best tag sequences (batch, time) by Viterbi."""
        u = self.unary(s)
        time, batch, _ = u.shape
        trans = self.p["T"] + self.barred
        best, back = u[0], []
        for t in range(1, time):
            a = best[:, :, None] + trans
            back.append(a.argmax(1))
            best = np.take_along_axis(a, back[-1][:, None, :], 1)[:, 0] + u[t]
        tags = np.empty((batch, time), np.int8)
        tags[:, -1] = best.argmax(1)
        rows = np.arange(batch)
        for t in range(time - 2, -1, -1):
            tags[:, t] = back[t][rows, tags[:, t + 1]]
        return tags
