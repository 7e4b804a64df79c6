"""A character-level bidirectional LSTM with CRF transitions, in numpy, and the labelled spans that it is trained from."""

from __future__ import annotations

from functools import lru_cache
from pathlib import Path

import numpy as np

KINDS = ("email", "ip", "card", "phone")
#: O, then B and I of each kind.
TAGS = 1 + 2 * len(KINDS)
EMBED, HIDDEN = 16, 24
WINDOW, STRIDE = 96, 48
BATCHES, BATCH, RATE = 1100, 48, 0.012
_ALPHABET = 131
_BAD = -1e4


def codes(text: str) -> np.ndarray:
    """ASCII characters by number, 128 for other letters, 129 for the rest; 130 pads."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.minimum(raw, 129).astype(np.int64)
    for k in np.flatnonzero(raw >= 128):
        out[k] = 128 if text[k].isalpha() else 129
    return out


def allowed() -> np.ndarray:
    """0 where a tag may follow another, a large negative figure where I would begin a span."""
    out = np.zeros((TAGS, TAGS))
    for k in range(len(KINDS)):
        out[:, 2 + 2 * k] = _BAD
        out[1 + 2 * k, 2 + 2 * k] = out[2 + 2 * k, 2 + 2 * k] = 0
    return out


def _luhn(digits: list[int]) -> int:
    """The check digit after digits."""
    return -sum(d if k % 2 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(reversed(digits))) % 10


class _Writer:
    """Writes labelled windows: personal data in usual and in evasive spellings, among prose, codes, dates and sums."""

    def __init__(self, seed: int) -> None:
        self.rng = np.random.default_rng(seed)

    def pick(self, xs):
        return xs[int(self.rng.integers(len(xs)))]

    def digits(self, n: int) -> str:
        return "".join(map(str, self.rng.integers(0, 10, n)))

    def word(self) -> str:
        letters = "aeiouaeiounrstlmdhcvbpgfkéüñ"
        out = "".join(self.pick(letters) for _ in range(int(self.rng.integers(2, 9))))
        return out.capitalize() if self.rng.random() < 0.15 else out.upper() if self.rng.random() < 0.05 else out

    def label(self) -> str:
        return "".join(self.pick("abcdefghijklmnopqrstuvwxyz") for _ in range(int(self.rng.integers(3, 11))))

    def email(self) -> str:
        at, dot = self.pick([("@", "."), ("@", "."), (" @ ", " . "), (" @ ", "."), (" [at] ", "."), (" (at) ", "."), ("[at]", "."), (" [at] ", " [dot] "), (" (at) ", " (dot) "), ("[at]", "[dot]"), ("(at)", "(dot)"), (" at ", " dot "), (" AT ", " DOT "), ("{at}", "{dot}"), ("<at>", "."), (" at ", "."), (" at ", "."), ("＠", "."), ("＠", "．"), (" (ät) ", "."), ("[ät]", "."), (" (ät) ", " dot ")])
        # Beside a plain word for at and plain dots, only a name of more parts tells an address from "look at example.com".
        parts = [self.label() for _ in range(self.pick([2, 2, 3] if (at, dot) == (" at ", ".") else [1, 1, 2, 2, 3]))]
        joint = self.pick([".", ".", "_", "-"]) if (at, dot) == (" at ", ".") else self.pick([".", ".", "_", "-", "+"]) if dot != " dot " or self.rng.random() < 0.5 else dot
        name = joint.join(parts) + self.pick(["", "", self.digits(2), f".{self.digits(2)}"])
        return name + at + dot.join([*(self.label() for _ in range(self.pick([1, 1, 2, 2, 3]))), self.pick(["com", "org", "net", "de", "io", "fr", "edu", "es"])])

    def ip(self) -> str:
        return self.pick([".", ".", " . ", "[.]", "(.)", "[dot]", " dot ", ". "]).join(str(int(x)) for x in self.rng.integers(0, 256, 4))

    def card(self) -> str:
        size = self.pick([16, 16, 16, 16, 15])
        own = [self.pick([4, 5, 3]), *map(int, self.rng.integers(0, 10, size - 2))]
        own = "".join(map(str, [*own, _luhn(own)]))
        sep = self.pick(["", "", " ", "-", ".", "/", "_", " - ", "  "])
        cuts = range(0, 16, 4) if size == 16 else (0, 4, 10)
        return sep.join(own[k:e] for k, e in zip(cuts, [*cuts[1:], size]))

    def phone(self) -> str:
        a, b, c = self.digits(3), self.digits(3), self.digits(4)
        land = self.pick(["49", "33", "34", "44", "1"])
        return self.pick([f"+1 ({a}) {b}-{c}", f"+{land} {a} {b}{c}", f"+{land}/{a}/{b}{c}", f"({a}) {b}-{c}", f"({a}) {b} {c}", f"({a}){b}-{c}", f"{a}/{b}{c}", f"0{a}/{b}{c}", f"{a}.{b}.{c}", f"{a}-{b}-{c}", f"{a} {b} {c}", f"1-{a}-{b}-{c}", f"00{land} {a} {b}{c}", f"0{a} {b} {c}", f"{a} - {b} - {c}", f"0{a}-{b}{c}", f"({land}) {a} {b} {c}"])

    def other(self) -> str:
        hexes = "".join(self.pick("0123456789abcdef") for _ in range(self.pick([8, 18, 32, 40])))
        key = "".join(self.pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
        d = self.digits
        return self.pick([
            hexes, f'token = "{hexes}"', f"AKIA{key}", f"password={hexes[:18]}", f"{d(4)}-{d(2)}-{d(2)}", f"{d(2)}.{d(2)}.{d(4)}", f"{d(2)}/{d(2)}/{d(4)}", f"{d(1)}.{d(2)}", f"${d(2)},{d(3)}.{d(2)}", f"{d(1)}.{d(3)}.{d(3)}",
            f"v{d(1)}.{d(1)}.{d(2)}", f"{d(1)}.{d(1)}.{d(1)}", d(int(self.rng.integers(1, 9))), f"{d(2)}:{d(2)}", f"{d(2)}:{d(2)}:{d(2)}", f"id {d(15)}x", f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", f"{d(4)}-{d(4)}", f"{d(4)}/{d(2)}",
            f"{d(2)}.{d(4)}, {d(2)}.{d(4)}", f"{hexes[:8]}-{d(4)}-{d(4)}-{d(4)}-{hexes[:12].ljust(12, '0')}", f"no. {d(5)}, {d(4)}, {d(4)} and {d(3)}", f"{d(2)} {d(2)} {d(1)}", f"version {d(1)}.0.", "***", "###", "&&&",
            f"at {self.label()}.com", f"look at {self.label()}.org", f"{self.word()} at {self.label()}.de", f"({self.label()[:4]})", f"({self.word()})", "(ät)",
            "at the dot", "a dot at the end", "dot by dot", "at home", "meet at noon", "the dot com years", "look at it. Then", "[at]", "(see at end)", "[dot]", "@", "@ 5",
        ])

    def window(self) -> tuple[np.ndarray, np.ndarray]:
        """WINDOW characters from any place of a written text, and their tags; an edge may cut a span."""
        text, tags = "", []
        offset = int(self.rng.integers(0, WINDOW)) if self.rng.random() < 0.7 else 0
        while len(text) < WINDOW + offset:
            r = self.rng.random()
            if r < 0.14:
                kind = int(self.rng.integers(len(KINDS)))
                own = getattr(self, KINDS[kind])()
                if self.rng.random() < 0.25:
                    lead = self.pick(["at ", "me at ", "us at ", "to ", "write to ", "mail ", "call "])
                    text += lead
                    tags += [0] * len(lead)
                text += own
                tags += [1 + 2 * kind] + [2 + 2 * kind] * (len(own) - 1)
            else:
                own = self.other() if r < 0.26 else self.word()
                text += own
                tags += [0] * len(own)
            gap = self.pick([" ", " ", " ", " ", ", ", ". ", "\n", " | ", '" ', "; ", ": ", " (", ") "])
            text += gap
            tags += [0] * len(gap)
        text, tags = text[offset : offset + WINDOW], tags[offset : offset + WINDOW]
        if tags[0] and tags[0] % 2 == 0:
            tags[0] -= 1
        if self.rng.random() < 0.15:  # as at the end of a text
            text = text[: int(self.rng.integers(20, WINDOW))]
        out, gold = np.full(WINDOW, _ALPHABET - 1), np.zeros(WINDOW, np.int64)
        out[: len(text)], gold[: len(text)] = codes(text), tags[: len(text)]
        return out, gold


def _lstm(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray):
    """x: (time, batch, EMBED). The hidden states, and what the gradient needs."""
    n, batch, _ = x.shape
    h, c = np.zeros((batch, HIDDEN)), np.zeros((batch, HIDDEN))
    hs, cs, gates = np.zeros((n + 1, batch, HIDDEN)), np.zeros((n + 1, batch, HIDDEN)), np.zeros((n, batch, 4 * HIDDEN))
    inputs = x @ wx + b
    for t in range(n):
        a = inputs[t] + h @ wh
        s = 1 / (1 + np.exp(-a[:, : 3 * HIDDEN]))
        g = np.tanh(a[:, 3 * HIDDEN :])
        c = s[:, :HIDDEN] * c + s[:, HIDDEN : 2 * HIDDEN] * g
        h = s[:, 2 * HIDDEN :] * np.tanh(c)
        hs[t + 1], cs[t + 1], gates[t, :, : 3 * HIDDEN], gates[t, :, 3 * HIDDEN :] = h, c, s, g
    return hs, cs, gates


def _lstm_back(dh_all, x, hs, cs, gates, wx, wh):
    n, batch, _ = x.shape
    dh, dc = np.zeros((batch, HIDDEN)), np.zeros((batch, HIDDEN))
    da_all = np.zeros_like(gates)
    for t in range(n - 1, -1, -1):
        dh = dh + dh_all[t]
        f, i, o, g = (gates[t][:, k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
        tc = np.tanh(cs[t + 1])
        dc = dc + dh * o * (1 - tc * tc)
        da = np.concatenate((dc * cs[t] * f * (1 - f), dc * g * i * (1 - i), dh * tc * o * (1 - o), dc * i * (1 - g * g)), axis=1)
        da_all[t] = da
        dh, dc = da @ wh.T, dc * f
    return da_all @ wx.T, np.einsum("tbe,tbg->eg", x, da_all), np.einsum("tbh,tbg->hg", hs[:-1], da_all), da_all.sum(axis=(0, 1))


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return np.log(np.exp(a - top).sum(axis=axis)) + np.squeeze(top, axis)


class Tagger:
    def __init__(self, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        normal = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.p = {"e": rng.normal(0, 0.5, (_ALPHABET, EMBED)), "o": normal(2 * HIDDEN, TAGS), "ob": np.zeros(TAGS), "t": np.zeros((TAGS, TAGS))}
        for d in "fb":
            bias = np.zeros(4 * HIDDEN)
            bias[:HIDDEN] = 1
            self.p |= {f"{d}x": normal(EMBED, 4 * HIDDEN), f"{d}h": normal(HIDDEN, 4 * HIDDEN), f"{d}c": bias}

    def _emit(self, x: np.ndarray):
        p, seq = self.p, self.p["e"][x.T]
        ahead = _lstm(seq, p["fx"], p["fh"], p["fc"])
        back = _lstm(seq[::-1], p["bx"], p["bh"], p["bc"])
        both = np.concatenate((ahead[0][1:], back[0][1:][::-1]), axis=2)
        return both @ p["o"] + p["ob"], both, seq, ahead, back

    def _marginals(self, emit: np.ndarray, trans: np.ndarray):
        n = len(emit)
        alpha, beta = np.zeros_like(emit), np.zeros_like(emit)
        alpha[0] = emit[0] + allowed()[0]
        for t in range(1, n):
            alpha[t] = emit[t] + _logsum(alpha[t - 1][:, :, None] + trans, 1)
        for t in range(n - 2, -1, -1):
            beta[t] = _logsum(trans + (emit[t + 1] + beta[t + 1])[:, None, :], 2)
        z = _logsum(alpha[-1], 1)
        return alpha, beta, z

    def gradients(self, x: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The mean loss of a batch (batch, time) and its gradients."""
        p, gold, batch = self.p, gold.T, x.shape[0]
        emit, both, seq, ahead, back = self._emit(x)
        trans = p["t"] + allowed()
        alpha, beta, z = self._marginals(emit, trans)
        one = np.eye(TAGS)[gold]
        d_emit = (np.exp(alpha + beta - z[None, :, None]) - one) / batch
        pair = np.exp(alpha[:-1, :, :, None] + trans + (emit[1:] + beta[1:])[:, :, None, :] - z[None, :, None, None]).sum(axis=(0, 1))
        d_trans = (pair - np.einsum("tbi,tbj->ij", one[:-1], one[1:])) / batch
        score = (emit * one).sum() + trans[gold[:-1], gold[1:]].sum() + allowed()[0][gold[0]].sum()
        g = {"t": np.where(allowed() < 0, 0, d_trans), "o": np.einsum("tbh,tbk->hk", both, d_emit), "ob": d_emit.sum(axis=(0, 1))}
        d_both = d_emit @ p["o"].T
        dx, g["fx"], g["fh"], g["fc"] = _lstm_back(d_both[:, :, :HIDDEN], seq, *ahead, p["fx"], p["fh"])
        dy, g["bx"], g["bh"], g["bc"] = _lstm_back(d_both[::-1, :, HIDDEN:], seq[::-1], *back, p["bx"], p["bh"])
        g["e"] = np.zeros_like(p["e"])
        np.add.at(g["e"], x.T, dx + dy[::-1])
        return float((z.sum() - score) / batch), g

    def fit(self, batches: int = BATCHES, seed: int = 11) -> Tagger:
        """Adam over windows written anew for each batch."""
        writer = _Writer(seed)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        for step in range(1, batches + 1):
            found = [writer.window() for _ in range(BATCH)]
            _, g = self.gradients(np.stack([x for x, _ in found]), np.stack([y for _, y in found]))
            norm = np.sqrt(sum((a * a).sum() for a in g.values()))
            rate = RATE * (1 - step / (batches + 1)) * min(1, step / 20)
            for k, a in g.items():
                a = a * min(1, 5 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * a
                v[k] = 0.99 * v[k] + 0.01 * a * a
                self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return self

    def spans(self, x: np.ndarray) -> list[list[tuple[int, int, int, float]]]:
        """Of each window (batch, time), the spans (start, end, kind, confidence) of its best path.

        Confidence is the least marginal probability of the path's tags in the span.
        """
        emit = self._emit(x)[0]
        trans, n = self.p["t"] + allowed(), len(emit)
        alpha, beta, z = self._marginals(emit, trans)
        marginal = np.exp(alpha + beta - z[None, :, None])
        best, came = emit[0] + allowed()[0], np.zeros((n, x.shape[0], TAGS), np.int64)
        for t in range(1, n):
            every = best[:, :, None] + trans
            came[t] = every.argmax(axis=1)
            best = every.max(axis=1) + emit[t]
        path = np.zeros((n, x.shape[0]), np.int64)
        path[-1] = best.argmax(axis=1)
        for t in range(n - 1, 0, -1):
            path[t - 1] = came[t][np.arange(x.shape[0]), path[t]]
        out = []
        for b in range(x.shape[0]):
            found, start = [], None
            for t in range(n + 1):
                tag = path[t, b] if t < n else 0
                if start is not None and not (tag and tag % 2 == 0):
                    sure = min(marginal[k, b, path[k, b]] for k in range(start, t))
                    found.append((start, t, int(path[start, b] - 1) // 2, float(sure)))
                    start = None
                if tag % 2 == 1:
                    start = t
            out.append(found)
        return out


#: What `python -m gneiss.llm.pii_model` wrote: the parameters that fit() finds, in the order of Tagger().p.
WEIGHTS = Path(__file__).with_name("pii_weights.npz")


@lru_cache(maxsize=1)
def trained() -> Tagger:
    """The fitted tagger: the stored parameters where they are there, else fitted anew, which takes some minutes."""
    if not WEIGHTS.exists():
        return Tagger().fit()
    tagger = Tagger()
    with np.load(WEIGHTS) as stored:
        tagger.p = {k: stored[k].astype(np.float64) for k in tagger.p}
    return tagger


if __name__ == "__main__":
    np.savez_compressed(WEIGHTS, **{k: v.astype(np.float32) for k, v in Tagger().fit().p.items()})
