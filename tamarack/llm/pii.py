"""Personal data: fixed recognisers, and a character-level BiLSTM-CRF that adds spans.

The network reads characters (ASCII ones each by an embedding of its own, others by one of a fixed number
that their code points share), runs one LSTM each way over windows of a text and scores nine labels for
each character: plain, and the beginning and inside of each kind. A linear-chain CRF scores their
transitions. It is trained in numpy by gradient descent on texts built with labelled spans.

A long text is covered by overlapping windows. Where a window's scores leave no room for any label but the
plain one, that is the best path there. Everything else is decoded globally: over each stretch of characters that
may bear another label the scores of all windows that hold them are averaged, each weighted by how deep a character
lies in it, and one Viterbi pass runs over the whole stretch, whatever its length and however many windows it
crosses. Nothing depends on which texts come in the same batch.

Base spans always stay. A span of the network is added where it overlaps no base span and holds
enough digits (or an address sign) for its kind.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tamarack.llm import kernels
from tamarack.llm.shared import column, ddl, neutral, text_in_place, unclashed

KINDS = ("email", "ip", "card", "phone")
#: Characters of a window and how many it shares with the next one; units of each LSTM; windows run at once.
WINDOW, OVERLAP, UNITS, BATCH = 256, 32, 8, 1024
#: Steps of training.
STEPS = 1000
#: Plain characters on either side of a stretch that is decoded.
MARGIN = 16
#: Products of matrices round alike for every column where their number is a multiple of this.
COLUMNS = 64
EMBED, LABELS = 6, 1 + 2 * len(KINDS)
#: Embeddings that characters beyond ASCII share, and of all.
OTHERS = 64
ALPHABET = 128 + OTHERS
#: Characters times stretches that one pass over back pointers holds.
STRETCH_CELLS = 1 << 21

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A start inside a run of digits, or a shorter run, finds nothing that the whole run does not.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each sign outwards: a scan from every letter would read each word once per letter."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and (text[start - 1].isascii() and text[start - 1].isalnum() or text[start - 1] in "._%+-"):
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            out.append(m.span())
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind by the fixed patterns; matches that fail their check are dropped without another try."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = emails(text)
    if not HAS_DIGIT.search(text):
        return out
    out["ip"] = [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out["card"].append(m.span())
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                out["phone"].append(m.span())
    return out


HAS_DIGIT = re.compile(r"[0-9]")


def characters(text: str) -> np.ndarray:
    """The embedding of each character."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.where(codes < 128, codes, 128 + codes % OTHERS).astype(np.uint8)


# --- training text ------------------------------------------------------------------------------


#: Where made-up words take their letters and endings from.
LETTERS = ("abcdefghijklmnopqrstuvwxyz", "aaeeiioouulnrstdmpc", "aeioulnrstdmpcéüñäößçàèê")


def _digits(rng: np.random.Generator, k: int) -> str:
    return "".join(map(str, rng.integers(0, 10, k)))


def _name(rng: np.random.Generator) -> str:
    return "".join(LETTERS[1][i] for i in rng.integers(0, len(LETTERS[1]), rng.integers(2, 9)))


def made_up_word(rng: np.random.Generator) -> str:
    letters = LETTERS[rng.integers(0, 3)]
    w = "".join(letters[i] for i in rng.integers(0, len(letters), rng.integers(1, 11)))
    kind = rng.random()
    if kind < 0.12:
        w = w.title()
    elif kind < 0.16:
        w = w.upper() + "!!"
    elif kind < 0.2:
        w += "***%%%&&&###$$$"[(k := 3 * int(rng.integers(0, 5))) : k + 3]
    elif kind < 0.24:
        w = str(rng.integers(0, 10 ** int(rng.integers(1, 7))))  # plain numbers are not personal
    elif kind < 0.26:
        w = f"{rng.integers(1, 40)}.{rng.integers(0, 20)}" + (f".{rng.integers(0, 9)}" if rng.random() < 0.4 else "")
    elif kind < 0.28:
        w = f"{rng.integers(1900, 2030)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}"
    elif kind < 0.30:
        w = f"{rng.integers(0, 24):02d}:{rng.integers(0, 60):02d}" if rng.random() < 0.5 else f"{rng.integers(1, 999)},{_digits(rng, 3)}.{_digits(rng, 2)}"
    elif kind < 0.32:
        w = "".join(chr(c) for c in rng.integers(33, 127, rng.integers(1, 7)) if c != ord("@"))
    elif kind < 0.34:
        w = "".join(chr(c) for c in rng.integers(0xA1, 0x3000, rng.integers(1, 6)))
    return w + ("", "", "", "", ".", ",", ":", ";")[rng.integers(0, 8)]


def personal(rng: np.random.Generator, missed: bool = False) -> tuple[int, str]:
    """(number of a kind, text); ``missed``: only spellings that the fixed patterns do not find."""
    kind = int(rng.integers(0, 4))
    if kind == 1 and missed:
        kind = 3
    if kind == 0:
        name = _name(rng) + ("", "." + _name(rng), str(rng.integers(0, 99)), "." + str(rng.integers(0, 99)))[rng.integers(0, 4)]
        host = _name(rng) + str(rng.integers(0, 9)) * int(rng.integers(0, 2)) + "." + ("com", "example.com", "org", "net", "example.net")[rng.integers(0, 5)]
        return kind, name + (" @ " if missed or rng.random() < 0.25 else "@") + host
    if kind == 1:
        return kind, ".".join(str(x) for x in rng.integers(0, 256, 4))
    if kind == 2:
        sep = "." if missed else ("", " ", "-", ".")[rng.integers(0, 4)]
        body = _digits(rng, 15)
        body += next(c for c in "0123456789" if luhn(body + c))
        return kind, sep.join(body[k : k + 4] for k in range(0, 16, 4))
    area, three, four, land = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4), rng.integers(1, 99)
    forms = (f"({area}) {three}-{four}", f"{area}-{three}-{four}", f"+{land} ({area}) {three}-{four}", f"+{land} {area} {three} {four}", f"+{land}{_digits(rng, 9)}")
    return kind, forms[rng.integers(0, 2 if missed else 5)]


def labelled_text(rng: np.random.Generator, length: int, share: float = 0.05, missed: bool = False) -> tuple[str, list[tuple[int, int, int]]]:
    """Made-up prose of ``length`` characters at least, and its spans (number of a kind, start, end)."""
    parts, marks, size = [], [], 0
    while size < length:
        if rng.random() < (0.25 if marks and marks[-1][2] == size - 1 else share):  # now and then one after another
            kind, t = personal(rng, missed)
            marks.append((kind, size, size + len(t)))
        else:
            t = made_up_word(rng)
        t += ("\n" if rng.random() < 0.03 else " ") if not marks or marks[-1][2] != size + len(t) or rng.random() < 0.8 else (", ", ". ", "; ")[rng.integers(0, 3)]
        parts.append(t)
        size += len(t)
    return "".join(parts), marks


def label_row(marks: list[tuple[int, int, int]], size: int) -> np.ndarray:
    out = np.zeros(size, np.int8)
    for kind, a, b in marks:
        out[a:b] = 2 + 2 * kind
        out[a] = 1 + 2 * kind
    return out


def labelled_windows(rng: np.random.Generator, n: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(n, length) characters and labels of windows of labelled texts."""
    x, y = np.zeros((n, length), np.uint8), np.zeros((n, length), np.int8)
    for i in range(n):
        text, marks = labelled_text(rng, length + 20)
        off = int(rng.integers(0, 20))
        x[i], y[i] = characters(text)[off : off + length], label_row(marks, len(text))[off : off + length]
    return x, y


def _forbidden() -> np.ndarray:
    """What the inside of a kind may not follow: a fixed cost of transitions."""
    out = np.zeros((LABELS, LABELS), np.float32)
    for k in range(len(KINDS)):
        out[:, 2 + 2 * k] = -50
        out[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = 0
    return out


FORBIDDEN = _forbidden()


class Network:
    """Both LSTMs, the label scores and the CRF transitions, with their gradients."""

    def __init__(self, seed: int = 4):
        rng = np.random.default_rng(seed)
        g, labels = 4 * UNITS, LABELS
        draw = lambda *s: (rng.standard_normal(s) * 0.3).astype(np.float32)
        self.p = {"embed": draw(ALPHABET, EMBED), "out": draw(2 * UNITS, labels), "bias": np.zeros(labels, np.float32), "trans": np.zeros((labels, labels), np.float32)}
        for way in "fb":
            self.p[f"w{way}"] = draw(EMBED + UNITS + 1, g)
            self.p[f"w{way}"][-1, UNITS : 2 * UNITS] = 1  # remember at first

    def _lstm(self, x: np.ndarray, w: np.ndarray):
        """x (time, way, batch, embed) and w (way, inputs, gates) -> hidden (time, way, batch, units), with what the gradient needs."""
        steps, ways, n, _ = x.shape
        h, c = np.zeros((ways, n, UNITS), x.dtype), np.zeros((ways, n, UNITS), x.dtype)
        one, hidden, kept = np.ones((ways, n, 1), x.dtype), np.zeros((steps, ways, n, UNITS), x.dtype), []
        for t in range(steps):
            z = np.concatenate([x[t], h, one], axis=2)
            a = z @ w
            gates, g = 1 / (1 + np.exp(-a[:, :, : 3 * UNITS])), np.tanh(a[:, :, 3 * UNITS :])
            i, f, o = gates[:, :, :UNITS], gates[:, :, UNITS : 2 * UNITS], gates[:, :, 2 * UNITS :]
            before, c = c, f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            hidden[t] = h
            kept.append((z, i, f, o, g, before, tc))
        return hidden, kept

    def _lstm_back(self, grad: np.ndarray, kept: list, w: np.ndarray):
        steps, ways, n, _ = grad.shape
        dw, dx = np.zeros_like(w), np.zeros((steps, ways, n, EMBED), grad.dtype)
        dh, dc = np.zeros((ways, n, UNITS), grad.dtype), np.zeros((ways, n, UNITS), grad.dtype)
        back = w.transpose(0, 2, 1)
        for t in range(steps - 1, -1, -1):
            z, i, f, o, g, before, tc = kept[t]
            dh = dh + grad[t]
            dc = dc + dh * o * (1 - tc * tc)
            da = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=2)
            dw += z.transpose(0, 2, 1) @ da
            dz = da @ back
            dx[t], dh, dc = dz[:, :, :EMBED], dz[:, :, EMBED : EMBED + UNITS], dc * f
        return dw, dx

    def _hidden(self, x: np.ndarray):
        """Both ways' states (time, batch, 2 * units) of windows (batch, time)."""
        e = self.p["embed"][x.T]
        h, kept = self._lstm(np.stack([e, e[::-1]], axis=1), np.stack([self.p["wf"], self.p["wb"]]))
        return np.concatenate([h[:, 0], h[::-1, 1]], axis=2), kept

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean negative log likelihood of the CRF over (batch, time) windows, and its gradient."""
        p, n, steps = self.p, len(x), x.shape[1]
        h, kept = self._hidden(x)
        scores = (h @ p["out"] + p["bias"]).astype(np.float64)
        trans = (p["trans"] + FORBIDDEN).astype(np.float64)
        # forward and backward sums, scaled to one at each step
        top = scores.max(axis=2, keepdims=True)
        odds, ways = np.exp(scores - top), np.exp(trans)
        alpha, beta, scale = np.zeros_like(odds), np.ones_like(odds), np.zeros((steps, n, 1))
        for t in range(steps):
            now = odds[t] if t == 0 else (alpha[t - 1] @ ways) * odds[t]
            scale[t] = now.sum(axis=1, keepdims=True)
            alpha[t] = now / scale[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = (odds[t + 1] * beta[t + 1]) @ ways.T / scale[t + 1]
        z = (np.log(scale) + top).sum()
        yt, at, rows = y.T.astype(int), np.arange(steps)[:, None], np.arange(n)
        gold = scores[at, rows, yt].sum() + trans[yt[:-1], yt[1:]].sum()
        d = alpha * beta
        d[at, rows, yt] -= 1
        dtrans = ways * np.tensordot(alpha[:-1], odds[1:] * beta[1:] / scale[1:], ((0, 1), (0, 1)))
        np.add.at(dtrans, (yt[:-1], yt[1:]), -1)
        d = (d / (n * steps)).astype(h.dtype)
        grad = {"out": np.tensordot(h, d, ((0, 1), (0, 1))), "bias": d.sum(axis=(0, 1)), "trans": (dtrans / (n * steps)).astype(h.dtype)}
        dh = d @ p["out"].T
        both, dx = self._lstm_back(np.stack([dh[:, :, :UNITS], dh[::-1, :, UNITS:]], axis=1), kept, np.stack([p["wf"], p["wb"]]))
        grad["wf"], grad["wb"] = both
        flat, dx = x.T.ravel(), (dx[:, 0] + dx[::-1, 1]).reshape(-1, EMBED)
        grad["embed"] = np.stack([np.bincount(flat, dx[:, k], ALPHABET) for k in range(EMBED)], axis=1).astype(h.dtype)
        return float((z - gold) / (n * steps)), grad

    def fit(self, steps: int, batch: int = 128, length: int = 64, seed: int = 11) -> Network:
        rng = np.random.default_rng(seed)
        x, y = labelled_windows(rng, 6000, length)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            at = rng.integers(0, len(x), batch)
            _, grad = self.loss(x[at], y[at])
            rate = 0.03 * min(1, 4 * (1 - step / (steps + 1)))
            for k, g in grad.items():  # Adam
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return self

    # --- decoding ---

    def _run(self, x: np.ndarray, width: np.ndarray, way: str) -> np.ndarray:
        """Hidden states (time, units, batch) of windows (time, batch) read forwards, or backwards from their ends.

        Units come first, so every step works on long rows; the gates are one product over the embedding,
        the hidden state and a constant, and sigmoids are tanh of half their argument, so one call serves all.
        """
        steps, n = x.shape
        w = self.p[f"w{way}"].T.copy()
        w[: 3 * UNITS] *= 0.5
        embed = self.p["embed"].T.copy()
        z = np.ones((EMBED + UNITS + 1, n), np.float32)
        z[EMBED:-1] = 0
        c, a, tc = np.zeros((UNITS, n), np.float32), np.empty((4 * UNITS, n), np.float32), np.empty((UNITS, n), np.float32)
        hidden = np.empty((steps, UNITS, n), np.float32)
        least = int(width.min())
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            np.take(embed, x[t], axis=1, out=z[:EMBED], mode="clip")
            np.matmul(w, z, out=a)
            np.tanh(a, out=a)
            gates = a[: 3 * UNITS]
            gates += 1
            gates *= 0.5
            i, f, o, g = (a[k * UNITS : (k + 1) * UNITS] for k in range(4))
            c *= f
            i *= g
            c += i
            np.tanh(c, out=tc)
            np.multiply(o, tc, out=hidden[t])
            if way == "b" and t >= least:  # a window begins at its own last character, with nothing behind it
                c *= t < width
                hidden[t] *= t < width
            z[EMBED:-1] = hidden[t]
        return hidden

    def scores(self, x: np.ndarray, width: np.ndarray) -> np.ndarray:
        """Scores (time, labels, batch) of windows (batch, time), each of its own width; what lies beyond means nothing."""
        n, steps = x.shape
        full = -(-n // COLUMNS) * COLUMNS
        xt = np.zeros((steps, full), np.int64)
        xt[:, :n] = x.T
        wide = np.full(full, steps)
        wide[:n] = width
        hf, hb = self._run(xt, wide, "f"), self._run(xt, wide, "b")
        of, ob = self.p["out"][:UNITS].T.copy(), self.p["out"][UNITS:].T.copy()
        out = np.matmul(of, hf)
        out += np.matmul(ob, hb)
        out += self.p["bias"][:, None]
        return out[:, :, :n]

    def live(self, scores: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows where a label but the plain one can pay, and for each of them (time, windows): the characters that may bear one.

        Each kind's best gain over the plain label is followed from character to character: it begins with the kind's
        first label, after the plain one or another kind, goes on with its inside, and pays where it outweighs the way
        back. What follows a character is bounded in the same way from the other end.
        """
        trans = self.p["trans"] + FORBIDDEN
        first, inner = np.arange(1, LABELS, 2), np.arange(2, LABELS, 2)
        begin = scores[:, first] - scores[:, :1]
        go_on = scores[:, inner] - scores[:, :1] + (np.maximum(trans[first, inner], trans[inner, inner]) - trans[0, 0])[:, None]
        enter = (trans[0, first] - trans[0, 0])[:, None]
        change = (np.maximum(trans[np.ix_(first, first)], trans[np.ix_(inner, first)]).max(axis=1) - trans[0, 0])[:, None]
        leave = np.maximum(np.maximum(trans[first, 0], trans[inner, 0]) - trans[0, 0], 0)[:, None]
        gains, least = np.empty_like(begin), int(width.min())
        gain = begin[0] + np.maximum(enter, 0)
        gains[0] = gain
        for t in range(1, len(scores)):
            fresh = np.maximum((gain + change).max(axis=0), enter)
            fresh += begin[t]
            gain = np.maximum(gain + go_on[t], fresh, out=gains[t])
            if t >= least:
                gain[:, t >= width] = -1e9
        asked = np.flatnonzero((gains.max(axis=0) + leave > 0).any(axis=0))
        out = np.zeros((len(scores), len(asked)), bool)
        if len(asked):
            begin, go_on, ends = begin[:, :, asked], go_on[:, :, asked], width[asked] - 1
            rest = np.broadcast_to(leave, begin[0].shape)
            for t in range(len(scores) - 1, -1, -1):
                if t + 1 < len(scores):
                    rest = np.maximum(np.maximum(rest + go_on[t + 1], (rest + begin[t + 1]).max(axis=0) + change), leave)
                rest = np.where(t >= ends, leave, rest)
                out[t] = (gains[t][:, asked] + rest > 0).any(axis=0)
        return asked, out

    def decode(self, stretches: list[np.ndarray]) -> list[np.ndarray]:
        """The best labels of each stretch (time, labels) of scores; an inside cannot come first."""
        trans = (self.p["trans"] + FORBIDDEN)[:, :, None]
        out: list[np.ndarray] = [np.zeros(0, np.uint8)] * len(stretches)
        order = sorted(range(len(stretches)), key=lambda i: -len(stretches[i]))
        while order:
            some = order[: max(1, STRETCH_CELLS // len(stretches[order[0]]))]
            order = order[len(some) :]
            sizes = np.array([len(stretches[i]) for i in some])  # the longest come first
            going = np.searchsorted(-sizes, -np.arange(int(sizes[0])), "left")  # stretches that reach beyond each place
            scores = np.zeros((int(sizes[0]), LABELS, len(some)), np.float32)
            for j, i in enumerate(some):
                scores[: sizes[j], :, j] = stretches[i]
            scores[0, 2::2] -= 50
            back, best = np.zeros(scores.shape, np.uint8), scores[0]
            labels = np.zeros(len(some), np.int64)
            for t in range(1, len(scores)):
                k = int(going[t])
                if k < best.shape[1]:
                    labels[k : best.shape[1]] = best[:, k:].argmax(axis=0)
                ways = best[:, None, :k] + trans
                back[t, :, :k] = ways.argmax(axis=0)
                best = ways.max(axis=0) + scores[t, :, :k]
            labels[: best.shape[1]] = best.argmax(axis=0)
            path = np.zeros((len(scores), len(some)), np.uint8)
            for t in range(len(scores) - 1, -1, -1):
                k = int(going[t])
                path[t, :k] = labels[:k]
                labels[:k] = back[t, labels[:k], np.arange(k)]
            for j, i in enumerate(some):
                out[i] = path[: sizes[j], j]
        return out


_networks: dict[tuple[int, int], Network] = {}


def network(steps: int = STEPS, seed: int = 4) -> Network:
    """The trained network; training is the same in every run, so a driver does it once."""
    if (steps, seed) not in _networks:
        _networks[steps, seed] = Network(seed).fit(steps)
    return _networks[steps, seed]


def window_starts(n: int) -> list[int]:
    """Starts of the windows that cover a text of n characters, neighbours sharing OVERLAP."""
    if n <= WINDOW:
        return [0]
    step = WINDOW - OVERLAP
    return [*range(0, n - WINDOW, step), n - WINDOW]


def depth(a: int, size: int, n: int) -> np.ndarray:
    """How far each character of a window lies from an edge that is not the text's, OVERLAP at most."""
    place = np.arange(size)
    left = place + 1 if a else np.full(size, OVERLAP)
    right = size - place if a + size < n else np.full(size, OVERLAP)
    return np.minimum(np.minimum(left, right), OVERLAP).astype(np.float32)


def plausible(kind: str, text: str) -> bool:
    digits = NOT_DIGIT.sub("", text)
    if kind == "email":
        return "@" in text and "." in text.split("@")[-1] and len(text) >= 6
    if kind == "ip":
        return IP.fullmatch(text) is not None and all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in text.split("."))
    if set(text) - set("0123456789 +().-"):
        return False
    return 13 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15


def word_at(text: str, at: int) -> tuple[int, int]:
    """Bounds of the run of letters and digits around a place."""
    a, b = at, at + 1
    while a > 0 and text[a - 1].isalnum():
        a -= 1
    while b < len(text) and text[b].isalnum():
        b += 1
    return a, b


def added_spans(text: str, labels: np.ndarray, taken: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Spans of the network's labels, trimmed of what cannot end one, that overlap nothing found before."""
    at = np.flatnonzero(labels % 2)
    stops = np.append(np.flatnonzero((labels == 0) | (labels % 2 == 1)), len(labels))
    ends = stops[np.searchsorted(stops, at, "right")]
    covered, out = np.zeros(len(text), bool), []
    for a, b in taken:
        covered[a:b] = True
    word, refused = (0, 0), set()
    for a, b in zip(at.tolist(), ends.tolist(), strict=True):
        name = KINDS[(int(labels[a]) - 1) // 2]
        # whole words: a label that breaks off inside a word goes on to its end; a word's bounds are looked for once
        if b < len(text) and text[b - 1].isalnum() and text[b].isalnum():
            word = word if word[0] <= b < word[1] else word_at(text, b)
            b = word[1]
        if a > 0 and text[a].isalnum() and text[a - 1].isalnum():
            word = word if word[0] <= a < word[1] else word_at(text, a)
            a = word[0]
        if (name, a, b) in refused:
            continue
        refused.add((name, a, b))
        while a < b and not (text[a].isalnum() or text[a] in "+("):
            a += 1
        while a < b and not text[b - 1].isalnum():
            b -= 1
        if a < b and not covered[a:b].any() and plausible(name, text[a:b]):
            out.append((name, a, b))
            covered[a:b] = True
    return out


class Finder:
    """Finds spans in lists of texts, window by window over all of them."""

    def __init__(self, model: Network):
        self.model = model

    def _batches(self, joined, first, width):
        """(windows, their scores) in batches, in the order of their widths."""
        order = np.argsort(width, kind="stable")
        for a in range(0, len(order), BATCH):
            rows = order[a : a + BATCH]
            place = np.arange(int(width[rows].max()))
            x = joined[np.minimum(first[rows, None] + place, len(joined) - 1)]
            x[place >= width[rows, None]] = 0
            yield rows, self.model.scores(x, width[rows])

    def labels(self, texts: list[str]) -> list[np.ndarray]:
        """The best labels of each text's characters; none for a text that is plain throughout."""
        out = [np.zeros(0, np.uint8)] * len(texts)
        joined = characters("".join(texts))
        sizes = np.array([len(t) for t in texts], np.int64)
        begins = np.cumsum(sizes) - sizes
        each = [window_starts(n) if n else [] for n in sizes.tolist()]
        starts = np.array([a for s in each for a in s], np.int64)
        if not len(starts):
            return out
        owner = np.repeat(np.arange(len(texts)), [len(s) for s in each])
        first, width = begins[owner] + starts, np.minimum(WINDOW, sizes[owner] - starts)
        ranges = []
        for rows, scores in self._batches(joined, first, width):
            asked, live = self.model.live(scores, width[rows])
            t, j = np.nonzero(live)
            ranges.append(first[rows[asked[j]]] + t)
        at = np.unique(np.concatenate(ranges))  # places in the joined texts
        if not len(at):
            return out
        text = np.searchsorted(begins + sizes, at, "right")
        apart = np.flatnonzero((np.diff(at) > 2 * MARGIN) | (np.diff(text) > 0)) + 1
        heads, tails = np.concatenate([[0], apart]), np.append(apart, len(at)) - 1
        lo = np.maximum(at[heads] - MARGIN, begins[text[heads]])
        hi = np.minimum(at[tails] + 1 + MARGIN, (begins + sizes)[text[heads]])
        chosen = np.flatnonzero(np.searchsorted(hi, first, "right") < np.searchsorted(lo, first + width, "left"))
        sums = [np.zeros((n, LABELS), np.float32) for n in (hi - lo).tolist()]
        weights = [np.zeros((len(s), 1), np.float32) for s in sums]
        for rows, scores in self._batches(joined, first[chosen], width[chosen]):
            for column_, w in enumerate(chosen[rows].tolist()):
                a, size = int(first[w]), int(width[w])
                deep = depth(int(starts[w]), size, int(sizes[owner[w]]))[:, None]
                for g in range(int(np.searchsorted(hi, a, "right")), int(np.searchsorted(lo, a + size, "left"))):
                    x, y = max(a, int(lo[g])), min(a + size, int(hi[g]))
                    sums[g][x - lo[g] : y - lo[g]] += scores[x - a : y - a, :, column_] * deep[x - a : y - a]
                    weights[g][x - lo[g] : y - lo[g]] += deep[x - a : y - a]
        for g, path in enumerate(self.model.decode([s / w for s, w in zip(sums, weights, strict=True)])):
            if path.any():
                i = text[heads[g]]
                if not len(out[i]):
                    out[i] = np.zeros(sizes[i], np.uint8)
                out[i][lo[g] - begins[i] : hi[g] - begins[i]] = path
        return out

    def find(self, texts: list[str]) -> list[tuple[dict, list[tuple[str, int, int]]]]:
        """(base spans by kind, added spans) of each text."""
        out = []
        for text, labels in zip(texts, self.labels(texts), strict=True):
            base = base_spans(text)
            more = added_spans(text, labels, [s for k in KINDS for s in base[k]]) if len(labels) else []
            out.append((base, more))
        return out


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _in_parts(column_: pa.Array):
    """Lists of texts of about a slice's bytes."""
    _, offsets = kernels.buffers(column_)
    for a, b in kernels.slices(offsets, 1 << 20):
        yield a, [x or "" for x in column_.slice(a, b - a).to_pylist()]


def _find(model: Network):
    def run(batches):
        finder, names = Finder(model), [c.split()[0] for c in FOUND.split(", ")]
        for batch in batches:
            for a, texts in _in_parts(batch.column("text")):
                rows = []
                for base, more in finder.find(texts):
                    fixed = [(k, *s) for k in KINDS for s in base[k]]
                    rows.append((*(len(base[k]) for k in KINDS), hashlib.sha256(listed(fixed).encode()).hexdigest(), listed(fixed + more)))
                cols = [pa.array(x) for x in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, len(rows)), *cols], ["doc_id", *names])

    return run


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for each row of ``docs``.

    Counts and digest are of the base spans; ``spans`` lists those and the network's as kind:start:end, code
    points, end exclusive. A null text is empty and has none; a long one is searched to its end. Repeated rows
    are searched each, ties go to the lower label. An empty table gives no rows. No shuffle.
    """
    docs = unclashed(docs, id_col, text_col)
    plain = docs.select(column(docs, id_col, "long").alias("doc_id"), column(docs, text_col, "string").alias("text"))
    return plain.mapInArrow(_find(network()), f"doc_id long, {FOUND}")


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each span replaced by its kind in angle brackets; of overlapping spans the union goes, under the first one's kind."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _mask(model: Network, inner: str, text_col: str, drop: bool):
    def run(batches):
        finder = Finder(model)
        for batch in batches:
            names = [n for n in batch.schema.names if not (drop and n == inner)]
            given = batch.column(inner)
            for a, texts in _in_parts(given):
                new = [masked(t, [(k, *s) for k in KINDS for s in base[k]] + more) for t, (base, more) in zip(texts, finder.find(texts), strict=True)]
                new = [None if not v else t for t, v in zip(new, given.slice(a, len(texts)).is_valid().to_pylist(), strict=True)]
                cols = [pa.array(new, pa.string()) if n == text_col else batch.column(n).slice(a, len(texts)) for n in names]
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def mask_personal(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span in ``text_col`` replaced by its kind; other columns come as they were, whatever their names.

    A null text stays null and an empty one empty; a long one is masked to its end; repeated rows are masked alike. An
    empty table stays empty.
    """
    names, docs = docs.columns, neutral(docs, text_col)
    given, inner, added = text_in_place(docs, text_col, "pii")
    return given.mapInArrow(_mask(network(), inner, text_col, added), ddl(docs).rstrip(", ")).toDF(*names)
