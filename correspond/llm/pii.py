"""Personal data: patterns, and a character-level bidirectional LSTM with CRF transitions, trained in numpy."""

import hashlib
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from correspond.llm.common import small_batches, table, unit

#: Kinds of the patterns, and those that the model tells apart.
KINDS = ("email", "ip", "card", "phone")
FOUND = (*KINDS, "secret")
#: A pattern's leftmost match never starts within a run of digits, nor an address before its @: the look-behind, and
#: growing an address back from its @, give the same matches without trying each character of a long run.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_PLAIN = re.compile(r"[0-9@]")
#: Every span has a digit, an @, or an @ spelt out.
_TRIGGER = re.compile(r"[0-9@]|[\[({] ?at ?[\])}]|\bat(?= \S+ dot )", re.IGNORECASE)


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    return sum(sum(divmod(2 * int(d), 10)) if k % 2 else int(d) for k, d in enumerate(reversed(digits))) % 10 == 0


def valid(kind: str, s: str) -> bool:
    """What a span of a pattern's kind must fulfil besides its pattern."""
    if kind == "ip":
        parts = s.split(".")
        return len(parts) == 4 and all(p and p.isascii() and p.isdigit() and (len(p.lstrip("0")) <= 3 and int(p) <= 255) for p in parts)
    d = _digits(s)
    return 13 <= len(d) <= 19 and luhn(d) if kind == "card" else 9 <= len(d) <= 15


_SPELT = re.compile(r"(?i)[a-z0-9._%+-]+(?:(?: ?[\[({] ?(?:dot|\.) ?[\])}] ?| dot )[a-z0-9_%+-]+)*(?: ?@ ?| ?[\[({] ?(?:at|@) ?[\])}] ?| at )[a-z0-9-]+(?:(?:\.| \. | ?[\[({] ?(?:dot|\.) ?[\])}] ?| dot )[a-z0-9-]+)+")
_SECRET = re.compile(r"[A-Za-z0-9_+/=.-]{16,}")
_NUMBER = re.compile(r"[0-9][0-9 ./_-]*[0-9]")
_CALL = re.compile(r"[(+]?[0-9][0-9 ()./-]*[0-9]")


def plausible(kind: str, s: str) -> bool:
    """What a span that the model finds must fulfil: the conditions of its kind, with any separators, an @ or full stops spelt out."""
    if kind == "email":
        return _SPELT.fullmatch(s) is not None
    if kind == "secret":
        return _SECRET.fullmatch(s) is not None and any(c in "0123456789" for c in s) and any(c.isalpha() for c in s)
    if kind == "ip":
        return valid("ip", re.sub(r"[\[({]\.[\])}]", ".", s))
    return (_NUMBER if kind == "card" else _CALL).fullmatch(s) is not None and valid(kind, s)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns, by kind, then start."""
    if not _PLAIN.search(text):
        return []
    found, last = [], 0
    for m in _DOMAIN.finditer(text) if "@" in text else ():
        start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            found.append((0, start, m.end()))
            last = m.end()
    for k, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
        found += [(k, *m.span()) for m in pattern.finditer(text) if valid(KINDS[k], m[0])]
    return found


# --- the model ---------------------------------------------------------------

WINDOW, STRIDE, HIDDEN = 96, 48, 24
TAGS = 1 + 2 * len(FOUND)  # outside; first and further characters of each kind
CHARS = 100  # padding, 95 printable ASCII characters, other white space, other control, letters beyond ASCII, others
_CODE = np.full(128, 97, np.uint8)
_CODE[32:127] = np.arange(1, 96)
_CODE[[9, 10, 11, 12, 13]] = 96


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, _CODE[np.minimum(points, 127)], 98 + (points >= 0x2000)).astype(np.uint8)


#: Transitions that no labelling has get this score: a further character after anything but its own kind.
_NEVER = np.array([[-30.0 if y and y % 2 == 0 and x not in (y, y - 1) else 0.0 for y in range(TAGS)] for x in range(TAGS)], np.float32)


def new_model(seed: int = 1) -> dict:
    """x, h: gates by character and by state, forward and backward; o, b: tag scores; t: transitions."""
    r, h = np.random.default_rng(seed), HIDDEN
    x = r.normal(0, 0.3, (2, CHARS, 4 * h))
    x[:, :, h : 2 * h] += 1.0  # remember at first
    return {"x": x, "h": r.normal(0, h**-0.5, (2, h, 4 * h)), "o": r.normal(0, (2 * h) ** -0.5, (2 * h, TAGS)), "b": np.zeros(TAGS), "t": np.zeros((TAGS, TAGS))}


def _forward(x, m):
    """x: (length, windows) of codes -> tag scores, states, and what the backward pass needs. Both directions run in step."""
    n, wx, wh = HIDDEN, m["x"], m["h"]
    two, side = np.stack((x, x[::-1]), axis=1), np.arange(2)[:, None]
    h = c = np.zeros((2, x.shape[1], n), wx.dtype)
    out, kept = np.empty((len(x), 2, x.shape[1], n), wx.dtype), []
    for t in range(len(x)):
        g = wx[side, two[t]] + h @ wh
        s, z = 1 / (1 + np.exp(-g[:, :, : 3 * n])), np.tanh(g[:, :, 3 * n :])
        before, c = c, s[:, :, n : 2 * n] * c + s[:, :, :n] * z
        e = np.tanh(c)
        kept.append((s, z, before, e, h))
        h = out[t] = s[:, :, 2 * n :] * e
    both = np.concatenate((out[:, 0], out[::-1, 1]), axis=2)
    scores = both @ m["o"] + m["b"]
    return scores, both, two, kept


def _state_grads(two, wh, kept, d_out):
    """d_out: (length, 2, windows, state), each direction in its own order -> gradients of x and h."""
    n, dh, dc, gh, gates = HIDDEN, 0.0, 0.0, np.zeros_like(wh), [None] * len(kept)
    for t in range(len(kept) - 1, -1, -1):
        s, z, before, e, h = kept[t]
        dh = dh + d_out[t]
        i, f, o = s[:, :, :n], s[:, :, n : 2 * n], s[:, :, 2 * n :]
        dc = dc + dh * o * (1 - e * e)
        dg = gates[t] = np.concatenate((dc * z * i * (1 - i), dc * before * f * (1 - f), dh * e * o * (1 - o), dc * i * (1 - z * z)), axis=2)
        gh += h.transpose(0, 2, 1) @ dg
        dh, dc = dg @ wh.transpose(0, 2, 1), dc * f
    gates, gx = np.stack(gates, axis=1), np.zeros((2, CHARS, 4 * n), wh.dtype)
    for d in range(2):
        chars, rows = two[:, d].ravel(), gates[d].reshape(-1, 4 * n)
        order = np.argsort(chars, kind="stable")
        seen, at = np.unique(chars[order], return_index=True)
        gx[d, seen] = np.add.reduceat(rows[order], at)
    return gx, gh


def _marginals(e, trans):
    """Forward and backward sums of the CRF, scaled to 1 at each step; emission factors over the scale; the log normaliser."""
    top = e.max(axis=2, keepdims=True)
    f, m = np.exp(e - top), np.exp(trans)
    a, b = np.empty_like(e), np.ones_like(e)
    scale = np.empty((*e.shape[:2], 1), e.dtype)
    for t in range(len(e)):
        a[t] = f[t] * (a[t - 1] @ m) if t else f[t]
        scale[t] = a[t].sum(axis=1, keepdims=True)
        a[t] /= scale[t]
    f /= scale
    for t in range(len(e) - 2, -1, -1):
        b[t] = (f[t + 1] * b[t + 1]) @ m.T
    return a, b, f, (np.log(scale) + top).sum(axis=(0, 2))


def loss_and_grads(x, y, m):
    """Mean negative log-likelihood of tags y (length, windows), and its gradients."""
    e, both, two, kept = _forward(x, m)
    a, b, f, z = _marginals(e, m["t"] + _NEVER)
    n, w = x.shape
    gold = e[np.arange(n)[:, None], np.arange(w), y].sum(axis=0) + m["t"][y[:-1], y[1:]].sum(axis=0)
    de = a * b
    de[np.arange(n)[:, None], np.arange(w), y] -= 1
    g = {k: np.zeros_like(v) for k, v in m.items()}
    g["t"] = np.exp(m["t"] + _NEVER) * (a[:-1].reshape(-1, TAGS).T @ (f * b)[1:].reshape(-1, TAGS))
    np.add.at(g["t"], (y[:-1], y[1:]), -1)
    flat, d_flat = both.reshape(-1, 2 * HIDDEN), de.reshape(-1, TAGS)
    g["o"], g["b"] = flat.T @ d_flat, d_flat.sum(axis=0)
    d_both = de @ m["o"].T
    d_out = np.stack((d_both[:, :, :HIDDEN], d_both[::-1, :, HIDDEN:]), axis=1)
    g["x"], g["h"] = _state_grads(two, m["h"], kept, d_out)
    return float((z - gold).mean()), {k: v / w for k, v in g.items()}


def decode(x, m):
    """Best tags (length, windows) by the CRF, and the marginal probability of each."""
    e, trans = _forward(x, m)[0], m["t"] + _NEVER
    best, steps = e[0], []
    for t in range(1, len(e)):
        s = best[:, :, None] + trans
        steps.append(s.argmax(axis=1))
        best = s.max(axis=1) + e[t]
    tags = np.empty(x.shape, np.int64)
    tags[-1] = best.argmax(axis=1)
    for t in range(len(e) - 2, -1, -1):
        tags[t] = steps[t][np.arange(x.shape[1]), tags[t + 1]]
    a, b, _, _ = _marginals(e, trans)
    return tags, np.take_along_axis(a * b, tags[:, :, None], 2)[:, :, 0]


def tags_of(spans, start: int, length: int) -> np.ndarray:
    """Tags of a window; of a span that begins before it, further characters alone."""
    y = np.zeros(length, np.int64)
    for k, a, b in spans:
        y[max(0, a - start) : max(0, b - start)] = 2 + 2 * k
        if start <= a < start + length:
            y[a - start] = 1 + 2 * k
    return y


class _Maker:
    """Labelled text made up: personal data in its usual forms and in forms that the patterns miss, and what merely looks like it."""

    def __init__(self, seed: int):
        self.r = np.random.default_rng(seed)

    def num(self, n: int) -> str:
        return "".join(map(str, self.r.integers(0, 10, n)))

    def pick(self, *of):
        return of[int(self.r.integers(len(of)))]

    def chars(self, of: str, n: int) -> str:
        return "".join(self.r.choice(list(of), n))

    def word(self) -> str:
        return self.chars("abcdefghijklmnoprstuvwy", int(self.r.integers(2, 9)))

    def email(self, hard: bool) -> str:
        name = f"{self.word()}{self.pick('.', '_', '-', '')}{self.num(int(self.r.integers(0, 4))) or self.word()}"
        labels = [self.word() + self.num(int(self.r.integers(0, 2))), *self.pick(["example", "com"], ["org"], ["net"], ["de"])]
        if not hard:
            return name + "@" + ".".join(labels)
        if self.r.random() < 0.2:  # full stops of the name as well
            at, dot = self.pick((" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"))
            return f"{self.word()}{dot}{self.word()}{self.num(int(self.r.integers(0, 3)))}{at}{dot.join(labels)}"
        at, dot = self.pick((" at ", " dot "), (" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", " (dot) "), ("(at)", "."), (" (at) ", "."), (" @ ", " . "), (" [at] ", "."))
        return name + at + dot.join(labels)

    def ip(self, hard: bool) -> str:
        return (self.pick("[.]", "(.)") if hard else ".").join(str(x) for x in self.r.integers(0, 256, 4))

    def card(self, hard: bool) -> str:
        d = self.num(self.pick(13, 15, 16, 16, 16, 19))
        d = next(d[:-1] + c for c in "0123456789" if luhn(d[:-1] + c))
        return self.pick(".", "/", "_", "  ", " - ").join(d[k : k + 4] for k in range(0, len(d), 4)) if hard else self.pick("", "", " ", "-").join(d[k : k + 4] for k in range(0, len(d), 4))

    def phone(self, hard: bool) -> str:
        s = self.pick(" ", "-", ".")
        if hard:
            return self.pick(f"({self.num(3)}) {self.num(3)}-{self.num(4)}", f"({self.num(3)}) {self.num(3)}-{self.num(4)}", f"{self.num(3)}{s}{self.num(3)}{s}{self.num(4)}", f"00{self.num(2)}{s}{self.num(3)}{s}{self.num(3)}{s}{self.num(3)}", f"0{self.num(3)}/{self.num(7)}")
        return self.pick(f"+1 ({self.num(3)}) {self.num(3)}-{self.num(4)}", f"+{self.r.integers(1, 99)}{s}{self.num(3)}{s}{self.num(3)}{s}{self.num(4)}", f"+{self.num(11)}")

    def secret(self) -> tuple[str, str, str]:
        """Text before, secret, text after."""
        hexes, more = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
        value = self.pick(self.chars(hexes, 40), self.chars(hexes, 40), self.chars(hexes, 32), self.chars(hexes, 64), self.chars(more, int(self.r.integers(20, 44))), "AKIA" + self.chars(more[:26] + more[52:], 16), "ghp_" + self.chars(more, 36))
        if not any(c in "0123456789" for c in value):
            value += "7"
        name = self.pick("token", "token", "api_key", "secret", "password", "key", "auth_token", "client_secret")
        sign, quote = self.pick(" = ", "=", ": "), self.pick('"', '"', "'", "")
        before, after = name + sign + quote, quote
        return (before.upper(), value.upper(), after) if self.r.random() < 0.2 else (before, value, after)

    def decoy(self) -> str:
        return self.pick(
            self.num(int(self.r.integers(1, 12))), f"{self.r.integers(1990, 2030)}-{self.num(2)}-{self.num(2)}", f"{self.num(1)}.{self.num(1)}.{self.num(2)}", f"{self.r.integers(256, 999)}.{self.num(3)}.{self.num(3)}.{self.num(3)}",
            f"@{self.word()}{self.num(2)}", f"{self.num(2)},{self.num(3)}.{self.num(2)}", f"Version {self.num(1)}.{self.num(1)}", f"{self.num(2)}:{self.num(2)}", f"commit {self.chars('0123456789abcdef', self.pick(7, 40))}", f"{self.pick('sha256', 'SHA-256', 'sha256sum', 'checksum', 'digest')}{self.pick(' ', ': ', ':', '=')}{self.chars('0123456789abcdef', 64)}", f"{self.pick('md5', 'MD5', 'etag', 'revision', 'sha1')}{self.pick(' ', ': ', ':', '=')}{self.chars('0123456789abcdef', self.pick(32, 40))}",
            f"https://{self.word()}.com/{self.word()}-{self.num(6)}/{self.word()}", f"{self.word()} at {self.word()} {self.num(2)}", f"{self.num(4)}-{self.num(4)}", f"{self.word()}_{self.word()}_{self.num(3)}", f"no. {self.num(int(self.r.integers(4, 9)))}", f"{self.num(3)} x {self.num(3)} x {self.num(2)}",
        )

    def span(self, hard_share: float) -> list[tuple[str, int | None]]:
        """Pieces of text, each with its kind (None: plain)."""
        kind, hard = int(self.r.integers(len(FOUND))), self.r.random() < hard_share
        if kind == 4:
            before, value, after = self.secret()
            return [(before, None), (value, kind), (after, None)]
        one = (self.email, self.ip, self.card, self.phone)[kind]
        out = [(one(hard), kind)]
        if kind == 2 and self.r.random() < 0.3:  # numbers that stand side by side
            out = [*self.pick([(self.num(int(self.r.integers(1, 5))) + " ", None)], [(one(False), kind), (" ", None)]), (one(False), kind), *self.pick([], [(" " + self.num(int(self.r.integers(1, 4))), None)])]
        return out

    def text(self, prose: list[str], hard_share: float, decoys: float) -> tuple[str, list[tuple[int, int, int]]]:
        """One line of prose with personal data or a decoy in it, and its spans."""
        left, right = (self.pick(*prose)[: self.r.integers(0, 48)] for _ in range(2))
        pieces = [(self.decoy(), None)] if self.r.random() < decoys else self.span(hard_share)
        text, spans = f"{left} ", []
        for piece, kind in pieces:
            if kind is not None:
                spans.append((kind, len(text), len(text) + len(piece)))
            text += piece
        return text + self.pick("", "", ",", ".", "!!", "###", "%%%", "***", "$$$") + " " + right, spans


_PROSE = ["the quick brown fox jumps over the lazy dog and runs away. "]


def labelled_windows(windows: list[tuple[str, list]], seed: int = 2, made: int = 3000):
    """Codes and tags to learn from: windows of documents with their spans, and the same prose with spans and decoys put in."""
    prose, maker = [_TRIGGER.sub("", w) for w, _ in windows if len(w) > 40] or _PROSE, _Maker(seed)
    rows = [*windows, *(maker.text(prose, 0.6, 0.3) for _ in range(made))]
    x, y = np.zeros((WINDOW, len(rows)), np.uint8), np.zeros((WINDOW, len(rows)), np.int64)
    for k, (text, spans) in enumerate(rows):
        c = codes(text[:WINDOW])
        x[: len(c), k], y[:, k] = c, tags_of(spans, 0, WINDOW)
    return x, y


def made_up_texts(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Texts of made-up spans in forms that the patterns miss (a third holds decoys alone), to measure a model on; use another seed than the one learnt from."""
    maker = _Maker(seed)
    return [maker.text(_PROSE * 2, 1.0, 1 / 3) for _ in range(n)]


def train(x, y, epochs: int = 16, size: int = 300, rate: float = 0.04, seed: int = 3) -> dict:
    """Adam over shuffled batches, in float32."""
    m, r, step = {k: v.astype(np.float32) for k, v in new_model().items()}, np.random.default_rng(seed), 0
    first, second = ({k: np.zeros_like(v) for k, v in m.items()} for _ in range(2))
    total = epochs * -(-x.shape[1] // size)
    for _ in range(epochs):
        order = r.permutation(x.shape[1])
        for k in range(0, len(order), size):
            at, step = order[k : k + size], step + 1
            _, g = loss_and_grads(x[:, at], y[:, at], m)
            norm = np.sqrt(sum((v * v).sum() for v in g.values()))
            lr = rate * (1 - 0.9 * step / total)
            for n, v in g.items():
                v = v * np.float32(min(1.0, 5.0 / (norm + 1e-9)))
                first[n] = 0.9 * first[n] + 0.1 * v
                second[n] = 0.999 * second[n] + 0.001 * v * v
                m[n] = (m[n] - lr * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return m


def window_starts(text: str) -> np.ndarray:
    """Starts of the windows, on a grid, around what a span needs; the others hold none. Each place is in two windows."""
    at = np.fromiter((m.start() for m in _TRIGGER.finditer(text)), np.int64)
    k = np.unique(np.concatenate((at // STRIDE, at // STRIDE - 1)))
    return k[k >= 0] * STRIDE if len(text) > STRIDE else k[k == 0]


_MIXED = re.compile(r"[0-9A-Za-z@._-]*[0-9@][0-9A-Za-z@._-]*")


def _explained(text: str, start: int, spans) -> bool:
    """Whether the patterns account for all longer runs with digits in a window: what they leave out can't serve as a label."""
    window = text[start : start + WINDOW]
    return all(len(m[0]) < 9 or any(a < m.end() + start and m.start() + start < b for _, a, b in spans) for m in _MIXED.finditer(window))


#: The models of the last training windows, so that the same ones are learnt from once.
_FITTED: dict[str, dict] = {}


def fit(docs: DataFrame, max_windows: int = 1200) -> dict:
    """Trains on at most max_windows windows of documents (by hash order) with the spans of the patterns as labels, and on made-up ones."""
    n = docs.count()

    def of(batches):
        for batch in batches:
            rows = []
            for t in batch.column(0).to_pylist():
                spans = base_spans(t or "")
                for a in window_starts(t or "").tolist():
                    if _explained(t, a, spans):
                        own = [f"{s - a}:{e - a}:{kind}" for kind, s, e in spans if s < a + WINDOW and a < e]
                        rows.append((xxhash.xxh64_intdigest(t[a : a + WINDOW].encode(errors="replace"), seed=5) >> 1, t[a : a + WINDOW], own))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.list_(pa.string()))], ["h", "text", "spans"])

    drawn = docs.where(F.coalesce(unit(F.col("doc_id"), 17), F.lit(1.0)) < min(1.0, 8.0 * max_windows / max(1, n)))
    rows = small_batches(drawn.select("text")).mapInArrow(of, "h long, text string, spans array<string>").orderBy("h", "text", "spans").limit(max_windows).collect()
    windows = [(r.text, [(int(k), int(a), int(b)) for a, b, k in (s.split(":") for s in r.spans)]) for r in rows]
    name = hashlib.sha256(repr(windows).encode(errors="surrogatepass")).hexdigest()
    if name not in _FITTED:
        while len(_FITTED) >= 4:
            del _FITTED[next(iter(_FITTED))]
        _FITTED[name] = train(*labelled_windows(windows))
    return _FITTED[name]


def _pieces(tags, sure, length: int) -> list[tuple[int, int, int, float]]:
    """(kind, start, end, summed probability) of the tagged runs of a window; one that begins with a further character comes from the left."""
    out, t = [], 0
    while t < length:
        if not tags[t]:
            t += 1
            continue
        kind, end = int(tags[t] - 1) // 2, t + 1
        while end < length and tags[end] == 2 + 2 * kind:
            end += 1
        out.append((kind, t, end, float(sure[t:end].sum())))
        t = end
    return out


def joined(pieces: list[tuple]) -> list[tuple[int, int, int, float]]:
    """pieces(kind, start, end, mean probability, cut on the left, cut on the right) of overlapping windows -> whole spans.

    Pieces that an edge of their window cuts are joined with those of their kind that
    they overlap, on and on, so that a span may be as long as it likes; what stays cut
    is left out, as some window that holds more of it decided otherwise.
    """
    out = [(k, a, b, p) for k, a, b, p, left, right in pieces if not left and not right]
    cut = sorted((p for p in pieces if p[4] or p[5]), key=lambda p: (p[0], p[1], -p[2]))
    run = None
    for k, a, b, p, left, right in [*cut, (None, 0, 0, 0.0, False, False)]:
        if run and k == run[0] and a < run[2]:
            run = (k, run[1], max(run[2], b), run[3] + p * (b - a), run[4] + b - a, run[5], right if b >= run[2] else run[6])
            continue
        if run and not run[5] and not run[6]:
            out.append((run[0], run[1], run[2], run[3] / run[4]))
        run = (k, a, b, p * (b - a), b - a, left, right) if k is not None else None
    return out


def best_spans(spans: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """Of (kind, start, end, weight) those that don't overlap and weigh most together."""
    spans = sorted(set(spans), key=lambda s: (s[2], s[1], s[0], s[3]))
    ends, best, back = [s[2] for s in spans], [0.0], []
    for j, (_, a, _, w) in enumerate(spans):
        i = bisect_right(ends, a, 0, j)
        take = best[i] + w > best[j]
        best.append(best[i] + w if take else best[j])
        back.append(i if take else -1)
    out, j = [], len(spans)
    while j:
        if back[j - 1] >= 0:
            out.append(spans[j - 1][:3])
            j = back[j - 1]
        else:
            j -= 1
    return out[::-1]


#: Runs of characters inside which no span of a kind begins or ends.
_RUNS = {0: re.compile("[A-Za-z0-9_%+-]+"), 1: re.compile("[0-9]+"), 2: re.compile("[0-9]+"), 3: re.compile("[0-9]+"), 4: re.compile("[A-Za-z0-9_/+-]+")}
#: What a span is looked for by around the place where the model sees one, and how far.
_AROUND, _FAR = {0: _SPELT, 2: _NUMBER, 3: _CALL}, 96
_DIGITS = re.compile("[0-9]+")


def _nearby(kind: int, text: str, a: int, b: int) -> tuple[int, int]:
    """The plausible span that has most in common with one that isn't; of numbers side by side, any that follow each other may be one."""
    found = []
    for m in _AROUND[kind].finditer(text, max(0, a - _FAR), min(len(text), b + _FAR)):
        spans = [m.span()]
        if kind == 2:
            runs = [d.span() for d in _DIGITS.finditer(text, *m.span())]
            spans += [(runs[i][0], runs[j][1]) for i in range(len(runs)) for j in range(i, min(i + 6, len(runs)))]
        found += [s for s in spans if s[0] < b and a < s[1] and plausible(FOUND[kind], text[slice(*s)])]
    return max(found, key=lambda s: (min(s[1], b) - max(s[0], a), s[0] - s[1]), default=(a, b))


def _run(pattern: re.Pattern, text: str, p: int, seen: tuple[int, int]) -> tuple[int, int]:
    """The whole run that the character at p belongs to, of any length; seen: the last one looked at."""
    if seen[0] <= p < seen[1]:
        return seen
    a, step = p, 256
    while a and pattern.fullmatch(text, max(0, a - step), a):
        a, step = max(0, a - step), 2 * step
    while a and pattern.match(text[a - 1]):
        a -= 1
    return a, pattern.match(text, p).end()


def _tidy(kind: int, text: str, a: int, b: int, seen: dict) -> tuple[int, int]:
    """To the ends of the runs of digits or characters that a span stands in, without blanks and punctuation at either end that no span has there. seen: the last run of each kind."""
    edge = " \t\r\n\"',;:!?#%*$&" + ("" if kind == 3 else "(") + ("" if kind == 4 else "=")
    while a < b and text[a] in edge:
        a += 1
    while a < b and text[b - 1] in edge + ".)":
        b -= 1
    run = _RUNS.get(kind)
    if run and a < b:
        if run.match(text[b - 1]):
            seen[kind] = _run(run, text, b - 1, seen.get(kind, (0, 0)))
            b = seen[kind][1]
        if run.match(text[a]):
            seen[kind] = _run(run, text, a, seen.get(kind, (0, 0)))
            a = seen[kind][0]
    if a < b and kind in _AROUND and not plausible(FOUND[kind], text[a:b]):  # the model sees the place; the form tells the ends
        return _nearby(kind, text, a, b)
    return a, b


#: Mean probability that a span of each kind needs: less where its form tells more.
LEAST = {"email": 0.6, "ip": 0.6, "card": 0.3, "phone": 0.4, "secret": 0.6}


def model_spans(texts: list[str], model: dict, own: list[list[tuple[int, int, int]]], least: dict[str, float] = LEAST) -> list[list[tuple[int, int, int]]]:
    """Spans of whole texts that touch none of `own`: windows are decoded by the CRF, spans across windows joined, and of the
    plausible ones of mean probability `least` or more for their kind those are chosen that don't overlap and together are the most certain characters."""
    places = [(k, a) for k, t in enumerate(texts) for a in window_starts(t).tolist()]
    found = [[] for _ in texts]
    for p in range(0, len(places), 512):
        part = places[p : p + 512]
        x = np.zeros((WINDOW, len(part)), np.uint8)
        for j, (k, a) in enumerate(part):
            c = codes(texts[k][a : a + WINDOW])
            x[: len(c), j] = c
        tags, sure = decode(x, model)
        for j in np.flatnonzero((tags > 0).any(axis=0)):
            k, a = part[j]
            n = min(WINDOW, len(texts[k]) - a)
            for kind, t, end, p in _pieces(tags[:, j], sure[:, j], n):
                left = t == 0 and a > 0
                # No window has more of a secret that begins here: it goes on to the end of its run of characters, see _tidy.
                right = end == n and a + n < len(texts[k]) and (FOUND[kind] != "secret" or left or t > STRIDE)
                found[k].append((kind, a + t, a + end, p / (end - t), left, right))
    out = []
    for text, pieces, taken in zip(texts, found, own, strict=True):
        spans, seen = [], {}
        for kind, a, b, p in sorted(joined(pieces)) if pieces else ():
            a, b = _tidy(kind, text, a, b, seen)
            if p >= least[FOUND[kind]] and a < b and plausible(FOUND[kind], text[a:b]) and all(b <= c or d <= a for _, c, d in taken):
                spans.append((kind, a, b, p * (b - a)))
        out.append(best_spans(spans))
    return out


def personal_data(docs: DataFrame, least: dict[str, float] = LEAST) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans), a row for each row of docs.

    The counts and the digest are those of the patterns, whose spans stay. The model
    adds spans that touch none of them: numbers and addresses that the patterns miss
    (other separators, an @ spelt out, numbers side by side), and secrets (`secret`:
    keys and tokens of 16 characters or more, with a digit). Null counts as empty; whole texts
    are searched at any length; equal texts have equal spans; an empty table gives
    none; other columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs.select("doc_id", "text")))
    kind = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)])
    for c in ("n_email", "n_ip", "n_card", "n_phone"):
        kind = kind.add(c, "long")
    kind = kind.add("base_sha256", "string").add("spans", "string").add("n_added", "long").add("n_spans", "long")
    told = lambda spans: ",".join(f"{FOUND[k]}:{a}:{b}" for k, a, b in sorted(spans))
    long = lambda values: pa.array(values, pa.int64())

    def of(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = [t or "" for t in part.column(1).to_pylist()]
                base = [base_spans(t) for t in texts]
                more = model_spans(texts, model.value, base, least)
                counts = [long([sum(s[0] == k for s in own) for own in base]) for k in range(4)]
                digests = pa.array([hashlib.sha256(told(own).encode()).hexdigest() for own in base], pa.string())
                spans = pa.array([told(own + m) for own, m in zip(base, more, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, digests, spans, long([len(m) for m in more]), long([len(own) + len(m) for own, m in zip(base, more, strict=True)])], kind.names)

    return small_batches(docs.select("doc_id", "text")).mapInArrow(of, kind)


def op2_pii(spark, sf_dir):
    return personal_data(table(spark, sf_dir, "documents"))
