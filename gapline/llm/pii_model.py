"""A character-level bidirectional LSTM with a CRF on top, in numpy."""

from __future__ import annotations

import unicodedata

import numpy as np

HANGUL = 256
VOCABULARY = 1 + 96 + 320 + HANGUL + 1
CLASSES = 7
MARK = 95


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Code and class of each character under U+0250: case folded, accents taken off, all digits alike."""
    code, kind = np.full(0x250, VOCABULARY - 1), np.full(0x250, 6)
    for cp in range(0x250):
        c = chr(cp)
        base = unicodedata.normalize("NFD", c)[0].lower()
        low = ord(base)
        code[cp] = 17 if c.isdigit() and cp < 128 else low - 31 if 32 <= low < 126 else 97 + low - 0xA0 if 0xA0 <= low < 0x1E0 else VOCABULARY - 1
        kind[cp] = 3 if cp < 128 and c.isdigit() else 1 if c.isupper() else 2 if c.isalpha() else 4 if c in " \u00a0" else 6
    code[[9, 10, 13]] = 96
    return code, kind


_CODE, _KIND = _tables()


def encode(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Two codes a character: its letter and its class. 0 is padding.

    Letters are case folded and without accents, so that a word has the same
    codes whether its accents are composed or not; combining marks have a code of
    their own and are letters. All digits are one letter: shapes matter, not the
    number.
    """
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    low = np.minimum(cp, 0x24F)
    hangul = (cp >= 0xAC00) & (cp <= 0xD7A3)
    mark = (cp >= 0x300) & (cp <= 0x36F)
    code = np.where(cp < 0x250, _CODE[low], VOCABULARY - 1)
    kind = np.where(cp < 0x250, _KIND[low], 6)
    code = np.where(hangul, 97 + 320 + (cp - 0xAC00) * 7919 % HANGUL, code)
    kind = np.where(hangul, 5, kind)
    return np.where(mark, MARK, code), np.where(mark, 2, kind)


#: Rows of the table of word features.
WORDS = 1 << 15
FEATURES = 6
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(*parts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(parts[0]), np.uint64)
    for x in parts:
        out = (out ^ x.astype(np.uint64)) * _MIX
        out ^= out >> np.uint64(29)
    return out


def word_features(code: np.ndarray, kind: np.ndarray, row: np.ndarray | None = None) -> np.ndarray:
    """Hashes (characters, FEATURES) of what stands around each character: its word, those beside it, and their shapes.

    Words are runs of letters and digits, case folded and with all digits alike.
    Each feature also tells whether a character begins its word, goes on with it,
    or follows it. ``row``: which sequence each character belongs to; words of
    another sequence are none.
    """
    n = len(code)
    if not n:
        return np.zeros((0, FEATURES), np.int32)
    inside = (kind == 1) | (kind == 2) | (kind == 3) | (kind == 5)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = np.flatnonzero(first)
    place = np.where(first, 0, np.where(inside, 1, 2)).astype(np.uint64)
    if not len(starts):
        zero = np.zeros(n, np.uint64)
        return np.stack([(_mix(zero + np.uint64(f), place) % np.uint64(WORDS)).astype(np.int32) for f in range(FEATURES)], 1)
    at = np.maximum(np.cumsum(first) - 1, 0)
    row = np.zeros(n, np.int64) if row is None else row
    rows = row[starts]
    own = (rows[at] == row) & (starts[at] <= np.arange(n))
    spelt = np.cumsum(code != MARK)
    position = spelt - spelt[starts[at]]
    with np.errstate(over="ignore"):
        value = np.where(inside & (code != MARK), _mix(code, np.minimum(position, 20) + 1), np.uint64(0))
        word = np.add.reduceat(value, starts)
        length = np.add.reduceat((inside & (code != MARK)).astype(np.int64), starts)
        second = np.minimum(starts + 1, n - 1)
        shape = (kind[starts] * 64 + kind[second] * 8 + np.minimum(length, 5)).astype(np.uint64)
        two = np.maximum(starts - 2, 0)
        mark = (code[np.maximum(starts - 1, 0)] * 1024 + np.where(inside[two], 0, code[two])).astype(np.uint64)

        def shift(x: np.ndarray, k: int) -> np.ndarray:
            out = np.zeros_like(x)
            if k > 0:
                out[k:] = np.where(rows[k:] == rows[:-k], x[:-k], 0)
            else:
                out[:k] = np.where(rows[:k] == rows[-k:], x[-k:], 0)
            return out

        before, before2, after = shift(word, 1), shift(word, 2), shift(word, -1)
        tables = (word, _mix(before, shape), _mix(before, before2, mark), _mix(after, shape), _mix(mark, shape), _mix(before2, before, shape))
        return np.stack([(_mix(np.where(own, t[at], np.uint64(0)) + np.uint64(f), place) % np.uint64(WORDS)).astype(np.int32) for f, t in enumerate(tables)], 1)


#: What stands around each of several texts that are encoded together.
_BETWEEN = "\n\n\n"


def encoded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes and classes (steps, texts), word features (steps, texts, FEATURES) and the mask of what isn't padding."""
    lengths = np.array([len(t) for t in texts], np.int64)
    code, kind = encode(_BETWEEN + _BETWEEN.join(texts) + _BETWEEN)
    gap = len(_BETWEEN)
    offsets = np.cumsum(lengths + gap) - lengths
    row = np.repeat(np.arange(len(texts)), lengths + gap)
    words = word_features(code, kind, np.concatenate([row, np.full(gap, len(texts))]))
    steps = np.arange(int(lengths.max(initial=0)))[:, None]
    mask = steps < lengths
    at = np.where(mask, offsets + steps, 0)
    return np.where(mask, code[at], 0), np.where(mask, kind[at], 0), words[at], mask.astype(np.float32)


def one_thread() -> None:
    """Let numpy's BLAS use one thread in this process: a task has one core, and the matrices are small."""
    import ctypes
    import glob
    import os

    for path in glob.glob(os.path.join(os.path.dirname(np.__file__), "..", "numpy.libs", "*openblas*")):
        lib = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(lib, name):
                getattr(lib, name)(ctypes.c_int(1))
                break


class Tagger:
    """Emissions of the LSTM and of word features, and transitions of the CRF, over ``labels`` labels.

    Characters are looked up directly in the gates' input space. Weights of the
    three sigmoid gates are halved, as sigmoid(x) is tanh(x / 2) / 2 + 1 / 2.
    """

    def __init__(self, labels: int, hidden: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        h = hidden
        self.hidden, self.labels = hidden, labels
        #: Names these weights, for what tasks remember of them; changes with each fit.
        self.key = ""
        #: Words that often begin sentences, for the checks of names.
        self.openers: frozenset[str] = frozenset()
        #: Given names of the roster in lower case, for the same.
        self.given: frozenset[str] = frozenset()
        f = lambda *s, k=1.0: (rng.standard_normal(s) * k).astype(np.float32)
        self.w = {
            "letter": f(2, VOCABULARY, 4 * h, k=0.2), "kind": f(2, CLASSES, 4 * h, k=0.2), "rec": f(2, h, 4 * h, k=0.6 / np.sqrt(h)),
            "bias": np.zeros((2, 1, 4 * h), np.float32), "out": f(2 * h, labels, k=0.3 / np.sqrt(h)), "out_bias": np.zeros(labels, np.float32),
            "trans": np.zeros((labels, labels), np.float32), "word": np.zeros((WORDS, labels), np.float32),
        }
        self.w["bias"][:, :, h : 2 * h] = 0.5  # the forget gate is open at first

    def emissions(self, code: np.ndarray, kind: np.ndarray, words: np.ndarray, keep: bool = False):
        """Scores (steps, batch, labels) of sequences given as (steps, batch) codes and (steps, batch, FEATURES) hashes."""
        w, h = self.w, self.hidden
        steps, batch = code.shape
        both_c, both_k = np.stack([code, code[::-1]]), np.stack([kind, kind[::-1]])
        hs = np.zeros((steps + 1, 2, batch, h), np.float32)
        cs = np.zeros((steps + 1, 2, batch, h), np.float32) if keep else None
        gates = np.empty((steps, 2, batch, 4 * h), np.float32) if keep else None
        tanhs = np.empty((steps, 2, batch, h), np.float32) if keep else None
        base = w["kind"] + w["bias"]
        side = np.arange(2)[:, None]
        state = np.zeros((2, batch, h), np.float32)
        for t in range(steps):
            z = np.matmul(hs[t], w["rec"])
            z += w["letter"][side, both_c[:, t]]
            z += base[side, both_k[:, t]]
            np.tanh(z, out=z)
            z[:, :, : 3 * h] *= 0.5
            z[:, :, : 3 * h] += 0.5
            state = z[:, :, h : 2 * h] * state + z[:, :, :h] * z[:, :, 3 * h :]
            th = np.tanh(state)
            np.multiply(z[:, :, 2 * h : 3 * h], th, out=hs[t + 1])
            if keep:
                gates[t], cs[t + 1], tanhs[t] = z, state, th
        top = np.concatenate([hs[1:, 0], hs[:0:-1, 1]], axis=2)
        scores = top @ w["out"] + w["out_bias"]
        for f in range(FEATURES):
            scores += w["word"][words[:, :, f]]
        return (scores, (both_c, both_k, hs, cs, gates, tanhs, top)) if keep else scores

    def table(self) -> np.ndarray:
        """What each pair of a letter and a class adds to the gates, by side."""
        w = self.w
        return (w["letter"][:, :, None] + w["kind"][:, None] + w["bias"][:, :, None]).reshape(2, -1, 4 * self.hidden)

    def scores(self, code: np.ndarray, kind: np.ndarray, words: np.ndarray, table: np.ndarray) -> np.ndarray:
        """As ``emissions``, for decoding: with one look-up a character, and nothing kept."""
        w, h = self.w, self.hidden
        steps, batch = code.shape
        pair = code * CLASSES + kind
        hs = np.zeros((steps + 1, 2, batch, h), np.float32)
        z, at = np.empty((2, batch, 4 * h), np.float32), np.empty((2, batch, 4 * h), np.float32)
        state, th = np.zeros((2, batch, h), np.float32), np.empty((2, batch, h), np.float32)
        i, f, o, g, gates = z[:, :, :h], z[:, :, h : 2 * h], z[:, :, 2 * h : 3 * h], z[:, :, 3 * h :], z[:, :, : 3 * h]
        for t in range(steps):
            np.matmul(hs[t], w["rec"], out=z)
            np.take(table[0], pair[t], 0, out=at[0], mode="clip")
            np.take(table[1], pair[steps - 1 - t], 0, out=at[1], mode="clip")
            z += at
            np.tanh(z, out=z)
            gates *= 0.5
            gates += 0.5
            state *= f
            np.multiply(i, g, out=th)
            state += th
            np.tanh(state, out=th)
            np.multiply(o, th, out=hs[t + 1])
        out = hs[1:, 0] @ w["out"][:h] + hs[:0:-1, 1] @ w["out"][h:] + w["out_bias"]
        for k in range(FEATURES):
            out += w["word"][words[:, :, k]]
        return out

    def best_paths(self, scores: np.ndarray) -> np.ndarray:
        """As ``viterbi``, which only reads the sequences that may hold a label other than 0.

        A stretch of n other labels gains at most n times the greatest gain of a
        character, and n + 1 times the greatest gain of a transition, over labels 0.
        If no character's gain and twice the transition's come to more than 0,
        nothing beats 0 throughout.
        """
        trans = self.w["trans"]
        most = (scores[:, :, 1:] - scores[:, :, :1]).max((0, 2)) + 2 * max(0.0, float((trans - trans[0, 0]).max()))
        some = np.flatnonzero(most > -1e-3)
        path = np.zeros(scores.shape[:2], np.int8)
        if len(some):
            path[:, some] = self.viterbi(scores[:, some])
        return path

    def viterbi(self, scores: np.ndarray) -> np.ndarray:
        """The best labels (steps, batch)."""
        steps, batch, k = scores.shape
        back = np.empty((steps, batch, k), np.int8)
        best = scores[0]
        for t in range(1, steps):
            through = best[:, :, None] + self.w["trans"][None]
            back[t] = through.argmax(1)
            best = through.max(1) + scores[t]
        path = np.empty((steps, batch), np.int8)
        path[-1] = best.argmax(1)
        rows = np.arange(batch)
        for t in range(steps - 1, 0, -1):
            path[t - 1] = back[t, rows, path[t]]
        return path

    def gradients(self, code: np.ndarray, kind: np.ndarray, words: np.ndarray, gold: np.ndarray, mask: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss (negative log likelihood a character) and gradients. ``mask``: 1 for characters, 0 for padding at the end."""
        w, h = self.w, self.hidden
        scores, (both_c, both_k, hs, cs, gates, tanhs, top) = self.emissions(code, kind, words, keep=True)
        steps, batch, k = scores.shape
        trans = w["trans"]
        scores = scores - scores.max(2, keepdims=True)
        e_trans, e_scores = np.exp(trans), np.exp(scores)
        count = mask.sum()
        # Scaled forward and backward sums.
        alpha, beta = np.empty_like(scores), np.empty_like(scores)
        scale = np.ones((steps, batch), np.float32)
        a = e_scores[0]
        scale[0] = a.sum(1)
        alpha[0] = a / scale[0][:, None]
        for t in range(1, steps):
            a = (alpha[t - 1] @ e_trans) * e_scores[t]
            s = a.sum(1)
            m = mask[t] > 0
            scale[t] = np.where(m, s, 1)
            alpha[t] = np.where(m[:, None], a / s[:, None], alpha[t - 1])
        beta[-1] = 1
        g_trans = np.zeros_like(trans)
        g_scores = np.zeros_like(scores)
        for t in range(steps - 1, -1, -1):
            p = alpha[t] * beta[t]
            g_scores[t] = p / p.sum(1, keepdims=True) * mask[t][:, None]
            if t:
                m = mask[t][:, None]
                b = e_scores[t] * beta[t] / scale[t][:, None]
                g_trans += e_trans * ((alpha[t - 1] * m).T @ (b * m))
                beta[t - 1] = np.where(m > 0, b @ e_trans.T, beta[t])
        at = (np.arange(steps)[:, None], np.arange(batch)[None], gold)
        gold_score = float((scores[at] * mask).sum()) + float((trans[gold[:-1], gold[1:]] * mask[1:]).sum())
        g_scores[at] -= mask
        g_trans -= np.bincount((gold[:-1] * k + gold[1:]).ravel(), mask[1:].ravel(), k * k).reshape(k, k)
        loss = float((np.log(scale) * mask).sum()) - gold_score
        g_scores /= count
        grads = {"trans": g_trans / count, "out_bias": g_scores.sum((0, 1)), "out": np.tensordot(top, g_scores, ((0, 1), (0, 1)))}
        hashes = words.reshape(-1)
        order = np.argsort(hashes, kind="stable")
        found, begin = np.unique(hashes[order], return_index=True)
        grads["word"] = np.zeros_like(w["word"])
        grads["word"][found] = np.add.reduceat(g_scores.reshape(-1, k)[order // FEATURES], begin, axis=0)
        g_top = g_scores @ w["out"].T
        g_h = np.stack([g_top[:, :, :h], g_top[::-1, :, h:]], axis=1)
        dz = np.empty((steps, 2, batch, 4 * h), np.float32)
        dh, dc = np.zeros((2, batch, h), np.float32), np.zeros((2, batch, h), np.float32)
        rec_t = w["rec"].transpose(0, 2, 1)
        for t in range(steps - 1, -1, -1):
            z, th = gates[t], tanhs[t]
            i, f, o, g = z[:, :, :h], z[:, :, h : 2 * h], z[:, :, 2 * h : 3 * h], z[:, :, 3 * h :]
            d = g_h[t] + dh
            dc = dc + d * o * (1 - th * th)
            out = dz[t]
            # The gates' inputs are halved: the derivative of the sigmoid by them is 2 s (1 - s).
            out[:, :, :h] = dc * g * i * (1 - i) * 2
            out[:, :, h : 2 * h] = dc * cs[t] * f * (1 - f) * 2
            out[:, :, 2 * h : 3 * h] = d * th * o * (1 - o) * 2
            out[:, :, 3 * h :] = dc * i * (1 - g * g)
            dc = dc * f
            dh = np.matmul(out, rec_t)
        flat = dz.transpose(1, 0, 2, 3).reshape(2, steps * batch, 4 * h)
        before = hs[:-1].transpose(1, 0, 2, 3).reshape(2, steps * batch, h)
        grads["rec"] = np.matmul(before.transpose(0, 2, 1), flat)
        grads["bias"] = flat.sum(1, keepdims=True)
        for name, codes, size in (("letter", both_c, VOCABULARY), ("kind", both_k, CLASSES)):
            g = np.zeros((2, size, 4 * h), np.float32)
            for side in range(2):
                c = codes[side].ravel()
                order = np.argsort(c, kind="stable")
                found, first = np.unique(c[order], return_index=True)
                g[side, found] = np.add.reduceat(flat[side][order], first, axis=0)
            grads[name] = g
        return loss / count, grads


class Adam:
    """Adam with gradients clipped as a whole; word features, each seen seldom, take three times the rate."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.v = {k: np.zeros_like(v) for k, v in weights.items()}
        self.t = 0

    def step(self, weights: dict[str, np.ndarray], grads: dict[str, np.ndarray], rate: float, clip: float = 1.0) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        factor = min(1.0, clip / (norm + 1e-9))
        for k, g in grads.items():
            g = g * factor
            own = rate * 3 if k == "word" else rate
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.98 * self.v[k] + 0.02 * g * g
            weights[k] -= (own * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.98**self.t)) + 1e-7)).astype(weights[k].dtype)
