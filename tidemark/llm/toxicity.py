"""A toxicity classifier: a bidirectional GRU with attention pooling over word and character inputs.

A word's input is its hashed embedding beside the mean embedding of its character n-grams, so
unseen forms of a known stem are recognised.  A text is scored in overlapping windows that cover all
of its words, and its score is that of its worst window.  Training and scoring are numpy.

Executors read the labelled texts: they count words over whole texts, pick the windows that the
network learns from, and find each text's worst window for the calibration.  The driver gets windows
and numbers of bounded size, never texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textscan
from tidemark.llm.labels import labelled, learnable, shares
from tidemark.llm.shared import claim, stored, text_column

WINDOW, STRIDE = 32, 16
WORD_BITS, GRAM_BITS, DIM, HIDDEN, ATTEND = 14, 14, 8, 8, 8
GRAMS = (3, 4, 5)
#: Labelled rows that the network is trained on, at most: toxic ones and others.
EACH = (1_500, 4_000)
#: Windows of a labelled text that the network learns from, at most: the worst by log-odds, and some by chance.
PICKED, CHANCE = 10, 4
#: Logit of every text where there is no labelled row to learn from.
UNTAUGHT = -15.0
#: Tasks that read the labelled texts.
TASKS = 32
#: Words whose inputs a scoring worker keeps, 72 bytes each, and windows of full size that are judged together.
KNOWN, FULL_BLOCK = 1 << 18, 512
_F = np.float32


# ---- inputs


def grams_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of words with a mark at either end: (buckets, first of each word, and one more)."""
    size = end - start
    n = len(size)
    marked = size + 2
    begin = np.cumsum(marked) - marked
    total = int(marked.sum())
    at = np.arange(total) - np.repeat(begin, marked) - 1  # place in the word; -1 and size are marks
    inside = (at >= 0) & (at < np.repeat(size, marked))
    text = np.where(at < 0, 1, 2).astype(np.uint64)
    text[inside] = data[(np.repeat(start, marked) + at)[inside]]
    left = np.repeat(marked, marked) - at - 1  # bytes from here to the word's end, marks too
    out, owner = [], []
    h = np.zeros(total, np.uint64)
    word = np.repeat(np.arange(n), marked)
    for k in range(1, max(GRAMS) + 1):
        m = total - k + 1
        if m <= 0:
            break
        h = h[:m] * np.uint64(0x9E3779B97F4A7C15) + text[k - 1 : k - 1 + m] + np.uint64(k)
        if k in GRAMS:
            ok = np.flatnonzero(left[:m] >= k)
            out.append((textscan.mix(h[ok]) >> np.uint64(64 - GRAM_BITS)).astype(np.int64))
            owner.append(word[ok])
    buckets, owner = np.concatenate(out), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return buckets[order], np.searchsorted(owner[order], np.arange(n + 1))


def windows_of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of so many words: (text, first word, size) of each window; an empty text has one of none."""
    count = np.maximum(1, -(-(words - WINDOW) // STRIDE) + 1)
    doc = np.repeat(np.arange(len(words)), count)
    first = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
    return doc, first, np.clip(words[doc] - first, 0, WINDOW)


# ---- the network


def _sigmoid(x):
    return _F(0.5) * np.tanh(_F(0.5) * x) + _F(0.5)


@dataclass
class Network:
    p: dict[str, np.ndarray]
    slope: float = 1.0
    shift: float = 0.0

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Network:
        r = lambda *s, k=1.0: (rng.standard_normal(s) * k / np.sqrt(s[0])).astype(_F)
        p = {"word": (rng.standard_normal((1 << WORD_BITS, DIM)) * 0.1).astype(_F), "gram": (rng.standard_normal((1 << GRAM_BITS, DIM)) * 0.3).astype(_F)}
        for d in "fb":
            p |= {f"x{d}": r(2 * DIM, 3 * HIDDEN), f"h{d}": r(HIDDEN, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, _F)}
        p |= {"att": r(2 * HIDDEN, ATTEND), "att_v": r(ATTEND), "out": r(2 * HIDDEN), "bias": np.full(1, -2, _F)}
        return cls(p)

    def inputs(self, word: np.ndarray, grams: np.ndarray, begin: np.ndarray, keep: np.ndarray | None = None) -> np.ndarray:
        """[words, 2 DIM] of different words, some thousands at a time."""
        out = np.zeros((len(word), 2 * DIM), _F)
        for lo in range(0, len(word), 8192):
            hi = min(len(word), lo + 8192)
            own = begin[lo : hi + 1] - begin[lo]
            n = np.diff(own)
            held = np.flatnonzero(n)
            w = self.p["word"][word[lo:hi]]
            out[lo:hi, :DIM] = w if keep is None else w * keep[lo:hi, None]
            if len(held):
                out[lo + held, DIM:] = np.add.reduceat(self.p["gram"][grams[begin[lo] : begin[hi]]], own[held]) / n[held, None].astype(_F)
        return out

    def run(self, x: np.ndarray, at: np.ndarray, mask: np.ndarray | None, hold: bool = False):
        """Logits of windows: x are inputs of words, at [windows, steps] the word at each step."""
        n, steps = at.shape
        states = np.empty((steps, n, 2 * HIDDEN), _F)
        tape: dict = {}
        for d, cols, order in (("f", slice(0, HIDDEN), range(steps)), ("b", slice(HIDDEN, None), range(steps - 1, -1, -1))):
            gate = x @ self.p[f"x{d}"] + self.p[f"b{d}"]
            u = self.p[f"h{d}"]
            h = np.zeros((n, HIDDEN), _F)
            for t in order:
                gi = gate[at[:, t]]
                gh = h @ u
                zr = _sigmoid(gi[:, : 2 * HIDDEN] + gh[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                new = np.tanh(gi[:, 2 * HIDDEN :] + r * gh[:, 2 * HIDDEN :])
                nxt = new + z * (h - new)
                if mask is not None:
                    nxt = np.where(mask[:, t, None], nxt, h)
                if hold:
                    tape[d, t] = (h, zr, new, gh[:, 2 * HIDDEN :])
                h = nxt
                states[t, :, cols] = h
        th = np.tanh(states @ self.p["att"])
        s = th @ self.p["att_v"]
        if mask is not None:
            s = np.where(mask.T, s, _F(-1e9))
        a = np.exp(s - s.max(0))
        if mask is not None:
            a *= mask.T
        a /= np.maximum(a.sum(0), _F(1e-9))
        pooled = np.einsum("tn,tnk->nk", a, states)
        logit = pooled @ self.p["out"] + self.p["bias"][0]
        return (logit, (states, tape, th, a, pooled)) if hold else logit

    def gates(self, x: np.ndarray) -> tuple:
        """What ``run_full`` adds for each word and step, with the halves of the sigmoids' arguments in it."""
        at = slice(0, 2 * HIDDEN), slice(2 * HIDDEN, None)
        both = [x @ self.p[f"x{d}"] + self.p[f"b{d}"] for d in "fb"]
        by_word = [(np.ascontiguousarray(g[:, at[0]] * _F(0.5)), np.ascontiguousarray(g[:, at[1]])) for g in both]
        u = np.stack([self.p["hf"], self.p["hb"]])
        ends = np.concatenate([self.p["att"], self.p["out"][:, None]], 1).reshape(2, 1, 2 * HIDDEN // 2, ATTEND + 1)
        return by_word, np.ascontiguousarray(u[:, :, at[0]] * _F(0.5)), np.ascontiguousarray(u[:, :, at[1]]), ends

    def run_full(self, gates: tuple, at: np.ndarray) -> np.ndarray:
        """Logits of windows of WINDOW words, as ``run`` gives them: both directions at once, in place, nothing held."""
        (fwd, bwd), u_zr, u_new, ends = gates
        n, steps = at.shape
        at = np.ascontiguousarray(at.T)
        states = np.empty((2, steps, n, HIDDEN), _F)
        h = np.zeros((2, n, HIDDEN), _F)
        zr, new, more_zr, more_new = (np.empty((2, n, k), _F) for k in (2 * HIDDEN, HIDDEN, 2 * HIDDEN, HIDDEN))
        for t in range(steps):
            back = steps - 1 - t
            for k, words, rows in ((0, fwd, at[t]), (1, bwd, at[back])):
                np.take(words[0], rows, 0, out=zr[k], mode="clip")
                np.take(words[1], rows, 0, out=new[k], mode="clip")
            if t:
                zr += np.matmul(h, u_zr, out=more_zr)
            np.tanh(zr, out=zr)
            zr *= _F(0.5)
            zr += _F(0.5)
            if t:
                np.matmul(h, u_new, out=more_new)
                more_new *= zr[..., HIDDEN:]
                new += more_new
            np.tanh(new, out=new)
            h -= new
            h *= zr[..., :HIDDEN]
            h += new
            states[0, t], states[1, back] = h
        told = np.matmul(states, ends)
        told = told[0] + told[1]
        s = np.tanh(told[..., :ATTEND]) @ self.p["att_v"]
        a = np.exp(s - s.max(0))
        return (a * told[..., ATTEND]).sum(0) / a.sum(0) + self.p["bias"][0]

    def gradient(self, x, at, mask, held, dlogit):
        """Gradients of all but the embeddings, and of x."""
        states, tape, th, a, pooled = held
        n, steps = at.shape
        g = {"out": pooled.T @ dlogit, "bias": np.array([dlogit.sum()], _F)}
        dpool = dlogit[:, None] * self.p["out"]
        da = np.einsum("tnk,nk->tn", states, dpool)
        ds = a * (da - (a * da).sum(0))
        dth = ds[..., None] * self.p["att_v"] * (1 - th * th)
        g["att_v"] = np.einsum("tn,tna->a", ds, th)
        g["att"] = np.einsum("tnk,tna->ka", states, dth)
        dstates = a[..., None] * dpool + dth @ self.p["att"].T
        dx = np.zeros_like(x)
        flat = at.T.ravel()
        for d, cols, order in (("f", slice(0, HIDDEN), range(steps - 1, -1, -1)), ("b", slice(HIDDEN, None), range(steps))):
            u = self.p[f"h{d}"]
            dgate = np.zeros((steps, n, 3 * HIDDEN), _F)
            du = np.zeros_like(u)
            dh = np.zeros((n, HIDDEN), _F)
            for t in order:
                dh = dh + dstates[t, :, cols]
                h, zr, new, ghn = tape[d, t]
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                own = dh if mask is None else dh * mask[:, t, None]
                dnew = own * (1 - z) * (1 - new * new)
                dz = own * (h - new) * z * (1 - z)
                dr = dnew * ghn * r * (1 - r)
                dgate[t, :, :HIDDEN], dgate[t, :, HIDDEN : 2 * HIDDEN], dgate[t, :, 2 * HIDDEN :] = dz, dr, dnew
                dgh = np.concatenate([dz, dr, dnew * r], 1)
                du += h.T @ dgh
                through = own * z + dgh @ u.T
                dh = through if mask is None else np.where(mask[:, t, None], through, dh)
            g[f"h{d}"] = du
            full = dgate.reshape(-1, 3 * HIDDEN)
            g[f"b{d}"] = full.sum(0)
            order_ = np.argsort(flat, kind="stable")
            run = flat[order_]
            first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
            summed = np.add.reduceat(full[order_], first)
            g[f"x{d}"] = x[run[first]].T @ summed
            dx[run[first]] += summed @ self.p[f"x{d}"].T
        return g, dx

    def probability(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logit.astype(float) + self.shift, -30, 30)))


@dataclass
class Texts:
    """Texts as different words and the words' order."""

    hash: np.ndarray  # of each different word
    grams: np.ndarray
    begin: np.ndarray
    at: np.ndarray  # of each word of the texts, its different word
    first: np.ndarray  # of each text, and one more

    @property
    def word(self) -> np.ndarray:
        """The bucket of each different word."""
        return (self.hash >> np.uint64(64 - WORD_BITS)).astype(np.int64)


def prepare(w: textscan.Words) -> Texts:
    h, one, at = _different(w.hash)
    if len(h):
        grams, begin = grams_of(w.data, w.start[one], w.end[one])
    else:
        grams, begin = np.zeros(0, np.int64), np.zeros(1, np.int64)
    return Texts(h, grams, begin, at, w.first)


def _different(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different hashes, a place of each, and of every place its hash's number."""
    order = np.argsort(h)
    run = h[order]
    new = np.empty(len(h), bool)
    new[:1], new[1:] = True, run[1:] != run[:-1]
    at = np.empty(len(h), np.int64)
    at[order] = np.cumsum(new) - 1
    return run[new], order[new], at


class Known:
    """Inputs of words that a worker has met, by hash; when there are more than KNOWN, the last texts' words stay."""

    def __init__(self, net: Network):
        self.net = net
        self.hash, self.x = np.zeros(0, np.uint64), np.zeros((0, 2 * DIM), _F)

    def prepare(self, w: textscan.Words) -> tuple[Texts, np.ndarray]:
        """Texts, without n-grams, and the inputs of their different words."""
        h, one, at = _different(w.hash)
        t = Texts(h, np.zeros(0, np.int64), np.zeros(len(h) + 1, np.int64), at, w.first)
        if not len(h):
            return t, np.zeros((1, 2 * DIM), _F)
        place = np.searchsorted(self.hash, h)
        met = np.zeros(len(h), bool)
        if len(self.hash):
            met = self.hash[np.minimum(place, len(self.hash) - 1)] == h
        x = np.empty((len(h), 2 * DIM), _F)
        x[met] = self.x[place[met]]
        if not met.all():
            new = ~met
            x[new] = self.net.inputs(t.word[new], *grams_of(w.data, w.start[one[new]], w.end[one[new]]))
            if len(self.hash) + int(new.sum()) > KNOWN:
                self.hash, self.x = h[:KNOWN], x[:KNOWN].copy()
            else:
                self.hash, self.x = np.insert(self.hash, place[new], h[new]), np.insert(self.x, place[new], x[new], 0)
        return t, x


def logits_of(net: Network, t: Texts, begin: np.ndarray, size: np.ndarray, block: int = 2048, x: np.ndarray | None = None) -> np.ndarray:
    """The logit of each window, given by its first place in ``t.at`` and its size; x are the inputs of the words, if known."""
    logit = np.empty(len(begin), _F)
    if x is None:
        x = net.inputs(t.word, t.grams, t.begin) if len(t.hash) else np.zeros((1, 2 * DIM), _F)
    step = np.arange(WINDOW)
    at = t.at if len(t.at) else np.zeros(1, np.int64)
    full = np.flatnonzero(size == WINDOW)
    gates = net.gates(x) if len(full) else None
    for lo in range(0, len(full), FULL_BLOCK):
        rows = full[lo : lo + FULL_BLOCK]
        logit[rows] = net.run_full(gates, at[begin[rows, None] + step])
    part = np.flatnonzero(size < WINDOW)
    part = part[np.argsort(size[part], kind="stable")]
    for lo in range(0, len(part), block):
        rows = part[lo : lo + block]
        steps = max(1, int(size[rows].max()))
        mask = step[None, :steps] < size[rows, None]
        logit[rows] = net.run(x, at[np.minimum(begin[rows, None] + step[:steps], len(at) - 1)], mask)
    return logit


def window_logits(net: Network, t: Texts, x: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, size, logit) of every window of every text."""
    doc, first, size = windows_of(np.diff(t.first))
    return doc, first, size, logits_of(net, t, t.first[doc] + first, size, x=x)


def worst_windows(net: Network, t: Texts, x: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: its worst window's logit, that window's first word (the first of equals), and its number of windows."""
    doc, first, _, logit = window_logits(net, t, x)
    n = len(t.first) - 1
    top = np.maximum.reduceat(logit, np.searchsorted(doc, np.arange(n)))
    at = np.flatnonzero(logit == top[doc])
    return top, first[at[np.searchsorted(doc[at], np.arange(n))]], np.bincount(doc, minlength=n)


@dataclass
class Lesson:
    """Windows of labelled texts: their words, where each begins, and whose it is."""

    texts: Texts
    begin: np.ndarray  # of each window, its first place in texts.at
    size: np.ndarray
    doc: np.ndarray  # rises
    first: np.ndarray  # a first judgement of each window


def counted(t: Texts, y: np.ndarray) -> list[np.ndarray]:
    """How many texts, and how many toxic ones, have each word bucket and each n-gram bucket."""
    out = [np.zeros(1 << b, np.int32) for b in (WORD_BITS, WORD_BITS, GRAM_BITS, GRAM_BITS)]
    for i in range(len(y)):
        own = np.unique(t.at[t.first[i] : t.first[i + 1]])
        if not len(own):
            continue
        many = t.begin[own + 1] - t.begin[own]
        at = np.repeat(t.begin[own] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        for k, what in enumerate((t.word[own], t.grams[at])):
            seen = np.unique(what)
            out[2 * k][seen] += 1
            out[2 * k + 1][seen] += int(y[i])
    return out


def log_odds(counts: list[np.ndarray], bad: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of toxic texts for each word and n-gram bucket."""
    lift = lambda b, a: np.log((b + 1) / (bad + 2)) - np.log((a - b + 1) / (n - bad + 2))
    return tuple((np.clip(lift(b, a), -3, 3) * np.minimum(a / 10, 1)).astype(_F) for a, b in (counts[:2], counts[2:]))


def pick(t: Texts, odds: tuple[np.ndarray, np.ndarray], seed: int) -> Iterator[tuple[Texts, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text: the words of the windows to learn from, their begins, sizes and first judgements.

    A text of up to PICKED + CHANCE windows gives all; any other the PICKED worst of all its windows
    by the log-odds of their words, and CHANCE others.
    """
    doc, start, size = windows_of(np.diff(t.first))
    by_word = np.maximum(odds[0][t.word], _means(odds[1][t.grams], t.begin))
    first = _window_max(by_word, t, t.first[doc] + start, size)
    own = np.searchsorted(doc, np.arange(len(t.first)))
    step = np.arange(WINDOW)
    for d in range(len(t.first) - 1):
        w = np.arange(own[d], own[d + 1])
        if len(w) > PICKED + CHANCE:
            worst = w[np.argsort(-first[w], kind="stable")]
            rest = np.random.default_rng((seed, int(t.first[d + 1] - t.first[d]))).permutation(worst[PICKED:])[:CHANCE]
            w = np.sort(np.concatenate([worst[:PICKED], rest]))
        at = (t.first[d] + start[w])[:, None] + step
        words, place = np.unique(t.at[at[step[None] < size[w, None]]], return_inverse=True)
        many = t.begin[words + 1] - t.begin[words]
        cuts = np.concatenate([[0], np.cumsum(many)])
        grams = t.grams[np.repeat(t.begin[words] - cuts[:-1], many) + np.arange(cuts[-1])]
        yield Texts(t.hash[words], grams, cuts, place, np.array([0, len(place)])), np.cumsum(size[w]) - size[w], size[w], first[w]


def lesson(rows: list[tuple[Texts, np.ndarray, np.ndarray, np.ndarray]]) -> Lesson:
    """What ``pick`` gave for each text, one after another; a word that several texts have is one."""
    cat = lambda xs, t: np.concatenate(xs).astype(t) if xs else np.zeros(0, t)
    shift = lambda sizes: np.cumsum([0, *sizes[:-1]]) if sizes else []
    words, grams, ats = [len(r[0].hash) for r in rows], [len(r[0].grams) for r in rows], [len(r[0].at) for r in rows]
    every = np.concatenate([[0], cat([r[0].begin[1:] + s for r, s in zip(rows, shift(grams))], np.int64)])
    h, one, place = np.unique(cat([r[0].hash for r in rows], np.uint64), return_index=True, return_inverse=True)
    many = every[one + 1] - every[one]
    cuts = np.concatenate([[0], np.cumsum(many)]).astype(np.int64)
    own = cat([r[0].grams for r in rows], np.int32)[np.repeat(every[one] - cuts[:-1], many) + np.arange(cuts[-1])]
    at = place[cat([r[0].at + s for r, s in zip(rows, shift(words))], np.int64)].astype(np.int32)
    texts = Texts(h, own, cuts, at, np.concatenate([[0], np.cumsum(ats)]).astype(np.int64))
    return Lesson(texts, cat([r[1] + s for r, s in zip(rows, shift(ats))], np.int64), cat([r[2] for r in rows], np.int64), np.repeat(np.arange(len(rows)), np.array([len(r[2]) for r in rows], np.int64)), cat([r[3] for r in rows], _F))


def fit(given: Lesson, y: np.ndarray, odds: tuple[np.ndarray, np.ndarray], passes: int = 6, rate: float = 0.05, seed: int = 3) -> Network:
    """Learn from texts' labels which windows are toxic.

    A clean text's windows are all clean.  Of a toxic text, each pass takes its worst windows: in the
    first pass by the log-odds of their words and n-grams (the embeddings' first place starts from
    these too), later by the network so far, asked every other pass.  With one class only the network
    says that class's share, and without texts that nothing is toxic.
    """
    rng = np.random.default_rng(seed)
    net = Network.fresh(rng)
    n = len(y)
    if not n or not 0 < y.sum() < n:
        net.slope, net.shift = 0.0, float(np.log((y.sum() + 1) / (n - y.sum() + 1))) if n else UNTAUGHT
        return net
    sums = {k: np.full(v.shape, 1e-3, _F) for k, v in net.p.items()}
    texts, begin, size = given.texts, given.begin, given.size
    buckets = texts.word
    own = np.searchsorted(given.doc, np.arange(n + 1))
    step = np.arange(WINDOW)

    def update(k, g, rows=None):
        if rows is None:
            sums[k] += g * g
            net.p[k] -= _F(rate) * g / np.sqrt(sums[k])
        else:
            sums[k][rows] += g * g
            net.p[k][rows] -= _F(rate) * g / np.sqrt(sums[k][rows])

    net.p["word"][:, 0], net.p["gram"][:, 0] = 0.3 * odds[0], 0.6 * odds[1]
    logit = given.first
    for turn in range(max(passes, min(8 * passes, 20_000 // n))):  # a small lesson is gone over more often
        if turn % 2:
            logit = logits_of(net, texts, begin, size)
        chosen, marks = [], []
        for i in range(n):
            w = np.arange(own[i], own[i + 1])
            worst = w[np.argsort(-logit[w], kind="stable")]
            if y[i]:
                take = worst[: max(1, min(3, int((logit[w] > 0).sum())))]
            else:
                take = np.unique(np.concatenate([worst[:2], rng.permutation(w)[:1]]))
            chosen.append(take)
            marks.append(np.full(len(take), y[i]))
        chosen, marks = np.concatenate(chosen), np.concatenate(marks).astype(_F)
        order = rng.permutation(len(chosen))
        for lo in range(0, len(order), 128):
            rows, mark = chosen[order[lo : lo + 128]], marks[order[lo : lo + 128]]
            steps = max(1, int(size[rows].max()))
            mask = step[None, :steps] < size[rows, None]
            place = texts.at[np.minimum(begin[rows, None] + step[:steps], len(texts.at) - 1)] if len(texts.at) else np.zeros((len(rows), steps), np.int64)
            used, at = np.unique(place, return_inverse=True)
            at = at.reshape(place.shape)
            count = texts.begin[used + 1] - texts.begin[used] if len(buckets) else np.zeros(1, np.int64)
            cuts = np.concatenate([[0], np.cumsum(count)])
            g_at = np.repeat(texts.begin[used] - cuts[:-1], count) + np.arange(cuts[-1]) if len(buckets) else np.zeros(0, np.int64)
            grams = texts.grams[g_at]
            word = buckets[used] if len(buckets) else np.zeros(1, np.int64)
            keep = (rng.random(len(used)) > 0.4).astype(_F)
            x = net.inputs(word, grams, cuts, keep)
            z, held = net.run(x, at, mask, hold=True)
            dz = (_sigmoid(z) - mark) / _F(len(rows))
            g, dx = net.gradient(x, at, mask, held, dz.astype(_F))
            for k, v in g.items():
                update(k, v.astype(_F))
            for k, i, v in (("word", word, dx[:, :DIM] * keep[:, None]), ("gram", grams, np.repeat(dx[:, DIM:] / np.maximum(count, 1)[:, None].astype(_F), count, 0))):
                if len(i):
                    o = np.argsort(i, kind="stable")
                    run = i[o]
                    f = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
                    update(k, np.add.reduceat(v[o], f).astype(_F), run[f])
    return net


def calibrate(net: Network, worst: np.ndarray, y: np.ndarray, share: float) -> None:
    """Fit slope and shift between a text's worst logit and its label, for a corpus of which ``share`` is toxic."""
    if 0 < y.sum() < len(y):
        odds = (1 - share) / share * y.sum() / (len(y) - y.sum())
        net.slope, net.shift = _line(worst, y, np.where(y > 0, 1.0, odds))


def _means(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=float)])
    return ((total[begin[1:]] - total[begin[:-1]]) / np.maximum(np.diff(begin), 1)).astype(_F)


def _window_max(by_word: np.ndarray, t: Texts, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    out = np.full(len(begin), -1.0, _F)
    values = by_word[t.at]
    for step in range(WINDOW):
        on = np.flatnonzero(size > step)
        out[on] = np.maximum(out[on], values[begin[on] + step])
    return out


def _line(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic line, by Newton steps with a little shrinkage."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        e = weight * (p - y)
        g = np.array([(e * x).sum() + 0.1 * (a - 1), e.sum() + 1e-3 * b])
        w = weight * p * (1 - p) + 1e-6
        h = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        d = np.linalg.solve(h, g)
        a, b = a - np.clip(d[0], -1, 1), b - np.clip(d[1], -2, 2)
    return float(max(a, 0.05)), float(b)


# ---- on tables


def train(docs: DataFrame, labels: DataFrame, learn, each: tuple[int, int] = EACH, key: str = "doc_id", text: str = "text", seed: int = 3) -> Network:
    """Train on the labelled rows of ``docs`` with ``learn``: at most ``each`` toxic and other ones.

    Labels of other rows are never looked at, not even to count classes.  Executors read whole texts
    of any length; the driver gets at most PICKED + CHANCE windows of a text.  Rows with a null key or
    label teach nothing, and repeated rows count once.  With one class only, every text gets that
    class's share as its score; without labelled rows nothing is known to be toxic, every score is
    below 1e-6, and a filter by ``predicted`` keeps every row.
    """
    import pyarrow as pa

    chosen = docs.where(learn)
    keys = learnable(chosen, labels, "toxic", key)
    told = shares(keys)
    rows = stored(labelled(chosen, keys, each[::-1], key, text).repartition(TASKS, "text").sortWithinPartitions("text", "y"), "labelled")

    def each_block(batches):
        for b in batches:
            y = b.column(1).to_numpy(zero_copy_only=False)
            for w in textscan.scan(b.column(0), textscan.MARKS):
                yield prepare(w), y[w.lo : w.hi]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, bad, n = None, 0, 0
        for t, y in each_block(batches):
            own = counted(t, y)
            total = own if total is None else [a + b for a, b in zip(total, own)]
            bad, n = bad + int(y.sum()), n + len(y)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([bad], pa.int64()), pa.array([n], pa.int64()), pa.array([np.concatenate(total).tobytes()], pa.binary())], names=["bad", "n", "counts"])

    sums = rows.select("text", "y").mapInArrow(count, "bad long, n long, counts binary").collect()  # a row of 256 kB from each of TASKS tasks
    if not sums:
        return fit(lesson([]), np.zeros(0), ())
    counts = np.split(sum(np.frombuffer(r.counts, np.int32).astype(np.int64) for r in sums), np.cumsum([1 << WORD_BITS, 1 << WORD_BITS, 1 << GRAM_BITS]))
    odds = log_odds(counts, sum(r.bad for r in sums), sum(r.n for r in sums))
    told_odds = docs.sparkSession.sparkContext.broadcast(odds)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = lambda xs, t: pa.array([np.ascontiguousarray(x, t).tobytes() for x in xs], pa.binary())
        for t, y in each_block(batches):
            got = list(pick(t, told_odds.value, seed))
            words, grams, begins, ats = ([getattr(g[0], a) for g in got] for a in ("hash", "grams", "begin", "at"))
            cols = [pa.array(y.astype(np.int32)), pack(words, np.uint64), pack(grams, np.uint16), pack(begins, np.int32), pack(ats, np.int16), pack([g[2] for g in got], np.uint8), pack([g[3] for g in got], np.float32)]
            yield pa.RecordBatch.from_arrays(cols, names=["y", "hash", "grams", "begin", "at", "size", "first"])

    got = rows.select("text", "y").mapInArrow(choose, "y int, hash binary, grams binary, begin binary, at binary, size binary, first binary").collect()  # at most sum(each) rows of some tens of kB
    got.sort(key=lambda r: (hashlib.md5(b"".join(r[1:])).digest(), r.y))  # the same order on every run
    wide = lambda x, t: np.frombuffer(x, t).astype(np.int64)
    picked = []
    for r in got:
        at, size = wide(r.at, np.int16), wide(r.size, np.uint8)
        picked.append((Texts(np.frombuffer(r.hash, np.uint64), np.frombuffer(r.grams, np.uint16), wide(r.begin, np.int32), at, np.array([0, len(at)])), np.cumsum(size) - size, size, np.frombuffer(r.first, np.float32)))
    y = np.array([r.y for r in got], float)
    given = lesson(picked)
    del got, picked
    net = fit(given, y, odds, seed=seed)
    if 0 < y.sum() < len(y):
        told_net = docs.sparkSession.sparkContext.broadcast(net)

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t, y in each_block(batches):
                yield pa.RecordBatch.from_arrays([pa.array(y.astype(np.int32)), pa.array(worst_windows(told_net.value, t)[0].astype(float))], names=["y", "worst"])

        ends = sorted((r.worst, r.y) for r in rows.select("text", "y").mapInArrow(judge, "y int, worst double").collect())  # at most sum(each) pairs of numbers
        calibrate(net, np.array([e[0] for e in ends]), np.array([e[1] for e in ends], float), told[1] / (told[0] + told[1]))
    return net


def score(docs: DataFrame, net: Network, keep: list[str] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ``keep``, ``score`` (0 to 1, higher: toxic), ``predicted`` (1 from a half), ``windows`` and
    ``worst`` (the first word of the worst window, the first of equals) of every row.

    Every window of every text is scored, and a text's score is that of its worst.  Null counts as
    empty, which is one window of no words; rows may repeat; an empty table gives no rows; other
    columns are passed on only if ``keep`` names them.
    """
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(net)
    names = [key, *(keep or [])]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity")
        own = shared.value
        known = Known(own)
        for b in batches:
            best, where, many = [], [], []
            for w in textscan.scan(b.column(0), textscan.MARKS):
                for held, x in zip((best, where, many), worst_windows(own, *known.prepare(w))):
                    held.append(x)
            cat = lambda x: np.concatenate(x) if x else np.zeros(0)
            p = own.probability(cat(best))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(cat(many).astype(np.int64)), pa.array(cat(where).astype(np.int64))], names=[*names, "score", "predicted", "windows", "worst"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", score double, predicted int, windows long, worst long"
    return docs.select(text_column(docs, text).alias("_text"), *[docs[c] for c in names]).mapInArrow(run, schema)
