"""N-best segmentation over a piece lattice, and decoding.

A text gets a blank ahead, as its vocabulary wants, and is cut where no piece can reach across, so
its lattice is a chain of small ones.  In each, forward Viterbi gives the best score up to every
place, and a search from the end that adds this score to what it has passed is A* with an exact
heuristic: hypotheses come out best first.  The same search over the chain, whose heuristic (the
best scores of what is ahead) is exact as well, gives the N best of the whole text.

Order: higher score first, then fewer pieces, then, from a part's end, the longer piece first; and
among texts' segmentations alike in score and number, the one that leaves the best choice later.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import claim, text_column
from tidemark.llm.token_count import blocks, pre_tokens

#: A vocabulary file's mark of a blank.  The lattice has blanks themselves, so the mark in a text is a character like any other.
MARK = "▁"
#: A score times STEP minus the number of pieces: the two compared as one number.
STEP = 1 << 20
#: A character that no piece covers scores so much below the least piece, and becomes its bytes.
UNKNOWN = 10
#: Parts up to so many characters are solved together with numpy.
TOGETHER = 48
#: Parts that are solved together.
ROWS = 2048
#: Parts, and bytes of them and their ids, that a worker's cache holds.
CACHE, CACHE_BYTES = 300_000, 64 << 20
#: Characters of a part whose edges are kept while it's searched; a longer one's are looked up again.
SPREAD = 1 << 16
_NEVER = -(1 << 61)


#: Links of long parts' hypotheses: (the one before, step, depth, a far one before).  A step is minus a piece's length.
_ROOT = (None, 0, 0, None)


def _link(before: tuple, step: int) -> tuple:
    far = before[3]
    # skip lists of doubling reach: two jumps of one length become one
    return (before, step, before[2] + 1, far[3] if far is not None and far[3] is not None and before[2] - far[2] == far[2] - far[3][2] else before)


def _steps(link: tuple) -> list[int]:
    out = []
    while link[0] is not None:
        out.append(link[1])
        link = link[0]
    return out[::-1]


class _Place:
    """A link's place in the order of steps from the end, the longer piece first."""

    __slots__ = ("link",)

    def __init__(self, link: tuple):
        self.link = link

    def __lt__(self, other: _Place) -> bool:
        a, b = self.link, other.link
        if a is b:
            return False
        depth = min(a[2], b[2])
        over = a[2] - b[2]
        a, b = _up(a, depth), _up(b, depth)
        if a is b:  # one goes on from the other
            return over < 0
        while a[0] is not b[0]:
            if a[3] is not b[3]:
                a, b = a[3], b[3]
            else:
                a, b = a[0], b[0]
        return a[1] < b[1]


def _up(link: tuple, depth: int) -> tuple:
    while link[2] > depth:
        link = link[3] if link[3] is not None and link[3][2] >= depth else link[0]
    return link


class Lattice:
    """Pieces of a vocabulary file, their scores, and segmentation by them."""

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        self.ids: dict[str, int] = {}
        self.bytes_at: dict[int, int] = {}
        self.raw: list[bytes] = [b""] * n
        scores = np.zeros(n)
        for i in range(n):
            p = m.id_to_piece(i)
            if m.is_byte(i):
                self.bytes_at[int(p[3:5], 16)] = i
                self.raw[i] = bytes([int(p[3:5], 16)])
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                self.ids[p.replace(MARK, " ")] = i
                scores[i] = m.get_score(i)
                self.raw[i] = p.replace(MARK, " ").encode()
        if len(self.bytes_at) != 256:
            raise ValueError("the vocabulary has no byte pieces")
        if any("\n" in p or " " in p.lstrip(" ") for p in self.ids):
            raise ValueError("a piece reaches across words")
        self.raw_all = np.frombuffer(b"".join(self.raw), np.uint8)
        self.raw_size = np.array([len(x) for x in self.raw])
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size
        #: scores as whole numbers: exact sums, so ties are ties
        self.unit = 1.0 if np.all(scores == np.round(scores)) else 1e-4
        whole = np.round(scores / self.unit).astype(np.int64)
        self.value = whole * STEP - 1
        self.longest = max(map(len, self.ids))
        self.unknown = int(min(whole[i] for p, i in self.ids.items() if whole[i] > -(10**8) / self.unit)) - round(UNKNOWN / self.unit)
        self._table()

    # ---- a hash table of pieces for numpy

    def _table(self) -> None:
        self.base = np.uint64(0x9E3779B97F4A7C15)
        hashes = {self._hash(p): i for p, i in self.ids.items()}
        if len(hashes) != len(self.ids):
            raise ValueError("two pieces share a hash")
        self.seen = np.zeros(1 << 20, bool)  # by the upper bits of a hash: most substrings stop here
        self.seen[[h >> 44 for h in hashes]] = True
        bits = max(17, (2 * len(hashes)).bit_length())  # at most half of the first table is taken
        self.shift = np.uint64(64 - bits)
        self.keys, self.vals = np.zeros((4, 1 << bits), np.uint64), np.full((4, 1 << bits), -1, np.int32)
        self.tables = 0
        for h, i in hashes.items():
            for t in range(4):
                s = self._slot(np.uint64(h), t)
                if self.vals[t, s] < 0:
                    self.keys[t, s], self.vals[t, s] = h, i
                    self.tables = max(self.tables, t + 1)
                    break
            else:
                raise ValueError("the table is too full")

    def _hash(self, piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(self.base) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def _slot(self, h, t: int):
        with np.errstate(over="ignore"):
            return ((h ^ (h >> np.uint64(31))) * np.uint64((0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA24BAED4963EE407)[t])) >> self.shift

    def find(self, h: np.ndarray) -> np.ndarray:
        s = self._slot(h, 0).astype(np.int64)
        out = np.where(self.keys[0].take(s) == h, self.vals[0].take(s), -1)
        for t in range(1, self.tables):
            rest = np.flatnonzero(out < 0)  # few: most pieces are in the first table
            own = h[rest]
            s = self._slot(own, t).astype(np.int64)
            out[rest] = np.where(self.keys[t].take(s) == own, self.vals[t].take(s), -1)
        return out

    # ---- one part at a time

    def edges(self, part: str) -> list[list[tuple[int, int, int]]]:
        """For each end: (start, value, id or -1 for a character's bytes), longest first."""
        return [[], *(self.edges_to(part, j) for j in range(1, len(part) + 1))]

    def edges_to(self, part: str, j: int) -> list[tuple[int, int, int]]:
        row, get = [], self.ids.get
        for i in range(max(0, j - self.longest), j):
            k = get(part[i:j])
            if k is not None:
                row.append((i, int(self.value[k]), k))
        if not row or row[-1][0] != j - 1:
            row.append((j - 1, self.unknown * STEP - len(part[j - 1].encode("utf-8", "surrogatepass")), -1))
        return row

    def n_best(self, part: str, n: int) -> list[tuple[int, bytes]]:
        """Up to ``n`` (value, ids as bytes) of a part, best first: forward Viterbi, then A* from the end."""
        if len(part) > TOGETHER:
            return self._n_best_long(part, n)
        edges = self.edges(part)
        ahead = [0]
        for row in edges[1:]:
            ahead.append(max(ahead[i] + v for i, v, _ in row))
        end = len(part)
        heap: list = [(-ahead[end], (), end, 0)]
        out = []
        while heap and len(out) < n:
            _, lens, at, passed = heapq.heappop(heap)
            if not at:
                out.append((passed, self._ids_of(part, lens)))
                continue
            for i, v, _ in edges[at]:
                heapq.heappush(heap, (-(ahead[i] + v + passed), (*lens, i - at), i, v + passed))
        return out

    def _n_best_long(self, part: str, n: int) -> list[tuple[int, bytes]]:
        """The same search, in the same order, in memory that grows with the part.

        A hypothesis is a link to the one it goes on from.  Hypotheses of one value are taken
        together: those left from better ones are put in order by where they part, and each is followed
        down, the longest piece first, before the next one's turn.  A place is gone on from n times at
        most, as n better ways through it are known by then.
        """
        edges = [[]] + [self.edges_to(part, j) for j in range(1, len(part) + 1)] if len(part) <= SPREAD else None
        to = edges.__getitem__ if edges else lambda j: self.edges_to(part, j)
        ahead = [0] * (len(part) + 1)  # Python integers: a long part's value has no bound
        for j in range(1, len(part) + 1):
            ahead[j] = max(ahead[i] + v for i, v, _ in to(j))
        visits = [0] * (len(part) + 1)
        end, turn = len(part), 0
        heap: list = [(-ahead[end], 0, end, 0, _ROOT)]
        out: list = []
        while heap and len(out) < n:
            level, same = heap[0][0], []
            while heap and heap[0][0] == level:
                _, _, at, passed, link = heapq.heappop(heap)
                if visits[at] < n:
                    same.append((_Place(link), at, passed, link))
            heapq.heapify(same)
            while same and len(out) < n:
                _, at, passed, link = heapq.heappop(same)
                todo = [(at, passed, link)]
                while todo and len(out) < n:
                    at, passed, link = todo.pop()
                    if not at:
                        out.append((passed, self._ids_of(part, _steps(link))))
                        continue
                    if visits[at] >= n:
                        continue
                    visits[at] += 1
                    for i, v, _ in reversed(to(at)):
                        cost = -(ahead[i] + v + passed)
                        if cost == level:
                            todo.append((i, v + passed, _link(link, i - at)))
                        else:
                            turn += 1
                            heapq.heappush(heap, (cost, turn, i, v + passed, _link(link, i - at)))
        return out

    def _ids_of(self, part: str, lens: tuple) -> bytes:
        ids, at = [], 0
        for n in reversed(lens):
            p = part[at : at - n]
            k = self.ids.get(p)
            ids += [k] if k is not None else [self.bytes_at[x] for x in p.encode("utf-8", "surrogatepass")]
            at -= n
        return np.array(ids, "<u2").tobytes()

    # ---- many parts at once

    def best_of(self, parts: list[str]) -> tuple[list[bytes], list[int], np.ndarray]:
        """Of each part: the best ids, its value, and how far the second best is below (-1: none)."""
        ids: list = [b""] * len(parts)
        value, gap = [0] * len(parts), np.full(len(parts), -1, np.int64)
        by: dict[int, list[int]] = {}
        for i, p in enumerate(parts):
            if 0 < len(p) <= TOGETHER:
                by.setdefault(len(p) if len(p) <= 12 else (len(p) + 3) // 4 * 4, []).append(i)
            elif p:
                two = self.n_best(p, 2)
                value[i], ids[i] = two[0]
                gap[i] = two[0][0] - two[1][0] if len(two) > 1 else -1
        for width, own in by.items():
            for lo in range(0, len(own), ROWS):
                rows = own[lo : lo + ROWS]
                got, v, g = self._together([parts[i] for i in rows], width)
                gap[rows] = g
                for i, x, y in zip(rows, got, v.tolist()):
                    ids[i], value[i] = x, y
        return ids, value, gap

    def _together(self, parts: list[str], width: int):
        n = len(parts)
        size = np.array([len(p) for p in parts])
        flat = np.frombuffer("".join(p.ljust(width, "\0") for p in parts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, width)
        code = (flat.astype(np.uint64) + np.uint64(1)).T.copy()  # [place, part]
        reach = min(self.longest, width)
        edge = np.full((reach + 1, width + 1, n), _NEVER, np.int64)  # by length and end
        edge_id = np.full((reach + 1, width + 1, n), -1, np.int32)
        h = np.zeros((width, n), np.uint64)
        inside = np.arange(1, width + 1)[:, None] <= size[None]
        used = []  # (end, length) with an edge in any part
        for k in range(1, reach + 1):
            h = (h[:-1] if k > 1 else h) * self.base + code[k - 1 :]
            likely = np.flatnonzero(self.seen.take((h >> np.uint64(44)).astype(np.int64)) & inside[k - 1 :])
            found = self.find(h.ravel()[likely])
            likely, found = likely[found >= 0], found[found >= 0]
            edge[k, k:].reshape(-1)[likely] = self.value[found]
            edge_id[k, k:].reshape(-1)[likely] = found
            used += [(j + k, k) for j in np.flatnonzero(np.bincount(likely // n)).tolist()]
        bare = (edge_id[1, 1:] < 0) & inside
        if bare.any():
            c = flat.T[bare]
            edge[1, 1:][bare] = self.unknown * STEP - (1 + (c > 0x7F).astype(np.int64) + (c > 0x7FF) + (c > 0xFFFF))
            used = sorted({*used, *((int(j) + 1, 1) for j in np.flatnonzero(bare.any(1)))})
        used.sort(key=lambda x: (x[0], -x[1]))  # longest first: it stays among equals
        ahead, back = np.full((width + 1, n), _NEVER, np.int64), np.zeros((width + 1, n), np.int8)
        ahead[0] = 0
        for j, k in used:
            v = ahead[j - k] + edge[k, j]
            better = v > ahead[j]
            np.copyto(ahead[j], v, where=better)
            np.copyto(back[j], np.int8(k), where=better)
        behind = np.full((width + 1, n), _NEVER, np.int64)
        behind[size, np.arange(n)] = 0
        for j, k in reversed(used):
            np.maximum(behind[j - k], behind[j] + edge[k, j], out=behind[j - k])
        best = ahead[size, np.arange(n)]
        # the best path, from the end; its edges go, so that the second best has to leave it
        whose, ends, ids = [], [], []
        at, who = size.copy(), np.arange(n)
        while len(who):
            j, k = at[who], back[at[who], who].astype(np.int64)
            whose.append(who)
            ends.append(j)
            ids.append(edge_id[k, j, who])
            edge[k, j, who] = _NEVER
            at[who] -= k
            who = who[at[who] > 0]
        second = np.full(n, _NEVER, np.int64)
        for j, k in used:
            np.maximum(second, ahead[j - k] + edge[k, j] + behind[j], out=second)
        whose, ends, ids = map(np.concatenate, (whose, ends, ids))
        order = np.lexsort((ends, whose))
        whose, ends, ids = whose[order], ends[order], ids[order]
        stop = 2 * np.cumsum(np.bincount(whose, minlength=n))
        joined = ids.astype("<u2").tobytes()
        ends_at = stop.tolist()
        out = [joined[i:j] for i, j in zip([0, *ends_at[:-1]], ends_at)]
        for w in np.unique(whose[ids < 0]).tolist():
            own: list[int] = []
            for j, i in zip(ends[whose == w].tolist(), ids[whose == w].tolist()):
                own += [i] if i >= 0 else [self.bytes_at[x] for x in parts[w][j - 1].encode("utf-8", "surrogatepass")]
            out[w] = np.array(own, "<u2").tobytes()
        return out, best, np.where(second > _NEVER // 2, best - second, -1)

    # ---- whole texts

    def score(self, value: int, count: int) -> float:
        return (value + count) // STEP * self.unit

    def raw_of(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for, some ten thousand ids at a time."""
        out = []
        for lo in range(0, len(ids), 1 << 15):
            own = ids[lo : lo + (1 << 15)]
            size = self.raw_size[own]
            upto = np.cumsum(size)
            out.append(self.raw_all[np.repeat(self.raw_at[own] - (upto - size), size) + np.arange(upto[-1])].tobytes())
        return b"".join(out)

    def text_of(self, ids: bytes) -> str:
        return b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u2").tolist())).decode("utf-8", "surrogatepass")

    def decode(self, ids: bytes) -> str:
        """The text of ids: their bytes, without the blank ahead."""
        return self.text_of(ids)[1:]


def part_form(part: str) -> str:
    """A pre-token as the lattice has it: with its blank ahead."""
    return part if part[:1] == "\n" else " " + part


class Segmenter:
    """N-best segmentations of whole texts, with a bounded cache of parts: the least used half goes when it's full."""

    def __init__(self, path: str, n: int):
        self.lattice, self.n = Lattice(path), n
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.ids: list[bytes] = []
        self.held = 0
        # scores without STEP, how far the second best is below, bytes of ids, texts that had the part
        self.total, self.gap, self.size, self.hits = (np.zeros(1024, np.int64) for _ in range(4))
        self.more: dict[str, list[tuple[int, bytes]]] = {}
        self.more_held = 0

    def learn(self, parts: list[str]) -> None:
        """Solve parts that the cache doesn't hold."""
        ids, value, gap = self.lattice.best_of([part_form(p) for p in parts])
        at, upto = len(self.ids), len(self.ids) + len(parts)
        if upto > len(self.total):
            self.total, self.gap, self.size, self.hits = (np.concatenate([x, np.zeros(upto, np.int64)]) for x in (self.total, self.gap, self.size, self.hits))
        self.total[at:upto] = [(v + len(i) // 2) // STEP for v, i in zip(value, ids)]
        self.gap[at:upto] = gap
        self.size[at:upto] = list(map(len, ids))
        self.hits[at:upto] = 0
        self.ids += ids
        self.at.update(zip(parts, range(at, upto)))
        self.held += sum(map(len, parts)) + sum(map(len, ids))

    def trim(self) -> None:
        """Keep the most used parts, up to half of either bound."""
        names = list(self.at)  # in the order of their numbers
        order = np.argsort(-self.hits[: len(names)], kind="stable")[: CACHE // 2]
        held = np.cumsum([len(names[i]) + len(self.ids[i]) for i in order.tolist()])
        order = np.sort(order[held <= CACHE_BYTES // 2])
        self.at = {names[i]: k for k, i in enumerate(order.tolist())}
        self.ids = [self.ids[i] for i in order.tolist()]
        self.total, self.gap, self.size, self.hits = (x[order] for x in (self.total, self.gap, self.size, self.hits // 2))
        self.held = sum(map(len, self.at)) + sum(map(len, self.ids))

    def segment(self, texts) -> list[list[tuple[int, bytes]]]:
        """Of each text of a list or an Arrow column without nulls: up to n (value, ids), best first."""
        names, which, first = self.split(texts)
        if new := [p for p in names if p not in self.at]:
            self.learn(new)
        at = np.fromiter(map(self.at.__getitem__, names), np.int64, len(names))[which]
        out = [self._whole(names, which[i:j], at[i:j]) for i, j in zip(first[:-1].tolist(), first[1:].tolist())]
        if len(self.at) > CACHE or self.held > CACHE_BYTES:
            self.trim()
        return out

    @staticmethod
    def split(texts) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Different parts of texts; which of them each part of the texts is; and each text's first part, and one more.

        Arrow cuts texts as ``pre_tokens`` does where no two blanks meet; others, few, are cut by it.
        """
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        marked = pc.replace_substring(texts.cast(pa.large_string()), "\n", " \n")
        odd = pc.or_(pc.or_(pc.match_substring(marked, "  "), pc.equal(pc.binary_length(marked), 0)), pc.or_(pc.starts_with(marked, " "), pc.ends_with(marked, " ")))
        odd_at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if len(odd_at):
            marked = pc.if_else(odd, pa.scalar(None, pa.large_string()), marked)
        cut = pc.split_pattern(marked, " ")
        many = pc.fill_null(pc.list_value_length(cut), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = cut.flatten().dictionary_encode()
        names, which = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        if len(odd_at):
            number = {p: i for i, p in enumerate(names)}
            runs, upto = [], 0
            start = np.cumsum(many) - many
            for i in odd_at.tolist():
                parts = pre_tokens(texts[i].as_py())
                if parts and parts[0][:1] == "\n":
                    parts = ["", *parts]  # the blank ahead of the text stands alone
                runs += [which[upto : start[i]], np.array([number.setdefault(p, len(number)) for p in parts], np.int64)]
                upto, many[i] = start[i], len(parts)
            names, which = list(number), np.concatenate([*runs, which[upto:]])
        return names, which, np.concatenate([[0], np.cumsum(many)])

    def _whole(self, names: list[str], which: np.ndarray, at: np.ndarray) -> list[tuple[int, bytes]]:
        """The n best of a text, whose parts are ``names`` at ``which`` and in the cache at ``at``."""
        if not len(at):
            return [(0, b"")]
        self.hits[at] += 1
        joined = b"".join(map(self.ids.__getitem__, at.tolist()))
        # scores and numbers of pieces are summed apart: a text's value may be beyond 64 bits
        total = int(self.total[at].sum()) * STEP - len(joined) // 2
        out = [(total, joined)]
        if self.n < 2:
            return out
        gap = self.gap[at]
        # only the n - 1 smallest gaps, later ones first among equals, can be in the n best
        open_ = np.flatnonzero(gap >= 0)
        if len(open_) >= self.n:
            g = gap[open_]
            open_ = open_[g <= np.partition(g, self.n - 2)[self.n - 2]]
        open_ = open_[np.lexsort((-open_, gap[open_]))][: self.n - 1]
        spots = sorted(open_.tolist())
        ends = np.cumsum(self.size[at])[spots].tolist()
        begins = [e - len(self.ids[at[s]]) for s, e in zip(spots, ends)]
        options = [self._more(names[which[s]]) for s in spots]
        loss = [[o[0][0] - v for v, _ in o] for o in options]
        heap, seen = [(0, (), (0,) * len(spots))], {(0,) * len(spots)}
        while heap and len(out) <= self.n:
            lost, _, choice = heapq.heappop(heap)
            if any(choice):
                changed, upto = [], 0
                for k, c in enumerate(choice):
                    if c:
                        changed += [joined[upto : begins[k]], options[k][c][1]]
                        upto = ends[k]
                out.append((total - lost, b"".join([*changed, joined[upto:]])))
                if len(out) == self.n:
                    break
            for k in range(len(spots)):
                if choice[k] + 1 < len(options[k]):
                    nxt = (*choice[:k], choice[k] + 1, *choice[k + 1 :])
                    if nxt not in seen:
                        seen.add(nxt)
                        cost = sum(x[c] for x, c in zip(loss, nxt))
                        heapq.heappush(heap, (cost, tuple((-s, c) for s, c in zip(spots, nxt) if c), nxt))
        return out

    def _more(self, part: str) -> list[tuple[int, bytes]]:
        found = self.more.get(part)
        if found is None:
            if len(self.more) > CACHE // 4 or self.more_held > CACHE_BYTES // 4:
                self.more.clear()
                self.more_held = 0
            form = part_form(part)
            found = self.more[part] = self.lattice.n_best(form, self.n)
            if any(self.lattice.text_of(i) != form for _, i in found):
                raise ValueError("a segmentation doesn't give its part back")
            self.more_held += len(part) + sum(len(i) for _, i in found)
        return found


_segmenters: dict[tuple[str, int], Segmenter] = {}


def segmenter(path: str, n: int) -> Segmenter:
    if (path, n) not in _segmenters:
        _segmenters.clear()
        _segmenters[path, n] = Segmenter(path, n)
    return _segmenters[path, n]


def encode(docs: DataFrame, path: str, n: int = 4, ids: bool = True, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The ``n`` best segmentations of every whole text.

    Returns key, ``rank`` arrays in best-first order: ``scores`` (sums of the pieces' scores; a
    character without a piece scores ``UNKNOWN`` below the least piece and becomes its bytes),
    ``lengths`` (pieces), ``digests`` (XXH64 of the ids as little-endian 16-bit numbers, 16 hex
    digits), ``segmentations`` (the ids, if ``ids``), and ``round_trip``: whether every segmentation
    decodes to the text.  Null counts as empty, which has one segmentation of no piece; a text has
    fewer than ``n`` where it has no more; rows may repeat, a null key is passed on; an empty table
    gives no rows; other columns are ignored.  Texts may have any length: a worker holds a block of
    them, the lattice of its longest part and its bounded cache.
    """
    import pyarrow as pa
    import pyarrow.compute as pc
    import xxhash

    kind = docs.schema[key].dataType.simpleString()
    more = ", segmentations array<array<int>>" if ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("nbest", _segmenters.clear)
        own = segmenter(path, n)
        for b in batches:
            for lo, hi in blocks(pc.utf8_length(b.column(1)).to_pylist()):
                texts = b.column(1).slice(lo, hi - lo)
                all_found = own.segment(texts)
                # the bytes of every text's best ids, one text after another, each with its blank ahead
                best = [np.frombuffer(f[0][1], "<u2") for f in all_found]
                back = memoryview(own.lattice.raw_of(np.concatenate(best)))
                sizes = [int(own.lattice.raw_size[i].sum()) for i in best]
                scores, lengths, digests, trips, all_ids = [], [], [], [], []
                upto = 0
                for t, size, found in zip(texts, sizes, all_found):
                    lengths.append([len(i) // 2 for _, i in found])
                    scores.append([own.lattice.score(v, m) for (v, _), m in zip(found, lengths[-1])])
                    digests.append([xxhash.xxh64_hexdigest(i) for _, i in found])
                    # the others differ from the first in parts whose segmentations were seen to give the part back
                    trips.append(back[upto : upto + size][1:] == t.as_buffer().to_pybytes())
                    upto += size
                    if ids:
                        all_ids.append([np.frombuffer(i, "<u2").astype(np.int32) for _, i in found])
                cols = [b.column(0).slice(lo, hi - lo), pa.array(scores, pa.list_(pa.float64())), pa.array(lengths, pa.list_(pa.int32())), pa.array(digests, pa.list_(pa.string())), pa.array(trips, pa.bool_())]
                names = [key, "scores", "lengths", "digests", "round_trip"]
                if ids:
                    cols.append(pa.array([[x.tolist() for x in row] for row in all_ids], pa.list_(pa.list_(pa.int32()))))
                    names.append("segmentations")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select(docs[key], text_column(docs, text).alias("text")).mapInArrow(run, f"`{key}` {kind}, scores array<double>, lengths array<int>, digests array<string>, round_trip boolean{more}")


def decode(rows: DataFrame, path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """``rows`` with ``out``: the text of an array of ids.  Null ids give null; no ids the empty text."""
    import pandas as pd

    def text_of(s):
        lat = segmenter(path, 1).lattice
        return s.map(lambda x: None if x is None else lat.decode(np.asarray(x, "<u2").tobytes()))

    text_of.__annotations__ = {"s": pd.Series, "return": pd.Series}
    text_of = F.pandas_udf("string")(text_of)
    return rows.withColumn(out, text_of(F.col(ids)))
