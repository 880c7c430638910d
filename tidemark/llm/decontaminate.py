"""Benchmark decontamination over a distributed positional inverted index.

The corpus is indexed in segments of whole documents.  A segment is one row: its documents, where
each begins on the segment's line of word positions, and for every term of its texts the sorted list
of its positions.  The index doesn't depend on what is searched: one stored index serves any
benchmark.  Searching a segment is local: the rarest term of a phrase gives the places, and the other
terms' lists, moved by their offsets, are intersected with them from the rarest on.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textscan
from tidemark.llm.shared import claim, mapped, packed, publish, shared_dir, stored, text_column, unpacked

WINDOW = 10
#: Consecutive words of a document among which a proximity match has all terms of a window.
NEAR = 30
#: Benchmark words that the driver turns into one file of phrases; a larger benchmark is more files.
FILE_WORDS = 2_000_000
#: Documents and bytes of a segment; a longer document is a segment by itself.
SEGMENT_ROWS, SEGMENT_BYTES = 2_000, 8 << 20
#: Positions left free between documents, so that no phrase and no neighbourhood spans two.
GAP = 64


@dataclass
class Phrases:
    """Windows of benchmark items as places in a term list."""

    terms: np.ndarray  # sorted uint64 hashes
    item_ids: list
    item: np.ndarray  # of each window, its item
    window: np.ndarray  # [windows, width]: term numbers, -1 beyond a short item's end
    size: np.ndarray  # of each window


def phrases(items: list[tuple], width: int = WINDOW) -> Phrases:
    """All windows of ``width`` consecutive words; an item of fewer words, but not none, is one."""
    import pyarrow as pa

    kept, rows, owner = [], [], []
    for w in textscan.scan(pa.array([t or "" for _, t in items], pa.string()), textscan.MARKS):
        for d in range(w.hi - w.lo):
            h = w.hash[w.first[d] : w.first[d + 1]]
            if not len(h):
                continue
            kept.append(items[w.lo + d][0])
            for lo in range(max(1, len(h) - width + 1)):
                rows.append(h[lo : lo + width])
                owner.append(len(kept) - 1)
    terms = np.unique(np.concatenate(rows)) if rows else np.zeros(0, np.uint64)
    window = np.full((len(rows), width), -1, np.int32)
    for i, r in enumerate(rows):
        window[i, : len(r)] = np.searchsorted(terms, r)
    return Phrases(terms, kept, np.array(owner, np.int64), window, (window >= 0).sum(1) if rows else np.zeros(0, np.int64))


def save(p: Phrases, uri: str) -> None:
    publish(uri, packed(p.terms, p.item, p.window.astype(np.int32), p.size.astype(np.int64), np.frombuffer(json.dumps([p.window.shape[1], p.item_ids]).encode(), np.uint8)))


def load(uri: str) -> Phrases:
    terms, item, window, size, told = unpacked(mapped(uri))
    width, ids = json.loads(told.tobytes())
    return Phrases(terms.view(np.uint64), ids, item.view(np.int64), window.view(np.int32).reshape(-1, width), size.view(np.int64))


SEGMENT = "docs array<{kind}>, begins binary, counts binary, terms binary, ends binary, places binary"
_COLUMNS = ["docs", "begins", "counts", "terms", "ends", "places"]


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The positions of all terms in all texts, a row for each segment.

    A row has the keys of its documents, each one's first position and number of words, the hashes of
    the terms that occur, in order, the end of each one's list, and the lists, one after another.
    Null texts have no words; rows may repeat and keys may be null; an empty table gives no segments.
    """
    import pyarrow as pa

    kind = docs.schema[key].dataType.simpleString()

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("decontaminate")
        for b in batches:
            off, raw = textscan.buffers(b.column(1))
            for seg_lo, seg_hi in textscan.groups(off, SEGMENT_BYTES):
                for lo in range(seg_lo, seg_hi, SEGMENT_ROWS):
                    hi = min(seg_hi, lo + SEGMENT_ROWS)
                    yield segment(b.column(0).slice(lo, hi - lo), raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])

    def segment(keys, raw, off):
        begins, counts, hashes, where, at = [], [], [], [], 0
        for lo, hi in textscan.groups(off):
            w = textscan.words(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], textscan.MARKS)
            n = np.diff(w.first)
            start = at + np.cumsum(n + GAP) - n - GAP
            begins.append(start)
            counts.append(n)
            at = int(start[-1] + n[-1] + GAP)
            hashes.append(w.hash)
            where.append(np.arange(len(w.hash)) + np.repeat(start - w.first[:-1], n))
        narrow = np.uint32 if at < 2**32 else np.int64
        hashes, where = np.concatenate(hashes), np.concatenate(where).astype(narrow)
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
        ends = np.append(first[1:], len(hashes)) if len(first) else first
        pack = lambda x, t: pa.array([np.ascontiguousarray(x, t).tobytes()], pa.binary())
        lists = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
        return pa.RecordBatch.from_arrays([lists, pack(np.concatenate(begins), np.int64), pack(np.concatenate(counts), np.int64), pack(hashes[first], np.uint64), pack(ends, narrow), pack(where[order], narrow)], names=_COLUMNS)

    return docs.select(docs[key], text_column(docs, text).alias("text")).mapInArrow(index, SEGMENT.format(kind=kind))


def search_segment(p: Phrases, begins, terms, ends, places, near: int = NEAR):
    """(document, item) pairs of exact and of proximity matches, and a segment's exact (start, size)s."""
    exact, close, spans = [], [], []
    if not len(p.window) or not len(terms):
        return exact, close, spans
    spot = np.minimum(np.searchsorted(terms, p.terms), len(terms) - 1)
    there = terms[spot] == p.terms
    upto = ends[spot].astype(np.int64)
    begin_at = np.where(spot > 0, ends[np.maximum(spot - 1, 0)].astype(np.int64), 0)
    length = np.append(np.where(there, upto - begin_at, 0), 0)
    much = np.where(p.window >= 0, length[p.window], np.iinfo(np.int64).max)
    for w in np.flatnonzero(much.min(1) > 0):  # all terms occur in the segment
        size = int(p.size[w])
        order = np.argsort(much[w, :size], kind="stable")
        rare = int(order[0])
        lists = [places[begin_at[t] : upto[t]] for t in p.window[w, :size].tolist()]
        hold = lists[rare].astype(np.int64)
        begin, beside = hold - rare, hold
        for o in order[1:].tolist():
            x = lists[o]
            if len(begin):
                begin = begin[_holds(x, begin + o)]
            if len(beside):  # what can't be within near words of all terms goes
                i = np.searchsorted(x, np.maximum(beside - near + 1, 0))
                i[i == len(x)] = len(x) - 1
                beside = beside[np.abs(x[i].astype(np.int64) - beside) < near]
            if not len(begin) and not len(beside):
                break
        item = int(p.item[w])
        if len(begin):
            doc = np.searchsorted(begins, begin, "right") - 1
            exact += [(int(d), item) for d in np.unique(doc)]
            spans += [(int(s), size) for s in begin]
        if len(beside):
            doc = np.searchsorted(begins, _together(lists, beside, near), "right") - 1
            close += [(int(d), item) for d in np.unique(doc)]
    return exact, close, spans


def _holds(x: np.ndarray, want: np.ndarray) -> np.ndarray:
    i = np.searchsorted(x, want)
    i[i == len(x)] = len(x) - 1
    return x[i] == want


def _together(lists: list[np.ndarray], around: np.ndarray, near: int) -> np.ndarray:
    """First places of stretches of ``near`` words that hold a place of every list, looked for around given places."""
    lefts = []
    for x in lists:
        i, j = np.searchsorted(x, np.maximum(around - near + 1, 0)), np.searchsorted(x, around, "right")
        n = j - i
        lefts.append(x[np.repeat(i - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))].astype(np.int64))
    left = np.unique(np.concatenate(lefts))
    for x in lists:
        i = np.searchsorted(x, left)
        left, i = left[i < len(x)], i[i < len(x)]
        left = left[x[i].astype(np.int64) - left < near]
    return left


def store_phrases(benchmark: DataFrame, width: int = WINDOW, item: str = "item_id", item_text: str = "text") -> list[str]:
    """The URIs of files of all windows of a benchmark's different items; each has about FILE_WORDS words."""
    spark = benchmark.sparkSession
    sized = benchmark.select(F.coalesce(benchmark[item].cast("string"), F.lit("")).alias("item"), text_column(benchmark, item_text).alias("text")).distinct()
    words = sized.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // 2 + 1  # at most
    files = int(-(-words // FILE_WORDS))
    home, out = shared_dir(spark), []
    for k in range(files):
        rows = sized.where(F.pmod(F.xxhash64("item", "text"), F.lit(files)) == k) if files > 1 else sized
        uri = f"{home}/phrases-{k:06d}"
        save(phrases(sorted(((r[0], r[1]) for r in rows.collect()), key=repr), width), uri)  # about FILE_WORDS words
        out.append(uri)
    return out


_phrases: dict[str, Phrases] = {}


def search(segments: DataFrame, files: list[str], near: int = NEAR, key: str = "doc_id") -> DataFrame:
    """The matches of stored phrases in a stored index: ``decontaminate``'s result, a row for every document.

    A worker maps the files into memory and searches its segments for each in turn, so a row's
    matches are all in one place, however many files there are, and nothing is shuffled.
    """
    import pyarrow as pa

    if near > GAP:
        raise ValueError(f"near is at most {GAP}")
    kind = segments.schema["docs"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("decontaminate", _phrases.clear)
        for b in batches:
            for r in range(b.num_rows):
                yield result(*[b.column(c)[r] for c in range(6)])

    def result(docs, begins, counts, terms, ends, places):
        begins, counts, terms = np.frombuffer(begins.as_py(), np.int64), np.frombuffer(counts.as_py(), np.int64), np.frombuffer(terms.as_py(), np.uint64)
        narrow = np.uint32 if int(begins[-1] + counts[-1] + GAP) < 2**32 else np.int64
        ends, places = np.frombuffer(ends.as_py(), narrow), np.frombuffer(places.as_py(), narrow)
        n = len(begins)
        items: list[set] = [set() for _ in range(n)]
        beside: list[set] = [set() for _ in range(n)]
        spans: set = set()
        for uri in files:
            if uri not in _phrases:
                if len(_phrases) > 64:
                    _phrases.clear()
                _phrases[uri] = load(uri)
            p = _phrases[uri]
            exact, close, found = search_segment(p, begins, terms, ends, places, near)
            for d, i in exact:
                items[d].add(p.item_ids[i])
            for d, i in close:
                beside[d].add(p.item_ids[i])
            spans.update(found)
        hits, own, covered = np.zeros(n, np.int64), [[] for _ in range(n)], {}
        for s, size in sorted(spans):
            d = int(np.searchsorted(begins, s, "right")) - 1
            own[d].append({"first": s - int(begins[d]), "size": size})
            hits[d] += max(0, s + size - max(s, covered.get(d, 0)))
            covered[d] = max(covered.get(d, 0), s + size)
        return pa.RecordBatch.from_arrays(
            [docs.values, pa.array(counts), pa.array(hits), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array([len(x) for x in beside], pa.int32()), pa.array(own, pa.list_(pa.struct([("first", pa.int64()), ("size", pa.int64())])))],
            names=[key, "n_words", "n_hit", "items", "n_near", "spans"],
        )

    return segments.select(*_COLUMNS).mapInArrow(run, f"`{key}` {kind}, n_words long, n_hit long, items array<string>, n_near int, spans array<struct<first: long, size: long>>")


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, near: int = NEAR, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Exact phrase and proximity matches of benchmark windows in every row.

    Words are runs of ASCII letters and digits and of everything beyond ASCII, A-Z in lower case; they
    are told apart by 64-bit hashes.  Returns key, ``n_words``, ``n_hit`` (words inside an occurrence
    of a window), ``items`` (sorted ids, as strings, of items with an occurring window), ``n_near``
    (items with a window all of whose terms are among some ``near`` consecutive words of the
    document), and ``spans`` (first word and number of words of each exact match).

    There is a row for every row of ``docs``: ids may repeat or be null, and equal ids don't mix.
    Null texts have no words; items may repeat, a null item id is the empty one; an empty table
    gives no rows, and an empty benchmark no hits; other columns are ignored.  ``build_index``,
    ``store_phrases`` and ``search`` are its three steps: an index that is kept serves any benchmark.
    """
    segments = stored(build_index(docs, key, text), "postings")
    return search(segments, store_phrases(benchmark, width, item, item_text), near, key)
