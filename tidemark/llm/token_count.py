"""Token counts by a two-tier look-up: a broadcast table of frequent pre-tokens, then worker caches."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import text_column

#: Entries of the broadcast table, whatever the input, and characters of one: at most 2 MB of keys of ASCII.
FREQUENT, ENTRY = 32_768, 64
#: One in so many texts is looked at for the table, by a hash of the text.
LOOK = 16
#: Entries and characters of a worker's cache before it is emptied.
CACHE, CACHE_CHARS = 400_000, 32 << 20
#: Entries of a task's running count before it is cut to its larger half.
RUNNING = 300_000
#: Texts, and characters of them, that are counted together; a longer text is alone.
BLOCK, BLOCK_CHARS = 512, 4 << 20

_RUNS = re.compile(r" +[^ \n]*|\n[^ \n]*")


def pre_tokens(text: str) -> list[str]:
    """The parts of a text that no piece of the vocabulary reaches across.

    A part is a run of blanks and what follows it, or a line feed and what follows it.  The blank
    that a tokenizer puts ahead of a text, and the one blank ahead of a word, are left out: "a" is
    the piece text " a".  " a" is two blanks and "a".  A lone blank is "".
    """
    if not text:
        return []
    parts = text.replace("\n", " \n").split(" ")
    if "" in parts:  # runs of blanks: rare
        return [m[1:] if m[0] == " " else m for m in _RUNS.findall(" " + text)]
    return parts


class Tokenizer:
    """Counts by the library that belongs to a vocabulary file: sentencepiece or tokenizers."""

    def __init__(self, path: str):
        self.path = path
        if path.endswith(".model"):
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
            #: pieces hold blanks at their front only, none holds a line feed, and a text gets one blank ahead
            self.parts = not any("\n" in p or "▁" in p.lstrip("▁") for p in pieces) and self.model.encode("a", out_type=str)[0].startswith("▁") and len(self.model.encode("a  b ")) > len(self.model.encode("a b"))
        elif path.endswith(".json"):
            import tokenizers

            self.model, self.parts = tokenizers.Tokenizer.from_file(path), False
            self.model.no_truncation()
            self.model.no_padding()
        else:
            raise ValueError(f"neither .model nor .json: {path}")

    def split(self, text: str) -> list[str]:
        """Pre-tokens as the vocabulary sees them: its mark of a blank is a blank."""
        return pre_tokens(text.replace("▁", " ") if "▁" in text else text)

    def whole(self, texts: list[str]) -> list[int]:
        """Tokens of whole texts, straight from the library."""
        if self.path.endswith(".model"):
            return [len(x) for x in self.model.encode(texts, num_threads=1)]
        return [len(x.ids) for x in self.model.encode_batch(texts, add_special_tokens=False)]

    def of_parts(self, parts: list[str]) -> list[int]:
        """Tokens of each pre-token in its place: a line feed has no blank ahead, a lone blank is one piece."""
        return [1 if not p else n - (p[0] == "\n") for p, n in zip(parts, self.whole(parts))]


class Cache(dict):
    """Lengths of pre-tokens, emptied after a block of texts that took it beyond its bounds."""

    chars = 0

    def add(self, words: list[str], lengths: list[int]) -> None:
        self.update(zip(words, lengths))
        self.chars += sum(map(len, words))

    def trim(self) -> None:
        if len(self) > CACHE or self.chars > CACHE_CHARS:
            self.clear()
            self.chars = 0


_tokenizers: dict[str, Tokenizer] = {}
_caches: dict[str, Cache] = {}


def tokenizer(path: str) -> Tokenizer:
    """One for each process and file."""
    if path not in _tokenizers:
        _tokenizers[path] = Tokenizer(path)
    return _tokenizers[path]


def _pack(counts: Counter, most: int) -> bytes:
    top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:most]
    return "\x00".join(f"{n}\x01{w}" for w, n in top if "\x00" not in w and "\x01" not in w).encode("utf-8", "surrogatepass")


def _unpack(blob: bytes) -> Counter:
    out: Counter = Counter()
    for x in blob.decode("utf-8", "surrogatepass").split("\x00") if blob else ():
        n, _, w = x.partition("\x01")
        out[w] = int(n)
    return out


def frequent_pre_tokens(docs: DataFrame, path: str, text: str = "text", most: int = FREQUENT) -> list[str]:
    """The most frequent pre-tokens of one in ``LOOK`` texts, by summaries of bounded size.

    Which texts are looked at is decided by a hash of the text.  Pre-tokens of over ``ENTRY``
    characters are left to the caches.  Each task counts its texts, cutting its count to the larger half when it grows beyond
    ``RUNNING``, and gives its ``most`` first as one row; the rows are merged over two rounds of
    tasks, so neither a task nor the driver ever holds more than some bounded summaries, and no
    pre-token is shuffled.  The list only speeds up counting: it never changes a count.
    """
    import pyarrow as pa

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_split = tokenizer(path).split
        total: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                total.update(w for w in own_split(t.as_py()) if len(w) <= ENTRY)
                if len(total) > RUNNING:
                    total = Counter(dict(total.most_common(RUNNING // 2)))
        yield pa.RecordBatch.from_arrays([pa.array([_pack(total, most)], pa.binary())], names=["summary"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for x in b.column(0):
                total.update(_unpack(x.as_py()))
                if len(total) > RUNNING:
                    total = Counter(dict(total.most_common(RUNNING // 2)))
        yield pa.RecordBatch.from_arrays([pa.array([_pack(total, most)], pa.binary())], names=["summary"])

    base = docs.select(text_column(docs, text).alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(LOOK)) == 0)
    parts = base.rdd.getNumPartitions()
    rows = base.mapInArrow(count, "summary binary")
    rows = rows.repartition(max(1, round(parts**0.5))).mapInArrow(merge, "summary binary").repartition(1).mapInArrow(merge, "summary binary")
    found: Counter = Counter()
    for r in rows.collect():  # one row
        found.update(_unpack(bytes(r[0])))
    return [w for w, _ in sorted(found.items(), key=lambda x: (-x[1], x[0]))[:most]]


def blocks(chars: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most BLOCK texts and BLOCK_CHARS characters, or of one longer text."""
    lo = held = 0
    for i, n in enumerate(chars):
        if i > lo and (i - lo == BLOCK or held + n > BLOCK_CHARS):
            yield lo, i
            lo, held = i, 0
        held += n
    if lo < len(chars):
        yield lo, len(chars)


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, key: str = "doc_id", text: str = "text", most: int = FREQUENT) -> DataFrame:
    """key, ``n_bytes``, ``n_tokens`` and ``over_limit`` (n_tokens > ``limit``) of every row.

    Counts are those of the library on the whole text, without added special tokens.  Where the
    vocabulary can be cut into pre-tokens, a text's count is the sum over its pre-tokens: first by
    the broadcast table (at most ``most`` entries: one blob of keys and one byte array of lengths),
    then by the worker's cache, which is filled by one call of the library for all misses of a
    batch.  Other vocabularies go to the library whole.  Null counts as empty (0 tokens); rows may
    repeat, a null key is passed on; an empty table gives no rows; other columns are ignored.  Texts
    may have any length: a worker holds a block of them and its bounded cache.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    spark = docs.sparkSession
    own = tokenizer(path)
    table = frequent_pre_tokens(docs, path, text, most) if own.parts else []
    table = [w for w in table if w]
    lengths = own.of_parts(table) if table else []
    kept = [(w, n) for w, n in zip(table, lengths) if n < 256]
    shared = spark.sparkContext.broadcast(("\x00".join(w for w, _ in kept).encode(), bytes(n for _, n in kept)))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        if not tok.parts:
            for b in batches:
                texts = b.column(1).to_pylist()
                n = [m for lo in range(0, len(texts), 256) for m in tok.whole(texts[lo : lo + 256])]
                yield out(b, [len(t.encode()) for t in texts], n)
            return
        blob, lens = shared.value
        first = dict(zip(blob.decode().split("\x00"), lens)) if lens else {}
        first[""] = 1  # a lone blank
        second = _caches.setdefault(path, Cache())
        for b in batches:
            n_bytes, n_tokens = [], []
            for lo, hi in blocks(pc.utf8_length(b.column(1)).to_pylist()):
                texts = b.column(1).slice(lo, hi - lo).to_pylist()
                split = [tok.split(t) for t in texts]
                different = set().union(*split)
                new = [w for w in different if w not in first and w not in second]
                if new:
                    second.add(new, tok.of_parts(new))
                get, miss = first.get, second.__getitem__
                for t, parts in zip(texts, split):
                    got = [get(w) for w in parts]
                    if None in got:
                        got = [miss(w) if n is None else n for w, n in zip(parts, got)]
                    n_tokens.append(sum(got))
                    n_bytes.append(len(t) if t.isascii() else len(t.encode()))
                second.trim()
            yield out(b, n_bytes, n_tokens)

    def out(b, n_bytes, n_tokens):
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())], names=[key, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key], text_column(docs, text).alias("text")).mapInArrow(counted, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
