"""Tag, key and membership indexes as DataFrame operations."""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.errors import CodecError
from tidemark.operators.split import SPAN_BITS

# ---- tags


@dataclass(frozen=True)
class TagIndex:
    """Devices by (key, value) tags: a table of (device, key, value)."""

    tags: DataFrame
    device: str = "device"

    @classmethod
    def of(cls, rows: DataFrame, device: str, columns: list[str]) -> TagIndex:
        """From a table with a column for each key; null tags are no tags."""
        pairs = F.inline(F.array(*[F.struct(F.lit(c).alias("key"), rows[c].cast("string").alias("value")) for c in columns]))
        return cls(rows.select(rows[device].alias("device"), pairs).where("value is not null").distinct())

    def write(self, path: str) -> None:
        self.tags.select(self.device, "key", "value").write.mode("overwrite").parquet(path)

    @classmethod
    def read(cls, spark: SparkSession, path: str, device: str = "device") -> TagIndex:
        return cls(spark.read.parquet(path), device)

    def _any(self, wanted: list[tuple[str, str]]) -> DataFrame:
        hit = F.lit(False)
        for k, v in wanted:
            hit = hit | ((F.col("key") == k) & (F.col("value") == v))
        return self.tags.where(hit)

    def query(self, key: str, value: str) -> DataFrame:
        return self._any([(key, value)]).select(self.device).distinct()

    def query_and(self, wanted: list[tuple[str, str]]) -> DataFrame:
        """Devices with all of the tags; none for an empty list."""
        need = len(set(wanted))
        found = self._any(wanted).groupBy(self.device).agg(F.countDistinct("key", "value").alias("_n"))
        return found.where((F.col("_n") == need) & F.lit(need > 0)).select(self.device)

    def query_or(self, wanted: list[tuple[str, str]]) -> DataFrame:
        """Devices with any of the tags; none for an empty list."""
        return self._any(wanted).select(self.device).distinct()

    def counts(self) -> DataFrame:
        """One row: different devices and different tags."""
        return self.tags.agg(F.countDistinct(self.device).alias("devices"), F.countDistinct("key", "value").alias("tags"))

    def bitmaps(self, ordinal: str) -> DataFrame:
        """For each tag and bucket of ordinals: a bitmap of the devices, and how many they are."""
        o = F.col(ordinal)
        made = self.tags.groupBy("key", "value", F.bitmap_bucket_number(o).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(o)).alias("bitmap"))
        return made.withColumn("devices", F.bitmap_count("bitmap"))


# ---- keys

#: Fixed value: longer keys aren't indexed
MOST_KEY_BYTES = 256


def key_index(rows: DataFrame, key: str, value: str, seq: str) -> DataFrame:
    """A map: each key of up to 256 bytes with the value written last."""
    fits = rows.where(rows[key].isNotNull() & (F.octet_length(rows[key]) <= MOST_KEY_BYTES))
    return fits.groupBy(F.col(key).alias("key")).agg(F.max_by(value, seq).alias("value"))


def lookup(index: DataFrame, wanted: DataFrame, key: str = "key") -> DataFrame:
    """``wanted`` with the value of each key, null where there's none."""
    return wanted.join(index.withColumnRenamed("key", "_key"), F.col(key) == F.col("_key"), "left").drop("_key")


# ---- Bloom filters


@dataclass(frozen=True)
class BloomShape:
    """Bits and hash functions for a number of items and a rate of false positives."""

    bits: int
    hashes: int

    @classmethod
    def sized(cls, n: int, p: float) -> BloomShape:
        """bits = -n ln p / ln2^2, hashes = bits / n ln2 from 1 to 10; 1024 bits where n or p make no sense."""
        bits = max(1, math.ceil(-n * math.log(p) / math.log(2) ** 2)) if n > 0 and 0 < p < 1 else 1024
        return cls(bits, min(10, max(1, math.ceil(bits / n * math.log(2)))) if n > 0 else 1)

    def positions(self, item: Column) -> Column:
        """The item's bits, as an array; Spark's seeded XXH64 of its text."""
        text = item.cast("string")
        return F.array(*[F.pmod(F.xxhash64(F.concat(F.lit(f"{k}:"), text)), F.lit(self.bits)) for k in range(self.hashes)])

    def positions_of(self, item: str) -> list[int]:
        """The same bits, in Python."""
        out = []
        for k in range(self.hashes):
            h = xxhash.xxh64_intdigest(f"{k}:{item}".encode(), 42)
            out.append((h - (1 << 64) if h >= 1 << 63 else h) % self.bits)
        return out

    def false_positives(self, items: int) -> float:
        """The expected rate after so many items; 0 for none."""
        return (1 - math.exp(-self.hashes * items / self.bits)) ** self.hashes if items else 0.0


def bloom_bits(rows: DataFrame, item: str, shape: BloomShape, by: list[str] | None = None) -> DataFrame:
    """The set bits of a filter for each group: (by..., bucket, bitmap).  Filters unite by ``bitmap_or_agg``."""
    spread = rows.where(rows[item].isNotNull()).select(*(by or []), F.explode(shape.positions(rows[item])).alias("_bit"))
    return spread.groupBy(*(by or []), F.bitmap_bucket_number("_bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_bit")).alias("bitmap"))


def bloom_union(bits: DataFrame, by: list[str]) -> DataFrame:
    """Filters of a finer grouping put together: blocks to chunks, chunks to files."""
    return bits.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


#: Asked items that a filter is tested for together.
ASKED = 4_096


def bloom_probe(bits: DataFrame, wanted: DataFrame, item: str, shape: BloomShape, by: list[str] | None = None) -> DataFrame:
    """(by..., item) pairs for which a filter may contain the item: never fewer than are true.

    A filter is one row, whose bitmaps are turned into words once.  The different asked items stand in
    blocks of ASKED with their bits; a filter meets each block once and tests all bits of all its items.
    """
    by = by or []
    # what a filter uses of a bitmap of 4096 bytes, as words; a word's first byte is its highest
    words = F.transform(F.sequence(F.lit(0), F.lit(min(511, shape.bits // 64))), lambda i: F.conv(F.hex(F.substring("bitmap", i * 8 + 1, F.lit(8))), 16, -10).cast("long"))
    filters = bits.select(*by, "bucket", words.alias("words")).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "words"))).alias("_words"))
    asked = wanted.where(wanted[item].isNotNull()).select(wanted[item].alias("_item")).distinct()
    spots = F.transform(shape.positions(F.col("_item")), lambda p: F.struct(F.bitmap_bucket_number(p).alias("bucket"), F.bitmap_bit_position(p).alias("at")))
    many = asked.count()
    parts = max(1, -(-many // ASKED))
    blocks = asked.select(F.struct(F.col("_item"), spots.alias("spots")).alias("_ask"), F.pmod(F.xxhash64("_item"), F.lit(parts)).cast("int").alias("_block")).groupBy("_block").agg(F.collect_list("_ask").alias("_asks"))
    held = lambda s: F.call_function("shiftright", F.get(F.element_at("_words", s["bucket"]), (s["at"] / 64).cast("int")), ((7 - (s["at"] / 8).cast("int") % 8) * 8 + s["at"] % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    met = filters.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).join(blocks, "_block")
    hits = F.filter("_asks", lambda a: F.forall(a["spots"], lambda s: F.coalesce(held(s), F.lit(False))))
    return met.select(*by, F.explode(hits).alias("_hit")).select(*by, F.col("_hit._item").alias(item))


class Bloom:
    """A single filter on the driver, with a byte form."""

    def __init__(self, shape: BloomShape):
        self.shape, self.items, self._set = shape, 0, bytearray(-(-shape.bits // 8))

    def insert(self, item: str) -> None:
        for b in self.shape.positions_of(item):
            self._set[b // 8] |= 1 << b % 8
        self.items += 1

    def might_contain(self, item: str) -> bool:
        return all(self._set[b // 8] >> b % 8 & 1 for b in self.shape.positions_of(item))

    def clear(self) -> None:
        self.items, self._set = 0, bytearray(len(self._set))

    @property
    def false_positives(self) -> float:
        return self.shape.false_positives(self.items)

    def to_bytes(self) -> bytes:
        """Bits, hash functions and items as 8, 4 and 8 little-endian bytes, then the bits."""
        return struct.pack("<QIQ", self.shape.bits, self.shape.hashes, self.items) + bytes(self._set)

    @classmethod
    def from_bytes(cls, data: bytes) -> Bloom:
        if len(data) < 20:
            raise CodecError("a filter has 20 bytes ahead")
        bits, hashes, items = struct.unpack_from("<QIQ", data)
        out = cls(BloomShape(bits, hashes))
        if len(data) != 20 + len(out._set):
            raise CodecError("a filter of another length")
        out.items, out._set = items, bytearray(data[20:])
        return out


class LevelledBloom:
    """Filters of pages, united for chunks and the file; pages keep their chunk when stored."""

    def __init__(self, shape: BloomShape):
        self.shape, self.pages, self.chunk_of = shape, {}, {}

    def add(self, page: int, item: str) -> None:
        self.pages.setdefault(page, Bloom(self.shape)).insert(item)

    def finalize(self, page: int, chunk: int) -> None:
        self.pages.setdefault(page, Bloom(self.shape))
        self.chunk_of[page] = chunk

    def page_might_contain(self, page: int, item: str) -> bool:
        return page in self.pages and self.pages[page].might_contain(item)

    def chunk_might_contain(self, chunk: int, item: str) -> bool:
        return any(self.page_might_contain(p, item) for p, c in self.chunk_of.items() if c == chunk)

    def file_might_contain(self, item: str) -> bool:
        return any(b.might_contain(item) for b in self.pages.values())

    def to_bytes(self) -> bytes:
        head = struct.pack("<QII", self.shape.bits, self.shape.hashes, len(self.pages))
        rows = [struct.pack("<qqI", p, self.chunk_of.get(p, -1), len(d := b.to_bytes())) + d for p, b in sorted(self.pages.items())]
        return head + b"".join(rows)

    @classmethod
    def from_bytes(cls, data: bytes) -> LevelledBloom:
        bits, hashes, n = struct.unpack_from("<QII", data)
        out, at = cls(BloomShape(bits, hashes)), 16
        for _ in range(n):
            p, c, size = struct.unpack_from("<qqI", data, at)
            at += 20
            out.pages[p] = Bloom.from_bytes(data[at : at + size])
            if c >= 0:
                out.chunk_of[p] = c
            at += size
        return out


# ---- global dictionary


def dictionary(rows: DataFrame, text: str, seq: str) -> DataFrame:
    """(text, id): ids from 0 in the order of first appearance.

    Only the different texts, one row each, are put in order, in chunks by where they appear first;
    what the chunks hold ahead of each other is summed over one row for each chunk.  Texts that first
    appear at the same place are in the order of the texts.
    """
    first = rows.where(rows[text].isNotNull()).groupBy(text).agg(F.min(seq).alias("_first"))
    first = first.withColumn("_chunk", F.shiftright(F.col("_first").cast("long"), SPAN_BITS))
    ahead = first.groupBy("_chunk").agg(F.count(F.lit(1)).alias("_n"))
    ahead = ahead.select("_chunk", (F.sum("_n").over(Window.orderBy("_chunk")) - F.col("_n")).alias("_ahead"))  # a row for each chunk
    place = F.row_number().over(Window.partitionBy("_chunk").orderBy("_first", text)) - 1
    return first.withColumn("_place", place).join(ahead, "_chunk").select(text, (F.col("_ahead") + F.col("_place")).cast("int").alias("id"))
