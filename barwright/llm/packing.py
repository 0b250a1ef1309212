"""Best-fit packing of documents into bins of a fixed capacity, under conflicts between sources and duplicate clusters.

Every document is cut into pieces of at most ``capacity`` words.  A bin holds at most ``per_source`` pieces of one source and one of a duplicate
cluster; a full piece fills a bin alone.  Pieces are dealt to shards by a hash, so that a shard holds about ``shard_words`` words or
``shard_rows`` documents, whatever the size of the corpus, and a source or cluster with a third of all rows is spread evenly.  Inside a shard pieces come in falling
length.  The open bins are ordered by the room they have left; each bin carries bitmaps of its sources (one for each allowed repeat) and of its
clusters.  For a piece the search starts at the smallest sufficient room and goes on to the next larger one until a bin has no
conflict: the tightest compatible bin.  Without one, a new bin opens.

Documents without a word take no place and are returned without a bin.  A null source or cluster never conflicts.  Ties are broken
by doc_id (as text) and piece, and equal rows are packed each for itself.  A null doc_id is packed like any other.  An empty table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

CAPACITY = 2048
PER_SOURCE = 2
SHARD_WORDS = 1 << 20
SHARD_ROWS = 1 << 12
OUT = "doc_id bigint, piece int, first_word bigint, n_words bigint, shard bigint, bin int, bin_offset bigint"


class Bins:
    """The open bins of one shard, found by the room left."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.rooms = 0  # bit r: some bin has r words left
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.room: list[int] = []
        self.sources: list[list[int]] = []
        self.clusters: list[int] = []

    def conflicts(self, b: int, source: int, cluster: int) -> bool:
        return bool(self.sources[b][-1] & source or self.clusters[b] & cluster)

    def tightest(self, size: int, source: int, cluster: int) -> int | None:
        """The compatible bin with the least sufficient room."""
        rooms = self.rooms >> size << size
        while rooms:
            least = rooms & -rooms
            for b in self.by_room[least.bit_length() - 1]:
                if not self.conflicts(b, source, cluster):
                    return b
            rooms ^= least
        return None

    def put(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Bin and offset of a piece; ``source`` and ``cluster`` are single bits, 0 for none."""
        b = self.tightest(size, source, cluster)
        if b is None:
            b = len(self.room)
            self.room.append(self.capacity)
            self.sources.append([0] * self.per_source)
            self.clusters.append(0)
        else:
            self._leave(b)
        at = self.capacity - self.room[b]
        self.room[b] -= size
        for k in range(self.per_source - 1, 0, -1):
            self.sources[b][k] |= self.sources[b][k - 1] & source
        self.sources[b][0] |= source
        self.clusters[b] |= cluster
        if self.room[b]:
            self.by_room[self.room[b]].append(b)
            self.rooms |= 1 << self.room[b]
        return b, at

    def _leave(self, b: int) -> None:
        level = self.by_room[self.room[b]]
        level.remove(b)
        if not level:
            self.rooms &= ~(1 << self.room[b])


def pack_shard(pieces: pd.DataFrame, capacity: int, per_source: int) -> pd.DataFrame:
    """Bins of the pieces of one shard (doc_id, piece, copy, first_word, n_words, source, cluster, shard)."""
    pieces = pieces.sort_values(["n_words", "doc_id", "piece", "copy", "cluster"], ascending=[False, True, True, True, True], kind="stable", na_position="first")
    bins, bits = Bins(capacity, per_source), ({}, {})
    bit = lambda k, v: 0 if v is None or v != v else 1 << bits[k].setdefault(v, len(bits[k]))
    # a cluster met once in the shard cannot conflict and needs no bit
    again = set(pieces["cluster"].dropna()[pieces["cluster"].dropna().duplicated()])
    placed = [bins.put(n, bit(0, s), bit(1, c) if c in again else 0) for n, s, c in zip(pieces["n_words"].tolist(), pieces["source"], pieces["cluster"])]
    out = pieces[["doc_id", "piece", "first_word", "n_words", "shard"]].copy()
    out["bin"], out["bin_offset"] = zip(*placed) if placed else ((), ())
    return out


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", cluster: str | None = None, capacity: int = CAPACITY, per_source: int = PER_SOURCE,
         shard_words: int = SHARD_WORDS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per piece with the columns of ``OUT``; (shard, bin) names a bin, ``bin_offset`` the place of the piece in it.

    ``cluster``: a column with the duplicate cluster of a document; without it, documents with equal words in lower case form one.
    """
    word = "[^\\x20\\x09-\\x0D]+"
    value = F.col(cluster) if cluster else F.xxhash64(F.trim(F.regexp_replace(F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[\\x20\\x09-\\x0D]+", " ")))
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(word)), F.lit(0)).cast("bigint")
    sized = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(source).cast("string").alias("source"), F.when(F.col(text).isNotNull(), value).cast("bigint").alias("cluster"), size.alias("all"))
    # equal rows are counted, then told apart, so that they do not meet in one shard
    rows = sized.groupBy("doc_id", "source", "cluster", "all").agg(F.count("*").alias("rows")).select("doc_id", "source", "cluster", "all", F.explode(F.sequence(F.lit(1).cast("bigint"), "rows")).alias("copy"))
    cut = rows.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("all") - 1) / capacity).cast("int")))).alias("piece"))
    pieces = cut.select("doc_id", "source", "cluster", "copy", "piece", (F.col("piece") * F.lit(capacity).cast("bigint")).alias("first_word"),
                        F.least(F.lit(capacity).cast("bigint"), F.col("all") - F.col("piece") * capacity).alias("n_words"))
    total, n = sized.agg(F.sum("all"), F.count("*")).first()
    shards = int(max((total or 0) // shard_words, n // shard_rows) + 1)
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster", "copy", "piece"), F.lit(shards)))
    packed = (dealt.where("n_words > 0").withColumns({c: F.col(c).cast("string") for c in ("doc_id", "cluster")})  # pandas has no long with nulls
              .groupBy("shard").applyInPandas(lambda p: pack_shard(p, capacity, per_source), OUT.replace("doc_id bigint", "doc_id string")).withColumn("doc_id", F.col("doc_id").cast("bigint")))
    return packed.unionByName(dealt.where("n_words <= 0").select("doc_id", "piece", "first_word", "n_words", "shard", F.lit(None).cast("int").alias("bin"), F.lit(None).cast("bigint").alias("bin_offset")))
