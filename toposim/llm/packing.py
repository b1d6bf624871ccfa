"""Best-fit packing with certified partitions.

Documents are tokenised, closed by an end id and cut into pieces of at
most ``CAPACITY`` ids (the first piece takes the odd length).  Pieces
are dealt over partitions and each is packed by best-fit decreasing.  A
lower bound from dual feasible functions (rounding up items over half
the rest, and the stair functions of Fekete and Schepers) certifies a
partition whose bin count meets it.  Partitions with a gap keep their
full bins and give up the pieces of the others; these are dealt anew
over half as many partitions and packed again, until no partition has a
gap or ``ROUNDS`` are over.

Only lengths and checksums are shuffled, never ids.  Defined cases: a
null text is empty and packs its end id alone; repeated rows are packed
each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toposim.llm.bpe import _kept
from toposim.llm.common import materialize, table, texts_of
from toposim.session import ship

CAPACITY = 1024
END_ID = 2
#: Pieces in a partition (about 40 MB as a pandas frame), and rounds at most.
PER_PARTITION, ROUNDS = 200_000, 4
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, deal long"


class Tokenizer:
    """Ids of a byte-level BPE in a ``tokenizers`` JSON file.

    The file's vocabulary is run by ``tiktoken``, whose merges give the same
    ids (tokens are numbered in the order of the file's merges) in about a
    quarter of the time; a text with white space on which the two libraries'
    patterns differ, or that holds an added token of the file, goes through
    ``tokenizers``.
    """

    _ODD_SPACE = "[\x1c-\x1f\x85\u180e]"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer as Library

        self.library = Library.from_file(path)
        own = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
        sign = {chr(c): c for c in own}  # the signs that stand for bytes in the file
        sign |= {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in own)}
        special = {t.content for t in self.library.get_added_tokens_decoder().values()}
        self.slow = re.compile("|".join([self._ODD_SPACE, *map(re.escape, sorted(special))]))
        ranks = {bytes(sign[c] for c in t): i for t, i in self.library.get_vocab(with_added_tokens=False).items() if t not in special}
        self.fast = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.slow.search(text):
            return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.asarray(self.fast.encode_ordinary(text), dtype="<u4")


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; only the first may be shorter."""
    first = (n - 1) % capacity + 1
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece; ``deal`` numbers a task's pieces, to deal them out evenly."""
    ship(docs.sparkSession)
    end = np.asarray([END_ID], dtype="<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        deal = TaskContext.get().partitionId() << 36
        tok = _kept(Tokenizer, path)
        for pdf in batches:
            rows = []
            for key, text in zip(pdf["doc_id"].tolist(), texts_of(pdf["text"])):
                ids = tok.encode(text).tobytes() + end
                for i, (s, n) in enumerate(cut(len(ids) // 4, capacity)):
                    rows.append((key, i, s, n, zlib.crc32(ids[4 * s:4 * (s + n)]), deal))
                    deal += 1
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "deal"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select("doc_id", "text").mapInPandas(run, _PIECES)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that any packing of ``lengths`` needs, by dual feasible functions."""
    h = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    total, count = np.cumsum(h * x), np.cumsum(h)
    best = -(-int(total[-1]) // capacity)
    for t in range(1, capacity // 2 + 1):  # below t nothing, above capacity - t a whole bin
        whole = int(count[-1] - count[capacity - t])
        part = int(total[capacity - t] - total[t - 1])
        best = max(best, whole - (-part // capacity))
    for k in range(1, 40):
        a = (k + 1) * x
        u = np.where(a % capacity == 0, x * k, a // capacity * capacity)
        best = max(best, -(-int((u * h).sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: (bin, offset) per item and the fill per bin."""
    n = len(lengths)
    bins, offsets, fill = np.zeros(n, np.int64), np.zeros(n, np.int64), []
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit r: some bin has r ids left
    order = np.argsort(-lengths, kind="stable")
    for i, size in zip(order.tolist(), lengths[order].tolist()):
        fits = mask >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            b = open_bins[r].pop()
            if not open_bins[r]:
                mask &= ~(1 << r)
        else:
            r, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += size
        if r - size:
            open_bins[r - size].append(b)
            mask |= 1 << (r - size)
    return bins, offsets, np.asarray(fill, np.int64)


def _pack_partition(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["length", "deal"], ascending=[False, True], ignore_index=True)
    lengths = pdf["length"].to_numpy(np.int64)
    bins, offsets, fill = best_fit(lengths)
    return pdf.assign(bin=bins, offset=offsets, fill=fill[bins], gap=len(fill) - lower_bound(lengths))


def pack(pieces: DataFrame, per_partition: int = PER_PARTITION, rounds: int = ROUNDS) -> DataFrame:
    """Adds sequence_id and offset to ``pieces``."""
    ship(pieces.sparkSession)
    todo = materialize(pieces, "pieces")
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    done, parts = None, max(1, -(-todo.count() // per_partition))
    for r in range(rounds):
        dealt = todo.withColumn("part", F.pmod(F.xxhash64("deal", F.lit(r)), F.lit(parts)).cast("int"))
        packed = materialize(dealt.groupBy("part").applyInPandas(
            _pack_partition, _PIECES + ", part int, bin long, offset long, fill long, gap long"), "packed")
        last = r + 1 == rounds or parts == 1
        final = packed if last else packed.where(f"gap = 0 or fill = {CAPACITY}")
        rows = final.select(*cols, (F.lit(r << 58) + F.col("part").cast("long") * (1 << 26) + F.col("bin")).alias("sequence_id"), "offset")
        done = rows if done is None else done.unionByName(rows)
        if last:
            break
        todo = packed.where(f"gap > 0 and fill < {CAPACITY}").select(*[c.split()[0] for c in _PIECES.split(", ")])
        n = todo.count()
        if not n:
            break
        parts = max(1, min(parts // 2, -(-n // per_partition)))
    return done


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return pack(pieces(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json")))
