"""Near-duplicates by SimHash, compared in bit planes.

A text's fingerprint has a bit set where over half the XXH64 values of its shingles have it.
Two fingerprints that differ in at most `radius` bits agree in all but `radius` of their
eight bytes. So every distinct fingerprint goes to one bucket for each choice of the bytes
that may differ; the other bytes are the bucket's key. A bucket leaves 8 * radius bits free
and can hold 65,536 distinct fingerprints at a radius of 2, however many rows there are, so
no key grows with the data. In a bucket the free bits lie in planes, one row of bits for each
place, and a fingerprint's distance to the one `s` places on is counted for all fingerprints
at once by carry-save adders. A block is left as soon as all its distances are beyond the
radius. Tasks report a star for each group they find, never all pairs.

A null text counts as empty; a text without words has the fingerprint zero, which links like
any other. Rows with the same fingerprint, repeated rows too, are in one component. A row
without an id has the component of the rows it is linked to through an equal fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.components import components
from rankweave.llm.words import column_bytes
from rankweave.session import written

SHINGLE = 3
RADIUS = 2
SEED = 42
# hashes of one text whose bits are counted together
_STEP = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of one text, words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words)) - 1
    first, last = starts[:len(words) - k].tolist(), ends[k:].tolist()
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for lo in range(0, len(first), _STEP):
        found = [digest(line[a:b], SEED) for a, b in zip(first[lo:lo + _STEP], last[lo:lo + _STEP], strict=True)]
        bits = np.unpackbits(np.array(found, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(first), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = column_bytes(batch.column(1))
        whole, at = memoryview(data), at.tolist()
        found = [fingerprint(bytes(whole[a:b]), shingle) for a, b in zip(at[:-1], at[1:], strict=True)]
        prints = pa.array(np.array(found, np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), prints], names=["id", "print"])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, print): the fingerprint of every row as a signed 64-bit number."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda b: _fingerprints(b, shingle), "id long, print long")


def within(free: np.ndarray, run: np.ndarray, bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places in the same run whose `free` bits differ in at most `radius` places.

    Rows of a run stand together. `radius` is 0 to 3.
    """
    n = len(free)
    planes = ((free[None, :] >> np.arange(bits, dtype=np.uint64)[:, None]) & np.uint64(1)).astype(np.uint8)
    shifted = [np.packbits(planes[:, r:], axis=1, bitorder="little") for r in range(min(8, n))]
    left, right = [], []
    for s in range(1, n):
        live = np.packbits(run[:-s] == run[s:], bitorder="little")
        if not live.any():
            break                                   # no run is longer
        size = len(live)
        here, there = shifted[0][:, :size], shifted[s & 7][:, s >> 3:(s >> 3) + size]
        ones, twos, more = (np.zeros(size, np.uint8) for _ in range(3))
        for k in range(0, bits, 3):
            three = [here[j] ^ there[j] for j in range(k, min(k + 3, bits))]
            three += [np.zeros(size, np.uint8)] * (3 - len(three))
            half = three[0] ^ three[1]
            add, carry = half ^ three[2], (three[0] & three[1]) | (half & three[2])
            up = ones & add
            ones ^= add
            more |= twos & carry
            twos ^= carry
            more |= twos & up
            twos ^= up
            beyond = (more | twos | ones, more | twos, more | (ones & twos), more)[radius]
            live &= ~beyond
            if not live.any():
                break
        hit = np.flatnonzero(np.unpackbits(live, bitorder="little")[:n - s])
        left.append(hit)
        right.append(hit + s)
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _groups(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest place reachable from each place."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _stars(batches: Iterator[pa.RecordBatch], choices: list[tuple[int, ...]], radius: int) -> Iterator[pa.RecordBatch]:
    """Links among the rows of each bucket; rows come sorted by (choice, key)."""
    shifts = np.array(choices, np.uint64).reshape(len(choices), -1) * np.uint64(8)

    def links(choice: np.ndarray, key: np.ndarray, prints: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (choice[1:] != choice[:-1])
        run = np.cumsum(new) - 1
        size = np.bincount(run)[run] if len(run) else run
        free = np.zeros(len(key), np.uint64)
        for k in range(shifts.shape[1]):
            byte = (prints.view(np.uint64) >> shifts[choice, k]) & np.uint64(255)
            free |= byte << np.uint64(8 * k)
        pairs = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        scale = np.ceil(np.log2(np.maximum(size, 1))).astype(int)
        for step in range(1, int(scale.max(initial=0)) + 1):   # runs of like size together
            at = np.flatnonzero(scale == step)
            if len(at):
                left, right = within(free[at], run[at], 8 * shifts.shape[1], radius)
                root = _groups(len(at), left, right)
                moved = np.flatnonzero(root != np.arange(len(at)))
                pairs.append((ids[at[moved]], ids[at[root[moved]]]))
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    held: list[np.ndarray] | None = None
    for batch in batches:
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        if not len(rows[0]):
            continue
        last = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])
        cut = int(np.argmax(last))
        yield links(*(x[:cut] for x in rows))
        held = [x[cut:] for x in rows]
    if held is not None:
        yield links(*held)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(id, print, component): the fingerprint of each row and the smallest id reachable by links.

    One row per row of `docs`. Fingerprints, links and components stay in Spark.
    """
    prints = written(fingerprints(docs, shingle, id_col, text_col), "prints")
    distinct = prints.where("id IS NOT NULL").groupBy("print").agg(F.min("id").alias("id"))
    if radius:
        choices = list(combinations(range(8), radius))
        keys = [F.struct(F.lit(k).alias("choice"), F.col("print").bitwiseAND(F.lit(_kept(c))).alias("key"))
                for k, c in enumerate(choices)]
        buckets = (distinct.select("print", "id", F.inline(F.array(*keys))).select("choice", "key", "print", "id")
                   .repartition("choice", "key").sortWithinPartitions("choice", "key", "print"))
        links = buckets.mapInArrow(lambda b: _stars(b, choices, radius), "a long, b long")
        roots = components(links).select(F.col("u").alias("id"), F.col("v").alias("root"))
        distinct = distinct.join(roots, "id", "left")
        distinct = distinct.select("print", F.coalesce("root", "id").alias("component"))
    else:
        distinct = distinct.select("print", F.col("id").alias("component"))
    # written first, so that both sides come straight from a shuffle and a hot fingerprint can be split
    return prints.join(written(distinct, "components"), "print", "left").select("id", "print", "component")


def _kept(choice: tuple[int, ...]) -> int:
    """The bits outside the chosen bytes, as a signed number."""
    mask = ~sum(255 << (8 * byte) for byte in choice) & ((1 << 64) - 1)
    return mask - (1 << 64) if mask >> 63 else mask


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose id is the smallest of its component; rows without an id stay."""
    found = near_duplicates(docs, shingle, radius, id_col, text_col)
    gone = found.where("id != component").select(F.col("id").alias("gone_id")).distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone["gone_id"], "left_anti")
