"""Spelling variants: words one edit apart, found by dense prefix-suffix tiling.

Two words are near when one inserted, deleted or replaced code point turns one into the other.
That is so when their common prefix and common suffix together reach the length of the longer
one minus 1. Tiles hold words as padded matrices of code points, once aligned to the left and
once to the right; a pair of tiles is compared column by column, and what agrees so far is
counted for all pairs of words at once.

Which words meet: an edit falls into one of `PARTS` parts of the longer word, all before it
and after it is common to both. So each word is keyed by itself without each part, for its own
length and for the next one, and words meet under equal keys only. Words of a key are dealt
into blocks by a hash once they pass what a tile holds, and pairs of blocks, not the key, are
the unit of work: a key that owns many words is spread over many tasks. Small keys share a
tile. A pair that meets under several keys counts under the first. A tile gives one row per
word, the number of its near words and the best of them, never the pairs.

`count_words` reads texts once; a task sums up the words it meets before anything moves.
Nothing is capped or sampled. Null texts have no words, a null id reads as an empty string.
Repeated rows count as often as they stand. Words of any length work: the number of words in
a tile shrinks as they grow, and a comparison goes on in stretches of columns. An empty table
gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.session import written

#: parts of a word of which an edit touches one
PARTS = 3
#: words of a tile, and code points of a tile of long words
TILE, AREA = 256, 1 << 18
#: distinct words a task holds before it passes their counts on, characters of a text read at once
HELD, PIECE = 1 << 17, 1 << 20

RUN = re.compile("[A-Za-zÀ-ÿ]+")
BREAK = re.compile("[^A-Za-zÀ-ÿ]")


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces that end between words."""
    lo = 0
    while lo < len(text):
        cut = BREAK.search(text, lo + PIECE)
        hi = cut.start() if cut else len(text)
        yield text[lo:hi]
        lo = hi


def slipped(run: str, crc: int, every: int) -> str:
    """The run, or without one code point where `every` divides the checksum of its document and itself."""
    h = zlib.crc32(run.encode(), crc)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 5, least: int = 3,
                slips: int | None = 97) -> DataFrame:
    """(word, n) of words with at least `shortest` code points and `least` occurrences in all texts.

    Words are maximal runs of Latin letters, A-Z in lower case. With `slips`, one in so many of
    the distinct words of a document loses a code point, as the checksum of both says.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())],
                                              names=["word", "n"])

        for batch in batches:
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                start = zlib.crc32(f"{ident or ''}:".encode())
                low = (text.as_py() or "").encode("utf-8").lower().decode("utf-8")      # bytes: A-Z only
                for piece in _pieces(low):
                    for run, n in Counter(RUN.findall(piece)).items():
                        word = slipped(run, start, slips) if slips else run
                        if len(word) >= shortest:
                            held[word] += n
                if len(held) > HELD:
                    yield out()
                    held.clear()
        yield out()

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(scan, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _keys(words: DataFrame) -> DataFrame:
    """(length, key, part, word, n): each word without each part, for its own length and the next one."""
    size, length = F.length("word"), F.col("length")
    longer = words.select("word", "n", F.explode(F.array(size, size + 1)).alias("length"))

    def edge(i: int) -> Column:
        return F.floor(length * i / PARTS).cast("int")

    # the parts of the longer word; what stands behind one is counted from the end
    keys = [F.struct(F.lit(i).alias("part"), F.xxhash64(
        F.lit(i), length, F.substring(F.col("word"), F.lit(1), edge(i)),
        F.when(length > edge(i + 1), F.right("word", length - edge(i + 1))).otherwise("")).alias("key"))
        for i in range(PARTS)]
    return longer.select("length", "word", "n", F.inline(F.array(*keys)))


def _cells(keys: DataFrame) -> DataFrame:
    """Keyed words with the pair of blocks (low, high) they are compared in, and their own block.

    A key with more words than a tile holds is dealt into blocks, and each block meets each.
    """
    room = F.greatest(F.lit(1), F.least(F.lit(TILE), F.floor(F.lit(AREA) / F.col("length"))))
    sizes = keys.groupBy("length", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    blocks = sizes.select("length", "key", F.ceil(F.col("size") / room).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("word", F.lit(11)), F.col("blocks")).cast("int")
    dealt = keys.join(written(blocks, "blocks"), ["length", "key"]).withColumn("block", own)
    return dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "length", "key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        "part", "block", "word", "n")


def _common(left: np.ndarray, right: np.ndarray, alive: np.ndarray, back: bool) -> np.ndarray:
    """How many columns agree from the front, or from the back, for all pairs of rows of two tiles.

    Pairs that are not `alive` may count anything.
    """
    width = left.shape[1]
    found = np.zeros(alive.shape, np.int32)
    alive = alive.copy()
    step = max(1, (AREA << 2) // max(1, alive.size)) if alive.size < 4096 else 1
    for lo in range(0, width, step):
        cols = slice(lo, min(lo + step, width)) if not back else slice(max(0, width - lo - step), width - lo)
        if step == 1:
            alive &= left[:, None, cols.start] == right[None, :, cols.start]
            found += alive
        else:
            same = left[:, None, cols] == right[None, :, cols]
            if back:
                same = same[:, :, ::-1]
            whole = same.all(axis=2)
            found += np.where(alive, np.where(whole, same.shape[2], same.argmin(axis=2)), 0)
            alive &= whole
        if not alive.any():
            break
    return found


class Tile:
    """Words of one band as padded code points, aligned to either side."""

    def __init__(self, words: np.ndarray, length: int):
        m = len(words)
        self.size = np.char.str_len(words)
        self.front = words.astype(f"U{length}").view(np.uint32).reshape(m, length)
        self.back = self.front.copy()
        short = np.flatnonzero(self.size < length)
        if len(short):
            self.back[short, 1:], self.back[short, 0] = self.front[short, :-1], 0


def near_pairs(a: Tile, b: Tile, length: int, part: np.ndarray, meet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of `a` and `b` that are near, among the pairs that `meet` under their `part`.

    The words have `length` code points or one less. A pair is given under the first part of
    the longer word that can hold its edit.
    """
    meet = meet & ((a.size[:, None] == length) | (b.size[None, :] == length))
    prefix = _common(a.front, b.front, meet, False)
    suffix = _common(a.back, b.back, meet, True)
    shorter = np.minimum(a.size[:, None], b.size[None, :])
    prefix, suffix = np.minimum(prefix, shorter), np.minimum(suffix, shorter)
    good = meet & (prefix + suffix >= length - 1)
    x, y = np.nonzero(good)
    if not len(x):
        return x, y
    edges = np.array([length * i // PARTS for i in range(PARTS + 1)])
    p, s = prefix[x, y][:, None], suffix[x, y][:, None]
    first = ((p >= edges[None, :-1]) & (s >= length - edges[None, 1:])).argmax(axis=1)
    mine = first == part[x]
    return x[mine], y[mine]


def _best(words: np.ndarray, n: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    """(word, near, other, other_n): of each row x the number of its pairs and the best y."""
    rank = np.empty(len(words), np.int64)
    rank[np.argsort(words, kind="stable")] = np.arange(len(words))
    order = np.lexsort((rank[y], -n[y], x))
    x, y = x[order], y[order]
    first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    count = np.diff(np.r_[first, len(x)])
    return pa.RecordBatch.from_arrays(
        [pa.array(words[x[first]].tolist(), pa.string()), pa.array(count, pa.int64()),
         pa.array(words[y[first]].tolist(), pa.string()), pa.array(n[y[first]], pa.int64())], names=["word", "near", "other", "other_n"])


def _compare_cells(length: int, words: np.ndarray, n: np.ndarray, part: np.ndarray, cell: np.ndarray, low: np.ndarray,
                   high: np.ndarray, block: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Near words within whole cells of one length; `cell` numbers them in order."""
    ends = np.r_[np.flatnonzero(np.diff(cell)) + 1, len(cell)]
    lo = 0
    while lo < len(cell):
        room = max(1, min(TILE, AREA // length))
        k = max(int(np.searchsorted(ends, lo + room, side="right")) - 1, int(np.searchsorted(ends, lo, side="right")))
        hi = int(ends[k])
        rows = slice(lo, hi)
        tile_words, tile_n, tile_part = words[rows], n[rows], part[rows]
        if low[lo] == high[lo]:                          # whole small cells, or a block against itself
            tile, number = Tile(tile_words, length), cell[rows]
            meet = number[:, None] == number[None, :]
            x, y = near_pairs(tile, tile, length, tile_part, np.triu(meet, 1))
        else:
            one, two = np.flatnonzero(block[rows] == low[lo]), np.flatnonzero(block[rows] != low[lo])
            a, b = Tile(tile_words[one], length), Tile(tile_words[two], length)
            x, y = near_pairs(a, b, length, tile_part[one], np.ones((len(one), len(two)), bool))
            x, y = one[x], two[y]
        if len(x):
            yield _best(tile_words, tile_n, np.r_[x, y], np.r_[y, x])
        lo = hi


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell; a cell that goes on in the next batch waits for it."""
    held: pa.Table | None = None

    def whole(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        length, key, low, high, part, block, n = (
            rows.column(c).to_numpy() for c in ("length", "key", "low", "high", "part", "block", "n"))
        new = np.zeros(len(key), bool)
        for column in (length, key, low, high):
            new[1:] |= column[1:] != column[:-1]
        cell = np.cumsum(new)
        many = np.bincount(cell)[cell] > 1               # a word alone has no partner here
        # cells of a pair of blocks stand alone in a tile
        border = np.flatnonzero(np.diff(length[many]) != 0) + 1
        at = np.flatnonzero(many)
        for mine in np.split(at, border):
            if not len(mine):
                continue
            pair = low[mine] != high[mine]
            words = np.array(rows.column("word").take(pa.array(mine)).to_pylist())
            cuts = np.flatnonzero((np.diff(cell[mine]) != 0) & (pair[1:] | pair[:-1])) + 1
            for run in np.split(np.arange(len(mine)), cuts):
                ids = mine[run]
                yield from _compare_cells(int(length[ids[0]]), words[run], n[ids], part[ids], cell[ids],
                                          low[ids], high[ids], block[ids])

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([held, rows]) if held is not None else rows
        if not rows.num_rows:
            continue
        last = np.ones(rows.num_rows, bool)
        for c in ("length", "key", "low", "high"):
            column = rows.column(c).to_numpy()
            last &= column == column[-1]
        start = int(np.flatnonzero(last)[0])             # sorted: the last cell stands at the end
        held = rows.slice(start)
        if start:
            yield from whole(rows.slice(0, start))
    if held is not None:
        yield from whole(held)


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, other, other_n): near words met in a tile and the best of them; a word may have several rows.

    `words` is (word, n) with distinct words.
    """
    cells = _cells(_keys(words)).repartition("length", "key", "low", "high").sortWithinPartitions(
        "length", "key", "low", "high")
    return cells.mapInArrow(_compare, "word string, near long, other string, other_n long")


def _roots(links: DataFrame) -> DataFrame:
    """(word, root) from (word, root) links to forms: every link is followed to its end, twice as far each round."""
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = written(links.join(ahead, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        links = joined.select("word", "root")
        if joined.where("moved").isEmpty():
            return links


def variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct (word, n).

    The form is the near word of largest n, the first in code-point order of equals, where its
    n is at least `ratio` (2 or more) times that of the word. The root ends the chain of forms.
    """
    if ratio < 2:
        raise ValueError("ratio must be at least 2")
    best = F.min(F.when(F.col("other").isNotNull(), F.struct((-F.col("other_n")).alias("less"), "other")))
    none = words.select("word", F.lit(0).cast("long").alias("near"), F.lit(None).cast("string").alias("other"),
                        F.lit(None).cast("long").alias("other_n"), "n")
    met = near_words(words).withColumn("n", F.lit(None).cast("long"))
    grouped = none.unionByName(met).groupBy("word").agg(
        F.max("n").alias("n"), F.sum("near").alias("n_near"), best.alias("best"))
    fits = -F.col("best.less") >= ratio * F.col("n")
    found = written(grouped.select(
        "word", F.when(fits, F.col("best.other")).alias("form"), "n", "n_near",
        F.when(fits, -F.col("best.less")).alias("form_n")), "forms")
    roots = _roots(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
