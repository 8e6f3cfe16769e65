"""Ranked keyword search: postings, phrases, prefixes, boolean conditions, BM25.

A batch of questions is scored where the words of a case lie. Questions are packed into
blocks, cases into tiles. The tiles are dealt into shares, and every block meets every share in
one join that Spark broadcasts while the table of questions is small. First the leaves of all
questions are counted, which gives the corpus statistics; then the tiles are counted again and
scored, and a task keeps the best hits of each question only. No counts are stored: there
would be some for each pair of a block and a tile, and reading the split texts twice costs far
less. Where the best hits of all questions would be too many for a task, the blocks are dealt
into groups, and a task has one group after the other.

Of an OR of leaves a tile is not scored whole (`_best_plain`). The postings of a leaf in a tile are
ordered by their score, so a few searches tell which of them a case must be among to reach the
last of the best hits; only those cases are scored.

A stored index (`build_index`) holds postings partitioned by a hash of the term, with the field
lengths of each case and a vocabulary for prefixes. Its rows are blocks: the postings of one term
in a run of cases, as arrays. Runs are grouped before anything moves, so far fewer rows are
shuffled, sorted and written than there are postings. A search joins blocks with its words
and takes them apart after that (`unfolded`). A stream stores rows for single postings instead. A
single question without an index is answered by `keyword_scan`, inside each row.
"""

from __future__ import annotations

import json
import pickle
from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.functions.scoring import BM25_B, BM25_K1, bm25
from rankweave.functions.text import STOP_WORDS, WORD_BREAK, folded, kept_words, spaced_words, words
from rankweave.operators.conditions import (
    Leaf, counting, flat, leaf_count, leaf_terms, make_leaf, met, named_leaves, near_places, parse_condition, parsed, pruned,
)
from rankweave.operators.topk import topk_per_group
from rankweave.operators.vectors import HELD_HITS, for_shares, share_of
from rankweave.schemas import CANDIDATES, INDEXED_FIELDS, SEARCHED_FIELDS
from rankweave.session import written

TERM_BUCKETS = 256
# words of a tile of cases, questions of a block, hits packed together
TILE_WORDS, BLOCK_QUESTIONS, PACK_HITS = 200_000, 10_000, 200_000
# tiles of the above size that a scan takes together, pairs of a leaf and a case scored at once
SCAN_TILES, CANDIDATE_PAIRS = 4, 1 << 20
# cells of a table of leaves by cases, sums taken at once, and from which share of the cases of a tile on candidates are summed that way
TABLE_CELLS, SUM_CELLS, DENSE_FROM = 1 << 24, 1 << 18, 100
# words of a run of cases whose postings are stored together
RUN_WORDS = 2_000_000
# hits not yet ranked and blocks that a task holds
WAITING_HITS, HELD_BLOCKS = 100_000, 16


@dataclass(frozen=True)
class KeywordIndex:
    """Either the case table itself (`cases`), or stored postings.

    Stored: `postings` (term_bucket and BLOCKS or POSTINGS; `unfolded` makes POSTINGS of either), `lengths`
    (case_id, lens in the order of `fields`) and `vocabulary` (term_bucket, term). An index
    fed by a stream keeps superseded postings; `versions` (case_id, batch_id) names the
    current ones.
    """

    fields: tuple[str, ...]
    stop_words: tuple[str, ...] = STOP_WORDS
    cases: DataFrame | None = None
    postings: DataFrame | None = None
    lengths: DataFrame | None = None
    vocabulary: DataFrame | None = None
    buckets: int = TERM_BUCKETS
    versions: DataFrame | None = None


def term_bucket(term: Column, buckets: int = TERM_BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _split(cases: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(case_id, all words for each field with a space between them)."""
    return cases.select("case_id", *[spaced_words(F.col(f)).alias(f"ws{i}") for i, f in enumerate(fields)])


def _word_lists(texts: pa.Array) -> pa.Array:
    """The words of texts as `_split` gives them."""
    lists = pc.split_pattern(texts, " ")
    blank = pc.equal(texts, "").to_numpy(zero_copy_only=False)
    if not blank.any():
        return lists
    sizes = np.where(blank, 0, pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    values = lists.flatten()
    return pa.ListArray.from_arrays(pa.array(np.cumsum(np.r_[0, sizes]).astype(np.int32)), values.filter(pc.not_equal(values, "")))


class _Tile:
    """The words of a run of cases as codes; a stop word is -1."""

    def __init__(self, ids: np.ndarray, columns: list[pa.Array], stop_words: Sequence[str]):
        self.ids = ids
        sizes = np.stack([pc.list_value_length(c).to_numpy(zero_copy_only=False) for c in columns], axis=1)
        flat = pa.concat_arrays([c.flatten() for c in columns]).dictionary_encode()
        self.words = flat.dictionary
        codes = np.arange(len(self.words) + 1, dtype=np.int32)[:-1]
        codes[pc.is_in(self.words, pa.array(list(stop_words), pa.string())).to_numpy(zero_copy_only=False)] = -1
        # one segment for each (field, case), the words of a field standing together
        self.codes = codes[flat.indices.to_numpy(zero_copy_only=False)]
        self.sizes = sizes
        self._place()

    def _place(self) -> None:
        cells, n = self.sizes.size, len(self.ids)
        self.segment = np.repeat(np.arange(cells, dtype=np.int32), self.sizes.T.ravel())
        self.lens = np.bincount(self.segment[self.codes >= 0], minlength=cells).reshape(-1, n).T.astype(np.int32)

    @cached_property
    def terms(self) -> list[str]:
        return self.words.to_pylist()

    def __getstate__(self) -> tuple:
        """Without what follows from the sizes."""
        return self.ids, self.words, self.codes, self.sizes

    def __setstate__(self, state: tuple) -> None:
        self.ids, self.words, self.codes, self.sizes = state
        self._place()


def _tiles(batches: Iterator[pa.RecordBatch], fields: int, stop_words: Sequence[str], size: int | None = None) -> Iterator[_Tile]:
    """Tiles of rows as `_split` gives them, of at most `size` words if they hold more than one case."""
    size = size or TILE_WORDS
    for batch in batches:
        texts = [batch.column(1 + f) for f in range(fields)]
        total = sum(pc.add(pc.count_substring(t, " "), pc.cast(pc.not_equal(t, ""), pa.int32())).to_numpy(zero_copy_only=False).astype(np.int64)
                    for t in texts)
        ends, lo = np.cumsum(total), 0
        while lo < batch.num_rows:
            before = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield _Tile(batch.column(0).slice(lo, hi - lo).to_numpy(zero_copy_only=False),
                        [_word_lists(t.slice(lo, hi - lo)) for t in texts], stop_words)
            lo = hi


def _payloads(column: str, values: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.zeros(len(values), np.int32)), pa.array(values, pa.binary())], names=["part", column])


def scan_index(cases: DataFrame, fields: Sequence[str] = SEARCHED_FIELDS,
               stop_words: Sequence[str] = STOP_WORDS) -> KeywordIndex:
    """The case table as an index, nothing stored."""
    return KeywordIndex(tuple(fields), tuple(stop_words), cases.select("case_id", *fields))


POSTINGS = "term string, case_id long, field string, tf int, positions array<int>"
# the postings of a term in a run of cases: number of the field, places of all of them, and where those of each one end
BLOCKS = "term string, case_ids array<long>, fields array<int>, ends array<int>, positions array<int>"


def _lists(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)).astype(np.int32)), pa.array(values))


def _occurrences(tile: _Tile) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code, segment and place of each indexed word, the first of each posting), by code, field and case."""
    at = np.flatnonzero(tile.codes >= 0)
    bits = max(1, len(tile.codes)).bit_length()
    keys = np.sort(tile.codes[at].astype(np.int64) << bits | at)       # segments stand in order, so places sort by them
    code, at = (keys >> bits).astype(np.int32), keys & ((1 << bits) - 1)
    segment = tile.segment[at]
    sizes = tile.sizes.T.ravel()
    place = (at - (np.cumsum(sizes) - sizes)[segment]).astype(np.int32)
    new = np.ones(len(at), bool)
    new[1:] = (segment[1:] != segment[:-1]) | (code[1:] != code[:-1])
    return code, segment, place, np.flatnonzero(new)


def _grouped(batches: Iterator[pa.RecordBatch], fields: Sequence[str], stop_words: Sequence[str], lengths: bool
             ) -> Iterator[pa.RecordBatch]:
    """Postings of each tile, one row per (case, field, term), grouped before anything moves.

    With `lengths` a row without a term for each case, whose positions are the field lengths.
    """
    for tile in _tiles(batches, len(fields), stop_words):
        n = len(tile.ids)
        if lengths:
            none = pa.nulls(n, pa.string())
            yield pa.RecordBatch.from_arrays(
                [none, pa.array(tile.ids), none, pa.array(np.zeros(n, np.int32)),
                 _lists(tile.lens.ravel(), np.arange(n) * len(fields))], names=["term", "case_id", "field", "tf", "positions"])
        code, segment, place, first = _occurrences(tile)
        counts = np.diff(np.append(first, len(code)))
        yield pa.RecordBatch.from_arrays(
            [tile.words.take(pa.array(code[first])), pa.array(tile.ids[segment[first] % n]),
             pa.array(list(fields)).take(pa.array(segment[first] // n)), pa.array(counts.astype(np.int32)), _lists(place, first)],
            names=["term", "case_id", "field", "tf", "positions"])


def _folded(batches: Iterator[pa.RecordBatch], fields: int, stop_words: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """BLOCKS of each run of cases; one without a term holds their field lengths as places."""
    names, whole = ["term", "case_ids", "fields", "ends", "positions"], np.zeros(1, np.int64)
    for tile in _tiles(batches, fields, stop_words, RUN_WORDS):
        n = len(tile.ids)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(1, pa.string()), _lists(tile.ids, whole), _lists(np.full(n, -1, np.int32), whole),
             _lists((np.arange(1, n + 1) * fields).astype(np.int32), whole), _lists(tile.lens.ravel(), whole)], names=names)
        code, segment, place, first = _occurrences(tile)
        if not len(code):
            continue
        code, segment = code[first], segment[first]
        start = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        ends = np.append(first[1:], len(place)) - np.repeat(first[start], np.diff(np.append(start, len(first))))
        yield pa.RecordBatch.from_arrays(
            [tile.words.take(pa.array(code[start])), _lists(tile.ids[segment % n], start), _lists(segment // n, start),
             _lists(ends.astype(np.int32), start), _lists(place, first[start])], names=names)


def _bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.withColumn("term_bucket", F.when(F.col("term").isNull(), -1).otherwise(term_bucket(F.col("term"), buckets)))


def build_postings(cases: DataFrame, fields: Sequence[str] = INDEXED_FIELDS, stop_words: Sequence[str] = STOP_WORDS,
                   buckets: int = TERM_BUCKETS, lengths: bool = False) -> DataFrame:
    """(term_bucket, term, case_id, field, tf, positions); positions count stop words. Nothing shuffles.

    With `lengths` also one row per case in bucket -1, whose positions are the lengths of its fields.
    """
    fields, stop_words = list(fields), list(stop_words)
    return _bucketed(_split(cases, fields).mapInArrow(lambda b: _grouped(b, fields, stop_words, lengths), POSTINGS), buckets)


def build_blocks(cases: DataFrame, fields: Sequence[str] = INDEXED_FIELDS, stop_words: Sequence[str] = STOP_WORDS,
                 buckets: int = TERM_BUCKETS) -> DataFrame:
    """What `build_postings` gives with `lengths`, as blocks (term_bucket and BLOCKS). Nothing shuffles."""
    fields, stop_words = list(fields), list(stop_words)
    return _bucketed(_split(cases, fields).mapInArrow(lambda b: _folded(b, len(fields), stop_words), BLOCKS), buckets)


def named(blocks: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Blocks with the names of their fields, as `unfolded` needs them."""
    return blocks.withColumn("names", F.array(*map(F.lit, fields)))


def unfolded(postings: DataFrame) -> DataFrame:
    """A row for each posting (case_id, field, tf, positions and all that stands beside), whichever form is stored.

    Filters by bucket and term go on to the blocks.
    """
    if "ends" not in postings.columns:
        return postings
    begin = "coalesce(get(ends, i - 1), 0)"
    one = f"""inline(transform(ends, (end, i) -> struct(case_ids[i] AS case_id, get(names, fields[i]) AS field,
        end - {begin} AS tf, slice(positions, {begin} + 1, end - {begin}) AS positions)))"""
    folded_columns = ("case_ids", "fields", "ends", "positions", "names")
    return postings.select(*[c for c in postings.columns if c not in folded_columns], F.expr(one))


def case_lengths(postings: DataFrame) -> DataFrame:
    """(case_id, lens): indexed words of each field, from postings with lengths."""
    return unfolded(postings.where("term_bucket = -1")).select("case_id", F.col("positions").alias("lens"))


def write_postings(postings: DataFrame, path: str, mode: str = "overwrite") -> None:
    """By term bucket. Spark sizes the tasks by what they hold, so a common term is split."""
    order = ["term_bucket", "term", *(["case_id"] if "case_id" in postings.columns else [])]
    (
        postings.hint("rebalance", "term_bucket").sortWithinPartitions(*order)
        .write.mode(mode).partitionBy("term_bucket").parquet(path)
    )


def build_index(cases: DataFrame, path: str, fields: Sequence[str] = INDEXED_FIELDS,
                stop_words: Sequence[str] = STOP_WORDS, buckets: int = TERM_BUCKETS) -> KeywordIndex:
    """Write postings with the length rows, the vocabulary and the settings below `path`."""
    spark = cases.sparkSession
    write_postings(build_blocks(cases, fields, stop_words, buckets), f"{path}/postings")
    write_vocabulary(spark.read.parquet(f"{path}/postings"), path)
    settings = spark.createDataFrame([(buckets, list(fields))], "buckets int, fields array<string>")
    settings.coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")
    return read_index(spark, path, fields, stop_words)


def write_vocabulary(postings: DataFrame, path: str) -> None:
    postings.where("term_bucket >= 0").select("term_bucket", "term").distinct().write.mode("overwrite").parquet(f"{path}/vocabulary")


def read_index(spark: SparkSession, path: str, fields: Sequence[str] = INDEXED_FIELDS,
               stop_words: Sequence[str] = STOP_WORDS) -> KeywordIndex:
    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{path}/{name}")

    postings, settings = table("postings"), table("settings").first()
    if "ends" in postings.columns:
        postings = named(postings, settings["fields"])
    return KeywordIndex(tuple(fields), tuple(stop_words), postings=postings.where("term_bucket >= 0"),
                        lengths=case_lengths(postings), vocabulary=table("vocabulary"), buckets=settings["buckets"])


@dataclass(frozen=True)
class _Block:
    """Some questions, (id, tree over the numbers of leaves), and the leaves."""

    leaves: list[Leaf]
    questions: list[tuple[int, list]]

    def plain(self) -> tuple[np.ndarray, np.ndarray]:
        """(question, leaf) of the questions that are an OR of single leaves, which any of them meets."""
        pairs = sorted({(q, leaf) for q, (_, tree) in enumerate(self.questions) for leaf in flat(tree) or ()})
        found = np.array(pairs, np.int64).reshape(-1, 2)
        return found[:, 0], found[:, 1]

    @cached_property
    def asked(self) -> tuple[np.ndarray, np.ndarray]:
        return self.plain()

    @cached_property
    def single(self) -> tuple[np.ndarray, pa.Array]:
        """(leaf, its word) of the leaves that are one whole word."""
        found = [(k, leaf.word) for k, leaf in enumerate(self.leaves) if leaf.word is not None]
        return np.array([k for k, _ in found], np.int64), pa.array([word for _, word in found], pa.string())

    @cached_property
    def others(self) -> list[int]:
        """The leaves that are no whole word."""
        return [k for k, leaf in enumerate(self.leaves) if leaf.word is None]

    @cached_property
    def nested(self) -> list[int]:
        """The questions that are more than an OR of single leaves."""
        return [q for q, (_, tree) in enumerate(self.questions) if flat(tree) is None]

    @cached_property
    def nested_leaves(self) -> list[int]:
        return sorted({leaf for q in self.nested for leaf in named_leaves(self.questions[q][1])})


def _pack_questions(batches: Iterator[pa.RecordBatch], stop_words: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """(part, payload, names): blocks of questions, and the names of their leaves by number."""
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK_QUESTIONS):
            numbers: dict[str, int] = {}
            leaves, questions = [], []
            for row in batch.slice(lo, BLOCK_QUESTIONS).to_pylist():
                own = {}
                for i, raw in enumerate(row["leaves"]):
                    leaf = make_leaf([(t["ws"], t["is_prefix"]) for t in raw["terms"]], raw["reach"], stop_words)
                    if leaf is None:
                        continue
                    if leaf.name not in numbers:
                        numbers[leaf.name] = len(leaves)
                        leaves.append(leaf)
                    own[i] = numbers[leaf.name]
                if tree := pruned(json.loads(row["tree"]), own):
                    questions.append((row["query_id"], tree))
            if questions:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([0], pa.int32()), pa.array([pickle.dumps(_Block(leaves, questions))], pa.binary()),
                     pa.array([list(numbers)], pa.list_(pa.string()))], names=["part", "payload", "names"])


def question_blocks(requests: DataFrame, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """(block, part, payload, names) of (query_id, keyword_search), written so that Spark knows its size."""
    stop_words = tuple(stop_words)
    # small partitions are put together, or every one of them would make a block of its own
    packed = parsed(requests).hint("rebalance").mapInArrow(
        lambda b: _pack_questions(b, stop_words), "part int, payload binary, names array<string>")
    return written(packed.withColumn("block", F.monotonically_increasing_id()), "questions")


class _Counter:
    """Where the leaves of a block occur in a tile."""

    def __init__(self, tile: _Tile):
        self.tile = tile
        self.scored: tuple[tuple, _Postings] | None = None       # of the last statistics

    @cached_property
    def code(self) -> dict[str, int]:
        return {t: k for k, t in enumerate(self.tile.terms)}

    @cached_property
    def order(self) -> np.ndarray:
        return np.argsort(self.tile.codes, kind="stable")

    @cached_property
    def first(self) -> np.ndarray:
        return np.searchsorted(self.tile.codes[self.order], np.arange(len(self.tile.words) + 1))

    @cached_property
    def sorted(self) -> list[str]:
        return sorted(self.code)

    @cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(codes, rows, counts): each word of each case once."""
        n, at = len(self.tile.ids), np.flatnonzero(self.tile.codes >= 0)
        keys, counts = np.unique(self.tile.codes[at].astype(np.int64) * n + self.tile.segment[at] % n, return_counts=True)
        return keys // n, keys % n, counts

    def places(self, word: str, is_prefix: bool) -> np.ndarray:
        """Indexes of the words that equal `word`, or start with it."""
        if not is_prefix:
            k = self.code.get(word)
            return self.order[self.first[k]:self.first[k + 1]] if k is not None else self.order[:0]
        found = []
        for term in self.sorted[bisect_left(self.sorted, word):]:
            if not term.startswith(word):
                break
            k = self.code[term]
            found.append(self.order[self.first[k]:self.first[k + 1]])
        return np.sort(np.concatenate(found)) if found else self.order[:0]

    @cached_property
    def length(self) -> np.ndarray:
        """Indexed words of each case."""
        return self.tile.lens.sum(axis=1)

    @cached_property
    def first_pair(self) -> np.ndarray:
        """Where the pairs of each code begin; the code behind the last one has none."""
        first = np.searchsorted(self.pairs[0], np.arange(len(self.tile.words) + 1))
        return np.append(first, first[-1])

    def codes_of(self, words: pa.Array) -> np.ndarray:
        """The code of each word, that behind the last one for a word the tile does not hold."""
        found = pc.index_in(words, value_set=self.tile.words.cast(words.type))
        return pc.fill_null(found, len(self.tile.words)).to_numpy(zero_copy_only=False).astype(np.int64)

    def frequencies(self, block: _Block) -> np.ndarray:
        """How many cases hold each leaf of a block."""
        found = np.zeros(len(block.leaves), np.int64)
        numbers, words = block.single
        codes = self.codes_of(words)
        found[numbers] = self.first_pair[codes + 1] - self.first_pair[codes]
        for number in block.others:
            found[number] = len(self.count(block.leaves[number])[0])
        return found

    def count_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the word, row, count) of each case that holds one of the words."""
        codes = self.codes_of(words)
        first = self.first_pair[codes]
        sizes = self.first_pair[codes + 1] - first
        at = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        return np.repeat(np.arange(len(codes)), sizes), self.pairs[1][at], self.pairs[2][at]

    def starts(self, term) -> np.ndarray:
        """Where a term starts: its words stand at their offsets in one field."""
        at = self.places(term.words[0][1], term.is_prefix)
        for offset, other in term.words[1:]:
            if not len(at):
                break
            moved = at + (offset - term.base)
            inside = moved < len(self.tile.codes)
            at, moved = at[inside], moved[inside]
            at = at[(self.tile.segment[moved] == self.tile.segment[at]) & np.isin(moved, self.places(other, term.is_prefix))]
        return at

    def count(self, leaf: Leaf) -> tuple[np.ndarray, np.ndarray]:
        """(rows, counts): the cases that hold a leaf."""
        found = [self.starts(term) for term in leaf.terms]
        at = found[0] if leaf.reach is None else near_places(
            found, [term.width for term in leaf.terms], leaf.window, self.tile.segment)
        return np.unique(self.tile.segment[at] % len(self.tile.ids), return_counts=True)


COUNTS = "block long, n long, len long, leaf array<int>, df array<long>"


def _counted(counter: _Counter, block: _Block, numbers: Sequence[int] | None = None) -> _Found:
    """(case ids, lengths, and leaf, row and count of each leaf in each case that holds it), of all leaves or some."""
    single, words = block.single
    others = block.others
    if numbers is not None:
        mine = np.isin(single, numbers)
        single, words, others = single[mine], words.filter(pa.array(mine)), [k for k in others if k in set(numbers)]
    which, rows, counts = counter.count_words(words)
    counted = [(single[which], rows, counts)]
    for number in others:
        rows, counts = counter.count(block.leaves[number])
        counted.append((np.full(len(rows), number), rows, counts))
    leaf, case, tf = (np.concatenate(x).astype(np.int32) for x in zip(*counted, strict=True))
    return counter.tile.ids, counter.length, leaf, case, tf


class _Blocks:
    """Blocks of questions as read from their payloads, the last `HELD_BLOCKS` of them."""

    def __init__(self) -> None:
        self.held: dict[int, _Block] = {}

    def __call__(self, number: int, payload: pa.Scalar) -> _Block:
        if number not in self.held:
            if len(self.held) >= HELD_BLOCKS:
                del self.held[next(iter(self.held))]
            self.held[number] = pickle.loads(payload.as_py())
        return self.held[number]


def _met_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, _Block, _Counter, pa.RecordBatch]]:
    """(block number, block, counter of the tile, row) of rows that begin with tile, block and questions."""
    last: tuple[bytes, _Counter] | None = None
    blocks = _Blocks()
    for batch in batches:
        for row in range(batch.num_rows):
            data = batch.column(0)[row].as_py()
            if last is None or last[0] != data:
                last = data, _Counter(pickle.loads(data))
            number = batch.column(1)[row].as_py()
            yield number, blocks(number, batch.column(2)[row]), last[1], batch.slice(row, 1)


def _count_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the tiles of a task add to the statistics, a row for each block."""
    sums: dict[int, list] = {}
    for number, block, counter, _ in _met_tiles(batches):
        one = sums.setdefault(number, [0, 0, np.zeros(len(block.leaves), np.int64)])
        one[0] += len(counter.length)
        one[1] += int(counter.length.sum())
        one[2] += counter.frequencies(block)
    for number, (n, length, df) in sums.items():
        some = np.flatnonzero(df)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([c], k) for c, k in zip((number, n, length, some.tolist(), df[some].tolist()), kinds, strict=True)],
            names=["block", "n", "len", "leaf", "df"])


def _scan_hits(index: KeywordIndex, blocks: DataFrame, fields: Sequence[str], limit: int | None, k1: float, b: float) -> DataFrame:
    """The hits of all questions in the case table: one pass for the statistics, one for the scores."""
    stop_words, n, size = list(index.stop_words), len(fields), SCAN_TILES * TILE_WORDS

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in _tiles(batches, n, stop_words, size):
            yield _payloads("tile", [pickle.dumps(tile)])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _best_hits(((number, block, counter if limit is not None else _counted(counter, block),
                            *row.select(["n", "len", "leaf", "df"]).to_pylist()[0].values())
                           for number, block, counter, row in _met_tiles(batches)), limit, k1, b)

    split = written(_split(index.cases, fields), "words")
    tiles = split.mapInArrow(pack, "part int, tile binary").select("part", "tile", share_of("tile"))
    asked = blocks.select("part", "block", F.col("payload").alias("questions"))
    pairs = tiles.join(for_shares(asked), ["part", "share"])
    counts = written(pairs.select("tile", "block", "questions").mapInArrow(_count_tiles, COUNTS), "counts")
    seen = counts.select("block", F.inline(F.arrays_zip("leaf", "df")))
    sums = counts.groupBy("block").agg(F.sum("n").alias("n"), F.sum("len").alias("len"))
    statistics = _statistics(seen.groupBy("block", "leaf").agg(F.sum("df").alias("df")), sums)
    known = written(asked.join(statistics, "block"), "statistics")
    groups = _groups(known.count(), limit)
    if groups == 1:
        pairs = tiles.join(for_shares(known), ["part", "share"])
    else:
        # blocks of a writing task are numbered one after the other, so groups are about equal
        number = F.col("block").bitwiseAND((1 << 33) - 1) + F.shiftright("block", 33)
        known = known.withColumn("held", F.pmod(number, F.lit(groups)).cast("int"))
        tiles = tiles.withColumn("held", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        pairs = tiles.join(for_shares(known).hint("merge"), ["part", "share", "held"])
    return pairs.select("tile", "block", "questions", "n", "len", "leaf", "df").mapInArrow(score, HITS)


def _groups(blocks: int, limit: int | None) -> int:
    """Groups of blocks of which a task holds the best hits of one."""
    room = max(1, HELD_HITS // limit // BLOCK_QUESTIONS) if limit is not None else blocks
    return max(1, -(-blocks // max(1, room)))


def _statistics(freqs: DataFrame, sums: DataFrame) -> DataFrame:
    """(block, n, len, leaf, df) from (block, leaf, df) and (block, n, len): one row per block."""
    lists = freqs.groupBy("block").agg(F.collect_list(F.struct("leaf", "df")).alias("dfs"))
    joined = sums.join(lists, "block", "left")
    return joined.select("block", "n", "len", F.col("dfs.leaf").alias("leaf"), F.col("dfs.df").alias("df"))


HITS = "query_id long, case_id long, keyword_score double"


class _Top:
    """The best hits so far of each question of a block, all of them without a `limit`."""

    def __init__(self, block: _Block, limit: int | None):
        self.ids, self.limit = pa.array([q for q, _ in block.questions], pa.int64()), limit
        self.plain = block.asked
        self.bar = np.zeros(len(self.ids))               # the score of the last of `limit` hits
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        self.waiting = 0

    def add(self, question: np.ndarray, cases: np.ndarray, score: np.ndarray) -> None:
        score = np.round(score, 8)
        kept = score >= self.bar[question]
        self.found.append((question[kept], cases[kept].astype(np.int64), score[kept]))
        self.waiting += int(kept.sum())
        if self.limit is not None and self.waiting > max(len(self.found[0][0]), WAITING_HITS):
            self.trim()

    def trim(self) -> None:
        question, cases, score = (np.concatenate(x) for x in zip(*self.found, strict=True))
        if self.limit is not None:
            order = _ranked_order(question, score, cases)
            question, cases, score = question[order], cases[order], score[order]
            first = np.searchsorted(question, np.arange(len(self.ids)))
            place = np.arange(len(question)) - first[question]
            last = place == self.limit - 1
            self.bar[question[last]] = score[last]
            question, cases, score = (x[place < self.limit] for x in (question, cases, score))
        self.found, self.waiting = [(question, cases, score)], 0

    def rows(self) -> pa.RecordBatch:
        self.trim()
        question, cases, score = self.found[0]
        self.found = [tuple(x[:0] for x in self.found[0])]
        return pa.RecordBatch.from_arrays([self.ids.take(pa.array(question)), pa.array(cases), pa.array(score)],
                                          names=["query_id", "case_id", "keyword_score"])


def _ranked_order(question: np.ndarray, score: np.ndarray, cases: np.ndarray) -> np.ndarray:
    """The order by question, score from the highest down, and case. Scores have eight places."""
    width = score.max(initial=0.0) + 1.0
    if width * (question.max(initial=0) + 1) > 1e6:             # one number would not tell such scores apart
        return np.lexsort((cases, -score, question))
    key = question * width - score
    order = np.argsort(key)
    key = key[order]
    same = np.r_[False, key[1:] == key[:-1]]
    tied = np.flatnonzero(same | np.r_[same[1:], False])
    order[tied] = order[tied][np.lexsort((cases[order[tied]], key[tied]))]
    return order


_Found = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _best_hits(rows: Iterator[tuple[int, _Block, _Found | _Counter, int, int, list[int] | None, list[int] | None]],
               limit: int | None, k1: float, b: float) -> Iterator[pa.RecordBatch]:
    """Hits of cases (block number, block, cases, and n, len, leaf, df of the corpus), of each question the best.

    Cases are counted, or come as a counter of their words, which needs a `limit`.
    """
    tops: dict[int, _Top] = {}
    for number, block, found, n, length, leaf, df in rows:
        if number not in tops:
            room = HELD_HITS // limit if limit is not None else 0
            while tops and sum(len(t.ids) for t in tops.values()) + len(block.questions) > room:
                yield tops.pop(next(iter(tops))).rows()
            tops[number] = _Top(block, limit)
        freq = np.ones(len(block.leaves))
        freq[leaf or []] = df or []
        average = length / n if n else 1.0
        if isinstance(found, _Counter):
            _best_plain(tops[number], block, found, freq, n, average, k1, b)
            if block.nested:
                _score(tops[number], block, _counted(found, block, block.nested_leaves), freq, n, average, k1, b, plain=False)
        else:
            _score(tops[number], block, found, freq, n, average, k1, b)
        if limit is None:
            yield tops[number].rows()
    for top in tops.values():
        yield top.rows()


def _score(top: _Top, block: _Block, found: _Found, freq: np.ndarray, n: int, average: float, k1: float, b: float,
           plain: bool = True) -> None:
    """Score counted cases for all questions of a block, or without the `plain` ones."""
    ids, dl, leaf, case, tf = found
    order = np.argsort(leaf, kind="stable")
    leaf, case, tf = leaf[order], case[order], tf[order]
    df = freq[leaf]
    idf = np.log(1.0 + (n - df + 0.5) / (df + 0.5))
    score = idf * tf * (k1 + 1.0) / (tf + k1 * ((1.0 - b) + b * dl[case] / average))
    first = np.searchsorted(leaf, np.arange(len(block.leaves) + 1))
    if plain:
        _score_plain(top, first, case, score, ids)
    by_leaf = {k: (case[first[k]:first[k + 1]], score[first[k]:first[k + 1]]) for k in np.unique(leaf).tolist()}
    for question in block.nested:
        tree = block.questions[question][1]
        counted = sorted(k for k in counting(tree) if k in by_leaf)
        if not counted:
            continue
        rows, where = np.unique(np.concatenate([by_leaf[k][0] for k in counted]), return_inverse=True)
        sums = np.bincount(where, np.concatenate([by_leaf[k][1] for k in counted]))
        none = np.zeros(len(rows), bool)
        meets = met(tree, lambda k, rows=rows, none=none: np.isin(rows, by_leaf[k][0]) if k in by_leaf else none, none)
        top.add(np.full(meets.sum(), question), ids[rows[meets]], sums[meets])


def _score_plain(top: _Top, first: np.ndarray, case: np.ndarray, score: np.ndarray, ids: np.ndarray, cells: int = 1 << 21) -> None:
    """Hits of the plain questions, some at a time, as a table of questions by cases."""
    question, leaf = top.plain
    n, step = len(ids), max(1, cells // max(1, len(ids)))
    for lo in range(0, len(top.ids), step):
        mine = slice(*np.searchsorted(question, [lo, lo + step]))
        sizes = first[leaf[mine] + 1] - first[leaf[mine]]
        at = np.repeat(first[leaf[mine]] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        if not len(at):
            continue
        rows = min(step, len(top.ids) - lo)
        table = np.bincount(np.repeat(question[mine] - lo, sizes) * n + case[at], score[at], rows * n).reshape(rows, n)
        # a case scored as low as the last hit may still tie with it
        q, c = np.nonzero((table > 0) & (table >= top.bar[lo:lo + rows, None] - 1e-8))
        top.add(lo + q, ids[c], table[q, c])


class _Postings:
    """The postings of a tile by code and row, and those of each code from the highest part of a score down.

    The part is what a score is without the weight of its leaf, below k1 + 1.
    """

    def __init__(self, code: np.ndarray, row: np.ndarray, tf: np.ndarray, first: np.ndarray, length: np.ndarray, average: float,
                 k1: float, b: float):
        self.row, self.tf, self.first, self.cases, self.width = row, tf, first, len(length), k1 + 2.0
        self.key = code.astype(np.int64) * self.cases + row
        self.part = tf * (k1 + 1.0) / (tf + k1 * ((1.0 - b) + b * length[row] / average))
        self.order = np.lexsort((-self.part, code))
        self.down = self.part[self.order]
        self.steps = code * self.width - self.down              # rises with the code, and as the part falls

    def nth(self, code: np.ndarray, n: int) -> np.ndarray:
        """The n-th highest part of each code, 0 where it has fewer postings."""
        at = self.first[code] + n - 1
        return np.where(at < self.first[code + 1], self.down[np.minimum(at, len(self.down) - 1)], 0.0)

    def reaching(self, code: np.ndarray, least: np.ndarray) -> np.ndarray:
        """How many postings of each code have at least so high a part, or one lower by rounding."""
        upto = np.searchsorted(self.steps, code * self.width - np.clip(least - 1e-8, 0.0, self.width - 0.5), side="right")
        return np.clip(upto, self.first[code], self.first[code + 1]) - self.first[code]

    def find(self, code: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether there is a posting of code and row, where)."""
        key = code * self.cases + row
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return self.key[at] == key, at


def _postings_of(counter: _Counter, block: _Block, average: float, k1: float, b: float) -> tuple[_Postings, np.ndarray]:
    """The postings of a tile, and the code of each leaf of a block; leaves that are no whole word get codes of their own."""
    numbers, words = block.single
    code_of = np.full(len(block.leaves), len(counter.tile.words), np.int64)
    code_of[numbers] = counter.codes_of(words)
    if counter.scored is None or counter.scored[0] != (average, k1, b):
        counter.scored = (average, k1, b), _Postings(*counter.pairs, counter.first_pair, counter.length, average, k1, b)
    plain = set(block.asked[1].tolist())
    more = [(number, *counter.count(block.leaves[number])) for number in block.others if number in plain]
    more = [one for one in more if len(one[1])]
    if not more:
        return counter.scored[1], code_of
    code, row, tf = counter.pairs
    new = len(counter.tile.words) + 1 + np.arange(len(more))
    sizes = [len(rows) for _, rows, _ in more]
    code_of[[number for number, _, _ in more]] = new
    first = np.concatenate([counter.first_pair, counter.first_pair[-1] + np.cumsum(sizes)])
    return _Postings(np.concatenate([code, np.repeat(new, sizes)]), np.concatenate([row, *(rows for _, rows, _ in more)]),
                     np.concatenate([tf, *(counts for _, _, counts in more)]), first, counter.length, average, k1, b), code_of


def _best_plain(top: _Top, block: _Block, counter: _Counter, freq: np.ndarray, n: int, average: float, k1: float, b: float) -> None:
    """The hits of a tile for the questions that are an OR of single leaves, without those too low for the best.

    The leaves of a case that reaches the bar make up for what the others can add at most: either it is
    among the postings of one leaf whose score reaches the bar less the highest scores of the others, or
    the score of some leaf reaches its portion of the bar. Whichever gives fewer cases is scored in full,
    and all cases where both give many.
    """
    question, leaf = top.plain
    postings, code_of = _postings_of(counter, block, average, k1, b)
    code = code_of[leaf]
    held = postings.first[code + 1] > postings.first[code]
    question, leaf, code = question[held], leaf[held], code[held]
    if not len(question):
        return
    weight = np.log(1.0 + (n - freq + 0.5) / (freq + 0.5))[leaf]
    start, own = _runs(question)
    most = weight * postings.nth(code, 1)
    total = np.add.reduceat(most, start)
    # as many cases of this tile as there are best hits reach this for sure
    sure = np.maximum.reduceat(weight * postings.nth(code, top.limit), start)
    bar = np.maximum(top.bar[question[start]], sure) - 2e-8
    alive = (total >= bar)[own]
    if not alive.any():
        return
    bar, total = bar[own][alive], total[own][alive]
    question, leaf, code, weight, most = (x[alive] for x in (question, leaf, code, weight, most))
    start, own = _runs(question)
    least = bar - (total - most)
    alone = np.where(least > 0, postings.reaching(code, least / weight), np.iinfo(np.int64).max)
    shared = postings.reaching(code, np.maximum(bar, 0.0) * (most / total) / weight)
    fewest, some = np.minimum.reduceat(alone, start), np.add.reduceat(shared, start)
    one = np.flatnonzero(alone == fewest[own])
    chosen = np.zeros(len(question), bool)
    chosen[one[np.r_[True, own[one][1:] != own[one][:-1]]]] = True
    count = np.where((some < fewest)[own], shared, np.where(chosen, alone, 0))
    sizes = np.diff(np.append(start, len(question)))
    found = np.add.reduceat(count, start)

    def settle(asking: np.ndarray, case: np.ndarray) -> None:
        """Score questions in cases, some at a time, by all leaves of a question."""
        ends, lo = np.cumsum(sizes[asking]), 0
        while lo < len(asking):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CANDIDATE_PAIRS, side="right")))
            ask, row = asking[lo:hi], case[lo:hi]
            which = np.repeat(np.arange(len(ask)), sizes[ask])
            leaves = np.repeat(start[ask] - (np.cumsum(sizes[ask]) - sizes[ask]), sizes[ask]) + np.arange(len(which))
            there, posting = postings.find(code[leaves], row[which])
            which, leaves, posting = which[there], leaves[there], posting[there]
            tf = postings.tf[posting]
            score = weight[leaves] * tf * (k1 + 1.0) / (tf + k1 * ((1.0 - b) + b * counter.length[postings.row[posting]] / average))
            sums = np.bincount(which, score, len(ask))
            good = sums >= bar[start[ask]]
            top.add(question[start[ask[good]]], counter.tile.ids[row[good]], sums[good])
            lo = hi

    few = (sizes == 1) | (found * sizes * DENSE_FROM < postings.cases)
    ends, lo = np.cumsum(np.where(few, found, 0)), 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CANDIDATE_PAIRS, side="right")))
        mine = slice(start[lo], start[hi] if hi < len(start) else None)
        some = np.where(few[own[mine]], count[mine], 0)
        at = np.repeat(postings.first[code[mine]] - (np.cumsum(some) - some), some) + np.arange(some.sum())
        pair = np.sort(np.repeat(own[mine], some) * postings.cases + postings.row[postings.order[at]])
        pair = pair[_runs(pair)[0]]
        settle(pair // postings.cases, pair % postings.cases)
        lo = hi
    many = np.flatnonzero(~few)
    many = many[np.argsort(-sizes[many], kind="stable")]
    if len(many):
        enough = bar[start] - 1.2e-7 * (sizes + 2) * total[start]
        for asking, case in _dense(postings, code, weight, start[many], sizes[many], enough[many]):
            settle(many[asking], case)


def _dense(postings: _Postings, code: np.ndarray, weight: np.ndarray, start: np.ndarray, sizes: np.ndarray, enough: np.ndarray
           ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(question, case) of the questions, those of most leaves first, in all cases where their sums in floats are high enough.

    The leaves of a question stand from its `start`. Sums come from a table of leaves by cases, some cases at a time.
    """
    used = np.unique(code[np.repeat(start - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())])
    line = np.zeros(len(postings.first), np.int64)
    line[used] = np.arange(len(used))
    weight_of = np.zeros(len(postings.first))
    weight_of[code] = weight
    size = postings.first[used + 1] - postings.first[used]
    at = np.repeat(postings.first[used] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    lines, rows = np.repeat(np.arange(len(used)), size), postings.row[at]
    scores = (np.repeat(weight_of[used], size) * postings.part[at]).astype(np.float32)
    least = np.maximum(enough, 1e-30).astype(np.float32)
    width = max(1, min(postings.cases, TABLE_CELLS // len(used)))
    for left in range(0, postings.cases, width):
        n = min(width, postings.cases - left)
        inside = slice(None) if n == postings.cases else (rows >= left) & (rows < left + n)
        table = np.zeros((len(used), n), np.float32)
        table[lines[inside], rows[inside] - left] = scores[inside]
        step = max(1, SUM_CELLS // n)
        for lo in range(0, len(start), step):
            first, more = start[lo:lo + step], sizes[lo:lo + step]
            sums = table[line[code[first]]]
            for k in range(1, more[0]):
                upto = np.searchsorted(-more, -k, side="left")          # questions of more than k leaves
                sums[:upto] += table[line[code[first[:upto] + k]]]
            hit = np.flatnonzero(sums >= least[lo:lo + step, None])
            if len(hit):
                yield lo + hit // n, left + hit % n


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each run of equal values starts, the number of the run of each value)."""
    new = np.ones(len(sorted_values), bool)
    new[1:] = sorted_values[1:] != sorted_values[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def _score_matches(batches: Iterator[pa.RecordBatch], limit: int | None, k1: float, b: float) -> Iterator[pa.RecordBatch]:
    """Hits of counted cases of a stored index."""
    def rows() -> Iterator[tuple]:
        blocks = _Blocks()
        for batch in batches:
            number, questions, payload, *rest = batch.columns
            for i in range(batch.num_rows):
                yield (number[i].as_py(), blocks(number[i].as_py(), questions[i]), pickle.loads(payload[i].as_py()),
                       *(column[i].as_py() for column in rest))

    return _best_hits(rows(), limit, k1, b)


def _spelled_out(index: KeywordIndex, terms: DataFrame) -> DataFrame:
    """`terms` with term_bucket; prefixes become the words of the vocabulary they begin."""
    vocabulary = index.vocabulary if index.vocabulary is not None else index.postings.select("term_bucket", "term").distinct()

    def head(n: int) -> Column:
        return F.substring("term", 1, n)

    columns = ["leaf", "sub", "idx", "n_terms", "window", "widths", "term_bucket", "term"]
    keyed = vocabulary.withColumn("key", F.explode(F.array(*[head(n) for n in (1, 2, 3)])))
    asked = terms.where("is_prefix").withColumn("key", F.substring("term", 1, 3)).withColumnRenamed("term", "asked")
    begun = keyed.join(asked, "key").where(F.col("term").startswith(F.col("asked"))).select(*columns).distinct()
    plain = terms.where(~F.col("is_prefix")).withColumn("term_bucket", term_bucket(F.col("term"), index.buckets))
    return begun.unionByName(plain.select(*columns))


def _matched(index: KeywordIndex, terms: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Current postings of the asked words in some fields, with what their leaves ask for."""
    # The comparison marks this side as selective, which lets Spark prune the term buckets.
    matched = unfolded(index.postings.join(terms.where("n_terms > 0"), ["term_bucket", "term"]))
    if set(fields) != set(index.fields):
        matched = matched.where(F.col("field").isin(*fields))
    if index.versions is not None:
        # only the versions of matched cases are looked at
        ids = matched.select("case_id").distinct()
        current = index.versions.join(ids, "case_id", "left_semi").groupBy("case_id").agg(
            F.max(F.struct("version", "batch_id", "deleted")).alias("v"))
        current = current.where("NOT v.deleted").select("case_id", "v.batch_id")
        matched = matched.join(current, ["case_id", "batch_id"], "left_semi")
    return matched


def leaf_hits(index: KeywordIndex, requests: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(leaf, case_id, tf, dl): occurrences of each leaf of the requests in each case of a stored index.

    The asked words are written first: Spark broadcasts them while they are few, prunes the
    term buckets by them, and otherwise splits the common words of the join by size. A phrase
    occurs where all its words sit at their offsets of one start position; a NEAR where the
    starts of its terms, gathered for each case and field, lie within its window.
    """
    terms = written(_spelled_out(index, leaf_terms(requests, index.stop_words)), "terms")
    matched = _matched(index, terms.where("window IS NULL"), fields)
    single = F.col("n_terms") == 1
    start = F.explode(F.when(single, F.array(F.lit(None).cast("int"))).otherwise(
        F.transform("positions", lambda p: p - F.col("idx"))))
    rows = matched.select("leaf", "case_id", "field", "n_terms", "tf", start.alias("start")).repartition("leaf", "case_id")
    at_start = rows.groupBy("leaf", "case_id", "field", "start").agg(
        F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("n"), F.max("n_terms").alias("n_terms"))
    full = F.when(F.col("n_terms") == 1, F.col("tf")).when(F.col("n") >= F.col("n_terms"), 1).otherwise(0)
    hits = at_start.groupBy("leaf", "case_id").agg(F.sum(full).alias("tf")).where("tf > 0")
    near = terms.where("window IS NOT NULL")
    if not near.isEmpty():
        hits = hits.unionByName(_near_hits(_matched(index, near, fields)))
    return hits.join(_case_size(index, fields), "case_id")


def _count_near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often a NEAR occurs in rows (leaf, case_id, window, widths, sub, start); places never become Python objects."""
    for batch in batches:
        sub, start = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in (4, 5))
        ends = np.cumsum(np.r_[0, pc.list_value_length(batch.column(4)).to_numpy(zero_copy_only=False)])
        counts = np.zeros(batch.num_rows, np.int64)
        for row in range(batch.num_rows):
            mine, at = sub[ends[row]:ends[row + 1]], start[ends[row]:ends[row + 1]].astype(np.int64)
            window, widths = batch.column(2)[row].as_py(), batch.column(3)[row].as_py()
            counts[row] = len(near_places([at[mine == k] for k in range(len(widths))], widths, window))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts)], names=["leaf", "case_id", "tf"])


def _near_hits(matched: DataFrame) -> DataFrame:
    """(leaf, case_id, tf) of NEAR leaves."""
    by_case = ["leaf", "case_id", "field"]
    start = F.explode(F.transform("positions", lambda p: p - F.col("idx"))).alias("start")
    rows = matched.select(*by_case, "sub", "n_terms", "window", "widths", start).repartition("leaf", "case_id")
    whole = rows.groupBy(*by_case, "sub", "start", "window", "widths").agg(
        F.count(F.lit(1)).alias("n"), F.max("n_terms").alias("n_terms")).where("n >= n_terms")
    gathered = whole.groupBy(*by_case, "window", "widths").agg(F.sort_array(F.collect_list(F.struct("sub", "start"))).alias("p"))

    counted = gathered.select("leaf", "case_id", "window", "widths", F.col("p.sub").alias("sub"), F.col("p.start").alias("start"))
    per_field = counted.mapInArrow(_count_near, "leaf string, case_id long, tf long")
    return per_field.groupBy("leaf", "case_id").agg(F.sum("tf").alias("tf")).where("tf > 0")


def _case_size(index: KeywordIndex, fields: Sequence[str]) -> DataFrame:
    """(case_id, dl) of the current cases."""
    dl = reduce(lambda a, b: a + b, [F.get("lens", F.lit(index.fields.index(f))) for f in fields])
    return index.lengths.select("case_id", dl.alias("dl"))


def _pack_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, case_id, dl, leaf, tf), sorted by block and case, as payloads of whole cases."""
    def pack(rows: list[np.ndarray]) -> pa.RecordBatch:
        block, case, dl, leaf, tf = rows
        ids, first, where = np.unique(case, return_index=True, return_inverse=True)
        found = (ids, dl[first], leaf.astype(np.int32), where.astype(np.int32), tf.astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(block[:1]), pa.array([pickle.dumps(found)], pa.binary())],
                                          names=["block", "payload"])

    held: list[np.ndarray] | None = None
    for batch in batches:
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        while len(rows[0]):
            more = np.flatnonzero(rows[0] != rows[0][0])
            end = int(more[0]) if len(more) else 0        # 0: the block may go on in the next batch
            if not end and len(rows[0]) > PACK_HITS and rows[1][0] != rows[1][-1]:
                end = int(np.argmax(rows[1] == rows[1][-1]))
            if not end:
                break
            yield pack([x[:end] for x in rows])
            rows = [x[end:] for x in rows]
        held = rows
    if held is not None and len(held[0]):
        yield pack(held)


def _index_matches(index: KeywordIndex, blocks: DataFrame, requests: DataFrame, fields: Sequence[str]
                   ) -> tuple[DataFrame, DataFrame]:
    """Counted cases of a stored index, and the statistics of each block."""
    hits = written(leaf_hits(index, requests, fields), "hits")
    numbers = blocks.select("block", F.posexplode("names").alias("leaf_no", "leaf"))
    rows = hits.join(numbers, "leaf").select(
        "block", "case_id", F.col("dl").cast("long").alias("dl"), F.col("leaf_no").alias("leaf"), "tf")
    packed = rows.repartition("case_id").sortWithinPartitions("block", "case_id").mapInArrow(
        _pack_hits, "block long, payload binary")
    freqs = hits.groupBy("leaf").agg(F.count(F.lit(1)).alias("df")).join(numbers, "leaf").select(
        "block", F.col("leaf_no").alias("leaf"), "df")
    total = _case_size(index, fields).agg(F.struct(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).cast("long").alias("len")).alias("t")).scalar()
    return packed, _statistics(freqs, blocks.select("block", total["n"].alias("n"), total["len"].alias("len")))


def keyword_search_batch(index: KeywordIndex, requests: DataFrame, fields: Sequence[str] | None = None,
                         limit: int | None = None, k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """(query_id, case_id, keyword_score) for the cases meeting each request's condition.

    The score is the BM25 sum over the matched, non-negated leaves, rounded to eight places
    before anything ranks by it. `requests` needs query_id and keyword_search. With a `limit`
    a task gives the best so many cases of a question among those it has met.
    """
    fields = tuple(fields or index.fields)
    requests = requests.select(F.col("query_id").cast("long").alias("query_id"), "keyword_search")
    blocks = question_blocks(requests, index.stop_words)
    if index.cases is not None:
        return _scan_hits(index, blocks, fields, limit, k1, b)
    matches, statistics = _index_matches(index, blocks, requests, fields)
    asked = blocks.select("block", F.col("payload").alias("questions")).join(written(statistics, "statistics"), "block")
    rows = matches.join(asked, "block").select("block", "questions", "payload", "n", "len", "leaf", "df")
    return rows.mapInArrow(lambda batches: _score_matches(batches, limit, k1, b), HITS)


def _near_counter(leaf: Leaf, stop_words: Sequence[str]) -> Callable[..., Column]:
    """A column function: how often a NEAR occurs in the arrays of words of a row's fields."""
    def count(*columns: pa.Array) -> pa.Array:
        n = len(columns[0])
        tile = _Tile(np.arange(n), list(columns), stop_words)
        out = np.zeros(n, np.int64)
        rows, counts = _Counter(tile).count(leaf)
        out[rows] = counts
        return pa.array(out)

    return F.arrow_udf(count, "long")


def leaf_counts(leaves: Sequence[Leaf], folded_texts: Sequence[Column], word_arrays: Sequence[Column],
                stop_words: Sequence[str]) -> list[Column]:
    """How often each leaf occurs in the fields of a row, all taken together."""
    def one(leaf: Leaf) -> Column:
        if leaf.reach is not None:
            return _near_counter(leaf, stop_words)(*word_arrays)
        return reduce(lambda a, b: a + b, [leaf_count(leaf, f, stop_words).cast("long") for f in folded_texts])

    return [one(leaf) for leaf in leaves]


def keyword_scan(cases: DataFrame, fields: Sequence[str], condition: str, limit: int | None = None,
                 stop_words: Sequence[str] = STOP_WORDS, k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """(case_id, keyword_score) for one condition over the case text, without an index.

    Leaf counts are taken inside each row, so no text is shuffled. One exchange feeds both
    the corpus statistics and the scores: the cases with a count go through it as narrow
    rows, all others as one sum per task. The text is scanned and broken into words once.
    """
    tree, leaves = parse_condition(cases.sparkSession, condition, stop_words)
    if not leaves:
        return cases.select("case_id", F.lit(0.0).alias("keyword_score")).limit(0)
    scored = sorted(counting(tree))
    texts = cases.select("case_id", *[folded(F.coalesce(F.col(f), F.lit(""))).alias(f"f{i}") for i, f in enumerate(fields)])
    broken = texts.select("*", *[F.array_remove(F.split(f"f{i}", WORD_BREAK), "").alias(f"ws{i}") for i in range(len(fields))])
    tfs = leaf_counts(leaves, [F.col(f"f{i}") for i in range(len(fields))], [F.col(f"ws{i}") for i in range(len(fields))], stop_words)
    counts = broken.select(
        "case_id",
        reduce(lambda x, y: x + y, [F.size(kept_words(f"ws{i}", stop_words)) for i in range(len(fields))]).alias("dl"),
        *[c.alias(f"tf{i}") for i, c in enumerate(tfs)],
    )
    tf = [F.col(f"tf{i}") for i in range(len(leaves))]
    counted = reduce(lambda x, y: x | y, [c > 0 for c in tf])
    grouped = counts.groupBy(F.when(counted, F.col("case_id")).alias("case_id")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("dl").alias("dl"), *[F.max(c).alias(f"tf{i}") for i, c in enumerate(tf)])
    stats = grouped.agg(F.struct(
        F.sum("n").cast("double").alias("n"), F.sum("dl").cast("double").alias("len"),
        *[F.count_if(c > 0).alias(f"df{i}") for i, c in enumerate(tf)],
    ).alias("s")).scalar()
    s = F.col("s")
    avg_dl = F.try_divide(s["len"], s["n"])
    parts = [F.when(tf[i] > 0, bm25(tf[i], F.col("dl"), s[f"df{i}"], s["n"], avg_dl, k1, b)).otherwise(0.0) for i in scored]
    score = F.round(reduce(lambda x, y: x + y, parts, F.lit(0.0)), 8)
    # `n` is asked for on this side too, or it would be pruned here and the two sides could not
    # share one exchange. A hit is emitted as an array of one row. A where() would be pushed below the counts
    # and break every text into words twice.
    hit = F.when(F.col("case_id").isNotNull() & (F.col("n") > 0) & met(tree, lambda i: tf[i] > 0, F.lit(False)), F.array(F.struct(score.alias("keyword_score")))
                 ).otherwise(F.array().cast("array<struct<keyword_score:double>>"))
    hits = grouped.withColumn("s", stats).select("case_id", F.inline(hit))
    if limit is None:
        return hits
    return hits.orderBy(F.desc("keyword_score"), "case_id").limit(limit)


def _buckets(spark: SparkSession, asked: Sequence[str], buckets: int) -> list[int]:
    """The term buckets of some words, by the expression that wrote them."""
    found = spark.sql("SELECT 1").select(F.transform(F.array(*map(F.lit, asked)), lambda w: term_bucket(w, buckets)))
    return sorted(set(found.first()[0]))


def _narrowed(index: KeywordIndex, leaves: Sequence[Leaf]) -> KeywordIndex:
    """The index behind literal filters: the buckets and words of the leaves, the heads of prefixes."""
    asked = {(w, term.is_prefix) for leaf in leaves for term in leaf.terms for _, w in term.words}
    exact = sorted(w for w, is_prefix in asked if not is_prefix)
    heads = [F.col("term").startswith(w) for w, is_prefix in sorted(asked) if is_prefix]
    postings = index.postings
    if heads:
        wanted = reduce(lambda a, b: a | b, heads)
        vocabulary = index.vocabulary.where(wanted) if index.vocabulary is not None else None
        return replace(index, postings=postings.where(F.col("term").isin(*exact) | wanted), vocabulary=vocabulary)
    if not exact:
        return index
    at = F.col("term_bucket").isin(*_buckets(postings.sparkSession, exact, index.buckets))
    return replace(index, postings=postings.where(at & F.col("term").isin(*exact)))


def keyword_search(index: KeywordIndex, condition: str, limit: int | None = None,
                   fields: Sequence[str] | None = None) -> DataFrame:
    """(case_id, keyword_score) for one condition over a stored index.

    The words are known here, so their term buckets are literal partition filters.
    """
    spark = (index.cases if index.postings is None else index.postings).sparkSession
    _, leaves = parse_condition(spark, condition, index.stop_words)
    if index.postings is not None:
        index = _narrowed(index, leaves)
    # one partition, or every core would start Python processes for it
    request = spark.createDataFrame([(0, condition)], "query_id long, keyword_search string").coalesce(1)
    hits = keyword_search_batch(index, request, fields, limit).drop("query_id")
    if limit is None:
        return hits
    return hits.orderBy(F.desc("keyword_score"), "case_id").limit(limit)


def keyword_topk(index: KeywordIndex, requests: DataFrame, k: int = CANDIDATES,
                 fields: Sequence[str] | None = None) -> DataFrame:
    """The best `k` cases of each request with their rank."""
    hits = keyword_search_batch(index, requests, fields, k)
    return topk_per_group(hits, ["query_id"], [F.desc("keyword_score"), F.asc("case_id")], k, "keyword_rank")


def contains_filter(cases: DataFrame, fields: Sequence[str], condition: str,
                    stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """Cases whose `fields` meet a search condition: a row filter, nothing shuffles."""
    tree, leaves = parse_condition(cases.sparkSession, condition, stop_words)
    if not leaves:
        return cases.limit(0)
    texts = [folded(F.coalesce(F.col(f), F.lit(""))) for f in fields]
    tf = leaf_counts(leaves, texts, [words(F.col(f)) for f in fields], stop_words)
    return cases.where(met(tree, lambda i: tf[i] > 0, F.lit(False)))


def _free_words(spark: SparkSession, text: str, stop_words: Sequence[str]) -> list[str]:
    """The indexed words of a free text."""
    found = spark.sql("SELECT 1").select(words(F.lit(text))).first()[0]
    return sorted({w for w in found if w not in stop_words})


def freetext_filter(cases: DataFrame, fields: Sequence[str], text: str,
                    stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """Cases holding any indexed word of a free text: a row filter, nothing shuffles."""
    asked = _free_words(cases.sparkSession, text, stop_words)
    if not asked:
        return cases.limit(0)
    wanted = F.array(*[F.lit(w) for w in asked])
    return cases.where(reduce(lambda a, b: a | b, [F.arrays_overlap(words(F.col(f)), wanted) for f in fields]))


def contains_index(index: KeywordIndex, cases: DataFrame, condition: str, fields: Sequence[str] | None = None) -> DataFrame:
    """`contains_filter` by a stored index: only the postings of the asked words are read."""
    return cases.join(keyword_search(index, condition, fields=fields).select("case_id"), "case_id", "left_semi")


def freetext_index(index: KeywordIndex, cases: DataFrame, text: str, fields: Sequence[str] | None = None) -> DataFrame:
    """`freetext_filter` by a stored index."""
    spark = cases.sparkSession
    asked = _free_words(spark, text, index.stop_words)
    if not asked:
        return cases.limit(0)
    buckets = _buckets(spark, asked, index.buckets)
    hits = unfolded(index.postings.where(F.col("term_bucket").isin(*buckets) & F.col("term").isin(*asked))
                    ).where(F.col("field").isin(*(fields or index.fields)))
    return cases.join(hits.select("case_id").distinct(), "case_id", "left_semi")
