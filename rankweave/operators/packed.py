"""Packed postings and top-k keyword search that leaves out what cannot reach the top.

Cases, sorted by id, are cut into pages. A row of the index is one block: a term in a page. Its
cases are numbers within the page, delta-coded with their counts as variable-length bytes; its
places are delta-coded in a column of their own, which only phrases and NEAR read. A place is
word number x fields + field, so one stream serves all fields. `pages` holds the case ids and
lengths of each page. Next to a block stand its impacts: for up to four classes of counts the
largest count and the shortest case, from which the greatest BM25 part of the block follows
under whatever average length the corpus has by then.

`search_topk` first reads impacts only. They give each page a bound on any score in it. The
pages of the greatest bounds are scored, the k-th score so far is the bar, and only pages whose
bound reaches the bar are read at all; the others are skipped together with their blocks. A
phrase, prefix or NEAR has to be matched everywhere first, since its weight depends on how many
cases hold it; what is found is packed into blocks of the same shape. Case ids must be unique.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.functions.scoring import BM25_B, BM25_K1
from rankweave.functions.text import STOP_WORDS
from rankweave.operators.conditions import Leaf, Tree, counting, met, near_places, parse_condition
from rankweave.operators.keyword import TERM_BUCKETS, _buckets, _split, _Tile, _tiles, term_bucket
from rankweave.schemas import CANDIDATES, SEARCHED_FIELDS
from rankweave.session import written

#: cases of a page; pages scored in the first rounds of a search, after them all that reach the bar
PAGE_CASES = 512
ROUNDS = (16, 256)
#: bytes of blocks that are unpacked together
UNPACKED_BYTES = 1 << 20

BLOCKS = "term string, page long, n int, tfs array<int>, dls array<int>, cases binary, places binary"
PAGES = "page long, n int, len long, ids binary, lens binary"


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): each value as groups of seven bits, the last one without the top bit."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for bits in range(7, 64, 7):
        size += values >= np.uint64(1 << bits)
    at = np.zeros(len(values) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    out = np.zeros(at[-1], np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        part = (values[has] >> np.uint64(7 * k)) & np.uint64(127)
        out[at[:-1][has] + k] = part.astype(np.uint8) | np.where(size[has] > k + 1, 128, 0).astype(np.uint8)
    return out, at


def decode(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    first = np.r_[0, np.flatnonzero(raw < 128)[:-1] + 1]
    place = np.arange(len(raw)) - np.repeat(first, np.diff(np.r_[first, len(raw)]))
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), first)


def _binary(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data)])


def _restart(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Differences to the value before, whole values where a run begins."""
    out = values.copy()
    out[1:] -= values[:-1]
    out[first] = values[first]
    return out


def _impacts(block: np.ndarray, tf: np.ndarray, dl: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first entry of each block, tfs, dls): the largest count and least length of each class of counts.

    Lengths are rounded down to four leading bits, which keeps the bound and takes less room.
    """
    shift = np.maximum(np.frexp(dl.astype(np.float64))[1] - 4, 0)
    dl = (dl >> shift) << shift
    kind = np.minimum(np.frexp(tf.astype(np.float64))[1] - 1, 3)         # 1, 2-3, 4-7, 8 and more
    order = np.lexsort((kind, block))
    block, kind, tf, dl = block[order], kind[order], tf[order], dl[order]
    first = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (kind[1:] != kind[:-1])])
    per = np.flatnonzero(np.r_[True, block[first][1:] != block[first][:-1]])
    return np.r_[per, len(first)], np.maximum.reduceat(tf, first), np.minimum.reduceat(dl, first)


def _lists(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(values.astype(np.int32)))


def _block_rows(page: np.ndarray, names: pa.Array, starts: np.ndarray, case: np.ndarray, tf: np.ndarray, dl: np.ndarray,
                places: np.ndarray | None, firsts: np.ndarray | None) -> pa.RecordBatch:
    """Blocks from postings in order: `starts` are the first postings of the blocks, `firsts` the first places of postings."""
    cuts = np.r_[starts, len(case)]
    block = np.repeat(np.arange(len(starts)), np.diff(cuts))
    # of each block first the steps from case to case, then the counts
    order = np.lexsort((np.tile(np.arange(len(case)), 2), np.repeat([0, 1], len(case)), np.tile(block, 2)))
    data, at = encode(np.r_[_restart(case, starts), tf][order])
    per, tfs, dls = _impacts(block, tf, dl)
    if places is None:
        spots = pa.nulls(len(starts), pa.binary())
    else:
        bytes_, offsets = encode(_restart(places, firsts))
        spots = _binary(bytes_, offsets[np.r_[firsts, len(places)][cuts]])
    return pa.RecordBatch.from_arrays(
        [names, pa.array(page), pa.array(np.diff(cuts).astype(np.int32)), _lists(tfs, per), _lists(dls, per),
         _binary(data, at[2 * cuts]), spots], names=["term", "page", "n", "tfs", "dls", "cases", "places"])


def _pages_of(tile: _Tile, fields: int, size: int) -> Iterator[tuple[pa.RecordBatch, pa.RecordBatch]]:
    """(blocks, page row) of each page of a tile."""
    n = len(tile.ids)
    dl = tile.lens.sum(axis=1).astype(np.int64)
    at = np.flatnonzero(tile.codes >= 0)
    segment = tile.segment[at]
    case, field = segment % n, segment // n
    spot = (at - np.searchsorted(tile.segment, segment)) * fields + field
    code = tile.codes[at]
    order = np.lexsort((spot, case, code, case // size))
    case, code, spot = case[order], code[order], spot[order]
    edges = np.searchsorted(case // size, np.arange(-(-n // size) + 1))
    terms = pa.array(tile.terms, pa.string())
    for k, lo in enumerate(range(0, n, size)):
        mine, ids = slice(edges[k], edges[k + 1]), tile.ids[lo:lo + size]
        c, t, s = case[mine] - lo, code[mine], spot[mine]
        lens, _ = encode(dl[lo:lo + size])
        packed, _ = encode(np.r_[0, np.diff(ids)])
        row = pa.RecordBatch.from_arrays(
            [pa.array([int(ids[0])]), pa.array([len(ids)], pa.int32()), pa.array([int(dl[lo:lo + size].sum())]),
             pa.array([packed.tobytes()], pa.binary()), pa.array([lens.tobytes()], pa.binary())],
            names=["page", "n", "len", "ids", "lens"])
        firsts = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (t[1:] != t[:-1])]) if len(c) else np.zeros(0, np.int64)
        if len(firsts):
            pc_, pt = c[firsts], t[firsts]
            tf = np.diff(np.r_[firsts, len(c)])
            starts = np.flatnonzero(np.r_[True, pt[1:] != pt[:-1]])
            page = np.full(len(starts), ids[0], np.int64)
            blocks = _block_rows(page, terms.take(pa.array(pt[starts])), starts, pc_, tf, dl[lo:][pc_], s, firsts)
        else:
            blocks = None
        yield blocks, row


@dataclass(frozen=True)
class PackedIndex:
    """`blocks` (term_bucket and BLOCKS), `pages` (PAGES) and the totals of the corpus."""

    blocks: DataFrame
    pages: DataFrame
    fields: tuple[str, ...]
    stop_words: tuple[str, ...]
    buckets: int
    n: int
    len: int


def build_packed(cases: DataFrame, path: str, fields: Sequence[str] = SEARCHED_FIELDS, stop_words: Sequence[str] = STOP_WORDS,
                 buckets: int = TERM_BUCKETS, page_cases: int = PAGE_CASES) -> PackedIndex:
    """Write a packed index over `fields` taken together. The texts are sorted by case id once, and read once."""
    spark, fields, stop_words = cases.sparkSession, tuple(fields), tuple(stop_words)
    rows = _split(cases.select("case_id", *fields).repartitionByRange("case_id").sortWithinPartitions("case_id"), fields)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["term", "page", "n", "tfs", "dls", "cases", "places"]
        for tile in _tiles(batches, len(fields), stop_words):
            for blocks, row in _pages_of(tile, len(fields), page_cases):
                if blocks is not None:
                    yield blocks
                # a page row travels as a block without a term: its length as the one count
                none = pa.nulls(1, pa.string())
                empty = pa.array([[]], pa.list_(pa.int32()))
                total, _ = encode(np.array([row.column(2)[0].as_py()]))
                yield pa.RecordBatch.from_arrays(
                    [none, row.column(0), row.column(1), empty, empty, row.column(3),
                     pa.array([total.tobytes() + row.column(4)[0].as_py()], pa.binary())], names=names)

    bucket = F.when(F.col("term").isNull(), -1).otherwise(term_bucket(F.col("term"), buckets))
    packed = rows.mapInArrow(pack, BLOCKS).withColumn("term_bucket", bucket)
    packed.hint("rebalance", "term_bucket").sortWithinPartitions("term_bucket", "term", "page").write.mode(
        "overwrite").option("compression", "zstd").partitionBy("term_bucket").parquet(f"{path}/blocks")

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [(values := decode(b))[0:1].tolist() + [encode(values[1:])[0].tobytes()] for b in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x for x, _ in split], pa.int64()), batch.column(2),
                 pa.array([y for _, y in split], pa.binary())], names=["page", "n", "len", "ids", "lens"])

    stored = spark.read.schema(BLOCKS + ", term_bucket int").parquet(f"{path}/blocks")
    stored.where("term_bucket = -1").select("page", "n", "cases", "places").mapInArrow(unfold, PAGES).write.mode(
        "overwrite").parquet(f"{path}/pages")
    totals = spark.read.schema(PAGES).parquet(f"{path}/pages").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("len"))
    totals.withColumn("buckets", F.lit(buckets)).withColumn("fields", F.lit(json.dumps(fields))).withColumn(
        "stop_words", F.lit(json.dumps(stop_words))).write.mode("overwrite").parquet(f"{path}/settings")
    return read_packed(spark, path)


def read_packed(spark: SparkSession, path: str) -> PackedIndex:
    row = spark.read.parquet(f"{path}/settings").first()
    blocks = spark.read.schema(BLOCKS + ", term_bucket int").parquet(f"{path}/blocks").where("term_bucket >= 0")
    return PackedIndex(blocks, spark.read.schema(PAGES).parquet(f"{path}/pages"), tuple(json.loads(row["fields"])),
                       tuple(json.loads(row["stop_words"])), row["buckets"], row["n"], row["len"])


def _cases(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of cases in the page, counts)."""
    steps, tf = decode(data).reshape(2, -1)
    return np.cumsum(steps), tf


def _spots(data: bytes, tf: np.ndarray) -> np.ndarray:
    """The places of all postings of a block, one after the other."""
    steps = decode(data)
    first = np.cumsum(tf) - tf
    running = np.cumsum(steps)
    return running - np.repeat(running[first] - steps[first], tf)


def unpacked(index: PackedIndex) -> DataFrame:
    """(term_bucket, term, case_id, field, tf, positions) of the whole index, as `build_postings` gives them."""
    fields = list(index.fields)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.add(*(pc.binary_length(batch.column(c)).to_numpy(zero_copy_only=False) for c in (4, 5)))
            for part in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(np.cumsum(size) // UNPACKED_BYTES)) + 1):
                if len(part):
                    yield _postings(batch.slice(part[0], len(part)), fields)

    rows = index.blocks.join(index.pages.select("page", "ids"), "page").select("term_bucket", "term", "page", "n", "cases", "places", "ids")
    return rows.mapInArrow(scan, "term_bucket int, term string, case_id long, field string, tf int, positions array<int>")


def _resumed(steps: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The values of runs that begin at `first`, from differences: the opposite of `_restart`."""
    running = np.cumsum(steps)
    return running - np.repeat(running[first] - steps[first], sizes)


def _postings(blocks: pa.RecordBatch, fields: Sequence[str]) -> pa.RecordBatch:
    """The postings of some blocks (term_bucket, term, page, n, cases, places, ids), all decoded together."""
    n = blocks.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
    first, block = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
    numbers = decode(b"".join(blocks.column(4).to_pylist()))             # of each block n steps, then n counts
    step = np.arange(len(block)) + first[block]
    tf = numbers[step + n[block]]
    case = _resumed(numbers[step], first, n)
    page, sample, which = np.unique(blocks.column(2).to_numpy(zero_copy_only=False), return_index=True, return_inverse=True)
    ids = [start + np.cumsum(decode(blocks.column(6)[int(k)].as_py())) for start, k in zip(page, sample, strict=True)]
    base = np.cumsum([0, *map(len, ids)])
    case = np.concatenate(ids)[base[which[block]] + case]
    spots = _resumed(decode(b"".join(blocks.column(5).to_pylist())), np.cumsum(tf) - tf, tf)
    owner = np.repeat(np.arange(len(tf)), tf) * len(fields) + spots % len(fields)
    order = np.argsort(owner, kind="stable")
    owner, spots = owner[order], (spots // len(fields))[order]
    cuts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    mine, field = np.divmod(owner[cuts], len(fields))
    cuts = np.r_[cuts, len(owner)]
    of = pa.array(block[mine])
    return pa.RecordBatch.from_arrays(
        [blocks.column(0).take(of), blocks.column(1).take(of), pa.array(case[mine]), pa.array(fields, pa.string()).take(pa.array(field)),
         pa.array(np.diff(cuts).astype(np.int32)), _lists(spots, cuts)],
        names=["term_bucket", "term", "case_id", "field", "tf", "positions"])


# ---- search ----


def _wanted(index: PackedIndex, leaves: Sequence[Leaf]) -> DataFrame:
    """The blocks of the words and prefixes of some leaves, by literal filters."""
    asked = {(w, term.is_prefix) for leaf in leaves for term in leaf.terms for _, w in term.words}
    exact = sorted(w for w, is_prefix in asked if not is_prefix)
    test = F.lit(False)
    if exact:
        buckets = _buckets(index.blocks.sparkSession, exact, index.buckets)
        test = F.col("term_bucket").isin(*buckets) & F.col("term").isin(*exact)
    for head in sorted(w for w, is_prefix in asked if is_prefix):
        test = test | F.col("term").startswith(head)
    return index.blocks.where(test)


def _page_hits(leaves: Sequence[tuple[int, Leaf]], fields: int):
    """Blocks of leaves that are no single words, from rows (page, term, cases, places, lens) sorted by page."""
    def starts(term, blocks: dict[str, tuple]) -> np.ndarray:
        """case << 40 | place of each start of a term; the words of a phrase stand `fields` apart."""
        at = None
        for offset, word in term.words:
            names = [w for w in blocks if w.startswith(word)] if term.is_prefix else [word] if word in blocks else []
            shift = (offset - term.base) * fields
            here = np.concatenate([(blocks[w][0] << 40) + blocks[w][1] - shift for w in names]) if names else np.zeros(0, np.int64)
            at = np.sort(here) if at is None else at[np.isin(at, here)]
            if not len(at):
                break
        return at

    def count(leaf: Leaf, blocks: dict) -> tuple[np.ndarray, np.ndarray]:
        found = [starts(term, blocks) for term in leaf.terms]
        if leaf.reach is None:
            at = found[0]
        else:                                            # by field, in words: case << 40 | word
            at = []
            for f in range(fields):
                own = [np.sort(((s >> 40) << 40) + (s & ((1 << 40) - 1)) // fields)[...] for s in
                       (x[(x & ((1 << 40) - 1)) % fields == f] for x in found)]
                at.append(near_places(own, [t.width for t in leaf.terms], leaf.window))
            at = np.concatenate(at)
        return np.unique(at >> 40, return_counts=True)

    def page(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        blocks = {}
        for row in rows:
            number, tf = _cases(row["cases"])
            blocks[row["term"]] = np.repeat(number, tf), _spots(row["places"], tf)
        dl = decode(rows[0]["lens"])
        for k, leaf in leaves:
            case, tf = count(leaf, blocks)
            if len(case):
                yield _block_rows(np.array([rows[0]["page"]]), pa.array([str(k)]), np.zeros(1, np.int64), case, tf, dl[case],
                                  None, None)

    return lambda batches: _by_page(batches, page)


def _by_page(batches: Iterator[pa.RecordBatch], each) -> Iterator[pa.RecordBatch]:
    """`each` for the rows of every page; rows come sorted by page."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row["page"] != held[0]["page"]:
                yield from each(held)
                held = []
            held.append(row)
    if held:
        yield from each(held)


@dataclass(frozen=True)
class TopHits:
    """The best (case_id, keyword_score), how many blocks of the asked words there are, and how many were scored."""

    hits: DataFrame
    blocks: int
    blocks_read: int


def _score_page(leaves: dict[int, float], tree: Tree, k: int, average: float, read, k1: float, b: float):
    """The best k hits of a page from its leaf blocks; `leaves` gives the weight of each counting leaf."""
    def page(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        ids = rows[0]["page"] + np.cumsum(decode(rows[0]["ids"]))
        dl = decode(rows[0]["lens"])
        score, holds, none = np.zeros(len(ids)), {}, np.zeros(len(ids), bool)
        read.add(len(rows))
        for row in sorted(rows, key=lambda r: r["leaf"]):
            case, tf = _cases(row["cases"])
            has = none.copy()
            has[case] = True
            holds[row["leaf"]] = has
            if row["leaf"] in leaves:
                score[case] += leaves[row["leaf"]] * tf * (k1 + 1.0) / (tf + k1 * ((1.0 - b) + b * dl[case] / average))
        good = np.flatnonzero(met(tree, lambda leaf: holds.get(leaf, none), none))
        if len(good):
            found = np.round(score[good], 8)
            best = np.lexsort((ids[good], -found))[:k]
            yield pa.RecordBatch.from_arrays([pa.array(ids[good][best]), pa.array(found[best])], names=["case_id", "keyword_score"])

    return lambda batches: _by_page(batches, page)


def _possible(tree: Tree, there: dict[int, Column]) -> Column:
    """Whether a page may hold a case that meets the tree, from the leaves that are there; a NOT may always hold."""
    result = F.lit(False)
    for group in tree:
        if all(negated for negated, _ in group):
            continue
        good = F.lit(True)
        for negated, part in group:
            if not negated:
                good = good & (there[part] if isinstance(part, int) else _possible(part, there))
        result = result | good
    return result


def search_topk(index: PackedIndex, condition: str, k: int = CANDIDATES, k1: float = BM25_K1, b: float = BM25_B) -> TopHits:
    """The k best cases of a condition, equal scores by case id: as an exhaustive search ranks them."""
    spark = index.blocks.sparkSession
    schema = "case_id long, keyword_score double"
    tree, leaves = parse_condition(spark, condition, index.stop_words)
    none = TopHits(spark.createDataFrame([], schema), 0, 0)
    if not counting(tree) or not index.n:
        return none
    average = index.len / index.n if index.len else 1.0
    own = [(i, leaf) for i, leaf in enumerate(leaves) if leaf.word is not None]
    rest = [(i, leaf) for i, leaf in enumerate(leaves) if leaf.word is None]
    columns = ["page", "leaf", "n", "tfs", "dls", "cases"]
    parts = []
    if own:
        # two leaves may be the same word, such as "the pain" and pain
        words = F.array(*[F.struct(F.lit(leaf.word).alias("w"), F.lit(i).alias("leaf")) for i, leaf in own])
        mine = F.filter(words, lambda x: x["w"] == F.col("term"))
        parts.append(_wanted(index, [leaf for _, leaf in own]).withColumn("leaf", F.explode(mine["leaf"])).select(*columns))
    if rest:
        rows = _wanted(index, [leaf for _, leaf in rest]).select("page", "term", "cases", "places")
        rows = rows.join(index.pages.select("page", "lens"), "page").repartition("page").sortWithinPartitions("page")
        found = rows.mapInArrow(_page_hits(rest, len(index.fields)), BLOCKS).withColumn("leaf", F.col("term").cast("int"))
        parts.append(written(found.select(*columns), "leaf-blocks"))
    blocks = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    df = {r["leaf"]: (r["df"], r["blocks"]) for r in blocks.groupBy("leaf").agg(
        F.sum("n").alias("df"), F.count(F.lit(1)).alias("blocks")).collect()}                # a row per leaf
    weights = {i: float(np.log(1.0 + (index.n - df[i][0] + 0.5) / (df[i][0] + 0.5))) for i in counting(tree) if i in df}
    if not weights:
        return none
    bounds = written(_bounds(blocks, tree, len(leaves), weights, average, k1, b), "bounds")
    read = spark.sparkContext.accumulator(0)
    score = _score_page(weights, tree, k, average, read, k1, b)

    def scored(chosen: DataFrame) -> list[tuple[float, int]]:
        rows = chosen.select("page", "leaf", "cases").join(index.pages.select("page", "ids", "lens"), "page")
        hits = rows.repartition("page").sortWithinPartitions("page").mapInArrow(score, schema)
        top = hits.orderBy(F.desc("keyword_score"), "case_id").limit(k).collect()            # k rows
        return [(-r["keyword_score"], r["case_id"]) for r in top]

    best: list[tuple[float, int]] = []
    left = bounds
    for pages in ROUNDS:
        chosen = left.orderBy(F.desc("bound"), "page").limit(pages).collect()
        if not chosen:
            break
        best = sorted(best + scored(blocks.where(F.col("page").isin([r["page"] for r in chosen]))))[:k]
        last = chosen[-1]
        left = left.where((F.col("bound") < last["bound"]) | ((F.col("bound") == last["bound"]) & (F.col("page") > last["page"])))
        if len(best) == k:
            left = left.where(F.col("bound") >= -best[-1][0])
    else:
        if not left.isEmpty():
            best = sorted(best + scored(blocks.join(left.select("page"), "page", "left_semi")))[:k]
    hits = spark.createDataFrame([(case, -score) for score, case in best], schema)
    return TopHits(hits, sum(n for _, n in df.values()), read.value)


def _bounds(blocks: DataFrame, tree: Tree, leaves: int, weights: dict[int, float], average: float, k1: float, b: float
            ) -> DataFrame:
    """(page, bound) of the pages that may hold a hit: no score of the page passes its bound."""
    weight = F.element_at(F.create_map(*[x for i, w in weights.items() for x in (F.lit(i), F.lit(w))]), F.col("leaf"))
    part = F.array_max(F.zip_with("tfs", "dls", lambda tf, dl: tf * F.lit(k1 + 1.0) / (
        tf + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * dl / F.lit(average)))))
    # a little more, for the rounding of scores
    bound = F.sum(F.coalesce(weight * part, F.lit(0.0))) + F.lit(1e-7)
    there = [F.bool_or(F.col("leaf") == i).alias(f"has{i}") for i in range(leaves)]
    found = blocks.groupBy("page").agg(bound.alias("bound"), *there)
    return found.where(_possible(tree, {i: F.col(f"has{i}") for i in range(leaves)})).select("page", "bound")
