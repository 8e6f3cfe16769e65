"""Benchmark decontamination by n-grams of words.

A window is `WINDOW` neighbouring words of a benchmark item; an item of fewer words, but not
none, is one window. The hashes of all windows go to every task in blocks of items of at most
`BLOCK_BYTES` of benchmark text (and one item more); a larger benchmark is several blocks, one
scan of the documents each, and what a scan has found is carried along to the next. A task
hashes all windows of a text at once, looks them up, and compares the words of each hit in
full. A document word inside any occurrence of a window is hit.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` with A-Z lower-cased. A null text has no words.
Items are told apart by their id: rows that repeat an id are one item, and an item without an
id marks words but is not listed. An empty benchmark hits nothing.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankweave.llm.words import ALNUM, LOWER, blocks, column_bytes, per_text, span_hashes, window_hashes, word_bounds
from rankweave.session import written

WINDOW = 10
BLOCK_BYTES = 16 << 20

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


class Windows:
    """The windows of a block of items: hashes by width, and the words behind each hash."""

    def __init__(self, items: pa.Table, window: int = WINDOW):
        data, at = column_bytes(items["text"].combine_chunks())
        data = LOWER[data]
        starts, ends, first = word_bounds(data, at, ALNUM)
        hashes, line = span_hashes(data, starts, ends), data.tobytes()
        known = {value: k for k, value in enumerate(dict.fromkeys(items["id"].to_pylist()))}
        self.ids = list(known)
        of_row = [known[value] for value in items["id"].to_pylist()]
        rows: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = defaultdict(list)
        for row, item in enumerate(of_row):
            lo, hi = int(first[row]), int(first[row + 1])
            width = min(window, hi - lo)
            if width:
                found = window_hashes(hashes[lo:hi], width)
                rows[width].append((found, np.full(len(found), item), np.arange(lo, lo + len(found))))
        self.words = [line[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        self.by_width = {}
        for width, parts in rows.items():
            key, item, word = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(key, kind="stable")
            self.by_width[width] = key[order], item[order], word[order]

    def hits(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray
             ) -> Iterator[tuple[int, int, int]]:
        """(word, width, item) of each place where an item's window occurs; no window leaves its text."""
        if not len(starts):
            return
        hashes = span_hashes(data, starts, ends)
        end_of = np.repeat(first[1:], np.diff(first))
        for width, (keys, item, word) in self.by_width.items():
            asked = window_hashes(hashes, width)
            place = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
            inside = np.arange(len(asked)) + width <= end_of[:len(asked)]
            for at in np.flatnonzero((keys[place] == asked) & inside).tolist():
                mine = [data[starts[j]:ends[j]].tobytes() for j in range(at, at + width)]
                k = int(place[at])
                while k < len(keys) and keys[k] == asked[at]:
                    if self.words[word[k]:word[k] + width] == mine:
                        yield at, width, int(item[k])
                    k += 1


def _scan(batches: Iterator[pa.RecordBatch], windows: Windows, text_at: int, keep: list[int], names: list[str],
          earlier: bool, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """The kept columns, then n_words, n_hit, spans of hit words and the items that occur."""
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for lo, hi, data, at in blocks(batch.column(text_at)):
            data = LOWER[data]
            starts, ends, first = word_bounds(data, at, ALNUM)
            edge = np.zeros(len(starts) + 1, np.int64)
            items: dict[int, set] = defaultdict(set)
            for word, width, item in windows.hits(data, starts, ends, first):
                edge[word] += 1
                edge[word + width] -= 1
                items[int(np.searchsorted(first, word, side="right")) - 1].add(windows.ids[item])
            if earlier:
                for row in range(hi - lo):
                    for span in batch.column(batch.num_columns - 2)[lo + row].as_py():
                        edge[first[row] + span["start"]] += 1
                        edge[first[row] + span["end"]] -= 1
                    items[row].update(batch.column(batch.num_columns - 1)[lo + row].as_py())
            hit = np.cumsum(edge[:-1]) > 0
            count = per_text(hit, first)
            out[0].append(np.diff(first))
            out[1].append(count)
            for row in range(hi - lo):
                spans = []
                if count[row]:
                    mine = np.concatenate([[0], hit[first[row]:first[row + 1]].astype(np.int8), [0]])
                    turn = np.flatnonzero(np.diff(mine)).tolist()
                    spans = [{"start": a, "end": b} for a, b in zip(turn[::2], turn[1::2], strict=True)]
                out[2].append(spans)
                out[3].append([x for x in items.get(row, ()) if x is not None])
        if not out[0]:
            continue
        span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(k) for k in keep), pa.array(np.concatenate(out[0])), pa.array(np.concatenate(out[1])),
             pa.array(out[2], span_type), pa.array(out[3], pa.list_(id_type))], names=names)


def _fresh(taken: list[str], *names: str) -> list[str]:
    """The names, with underscores where a column has them in any case, as Spark tells names apart."""
    used, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id",
                  item_text: str = "text", keep: list[str] | None = None, window: int = WINDOW,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Each row's `keep` columns (all by default), then n_words, n_hit, spans and items.

    `spans` are runs of hit words, words counted from 0, ends exclusive; `items` are the ids
    of the items with occurring windows. Where `keep` has a column of such a name, the new
    one gets an underscore.
    """
    items = benchmark.select(F.col(item_id).alias("id"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-size // block_bytes))
    mine = items.withColumn("part", F.pmod(F.xxhash64("id", "text"), F.lit(parts)))
    keep = list(docs.columns) if keep is None else keep
    names = _fresh(keep, "n_words", "n_hit", "spans", "items")
    id_type = items.schema["id"].dataType
    fields = [T.StructField(names[0], T.LongType()), T.StructField(names[1], T.LongType()),
              T.StructField(names[2], SPANS), T.StructField(names[3], T.ArrayType(id_type))]
    text_name = _fresh([*keep, *names], "scanned_text")[0]
    rows = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias(text_name))
    for part in range(parts):
        block = mine.where(F.col("part") == part).select("id", "text").toArrow()
        held = docs.sparkSession.sparkContext.broadcast(Windows(block, window))
        carried = [*keep, text_name] if part < parts - 1 else keep
        schema = T.StructType([*(rows.schema[c] for c in carried), *fields])
        order = [rows.columns.index(c) for c in carried]
        rows = rows.mapInArrow(
            lambda b, held=held, order=order, labels=schema.names, more=part > 0, at=rows.columns.index(text_name),
            kind=block.schema.field("id").type: _scan(b, held.value, at, order, labels, more, kind), schema)
        if part < parts - 1:
            rows = written(rows, "contamination")   # one block of windows at a time in a task
    return rows


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of `docs` without any hit word, all columns as they were."""
    found = contamination(docs, benchmark, text_col)
    return found.where(F.col(found.columns[-3]) == 0).select(*docs.columns)


def without_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows of `docs`, the hit words and what stands between them cut out of the text."""
    found = contamination(docs, benchmark, text_col)
    spans, at = found.columns[-2], docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, cuts in zip(batch.column(at), batch.column(batch.num_columns - 2), strict=True):
                cuts = cuts.as_py()
                if cuts:
                    data, offsets = column_bytes(pa.array([text.as_py()]))
                    starts, ends, _ = word_bounds(LOWER[data], offsets, ALNUM)
                    inside = np.ones(len(data), bool)
                    for cut in cuts:
                        inside[starts[cut["start"]]:ends[cut["end"] - 1]] = False
                    texts.append(data[inside].tobytes().decode())
                else:
                    texts.append(text.as_py())
            columns = [batch.column(k) for k in range(len(docs_names))]
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=docs_names)

    docs_names = list(docs.columns)
    return found.select(*docs_names, spans, found.columns[-1]).mapInArrow(run, docs.schema)
