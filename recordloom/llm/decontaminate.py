"""Benchmark decontamination by a generalised suffix automaton of the test items.

The automaton of an item set holds every run of words of every item.  A document's words walk it: the state reached
stands for the longest run that ends at this word and occurs in an item.  Once that length reaches the window, the
window ending here occurs, and the state knows the items that have it.  An item shorter than the window is one window,
found through the suffix links.  Item sets of more than ``block_words`` words are taken in blocks, one automaton each,
so that what a worker holds has a bound; texts are read in one pass, a bounded number of them walking all automata.
"""

from __future__ import annotations

import pickle
import re
import uuid
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .shared import free_name, raw, read_file, scratch, ship, write_file

WINDOW = 13
#: Of an item set's block; an automaton has less than two states a word.
BLOCK_WORDS = 200_000
#: Bytes of texts that walk one automaton after the other together, about.
WALK_BYTES = 48 << 20
# A-Z to a-z, and every other ASCII character that is no digit or letter to a space: then words are what split() gives.
_TABLE = bytes((c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32) for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Runs of ASCII digits, letters (lower-cased) and any other characters beyond ASCII; null has none."""
    return (text or b"").translate(_TABLE).split()


class Automaton:
    """Generalised suffix automaton over items' words, with the items of each window.

    ``next``: a dict a state, from a word to a state.  ``link``, ``length``: of suffix links and longest runs.
    """

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.windows: dict[int, set] = {}  # of the state that holds a full window
        self.whole: dict[int, set] = {}  # of the state of a short item: (length, item)
        for _, sequence in items:
            last = 0
            for word in sequence:
                last = self._extend(last, self.ids.setdefault(word, len(self.ids)))
        for item, sequence in items:
            self._mark(item, [self.ids[w] for w in sequence])
        self._close()

    def _new(self, length: int, link: int, after: dict[int, int]) -> int:
        self.next.append(after)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, state: int, word: int, target: int) -> int:
        """A state for the runs of ``target`` no longer than those that come from ``state``."""
        if self.length[target] == self.length[state] + 1:
            return target
        clone = self._new(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = clone
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = clone
            state = self.link[state]
        return clone

    def _extend(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None:
            return self._split(last, word, known)
        new = self._new(self.length[last] + 1, 0, {})
        state = last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, word, self.next[state][word])
        return new

    def step(self, state: int, length: int, word: int) -> tuple[int, int]:
        """The longest run that ends with ``word``."""
        after = self.next
        while state and word not in after[state]:
            state = self.link[state]
            length = self.length[state]
        target = after[state].get(word)
        return (0, 0) if target is None else (target, length + 1)

    def holder(self, state: int, length: int) -> int:
        """The state that the run's last ``length`` words are in."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def _mark(self, item: int, sequence: list[int]) -> None:
        state = length = 0
        for word in sequence:
            state, length = self.step(state, length, word)
            if length >= self.window:
                self.windows.setdefault(self.holder(state, self.window), set()).add(item)
        if 0 < len(sequence) < self.window:
            self.whole.setdefault(self.holder(state, len(sequence)), set()).add((len(sequence), item))

    def _close(self) -> None:
        """For each state: short items that it or a state along its links holds; its window's state."""
        order = sorted(range(len(self.next)), key=self.length.__getitem__)
        self.short: list[tuple] = [()] * len(order)
        self.window_of = [0] * len(order)
        for state in order[1:]:
            parent = self.link[state]
            self.short[state] = (*sorted(self.whole.get(state, ()), key=lambda x: (x[0], *_null_last(x[1]))), *self.short[parent])
            self.window_of[state] = self.window_of[parent] or (state if self.length[state] >= self.window else 0)
        self.alert = [bool(self.short[s]) or bool(self.window_of[s]) for s in range(len(order))]

    def scan(self, sequence: list[int | None]) -> tuple[list[tuple[int, int]], set]:
        """Word spans (start, end) inside occurring windows, in order and joined, and the items that have them."""
        spans: list[tuple[int, int]] = []
        items: set = set()
        after, link, lengths, alert, window = self.next, self.link, self.length, self.alert, self.window
        state = length = 0
        here = after[0]
        for i, word in enumerate(sequence):
            target = here.get(word)
            if target is None:
                if word is None or not state:
                    state = length = 0
                    here = after[0]
                    continue
                while True:
                    state = link[state]
                    target = after[state].get(word)
                    if target is not None:
                        length = lengths[state]
                        break
                    if not state:
                        break
                if target is None:
                    state = length = 0
                    here = after[0]
                    continue
            state = target
            length += 1
            here = after[state]
            if alert[state]:
                reach = 0
                if length >= window:
                    reach = window
                    items |= self.windows.get(self.window_of[state], set())
                for size, item in self.short[state]:
                    if size <= length:
                        items.add(item)
                        reach = max(reach, size)
                if reach:
                    start = i + 1 - reach
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, i + 1))
        return spans, items


_BUILT: dict[str, Automaton] = {}


def built(name: str, block, window: int) -> Automaton:
    """The automaton of the block that ``block()`` gives, kept for a worker's next tasks; the last one only."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Automaton(block(), window)
    return _BUILT[name]


def _null_last(item) -> tuple:
    return (True, 0) if item is None else (False, item)


def _joined(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and out[-1][1] >= start:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _item_blocks(benchmark: DataFrame, item: str, text: str, block_words: int):
    """Lists of (item, words) of at most ``block_words`` words or one item, read in order of the item's id."""
    rows = benchmark.select(F.col(item).alias("item"), F.col(text).alias("text")).where("text is not null")
    block, size = [], 0
    for row in rows.orderBy("item").toLocalIterator(prefetchPartitions=False):
        sequence = words(row["text"].encode())
        if not sequence:
            continue
        if block and size + len(sequence) > block_words:
            yield block
            block, size = [], 0
        block.append((row["item"], sequence))
        size += len(sequence)
    yield block


def match(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``n_items``, ``items`` (array) and ``spans`` (array of word starts and ends).

    A document word inside any occurrence of a window is hit; a window is ``window`` consecutive item words, or a
    whole shorter item.  Null and wordless texts have no words and no hits; texts are read whole, however long, and
    repeated rows each; items of a null or wordless text have no window.  Items that share an id count once; those
    without an id count as one item, a null at the end of ``items``.  Ids are of any type that has an order.  Other
    columns stay; where one has a new column's name, the new one gets underscores before it.  An empty table gives an
    empty one.
    """
    spark = docs.sparkSession
    ship(spark)
    names = [free_name(docs.columns, n) for n in ("n_words", "n_hit", "n_items", "items", "spans")]
    item_type = benchmark.schema[item].dataType
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    kinds = (T.LongType(), T.LongType(), T.LongType(), T.ArrayType(item_type), span)
    schema = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in docs.schema.fields], *[T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]])
    at, all_names = docs.columns.index(text), [f.name for f in schema.fields]
    span_type, ids = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(to_arrow_type(item_type))

    # The first block travels with the tasks; where there are more, all but it are files in the shared folder.
    folder, uid, first, n_blocks = scratch(spark, "items"), uuid.uuid4().hex, None, 0
    for block in _item_blocks(benchmark, item, item_text, block_words):
        if n_blocks:
            write_file(f"{folder}/{n_blocks}.pickle", [pickle.dumps(block)])
        else:
            first = spark.sparkContext.broadcast(block)
        n_blocks += 1

    def load(k: int):
        return pickle.loads(read_file(f"{folder}/{k}.pickle")) if k else first.value

    def settle(parts):
        texts = [raw(part.column(at)) for part in parts]
        n_words = [[0] * len(t) for t in texts]
        all_spans, all_items = [[[] for _ in t] for t in texts], [[set() for _ in t] for t in texts]
        for block in range(n_blocks):
            automaton = built(f"{uid}/{block}", lambda k=block: load(k), window)
            get = automaton.ids.get
            for p, values in enumerate(texts):
                for k, value in enumerate(values):
                    sequence = words(value)
                    n_words[p][k] = len(sequence)
                    spans, items = automaton.scan([get(w) for w in sequence])
                    all_spans[p][k] = _joined(chain(spans, all_spans[p][k])) if all_spans[p][k] else spans
                    all_items[p][k] |= items
        for part, counts, spans, items in zip(parts, n_words, all_spans, all_items, strict=True):
            yield pa.RecordBatch.from_arrays([
                *part.columns, pa.array(counts, pa.int64()), pa.array([sum(e - s for s, e in x) for x in spans], pa.int64()), pa.array([len(x) for x in items], pa.int64()),
                pa.array([sorted(x, key=_null_last) for x in items], ids), pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], span_type),
            ], names=all_names)

    def run(batches):
        parts, size = [], 0
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                parts.append(batch.slice(begin, 1000))
                size += parts[-1].column(at).get_total_buffer_size() * len(parts[-1]) // max(1, batch.num_rows)
                if n_blocks == 1 or size > WALK_BYTES:
                    yield from settle(parts)
                    parts, size = [], 0
        yield from settle(parts)

    return docs.mapInArrow(run, schema)


def contaminated(n_hit, n_words, share: int = 20):
    """More than no hit, and at least one word in ``share`` hit."""
    return (n_hit > 0) & (n_hit * share >= n_words)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", window: int = WINDOW, share: int = 20) -> DataFrame:
    """``docs`` without contaminated documents, all columns as they were.

    Nulls, long texts, repeated rows and empty tables as in :func:`match`: a document without words is clean.
    """
    inner = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[text].alias("text"))
    marked = match(inner, benchmark, "text", item, window=window)
    return marked.where(~contaminated(F.col("n_hit"), F.col("n_words"), share)).select("row.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", window: int = WINDOW, share: int = 20) -> DataFrame:
    """``docs`` with hit spans cut out of texts; texts over the coverage limit become null.

    A span runs from its first word's first byte to its last word's last byte; what separates words stays.  Null texts
    stay null; else as in :func:`match`.
    """
    ship(docs.sparkSession)
    inner = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[text].alias("text"))
    marked = match(inner, benchmark, "text", item, window=window)

    @F.pandas_udf("string")
    def cut(texts, spans):
        out = []
        for value, own in zip(texts, spans, strict=True):
            if value is None or not len(own):
                out.append(value)
                continue
            data = value.encode()
            bounds = [m.span() for m in re.finditer(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", data)]
            parts, last = [], 0
            for s in own:
                parts.append(data[last : bounds[s["start"]][0]])
                last = bounds[s["end"] - 1][1]
            out.append(b"".join([*parts, data[last:]]).decode())
        import pandas as pd

        return pd.Series(out, dtype=object)

    fixed = F.when(contaminated(F.col("n_hit"), F.col("n_words"), share), F.lit(None).cast("string")).otherwise(cut("text", "spans"))
    return marked.select(*[(fixed if c == text else F.col("row")[c]).alias(c) for c in docs.columns])
