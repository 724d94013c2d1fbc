"""Token counts by rank-synchronous array merging.

The pre-tokens of a batch are ragged rows of one flat symbol array.  In each round every row's lowest-rank pair is
found and all rows merge theirs at once, until no row has a pair with a rank; the symbols that survive are the tokens.
Pre-tokens that a worker has counted before are looked up.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import free_name, raw, ship

#: Pre-tokens that a worker remembers, and bytes of pre-tokens that are merged at once, at most.
REMEMBER = 400_000
MERGE_BYTES = 1_000_000
NO_RANK = np.int64(1 << 40)
# Unicode's White_Space.
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


class Merges:
    """Merge ranks of a byte-pair vocabulary, as sorted arrays."""

    def __init__(self, vocab: dict[str, int], merges: list, end: str):
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.width = max(vocab.values()) + 1
        key = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], order.astype(np.int64), made
        # Ranks whose product has a pair of lower rank: of these only the first is merged in a round.
        lowest = np.full(self.width, NO_RANK)
        for side in (0, 1):
            np.minimum.at(lowest, np.array([vocab[p[side]] for p in pairs], dtype=np.int64), np.arange(len(pairs)))
        self.alone = lowest[made] <= np.arange(len(pairs))
        letters = byte_letters()
        self.plain = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.last = np.array([vocab[c + end] for c in letters], dtype=np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def counts(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols that survive of each pre-token."""
        sizes = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        if not sizes.sum():
            return sizes
        flat = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        symbols = self.plain[flat]
        ends = np.cumsum(sizes)[sizes > 0] - 1
        symbols[ends] = self.last[flat[ends]]
        row = np.repeat(np.arange(len(tokens)), sizes)
        done = np.zeros(len(tokens), dtype=np.int64)
        while len(symbols) > 1:
            rank = self.rank(symbols[:-1], symbols[1:])
            rank[row[:-1] != row[1:]] = NO_RANK
            starts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            lowest = np.minimum.reduceat(np.append(rank, NO_RANK), starts)
            lengths = np.diff(np.append(starts, len(row)))
            live = lowest < NO_RANK
            if not live.all():
                done[row[starts[~live]]] = lengths[~live]
                if not live.any():
                    return done
                keep = np.repeat(live, lengths)
                # The last pair kept may have crossed to a row that is gone; it has no rank.
                symbols, row, rank = symbols[keep], row[keep], np.append(rank, NO_RANK)[keep][:-1]
                lowest, lengths = lowest[live], lengths[live]
            hit = np.flatnonzero(rank == np.repeat(lowest, lengths)[: len(rank)])
            # Pairs that overlap (one symbol repeated): every other one, from the left of each run.
            fresh = np.concatenate(([True], np.diff(hit) != 1))
            place = np.arange(len(hit)) - np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
            hit = hit[place % 2 == 0]
            lone = self.alone[rank[hit]]
            if lone.any():
                first = np.concatenate(([True], row[hit][1:] != row[hit][:-1]))
                hit = hit[~lone | first]
            symbols[hit] = self.made[rank[hit]]
            stay = np.ones(len(symbols), dtype=bool)
            stay[hit + 1] = False
            symbols, row = symbols[stay], row[stay]
        if len(symbols):
            np.add.at(done, row, 1)
        return done


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte.

    Printable Latin-1 bytes stand for themselves, the others for code points from 256 on, in order.
    """
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class Counter:
    """Counts as the vocabulary file says: added tokens, normalisation, pre-tokens, merges.

    Takes files with NFC, white space to a space, lower case, one pattern for pre-tokens, byte letters and a word end;
    others are refused.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf8") as src:
            spec = json.load(src)
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        parts = [p["type"] for p in spec["pre_tokenizer"]["pretokenizers"]]
        model = spec["model"]
        if steps != ["NFC", "Replace", "Lowercase"] or parts != ["Split", "ByteLevel"] or model["type"] != "BPE" or not model["end_of_word_suffix"]:
            raise ValueError("a vocabulary of lower-cased words with word ends is needed")
        space, split, letters = spec["normalizer"]["normalizers"][1], *spec["pre_tokenizer"]["pretokenizers"]
        if (space["pattern"], space["content"]) != ({"Regex": r"\s+"}, " ") or (split["behavior"], split["invert"]) != ("Removed", True) or letters["add_prefix_space"] or letters["use_regex"]:
            raise ValueError("white space has to become a space, and pre-tokens what the pattern finds")
        if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")) or spec.get("post_processor"):
            raise ValueError("merges have to be applied in full, without unknown tokens or templates")
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens have to be plain strings")
        self.added = regex.compile("|".join(regex.escape(t["content"]) for t in sorted(spec["added_tokens"], key=lambda t: -len(t["content"])))) if spec["added_tokens"] else None
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.merges = Merges(model["vocab"], model["merges"], model["end_of_word_suffix"])
        self.known: dict[str, int] = {}

    def pieces(self, text: str) -> tuple[int, list[str]]:
        """Added tokens in the text, and the pre-tokens of what is between them."""
        parts = self.added.split(text) if self.added else [text]
        out: list[str] = []
        for part in parts:
            if not part.isascii():
                part = unicodedata.normalize("NFC", part)
                part = _SPACE.sub(" ", part).replace("Σ", "σ")  # lower() would write a final sigma
            out += self.pattern.findall(part.lower())
        return len(parts) - 1, out

    def count(self, texts: list[str]) -> list[int]:
        known = self.known
        if len(known) > REMEMBER:
            known.clear()
        out: list[int] = []
        waiting: list[tuple[int, list[str]]] = []
        fresh: dict[str, None] = {}
        size = 0

        def settle():
            nonlocal waiting, fresh, size
            names = list(fresh)
            begin = 0
            while begin < len(names):
                end, room = begin, MERGE_BYTES
                data = []
                while end < len(names) and room > 0:
                    data.append(names[end].encode())
                    room -= len(data[-1])
                    end += 1
                known.update(zip(names[begin:end], self.merges.counts(data).tolist(), strict=True))
                begin = end
            get = known.__getitem__
            out.extend(n + sum(map(get, words)) for n, words in waiting)
            waiting, fresh, size = [], {}, 0
            if len(known) > REMEMBER:
                known.clear()

        for text in texts:
            n, words = self.pieces(text)
            waiting.append((n, words))
            fresh.update(dict.fromkeys(w for w in words if w not in known))
            size += len(words)
            if size > 300_000:
                settle()
        settle()
        return out


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """A worker's counter for a vocabulary file, loaded once."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = 2048) -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``; ``path``: a vocabulary file on each machine.

    Null counts as empty, which has no tokens.  All rows and columns stay; where one has a new column's name, the new
    one gets underscores before it.  An empty table gives an empty one.
    """
    ship(docs.sparkSession)
    names = [free_name(docs.columns, n) for n in ("n_bytes", "n_tokens", "over_limit")]
    kinds = (T.LongType(), T.LongType(), T.BooleanType())
    schema = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in docs.schema.fields], *[T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]])
    all_names, at = schema.names, docs.columns.index(text)

    def run(batches):
        count = counter(path).count
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                data = raw(part.column(at))
                n = count([(d or b"").decode() for d in data])
                new = [pa.array([len(d or b"") for d in data], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=all_names)

    return docs.mapInArrow(run, schema)
