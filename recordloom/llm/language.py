"""Language of words and texts by a linear-chain conditional random field.

A word's features are its affixes, its character n-grams and, from a lexicon learned with the model, the languages it
is a word of; transitions between languages are learned too.  The model is fitted on sequences made of runs of texts
in different languages, as code-switched text has them.  Forward-backward gives each word's marginals; a text's score
for a language is the mean marginal of its words.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .line_dedup import mix
from .shared import free_name, raw, ship

BUCKETS = 1 << 15
#: Documents a language, characters of a document and words of all languages, that the model is fitted on at most; each
#: language has an equal share of the words, and those that need less leave the rest to the others.
TRAIN_DOCS = 150
TRAIN_CHARS = 20_000
TRAIN_WORDS = 150_000
#: UTF-8 bytes of a word at most; a longer one, as a line of a text without spaces is, is a run of words.
PIECE = 40
#: Words of a sequence that the model is fitted on, and of the parts that a text's chain is worked out in.
LENGTH = 48
ROUNDS = 60
#: Words whose emissions a worker remembers, at most.
REMEMBER = 300_000
_LETTER = regex.compile(r"\p{L}")
_ENDS = "\"'.,;:!?()[]{}<>-*#$%&/|"


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, words): of each word's byte n-grams, with marks at its ends, and its affixes, in order of the words."""
    data = [f"^{w}$".encode() for w in words]
    sizes = np.fromiter(map(len, data), dtype=np.int64, count=len(data))
    flat = np.frombuffer(b"".join(data) + b"\0" * 4, dtype=np.uint8).astype(np.uint64)
    n = len(flat) - 4
    owner = np.repeat(np.arange(len(data)), sizes)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    room = ends[owner] - np.arange(n)
    own = np.arange(len(data))
    hashes, owners = [], []
    rolling = np.zeros(n, dtype=np.uint64)
    for k in (1, 2, 3, 4):
        rolling = rolling * np.uint64(257) + flat[k - 1 : k - 1 + n]
        if k < 4:
            fits = room >= k
            hashes.append(mix(rolling[fits], k))
            owners.append(owner[fits])
        if k > 1:
            long = sizes >= k + 2
            for salt, at in ((10 + k, starts + 1), (20 + k, ends - 1 - k)):
                hashes.append(mix(rolling[at[long]], salt))
                owners.append(own[long])
    who = np.concatenate(owners)
    order = np.argsort(who, kind="stable")
    return (np.concatenate(hashes)[order] % np.uint64(BUCKETS)).astype(np.int64), who[order]


def pieces(word: str) -> list[str]:
    """``word``, or consecutive pieces of it of at most PIECE UTF-8 bytes, about alike in bytes and never split inside a character."""
    if len(word) * 4 <= PIECE or (size := len(word.encode())) <= PIECE:
        return [word]
    # Characters have up to four bytes, so a piece may be three bytes over its share.
    share = size / -(-size // (PIECE - 3))
    ends = np.cumsum(np.fromiter((len(c.encode()) for c in word), dtype=np.int64, count=len(word)))
    cuts = np.flatnonzero(np.diff(np.ceil(ends / share - 1e-9), prepend=1)).tolist()
    return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True) if a < b]


def tokens(text: str) -> list[str]:
    """Lower-case words without marks at their ends, long ones in pieces; words without a letter are left out."""
    words = [w.strip(_ENDS) for w in text.lower().split()]
    words = [w for w in words if w and (w.isalpha() or _LETTER.search(w))]
    return [p for w in words for p in (pieces(w) if len(w) > PIECE // 4 else (w,))]


class Crf:
    """Weights of word features by language, of the lexicon, and of transitions between languages."""

    def __init__(self, languages: list[str], lexicon: dict[str, int]):
        k = len(languages)
        self.languages, self.lexicon = languages, lexicon
        self.w = np.zeros((BUCKETS, k))
        self.lex = np.zeros(1)
        self.trans = np.zeros((k, k))
        self.start = np.zeros(k)

    def emissions(self, words: list[str]) -> np.ndarray:
        """Unnormalised log scores (words, languages)."""
        out = np.zeros((len(words), len(self.languages)))
        for begin in range(0, len(words), 20_000):
            flat, owner = grams(words[begin : begin + 20_000])
            out[begin : begin + 20_000] = np.add.reduceat(self.w[flat], np.flatnonzero(np.diff(owner, prepend=-1)))
        for i, word in enumerate(words):
            own = self.lexicon.get(word)
            if own is not None:
                out[i, own] += self.lex[0]
        return out

    def transfers(self, emission: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(sequences, languages, languages): from a forward message at a sequence's start to that at its end, each up
        to a factor."""
        n, steps, k = emission.shape
        e, a = np.exp(emission - emission.max(axis=2, keepdims=True)), np.exp(self.trans)
        out = np.tile(np.eye(k), (n, 1, 1))
        for t in range(steps):
            moved = (out @ a if t else out) * e[:, t, None, :]
            moved /= moved.max(axis=(1, 2), keepdims=True)
            out = np.where((t < lengths)[:, None, None], moved, out)
        return out

    def joints(self, emission: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Messages at the ends of sequences that are parts of longer ones: (into the first word, back to the last one).

        ``counts``: of parts of each whole, which follow each other.  With them, parts have the marginals of the whole.
        """
        k, a = emission.shape[2], np.exp(self.trans)
        into, back = np.tile(np.exp(self.start), (len(lengths), 1)), np.ones((len(lengths), k))
        begins = np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int64)
        split = counts > 1
        some = np.repeat(split, counts)
        move = np.zeros((len(lengths), k, k))
        if split.any():
            move[some] = self.transfers(emission[some], lengths[some])
        begins, counts = begins[split], counts[split]
        for j in range(1, int(counts.max(initial=1))):
            live = begins[counts > j]
            now = np.einsum("ni,nij->nj", into[live + j - 1], move[live + j - 1]) @ a
            into[live + j] = now / now.max(axis=1, keepdims=True)
            end = live + counts[counts > j] - 1
            now = np.einsum("nij,nj->ni", move[end - j + 1], back[end - j + 1]) @ a.T
            back[end - j] = now / now.max(axis=1, keepdims=True)
        return into, back

    def marginals(self, emission: np.ndarray, lengths: np.ndarray, pairs: bool = False, into: np.ndarray | None = None, back: np.ndarray | None = None):
        """Forward-backward over (sequences, time, languages) log scores; time beyond a sequence's length is masked.

        Marginals, and with ``pairs`` the expected transitions and the log likelihoods' normalisers.  ``into`` and
        ``back`` are messages from what is before and after a sequence.
        """
        n, steps, k = emission.shape
        shift = emission.max(axis=2, keepdims=True)
        e = np.exp(emission - shift)
        a = np.exp(self.trans)
        alpha, scale = np.empty_like(e), np.ones((n, steps))
        now = e[:, 0] * (np.exp(self.start) if into is None else into)
        for t in range(steps):
            if t:
                now = (alpha[:, t - 1] @ a) * e[:, t]
            total = now.sum(axis=1)
            alpha[:, t] = now / total[:, None]
            scale[:, t] = total
        beta = np.empty_like(e)
        ends = np.ones((n, k)) if back is None else back
        after = ends.copy()
        for t in range(steps - 1, -1, -1):
            # At and beyond its end, a sequence's backward score is what comes from after it, else 1.
            done = t + 1 >= lengths
            after[done] = ends[done]
            beta[:, t] = after
            after = (e[:, t] * after) @ a.T / np.maximum(scale[:, t], 1e-300)[:, None]
        gamma = alpha * beta
        gamma /= gamma.sum(axis=2, keepdims=True)
        if not pairs:
            return gamma
        expected = np.zeros((k, k))
        logz = 0.0
        for t in range(steps):
            live = t < lengths
            logz += float((np.log(scale[live, t]) + shift[live, t, 0]).sum())
            if t:
                right = e[live, t] * beta[live, t] / scale[live, t][:, None]
                expected += a * (alpha[live, t - 1].T @ right)
        return gamma, expected, logz


def switched(rows: list[tuple[list[str], int]], seed: int = 11) -> list[list[tuple[str, int]]]:
    """Sequences of LENGTH words, of runs from texts in turn: most runs are long, some short."""
    rng = np.random.default_rng(seed)
    by: dict[int, list[str]] = defaultdict(list)
    for words, label in rows:
        by[label] += words
    at = dict.fromkeys(by, 0)
    out: list[list[tuple[str, int]]] = [[]]
    while by:
        label = list(by)[rng.integers(len(by))]
        run = by[label][at[label] : at[label] + int(rng.choice([6, 16, 48, 96]))]
        at[label] += len(run)
        if at[label] >= len(by[label]):
            del by[label]
        for word in run:
            if len(out[-1]) == LENGTH:
                out.append([])
            out[-1].append((word, label))
    return [s for s in out if s]


def shares(needs: list[int], most: int) -> list[int]:
    """``most`` dealt out evenly over ``needs``; what one doesn't need goes to the others."""
    out = [0] * len(needs)
    order = sorted(range(len(needs)), key=needs.__getitem__)
    for place, k in enumerate(order):
        out[k] = min(needs[k], most // (len(order) - place))
        most -= out[k]
    return out


def fit(rows: list[tuple[str, str]], rounds: int = ROUNDS, l2: float = 1e-3, max_words: int = TRAIN_WORDS) -> Crf | None:
    """A model from (text, language) rows; None where no row has a word.  Adagrad on the exact gradient.

    A language's texts are taken in order up to its share of ``max_words``; its first text is always taken, the last one whole.
    """
    languages = sorted({lang for _, lang in rows})
    place = {lang: i for i, lang in enumerate(languages)}
    texts = [(own, place[lang]) for text, lang in rows if (own := tokens(text))]
    needs = [0] * len(languages)
    for own, label in texts:
        needs[label] += len(own)
    split, room, taken = [], shares(needs, max_words), [0] * len(languages)
    for own, label in texts:
        if not taken[label] or taken[label] < room[label]:
            split.append((own, label))
            taken[label] += len(own)
    if not split:
        return None
    spread: dict[str, Counter] = defaultdict(Counter)
    for own, label in split:
        for word, n in Counter(own).items():
            spread[word][label] += n
    lexicon = {}
    for word, n in spread.items():
        label, most = n.most_common(1)[0]
        if n.total() >= 5 and most >= 0.9 * n.total():
            lexicon[word] = label
    model = Crf(languages, lexicon)
    k = len(languages)
    sequences = switched(split)
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for s in sequences for w, _ in s))}
    names = list(vocabulary)
    flat, owner = grams(names)
    begins = np.flatnonzero(np.diff(owner, prepend=-1))
    own_lex = np.array([lexicon.get(w, -1) for w in names])
    lengths = np.array([len(s) for s in sequences])
    ids = np.zeros((len(sequences), LENGTH), dtype=np.int64)
    gold = np.zeros((len(sequences), LENGTH), dtype=np.int64)
    for i, s in enumerate(sequences):
        ids[i, : len(s)] = [vocabulary[w] for w, _ in s]
        gold[i, : len(s)] = [y for _, y in s]
    live = np.arange(LENGTH)[None, :] < lengths[:, None]
    n_live = live.sum()
    gold_words = np.zeros((len(names), k))
    np.add.at(gold_words, (ids[live], gold[live]), 1)
    gold_pairs = np.zeros((k, k))
    both = live[:, 1:]
    np.add.at(gold_pairs, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    gold_start = np.bincount(gold[:, 0], minlength=k)
    has = own_lex >= 0
    memory = {name: np.full_like(getattr(model, name), 1e-8) for name in ("w", "lex", "trans", "start")}
    for _ in range(rounds):
        scores = np.add.reduceat(model.w[flat], begins)
        scores[has, own_lex[has]] += model.lex[0]
        gamma, expected, _ = model.marginals(scores[ids], lengths, pairs=True)
        words = np.zeros((len(names), k))
        for j in range(k):
            words[:, j] = np.bincount(ids[live], weights=gamma[:, :, j][live], minlength=len(names))
        error = (gold_words - words) / n_live
        gradient = {"w": np.stack([np.bincount(flat, weights=error[owner, j], minlength=BUCKETS) for j in range(k)], axis=1)}
        gradient["lex"] = np.array([error[has, own_lex[has]].sum()])
        gradient["trans"] = (gold_pairs - expected) / n_live
        gradient["start"] = (gold_start - gamma[:, 0].sum(axis=0)) / n_live
        for name, g in gradient.items():
            value = getattr(model, name)
            g = g - l2 * value / 100
            memory[name] += g * g
            value += 0.15 * g / np.sqrt(memory[name])
    return model


class Tagger:
    """A model with a memory of words' emissions."""

    def __init__(self, model: Crf):
        self.model = model
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.languages)))

    def _ids(self, words: list[str]) -> np.ndarray:
        if len(self.known) > REMEMBER:
            self.known, self.scores = {}, self.scores[:0]
        known = self.known
        fresh = list(dict.fromkeys(w for w in words if w not in known))
        if fresh:
            base = len(known)
            known.update(zip(fresh, range(base, base + len(fresh)), strict=True))
            self.scores = np.concatenate([self.scores[:base], self.model.emissions(fresh)])
        return np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))

    def tag(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Marginals (words, languages) of each text's words."""
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        total = int(sizes.sum())
        k = len(self.model.languages)
        if not total:
            return [np.zeros((0, k)) for _ in texts]
        ids = self._ids([w for t in texts for w in t])
        # A text is one chain, worked out in parts of LENGTH words that pass messages to each other.
        begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        within = np.arange(total) - np.repeat(begin, sizes)
        head = within % LENGTH == 0
        row = np.cumsum(head) - 1
        column = within % LENGTH
        lengths = np.bincount(row)
        emission = np.zeros((len(lengths), LENGTH, k))
        emission[row, column] = self.scores[ids]
        into, back = self.model.joints(emission, lengths, -(-sizes[sizes > 0] // LENGTH))
        gamma = self.model.marginals(emission, lengths, into=into, back=back)[row, column]
        return np.split(gamma, np.cumsum(sizes)[:-1])

    def languages(self, texts: list[str]) -> list[tuple[str, float]]:
        """Language and score of each text; ("und", 0.0) for a text without a letter."""
        out: list[tuple[str, float]] = []
        batch: list[list[str]] = []
        size = 0

        def settle():
            nonlocal batch, size
            for gamma in self.tag(batch):
                if not len(gamma):
                    out.append(("und", 0.0))
                    continue
                mean = gamma.mean(axis=0)
                best = int(mean.argmax())
                out.append((self.model.languages[best], float(min(1.0, mean[best]))))
            batch, size = [], 0

        for text in texts:
            own = tokens(text)
            if not own and _LETTER.search(text):
                own = pieces(text.lower())
            batch.append(own)
            size += len(own)
            if size > 100_000:
                settle()
        settle()
        return out


_TAGGERS: dict[str, Tagger] = {}


def tagger_of(name: str, model: Crf) -> Tagger:
    """A worker's tagger for a model, with what it remembers; the last one only."""
    if name not in _TAGGERS:
        _TAGGERS.clear()
        _TAGGERS[name] = Tagger(model)
    return _TAGGERS[name]


def train(docs: DataFrame, learnable: Column, text: str = "text", lang: str = "lang", key: str = "doc_id", docs_each: int = TRAIN_DOCS, max_chars: int = TRAIN_CHARS, max_words: int = TRAIN_WORDS) -> Crf | None:
    """A model from rows for which ``learnable`` holds and whose language and text aren't null.

    About ``docs_each`` texts of each language, of at most ``max_chars`` characters, chosen by a hash of key and text; of all
    languages about ``max_words`` words, in equal shares.
    """
    known = docs.where(learnable & F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.char_length(text) <= max_chars))
    known = known.select(F.col(key).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.lit("train"), key, text).alias("o"))
    counts = known.groupBy("lang").agg(F.approx_count_distinct("o", 0.02).alias("n"))  # a row a language
    share = counts.select("lang", (F.least(F.lit(1.0), 1.2 * docs_each / F.col("n")) * (1 << 20) + 1).alias("share"))
    # A row a language, as the model has weights for each: may be broadcast.  Copies of a row are one, so that they can't
    # fill the sample.
    rows = known.join(F.broadcast(share), "lang").where(F.pmod("o", F.lit(1 << 20)) < F.col("share")).groupBy("lang", "o").agg(F.min(F.struct("text", "id")).alias("r")).select("lang", "r.text", "o", "r.id").toPandas()
    rows = rows.sort_values(["o", "id", "text"]).groupby("lang").head(docs_each) if len(rows) else rows
    return fit(list(zip(rows["text"], rows["lang"], strict=True)), max_words=max_words)


def with_languages(docs: DataFrame, model: Crf | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``.

    A null text, one without a letter, and every text where there was nothing to learn from is ``und`` at 0.  Texts are
    read whole, however long, as one chain; repeated rows get the same.  Other columns stay; where one has a new column's name, the new one gets underscores before it.  Empty tables stay empty.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # BUCKETS weights a language
    uid = uuid.uuid4().hex
    names = [free_name(docs.columns, n) for n in ("lang_pred", "score")]
    schema = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in docs.schema.fields], T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    all_names, at = schema.names, docs.columns.index(text)

    def run(batches):
        tagger = tagger_of(uid, shared.value) if shared.value else None
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                texts = [(d or b"").decode() for d in raw(part.column(at))]
                found = tagger.languages(texts) if tagger else [("und", 0.0)] * len(texts)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=all_names)

    return docs.mapInArrow(run, schema)


def with_word_languages(docs: DataFrame, model: Crf, text: str = "text") -> DataFrame:
    """``docs`` with ``words``: an array of (word, lang, score) for the words that have a letter, by their marginals.

    Null and letterless texts have no words; texts are read whole.  Other columns and repeated rows stay; a column
    ``words`` has the new one get underscores before its name.  Empty tables stay empty.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    word = T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())]))
    schema = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in docs.schema.fields], T.StructField(free_name(docs.columns, "words"), word)])
    all_names, at = schema.names, docs.columns.index(text)
    kind = pa.list_(pa.struct([("word", pa.string()), ("lang", pa.string()), ("score", pa.float64())]))

    def run(batches):
        tagger = Tagger(shared.value)
        names = tagger.model.languages
        for batch in batches:
            for start in range(0, batch.num_rows, 100):
                part = batch.slice(start, 100)
                split = [tokens((d or b"").decode()) for d in raw(part.column(at))]
                out = [[{"word": w, "lang": names[g.argmax()], "score": float(g.max())} for w, g in zip(words, gamma, strict=True)] for words, gamma in zip(split, tagger.tag(split), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, kind)], names=all_names)

    return docs.mapInArrow(run, schema)
