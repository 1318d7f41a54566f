"""Language identification by a linear-chain conditional random field over words.

Each word has features: its affixes, the n-grams of its bytes, and its entries in lexicons learned for each language. Learned
transitions join neighbouring words; forward-backward gives each word a distribution over languages, so text that switches language is
labelled word by word. A text's language is the one with the largest share of its letters' weight, and the score is that share.

The field is fitted on at most SAMPLE documents for each language, chosen by a hash over all rows given, none longer than
SAMPLE_CHARS, and on at most TRAIN_WORDS of their words; training sequences are spliced from spans of them, so that switches occur.
Every text is one chain, whatever its length: the messages between pieces of PIECE words are products of the pieces'
transfer matrices, so the pieces are labelled side by side without a cut.

Defined results: a null text, and one without a letter, is ``und`` with score 0; without any labelled rows every text is
``und``; ties go to the language first in order; repeated rows are labelled alike, row by row; further columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timelens.llm.common import bounded_sample, bucket_of, table, text_parts, worker_cache

SAMPLE, SAMPLE_CHARS = 120, 20_000
#: Words of training text for each language.
TRAIN_WORDS = 40_000
FEATURES = 1 << 17
#: Words of a training chain, and of the pieces in which a text's chain is computed.
CHAIN, PIECE = 128, 64
EPOCHS, RATE, DECAY = 30, 0.3, 1e-4
LEXICON_LEAST, LEXICON_SHARE = 2, 0.8
#: Bytes of text labelled at once, words whose features are made at once, words whose scores a Python worker keeps.
SLICE, FRESH, KEPT_WORDS = 500_000, 5_000, 60_000

UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").split()


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words: ids, and the index of the word that each belongs to, in order."""
    joined = np.frombuffer(b" " + b" ".join(words) + b"   ", np.uint8).astype(np.int64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]) + 1
    ends = starts + lengths
    owner = np.repeat(np.arange(len(words)), lengths + 1)
    at = np.arange(len(owner))
    a, b, c = joined[at], joined[at + 1], joined[at + 2]
    # a bigram starts at the space before a word or at one of its bytes; a trigram's middle byte is never a space
    pair = ((a << 8) | b) * 2654435761 + 97
    triple = ((a << 16) | (b << 8) | c) * 2246822519 + 193
    ids, owners = [pair, triple[b != 32]], [owner, owner[b != 32]]
    every = np.arange(len(words))
    for n in (2, 3, 4):
        long = lengths >= n
        head = tail = np.zeros(int(long.sum()), np.int64)
        for k in range(n):
            head = (head << 8) | joined[starts[long] + k]
            tail = (tail << 8) | joined[ends[long] - n + k]
        ids += [head * 3266489917 + 389 * n, tail * 668265263 + 769 * n]
        owners += [every[long], every[long]]
    ids_all, owner_all = np.concatenate(ids), np.concatenate(owners)
    ids_all = (ids_all ^ (ids_all >> 29)) % FEATURES
    order = np.argsort(owner_all, kind="stable")
    return ids_all[order], owner_all[order]


class Field:
    """Weights of a fitted field: features by language, lexicon entries, transitions."""

    def __init__(self, langs: list[str], weights: np.ndarray, lexicon: dict[bytes, int], lexicon_weights: np.ndarray, moves: np.ndarray):
        self.langs, self.weights, self.lexicon, self.lexicon_weights, self.moves = langs, weights, lexicon, lexicon_weights, moves

    def emissions(self, words: list[bytes]) -> np.ndarray:
        """A score for each word and language."""
        if not words:
            return np.zeros((0, len(self.langs)), np.float32)
        ids, owner = word_features(words)
        first = np.searchsorted(owner, np.arange(len(words)))
        out = np.add.reduceat(self.weights[ids], first, axis=0)
        known = np.fromiter((self.lexicon.get(w, -1) for w in words), np.int64, len(words))
        out[known >= 0] += self.lexicon_weights[known[known >= 0]]
        return out


def forward_backward(emissions: np.ndarray, moves: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of words [chains, steps, languages] and expected moves, for chains that fill the first lengths steps."""
    n, steps, k = emissions.shape
    table_ = np.exp(moves - moves.max()).astype(emissions.dtype)
    local = np.exp(emissions - emissions.max(axis=2, keepdims=True))
    forward = np.empty_like(local)
    backward = np.ones_like(local)
    forward[:, 0] = local[:, 0] / local[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, steps):
        x = (forward[:, t - 1] @ table_) * local[:, t]
        forward[:, t] = x / x.sum(axis=1, keepdims=True)
    expected = np.zeros((k, k))
    for t in range(steps - 2, -1, -1):
        x = local[:, t + 1] * backward[:, t + 1]
        inside = (t + 1 < lengths)[:, None]
        y = x @ table_.T
        backward[:, t] = np.where(inside, y / y.sum(axis=1, keepdims=True), 1.0)
        both = forward[:, t, :, None] * table_[None] * x[:, None, :]
        both /= both.sum(axis=(1, 2), keepdims=True)
        expected += (both * inside[:, :, None]).sum(axis=0)
    marginals = forward * backward
    marginals /= marginals.sum(axis=2, keepdims=True)
    return marginals, expected


def word_marginals(emissions: np.ndarray, moves: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Marginals of all words of chains that stand one after another; counts are the chains' words, 1 at least.

    Each chain is taken in pieces. What reaches a piece from either side is found from the transfer matrices of the others; then forward and
    backward messages run through all pieces side by side.
    """
    k = emissions.shape[1]
    table_ = np.exp(moves - moves.max()).astype(np.float32)
    local = np.exp(emissions - emissions.max(axis=1, keepdims=True)).astype(np.float32)
    number = -(-counts // PIECE)
    chain = np.repeat(np.arange(len(counts)), number)
    nth = np.arange(len(chain)) - np.repeat(np.cumsum(number) - number, number)
    first = (np.cumsum(counts) - counts)[chain] + nth * PIECE
    lengths = np.minimum(PIECE, counts[chain] - nth * PIECE)

    # longest pieces first, so that those with more than t words are the first ones
    order = np.argsort(-lengths, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    first, lengths, opens = first[order], lengths[order], (nth == 0)[order]
    steps = int(lengths.max())
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")

    into, back = np.ones((len(order), k), np.float32), np.ones((len(order), k), np.float32)
    if len(order) > len(counts):
        carry = np.where(opens[:, None, None], np.eye(k, dtype=np.float32)[None], table_[None]) * local[first][:, None, :]
        for t in range(1, steps):
            m = active[t]
            x = (carry[:m].reshape(-1, k) @ table_).reshape(-1, k, k) * local[first[:m] + t][:, None, :]
            carry[:m] = x / x.max(axis=(1, 2), keepdims=True)
        by_chain = np.argsort(-number, kind="stable")
        start = (np.cumsum(number) - number)[by_chain]
        with_more = np.searchsorted(-number[by_chain], -np.arange(int(number.max())), side="left")
        for j in range(1, int(number.max())):
            at, before = place[start[: with_more[j]] + j], place[start[: with_more[j]] + j - 1]
            x = np.einsum("ni,nij->nj", into[before], carry[before])
            into[at] = x / x.sum(axis=1, keepdims=True)
        for j in range(int(number.max()) - 1, 0, -1):
            at, before = place[start[: with_more[j]] + j], place[start[: with_more[j]] + j - 1]
            x = np.einsum("nij,nj->ni", carry[at], back[at])
            back[before] = x / x.sum(axis=1, keepdims=True)

    forward = np.empty_like(local)
    state = np.where(opens[:, None], 1.0, into @ table_).astype(np.float32) * local[first]
    forward[first] = state = state / state.sum(axis=1, keepdims=True)
    for t in range(1, steps):
        at = first[: active[t]] + t
        x = (state[: active[t]] @ table_) * local[at]
        state = x / x.sum(axis=1, keepdims=True)
        forward[at] = state
    forward[first + lengths - 1] *= back
    for t in range(steps - 2, -1, -1):
        m = active[t + 1]
        at = first[:m] + t
        x = (local[at + 1] * back[:m]) @ table_.T
        back[:m] = x / x.sum(axis=1, keepdims=True)
        forward[at] *= back[:m]
    return forward / forward.sum(axis=1, keepdims=True)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Field | None:
    """Fit the field on labelled documents (doc_id, text, lang)."""
    usable = docs.filter((F.length("text") > 0) & (F.length("text") <= SAMPLE_CHARS) & F.col("lang").isNotNull())
    rows = bounded_sample(usable, "lang", "doc_id", sample, ["lang", "text"])
    rng = np.random.default_rng(17)
    langs = sorted({r["lang"] for r in rows})
    texts: list[list[list[bytes]]] = [[] for _ in langs]
    for i, lang in enumerate(langs):
        n = 0
        for words in (words_of(r["text"]) for r in rows if r["lang"] == lang):
            if n < TRAIN_WORDS and words and any(_LETTER.search(w.decode("utf-8", "replace")) for w in words):
                texts[i].append(words)
                n += len(words)
    texts, langs = [t for t in texts if t], [lang for t, lang in zip(texts, langs, strict=True) if t]
    if not langs:
        return None
    seen: dict[bytes, Counter] = {}
    for i, docs_ in enumerate(texts):
        for w in {(n, w) for n, words in enumerate(docs_) for w in words}:
            seen.setdefault(w[1], Counter())[i] += 1
    lexicon = {w: c.most_common(1)[0][0] for w, c in seen.items() if sum(c.values()) >= LEXICON_LEAST and c.most_common(1)[0][1] >= LEXICON_SHARE * sum(c.values())}

    # chains spliced from spans: most stay in one language, some switch
    spans = [(i, words[a : a + step]) for i, docs_ in enumerate(texts) for words in docs_ for step in [int(rng.integers(16, 64))] for a in range(0, len(words), step)]
    rng.shuffle(spans)
    by_lang: dict[int, list] = {}
    for span in spans:
        by_lang.setdefault(span[0], []).append(span)
    flow, at = [], {i: 0 for i in by_lang}
    current = 0
    for _ in range(len(spans)):
        left = [i for i in by_lang if at[i] < len(by_lang[i])]
        if current not in left or rng.random() < 0.25:
            current = int(rng.choice(left))
        flow.append(by_lang[current][at[current]])
        at[current] += 1
    words = [w for _, ws in flow for w in ws]
    truth = np.repeat([i for i, _ in flow], [len(ws) for _, ws in flow])
    chains = -(-len(words) // CHAIN)
    k = len(langs)
    distinct = {w: n for n, w in enumerate(dict.fromkeys(words))}
    which = np.fromiter((distinct[w] for w in words), np.int64, len(words))
    ids, owner = word_features(list(distinct))
    first = np.searchsorted(owner, np.arange(len(distinct)))
    known = np.fromiter((lexicon.get(w, -1) for w in distinct), np.int64, len(distinct))
    # a lexicon entry is left out half the time, so that affixes and n-grams carry weight of their own
    weights, lexical, moves = np.zeros((FEATURES, k)), np.zeros((k, k)), np.zeros((k, k))
    sums = [np.full_like(x, 1e-6) for x in (weights, lexical, moves)]
    lengths = np.full(chains, CHAIN)
    lengths[-1] = len(words) - CHAIN * (chains - 1)
    padded = np.zeros(chains * CHAIN, np.int64)
    padded[: len(words)] = which
    inside = np.arange(chains * CHAIN) < len(words)
    gold = np.zeros((chains * CHAIN, k))
    gold[np.arange(len(words)), truth] = 1
    labels = np.full(chains * CHAIN, -1)
    labels[: len(words)] = truth
    pairs = labels.reshape(chains, CHAIN)
    kept = pairs[:, 1:] >= 0
    gold_moves = np.zeros((k, k))
    np.add.at(gold_moves, (pairs[:, :-1][kept], pairs[:, 1:][kept]), 1)
    for _ in range(EPOCHS):
        use = (known >= 0) & (rng.random(len(known)) < 0.5)
        e = np.add.reduceat(weights[ids], first, axis=0)
        e[use] += lexical[known[use]]
        marginals, expected = forward_backward(e[padded].reshape(chains, CHAIN, k), moves, lengths)
        error = (gold - marginals.reshape(-1, k)) * inside[:, None]
        by_word = np.stack([np.bincount(padded, error[:, j], len(distinct)) for j in range(k)], axis=1)
        spread = by_word[owner]
        step_w = np.stack([np.bincount(ids, spread[:, j], FEATURES) for j in range(k)], axis=1) / len(words) - DECAY * weights
        step_l = np.stack([np.bincount(known[use], by_word[use, j], k) for j in range(k)], axis=1) / len(words) - DECAY * lexical
        step_m = (gold_moves - expected) / len(words) - DECAY * moves
        for x, step, total in zip((weights, lexical, moves), (step_w, step_l, step_m), sums, strict=True):
            total += step * step
            x += RATE * step / np.sqrt(total)
    return Field(langs, weights.astype(np.float32), lexicon, lexical.astype(np.float32), moves.astype(np.float32))


class Labeller:
    """Labels texts by a field; keeps the scores of words between texts."""

    def __init__(self, field: Field):
        self.field = field
        self._forget()

    def _forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.emissions = np.empty((0, len(self.field.langs)), np.float32)
        self.letters = np.empty(0, np.float32)

    def _look_up(self, words: list[bytes]) -> np.ndarray:
        index = self.index
        known = len(index)
        ids = np.fromiter([index.setdefault(w, len(index)) for w in words], np.int64, len(words))
        fresh = list(index)[known:] if len(index) > known else []
        for at in range(0, len(fresh), FRESH):
            part = fresh[at : at + FRESH]
            self.emissions = np.concatenate([self.emissions, self.field.emissions(part)])
            letters = np.fromiter((len(w) if w.isalpha() else len(_LETTER.findall(w.decode("utf-8", "replace"))) for w in part), np.float32, len(part))
            self.letters = np.concatenate([self.letters, letters])
        return ids

    def label_texts(self, texts: list[str]) -> list[tuple[str, float]]:
        """Language and score of each text."""
        out: list[tuple[str, float]] = [(UNDETERMINED, 0.0)] * len(texts)
        if len(self.index) > KEPT_WORDS:
            self._forget()
        flat: list[bytes] = []
        counts, which = [], []
        for i, text in enumerate(texts):
            if text and _LETTER.search(text):
                words = words_of(text)
                which.append(i)
                counts.append(len(words))
                flat += words
        if not which:
            return out
        ids, counts_ = self._look_up(flat), np.array(counts)
        marginals = word_marginals(self.emissions[ids], self.field.moves, counts_) * self.letters[ids][:, None]
        sums = np.add.reduceat(marginals, np.cumsum(counts_) - counts_, axis=0, dtype=np.float64)
        totals = sums.sum(axis=1)
        for i, j, top, total in zip(which, sums.argmax(axis=1), sums.max(axis=1), totals, strict=True):
            out[i] = (self.field.langs[j], float(min(1.0, top / total)) if total > 0 else 0.0)
        return out


def label_texts(field: Field, texts: list[str]) -> list[tuple[str, float]]:
    return Labeller(field).label_texts(texts)


def label_words(field: Field, text: str) -> list[tuple[str, str]]:
    """Each word of a text with its language, for text that switches between languages."""
    words = words_of(text)
    if not words:
        return []
    best = word_marginals(field.emissions(words), field.moves, np.array([len(words)])).argmax(axis=1)
    return [(w.decode("utf-8", "replace"), field.langs[j]) for w, j in zip(words, best, strict=True)]


def predict(docs: DataFrame, field: Field | None, language: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with a language and a score for every row; docs has a text, and other columns stay, but for any of the two new names."""
    docs = docs.drop(language, score)
    held = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, field))
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, model = held.value
        cache = worker_cache("language_id")
        if key not in cache:
            cache.clear()
            cache[key] = None if model is None else Labeller(model)
        labeller = cache[key]
        for batch in batches:
            found: list[tuple[str, float]] = []
            for part in text_parts(batch.column(at), SLICE):
                found += [(UNDETERMINED, 0.0)] * len(part) if labeller is None else labeller.label_texts(part)
            columns = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*names, language, score])

    schema = T.StructType([*docs.schema.fields, T.StructField(language, T.StringType()), T.StructField(score, T.DoubleType())])
    return docs.mapInArrow(run, schema)


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows with a language that aren't held out."""
    return docs.filter(F.col("lang").isNotNull() & (bucket_of("doc_id", 4) != 2)).select("doc_id", "text", "lang")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = fit(training_rows(docs))
    return predict(docs.select("doc_id", "text"), field).select("doc_id", (bucket_of("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
