"""Benchmark decontamination by latent semantic retrieval.

1. The benchmark is taken in groups of passages of at most GROUP_WORDS words, so what is broadcast has a fixed bound; one group is the
   usual case. A further group takes two further passes over the documents.
2. Document frequencies of a group's words come from one pass over all documents: exact counts, added up before the shuffle.
3. The group's TF-IDF matrix has its rows made on the executors. A randomised SVD with one power iteration gives the latent space: the
   products with the matrix run over its rows, and the driver holds factors of RANK + OVERSAMPLE columns for the group's words and passages.
4. A document can only leak a passage if words of at least PARAPHRASE of the passage's weight stand in it, as step 6 asks for that. The
   words that hold the passage's weight but for REST are its keys, and the sum over keys found shows which passages are possible. This
   loses nothing: a longest common subsequence weighs no more than the words that both have.
5. A document with a possible passage is cut into windows of two STRIDEs. A window is a candidate where its cosine with the passage, in
   the latent space, reaches the passage's least one. What the space doesn't hold of either is added at its bound (the product
   of the two residuals' norms), so no cosine is lost to the rank; where that bound decides, the exact cosine is taken. Words that no
   passage of the group has count for nothing.
6. Candidates are verified by a longest common subsequence, weighted by inverse document frequency, between the passage and the text around
   them: as many words as the passage has to either side. It is a leak where that holds SHARE of the passage's weight, or
   PARAPHRASE of it and the answer (the passage's last sentence, at least its last quarter) at ANSWER.

A window holds little of a long passage, so the least cosine is lower for it (PassageIndex.least). Documents of any length are searched whole.

Defined results: null and empty texts leak nothing; empty or null passages are no passages; repeated rows are judged alike, row by row;
equal passages are all reported; an empty benchmark or table gives no leaks; further columns stay as they are, but for one
that has the new column's name, which goes.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timelens.llm.common import checkpoint, table, text_parts, worker_cache

#: Words of the passages of a group; a longer passage is a group of its own.
GROUP_WORDS = 300_000
RANK, OVERSAMPLE = 256, 16
STRIDE = 16
COSINE, SHARE, PARAPHRASE, ANSWER = 0.2, 0.6, 0.45, 0.8
#: Share of a passage's weight that its keys leave out; residual under which a passage's latent coordinates are exact.
REST, EXACT = 0.2, 1e-3
#: Bytes of text held at once; windows projected, and cosines held, at once.
SLICE, WINDOWS, CELLS = 1_000_000, 1024, 4_000_000

_BREAKS = bytes.maketrans(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\x00\x1c\x1d\x1e\x1f", b" " * 37)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_BREAKS).split()


def document_frequencies(docs: DataFrame, vocabulary: frozenset[bytes]) -> tuple[int, dict[bytes, int]]:
    """Number of rows, and in how many of them each word of the vocabulary stands. A task gives a row for each of its words at most."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("decontaminate")
        counts, n, known = Counter(), 0, held.value
        for batch in batches:
            for part in text_parts(batch.column(0), SLICE):
                for text in part:
                    counts.update(known.intersection(words_of(text)))
            n += batch.num_rows
        yield pa.RecordBatch.from_pydict({"word": pa.array([*counts, None], pa.binary()), "n": pa.array([*counts.values(), n], pa.int64())})

    rows = docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    held.unpersist()
    counts = {None if r["word"] is None else bytes(r["word"]): r["n"] for r in rows}
    return counts.pop(None, 0), counts


def answer_of(text: str) -> int:
    """Words in a passage's answer: its last sentence, at least its last quarter."""
    sentences = [s for s in re.split(r"[.!?]\s+", text.strip()) if words_of(s)]
    n = len(words_of(text))
    return min(n, max(len(words_of(sentences[-1])) if sentences else 0, -(-n // 4)))


def randomised_svd(matrix: DataFrame, height: int, width: int, rank: int = RANK) -> np.ndarray:
    """Right singular vectors [width, rank] of sparse rows (row, at, x), by a range finder with one power iteration."""
    k = min(height, width, rank + OVERSAMPLE)
    context = matrix.sparkSession.sparkContext

    def times(right: np.ndarray) -> np.ndarray:
        """The matrix times right [width, k]."""
        held = context.broadcast(right)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                y = [(np.array(x) @ held.value[np.array(at, np.int64)]).tolist() for at, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"row": b.column(0), "y": pa.array(y, pa.list_(pa.float64()))})

        out = np.zeros((height, k))
        for r in matrix.mapInArrow(run, "row int, y array<double>").toLocalIterator():
            out[r["row"]] = r["y"]
        held.unpersist()
        return out

    def transposed(left: np.ndarray) -> np.ndarray:
        """The matrix, transposed, times left [height, k]."""
        held = context.broadcast(left)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for b in batches:
                for i, at, x in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                    for j, v in zip(at, x, strict=True):
                        total[j] = total.get(j, 0.0) + v * held.value[i]
            yield pa.RecordBatch.from_pydict({"at": pa.array(list(total), pa.int32()), "y": pa.array([t.tolist() for t in total.values()], pa.list_(pa.float64()))})

        out = np.zeros((width, k))
        for r in matrix.mapInArrow(run, "at int, y array<double>").toLocalIterator():
            out[r["at"]] += r["y"]
        held.unpersist()
        return out

    sketch = np.random.default_rng(23).standard_normal((width, k))
    q = np.linalg.qr(times(sketch))[0]
    z = np.linalg.qr(transposed(q))[0]
    q = np.linalg.qr(times(z))[0]
    u, s, _ = np.linalg.svd(transposed(q), full_matrices=False)
    return u[:, : min(rank, int((s > 1e-9).sum()) or 1)].astype(np.float32)


class PassageIndex:
    """A group of passages: words, weights, latent coordinates, and the keys that tell which passages a document may leak."""

    def __init__(self, passages: list[tuple], n: int, counts: dict[bytes, int]):
        self.ids = [p[0] for p in passages]
        self.answers = [answer_of(p[1]) for p in passages]
        self.row: dict[bytes, int] = {}
        self.words = [np.array([self.row.setdefault(w, len(self.row)) for w in words_of(p[1])], np.int32) for p in passages]
        self.idf = np.log1p(n / (1.0 + np.array([counts.get(w, 0) for w in self.row], np.float64)))
        self.total = np.array([self.idf[w].sum() for w in self.words])
        self.least = np.array([self._least(w) for w in self.words])
        self.keys: dict[bytes, list[tuple[int, float]]] = {}
        self.need: list[float] = []
        names = list(self.row)
        for item, ws in enumerate(self.words):
            rows, times = np.unique(ws, return_counts=True)
            weight = self.idf[rows] * times
            order = np.lexsort((rows, -self.idf[rows]))
            upto = np.cumsum(weight[order])
            # keys: up to the first with which no more than REST is left out
            many = int(np.searchsorted(upto, (1 - REST) * self.total[item])) + 1
            for j in order[:many]:
                self.keys.setdefault(names[rows[j]], []).append((item, float(weight[j])))
            self.need.append(float(PARAPHRASE * self.total[item] - (self.total[item] - upto[min(many, len(upto)) - 1]) - 1e-6 * self.total[item]))
        self.key_words = frozenset(self.keys)

    def _least(self, ws: np.ndarray) -> float:
        """Least cosine of a candidate: COSINE, or less where PARAPHRASE of the passage, spread over windows like its own, may stay under it.

        The windows' products with the passage add up to PARAPHRASE of its squared norm, so one has this cosine at least.
        """
        squares = self.idf[ws] ** 2
        windows = np.sqrt(np.add.reduceat(squares, np.arange(0, len(ws), 2 * STRIDE))).sum()
        return min(COSINE, PARAPHRASE * float(np.sqrt(squares.sum()) / (windows or 1.0)))

    def place(self, basis: np.ndarray) -> None:
        """Put the passages into the latent space."""
        self.basis = basis
        out, norms = [], []
        for ws in self.words:
            rows, times = np.unique(ws, return_counts=True)
            x = self.idf[rows] * times
            norms.append(np.linalg.norm(x) or 1.0)
            out.append((x @ basis[rows]) / norms[-1])
        self.norm = np.array(norms)
        # for words of a passage or of a text; unknown words of a text are -1, the last place
        self.scratch, self.present = np.zeros(len(self.row)), np.zeros(len(self.row) + 1, bool)
        self.coordinates = np.array(out, np.float32)
        self.residual = np.sqrt(np.maximum(0.0, 1.0 - (self.coordinates.astype(np.float64) ** 2).sum(axis=1)))

    def possible(self, words: list[bytes]) -> list[int]:
        """Passages of which enough weight stands among the words."""
        found = self.key_words.intersection(words)
        if not found:
            return []
        weight: dict[int, float] = {}
        for w in found:
            for item, x in self.keys[w]:
                weight[item] = weight.get(item, 0.0) + x
        need = self.need
        return sorted(item for item, x in weight.items() if x >= need[item])

    def leaks(self, words: list[bytes], items: list[int]) -> list[tuple]:
        """Leaks of the items in a text, given by its words: (item_id, share, cosine)."""
        rows = np.fromiter((self.row.get(w, -1) for w in words), np.int64, len(words))
        windows, out = -(-len(words) // STRIDE), []
        together = max(1, CELLS // windows)
        for part in (items[i : i + together] for i in range(0, len(items), together)):
            cosines = np.concatenate([self._cosines(rows, a, part) for a in range(0, windows, WINDOWS)])
            for n, item in enumerate(part):
                at = np.flatnonzero(cosines[:, n] >= self.least[item])
                if len(at) and (found := self._verified(rows, item, at, cosines[at, n])):
                    out.append((self.ids[item], *found))
        return out

    def _cosines(self, rows: np.ndarray, first: int, items: list[int]) -> np.ndarray:
        """Cosines [windows, items] of WINDOWS windows that reach an item's least one, else 0; a window is two strides of words."""
        inside = rows[first * STRIDE : (first + WINDOWS + 1) * STRIDE]
        number = min(WINDOWS, -(-(len(rows) - first * STRIDE) // STRIDE))
        known = np.flatnonzero(inside >= 0)
        stride, width = known // STRIDE, len(self.idf)
        # a word stands in the windows that begin with its own stride and with the one before
        pairs = np.concatenate([stride * width + inside[known], (stride - 1) * width + inside[known]])
        pairs, times = np.unique(pairs[(pairs >= 0) & (pairs < number * width)], return_counts=True)
        window, row = pairs // width, pairs % width
        x = self.idf[row] * times
        norm = np.sqrt(np.bincount(window, x * x, number))
        y = np.zeros((number, self.basis.shape[1]))
        if len(window):
            begin = np.flatnonzero(np.r_[True, window[1:] != window[:-1]])
            y[window[begin]] = np.add.reduceat(x.astype(np.float32)[:, None] * self.basis[row], begin, axis=0)
        y /= np.where(norm > 0, norm, 1.0)[:, None]
        rest = np.sqrt(np.maximum(0.0, 1.0 - (y * y).sum(axis=1)))
        latent = y @ self.coordinates[items].T
        upper = latent + rest[:, None] * self.residual[items][None]
        reached = (norm[:, None] > 0) & (upper >= self.least[items][None])
        for n, item in enumerate(items):
            if self.residual[item] > EXACT and reached[:, n].any():
                self.scratch[self.words[item]] = 0.0
                np.add.at(self.scratch, self.words[item], self.idf[self.words[item]])
                latent[:, n] = np.bincount(window, x * self.scratch[row], number) / np.where(norm > 0, norm, 1.0) / self.norm[item]
                self.scratch[self.words[item]] = 0.0
                reached[:, n] &= latent[:, n] >= self.least[item]
        return np.where(reached, latent, 0.0)

    def _verified(self, rows: np.ndarray, item: int, at: np.ndarray, cosine: np.ndarray) -> tuple[float, float] | None:
        """Share and cosine where the text around one of the windows passes; nearby windows of a long passage are tried together."""
        n = len(self.words[item])
        apart = max(1, n // (2 * STRIDE))
        groups: dict[int, list[int]] = {}
        for i in np.argsort(-cosine, kind="stable"):
            groups.setdefault(int(at[i]) // apart, []).append(i)
        for members in groups.values():
            windows = at[members]
            around = rows[max(0, windows.min() * STRIDE - n) : (windows.max() + 2) * STRIDE + n]
            share = self._share(item, around)
            if share:
                return round(share, 6), round(min(1.0, float(cosine[members[0]])), 6)
        return None

    def _share(self, item: int, around: np.ndarray) -> float:
        """Share of the passage's weight in the text around a window, where it is a leak, else 0."""
        passage, total = self.words[item], self.total[item]
        weights = self.idf[passage]
        self.present[around] = True
        shared = weights[self.present[passage]].sum()
        self.present[around] = False
        if shared < PARAPHRASE * total:
            return 0.0
        share = weighted_lcs(passage.tolist(), around.tolist(), weights) / total
        if share >= SHARE:
            return share
        k = self.answers[item]
        if share >= PARAPHRASE and weighted_lcs(passage[-k:].tolist(), around.tolist(), weights[-k:]) >= ANSWER * weights[-k:].sum():
            return share
        return 0.0


def passage_groups(benchmark: DataFrame) -> Iterator[list[tuple]]:
    """The passages (item_id, text) that hold words, in groups."""
    part, size = [], 0
    for r in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        n = len(words_of(r["text"]))
        if part and size + n > GROUP_WORDS:
            yield part
            part, size = [], 0
        if n:
            part.append((r["item_id"], r["text"]))
            size += n
    if part:
        yield part


def make_index(docs: DataFrame, passages: list[tuple]) -> PassageIndex:
    """A group's index, with the frequencies of its words in docs."""
    spark = docs.sparkSession
    n, counts = document_frequencies(docs, frozenset(w for _, t in passages for w in words_of(t)))
    index = PassageIndex(passages, n, counts)
    held = spark.sparkContext.broadcast((index.row, index.idf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, idf = held.value
        for b in batches:
            at, xs = [], []
            for text in b.column(1).to_pylist():
                rows, times = np.unique(np.array([row[w] for w in words_of(text)], np.int32), return_counts=True)
                x = idf[rows] * times
                at.append(rows.tolist())
                xs.append((x / (np.linalg.norm(x) or 1.0)).tolist())
            yield pa.RecordBatch.from_pydict({"row": b.column(0), "at": pa.array(at, pa.list_(pa.int32())), "x": pa.array(xs, pa.list_(pa.float64()))})

    texts = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(passages)], "row int, text string").repartition(min(64, 1 + len(passages) // 256))
    matrix = checkpoint(texts.mapInArrow(run, "row int, at array<int>, x array<double>"))
    index.place(randomised_svd(matrix, len(passages), len(index.row)))
    held.unpersist()
    return index


def weighted_lcs(a: list, b: list, weights: np.ndarray) -> float:
    """Largest weight of a common subsequence of a (with weights) and b."""
    places: dict[object, list[int]] = {}
    for j, w in enumerate(b):
        places.setdefault(w, []).append(j)
    best = np.zeros(len(b) + 1)
    for w, x in zip(a, weights, strict=True):
        if at := places.get(w):
            at_ = np.array(at)
            fresh = best.copy()
            fresh[at_ + 1] = np.maximum(fresh[at_ + 1], best[at_] + x)
            best = np.maximum.accumulate(fresh)
    return float(best[-1])


LEAKS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("share", T.DoubleType()), T.StructField("cosine", T.DoubleType())]))
_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("share", pa.float64()), ("cosine", pa.float64())]))


def find_leaks(docs: DataFrame, benchmark: DataFrame, leaks: str = "leaks") -> DataFrame:
    """docs with one more column: the passages found in each row's text."""
    docs = docs.drop(leaks)
    names, at = docs.columns, docs.columns.index("text")
    found, groups = docs.withColumn(leaks, F.array().cast(LEAKS)), 0
    for passages in passage_groups(benchmark):
        if groups:
            found = checkpoint(found)  # a group's passages are live in one pass only
        groups += 1
        held = docs.sparkSession.sparkContext.broadcast(make_index(docs, passages))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            worker_cache("decontaminate")
            index = held.value
            for batch in batches:
                fresh: list[list[dict]] = []
                for part in text_parts(batch.column(at), SLICE):
                    for text in part:
                        words = words_of(text)
                        items = index.possible(words)
                        found_ = index.leaks(words, items) if items else []
                        fresh.append([dict(zip(("item_id", "share", "cosine"), x, strict=True)) for x in found_])
                every = [(b or []) + xs for b, xs in zip(batch.column(len(names)).to_pylist(), fresh, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(every, _ARROW)], names=[*names, leaks])

        found = found.mapInArrow(run, found.schema)
    return found


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks: a row for each document and passage found in it."""
    found = find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.item_id", F.col("leak.share").alias("lcs_share"), F.col("leak.cosine").alias("cosine"))
