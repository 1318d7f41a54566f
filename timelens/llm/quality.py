"""Quality classifier by compression.

Two zstandard dictionaries are built from good and bad labelled texts. A text is cut into blocks, all of which are compressed with
either dictionary; the difference of the two sizes, as a share of the text's bytes, is calibrated to a probability by logistic
regression on labelled texts that the dictionaries haven't seen.

The model is fitted on at most SAMPLE rows for each label, chosen by a hash over all labelled rows that aren't held out;
longer texts than SAMPLE_BYTES aren't chosen, and of several texts of one document the first in order. Every text is scored whole.

Defined results: a null text counts as empty; an empty text scores as the calibration says for a difference of 0; without labels
of both kinds every score is the share of label 1 among those there are, or 0.5 without any; repeated rows score alike; a
document with several labels counts once for each; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timelens.llm.common import bounded_sample, bucket_of, table, text_parts, worker_cache

SAMPLE, SAMPLE_BYTES = 1500, 65_536
#: Bytes that are compressed at once: a dictionary counts most at a block's start.
BLOCK = 2048
DICTIONARY_BYTES, LEVEL = 65_536, 3
#: Bytes of text held at once.
SLICE = 4_000_000


def build_dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary, or the last texts themselves where there are too few to train on."""
    blocks = [t[i : i + BLOCK] for t in texts for i in range(0, len(t), BLOCK)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, blocks).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"\n".join(texts)[-DICTIONARY_BYTES:]


class Sizes:
    """Compressed sizes of a text under the two dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.by = [self._compressor(d) for d in (good, bad)]

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        dictionary = zstandard.ZstdCompressionDict(content)
        dictionary.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=False, write_content_size=False, write_dict_id=False)

    def difference(self, text: bytes) -> float:
        """Size with the bad dictionary less size with the good one, as a share of the bytes; 0 for an empty text."""
        if not text:
            return 0.0
        good = bad = 0
        for i in range(0, len(text), BLOCK):
            block = text[i : i + BLOCK]
            good += len(self.by[0].compress(block))
            bad += len(self.by[1].compress(block))
        return (bad - good) / len(text)


def sizes(good: bytes, bad: bytes) -> Sizes:
    """The compressors, made once in each Python worker."""
    made = worker_cache("quality")
    key = hashlib.sha256(good + b"|" + bad).hexdigest()
    if key not in made:
        made[key] = Sizes(good, bad)
    return made[key]


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


def calibrate(xs: list[float], ys: list[int], steps: int = 60, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and intercept of a logistic regression, by Newton's method on standardised x."""
    n = len(xs)
    mean = sum(xs) / n
    scale = math.sqrt(sum((x - mean) ** 2 for x in xs) / n) or 1.0
    a = b = 0.0
    for _ in range(steps):
        ga = gb = haa = hab = hbb = 0.0
        for x, y in zip(xs, ys, strict=True):
            z = (x - mean) / scale
            p = sigmoid(a * z + b)
            w = p * (1 - p)
            ga += (y - p) * z
            gb += y - p
            haa += w * z * z
            hab += w * z
            hbb += w
        ga -= ridge * n * a
        haa += ridge * n
        hbb += 1e-6
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        limit = max(1.0, abs(da), abs(db))
        a, b = a + da / limit, b + db / limit
        if abs(da) + abs(db) < 1e-9:
            break
    return a / scale, b - a * mean / scale


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """The model: dictionaries and calibration. docs (doc_id, text), labels (doc_id, quality) without held-out rows."""
    known = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)")
    chosen = bounded_sample(known, "quality", "doc_id", sample, ["doc_id", "quality"])
    # at most 2 * sample rows, so the list may be broadcast
    picked = docs.sparkSession.createDataFrame([(r["doc_id"], r["quality"]) for r in chosen], "doc_id long, quality int")
    rows = docs.join(F.broadcast(picked), "doc_id").filter((F.octet_length("text") > 0) & (F.octet_length("text") <= SAMPLE_BYTES)).groupBy("doc_id", "quality").agg(F.min("text").alias("text")).collect()
    texts: dict[int, list[bytes]] = {0: [], 1: []}
    for r in sorted((r["doc_id"], r["text"], r["quality"]) for r in rows):
        texts[r[2]].append(r[1].encode())
    n0, n1 = (known.filter(F.col("quality") == k).count() for k in (0, 1))
    if min(map(len, texts.values())) < 2:
        return {"share": n1 / (n0 + n1) if n0 + n1 else 0.5}
    # every second text builds the dictionaries, the others calibrate them; their weights follow all labelled rows
    good, bad = build_dictionary(texts[1][::2]), build_dictionary(texts[0][::2])
    by = Sizes(good, bad)
    xs = [by.difference(t) for k in (0, 1) for t in texts[k][1::2]]
    ys = [k for k in (0, 1) for _ in texts[k][1::2]]
    slope, intercept = calibrate(xs, ys)
    shift = math.log((n1 / n0) / (sum(ys) / (len(ys) - sum(ys))))
    return {"good": good, "bad": bad, "slope": slope, "intercept": intercept + shift}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and score of every row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        by = None if "share" in m else sizes(m["good"], m["bad"])
        for batch in batches:
            texts = (t for part in text_parts(batch.column(1), SLICE) for t in part)
            scores = [m["share"] if by is None else sigmoid(m["slope"] * by.difference(t.encode("utf-8", "surrogatepass")) + m["intercept"]) for t in texts]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "score": pa.array(scores, pa.float64())})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = fit(docs, labels.filter(bucket_of("doc_id", 3) != 1))
    return score(docs, model).select("doc_id", (bucket_of("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
