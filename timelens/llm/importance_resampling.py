"""Importance resampling of documents towards a target distribution, by hashed word n-grams.

Features are all runs of 1 to 3 consecutive words; each falls into one of 10000 buckets by its crc32. A bucket's gain is the scaled logarithm of
its smoothed share in the target over its share in all documents; a document's weight is the sum of its features' gains. Weights plus Gumbel
noise that a document's id decides are scores, and the documents with the highest scores are drawn: a sample without replacement in
proportion to the exponential of the weights.

Long texts are skewed work. A text of more than CHUNK bytes is cut at word boundaries into chunks that carry the next n - 1 words along; a
chunk owns the features that start at its own words, so every feature counts once. Chunks are dealt out over all tasks, and
their counts and weights are summed by document. What goes to all tasks are 10000 gains, at any size of input.

Defined results: null and empty texts have no features and weight 0; an empty target or corpus gives gains by the smoothing alone; rows
without a doc_id draw noise as for an empty id; repeated rows count each, and of rows that are alike each has a rank of its own; texts of
any length are taken whole; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timelens.llm.common import checkpoint, table, text_parts, worker_cache

GRAMS = 3
BUCKETS = 10_000
#: A hundredth part is drawn so many times.
PERCENT = 5
#: Words of a document that can be drawn.
LEAST_WORDS = 20
SEED = 42
#: Bytes of text in a chunk.
CHUNK = 65_536
#: Bytes of text held at once.
SLICE = 2_000_000
KEPT_WORDS = 50_000
#: Longer words are not kept.
KEPT_BYTES = 64

#: Fixed by the features' definition: A-Z are lower-cased; 0-9, a-z and all that isn't ASCII make words.
_PLAIN = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_PLAIN).split()


def _shift_tables() -> np.ndarray:
    """[j, k, b]: what byte b at place k of a crc32 becomes when 2^j zero bytes follow. The shift is linear over bits."""
    step = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)  # differences alone, free of the constant part
    one = np.empty((4, 256), np.uint32)
    for k in range(4):
        c = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
        one[k] = step[c & np.uint32(255)] ^ (c >> np.uint32(8))
    out = [one]
    for _ in range(31):
        out.append(_applied(out[-1], out[-1]))
    return np.array(out)


def _applied(t: np.ndarray, c: np.ndarray) -> np.ndarray:
    m = np.uint32(255)
    return t[0][c & m] ^ t[1][(c >> np.uint32(8)) & m] ^ t[2][(c >> np.uint32(16)) & m] ^ t[3][c >> np.uint32(24)]


_SHIFT = _shift_tables()


def joined_crc(a: np.ndarray, b: np.ndarray, b_bytes: np.ndarray) -> np.ndarray:
    """crc32 of texts set one after the other, from their crc32s and the second's number of bytes."""
    a = a.copy()
    for j in range(int(b_bytes.max(initial=0)).bit_length()):
        at = np.flatnonzero((b_bytes >> j) & 1)
        a[at] = _applied(_SHIFT[j], a[at])
    return a ^ b


class _WordCodes(dict):
    """crc32 of a word, and above it that of the word after a space."""

    def __missing__(self, word: bytes) -> int:
        code = zlib.crc32(word) | zlib.crc32(word, zlib.crc32(b" ")) << 32
        if len(word) <= KEPT_BYTES:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = code
        return code


def features(texts: list[list[bytes]], owned: list[int], codes: dict) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the features that start at each text's first ``owned`` words, and the number of the text that each belongs to."""
    sizes = np.array([len(t) for t in texts], np.int64)
    flat, n_words = list(itertools.chain.from_iterable(texts)), int(sizes.sum())
    code = np.fromiter(map(codes.__getitem__, flat), np.uint64, n_words)
    word, after, length = code.astype(np.uint32), (code >> np.uint64(32)).astype(np.uint32), np.fromiter(map(len, flat), np.int64, n_words) + 1
    text = np.repeat(np.arange(len(texts)), sizes)
    own = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < np.repeat(np.array(owned, np.int64), sizes)
    crc, buckets, of = word, [word[own] % BUCKETS], [text[own]]
    for n in range(1, GRAMS):
        crc = joined_crc(crc[: len(word) - n], after[n:], length[n:])
        whole = (text[: len(text) - n] == text[n:]) & own[: len(own) - n]
        buckets.append(crc[whole] % BUCKETS)
        of.append(text[: len(text) - n][whole])
    return np.concatenate(buckets), np.concatenate(of)


def chunked(text: str) -> Iterator[tuple[bytes, int]]:
    """Chunks of about CHUNK bytes that end between words, each with the next GRAMS - 1 words, and how many words it owns."""
    data = text.encode("utf-8", "surrogatepass").translate(_PLAIN)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + CHUNK)
        end = len(data) if end < 0 else end
        own = data[at:end].split()
        carried = [m.group() for m in itertools.islice(_WORD.finditer(data, end), GRAMS - 1)]
        if own:
            yield b" ".join(own + carried), len(own)
        at = end


def chunks(docs: DataFrame) -> DataFrame:
    """doc_id, digest (of the text), part, chunk (words, one space between) and owned (words): of each long text (doc_id, text), dealt out over all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("importance_resampling")
        for batch in batches:
            for at, text in enumerate(t for part in text_parts(batch.column(1), SLICE) for t in part):
                digest = xxhash.xxh3_128_hexdigest(text.encode("utf-8", "surrogatepass"))
                parts = list(chunked(text)) or [(b"", 0)]
                n = len(parts)
                key = batch.column(0).slice(at, 1).take(pa.array([0] * n))
                yield pa.RecordBatch.from_pydict({"doc_id": key, "digest": pa.array([digest] * n), "part": pa.array(range(n), pa.int64()), "chunk": pa.array([c for c, _ in parts], pa.binary()), "owned": pa.array([o for _, o in parts], pa.int64())})

    return docs.mapInArrow(run, "doc_id long, digest string, part long, chunk binary, owned long").repartition("doc_id", "digest", "part")


def _counted(parts: Iterable[tuple[list[list[bytes]], list[int]]]) -> Iterator[pa.RecordBatch]:
    """bucket and n, over all parts of a task."""
    codes = worker_cache("importance_resampling").setdefault("codes", _WordCodes())
    total = np.zeros(BUCKETS, np.int64)
    for texts, owned in parts:
        total += np.bincount(features(texts, owned, codes)[0], minlength=BUCKETS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int64()), "n": pa.array(total[at])})


def _weighed(texts: list[list[bytes]], owned: list[int], gains: np.ndarray) -> dict:
    codes = worker_cache("importance_resampling").setdefault("codes", _WordCodes())
    bucket, of = features(texts, owned, codes)
    weight = np.zeros(len(texts), np.int64)
    np.add.at(weight, of, gains[bucket])
    return {"n_words": pa.array(owned, pa.int64()), "n_features": pa.array(np.bincount(of, minlength=len(texts)).astype(np.int64)), "weight": pa.array(weight)}


def _whole(batch: pa.RecordBatch, column: int) -> Iterator[tuple[list[list[bytes]], list[int]]]:
    for part in text_parts(batch.column(column), SLICE):
        texts = [words_of(t) for t in part]
        yield texts, [len(t) for t in texts]


def _cut(batch: pa.RecordBatch, step: int = 16) -> Iterator[tuple[list[list[bytes]], list[int]]]:
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        yield [c.split() for c in part.column("chunk").to_pylist()], part.column("owned").to_pylist()


def bucket_counts(texts: DataFrame, long_chunks: DataFrame | None = None) -> DataFrame:
    """bucket and n (its features) over all texts, and over the chunks of long ones."""
    whole = texts.select("text").mapInArrow(lambda batches: _counted(p for b in batches for p in _whole(b, 0)), "bucket long, n long")
    if long_chunks is not None:
        whole = whole.union(long_chunks.select("chunk", "owned").mapInArrow(lambda batches: _counted(p for b in batches for p in _cut(b)), "bucket long, n long"))
    return whole.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains_of(corpus: dict[int, int], target: dict[int, int]) -> np.ndarray:
    """Each bucket's gain in thousandths, rounded down."""
    all_corpus, all_target = float(sum(corpus.values()) + BUCKETS), float(sum(target.values()) + BUCKETS)
    return np.array([math.floor(1000 * math.log((target.get(b, 0) + 1.0) * all_corpus / ((corpus.get(b, 0) + 1.0) * all_target))) for b in range(BUCKETS)], np.int64)


def weights(short: DataFrame, long_chunks: DataFrame, gains: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight of every document."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts, owned in _whole(batch, 1):
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(at, len(texts))} | _weighed(texts, owned, gains))
                at += len(texts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts, owned in _cut(batch):
                named = {f: batch.column(f).slice(at, len(texts)) for f in ("doc_id", "digest", "part")}
                yield pa.RecordBatch.from_pydict(named | _weighed(texts, owned, gains))
                at += len(texts)

    numbers = "n_words long, n_features long, weight long"
    direct = short.select("doc_id", "text").mapInArrow(whole, f"doc_id long, {numbers}")
    # rows alike in id and text have the same chunks, each as often as there are rows
    parts = long_chunks.mapInArrow(cut, f"doc_id long, digest string, part long, {numbers}")
    once = parts.groupBy("doc_id", "digest", "part").agg(F.count("*").alias("copies"), *[F.min(c).alias(c) for c in ("n_words", "n_features", "weight")])
    summed = once.groupBy("doc_id", "digest").agg(F.min("copies").alias("copies"), *[F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")])
    again = summed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return direct.union(again.select("doc_id", "n_words", "n_features", "weight"))


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down, decided by the id."""
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((drawn + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def ranked(scored: DataFrame, percent: int) -> DataFrame:
    """scored (doc_id, score, drawable, further columns) with rank 1, 2, 3... of the percentage of the drawable rows that is drawn; null for the rest.

    Only rows near the top are sorted: over ranges, numbered within each range and set after the rows of the ranges before. Equal rows are
    told apart by a number, so a range can't outgrow its share.
    """
    columns = [c for c in scored.columns if c != "drawable"]
    scored = checkpoint(scored.withColumn("_tie", F.monotonically_increasing_id()))
    top = F.percentile_approx("score", max(0.0, 1 - percent / 100 - 0.01), 10_000)  # within a ten-thousandth of the rows: all that are drawn lie above
    n, least = scored.filter("drawable").agg(F.count("*"), top).first()
    drawn = percent * n // 100
    if not drawn:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    near = F.col("drawable") & (F.col("score") >= F.lit(least))
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("_tie")]
    ranges = checkpoint(scored.filter(near).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = {r[0]: r[1] for r in ranges.groupBy("_range").count().collect()}  # one row for each partition
    first = dict(zip(sorted(sizes), itertools.accumulate((sizes[r] for r in sorted(sizes)), initial=0), strict=False))
    starts = scored.sparkSession.createDataFrame([(r, s) for r, s in first.items() if s < drawn], "_range int, _start long")
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + F.col("_start")
    rank = F.when(inside <= drawn, inside.cast("long"))
    placed = ranges.join(F.broadcast(starts), "_range").select(*columns, rank.alias("rank"))
    behind = ranges.join(F.broadcast(starts), "_range", "left_anti").select(*columns, F.lit(None).cast("long").alias("rank"))
    rest = scored.filter(~F.coalesce(near, F.lit(False))).select(*columns, F.lit(None).cast("long").alias("rank"))
    return placed.union(behind).union(rest)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """docs (doc_id, text) weighed towards the texts of target: doc_id, n_features, weight, score, rank (null where not drawn)."""
    docs = docs.select("doc_id", "text")
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    short = docs.filter(size <= CHUNK)
    long_chunks = checkpoint(chunks(docs.filter(size > CHUNK)))
    corpus = {r[0]: r[1] for r in bucket_counts(short, long_chunks).collect()}  # at most BUCKETS rows, as for the target
    wanted = {r[0]: r[1] for r in bucket_counts(target).collect()}
    weighed = weights(short, long_chunks, gains_of(corpus, wanted))
    scored = weighed.select("doc_id", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"), (F.col("n_words") >= least_words).alias("drawable"))
    return ranked(scored, percent)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_CRC_TABLE = "list_transform(range(0, 256), lambda b: list_reduce([b, 0, 1, 2, 3, 4, 5, 6, 7], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = f"""
WITH crc AS (SELECT {_CRC_TABLE} AS t), digits AS (SELECT map(list_transform(range(0, 256), lambda b: printf('%02X', b)), range(0, 256)) AS m),
texts AS (SELECT doc_id, true AS is_doc, {_LOWER} AS text FROM documents UNION ALL SELECT NULL, false, {_LOWER} FROM benchmark),
cut AS (SELECT row_number() OVER () AS row, doc_id, is_doc, list_filter(regexp_split_to_array(text, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS words FROM texts),
grams AS (
  SELECT row, is_doc, unnest(flatten(list_transform([1, 2, 3], lambda n: list_transform(range(1, len(words) - n + 2), lambda i: array_to_string(words[i:i + n - 1], ' '))))) AS gram FROM cut
), counted AS (SELECT row, is_doc, gram, count(*) AS n FROM grams GROUP BY ALL),
known AS (
  SELECT gram, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, strlen(gram)), lambda i: m[substr(hex(encode(gram)), 2 * i + 1, 2)])), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket
  FROM (SELECT DISTINCT gram FROM counted), crc, digits
), placed AS (SELECT row, is_doc, bucket, sum(n) AS n FROM counted JOIN known USING (gram) GROUP BY ALL),
buckets AS (SELECT bucket, coalesce(sum(n) FILTER (is_doc), 0) AS s, coalesce(sum(n) FILTER (NOT is_doc), 0) AS t FROM placed GROUP BY 1),
totals AS (SELECT sum(s) AS all_s, sum(t) AS all_t FROM buckets),
gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (all_s + {BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * (all_t + {BUCKETS})::DOUBLE)))::BIGINT AS gain FROM buckets, totals),
sums AS (SELECT row, sum(n) AS n_features, sum(n * gain) AS weight FROM placed JOIN gains USING (bucket) WHERE is_doc GROUP BY 1),
scored AS (
  SELECT doc_id, len(words) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5)::DOUBLE / 4294967296::DOUBLE))))::BIGINT AS score
  FROM cut LEFT JOIN sums USING (row) WHERE is_doc
), drawn AS (
  SELECT *, CASE WHEN n_words >= {LEAST_WORDS} THEN row_number() OVER (PARTITION BY n_words >= {LEAST_WORDS} ORDER BY score DESC, doc_id) END AS place, count(*) FILTER (n_words >= {LEAST_WORDS}) OVER () AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {PERCENT} * n // 100 THEN place END AS rank FROM drawn
"""
