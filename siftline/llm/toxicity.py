"""Toxicity by compression distance: two zstandard dictionaries, one trained on toxic and one on ordinary text.

Training, on a bounded sample of labelled rows (`sample_rows`, the rows of
smallest hash). zstandard's trainer keeps the segments that its samples repeat
most, which in whole toxic documents are those of any text. So its samples are,
of each toxic document, the stretches of `GRAM` bytes from a space on that toxic
documents hold far more often than ordinary ones (log-likelihood ratio of at
least `LEAST_G2`); those of the ordinary dictionary are windows of ordinary
documents without such stretches. Both dictionaries end alike, with the ordinary one's content. The
sample is read and counted by tasks: what comes to the driver is at most
`MOST_GRAMS` stretches, their lists for each toxic document, `ORDINARY_WINDOWS`
windows and a few numbers for each row, whatever the texts' lengths.

Scoring: a text in lower case, white space folded, is cut at spaces into
windows of at most `WINDOW` bytes. Each is compressed with either dictionary
between two marks that both hold, so a window is never stored raw, its last
bytes are searched too, and literals stay below the size from which they are
entropy coded; lengths then differ by the matches alone. A window hits if the
toxic dictionary saves at least a calibrated number of bytes. A logistic
model, fitted on the same sample, turns the number and the share of hits into
a score from 0 to 1.

Defined cases: a null text counts as empty, and an empty text gets the score
of a text without hits; labels that are null or not 0 or 1 are ignored, a
document labelled both ways counts as toxic; a labelled id with several texts
is learnt from the smallest of them; without labels of both classes, or where
no stretch tells the classes apart, every score is 0; null ids pass through,
repeated rows give repeated results, an empty table gives no rows; other
columns are ignored. Whole texts are scored, in windows, whatever their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import bounded_batches, id_and_text, written

GRAM, WINDOW, LEAST_G2, LEAST_DOCS = 6, 60, 20.0, 3
MOST_GRAMS, ORDINARY_WINDOWS = 1000, 20_000
#: for each dictionary: most bytes, the trainer's segments, and the strings that it counts
TOXIC, ORDINARY = (4096, 48, GRAM), (512, 32, 8)
#: savings in bytes from which a window may count as a hit
LEAST_SAVED = range(1, 7)
#: marks around each window: bytes that UTF-8 text doesn't hold in this order
_BEFORE, _AFTER = bytes(range(128, 144)), bytes(range(144, 160))


def folded(text: str) -> bytes:
    return f" {' '.join(text.lower().split())} ".encode("utf-8", "replace")


def windows(data: bytes) -> Iterator[bytes]:
    """Cut before the last space that fits; without one, after WINDOW bytes."""
    at, n = 0, len(data)
    while n - at > WINDOW:
        cut = data.rfind(b" ", at + 1, at + WINDOW)
        cut = at + WINDOW if cut < 0 else cut
        yield data[at:cut]
        at = cut
    if data[at:].strip():
        yield data[at:]


def grams(data: bytes) -> set[bytes]:
    """The different stretches of GRAM bytes from a space on."""
    return {data[m.start() : m.start() + GRAM] for m in re.finditer(b" ", data) if len(data) - m.start() >= GRAM}


def telling(counts: list[tuple[bytes, int, int]], n_toxic: int, n_ordinary: int) -> list[bytes]:
    """Of stretches with the toxic and the ordinary documents that hold them, those that tell the classes apart, the best MOST_GRAMS."""
    counts = sorted(c for c in counts if c[1] >= LEAST_DOCS)
    if not counts:
        return []
    a, b = (np.array([c[i] for c in counts], float) for i in (1, 2))
    part = lambda x, e: np.where(x > 0, x * np.log(np.maximum(x, 1) / e), 0)
    n = n_toxic + n_ordinary
    g2 = 2 * (part(a, n_toxic * (a + b) / n) + part(b, n_ordinary * (a + b) / n))
    can = [i for i in np.argsort(-g2, kind="stable").tolist() if g2[i] >= LEAST_G2 and a[i] / n_toxic > 2 * b[i] / n_ordinary]
    return sorted(counts[i][0] for i in can[:MOST_GRAMS])


def samples_of(data: bytes, known: set[bytes]) -> list[bytes]:
    """What the trainer is given of a toxic document: the telling stretches that it holds, if any."""
    held = sorted(grams(data) & known)
    return [b"\n".join(held) + b"\n"] if held else []


def _trained(samples: list[bytes], size: int, segment: int, counted: int) -> bytes:
    """A dictionary of zstandard's own trainer, from samples in an order of chance, as it picks along them. It refuses few samples, so few are said several times."""
    ordered, total = sorted(samples), sum(map(len, samples))
    samples = [ordered[i] for i in np.random.default_rng(3).permutation(len(ordered))]
    return zstandard.train_dictionary(size, samples * max(1, -(-8 * size // max(1, total)), -(-16 // len(samples))), k=segment, d=counted).as_bytes()


def dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """The toxic and the ordinary dictionary's content, trained on samples of either class."""
    if not toxic or not ordinary:
        return b"", b""
    tail = _trained(ordinary, *ORDINARY) + _BEFORE + _AFTER
    return _trained(toxic, *TOXIC) + tail, tail


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters(
        compression_level=3, strategy=zstandard.STRATEGY_GREEDY, min_match=GRAM, search_log=4, hash_log=13, chain_log=13, window_log=15,
        format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    held.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=how)


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    least: int = 1
    weights: tuple[float, ...] = ()

    def saved(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """Bytes that the toxic dictionary saves, for each window of each text."""
        with_toxic, with_ordinary = _compressor(self.toxic).compress, _compressor(self.ordinary).compress
        for text in texts:
            yield np.array([len(with_ordinary(w)) - len(with_toxic(w)) for w in (_BEFORE + x + _AFTER for x in windows(folded(text)))], int)

    def features(self, hits: int, n: int) -> list[float]:
        return [1.0, float(hits > 0), float(np.log1p(hits)), hits / max(1, n), float(np.log1p(n))]

    def scores(self, texts: Iterable[str]) -> Iterator[float]:
        if not self.weights:
            yield from (0.0 for _ in texts)
            return
        for saved in self.saved(texts):
            x = self.features(int((saved >= self.least).sum()), len(saved))
            yield float(1 / (1 + np.exp(-np.clip(np.dot(x, self.weights), -30, 30))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Newton's method; the intercept isn't penalised."""
    w, keep = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    keep[0] = 1e-6
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep + 1e-9), x.T @ (y - p) - keep * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _loss(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    z = np.clip(x @ w, -30, 30)
    return float((np.log1p(np.exp(z)) - y * z).sum())


def calibrated(model: Model, rows: list[tuple[int, int, list[int]]]) -> Model:
    """The model with the least saving and the weights that fit best; `rows`: label, windows, and hits at each of LEAST_SAVED."""
    y, best = np.array([r[0] for r in rows], float), None
    for i, least in enumerate(LEAST_SAVED):
        x = np.array([model.features(r[2][i], r[1]) for r in rows])
        w = _logistic(x, y)
        if best is None or _loss(x, y, w) < best[0]:
            best = _loss(x, y, w), least, tuple(float(v) for v in w)
    return Model(model.toxic, model.ordinary, *best[1:])


def held_out(doc_id: str, folds: int = 5) -> Column:
    """Whether a document is in the fold that is never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 6000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fits on at most `sample_rows` labelled documents outside the held-out fold, those with the smallest hashes of their ids."""
    known = labels.select(labels[id_col].alias("doc_id"), labels[label_col].alias("y")).filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    ids = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # at most sample_rows ids, so the broadcast is bounded; a repeated document counts once
    texts = id_and_text(docs, id_col, text_col).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    sample = written(texts.select(F.col("y").cast("int").alias("y"), "text"), "labelled")
    bounded_batches(docs.sparkSession)
    n = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return Model(b"", b"")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held = sorted(grams(folded(text)))
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary()), pa.array([y] * len(held), pa.int32())], names=["gram", "y"])

    held = sample.mapInArrow(counted, "gram binary, y int").groupBy("gram").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    # the same bounds as in `telling`, so that few counts leave the tasks
    held = held.filter((F.col("a") >= LEAST_DOCS) & (F.col("a") * n[0] > 2 * F.col("b") * n[1]))
    chosen = telling([(bytes(r["gram"]), r["a"], r["b"]) for r in held.collect()], n[1], n[0])
    if not chosen:
        return Model(b"", b"")

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = set(chosen)
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = folded(text)
                of = samples_of(data, known) if y else [w for w in windows(data) if known.isdisjoint(grams(w))]
                yield pa.RecordBatch.from_arrays([pa.array([y] * len(of), pa.int32()), pa.array(of, pa.binary())], names=["y", "sample"])

    samples = sample.mapInArrow(sampled, "y int, sample binary")
    toxic = [bytes(r["sample"]) for r in samples.filter("y = 1").collect()]
    few = samples.filter("y = 0").orderBy(F.xxhash64("sample"), "sample").limit(ORDINARY_WINDOWS)
    model = Model(*dictionaries(toxic, [bytes(r["sample"]) for r in few.collect()]))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            saved = list(model.saved(batch.column(1).to_pylist()))
            hits = pa.array([[int((s >= least).sum()) for least in LEAST_SAVED] for s in saved], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in saved], pa.int64()), hits], names=["y", "n", "hits"])

    rows = sample.mapInArrow(measured, "y int, n bigint, hits array<bigint>").collect()
    return calibrated(model, sorted((r["y"], r["n"], list(r["hits"])) for r in rows))


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, score, predicted."""
    bounded_batches(docs.sparkSession)
    narrow = id_and_text(docs, id_col, text_col)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.fromiter(model.scores(batch.column(1).to_pylist()), float, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype("int32"))], names=["doc_id", "score", "predicted"])

    return narrow.mapInArrow(scored, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def kept(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, that the model doesn't call toxic."""
    bounded_batches(docs.sparkSession)
    at, text_at = docs.schema, docs.columns.index(text_col)

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.fromiter(model.scores(t or "" for t in batch.column(text_at).to_pylist()), float, batch.num_rows)
            yield batch.filter(pa.array(s < 0.5))

    return docs.mapInArrow(passed, at)
