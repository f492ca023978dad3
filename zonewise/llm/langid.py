"""Language identification with a byte convolutional network, trained and applied in numpy.

A text is cut into fixed-length windows of bytes that overlap by the widest filter less one, so no
filter position is lost. Bytes are embedded, filters of several widths slide over them, each filter's
maximum over the window goes to a softmax layer. A text's distribution is the mean of its windows',
weighted by their bytes. Windows of many texts make one batch of matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import LOWER, U64, Slice, mix, owner, powers, text_slices
from .sampling import bucket_of, share_of
from .store import bound_batches, col, fold_of

FOLDS = 5
#: Bounds of the training sample: documents, and windows drawn from them.
MAX_DOCS, MAX_WINDOWS = 4_000, 16_000
WINDOW, EMBED = 256, 6
#: Filters of each width in bytes.
FILTERS = {2: 8, 3: 12, 4: 14, 5: 14}
WIDEST = max(FILTERS)
EPOCHS, BATCH, RATE = 3, 128, 0.01
#: Windows in one matrix product when predicting.
PREDICT_BATCH = 96
UNDETERMINED = "und"

#: A-Z as a-z, digits as 0, control characters as a space. 0 is the padding.
SYMBOL = LOWER.copy()
SYMBOL[0x30:0x3A] = 0x30
SYMBOL[:0x20] = 0x20


def windows_of(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of a slice's texts as symbols padded with 0, the bytes in each, and of each text the index of its first window."""
    size = np.diff(part.offs)
    stride = WINDOW - WIDEST + 1
    many = np.where(size == 0, 0, 1 + np.maximum(0, -(-(size - WINDOW) // stride)))
    bounds = np.concatenate([[0], np.cumsum(many)])
    doc = np.repeat(np.arange(part.n), many)
    start = (np.arange(bounds[-1]) - bounds[doc]) * stride
    left = np.minimum(WINDOW, size[doc] - start)
    padded = np.concatenate([SYMBOL[part.buf], np.zeros(WINDOW, dtype=np.uint8)])
    made = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[start + part.offs[doc]].copy() if len(doc) else np.zeros((0, WINDOW), dtype=np.uint8)
    made[np.arange(WINDOW) >= left[:, None]] = 0
    return made, left, bounds


class ByteCNN:
    def __init__(self, langs: list[str], seed: int = 7):
        self.langs = langs
        rng = np.random.default_rng(seed)
        n = sum(FILTERS.values())
        self.embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.embed[0] = 0
        self.filters = rng.normal(0, 0.25, (WIDEST * EMBED, n)).astype(np.float32)
        # a narrower filter is a widest one whose further bytes count nothing
        self.mask = np.zeros_like(self.filters)
        at = 0
        for width, many in FILTERS.items():
            self.mask[: width * EMBED, at : at + many] = 1
            at += many
        self.filters *= self.mask
        self.bias = np.zeros(n, dtype=np.float32)
        self.dense = rng.normal(0, 0.1, (n, len(langs))).astype(np.float32)
        self.offset = np.zeros(len(langs), dtype=np.float32)

    def columns(self, symbols: np.ndarray) -> np.ndarray:
        """Of each window and position the embedded bytes under the widest filter: (windows, positions, WIDEST * EMBED)."""
        embedded = self.embed[symbols]
        positions = WINDOW - WIDEST + 1
        out = np.empty((len(symbols), positions, WIDEST * EMBED), dtype=np.float32)
        for k in range(WIDEST):
            out[:, :, k * EMBED : (k + 1) * EMBED] = embedded[:, k : k + positions]
        return out

    def pooled(self, columns: np.ndarray) -> np.ndarray:
        n, positions, width = columns.shape
        return (columns.reshape(-1, width) @ self.filters).reshape(n, positions, -1)

    def probabilities(self, symbols: np.ndarray) -> np.ndarray:
        out = np.empty((len(symbols), len(self.langs)), dtype=np.float32)
        for i in range(0, len(symbols), PREDICT_BATCH):
            best = self.pooled(self.columns(symbols[i : i + PREDICT_BATCH])).max(axis=1) + self.bias
            out[i : i + PREDICT_BATCH] = softmax(np.maximum(best, 0) @ self.dense + self.offset)
        return out

    def fit(self, symbols: np.ndarray, label: np.ndarray, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        names = ("embed", "filters", "bias", "dense", "offset")
        first = {n: np.zeros_like(getattr(self, n)) for n in names}
        second = {n: np.zeros_like(getattr(self, n)) for n in names}
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(symbols))
            for i in range(0, len(order), BATCH):
                step += 1
                for name, slope in self._slopes(symbols[order[i : i + BATCH]], label[order[i : i + BATCH]]).items():
                    first[name] += 0.1 * (slope - first[name])
                    second[name] += 0.01 * (slope * slope - second[name])
                    change = RATE * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-7)
                    setattr(self, name, (getattr(self, name) - change).astype(np.float32))

    def _slopes(self, symbols: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        n = len(symbols)
        columns = self.columns(symbols)
        maps = self.pooled(columns)
        where = maps.argmax(axis=1)
        best = np.take_along_axis(maps, where[:, None], axis=1)[:, 0] + self.bias
        active = np.maximum(best, 0)
        error = softmax(active @ self.dense + self.offset)
        error[np.arange(n), label] -= 1
        error /= n
        back = (error @ self.dense.T) * (best > 0)
        # only the position of its maximum moves a filter
        under = columns[np.arange(n)[:, None], where]
        filters = np.einsum("nf,nfk->kf", back, under, optimize=True) * self.mask
        to_columns = (back[:, :, None] * self.filters.T[None]).reshape(n, -1, WIDEST, EMBED)
        touched = symbols[np.arange(n)[:, None, None], where[:, :, None] + np.arange(WIDEST)]
        embed = np.zeros_like(self.embed)
        np.add.at(embed, touched.reshape(-1), to_columns.reshape(-1, EMBED))
        embed[0] = 0
        return {"embed": embed, "filters": filters, "bias": back.sum(axis=0), "dense": active.T @ error, "offset": error.sum(axis=0)}

    def texts(self, batch: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of each text the language's number and its probability; an empty text gets -1."""
        which, score = [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
        for part in text_slices(batch):
            symbols, size, bounds = windows_of(part)
            made = self.probabilities(symbols) * size[:, None]
            sums = np.concatenate([np.zeros((1, made.shape[1])), np.cumsum(made, axis=0, dtype=np.float64)])
            mean = (sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(1, np.diff(part.offs))[:, None]
            mean /= np.maximum(1e-12, mean.sum(axis=1, keepdims=True))
            which.append(np.where(np.diff(bounds) > 0, mean.argmax(axis=1), -1))
            score.append(mean.max(axis=1))
        return np.concatenate(which), np.concatenate(score)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def cut_windows(each: int):
    """A mapInArrow function from rows (l, t) to (l, place, symbols): at most ``each`` windows of a text, chosen by a hash of their bytes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch.column("t")):
                made, _, bounds = windows_of(part)
                place = np.concatenate([np.zeros(0, np.uint64), *(((made[i : i + 1024].astype(np.uint64) + U64(1)) * powers()[0][:WINDOW]).sum(axis=1) for i in range(0, len(made), 1024))])
                place = mix(place + np.arange(len(made), dtype=np.uint64))
                doc = owner(bounds)
                order = np.lexsort((place, doc))
                some = np.sort(order[np.arange(len(order)) - bounds[doc] < each])
                langs = batch.column("l").slice(part.first, part.n).take(pa.array(doc[some]))
                yield pa.RecordBatch.from_arrays([langs, pa.array(place[some].view(np.int64)), pa.array([w.tobytes() for w in made[some]], pa.binary())], ["l", "place", "symbols"])

    return cut


def learn(windows: pa.Table) -> ByteCNN | None:
    """A network for the languages of windows (l, place, symbols), which are put in a fixed order; None without any."""
    if not len(windows):
        return None
    rows = windows.sort_by([(c, "ascending") for c in ("l", "place", "symbols")])
    langs = rows.column("l").to_pylist()
    names = sorted(set(langs))
    number = {x: i for i, x in enumerate(names)}
    model = ByteCNN(names)
    model.fit(np.frombuffer(b"".join(rows.column("symbols").to_pylist()), dtype=np.uint8).reshape(-1, WINDOW), np.array([number[x] for x in langs]))
    return model


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ByteCNN | None:
    """Learns from about MAX_DOCS ids at most, as many of each language, that have a letter and are not held out.

    Of several rows of one id the one with the least hash counts. Texts are cut in the executors; the
    driver gets the drawn windows, about MAX_WINDOWS of WINDOW bytes, whatever the texts' lengths.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    known = docs.select(col(id_col).alias("id"), col(text_col).alias("t"), col(lang_col).cast("string").alias("l")).filter("l IS NOT NULL AND t IS NOT NULL").filter(fold_of("id", FOLDS) != 0)
    rows = {r.l: r["count"] for r in known.groupBy("l").count().collect()}
    if not rows:
        return None
    each = max(1, MAX_DOCS // len(rows))
    shares = spark.createDataFrame([(lang, share_of(n, each)) for lang, n in rows.items()], "l string, share bigint")
    sample = known.join(F.broadcast(shares), "l").filter(bucket_of(F.col("id")) < F.col("share")).filter(F.col("t").rlike(r"\p{L}"))
    one = F.min(F.struct(F.xxhash64("l", "t").alias("h"), "l", "t")).alias("m")
    sample = sample.groupBy("id").agg(one).select("m.l", "m.t")
    per_text = max(1, MAX_WINDOWS // sum(min(n, each) for n in rows.values()))
    return learn(sample.mapInArrow(cut_windows(per_text), "l string, place bigint, symbols binary").toArrow())


def predict_languages(docs: DataFrame, model: ByteCNN | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, lang_pred, score.

    A null text, one without a letter, and every text if no language was learned, gets ``und`` with
    score 0. A null id counts as the empty one, which is held out.
    """

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def predict(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = pa.array([*model.langs, UNDETERMINED]) if model else None
        for batch in texts:
            which, score = model.texts(batch)
            yield pa.StructArray.from_arrays([names.take(pa.array(np.where(which < 0, len(model.langs), which))), pa.array(np.where(which < 0, 0, score), pa.float64())], ["lang_pred", "score"])

    held = (fold_of("id", FOLDS) == 0).alias("held_out")
    chosen = docs.select(col(id_col).alias("id"), col(text_col).alias("t"))
    if not model:
        return chosen.select(F.col("id").alias(id_col), held, F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    made = chosen.select("id", F.coalesce(F.col("t").rlike(r"\p{L}"), F.lit(False)).alias("lettered"), predict("t").alias("p"))
    return made.select(
        F.col("id").alias(id_col), held,
        F.when(F.col("lettered"), F.col("p.lang_pred")).otherwise(UNDETERMINED).alias("lang_pred"),
        F.when(F.col("lettered"), F.col("p.score")).otherwise(0.0).alias("score"),
    )
