"""Quality classifier: a factorisation machine over hashed words, structure
statistics and metadata.

score = sigmoid(b + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); the pairwise
part is evaluated in time linear in the features by
1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2].

Features: each distinct word bucket of a text with x = sqrt(count / words), and
one indicator for the bin of each structure statistic and of the metadata
column ``n_chars``. Bins are quantiles of the training rows. Labels, lang,
source and doc_id are not features.

Training reads the labelled rows that the hold-out rule admits, at most
``train_rows`` of them (those with the smallest hash of their id); that bound
is the only one. Their features, of bounded size, go to the driver, where the
machine is fitted in numpy (Adagrad, log loss).

Defined cases: null, empty or blank text has its structure bins only and is
scored like any other; with no labelled row, or one label only, the score is
the smoothed share of label 1; null labels are skipped; several labels of one
document each count; repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm import bytewords as bw
from mnemospark.llm import nativetext as nt
from mnemospark.llm.ppm import held_out

BUCKETS = 1 << 14
BINS = 8
STATS = ("words", "word_bytes", "symbols", "upper", "digits", "stops", "repeats", "line_bytes", "same_lines", "n_chars")


def _lookup(chars: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(chars)] = True
    return table


_SYMBOL, _UPPER, _DIGIT, _STOP = _lookup(b"#*$%&|<>{}[]~^@\\/=+_"), _lookup(bytes(range(65, 91))), _lookup(bytes(range(48, 58))), _lookup(b".!?,;:")


def _per_row(flag: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flag)))
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _repeat_share(keys: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Share of a row's keys that equal another key of the row."""
    if not len(keys):
        return np.zeros(rows)
    both = bw.mix(keys.view(np.uint64) + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, inverse, count = np.unique(both, return_inverse=True, return_counts=True)
    total = np.bincount(row, minlength=rows)
    return bw.per_row(count[inverse] > 1, row, rows) / np.maximum(total, 1)


def features(column, n_chars: np.ndarray):
    """Yields (rows, stats, word row, word bucket, word x) for slices of a text column.

    Word features are sorted by row; a row's x squared add up to 1.
    """
    for lo, hi, raw, offsets in bw.slices(column):
        rows = hi - lo
        size = np.maximum(np.diff(offsets), 1)
        start, end, row = bw.spans(raw, offsets)
        n = np.bincount(row, minlength=rows)
        words = np.maximum(n, 1)
        keys = bw.word_hash(bw.LOWER[raw], start, end)
        brk = raw == 10
        edge = np.flatnonzero(brk)
        at = np.sort(np.concatenate([offsets[:-1], edge + 1])) if len(raw) else np.zeros(0, np.int64)
        stop = np.concatenate([at[1:], [len(raw)]]) if len(at) else at
        stop = stop - (brk[np.maximum(stop - 1, 0)] & (stop > at)) if len(at) else stop  # without the line end
        full = stop > at
        line_row = np.searchsorted(offsets, at[full], side="right") - 1
        lines = bw.word_hash(raw, at[full], stop[full]) if full.any() else np.zeros(0, np.int64)
        n_lines = np.bincount(line_row, minlength=rows)
        stats = np.stack(
            [
                np.log1p(n),
                bw.per_row((end - start).astype(float), row, rows) / words,
                _per_row(_SYMBOL[raw], offsets) / size,
                _per_row(_UPPER[raw], offsets) / size,
                _per_row(_DIGIT[raw], offsets) / size,
                _per_row(_STOP[raw], offsets) / words,
                _repeat_share(keys, row, rows),
                np.log1p(np.diff(offsets) / np.maximum(n_lines, 1)),
                _repeat_share(lines, line_row, rows),
                np.log1p(n_chars[lo:hi]),
            ],
            axis=1,
        )
        cell, count = bw.counted(row * BUCKETS + (keys.view(np.uint64) >> np.uint64(50)).astype(np.int64)) if len(keys) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        yield rows, stats, cell // BUCKETS, cell % BUCKETS, np.sqrt(count / words[cell // BUCKETS])


class FactorisationMachine:
    """The first ``BUCKETS`` features are words, the rest bins of the statistics."""

    def __init__(self, edges: np.ndarray, rank: int = 6, seed: int = 9):
        self.edges = edges  # (statistic, BINS - 1)
        self.b = 0.0
        self.w = np.zeros(BUCKETS + len(edges) * BINS)
        self.v = np.random.default_rng(seed).normal(scale=0.05, size=(len(self.w), rank))

    def bins(self, stats: np.ndarray) -> np.ndarray:
        """Feature number of each row's bin of each statistic."""
        return np.stack([BUCKETS + j * BINS + np.searchsorted(self.edges[j], stats[:, j], side="right") for j in range(len(self.edges))], axis=1)

    def logits(self, rows: int, stats: np.ndarray, row: np.ndarray, bucket: np.ndarray, x: np.ndarray) -> np.ndarray:
        bins = self.bins(stats)
        out = self.b + self.w[bins].sum(1) + bw.per_row(self.w[bucket] * x, row, rows)
        for f in range(self.v.shape[1]):
            v = self.v[:, f]
            linear = v[bins].sum(1) + bw.per_row(v[bucket] * x, row, rows)
            square = (v[bins] ** 2).sum(1) + bw.per_row((v[bucket] * x) ** 2, row, rows)
            out += 0.5 * (linear**2 - square)
        return out

    def probabilities(self, *features) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(*features), -30, 30)))

    def fit(self, stats: np.ndarray, words: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, epochs: int = 12, rate: float = 0.1, decay: float = 2e-4, seed: int = 4) -> None:
        """words: (buckets, x) of each row."""
        rng = np.random.default_rng(seed)
        bins = self.bins(stats)
        self.b = float(np.log((label.sum() + 1) / (len(label) - label.sum() + 1)))
        gw, gv = np.full(self.w.shape, 1e-2), np.full(self.v.shape, 1e-2)
        for _ in range(epochs):
            for i in rng.permutation(len(label)):
                at, x = np.concatenate([bins[i], words[i][0]]), np.concatenate([np.ones(bins.shape[1]), words[i][1]])
                v = self.v[at]
                linear = x @ v
                z = self.b + self.w[at] @ x + 0.5 * (linear @ linear - ((v * x[:, None]) ** 2).sum())
                error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[i]
                dw = error * x + decay * self.w[at]
                dv = error * x[:, None] * (linear[None, :] - v * x[:, None]) + decay * v
                gw[at] += dw**2
                gv[at] += dv**2
                self.w[at] -= rate * dw / np.sqrt(gw[at])
                self.v[at] -= 0.3 * rate * dv / np.sqrt(gv[at])
                self.b -= 0.01 * error


class Constant:
    """Stands in where there is nothing to learn from."""

    def __init__(self, p: float):
        self.p = p

    def probabilities(self, rows: int, *_) -> np.ndarray:
        return np.full(rows, self.p)


def _chars(batch) -> np.ndarray:
    return np.maximum(batch.column("n_chars").fill_null(0).to_numpy(zero_copy_only=False).astype(float), 0)


def _train_rows(batches):
    schema = pa.schema([("stats", pa.list_(pa.float64())), ("bucket", pa.list_(pa.int32())), ("x", pa.list_(pa.float32()))])
    for batch in batches:
        for rows, stats, row, bucket, x in features(batch.column("text"), _chars(batch)):
            at = np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(stats.tolist(), schema.field("stats").type), pa.ListArray.from_arrays(pa.array(at), pa.array(bucket.astype(np.int32))), pa.ListArray.from_arrays(pa.array(at), pa.array(x.astype(np.float32)))],
                schema=schema,
            )


def train(docs: DataFrame, labels: DataFrame, modulus: int, remainder: int, train_rows: int) -> FactorisationMachine | Constant:
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id", modulus, remainder)).select("doc_id", "quality")
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(train_rows)
    drawn = some.collect()  # at most train_rows pairs of numbers
    if len({r[1] for r in drawn}) < 2:
        ones = sum(r[1] for r in drawn)
        return Constant((ones + 1) / (len(drawn) + 2))
    of: dict = {}
    for doc, quality in drawn:
        of.setdefault(doc, []).append(quality)
    rows = docs.where(F.col("doc_id").isin(list(of))).select("doc_id", nt.row_key().alias("row"), "text", "n_chars")

    def featured(batches):
        for batch in batches:
            at = 0
            for part in _train_rows([batch]):
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(at, part.num_rows) for c in ("doc_id", "row")], *part.columns], names=["doc_id", "row", *part.schema.names])
                at += part.num_rows

    got = rows.mapInArrow(bw.tidy(featured), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, row long, stats array<double>, bucket array<int>, x array<float>")
    # ids that many rows share are cut off, in the order of a hash of id and text, at four rows each on average
    got = got.orderBy(F.xxhash64("doc_id", "row"), "doc_id", "row").limit(4 * len(of)).toArrow()
    ids, keys = got.column("doc_id").to_pylist(), got.column("row").to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i], keys[i]))
    stats = np.array(got.column("stats").to_pylist(), dtype=float).reshape(len(ids), len(STATS))
    bucket, x = got.column("bucket").combine_chunks(), got.column("x").combine_chunks()
    which = [(i, q) for i in order for q in of[ids[i]]]
    if len({q for _, q in which}) < 2:
        return Constant((sum(q for _, q in which) + 1) / (len(which) + 2))
    edges = np.stack([np.quantile(stats[:, j], np.arange(1, BINS) / BINS) for j in range(len(STATS))])
    model = FactorisationMachine(edges)
    model.fit(stats[[i for i, _ in which]], [(bucket[i].values.to_numpy(), x[i].values.to_numpy().astype(float)) for i, _ in which], np.array([q for _, q in which], dtype=float))
    return model


def _score(model, kind: pa.DataType):
    schema = pa.schema([("doc_id", kind), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches):
        for batch in batches:
            p = [model.probabilities(*f) for f in features(batch.column("text"), _chars(batch))]
            p = np.concatenate(p) if p else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], schema=schema)

    return run


def classify(docs: DataFrame, labels: DataFrame, modulus: int = 3, remainder: int = 1, train_rows: int = 4000) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    from pyspark.sql.pandas.types import to_arrow_type

    bw.bounded_batches(docs.sparkSession)
    model = train(docs, labels, modulus, remainder, train_rows)
    kind = docs.schema["doc_id"].dataType
    given = docs.select("doc_id", "text", "n_chars", held_out("doc_id", modulus, remainder).alias("held_out"))
    return given.mapInArrow(bw.tidy(_score(model, to_arrow_type(kind))), f"doc_id {kind.simpleString()}, held_out boolean, score double, predicted int")
