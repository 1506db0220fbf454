"""Language ID by a bidirectional gated recurrent network over bytes.

The network is written and trained here in numpy (backpropagation through
time, Adam). Both directions run over a whole text, state carried from the
first byte to the last and back, and every byte, white space included, gets a
label distribution; a document's distribution is the mean over all its bytes.

Texts run side by side in lanes, ``BATCH`` bytes at a time: a lane is a row of
texts one after the other, with a fresh state where a text begins. A text above ``SEGMENT`` bytes runs alone: a first pass ahead keeps the state at each
segment's start, then segments are labelled from the last to the first, so
memory is bounded by the segment and the result is that of one run.

Training takes excerpts of at most ``sample_rows`` labelled documents, shared
out evenly over the languages (those with the smallest hash of id and text;
``EXCERPTS`` stretches of ``EXCERPT`` characters of each, at places given by
that hash), and ``steps`` batches; that bound is the only one. Prediction reads
nothing but the text, all of it.

Defined cases: null text or text without a letter is ``und`` with score 0; with
no training row every document is ``und``; ties go to the label that sorts
first; rows that share an id are separate, repeated rows are predicted each and
may all be learned from; a null id counts as the empty string for the hold-out
rule; any number of languages is learned; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.llm import bytewords as bw
from mnemospark.llm.ppm import held_out

BATCH, WINDOW, SEGMENT, LANES = 3 << 20, 32 << 20, 1 << 18, 1024
EXCERPTS, EXCERPT = 6, 128
#: Bytes of a training sequence.
STRETCH = 64
UNKNOWN = "und"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Gru:
    """One direction: h' = (1-z)*n + z*h, n = tanh(x_n + r*(h U_n))."""

    def __init__(self, rng: np.random.Generator, embed: int, hidden: int):
        self.w = (rng.normal(size=(embed, 3 * hidden)) / np.sqrt(embed)).astype(np.float32)
        self.u = (rng.normal(size=(hidden, 3 * hidden)) / np.sqrt(hidden)).astype(np.float32)
        self.b = np.zeros(3 * hidden, np.float32)

    def forward(self, x: np.ndarray, keep: bool = False):
        """x: (time, batch, 3*hidden) input projections; states (time, batch, hidden)."""
        steps, batch, wide = x.shape
        size = wide // 3
        h = np.zeros((batch, size), np.float32)
        out = np.empty((steps, batch, size), np.float32)
        memory = []
        for t in range(steps):
            g = h @ self.u
            gates = _sigmoid(x[t, :, : 2 * size] + g[:, : 2 * size])
            r, z = gates[:, :size], gates[:, size:]
            n = np.tanh(x[t, :, 2 * size :] + r * g[:, 2 * size :])
            if keep:
                memory.append((h, r, z, n, g[:, 2 * size :]))
            h = n + z * (h - n)
            out[t] = h
        return out, memory

    def backward(self, memory, dout: np.ndarray):
        """Gradients (of input projections, of u) given those of the states."""
        steps, batch, size = dout.shape
        dx, du, dh = np.empty((steps, batch, 3 * size), np.float32), np.zeros_like(self.u), np.zeros((batch, size), np.float32)
        for t in range(steps - 1, -1, -1):
            h, r, z, n, gn = memory[t]
            dh = dh + dout[t]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z)
            dr = dn * gn * r * (1 - r)
            dg = np.concatenate([dr, dz, dn * r], axis=1)
            dx[t] = np.concatenate([dr, dz, dn], axis=1)
            du += h.T @ dg
            dh = dh * z + dg @ self.u.T
        return dx, du


class ByteLabeller:
    """Byte embedding, two GRUs, a label distribution at every position."""

    def __init__(self, labels: list[str], embed: int = 8, hidden: int = 12, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.embedding = (0.5 * rng.normal(size=(256, embed))).astype(np.float32)
        self.ahead, self.back = Gru(rng, embed, hidden), Gru(rng, embed, hidden)
        self.out = (rng.normal(size=(2 * hidden, len(labels))) / np.sqrt(2 * hidden)).astype(np.float32)
        self.bias = np.zeros(len(labels), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, self.ahead.w, self.ahead.u, self.ahead.b, self.back.w, self.back.u, self.back.b, self.out, self.bias]

    def positions(self, codes: np.ndarray) -> np.ndarray:
        """Label probabilities (time, batch, label) of byte codes (time, batch)."""
        ahead, _ = self.ahead.forward((self.embedding @ self.ahead.w + self.ahead.b)[codes])
        back, _ = self.back.forward((self.embedding @ self.back.w + self.back.b)[codes[::-1]])
        logits = ahead @ self.out[: ahead.shape[2]] + back[::-1] @ self.out[ahead.shape[2] :] + self.bias
        logits = np.exp(logits - logits.max(2, keepdims=True))
        return logits / logits.sum(2, keepdims=True)

    def gradients(self, codes: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over all positions and its gradients."""
        steps, batch = codes.shape
        x = self.embedding[codes]
        ahead, kept_a = self.ahead.forward(x @ self.ahead.w + self.ahead.b, keep=True)
        back, kept_b = self.back.forward((x @ self.back.w + self.back.b)[::-1], keep=True)
        both = np.concatenate([ahead, back[::-1]], axis=2)
        logits = both @ self.out + self.bias
        logits = np.exp(logits - logits.max(2, keepdims=True))
        p = logits / logits.sum(2, keepdims=True)
        loss = float(-np.log(p[:, np.arange(batch), label] + 1e-12).mean())
        d = p
        d[:, np.arange(batch), label] -= 1
        d /= steps * batch
        size = ahead.shape[2]
        dout, dbias, dboth = np.tensordot(both, d, axes=([0, 1], [0, 1])), d.sum((0, 1)), d @ self.out.T
        dxa, dua = self.ahead.backward(kept_a, dboth[:, :, :size])
        dxb, dub = self.back.backward(kept_b, dboth[::-1, :, size:])
        dxb = dxb[::-1]
        dx = dxa @ self.ahead.w.T + dxb @ self.back.w.T
        dembed = np.zeros_like(self.embedding)
        np.add.at(dembed, codes.ravel(), dx.reshape(-1, dx.shape[2]))
        of_w = lambda dp: np.tensordot(x, dp, axes=([0, 1], [0, 1]))
        return loss, [dembed, of_w(dxa), dua, dxa.sum((0, 1)), of_w(dxb), dub, dxb.sum((0, 1)), dout, dbias]

    def fit(self, pieces: list[bytes], label: np.ndarray, steps: int = 700, batch: int = 64, rate: float = 0.01, seed: int = 11) -> None:
        """Adam over batches of pieces of one length, drawn by how common the length is."""
        rng = np.random.default_rng(seed)
        lengths = np.array([len(p) for p in pieces])
        by_length = {int(n): np.flatnonzero(lengths == n) for n in np.unique(lengths)}
        share = np.array([n * len(at) for n, at in by_length.items()], dtype=float)
        first, second = [np.zeros_like(p) for p in self.parameters()], [np.zeros_like(p) for p in self.parameters()]
        for step in range(1, steps + 1):
            n = list(by_length)[rng.choice(len(by_length), p=share / share.sum())]
            some = rng.choice(by_length[n], size=min(batch, len(by_length[n])), replace=False)
            codes = np.frombuffer(b"".join(pieces[i] for i in some), np.uint8).reshape(len(some), n).T
            _, grads = self.gradients(codes, label[some])
            lr = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for p, g, m, v in zip(self.parameters(), grads, first, second):
                np.clip(g, -1, 1, out=g)
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)


def lanes_of(length: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(lane, start in the lane, lanes, steps): texts laid one after the other into lanes of nearly one length,
    the next longest always into the shortest lane."""
    lanes = int(max(1, min(most, len(length), -(-int(length.sum()) // int(length.max())))))
    lane, start, ends = np.empty(len(length), np.int64), np.empty(len(length), np.int64), [(0, i) for i in range(lanes)]
    for i in np.argsort(-length, kind="stable").tolist():
        start[i], lane[i] = ends[0]
        heapq.heapreplace(ends, (int(start[i] + length[i]), int(lane[i])))
    return lane, start, lanes, max(e for e, _ in ends)


class Reader:
    """The trained network over whole texts: gates in tables of their own, both directions in one step.

    What is kept of a position is what its state adds to the logits.
    """

    def __init__(self, model: ByteLabeller):
        size = len(model.ahead.u)
        sides = (model.ahead, model.back)
        inputs = np.stack([model.embedding @ g.w + g.b for g in sides])  # (2, 256, 3 * size)
        state = np.stack([g.u for g in sides])
        cut = lambda a, i, scale: np.ascontiguousarray(a[..., i * size : (i + 1) * size] * np.float32(scale))
        # sigmoid(x) = (tanh(x / 2) + 1) / 2: the half goes into the weights of both gates, that of
        # the reset gate's value into the candidate's weights
        self.inputs = [cut(inputs, 0, 0.5), cut(inputs, 1, 0.5), cut(inputs, 2, 1)]
        self.state = [cut(state, 0, 0.5), cut(state, 1, 0.5), cut(state, 2, 0.5)]
        self.size, self.bias, self.out = size, model.bias, np.stack([model.out[:size], model.out[size:]])
        self.tame = float(np.abs(model.out).sum(0).max() + np.abs(model.bias).max()) < 60  # exp() of a logit cannot overflow

    def scan(self, codes: np.ndarray, fresh: list[tuple[int, int, int]], h: np.ndarray, keep: bool = True):
        """codes: (step, direction, lane); fresh: (step, direction, lane) where a text begins, in order of step.
        Returns what each position adds to the logits, (step, direction, lane, label), and the last state."""
        steps, sides, lanes = codes.shape
        inputs, (u_r, u_z, u_n) = [x[:sides].reshape(-1, self.size) for x in self.inputs], [u[:sides] for u in self.state]
        offset = (256 * np.arange(sides))[:, None]
        out, weights = np.empty((steps if keep else 0, sides, lanes, len(self.bias)), np.float32), self.out[:sides]
        fresh, block = [*fresh, (steps, 0, 0)], 4096
        now, event = fresh[0][0], 0
        for low in range(0, steps, block):
            part = codes[low : low + block] + offset
            for t in range(len(part)):
                while low + t == now:
                    h[fresh[event][1], fresh[event][2]] = 0
                    event += 1
                    now = fresh[event][0]
                at = part[t]
                r, z, g = np.matmul(h, u_r), np.matmul(h, u_z), np.matmul(h, u_n)
                r += inputs[0].take(at, 0)
                z += inputs[1].take(at, 0)
                np.tanh(r, out=r)
                np.tanh(z, out=z)
                r *= g
                r += g
                r += inputs[2].take(at, 0)
                n = np.tanh(r, out=r)
                h -= n
                h *= 0.5
                n += h
                h *= z
                h += n
                if keep:
                    np.matmul(h, weights, out=out[low + t])
        return out, h

    def _distributions(self, logits: np.ndarray) -> np.ndarray:
        logits += self.bias
        if not self.tame:
            logits -= logits.max(-1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits @ np.ones((logits.shape[-1], 1), np.float32)
        return logits

    def _side_by_side(self, raw: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Summed distributions of texts."""
        lane, start, lanes, steps = lanes_of(length, LANES)
        laid = np.zeros((lanes, steps), np.uint8)
        for b, n, i, s in zip(begin.tolist(), length.tolist(), lane.tolist(), start.tolist()):
            laid[i, s : s + n] = raw[b : b + n]
        codes = np.stack([laid.T, laid.T[::-1]], axis=1)
        fresh = [(s, 0, i) for s, i in zip(start.tolist(), lane.tolist())] + [(steps - s - n, 1, i) for s, n, i in zip(start.tolist(), length.tolist(), lane.tolist())]
        adds, _ = self.scan(codes, sorted(fresh), np.zeros((2, lanes, self.size), np.float32))
        logits = adds[:, 0] + adds[::-1, 1]
        del adds, codes, laid
        p = self._distributions(logits)
        # the texts of all lanes one after the other, each followed by the rest of its lane if it is the last
        order = np.argsort(lane * steps + start)
        at = (lane * steps + start)[order]
        after = at + length[order]
        edges = np.minimum(np.stack([at, after], axis=1).ravel(), lanes * steps - 1)
        total = np.empty((len(length), len(self.bias)))
        for j in range(len(self.bias)):
            flat = np.ascontiguousarray(p[:, :, j].T).ravel()
            sums = np.add.reduceat(flat, edges, dtype=np.float64)[0::2]
            total[order, j] = sums + np.where(after == lanes * steps, np.where(length[order] > 1, flat[-1], 0.0), 0.0)
        return total

    def _alone(self, raw: np.ndarray) -> np.ndarray:
        """Summed distributions of one long text, a segment at a time."""
        cuts = range(0, len(raw), SEGMENT)
        ahead, starts = np.zeros((1, 1, self.size), np.float32), []
        for lo in cuts:
            starts.append(ahead.copy())
            _, ahead = self.scan(raw[lo : lo + SEGMENT, None, None], [], ahead, keep=False)
        back, total = np.zeros((1, 1, self.size), np.float32), np.zeros(len(self.bias))
        for lo, ahead in zip(reversed(cuts), reversed(starts)):
            part = raw[lo : lo + SEGMENT, None]
            adds, last = self.scan(np.stack([part, part[::-1]], axis=1), [], np.concatenate([ahead, back]))
            back = last[1:].copy()
            total += self._distributions(adds[:, 0, 0] + adds[::-1, 1, 0]).sum(0, dtype=np.float64)
        return total

    def sums(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(text, label): the distributions of all bytes of each text, summed."""
        length = np.diff(offsets)
        out = np.zeros((len(length), len(self.bias)))
        order = np.argsort(-length, kind="stable")
        order, at = order[length[order] > 0], 0
        while at < len(order):
            if length[order[at]] > SEGMENT:
                out[order[at]] = self._alone(raw[offsets[order[at]] : offsets[order[at] + 1]])
                at += 1
                continue
            many = max(1, int(np.searchsorted(np.cumsum(length[order[at:]]), BATCH, side="right")))
            some = order[at : at + many]
            out[some] = self._side_by_side(raw, offsets[some], length[some])
            at += many
        return out


def document_probabilities(reader: Reader, column) -> np.ndarray:
    """(row, label): mean over all bytes of each text; 0 where there is none."""
    out = []
    for _, _, raw, offsets in bw.slices(column, WINDOW):
        total = reader.sums(bw.LOWER[raw], offsets)
        out.append(total / np.maximum(total.sum(1, keepdims=True), 1e-12))
    return np.concatenate(out) if out else np.zeros((0, len(reader.bias)))


def _sample(docs: DataFrame, learn: Column, sample_rows: int) -> list:
    """(lang, excerpts) of the documents to learn from."""
    labelled = docs.where(learn & F.col("lang").isNotNull() & (F.length("text") > 0)).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    labels = labelled.select("lang").distinct().count()
    if not labels:
        return []
    h = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text")
    room = F.greatest(F.length("text") - EXCERPT + 1, F.lit(1))
    place = lambda i: (F.pmod(F.xxhash64(F.lit(i), "h"), room) + 1).cast("int")
    marked = labelled.select("lang", "text", h.alias("h")).select("lang", "h", F.array(*[F.substring(F.col("text"), place(i), F.lit(EXCERPT)) for i in range(EXCERPTS)]).alias("parts"))
    ranked = marked.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("h", "parts")))
    return ranked.where(F.col("nth") <= max(1, sample_rows // labels)).select("lang", "h", "parts").collect()  # at most sample_rows (or one a language)


def train(docs: DataFrame, learn: Column, sample_rows: int = 1200, steps: int = 700) -> ByteLabeller | None:
    """Fit on excerpts of at most ``sample_rows`` documents of the rows that ``learn`` admits."""
    rows = sorted(_sample(docs, learn, sample_rows), key=lambda r: (r[0], r[1], r[2]))
    labels = sorted({r[0] for r in rows})
    pieces, label = [], []
    for name, _, parts in rows:
        for part in dict.fromkeys(parts):
            raw = bw.LOWER[np.frombuffer(part.encode("utf-8", "surrogatepass"), np.uint8)].tobytes()
            found = [raw[i : i + STRETCH] for i in range(0, max(1, len(raw) - STRETCH // 2), STRETCH)]
            pieces += found
            label += [labels.index(name)] * len(found)
    if not pieces:
        return None
    model = ByteLabeller(labels)
    model.fit(pieces, np.array(label), steps=steps)
    return model


def least_score(labels: int) -> float:
    """The share of bytes that a recognisable text gives its best label: a fifth above
    chance, but never more than 0.3, so that a text of two or three languages counts as one."""
    return min(0.3, 1.2 / labels)


def _predict(model: ByteLabeller | None, carried: pa.Schema, names: tuple[str, ...]):
    """Carries columns over and adds label, score and the score's lead over what chance gives; the text is the last but one given."""
    schema = carried
    for name, kind in zip(names, (pa.string(), pa.float64(), pa.float64())):
        schema = schema.append(pa.field(name, kind))

    def run(batches):
        reader = Reader(model) if model else None
        for batch in _gathered(batches):
            text, letter = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            n = batch.num_rows
            label, score, lead = np.full(n, UNKNOWN, dtype=object), np.zeros(n), np.full(n, -1.0)
            if reader:
                p = document_probabilities(reader, text)
                known = letter.to_numpy(zero_copy_only=False).astype(bool) & (p.sum(1) > 0)
                best = p.argmax(1)
                label = np.where(known, np.array(model.labels, dtype=object)[best], UNKNOWN)
                score = np.where(known, np.minimum(p[np.arange(n), best], 1.0), 0.0)
                lead = np.where(known, score - least_score(len(model.labels)), -1.0)
            more = [pa.array(label, pa.string()), pa.array(score), pa.array(lead)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carried)], *more[: len(names)]], schema=schema)

    return run


def _gathered(batches):
    """Batches put together up to about ``WINDOW`` bytes, so that many texts run side by side."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= WINDOW:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]
            held, size = [], 0
    if held and (rest := [b for b in held if b.num_rows]):
        yield pa.Table.from_batches(rest).combine_chunks().to_batches()[0]


def _predicted(df: DataFrame, carried: DataFrame, model: ByteLabeller | None, names: tuple[str, ...]) -> DataFrame:
    """``df``: the carried columns, the text, whether it has a letter."""
    from pyspark.sql.pandas.types import to_arrow_schema

    bw.bounded_batches(df.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried.schema)
    added = ", ".join(f"`{n}` {kind}" for n, kind in zip(names, ("string", "double", "double")))
    return df.mapInArrow(bw.tidy(_predict(model, to_arrow_schema(carried.schema), names)), f"{fields}, {added}")


def _has_letter() -> Column:
    return F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("_letter")


def identify(docs: DataFrame, modulus: int = 4, remainder: int = 2, sample_rows: int = 1200, steps: int = 700) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learns from the rows that are not held out."""
    out = held_out("doc_id", modulus, remainder)
    model = train(docs, ~out, sample_rows, steps)
    given = docs.select("doc_id", out.alias("held_out"), F.col("text").alias("_text"), _has_letter())
    return _predicted(given, given.select("doc_id", "held_out"), model, ("lang_pred", "score"))


def label_rows(docs: DataFrame, names: tuple[str, str, str] = ("_lang_pred", "_lang_score", "_lang_lead"), modulus: int = 4, remainder: int = 2) -> DataFrame:
    """All columns of ``docs``, the prediction, its score and by how much that is above
    ``least_score`` (columns of the same names give way)."""
    carried = docs.drop(*names)
    model = train(docs, ~held_out("doc_id", modulus, remainder))
    # the text itself is carried, as the last column, so it crosses to Python once; names may hold anything
    order = [c for c in carried.columns if c != "text"] + ["text"]
    given = carried.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(order)], _has_letter())
    done = _predicted(given, given.drop("_letter"), model, ("_label", "_share", "_lead"))
    back = [F.col(f"_c{order.index(c)}").alias(c) for c in carried.columns]
    return done.select(*back, *[F.col(c).alias(n) for c, n in zip(("_label", "_share", "_lead"), names)])
