"""LM scoring by prediction by partial matching (PPM, escape method D).

A trie of byte contexts (orders ``max_order`` down to 0, then uniform) is
gathered from every training document; a document's score is the log10
probability of its whole lower-cased text followed by an end symbol. At each
order a symbol seen n times after the context has probability (n-1/2)/T; an
unseen one pays the escape (q/2)/T and is coded at the next shorter context,
from whose counts the symbols of the longer context are excluded (T total, q
distinct symbols, both after exclusion).

How it is distributed: documents are dealt by hash to chunks of about
``chunk_bytes`` of text. Each chunk asks for the distinct words and distinct
(max_order+1)-grams it holds, together with its own training counts; these
requests meet by word, and by the last two bytes of the gram's context, so one
shuffle both sums the corpus counts and evaluates every requested gram. A
context with more than 1 / ``SPLIT`` of all requests is split by the byte
before it, and again while it must be (down to whole contexts); the counts of
the shorter orders of a split context then come from tables. The answers go
back to the chunks, each a partition of its own, which add them up per
document. Nothing of corpus size is broadcast or collected: the driver sees the
counts of byte pairs (at most 257 x 257) and of split contexts (at most
``SPLIT`` of each order, 257 symbols each); the trie grows with the corpus.

Defined cases: null text = empty text (it costs its end symbol); no training
document = uniform over 257 symbols; repeated rows are scored each; a null id
counts as the empty string for the hold-out rule; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.llm import bytewords as bw
from mnemospark.scratch import materialize

END = 256
SYMBOLS = 257
BITS = 9
PAIR = (1 << (2 * BITS)) - 1
WORD, GRAM, TOKENS, DOCS = 0, 1, 2, 3
SPLIT = 4096
#: Answers in a blob, at most.
BLOB = 1 << 16


def _tail(symbols: int) -> int:
    """The bits of the last so many symbols."""
    return (1 << (BITS * symbols)) - 1


def held_out(doc_id: str, modulus: int, remainder: int) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def grams(raw: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """One gram per byte and one per end symbol, in text order, with the first
    gram's position of each row. Texts start in a context of end symbols."""
    n = len(offsets) - 1
    rows = np.repeat(np.arange(n), np.diff(offsets))
    symbols = np.full(len(raw) + n * (order + 1), END, dtype=np.int64)
    symbols[np.arange(len(raw)) + rows * (order + 1) + order] = raw
    gram = symbols[order:].copy()
    for j in range(1, order + 1):
        gram |= symbols[order - j : len(symbols) - j] << np.int64(BITS * j)
    first = offsets[:-1] + np.arange(n) * (order + 1)
    if order:
        keep = np.ones(len(gram), dtype=bool)
        gap = (first[1:, None] - order + np.arange(order)[None, :]).ravel()
        keep[gap] = False
        gram = gram[keep]
    return gram, offsets[:-1] + np.arange(n)


class _Tally:
    """Distinct keys of a chunk with training counts, merged slice by slice."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray, learn: np.ndarray) -> None:
        for part, n in ((keys[learn], 1), (keys[~learn], 0)):
            if len(part):
                distinct, count = bw.counted(part)
                self.parts.append((distinct, count * n))
                self.held += len(distinct)
        if self.held > 1_000_000:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        merged = bw.counted(np.concatenate([k for k, _ in self.parts]), np.concatenate([n for _, n in self.parts]))
        self.parts, self.held = [merged], len(merged[0])
        return merged


def _requests(order: int):
    schema = pa.schema([("chunk", pa.int32()), ("kind", pa.int8()), ("key", pa.int64()), ("n", pa.int64())])

    def run(batches):
        tallies: dict[int, tuple[_Tally, _Tally, list[int]]] = {}
        for batch in batches:
            chunk = batch.column("chunk").to_numpy(zero_copy_only=False)
            for c in np.unique(chunk):
                rows = pa.array(np.flatnonzero(chunk == c))
                learn = ~batch.column("held_out").take(rows).to_numpy(zero_copy_only=False)
                words, bytegrams, totals = tallies.setdefault(int(c), (_Tally(), _Tally(), [0, 0]))
                for lo, hi, raw, offsets in bw.slices(batch.column("text").take(rows)):
                    raw, some = bw.LOWER[raw], learn[lo:hi]
                    start, end, row = bw.spans(raw, offsets)
                    words.add(bw.word_hash(raw, start, end), some[row])
                    totals[0] += int(some[row].sum() + some.sum())
                    totals[1] += int(some.sum())
                    gram, _ = grams(raw, offsets, order)
                    bytegrams.add(gram, np.repeat(some, np.diff(offsets) + 1))
        for c, (words, bytegrams, totals) in tallies.items():
            for kind, (keys, n) in ((WORD, words.merge()), (GRAM, bytegrams.merge()), (TOKENS, (np.zeros(1, np.int64), np.array(totals[:1]))), (DOCS, (np.zeros(1, np.int64), np.array(totals[1:])))):
                for at in range(0, len(keys), 200_000):
                    k, m = keys[at : at + 200_000], n[at : at + 200_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), c, np.int32)), pa.array(np.full(len(k), kind, np.int8)), pa.array(k), pa.array(m.astype(np.int64))], schema=schema)

    return run


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The values of wanted keys (``keys`` ascend), 0 for absent ones."""
    if not len(keys):
        return np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


class SplitContexts:
    """Counts of one order, of the contexts that were split: by gram, and summed by context."""

    def __init__(self, contexts: list[int], keys: np.ndarray, n: np.ndarray, below: np.ndarray):
        order = np.argsort(keys)
        self.contexts = np.sort(np.array(contexts, np.int64))
        self.keys, self.n = keys[order], n[order]
        self.of, at = np.unique(self.keys >> BITS, return_inverse=True)
        self.t, self.q, self.e = (np.bincount(at, weights=w, minlength=len(self.of)) for w in (self.n, np.ones(len(at)), below[order]))

    def stats(self, context: np.ndarray) -> tuple[np.ndarray, ...]:
        return tuple(_find(self.of, v, context) for v in (self.t, self.q, self.e))


class LowOrders:
    """Counts of orders 1 and 0, in full (at most 257 x 257 numbers), and those of the contexts that were split."""

    def __init__(self, pairs: np.ndarray, split: dict[int, SplitContexts] | None = None):
        self.n1, self.split = pairs, split or {}
        self.t1, self.q1 = pairs.sum(1), (pairs > 0).sum(1)
        self.n0 = pairs.sum(0)
        self.t0, self.q0 = int(self.n0.sum()), int((self.n0 > 0).sum())
        self.e1 = ((pairs > 0) * self.n0[None, :]).sum(1)


def log10_probability(gram: np.ndarray, count: np.ndarray, order: int, low: LowOrders, depth: int = 2) -> np.ndarray:
    """log10 probability of each distinct gram's last symbol after its context.

    ``gram`` holds every distinct gram, wanted or counted, of the contexts
    that end in the same ``depth`` symbols; ``count`` their corpus counts.
    Orders below ``depth`` come from ``low``.
    """
    done = np.zeros(len(gram), dtype=bool)
    out = np.zeros(len(gram))
    symbol, last = gram & _tail(1), (gram >> BITS) & _tail(1)
    taken_t, taken_q = np.zeros(len(gram)), np.zeros(len(gram))  # excluded at the order that comes
    for k in range(order, -1, -1):
        if k >= depth:
            keys, inv = np.unique(gram & np.int64(_tail(k + 1)), return_inverse=True)
            n_key = np.bincount(inv, weights=count, minlength=len(keys))
            ctx, ctx_inv = np.unique(keys >> BITS, return_inverse=True)
            seen = n_key > 0
            t_ctx = np.bincount(ctx_inv, weights=n_key, minlength=len(ctx))
            q_ctx = np.bincount(ctx_inv, weights=seen, minlength=len(ctx))
            low_key = keys & np.int64(_tail(k))
            if k > depth:
                low_keys, low_inv = np.unique(gram & np.int64(_tail(k)), return_inverse=True)
                below = np.bincount(low_inv, weights=count, minlength=len(low_keys))[np.searchsorted(low_keys, low_key)]
            elif k > 2:
                below = _find(low.split[k - 1].keys, low.split[k - 1].n, low_key)
            else:
                below = low.n1[low_key >> BITS, low_key & _tail(1)]
            e_ctx = np.bincount(ctx_inv, weights=np.where(seen, below, 0), minlength=len(ctx))
            n, t, q, e = n_key[inv], t_ctx[ctx_inv][inv], q_ctx[ctx_inv][inv], e_ctx[ctx_inv][inv]
        elif k >= 2:
            table = low.split[k]
            n, (t, q, e) = _find(table.keys, table.n, gram & np.int64(_tail(k + 1))), table.stats((gram >> BITS) & np.int64(_tail(k)))
        elif k == 1:
            n, t, q, e = low.n1[last, symbol], low.t1[last], low.q1[last], low.e1[last]
        else:
            n, t, q, e = low.n0[symbol], np.full(len(gram), low.t0), np.full(len(gram), low.q0), np.zeros(len(gram))
        left_t, left_q = t - taken_t, q - taken_q
        hit = ~done & (n > 0)
        out[hit] += np.log10((n[hit] - 0.5) / left_t[hit])
        done |= hit
        escape = ~done & (left_q > 0)
        out[escape] += np.log10(0.5 * left_q[escape] / left_t[escape])
        known = t > 0
        taken_t, taken_q = np.where(known, e, 0.0), np.where(known, q, 0.0)
    rest = ~done
    out[rest] -= np.log10(SYMBOLS - low.q0)
    return out


def _depths(gram: np.ndarray, low: LowOrders) -> np.ndarray:
    """The length of the context by which each gram was dealt."""
    depth = np.full(len(gram), 2)
    for d, table in sorted(low.split.items()):
        deeper = (depth == d) & np.isin((gram >> BITS) & np.int64(_tail(d)), table.contexts)
        depth[deeper] = d + 1
    return depth


def _dealt_by(split: dict[int, SplitContexts]) -> Column:
    """The context by which a gram is dealt: two symbols, or more where it was split."""
    context = lambda d: F.shiftright("key", BITS).bitwiseAND(F.lit(_tail(d)).cast("long"))
    deal = context(max(split, default=1) + 1)
    for d in sorted(split, reverse=True):
        deal = F.when(context(d).isin(split[d].contexts.tolist()), deal).otherwise(context(d))
    return deal


def _split_contexts(grams: DataFrame, order: int, pairs: np.ndarray) -> dict[int, SplitContexts]:
    """For each order from 2: the contexts with more than 1 / SPLIT of the rows, and their counts."""
    found: dict[int, SplitContexts] = {}
    most = grams.count() / SPLIT
    for d in range(2, order):
        context = F.shiftright("key", BITS).bitwiseAND(F.lit(_tail(d)).cast("long"))
        inner = F.shiftright("key", BITS).bitwiseAND(F.lit(_tail(d - 1)).cast("long"))
        rows = grams.where(inner.isin(found[d - 1].contexts.tolist())) if d > 2 else grams
        hot = [r[0] for r in rows.groupBy(context.alias("c")).count().where(F.col("count") > most).select("c").collect()]  # fewer than SPLIT
        if not hot:
            break
        counts = rows.where(context.isin(hot)).groupBy(F.col("key").bitwiseAND(F.lit(_tail(d + 1)).cast("long")).alias("key")).agg(F.sum("n").alias("n")).where("n > 0").toArrow()  # 257 for each at most
        keys, n = counts.column("key").to_numpy(), counts.column("n").to_numpy().astype(float)
        low_key = keys & np.int64(_tail(d))
        below = pairs[low_key >> BITS, low_key & _tail(1)] if d == 2 else _find(found[d - 1].keys, found[d - 1].n, low_key)
        found[d] = SplitContexts(hot, keys, n, below)
    return found


def _answers(order: int, low: LowOrders):
    """Answers the requests of a partition: for each chunk and kind blobs of keys and of values."""
    schema = pa.schema([("chunk", pa.int32()), ("kind", pa.int8()), ("keys", pa.binary()), ("values", pa.binary())])

    def run(batches):
        table = pa.Table.from_batches(got) if (got := list(batches)) else None
        if table is None or not table.num_rows:
            return
        chunk, kind, key, n = (table.column(c).to_numpy() for c in ("chunk", "kind", "key", "n"))
        del table, got
        for which in (WORD, GRAM):
            at = np.flatnonzero(kind == which)
            if not len(at):
                continue
            keys, inv = np.unique(key[at], return_inverse=True)
            count = np.bincount(inv, weights=n[at], minlength=len(keys))
            value = count
            if which == GRAM:
                depth, value = _depths(keys, low), np.zeros(len(keys))
                for d in np.unique(depth):
                    some = depth == d
                    value[some] = log10_probability(keys[some], count[some], order, low, int(d))
            by_chunk = np.argsort(chunk[at], kind="stable")
            edges = np.flatnonzero(np.diff(chunk[at][by_chunk], prepend=-1, append=-1))
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                for first in range(lo, hi, BLOB):
                    some = by_chunk[first : min(hi, first + BLOB)]
                    blobs = [pa.array([x.tobytes()], pa.binary()) for x in (key[at[some]], value[inv[some]])]
                    yield pa.RecordBatch.from_arrays([pa.array([chunk[at[some[0]]]], pa.int32()), pa.array([which], pa.int8()), *blobs], schema=schema)
            del keys, inv, count, value

    return run


def _scores(order: int, id_type: pa.DataType):
    """Adds up the answers of the chunk whose documents and answers a partition holds."""
    schema = pa.schema([("doc_id", id_type), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("log_counts", pa.float64()), ("score", pa.float64())])

    def run(batches):
        docs, answers = [], {WORD: [], GRAM: []}
        for batch in batches:
            kind = batch.column("kind").to_numpy(zero_copy_only=False)
            for which, parts in answers.items():
                for i in np.flatnonzero(kind == which).tolist():
                    parts.append((np.frombuffer(batch.column("keys")[i].as_buffer(), np.int64), np.frombuffer(batch.column("values")[i].as_buffer(), np.float64)))
            if len(at := np.flatnonzero(kind == DOCS)):
                docs.append(batch.column("doc").take(pa.array(at)))
        if not docs:
            return
        tables = {}
        for which, parts in answers.items():
            tables[which] = (bw.Index(np.concatenate([k for k, _ in parts])), np.concatenate([v for _, v in parts])) if parts else (bw.Index(np.zeros(0, np.int64)), np.zeros(0))
        answers.clear()
        cost, known = np.log10(tables[WORD][1] + 0.1), tables[WORD][1] > 0
        for part in docs:
            n_words, n_known, logs, score = ([] for _ in range(4))
            for _, _, raw, offsets in bw.slices(part.field("text")):
                raw, rows = bw.LOWER[raw], len(offsets) - 1
                start, end, row = bw.spans(raw, offsets)
                at = tables[WORD][0].find(bw.word_hash(raw, start, end))
                n_words.append(np.bincount(row, minlength=rows))
                n_known.append(bw.per_row(known[at], row, rows) if len(at) else np.zeros(rows))
                logs.append(bw.per_row(cost[at], row, rows) if len(at) else np.zeros(rows))
                gram, first = grams(raw, offsets, order)
                score.append(np.add.reduceat(tables[GRAM][1][tables[GRAM][0].find(gram)], first) if rows else np.zeros(0))
            whole = [np.concatenate(x) for x in (n_words, n_known, logs, score)]
            yield pa.RecordBatch.from_arrays([part.field("doc_id"), part.field("held_out"), pa.array(whole[0].astype(np.int64)), pa.array(whole[1].astype(np.int64)), pa.array(whole[2]), pa.array(whole[3])], schema=schema)

    return run


def score_documents(docs: DataFrame, modulus: int = 10, remainder: int = 0, max_order: int = 5, chunk_bytes: int = 32 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Learns from rows whose crc32(doc_id) mod ``modulus`` is not ``remainder``.
    ``base_score`` is the add-0.1 unigram model over words and an end token.
    """
    if not 2 <= max_order <= 6:
        raise ValueError("max_order: 2 to 6 symbols fit a 64-bit gram")
    bw.bounded_batches(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cores = docs.sparkSession.sparkContext.defaultParallelism
    chunks = max(1, -(-int(total) // chunk_bytes), min(cores, -(-int(total) // (1 << 20))))  # a small table keeps all cores busy
    given = docs.select("doc_id", "text", held_out("doc_id", modulus, remainder).alias("held_out"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int").alias("chunk"))
    asked = given.repartitionById(chunks, F.col("chunk")).mapInArrow(bw.tidy(_requests(max_order)), "chunk int, kind tinyint, key long, n long")
    asked = materialize(asked, "ppm")
    tokens, documents = (asked.where(F.col("kind") == k).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for k in (TOKENS, DOCS))
    vocabulary = asked.where((F.col("kind") == WORD) & (F.col("n") > 0)).select("key").distinct().count() + (documents > 0)
    pairs = np.zeros((SYMBOLS, SYMBOLS), np.int64)
    for pair, n in asked.where(F.col("kind") == GRAM).groupBy(F.col("key").bitwiseAND(PAIR).alias("pair")).agg(F.sum("n")).collect():  # at most 257 x 257 rows
        pairs[pair >> BITS, pair & ((1 << BITS) - 1)] = n
    split = _split_contexts(asked.where(F.col("kind") == GRAM).select("key", "n"), max_order, pairs)
    meet = F.when(F.col("kind") == WORD, F.col("key")).otherwise(_dealt_by(split))
    model = asked.where(F.col("kind") <= GRAM).withColumn("meet", meet).repartition(4 * chunks, "kind", "meet").select("chunk", "kind", "key", "n").mapInArrow(bw.tidy(_answers(max_order, LowOrders(pairs, split))), "chunk int, kind tinyint, keys binary, values binary")
    id_type = docs.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    doc = F.struct("doc_id", "held_out", "text")
    both = model.select("*", F.lit(None).cast(given.select(doc.alias("d")).schema["d"].dataType).alias("doc"))
    both = both.unionByName(given.select("chunk", F.lit(DOCS).cast("tinyint").alias("kind"), F.lit(b"").alias("keys"), F.lit(b"").alias("values"), doc.alias("doc")))
    scored = both.repartitionById(chunks, F.col("chunk")).select("kind", "keys", "values", "doc").mapInArrow(bw.tidy(_scores(max_order, to_arrow_type(id_type))), f"doc_id {id_type.simpleString()}, held_out boolean, n_tokens long, n_known long, log_counts double, score double")
    end_cost, norm = float(np.log10(documents + 0.1)), float(np.log10(tokens + 0.1 * (vocabulary + 1)))
    return scored.select(
        "doc_id",
        "held_out",
        (F.col("n_tokens") + 1).alias("n_tokens"),
        (F.col("n_known") + (1 if documents else 0)).alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("log_counts") + F.lit(end_cost) - (F.col("n_tokens") + 1) * F.lit(norm)).alias("base_score"),
        "score",
    )
