"""Mixture-controlled packing: deficit round-robin over source queues, in closed form.

Every source is a queue of token ids. In each round of one window's length, a queue earns its target share; what
it may not spend yet, because it sends whole quanta only, stays as its deficit for later rounds. Earnings are
linear in the round, so the tokens a queue has sent before any round are known by arithmetic: no task has to
wait for another one, and deficits carry on across windows and partitions. The rounds, one after the other,
form one stream that is cut at every window length, so only the last window is padded.
"""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from helixmart.llm.common import pick, stored, table, text_batches
from helixmart.llm.tokens import encoder

TOKENIZER = "word_bpe_49k.json"
END_ID, WINDOW, QUANTUM = 1, 2048, 256
#: Sources without a target of their own are spread over this many queues by hash.
QUEUES = 4096

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long, "
          "source string")


class Mixture:
    """Rounds of the queues, phase by phase. A phase ends when a queue with a target is empty; its share then
    goes to the others in proportion."""

    def __init__(self, totals: dict[int, int], weights: dict[int, float], window: int, quantum: int):
        self.window, self.quantum = window, quantum
        self.queues = sorted(q for q, n in totals.items() if n)
        left = np.array([totals[q] for q in self.queues], np.int64)
        w = np.array([weights[q] for q in self.queues], float)
        self.phases, base, sent = [], 0, np.zeros(len(left), np.int64)
        while left.sum():
            live = left > 0
            spans = np.where(live, left / np.where(live, w, 1.0), np.inf)
            end = spans.min()
            take = np.where(spans <= end * (1 + 1e-9), left, np.minimum(left, np.floor(w * end)).astype(np.int64) * live)
            rounds = max(1, -(-int(take.sum()) // window))
            self.phases.append((base, rounds, sent.copy(), take))
            base, sent, left = base + int(take.sum()), sent + take, left - take
        self.total = base

    def served(self, phase: int, r: np.ndarray) -> np.ndarray:
        """Tokens (rounds x queues) that the queues have sent in the phase before round ``r``."""
        _, rounds, _, take = self.phases[phase]
        quanta = np.floor(np.outer(r, take / (rounds * self.quantum)) + self._lead(len(take)))
        out = np.minimum(quanta * self.quantum, take).astype(np.int64)
        out[r <= 0] = 0
        out[r >= rounds] = take
        return out

    @staticmethod
    def _lead(n: int) -> np.ndarray:
        """A fixed part of a quantum ahead for each queue, so that they do not all send in the same round."""
        return np.modf(np.arange(1, n + 1) * 0.6180339887498949)[0]

    def pieces(self, queue: int, x0: np.ndarray, n: np.ndarray):
        """Cut the spans [x0, x0 + n) of a queue: index of the span, start in it, length, place in the stream."""
        q = self.queues.index(queue)
        parts = []
        for p, (base, rounds, sent, take) in enumerate(self.phases):
            lo, hi = np.maximum(x0, sent[q]), np.minimum(x0 + n, sent[q] + take[q])
            some = np.flatnonzero(lo < hi)
            if len(some):
                parts.append(self._phase_pieces(p, q, some, lo[some] - sent[q], hi[some] - sent[q]))
        span, a, b, at = (np.concatenate(c) for c in zip(*parts, strict=True))
        first, last = at // self.window, (at + (b - a) - 1) // self.window
        k = last - first + 1
        row = np.repeat(np.arange(len(k)), k)
        cut = (first[row] + np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)) * self.window
        lo, hi = np.maximum(at[row], cut), np.minimum((at + b - a)[row], cut + self.window)
        return span[row], a[row] + lo - at[row] - x0[span[row]], hi - lo, lo

    def _phase_pieces(self, p: int, q: int, some: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        base, rounds, sent, take = self.phases[p]
        first, last = lo // self.quantum, (hi - 1) // self.quantum
        k = last - first + 1
        row = np.repeat(np.arange(len(k)), k)
        chunk = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
        r = self._round_of(q, chunk, rounds, take[q])
        # Quanta of one span that go out in one round are one piece.
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (r[1:] != r[:-1])
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(row)) - 1
        a = np.maximum(chunk[head] * self.quantum, lo[row[head]])
        b = np.minimum((chunk[tail] + 1) * self.quantum, hi[row[head]])
        at = np.empty(len(head), np.int64)
        rounds_of = r[head]
        for i in range(0, len(head), 4096):
            part = rounds_of[i : i + 4096]
            before, after = self.served(p, part), self.served(p, part + 1)
            ahead = before.sum(axis=1) + (after - before)[:, :q].sum(axis=1)
            at[i : i + 4096] = base + ahead + a[i : i + 4096] - before[:, q]
        return some[row[head]], a + sent[q], b + sent[q], at

    def _round_of(self, q: int, chunk: np.ndarray, rounds: int, take: int) -> np.ndarray:
        rate, lead = take / (rounds * self.quantum), self._lead(q + 1)[q]
        sent = lambda r: np.where(r >= rounds, np.inf, np.where(r <= 0, 0, np.floor(r * rate + lead)))
        r = np.clip(np.ceil((chunk + 1 - lead) / rate) - 1, 0, rounds - 1)
        for _ in range(3):
            r = np.where((sent(r) > chunk) & (r > 0), r - 1, r)
            r = np.where((sent(r + 1) <= chunk) & (r < rounds - 1), r + 1, r)
        return r.astype(np.int64)


def _tokenised(docs: DataFrame, tokenizer: str, end_id: int, words: int) -> DataFrame:
    """Ids of every document with its place in its partition's part of the queue."""
    end = end_id.to_bytes(4, "little")
    fields = ["part", "queue", "local", "n", "doc_id", "source", "ids"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def encode(batches):
        enc, part, sent = encoder(tokenizer, words), TaskContext.get().partitionId(), {}
        narrow = max(enc.tokenizer.get_vocab_size(), end_id + 1) <= 65536
        out, held = [], 0
        for doc_id, source, queue, text in text_batches(batches, ["doc_id", "source", "queue", "text"], "encoders"):
            ids = enc.encode(text) + end
            n = len(ids) // 4
            if narrow:
                ids = np.frombuffer(ids, "<u4").astype("<u2").tobytes()
            out.append((part, queue, sent.get(queue, 0), n, doc_id, source, ids))
            sent[queue] = sent.get(queue, 0) + n
            held += n
            if held > 1_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], fields)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], fields)

    return docs.mapInArrow(encode, "part long, queue int, local long, n long, doc_id long, source string, ids binary")


def pack(docs: DataFrame, tokenizer: str, targets: dict[str, float] | None = None, window: int = WINDOW,
         quantum: int = QUANTUM, end_id: int = END_ID, words: int = 400_000) -> DataFrame:
    """One row per piece of a document (doc_id, source, text): see PIECES.

    ``targets`` gives token shares of named sources; without it, every source has the share of its tokens in all,
    so each window has the mixture of the whole table. Sources without a target keep their own proportions within
    what is left. No token is dropped or repeated: when a queue is empty, its share goes to the others.
    Null and empty texts consist of the end id; null sources count as one source; repeated rows are packed each;
    an empty table gives no pieces. A worker remembers the ids of ``words`` words a generation.
    """
    targets = targets or {}
    named = {name: i for i, name in enumerate(sorted(targets))}
    queue = F.pmod(F.xxhash64(F.coalesce("source", F.lit(""))), F.lit(QUEUES)) + len(named)
    for name, i in named.items():
        queue = F.when(F.col("source") == name, F.lit(i)).otherwise(queue)
    ids = stored(_tokenised(docs.select("doc_id", "source", queue.cast("int").alias("queue"), "text"), tokenizer, end_id, words))
    # One row per input partition and queue; at most QUEUES totals reach the driver.
    parts = stored(ids.groupBy("part", "queue").agg(F.sum("n").alias("n")))
    totals = {r[0]: int(r[1]) for r in parts.groupBy("queue").agg(F.sum("n")).collect()}
    spark = docs.sparkSession
    if not totals:
        return spark.createDataFrame([], PIECES)
    free = sum(n for q, n in totals.items() if q >= len(named))
    rest = max(0.0, 1 - sum(targets.values()))
    weights = {q: targets[sorted(targets)[q]] if q < len(named) else (rest or 1e-9) * n / free for q, n in totals.items()}
    mixture = Mixture(totals, weights, window, quantum)
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = stored(parts.select("part", "queue", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    placed = ids.join(bases, ["part", "queue"]).select("queue", (F.col("base") + F.col("local")).alias("x0"), "n", "doc_id", "source", "ids")
    fields = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"]

    def cut(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                x0, n, queues = (b[c].to_numpy(zero_copy_only=False) for c in ("x0", "n", "queue"))
                for q in np.unique(queues).tolist():
                    rows = np.flatnonzero(queues == q)
                    span, start, length, place = mixture.pieces(q, x0[rows], n[rows])
                    row = rows[span]
                    blobs, crc, now, raw = b["ids"], [], -1, b""
                    for i, s, k in zip(row.tolist(), start.tolist(), length.tolist(), strict=True):
                        if i != now:
                            now, raw = i, blobs[i].as_py()
                            raw = np.frombuffer(raw, f"<u{len(raw) // int(n[i])}").astype("<u4")
                        crc.append(zlib.crc32(raw[s : s + k].tobytes()))
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [b["doc_id"].take(take), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                         pa.array(n[row], pa.int64()), pa.array(place // window, pa.int64()), pa.array(place % window, pa.int64()),
                         b["source"].take(take)], fields)

    return placed.mapInArrow(cut, PIECES)


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = pick(table(spark, folder, "documents"), "doc_id", "source", "text")
    return pack(docs, public_tokenizers.path(TOKENIZER))
