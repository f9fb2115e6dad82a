"""Log-bilinear neural language model, trained in numpy with noise-contrastive estimation.

Tokens are lower-cased (A-Z) words and one end per text. Counts of all words of
all training texts are gathered with a shuffle. The softmax has two levels. Words fall into classes: the most
frequent words have one each, the others share a class with the words of the
same ending. Inside a shared class the frequent words have a place each, and one more place stands for the others.
The network predicts from the three words before, q = sum_i C_i r(word_i), with the logits q . v(class) + b(class)
and, inside the class, q . u(place) + a(place). Both are normalised over all classes and all places of the class by
matrix products. Words without a place share the probability of the place for others in proportion to
count + 1, with 1 more for all unseen words, so the whole distribution is normalised.

Training covers every training text once. Texts are dealt by a hash of id and text into shards of about
``SHARD_TOKENS`` tokens, whose number follows from the corpus alone; every shard runs noise-contrastive gradient steps from
the same start, in an order fixed by the hash, and the networks are averaged by tokens. So the
result depends neither on the number of tasks nor on how the input is split.

Counts of the ``HEAD`` most frequent words of at most ``LONGEST`` bytes are broadcast (a bound on
size that does not depend on the input), the end always among them; all other words are looked up by a join.

Nulls and edges: a null text counts as empty and has the end alone; rows with a null
id belong to the training texts; repeated rows count and are scored each; an
empty table gives an empty result; without any training text all counts are 0; long texts are taken apart
into words a span at a time; other columns, whatever their names, do not interfere.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.runtime import materialize
from tidemark.llm.textbatch import slices, text_buffer

HEAD, LONGEST = 1 << 18, 64
SINGLES, SUFFIXES, HASHED = 63, 112, 16
#: Class 0 is the end of a text, then single words, known endings, hashed endings.
CLASSES = 1 + SINGLES + SUFFIXES + HASHED
#: Places of a shared class, the one for others included.
PLACES = 160
DIM, CONTEXT = 16, 3
NOISE, NOISE_SAMPLE, NOISE_INSIDE = 12.0, 32, 4
BATCH, SEGMENT, SCORE_BATCH, QUERIES, PRODUCT = 2048, 32, 256, 1 << 13, 256
SHARD_TOKENS, BLOCK, CHUNK = 1 << 22, 1 << 20, 1 << 18
AVERAGED = 64
COUNTER_LIMIT = 200_000
SPAN = 1 << 20
HELD_OUT_MOD, HELD_OUT = 7, 2

_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def word_lists(column: pa.Array) -> Iterator[Iterator[list[bytes]]]:
    """For each text its words, in lists of at most about ``SPAN`` bytes."""
    data, off = text_buffer(column)
    raw = data.tobytes()

    def spans(at: int, end: int) -> Iterator[list[bytes]]:
        while at < end:
            stop = end
            if at + SPAN < end:
                blank = _BLANK.search(raw, at + SPAN, end)
                stop = blank.start() if blank else end
            yield raw[at:stop].lower().split()
            at = stop

    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        yield spans(a, b)


def _count_words(batches):
    seen: Counter = Counter()

    def flush():
        out = pa.RecordBatch.from_arrays(
            [pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"]
        )
        seen.clear()
        return out

    for batch in batches:
        for piece in slices(batch, "text"):
            for text in word_lists(piece.column(0)):
                for words in text:
                    seen.update(words)
                    if len(seen) > COUNTER_LIMIT:
                        yield flush()
            seen[b""] += piece.num_rows
    if seen:
        yield flush()


def word_counts(texts: DataFrame) -> DataFrame:
    """``word`` (binary; empty for the end) and ``n`` over all texts, combined in the tasks before the shuffle."""
    return texts.select("text").mapInArrow(_count_words, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Which class a word is in, and what is known of the frequent words.

    A word's code is its class, if it is alone there or has no place, and a number from ``CLASSES`` on for its place otherwise.
    Rows are the places of all shared classes, class by class, each with the place for others first.
    """

    singles: dict[bytes, int]
    suffixes: dict[bytes, int]
    head: dict[bytes, int] = field(default_factory=dict)
    head_code: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint16))
    head_log: np.ndarray = field(default_factory=lambda: np.zeros(0))
    code_class: np.ndarray = field(default_factory=lambda: np.arange(CLASSES))
    code_row: np.ndarray = field(default_factory=lambda: np.full(CLASSES, -1))
    class_row: np.ndarray = field(default_factory=lambda: np.zeros(CLASSES + 1, np.int64))
    other_log: np.ndarray = field(default_factory=lambda: np.zeros(CLASSES))

    def class_of(self, word: bytes) -> int:
        if not word:
            return 0
        found = self.singles.get(word)
        if found is None:
            found = self.suffixes.get(word[-3:])
        return 1 + SINGLES + SUFFIXES + zlib.crc32(word[-2:]) % HASHED if found is None else found


class Codes(dict):
    """Positions of words in the head; -1 - class of other words, of which the first ones met are kept."""

    def __init__(self, vocab: Vocabulary):
        super().__init__(vocab.head)
        self._vocab, self._most = vocab, len(vocab.head) + COUNTER_LIMIT

    def __missing__(self, word: bytes) -> int:
        code = -1 - self._vocab.class_of(word)
        if len(self) < self._most and len(word) <= LONGEST:
            self[word] = code
        return code


@dataclass
class Net:
    """Context vectors by code (the last is a text's start), their maps by distance, and outputs by class and by row.

    Outputs have one coordinate more, the bias: the last coordinate of every query is 1.
    """

    r: np.ndarray
    c: np.ndarray
    v: np.ndarray
    u: np.ndarray

    @staticmethod
    def start(codes: int, class_share: np.ndarray, row_share: np.ndarray, code_class: np.ndarray, seed: int = 3) -> "Net":
        rng = np.random.default_rng(seed)
        by_class = rng.normal(0, 0.3, (CLASSES + 1, DIM))  # words of one class start alike
        r = by_class[np.append(code_class, CLASSES)]
        c = np.stack([np.eye(DIM)] * CONTEXT) / CONTEXT
        v = np.column_stack([rng.normal(0, 0.1, (CLASSES, DIM)), np.log(class_share)])
        u = np.column_stack([np.zeros((len(row_share), DIM)), np.log(np.maximum(row_share, 1e-30))])
        return Net(*(x.astype(np.float32) for x in (r, c, v, u)))

    def parts(self) -> list[np.ndarray]:
        return [self.r, self.c, self.v, self.u]

    def pack(self) -> bytes:
        return np.concatenate([x.ravel() for x in self.parts()]).astype(np.float32).tobytes()

    def like(self, flat: np.ndarray) -> "Net":
        """A network of the same shapes."""
        cuts = np.cumsum([x.size for x in self.parts()])[:-1]
        return Net(*(y.reshape(x.shape).astype(np.float32) for x, y in zip(self.parts(), np.split(flat, cuts))))


def _firsts(ids: np.ndarray) -> np.ndarray:
    """Where each run of equal ids begins."""
    changes = np.ones(len(ids), bool)
    np.not_equal(ids[1:], ids[:-1], out=changes[1:])
    return np.flatnonzero(changes)


def _sums(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sum of each run of rows, two columns at a time as complex numbers; the number of columns is even."""
    return np.add.reduceat(rows.view(np.complex64), first, axis=0).view(np.float32)


def _cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a.T @ b``; long thin products are quicker in blocks."""
    return sum(a[i : i + PRODUCT].T @ b[i : i + PRODUCT] for i in range(0, len(a), PRODUCT))


class Scorer:
    """Normalised log10 probabilities of tokens, as far as classes and places go."""

    def __init__(self, net: Net, vocab: Vocabulary):
        # The bias' coordinate is 1 in the nearest word's map and 0 in the others, so that their sum is a query.
        self.rc = [np.column_stack([net.r @ net.c[i], np.full(len(net.r), i == 0, np.float32)]) for i in range(CONTEXT)]
        self.vt = np.ascontiguousarray(net.v.T)
        self.code_class, self.code_row, self.class_row = vocab.code_class.astype(np.uint16), vocab.code_row, vocab.class_row
        self.shared = np.diff(vocab.class_row) > 1
        self.inside = [np.ascontiguousarray(net.u[a:b].T) for a, b in zip(vocab.class_row[:-1], vocab.class_row[1:])]

    def _softmax(self, q: np.ndarray, table: np.ndarray, target: np.ndarray) -> np.ndarray:
        out, ones, held = np.empty(len(q), np.float64), np.ones(table.shape[1], np.float32), np.empty((SCORE_BATCH, table.shape[1]), np.float32)
        for a in range(0, len(q), SCORE_BATCH):
            qa = q[a : a + SCORE_BATCH]
            z = np.matmul(qa, table, out=held[: len(qa)])
            hit = z[np.arange(len(z)), target[a : a + SCORE_BATCH]]
            with np.errstate(over="ignore"):
                total = np.exp(z, out=z) @ ones
            if not (total.min() > 1e-20 and total.max() < 1e30):  # too far from 0 for 32 bits
                z = np.matmul(qa, table, out=z)
                most = z.max(axis=1, keepdims=True)
                z -= most
                hit -= most[:, 0]
                total = np.exp(z, out=z) @ ones
            out[a : a + SCORE_BATCH] = hit - np.log(total)
        return out

    def log10_next(self, context: list[np.ndarray], target: np.ndarray) -> np.ndarray:
        """Context: CONTEXT arrays of codes, nearest first; target: codes."""
        q = np.empty((len(target), DIM + 1), np.float32)
        for a in range(0, len(target), QUERIES):
            some = self.rc[0].take(context[0][a : a + QUERIES], axis=0)
            for i in range(1, CONTEXT):
                some += self.rc[i].take(context[i][a : a + QUERIES], axis=0)
            q[a : a + QUERIES] = some
        classes = self.code_class.take(target)
        out = self._softmax(q, self.vt, classes)
        order = np.argsort(classes, kind="stable")  # 16 bits sort by radix
        order = order[self.shared[classes[order]]]
        cuts = np.flatnonzero(np.diff(classes[order].astype(np.int32), prepend=-1, append=-1))
        for a, b in zip(cuts[:-1], cuts[1:]):
            mine, k = order[a:b], int(classes[order[a]])
            out[mine] += self._softmax(q.take(mine, axis=0), self.inside[k], self.code_row.take(target.take(mine)) - self.class_row[k])
        return out / np.log(10)


class Trainer:
    """AdaGrad steps on the noise-contrastive objective of both levels; noise comes from the shares of classes and places.

    A batch is ``BATCH // SEGMENT`` runs of neighbouring tokens, so that a word's vector is read and moved once for all the tokens after it.
    Queries and outputs have one more coordinate here, always 0, so that their number is even.
    """

    def __init__(self, net: Net, vocab: Vocabulary, class_share: np.ndarray, row_share: np.ndarray, rate: float = 0.15, seed: int = 5):
        self._net = Net(net.r.copy(), net.c.copy(), *(np.pad(x, ((0, 0), (0, 1))) for x in (net.v, net.u)))
        self.noise = class_share**0.75 / (class_share**0.75).sum()
        self.log_noise = np.log(NOISE * self.noise).astype(np.float32)
        self.row_noise = np.log(NOISE_INSIDE * np.maximum(row_share, 1e-30)).astype(np.float32)
        self.reach, self.class_reach = (np.concatenate([[0.0], np.cumsum(x)]) for x in (row_share, self.noise))
        self.start = len(vocab.code_class)
        self.code_class, self.code_row = np.append(vocab.code_class, 0).astype(np.uint16), np.append(vocab.code_row, -1)
        self.shared = np.flatnonzero(np.diff(vocab.class_row) > 1)
        self.place = np.full(CLASSES, -1)
        self.place[self.shared] = np.arange(len(self.shared))
        self.low, self.high = vocab.class_row[self.shared][:, None], vocab.class_row[self.shared + 1][:, None]
        self.rate, self.rng = np.float32(rate), np.random.default_rng(seed)
        self.square = [np.full_like(x, 1e-2) for x in self._net.parts()]

    @property
    def net(self) -> Net:
        return Net(self._net.r, self._net.c, self._net.v[:, :-1], self._net.u[:, :-1])

    def _move(self, k: int, grad: np.ndarray, at: np.ndarray | None = None) -> None:
        grad *= np.float32(30)
        part, square = self._net.parts()[k], self.square[k]
        seen = grad * grad
        seen += square if at is None else square.take(at, axis=0)
        grad *= self.rate
        grad /= np.sqrt(seen)
        if at is None:
            square[:] = seen
            part += grad
        else:
            square[at] = seen
            grad += part.take(at, axis=0)
            part[at] = grad

    def _scatter(self, k: int, ids: np.ndarray, rows: np.ndarray) -> None:
        order = np.argsort(ids.astype(np.uint16), kind="stable")  # 16 bits sort by radix
        ids = ids.take(order)
        first = _firsts(ids)
        self._move(k, _sums(rows.take(order, axis=0), first), ids.take(first))

    def step(self, codes: np.ndarray) -> None:
        """``codes``: runs of tokens (runs, CONTEXT + SEGMENT), of which the first CONTEXT are context only."""
        net, target = self._net, codes[:, CONTEXT:].ravel()
        n = len(target)
        r = net.r.take(codes, axis=0)
        # By distance, where a run has the vectors of its tokens' contexts, side by side.
        before = [slice((CONTEXT - 1 - i) * DIM, (CONTEXT - 1 - i + SEGMENT) * DIM) for i in range(CONTEXT)]
        ahead = sum((r.reshape(-1, DIM) @ c).reshape(len(codes), -1)[:, near] for c, near in zip(net.c, before))
        # From here to dq the tokens stand class by class.
        classes = self.code_class.take(target)
        order = np.argsort(classes, kind="stable")  # 16 bits sort by radix
        classes, target = classes.take(order), target.take(order)
        first = _firsts(classes)
        q = np.zeros((n, DIM + 2), np.float32)
        q[:, :DIM], q[:, DIM] = ahead.reshape(n, DIM).take(order, axis=0), 1
        weight = ((target != self.start) / np.float32(n)).astype(np.float32)
        pick = np.searchsorted(self.class_reach, self.rng.random(NOISE_SAMPLE) * self.class_reach[-1], "right") - 1
        vt, away = net.v.take(classes, axis=0), -net.v.take(pick, axis=0)
        away[:, DIM] += self.log_noise[pick]
        good = weight / (1 + np.exp(np.einsum("nd,nd->n", q, vt) - self.log_noise.take(classes)))
        bad = q @ away.T
        np.exp(bad, out=bad)
        bad += 1
        np.divide((weight * np.float32(NOISE / NOISE_SAMPLE))[:, None], bad, out=bad)
        vt *= good[:, None]
        dq = bad @ away
        dq += vt
        gv = (np.arange(CLASSES)[:, None] == pick).astype(np.float32) @ -_cross(bad, q)
        gv[classes.take(first)] += _sums(good[:, None] * q, first)

        place = self.place.take(classes)
        inside = np.flatnonzero(place >= 0)
        if len(inside):
            k, rows, qi, wi = place.take(inside), self.code_row.take(target.take(inside)), q.take(inside, axis=0), weight.take(inside)
            low, high = self.reach[self.low], self.reach[self.high]
            drawn = np.searchsorted(self.reach, low + self.rng.random((len(self.shared), NOISE_INSIDE)) * (high - low), "right") - 1
            drawn = np.clip(drawn, self.low, self.high - 1)
            ut, un = net.u.take(rows, axis=0), -net.u.take(drawn, axis=0)
            un[:, :, DIM] += self.row_noise[drawn]
            un = un.take(k, axis=0)
            good_in = wi / (1 + np.exp(np.einsum("nd,nd->n", qi, ut) - self.row_noise.take(rows)))
            bad_in = wi[:, None] / (1 + np.exp(np.einsum("nkd,nd->nk", un, qi)))
            ut *= good_in[:, None]
            ut += np.einsum("nk,nkd->nd", bad_in, un)
            ut += dq.take(inside, axis=0)
            dq[inside] = ut
            begin = _firsts(k)
            push = -_sums(np.einsum("nk,nd->nkd", bad_in, qi).reshape(len(qi), -1), begin)
            qi *= good_in[:, None]
            self._scatter(3, np.concatenate([rows, drawn.take(k.take(begin), axis=0).ravel()]), np.concatenate([qi, push.reshape(-1, DIM + 2)]))
        back = np.empty_like(order)
        back[order] = np.arange(n)
        dq = dq[:, :DIM].take(back, axis=0)
        gr = np.zeros((len(codes), codes.shape[1] * DIM), np.float32)
        for c, near in zip(net.c, before):
            gr[:, near] += (dq @ c.T).reshape(len(codes), -1)
        gc = np.stack([r.reshape(len(codes), -1)[:, near].reshape(n, DIM).T @ dq for near in before])
        self._scatter(0, codes.ravel(), gr.reshape(-1, DIM))
        self._move(1, gc)
        self._move(2, gv)

    def run(self, stream: np.ndarray) -> None:
        """Go over a stream once, its runs in random order."""
        padded = np.full(CONTEXT + -(-len(stream) // SEGMENT) * SEGMENT, self.start, np.int32)
        padded[CONTEXT : CONTEXT + len(stream)] = stream
        runs = np.lib.stride_tricks.sliding_window_view(padded, CONTEXT + SEGMENT)[::SEGMENT]
        order = self.rng.permutation(len(runs))
        for a in range(0, len(order), BATCH // SEGMENT):
            self.step(runs[order[a : a + BATCH // SEGMENT]])


def code_stream(texts: list[np.ndarray], start: int) -> tuple[np.ndarray, np.ndarray]:
    """The codes of texts one after the other, each behind CONTEXT starts, and which places are tokens."""
    lengths = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(lengths + CONTEXT) - lengths - CONTEXT
    is_token = np.ones(int((lengths + CONTEXT).sum()), bool)
    for i in range(CONTEXT):
        is_token[begins + i] = False
    stream = np.full(len(is_token), start, np.int32)
    stream[is_token] = np.concatenate(texts) if texts else 0
    return stream, is_token


def train(encoded: DataFrame, tokens: int, vocab: Vocabulary, net: Net, class_share: np.ndarray, row_share: np.ndarray) -> Net:
    """The average, weighted by tokens, of what every shard of the training texts teaches."""
    spark = encoded.sparkSession
    held = spark.sparkContext.broadcast((replace(vocab, head={}), net, class_share, row_share))  # places and a network, both bounded
    shards = max(1, -(-tokens // SHARD_TOKENS))
    rows = encoded.filter(~F.col("held_out")).select(F.xxhash64("doc_id", "codes").alias("h"), "codes")
    rows = rows.select(F.pmod("h", F.lit(shards)).cast("int").alias("shard"), "h", "codes")

    def learn(table: pa.Table) -> pa.Table:
        vocab, net, class_share, row_share = held.value
        table = table.sort_by([("h", "ascending")])
        trainer = Trainer(net, vocab, class_share, row_share, seed=table["shard"][0].as_py())
        waiting, size, seen = [], 0, 0
        for cell in table["codes"]:
            codes = np.frombuffer(cell.as_buffer(), np.uint16)
            waiting.append(codes)
            size, seen = size + len(codes), seen + len(codes)
            if size >= BLOCK:
                trainer.run(code_stream(waiting, len(vocab.code_class))[0])
                waiting, size = [], 0
        if waiting:
            trainer.run(code_stream(waiting, len(vocab.code_class))[0])
        return pa.table({"shard": [table["shard"][0].as_py()], "n": [seen], "net": pa.array([trainer.net.pack()], pa.binary())}, schema=schema)

    def summed(group: int, total: int, flat: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([total], pa.int64()), pa.array([(flat / total).astype(np.float32).tobytes()], pa.binary())], names=["part", "n", "net"])

    def average(batches):
        total, flat, group = 0, None, None
        for batch in batches:
            for g, n, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                if group is not None and g != group:
                    yield summed(group, total, flat)
                    total, flat = 0, None
                x = np.frombuffer(raw.as_buffer(), np.float32).astype(np.float64) * n
                flat, total, group = x if flat is None else flat + x, total + n, g
        if flat is not None:
            yield summed(group, total, flat)

    schema = pa.schema([("shard", pa.int32()), ("n", pa.int64()), ("net", pa.binary())])
    nets = rows.groupBy("shard").applyInArrow(learn, "shard int, n bigint, net binary")
    while shards > 1:  # AVERAGED networks become one in a task, level by level
        shards = -(-shards // AVERAGED)
        below = nets.select(F.floor(F.col("shard") / AVERAGED).cast("int").alias("part"), "shard", "n", "net")
        below = below.repartition(shards, "part").sortWithinPartitions("part", "shard")
        nets = below.mapInArrow(average, "part int, n bigint, net binary").withColumnRenamed("part", "shard")
    row = nets.first()  # one network
    return net.like(np.frombuffer(row["net"], np.float32)) if row else net


def vocabulary(counts: DataFrame) -> tuple[Vocabulary, np.ndarray, np.ndarray, int, int]:
    """The words' classes and places from the counts of all words, the shares of classes and rows, and the numbers of tokens and words."""
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n_tokens, n_words = total["n"] or 0, total["v"]
    level = F.floor(F.log2("n") * 32).cast("int")
    short = counts.filter(F.octet_length("word").between(1, LONGEST))
    fits, at_least = 0, 1 << 30
    for row in short.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # 32 levels for a doubling
        fits += row["count"]
        if fits > HEAD:
            break
        at_least = row["level"]
    table = short.filter(level >= at_least).unionByName(counts.filter(F.octet_length("word") == 0)).toArrow()  # HEAD words and the end
    words, n = table["word"].to_pylist(), table["n"].to_numpy()
    order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
    singles = [words[i] for i in order if words[i]][:SINGLES]
    tail = F.expr("substring(word, greatest(1, octet_length(word) - 2), 3)")
    others = counts.filter(~F.col("word").isin(singles + [b""])) if singles else counts.filter(F.octet_length("word") > 0)
    ends = others.groupBy(tail.alias("end")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "end").limit(SUFFIXES).collect()
    vocab = Vocabulary(
        {w: 1 + i for i, w in enumerate(singles)}, {bytes(r["end"]): 1 + SINGLES + i for i, r in enumerate(ends)}
    )
    held = counts.sparkSession.sparkContext.broadcast(vocab)

    def by_class(batches):
        sums = np.zeros((2, CLASSES), np.int64)
        for batch in batches:
            c = np.fromiter(map(held.value.class_of, batch.column(0).to_pylist()), np.int64, batch.num_rows)
            np.add.at(sums[0], c, batch.column(1).to_numpy())
            sums[1] += np.bincount(c, minlength=CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(sums[0]), pa.array(sums[1])], names=["k", "n", "types"])

    class_n, types = np.zeros(CLASSES), np.zeros(CLASSES)
    found = counts.select("word", "n").mapInArrow(by_class, "k bigint, n bigint, types bigint").groupBy("k").agg(F.sum("n").alias("n"), F.sum("types").alias("t"))
    for r in found.collect():
        class_n[r["k"]], types[r["k"]] = r["n"], r["t"]

    # Places by count, in the classes that words share.
    of = np.array([vocab.class_of(words[i]) for i in order], np.int64)
    placed: list[list[int]] = [[] for _ in range(CLASSES)]
    for i, k in enumerate(of.tolist()):
        if k > SINGLES and len(placed[k]) < PLACES - 1:
            placed[k].append(i)
    code, rows, codes = of.copy(), [0], list(range(CLASSES))
    code_row, row_n = [-1] * CLASSES, []
    for k in range(CLASSES):
        if k > SINGLES:
            mine = [float(n[order[i]]) for i in placed[k]]
            code_row[k] = len(row_n)
            row_n += [max(0.5, class_n[k] - sum(mine)), *mine]
            for j, i in enumerate(placed[k]):
                code[i] = len(codes)
                codes.append(k)
                code_row.append(code_row[k] + 1 + j)
        rows.append(len(row_n))
    vocab.code_class, vocab.code_row, vocab.class_row = np.array(codes), np.array(code_row), np.array(rows)
    vocab.head = {words[i]: k for k, i in enumerate(order)}
    vocab.head_code = code.astype(np.uint16)
    vocab.head_log = np.log10(n[order] + 1.0) if len(order) else np.zeros(0)
    with_place = np.bincount(of, code >= CLASSES, minlength=CLASSES) if len(of) else np.zeros(CLASSES)
    place_n = np.bincount(of, n[order] * (code >= CLASSES), minlength=CLASSES) if len(of) else np.zeros(CLASSES)
    vocab.other_log = np.log10(class_n - place_n + types - with_place + 1)
    row_n = np.array(row_n)
    row_share = row_n / np.repeat(np.add.reduceat(row_n, vocab.class_row[SINGLES + 1 : -1]), np.diff(vocab.class_row)[SINGLES + 1 :])
    class_share = (class_n + 0.5) / (class_n.sum() + 0.5 * CLASSES)
    return vocab, class_share, row_share, n_tokens, n_words


_ENCODED = ("n_tokens bigint, n_known bigint, log_count double, inside double, tail array<binary>, tail_n array<bigint>, codes binary")


def encode(rows: DataFrame, vocab: Vocabulary) -> DataFrame:
    """``doc_id``, ``held_out``, the codes of each text, its sums over words of the head, and the distinct other words with their numbers."""
    held = rows.sparkSession.sparkContext.broadcast(vocab)  # HEAD words

    def run(batches):
        vocab = held.value
        known = Codes(vocab)
        code, end = known.__getitem__, np.array([known[b""]], np.int32)
        head_log = np.append(vocab.head_log, 0.0)
        head_code = np.append(vocab.head_code, np.uint16(0)).astype(np.int32)
        for batch in batches:
            for piece in slices(batch, "text"):
                sums, tails, tails_n, cells = [], [], [], []
                for text in word_lists(piece.column(2)):
                    parts, tail = [], Counter()
                    for words in text:
                        got = np.fromiter(map(code, words), np.int32, len(words))
                        tail.update(words[i] for i in np.flatnonzero(got < 0).tolist())
                        parts.append(got)
                    got = np.concatenate([*parts, end])
                    seen = got >= 0
                    at = np.where(seen, got, -1)
                    codes, logs = np.where(seen, head_code[at], -1 - got), head_log[at]
                    shared = (codes > SINGLES) & (codes < CLASSES)
                    sums.append((len(got), int(seen.sum()), logs.sum(), (logs[shared] - vocab.other_log[codes[shared]]).sum()))
                    tails.append(list(tail.keys()))
                    tails_n.append(list(tail.values()))
                    cells.append(codes.astype(np.uint16).tobytes())
                n_tokens, n_known, log_count, inside = zip(*sums)
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column(0), piece.column(1), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(log_count, pa.float64()),
                        pa.array(inside, pa.float64()), pa.array(tails, pa.list_(pa.binary())), pa.array(tails_n, pa.list_(pa.int64())), pa.array(cells, pa.binary()),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "log_count", "inside", "tail", "tail_n", "codes"],
                )

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {id_type}, held_out boolean, {_ENCODED}")


def model_scores(encoded: DataFrame, vocab: Vocabulary, net: Net, carry: list[str]) -> DataFrame:
    """The columns ``carry`` and ``model``: the log10 probability of each text's classes and places."""
    held = encoded.sparkSession.sparkContext.broadcast((replace(vocab, head={}), net))  # places and a network, both bounded

    def run(batches):
        vocab, net = held.value
        scorer, start = Scorer(net, vocab), len(vocab.code_class)
        for batch in batches:
            for piece in slices(batch, "codes"):
                cells = [np.frombuffer(c.as_buffer(), np.uint16) for c in piece.column(piece.num_columns - 1)]
                stream, is_token = code_stream(cells, start)
                owner = np.repeat(np.arange(len(cells)), [len(c) + CONTEXT for c in cells])
                model = np.zeros(len(cells))
                for a in range(0, len(stream), CHUNK):
                    at = a + np.flatnonzero(is_token[a : a + CHUNK])
                    scores = scorer.log10_next([stream[at - 1 - i] for i in range(CONTEXT)], stream[at])
                    model += np.bincount(owner[at], scores, minlength=len(cells))
                yield pa.RecordBatch.from_arrays([*piece.columns[:-1], pa.array(model)], names=[*carry, "model"])

    schema = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in carry)
    return encoded.select(*carry, "codes").mapInArrow(run, f"{schema}, model double")


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Token counts, the add-one unigram score and the model's score of each text, in log10."""
    k = F.col(f"`{key}`")
    held_out = F.coalesce(F.crc32(k.cast("string").cast("binary")) % HELD_OUT_MOD == HELD_OUT, F.lit(False))
    rows = docs.select(k.alias("doc_id"), held_out.alias("held_out"), F.col(f"`{text}`").cast("string").alias("text"))
    counts = materialize(word_counts(rows.filter(~F.col("held_out"))), "words")
    vocab, class_share, row_share, n_tokens, n_words = vocabulary(counts)
    # Written with a number for each row, by which the counts of other words find back.
    encoded = materialize(encode(rows, vocab).withColumn("row", F.monotonically_increasing_id()), "codes")
    start = Net.start(len(vocab.code_class), class_share, row_share, vocab.code_class)
    net = train(encoded, n_tokens, vocab, start, class_share, row_share)
    carry = ["row", "doc_id", "held_out", "n_tokens", "n_known", "log_count", "inside"]
    scored = model_scores(encoded, vocab, net, carry)
    rare = encoded.select("row", F.inline(F.arrays_zip(F.col("tail").alias("word"), F.col("tail_n").alias("times"))))
    looked = rare.join(counts, "word").groupBy("row").agg(
        F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more_log")
    )
    joined = scored.join(looked, "row", "left")
    more = F.coalesce("more_log", F.lit(0.0))
    per_token = float(np.log10(n_tokens + n_words + 1))
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n_tokens).cast("long").alias("train_tokens"),
        (F.col("log_count") + more - F.col("n_tokens") * per_token).alias("base_score"),
        (F.col("model") + F.col("inside") + more).alias("score"),
    )
