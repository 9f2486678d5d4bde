"""Language-model scoring: a log-bilinear model trained with noise-contrastive estimation, and a smoothed unigram base.

Tokens are words (A-Z as a-z) and one end per document. Symbols are the HEAD most frequent tokens, then one rest for each
ending, which stands for all tokens of that ending that aren't symbols, then words: all further tokens that occur WORD_COUNT
times or more in training, up to the WORDS most frequent, so their number grows with the corpus to a fixed bound. The words
of an ending are dealt by frequency into classes of at most MEMBERS.

The model predicts a symbol from the CONTEXT symbols before it: the predicted vector is the sum of their vectors, each scaled
by its position's weights. Its products with target vectors, plus biases, score the heads, rests and classes, and within a
class its words; both levels are normalised by batched matrix products, and a word's probability is the product of the two.
A rest's probability is shared out by the tokens' smoothed counts.

Training reads every training document: each task runs stochastic gradients over its own tokens from the common start, and
the tasks' parameters are averaged once per pass, a symbol's by how often each task met it. Texts are cut into tokens twice,
to count and to number them; training and scoring read the written numbers. Counts of rare tokens stay distributed: only
counts above a bound that at most TABLE tokens exceed are sent to the tasks, the others are joined by the token's hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _GOLD, materialise, mix, releasing, slices, spread, text_column, words_of

HEAD, ENDINGS = 64, 64  # endings: the low bits of a token
WORDS, WORD_COUNT, MEMBERS = 1 << 15, 20, 256
CONTEXT, DIMENSIONS = 3, 24
#: Noise that places share: of the upper level a batch's, of each class those of ROUND batches; and places of the table that words are drawn from.
NOISE, WORD_NOISE, DRAWS = 64, 32, 1024
BATCH, ROUND, RATE, START, PASSES = 4096, 4, 0.05, 1e-3, 2
TABLE = 400_000
#: Places that are scored by one matrix product.
SCORED = 256
FOLDS, FOLD = 5, 1
#: Characters of texts, and tokens, that are worked on together; a text counts for ROW of either at least.
TOGETHER, TOKENS, ROW = 1_000_000, 200_000, 64
END_TOKEN, _ENDING = np.uint64(0x454E4400), np.uint64(ENDINGS - 1)
#: Distinct tokens that a task counts before it passes them on.
HELD = 2_000_000


def held_out(key: Column) -> Column:
    """Whether the CRC-32 of the id as text has the fold's remainder; a null id hasn't."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS == FOLD, F.lit(False))


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all texts, each with its end, as hashes whose low bits are the number of the ending; and offsets."""
    words, at, tails = words_of(texts)
    endings = mix(tails.astype(np.uint64) * _GOLD) & _ENDING
    return np.insert(words & ~_ENDING | endings, at[1:], END_TOKEN), at + np.arange(len(at))


# ---------------------------------------------------------------- counts


def _ending(token: Column) -> Column:
    return token.bitwiseAND(ENDINGS - 1).cast("int")


def count_tokens(training: DataFrame) -> DataFrame:
    """token, n: of the column text of the training documents."""

    def counted(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.sort(h)
        edges = _edges(h)
        return h[edges[:-1]], np.diff(edges)

    def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        h, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(h, kind="stable")
        first = _edges(h[order])[:-1]
        return h[order[first]], np.add.reduceat(n[order], first)

    def batch(h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["token", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for _, texts in slices(batches, 0, TOGETHER, ROW):
            held.append(counted(tokens(texts)[0]))
            size += len(held[-1][0])
            if size > HELD:
                held = [merged(held)]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield batch(*held[0])
                    held, size = [], 0
        if held:
            yield batch(*merged(held))

    return training.select("text").mapInArrow(releasing(run), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _edges(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values of x, not empty, begin, and the end."""
    return np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1, [len(x)]])


class Table:
    """Numbers of 64-bit hashes, found by open addressing in vectorised steps."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.bits = keys, max(4, int(len(keys) * 4).bit_length())
        self.slots = np.full(1 << self.bits, -1, dtype=np.int32)
        left, place = np.arange(len(keys)), self._first(keys)
        while len(left):
            free = self.slots[place] < 0
            self.slots[place[free]] = left[free]  # of several for a slot, one stays
            lost = self.slots[place] != left
            left, place = left[lost], (place[lost] + 1) & ((1 << self.bits) - 1)

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 if the table doesn't have it."""
        place = self._first(keys)
        out = self.slots[place]
        left = np.flatnonzero((out >= 0) & (self.keys[out] != keys)) if len(self.keys) else np.zeros(0, np.int64)
        while len(left):
            place[left] = (place[left] + 1) & ((1 << self.bits) - 1)
            out[left] = self.slots[place[left]]
            left = left[(out[left] >= 0) & (self.keys[out[left]] != keys[left])]
        return out


class Vocabulary:
    """Symbols, frequent tokens' counts, and sizes of the rests: all of bounded size."""

    def __init__(self, counts: DataFrame):
        level = F.floor(F.log2("n") * 8).cast("int")
        levels = counts.groupBy(level.alias("level")).agg(F.count("*").alias("v")).orderBy(F.desc("level")).collect()
        self.least, taken = 1 << 20, 0  # tokens of this level or above are in the table
        for r in levels:
            taken += r["v"]
            if taken > TABLE:
                break
            self.least = r["level"]
        table = counts.where(level >= self.least).select("token", "n").toPandas()
        total = counts.groupBy(_ending(F.col("token")).alias("ending")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
        self.n, self.v = sum(r["n"] for r in total), sum(r["v"] for r in total)
        rest_n, rest_v = np.zeros(ENDINGS), np.zeros(ENDINGS)
        for r in total:
            rest_n[r["ending"]], rest_v[r["ending"]] = r["n"], r["v"]
        table["u"] = table["token"].to_numpy(np.int64).view(np.uint64)
        table = table.sort_values(["n", "u"], ascending=[False, True], ignore_index=True)
        n, ending = table["n"].to_numpy(np.int64), (table["u"].to_numpy(np.uint64) & _ENDING).astype(np.int64)
        heads = min(HEAD, len(n))
        known = heads + min(WORDS, int((n[heads:] >= WORD_COUNT).sum()))
        np.subtract.at(rest_n, ending[:known], n[:known])
        np.subtract.at(rest_v, ending[:known], 1)
        # words by ending, then frequency; the k-th word of an ending is in its class k // MEMBERS
        order = heads + np.argsort(ending[heads:known], kind="stable")
        rank = np.arange(len(order)) - np.searchsorted(ending[order], ending[order])
        self.first = np.append(np.flatnonzero(rank % MEMBERS == 0), len(order))  # where classes begin among the words
        symbol = HEAD + ending
        symbol[:heads] = np.arange(heads)
        symbol[order] = HEAD + ENDINGS + np.arange(len(order))
        self.symbols = HEAD + ENDINGS + len(order)
        class_of = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        #: The number at the upper level, of each symbol.
        self.upper = np.concatenate([np.arange(HEAD + ENDINGS), HEAD + ENDINGS + class_of]).astype(np.int64)
        share = np.concatenate([np.pad(n[:heads].astype(np.float64), (0, HEAD - heads)), rest_n, np.bincount(class_of, weights=n[order], minlength=len(self.first) - 1)]) + 0.5
        self.share, self.words = share / share.sum(), n[order].astype(np.float64)
        self.rest = np.log10(rest_n + 0.5 * (rest_v + 1))
        self.tokens, self.symbol, self.logs = table["u"].to_numpy(np.uint64), symbol, np.log10(n + 0.5)
        self._table: Table | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_table": None}

    def in_table(self) -> Column:
        """Whether the table has a row of the counts."""
        return F.floor(F.log2("n") * 8).cast("int") >= self.least

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbol, log10 of the smoothed count (0 if not in the table) and whether the table has it, of each token."""
        self._table = self._table or Table(self.tokens)
        at = self._table.find(hashes)
        has = at >= 0
        symbol, logs = HEAD + (hashes & _ENDING).astype(np.int64), np.zeros(len(hashes))
        known = at[has]
        symbol[has], logs[has] = np.take(self.symbol, known), np.take(self.logs, known)
        return symbol, logs, has

    def draws(self) -> tuple[np.ndarray, np.ndarray]:
        """For each class DRAWS words, each about as often as it occurs and at least once, and each word's share of its class's draws."""
        table, times = np.zeros((len(self.first) - 1, DRAWS), dtype=np.int64), np.ones(len(self.words), dtype=np.int64)
        for c, (a, b) in enumerate(zip(self.first[:-1], self.first[1:], strict=True)):
            spare = self.words[a:b] / self.words[a:b].sum() * (DRAWS - (b - a))
            times[a:b] += spare.astype(np.int64)
            times[a + np.argsort(spare.astype(np.int64) - spare, kind="stable")[: DRAWS - times[a:b].sum()]] += 1
            table[c] = np.repeat(np.arange(a, b), times[a:b])
        return table, times / DRAWS


# ---------------------------------------------------------------- model


def shapes(words: Vocabulary) -> tuple[tuple[int, ...], ...]:
    """Of the parameters: context vectors (the last one for "before the text"), position weights, vectors and biases of the upper level, and of the words."""
    upper, members = len(words.share), len(words.words)
    return (words.symbols + 1, DIMENSIONS), (CONTEXT, DIMENSIONS), (upper, DIMENSIONS), (upper,), (members, DIMENSIONS), (members,)


def start(words: Vocabulary, seed: int = 11) -> list[np.ndarray]:
    """Small random vectors; biases at the log shares, so that the untrained model is the unigram one."""
    rng = np.random.default_rng(seed)
    context, position, upper, _, members, _ = shapes(words)
    shares = words.words / np.repeat(np.add.reduceat(words.words, words.first[:-1]), np.diff(words.first)) if len(words.words) else words.words
    p = [rng.normal(0, 0.1, context), np.ones(position), rng.normal(0, 0.1, upper), np.log(words.share), rng.normal(0, 0.1, members), np.log(shares)]
    return [x.astype(np.float32) for x in p]


def _contexts(symbols: np.ndarray, at: np.ndarray, before: int) -> np.ndarray:
    """Symbols with CONTEXT places "before the text" ahead of each text."""
    return np.insert(symbols, np.repeat(at[:-1], CONTEXT), before)


def predicted(p: list[np.ndarray], e: np.ndarray) -> np.ndarray:
    """The predicted vector for each place of context vectors from the CONTEXT ones before it (the first CONTEXT places: of fewer)."""
    out = np.zeros_like(e)
    np.multiply(e[:-1], p[1][0], out=out[1:])
    for j in range(2, CONTEXT + 1):
        out[j:] += p[1][j - 1] * e[:-j]
    return out


def _logistic(x: np.ndarray) -> np.ndarray:
    """The logistic function, in place."""
    with np.errstate(over="ignore"):
        np.exp(np.negative(x, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _summed(rows: np.ndarray, vectors: np.ndarray, numbers: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Distinct rows, and for each the sums of its vectors (two components at a time, as complex numbers), and of its numbers."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")
    rows = rows[order]
    first = _edges(rows)[:-1]
    found = rows[first], np.add.reduceat(np.take(vectors, order, axis=0).view(np.complex64), first, axis=0).view(np.float32)
    return found if numbers is None else (*found, np.add.reduceat(numbers[order], first))


class Trainer:
    """Parameters that one task learns by noise-contrastive estimation, with Adagrad steps of those rows alone that are met.

    A batch's places share NOISE symbols of the upper level. Words learn once in ROUND batches, from the vectors predicted at
    its beginning: the places of a class share WORD_NOISE of its words. Noise is drawn by shares, one from each equal part of
    the distribution.
    """

    def __init__(self, p: list[np.ndarray], words: Vocabulary, seed: int):
        self.words, self.rng = words, np.random.default_rng(seed)
        self.p = [x.astype(np.float32) for x in p]
        self.squares = [np.full(len(x), START, dtype=np.float32) for x in p]
        self.cumulated, self.shift = np.cumsum(words.share), np.log(NOISE * words.share).astype(np.float32)
        self.draws, share = words.draws()
        self.word_shift = np.log(WORD_NOISE * share).astype(np.float32)
        self.seen = np.zeros(words.symbols, dtype=np.int64)

    def learn(self, symbols: np.ndarray, at: np.ndarray) -> None:
        """Steps over all places of texts."""
        self.seen += np.bincount(symbols, minlength=self.words.symbols)
        padded = _contexts(symbols, at, self.words.symbols)
        for a in range(0, len(padded), BATCH * ROUND):
            lead = min(a, CONTEXT)
            part = padded[a - lead : a + BATCH * ROUND]
            more = self._words(part, lead)
            for b in range(lead, len(part), BATCH):
                before = min(b, CONTEXT)
                self._batch(part[b - before : b + BATCH], before, more[b : b + BATCH])

    def _batch(self, part: np.ndarray, lead: int, more: np.ndarray) -> None:
        """A step of all but the words, from the places from lead on; more: the words' gradients of their predicted vectors."""
        p = self.p
        e = np.take(p[0], part, axis=0)
        r = predicted(p, e)[lead:]
        none = np.flatnonzero(part[lead:] == self.words.symbols)
        n = len(r) - len(none)
        if not n:
            return
        target = self.words.upper[np.minimum(part[lead:], self.words.symbols - 1)]
        noise = np.minimum(np.searchsorted(self.cumulated, (np.arange(NOISE) + self.rng.random(NOISE)) / NOISE), len(self.cumulated) - 1)
        q, qn, bias = np.take(p[2], target, axis=0), p[2][noise], p[3] - self.shift
        up = _logistic(np.einsum("ij,ij->i", r, q) + bias[target]) - 1
        down = r @ qn.T
        down += bias[noise]
        down = _logistic(down)
        up[none], down[none] = 0, 0
        q *= up[:, None]
        q += down @ qn
        q += more
        g = np.concatenate([np.zeros((lead, DIMENSIONS), dtype=np.float32), q]) if lead else q
        back, weights = np.zeros_like(e), np.zeros_like(p[1])
        np.multiply(g[1:], p[1][0], out=back[:-1])
        for j in range(2, CONTEXT + 1):
            back[:-j] += p[1][j - 1] * g[j:]
        for j in range(1, CONTEXT + 1):
            weights[j - 1] = np.einsum("ij,ij->j", g[j:], e[:-j])
        noisy = down.T @ r
        r *= up[:, None]
        rows, vectors, biases = _summed(np.concatenate([target, noise]), np.concatenate([r, noisy]), np.concatenate([up, down.sum(axis=0)]))
        self._step(2, rows, vectors)
        self._step(3, rows, biases)
        self._step(0, *_summed(part, back))
        self._step(1, np.arange(CONTEXT), weights / n)

    def _words(self, part: np.ndarray, lead: int) -> np.ndarray:
        """A step of the words among the places from lead on; returns the gradients of all places' predicted vectors."""
        fixed, p = HEAD + ENDINGS, self.p
        out = np.zeros((len(part), DIMENSIONS), dtype=np.float32)
        places = lead + np.flatnonzero((part[lead:] >= fixed) & (part[lead:] < self.words.symbols))
        if not len(places):
            return out
        places = places[np.argsort(part[places].astype(np.uint16), kind="stable")]
        word = part[places] - fixed
        upper = self.words.upper[word + fixed] - fixed
        edges = _edges(upper)
        classes = upper[edges[:-1]]
        r = np.take(p[0], part[places - 1], axis=0)  # CONTEXT places or more are before each
        r *= p[1][0]
        for j in range(2, CONTEXT + 1):
            r += p[1][j - 1] * np.take(p[0], part[places - j], axis=0)
        drawn = self.draws[classes[:, None], ((np.arange(WORD_NOISE) + self.rng.random((len(classes), WORD_NOISE))) * (DRAWS / WORD_NOISE)).astype(np.int64)]
        bias = p[5] - self.word_shift
        own, noise = np.take(p[4], word, axis=0), np.take(p[4], drawn, axis=0)
        up = _logistic(np.einsum("ij,ij->i", r, own) + bias[word]) - 1
        own *= up[:, None]
        down = np.empty((len(word), WORD_NOISE), dtype=np.float32)
        runs = list(zip(edges[:-1].tolist(), edges[1:].tolist(), noise, strict=True))
        for (a, b, q), x in zip(runs, bias[drawn], strict=True):
            np.matmul(r[a:b], q.T, out=down[a:b])
            down[a:b] += x
        down = _logistic(down)
        noisy = np.empty_like(noise)
        for c, (a, b, q) in enumerate(runs):
            own[a:b] += down[a:b] @ q
            np.matmul(down[a:b].T, r[a:b], out=noisy[c])
        out[places] = own
        r *= up[:, None]
        rows, vectors, biases = _summed(np.concatenate([word, drawn.ravel()]), np.concatenate([r, noisy.reshape(-1, DIMENSIONS)]), np.concatenate([up, np.add.reduceat(down, edges[:-1], axis=0).ravel()]))
        self._step(4, rows, vectors)
        self._step(5, rows, biases)
        return out

    def _step(self, k: int, rows: np.ndarray, d: np.ndarray) -> None:
        """An Adagrad step of some rows of the k-th parameter, each with one rate."""
        s = np.take(self.squares[k], rows) + (np.einsum("ij,ij->i", d, d) / DIMENSIONS if d.ndim > 1 else d * d)
        self.squares[k][rows] = s
        rate = RATE / np.sqrt(s)
        self.p[k][rows] = np.take(self.p[k], rows, axis=0) - (d * rate[:, None] if d.ndim > 1 else d * rate)


def log_probabilities(p: list[np.ndarray], words: Vocabulary, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Normalised natural log-probabilities of all symbols: the upper level, and for words their class's level, too.

    Places of a class's words are worked on together, for they share its matrix.
    """
    padded = _contexts(symbols, at, words.symbols)
    upper, fixed = words.upper[symbols], HEAD + ENDINGS
    r, done = np.empty((len(symbols), DIMENSIONS), dtype=np.float32), 0
    for a in range(0, len(padded), BATCH):
        lead = min(a, CONTEXT)
        part = padded[a - lead : a + BATCH]
        block = predicted(p, np.take(p[0], part, axis=0))[lead:]
        if (part[lead:] == words.symbols).any():
            block = block[part[lead:] < words.symbols]
        r[done : done + len(block)] = block
        done += len(block)
    out = normalised(r, p[2], p[3], upper)
    places = np.flatnonzero(symbols >= fixed)
    if len(places):
        places = places[np.argsort(symbols[places].astype(np.uint16), kind="stable")]
        classes = upper[places] - fixed
        edges = _edges(classes)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            own, first, last = places[a:b], *words.first[classes[a] : classes[a] + 2]
            out[own] += normalised(np.take(r, own, axis=0), p[4][first:last], p[5][first:last], symbols[own] - fixed - first)
    return out


def normalised(r: np.ndarray, q: np.ndarray, bias: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log-probabilities of the targets among all rows of q. Only where a product could overflow are the greatest ones taken off first.

    A block of places is one matrix product, exponentials in place and one more product for the sums. Where the vectors'
    lengths bound all products, no block is searched for large ones.
    """
    out, bias = np.empty(len(r)), bias - bias.max()
    weights, own_bias, columns = np.exp(bias), bias[target].astype(np.float64), np.ascontiguousarray(q.T)
    small = len(r) > 0 and np.einsum("ij,ij->i", r, r).max() * np.einsum("ij,ij->i", q, q).max() < 59**2
    for a in range(0, len(r), SCORED):
        scores = r[a : a + SCORED] @ columns
        own = np.arange(len(scores)), target[a : a + SCORED]
        if not small and (scores.max() > 60 or scores.min() < -60):
            scores += bias
            top = scores.max(axis=1)
            scores -= top[:, None]
            own, sums = scores[own].astype(np.float64), np.exp(scores).sum(axis=1, dtype=np.float64)
        else:
            own = scores[own] + own_bias[a : a + SCORED]
            sums = (np.exp(scores, out=scores) @ weights).astype(np.float64)
        out[a : a + SCORED] = own - np.log(sums)
    return out


def _symbols(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts end to end, and offsets."""
    return np.frombuffer(b"".join(values), dtype="<u2").astype(np.int64), np.cumsum([0] + [len(v) // 2 for v in values])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted sums of the rows of each number: a partition holds a row for each of its numbers, as many as symbols at most."""
    found: dict[int, list] = {}
    for batch in batches:
        numbers, weights = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for i, n, x in zip(numbers, weights, batch.column(2).to_pylist(), strict=True):
            x = np.frombuffer(x, dtype="<f4") * n
            if i in found:
                found[i][0] += n
                found[i][1] += x
            else:
                found[i] = [n, x]
    if found:
        yield _rows(np.array(list(found)), np.array([n for n, _ in found.values()]), [x.astype("<f8").tobytes() for _, x in found.values()])


def _rows(number: np.ndarray, n: np.ndarray, x: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(n, pa.float64()), pa.array(x, pa.binary())], names=["number", "n", "x"])


def fit(numbered: DataFrame, vocabulary: Vocabulary) -> list[np.ndarray]:
    """Parameters after PASSES passes over the symbols of all training documents.

    A task sends one row for each symbol that it met, with the symbol's context and word vectors, one for each number of the
    upper level, and the position weights in rows of their own: weighted by how often they were met. Rows are added up by
    number, and the driver gets one sum for each.
    """
    context = numbered.sparkSession.sparkContext
    words, p = context.broadcast(vocabulary), start(vocabulary)
    schema = "number int, n double, x binary"
    for number in range(PASSES):
        sent = context.broadcast(p)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, number=number) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            task, v = TaskContext.get(), words.value
            trainer = Trainer(sent.value, v, 1000 * number + (task.partitionId() if task else 0))
            for _, x in slices(batches, 0, TOKENS, ROW, 2):
                trainer.learn(*_symbols(x))
            if trainer.seen.any():
                yield _rows(*parameter_rows(trainer.p, v, trainer.seen))

        rows = numbered.where(~F.col("held")).select("symbols").mapInArrow(releasing(run), schema)
        sums = rows.repartition("number").mapInArrow(releasing(_sums), schema).toPandas()
        if len(sums):
            p = averaged(p, vocabulary, sums["number"].to_numpy(np.int64), sums["n"].to_numpy(), list(sums["x"]))
    return p


def parameter_rows(p: list[np.ndarray], words: Vocabulary, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Numbers, weights and values: of position weights from -CONTEXT, of symbols from 0, of the upper level after the symbols."""
    met, upper = np.flatnonzero(seen), np.bincount(words.upper, weights=seen, minlength=len(words.share))
    own, word = np.flatnonzero(upper), met - HEAD - ENDINGS
    members = np.concatenate([p[4], p[5][:, None]], axis=1)
    values = [x.tobytes() for x in p[1]]
    values += [x.tobytes() if w < 0 else x.tobytes() + members[w].tobytes() for x, w in zip(p[0][met], word.tolist(), strict=True)]
    values += [x.tobytes() for x in np.concatenate([p[2], p[3][:, None]], axis=1)[own]]
    return np.concatenate([np.arange(-CONTEXT, 0), met, words.symbols + own]), np.concatenate([np.full(CONTEXT, seen.sum()), seen[met], upper[own]]).astype(np.float64), values


def averaged(p: list[np.ndarray], words: Vocabulary, number: np.ndarray, n: np.ndarray, sums: list[bytes]) -> list[np.ndarray]:
    """Parameters from the weighted sums (64-bit) of parameter_rows; those that no task met stay, the "before the text" vector, too."""
    p = [x.copy() for x in p]
    for i, weight, x in zip(number.tolist(), n.tolist(), sums, strict=True):
        x = np.frombuffer(x, dtype="<f8") / weight
        if i < 0:
            p[1][i + CONTEXT] = x
        elif i < words.symbols:
            p[0][i] = x[:DIMENSIONS]
            if i >= HEAD + ENDINGS:
                p[4][i - HEAD - ENDINGS], p[5][i - HEAD - ENDINGS] = x[DIMENSIONS:-1], x[-1]
        else:
            p[2][i - words.symbols], p[3][i - words.symbols] = x[:-1], x[-1]
    return p


# ---------------------------------------------------------------- scores

NUMBERED = "row long, id long, held boolean, n long, known long, base double, spread double, rare array<long>, times array<long>, symbols binary"


def number_tokens(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """NUMBERED of (id, held, text): symbols, what the table knows of the base score, and tokens that it doesn't have, with how often.

    spread: what the model's log10 probability has besides the symbols', the shares of tokens in their rests. ``row`` numbers
    differ from run to run: write the result down before using them.
    """
    sent = rows.sparkSession.sparkContext.broadcast(vocabulary)
    total = np.log10(vocabulary.n + 0.5 * (vocabulary.v + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, row = sent.value, TaskContext.get().partitionId() << 40
        for part, texts in slices(batches, 2, TOGETHER, ROW):
            h, at = tokens(texts)
            symbol, logs, has = words.find(h)
            n, begin = np.diff(at), at[:-1]
            in_rest = (symbol >= HEAD) & (symbol < HEAD + ENDINGS)
            spread = np.where(in_rest, logs - words.rest[np.where(in_rest, symbol - HEAD, 0)], 0.0)
            missing = np.flatnonzero(~has)
            o, t = np.repeat(np.arange(len(n)), n)[missing], h[missing]
            order = np.lexsort((t, o))
            o, t = o[order], t[order]
            new = np.ones(len(o), dtype=bool)
            new[1:] = (o[1:] != o[:-1]) | (t[1:] != t[:-1])
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(o)))
            offsets = pa.array(np.searchsorted(o[first], np.arange(len(n) + 1)), pa.int32())
            data = symbol.astype("<u2").tobytes()
            ends = pa.array(2 * at, pa.int32()).buffers()[1]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row + np.arange(len(n))),
                    part.column(0),
                    part.column(1),
                    pa.array(n),
                    pa.array(np.add.reduceat(has, begin, dtype=np.int64)),
                    pa.array(np.add.reduceat(logs, begin) - n * total),
                    pa.array(np.add.reduceat(spread, begin)),
                    pa.ListArray.from_arrays(offsets, pa.array(t[first].view(np.int64))),
                    pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64())),
                    pa.Array.from_buffers(pa.binary(), len(n), [None, ends, pa.py_buffer(data)]),
                ],
                names=["row", "id", "held", "n", "known", "base", "spread", "rare", "times", "symbols"],
            )
            row += len(n)

    return rows.select("id", "held", "text").mapInArrow(releasing(run), NUMBERED)


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10 of the whole text).

    Null texts count as empty: one token, the end. Repeated rows are documents of their own, in training, too. Without
    training documents every count is 0 and the model is the uniform one over rests. An empty table gives an empty result.
    """
    context = docs.sparkSession.sparkContext
    rows = spread(docs.select(docs[key].cast("long").alias("id"), held_out(docs[key].cast("long")).alias("held"), text_column(docs, text).alias("text")))
    counts = materialise(count_tokens(rows.where(~F.col("held"))), "counts", batch=None)
    vocabulary = Vocabulary(counts)
    numbered = materialise(number_tokens(rows, vocabulary), "numbered", batch=None)
    sent = context.broadcast((vocabulary, fit(numbered, vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, p = sent.value
        for part, values in slices(batches, 7, TOKENS, ROW, 2):
            symbols, at = _symbols(values)
            model = np.add.reduceat(log_probabilities(p, words, symbols, at), at[:-1]) / np.log(10) + part.column(6).to_numpy()
            yield pa.RecordBatch.from_arrays([*part.columns[:6], pa.array(model)], names=["row", "id", "held", "n", "known", "base", "model"])

    scored = numbered.select("row", "id", "held", "n", "known", "base", "spread", "symbols").mapInArrow(releasing(run), "row long, id long, held boolean, n long, known long, base double, model double")
    rare = numbered.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("token"), F.col("x.times").alias("times"))
    met = rare.join(counts.where(~vocabulary.in_table()).select("token", F.col("n").alias("c")), "token", "left")
    more = met.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("logs"), F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("also"))
    out = scored.join(more, "row", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return out.select(F.col("id").alias(key), F.col("held").alias("held_out"), F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("also", F.lit(0))).cast("long").alias("n_known"), F.lit(int(vocabulary.n)).cast("long").alias("train_tokens"), (F.col("base") + logs).alias("base_score"), (F.col("model") + logs).alias("score"))
