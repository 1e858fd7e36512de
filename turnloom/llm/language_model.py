"""Operator 9: log-likelihood of whole texts by a gated recurrent language model with a class-factored output.

P(word | before) = P(class | state) P(word | class). A word's inputs are a small embedding times a matrix. The state is that of a gated recurrent unit which reads the text word by word; it is carried
from window to window to the end of the text. P(word | class) is the share of its class that the smoothed counts give a word, which is what a
bias for each word of the class would learn; with a state that says nothing, the score would be that of the counts alone. The words
of the model's vocabulary are put in classes by k-means over their neighbours; all others belong to a class by their surface (non-ASCII letters, last
character, length). One more class is the end. Words that are not among the frequent ones, known or not, have the share that the counts give them
in any state, and the classes share the rest; so the probabilities of all known words, the end and the unknown add up to 1.

Everything is learned from all training documents: counts, neighbours of words (both grouped sums), and the network. A pass over the documents
is dealt by hash to `rounds` rounds, so each is read once. In a round every task starts from the broadcast weights, runs truncated
backpropagation over its documents, in chunks of bounded size, and returns what it changed; changes are averaged in two steps of sums
over blocks of weights, by tokens, and for a word's inputs by how often a task met the word. Texts over `SEGMENT` tokens are trained on in
pieces, all of them.

Texts become token ids once; they are stored with what the counts say, and read for neighbours, training and scoring. Frequent words (at most
`head_words`, a fixed bound) go to tasks as arrays; counts of all other words are joined by shuffle. The driver holds weights, the
neighbour table of the vocabulary, and the classes' k-means: all bounded by `vocabulary`.

Defined cases: null, empty and blank texts have the end only; repeated rows are scored each; a row without id counts as id ''; a very long text is
one row of one task; words of equal count are taken into the vocabulary in the order of their hashes; an empty table gives no rows; with no
training document every word is unknown and the score is the base score; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.labelled import id_crc32
from turnloom.llm.storage import materialise
from turnloom.llm.textops import SEPARATOR, Words, slices, utf8_of

END = np.uint64(0x5D2B1F0E9C8A7766)
SURFACES = 24
HIDDEN = 32
CONTEXTS = 64
CHUNK, SEGMENT, WINDOW, EMBEDDING = 1 << 21, 2048, 32, 16
BLOCK_ROWS, FAN_IN = 1024, 256
LOGIT_BLOCK = 1024


def surface(words: Words) -> np.ndarray:
    """0 to 23, from a word's bytes alone."""
    high = np.concatenate([[0], np.cumsum(words.buf >= 128)])
    last = words.buf[words.end - 1]
    tail = np.where(last == 46, 1, np.where(last == 44, 2, np.where((last >= 128) | ((last | 32) >= 97) & ((last | 32) <= 122), 0, 3)))
    return (high[words.end] > high[words.start]) * 12 + tail * 3 + np.searchsorted([5, 9], words.end - words.start, side="right")


def _sorted_runs(h: np.ndarray, extra: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    distinct, at, count = np.unique(h, return_index=True, return_counts=True)
    return distinct, count, extra[at]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each range of texts, added up for each batch; the end's is the number of texts."""
    for batch in batches:
        data, offsets = utf8_of(batch.column(0))
        keys, counts, kinds = [np.array([END])], [np.array([batch.num_rows])], [np.array([SURFACES])]
        for i, j in slices(offsets):
            words = Words(data, offsets[i : j + 1], SEPARATOR)
            if len(words.start):
                for to, part in zip((keys, counts, kinds), _sorted_runs(words.hashes(), surface(words)), strict=True):
                    to.append(part)
        key, count, kind = np.concatenate(keys), np.concatenate(counts), np.concatenate(kinds)
        distinct, at, back = np.unique(key, return_index=True, return_inverse=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(distinct.view(np.int64)), pa.array(np.bincount(back, count).astype(np.int64)), pa.array(kind[at].astype(np.int32))], names=["word", "n", "surface"]
        )


@dataclass
class Model:
    """head: sorted hashes with counts and model ids.

    An id below `vocabulary` is a word of the model; then come the surfaces of the other words of head, the end, and the surfaces of words
    outside head, which have no class (-1) and the inputs of the surfaces before.
    """

    head: np.ndarray
    head_count: np.ndarray
    head_id: np.ndarray
    vocabulary: int
    total: int
    distinct: int
    class_of: np.ndarray
    class_share: np.ndarray
    inputs: np.ndarray
    recurrent: np.ndarray
    output: np.ndarray
    output_bias: np.ndarray
    head_surface: np.ndarray | None = None
    end_count: int = 0

    @property
    def scale(self) -> float:
        return self.total + 0.1 * (self.distinct + 1)

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in head of each hash, and whether it is there."""
        if not len(self.head):
            return np.zeros(len(h), dtype=np.int64), np.zeros(len(h), dtype=bool)
        at = np.minimum(np.searchsorted(self.head, h), len(self.head) - 1)
        return at, self.head[at] == h

    def ids(self, words: Words, at: np.ndarray, there: np.ndarray) -> np.ndarray:
        own = self.vocabulary + surface(words)
        if there.any():
            found = self.head_id[at[there]]
            own[there] = np.where(found >= 0, found, own[there])
        own[~there] += SURFACES + 1
        return own


def _sigmoid(gates: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(gates, out=gates)
    # an overflow gives 0, as it should
    np.exp(gates, out=gates)
    gates += 1
    return np.reciprocal(gates, out=gates)


def _step(h: np.ndarray, x: np.ndarray, u: np.ndarray) -> np.ndarray:
    gates = _sigmoid(x[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
    z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
    new = r * u[:, 2 * HIDDEN :]
    new += x[:, 2 * HIDDEN :]
    np.tanh(new, out=new)
    after = h - new
    after *= z
    after += new
    return after


def log_shares(model: Model, ids: np.ndarray, first: np.ndarray, width: int = 1024, window: int = 32) -> np.ndarray:
    """For each text (ids[first[i] : first[i + 1]]) the sum over tokens of log10 P(class | state) - log10 share of the class."""
    length = np.diff(first)
    out = np.zeros(len(length))
    order = np.argsort(-length, kind="stable")
    share = np.log10(model.class_share)
    # states lie between -1 and 1, so this bounds every logit
    small = float((np.abs(model.output).sum(axis=0) + np.abs(model.output_bias)).max(initial=0)) < 80
    with np.errstate(over="ignore"):
        _add_shares(model, ids, first, length, order, share, small, out, width, window)
    return out


def _add_shares(model: Model, ids: np.ndarray, first: np.ndarray, length: np.ndarray, order: np.ndarray, share: np.ndarray, small: bool, out: np.ndarray, width: int, window: int) -> None:
    output_t = np.ascontiguousarray(model.output.T)
    for g in range(0, len(order), width):
        own = order[g : g + width]
        h = np.zeros((len(own), HIDDEN), dtype=np.float32)
        for t0 in range(0, int(length[own[0]]) if len(own) else 0, window):
            steps = min(window, int(length[own[0]]) - t0)
            active = int(np.searchsorted(-length[own], -t0, side="left"))
            h = h[:active]
            states = np.empty((steps, active, HIDDEN), dtype=np.float32)
            classes = np.full((steps, active), -1, dtype=np.int64)
            base, size = first[own[:active]], length[own[:active]]
            for t in range(steps):
                n = int(np.searchsorted(-size, -(t0 + t), side="left"))
                states[t] = h
                token = ids[base[:n] + t0 + t]
                classes[t, :n] = model.class_of[token]
                h[:n] = _step(h[:n], model.inputs[token], h[:n] @ model.recurrent)
            has = np.flatnonzero(classes.ravel() >= 0)
            chosen = classes.ravel()[has]
            value, flat = np.empty(len(has)), states.reshape(-1, HIDDEN)
            # a block's classes are rows and stay in the cache
            for a in range(0, len(has), LOGIT_BLOCK):
                of = chosen[a : a + LOGIT_BLOCK]
                logits = output_t @ flat[has[a : a + LOGIT_BLOCK]].T
                logits += model.output_bias[:, None]
                if not small:
                    logits -= logits.max(axis=0)
                own_logit = logits[of, np.arange(len(of))]
                value[a : a + LOGIT_BLOCK] = (own_logit - np.log(np.exp(logits, out=logits).sum(axis=0))) / np.log(10) - share[of]
            out[own[:active]] += np.bincount(has % active, value, minlength=active)


def segments(first: np.ndarray, most: int) -> np.ndarray:
    """Offsets of texts cut into pieces of at most `most` tokens."""
    pieces = np.maximum(-(-np.diff(first) // most), 1)
    inside = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return np.append(np.repeat(first[:-1], pieces) + inside * most, first[-1])


def _streams(ids: np.ndarray, first: np.ndarray, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts in random order, end to end, dealt to n streams: (n, longest) token or -1, and whether a text starts."""
    size = np.diff(first)
    order = np.random.Generator(np.random.PCG64(seed)).permutation(len(size))
    end = np.cumsum(size[order])
    stream = np.minimum((end - size[order]) * n // max(int(end[-1]), 1), n - 1)
    begin = end - size[order]
    begin_of = np.searchsorted(stream, np.arange(n))
    base = np.append(begin, end[-1])[begin_of]
    flat = ids[np.repeat(first[:-1][order] - begin, size[order]) + np.arange(end[-1])]
    row = np.repeat(stream, size[order])
    column = np.arange(end[-1]) - base[row]
    token = np.full((n, int(column.max(initial=0)) + 1), -1, dtype=np.int64)
    fresh = np.zeros(token.shape, dtype=bool)
    token[row, column] = flat
    some = size[order] > 0
    fresh[stream[some], begin[some] - base[stream[some]]] = True
    return token, fresh


def input_places(class_of: np.ndarray) -> np.ndarray:
    """The row of inputs of each id: of words outside head, the one of their surface."""
    places = np.arange(len(class_of))
    return np.where(places < len(places) - SURFACES, places, places - SURFACES - 1)


def initial_weights(class_share: np.ndarray, n_ids: int) -> list[np.ndarray]:
    """Embeddings, then what turns them into inputs, recurrent, output and output bias; the output starts at the shares of the classes."""
    rng = np.random.Generator(np.random.PCG64(10))
    return [
        rng.normal(0, 0.3, (n_ids, EMBEDDING)).astype(np.float32),
        rng.normal(0, EMBEDDING**-0.5, (EMBEDDING, 3 * HIDDEN)).astype(np.float32),
        rng.normal(0, HIDDEN**-0.5, (HIDDEN, 3 * HIDDEN)).astype(np.float32),
        np.zeros((HIDDEN, len(class_share)), dtype=np.float32),
        np.log(class_share).astype(np.float32),
    ]


class Trainer:
    """Truncated backpropagation over windows, the state going on within a text. Adam for all but the embeddings, whose rows take steps by their own past gradients."""

    def __init__(self, weights: list[np.ndarray], class_of: np.ndarray, rate: float):
        self.p, self.class_of, self.rate = [q.copy() for q in weights], class_of, rate
        self.input_of = input_places(class_of)
        self.moments = [(np.zeros_like(q), np.zeros_like(q)) for q in self.p[1:]]
        self.squares = np.zeros_like(self.p[0])
        self.met = np.zeros(len(self.p[0]), dtype=np.int64)
        self.step = self.clipped = 0

    def gradients(self, own: np.ndarray, start: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray, float]:
        """(token, gradient of its embedding) of each token, gradients of the other weights, the last state, and the loss a token."""
        with np.errstate(over="ignore"):
            return self._gradients(own, start, h)

    def _gradients(self, own: np.ndarray, start: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray, float]:
        embed, into, recurrent, output, bias = self.p
        kind, n, steps = into.dtype, *own.shape
        valid = own.T >= 0
        token = np.where(valid, own.T, 0)
        token_in = self.input_of[token]
        target = np.where(valid, self.class_of[token], -1)
        embedded, keep = embed[token_in], (~start.T).astype(np.float32)
        count = max(int(np.count_nonzero(target >= 0)), 1)
        # a unit is a row and a stream a column: gates lie apart, and what a step needs stays in the cache
        shape = (steps, HIDDEN, n)
        before, new, u_new, d_states = (np.empty(shape, kind) for _ in range(4))
        gates = np.empty((steps, 2 * HIDDEN, n), kind)
        into_t, recurrent_t, output_t = (np.ascontiguousarray(w.T) for w in (into, recurrent, output))
        d_into, d_recurrent, d_output, d_bias = (np.zeros_like(w) for w in (into, recurrent, output, bias))
        h, loss = np.ascontiguousarray(h.T), 0.0
        for t in range(steps):
            np.multiply(h, keep[t], out=before[t])
            u, x = recurrent_t @ before[t], into_t @ embedded[t].T
            _sigmoid(np.add(u[: 2 * HIDDEN], x[: 2 * HIDDEN], out=gates[t]))
            u_new[t] = u[2 * HIDDEN :]
            np.multiply(gates[t, HIDDEN:], u_new[t], out=new[t])
            new[t] += x[2 * HIDDEN :]
            np.tanh(new[t], out=new[t])
            h = before[t] - new[t]
            h *= gates[t, :HIDDEN]
            h += new[t]
            prob = output_t @ before[t]
            prob += bias[:, None]
            np.exp(prob, out=prob)
            sums, aimed = prob.sum(axis=0), np.flatnonzero(target[t] >= 0)
            to = target[t, aimed]
            loss -= float(np.log(np.maximum(prob[to, aimed] / sums[aimed], 1e-30)).sum())
            prob *= np.where(target[t] >= 0, 1 / (sums * count), 0).astype(kind)
            prob[to, aimed] -= kind.type(1 / count)
            np.matmul(output, prob, out=d_states[t])
            d_output += before[t] @ prob.T
            d_bias += prob.sum(axis=1)
        dx, du = np.empty((3 * HIDDEN, n), kind), np.empty((3 * HIDDEN, n), kind)
        dh, d_embedded = np.zeros_like(h), np.empty_like(embedded)
        for t in range(steps - 1, -1, -1):
            z, r = gates[t, :HIDDEN], gates[t, HIDDEN:]
            dz, dr, dn = dx[:HIDDEN], dx[HIDDEN : 2 * HIDDEN], dx[2 * HIDDEN :]
            # of the state's change z hands on its own share, the new state the rest
            own_share = dh * z
            np.subtract(dh, own_share, out=dn)
            np.subtract(before[t], new[t], out=dz)
            dz *= dn
            dz *= z
            np.multiply(new[t], new[t], out=dr)
            np.subtract(1, dr, out=dr)
            dn *= dr
            np.multiply(r, r, out=dr)
            np.subtract(r, dr, out=dr)
            dr *= u_new[t]
            dr *= dn
            du[: 2 * HIDDEN] = dx[: 2 * HIDDEN]
            np.multiply(dn, r, out=du[2 * HIDDEN :])
            dh = recurrent @ du
            dh += own_share
            dh += d_states[t]
            dh *= keep[t]
            d_into += embedded[t].T @ dx.T
            d_recurrent += before[t] @ du.T
            np.matmul(dx.T, into_t, out=d_embedded[t])
        met = np.flatnonzero(valid.ravel())
        return token_in.ravel()[met], d_embedded.reshape(len(token_in.ravel()), -1)[met], [d_into, d_recurrent, d_output, d_bias], np.ascontiguousarray(h.T), loss / count

    def _update(self, token: np.ndarray, dx: np.ndarray, others: list[np.ndarray]) -> None:
        if not all(np.isfinite(g).all() for g in (dx, *others)):
            # a step that went too far is cut to a short one, and counted
            self.clipped += 1
            short = lambda g: np.clip(np.nan_to_num(g, nan=0.0, posinf=1.0, neginf=-1.0), -1, 1)
            dx, others = short(dx), [short(g) for g in others]
        self.step += 1
        for q, g, (m, s) in zip(self.p[1:], others, self.moments, strict=True):
            m += np.float32(0.1) * (g - m)
            s += np.float32(0.01) * (g * g - s)
            q -= np.float32(self.rate / (1 - 0.9**self.step)) * m / (np.sqrt(s / np.float32(1 - 0.99**self.step)) + np.float32(1e-7))
        order = np.argsort(token, kind="stable")
        rows, begin, times = np.unique(token[order], return_index=True, return_counts=True)
        g = np.add.reduceat(dx[order], begin, axis=0)
        self.met[rows] += times
        self.squares[rows] += g * g
        self.p[0][rows] -= np.float32(5 * self.rate) * g / (np.sqrt(self.squares[rows]) + np.float32(1e-7))

    def chunk(self, ids: np.ndarray, first: np.ndarray, seed: int) -> float:
        """One pass over these texts; the loss of the last window."""
        streams = int(np.clip(len(ids) // (64 * WINDOW), 16, 1024))
        token, fresh = _streams(ids, segments(first, SEGMENT), streams, seed)
        h, loss = np.zeros((streams, HIDDEN), dtype=np.float32), 0.0
        for t0 in range(0, token.shape[1], WINDOW):
            # a stream has no gaps, so one that begins no token here has ended
            live = np.flatnonzero(token[:, t0] >= 0)
            if len(live):
                tokens, dx, others, h[live], loss = self.gradients(token[live, t0 : t0 + WINDOW], fresh[live, t0 : t0 + WINDOW], h[live])
                self._update(tokens, dx, others)
        return loss


SUM_SCHEMA = "block int, part int, ids binary, weights binary, changes binary"


def _change_rows(trainer: Trainer, start: list[np.ndarray], part: int) -> pa.RecordBatch:
    """What a task changed, times its weight: block -1 the dense weights by tokens, block k those embeddings of BLOCK_ROWS words that it met, by how often."""
    total = int(trainer.met.sum())
    dense = np.concatenate([(q - w).ravel() for q, w in zip(trainer.p[1:], start[1:], strict=True)]).astype(np.float64) * total
    rows = [(-1, part, np.zeros(1, dtype=np.int64), np.full(1, total, dtype=np.float64), dense)]
    met = np.flatnonzero(trainer.met)
    change = (trainer.p[0][met] - start[0][met]) * trainer.met[met, None]
    edges = np.searchsorted(met, np.arange(0, len(trainer.met) + BLOCK_ROWS, BLOCK_ROWS))
    for k in np.flatnonzero(np.diff(edges)):
        own = slice(edges[k], edges[k + 1])
        rows.append((int(k), part, met[own], trainer.met[met[own]].astype(np.float64), change[own].astype(np.float32)))
    return _sum_batch(rows)


def _sum_batch(rows: list[tuple]) -> pa.RecordBatch:
    block, part, *arrays = zip(*rows, strict=True) if rows else ((), (), (), (), ())
    binary = [pa.array([x.tobytes() for x in column], pa.binary()) for column in arrays]
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(part, pa.int32()), *binary], names=["block", "part", "ids", "weights", "changes"])


def _sum_block(table: pa.Table) -> pa.Table:
    """One row for the rows of a block: sums of weights and changes by id, added in the order of their parts, so that every run gives the same."""
    table = table.sort_by("part")
    block, part = (table.column(c)[0].as_py() for c in ("block", "part"))
    kind = np.float64 if block < 0 else np.float32
    read = lambda name, dtype: [np.frombuffer(x, dtype=dtype) for x in table.column(name).to_pylist()]
    ids, weights = read("ids", np.int64), read("weights", np.float64)
    distinct, back = np.unique(np.concatenate(ids), return_inverse=True)
    weight, at, changes = np.zeros(len(distinct)), 0, None
    for own, w, change in zip(ids, weights, read("changes", kind), strict=True):
        to = back[at : at + len(own)]
        at += len(own)
        weight[to] += w
        change = change.reshape(len(own), -1)
        changes = np.zeros((len(distinct), change.shape[1])) if changes is None else changes
        changes[to] += change
    return pa.Table.from_batches([_sum_batch([(block, part // FAN_IN, distinct, weight, changes.astype(kind))])])


def train(documents: DataFrame, class_of: np.ndarray, class_share: np.ndarray, n_ids: int, rounds: int, tokens: int, rate: float = 0.02, shard_tokens: int = 1 << 20) -> list[np.ndarray]:
    """Weights after one pass over all documents (doc_id, ids), a share of them in each round.

    Rounds and shards, about shard_tokens each of the `tokens` of a round, are dealt by a digest of id and tokens and read in its order, so that the weights don't depend on how the table was written.
    """
    weights = initial_weights(class_share, n_ids)
    key = F.xxhash64("doc_id", "ids")
    shards = max(1, -(-tokens // (rounds * shard_tokens)))
    context = documents.sparkSession.sparkContext
    for turn in range(rounds):
        shared = context.broadcast((weights, class_of))
        own_rate = rate * 0.7**turn

        def run(batches: Iterator[pa.RecordBatch], shared=shared, own_rate=own_rate, turn=turn) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            start, classes = shared.value
            trainer, part, held, size, chunks = None, TaskContext.get().partitionId(), [], 0, 0
            for batch in batches:
                for raw in batch.column("ids").to_pylist():
                    held.append(np.frombuffer(raw, dtype=np.uint16))
                    size += len(held[-1])
                    if size >= CHUNK:
                        trainer = trainer or Trainer(start, classes, own_rate)
                        trainer.chunk(np.concatenate(held).astype(np.int64), np.cumsum([0, *map(len, held)]), 1000 * turn + chunks)
                        held, size, chunks = [], 0, chunks + 1
            if held:
                trainer = trainer or Trainer(start, classes, own_rate)
                trainer.chunk(np.concatenate(held).astype(np.int64), np.cumsum([0, *map(len, held)]), 1000 * turn + chunks)
            yield _change_rows(trainer, start, part) if trainer else _sum_batch([])

        own = documents.where(F.pmod(F.shiftright(key, 32), F.lit(rounds)) == turn).withColumn("key", key)
        own = own.repartition(shards, "key").sortWithinPartitions("key", "doc_id", "ids").select("ids")
        changes = own.mapInArrow(run, SUM_SCHEMA)
        partial = changes.groupBy("block", F.floor(F.col("part") / FAN_IN)).applyInArrow(_sum_block, SUM_SCHEMA)
        total = partial.groupBy("block").applyInArrow(_sum_block, SUM_SCHEMA).toArrow()
        weights = _changed(weights, total)
        shared.unpersist()
    return weights


def _changed(weights: list[np.ndarray], total: pa.Table) -> list[np.ndarray]:
    weights = [q.copy() for q in weights]
    for row in total.to_pylist():
        ids, weight = np.frombuffer(row["ids"], dtype=np.int64), np.frombuffer(row["weights"], dtype=np.float64)
        if row["block"] >= 0:
            weights[0][ids] += np.frombuffer(row["changes"], dtype=np.float32).reshape(len(ids), -1) / weight[:, None].astype(np.float32)
            continue
        change, at = np.frombuffer(row["changes"], dtype=np.float64) / weight[0], 0
        for q in weights[1:]:
            q += change[at : at + q.size].reshape(q.shape).astype(np.float32)
            at += q.size
    return weights


def _count_neighbours(batches: Iterator[pa.RecordBatch], vocabulary: int) -> Iterator[pa.RecordBatch]:
    """(cell, n): how often a frequent word or a surface stands before or after a word of the vocabulary."""
    n = CONTEXTS + SURFACES + 1
    counts = np.zeros(vocabulary * 2 * n, dtype=np.int64)
    context_of = np.where(np.arange(vocabulary) < CONTEXTS, np.arange(vocabulary), -1)
    context_of = np.concatenate([context_of, CONTEXTS + np.arange(SURFACES + 1), CONTEXTS + np.arange(SURFACES)])
    for batch in batches:
        for raw in (batch.column("ids").to_pylist()[k : k + 512] for k in range(0, batch.num_rows, 512)):
            ids = np.frombuffer(b"".join(raw), dtype=np.uint16).astype(np.int64)
            # a text ends with the end, before which no word of another text stands
            a, b = ids[:-1], ids[1:]
            inside = a != vocabulary + SURFACES
            for word, other, shift in ((a, b, 0), (b, a, n)):
                c = context_of[other]
                good = inside & (word < vocabulary) & (c >= 0)
                counts += np.bincount(word[good] * (2 * n) + c[good] + shift, minlength=len(counts))
    cells = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(counts[cells])], names=["cell", "n"])


def word_classes(neighbours: pa.Table, vocabulary: int, n_classes: int) -> np.ndarray:
    """A class for each of the vocabulary's words by k-means over which frequent words and surfaces stand before and after it."""
    vectors = np.zeros(vocabulary * 2 * (CONTEXTS + SURFACES + 1), dtype=np.float32)
    vectors[neighbours.column("cell").to_numpy()] = neighbours.column("n").to_numpy()
    vectors = vectors.reshape(vocabulary, 2 * (CONTEXTS + SURFACES + 1))
    expected = np.maximum(vectors.sum(1, keepdims=True) * vectors.sum(0, keepdims=True) / max(float(vectors.sum()), 1.0), 1e-6)
    vectors = np.log1p(vectors / expected) * np.minimum(vectors, 1)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-6)
    rng = np.random.Generator(np.random.PCG64(11))
    centre = vectors[rng.choice(vocabulary, min(n_classes, vocabulary), replace=False)] if vocabulary else vectors
    own = np.zeros(vocabulary, dtype=np.int64)
    for _ in range(12 if vocabulary else 0):
        own = (vectors @ centre.T).argmax(axis=1)
        order = np.argsort(own, kind="stable")
        some, begin = np.unique(own[order], return_index=True)
        sums = np.zeros_like(centre)
        sums[some] = np.add.reduceat(vectors[order], begin, axis=0)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centre = np.where(size > 0, sums / np.maximum(size, 1e-6), centre)
    return own


def held_out():
    return id_crc32("doc_id") % 10 == 0


def frequent_words(counts: DataFrame, head_words: int, vocabulary: int) -> Model:
    """A model without classes and network. counts: (word, n, surface), stored."""
    by_count = counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n"))
    least, taken = None, 0
    for r in by_count.toLocalIterator():
        if taken + r.words > head_words:
            break
        least, taken = r.n, taken + r.words
    total, distinct = (int(x or 0) for x in counts.agg(F.sum("n"), F.count("*")).first())
    end = counts.where(F.col("word") == int(END.view(np.int64))).select("n").first()
    # where even the most frequent words are too many, those that come first by hash are taken
    frequent = (counts.where(F.col("n") >= least) if least is not None else counts.orderBy(F.desc("n"), "word").limit(head_words)).toArrow()
    head, n, kind = (frequent.column(c).to_numpy() for c in ("word", "n", "surface"))
    head = head.view(np.uint64)
    rank = np.lexsort((head, -n))
    rank = rank[kind[rank] < SURFACES][:vocabulary]
    ids = np.full(len(head), -1, dtype=np.int32)
    ids[rank] = np.arange(len(rank))
    order = np.argsort(head)
    n_ids = len(rank) + 2 * SURFACES + 1
    none = np.zeros((n_ids, 3 * HIDDEN), dtype=np.float32)
    return Model(
        head[order], n[order].astype(np.int64), ids[order], len(rank), total, distinct, np.zeros(n_ids, dtype=np.int64), np.ones(1), none, none[:HIDDEN], none[:HIDDEN, :1], none[0, :1],
        head_surface=kind[order], end_count=int(end.n) if end else 0,
    )


def fit(model: Model, documents: DataFrame, n_classes: int, rounds: int) -> Model:
    """The model with classes and network, from the training documents (doc_id, ids)."""
    vocabulary = model.vocabulary
    neighbours = documents.select("ids").mapInArrow(lambda it: _count_neighbours(it, vocabulary), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    own = word_classes(neighbours, vocabulary, n_classes)
    class_of = np.concatenate([own, n_classes + np.arange(SURFACES + 1), np.full(SURFACES, -1)])
    # smoothed counts of the words of head, by class, and the end's
    word = model.head_surface < SURFACES
    of_word = np.where(model.head_id >= 0, class_of[np.maximum(model.head_id, 0)], n_classes + model.head_surface)[word]
    mass = np.bincount(of_word, model.head_count[word] + 0.1, minlength=n_classes + SURFACES + 1).astype(np.float64)
    mass[-1] += model.end_count + 0.1
    class_share = np.maximum(mass, 1e-6) / np.maximum(mass, 1e-6).sum()
    embed, into, recurrent, output, bias = train(documents, class_of, class_share, vocabulary + SURFACES + 1, rounds, model.total)
    return replace(model, class_of=class_of, class_share=class_share, inputs=(embed @ into)[input_places(class_of)], recurrent=recurrent, output=output, output_bias=bias)


def _tokens(model: Model, words: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token ids with ends, offsets, and of the words alone: hashes, place in head, whether there."""
    h = words.hashes()
    at, there = model.lookup(h)
    ids = np.insert(model.ids(words, at, there), words.first[1:], model.vocabulary + SURFACES)
    return ids, words.first + np.arange(n + 1), h, at, there


PART_SCHEMA = "row long, doc_id long, held_out boolean, n_tokens long, known long, head_score double, rare array<struct<word:long,times:int>>, ids binary"


def _parts(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """What the counts of frequent words tell of each text, the rare words to be joined with their counts, and the token ids."""
    log_count = np.log10(model.head_count + 0.1)
    for batch in batches:
        data, offsets = utf8_of(batch.column("text"))
        for i, j in slices(offsets):
            words = Words(data, offsets[i : j + 1])
            ids, first, h, at, there = _tokens(model, words, j - i)
            flat, edges = ids.astype(np.uint16).tobytes(), (2 * first).tolist()
            # without a frequent word bincount gives whole numbers, whatever the weights
            known, head_score = np.bincount(words.text_of[there], minlength=j - i), np.bincount(words.text_of[there], log_count[at[there]], minlength=j - i).astype(np.float64)
            rare_h, rare_text = h[~there], words.text_of[~there]
            order = np.lexsort((rare_h, rare_text))
            rare_h, rare_text = rare_h[order], rare_text[order]
            new = np.ones(len(rare_h), dtype=bool)
            new[1:] = (rare_h[1:] != rare_h[:-1]) | (rare_text[1:] != rare_text[:-1])
            begin = np.flatnonzero(new)
            rare_first = np.concatenate([[0], np.cumsum(np.bincount(rare_text[begin], minlength=j - i))])
            times = pa.array(np.diff(np.append(begin, len(rare_h))), pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(rare_first, pa.int32()), pa.StructArray.from_arrays([pa.array(rare_h[begin].view(np.int64)), times], names=["word", "times"]))
            texts = pa.array([flat[a:b] for a, b in zip(edges, edges[1:], strict=False)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).slice(i, j - i) for c in ("row", "doc_id", "held_out")), pa.array(np.diff(first)), pa.array(known), pa.array(head_score), lists, texts],
                names=["row", "doc_id", "held_out", "n_tokens", "known", "head_score", "rare", "ids"],
            )


def _lm_scores(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Rows with lm_score in place of ids."""
    for batch in batches:
        lists = [np.frombuffer(x, dtype=np.uint16) for x in batch.column("ids").to_pylist()]
        first = np.cumsum([0, *map(len, lists)])
        ids = np.concatenate(lists).astype(np.int32) if lists else np.zeros(0, dtype=np.int32)
        lm = log_shares(model, ids, first) if len(model.class_share) > 1 else np.zeros(len(lists))
        kept = [c for c in batch.schema.names if c != "ids"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(lm)], names=[*kept, "lm_score"])


def learn(docs: DataFrame, head_words: int = 1 << 19, vocabulary: int = 8192, n_classes: int = 32, rounds: int = 4) -> tuple[Model, DataFrame, DataFrame]:
    """The model; counts of words (word, n, surface); and the rows with token ids (PART_SCHEMA). Learns from rows that are not held out."""
    if vocabulary + 2 * SURFACES >= 1 << 16:
        raise ValueError("token ids are stored in 16 bits")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    counted = own.where(~held_out()).select("text").mapInArrow(_count_words, "word long, n long, surface int")
    counts = materialise(counted.groupBy("word").agg(F.sum("n").alias("n"), F.min("surface").alias("surface")), "word-counts")
    model = frequent_words(counts, head_words, vocabulary)
    lookup = docs.sparkSession.sparkContext.broadcast(model)
    rows = own.select(F.monotonically_increasing_id().alias("row"), "doc_id", held_out().alias("held_out"), "text")
    parts = materialise(rows.mapInArrow(lambda it: _parts(it, lookup.value), PART_SCHEMA), "score-parts")
    if model.total:
        model = fit(model, parts.where("not held_out").select("doc_id", "ids"), n_classes, rounds)
    return model, counts, parts


def score(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; options as for learn."""
    model, counts, parts = learn(docs, **options)
    network = docs.sparkSession.sparkContext.broadcast(replace(model, head=model.head[:0], head_count=model.head_count[:0], head_id=model.head_id[:0], head_surface=None))
    rare = parts.select("row", F.explode("rare").alias("r")).select("row", F.col("r.word").alias("word"), F.col("r.times").alias("times"))
    tail = counts
    if len(model.head):
        least = int(model.head_count.min())
        last = int(model.head[model.head_count == least].view(np.int64).max())
        tail = counts.where((F.col("n") < least) | ((F.col("n") == least) & (F.col("word") > last)))
    joined = rare.join(tail.select("word", "n"), "word").groupBy("row").agg(F.sum("times").alias("rare_known"), F.sum(F.col("times") * (F.log10(F.col("n") + 0.1) + 1.0)).alias("rare_score"))
    scored = parts.drop("rare").mapInArrow(lambda it: _lm_scores(it, network.value), "row long, doc_id long, held_out boolean, n_tokens long, known long, head_score double, lm_score double")
    scale = float(np.log10(model.scale))
    # an unknown word has log10(0.1) = -1; known rare words are raised above that by the join
    unknown = F.col("n_tokens") - 1 - F.col("known")
    base = F.col("head_score") + F.coalesce("rare_score", F.lit(0.0)) - unknown + float(np.log10(model.end_count + 0.1)) - F.col("n_tokens") * scale
    known = F.col("known") + F.coalesce("rare_known", F.lit(0)) + F.lit(int(model.end_count > 0))
    return scored.join(joined, "row", "left").select(
        "doc_id", "held_out", "n_tokens", known.alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), base.alias("base_score"), (base + F.col("lm_score")).alias("score")
    )
