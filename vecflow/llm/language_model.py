"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax.

P(word | history) = P(class | history) * P(word | class, history). The class is predicted
by a maximum-entropy model over hashed features of the history: the word before, the
n-gram of the three classes before, and two skip features (classes two and four, three and
five back). Classes: the end of a text, the most frequent words (a class each), and groups
of words by their ending.

Inside a group the word is found in steps of ``WAYS`` branches by digits of its hash, each
step a softmax over hashed pairs of the node and the history (the word before, the two
classes before), until the group has ``SPREAD`` leaves a word or the leaves are used up. A
branch's prior is its smoothed share of the node's training tokens, and words of one leaf
have their smoothed share of it; one unseen word of a group is spread over its leaves, so
the model is a proper distribution.

Training is distributed: texts are dealt to rounds and shares by a hash of id and text (so
copies spread), ``SHARES`` or more at every size, and lie in a share in the order of that
hash: neither files, their order nor the number of partitions change a score. In each round every share runs
mini-batch updates (adaptive steps) from the current parameters over its texts; what it
changed (the rows it touched, no others) is averaged by tokens, first among ``FAN_IN``
shares, then among all. The rounds' texts together are all training texts.

Word counts cover all training texts and stay distributed. Scoring needs a word's count
only in one sum per text; frequent words (``HEAD`` at most, broadcast) are looked up in
the task, the others go through one join by word. Words are told apart by 64-bit hashes.

Defined cases: a null or empty text is its end token alone; a null id belongs to the
training texts; repeated rows are counted and scored each; without training texts, all
counts are 0 and the classes equally likely; an empty table gives no rows; extra columns
are ignored; texts of any length are used whole.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecflow.llm.common import as_bytes, concat_texts, hash_words, mix64, text_slices, word_spans

CLASSES = 32
#: classes of one word each, beside the end
SINGLES = 11
#: rows of the parameter table: word before, class trigram, two skip pairs, constant
WORD_CELLS, GRAM_CELLS = 1 << 13, 1 << 13
CELLS = WORD_CELLS + GRAM_CELLS + 2 * CLASSES * CLASSES + 1
#: branches of a step inside a group (five bits of the hash), leaves wanted for each word, leaves of all groups at most
WAYS, SPREAD, LEAVES = CLASSES, 4, 1 << 21
#: rows of the parameter table of the steps: a quarter of the types, within these bounds
STEP_CELLS = 1 << 10, 1 << 15
STEP_RATE = 0.2
#: words whose counts are broadcast, at most
HEAD = 1 << 18
ROUNDS = 2
RATE = 0.5
BATCH = 4096
#: shares of a round, at least, and training tokens of a share (its parameters are 6.7 MB at most) where there are more
SHARES, SHARD_TOKENS = 8, 2_000_000
#: parts that the parameter table travels in; shares whose changes are added up first
PARTS, FAN_IN = 64, 16
END = 0
#: scores stay within these bounds, so that their exponentials are finite numbers
EDGE = np.float32(60)
_ONES = np.ones(CLASSES, dtype=np.float32)
#: a row of the parameter table as one item
_ROW = np.dtype((np.void, 4 * CLASSES))
#: cells whose occurrences in a batch are added cell by cell
FEW = 32
#: a worker's arrays for the rows of a batch: a fresh one for each batch costs more than what is put into it
_ROOM: dict[str, np.ndarray] = {}


def _room(name: str, rows: int) -> np.ndarray:
    """A (rows, CLASSES) array that is kept, with any contents, until the next call with its name."""
    if name not in _ROOM or len(_ROOM[name]) < rows:
        _ROOM[name] = np.empty((rows, CLASSES), dtype=np.float32)
    return _ROOM[name][:rows]


def _rows(table: np.ndarray, at: np.ndarray, name: str) -> np.ndarray:
    """Rows of a table in the array ``name``."""
    return table.take(at, axis=0, out=_room(name, len(at)), mode="clip")  # without "clip" there is a second copy


def held_out(id) -> bool:
    return id is not None and zlib.crc32(str(id).encode()) % 5 == 1


def training(id):
    """The same fold as a column: true for training texts, a null id among them."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 5 != 1, F.lit(True))


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, endings, index of each text's first word); an ending is the last two bytes, A-Z lower-cased."""
    buf, offsets = concat_texts(texts)
    starts, lengths, at = word_spans(buf, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), at
    last = starts + lengths - 1
    one, two = buf[last].astype(np.int64), np.where(lengths > 1, buf[np.maximum(last - 1, 0)], 0).astype(np.int64)
    one, two = (np.where((x >= 65) & (x <= 90), x + 32, x) for x in (one, two))
    return hash_words(buf, starts, lengths), two << 8 | one, at


@dataclass
class Classes:
    """Bounded summary of the training counts."""

    tokens: int  # N
    types: int  # V
    ends: int  # training texts
    singles: np.ndarray  # hashes, sorted; class i + 1
    single_counts: np.ndarray
    ending: np.ndarray  # class of each ending
    scale: np.ndarray  # log10 of each group's denominator; 0 for classes of one word
    prior: np.ndarray  # log class share
    depth: np.ndarray | None = None  # steps inside each class
    base: np.ndarray | None = None  # [class, step]: first node of the step, a row of ``shares``
    shares: np.ndarray | None = None  # log share of each branch of a node
    places: np.ndarray | None = None  # hash of each node
    cells: int = 0  # rows of the steps' parameter table, a power of two

    def of(self, words: np.ndarray, endings: np.ndarray) -> np.ndarray:
        out = self.ending[endings]
        if len(self.singles):
            k = np.minimum(np.searchsorted(self.singles, words), len(self.singles) - 1)
            out = np.where(self.singles[k] == words, k + 1, out)
        return out


def count_words(docs: DataFrame, text: str, id: str) -> DataFrame:
    """(h, ending, n) of the training texts' words; the end token is left to ``summarise``."""
    def run(batches):
        kept, held = [], 0

        def flush():
            words, endings = np.concatenate([k[0] for k in kept]), np.concatenate([k[1] for k in kept])
            h, first, n = np.unique(words, return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(endings[first].astype(np.int32)), pa.array(n)],
                                              names=["h", "ending", "n"])

        for b in batches:
            texts = [t for i, t in zip(b.column(0).to_pylist(), as_bytes(b.column(1))) if not held_out(i)]
            for lo, hi in text_slices(texts):
                words, endings, _ = words_of(texts[lo:hi])
                kept.append((words, endings))
                held += len(words)
                if held > 1_500_000:
                    yield flush()
                    kept, held = [], 0
        if held:
            yield flush()

    part = docs.select(F.col(id), F.col(text)).mapInArrow(run, "h long, ending int, n long")
    return part.groupBy("h").agg(F.min("ending").alias("ending"), F.sum("n").alias("n"))


def summarise(vocabulary: DataFrame, ends: int) -> Classes:
    top = vocabulary.orderBy(F.desc("n"), "h").limit(SINGLES).collect()
    groups = vocabulary.groupBy("ending").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()  # at most 65536
    n, v = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    for r in groups:
        n[r.ending], v[r.ending] = r.n, r.v
    tokens, types = int(n.sum()) + ends, int(v.sum()) + (ends > 0)
    for r in top:
        n[r.ending] -= r.n
        v[r.ending] -= 1
    singles = sorted((np.int64(r.h).view(np.uint64), r.n) for r in top)
    first = SINGLES + 1
    ending = np.full(1 << 16, CLASSES - 1, dtype=np.int64)
    best = np.lexsort((np.arange(1 << 16), -n))[:CLASSES - 1 - first]
    ending[best] = first + np.arange(len(best))
    mass, kinds = np.bincount(ending, weights=n, minlength=CLASSES), np.bincount(ending, weights=v, minlength=CLASSES)
    scale = np.log10(mass + 0.5 * (kinds + 1))
    scale[:first] = 0
    mass[END] = ends
    mass[1:1 + len(singles)] = [c for _, c in singles]
    prior = np.log((mass + 1) / (mass + 1).sum()) if tokens else np.zeros(CLASSES)
    classes = Classes(tokens, types, ends, np.array([h for h, _ in singles], dtype=np.uint64), np.array([c for _, c in singles], dtype=np.int64),
                      ending, scale, prior.astype(np.float32))
    branch_shares(vocabulary, classes, kinds)
    return classes


def depths(kinds: np.ndarray) -> np.ndarray:
    """Steps of each class with ``kinds`` words: enough for SPREAD leaves a word, all leaves together LEAVES at most."""
    depth = np.zeros(len(kinds), dtype=np.int64)
    while True:
        short = np.flatnonzero((kinds > 0) & (WAYS ** depth < SPREAD * kinds))
        grown = depth + (np.arange(len(kinds))[:, None] == short).T
        fits = (WAYS ** grown * (grown > 0)).sum(axis=1) <= LEAVES
        if not fits.any():
            return depth
        crowd = np.where(fits, kinds[short] / WAYS ** depth[short], -1.0)
        depth[short[np.argmax(crowd)]] += 1


def branch_shares(vocabulary: DataFrame, classes: Classes, kinds: np.ndarray) -> None:
    """Fills in the steps of ``classes``: nodes and the shares of their branches (LEAVES bounds their number)."""
    depth = depths(np.where(np.arange(CLASSES) > SINGLES, kinds, 0).astype(np.int64))
    leaves = np.where(depth > 0, WAYS ** depth, 0)
    first = np.append(0, np.cumsum(leaves))
    block = 1 << 15
    groups = vocabulary.sparkSession.sparkContext.broadcast((classes, depth, first))

    def place(batches):
        classes, depth, first = groups.value
        for b in batches:
            h = b.column(0).to_numpy().view(np.uint64)
            cls = classes.of(h, b.column(1).to_numpy())
            use = np.flatnonzero(depth[cls] > 0)
            leaf = first[cls[use]] + (h[use] >> (64 - 5 * depth[cls[use]]).astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((leaf // block).astype(np.int32)), pa.array((leaf % block).astype(np.int32)),
                                              pa.array(b.column(2).to_numpy()[use])], names=["k", "leaf", "n"])

    def add(batches):
        acc: dict[int, np.ndarray] = {}
        for b in batches:
            k, leaf, n = (c.to_numpy() for c in b.columns)
            for one in np.unique(k):
                at = k == one
                part = np.bincount(leaf[at], weights=n[at] + 0.5, minlength=block)
                acc[one] = acc[one] + part if one in acc else part
        for one, part in acc.items():
            yield pa.RecordBatch.from_pydict({"k": pa.array([int(one)], pa.int32()), "v": pa.array([part.tobytes()], pa.binary())})

    mass = np.zeros((first[-1] // block + 1) * block)
    words = vocabulary.select("h", "ending", "n").mapInArrow(place, "k int, leaf int, n long")
    for r in words.repartition(64, "k").mapInArrow(add, "k int, v binary").collect():
        mass[r.k * block:(r.k + 1) * block] = np.frombuffer(bytes(r.v))
    base, shares, nodes = np.zeros((CLASSES, 8), dtype=np.int64), [], 0
    for c in np.flatnonzero(depth):
        under = mass[first[c]:first[c + 1]] + 0.5 / leaves[c]
        for k in range(depth[c] - 1, -1, -1):
            node = under.reshape(-1, WAYS)
            under = node.sum(axis=1)
            shares.append(np.log(node / under[:, None]).astype(np.float32))
            base[c, k] = nodes
            nodes += len(node)
    low, high = STEP_CELLS
    classes.depth, classes.base = depth, base
    classes.shares = np.concatenate(shares) if shares else np.zeros((0, WAYS), np.float32)
    classes.places = mix64(np.arange(1, len(classes.shares) + 1, dtype=np.uint64))
    classes.cells = min(max(low, 1 << max(0, classes.types // 4).bit_length()), high)


def steps(words: np.ndarray, at: np.ndarray, cls: np.ndarray, classes: Classes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(token, node, branch, feature rows) of the steps inside the tokens' classes, in the order of the tokens."""
    h = np.insert(words, at[1:], np.uint64(0))
    before = np.append(np.uint64(0), h[:-1])  # 0 after a text's end, as h is there
    c1 = np.append(END, cls[:-1])
    c2 = np.where(c1 == END, END, np.append([END, END], cls[:-2])[:len(cls)])
    histories = before, mix64((c1 * CLASSES + c2 + 1).astype(np.uint64))
    depth = classes.depth[cls]
    first = np.append(0, np.cumsum(depth))
    token, node, branch = (np.empty(first[-1], dtype=np.int64) for _ in range(3))
    cells = np.empty((first[-1], len(histories)), dtype=np.int64)
    for lo in range(0, len(cls), BATCH):  # arrays that fit a core's cache
        s = slice(first[lo], first[min(lo + BATCH, len(cls))])
        own = np.repeat(np.arange(lo, min(lo + BATCH, len(cls))), depth[lo:lo + BATCH])
        k = np.arange(s.start, s.stop) - first[own]
        digits = (h[own] >> (59 - 5 * k).astype(np.uint64)).astype(np.int64)  # those before the step, and its own
        token[s], branch[s] = own, digits & (WAYS - 1)
        at_node = node[s] = classes.base[cls[own], k] + (digits >> 5)
        place = classes.places.take(at_node)
        for f, x in enumerate(histories):
            cells[s, f] = mix64(place + (np.uint64(2 * f + 1) * x[lo:lo + BATCH])[own - lo]) & np.uint64(max(classes.cells, 1) - 1)
    return token, node, branch, cells


def step_shares(w: np.ndarray, tokens: int, part: tuple, classes: Classes, factors: tuple | None = None) -> np.ndarray:
    """What the history adds to the logarithm of each token's unigram share inside its class; ``factors``: of w and the shares."""
    token, node, branch, cells = part
    parts = []
    for k in range(0, len(token), BATCH):
        s = slice(k, k + BATCH)
        if factors:
            own, z = _products(factors[0], cells[s], branch[s])
            more = np.log(own) - np.log(np.einsum("ij,ij->i", z, _rows(factors[1], node[s], "more")))
        else:
            prior = classes.shares.take(node[s], axis=0)
            more = log_shares(w, cells[s], branch[s], prior, False) - prior[np.arange(len(prior)), branch[s]]
        parts.append(more)
    return np.bincount(token, weights=np.concatenate(parts), minlength=tokens) if parts else np.zeros(tokens)


def class_shares(w: np.ndarray, rows: np.ndarray, cls: np.ndarray, prior: np.ndarray, factors: tuple | None = None) -> np.ndarray:
    """Natural logarithm of each class's share after its history; ``factors``: of w, and of the prior with the constant."""
    out = np.empty(len(cls))
    for k in range(0, len(cls), BATCH):
        s = slice(k, k + BATCH)
        if factors:
            own, z = _products(factors[0], rows[s], cls[s])
            out[s] = np.log(own * factors[1][cls[s]]) - np.log(z @ factors[1])
        else:
            out[s] = log_shares(w, rows[s], cls[s], prior)
    return out


def factors_of(w: np.ndarray, features: int, last: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Exponentials of parameters and of what is added last, whose products are those of the scores' sums.

    None where a score might leave EDGE, where sums are bounded and products are not.
    """
    if features * np.abs(w).max(initial=0) + np.abs(last).max(initial=0) > EDGE:
        return None
    return np.exp(w), np.exp(last)


def _products(e: np.ndarray, rows: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(each row's own product, products of all classes) of the factors of each history."""
    z = _rows(e, rows[:, 0], "scores")
    for k in range(1, rows.shape[1]):
        z *= _rows(e, rows[:, k], "more")
    return z[np.arange(len(cls)), cls], z


def positions(words: np.ndarray, endings: np.ndarray, at: np.ndarray, classes: Classes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class of each token, feature rows of its history without the constant, index of each text's first token); every text ends with END."""
    cls = np.insert(classes.of(words, endings), at[1:], END)
    w = np.insert(words, at[1:], np.uint64(0))
    first = at + np.arange(len(at))
    nth = np.arange(len(cls)) - np.repeat(first[:-1], np.diff(first))

    def back(x, k):
        out = np.zeros(len(x), dtype=x.dtype)
        out[k:] = x[:-k] if k < len(x) else x[:0]
        out[nth < k] = 0
        return out

    c1, c2, c3, c4, c5 = (back(cls, k) for k in range(1, 6))
    # a text's start is known by its place: END as history stands for it
    rows = np.empty((len(cls), 4), dtype=np.int64)
    rows[:, 0] = back(w, 1) % np.uint64(WORD_CELLS)
    gram = mix64(((c1 * CLASSES + c2) * CLASSES + c3).astype(np.uint64) + np.uint64(1))
    rows[:, 1] = WORD_CELLS + (gram % np.uint64(GRAM_CELLS)).astype(np.int64)
    rows[:, 2] = WORD_CELLS + GRAM_CELLS + c2 * CLASSES + c4
    rows[:, 3] = WORD_CELLS + GRAM_CELLS + CLASSES * CLASSES + c3 * CLASSES + c5
    return cls, rows, first


def _scores(w: np.ndarray, rows: np.ndarray, prior: np.ndarray, constant: bool = True) -> np.ndarray:
    """Scores, within EDGE, of each history's classes, in the array "scores"."""
    z = _rows(w, rows[:, 0], "scores")
    for k in range(1, rows.shape[1]):
        z += _rows(w, rows[:, k], "more")
    z += w[-1] + prior if constant else prior  # the constant row is the last
    return np.clip(z, -EDGE, EDGE, out=z)


def log_shares(w: np.ndarray, rows: np.ndarray, cls: np.ndarray, prior: np.ndarray, constant: bool = True) -> np.ndarray:
    """Natural logarithm of the share that each history gives its class."""
    z = _scores(w, rows, prior, constant)
    own = z[np.arange(len(cls)), cls]
    return own - np.log(np.exp(z, out=z) @ _ONES)


def _sums(rows: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cells that occur in ``rows``, rising; sum of ``d`` over each cell's occurrences, in the array "sums").

    Most cells occur once. Of the others, the second occurrences of all are added together,
    then the third ones, until only FEW cells have more.
    """
    flat = rows.ravel()
    order = np.argsort(flat.astype(np.uint16), kind="stable")  # CELLS fit: a radix sort
    at = flat.take(order)
    order //= rows.shape[1]
    edge = np.empty(len(at) + 1, dtype=bool)
    edge[:1] = edge[-1:] = True
    np.not_equal(at[1:], at[:-1], out=edge[1:-1])
    first = np.flatnonzero(edge)
    count, first = np.diff(first), first[:-1]
    g = _rows(d, order.take(first), "sums")
    often = np.flatnonzero(count > 1)
    count = count.take(often)
    most = np.argsort(len(at) - count if len(at) >> 16 else (len(at) - count).astype(np.uint16), kind="stable")
    often, count = often.take(most), count.take(most)
    left, more = count - 1, _rows(g, often, "often")
    place = first.take(often) + 1
    m = len(often)
    while m > FEW:
        more[:m] += _rows(d, order.take(place[:m]), "more")
        place[:m] += 1
        left[:m] -= 1
        m = np.count_nonzero(left[:m])
    for i, (a, n) in enumerate(zip(place[:m].tolist(), left[:m].tolist())):
        more[i] += np.ones(n, np.float32) @ _rows(d, order[a:a + n], "more")
    g.view(_ROW)[often, 0] = more.view(_ROW)[:, 0]
    return at.take(first), g


def update(w: np.ndarray, squares: np.ndarray, rows: np.ndarray, cls: np.ndarray, prior: np.ndarray, rate: float = RATE,
           constant: bool = True) -> None:
    """One mini-batch step on the rows of the batch, in place."""
    d = _scores(w, rows, prior, constant)
    np.exp(d, out=d)
    d *= np.reciprocal(d @ _ONES)[:, None]
    d.reshape(-1)[np.arange(0, d.size, CLASSES) + cls] -= 1
    used, g = _sums(rows, d)
    _learn(w, squares, used, g, rate)
    if constant:
        _learn(w, squares, np.array([len(w) - 1]), d.sum(axis=0, keepdims=True), rate)


def _learn(w: np.ndarray, squares: np.ndarray, used: np.ndarray, g: np.ndarray, rate: float) -> None:
    """Moves the rows ``used`` against their gradients ``g``, which are overwritten."""
    step = squares[used] + np.einsum("ij,ij->i", g, g) / CLASSES
    squares[used] = step
    g *= (rate / np.sqrt(step + 1.0))[:, None]
    new = np.subtract(_rows(w, used, "more"), g, out=g)
    w.view(_ROW)[used, 0] = new.view(_ROW)[:, 0]  # whole rows are stored as one item each


def _changes(k: int, share: int, n: int, rows: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    """Changes of some rows of part ``k`` of the parameter table, made from ``n`` tokens."""
    return pa.RecordBatch.from_arrays(
        [pa.array([k], pa.int32()), pa.array([share], pa.int64()), pa.array([n], pa.int64()), pa.array([rows.astype(np.int32).tobytes()], pa.binary()),
         pa.array([v.astype(np.float32).tobytes()], pa.binary())], names=["k", "share", "n", "cells", "v"])


def train(docs: DataFrame, classes: Classes, text: str, id: str, rounds: int = ROUNDS) -> np.ndarray:
    sc = docs.sparkSession.sparkContext
    # the classes' rows, then the steps'
    size = CELLS + classes.cells
    w, squares = np.zeros((size, CLASSES), dtype=np.float32), np.zeros(size, dtype=np.float32)
    if not classes.tokens:
        return w
    shares, width = max(SHARES, classes.tokens // SHARD_TOKENS), -(-size // PARTS)
    model = sc.broadcast(classes)
    chosen = docs.where(training(F.col(id))).select(
        F.xxhash64(F.col(id).cast("string"), F.coalesce(F.col(text), F.lit(""))).alias("key"), F.col(text).alias("text"))
    for r in range(rounds):
        # a round's texts, each shuffled in its own round only; equal keys are equal texts
        dealt = chosen.where(F.pmod(F.shiftrightunsigned("key", 40), F.lit(rounds)) == r).withColumn(
            "share", F.pmod(F.shiftrightunsigned("key", 8), F.lit(shares))).repartition(2 * shares, "share").sortWithinPartitions("share", "key", "text")
        now = sc.broadcast(np.concatenate([w, squares[:, None]], axis=1))  # fixed size

        def run(batches, now=now):
            classes, at_share, seen = model.value, None, 0
            w = squares = None

            def changed():
                both = np.concatenate([w, squares[:, None]], axis=1)
                for k, lo in enumerate(range(0, size, width)):
                    old, new = now.value[lo:lo + width], both[lo:lo + width]
                    rows = np.flatnonzero((new != old).any(axis=1))
                    yield _changes(k, at_share, seen, rows, new[rows] - old[rows])

            for b in batches:
                share, texts = b.column(0).to_numpy(), as_bytes(b.column(1))
                edges = np.flatnonzero(np.append(True, share[1:] != share[:-1]))[:len(share)].tolist()
                for first, last in zip(edges, edges[1:] + [len(share)]):
                    if share[first] != at_share:
                        if seen:
                            yield from changed()
                        at_share, seen = int(share[first]), 0
                        w, squares = now.value[:, :-1].copy(), now.value[:, -1].copy()
                    for lo, hi in text_slices(texts[first:last]):
                        words, endings, at = words_of(texts[first + lo:first + hi])
                        cls, rows, _ = positions(words, endings, at, classes)
                        token, node, branch, cells = steps(words, at, cls, classes)
                        for k in range(0, len(cls), BATCH):
                            update(w[:CELLS], squares[:CELLS], rows[k:k + BATCH], cls[k:k + BATCH], classes.prior)
                        for k in range(0, len(token), BATCH):
                            s = slice(k, k + BATCH)
                            update(w[CELLS:], squares[CELLS:], cells[s], branch[s], _rows(classes.shares, node[s], "prior"), STEP_RATE, False)
                        seen += len(cls)
            if seen:
                yield from changed()

        def add(batches):
            acc: dict[int, list] = {}
            for b in batches:
                for k, _, n, rows, v in zip(*(c.to_pylist() for c in b.columns)):
                    total = acc.setdefault(k, [0, np.zeros((width, CLASSES + 1))])
                    rows = np.frombuffer(rows, np.int32)
                    total[0] += n
                    total[1][rows] += np.frombuffer(v, np.float32).reshape(len(rows), CLASSES + 1).astype(np.float64) * n
            for k, (n, total) in acc.items():
                rows = np.flatnonzero(total.any(axis=1))
                yield _changes(k, 0, n, rows, total[rows] / n)

        kind = "k int, share long, n long, cells binary, v binary"
        parts = dealt.select("share", "text").mapInArrow(run, kind).withColumn("p", F.expr(f"share div {FAN_IN}"))
        tasks = PARTS * min(-(-shares // FAN_IN), PARTS)
        parts = parts.repartition(tasks, "k", "p").select("k", "share", "n", "cells", "v").mapInArrow(add, kind)
        for x in parts.repartition(PARTS, "k").mapInArrow(add, kind).collect():  # one table of changes
            rows = x.k * width + np.frombuffer(bytes(x.cells), np.int32)
            change = np.frombuffer(bytes(x.v), np.float32).reshape(len(rows), CLASSES + 1)
            w[rows] += change[:, :-1]
            squares[rows] += change[:, -1]
        now.destroy()
    model.destroy()
    return w


def buckets(hashes: np.ndarray) -> np.ndarray:
    """Where the (rising) hashes of each first 20 bits start."""
    return np.searchsorted(hashes, np.arange(1 << 20, dtype=np.uint64) << np.uint64(44)).astype(np.int32)


def places_of(hashes: np.ndarray, starts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """A place in ``hashes`` (rising, with their ``buckets``) for each word: its own where it is there."""
    last = max(len(hashes) - 1, 0)
    at = np.minimum(starts.take((words >> np.uint64(44)).astype(np.int64)), last)
    on = np.flatnonzero(hashes.take(at) < words) if len(hashes) else np.zeros(0, np.int64)
    while len(on):  # buckets of hashes hold few
        at[on] += 1
        on = on[at[on] <= last]
        on = on[hashes[at[on]] < words[on]]
    return np.minimum(at, last)


def score_documents(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every text; scores are log10."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    kind = docs.schema[id].dataType.simpleString()
    vocabulary = count_words(docs, text, id).checkpoint()
    ends = docs.where(training(F.col(id))).count()
    classes = summarise(vocabulary, ends)
    w = train(docs, classes, text, id)
    # the head: as many of the most frequent words as fit, by a count they all reach
    often = sorted(vocabulary.groupBy(F.least("n", F.lit(10_000)).alias("n")).agg(F.count(F.lit(1)).alias("v")).collect(), key=lambda r: -r.n)
    least, held = 10_001, 0
    for r in often:
        if (held := held + r.v) > HEAD:
            break
        least = r.n
    head = sorted((np.int64(r.h).view(np.uint64), r.n) for r in vocabulary.where(F.col("n") >= least).select("h", "n").collect())
    hashes = np.array([h for h, _ in head], dtype=np.uint64)
    model = sc.broadcast((w, classes, hashes, buckets(hashes), np.log10(np.array([n for _, n in head], dtype=np.float64) + 0.5)))

    def run(batches):
        w, classes, head, starts, value = model.value
        by_class, by_step = factors_of(w[:CELLS - 1], 4, classes.prior + w[CELLS - 1]), factors_of(w[CELLS:], 2, classes.shares)
        ln10 = np.log(10.0)
        end_value = np.log10(classes.ends + 0.5)
        single_value = np.log10(np.append(classes.single_counts, 0) + 0.5)
        for b in batches:
            texts = as_bytes(b.column(1))
            out = [[] for _ in range(7)]
            for lo, hi in text_slices(texts):
                words, endings, at = words_of(texts[lo:hi])
                cls, rows, first = positions(words, endings, at, classes)
                logp = class_shares(w[:CELLS], rows, cls, classes.prior, by_class)
                logp += step_shares(w[CELLS:], len(cls), steps(words, at, cls, classes), classes, by_step)
                run_p = np.append(0, np.cumsum(logp / ln10 - classes.scale[cls]))
                wc = np.delete(cls, first[1:] - 1)  # without the ends
                alone = (wc >= 1) & (wc <= len(classes.singles))
                k = places_of(head, starts, words)
                known = head[k] == words if len(head) else np.zeros(len(words), dtype=bool)
                vals = np.where(known, value[k], 0.0) if len(head) else np.zeros(len(words))
                run_one = np.append(0, np.cumsum(np.where(alone, single_value[np.minimum(wc - 1, len(single_value) - 1)], 0.0)))
                run_head = np.append(0, np.cumsum(np.where(alone, 0.0, vals)))
                run_known = np.append(0, np.cumsum(known | alone))
                unseen = np.flatnonzero(~(known | alone))
                rare, part = words[unseen], np.searchsorted(unseen, at)
                for d in range(hi - lo):
                    a, z = at[d], at[d + 1]
                    tail, n = np.unique(rare[part[d]:part[d + 1]], return_counts=True)
                    row = (z - a + 1, run_known[z] - run_known[a] + (classes.ends > 0), run_p[first[d + 1]] - run_p[first[d]],
                           run_one[z] - run_one[a] + end_value, run_head[z] - run_head[a], tail.view(np.int64), n)
                    for o, x in zip(out, row):
                        o.append(x)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([held_out(i) for i in b.column(0).to_pylist()], pa.bool_()), *(pa.array(o, t) for o, t in zip(out, kinds))],
                names=["doc", "held_out", "n_tokens", "known", "p_class", "s_single", "s_head", "tail", "times"])

    rows = docs.select(F.col(id), F.col(text)).mapInArrow(
        run, f"doc {kind}, held_out boolean, n_tokens long, known long, p_class double, s_single double, s_head double, "
             "tail array<long>, times array<long>").checkpoint().withColumn("row", F.monotonically_increasing_id())  # of the stored rows
    rare = rows.select("row", F.explode(F.arrays_zip("tail", "times")).alias("x")).select("row", F.col("x.tail").alias("h"), F.col("x.times").alias("k"))
    sums = rare.join(vocabulary.select("h", "n"), "h", "left").groupBy("row").agg(
        F.sum(F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("s_tail"), F.sum(F.when(F.col("n") > 0, F.col("k"))).alias("k_tail"))
    whole = float(np.log10(classes.tokens + 0.5 * (classes.types + 1)))
    tail = F.col("s_head") + F.coalesce("s_tail", F.lit(0.0))
    return rows.drop("tail", "times").join(sums, "row", "left").select(
        F.col("doc").alias(id), "held_out", "n_tokens", (F.col("known") + F.coalesce("k_tail", F.lit(0))).cast("long").alias("n_known"),
        F.lit(classes.tokens).cast("long").alias("train_tokens"),
        (F.col("s_single") + tail - F.col("n_tokens") * whole).alias("base_score"), (F.col("p_class") + tail).alias("score"))
