"""Scores of a Brown class-based bigram model.

Every training word is a symbol of its own and moves between classes while that
raises the likelihood of the class bigrams. A token then costs
log10 P(class | class before) + log10 P(word | class).

The first classes come from an exact exchange of the OWN most frequent words and
of suffix groups of all others. Then the HEAD most frequent words move, one by
one, in up to PASSES passes: each counts the class bigrams and the classes before
and after each of these words, exactly, over all training tokens. At last every
other word leaves its suffix group for the class that its own neighbours in the
head, whose classes are settled, make likeliest; it moves once. Of the classes
before and after that move the likelier ones are the model's, with their bigrams
counted exactly.

Texts are read once: from then on a word is its 64-bit hash and its suffix group,
so a word of any length is eight bytes, and two of a billion words have one hash
with a probability of 3 %. All training tokens are counted. The head travels to
the tasks as a bounded table; every other word's count, neighbours and class are
found by joins, so no table that grows with the corpus is broadcast or collected.
A word without a training row has no neighbours to tell its class: it takes the
one of most words of its suffix group outside the head.

Defined results: a null or empty text has one token, the end. Texts are read
whole at any length. Without training rows N and V are 0, nothing is known and
every probability is uniform; an empty table gives no rows. Ties: of equally
frequent words the one with the smaller hash comes first in the head; of classes that gain equally
a word takes the first, and it moves only for a gain. Repeated rows get equal
scores. Extra columns are not read.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import dropped, fold_of, mixed, plain_words, swept, table, utf8, written

#: For the first classes: words with a symbol of their own; groups of the other words, by their last SUFFIX bytes. Classes.
OWN, GROUPS, SUFFIX, CLASSES = 768, 256, 3, 48
ROUNDS = 6
#: Passes over the head's words, at most; none follows one that raised the log-likelihood by less than LEAST a token.
PASSES, LEAST = 4, 0.002
#: Classes with the end's; counts kept of a word (classes after it, before it, itself after itself); words a block of them.
ALL = CLASSES + 1
CELLS, BLOCK = 2 * ALL + 1, 500
#: Words outside the head that a task moves at a time, at most; and at most a tenth of a batch, so that few move unseen by each other.
TOGETHER = 2000
#: Words that travel to the tasks, at most; tokens that a task works on at once, but for a longer text.
HEAD, TOKENS = 100_000, 200_000
#: Bytes of a text that are cut into words at once.
PIECE = 1 << 20
ADD = 0.5
#: Compression of the written tables that have a cell for each token: eight bytes of a frequent word recur too far apart for Snappy.
CODEC = "zstd"


def hashes(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Of each word of the text its hash, and the group of its last SUFFIX bytes."""
    if text and len(text) > PIECE:
        at, told = 0, []
        while at < len(text):
            blank = _BLANK.search(text, at + PIECE)
            end = blank.start() if blank else len(text)
            told.append(_hashes(text[at:end]))
            at = end
        return tuple(np.concatenate(x) for x in zip(*told))
    return _hashes(text)


_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def _hashes(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    words = plain_words(text.lower()) if text else []
    n = len(words)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.uint8)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n).view(np.int64)
    sizes = np.fromiter(map(len, words), np.int64, n)
    ends, flat = np.cumsum(sizes), np.frombuffer(b"".join(words), np.uint8)
    suffix = np.zeros(n, np.uint64)
    for k in range(1, SUFFIX + 1):
        byte = flat[np.maximum(ends - k, 0)].astype(np.uint64) + np.uint64(1)
        suffix = suffix * np.uint64(257) + np.where(sizes >= k, byte, np.uint64(0))
    return hashed, (mixed(suffix) % np.uint64(GROUPS)).astype(np.uint8)


def hashed(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., h, g) of each row of docs: hashes of the text's words, eight bytes each, and a byte for the group of each."""
    rows = docs.select(*keep, "text")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                told = [hashes(t) for t in utf8(part.column("text"))]
                both = [pa.array([x.tobytes() for x in column], pa.binary()) for column in zip(*told)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *both], [*keep, "h", "g"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields if f.name in keep)
    return rows.mapInArrow(run, fields + "h binary, g binary")


def chunks(batch: pa.RecordBatch):
    """(first row, rows, words of each, hashes, groups) of a batch of hashed texts, some TOKENS at a time."""
    h, g, at = batch.column("h"), batch.column("g"), 0
    sizes = pa.compute.binary_length(g).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    while at < len(sizes):
        n = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOKENS, "right")) - at)
        yield at, n, sizes[at : at + n], *(np.frombuffer(b"".join(c.slice(at, n).to_pylist()), kind) for c, kind in ((h, np.int64), (g, np.uint8)))
        at += n


def counted(texts: DataFrame) -> DataFrame:
    """(h, c, g) of every training word, from hashed texts."""

    def run(batches):
        for batch in batches:
            for _, _, _, h, g in chunks(batch):
                word, first, c = np.unique(h, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(c), pa.array(g[first].astype(np.int32))], ["h", "c", "g"])

    return texts.select("h", "g").mapInArrow(run, "h long, c long, g int").groupBy("h").agg(F.sum("c").alias("c"), F.min("g").alias("g"))


@dataclass
class Symbols:
    """The head table: codes rise as counts fall. Symbols: own words, then suffix groups, then the end."""

    keys: np.ndarray  # sorted hashes
    order: np.ndarray  # their codes
    counts: np.ndarray  # by code
    symbols: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int, int, int]]) -> Symbols:
        """rows: (hash, count, group) of the head's words."""
        rows = sorted(rows, key=lambda x: (-x[1], x[0]))
        h = np.array([x[0] for x in rows], dtype=np.int64)
        order = np.argsort(h)
        symbols = np.array([k if k < OWN else OWN + x[2] for k, x in enumerate(rows)], dtype=np.int64)
        return cls(h[order], order.astype(np.int32), np.array([x[1] for x in rows], dtype=np.float64), symbols)

    @property
    def size(self) -> int:
        return OWN + GROUPS + 1

    @property
    def end(self) -> int:
        return len(self.counts)

    def codes(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        """Of each word its code, or that of the end plus 1 plus its suffix group."""
        other = (self.end + 1 + g.astype(np.int32)).astype(np.int32)
        if not self.end:
            return other
        at = np.minimum(np.searchsorted(self.keys, h), self.end - 1)
        return np.where(self.keys[at] == h, self.order[at], other)

    def laid(self, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of texts one after the other, the end before the first and after each; and where the words stand."""
        at = np.arange(len(codes)) + 1 + np.repeat(np.arange(len(sizes)), sizes)
        seq = np.full(len(codes) + len(sizes) + 1, self.end, np.int32)
        seq[at] = codes
        return seq, at

    def first(self) -> np.ndarray:
        """The first exchange's symbol of each code."""
        return np.concatenate([self.symbols, [OWN + GROUPS], OWN + np.arange(GROUPS)])


def head_of(counts: DataFrame) -> Symbols:
    """The most frequent words."""
    step = F.floor(F.log2("c") * 16)
    steps = sorted(((r["s"], r["n"]) for r in counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    total, least = 0, (steps[0][0] + 1 if steps else 0)
    for s, n in steps:
        if total + n > HEAD:
            break
        total, least = total + n, s
    return Symbols.of([(r["h"], r["c"], r["g"]) for r in counts.where(step >= least).collect()])  # at most HEAD rows


def listed(groups: np.ndarray, n: int, values: np.ndarray) -> pa.Array:
    """Binary cells of 32-bit values, which stand in the order of their groups 0 to n - 1."""
    offsets = np.concatenate([[0], np.cumsum(np.bincount(groups, minlength=n))]).astype(np.int32) * 4
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(values.astype(np.int32).tobytes())])


def passed(texts: DataFrame, symbols: Symbols) -> DataFrame:
    """Codes of all texts, with the end around each, and what stands around each word outside the head.

    Rows have either ``seq`` (32 bits a code); or ``h`` with ``told`` (its group, count and pairs with itself) and
    ``around``: of its neighbours in the head, 2 * code of one before, 2 * code + 1 of one after; or ``h`` and
    ``after``, where both are outside the head and differ.
    """
    held = texts.sparkSession.sparkContext.broadcast(symbols)
    kinds = {"seq": pa.binary(), "h": pa.int64(), "told": pa.int64(), "around": pa.binary(), "after": pa.int64()}

    def out(size, **columns):
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(size, k) for c, k in kinds.items()], list(kinds))

    def run(batches):
        symbols = held.value
        end = symbols.end
        for batch in batches:
            for _, _, sizes, h, g in chunks(batch):
                seq, at = symbols.laid(sizes, symbols.codes(h, g))
                yield out(1, seq=pa.array([seq.astype(np.int32).tobytes()], pa.binary()))
                word = np.zeros(len(seq), np.int64)
                word[at] = h
                rare = np.flatnonzero(seq > end)
                if not len(rare):
                    continue
                own, first, which, c = np.unique(word[rare], return_index=True, return_inverse=True, return_counts=True)
                group = seq[rare[first]] - end - 1
                before, after = seq[rare - 1], seq[rare + 1]
                follows = np.flatnonzero(after > end)
                same = word[rare[follows] + 1] == word[rare[follows]]
                i = np.concatenate([which[before <= end], which[after <= end]])
                x = np.concatenate([2 * before[before <= end], 2 * after[after <= end] + 1])
                order = np.argsort(i, kind="stable")
                s = np.bincount(which[follows[same]], minlength=len(own))
                yield out(len(own), h=pa.array(own), told=pa.array(group.astype(np.int64) | c << 8 | s << 36), around=listed(i, len(own), x[order]))
                some = rare[follows[~same]]
                yield out(len(some), h=pa.array(word[some]), after=pa.array(word[some + 1]))

    return texts.select("h", "g").mapInArrow(run, "seq binary, h long, told long, around binary, after long")


def bigrams(seqs: DataFrame, symbols: Symbols) -> np.ndarray:
    """Counts of neighbouring symbols of the first exchange over all training rows."""
    held, size = seqs.sparkSession.sparkContext.broadcast(symbols.first()), symbols.size

    def run(batches):
        first, total = held.value, np.zeros(size * size, np.int64)
        for batch in batches:
            for seq in batch.column("seq"):
                s = first[np.frombuffer(seq.as_buffer(), np.int32)]
                total += np.bincount(s[:-1] * size + s[1:], minlength=size * size)
        some = np.flatnonzero(total)
        for at in range(0, len(some), 200_000):
            part = some[at : at + 200_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], ["pair", "n"])

    out = np.zeros(size * size, np.int64)
    got = seqs.select("seq").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # at most size * size rows
    out[got.column("pair").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(size, size)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(pairs: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """A class for each symbol; the last symbol, the end, has the last class to itself."""
    size, n = len(pairs), pairs.astype(np.float64)
    seen = n.sum(axis=0) + n.sum(axis=1)
    order = np.argsort(-seen[:-1], kind="stable")
    of = np.empty(size, np.int64)
    of[order] = np.arange(size - 1) % classes
    of[-1] = classes
    total = classes + 1
    m = np.zeros((total, total))
    np.add.at(m, (of[:, None].repeat(size, 1), of[None, :].repeat(size, 0)), n)
    diagonal = np.arange(total)
    for _ in range(rounds):
        moves = 0
        for w in order:
            if not seen[w]:
                continue
            right = np.bincount(of, weights=n[w], minlength=total)
            left = np.bincount(of, weights=n[:, w], minlength=total)
            old, itself = of[w], n[w, w]
            right[old] -= itself
            left[old] -= itself
            m[old, :] -= right
            m[:, old] -= left
            m[old, old] -= itself
            # what others have before and after w counts in their margins wherever w goes
            fm, rows, cols = _xlogx(m), m.sum(axis=1) + left, m.sum(axis=0) + right
            a, b = _xlogx(m + right[None, :]) - fm, (_xlogx(m + left[:, None]) - fm).T
            gain = a.sum(axis=1) - a[diagonal, diagonal] + b.sum(axis=1) - b[diagonal, diagonal]
            gain += _xlogx(m[diagonal, diagonal] + right + left + itself) - fm[diagonal, diagonal]
            gain -= _xlogx(rows + right.sum() + itself) - _xlogx(rows) + _xlogx(cols + left.sum() + itself) - _xlogx(cols)
            best = int(np.argmax(gain[:classes]))
            if gain[best] <= gain[old] + 1e-6:
                best = old
            moves += best != old
            of[w] = best
            m[best, :] += right
            m[:, best] += left
            m[best, best] += itself
        if not moves:
            break
    return of


def likelihood(m: np.ndarray) -> float:
    """Of the class bigrams; what does not depend on the classes is left out."""
    return float(_xlogx(m).sum() - _xlogx(m.sum(axis=1)).sum() - _xlogx(m.sum(axis=0)).sum())


def _put(m: np.ndarray, of: np.ndarray, right: np.ndarray, left: np.ndarray, itself: np.ndarray, sign: int) -> None:
    one_hot = np.zeros(right.shape)
    one_hot[np.arange(len(of)), of] = sign
    m += one_hot.T @ right + left.T @ one_hot
    m[np.diag_indices(len(m))] += itself @ one_hot


def placed(m: np.ndarray, of: np.ndarray, right: np.ndarray, left: np.ndarray, itself: np.ndarray) -> np.ndarray:
    """The best class of each word (row) against what is left of ``m`` without these words; ``m`` then has them there."""
    right, left, itself = right.astype(np.float64), left.astype(np.float64), itself.astype(np.float64)
    _put(m, of, right, left, itself, -1)
    np.maximum(m, 0, out=m)  # pairs of two of these words went twice
    fm = _xlogx(m)
    gain = np.zeros(right.shape)
    for side, by, f in ((right, m.T, fm.T), (left, m, fm)):
        at, k = side.nonzero()
        if len(at):
            more = _xlogx(by[k] + side[at, k][:, None]) - f[k]
            more[np.arange(len(k)), k] = 0
            starts = np.flatnonzero(np.diff(at, prepend=-1))
            gain[at[starts]] += np.add.reduceat(more, starts, axis=0)
    both = right + left + itself[:, None]
    gain += _xlogx(np.diag(m) + both) - np.diag(fm)
    rows, cols = m.sum(axis=1) + left, m.sum(axis=0) + right
    r, l = (right.sum(axis=1) + itself)[:, None], (left.sum(axis=1) + itself)[:, None]
    gain -= _xlogx(rows + r) - _xlogx(rows) + _xlogx(cols + l) - _xlogx(cols)
    best = gain[:, :CLASSES].argmax(axis=1)
    every = np.arange(len(of))
    best = np.where(gain[every, best] > gain[every, of] + 1e-6, best, of)
    _put(m, best, right, left, itself, 1)
    return best


def _blobs(cells: np.ndarray, size: int):
    """(block, places and counts) of what is not 0."""
    for block, at in enumerate(range(0, len(cells), size)):
        part = cells[at : at + size]
        some = np.flatnonzero(part)
        if len(some):
            yield block, some.astype(np.uint16).tobytes() + part[some].astype(np.int64).tobytes()


def _add(cells: np.ndarray, blob: bytes) -> None:
    n = len(blob) // 10
    cells[np.frombuffer(blob, np.uint16, n)] += np.frombuffer(blob, np.int64, n, 2 * n)


def _summed(blobs: DataFrame) -> DataFrame:
    """One blob a block, the sum of its blobs, which a task reads one after the other."""

    def run(batches):
        block, cells = None, np.zeros(1 << 16, np.int64)

        def out():
            got = [b for _, b in _blobs(cells, len(cells))]
            cells[:] = 0
            return pa.RecordBatch.from_arrays([pa.array([block] * len(got), pa.int32()), pa.array(got, pa.binary())], ["block", "blob"])

        for batch in batches:
            for k, blob in zip(batch.column("block").to_pylist(), batch.column("blob")):
                if k != block and block is not None:
                    yield out()
                block = k
                _add(cells, blob.as_py())
        if block is not None:
            yield out()

    return blobs.repartition("block").sortWithinPartitions("block").mapInArrow(run, "block int, blob binary")


def _head_cells(seqs: DataFrame, of: np.ndarray, end: int) -> DataFrame:
    """Blobs of the counts around head words (and the end) under the classes ``of`` of all codes.

    Block -1: class bigrams of all pairs; block -2: of pairs within the head; block -3: of pairs with the head.
    """
    held = seqs.sparkSession.sparkContext.broadcast(of)

    def run(batches):
        of = held.value
        total, bigram = np.zeros((end + 1) * CELLS, np.int32), np.zeros((3, ALL * ALL), np.int64)  # of one task, so 32 bits will do
        for batch in batches:
            for seq in batch.column("seq"):
                s = np.frombuffer(seq.as_buffer(), np.int32)
                k = of[s]
                a, b, step = s[:-1].astype(np.int64), s[1:].astype(np.int64), k[:-1] * ALL + k[1:]
                first, second, others = a <= end, b <= end, a != b
                for at, some in enumerate((slice(None), first & second, first | second)):
                    bigram[at] += np.bincount(step[some], minlength=ALL * ALL)
                np.add.at(total, a[first & ~others] * CELLS + 2 * ALL, 1)
                first, second = first & others, second & others
                np.add.at(total, a[first] * CELLS + k[1:][first], 1)
                np.add.at(total, b[second] * CELLS + ALL + k[:-1][second], 1)
        for block, blob in itertools.chain(_blobs(total, BLOCK * CELLS), ((-1 - at, b) for at in range(3) for _, b in _blobs(bigram[at], ALL * ALL))):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([blob], pa.binary())], ["block", "blob"])

    # a task's counts are a table of bounded size however much it reads, so there are as many tasks as the cluster keeps busy
    return seqs.select("seq").coalesce(2 * seqs.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, "block int, blob binary")


def _whole(batches):
    """The batches of rows sorted by h, cut so that the rows of one h are in one."""
    left = None
    for batch in batches:
        if left is not None and left.num_rows:
            batch = pa.Table.from_batches([left, batch]).combine_chunks().to_batches()[0] if batch.num_rows else left
        h = batch.column("h").to_numpy()
        cut = int(np.searchsorted(h, h[-1], "left")) if len(h) else 0
        if cut:
            yield batch.slice(0, cut)
        left = batch.slice(cut)
    if left is not None and left.num_rows:
        yield left


def _rare_moves(rare: DataFrame, of: np.ndarray, m: np.ndarray, end: int) -> DataFrame:
    """(h, g, c, k) of the words outside the head after their move, and blobs: the class bigrams that they make with the head and themselves.

    m: class bigrams of the pairs with the head. A word's rows come to one task, sorted, and are summed there.
    """
    held = rare.sparkSession.sparkContext.broadcast((of, m))
    names = ["h", "g", "c", "k", "blob"]

    def run(batches):
        of, m = held.value[0], held.value[1].copy()  # the task's own moves show in it
        made = np.zeros((ALL, ALL), np.int64)
        for batch in _whole(batches):
            h, told = batch.column("h").to_numpy(), batch.column("told").to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            n, word = len(starts), np.cumsum(np.bincount(starts, minlength=len(h))) - 1
            g, c, s = (told[starts] & 255).astype(np.int32), np.add.reduceat(told >> 8 & (1 << 28) - 1, starts), np.add.reduceat(told >> 36, starts)
            around = batch.column("around")
            x = np.frombuffer(b"".join(around.to_pylist()), np.int32).astype(np.int64)
            i = np.repeat(word, pa.compute.binary_length(around).to_numpy(zero_copy_only=False) // 4)
            code, follows = x >> 1, (x & 1) == 1
            right = np.bincount((i * ALL + of[code])[follows], minlength=n * ALL).reshape(n, ALL)
            left = np.bincount((i * ALL + of[code])[~follows], minlength=n * ALL).reshape(n, ALL)
            k, none = of[end + 1 + g], np.zeros(n, np.int64)
            step = max(1, min(TOGETHER, n // 10))
            then = np.concatenate([placed(m, k[a : a + step], right[a : a + step], left[a : a + step], none[a : a + step]) for a in range(0, n, step)])
            np.add.at(made, (then[i[follows]], of[code[follows]]), 1)
            np.add.at(made, (of[code[~follows]], then[i[~follows]]), 1)
            np.add.at(made, (then, then), s)
            yield pa.RecordBatch.from_arrays([pa.array(h[starts]), pa.array(g), pa.array(c), pa.array(then.astype(np.int32)), pa.nulls(n, pa.binary())], names)
        got = [b for _, b in _blobs(made.reshape(-1), ALL * ALL)]
        size = len(got)
        yield pa.RecordBatch.from_arrays([pa.nulls(size, pa.int64()), pa.nulls(size, pa.int32()), pa.nulls(size, pa.int64()), pa.nulls(size, pa.int32()), pa.array(got, pa.binary())], names)

    return rare.repartition("h").sortWithinPartitions("h").mapInArrow(run, "h long, g int, c long, k int, blob binary")


def _matrix(blobs: DataFrame) -> np.ndarray:
    """The sum of ALL * ALL counts in blobs."""
    cells = np.zeros(ALL * ALL, np.int64)
    for r in _summed(blobs.select(F.lit(0).alias("block"), "blob")).collect():  # one row
        _add(cells, bytes(r["blob"]))
    return cells.reshape(ALL, ALL)


def head_classes(seqs: DataFrame, symbols: Symbols) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Classes of all codes, class bigrams (of all pairs, within the head, with the head), and each pass's log-likelihood."""
    of, end = exchange(bigrams(seqs, symbols))[symbols.first()], symbols.end
    best, told = None, []
    for turn in range(PASSES + 1):
        cells, bigram = np.zeros((end + 1 + BLOCK) * CELLS, np.int64), np.zeros((3, ALL * ALL), np.int64)
        for r in _summed(_head_cells(seqs, of, end)).coalesce(8).toLocalIterator():  # a job for each of its partitions
            k = r["block"]
            _add(bigram[-1 - k] if k < 0 else cells[k * BLOCK * CELLS :], bytes(r["blob"]))
        swept(seqs.sparkSession)
        bigram = bigram.reshape(3, ALL, ALL).astype(np.float64)
        m = bigram[0].copy()
        told.append(likelihood(m))
        gained = told[-1] - max(told[:-1], default=-np.inf)
        if gained > 0:
            best = of, bigram
        if turn == PASSES or gained <= LEAST * m.sum():
            return *best, told
        cells = cells[: (end + 1) * CELLS].reshape(end + 1, CELLS)
        right, left, itself = cells[:, :ALL], cells[:, ALL : 2 * ALL], cells[:, 2 * ALL]
        of, at = of.copy(), 0
        while at < end:  # the more frequent, the fewer at a time
            to = min(end, at + max(1, min(BLOCK, at // 100)))
            of[at:to] = placed(m, of[at:to], right[at:to], left[at:to], itself[at:to])
            at = to


def clustered(texts: DataFrame, symbols: Symbols) -> tuple[np.ndarray, np.ndarray, DataFrame, list[float]]:
    """Classes of all codes, class bigrams, (h, c, k) of the words outside the head, and each pass's log-likelihood."""
    spark, end = texts.sparkSession, symbols.end
    got = written(passed(texts, symbols), "passed", CODEC)
    of, (m, within, met), told = head_classes(got.where(F.col("seq").isNotNull()), symbols)
    moves = written(_rare_moves(got.where(F.col("around").isNotNull()).select("h", "told", "around"), of, met, end), "moves")
    swept(spark)
    classes = moves.where(F.col("h").isNotNull()).select("h", "g", "c", "k")
    then = within + _matrix(moves.where(F.col("blob").isNotNull()))
    pairs = got.where(F.col("after").isNotNull()).select("h", "after")
    pairs = pairs.join(classes.select("h", F.col("k").alias("a")), "h").join(classes.select(F.col("h").alias("after"), F.col("k").alias("b")), "after")
    for r in pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).collect():  # at most ALL * ALL rows
        then[r["a"], r["b"]] += r["n"]
    told.append(likelihood(then))
    if told[-1] < max(told[:-1]):
        first = F.element_at(F.array(*(F.lit(int(k)) for k in of[end + 1 :])), F.col("g") + 1)
        classes = written(classes.select("h", "g", "c", first.alias("k")), "classes")
        dropped(spark, moves)
        then = m
    of = of.copy()
    usual: dict[int, tuple[int, int]] = {}
    for r in classes.groupBy("g", "k").agg(F.count(F.lit(1)).alias("n")).collect():  # at most GROUPS * ALL rows
        usual[r["g"]] = max(usual.get(r["g"], (0, 0)), (r["n"], r["k"]))
    for g, (_, k) in usual.items():
        of[end + 1 + g] = k
    dropped(spark, got)
    del pairs
    swept(spark)
    return of, then, classes.select("h", "c", "k"), told


def transitions(m: np.ndarray) -> np.ndarray:
    """P(class | class before): Witten-Bell interpolation of class bigrams with class unigrams."""
    single = (m.sum(axis=0) + ADD) / (m.sum() + ADD * len(m))
    kinds, n = (m > 0).sum(axis=1, keepdims=True), m.sum(axis=1, keepdims=True)
    return np.where(n > 0, (m + kinds * single) / np.maximum(n + kinds, 1), single)


@dataclass
class ClassModel:
    """Arrays by code: head words, the end, then a word not seen in training by its suffix group."""

    symbols: Symbols
    classes: np.ndarray
    step: np.ndarray
    emit: np.ndarray
    mass: np.ndarray
    base_floor: float
    end_count: float
    n: int
    told: list[float]

    def parts(self, sizes: np.ndarray, h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
        """Of texts one after the other: known tokens, base and model score of the head words among themselves; and of the
        other words text, hash, class of one not seen, and the classes before and after, or -1."""
        end, n = self.symbols.end, len(sizes)
        codes, at = self.symbols.laid(sizes, self.symbols.codes(h, g))
        k, head = self.classes[codes], codes <= end
        text = np.repeat(np.arange(n), sizes + 1)
        both, own = head[:-1] & head[1:], head[1:]
        known = codes[1:][own]
        counts = np.append(self.symbols.counts, self.end_count)
        score = np.bincount(text[both], weights=self.step[k[:-1], k[1:]][both], minlength=n) + np.bincount(text[own], weights=self.emit[known], minlength=n)
        base = np.bincount(text[own], weights=np.log10(counts[known] + ADD), minlength=n) + self.base_floor * (sizes + 1)
        word = np.zeros(len(codes), np.int64)
        word[at] = h
        others = np.flatnonzero(~head)
        before, after = (np.where(head[others + d], k[others + d], -1) for d in (-1, 1))
        return np.bincount(text[own], minlength=n) - (self.end_count == 0), base, score, (text[others - 1], word[others], k[others], before, after)

    def rest(self, n: int, text: np.ndarray, before: np.ndarray, after: np.ndarray, k: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What the other words add to each of n texts, from their classes and counts; words stand in the order of texts and places."""
        logs = np.log10(c + ADD)
        before = np.where(before < 0, np.roll(k, 1), before)  # the word before is another one of these
        more = logs - self.mass[k] + self.step[before, k]
        closed = after >= 0
        more[closed] += self.step[k[closed], after[closed]]
        return np.bincount(text[c > 0], minlength=n), np.bincount(text, weights=logs, minlength=n), np.bincount(text, weights=more, minlength=n)


def fit(texts: DataFrame) -> tuple[ClassModel, DataFrame]:
    """The model of hashed texts, and (h, c, k) of the words outside its head."""
    counts = written(counted(texts), "counts")
    totals = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    ends = texts.count()
    n, v = (totals["n"] or 0) + ends, totals["v"] + (ends > 0)
    symbols = head_of(counts)
    dropped(texts.sparkSession, counts)
    swept(texts.sparkSession)
    of, m, rare, told = clustered(texts, symbols)
    seen = np.concatenate([symbols.counts, [ends], np.zeros(GROUPS)]) + ADD
    mass = np.bincount(of, weights=seen, minlength=ALL)
    for r in rare.groupBy("k").agg(F.sum(F.col("c") + ADD).alias("c")).collect():
        mass[r["k"]] += r["c"]
    mass = np.log10(np.maximum(mass, ADD))
    base_floor = -float(np.log10(n + ADD * (v + 1)))
    return ClassModel(symbols, of, np.log10(transitions(m)), np.log10(seen) - mass[of], mass, base_floor, float(ends), n, told), rare


def scored(texts: DataFrame, model: ClassModel, rare: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep..., n_tokens, n_known, train_tokens, base_score, score) of each row of hashed texts, which are not read after it returns."""
    held = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = held.value
        for batch in batches:
            for first, n, sizes, h, g in chunks(batch):
                known, base, score, (text, *places) = model.parts(sizes, h, g)
                offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n))]), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(t))) for x, t in zip(places[:2], (np.int64, np.int32))]
                lists += [listed(text, n, x) for x in places[2:]]
                own = [batch.column(c).slice(first, n) for c in keep]
                yield pa.RecordBatch.from_arrays([*own, pa.array(sizes + 1), pa.array(known), pa.array(base), pa.array(score), *lists], [*keep, "n_tokens", "n_known", "base", "score", "words", "unseen", "before", "after"])

    def close(batches):
        model = held.value
        for batch in batches:
            before, after = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.int32) for c in ("before", "after"))
            jk, c = (batch.column(x).flatten().to_numpy() for x in ("jk", "c"))
            text = np.repeat(np.arange(batch.num_rows), pa.compute.fill_null(pa.compute.list_value_length(batch.column("jk")), 0).to_numpy(zero_copy_only=False))
            order = np.lexsort((jk, text))
            known, base, score = model.rest(batch.num_rows, text, before, after, jk[order] & 63, c[order])
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in keep), batch.column("n_tokens"), pa.array(batch.column("n_known").to_numpy() + known.astype(np.int64)), pa.array(np.full(batch.num_rows, model.n, np.int64)),
                    pa.array(batch.column("base").to_numpy() + base), pa.array(batch.column("score").to_numpy() + score),
                ],
                [*keep, "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in texts.schema.fields if f.name in keep)
    shape = fields + "n_tokens long, n_known long, base double, score double, words array<bigint>, unseen array<int>, before binary, after binary"
    parts = written(texts.select(*keep, "h", "g").mapInArrow(run, shape).withColumn("row", F.monotonically_increasing_id()), "parts", CODEC)
    # a place and a class, of which there are fewer than 64, travel as one number
    rest = parts.select("row", F.posexplode(F.arrays_zip("words", "unseen")).alias("j", "t")).select("row", (F.col("j").cast("long") * 64 + F.col("t.unseen")).alias("jk"), F.col("t.words").alias("h"))
    known = F.shiftleft(F.shiftright("jk", 6), 6) + F.col("k")
    found = rest.join(rare, "h", "left").select("row", F.coalesce(known, "jk").alias("jk"), F.coalesce(F.col("c"), F.lit(0)).alias("c"))
    t = F.col("t")
    found = found.groupBy("row").agg(F.collect_list(F.struct("jk", "c")).alias("t")).select("row", t.jk.alias("jk"), t.c.alias("c"))
    whole = parts.drop("words", "unseen").join(found, "row", "left").drop("row")
    return whole.mapInArrow(close, fields + "n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op9_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", fold_of(F.col("doc_id"), 5) == 1)
    texts = written(hashed(docs, ("doc_id", "held_out")), "hashed", CODEC)
    model, rare = fit(texts.where(~F.col("held_out")))
    scores = scored(texts, model, rare, ("doc_id", "held_out"))
    dropped(spark, texts)  # all that the scores need of them is written
    return scores.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
