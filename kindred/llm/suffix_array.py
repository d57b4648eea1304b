"""Repeated passages by a distributed difference-cover suffix array (operator 8).

Kärkkäinen and Sanders's DC3 over all documents' words.

1. Discarding, before the sort: a suffix's first min_words words are known by the least fingerprint of the shorter windows in them
   (winnowing, after Schleimer, Wilkerson and Aiken), which equal words have alike and which neighbours mostly share; a suffix whose
   least fingerprint no other document has can't share these words, and leaves. What stays are texts: maximal runs of suffixes that
   stay, in blocks of their own, since they are few. Of equal texts of several documents, all of whose words are shared by that,
   one goes on for others to be compared with. A text ends with a sign of its own, which is less than all words.
2. Words are named by their rank among all words left (in the order of their 64-bit fingerprints: any total order serves).
3. Down: the triples at places 1 and 2 modulo 3 of every text are sorted by range partitions and named by rank. While names repeat,
   the texts of names, those of class 1 before those of class 2, are the next level's, whose suffixes are ranked first.
   A level that fits one task is ranked there, by doubling.
4. Up: the suffixes of class 0 are merged with those sampled: with class 1 by (symbol, rank of the next suffix), with class 2 by
   (symbol, symbol, rank of the next but one). One sort does both; a suffix's rank is the number of those before it.
5. All suffixes lie in their order, and neighbours' first min_words words are compared, by 64-bit fingerprints: a wrong answer
   needs a collision between neighbours, of which there are fewer than words. A run of neighbours that agree is one passage, shared if two documents have it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import Shared
from .blocks import (
    _ROUTED,
    ROUTED,
    SPANS,
    Distinct,
    Docs,
    U,
    ask,
    blobs_of,
    each_row,
    grouped,
    heard,
    joined_columns,
    numbered,
    order_by,
    order_of,
    pack_columns,
    ranges,
    routed,
    rows,
    said_of,
    spans_table,
    token_blocks,
    unpack_columns,
    worker_count,
)
from .recompression import listed
from .words import mix, powers, windows

MIN_WORDS = 50
#: Symbols of a level that one task ranks alone.
BASE = 1 << 20
NAME_BITS, HALF = U(42), U(21)
#: texts: document's place in its block, identifier, first word, whether another document has an equal text; lengths of the texts, with their end signs; their symbols.
_STATE = {"block": pa.int64(), "texts": pa.binary(), "lengths": pa.binary(), "symbols": pa.binary(), "n_texts": pa.int64(), "n_symbols": pa.int64()}
STATE = "block bigint, texts binary, lengths binary, symbols binary, n_texts bigint, n_symbols bigint"


def key(a: np.ndarray, b: np.ndarray, c: np.ndarray, which: int = 0, bits: tuple[int, int, int] = (42, 42, 42)) -> tuple[np.ndarray, np.ndarray]:
    """(which, a, b, c) in two numbers of the same order; a, b and c have so many bits, 42 at most. The first number takes as much as it can, so that the second seldom decides."""
    rest = sum(bits) - 63
    if rest <= 0:
        return U(which) << U(63) | a << U(bits[1] + bits[2]) | b << U(bits[2]) | c, np.zeros(len(a), U)
    if bits[0] + bits[1] <= 63:
        return U(which) << U(63) | a << U(63 - bits[0]) | b << U(63 - bits[0] - bits[1]) | c >> U(rest), c & U((1 << rest) - 1)
    return U(which) << U(63) | a << HALF | b >> HALF, (b & U((1 << 21) - 1)) << NAME_BITS | c


class Texts:
    """A block's texts at one level: symbols on end, and where each text begins."""

    def __init__(self, row: dict):
        self.symbols, = unpack_columns(row["symbols"], 1)
        self.lengths = unpack_columns(row["lengths"], 1)[0].astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.lengths)])
        self.end = np.repeat(self.first[1:], self.lengths)
        self.place = np.arange(len(self.symbols)) - np.repeat(self.first[:-1], self.lengths)

    def sampled(self) -> tuple[np.ndarray, np.ndarray]:
        """The places of class 1, then those of class 2, of each text, and how many a text has."""
        one, two = (self.lengths + 1) // 3, self.lengths // 3
        n = one + two
        owner = np.repeat(np.arange(len(n)), n)
        j = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return self.first[owner] + np.where(j < one[owner], 1 + 3 * j, 2 + 3 * (j - one[owner])), n

    def following(self, values: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
        """values, `step` places on; 0 beyond the text's end."""
        inside = at + step < self.end[at]
        return np.where(inside, values[np.minimum(at + step, max(len(values) - 1, 0))], U(0)) if len(at) else np.zeros(0, U)

    def triples(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """bits: of a symbol."""
        at, _ = self.sampled()
        return *key(self.symbols[at], self.following(self.symbols, at, 1), self.following(self.symbols, at, 2), 0, (bits, bits, bits)), at

    def merging(self, ranks: np.ndarray, bits: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The keys of the merge, (hi, lo), the place that each is about, and whether it is one of class 0. ranks: of sampled places, 0 for others; bits: of a symbol, of a rank."""
        s, r = bits
        kind = self.place % 3
        at = np.concatenate([np.flatnonzero(kind < 2), np.flatnonzero(kind != 1)])
        n = int((kind < 2).sum())
        a, b = at[:n], at[n:]
        first = key(self.symbols[a], self.following(ranks, a, 1), np.zeros(len(a), U), 0, (s, r, 0))
        second = key(self.symbols[b], self.following(self.symbols, b, 1), self.following(ranks, b, 2), 1, (s, s, r))
        return np.concatenate([first[0], second[0]]), np.concatenate([first[1], second[1]]), at, kind[at] == 0


def _least(docs: Docs, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of suffixes of `length` words or more; where runs of one document's that have one least fingerprint begin among them; and these fingerprints.

    Least of the windows, of two thirds of the words, in the first `length` words: suffixes that begin with equal words have equal ones.
    """
    wide, done = _wide(length), 1
    least = windows(docs.tokens, length - wide + 1)
    while done < wide:
        step = min(done, wide - done)
        least = np.minimum(least[:-step], least[step:])
        done += step
    at = np.flatnonzero(docs.left() >= length)
    least, doc = least[at], docs.doc[at]
    new = np.ones(len(at), bool)
    new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    return at, begin, mix(least[begin])  # mixed, since the least ones lie close together and owners have ranges


def _wide(length: int) -> int:
    """How many windows of length - _wide(length) + 1 words lie in `length` words."""
    return max(1, length // 3)


def _least_keys(docs: Docs, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at, begin, hi = _least(docs, length)
    return hi, np.zeros(len(hi), U), docs.doc[at[begin]]


def _staying(docs: Docs, length: int, place: np.ndarray, said: np.ndarray) -> np.ndarray:
    """Words from which `length` words may be shared: another document has their least fingerprint."""
    at, begin, hi = _least(docs, length)
    known = Distinct(hi, np.zeros(len(hi), U), docs.doc[at[begin]])
    shared = said_of(len(known.hi), place, said)[known.inverse] > 0
    return at[np.repeat(shared, np.diff(np.append(begin, len(at))))]


def _texts(row: dict, docs: Docs, at: np.ndarray, length: int) -> dict:
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (docs.doc[at[1:]] != docs.doc[at[:-1]])
    begin = at[new]
    last = at[np.append(new[1:], True)] if len(at) else at
    size = last - begin + length
    owner = np.repeat(np.arange(len(size)), size)
    word = docs.tokens[np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + begin[owner]]
    doc = docs.doc[begin].astype(np.int64)
    return {"block": row["block"], "texts": pack_columns(doc, docs.ids[doc], begin - docs.first[doc], np.zeros(len(size))), "lengths": pack_columns(size), "symbols": pack_columns(word), "n_texts": len(size), "n_symbols": len(word)}


def _gathered(work: Shared, texts: DataFrame) -> tuple[DataFrame, int]:
    """texts in blocks of about BLOCK_WORDS symbols, several of the old ones each, and how many blocks these are. Two numbers a block go to the driver."""
    groups = grouped({r["block"]: r["n_symbols"] for r in texts.select("block", "n_symbols").collect()})
    of = texts.sparkSession.createDataFrame(list(groups.items()) or [(0, 0)], "block bigint, new_block bigint")

    def together(table: pa.Table) -> pa.Table:
        columns, lengths, symbols, docs = [], [], [], 0
        for row in each_row(table.sort_by("block")):
            own = unpack_columns(row["texts"], 4)
            if len(own[0]):
                own[0] = own[0] + U(docs)  # documents are numbered on
                docs = int(own[0].max()) + 1
            columns.append(own)
            lengths += unpack_columns(row["lengths"], 1)
            symbols += unpack_columns(row["symbols"], 1)
        lengths, symbols = np.concatenate(lengths), np.concatenate(symbols)
        row = {"block": table["new_block"][0].as_py(), "texts": pack_columns(*map(np.concatenate, zip(*columns))), "lengths": pack_columns(lengths), "symbols": pack_columns(symbols), "n_texts": len(lengths), "n_symbols": len(symbols)}
        return pa.table({k: pa.array([row[k]], kind) for k, kind in _STATE.items()})

    return work.written(texts.join(F.broadcast(of), "block").groupBy("new_block").applyInArrow(together, STATE), "gathered"), len(set(groups.values()))


def _copies(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of a block's texts (a fingerprint of all words; number of words), and their documents."""
    doc = unpack_columns(row["texts"], 4)[0].astype(np.int64)
    lengths = unpack_columns(row["lengths"], 1)[0]
    word, = unpack_columns(row["symbols"], 1)
    if not len(lengths):
        return np.zeros(0, U), np.zeros(0, U), doc
    first = np.cumsum(lengths.astype(np.int64)) - lengths.astype(np.int64)
    place = np.arange(len(word)) - np.repeat(first, lengths.astype(np.int64))
    return mix(np.add.reduceat(mix(word + powers(2)[1:] * (place + 1).astype(U)), first)), lengths, doc


def _apart(row: dict, place: np.ndarray, said: np.ndarray) -> dict:
    """The texts to be ranked, and in `spans` those of which another document has an equal one."""
    hi, lo, doc = _copies(row)
    d = Distinct(hi, lo, doc)
    word = said_of(len(d.hi), place, said)[d.inverse]
    first = np.zeros(len(hi), bool)
    first[np.unique(d.inverse, return_index=True)[1]] = True
    keep = (word == 0) | ((word == 2) & first)
    texts = [c.astype(np.int64) for c in unpack_columns(row["texts"], 4)]
    symbols, = unpack_columns(row["symbols"], 1)
    lengths = lo.astype(np.int64)
    symbols = symbols[np.repeat(keep, lengths)]
    whole = pack_columns(*(c[word > 0] for c in texts[:3]), lengths[word > 0])
    texts[3] = (word > 0).astype(np.int64)
    return {"block": row["block"], "texts": pack_columns(*(c[keep] for c in texts)), "lengths": pack_columns(lengths[keep]), "symbols": pack_columns(symbols), "n_texts": int(keep.sum()), "n_symbols": len(symbols), "whole": whole}


def _replaced(row: dict, symbols: np.ndarray, lengths: np.ndarray | None = None) -> dict:
    changed = {} if lengths is None else {"lengths": pack_columns(lengths)}
    return {**row, **changed, "symbols": pack_columns(symbols), "n_symbols": len(symbols)}


def _doubled(texts: list[Texts]) -> np.ndarray:
    """Ranks, from 1, of all suffixes of texts that end with a symbol of their own, by doubling."""
    symbols = np.concatenate([t.symbols for t in texts])
    lengths = np.concatenate([t.lengths for t in texts])
    n = len(symbols)
    end = np.repeat(np.cumsum(lengths), lengths)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64) + 1
    step = 1
    while n and rank.max() < n:
        at = np.arange(n) + step
        second = np.where(at < end, rank[np.minimum(at, n - 1)], 0)
        both = rank * (n + 1) + second
        order = np.argsort(both, kind="stable")
        new = np.ones(n, bool)
        new[1:] = both[order][1:] != both[order][:-1]
        rank[order] = np.cumsum(new)
        step *= 2
    return rank


def _in_one_task(state: DataFrame) -> DataFrame:
    """The ranks of all suffixes of a level of BASE symbols at most."""

    def run(table: pa.Table) -> pa.Table:
        found = table.sort_by("block").to_pylist()
        texts = [Texts(r) for r in found]
        ranks = _doubled(texts)
        cut = np.concatenate([[0], np.cumsum([len(t.symbols) for t in texts])])
        return pa.table({"block": pa.array([r["block"] for r in found], pa.int64()), "ranks": pa.array([pack_columns(ranks[a:b].astype(U)) for a, b in zip(cut[:-1], cut[1:])], pa.binary())})

    return state.select("block", "lengths", "symbols", F.lit(0).alias("all")).groupBy("all").applyInArrow(run, RANKS)


RANKS = "block bigint, ranks binary"
_RANKS = {"block": pa.int64(), "ranks": pa.binary()}


def _sampled_ranks(t: Texts, ranks: bytes) -> np.ndarray:
    out = np.zeros(len(t.symbols), U)
    out[t.sampled()[0]] = unpack_columns(ranks, 1)[0]
    return out


def _merged(work: Shared, name: str, both: DataFrame, workers: int, blocks: int, bits: tuple[int, int]) -> DataFrame:
    """Ranks of all suffixes of a level. both: its state with `ranks`, those of the next level's suffixes; bits: of a symbol, of a rank."""

    def keys_of(row: dict) -> tuple:
        t = Texts(row)
        hi, lo, at, _ = t.merging(_sampled_ranks(t, row["ranks"]), bits)
        return hi, lo, at

    def records(batches):
        for batch in batches:
            for row in each_row(batch):
                t = Texts(row)
                hi, lo, _, zero = t.merging(_sampled_ranks(t, row["ranks"]), bits)
                if len(hi):
                    order = order_of(hi, lo)
                    yield rows(_ROUTED, worker=[row["block"]], source=[row["block"]], data=[pack_columns(hi[order], lo[order], (order * 2 + zero[order]).astype(U), np.full(len(hi), row["block"]))])

    def place(table: pa.Table) -> pa.Table:
        """(block, record, value, worker). The sort with class 1 comes first. value: how many of class 0 come before one of another class; how many of the other class
        before one of class 0, and with class 1 those of class 0 too."""
        me = table["worker"][0].as_py()
        hi, lo, tag, block = joined_columns(blobs_of(table.sort_by("source")["data"]), 4)
        order = order_of(hi, lo)
        zero, second = (tag[order] & U(1)).astype(bool), (hi[order] >> U(63)).astype(bool)
        z, o = np.cumsum(zero) - zero, np.cumsum(~zero) - ~zero
        start = int((~second).sum())  # the second sort counts from here
        for x, of in ((z, zero), (o, ~zero)):
            x[start:] -= int(of[:start].sum())
        counts = pack_columns(np.array([zero[:start].sum(), (~zero[:start]).sum(), zero[start:].sum(), (~zero[start:]).sum()], np.int64))
        by = order_by(block[order], tag[order])
        value = np.where(zero, o + np.where(second, 0, z), z)
        data = pack_columns(block[order][by], tag[order][by] >> U(1), value[by], np.full(len(by), me))
        return pa.table({"worker": pa.array([me, -1 - me], pa.int64()), "source": pa.array([me, me], pa.int64()), "data": pa.array([data, counts], pa.binary())})

    to = ranges(both, keys_of, workers)
    sorted_ = work.written(routed(both.mapInArrow(records, ROUTED), 4, to, workers).groupBy("worker").applyInArrow(place, ROUTED), f"{name}-sorted")
    counts = np.zeros((workers, 4), np.int64)
    for r in sorted_.where("worker < 0").collect():  # four numbers a worker
        counts[-1 - r["worker"]] = unpack_columns(r["data"], 1)[0].astype(np.int64)
    base = np.cumsum(counts, 0) - counts
    back = routed(sorted_.where("worker >= 0"), 4, lambda block, *_: block.astype(np.int64), blocks)

    def ranked(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        _, record, value, worker = (x.astype(np.int64) for x in joined_columns(blobs_of(right["data"]), 4))
        for row in each_row(left):
            t = Texts(row)
            sampled = _sampled_ranks(t, row["ranks"]).astype(np.int64)
            _, _, at, zero = t.merging(sampled.astype(U), bits)
            second = record >= int((t.place % 3 < 2).sum())
            zeros, others = base[worker, np.where(second, 2, 0)], base[worker, np.where(second, 3, 1)]
            rank = np.where(t.place % 3 == 0, 1, sampled)
            mine = zero[record]
            # Class 0: those of its own class before it, once, and those of either other class. Others: those of class 0, besides the sampled.
            value = value + np.where(mine, others + np.where(second, 0, zeros), zeros)
            for on in (mine & ~second, mine & second, ~mine):
                rank[at[record[on]]] += value[on]
            out.append({"block": row["block"], "ranks": pack_columns(rank.astype(U))})
        return pa.table({k: pa.array([x[k] for x in out], kind) for k, kind in _RANKS.items()})

    return work.written(both.groupBy("block").cogroup(back.withColumnRenamed("worker", "block").groupBy("block")).applyInArrow(ranked, RANKS), f"{name}-ranks")


def _workers(records: int) -> int:
    """Workers by what there is to sort, however many blocks send it; half of what a worker may own, as a merge has four records for three symbols."""
    return worker_count(0, 2 * records)


def suffix_ranks(work: Shared, state: DataFrame, blocks: int, most: int = (1 << 42) - 1) -> DataFrame:
    """(block, ranks) of all suffixes of all texts of state, from 1, in the order of their symbols. most: no symbol is above it."""
    stack = []
    symbols = state.agg(F.sum("n_symbols")).first()[0] or 0
    while True:
        level = len(stack)
        if symbols <= BASE:
            ranks = work.written(_in_one_task(state), f"ranks{level}")
            break
        workers, bits = _workers(symbols), most.bit_length()
        keys_of = lambda row, bits=bits: Texts(row).triples(bits)
        answers = ask(work, f"down{level}", state, keys_of, workers, "all", ranges(state, keys_of, workers), blocks)

        def onward(row: dict, place: np.ndarray, said: np.ndarray, bits: int = bits) -> dict:
            t = Texts(row)
            d = Distinct(*t.triples(bits))
            return _replaced(row, said_of(len(d.hi), place, said)[d.inverse].astype(U), t.sampled()[1])

        stack.append((state, workers, (bits, symbols.bit_length())))
        state = work.written(heard(state, answers, onward, _STATE, STATE), f"down{level}")
        work.dropped(f"down{level}-answers")
        symbols, most = state.agg(F.sum("n_symbols")).first()[0] or 0, answers.names
        if answers.names == symbols:
            ranks = state.select("block", F.col("symbols").alias("ranks"))
            break
    while stack:
        state, workers, bits = stack.pop()
        ranks = _merged(work, f"up{len(stack)}", state.join(ranks.hint("merge"), "block"), workers, blocks, bits)
        work.dropped(f"up{len(stack)}-sorted")
        work.dropped(f"down{len(stack)}")
    return ranks


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans (doc_id, start_word, end_word, n_words) of which every word lies in a window of min_words words that another document has too.

    Words are those of words.py. Spans of a document don't overlap or touch. All rows count: copies of a whole document are
    spans over it, and two rows with one identifier, and repeated rows, are documents of their own. A repeat within one document
    alone is none. All holders of a passage are listed alike, so there are no ties. Null identifiers are left out; null, empty and
    shorter texts have no spans; texts may be of any length; other columns are ignored; an empty table gives no row.
    """
    if min_words < 5:
        raise ValueError("min_words must be at least 5")
    work = Shared(docs.sparkSession, "suffix-array")
    raw = work.written(token_blocks(docs, id_col, text_col), "raw")
    n_blocks, total = raw.agg(F.count("*"), F.sum("n_words")).first()
    blocks = numbered(raw)
    # Random windows change their least fingerprint twice in as many places, and one, as they have windows.
    workers = _workers((total or 0) * 2 // (_wide(min_words) + 1))

    def stay(row: dict, place: np.ndarray, said: np.ndarray) -> dict:
        d = Docs(row)
        return _texts(row, d, _staying(d, min_words, place, said), min_words)

    texts = work.written(heard(blocks, ask(work, "least", blocks, lambda row: _least_keys(Docs(row), min_words), workers, "shared", blocks=n_blocks), stay, _STATE, STATE), "texts")
    work.dropped("least-answers")
    work.dropped("raw")
    gathered, n_blocks = _gathered(work, texts)
    work.dropped("texts")
    copies = ask(work, "copies", gathered, _copies, worker_count(n_blocks, 0), "keeper")
    state = work.written(heard(gathered, copies, _apart, {**_STATE, "whole": pa.binary()}, STATE + ", whole binary"), "apart")
    work.dropped("copies-answers")
    work.dropped("gathered")
    most, total = state.agg(F.max("n_texts"), F.sum("n_symbols")).first()
    workers, most = _workers(total or 0), most or 0
    ends = n_blocks * most

    def words_of(row: dict) -> tuple:
        hi, = unpack_columns(row["symbols"], 1)
        return hi, np.zeros(len(hi), U), np.zeros(len(hi), np.int64)

    def named(row: dict, place: np.ndarray, said: np.ndarray) -> dict:
        hi, lo, doc = words_of(row)
        d = Distinct(hi, lo, doc)
        word = (said_of(len(d.hi), place, said)[d.inverse] + ends).astype(U)
        lengths = unpack_columns(row["lengths"], 1)[0].astype(np.int64)
        sign = (row["block"] * most + 1 + np.arange(len(lengths))).astype(U)
        return _replaced(row, np.insert(word, np.cumsum(lengths), sign), lengths + 1)

    named_rows = state.drop("whole")
    answers = ask(work, "words", named_rows, words_of, workers, "all", blocks=n_blocks)
    level0 = work.written(heard(named_rows, answers, named, _STATE, STATE), "level0")
    work.dropped("words-answers")
    ranks = suffix_ranks(work, level0, n_blocks, ends + answers.names)
    final = state.select("block", "texts", "lengths", "symbols", "whole").join(ranks.hint("merge"), "block")
    total = (total or 0) + (level0.agg(F.sum("n_texts")).first()[0] or 0)
    passages = _neighbours(work, final, _workers(total), n_blocks, total, min_words)
    return listed(passages)


def _starts(row: dict, length: int) -> tuple[np.ndarray, ...]:
    """Of each suffix of `length` words or more: its rank, its words' fingerprint, its document in the block, its place there, and whether another document has its whole text."""
    doc, _, begin, several = (x.astype(np.int64) for x in unpack_columns(row["texts"], 4))
    lengths = unpack_columns(row["lengths"], 1)[0].astype(np.int64)
    word, = unpack_columns(row["symbols"], 1)
    ranks, = unpack_columns(row["ranks"], 1)
    first = np.cumsum(lengths) - lengths
    text = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(word)) - first[text]
    at = np.flatnonzero(place + length <= lengths[text])
    return ranks[at + text[at]], windows(word, length)[at] if len(at) else np.zeros(0, U), doc[text[at]], begin[text[at]] + place[at], several[text[at]]


def _neighbours(work: Shared, final: DataFrame, workers: int, blocks: int, total: int, length: int) -> DataFrame:
    """(spans) of each block, packed: suffixes in their order, compared with their neighbours."""
    span = max(1, -(-(total + 1) // workers))

    def records(batches):
        for batch in batches:
            for row in each_row(batch):
                rank, print_, doc, _, several = _starts(row, length)
                if len(rank):
                    order = np.argsort(rank)
                    yield rows(_ROUTED, worker=[row["block"]], source=[row["block"]], data=[pack_columns(rank[order], print_[order], doc[order] * 2 + several[order], np.full(len(rank), row["block"]), order)])

    def compare(table: pa.Table) -> pa.Table:
        """(block, record, passage, worker) with the passages of this worker: fingerprint, one document that has it, whether another has."""
        me = table["worker"][0].as_py()
        rank, print_, doc, block, record = joined_columns(blobs_of(table["data"]), 5)
        order = np.argsort(rank)
        same = print_[order]
        new = np.ones(len(order), bool)
        new[1:] = same[1:] != same[:-1]
        group = np.cumsum(new) - 1
        begin = np.flatnonzero(new)
        holder = block[order] << U(32) | doc[order] >> U(1)
        differs = (holder != holder[begin][group]) | (doc[order] & U(1)).astype(bool)
        several = np.bincount(group, differs, len(begin)) > 0
        edges = pack_columns(same[begin[[0, -1]]], holder[begin[[0, -1]]], several[[0, -1]], np.array([len(begin), 0]))
        verdict = several.astype(np.int64)  # 2 and 3: whatever the first and the last passage turn out to be
        verdict[0], verdict[-1] = 2, 3
        if len(begin) == 1:
            verdict[0] = 2
        by = order_by(block[order], record[order])
        at = order[by]
        data = pack_columns(block[at], record[at], verdict[group[by]], np.full(len(at), me))
        return pa.table({"worker": pa.array([me, -1 - me], pa.int64()), "source": pa.array([me, me], pa.int64()), "data": pa.array([data, edges], pa.binary())})

    asked = routed(final.mapInArrow(records, ROUTED), 5, lambda rank, *_: (rank // U(span)).astype(np.int64), workers)
    compared = work.written(asked.groupBy("worker").applyInArrow(compare, ROUTED), "compared")
    edges = {-1 - r["worker"]: unpack_columns(r["data"], 4) for r in compared.where("worker < 0").collect()}  # two passages a worker
    known = np.zeros((workers, 4), bool)
    known[:, 1] = True
    _join_edges(edges, known)
    back = routed(compared.where("worker >= 0"), 4, lambda block, *_: block.astype(np.int64), blocks)

    def spans(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        _, record, verdict, worker = (x.astype(np.int64) for x in joined_columns(blobs_of(right["data"]), 4))
        for row in each_row(left):
            _, _, doc, place, _ = _starts(row, length)
            hit = np.zeros(len(doc), bool)
            hit[record] = known[worker, verdict]
            owner, ids, _, _ = (x.astype(np.int64) for x in unpack_columns(row["texts"], 4))
            own, own_ids, begin, size = (x.astype(np.int64) for x in unpack_columns(row["whole"], 4))
            n = size - length + 1
            doc = np.concatenate([doc[hit], np.repeat(own, n)])
            place = np.concatenate([place[hit], np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - begin, n)])
            by = np.lexsort((place, doc))
            doc, place = doc[by], place[by]
            docs, at = np.unique(np.concatenate([owner, own]), return_index=True)
            ids = np.concatenate([ids, own_ids])[at]
            found = spans_table(ids, np.zeros(len(ids), np.int64), np.searchsorted(docs, doc), place, length)
            out.append(pack_columns(*found.values()))
        return pa.table({"spans": pa.array(out, pa.binary())})

    return final.groupBy("block").cogroup(back.withColumnRenamed("worker", "block").groupBy("block")).applyInArrow(spans, "spans binary")


def _join_edges(edges: dict[int, list[np.ndarray]], known: np.ndarray) -> None:
    """Whether two documents have the passages at workers' edges, which may go on at the next workers."""
    run: list[tuple[int, int]] = []
    state: tuple | None = None  # fingerprint, a document, several

    def close() -> None:
        for w, column in run:
            known[w, column] = bool(state and state[2])
        run.clear()

    for w in sorted(edges):
        print_, holder, several, groups = edges[w]
        for i, column in ((0, 2), (1, 3)):
            if i and int(groups[0]) == 1:
                known[w, 3] = False  # unused: its only passage is its first
                continue
            if state is not None and state[0] == print_[i] and not i:
                state = (state[0], state[1], bool(state[2] or several[i] or state[1] != holder[i]))
            else:
                close()
                state = (print_[i], holder[i], bool(several[i]))
            run.append((w, column))
    close()
