"""Repeated passages by recompression (operator 4).

Jeż's recompression over all documents at once, a Spark round a level. At each level, runs of one symbol become one; then a
bit of a hash splits the symbols into left and right ones, and every left one followed by a right one becomes one symbol. The
blocks send the new runs and pairs to the workers that own them, which name them: the same run or pair has the same name in all
documents. One that a single document has is left without a name, and no passage that another document shares holds it.

Whether two neighbours join depends on them alone, so equal passages have equal symbols but for those at either end. A window
of min_words words is read level by level: what may depend on its surroundings (the runs at its ends, a right symbol that would
come first, a left one that would come last) is put down with its name, and the rest goes on to the next level. What is put down,
with the symbols left at the top, spells the window, and equal windows spell alike. A window dies with
the first nameless symbol inside it, and blocks keep only the symbols of windows that live; a last round finds which spellings another document has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import Shared
from .blocks import SPANS, Docs, U, ask, heard, numbered, pack_columns, said_each, spans_table, token_blocks, unpack, unpack_columns, worker_count
from .words import mix, powers

MIN_WORDS = 50
#: Windows that are read at once.
PART = 1 << 16
_STATE = {"block": pa.int64(), "n": pa.int64(), "doc_ids": pa.binary(), "lengths": pa.binary(), "symbols": pa.binary(), "windows": pa.binary()}
STATE = "block bigint, n bigint, doc_ids binary, lengths binary, symbols binary, windows binary"


def levels(min_words: int) -> int:
    """A symbol of level r stands for some 1.5**r words or more, and two at either end of a window go at each level."""
    return max(1, int(np.log2(min_words)) - 1)


class Level:
    """A string of symbols (0 is none: the end of a piece, or a symbol without a name) and what it is compressed to."""

    def __init__(self, symbols: np.ndarray, level: int):
        p = powers(5)
        n = len(symbols)
        self.symbols = symbols
        new = np.ones(n, bool)
        new[1:] = (symbols[1:] != symbols[:-1]) | (symbols[1:] == 0)
        self.run_start = np.flatnonzero(new).astype(np.int32)
        self.run_end = np.append(self.run_start[1:], np.int32(n))
        self.run_of = np.cumsum(new, dtype=np.int32) - 1
        size = (self.run_end - self.run_start).astype(U)
        one = symbols[self.run_start]
        long = size > 1
        self.run = np.where(long, mix(one * p[1] + size * p[2] + U(2 * level)), one)
        self.right = (mix(self.run + p[3:4] * U(level + 1)) >> U(63)).astype(bool)
        joined = np.flatnonzero(~self.right[:-1] & self.right[1:] & (one[:-1] != 0) & (one[1:] != 0)) if n else np.zeros(0, np.int64)
        keep = np.ones(len(one), bool)
        keep[joined + 1] = False
        self.key, self.fresh = self.run.copy(), long.copy()
        self.key[joined] = mix(self.run[joined] * p[3] + self.run[joined + 1] * p[4] + U(2 * level + 1))
        self.fresh[joined] = True
        self.element_of = np.cumsum(keep, dtype=np.int32) - 1
        self.key, self.fresh, self.start = self.key[keep], self.fresh[keep], self.run_start[keep]

    def keys(self, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The runs and pairs to be named, and their documents."""
        hi = self.key[self.fresh]
        return hi, np.zeros(len(hi), U), doc[self.start[self.fresh]]

    def named(self, named: np.ndarray, level: int) -> np.ndarray:
        """The next level's string. named: names of the fresh symbols, 0 for none."""
        out = self.key.copy()
        out[self.fresh] = np.where(named > 0, mix(named.astype(U) + (U(level + 1) << U(56))), U(0))
        return out

    def read(self, lo: np.ndarray, hi: np.ndarray, spelt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What is left, in the next level's string, of windows lo .. hi - 1, and what they spell so far."""
        if not len(self.symbols):
            return lo, hi, spelt
        out = np.empty_like(lo), np.empty_like(hi), np.empty_like(spelt)
        for at in range(0, len(lo), PART):
            part = slice(at, at + PART)
            for whole, x in zip(out, self._read(lo[part], hi[part], spelt[part])):
                whole[part] = x
        return out

    def _read(self, lo: np.ndarray, hi: np.ndarray, spelt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        some = hi > lo
        at, last = np.where(some, lo, 0), np.where(some, hi - 1, 0)
        r, q = self.run_of[at], self.run_of[last]
        spell = lambda tag, on, x, k: np.where(on, mix(spelt * U(0x9E3779B97F4A7C15) + mix(x + U(tag)) + k.astype(U)), spelt)
        spelt = spell(1, some, self.symbols[at], np.minimum(self.run_end[r], hi) - at)
        spelt = spell(2, some & (q > r), self.symbols[last], hi - self.run_start[q])
        a, b = r + 1, np.where(some, q, r + 1)  # runs a .. b - 1 lie inside
        out = (a < b) & self.right[np.minimum(a, len(self.right) - 1)]
        spelt = spell(3, out, self.run[np.minimum(a, len(self.run) - 1)], a * 0)
        a = a + out
        out = (a < b) & ~self.right[b - 1]
        spelt = spell(4, out, self.run[b - 1], b * 0)
        b = b - out
        left = a < b
        return np.where(left, self.element_of[np.minimum(a, len(self.run) - 1)], 0), np.where(left, self.element_of[b - 1] + 1, 0), spelt


def _compact(symbols: np.ndarray, doc: np.ndarray, windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Without the windows that hold a nameless symbol and the symbols that no other window holds; pieces stay apart."""
    at, lo, hi, spelt = windows
    nameless = np.concatenate([[0], np.cumsum(symbols == 0)])
    alive = nameless[lo] == nameless[hi]
    at, lo, hi, spelt = at[alive], lo[alive], hi[alive], spelt[alive]
    some = hi > lo
    n = len(symbols) + 1
    used = np.flatnonzero(np.cumsum(np.bincount(lo[some], minlength=n) - np.bincount(hi[some], minlength=n))[:-1] > 0)
    gap = np.ones(len(used), bool)
    gap[1:] = np.diff(used) > 1
    place = np.arange(len(used)) + np.cumsum(gap)
    where = np.zeros(n, np.int64)
    where[used] = place
    out, owner = np.zeros(len(used) + int(gap.sum()), U), np.zeros(len(used) + int(gap.sum()), np.int64)
    out[place], owner[place] = symbols[used], doc[used]
    return out, owner, [at, np.where(some, where[lo], 0), np.where(some, where[np.maximum(hi - 1, 0)] + 1, 0), spelt]


def _row(row: dict, symbols: np.ndarray, doc: np.ndarray, windows: list[np.ndarray]) -> dict:
    return {"block": row["block"], "n": len(windows[0]), "doc_ids": row["doc_ids"], "lengths": row["lengths"], "symbols": pack_columns(symbols, doc), "windows": pack_columns(*windows)}


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    symbols, doc = unpack_columns(row["symbols"], 2)
    at, lo, hi, spelt = unpack_columns(row["windows"], 4)
    return symbols, doc.astype(np.int64), [*(x.astype(np.int64) for x in (at, lo, hi)), spelt]


def _words(row: dict, length: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The words of a block as the first string, documents kept apart, and all its windows."""
    docs = Docs(row)
    place = np.arange(len(docs.tokens)) + docs.doc
    symbols, doc = np.zeros(len(docs.tokens) + len(docs.ids), U), np.zeros(len(docs.tokens) + len(docs.ids), np.int64)
    symbols[place], doc[place] = docs.tokens, docs.doc
    at = np.flatnonzero(docs.left() >= length)
    return symbols, doc, [at, place[at], place[at] + length, np.zeros(len(at), U)]


def _spelling(symbols: np.ndarray, windows: list[np.ndarray]) -> np.ndarray:
    """What windows spell, the symbols left at the top included."""
    _, lo, hi, spelt = windows
    c = np.concatenate([[U(0)], np.cumsum(symbols * powers(len(symbols) + 1)[: len(symbols)], dtype=U)])
    top = (c[hi] - c[lo]) * powers(len(symbols) + 1, True)[lo]
    return mix(spelt * U(0x9E3779B97F4A7C15) + mix(top + (hi - lo).astype(U)))


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans (doc_id, start_word, end_word, n_words) of which every word lies in a window of min_words words that another document has too.

    Words are those of words.py. Spans of a document don't overlap or touch. All rows count: copies of a whole document are
    spans over it, and two rows with one identifier, and repeated rows, are documents of their own. A repeat within one document
    alone is none. All holders of a passage are listed alike, so there are no ties. Null identifiers are left out; null, empty and
    shorter texts have no spans; texts may be of any length; other columns are ignored; an empty table gives no row.
    """
    if min_words < 2:
        raise ValueError("min_words must be at least 2")
    work = Shared(docs.sparkSession, "recompression")
    blocks = work.written(token_blocks(docs, id_col, text_col), "raw")
    n, total = blocks.agg(F.count("*"), F.sum("n_words")).first()
    workers = worker_count(n, (total or 0) // 3)
    state = numbered(blocks)
    for level in range(levels(min_words)):
        read = (lambda row: _words(row, min_words)) if level == 0 else _unpacked

        def keys_of(row: dict, level: int = level, read=read) -> tuple:
            symbols, doc, _ = read(row)
            return Level(symbols, level).keys(doc)

        def onward(row: dict, place: np.ndarray, said: np.ndarray, level: int = level, read=read) -> dict:
            symbols, doc, (at, lo, hi, spelt) = read(row)
            now = Level(symbols, level)
            following = now.named(said_each(now.keys(doc), place, said), level)
            return _row(row, *_compact(following, doc[now.start], [at, *now.read(lo, hi, spelt)]))

        answers = ask(work, f"level{level}", state, keys_of, workers, "shared")
        state = work.written(heard(state, answers, onward, _STATE, STATE), f"level{level}")
        work.dropped(f"level{level}-answers")
        work.dropped("raw" if level == 0 else f"level{level - 1}")

    def spelling(row: dict) -> tuple:
        symbols, _, windows = _unpacked(row)
        first = np.concatenate([[0], np.cumsum(unpack(row["lengths"], np.int64))])
        hi = _spelling(symbols, windows)
        return hi, np.zeros(len(hi), U), np.searchsorted(first, windows[0], "right") - 1

    answers = ask(work, "windows", state, spelling, workers, "shared")

    def spans(row: dict, place: np.ndarray, said: np.ndarray) -> dict:
        hi, lo, doc = spelling(row)
        hit = said_each((hi, lo, doc), place, said) > 0
        first = np.concatenate([[0], np.cumsum(unpack(row["lengths"], np.int64))])
        found = spans_table(unpack(row["doc_ids"], np.int64), first, doc[hit], unpack_columns(row["windows"], 4)[0].astype(np.int64)[hit], min_words)
        return {"block": row["block"], "n": 0, "doc_ids": b"", "lengths": b"", "symbols": pack_columns(*found.values()), "windows": b""}

    return listed(heard(state, answers, spans, _STATE, STATE).select(F.col("symbols").alias("spans")))


def listed(packed: DataFrame) -> DataFrame:
    """Rows of packed spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in unpack_columns(b, 4)], names=["doc_id", "start_word", "end_word", "n_words"])

    return packed.mapInArrow(run, SPANS)


def oracle(length: int = MIN_WORDS) -> str:
    """The same spans in SQL, by grouping all windows by their words."""
    return rf"""
with docs as (
  select row_number() over () as n, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') as w
  from documents where doc_id is not null and text is not null),
places as (select n, doc_id, w, unnest(range(len(w) - {length - 1})) as place from docs where len(w) >= {length}),
windows as (select n, doc_id, place, md5(array_to_string(w[place + 1 : place + {length}], ' ')) as h from places),
shared as (select h from windows group by h having count(distinct n) > 1),
hits as (select n, doc_id, place, place > coalesce(lag(place) over (partition by n order by place), -{length + 2}) + {length} as begins from windows where h in (select h from shared)),
numbered as (select *, sum(cast(begins as integer)) over (partition by n order by place) as span from hits)
select doc_id, cast(min(place) as bigint) as start_word, cast(max(place) + {length} as bigint) as end_word, cast(max(place) + {length} - min(place) as bigint) as n_words from numbered group by n, doc_id, span
"""
