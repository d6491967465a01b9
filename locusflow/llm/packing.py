"""Best-fit packing of token sequences by bin completion.

Tokenisation is one pass over the texts; a document longer than a sequence is
cut, so that all pieces but the first are full. Only the number of pieces by
length, at most capacity rows, goes to the driver: pieces of one length are
alike, so packing is over this histogram, however large the corpus is. The
largest length left is the bin's first item; fillings of the rest that no other
one dominates are enumerated, and the search branches over them, least waste
first, each as often as its lengths last or once, and backtracks. A branch ends
if its bins and the volume left reach the incumbent, at first the whole best-fit
packing, or if what is left has been met with as few bins. The search ends when
the incumbent is at a lower bound, when nothing is left to try, or at its caps:
NODES partial fillings a bin and SEARCH in all after the first descent.
Pieces take the places for their length by
rank: rank in the task plus the count of earlier tasks, no window over a length.

Defined cases: a null text is empty and has its end token only; repeated rows
are packed each; rows with a null id too; an empty table gives an empty result.
"""

from __future__ import annotations

import logging
import zlib
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusflow.llm.common import materialize, prepare

log = logging.getLogger(__name__)
CAPACITY, END = 1024, 2
TOKENIZER = "byte_bpe_50k.json"
#: Partial fillings looked at for a bin, and for all bins once the search has turned back.
NODES, SEARCH = 2000, 500_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long"
#: How byte-level tokenizers of this kind split a text before merging bytes; a fixed value.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: White space of this length or more is cut out before the split.
LONG_SPACE = 10_000
_LONG_SPACE = regex.compile(rf"\p{{White_Space}}{{{LONG_SPACE},}}+")


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable ones stand for themselves, the others are numbered from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


class Ids:
    """Little-endian ids of texts, by a vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        import tiktoken
        import tokenizers

        self.whole = tokenizers.Tokenizer.from_file(path)
        vocabulary, marks = self.whole.get_vocab(with_added_tokens=False), _byte_letters()
        ranks = {bytes(marks[c] for c in token): k for token, k in vocabulary.items() if all(c in marks for c in token)}
        added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        ranks = {k: v for k, v in ranks.items() if k not in {a.encode() for a in added}}
        # the same merges by rank, several times as fast as the whole tokenizer
        self.merges = tiktoken.Encoding("merges", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.piece = self.merges._core_bpe.encode_single_piece

    def __call__(self, text: str) -> bytes:
        if "<|" in text:  # a special token's own text is one id, wherever it stands
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        out, at = array("I"), 0
        if len(text) >= LONG_SPACE:
            # the split backtracks over a run of white space; it is one piece up to its last character, which may go with what follows
            for m in _LONG_SPACE.finditer(text):
                out.extend(self.merges.encode_ordinary(text[at : m.start()]))
                at = m.end() - (m.end() < len(text))
                out.extend(self.piece(text[m.start() : at].encode()))
        out.extend(self.merges.encode_ordinary(text[at:] if at else text))
        return out.tobytes()


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str | None, capacity: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of, end = Ids(tokenizer or tokenizer_path()), np.array([END], "<u4").tobytes()
        task, seen = TaskContext.get().partitionId(), Counter()
        for b in batches:
            out = []
            for doc_id, text in zip(b["doc_id"], b["text"]):
                ids = memoryview(ids_of(text or "") + end)
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    out.append((doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), task, seen[length]))
                    seen[length] += 1
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in PIECES.split(", ")])
            yield frame.assign(doc_id=pd.array([None if x is None else int(x) for x in frame["doc_id"]], dtype="Int64"))

    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    return materialize(rows.mapInPandas(run, PIECES), "pieces")


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: (lengths of a bin, how many such bins).
    Open bins are kept by what is left in them; equal bins are one entry."""
    open_: dict[int, dict[tuple[int, ...], int]] = {}
    for length in sorted(counts, reverse=True):
        need = counts[length]
        while need:
            room = min((r for r in open_ if r >= length), default=None)
            if room is None:  # new bins take as many of this length as fit
                each = min(capacity // length, need)
                bins, kind = need // each, (length,) * each
                need -= bins * each
                slot = open_.setdefault(capacity - each * length, {})
                slot[kind] = slot.get(kind, 0) + bins
                continue
            kind, have = next(iter(open_[room].items()))
            each = min(room // length, need)
            bins = min(have, need // each)
            need -= bins * each
            for r, k, n in ((room, kind, -bins), (room - each * length, kind + (length,) * each, bins)):
                slot = open_.setdefault(r, {})
                slot[k] = slot.get(k, 0) + n
                if not slot[k]:
                    del slot[k]
            if not open_[room]:
                del open_[room]
    return [(k, n) for slot in open_.values() for k, n in slot.items()]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Martello and Toth's bound: for each k, what lengths of k or more need beside those over half."""
    lengths = np.array(sorted(counts), np.int64)
    n = np.array([counts[k] for k in lengths.tolist()], np.int64)
    best = -(-int((lengths * n).sum()) // capacity) if len(n) else 0
    big = 2 * lengths > capacity
    for k in [0, *lengths[~big].tolist()]:
        alone, mid = big & (lengths > capacity - k), big & (lengths <= capacity - k)
        small = ~big & (lengths >= k)
        room = int(((capacity - lengths) * n)[mid].sum())
        best = max(best, int(n[big].sum()) + max(0, -(-(int((lengths * n)[small].sum()) - room) // capacity)))
    return best


def dominated(filling: tuple[int, ...], slack: int, left: dict[int, int], present: int) -> bool:
    """Whether a length left over could take the place of some of the filling (none, too), with less
    waste, or of two or more with the same: what it replaces fits where it was. present: bits of left."""
    one, two = 1, 0
    for x in filling:
        one, two = one | one << x, two | two << x | (one & ~1) << x
    for x, c in Counter(filling).items():
        if left[x] == c:
            present &= ~(1 << x)
    spread, width = one << 1, 1  # sums raised by 1 to width
    if not slack:
        return bool(two & present)
    while width < slack:
        step = min(width, slack - width)
        spread, width = spread | spread << step, width + step
    return bool((spread | two) & present)


def fillings(left: dict[int, int], room: int, spare: int) -> tuple[list[tuple[int, ...]], int]:
    """The undominated fillings of room that waste at most spare, least waste first, and the nodes taken."""
    lengths = sorted((x for x in left if x <= room), reverse=True)
    after = np.cumsum([0, *[x * left[x] for x in reversed(lengths)]])[::-1].tolist()  # volume from a length on
    present = sum(1 << x for x in lengths)
    found, others, stack, nodes = [], [], [(0, (), room)], 0
    while stack and nodes < NODES:
        at, chosen, free = stack.pop()
        nodes += 1
        if free <= spare:
            (others if dominated(chosen, free, left, present) else found).append((free, chosen))
        more = []
        for i in range(bisect_left(lengths, -free, at, key=lambda x: -x), len(lengths)):
            if free - after[i] > spare:
                break
            if chosen.count(lengths[i]) < left[lengths[i]]:
                more.append((i, (*chosen, lengths[i]), free - lengths[i]))
        stack += reversed(more)
    if stack:  # at the cap, what dominates them may not have been reached
        found = found or others
    return [f for _, f in sorted(found, key=lambda x: x[0])], nodes


def pack(counts: dict[int, int], capacity: int = CAPACITY, report: dict | None = None) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, times): bins that hold every piece once. report gets their number,
    the lower bound, and whether they are proven the fewest or a cap was met."""
    fit = best_fit(counts, capacity)
    best, bins = fit, sum(n for _, n in fit)
    least, total = lower_bound(counts, capacity), sum(k * n for k, n in counts.items())
    left, taken, used, waste = dict(counts), [], 0, 0
    seen: dict[int, int] = {}
    budget, turned, capped = SEARCH, False, False

    def moves() -> Iterator[tuple[tuple[int, ...], int]]:
        nonlocal budget, capped
        state = xxhash.xxh3_128_intdigest(np.array(sorted(left.items()), np.int64).tobytes())
        if seen.get(state, bins) <= used:
            return
        seen[state] = used
        largest = max(left)
        left[largest] -= 1
        rest = {x: n for x, n in left.items() if n}
        left[largest] += 1
        found, nodes = fillings(rest, capacity - largest, (bins - 1) * capacity - total - waste)
        budget -= nodes if turned else 0
        capped |= nodes >= NODES
        for f in found:
            kind = (largest, *f)
            most = min(left[x] // c for x, c in Counter(kind).items())
            yield from ((kind, t) for t in dict.fromkeys((most, 1)))

    def take(kind: tuple[int, ...], times: int) -> None:
        nonlocal used, waste
        for x, c in Counter(kind).items():
            left[x] = left.get(x, 0) - c * times
            if not left[x]:
                del left[x]
        used, waste = used + times, waste + (capacity - sum(kind)) * times

    stack = [moves()] if left else []
    while stack and bins > least and budget > 0:
        move = next(stack[-1], None)
        if move is None:
            turned = True
            stack.pop()
            if taken:
                kind, times = taken.pop()
                take(kind, -times)
            continue
        if waste + (capacity - sum(move[0])) * move[1] > (bins - 1) * capacity - total:
            continue  # the volume left needs as many bins as the incumbent
        take(*move)
        taken.append(move)
        if left:
            stack.append(moves())
        else:
            if used < bins:
                best, bins = list(taken), used
            taken.pop()
            take(move[0], -move[1])
            turned = True
    if report is not None:
        report |= {"bins": bins, "bound": least, "fewest": bins <= least or not (capped or budget <= 0)}
    return best


def places(bins: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: the first rank of each run of places, and the sequence and offset of its first place."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    taken: Counter = Counter()
    first = 0
    for kind, times in bins:
        offset = 0
        for length in kind:
            runs.setdefault(length, []).append((taken[length], first, offset))
            taken[length] += times
            offset += length
        first += times
    return {k: tuple(np.array(x, np.int64) for x in zip(*v)) for k, v in runs.items()}


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    prepare(spark)
    found = pieces(docs, id_col, text_col, tokenizer, capacity)
    counts = materialize(found.groupBy("task", "length").count(), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most capacity rows
    report: dict = {}
    bins = pack(histogram, capacity, report)
    log.info("%(bins)d sequences, at least %(bound)d; proven the fewest: %(fewest)s", report)
    if len(histogram) > capacity:
        raise AssertionError("more lengths than a sequence has places")
    # at most capacity lengths; equal bins are one run, so this grows with the kinds of bins, not with documents
    at = spark.sparkContext.broadcast(places(bins))
    before = F.sum("count").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    offsets = materialize(counts.select(F.col("task"), F.col("length"), F.coalesce(before, F.lit(0)).cast("long").alias("before")), "offsets")
    ranked = found.join(offsets, ["task", "length"]).withColumn("rank", F.col("rank") + F.col("before"))

    @F.pandas_udf("struct<sequence_id:bigint,offset:bigint>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        sequence, offset = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
        for k in np.unique(n):
            own = n == k
            first, base, off = at.value[int(k)]
            run = np.searchsorted(first, r[own], side="right") - 1
            sequence[own], offset[own] = base[run] + r[own] - first[run], off[run]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    out = ranked.withColumn("x", place("length", "rank"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "x.sequence_id", "x.offset")
