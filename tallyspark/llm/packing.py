"""Packing tokenised documents into sequences of bounded length by swap-based local search.

Only the lengths decide a packing, so the search runs on their histogram, which has at most `room` entries whatever the
number of documents: a bin is a multiset of lengths, and equal bins are one row with a count. It starts from a plain order, bins that
hold one length each, and once more from bins filled with the longest lengths that fit, as it may end in different places; the better end counts. From there it tries, between underfull bins, to move a document, to exchange one for one, and to exchange
two for one or one for two, whenever that raises the sum of squared fills; bins so emptied disappear. It ends when no step between any two
bins helps. Exchanges between equal bins are done for all of them at once. Documents are then matched to the places of their length by rank.
Ranks are counted inside the task that tokenised them and offset by a table of counts per task and length.

Texts of more than `room` tokens are cut, from the end, into pieces of `room`; the first piece holds the rest.

Tokenising. A byte-level BPE file is read as ranks and run by tiktoken, which gives the ids that the tokenizers library gives
(the tests compare them) at a fifth of the time; other files are run by the tokenizers library. Strings of added tokens in a
text become these tokens, as that library has it.

Cases. A null or empty text is the closing id alone. Rows repeated, or with a null identifier, are packed as rows of
their own. A very long text is tokenised whole. Empty input gives an empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import functools
import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import rows_in, save, short_batches, small

ROOM, END = 1024, 2
#: How the byte-level BPE file cuts text before merging; a fixed value of that public vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 stands for itself, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.cache
def tokenizer(path: str):
    """From a text to its ids, for a file of the tokenizers library."""
    from tokenizers import Tokenizer

    spec = json.loads(open(path, encoding="utf-8").read())
    model, before = spec.get("model", {}), spec.get("pre_tokenizer") or {}
    added = spec.get("added_tokens", [])
    plain = model.get("type", "BPE") == "BPE" and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not spec.get("normalizer") and not model.get("dropout") and not model.get("ignore_merges")
    plain = plain and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added)
    if plain:
        import tiktoken

        letters, special = byte_letters(), {t["content"]: t["id"] for t in added}
        ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        if sorted(ranks.values()) == list(range(len(ranks))):
            fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
            return lambda text: fast.encode(text, allowed_special="all") if any(t in text for t in special) else fast.encode_ordinary(text)
    own = Tokenizer.from_file(path)
    return lambda text: own.encode(text, add_special_tokens=False).ids


def cuts(n: int, room: int = ROOM) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    first = n % room or min(n, room)
    return [(0, first)] + [(s, room) for s in range(first, n, room)]


# --- the search, on the histogram -------------------------------------------------------------------------------------


Bin = tuple[int, ...]


def plain_order(counts: dict[int, int], room: int) -> Counter:
    """Bins (sorted tuples of lengths) with their numbers: each length by itself, as many as fit in a bin."""
    bins: Counter[Bin] = Counter()
    for size, n in sorted(counts.items()):
        each = room // size
        if n >= each:
            bins[(size,) * each] += n // each
        if n % each:
            bins[(size,) * (n % each)] += 1
    return bins


def filled_order(counts: dict[int, int], room: int) -> Counter:
    """Bins filled one after the other with the longest lengths that still fit, equal bins at once."""
    left, bins = {k: v for k, v in counts.items() if v}, Counter()
    while left:
        space, took = room, Counter()
        for size in sorted(left, reverse=True):
            if k := min(space // size, left[size]):
                took[size] = k
                space -= size * k
        n = min(left[size] // k for size, k in took.items())
        for size, k in took.items():
            left[size] -= n * k
            if not left[size]:
                del left[size]
        bins[tuple(sorted(took.elements(), reverse=True))] += n
    return bins


def _sums(bin_: Bin) -> tuple[int, int]:
    """The lengths in a bin, and the sums of two of them, as bit sets."""
    kinds = sorted(set(bin_))
    ones = twos = 0
    for k, x in enumerate(kinds):
        ones |= 1 << x
        for y in kinds[k:]:
            if x != y or bin_.count(x) > 1:
                twos |= 1 << (x + y)
    return ones, twos


def _pair(bin_: Bin, total: int) -> Bin:
    have = Counter(bin_)
    return next((x, total - x) for x in have if total - x in have and (x * 2 != total or have[x] > 1))


def _swap(a: Bin, b: Bin, out_a: Bin, out_b: Bin) -> tuple[Bin, Bin]:
    x, y = Counter(a), Counter(b)
    x.subtract(out_a)
    x.update(out_b)
    y.subtract(out_b)
    y.update(out_a)
    return tuple(sorted(x.elements(), reverse=True)), tuple(sorted(y.elements(), reverse=True))


def most_gain(a: Bin, twos_a: int, ones_b: int, twos_b: int, most: int) -> int:
    """The most, up to `most`, that a can gain from what others hold by a move or an exchange of one for one, two for one or one for two; 0 if nothing."""
    gets, found = ones_b | twos_b, 0
    for x in (0, *set(a)):
        found |= gets >> x
    while twos_a and ones_b >> ((twos_a & -twos_a).bit_length() - 1):
        found |= ones_b >> ((twos_a & -twos_a).bit_length() - 1)
        twos_a &= twos_a - 1
    return (found & ((1 << (most + 1)) - 2)).bit_length() - 1 if found & ((1 << (most + 1)) - 2) else 0


def gains(d: int, ones_a: int, twos_a: int, ones_b: int, twos_b: int) -> bool:
    """Whether a step brings bin a exactly d from bin b."""
    return bool((ones_b | twos_b) & ((1 | ones_a) << d) or ones_b & (twos_a << d))


def exchange(a: Bin, b: Bin, d: int) -> tuple[Bin, Bin]:
    """The bins after a step by which a gains d from b."""
    mine, theirs = sorted(set(a)), set(b)
    ones, pairs = _sums(b)
    for x in (0, *mine):
        if x + d in theirs:
            return _swap(a, b, (x,) if x else (), (x + d,))
    for x in (0, *mine):
        if pairs >> (x + d) & 1:
            return _swap(a, b, (x,) if x else (), _pair(b, x + d))
    for y in sorted(theirs):
        if y > d and _sums(a)[1] >> (y - d) & 1:
            return _swap(a, b, _pair(a, y - d), (y,))
    raise ValueError("no such step")


def local_search(bins: Counter, room: int) -> Counter:
    """Exchange and move between underfull bins until no step helps. Bins that empty out are gone.

    A bin gains from those that are no fuller, so each step raises the sum of squared fills, and the search ends. The fullest bins come first;
    of the bins that give the most, the emptiest gives.
    """
    bins = Counter({k: n for k, n in bins.items() if k and n})
    sums: dict[Bin, tuple[int, int]] = {}
    moved = True
    while moved:
        moved = False
        under = sorted((b for b in bins if sum(b) < room), key=lambda b: (sum(b), b))
        for b in under:
            if b not in sums:
                sums[b] = _sums(b)
        for at in range(len(under) - 1, -1, -1):
            a = under[at]
            while bins[a]:
                # bins that other steps used up have no number left
                givers, ones, twos = [b for b in under[:at] if bins[b]] + [a] * (bins[a] > 1), 0, 0
                for b in givers:
                    ones, twos = ones | sums[b][0], twos | sums[b][1]
                best = most_gain(a, sums[a][1], ones, twos, room - sum(a))
                if not best:
                    break
                giver = next(b for b in givers if gains(best, *sums[a], *sums[b]))
                n = bins[a] // 2 if a == giver else min(bins[a], bins[giver])
                step = exchange(a, giver, best)
                for old in (a, giver):
                    bins[old] -= n
                for new in step:
                    if new:
                        bins[new] += n
                moved = True
        bins = +bins
    return bins


def pack_lengths(counts: dict[int, int], room: int = ROOM) -> list[tuple[tuple[int, ...], int]]:
    """Kinds of bins, each with its number; all lengths of counts are placed exactly once."""
    whole = Counter({(room,): counts[room]} if counts.get(room) else {})
    rest = {k: v for k, v in counts.items() if v and k < room}
    ends = [local_search(start(rest, room), room) for start in (plain_order, filled_order)]
    return sorted((whole + min(ends, key=lambda bins: sum(bins.values()))).items())


def places(kinds: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """Rows length, first (the first rank of that length that goes here), sequence (of that rank), offset: ranks follow on in steps of one bin."""
    rows, next_rank, sequence = [], Counter(), 0
    for kind, n in kinds:
        at = 0
        for size in kind:
            rows.append((size, next_rank[size], sequence, at))
            next_rank[size] += n
            at += size
        sequence += n
    return pd.DataFrame(rows, columns=["length", "first", "sequence", "offset"]).sort_values(["length", "first"], kind="stable", ignore_index=True)


# --- the operator ------------------------------------------------------------------------------------------------------

PIECES = "doc_id {}, piece int, start long, length long, ids binary, part int, rank long"


def tokenise(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", room: int = ROOM, end: int = END) -> DataFrame:
    """Pieces: doc_id, piece, start, length, ids (little-endian unsigned 32-bit), and the rank among the task's pieces of that length."""
    short_batches(docs.sparkSession, 500)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encode, part, seen = tokenizer(path), TaskContext.get().partitionId(), np.zeros(room + 1, dtype=np.int64)
        for b in batches:
            out = []
            for doc, text in zip(b["id"], b["text"]):
                ids = np.array([*encode(text if isinstance(text, str) else ""), end], dtype="<u4")
                for piece, (start, n) in enumerate(cuts(len(ids), room)):
                    out.append((doc, piece, start, n, ids[start : start + n].tobytes(), part, int(seen[n])))
                    seen[n] += 1
            frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids", "part", "rank"])
            yield frame.astype({"doc_id": "Int64"}) if kind == "bigint" else frame

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if kind == "bigint":  # a null must not turn whole numbers into floating ones
        rows = rows.withColumn("id", F.col("id").cast("string"))
        inner = run

        def run(batches):  # noqa: F811
            return inner(b.assign(id=pd.array([None if pd.isna(x) else int(x) for x in b["id"]], dtype="Int64")) for b in batches)

    return rows.mapInPandas(run, PIECES.format(kind))


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", room: int = ROOM, end: int = END) -> DataFrame:
    """Rows doc_id, piece, start, length, ids, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = save(tokenise(docs, path, id_col, text_col, room, end), "pieces")
    per_part = save(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts", narrow=True, rows="true")
    histogram = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `room` rows
    table = places(pack_lengths(histogram, room))
    # offset of each task's ranks: partial sums over tasks, for each length
    from pyspark.sql import Window

    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = per_part.select("part", "length", before.alias("base"))
    rows = pieces.join(small(base, 32, rows_in(per_part)), ["part", "length"])
    lookup = {k: (g["first"].to_numpy(), g["sequence"].to_numpy(), g["offset"].to_numpy()) for k, g in table.groupby("length")}
    shared = spark.sparkContext.broadcast(lookup)

    @F.pandas_udf("sequence_id long, offset long")
    def place(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for lengths, ranks in batches:
            length, rank = lengths.to_numpy(), ranks.to_numpy()
            out = np.zeros((len(length), 2), dtype=np.int64)
            for n in np.unique(length):
                at = np.nonzero(length == n)[0]
                first, sequence, offset = own[int(n)]
                i = np.searchsorted(first, rank[at], side="right") - 1
                out[at, 0], out[at, 1] = sequence[i] + rank[at] - first[i], offset[i]
            yield pd.DataFrame(out, columns=["sequence_id", "offset"])

    rows = rows.withColumn("__place", place("length", F.col("base") + F.col("rank")))
    return rows.select("doc_id", "piece", "start", "length", "ids", "__place.*")
