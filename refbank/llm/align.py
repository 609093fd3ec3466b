"""Alignment of two tokenizers over the same bytes.

A text is encoded twice: with a blank before it by a byte-level BPE file (A), and
as it is by a sentencepiece model that adds the blank itself (B).  Byte offsets
where tokens of both end cut the tokens into groups, and the two tokens that end
there are linked.

Diagonal run skipping (:func:`runs`).  The token ends of A and B are two rising
arrays.  At the current index shift ``j - i`` equal ends are a stretch of
one-to-one groups; slices of doubling length are compared along that diagonal
and the last one is halved down, so a stretch of n groups costs about 2 log n
comparisons of slices.  Where the ends part, the smaller one is advanced until
they meet again, which closes an irregular group and fixes the new shift.

Corpus counts.  Documents are aligned in blocks (a few MB of text, one stored
row each); a block holds its distinct (A id, B id) pairs once and every link as
an index into them.  Pairs are counted per block, summed over the corpus, and
met again as one row per block and pair, so neither the documents' links nor the
pair table pass through one task or the driver.  The best count of a B id comes
from a table with at most one row per entry of B.

Defined results: a text has no tokens if it is null or empty, or if the joined
bytes of A or of B are not the blank and the text (B writes U+2581 as a blank,
so texts that hold this sign have none); it then has zeros and an empty digest.
Strings of special tokens are ordinary text.  Rows are aligned one by one:
repeated rows each count, null ids and ids of any type pass through unchanged.
An empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refbank.llm.common import store
from refbank.llm.tokens import _SAFE, Again, Encoder, Ragged, Words, _pieces, byte_alphabet

BLOCK_CHARS = 1_000_000  # text characters of a block (a longer text is a block of its own)
CACHE = 500_000  # words a worker remembers
_PAIRS: dict[tuple[str, str], Pair] = {}  # one per worker process


def runs(ea: list[int], eb: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(i, j, n) as three lists: tokens i, i+1, ... of A and j, j+1, ... of B end
    together n times.  Both lists rise and have the same last value."""
    at_i, at_j, length = [], [], []
    i = j = 0
    n, m = len(ea), len(eb)
    while i < n and j < m:
        x, y = ea[i], eb[j]
        while x != y:  # an irregular group: the side that is behind goes on
            if x < y:
                i += 1
                x = ea[i]
            else:
                j += 1
                y = eb[j]
        at_i.append(i)
        at_j.append(j)
        k, step, room = 1, 1, min(n - i, m - j)
        if room > 1 and ea[i + 1] == eb[j + 1]:  # the diagonal goes on: probe ahead
            k = step = 2
            while k + step <= room and ea[i + k:i + k + step] == eb[j + k:j + k + step]:
                k += step
                step *= 2
            while step > 1:
                step //= 2
                if k + step <= room and ea[i + k:i + k + step] == eb[j + k:j + k + step]:
                    k += step
        length.append(k)
        i += k
        j += k
    return at_i, at_j, length


class PlainEncoder(Encoder):
    """Ids without special tokens: their strings are text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tok.encode_special_tokens = True
        self.specials = []

class PieceEncoder:
    """Ids by a sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        #: whether every piece ends within a word
        self.by_word = not any("▁" in p.lstrip("▁") for p in self.pieces)

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self.sp.encode(words, num_threads=1)
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(n.sum())), n


class Pair:
    """Both tokenizers and the bytes of their entries.

    Both start a token at a single blank between visible signs and let none go
    on over it, so texts are cut there and each word is encoded once for both."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = PlainEncoder(a_path), PieceEncoder(b_path)
        signs = byte_alphabet()
        vocab = self.a.tok.get_vocab()
        a = [b""] * (max(vocab.values()) + 1)
        for entry, i in vocab.items():
            a[i] = bytes(signs[c] for c in entry) if all(c in signs for c in entry) else entry.encode()
        sp = self.b.sp
        b = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(self.b.pieces)]
        self.bytes = a, b
        self.sizes = [np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b)]
        # an id as text with what follows it: "," inside a group's half, "|" or ";" at its end
        self.texts = []
        for x, end in ((a, "|"), (b, ";")):
            both = np.empty(2 * len(x), object)
            both[0::2] = [f"{i},".encode() for i in range(len(x))]
            both[1::2] = [f"{i}{end}".encode() for i in range(len(x))]
            self.texts.append(both)
        self.index, self.ids, self.fine, self.again = Words(), (Ragged(), Ragged()), np.zeros(0, bool), Again()

    def _cut(self, text: str) -> list[str]:
        if not (self.a.by_piece and self.b.by_word):
            return [text]
        return _SAFE.split(text) if text[0] == " " or text[-1] == " " else [w for w in _pieces(text)]

    def _learn(self) -> None:
        new, self.index.new = self.index.new, []
        want = [b" " + w.encode() for w in new]
        fine = np.ones(len(new), bool)
        for side, encoder in enumerate((self.a, self.b)):
            flat, n = encoder.words(new)
            self.ids[side].add(flat, n)
            parts = list(map(self.bytes[side].__getitem__, flat.tolist()))
            if b"".join(parts) != b"".join(want) or not (np.add.reduceat(np.append(self.sizes[side][flat], 0), np.cumsum(n) - n) == list(map(len, want))).all():
                stops = np.cumsum(n).tolist()
                fine &= [b"".join(parts[x:y]) == w for x, y, w in zip([0, *stops], stops, want)]
        self.fine = np.concatenate((self.fine, fine))

    def align(self, texts: list[str | None]) -> Aligned:
        if len(self.index) > CACHE:  # what came once may go
            kept, words = self.again.rows(CACHE // 2), list(self.index)
            self.index, self.again, self.fine = Words([words[k] for k in kept.tolist()]), Again(), self.fine[kept]
            for x in self.ids:
                x.keep(kept)
        before = len(self.index)
        cut = [self._cut(t) if t else [] for t in texts]
        n = np.fromiter(map(len, cut), np.int64, len(cut))
        rows = np.fromiter(map(self.index.__getitem__, itertools.chain.from_iterable(cut)), np.int64, int(n.sum()))
        if self.index.new:
            self._learn()
        self.again.note(rows, before, len(self.index))
        # a text with a word whose bytes do not come back has no tokens
        bad = np.unique(np.repeat(np.arange(len(cut)), n)[~self.fine[rows]])
        keep = np.ones(len(cut), bool)
        keep[bad] = False
        rows, n = rows[np.repeat(keep, n)], np.where(keep, n, 0)
        out = []
        for x in self.ids:
            ids, k = x.take(rows)
            upto = np.concatenate(([0], np.cumsum(k)))[np.concatenate(([0], np.cumsum(n)))]
            out.append((ids.astype(np.int64), np.diff(upto)))
        return Aligned(self, *out)


class Aligned:
    """Tokens, groups and links of some texts, laid one behind the other."""

    def __init__(self, pair: Pair, *sides: tuple[np.ndarray, np.ndarray]):
        self.pair = pair
        self.ids, self.n = zip(*sides)  # of A and of B: all ids, and how many each text has
        sizes = [s[i] for s, i in zip(pair.sizes, self.ids)]
        if not all(s.all() for s in sizes):
            raise ValueError("a token without bytes")
        self.ends = [np.cumsum(s) for s in sizes]
        i, j, k = (np.array(x, np.int64) for x in runs(*(e.tolist() for e in self.ends)))
        inside = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        self.last = np.repeat(i, k) + inside, np.repeat(j, k) + inside  # each group's last tokens
        self.links = self.ids[0][self.last[0]] << 32 | self.ids[1][self.last[1]]
        stops = np.cumsum(self.n[0])
        upto = np.searchsorted(self.last[0], stops)
        self.n_groups = np.diff(upto, prepend=0)

    def digests(self) -> list[str]:
        """SHA-256 of ``a1,a2|b1;...`` of each text, empty without tokens."""
        groups = [np.searchsorted(x, np.arange(len(i))) for x, i in zip(self.last, self.ids)]
        before_b = np.concatenate(([0], self.last[1] + 1))
        at = [np.arange(len(self.ids[0])) + before_b[groups[0]], np.arange(len(self.ids[1])) + self.last[0][groups[1]] + 1]
        parts = np.empty(len(self.ids[0]) + len(self.ids[1]), object)
        for s in (0, 1):
            closes = np.zeros(len(self.ids[s]), np.int64)
            closes[self.last[s]] = 1
            parts[at[s]] = self.pair.texts[s][2 * self.ids[s] + closes]
        listed = parts.tolist()
        stops = np.cumsum(self.n[0] + self.n[1]).tolist()
        return [hashlib.sha256(b"".join(listed[x:y])[:-1]).hexdigest() if y > x else "" for x, y in zip([0, *stops], stops)]


def pair(a_path: str, b_path: str) -> Pair:
    if (a_path, b_path) not in _PAIRS:
        _PAIRS[a_path, b_path] = Pair(a_path, b_path)
    return _PAIRS[a_path, b_path]


def _aligned(p: Pair, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, Aligned]]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        first = held = 0
        for k, t in enumerate(texts):
            if k > first and held + len(t or "") > BLOCK_CHARS:
                yield batch.column("id")[first:k], p.align(texts[first:k])
                first, held = k, 0
            held += len(t or "")
        if first < len(texts):
            yield batch.column("id")[first:], p.align(texts[first:])


def groups(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, place, start, stop, a, b): every group with its byte range in the
    blank and text, and the ids of both sides."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _aligned(pair(a_path, b_path), batches):
            doc = np.repeat(np.arange(len(ids)), x.n_groups)
            first = np.cumsum(x.n_groups) - x.n_groups
            stop = x.ends[0][x.last[0]]
            base = np.concatenate(([0], stop))[first]  # bytes before each text
            start = np.concatenate(([0], stop[:-1]))
            offsets = [pa.array(np.concatenate(([0], e + 1)), pa.int32()) for e in x.last]
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(doc)), pa.array(np.arange(len(doc)) - first[doc]), pa.array(start - base[doc]), pa.array(stop - base[doc]),
                 *(pa.ListArray.from_arrays(o, pa.array(i, pa.int32())) for o, i in zip(offsets, x.ids))],
                ["id", "place", "start", "stop", "a", "b"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, place long, start long, stop long, a array<int>, b array<int>")


def blocks(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per block: its documents, its distinct pairs with their numbers,
    and every link as an index into the pairs."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        me = TaskContext.get().partitionId() << 32
        for seq, (ids, x) in enumerate(_aligned(pair(a_path, b_path), batches)):
            pairs, index, times = np.unique(x.links, return_inverse=True, return_counts=True)
            wide = "<u2" if len(pairs) <= 1 << 16 else "<u4"
            yield pa.RecordBatch.from_arrays(
                [pa.array([me | seq]), pa.array([ids.to_pylist()], pa.list_(ids.type)),
                 *(pa.array([v.astype("<i8").tobytes()], pa.binary()) for v in (*x.n, x.n_groups, pairs, times)),
                 pa.array([index.astype(wide).tobytes()], pa.binary()), pa.array([x.digests()])],
                ["block", "ids", "n_a", "n_b", "n_groups", "pairs", "times", "links", "sha"])

    return rows.mapInArrow(run, f"block long, ids array<{kind}>, n_a binary, n_b binary, n_groups binary, pairs binary, "
                                "times binary, links binary, sha array<string>")


def pair_rows(held: DataFrame) -> DataFrame:
    """(block, pair, n): the distinct pairs of every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, pairs, times in zip(*(batch.column(c).to_pylist() for c in ("block", "pairs", "times"))):
                p, t = np.frombuffer(pairs, "<i8"), np.frombuffer(times, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), block)), pa.array(p), pa.array(t)], ["block", "pair", "n"])

    return held.select("block", "pairs", "times").mapInArrow(run, "block long, pair long, n long")


def pair_counts(held: DataFrame) -> DataFrame:
    """(pair, count, best): links that hold the pair corpus-wide, and whether no
    other A id is linked more often with its B id."""
    totals = store(pair_rows(held).groupBy("pair").agg(F.sum("n").alias("count")), "pair-totals")
    b_id = F.col("pair").bitwiseAND((1 << 32) - 1)
    top = totals.groupBy(b_id.alias("b")).agg(F.max("count").alias("top"))  # at most one row per entry of B
    return totals.withColumn("b", b_id).join(top, "b").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per row."""
    held = store(blocks(docs, a_path, b_path, id_col, text_col), "aligned-blocks")
    met = pair_rows(held).select("block", "pair").join(pair_counts(held), "pair")
    kind = held.schema["ids"].dataType.elementType.simpleString()

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right["pair"].to_numpy())
        count, best = right["count"].to_numpy()[order], right["best"].to_numpy()[order].astype(np.int64)
        out = []
        for r in left.to_pylist():
            n_a, n_b, n_groups = (np.frombuffer(r[c], "<i8") for c in ("n_a", "n_b", "n_groups"))
            links = np.frombuffer(r["links"], "<u2" if len(order) <= 1 << 16 else "<u4")
            stops = np.cumsum(n_groups)
            sums = [np.diff(np.concatenate(([0], np.cumsum(v[links])))[stops], prepend=0) for v in (best, count)]
            out.append(pa.table([pa.array(r["ids"], left["ids"].type.value_type), n_a, n_b, n_groups, n_groups, *sums, pa.array(r["sha"], pa.string())],
                                ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]))
        return pa.concat_tables(out)

    return held.drop("pairs", "times").groupBy("block").cogroup(met.groupBy("block")).applyInArrow(
        score, f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
