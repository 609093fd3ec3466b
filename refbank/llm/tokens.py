"""Token ids as directly addressable codes.

File format: a table of segments.  A segment row holds whole documents in
ascending id order: ``shard`` (range partition), ``seq`` (place in the shard),
``local_start`` (ids before it in the shard), ``n_ids``, ``doc_ids``,
``lengths`` and ``payload``.  The payload is one directly addressable code
(:func:`encode`): ids are cut into 8-bit chunks; level 0 has the low chunk of
every id, level k the k-th chunk of the ids that need it; beside each level's
chunks lie a continuation bitmap (is there a higher chunk?) and a rank
directory (ones before each block of 512 bits).  Id i is read by following
ranks through at most as many levels as it has chunks; nothing else is
decoded (:class:`Codes`).

Payload, little-endian: ``DAC1``, u32 levels, then per level u32 chunk count,
chunks, bitmap padded to 64 bytes, u32 rank per block.

A table is written with Spark's committer to the shared folder, so a lost
executor costs a repeated task and nothing else.  Segments are closed after
``SEGMENT`` ids; a document is never cut, so one task holds one segment plus
one document.

Defined results: a null text is an empty text, an empty text has the end id
only; a null id sorts first; rows with one id are ordered by text and each is
kept; an empty table gives an empty file; other columns are not stored.
"""

from __future__ import annotations

import itertools
import re
import string
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from refbank.session import scratch_path

MAGIC = b"DAC1"
BLOCK = 512  # bits per rank directory entry
SEGMENT = 1 << 18
CACHE = 800_000  # distinct pieces a worker remembers
CALL_CHARS = 2_000_000  # of texts encoded together
PIECES = {}  # tokenizer path -> (tokenizer, piece -> ids); one per worker process


# ---- codes -----------------------------------------------------------------

def encode(ids: np.ndarray) -> bytes:
    """Directly addressable code of unsigned ids."""
    rest = np.ascontiguousarray(ids, dtype=np.uint64)
    levels = []
    while True:
        low, high = (rest & 255).astype(np.uint8), rest >> np.uint64(8)
        more = high > 0
        levels.append((low, more))
        if not more.any():
            break
        rest = high[more]
    out = [MAGIC, np.uint32(len(levels)).tobytes()]
    for low, more in levels:
        bitmap = np.zeros(-(-max(len(low), 1) // BLOCK) * (BLOCK // 8), np.uint8)
        packed = np.packbits(more, bitorder="little")
        bitmap[: len(packed)] = packed
        ones = np.bitwise_count(bitmap.view(np.uint64)).reshape(-1, BLOCK // 64).sum(1, dtype=np.uint32)
        ranks = np.concatenate(([0], np.cumsum(ones)[:-1])).astype("<u4")
        out += [np.uint32(len(low)).tobytes(), low.tobytes(), bitmap.tobytes(), ranks.tobytes()]
    return b"".join(out)


class Codes:
    """Reader of one payload: ``codes[i]`` reads one id, ``all()`` every id."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a directly addressable code")
        n_levels, at = int(np.frombuffer(payload, "<u4", 1, 4)[0]), 8
        self.levels = []
        for _ in range(n_levels):
            n = int(np.frombuffer(payload, "<u4", 1, at)[0])
            at += 4
            blocks = -(-max(n, 1) // BLOCK)
            low = np.frombuffer(payload, np.uint8, n, at)
            bitmap = np.frombuffer(payload, np.uint8, blocks * BLOCK // 8, at + n)
            at += n + blocks * BLOCK // 8
            ranks = np.frombuffer(payload, "<u4", blocks, at)
            at += 4 * blocks
            self.levels.append((low, bitmap, ranks))
        if at != len(payload):
            raise ValueError("damaged payload")

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for k, (low, bitmap, ranks) in enumerate(self.levels):
            value |= int(low[i]) << (8 * k)
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK
            first = block * (BLOCK // 8)
            ones = int(np.bitwise_count(bitmap[first: i >> 3]).sum())
            ones += int(bitmap[i >> 3] & ((1 << (i & 7)) - 1)).bit_count()
            i = int(ranks[block]) + ones
        return value

    def all(self) -> np.ndarray:
        at, out = None, None
        for k, (low, bitmap, _) in enumerate(self.levels):
            if out is None:
                out, at = low.astype(np.uint64), np.arange(len(low))
            else:
                out[at] |= low.astype(np.uint64) << np.uint64(8 * k)
            at = at[np.unpackbits(bitmap, count=len(low), bitorder="little").view(bool)]
        return out


# ---- tokenizing ------------------------------------------------------------

_ODD = re.compile(r"[^\S \n]|[\x1c-\x1f\x85]")
_ODD_ASCII = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
_SAFE = re.compile(r"(?<=\S) (?=\S)")
#: Letters of all Unicode versions, and signs that are neither letters, digits nor white space.
_LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+").fullmatch
SIGNS = string.punctuation


def byte_alphabet() -> dict[str, int]:
    """The signs byte-level vocabularies write bytes with: printable ones stand
    for themselves, the others are numbered from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


def _pieces(text: str) -> list[str]:
    """The text cut at single blanks between visible characters; every piece
    but the first stands for itself with its blank before it.  The byte-level
    pattern always starts a new token at such a blank, so pieces can be
    encoded one by one."""
    odd = any(c in text for c in _ODD_ASCII) if text.isascii() else _ODD.search(text)
    if odd or "  " in text or "\n " in text or " \n" in text:
        return _SAFE.split(text)
    return text.split(" ")


class Words(dict):
    """Words by number; one asked for that is not there is new."""

    def __init__(self, words: Iterable[str] = ()):
        super().__init__(zip(words, itertools.count()))
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Ragged:
    """Rows of ids, one behind the other; there is room to grow, so adding does
    not copy what is there."""

    def __init__(self):
        self._flat, self._start, self.rows = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), 0

    def add(self, flat: np.ndarray, n: np.ndarray) -> None:
        used, rows = int(self._start[self.rows]), self.rows + len(n)
        if used + len(flat) > len(self._flat):
            self._flat = np.concatenate((self._flat[:used], np.zeros(used + 2 * len(flat), np.uint32)))
        if rows >= len(self._start):
            self._start = np.concatenate((self._start[:self.rows + 1], np.zeros(rows + len(n), np.int64)))
        self._flat[used:used + len(flat)] = flat
        self._start[self.rows + 1:rows + 1] = used + np.cumsum(n)
        self.rows = rows

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = self._start[rows]
        n = self._start[rows + 1] - start
        place = np.arange(int(n.sum())) + np.repeat(start - (np.cumsum(n) - n), n)
        return self._flat[place], n

    def keep(self, rows: np.ndarray) -> None:
        flat, n = self.take(rows)
        self.__init__()
        self.add(flat, n)


class Again:
    """Which words of an index were met in more than one call."""

    def __init__(self):
        self.flag = np.zeros(1 << 14, bool)

    def note(self, rows: np.ndarray, before: int, size: int) -> None:
        """``rows`` are in use; those below ``before`` had been met earlier."""
        if size > len(self.flag):
            self.flag = np.concatenate((self.flag, np.zeros(size, bool)))
        self.flag[rows[rows < before]] = True

    def rows(self, most: int) -> np.ndarray:
        return np.flatnonzero(self.flag)[:most]


class Encoder:
    """Ids of texts by a byte-level BPE file; equal pieces are encoded once.

    Pieces are cut as the byte-level pattern cuts, so files with another
    pre-tokenizer or a normalizer have their texts encoded whole.  A piece of
    Latin letters with signs behind it is two runs of the pattern; the letters go
    straight to the merges."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        cut = self.tok.pre_tokenizer
        self.by_piece = (isinstance(cut, pre_tokenizers.ByteLevel) and cut.use_regex and not cut.add_prefix_space
                         and self.tok.normalizer is None and isinstance(self.tok.model, models.BPE) and not self.tok.model.ignore_merges)
        self.newline = self._ids(["\n"])[0]
        signs = {b: c for c, b in byte_alphabet().items()}
        self.table, self.blank = str.maketrans({chr(b): c for b, c in signs.items()}), signs[32]
        self.tails: dict[str, list[int]] = {}  # signs behind words -> ids
        self.index, self.words_ids, self.again = Words(), Ragged(), Again()

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a blank and each word, and how many."""
        merge, latin, tails, table = self.tok.model.tokenize, _LATIN, self.tails, self.table
        if len(tails) > CACHE // 8:
            tails.clear()
        stems: dict[str, list[int]] = {}
        out: list[list[int]] = []
        rest: list[int] = []  # places of words that go another way
        for at, w in enumerate(words):
            stem = w.rstrip(SIGNS)
            if not self.by_piece or not latin(stem):
                rest.append(at)
                out.append([])
                continue
            ids = stems.get(stem)
            if ids is None:
                raw = stem if stem.isascii() else stem.encode().decode("latin-1").translate(table)
                ids = stems[stem] = [t.id for t in merge(self.blank + raw)]
            if len(stem) < len(w):
                tail = w[len(stem):]
                more = tails.get(tail)
                if more is None:
                    more = tails[tail] = self._ids([tail])[0]
                ids = ids + more
            out.append(ids)
        # many pieces in one call, with a line break between: it is a token of its own
        plain = [k for k in rest if words[k].split() == [words[k]]] if self.by_piece and len(self.newline) == 1 else []
        apart = set(rest).difference(plain)
        for at in range(0, len(plain), 4096):
            part = plain[at:at + 4096]
            ids = self._ids([" " + "\n ".join([words[k] for k in part])])[0]
            stops = [k for k, i in enumerate(ids) if i == self.newline[0]]
            if len(stops) != len(part) - 1:
                apart.update(part)
                continue
            for k, x, y in zip(part, [0, *[x + 1 for x in stops]], [*stops, len(ids)]):
                out[k] = ids[x:y]
        alone = sorted(apart)
        for k, ids in zip(alone, self._ids([" " + words[k] for k in alone])):
            out[k] = ids
        n = np.fromiter(map(len, out), np.int64, len(out))
        return np.fromiter(itertools.chain.from_iterable(out), np.uint32, int(n.sum())), n

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.index) > CACHE:  # what came once may go; one call's own pieces may go beyond the bound
            kept, words = self.again.rows(CACHE // 2), list(self.index)
            self.index, self.again = Words([words[k] for k in kept.tolist()]), Again()
            self.words_ids.keep(kept)
        before = len(self.index)
        cut = [_pieces(t) if self.by_piece and not any(s in t for s in self.specials) else None for t in texts]
        heads = [t if c is None else c[0] for t, c in zip(texts, cut)]  # whole texts, else what has no blank before it
        tails = [() if c is None else c[1:] for c in cut]
        n = np.fromiter(map(len, tails), np.int64, len(tails))
        rows = np.fromiter(map(self.index.__getitem__, itertools.chain.from_iterable(tails)), np.int64, int(n.sum()))
        if self.index.new:
            new, self.index.new = self.index.new, []
            self.words_ids.add(*self.words(new))
        self.again.note(rows, before, len(self.index))
        ids, k = self.words_ids.take(rows)
        stops = np.concatenate(([0], np.cumsum(k)))[np.cumsum(n)].tolist()
        return [np.array(h, "<u4").tobytes() + ids[a:b].tobytes() for h, a, b in zip(self._ids(heads), [0, *stops], stops)]


def _encoder(path: str) -> Encoder:
    if path not in PIECES:
        PIECES[path] = Encoder(path)
    return PIECES[path]


def calls(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive rows of at most ``most`` in sum (a larger row by itself)."""
    first = held = 0
    for k, n in enumerate(sizes):
        if k > first and held + n > most:
            yield first, k
            first, held = k, 0
        held += n
    if first < len(sizes):
        yield first, len(sizes)


# ---- files -----------------------------------------------------------------

SEGMENTS = ("shard int, seq int, local_start long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary")


def write(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
          end_id: int = 2, segment_ids: int = SEGMENT) -> None:
    """Encode every document, append ``end_id``, and write the segment table."""
    end = np.array([end_id], "<u4").tobytes()

    def shard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        me, enc = TaskContext.get().partitionId(), _encoder(tokenizer)
        seq = start = held = 0
        ids, lens, raw = [], [], []

        def segment():
            return pd.DataFrame({"shard": [me], "seq": [seq], "local_start": [start], "n_ids": [held],
                                 "doc_ids": [ids], "lengths": [lens],
                                 "payload": [encode(np.frombuffer(b"".join(raw), "<u4"))]})

        for pdf in batches:
            names, texts = pdf["id"].tolist(), [t or "" for t in pdf["text"].tolist()]
            for a, b in calls([len(t) for t in texts], CALL_CHARS):
                for i, code in zip(names[a:b], enc(texts[a:b])):
                    ids.append(None if i is None else int(i))
                    raw += [code, end]
                    lens.append(len(code) // 4 + 1)
                    held += lens[-1]
                    if held >= segment_ids:
                        yield segment()
                        seq, start, held, ids, lens, raw = seq + 1, start + held, 0, [], [], []
        if ids:
            yield segment()

    (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
     .repartitionByRange("id").sortWithinPartitions("id", "text")
     # as text: a batch with a null id would turn longs into doubles
     .select(F.col("id").cast("string").alias("id"), "text")
     .mapInPandas(shard, SEGMENTS).write.parquet(path))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    segs = spark.read.schema(SEGMENTS).parquet(path)

    names = ["shard", "doc_id", "place", "n_tokens", "ids_crc32"]

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                raw = Codes(batch["payload"][k].as_py()).all().astype("<u4").tobytes()
                lens = np.asarray(batch["lengths"][k].values, np.int64)
                stops = np.cumsum(lens)
                view = memoryview(raw)
                crc = [zlib.crc32(view[4 * (b - n):4 * b]) for b, n in zip(stops.tolist(), lens.tolist())]
                start = batch["local_start"][k].as_py()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(lens), batch["shard"][k].as_py(), np.int32)), batch["doc_ids"][k].values,
                                                  pa.array(start + stops - lens), pa.array(lens), pa.array(crc, pa.int64())], names)

    rows = segs.select("shard", "local_start", "doc_ids", "lengths", "payload").mapInArrow(
        documents, "shard int, doc_id long, place long, n_tokens long, ids_crc32 long")
    # shards are as many as there were tasks: a short table of totals
    totals = segs.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    return rows.join(before, "shard").select(
        "doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, tokenizer: str, path: str | None = None, **kw) -> DataFrame:
    """Write the files (to the shared scratch folder unless told where) and
    report every document from what was read back."""
    path = path or scratch_path(docs.sparkSession, "token-ids")
    write(docs, path, tokenizer, **kw)
    return read(docs.sparkSession, path)
