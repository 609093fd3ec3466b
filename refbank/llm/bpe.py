"""Byte-level BPE by recursive queries, one in-process DuckDB per partition.

``encode``: a task cuts every text with the tokenizer's pattern, lays the bytes
of the distinct words it has not met yet out as (word, position, token) rows
and lets a recursive query join neighbouring rows with the merge table and
contract each word's leftmost pair of least rank until no pair has a rank.
``decode``: token rows join the vocabulary and an ordered aggregation puts the
bytes of each document together.

Long words.  A word of over ``LONG`` bytes is first cut between bytes that stand
side by side in no token (no merge crosses such a place).  What is still long
goes through a second form of the query that contracts all occurrences of the
least pair at once where that is the same as one after the other: the merged
token M is *safe* if no token of lower rank has M at one end and another token
as the rest, so no contraction of M can bring a pair to the front.  Other pairs
are contracted leftmost first, one a step.  The recursion is left after a number
of steps that bounds the rows it holds, and entered again with what it reached.

Words are remembered by worker up to ``CACHE``; nothing is shared or collected,
so a lost executor costs its own tasks.

Defined results: a null text is an empty text, which has no ids and no bytes;
rows are answered one by one, so repeated rows, null ids and rows with one id
come out as often as they come in; an empty table gives an empty table; other
columns are not read.  Ids of any type pass through unchanged.
"""

from __future__ import annotations

import base64
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG = 64  # bytes of a word that takes the second form
CACHE = 500_000  # words a worker remembers
WORDS = 20_000  # words of one recursive query
CALL_CHARS = 1_000_000  # text characters handled together
STEP_ROWS = 4_000_000  # rows a recursion may hold
BLOCK = 1 << 16  # tokens of one decoding group
MEMORY = "256MB"
_CODERS: dict[tuple[str, str], Coder] = {}  # one per worker process

# rows of the least pair per word: (rank, position) packed in one integer
_SHORT = """
WITH RECURSIVE step(w, i, tok, n) AS (
  SELECT w, i, tok, 0 FROM start
  UNION ALL
  (WITH p AS (SELECT *, lead(tok) OVER x AS tok2, lead(i) OVER x AS i2, lead(w) OVER x AS w2 FROM step WINDOW x AS (ORDER BY i)),
   least AS (SELECT w, min(rank << 32 | i) AS k, arg_min(i2, rank << 32 | i) AS gone
             FROM p JOIN merges ON l = tok AND r = tok2 WHERE w2 = w GROUP BY w)
   SELECT p.w, i, CASE WHEN i = k & 4294967295 THEN (k >> 32)::INT ELSE tok END, n + 1
   FROM p JOIN least ON p.w = least.w WHERE i <> gone))
SELECT step.w, i, tok FROM step JOIN (SELECT w, max(n) AS n FROM step GROUP BY w) USING (w, n) ORDER BY i
"""

_REPEATS = """
WITH RECURSIVE step(w, i, tok, n) AS (
  SELECT w, i, tok, 0 FROM start
  UNION ALL
  (WITH p AS (SELECT *, lead(tok) OVER x AS tok2, row_number() OVER x AS o FROM step WHERE n < $steps
              WINDOW x AS (PARTITION BY w ORDER BY i)),
   q AS (SELECT p.*, rank, safe, min(rank) OVER (PARTITION BY w) AS least FROM p LEFT JOIN merges ON l = tok AND r = tok2),
   c AS (SELECT *, count(*) FILTER (rank = least) OVER (PARTITION BY w ORDER BY i) AS k FROM q WHERE least IS NOT NULL),
   d AS (SELECT *, coalesce(rank = least AND CASE WHEN NOT safe THEN k = 1
                   WHEN tok = tok2 THEN row_number() OVER (PARTITION BY w, rank = least, o - k ORDER BY i) % 2 = 1
                   ELSE true END, false) AS taken FROM c),
   e AS (SELECT *, coalesce(lag(taken) OVER (PARTITION BY w ORDER BY i), false) AS gone FROM d)
   SELECT w, i, CASE WHEN taken THEN least::INT ELSE tok END, n + 1 FROM e WHERE NOT gone))
SELECT step.w, i, tok, n = $steps AS open FROM step JOIN (SELECT w, max(n) AS n FROM step GROUP BY w) USING (w, n) ORDER BY i
"""

_DECODE = """
SELECT piece, string_agg(chars, '' ORDER BY pos) AS chars FROM tokens JOIN vocab ON tok = id GROUP BY piece ORDER BY piece
"""


class Coder:
    """Words to ids and ids to bytes by a rank file."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        self.find = regex.compile(pattern).findall
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        ranks = self.ranks
        splits = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t))
                  if t[:k] in ranks and t[k:] in ranks]
        fronts = {x for a, b, r in splits for x in (a, b) if x > r}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.joined = np.zeros((256, 256), bool)
        for t in ranks:
            self.joined[np.frombuffer(t[:-1], np.uint8), np.frombuffer(t[1:], np.uint8)] = True
        self.size = max(ranks.values()) + 1
        self.known: dict[str, bytes] = {}
        self.again: set[str] = set()  # words met in more than one call
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        a, b, r = (np.array(x, np.int64) for x in zip(*splits))
        self._table("merges", l=a.astype(np.int32), r=b.astype(np.int32), rank=r, safe=[x not in fronts for x in r.tolist()])
        self._table("vocab", id=np.fromiter(ranks.values(), np.int32), chars=[t.decode("latin-1") for t in ranks])

    def _table(self, name: str, **columns) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE TABLE {name} AS FROM given")
        self.db.unregister("given")

    def _rows(self, words: list[bytes]) -> pa.Table:
        raw = np.frombuffer(b"".join(words), np.uint8)
        n = np.fromiter(map(len, words), np.int64, len(words))
        return pa.table({"w": np.repeat(np.arange(len(words), dtype=np.int32), n),
                         "i": np.arange(len(raw), dtype=np.int64), "tok": self.single[raw]})

    def _contract(self, words: list[bytes], long: bool) -> list[bytes]:
        """Ids of each word, by recursion over its bytes."""
        rows, done = self._rows(words), []
        while rows.num_rows:
            self.db.register("start", rows)
            if long:
                steps = max(1, min(64, STEP_ROWS // rows.num_rows))
                got = self.db.sql(_REPEATS, params={"steps": steps}).to_arrow_table()
                done.append(got.filter(pa.compute.invert(got["open"])).drop(["open"]))
                rows = got.filter(got["open"]).drop(["open"])
            else:
                done.append(self.db.sql(_SHORT).to_arrow_table())
                rows = rows.slice(0, 0)
            self.db.unregister("start")
        got = pa.concat_tables(done) if len(done) == 1 else pa.concat_tables(done).sort_by("i")
        raw = got["tok"].to_numpy().astype("<u4").tobytes()
        at = (4 * np.searchsorted(got["w"].to_numpy(), np.arange(len(words) + 1))).tolist()
        return [raw[x:y] for x, y in zip(at, at[1:])]

    def _learn(self, words: list[str]) -> None:
        plain, long = {}, {}
        for w in words:
            raw = w.encode()
            rank = self.ranks.get(raw)
            if rank is not None:
                self.known[w] = rank.to_bytes(4, "little")
            elif len(raw) <= LONG:
                plain[w] = raw
            else:
                long[w] = raw
        for at in range(0, len(plain), WORDS):
            part = list(itertools.islice(plain.items(), at, at + WORDS))
            self.known.update(zip((w for w, _ in part), self._contract([raw for _, raw in part], False)))
        for w, raw in long.items():
            b = np.frombuffer(raw, np.uint8)
            cuts = [0, *(np.flatnonzero(~self.joined[b[:-1], b[1:]]) + 1).tolist(), len(raw)]
            pieces = [raw[x:y] for x, y in zip(cuts, cuts[1:])]
            ids = dict.fromkeys(pieces, b"")
            for form in (False, True):
                some = [x for x in ids if (len(x) > LONG) == form]
                if some:
                    ids.update(zip(some, self._contract(some, form)))
            self.known[w] = b"".join(map(ids.__getitem__, pieces))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        cut = [self.find(t) for t in texts]
        used = set().union(*cut)
        new = used.difference(self.known)
        if len(self.known) + len(new) > CACHE:
            # what came once may go; one call's own words may go beyond the bound
            kept = self.again if 2 * len(self.again) < CACHE else set()
            self.known, self.again = {w: self.known[w] for w in kept}, set()
            new = used.difference(self.known)
        self.again |= used - new
        self._learn(sorted(new))
        known = self.known.__getitem__
        return [b"".join(map(known, ws)) for ws in cut]

    def decode(self, codes: list[bytes]) -> list[bytes]:
        """The bytes of each row of ids; an id without an entry is an error."""
        ids = np.frombuffer(b"".join(codes), "<u4").astype(np.int32)
        if len(ids) == 0:
            return [b""] * len(codes)
        if not np.isin(ids, np.fromiter(self.ranks.values(), np.int32)).all():
            raise ValueError("an id is not in the vocabulary")
        n = np.fromiter((len(c) // 4 for c in codes), np.int64, len(codes))
        place = np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n)
        # long documents are several groups in a row
        new = (place % BLOCK == 0).cumsum() - 1
        self.db.register("tokens", pa.table({"piece": new, "pos": place, "tok": ids}))
        chars = self.db.sql(_DECODE).to_arrow_table()["chars"].to_pylist()
        self.db.unregister("tokens")
        out, at = [], 0
        for k in n.tolist():
            blocks = -(-k // BLOCK)
            out.append("".join(chars[at:at + blocks]).encode("latin-1"))
            at += blocks
        return out


def coder(path: str, pattern: str) -> Coder:
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = Coder(path, pattern)
    return _CODERS[path, pattern]


def _calls(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive rows of at most ``most`` in sum (a larger row by itself)."""
    first = held = 0
    for k, n in enumerate(sizes):
        if k > first and held + n > most:
            yield first, k
            first, held = k, 0
        held += n
    if first < len(sizes):
        yield first, len(sizes)


def _run(rows: DataFrame, source: str, path: str, pattern: str, code: bool, text: bool) -> DataFrame:
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for b in batches:
            given = b.column(source)
            sizes = pa.compute.binary_length(given).to_pylist()
            for x, y in _calls(sizes, CALL_CHARS):
                part = given[x:y].to_pylist()
                ids = c.encode(part) if code else part
                out = [b.column("id")[x:y], pa.array(ids, pa.binary())]
                if text:
                    out.append(pa.array(c.decode(ids), pa.binary()))
                yield pa.RecordBatch.from_arrays(out, ["id", "ids", "bytes"][:len(out)])

    return rows.mapInArrow(run, f"id {kind}, ids binary" + (", bytes binary" if text else ""))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): every text's ids as little-endian unsigned 32-bit integers."""
    return _run(_texts(docs, id_col, text_col), "text", path, pattern, True, False)


def decode(coded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(id, ids, bytes) of the rows of :func:`encode`."""
    return _run(coded.select("id", "ids"), "ids", path, pattern, False, True)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`encode`, then :func:`decode`, in one Python worker instead of two."""
    return _run(_texts(docs, id_col, text_col), "text", path, pattern, True, True)
