"""Conversation structure repair by iterative-deepening A*.

A conversation is legal if its role initials read ``(s?(ua)+)?``.  Edits take
its rows in order: K keeps a row (0), R gives it the role user or assistant (3),
D deletes it (4; required for blank and duplicate rows), I inserts an empty user
or assistant row (3); a truncated row that is not deleted adds 3.  The answer is
the cheapest list of edits, of equal ones the least in ASCII order.

Search (:func:`search`).  Depth first with the edits in ASCII order (D, I, K, R)
under a cost bound that rises to the least estimate that went beyond it; the
first accepting path is the answer.  The estimate is what the remaining rows
cost at least: forced deletions, truncated rows, roles without a place, and the
pairs of equal initials left.  A transposition table keeps for each (row, role
state) the largest rest of a bound that failed, over all bounds.

Conversations of any length.  Rows are dealt by ranges of (conversation, turn,
role, text), so one conversation may spread over many tasks, and cut into chunks
of at most ``CHUNK`` rows; a chunk is all that is searched at once.  For a
conversation of several chunks the same search first gives each chunk's cost
from every role state to every other (min-plus matrices); what the rest costs is
passed back from chunk to chunk, the chunk's search ends against it, and the role
state is passed forward.  Both passes go over a task's chunks first, then over
one value per task (:func:`scan`).  Cutting loses nothing: a chunk's edits end
with its last row (inserts before a row belong to the row's chunk), so of two
lists neither begins the other, and the least list of the whole is the least of
the first chunk followed by the least of the rest.

Equal rows of a turn are one row with a number of copies until they are written.

Defined results: rows are ordered by turn (nulls first), then role, then text;
a null role or text counts as one blank; a role that does not begin with s, u or
a (an empty one too) has no place; conversations with a null id are one
conversation; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refbank.llm.common import store

CHUNK = 32  # rows of a chunk
CHUNK_CHARS = 4_000_000  # text characters of a chunk (a longer row is a chunk of its own)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3  # fixed costs
START, SYSTEM, USER, ASSISTANT = range(4)  # role states: what was written last
#: state -> what a kept initial leads to, and where a written user/assistant row leads.
KEPT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
WRITTEN = (USER, USER, ASSISTANT, USER)
#: What it costs to end in each state (u and a are inserted).
ENDINGS = (0, 2 * INSERT, INSERT, 0)
NEVER = 1 << 60
SPACE = r"[\x20\x09-\x0D]"


# ---- search ----------------------------------------------------------------

def search(kinds: str, copies: list[int], entry: int, togo: tuple[int, ...], most: int = NEVER) -> tuple[int, int, str] | None:
    """(cost with ``togo``, state reached, edits) of a chunk, None if it costs more than ``most``.

    ``kinds`` has a sign per row: D for rows that must go (``copies`` of them),
    else the initial, x for any other, upper case for truncated rows."""
    n = len(kinds)
    least_end = min(togo)
    if least_end >= NEVER:
        return None
    # at least: forced costs of rows i.., and of pairs of equal initials among them
    rest = [least_end] * (n + 1)
    forced = pairs = 0
    cut, after = False, ""
    for i in range(n - 1, -1, -1):
        k = kinds[i]
        if k == "D":
            forced += DELETE * copies[i]
        else:
            low = k.lower()
            cut = cut or k != low
            pairs += low == after and low != "x"
            forced += (DELETE if k == "X" else REROLE) if low == "x" else TRUNCATED if k != low else 0
            after = low
        # a new role mends two pairs, a deletion or an insert one; deleting a truncated row costs one more than keeping it
        rest[i] = forced + (pairs if cut else (REROLE * pairs + 1) // 2) + least_end
    proved: dict[tuple[int, int], int] = {}  # (row, state) that failed -> what it costs at least

    def walk(i: int, state: int, left: int) -> tuple[int, str] | int:
        """The first path within ``left``, or by how much the least estimate goes beyond it."""
        over = max(rest[i] if i < n else togo[state], proved.get((i, state), 0)) - left
        if over > 0:
            return over
        if i == n:
            return state, ""
        kind = kinds[i]
        gone, low = kind == "D", kind.lower()
        stays = TRUNCATED if kind != low else 0
        moves = [("D" * copies[i], i + 1, state, DELETE * copies[i]), ("I", i, WRITTEN[state], INSERT)]
        if not gone:
            if low in KEPT[state]:
                moves.append(("K", i + 1, KEPT[state][low], KEEP + stays))
            moves.append(("R", i + 1, WRITTEN[state], REROLE + stays))
        beyond = NEVER
        for sign, at, to, cost in moves:
            got = walk(at, to, left - cost)
            if not isinstance(got, int):
                return got[0], sign + got[1]
            beyond = min(beyond, got)
        proved[i, state] = left + beyond
        return beyond

    bound = rest[0] if n else togo[entry]
    while bound <= most:
        got = walk(0, entry, bound)
        if not isinstance(got, int):
            return bound, *got
        bound += got
    return None


def costs(kinds: str, copies: list[int]) -> list[int]:
    """Cost of a chunk from every state to every state, row by row."""
    most = DELETE * sum(copies) + 4 * REROLE + TRUNCATED  # all rows but one deleted
    out = []
    for entry in range(4):
        for leave in range(4):
            # a state without its own way in is not reached at all
            dead = leave == START and entry != START or leave == SYSTEM and not (
                entry == SYSTEM or entry == START and "s" in kinds.lower())
            got = None if dead else search(kinds, copies, entry, tuple(0 if s == leave else NEVER for s in range(4)), most)
            out.append(got[0] if got else NEVER)
    return out


def render(edits: str, entry: int, rows: list[dict]) -> list[tuple[str, str]]:
    """(role, text) after a chunk's edits."""
    out, state = [], entry
    source = ((r["role"], r["text"]) for r in rows for _ in range(r["copies"]))
    for e in edits:
        if e == "I":
            state = WRITTEN[state]
            out.append(("user" if state == USER else "assistant", ""))
            continue
        role, text = next(source)
        if e == "K":
            state = KEPT[state][role[:1]]
            out.append((role, text))
        elif e == "R":
            state = WRITTEN[state]
            out.append(("user" if state == USER else "assistant", text))
    return out


# ---- chunks ----------------------------------------------------------------

def _lawful(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


_CHUNKS = ("key string, part int, seq int, kinds string, copies array<long>, first string, last string, illegal long, "
           "rows array<struct<role:string,text:string,copies:long>>")


def chunks(rows: DataFrame) -> DataFrame:
    """Chunks of the sorted rows (key, turn, role, text, copies, fault)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        me = TaskContext.get().partitionId()
        held: list[dict] = []
        key, seq, chars = None, 0, 0

        def close() -> dict:
            kinds, copies, bad, before = [], [], 0, None
            for r in held:
                initial, n = r["role"][:1], r["copies"]
                kind = initial if initial and initial in "sua" else "x"
                if r["fault"] in ("", "truncated"):
                    kinds.append(kind.upper() if r["fault"] else kind)
                    copies.append(1)
                    n -= 1
                if n:
                    kinds.append("D")
                    copies.append(n)
                bad += r["copies"] - 1 + (before is not None and not _lawful(before, initial))
                before = initial
            return {"key": key, "part": me, "seq": seq, "kinds": "".join(kinds), "copies": copies, "first": held[0]["role"][:1],
                    "last": before, "illegal": bad, "rows": [{c: r[c] for c in ("role", "text", "copies")} for r in held]}

        schema = pa.schema([("key", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("kinds", pa.string()),
                            ("copies", pa.list_(pa.int64())), ("first", pa.string()), ("last", pa.string()), ("illegal", pa.int64()),
                            ("rows", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("copies", pa.int64())])))])
        ready: list[dict] = []
        weight = 0
        for batch in batches:
            for r in batch.to_pylist():
                size = len(r["text"]) + len(r["role"])
                if held and (r["key"] != key or len(held) >= CHUNK or chars + size > CHUNK_CHARS):
                    ready.append(close())
                    weight += chars
                    seq, held, chars = seq + 1, [], 0
                key = r["key"]
                held.append(r)
                chars += size
                if weight > CHUNK_CHARS or len(ready) >= 2000:
                    yield pa.RecordBatch.from_pylist(ready, schema)
                    ready, weight = [], 0
        if held:
            ready.append(close())
        if ready:
            yield pa.RecordBatch.from_pylist(ready, schema)

    order = ["key", "turn", "role", "text"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, _CHUNKS)


def scan(items: DataFrame, start: list[int], join: Callable[[list, list], list], act: Callable[[list, list], list],
         back: bool = False) -> DataFrame:
    """(key, part, seq, value): the value every chunk of a conversation is met with.

    ``items`` has ``m`` per chunk; ``act(m, value)`` is the value after a chunk
    and ``join`` puts two chunks' ``m`` together.  Chunks of one task are
    joined first (at most a range partition's), then the tasks' own, one row each."""
    def in_order(pdf: pd.DataFrame, by: str) -> pd.DataFrame:
        return pdf.sort_values(by, ascending=not back)

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        total = None
        for m in in_order(pdf, "seq")["m"]:
            total = list(m) if total is None else join(total, list(m))
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "part": [pdf["part"].iloc[0]], "m": [total]})

    def met(pdf: pd.DataFrame, by: str, value: list) -> pd.DataFrame:
        pdf, values = in_order(pdf, by), []
        for m in pdf["m"]:
            values.append(value)
            value = act(list(m), value)
        return pdf.drop(columns=["m"]).assign(value=values)

    parts = items.groupBy("key", "part").applyInPandas(whole, "key string, part int, m array<long>")
    heads = parts.groupBy("key").applyInPandas(lambda p: met(p, "part", list(start))[["key", "part", "value"]], "key string, part int, value array<long>")
    within = items.select("key", "part", "seq", "m").join(heads, ["key", "part"])

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        return met(pdf.drop(columns=["value"]), "seq", list(pdf["value"].iloc[0]))[["key", "part", "seq", "value"]]

    return within.groupBy("key", "part").applyInPandas(inside, "key string, part int, seq int, value array<long>")


def _product(right: list[int], left: list[int]) -> list[int]:
    """Costs of ``left`` and then ``right`` (the pass runs backwards)."""
    a, b = np.array(left).reshape(4, 4), np.array(right).reshape(4, 4)
    return np.minimum((a[:, :, None] + b[None, :, :]).min(1), NEVER).ravel().tolist()


def _ahead(m: list[int], togo: list[int]) -> list[int]:
    """What is to come before a chunk; the fifth value says that nothing comes after."""
    return [*np.minimum((np.array(m).reshape(4, 4) + np.array(togo[:4])[None, :]).min(1), NEVER).tolist(), 0]


def _edits(kinds: str, copies: list[int], entry: int, togo: tuple[int, ...], last: bool) -> tuple[int, int, str] | None:
    """(own cost, state reached, edits) of a chunk; the last one ends the conversation."""
    got = search(kinds, copies, entry, togo)
    if not got:
        return None
    cost, leave, edits = got
    return (cost, leave, edits + "I" * (ENDINGS[leave] // INSERT)) if last else (cost - togo[leave], leave, edits)


def _search_long(found: DataFrame) -> DataFrame:
    """Edits of every chunk (with ``value``, what the rest costs) for every state it may be entered in."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                *togo, last = (int(v) for v in r.value)
                for entry in range(4):
                    got = _edits(r.kinds, [int(c) for c in r.copies], entry, tuple(togo), bool(last))
                    if got:
                        out.append((r.key, r.part, r.seq, entry, *got))
            yield pd.DataFrame(out, columns=["key", "part", "seq", "entry", "cost", "leave", "edits"])

    return found.select("key", "part", "seq", "kinds", "copies", "value").mapInPandas(
        run, "key string, part int, seq int, entry int, cost long, leave int, edits string")


_PIECES = ("key string, part int, seq int, cost long, edits string, illegal long, "
           "messages array<struct<role:string,text:string>>")


_PIECE = pa.schema([("key", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("cost", pa.int64()), ("edits", pa.string()),
                    ("illegal", pa.int64()), ("messages", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))])


def _rendered(found: DataFrame) -> DataFrame:
    """Repaired rows of chunks.  Chunks without edits yet are whole conversations, searched here."""
    alone = "edits" not in found.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = batch.to_pylist()
            for r in out:
                if alone:
                    r["entry"] = START
                    r["cost"], _, r["edits"] = _edits(r["kinds"], r["copies"], START, ENDINGS, True)
                r["messages"] = [{"role": a, "text": b} for a, b in render(r["edits"], r["entry"], r["rows"])]
            yield pa.RecordBatch.from_pylist([{c: r[c] for c in _PIECE.names} for r in out], _PIECE)

    more = ["kinds", "copies"] if alone else ["cost", "edits", "entry"]
    return found.select("key", "part", "seq", "illegal", "rows", *more).mapInArrow(run, _PIECES)


def faults(rows: DataFrame) -> DataFrame:
    """Rows (key, turn, role, text) as (key, turn, role, text, copies, fault):
    equal rows of a turn are one, and ``fault`` is that of its first copy (the
    others are blank or duplicates)."""
    one = rows.groupBy("key", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies")).withColumn("says", F.sha2("text", 256))
    # (role, text) at several turns of a conversation: the first of them; null turns come first
    order = F.struct(F.col("turn").isNotNull().alias("a"), F.coalesce("turn", F.lit(0)).alias("b"))
    again = (one.groupBy("key", "role", "says").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
             .where("n > 1").drop("n"))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    whole = F.col("text").rlike(rf"[.!?]{SPACE}*\z")
    return (one.join(again, ["key", "role", "says"], "left")
            .withColumn("fault", F.when(blank, "blank").when(order != F.col("first"), "duplicate").when(~whole, "truncated").otherwise(""))
            .select("key", "turn", "role", "text", "copies", "fault"))


def key(conv: Column) -> Column:
    """A text that stands for a conversation id, null too."""
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))


class Repaired:
    """Results of :func:`repair`: ``conversations`` (key, gaps, blank, duplicate,
    truncated, illegal, cost, audit), ``messages`` (key, part, seq, messages: the
    repaired rows of every chunk, in order of part and seq) and ``digests``."""

    def __init__(self, conversations: DataFrame, single: DataFrame, several: DataFrame):
        self.conversations, self._single, self._several = conversations, single, several

    @property
    def messages(self) -> DataFrame:
        return self._single.unionByName(self._several).select("key", "part", "seq", "messages")

    @property
    def digests(self) -> DataFrame:
        """(key, sha256) of the ``role:text`` rows joined by a newline.  A digest
        reads its conversation from end to end; chunks pass through it one by one."""
        joined = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, sha, begun = None, None, False
            for batch in batches:
                done = []
                for k, empty, body in zip(*(batch.column(c).to_pylist() for c in ("key", "empty", "body"))):
                    if k != key:
                        if sha is not None:
                            done.append((key, sha.hexdigest()))
                        key, sha, begun = k, hashlib.sha256(), False
                    if not empty:
                        sha.update((b"\n" if begun else b"") + body.encode())
                        begun = True
                yield pa.RecordBatch.from_pylist([{"key": a, "sha256": b} for a, b in done], pa.schema([("key", pa.string()), ("sha256", pa.string())]))
            if sha is not None:
                yield pa.RecordBatch.from_pylist([{"key": key, "sha256": sha.hexdigest()}])

        one = self._single.select("key", F.sha2(joined, 256).alias("sha256"))
        more = (self._several.select("key", "part", "seq", (F.size("messages") == 0).alias("empty"), joined.alias("body"))
                .repartition("key").sortWithinPartitions("key", "part", "seq").select("key", "empty", "body")
                .mapInArrow(run, "key string, sha256 string"))
        return one.unionByName(more)


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Repaired:
    """Repair every conversation of ``rows``."""
    blank = F.lit(" ")
    rows = rows.select(key(F.col(conv_col)).alias("key"), F.col(turn_col).cast("long").alias("turn"),
                       F.coalesce(F.col(role_col).cast("string"), blank).alias("role"), F.coalesce(F.col(text_col).cast("string"), blank).alias("text"))
    known = store(faults(rows), "conversation-rows")
    cut = store(chunks(known), "conversation-chunks")
    long = cut.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    single = store(_rendered(cut.join(long, "key", "left_anti")), "repaired-single")
    several = store(_several(store(cut.join(long, "key", "left_semi"), "long-chunks")), "repaired-several")

    counts = known.groupBy("key").agg(
        F.min("turn").alias("low"), F.max("turn").alias("high"),
        F.sum(F.when(F.col("fault") == "blank", F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("fault") == "duplicate", F.col("copies")).when(F.col("fault") != "blank", F.col("copies") - 1).otherwise(0)).alias("duplicate"),
        F.sum((F.col("fault") == "truncated").cast("long")).alias("truncated"))
    turns = known.where("turn IS NOT NULL").select("key", "turn").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("turns"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("part", "seq", "edits"))), lambda e: e["edits"])
    found = single.select("key", "illegal", "cost", F.col("edits").alias("audit")).unionByName(several.groupBy("key").agg(
        F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), F.array_join(ordered, "").alias("audit")))
    out = (counts.join(turns, "key", "left").join(found, "key")
           .withColumn("gaps", F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("long"))
           .select("key", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"))
    return Repaired(out, single, several)


def _several(found: DataFrame) -> DataFrame:
    """Repaired chunks of the conversations that have more than one."""

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[["key", "part", "seq"]].assign(m=[costs(k, c.tolist()) for k, c in zip(pdf["kinds"], pdf["copies"])])

    small = found.select("key", "part", "seq", "kinds", "copies", "first", "last", "illegal")
    m = store(small.select("key", "part", "seq", "kinds", "copies").mapInPandas(matrices, "key string, part int, seq int, m array<long>"), "chunk-costs")
    togo = store(scan(m, [*ENDINGS, 1], _product, _ahead, back=True), "chunk-togo")
    edits = store(_search_long(small.join(togo, ["key", "part", "seq"])), "chunk-edits")
    # where each entry leads, and the last role: passed forward
    leads = [F.coalesce(F.max(F.when(F.col("entry") == s, F.col("leave"))), F.lit(-1)).cast("long") for s in range(4)]
    initials = F.create_map(*[F.lit(x) for p in (("s", 0), ("u", 1), ("a", 2)) for x in p])
    code = lambda c: F.coalesce(initials[F.col(c)], F.lit(3)).cast("long")
    ways = (edits.groupBy("key", "part", "seq").agg(F.array(*leads).alias("to")).join(small, ["key", "part", "seq"])
            .select("key", "part", "seq", F.concat("to", F.array(code("last"))).alias("m")))
    # value: the state the chunk is entered in and the initial before it (-1: none)
    entered = scan(ways, [START, -1], lambda a, b: [*(b[x] if x >= 0 else -1 for x in a[:4]), b[4]], lambda m, v: [m[v[0]], m[4]])
    entered = entered.select("key", "part", "seq", F.col("value")[0].cast("int").alias("entry"), F.col("value")[1].alias("before"))
    chosen = edits.join(entered, ["key", "part", "seq", "entry"]).select("key", "part", "seq", "entry", "before", "cost", "edits")
    lawful = F.concat(F.col("before"), F.lit("-"), code("first")).isin("0-1", "1-2", "2-1")
    both = found.join(chosen, ["key", "part", "seq"])
    both = both.withColumn("illegal", F.col("illegal") + F.when((F.col("before") >= 0) & ~lawful, 1).otherwise(0))
    return _rendered(both)
