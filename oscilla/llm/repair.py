"""Repair of conversation structure by a weighted automaton that is made deterministic as it is needed.

A conversation is a row of symbols: the initial of each role with the row's fault. Edits turn it into one whose initials are
`(s?(ua)+)?`; each edit has a cost. What the cheapest edits cost to come into each of the automaton's four states is a vector;
less its least entry it is one of a few hundred, so vectors are states of a deterministic automaton, whose transitions are
computed when first met and then looked up in a table: the costs of a conversation are one scan of it. Entries that no
cheapest edits can use are struck out, which bounds the number of vectors. Backwards, arcs that keep the cost (tight ones)
are followed from the end; of each state it is kept how its least continuation ranks among those of the others, again by a
table, so that of equal costs the edits come out whose initials are ASCII-least.

Rows are dealt by ranges of (conversation, order), so that even one conversation with a third of all rows is spread over
tasks, and streamed. A conversation that lies inside one task and one chunk is done there. Of all others chunks of bounded
size are written; duplicates are found among digests by an exchange of their own, symbols (one byte a row) come together in
one task a conversation, as its audit (one letter a row, in one cell) does, edits go back to the chunks, and the repaired
text of a conversation passes once, chunk by chunk, through the hash, which no method can split.

Defined results: null roles and texts are one space; a null conversation is a conversation; rows with null turns come first;
rows with one turn are ordered by role, then by the first TIE characters and then by the digest of their text; equal rows
stand side by side, the later ones as duplicates; an empty or blank text must go, and with it a text of any length that came
before with the same role; an empty role has no initial; an empty table has no conversations; extra columns are ignored."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SQL_CRC_TABLE, cut, read, shared_table, sql_crc

WHITE, ENDS = " \t\n\v\f\r", ".!?"
#: What edits cost, and what an undeleted truncated row adds.
RETAG, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States: nothing yet, system, user, assistant. The only role that may come next by an edit, and the state after it.
FOLLOWS = ((2, "user"), (2, "user"), (3, "assistant"), (2, "user"))
FINAL = (0, 3)
INITIALS = "sua"
LEGAL = {(0, 1), (1, 2), (2, 1)}
SOUND, BLANK, DUPLICATE, CUT = range(4)
NEVER = 1 << 40
#: Rows and characters of a chunk, and characters of a text that rows with one turn are ordered by.
CHUNK_ROWS, CHUNK_CHARS, TIE = 4096, 1 << 20, 64
FACTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def symbol(role: str, fault: int) -> int:
    """Initial and fault as one number below 16."""
    found = INITIALS.find(role[:1]) if role else -1
    return (found if found >= 0 else 3) + 4 * fault


def fault_of(text: str) -> int:
    """What a text shows by itself."""
    bare = text.rstrip(WHITE)
    return BLANK if not bare else SOUND if bare[-1] in ENDS else CUT


def _kept(state: int, initial: int) -> int | None:
    """The state after a row that stays as it is."""
    if state == 0 and initial == 0:
        return 1
    return FOLLOWS[state][0] if INITIALS[initial : initial + 1] == FOLLOWS[state][1][0] else None


class Automaton:
    """Vectors of costs as states, and tables of what has been met."""

    def __init__(self) -> None:
        self.vectors: list[tuple[int, ...]] = []
        self.known: dict[tuple[int, ...], int] = {}
        self.steps: list[list[tuple[int, int] | None]] = []
        self.arcs: dict[tuple[int, int], list[tuple[int, str, int]]] = {}
        self.back: dict[tuple, tuple] = {}
        self.start = self._state([0, NEVER, NEVER, NEVER])[0]

    def _state(self, costs: list[int]) -> tuple[int, int]:
        """The state of a vector once insertions are taken, and what was taken from all its entries."""
        for _ in FOLLOWS:
            for q, (after, _role) in enumerate(FOLLOWS):
                costs[after] = min(costs[after], costs[q] + INSERT)
        # From the state `assistant` all goes on as from `system`, and as from `nothing` if one system row is deleted.
        if costs[1] > costs[3]:
            costs[1] = NEVER
        if costs[0] > costs[3] + DELETE:
            costs[0] = NEVER
        least = min(costs)
        vector = tuple(min(NEVER, c - least) if c < NEVER else NEVER for c in costs)
        if vector not in self.known:
            self.known[vector] = len(self.vectors)
            self.vectors.append(vector)
            self.steps.append([None] * 16)
        return self.known[vector], least

    def _edits(self, state: int, sign: int) -> list[tuple[int, str, int, int]]:
        """(from, letter, to, cost) of all arcs that take one row."""
        out, (fault, initial) = [], divmod(sign, 4)
        for q, cost in enumerate(self.vectors[state]):
            if cost < NEVER:
                out.append((q, "D", q, DELETE))
                if fault in (SOUND, CUT):
                    more = TRUNCATED if fault == CUT else 0
                    out.append((q, "R", FOLLOWS[q][0], RETAG + more))
                    kept = _kept(q, initial)
                    if kept is not None:
                        out.append((q, "K", kept, more))
        return out

    def step(self, state: int, sign: int) -> tuple[int, int]:
        """The next state, and the cost that is common to all its entries."""
        found = self.steps[state][sign]
        if found is None:
            costs, edits = [NEVER] * 4, self._edits(state, sign)
            for q, _, after, cost in edits:
                costs[after] = min(costs[after], self.vectors[state][q] + cost)
            found = self.steps[state][sign] = self._state(costs)
            after_costs = self.vectors[found[0]]
            self.arcs[state, sign] = [(q, letter, after) for q, letter, after, cost in edits if self.vectors[state][q] + cost == after_costs[after] + found[1]]
        return found

    def scan(self, signs: bytes) -> tuple[int, list[int]]:
        """The cost of the cheapest edits, and the state before each row and at the end."""
        steps, state, total, path = self.steps, self.start, 0, [self.start]
        for sign in signs:
            found = steps[state][sign] or self.step(state, sign)
            state, total = found[0], total + found[1]
            path.append(state)
        return total + min(self.vectors[state][q] for q in FINAL), path

    def _layer(self, state: int, direct: list[tuple[str, int, int] | None]) -> tuple:
        """Ranks of the states' least continuations, and these: letters up to the row's own, and the state after it; tight insertions are taken before the row."""
        costs, best = self.vectors[state], list(direct)
        for _ in range(2):
            for q, (after, _role) in enumerate(FOLLOWS):
                if best[after] is not None and costs[q] < NEVER and costs[q] + INSERT == costs[after]:
                    letters, rank, target = best[after]
                    here = ("I" + letters, rank, target)
                    best[q] = here if best[q] is None else min(best[q], here)
        order = sorted({b[:2] for b in best if b is not None})
        return tuple(-1 if b is None else order.index(b[:2]) for b in best), tuple(None if b is None else (b[0], b[2]) for b in best)

    def trace(self, signs: bytes, path: list[int]) -> list[str]:
        """The ASCII-least cheapest edits: for each row insertions and its own letter, and last the insertions at the end."""
        last = self.vectors[path[-1]]
        least = min(last[q] for q in FINAL)
        ranks, choice = self._layer(path[-1], [("", 0, q) if q in FINAL and last[q] == least else None for q in range(4)])
        choices = [choice]
        for k in range(len(signs) - 1, -1, -1):
            key = (path[k], signs[k], ranks)
            found = self.back.get(key)
            if found is None:
                direct: list[tuple[str, int, int] | None] = [None] * 4
                for q, letter, after in self.arcs[path[k], signs[k]]:
                    if ranks[after] >= 0:
                        here = (letter, ranks[after], after)
                        direct[q] = here if direct[q] is None else min(direct[q], here)
                found = self.back[key] = self._layer(path[k], direct)
            ranks, choice = found
            choices.append(choice)
        out, q = [], 0
        for choice in reversed(choices):
            letters, q = choice[q]
            out.append(letters)
        return out


@functools.lru_cache(maxsize=1)
def automaton() -> Automaton:
    """The tables of this Python worker."""
    return Automaton()


def repaired(rows: list[tuple[str, str]], edits: list[str], state: int = 0) -> tuple[list[str], int]:
    """The lines `role:text` that edits leave, one entry of edits for each row and perhaps one for the end; and the state after them."""
    lines = []
    for k, letters in enumerate(edits):
        for letter in letters:
            after, role = FOLLOWS[state]
            if letter == "D":
                continue
            if letter == "K":
                role = rows[k][0]
                after = _kept(state, symbol(role, SOUND) % 4)
            lines.append(f"{role}:{'' if letter == 'I' else rows[k][1]}")
            state = after
    return lines, state


def counted(signs: bytes) -> tuple[int, int, int, int]:
    """Blank, duplicate, truncated and illegal rows."""
    faults = [s >> 2 for s in signs]
    initials = [s & 3 for s in signs]
    return faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT), sum(pair not in LEGAL for pair in zip(initials[:-1], initials[1:], strict=True))


class _Turns:
    """Least, largest and number of turns that are not null, in rising order."""

    def __init__(self, low: int | None = None, high: int | None = None, n: int = 0) -> None:
        self.low, self.high, self.n = low, high, n

    def add(self, low: int | None, high: int | None, n: int) -> None:
        if n:
            self.n += n - (low == self.high)
            self.low, self.high = low if self.low is None else self.low, high

    @property
    def gaps(self) -> int:
        return self.high - self.low + 1 - self.n if self.n else 0


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
CHUNK = "name string, chunk long, signs binary, keys array<binary>, low long, high long, turns int, roles array<string>, texts array<string>"


def _schema() -> pa.Schema:
    kinds = [("conv_id", pa.int64()), *((c, pa.int64()) for c in FACTS), ("audit", pa.string()), ("repaired_sha256", pa.string())]
    kinds += [("name", pa.string()), ("chunk", pa.int64()), ("signs", pa.binary()), ("keys", pa.list_(pa.binary())), ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int32()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))]
    return pa.schema(kinds)


class _Open:
    """Rows of one conversation that have come so far."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.chars = conv_id, 0
        self.rows: list[tuple[str, str]] = []
        self.turns = _Turns()

    def add(self, turn: int | None, role: str, text: str, copies: int) -> None:
        if copies:
            self.rows += [(role, text)] * copies
            self.chars += len(role) + len(text)
            self.turns.add(turn, turn, int(turn is not None))

    def chunk(self, number: int) -> dict:
        faults = [fault_of(t) for _, t in self.rows]
        keys = [None if f == BLANK else hashlib.sha256(f"{len(r)}:{r}{t}".encode()).digest() for f, (r, t) in zip(faults, self.rows, strict=True)]
        signs = bytes(symbol(r, f) for f, (r, _) in zip(faults, self.rows, strict=True))
        own = {"name": "" if self.conv_id is None else f"={self.conv_id}", "chunk": number, "low": self.turns.low, "high": self.turns.high, "turns": self.turns.n}
        return own | {"conv_id": self.conv_id, "signs": signs, "keys": keys, "roles": [r for r, _ in self.rows], "texts": [t for _, t in self.rows]}

    def result(self) -> dict:
        seen, signs = set(), bytearray()
        for row in self.rows:
            fault = fault_of(row[1])
            signs.append(symbol(row[0], DUPLICATE if fault != BLANK and row in seen else fault))
            seen.add(row)
        cost, edits = solved(bytes(signs))
        lines, _ = repaired(self.rows, edits)
        facts = (self.turns.gaps, *counted(bytes(signs)), cost)
        return {"conv_id": self.conv_id, "audit": "".join(edits), "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()} | dict(zip(FACTS, facts, strict=True))


def solved(signs: bytes) -> tuple[int, list[str]]:
    """Cost and edits of a conversation's symbols."""
    own = automaton()
    cost, path = own.scan(signs)
    return cost, own.trace(signs, path)


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of conversations that lie inside this task and one chunk; chunks of the others."""
    from pyspark import TaskContext

    task, number, out, schema = TaskContext.get().partitionId(), 0, [], _schema()
    own: _Open | None = None
    edge = True  # the conversation may go on in another task, or has chunks already

    def flushed() -> None:
        nonlocal number
        out.append(own.chunk(task << 32 | number))
        number += 1

    for batch in batches:
        for conv_id, turn, role, text, copies in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies")), strict=True):
            if own is None:
                own = _Open(conv_id)
            elif conv_id != own.conv_id:
                if edge:
                    flushed()
                else:
                    out.append(own.result())
                own, edge = _Open(conv_id), False
            elif len(own.rows) >= CHUNK_ROWS or own.chars >= CHUNK_CHARS:
                flushed()
                own, edge = _Open(conv_id), True
            own.add(turn, role, text, copies)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if own is not None:
        flushed()
        yield pa.RecordBatch.from_pylist(out, schema)


def _solve_chunks(table: pa.Table) -> pa.Table:
    """One conversation's symbols, chunk by chunk: its facts, and for each chunk its edits and the state before them."""
    parts, turns, signs = table.sort_by("chunk").to_pylist(), _Turns(), bytearray()
    for part in parts:
        own = bytearray(part["signs"])
        for k in part["again"] or []:
            own[k] = own[k] & 3 | DUPLICATE << 2
        signs += own
        turns.add(part["low"], part["high"], part["turns"])
    cost, edits = solved(bytes(signs))
    facts = dict(zip(FACTS, (turns.gaps, *counted(bytes(signs)), cost), strict=True)) | {"audit": "".join(edits)}
    out, at, state = [], 0, 0
    for k, part in enumerate(parts):
        last = len(edits) if k == len(parts) - 1 else at + len(part["signs"])
        own = edits[at:last]
        out.append({"name": part["name"], "chunk": part["chunk"], "edits": own, "state": state} | (facts if k == 0 else {}))
        state, at = _after(state, signs[at:last], own), last
    return pa.Table.from_pylist(out, pa.schema([("name", pa.string()), ("chunk", pa.int64()), ("edits", pa.list_(pa.string())), ("state", pa.int32()), *((c, pa.int64()) for c in FACTS), ("audit", pa.string())]))


def _after(state: int, signs: bytes, edits: list[str]) -> int:
    for k, letters in enumerate(edits):
        for letter in letters:
            if letter != "D":
                state = _kept(state, signs[k] & 3) if letter == "K" else FOLLOWS[state][0]
    return state


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repaired lines of each chunk, joined; null if none is left."""
    for batch in batches:
        for row in batch.to_pylist():
            lines, _ = repaired(list(zip(row["roles"], row["texts"], strict=True)), row["edits"], row["state"])
            yield pa.RecordBatch.from_pylist([{"name": row["name"], "chunk": row["chunk"], "lines": "\n".join(lines) if lines else None}], pa.schema([("name", pa.string()), ("chunk", pa.int64()), ("lines", pa.string())]))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each conversation's lines; chunks come in order."""
    name, digest, begun = None, None, False
    for batch in batches:
        out = []
        for own, lines in zip(batch.column("name").to_pylist(), batch.column("lines"), strict=True):
            if own != name:
                if name is not None:
                    out.append((name, digest.hexdigest()))
                name, digest, begun = own, hashlib.sha256(), False
            if lines.is_valid:
                digest.update(b"\n" * begun)
                digest.update(lines.as_buffer())
                begun = True
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["name", "repaired_sha256"])
    if name is not None:
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([digest.hexdigest()])], names=["name", "repaired_sha256"])


def repair(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: Column | None = None) -> DataFrame:
    """Facts, cost, audit and digest of the repaired text of each conversation. `copies` says how often a row stands there; with 0 it only makes its conversation known."""
    spark = df.sparkSession
    rows = df.select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"), (F.lit(1) if copies is None else copies).cast("int").alias("copies"),
    )
    rows = rows.withColumn("head", F.substring("text", 1, TIE)).withColumn("tail", F.sha2(F.col("text").cast("binary"), 256)).withColumn("row", F.monotonically_increasing_id())
    by = ["conv_id", "turn", "role", "head", "tail", "row"]
    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    made = shared_table(spark, ordered.select("conv_id", "turn", "role", "text", "copies").mapInArrow(_streamed, f"{RESULT}, {CHUNK}"), "turns")
    done, chunks = made.where("chunk is null").select(*(c.split()[0] for c in RESULT.split(", "))), made.where("chunk is not null")

    keys = chunks.select("name", "chunk", F.posexplode("keys").alias("place", "key")).where("key is not null")
    here = F.struct("chunk", "place")
    firsts = cut(keys.groupBy("name", "key").agg(F.min(here).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    again = keys.join(firsts, ["name", "key"]).where(here != F.col("first")).groupBy("chunk").agg(F.collect_list("place").alias("again"))
    narrow = chunks.select("name", "chunk", "signs", "low", "high", "turns").join(again, "chunk", "left")
    facts = ", ".join(f"{c} long" for c in FACTS)
    solved_ = cut(narrow.groupBy("name").applyInArrow(_solve_chunks, f"name string, chunk long, edits array<string>, state int, {facts}, audit string"))
    lines = chunks.select("chunk", "name", "roles", "texts").join(solved_.select("chunk", "edits", "state"), "chunk").mapInArrow(_lines, "name string, chunk long, lines string")
    digests = lines.repartition("name").sortWithinPartitions("name", "chunk").mapInArrow(_hashed, "name string, repaired_sha256 string")
    known = F.when(F.col("name") != "", F.substring("name", 2, 20).cast("long")).alias("conv_id")
    rest = solved_.where("audit is not null").join(digests, "name").select(known, *FACTS, "audit", "repaired_sha256")
    return done.unionByName(rest)


def damage(df: DataFrame) -> tuple[DataFrame, Column]:
    """Rows with planted faults, by a checksum of conversation and turn, and how often each stands there."""
    blank = F.lit(" ")
    part = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank)).cast("binary")) % 20
    text, role = F.coalesce(F.col("text").cast("string"), blank), F.coalesce(F.col("role").cast("string"), blank)
    text = F.when(part <= 1, F.lit("")).when(part == 2, F.translate(text, ENDS, "")).otherwise(text)
    made = df.select("conv_id", "turn", F.when(part == 4, F.lit("user")).otherwise(role).alias("role"), text.alias("text"), F.when(part == 0, 0).when(part == 3, 2).otherwise(1).alias("copies"))
    return made, F.col("copies")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired."""
    rows, copies = damage(read(spark, sf_dir, "conversations"))
    return repair(rows, copies=copies)


def _oracle() -> str:
    """The least (cost, letters) from each state to the end, row by row from the last, by recursion."""
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

    def made(letter: str, cost: str, line: str | None, rest: str) -> str:
        return f"{{'c': {cost} + {rest}.c, 'a': '{letter}' || {rest}.a, 't': " + (f"[{line}] || {rest}.t}}" if line else f"{rest}.t}}")

    def least(*options: str) -> str:
        return f"list_sort(list_filter([{', '.join(options)}], lambda o: o IS NOT NULL))[1]"

    columns = []
    for q, (after, role) in enumerate(FOLLOWS):
        kept = [f"initial = '{role[0]}'"], [f"g{after}"]
        if q == 0:
            kept[0].append("initial = 's'"), kept[1].append("g1")
        keeps = [f"CASE WHEN NOT gone AND {when} THEN {made('K', '5 * cut', 'line', to)} END" for when, to in zip(*kept, strict=True)]
        columns.append(f"{least(made('D', '2', None, f'g{q}'), 'CASE WHEN NOT gone THEN ' + made('R', '1 + 5 * cut', f'{chr(39)}{role}:{chr(39)} || text', f'g{after}') + ' END', *keeps)} AS h{q}")
    inserted = [least(f"h{q}", made("I", "5", f"'{role}:'", f"h{after}"), *([f"{{'c': 10 + h3.c, 'a': 'II' || h3.a, 't': ['user:', 'assistant:'] || h3.t}}"] if q < 2 else [])) + f" AS g{q}" for q, (after, role) in enumerate(FOLLOWS)]
    end = "{'c': 0, 'a': '', 't': []::VARCHAR[]} AS g0, {'c': 10, 'a': 'II', 't': ['user:', 'assistant:']} AS g1, {'c': 5, 'a': 'I', 't': ['assistant:']} AS g2, {'c': 0, 'a': '', 't': []::VARCHAR[]} AS g3"
    part = sql_crc("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")
    return f"""
WITH RECURSIVE {SQL_CRC_TABLE}, p AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {part} % 20 AS part FROM conversations, t
), d AS (SELECT conv_id, turn, CASE WHEN part = 4 THEN 'user' ELSE role END AS role, CASE WHEN part = 1 THEN '' WHEN part = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN part = 3 THEN 2 ELSE 1 END)) AS copy FROM p WHERE part <> 0
), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, count(*) OVER (PARTITION BY conv_id) AS m, rtrim(text, {white}) AS bare, role[1] AS initial FROM d
), f AS (SELECT *, bare = '' AS blank, bare <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
  coalesce(lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au'), false) AS illegal FROM n
), r AS (SELECT *, blank OR again AS gone, (NOT blank AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?'))::INT AS cut, role || ':' || text AS line FROM f
), facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank::INT) AS blank, sum(again::INT) AS duplicate, sum(cut) AS truncated, sum(illegal::INT) AS illegal FROM r GROUP BY conv_id
), g AS (SELECT conv_id, m AS i, {end} FROM r WHERE i = 1
  UNION ALL SELECT conv_id, i, {', '.join(inserted)} FROM (SELECT r.conv_id, r.i - 1 AS i, {', '.join(columns)} FROM g JOIN r ON r.conv_id IS NOT DISTINCT FROM g.conv_id AND r.i = g.i)
), best AS (SELECT conv_id, g0 FROM g WHERE i = 0
), c AS (SELECT DISTINCT conv_id FROM conversations)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(g0.c, 0)::BIGINT AS cost, coalesce(g0.a, '') AS audit, sha256(coalesce(array_to_string(g0.t, chr(10)), '')) AS repaired_sha256
FROM c LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id
"""


ORACLE = _oracle()
