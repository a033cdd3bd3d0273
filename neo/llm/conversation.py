"""Conversation structure repair by rank-convergence parallel Viterbi.

The cheapest edits that turn a conversation's roles into ``(s?(ua)+)?`` are a shortest path over
its rows with four states: nothing yet, after the system row, after a user, after an assistant.
A cost vector holds what each state still has to pay from a place to the end.

1. The rows are dealt by range of (conversation, turn), so that a conversation of any size is
   spread over tasks, and sorted.  A task cuts them into blocks.  A conversation that lies
   inside one block is finished at once (``whole``); its texts go no further.
2. For the others every block runs backward from a speculative vector, that of the end of a
   conversation.  Fix-up passes hand each block the vector that its successor really begins
   with and rerun it from its last row until the vector differs from the old one by a constant
   only; the rest of the block then stands.  Passes repeat until no block's end changes.
3. Stitched backward costs: with them a block's exit state for each state that may enter it
   is known, a scan over these four-byte maps gives every block its entering state, and each
   block traces its edits and writes its repaired rows alone.
4. Only the hash of a conversation's repaired text is sequential by nature: one task streams
   the blocks of a conversation in order, holding one batch at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from neo.llm.common import arrow_schema, land

#: Costs of the edits; an undeleted truncated row costs ``PATCH`` more (fixed by the contract).
DELETE, INSERT, REROLE, PATCH = 4, 3, 3, 3

#: A block ends after so many rows or so many characters of text.
BLOCK_ROWS, BLOCK_CHARS = 4_096, 1 << 20

_BLANKS = " \t\n\v\f\r"
_INITIAL = {"s": 1, "u": 2, "a": 3}
_PAIRS = {(1, 2), (2, 3), (3, 2)}
_BLANK, _DUPLICATE, _TRUNCATED = 1, 2, 3

#: States: nothing yet, after system, after user, after assistant; what follows each at the end.
_END = (0, 2 * INSERT, INSERT, 0)
_LAST_EDITS = ("", "II", "I", "")

SUMMARY = ("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
           "repaired_sha256 string")


def code(role: str, text: str) -> int:
    """Role and first fault of a row but for duplicates: ``initial + 4 * fault``."""
    shown = text.rstrip(_BLANKS)
    fault = _BLANK if not shown else _TRUNCATED if shown[-1] not in ".!?" else 0
    return _INITIAL.get(role[:1], 0) + 4 * fault


def _next_state(state: int) -> int:
    """The state after a user or assistant row that fits."""
    return 3 if state == 2 else 2


@cache
def _options(row: int, after: tuple, state: int) -> tuple:
    """``letter, cost, state`` of the edits of a row whose end has the costs ``after``."""
    initial, fault = row % 4, row // 4
    out = [("D", DELETE + after[state], state)]
    if fault not in (_BLANK, _DUPLICATE):
        extra, fit = PATCH if fault == _TRUNCATED else 0, _next_state(state)
        if initial == fit or (initial == 1 and state == 0):
            out.append(("K", extra + after[initial], initial))
        out.append(("R", extra + REROLE + after[fit], fit))
    return tuple(out)


@cache
def _before(row: int, after: tuple) -> tuple:
    """Costs of the four states before a row, its insertions included."""
    none, system, user, bot = (min(o[1] for o in _options(row, after, q)) for q in range(4))
    user, bot = min(user, INSERT + bot), min(bot, INSERT + user)
    return min(none, INSERT + user), min(system, INSERT + user), user, bot


@cache
def step(row: int, after: tuple) -> tuple[tuple, int]:
    """Costs before a row, less their least, and that least."""
    costs = _before(row, after)
    least = min(costs)
    return tuple(c - least for c in costs), least


@cache
def edits(row: int, after: tuple, state: int) -> tuple[str, int]:
    """The ASCII-least cheapest edits of a row, insertions before it included, and the state behind it."""
    costs, letters = _before(row, after), ""
    while True:
        options = {o[0]: o for o in _options(row, after, state)}
        for letter in "DIKR":
            if letter == "I":
                if INSERT + costs[_next_state(state)] == costs[state]:
                    letters, state = letters + "I", _next_state(state)
                    break
            elif letter in options and options[letter][1] == costs[state]:
                return letters + letter, options[letter][2]


def backward(codes: bytes, end: tuple) -> tuple[list[tuple], tuple, int]:
    """Costs behind each row, costs before the first, and the constant taken out of them."""
    behind, gain = [end] * len(codes), 0
    for i in range(len(codes) - 1, -1, -1):
        behind[i] = end
        end, least = step(codes[i], end)
        gain += least
    return behind, end, gain


def fix_up(codes: bytes, behind: list[tuple], start: tuple, gain: int, end: tuple) -> tuple[list[tuple], tuple, int]:
    """``backward`` from another end, rerun until the costs differ by a constant only."""
    behind = list(behind)
    for i in range(len(codes) - 1, -1, -1):
        if behind[i] == end:
            return behind, start, gain
        gain -= step(codes[i], behind[i])[1]
        behind[i] = end
        end, least = step(codes[i], end)
        gain += least
    return behind, end, gain


def trace(codes: bytes, behind: list[tuple], state: int) -> tuple[list[str], int]:
    """Edits of each row and the state behind the last."""
    out = []
    for row, after in zip(codes, behind):
        letters, state = edits(row, after, state)
        out.append(letters)
    return out, state


def apply(letters: list[str], roles: list[str], texts: list[str], state: int, last: bool) -> list[tuple[str, str]]:
    """The repaired rows ``role, text`` of a block that is entered in a state."""
    out, names = [], (None, None, "user", "assistant")
    for edit, role, text in zip([*letters, *([_LAST_EDITS[state]] if last and not letters else [])],
                                [*roles, ""], [*texts, ""]):
        for letter in edit:
            if letter == "D":
                continue
            if letter == "K":
                out.append((role, text))
                state = _INITIAL[role[:1]]
            else:
                state = _next_state(state)
                out.append((names[state], text if letter == "R" else ""))
    if last and letters:
        for _ in _LAST_EDITS[state]:
            state = _next_state(state)
            out.append((names[state], ""))
    return out


def _joined(rows: list[tuple[str, str]]) -> str:
    return "\n".join(f"{role}:{text}" for role, text in rows)


def _illegal(codes: bytes) -> int:
    return sum((a % 4, b % 4) not in _PAIRS for a, b in zip(codes, codes[1:]))


class _Block:
    """Rows of one conversation that lie side by side in a task."""

    def __init__(self, conv, first: bool, seen: set):
        self.conv, self.first, self.seen = conv, first, seen
        self.roles, self.texts, self.codes = [], [], bytearray()
        self.places, self.digests = [], []
        self.low = self.high = None
        self.n_turns = self.chars = 0

    def add(self, turn, role: str, text: str) -> None:
        if turn is not None:
            self.n_turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        row = code(role, text)
        if row // 4 != _BLANK:
            digest = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
            if digest in self.seen:
                row = row % 4 + 4 * _DUPLICATE
            else:
                self.seen.add(digest)
                self.places.append(len(self.codes))
                self.digests.append(digest)
        self.codes.append(row)
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(text)

    def full(self, most: int) -> bool:
        return len(self.codes) >= most or self.chars >= BLOCK_CHARS

    def summary(self) -> dict:
        """The result of a conversation that is this block."""
        codes = bytes(self.codes)
        behind, start, gain = backward(codes, _END)
        letters, state = trace(codes, behind, 0)
        rows = apply(letters, self.roles, self.texts, 0, True)
        faults = [c // 4 for c in codes]
        return {"gaps": self.high - self.low + 1 - self.n_turns if self.n_turns else 0, "blank": faults.count(_BLANK),
                "duplicate": faults.count(_DUPLICATE), "truncated": faults.count(_TRUNCATED), "illegal": _illegal(codes),
                "cost": start[0] + gain, "audit": "".join(letters) + _LAST_EDITS[state],
                "repaired_sha256": hashlib.sha256(_joined(rows).encode()).hexdigest(),
                "turns": [{"role": r, "text": t} for r, t in rows]}

    def row(self, whole: bool, with_turns: bool) -> dict:
        out = {"conv": self.conv, "whole": whole}
        if whole:
            out |= self.summary()
            if not with_turns:
                del out["turns"]
            return out
        return out | {"roles": self.roles, "texts": self.texts, "codes": bytes(self.codes), "places": self.places,
                      "digests": self.digests, "low": self.low, "high": self.high, "n_turns": self.n_turns}


def _blocks(batches: Iterator[pa.RecordBatch], with_turns: bool, most: int, schema: pa.Schema):
    """Blocks of sorted rows ``conv, gone, turn, role, text``."""
    block, out, size, first = None, [], 0, True

    def packed() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(out, schema=schema)

    for batch in batches:
        for conv, gone, turn, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if block is None or block.conv != conv:
                if block is not None:  # neither the first nor the last of the task: it ends here
                    out.append(block.row(block.first and not first, with_turns))
                    size += block.chars
                    first = False
                block = _Block(conv, True, set())
            elif block.full(most):
                out.append(block.row(False, with_turns))
                size += block.chars
                block = _Block(conv, False, block.seen)
            if not gone:
                block.add(turn, role, text)
            if size > BLOCK_CHARS or len(out) >= most:
                yield packed()
                out, size = [], 0
    if block is not None:
        out.append(block.row(False, with_turns))
        yield packed()


def _vector(raw: bytes) -> tuple:
    return tuple(raw)


def _pass(batches: Iterator[pa.RecordBatch], schema: pa.Schema):
    """Backward costs of blocks ``conv, block, codes, dups, costs, start, gain, end``.

    ``dups`` are places of rows seen in an earlier block; without ``costs`` the end is
    speculative."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            codes = bytearray(r["codes"])
            for i in r["dups"] or ():
                codes[i] = codes[i] % 4 + 4 * _DUPLICATE
            codes = bytes(codes)
            if r["costs"] is None:
                behind, start, gain = backward(codes, _END)
            else:
                flat = r["costs"]
                behind = [_vector(flat[i:i + 4]) for i in range(0, len(flat), 4)]
                behind, start, gain = fix_up(codes, behind, _vector(r["start"]), r["gain"], _vector(r["end"]))
            if not codes and r["end"] is not None:
                start = _vector(r["end"])
            out.append({"conv": r["conv"], "block": r["block"], "codes": codes, "costs": b"".join(map(bytes, behind)),
                        "start": bytes(start), "gain": gain, "used": r["end"] or bytes(_END)})
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _exits(batches: Iterator[pa.RecordBatch], schema: pa.Schema):
    """The state behind each block for every state before it."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            flat, codes = r["costs"], r["codes"]
            behind = [_vector(flat[i:i + 4]) for i in range(0, len(flat), 4)]
            out.append({"conv": r["conv"], "block": r["block"],
                        "exits": bytes(trace(codes, behind, q)[1] for q in range(4))})
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _states(batches: Iterator[pa.RecordBatch], schema: pa.Schema):
    """The state in which each block is entered, and whether it is its conversation's last;
    blocks come sorted by conversation."""
    held = None  # block, conversation, state, exits
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            state = 0
            if held is not None:
                same = held[1] == r["conv"]
                out.append({"block": held[0], "state": held[2], "last": not same})
                state = held[3][held[2]] if same else 0
            held = r["block"], r["conv"], state, r["exits"]
        yield pa.RecordBatch.from_pylist(out, schema=schema)
    if held is not None:
        yield pa.RecordBatch.from_pylist([{"block": held[0], "state": held[2], "last": True}], schema=schema)


def _repaired(batches: Iterator[pa.RecordBatch], with_turns: bool, schema: pa.Schema):
    """Edits, repaired text and figures of blocks whose entering state is known."""
    for batch in batches:
        for k in range(batch.num_rows):
            r = batch.slice(k, 1).to_pylist()[0]
            codes, flat = r["codes"], r["costs"]
            behind = [_vector(flat[i:i + 4]) for i in range(0, len(flat), 4)]
            letters, state = trace(codes, behind, r["state"])
            rows = apply(letters, r["roles"], r["texts"], r["state"], r["last"])
            faults = [c // 4 for c in codes]
            out = {c: r[c] for c in ("conv", "block", "low", "high", "n_turns")} | {
                "blank": faults.count(_BLANK), "duplicate": faults.count(_DUPLICATE),
                "truncated": faults.count(_TRUNCATED), "illegal": _illegal(codes),
                "head": codes[0] % 4 if codes else None, "tail": codes[-1] % 4 if codes else None,
                "cost": r["gain"], "first_cost": r["start"][0],
                "audit": "".join(letters) + (_LAST_EDITS[state] if r["last"] else ""),
                "rows": len(rows), "repaired": _joined(rows)}
            if with_turns:
                out["turns"] = [{"role": a, "text": b} for a, b in rows]
            yield pa.RecordBatch.from_pylist([out], schema=schema)


def _summaries(batches: Iterator[pa.RecordBatch], schema: pa.Schema):
    """One row per conversation from its blocks in order; holds one batch and the edits."""
    names = ("blank", "duplicate", "truncated", "illegal", "cost")
    now, conv = None, None

    def closed() -> dict:
        out = {k: now[k] for k in names} | {"conv": conv, "audit": "".join(now["audit"])}
        out["gaps"] = now["high"] - now["low"] + 1 - now["n_turns"] if now["n_turns"] else 0
        return out | {"repaired_sha256": now["sha"].hexdigest()}

    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if now is None or conv != r["conv"]:
                if now is not None:
                    out.append(closed())
                now = dict.fromkeys(names, 0) | {"audit": [], "sha": hashlib.sha256(), "some": False, "low": None,
                                                 "high": None, "n_turns": 0, "tail": None, "cost": r["first_cost"]}
                conv = r["conv"]
            for k in names:
                now[k] += r[k]
            if r["n_turns"]:
                now["n_turns"] += r["n_turns"] - (now["high"] == r["low"])
                now["low"], now["high"] = r["low"] if now["low"] is None else now["low"], r["high"]
            if r["head"] is not None:
                now["illegal"] += now["tail"] is not None and (now["tail"], r["head"]) not in _PAIRS
                now["tail"] = r["tail"]
            now["audit"].append(r["audit"])
            if r["rows"]:
                now["sha"].update((("\n" if now["some"] else "") + r["repaired"]).encode())
                now["some"] = True
        yield pa.RecordBatch.from_pylist(out, schema=schema)
    if now is not None:
        yield pa.RecordBatch.from_pylist([closed()], schema=schema)


def _map(df: DataFrame, fn, ddl: str, *options) -> DataFrame:
    schema = arrow_schema(ddl)
    return df.mapInArrow(lambda it: fn(it, *options, schema), ddl)


def _converged(spark: SparkSession, edge: DataFrame, conv: str) -> DataFrame:
    """``conv, block, codes, costs, start, gain`` of blocks after all fix-up passes."""
    marks = edge.select("conv", "block", F.explode(F.arrays_zip("places", "digests")).alias("m")).select(
        F.col("conv").alias("of"), "block", F.col("m.places").alias("place"), F.col("m.digests").alias("digest"))
    first = (marks.groupBy("of", "digest").agg(F.min("block").alias("first"), F.max("block").alias("latest"))
             .filter("first != latest").select(F.col("of").alias("same"), "digest", "first"))
    dups = (marks.join(first, ["digest"]).filter(F.col("of").eqNullSafe(F.col("same")) & (F.col("block") != F.col("first")))
            .groupBy("block").agg(F.collect_list("place").alias("dups")))
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("costs", "binary"), ("start", "binary"), ("gain", "long"),
                                                       ("end", "binary"))]
    ddl = f"conv {conv}, block long, codes binary, costs binary, start binary, gain long, used binary"
    known = land(spark, _map(edge.select("conv", "block", "codes").join(dups, "block", "left")
                             .select("conv", "block", "codes", "dups", *empty), _pass, ddl), "costs")
    order = Window.partitionBy("conv").orderBy("block")
    while True:
        ends = known.select("block", "used", F.lead("start").over(order).alias("end")).filter("end != used")
        ends = land(spark, ends.select("block", "end"), "ends")
        if ends.isEmpty():
            return known
        rerun = known.join(ends, "block").select("conv", "block", "codes", F.lit(None).cast("array<int>").alias("dups"),
                                                 "costs", "start", "gain", "end")
        known = land(spark, known.join(ends, "block", "left_anti").unionByName(_map(rerun, _pass, ddl)), "costs")


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text", gone_col: str | None = None, with_turns: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per conversation: ``conv_id``, its faults, the cost and letters of the cheapest
    edits, the hash of the repaired text, and with ``with_turns`` the repaired rows of each of its
    blocks (``block, turns``, then one row per block and no figures).

    Rows for which ``gone_col`` is true do not count; a conversation of such rows alone has
    zeros, no edits and the hash of an empty text.  Defined results: null roles and texts are
    one blank; null turns come first and make no gap; rows of the same turn come in the order of
    role and a hash of the text; a role whose initial is none of s, u and a (an empty one, too)
    is never kept; rows with a null conversation are one conversation; further columns change
    nothing; an empty table gives an empty result.  Rows are the same if a 128-bit digest of role
    and text is."""
    spark = turns.sparkSession
    conv = turns.schema[conv_col].dataType.simpleString()
    blank = F.lit(" ")
    rows = turns.select(
        F.col(conv_col).alias("conv"), (F.col(gone_col) if gone_col else F.lit(False)).alias("gone"),
        F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), blank).alias("role"),
        F.coalesce(F.col(text_col), blank).alias("text"))
    # the last key only deals equal rows over tasks
    keys = ["conv", F.col("turn").asc_nulls_first(), "role", F.xxhash64("text"), F.col("_at")]
    rows = rows.withColumn("_at", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv", "gone", "turn", "role", "text")
    lists = "turns array<struct<role: string, text: string>>"
    ddl = (f"conv {conv}, whole boolean, {SUMMARY}, roles array<string>, texts array<string>, codes binary, "
           f"places array<int>, digests array<binary>, low long, high long, n_turns long, {lists}")
    found = land(spark, _map(rows, _blocks, ddl, with_turns, block_rows).withColumn("block", F.monotonically_increasing_id()), "blocks")
    edge = found.filter("not whole")
    costs = _converged(spark, edge, conv)
    exits = _map(costs.select("conv", "block", "codes", "costs"), _exits, f"conv {conv}, block long, exits binary")
    exits = exits.repartition("conv").sortWithinPartitions("conv", "block")
    states = land(spark, _map(exits, _states, "block long, state int, last boolean"), "states")
    ready = (edge.select("conv", "block", "low", "high", "n_turns", "roles", "texts")
             .join(costs.select("block", "codes", "costs", "start", "gain"), "block").join(states, "block"))
    ddl = (f"conv {conv}, block long, low long, high long, n_turns long, blank long, duplicate long, truncated long, "
           f"illegal long, head int, tail int, cost long, first_cost long, audit string, rows long, repaired string, {lists}")
    parts = _map(ready, _repaired, ddl, with_turns)
    if with_turns:
        return (parts.select("conv", "block", "turns").unionByName(found.filter("whole").select("conv", "block", "turns"))
                .withColumnRenamed("conv", "conv_id"))
    parts = parts.drop("turns").repartition("conv").sortWithinPartitions("conv", "block")
    ddl = f"conv {conv}, {SUMMARY}"
    names = [c.split()[0] for c in ddl.split(", ")]
    return (found.filter("whole").select(*names).unionByName(_map(parts, _summaries, ddl))
            .withColumnRenamed("conv", "conv_id"))


def damaged(turns: DataFrame) -> DataFrame:
    """The contract's damage by ``crc32(conv_id:turn) % 20``; dropped rows are marked ``gone``."""
    blank = F.lit(" ")
    turn, text, role = F.col("turn"), F.coalesce("text", blank), F.coalesce("role", blank)
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), blank), F.coalesce(turn.cast("string"), blank))
    kind = F.pmod(F.crc32(key), F.lit(20))
    rows = turns.select("conv_id", "turn", text.alias("text"), role.alias("role"), kind.alias("kind"))
    rows = rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1)))
                                             .otherwise(F.array(F.lit(0)))))
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"), (F.col("kind") == 0).alias("gone"))
