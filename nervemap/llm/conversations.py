"""Repair of conversations: faults of their turns, and the cheapest edits that give each the order of roles it should have.

A repaired conversation's role initials are ``(s?(ua)+)?``, so a prefix of it is in one of four states. The least cost of what
follows, by state, is a dynamic program from the last turn to the first. Conversations are cut into runs of at most ``RUN`` turns, runs of like
length are laid side by side, and one step of the program moves all of them by a turn (time-major tensors: turn, run, state). A run
first gives the costs from each state before it to each state after it; along a long conversation these are multiplied up, from
its end, to the costs that each run leaves off with. With them every run is traced from each state it could be entered in, all runs at once,
and the states that it is entered in are read off from the first run on. So no turn waits for another run's, and a conversation of any
length spreads over tasks; what comes together for a conversation is 16 numbers a run, and then its audit, which is a value of the result.

Turns are put in order once, by a range partitioning in which a long conversation spreads too, and written; the program works
on one byte a turn, and texts meet the edits again in a sorted stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nervemap.llm.decontamination import text_key
from nervemap.runtime import materialize, ordered, trimmed, trimmed_group

#: Turns of a run, and of a stretch of the ordered table that a task looks at together.
RUN, CHUNK = 256, 1 << 16
#: Cost of an edit; a truncated turn that stays costs ``CUT`` more.
DELETE, INSERT, REROLE, CUT = 4, 3, 3, 3
#: White space; a turn of nothing else is blank.
SPACE = " \t\n\x0b\x0c\r"

# States of a repaired prefix: nothing, system, ends with user, ends with assistant. Roles by initial: s, u, a, any other.
_STATES = 4
_SYSTEM, _USER, _ASSISTANT, _OTHER = range(4)
_FINE, _GONE, _TRUNCATED = range(3)
_NEVER = 1 << 40
#: The state after a user or an assistant turn, whichever has to come, and whose turn that is.
_NEXT = np.array([2, 2, 3, 2])
_NEXT_ROLE = ("user", "user", "assistant", "user")
#: Least cost from each state to an end.
_END = np.array([0, 2 * INSERT, INSERT, 0], dtype=np.int64)
_TAIL = ("", "II", "I", "")
#: State after keeping a turn of a role, by state; -1 where it can't stand.
_KEPT = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1, -1, -1, -1]])
#: What is done before and with a turn, by edit code: up to two insertions, then deletion, keeping or another role.
_LETTERS = [i + e for i in ("", "I", "II") for e in "DKR"]
_D, _K, _R = range(3)

# by symbol (role * 3 + fault) and state
_ALLOWED = (_KEPT >= 0)[np.repeat(np.arange(4), 3)] & (np.tile(np.arange(3), 4) != _GONE)[:, None]
_AFTER = np.where(_ALLOWED, np.repeat(_KEPT, 3, axis=0), 0)
_KEEP_COST = np.where(_ALLOWED, np.tile([0, 0, CUT], 4)[:, None], _NEVER).astype(np.int64)
_REROLE_COST = np.tile([REROLE, _NEVER, REROLE + CUT], 4).astype(np.int64)


def _before(symbol: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Least costs before a turn of each run, given those after it: (run, state, ...) both; turns may be inserted first."""
    shape = (len(symbol), _STATES) + (1,) * (after.ndim - 2)
    at = np.arange(len(symbol))[:, None]
    here = DELETE + after
    np.minimum(here, _KEEP_COST[symbol].reshape(shape) + after[at, _AFTER[symbol]], out=here)
    np.minimum(here, _REROLE_COST[symbol].reshape((-1, 1) + shape[2:]) + after[:, _NEXT], out=here)
    once = INSERT + here[:, _NEXT]
    return np.minimum(np.minimum(here, once), 2 * INSERT + here[:, _NEXT[_NEXT]])


def _buckets(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Runs of like length: at most twice as long as one another."""
    level = np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64)
    for x in np.unique(level):
        yield np.flatnonzero(level == x)


def _tensor(symbols: list[bytes], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(turn, run) of the runs' symbols, and their lengths, the longest first."""
    at = at[np.argsort([-len(symbols[i]) for i in at], kind="stable")]
    sizes = np.array([len(symbols[i]) for i in at])
    out = np.zeros((int(sizes.max(initial=0)), len(at)), dtype=np.uint8)
    for j, i in enumerate(at):
        out[: sizes[j], j] = np.frombuffer(symbols[i], np.uint8)
    return out, at


def transfers(symbols: list[bytes]) -> np.ndarray:
    """(run, state before, state after): the least cost of a run, without what is inserted after its last turn."""
    out = np.empty((len(symbols), _STATES, _STATES), dtype=np.int64)
    sizes = np.array([len(s) for s in symbols])
    for bucket in _buckets(sizes):
        turns, at = _tensor(symbols, bucket)
        cost = np.broadcast_to(np.where(np.eye(_STATES, dtype=bool), 0, _NEVER), (len(at), _STATES, _STATES)).copy()
        for t in range(len(turns) - 1, -1, -1):
            n = int(np.count_nonzero(sizes[at] > t))  # the longest come first
            cost[:n] = np.minimum(_before(turns[t, :n], cost[:n]), _NEVER)
        out[at] = cost
    return out


def traces(symbols: list[bytes], leaving: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each run its edit codes (state entered in, turn), states after it and costs, by state entered in; ``leaving``: least costs after it.

    Of edits that cost the same those whose letters come first.
    """
    out: list = [None] * len(symbols)
    sizes = np.array([len(s) for s in symbols])
    for bucket in _buckets(sizes):
        turns, at = _tensor(symbols, bucket)
        cost = np.empty((len(turns) + 1, len(at), _STATES), dtype=np.int64)
        cost[:] = leaving[at]
        for t in range(len(turns) - 1, -1, -1):
            n = int(np.count_nonzero(sizes[at] > t))
            cost[t, :n] = _before(turns[t, :n], cost[t + 1, :n])
        state = np.broadcast_to(np.arange(_STATES), (len(at), _STATES)).copy()
        codes = np.zeros((len(turns), len(at), _STATES), dtype=np.uint8)
        for t in range(len(turns)):
            n = int(np.count_nonzero(sizes[at] > t))
            q, symbol, row = state[:n], turns[t, :n, None], np.arange(n)[:, None]
            done, inserted, op, after = np.zeros((n, _STATES), bool), np.zeros((n, _STATES), np.int64), np.zeros((n, _STATES), np.int64), q.copy()
            for _ in range(3):
                want = cost[t][row, q]
                gone = ~done & (DELETE + cost[t + 1][row, q] == want)
                after[gone] = q[gone]
                done |= gone
                insert = ~done & (INSERT + cost[t][row, _NEXT[q]] == want)
                rest = ~done & ~insert
                kept = rest & (_KEEP_COST[symbol, q] + cost[t + 1][row, _AFTER[symbol, q]] == want)
                after[kept] = _AFTER[np.broadcast_to(symbol, q.shape)[kept], q[kept]]
                op[kept] = _K
                other = rest & ~kept
                after[other], op[other] = _NEXT[q[other]], _R
                done |= rest
                inserted[insert] += 1
                q = np.where(insert, _NEXT[q], q)
            codes[t, :n], state[:n] = inserted * 3 + op, after
        for j, i in enumerate(at):
            out[i] = codes[: sizes[i], j].T.copy(), state[j].astype(np.int64), cost[0, j] - leaving[i][state[j]]
    return out


def letters(codes: np.ndarray) -> str:
    return "".join(map(_LETTERS.__getitem__, codes.tolist()))


def damage(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", kinds: int = 20) -> DataFrame:
    """(conv_id, turn, role, text) with faults put in by crc32("conv_id:turn") mod ``kinds``: 0 the row goes, 1 its text is emptied, 2 loses its
    ``.!?``, 3 the row comes twice, 4 its role becomes user. A null role or text, and a null id or turn in the sum, is one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    named = conversations.select(
        F.col(id_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"),
        (F.crc32(F.concat_ws(":", space(id_col), space(turn_col)).cast("binary")) % kinds).alias("_kind"),
    )
    kind = F.col("_kind")
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    out = named.where(kind != 0).withColumns({"text": text, "role": F.when(kind == 4, "user").otherwise(F.col("role"))})
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1)))).drop("_copy", "_kind")


class Repair:
    """The repair of a table (conv_id, turn, role, text). Null roles and texts count as one space; rows of one id, null ones too, are one conversation.

    Turns of a conversation stand by turn (null first), then role, then text. A turn's first fault counts: blank, duplicate of an earlier one
    (role and text), truncated (its last character that isn't white space is none of ``.!?``). Blank turns and duplicates are deleted,
    other turns are kept, deleted or get the role user or assistant, and turns of these two may be inserted, so that the role
    initials are ``(s?(ua)+)?`` at the least cost; of equal costs the edits whose initials (D, I, K, R) come first in ASCII. A role of no
    character, or of another initial, can't be kept. An empty table gives empty results.
    """

    def __init__(self, rows: DataFrame, run: int = RUN, chunk: int = CHUNK):
        space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
        slim = rows.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), space("role"), space("text"))
        self.kind = rows.schema["conv_id"].dataType
        self.placed, _ = ordered(slim, "conv", "turn", "role", "text", name="turns")
        self.placed = self.placed.withColumn("at", F.shiftleft(F.col("_part").cast("long"), 33).bitwiseOR(F.col("_pos").cast("long")))
        self.runs = materialize(self._runs(run, chunk), "runs")
        self.edits = materialize(self._edits(), "edits")

    def _fields(self, **more: str) -> str:
        return ", ".join([f"conv {self.kind.simpleString()}", *(f"{n} {t}" for n, t in more.items())])

    def _runs(self, run: int, size: int) -> DataFrame:
        """A row for each run: what it holds, and what it costs from state to state."""
        end = F.rtrim("text", F.lit(SPACE))
        initial = F.substring("role", 1, 1)
        role = F.when(initial == "s", _SYSTEM).when(initial == "u", _USER).when(initial == "a", _ASSISTANT).otherwise(_OTHER)
        fault = F.when(end == "", 1).when(F.substring(end, -1, 1).isin(".", "!", "?"), 0).otherwise(2)
        chunk = F.expr(f"at div {size}").alias("chunk")
        slim = self.placed.select(chunk, "at", "conv", "turn", role.cast("int").alias("role"), fault.cast("int").alias("fault"))
        first = self.placed.where(end != "").groupBy("conv", "role", *text_key(F.col("text"))).agg(F.min("at").alias("at")).select(chunk, "at")
        # names of runs are row numbers, one a row, so that a text that comes often is one row a partition only
        made = slim.groupBy("chunk").cogroup(first.groupBy("chunk")).applyInArrow(trimmed_group(_run_table(run)), self._fields(**_RUN))
        inside = Window.partitionBy("conv").orderBy("at")
        legal = (F.col("prev") == _SYSTEM) & (F.col("first_role") == _USER) | (F.col("prev") == _USER) & (F.col("first_role") == _ASSISTANT) | (F.col("prev") == _ASSISTANT) & (F.col("first_role") == _USER)
        joined = made.withColumns({"prev": F.lag("last_role").over(inside), "prev_turn": F.lag("last_turn").over(inside), "pieces": F.count(F.lit(1)).over(Window.partitionBy("conv"))})
        return joined.withColumns(
            {"illegal": F.col("illegal") + F.when(F.col("prev").isNotNull() & ~legal, 1).otherwise(0), "turns": F.col("turns") - F.when(F.col("prev_turn") == F.col("first_turn"), 1).otherwise(0)}
        ).drop("prev", "prev_turn", "first_role", "last_role", "first_turn", "last_turn")

    def _edits(self) -> DataFrame:
        """A row for each run: conv, at, state entered in, state after, edit codes and letters, cost."""
        one, more = self.runs.where("pieces = 1"), self.runs.where("pieces > 1")
        single = one.select("conv", "at", "pieces", "symbols", F.array(*(F.lit(int(x)) for x in _END)).cast("array<bigint>").alias("leaving"))
        # of a conversation of several runs: 16 numbers a run
        ends = more.select("conv", "at", "matrix").groupBy("conv").applyInArrow(_leaving, "at long, leaving array<bigint>")
        several = more.select("conv", "at", "pieces", "symbols").join(ends, "at").select("conv", "at", "pieces", "symbols", "leaving")
        traced = single.unionByName(several).mapInArrow(trimmed(_trace), self._fields(at="long", pieces="long", codes="array<binary>", after="array<bigint>", cost="array<bigint>"))
        traced = materialize(traced, "traces")
        fields = self._fields(at="long", entered="int", after="int", codes="binary", cost="long")
        alone = traced.where("pieces = 1").select("conv", "at", F.lit(0).alias("entered"), F.col("after")[0].cast("int").alias("after"), F.col("codes")[0].alias("codes"), F.col("cost")[0].alias("cost"))
        return alone.unionByName(traced.where("pieces > 1").drop("pieces").groupBy("conv").applyInArrow(_chosen, fields))

    def audits(self) -> DataFrame:
        """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation that has a turn."""
        found = self.runs.groupBy("conv").agg(*(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "turns")), F.min("low").alias("low"), F.max("high").alias("high"))
        # one row a run: in all as long as the audit
        spelled = self.edits.mapInArrow(trimmed(_spelled), self._fields(at="long", after="int", cost="long", letters="string"))
        told = spelled.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("at", "letters"))).alias("parts"), F.max_by("after", "at").alias("after"), F.sum("cost").alias("cost"))
        tail = F.array(*map(F.lit, _TAIL))[F.col("after")]
        rest = F.array(*(F.lit(int(x)) for x in _END))[F.col("after")]
        told = told.select(F.col("conv").alias("_c"), F.concat(F.array_join(F.transform("parts", lambda x: x["letters"]), ""), tail).alias("audit"), (F.col("cost") + rest).alias("cost"))
        both = found.join(told, F.col("conv").eqNullSafe(F.col("_c")))
        gaps = F.when(F.col("low").isNull(), 0).otherwise(F.col("high") - F.col("low") + 1 - F.col("turns"))
        return both.select(F.col("conv").alias("conv_id"), gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    def _stream(self) -> DataFrame:
        """Turns of a conversation in order, in one partition, each run's edits before it."""
        none = F.lit(None)
        turns = self.placed.select("conv", "at", F.lit(1).alias("what"), "turn", "role", "text", none.cast("binary").alias("codes"), none.cast("int").alias("entered"))
        edits = self.edits.select("conv", "at", F.lit(0).alias("what"), none.cast("long").alias("turn"), none.cast("string").alias("role"), none.cast("string").alias("text"), "codes", "entered")
        return turns.unionByName(edits).repartition("conv").sortWithinPartitions("conv", "at", "what")

    def repaired(self) -> DataFrame:
        """(conv_id, place, turn, role, text, edit): the repaired turns, from place 0; inserted ones have no turn and an empty text."""
        fields = [T.StructField("conv_id", self.kind), *(T.StructField(n, t) for n, t in (("place", T.LongType()), ("turn", T.LongType()), ("role", T.StringType()), ("text", T.StringType()), ("edit", T.StringType())))]
        return self._stream().mapInArrow(trimmed(_repaired), T.StructType(fields))

    def digests(self) -> DataFrame:
        """(conv_id, repaired_sha256): of the repaired turns as ``role:text``, a line each. A text is hashed as it streams by."""
        return self._stream().mapInArrow(trimmed(_digests), T.StructType([T.StructField("conv_id", self.kind), T.StructField("repaired_sha256", T.StringType())]))


_RUN = {
    "at": "long", "symbols": "binary", "blank": "long", "duplicate": "long", "truncated": "long", "illegal": "long", "turns": "long", "low": "long", "high": "long",
    "first_role": "int", "last_role": "int", "first_turn": "long", "last_turn": "long", "matrix": "array<bigint>",
}


def _arrow(kind: str) -> pa.DataType:
    return {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64())}[kind]


def _run_table(run: int):
    """Runs of a stretch of turns; ``first``: the places of those that no earlier turn of the conversation equals."""

    def made(rows: pa.Table, first: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        at, role, fault = (rows[c].to_numpy() for c in ("at", "role", "fault"))
        turn, known = rows["turn"].fill_null(0).to_numpy(), rows["turn"].is_valid().to_numpy()
        conv = rows["conv"].combine_chunks()
        number = conv.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        fault = np.where((fault != 1) & ~np.isin(at, first["at"].to_numpy()), 3, fault)  # 1 blank, 2 truncated, 3 duplicate
        new = np.concatenate(([True], number[1:] != number[:-1])) if len(at) else np.zeros(0, bool)
        begun = np.flatnonzero(new)
        depth = np.arange(len(at)) - np.repeat(begun, np.diff(np.append(begun, len(at))))
        starts = np.flatnonzero(depth % run == 0)
        stops = np.append(starts[1:], len(at))
        symbols = (role * 3 + np.array([_FINE, _GONE, _TRUNCATED, _GONE])[fault]).astype(np.uint8)
        joins = np.zeros(len(at), bool)
        joins[1:] = depth[1:] % run > 0  # a turn and the one before it, in one run
        before = np.roll(role, 1)
        legal = (before == _SYSTEM) & (role == _USER) | (before == _USER) & (role == _ASSISTANT) | (before == _ASSISTANT) & (role == _USER)
        other = known & ~(joins & np.roll(known, 1) & (np.roll(turn, 1) == turn))
        total = lambda x: np.add.reduceat(x.astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)
        parts = [symbols[a:b].tobytes() for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
        some = total(known) > 0
        big = np.iinfo(np.int64)
        low = np.minimum.reduceat(np.where(known, turn, big.max), starts) if len(starts) else starts
        high = np.maximum.reduceat(np.where(known, turn, big.min), starts) if len(starts) else starts
        matrix = transfers(parts).reshape(-1)
        cols = {
            "conv": conv.take(pa.array(starts)), "at": at[starts], "symbols": parts, "blank": total(fault == 1), "duplicate": total(fault == 3), "truncated": total(fault == 2),
            "illegal": total(joins & ~legal), "turns": total(other), "low": pa.array(low, mask=~some), "high": pa.array(high, mask=~some),
            "first_role": role[starts], "last_role": role[stops - 1], "first_turn": pa.array(turn[starts], mask=~known[starts]), "last_turn": pa.array(turn[stops - 1], mask=~known[stops - 1]),
            "matrix": pa.ListArray.from_arrays(pa.array(np.arange(len(starts) + 1) * _STATES**2, pa.int32()), pa.array(matrix, pa.int64())),
        }
        return pa.table([cols["conv"], *(x if isinstance(x := cols[n], pa.Array) else pa.array(x, _arrow(k)) for n, k in _RUN.items())], ["conv", *_RUN])

    return made


def _leaving(runs: pa.Table) -> pa.Table:
    """Least costs after each run of a conversation."""
    runs = runs.sort_by("at")
    matrix = runs["matrix"].combine_chunks().flatten().to_numpy().reshape(-1, _STATES, _STATES)
    out = np.empty((len(matrix), _STATES), dtype=np.int64)
    cost = _END
    for i in range(len(matrix) - 1, -1, -1):
        out[i] = cost
        cost = (matrix[i] + cost[None, :]).min(axis=1)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * _STATES, pa.int32()), pa.array(out.reshape(-1)))
    return pa.table([runs["at"].combine_chunks(), lists], ["at", "leaving"])


def _trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        leaving = batch["leaving"].flatten().to_numpy().reshape(-1, _STATES)
        found = traces(batch["symbols"].to_pylist(), leaving)
        codes = pa.array([[x.tobytes() for x in c] for c, _, _ in found], pa.list_(pa.binary()))
        yield pa.RecordBatch.from_arrays(
            [batch["conv"], batch["at"], batch["pieces"], codes, *(pa.array([f[i].tolist() for f in found], pa.list_(pa.int64())) for i in (1, 2))], ["conv", "at", "pieces", "codes", "after", "cost"]
        )


def _chosen(runs: pa.Table) -> pa.Table:
    """The edits of a conversation's runs, each in the state that the one before leaves."""
    runs = runs.sort_by("at")
    state, out = 0, []
    for codes, after, cost in zip(runs["codes"], runs["after"].to_pylist(), runs["cost"].to_pylist(), strict=True):
        out.append((state, after[state], codes[state].as_py(), cost[state]))
        state = after[state]
    cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.int64()), strict=True)]
    return pa.table([runs["conv"].combine_chunks(), runs["at"].combine_chunks(), *cols], ["conv", "at", "entered", "after", "codes", "cost"])


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [letters(np.frombuffer(c, np.uint8)) for c in batch["codes"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["conv"], batch["at"], batch["after"], batch["cost"], pa.array(words, pa.string())], ["conv", "at", "after", "cost", "letters"])


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Repaired turns (new, conv, turn, role, text, edit) of a stream; ``new``: the first of a conversation. A conversation that loses all turns gives one without a role."""
    conv, open_, state, made, codes = None, False, 0, 0, iter(())

    def close() -> Iterator[tuple]:
        inserted = ("user", "assistant") if state == 1 else ("assistant",) if state == 2 else ()
        for i, role in enumerate(inserted):
            yield made == 0 and i == 0, conv, None, role, "", "I"
        if not made and not inserted:
            yield True, conv, None, None, None, None

    for batch in batches:
        cols = {n: batch[n] for n in batch.schema.names}
        what = cols["what"].to_numpy()
        ids, turns, roles, texts = (cols[n].to_pylist() for n in ("conv", "turn", "role", "text"))
        for i in range(batch.num_rows):
            if not open_ or ids[i] != conv:
                if open_:
                    yield from close()
                conv, open_, state, made = ids[i], True, 0, 0
            if what[i] == 0:
                codes = iter(cols["codes"][i].as_py())
                state = cols["entered"][i].as_py()
                continue
            inserted, op = divmod(next(codes), 3)
            for _ in range(inserted):
                yield made == 0, conv, None, _NEXT_ROLE[state], "", "I"
                state, made = int(_NEXT[state]), made + 1
            if op == _D:
                continue
            role = roles[i] if op == _K else _NEXT_ROLE[state]
            yield made == 0, conv, turns[i], role, texts[i], "KR"[op - 1]
            state = int(_KEPT["sua".index(role[0]), state]) if op == _K else int(_NEXT[state])
            made += 1
    if open_:
        yield from close()


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, size, place, kinds = [], 0, 0, None

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal kinds
        for b in batches:
            kinds = b.schema.field("conv").type
            yield b

    def batch() -> pa.RecordBatch:
        types = (kinds, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["conv_id", "place", "turn", "role", "text", "edit"])

    for new, conv, turn, role, text, edit in _applied(told(batches)):
        place = 0 if new else place + 1
        if role is None:
            continue
        rows.append((conv, place, turn, role, text, edit))
        size += len(text)
        if size > 1 << 22 or len(rows) == 10_000:
            yield batch()
            rows, size = [], 0
    if rows:
        yield batch()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, found, kinds, sha, last = [], [], None, None, None

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal kinds
        for b in batches:
            kinds = b.schema.field("conv").type
            yield b

    for new, conv, _, role, text, _ in _applied(told(batches)):
        if new:
            if sha is not None:
                ids.append(last)
                found.append(sha.hexdigest())
            sha, last = hashlib.sha256(), conv
        if role is not None:
            sha.update(("" if new else "\n").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
        if len(ids) == 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(ids, kinds), pa.array(found, pa.string())], ["conv_id", "repaired_sha256"])
            ids, found = [], []
    if sha is not None:
        ids.append(last)
        found.append(sha.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(ids, kinds), pa.array(found, pa.string())], ["conv_id", "repaired_sha256"])


def audit_damaged(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each id, null included: what ``Repair`` finds and does after ``damage``. An id without a row left has zeros and the hash of nothing.

    Repeated rows count each, unless they are turns that repeat; long texts count whole; other columns play no part.
    """
    repair = Repair(damage(conversations, id_col, turn_col, role_col, text_col))
    ids = conversations.select(F.col(id_col).alias("conv_id")).distinct()
    audits = repair.audits().withColumnRenamed("conv_id", "_a")
    digests = repair.digests().withColumnRenamed("conv_id", "_d")
    out = ids.join(audits, F.col("conv_id").eqNullSafe(F.col("_a")), "left").join(digests, F.col("conv_id").eqNullSafe(F.col("_d")), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256().hexdigest()
    return out.select(F.col("conv_id").alias(id_col), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
