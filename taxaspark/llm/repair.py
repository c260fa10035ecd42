"""Cheapest edits that give a conversation a legal order of roles, for conversations of any length.

A legal repaired conversation has role initials ``(s?(ua)+)?``, an automaton of four states. What the rows from some
place on cost, for each state before them, is a vector of four numbers, and a block of rows maps the vector after it
to the vector before it. Blocks grow with the square root of the place they begin at, so a conversation of n rows has
about sqrt(n) of them, of about sqrt(n) rows. Vectors are kept only between blocks; every block, in a task of its own,
then computes its rows' vectors again from the one after it and walks forward along edits that keep to them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taxaspark.llm.rows import positions
from taxaspark.session import stage, task_count

# A conversation's k-th block holds its places from FIRST_BLOCK * k^2 on; nothing but the sizes of tasks depends on it.
FIRST_BLOCK = 64
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
# State → state after a role's initial, where that is legal.
AFTER = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
# The role that may be written next, whatever the row's was; nothing but START may be followed by a system row.
NEXT = (("u", USER), ("u", USER), ("a", ASSISTANT), ("u", USER))
KINDS = "sua?"
# What is written after the last row, by state.
TAIL = ("", "ua", "a", "")
_SPACE = r"\x20\x09-\x0D"
_BLANK = 4  # a row that must go
_CUT = 8  # a truncated row


def _closed(v: list[float]) -> list[float]:
    """Allow inserts before a row, at costs given for no insert. One is enough but at the end, which TAIL has."""
    user, assistant = min(v[USER], INSERT + v[ASSISTANT]), min(v[ASSISTANT], INSERT + v[USER])
    return [min(v[START], INSERT + user), min(v[SYSTEM], INSERT + user), user, assistant]


def _options(code: int) -> list[list[tuple[str, str, int, int]]]:
    """By state, what may be done to a row: (initial, written as, cost, state after), initials rising."""
    made = []
    for state in range(4):
        ways = [("D", "D", DELETE, state)]
        if not code & _BLANK:
            more = TRUNCATED if code & _CUT else 0
            kept = AFTER.get(KINDS[code & 3], {}).get(state)
            if kept is not None:
                ways.append(("K", "K", KEEP + more, kept))
            role, after = NEXT[state]
            ways.append(("R", role.upper(), REROLE + more, after))
        made.append(ways)
    return made


OPTIONS = [_options(code) for code in range(16)]
END = [float(INSERT * len(TAIL[state])) for state in range(4)]


def before_row(code: int, after: list[float]) -> list[float]:
    return _closed([min(cost + after[to] for _, _, cost, to in OPTIONS[code][state]) for state in range(4)])


def block_map(codes: bytes) -> list[float]:
    """Costs through a block, state before * 4 + state after, inserts before its first row among them."""
    columns = []
    for end in range(4):
        v = [0.0 if state == end else np.inf for state in range(4)]
        for code in reversed(codes):
            v = before_row(code, v)
        columns.append(v)
    return [columns[end][state] for state in range(4) for end in range(4)]


def walk(codes: bytes, after: list[float]) -> list[tuple[int, str]]:
    """For each state before the block: the state after it, and the least cheapest edits, one ``|`` behind each row.

    Letters: D, K, U and A for a row that becomes a user's or assistant's, u and a for one inserted before a row.
    """
    costs = [after]
    for code in reversed(codes):
        costs.append(before_row(code, costs[-1]))
    costs.reverse()
    found = []
    for state in range(4):
        told = []
        for i, code in enumerate(codes):
            here = costs[i]
            while True:
                (initial, told_as, cost, to), *others = OPTIONS[code][state]
                if cost + costs[i + 1][to] == here[state]:
                    break
                role, next_state = NEXT[state]
                if INSERT + here[next_state] == here[state]:
                    told.append(role)
                    state = next_state
                    continue
                initial, told_as, cost, to = next(o for o in others if o[2] + costs[i + 1][o[3]] == here[state])
                break
            told.append(told_as + "|")
            state = to
        found.append((state, "".join(told)))
    return found


def faults(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows by conversation and place, with their first fault: conv, turn, role, text, place, fault.

    Order is turn (nulls first), role, text. fault is blank (no visible character), duplicate (role and text stand
    earlier in the conversation), truncated (the last visible character is none of ``.!?``) or null. A null conv_id is
    a conversation, null roles and texts are one space. Other columns are not read. The result is a written table.
    """
    space = F.lit(" ")
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, space).alias("role"), F.coalesce(text, space).alias("text"))
    rows = stage(rows, "turns")
    rows = positions(rows, ["conv"], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], "place")
    rows = stage(rows, "placed")
    # The first place of each text, by a combined minimum; it is looked up by place, so many copies are no hot key.
    firsts = rows.groupBy("conv", "role", F.sha2("text", 256).alias("digest")).agg(F.min("place").alias("__place"))
    firsts = firsts.select(F.col("conv").alias("__conv"), "__place")
    marked = rows.join(firsts, F.col("conv").eqNullSafe(F.col("__conv")) & (F.col("place") == F.col("__place")), "left")
    fault = (
        F.when(~F.col("text").rlike(f"[^{_SPACE}]"), "blank")
        .when(F.col("__place").isNull(), "duplicate")
        .when(~F.col("text").rlike(rf"[.!?][{_SPACE}]*\z"), "truncated")
    )
    return stage(marked.select("conv", "turn", "role", "text", "place", fault.alias("fault")), "faults")


def _block(place: Column) -> Column:
    return F.floor(F.sqrt(place / FIRST_BLOCK)).cast("int")


def _same(other: str = "__conv") -> Column:
    return F.col("conv").eqNullSafe(F.col(other))


def cheapest_edits(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edits of ``faults``' rows: (conv, block, edits, as in ``walk``) and (conv, illegal, cost).

    illegal counts adjacent rows whose roles' initials are none of su, ua, au. Of a conversation a task holds a block,
    or four costs for each of its blocks.
    """
    kind = F.coalesce(F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.instr(F.lit(KINDS), F.substring("role", 1, 1)) - 1), F.lit(3))
    code = kind + F.when(F.col("fault").isin("blank", "duplicate"), _BLANK).when(F.col("fault") == "truncated", _CUT).otherwise(0)
    spark = rows.sparkSession
    # Codes are small and walking them is not: a number of tasks is asked for, which few bytes do not reduce.
    tasks = max(task_count(spark), int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.select("conv", "place", code.cast("tinyint").alias("code"), _block(F.col("place")).alias("block"))
    coded = rows.repartition(tasks, "conv", "block").groupBy("conv", "block").agg(F.array_sort(F.collect_list(F.struct("place", "code"))).alias("list"))
    coded = coded.select("conv", "block", F.col("list.code").alias("codes"))

    @F.pandas_udf("map array<double>, illegal long, first int, last int")
    def through(codes: pd.Series) -> pd.DataFrame:
        out = []
        for block in codes:
            kinds = block & 3
            legal = sum(int(((kinds[:-1] == a) & (kinds[1:] == b)).sum()) for a, b in ((0, 1), (1, 2), (2, 1)))
            out.append((block_map(block.astype(np.uint8).tobytes()), len(kinds) - 1 - legal, int(kinds[0]), int(kinds[-1])))
        return pd.DataFrame(out, columns=["map", "illegal", "first", "last"])

    coded = stage(coded.withColumn("through", through("codes")), "blocks")

    @F.pandas_udf("checkpoints array<struct<block int, after array<double>>>, cost long, illegal long")
    def back(blocks: pd.Series) -> pd.DataFrame:
        out = []
        for listed in blocks:
            after, kept, illegal = END, [], 0
            for i in range(len(listed) - 1, -1, -1):
                now = listed[i]["through"]
                kept.append({"block": listed[i]["block"], "after": after})
                illegal += now["illegal"] + (i > 0 and (listed[i - 1]["through"]["last"], now["first"]) not in ((0, 1), (1, 2), (2, 1)))
                through = np.asarray(now["map"]).reshape(4, 4)
                after = _closed((through + np.asarray(after)).min(axis=1).tolist())
            out.append((kept, int(after[START]), illegal))
        return pd.DataFrame(out, columns=["checkpoints", "cost", "illegal"])

    by_conv = coded.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("block", F.struct("through.map", "through.illegal", "through.first", "through.last").alias("through")))).alias("blocks"))
    by_conv = stage(by_conv.withColumn("back", back("blocks")).select("conv", "back.*"), "checkpoints")
    points = by_conv.select(F.col("conv").alias("__conv"), F.explode("checkpoints").alias("c")).select("__conv", F.col("c.block").alias("__block"), "c.after")
    here = coded.join(points, _same() & (F.col("block") == F.col("__block"))).select("conv", "block", "codes", "after")
    here = here.repartition(tasks, "conv", "block")

    @F.pandas_udf("exits array<int>, edits array<string>")
    def forward(codes: pd.Series, after: pd.Series) -> pd.DataFrame:
        out = []
        for block, v in zip(codes, after, strict=True):
            found = walk(block.astype(np.uint8).tobytes(), list(v))
            out.append(([e for e, _ in found], [t for _, t in found]))
        return pd.DataFrame(out, columns=["exits", "edits"])

    walked = stage(here.select("conv", "block", forward("codes", "after").alias("w")).select("conv", "block", "w.*"), "walks")

    @F.pandas_udf("array<struct<block int, state int, tail string>>")
    def entered(blocks: pd.Series) -> pd.Series:
        out = []
        for listed in blocks:
            state, kept = START, []
            for b in listed:
                kept.append({"block": b["block"], "state": state, "tail": ""})
                state = int(b["exits"][state])
            kept[-1]["tail"] = TAIL[state]
            out.append(kept)
        return pd.Series(out)

    states = walked.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("block", "exits"))).alias("blocks"))
    states = states.select(F.col("conv").alias("__conv"), F.explode(entered("blocks")).alias("s")).select("__conv", "s.*").withColumnRenamed("block", "__block")
    chosen = walked.join(states, _same() & (F.col("block") == F.col("__block")))
    # What follows the last row stands behind that row's edit.
    edits = F.concat(F.regexp_replace(F.get("edits", F.col("state")), r"\|\z", ""), "tail")
    return stage(chosen.select("conv", "block", edits.alias("edits")), "edits"), by_conv.select("conv", "illegal", "cost")


def audits(edits: DataFrame) -> DataFrame:
    """(conv, audit): the edits' initials, D, I, K or R, of a whole conversation."""
    letters = F.translate(F.concat_ws("", F.col("list.edits")), "uaUA|", "IIRR")
    return edits.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("block", "edits"))).alias("list")).select("conv", letters.alias("audit"))


def repaired(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Repaired rows, (conv, place, nth, role, text, edit): nth orders what one place gives, edit is I, K or R."""
    split = edits.select(F.col("conv").alias("__conv"), F.posexplode(F.split("edits", r"\|")).alias("nth", "letters"), "block")
    split = split.select("__conv", (F.col("nth") + FIRST_BLOCK * F.col("block").cast("long") * F.col("block")).alias("__place"), "letters").where("letters <> 'D'")
    joined = rows.join(split, _same() & (F.col("place") == F.col("__place")))
    joined = joined.select("conv", "place", "role", "text", F.posexplode(F.split("letters", "")).alias("nth", "letter")).where("letter not in ('D', '')")
    role = F.when(F.col("letter") == "K", F.col("role")).when(F.lower("letter") == "u", "user").otherwise("assistant")
    new = F.col("letter").isin("u", "a")
    return joined.select("conv", "place", "nth", role.alias("role"), F.when(new, "").otherwise(F.col("text")).alias("text"), F.translate("letter", "uaUA", "IIRR").alias("edit"))


def transcripts_sha256(rows: DataFrame) -> DataFrame:
    """(conv, sha256) of each conversation's ``role:text`` lines in order, joined by line feeds.

    Rows of a conversation pass a task sorted and are hashed as they come, so none is held whole.
    """
    kind = rows.schema["conv"].dataType
    # A row's inserts stand before its own line; lines of one place are joined here, at most four.
    line = F.concat("role", F.lit(":"), "text")
    lines = rows.groupBy("conv", "place").agg(F.array_sort(F.collect_list(F.struct("nth", line.alias("line")))).alias("list"))
    lines = lines.select("conv", "place", F.array_join("list.line", "\n").alias("lines"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, arrow = None, None, None
        for batch in batches:
            arrow, keys, digests = batch.column(0).type, [], []
            for conv, told in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest is None or conv != now:
                    if digest is not None:
                        keys.append(now)
                        digests.append(digest.hexdigest())
                    now, digest = conv, hashlib.sha256(told.encode())
                else:
                    digest.update(b"\n" + told.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, arrow), pa.array(digests, pa.string())], names=["conv", "sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], arrow), pa.array([digest.hexdigest()])], names=["conv", "sha256"])

    ordered = lines.repartition("conv").sortWithinPartitions("conv", "place").select("conv", "lines")
    return ordered.mapInArrow(run, T.StructType([T.StructField("conv", kind), T.StructField("sha256", T.StringType())]))


def report(rows: DataFrame, edits: DataFrame, costs: DataFrame) -> DataFrame:
    """One row per conversation of ``faults``: conv, gaps, blank, duplicate, truncated, illegal, cost, audit."""
    count = lambda fault: F.count(F.when(F.col("fault") == fault, 1)).alias(fault)
    counts = rows.groupBy("conv").agg(*[count(f) for f in ("blank", "duplicate", "truncated")])
    wide = F.col("turn").cast("decimal(20,0)")  # first and last turn may be further apart than their type holds
    turns = rows.groupBy("conv", wide.alias("turn")).agg(F.lit(1).alias("one")).groupBy("conv")
    turns = turns.agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    for more in (turns, costs, audits(edits)):
        counts = counts.join(more.withColumnRenamed("conv", "__conv"), _same()).drop("__conv")
    return counts.select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
