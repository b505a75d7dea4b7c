"""Conversation structure repair: the cheapest edits that make the roles of a conversation s?(ua)+ or empty.

A node is (rows read, state): E nothing kept yet, S after the system turn, U after a user turn, A after an assistant turn. Its arcs are Delete,
Insert, Keep and Rerole, each to one node, at costs of 0 to 3. Distances to the end come from a Dial queue, an array of buckets by
distance, and the audit is the walk from the start over tight arcs that takes the ASCII-least letter at each node.

Conversations are cut into chunks of CHUNK rows, so none is ever gathered: the chunks of a longer one are first reduced to the 4 x 4 distances
between their ends, whose min-plus products give the distances at each cut, and walks are chained by the states in which they cross the cuts.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import folded, stored

#: Rows of a conversation that one task holds at a time.
CHUNK = 4096
WHITE = " \t\n\x0b\x0c\r"
E, S, U, A = range(4)
#: State after a turn of each initial, where that turn is allowed.
AFTER = {(E, "s"): S, (E, "u"): U, (S, "u"): U, (U, "a"): A, (A, "u"): U}
#: The user or assistant turn that is allowed next, and the state after it.
NEXT = {E: ("user", U), S: ("user", U), U: ("assistant", A), A: ("user", U)}
#: Distances to the end once all rows are read: a system turn lacks a pair, a user turn an answer.
AT_END = (0, 4, 2, 0)
INITIALS = "sua"
MUST_GO, TRUNCATED = 4, 8
FAR = 1 << 40


def damage(conversations: DataFrame) -> DataFrame:
    """The rows with planted faults: by crc32 of "conv_id:turn" modulo 20, 0 drops a row, 1 empties its text, 2 removes its end marks, 3
    repeats it and 4 sets its role to user. Nulls of role and text, and in the hashed string, are one space."""
    kind = F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])) % 20
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def faults(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text) -> the same with pos (1-based, by turn with nulls first, then role and text), fault (blank, duplicate,
    truncated or null) and illegal (the pair of initials with the row before is none of su, ua, au)."""
    of_turn = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    nth = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    trimmed = F.rtrim(F.col("text"), F.lit(WHITE))
    fault = F.when(trimmed == "", "blank").when(nth > 1, "duplicate").when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), "truncated")
    of_conv = Window.partitionBy("conv_id").orderBy(*of_turn, F.col("again"))
    initial = F.substring("role", 1, 1)
    # one shuffle by conversation serves both windows
    judged = rows.repartition("conv_id").withColumn("fault", fault).withColumn("again", (nth > 1).cast("int"))
    pair = F.concat(F.lag(initial).over(of_conv), initial)
    placed = judged.withColumn("pos", F.row_number().over(of_conv).cast("long")).withColumn("illegal", F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)))
    return placed.drop("again")


def _code(role: Column, fault: Column) -> Column:
    """Initial (3: another), with MUST_GO and TRUNCATED."""
    initial = F.when(role.startswith("s"), 0).when(role.startswith("u"), 1).when(role.startswith("a"), 2).otherwise(3)
    return (initial + F.when(fault.isin("blank", "duplicate"), MUST_GO).when(fault == "truncated", TRUNCATED).otherwise(0)).cast("int")


def arcs(code: int | None, state: int) -> list[tuple[str, int, int, int]]:
    """(letter, rows read, state after, cost) of the arcs of a node before a row of this code, or after the last row (None), letters ascending."""
    after = NEXT[state][1]
    insert = ("I", 0, after, 2)
    if code is None:
        return [insert]
    out = [("D", 1, state, 3), insert]
    if not code & MUST_GO:
        more, initial = (code & TRUNCATED) // TRUNCATED, code & 3
        kept = AFTER.get((state, INITIALS[initial])) if initial < 3 else None
        if kept is not None:
            out.append(("K", 1, kept, more))
        out.append(("R", 1, after, 2 + more))
    return out


def distances(codes: list[int], ends: list[int] | tuple[int, ...]) -> list[list[int]]:
    """Distance to the end from each node (row, state), by Dial's queue over the reversed arcs; ends are those after the last row."""
    n = len(codes)
    into: list[list[list[tuple[int, int, int]]]] = [[[] for _ in range(4)] for _ in range(n + 1)]
    for i in range(n + 1):
        for q in range(4):
            for _, read, after, cost in arcs(codes[i] if i < n else None, q):
                into[i + read][after].append((i, q, cost))
    far = [[FAR] * 4 for _ in range(n + 1)]
    least = min(ends)
    buckets: list[list[tuple[int, int]]] = [[]]

    def offer(i: int, q: int, d: int) -> None:
        if d < far[i][q]:
            far[i][q] = d
            while len(buckets) <= d - least:
                buckets.append([])
            buckets[d - least].append((i, q))

    for q in range(4):
        if ends[q] < FAR:
            offer(n, q, ends[q])
    at = 0
    while at < len(buckets):
        for i, q in buckets[at]:  # grows while arcs of cost 0 are followed
            if far[i][q] == at + least:
                for j, p, cost in into[i][q]:
                    offer(j, p, at + least + cost)
        at += 1
    return far


def walk(codes: list[int], far: list[list[int]], state: int, last: bool) -> tuple[list[str], int]:
    """(letters up to and with those that read each row, state after the last row) of the ASCII-least shortest way; last: with the inserts at
    the end of the conversation, which go to the last row."""
    pieces, piece, i = [], "", 0
    while i < len(codes) or last and far[i][state] > 0:
        letter, read, state = next((a, r, q) for a, r, q, cost in arcs(codes[i] if i < len(codes) else None, state) if cost + far[i + r][q] == far[i][state])
        piece += letter
        if read:
            pieces.append(piece)
            piece, i = "", i + 1
    if piece:
        pieces[-1] += piece
    return pieces, state


def _between_ends(codes: pd.Series) -> pd.Series:
    """16 distances from each state before a chunk to each state after it."""

    def of(own: list[int]) -> list[int]:
        columns = [distances(own, [0 if q == end else FAR for q in range(4)])[0] for end in range(4)]
        return [columns[end][q] for q in range(4) for end in range(4)]

    return codes.map(lambda own: of([int(c) for c in own]))


def _walks(codes: pd.Series, ends: pd.Series, last: pd.Series, first: pd.Series) -> pd.Series:
    """For each state before a chunk the way through it; before the first chunk there is only E."""

    def of(own: list[int], end: list[int], is_last: bool, is_first: bool) -> list[dict]:
        far = distances(own, end)
        out = []
        for q in range(1 if is_first else 4):
            pieces, state = walk(own, far, q, is_last)
            out.append({"cost": far[0][q], "state": state, "pieces": pieces})
        return out

    return pd.Series([of([int(c) for c in c_], [int(e) for e in e_], bool(l_), bool(f_)) for c_, e_, l_, f_ in zip(codes, ends, last, first, strict=True)])


def _same(a: DataFrame, b: DataFrame, key: str, how: str = "left") -> DataFrame:
    """a joined with b(key_b, key, ...) on a conversation, null being one, and on key."""
    return a.join(b.withColumnRenamed("conv_id", "__conv").withColumnRenamed(key, "__key"), F.expr(f"conv_id <=> __conv and {key} = __key"), how).drop("__conv", "__key")


def edits(flagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, piece) and (conv_id, cost): the letters of the audit that end with the edit of each row, and the cost of a conversation."""
    between_ends = F.pandas_udf(_between_ends, "array<long>")
    walks = F.pandas_udf(_walks, "array<struct<cost long, state int, pieces array<string>>>")
    chunk = F.floor((F.col("pos") - 1) / CHUNK).alias("chunk")
    coded = flagged.select("conv_id", "pos", chunk, _code(F.col("role"), F.col("fault")).alias("code"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("pos", "code"))), lambda x: x["code"])  # CHUNK entries at most
    chunks = stored(coded.groupBy("conv_id", "chunk").agg(listed.alias("codes"), F.max("pos").alias("until")))
    long = chunks.groupBy("conv_id").agg(F.max("chunk").alias("of")).where("of > 0")
    conv = F.col("conv_id").eqNullSafe(F.col("c"))
    in_long = chunks.join(long.withColumnRenamed("conv_id", "c"), conv).drop("c")

    def cuts(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("chunk", ascending=False)
        end, out = list(AT_END), []
        for conv_id, at, between in zip(part["conv_id"], part["chunk"], part["between"], strict=True):
            out.append((conv_id, at - 1, end := [min(between[4 * q + e] + end[e] for e in range(4)) for q in range(4)]))
        return pd.DataFrame(out, columns=["conv_id", "chunk", "ends"])

    kind = chunks.schema["conv_id"].dataType.simpleString()
    ends = in_long.where("chunk > 0").select("conv_id", "chunk", between_ends("codes").alias("between")).groupBy("conv_id").applyInPandas(cuts, f"conv_id {kind}, chunk long, ends array<long>")
    at_end = F.array(*[F.lit(x).cast("long") for x in AT_END])
    led = _same(chunks, ends, "chunk")
    ways = stored(led.select("conv_id", "chunk", "until", walks("codes", F.coalesce("ends", at_end), F.col("ends").isNull(), F.col("chunk") == 0).alias("ways")))

    def crossed(part: pd.DataFrame) -> pd.DataFrame:
        state, out = E, []
        for conv_id, at, after in part.sort_values("chunk")[["conv_id", "chunk", "after"]].itertuples(index=False):
            out.append((conv_id, at, state))
            state = int(after[state])
        return pd.DataFrame(out, columns=["conv_id", "chunk", "enters"])

    after = ways.select("conv_id", "chunk", F.col("ways.state").alias("after")).join(long.select(F.col("conv_id").alias("c")), conv, "left_semi")
    enters = after.groupBy("conv_id").applyInPandas(crossed, f"conv_id {kind}, chunk long, enters int")
    taken = _same(ways, enters, "chunk").select("conv_id", "chunk", F.get("ways", F.coalesce("enters", F.lit(0))).alias("way"))
    pieces = taken.select("conv_id", "chunk", F.posexplode("way.pieces").alias("at", "piece")).select("conv_id", (F.col("chunk") * CHUNK + F.col("at") + 1).alias("pos"), "piece")
    return pieces, ways.where("chunk = 0").select("conv_id", F.col("ways")[0]["cost"].alias("cost"))


class _Repaired:
    """Role automaton over the audit, with a running hash of the repaired conversation."""

    def __init__(self) -> None:
        self.state, self.audit, self.hash, self.any = E, [], hashlib.sha256(), False

    def turn(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.any else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.any = True

    def read(self, role: str, text: str, piece: str) -> None:
        self.audit.append(piece)
        for letter in piece:
            if letter == "K":
                self.turn(role, text)
                self.state = AFTER[self.state, role[0]]
            elif letter != "D":
                role_next, self.state = NEXT[self.state]
                self.turn(role_next, text if letter == "R" else "")


def repair(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text) -> (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation.

    Keep costs 0, Rerole to user or assistant and Insert of an empty turn 2, Delete 3; blank and repeated rows are always deleted, and a
    truncated row that stays costs 1 more. Null roles and texts are one space, a null conv_id is a conversation like any other, null turns come first
    and count in no gap, rows of one turn are ordered by role and text, and repeated rows are duplicates. A role with another initial
    than s, u and a can't be kept. Other columns are ignored; an empty table gives an empty result.
    """
    named = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    flagged = stored(faults(named))
    count = lambda what: F.sum((F.col("fault") == what).cast("long"))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    stats = flagged.groupBy("conv_id").agg(gaps.alias("gaps"), *[zero(count(f)).alias(f) for f in ("blank", "duplicate", "truncated")], F.sum(F.col("illegal").cast("long")).alias("illegal"))
    pieces, costs = edits(flagged)
    told = _same(flagged.select("conv_id", "pos", "role", "text"), pieces, "pos", "inner")
    done = folded(told, "conv_id", ["pos"], ["role", "text", "piece"], _Repaired, _Repaired.read, lambda s: ("".join(s.audit), s.hash.hexdigest()), "audit string, repaired_sha256 string")
    by_conv = lambda a, b: a.join(b.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    return by_conv(by_conv(stats, costs), done).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """repair() of damage(), with a row for every conversation: without rows left its numbers are 0, its audit is empty and its hash that of the empty string."""
    found = repair(damage(conversations)).withColumnRenamed("conv_id", "c")
    every = conversations.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
