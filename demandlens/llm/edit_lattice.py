"""Conversation repair: least-cost edits by bidirectional Dijkstra.

Repairing a conversation is a walk through its edit lattice: node (i, state) means
that ``i`` rows are done and what stands so far ends in ``state`` (nothing, system,
user, assistant).  Keeping, re-roling and deleting lead to the next row, inserting
stays in front of it; a walk is an audit, one letter an edit (``K R D I``).  The
search runs from both ends: a forward heap from the start and a reverse heap from
the accepting nodes meet, all crossings that cost as much as the best one are
finished too, and of these the least audit in ASCII order is taken.  A heap orders
by (cost, rows done, letters): edges that cost nothing always finish a row, so a
node leaves a heap only after all that lead to it, with its least letters.

The lattice is cut into blocks of ``BLOCK`` rows.  A conversation of one block is
searched whole; of a longer one, every block is searched from each state to each
state, and blocks are joined in rounds, ``BLOCK`` at a time, by the least (cost,
audit) over the state between them, so no search and no task holds a conversation:
rows are placed by ``ranks.ranked``.  What is as long as a conversation is its own
result, the audit, and the one stream that writes its repaired messages and reads
the hash on: constant memory, though one task, as a hash goes from front to back.

Defined results: a null id is a conversation of its own; a null role or text is one
space; null turns come first; rows of one turn stand by role and text; equal rows
are duplicates but the first; a role is read by its first letter, other letters
must be re-roled or deleted; a conversation without rows has zeros, the empty audit
and the hash of the empty text; an empty table has no rows.  Other columns are not
read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandlens.llm.common import cut, prepare
from demandlens.llm.ranks import numbered, ranked

BLOCK = 64
ORDER = ("turn", "role", "text")
SPACES = " \t\n\x0b\f\r"
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
ACCEPT = (START, ASSISTANT)
AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
FORCED = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}     # what re-roling or inserting gives
ROLES = {USER: "user", ASSISTANT: "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1


# ---------------------------------------------------------------- the lattice

@lru_cache(maxsize=None)
def _steps(code: str) -> tuple[tuple, tuple]:
    """Over a row: (state after, cost, letter) by the state before, and (state before,
    cost, letter) by the state after.  A code is the first letter of the row's role,
    in upper case when truncated, or ``-`` when the row must be deleted."""
    onward: tuple[list, ...] = ([], [], [], [])
    back: tuple[list, ...] = ([], [], [], [])

    def add(p: int, q: int, cost: int, letter: str) -> None:
        onward[p].append((q, cost, letter))
        back[q].append((p, cost, letter))

    extra = TRUNCATED if code.isupper() else 0
    for p in STATES:
        add(p, p, DELETE, "D")
        if code != "-":
            add(p, FORCED[p], REROLE + extra, "R")
            kept = AFTER.get((p, code.lower()))
            if kept is not None:
                add(p, kept, extra, "K")
    return onward, back


def _edges(codes: str, node: tuple[int, int], reverse: bool) -> Iterator[tuple[tuple[int, int], int, str]]:
    """(node, cost, letter) of the edges out of ``node``, or into it."""
    i, q = node
    if reverse:
        for p in STATES:
            if FORCED[p] == q:
                yield (i, p), INSERT, "I"
        if i > 0:
            for p, cost, letter in _steps(codes[i - 1])[1][q]:
                yield (i - 1, p), cost, letter
    else:
        yield (i, FORCED[q]), INSERT, "I"
        if i < len(codes):
            for p, cost, letter in _steps(codes[i])[0][q]:
                yield (i + 1, p), cost, letter


def least_edits(codes: str, entry: int, exits: tuple[int, ...]) -> tuple[int, str] | None:
    """(cost, audit) of the least walk from state ``entry`` before the rows to one
    of ``exits`` after them; None when there is none."""
    n = len(codes)
    done: tuple[dict, dict] = ({}, {})                 # node -> (cost, letters), forward and reverse
    heaps: tuple[list, list] = ([(0, 0, "", (0, entry))], [(0, 0, "", (n, q)) for q in exits])
    heapq.heapify(heaps[1])
    best: tuple[int, str] | None = (0, "") if n == 0 and entry in exits else None
    while heaps[0] and heaps[1]:
        if best is not None and heaps[0][0][0] + heaps[1][0][0] > best[0]:
            break                                      # every crossing of the best cost is finished
        side = 0 if heaps[0][0][:2] <= heaps[1][0][:2] else 1
        cost, _, letters, node = heapq.heappop(heaps[side])
        if node in done[side]:
            continue
        done[side][node] = (cost, letters)
        for nxt, step, letter in _edges(codes, node, bool(side)):
            audit = letter + letters if side else letters + letter
            if nxt in done[1 - side]:                  # a crossing
                far_cost, far = done[1 - side][nxt]
                found = (cost + step + far_cost, audit + far if not side else far + audit)
                best = found if best is None else min(best, found)
            if nxt not in done[side]:
                rows = n - nxt[0] if side else nxt[0]
                heapq.heappush(heaps[side], (cost + step, rows, audit, nxt))
    return best


@lru_cache(maxsize=1 << 16)
def _whole(codes: str) -> tuple[int, str]:
    return least_edits(codes, START, ACCEPT)


@lru_cache(maxsize=1 << 12)
def _between(codes: str) -> list[tuple[int, int, int, str]]:
    """(entry, exit, cost, audit) of a block, for all pairs of states."""
    found = [(p, q, least_edits(codes, p, (q,))) for p in STATES for q in STATES]
    return [(p, q, *f) for p, q, f in found if f is not None]


def _joined(parts: list) -> list[tuple[int, int, int, str]]:
    """One summary of consecutive blocks' walks."""
    total = {(r["entry"], r["exit"]): (r["cost"], r["audit"]) for r in parts[0]}
    for part in parts[1:]:
        nxt: dict = {}
        for (p, mid), (cost, audit) in total.items():
            for r in part:
                if r["entry"] == mid:
                    key, found = (p, r["exit"]), (cost + r["cost"], audit + r["audit"])
                    nxt[key] = min(nxt.get(key, found), found)
        total = nxt
    return [(p, q, cost, audit) for (p, q), (cost, audit) in total.items()]


SUMMARY = T.ArrayType(T.StructType([T.StructField("entry", T.IntegerType()), T.StructField("exit", T.IntegerType()),
                                    T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())]))


def _named(walks: list[tuple]) -> list[dict]:
    return [dict(zip(("entry", "exit", "cost", "audit"), w)) for w in walks]


@F.pandas_udf(SUMMARY)
def _search_blocks(codes: pd.Series, alone: pd.Series) -> pd.Series:
    return pd.Series([_named([(START, ASSISTANT, *_whole(c))] if one else _between(c)) for c, one in zip(codes, alone)])


def _join_blocks(group: tuple, blocks: pd.DataFrame) -> pd.DataFrame:
    blocks = blocks.sort_values("block")
    return pd.DataFrame({"key": [group[0]], "block": [group[1]], "illegal": [blocks["illegal"].sum()],
                         "walks": [_named(_joined(list(blocks["walks"])))]})


# ---------------------------------------------------------------- faults and plans

def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of ``conversations`` after the fixed damage rule."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    text = F.coalesce(F.col("text"), F.lit(" "))
    kind = F.col("kind")
    hit = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"),
                      (F.crc32(F.concat(said[0], F.lit(":"), said[1])) % 20).alias("kind")).filter(kind != 0)
    changed = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return hit.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
                      changed.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def _key(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def messages(rows: DataFrame) -> DataFrame:
    """(key, conv_id, turn, role, text, row_no): ``rows``, numbered and without nulls
    but in conv_id and turn."""
    return numbered(rows.select(_key(F.col("conv_id")).alias("key"), "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                                F.coalesce("text", F.lit(" ")).alias("text")), "lattice-messages")


def with_faults(said: DataFrame) -> DataFrame:
    """(key, turn, initial, pos, n, fault): every message's place in its conversation
    and its first fault (``blank``, ``duplicate``, ``truncated`` or null)."""
    bare = F.rtrim("text", F.lit(SPACES))
    open_end = ~F.right(bare, F.lit(1)).isin(".", "!", "?")
    marked = said.select("*", F.substring("role", 1, 1).alias("initial"), (bare == "").alias("blank"), open_end.alias("open_end"),
                         F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("digest"))
    placed = ranked(marked, "key", ORDER, "lattice", ["turn", "initial", "blank", "open_end", "digest"])
    # the first message of every (role, text); its place is unique, so the join has no hot key
    first = (placed.groupBy("key", "digest").agg(F.min("pos").alias("pos"))
             .select("key", "pos", F.lit(True).alias("first")))
    fault = (F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("open_end"), "truncated"))
    return placed.join(first, ["key", "pos"], "left").select("key", "turn", "initial", "pos", "n", fault.alias("fault"))


def plans(rows: DataFrame) -> DataFrame:
    """(key, blank, duplicate, truncated, illegal, gaps, cost, audit) of every
    conversation of ``with_faults`` rows."""
    prepare(rows.sparkSession)
    fault, initial = F.col("fault"), F.col("initial")
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    code = (F.when(fault.isin("blank", "duplicate"), "-").when(fault == "truncated", F.upper(letter)).otherwise(letter))
    block = F.floor(F.col("pos") / BLOCK)
    # a block sees the first row of the next one too, for the pair across its edge
    seen = F.when((F.col("pos") % BLOCK == 0) & (F.col("pos") > 0), F.array(block, block - 1)).otherwise(F.array(block))
    listed = (rows.select("key", "n", "pos", initial.alias("initial"), code.alias("code"), block.alias("own"),
                          F.explode(seen).alias("block"))
              .groupBy("key", "n", "block")
              .agg(F.array_sort(F.collect_list(F.struct("pos", "initial", "code", "own"))).alias("rows")))
    pairs = F.zip_with(F.expr("slice(rows, 1, size(rows) - 1)"), F.expr("slice(rows, 2, size(rows))"),
                       lambda x, y: F.concat(x["initial"], y["initial"]))
    codes = F.array_join(F.expr("transform(filter(rows, r -> r.own = block), r -> r.code)"), "")
    blocks = listed.select("key", "block", codes.alias("codes"), (F.col("n") <= BLOCK).alias("alone"),
                           F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au"))).cast("long").alias("illegal"))
    found = cut(blocks.select("key", "block", "illegal", "alone", _search_blocks("codes", "alone").alias("walks")), "lattice-0")
    whole, found = found.filter("alone").drop("alone"), found.filter("not alone").drop("alone")
    rounds = 0
    while (found.agg(F.max("block")).first()[0] or 0) > 0:
        rounds += 1
        up = found.groupBy("key", F.floor(F.col("block") / BLOCK).alias("up"))     # at most BLOCK rows a group
        found = cut(up.applyInPandas(_join_blocks, found.schema), f"lattice-{rounds}")
    found = whole.unionByName(found)
    ends = F.filter("walks", lambda w: (w["entry"] == START) & w["exit"].isin(*ACCEPT))
    best = F.array_min(F.transform(ends, lambda w: F.struct(w["cost"].alias("cost"), w["audit"].alias("audit"))))
    counts = rows.groupBy("key").agg(
        *[F.sum((F.coalesce(fault, F.lit("")) == f).cast("long")).alias(f) for f in ("blank", "duplicate", "truncated")],
        (F.max("turn") - F.min("turn") + 1).alias("span"))
    turns = rows.filter("turn is not null").select("key", "turn").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("turns"))
    return (found.select("key", "illegal", best.alias("best")).join(counts, "key").join(turns, "key", "left")
            .select("key", "blank", "duplicate", "truncated", "illegal",
                    F.coalesce(F.col("span") - F.col("turns"), F.lit(0)).cast("long").alias("gaps"),
                    F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit")))


# ---------------------------------------------------------------- repaired messages

def _repaired(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Messages of sorted rows, each conversation's plan first."""
    key, audit, at, state, place = None, "", 0, START, 0
    out: list[tuple] = []

    def write(role: str, text: str) -> None:
        nonlocal place
        out.append((key, place, role, text))
        place += 1

    def inserted() -> None:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            state, at = FORCED[state], at + 1
            write(ROLES[state], "")

    for pdf in batches:
        for k, plan, role, text in zip(pdf["key"], pdf["audit"], pdf["role"], pdf["text"]):
            if k != key:
                inserted()
                key, audit, at, state, place = k, plan, 0, START, 0
                continue                               # the row that brings the plan
            inserted()
            edit, at = audit[at], at + 1
            if edit == "K":
                state = AFTER[state, role[0]]
                write(role, text)
            elif edit == "R":
                state = FORCED[state]
                write(ROLES[state], text)
        yield pd.DataFrame(out, columns=["key", "place", "role", "text"])
        out.clear()
    inserted()
    yield pd.DataFrame(out, columns=["key", "place", "role", "text"])


def repaired(said: DataFrame, planned: DataFrame) -> DataFrame:
    """(key, place, role, text): the messages that the audits leave, conversations
    whole in their partitions and in order."""
    prepare(said.sparkSession)
    stream = (planned.select("key", F.lit(0).alias("step"), "audit")
              .unionByName(said.select("key", F.lit(1).alias("step"), *ORDER, "row_no"), allowMissingColumns=True)
              .repartition("key").sortWithinPartitions("key", "step", *ORDER, "row_no"))
    return stream.select("key", "audit", "role", "text").mapInPandas(_repaired, "key string, place long, role string, text string")


def _hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    key, digest, out = None, None, []
    for pdf in batches:
        for k, place, role, text in zip(pdf["key"], pdf["place"], pdf["role"], pdf["text"]):
            if k != key:
                if digest is not None:
                    out.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256()
            digest.update((("\n" if place else "") + f"{role}:{text}").encode())
        yield pd.DataFrame(out, columns=["key", "repaired_sha256"])
        out.clear()
    yield pd.DataFrame([] if digest is None else [(key, digest.hexdigest())], columns=["key", "repaired_sha256"])


def repair(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """Faults, cost, audit and hash of the repaired messages of every conversation
    of ``conversations``, from its ``rows`` (conv_id, turn, role, text)."""
    prepare(rows.sparkSession)
    said = messages(rows)
    planned = cut(plans(cut(with_faults(said), "lattice-faults")), "lattice-plans")
    hashed = repaired(said, planned).mapInPandas(_hashes, "key string, repaired_sha256 string")
    ids = conversations.select("conv_id").distinct().withColumn("key", _key(F.col("conv_id")))
    nothing = hashlib.sha256(b"").hexdigest()
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return (ids.join(planned, "key", "left").join(hashed, "key", "left")
            .select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256")))
