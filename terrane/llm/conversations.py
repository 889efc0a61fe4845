"""Conversation structure repair by a persistent audit DP.

Rows of a conversation are judged (blank, duplicate, truncated), and the
cheapest edits are found that leave role initials ``(s?(ua)+)?``:

    K  keep, 0                      R  rerole to user or assistant, 1
    D  delete, 2 (blank and duplicate rows must go)
    I  insert an empty user or assistant row, 5
    a truncated row that stays costs 5 more

Edits are letters; equal costs go to the ASCII-least string.  The dynamic
program has one state per place in the pattern: nothing yet, after s, after
u, after a.  Its edit strings are nodes of a tree that share their prefixes.

No conversation is gathered as a whole before its strings are: rows are range
sorted by (conv_id, turn), runs of rows become blocks, each block gives the
cheapest way from every state to every state, and a conversation's blocks are
chained.  What a conversation brings to one task is its audit, one letter a
row, and the stream of its texts, one row after another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, staged

#: Rows of a block, as a power of two.
BLOCK_BITS = 11
# Costs of edits and the ends of whole sentences.
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
ENDS = [".", "!", "?"]
USER, ASSISTANT = "user", "assistant"
#: States: nothing yet, after s, after u, after a.
STATES = 4
FINAL = (0, 3)
#: What a conversation may begin with, before its first row: inserted rows.
STARTS = {0: (0, ""), 2: (INSERT, "I"), 3: (2 * INSERT, "II")}
FAULTS = ("blank", "duplicate", "truncated")
_MASK = (1 << 61) - 1
_BASE = 1_000_003


def _moves(code: int) -> list[list[tuple[int, int, str]]]:
    """For each state, how a row of this code leads there: (from, cost, letters), inserts behind the row included.

    A code is the role (0 s, 1 u, 2 a, 3 other) plus 4 times the fault (0 none, 1 truncated, 2 blank, 3 duplicate).
    """
    role, fault = code % 4, code // 4
    step: list[tuple[int, int, int, str]] = [(s, s, DELETE, "D") for s in range(STATES)]
    if fault < 2:
        cost = CUT if fault else 0
        if role == 0:
            step.append((0, 1, cost, "K"))
        for s in (0, 1, 3):
            step.append((s, 2, cost, "K") if role == 1 else (s, 2, cost + REROLE, "R"))
        step.append((2, 3, cost, "K") if role == 2 else (2, 3, cost + REROLE, "R"))
    grown = list(step)
    for s, t, cost, letters in step:
        if t != 2:
            grown.append((s, 2, cost + INSERT, letters + "I"))
            if t != 3:
                grown.append((s, 3, cost + 2 * INSERT, letters + "II"))
        else:
            grown.append((s, 3, cost + INSERT, letters + "I"))
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for s, t, cost, letters in grown:
        if (s, t) not in best or (cost, letters) < best[s, t]:
            best[s, t] = (cost, letters)
    return [[(s, *best[s, t]) for s in range(STATES) if (s, t) in best] for t in range(STATES)]


MOVES = [_moves(code) for code in range(16)]


class AuditTree:
    """Edit strings as linked nodes; a node adds one label to its parent.

    Every node holds its ancestors at distances 1, 2, 4, … and a rolling hash
    of its labels, so the first label in which two nodes of one depth differ
    is found by halving.  Labels begin with K, D or R and may end with I's
    (only a first label may be all I's or empty), so that one string is one
    list of labels.
    """

    def __init__(self):
        self.label: list[str] = [""]
        self.depth: list[int] = [0]
        self.up: list[tuple[int, ...]] = [()]
        self.hash: list[int] = [7]
        self.equal: set[tuple[int, int]] = set()

    def add(self, parent: int, label: str) -> int:
        node = len(self.label)
        up, at, k = [parent], parent, 0
        while k < len(self.up[at]):
            at = self.up[at][k]
            up.append(at)
            k += 1
        self.label.append(label)
        self.depth.append(self.depth[parent] + 1)
        self.up.append(tuple(up))
        self.hash.append((self.hash[parent] * _BASE + hash(label)) % _MASK)
        return node

    def same(self, a: int, b: int) -> bool:
        """Equal strings: equal hashes, and every label compared until the two meet."""
        if a == b:
            return True
        if self.hash[a] != self.hash[b]:
            return False
        walked = []
        while a != b and (a, b) not in self.equal:
            if self.label[a] != self.label[b]:
                return False
            walked.append((a, b))
            a, b = self.up[a][0], self.up[b][0]
        self.equal.update(walked)
        return True

    def ancestor(self, node: int, depth: int) -> int:
        while self.depth[node] > depth:
            node = self.up[node][(self.depth[node] - depth).bit_length() - 1]
        return node

    def first_difference(self, a: int, b: int) -> int:
        """Depth of the first differing labels of two nodes of one depth; 0 if there is none."""
        if self.same(a, b):
            return 0
        for k in reversed(range(len(self.up[a]))):
            if k < len(self.up[a]) and not self.same(self.up[a][k], self.up[b][k]):
                a, b = self.up[a][k], self.up[b][k]
        return self.depth[a]

    def less(self, a: int, x: str, b: int, y: str) -> bool:
        """Whether the string of ``a`` with ``x`` added comes before that of ``b`` with ``y``."""
        at = 0 if a == b else self.first_difference(a, b)
        if at:
            last = self.depth[a]
            below = (lambda node, label: self.label[self.ancestor(node, at + 1)] if at < last else label)
            x, y = self.label[self.ancestor(a, at)] + below(a, x), self.label[self.ancestor(b, at)] + below(b, y)
        return x < y

    def text(self, node: int) -> str:
        labels = []
        while self.depth[node]:
            labels.append(self.label[node])
            node = self.up[node][0]
        return "".join(reversed(labels))


Ways = list[tuple[int, int] | None]


def _advance(tree: AuditTree, ways: Ways, moves: list[list[tuple[int, int, str]]]) -> Ways:
    """The cheapest (cost, node) in every state after one more label."""
    out: Ways = []
    for options in moves:
        best = None
        for s, cost, label in options:
            if ways[s] is None:
                continue
            total, node = ways[s][0] + cost, ways[s][1]
            if best is None or total < best[0] or (total == best[0] and tree.less(node, label, best[1], best[2])):
                best = (total, node, label)
        out.append(None if best is None else (best[0], tree.add(best[1], best[2])))
    return out


def block_ways(codes: str) -> list[tuple[int, str] | None]:
    """Cheapest (cost, edits) from state i to state j over the rows of a block, at 4 i + j."""
    out: list[tuple[int, str] | None] = []
    for first in range(STATES):
        tree = AuditTree()
        ways: Ways = [None] * STATES
        ways[first] = (0, 0)
        for c in codes:
            ways = _advance(tree, ways, MOVES[ord(c) - 65])
        out += [None if w is None else (w[0], tree.text(w[1])) for w in ways]
    return out


def chain(blocks: list[list[tuple[int, str] | None]]) -> tuple[int, str]:
    """Cheapest (cost, edits) of a conversation from the ways of its blocks, in order."""
    tree = AuditTree()
    ways: Ways = [None] * STATES
    for s, (cost, label) in STARTS.items():
        ways[s] = (cost, tree.add(0, label))
    for block in blocks:
        ways = _advance(tree, ways, [[(i, *block[STATES * i + j]) for i in range(STATES) if block[STATES * i + j]] for j in range(STATES)])
    best = None
    for s in FINAL:
        if ways[s] and (best is None or ways[s][0] < best[0] or (ways[s][0] == best[0] and tree.less(ways[s][1], "", best[1], ""))):
            best = ways[s]
    return best[0], tree.text(best[1])


# --- rows --------------------------------------------------------------------

def _text(name: str) -> Column:
    """A column as text, null as one space."""
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damage(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with known faults, by crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 takes its sentence ends, 3 repeats
    it, 4 makes it the user's.  Nulls read as one space.
    """
    drawn = F.crc32(F.concat(_text("conv_id"), F.lit(":"), _text("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), _text("role").alias("role"), _text("text").alias("text"), drawn.alias("_d"))
    text = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.translate("text", "".join(ENDS), "")).otherwise(F.col("text"))
    role = F.when(F.col("_d") == 4, USER).otherwise(F.col("role"))
    copies = F.when(F.col("_d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.filter("_d <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")


def _keyed(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, h1, h2): ordered by these columns, nulls first, rows of one turn by role and content."""
    return turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), _text("role").alias("role"), _text("text").alias("text")
    ).withColumn("h1", F.xxhash64("role", "text")).withColumn("h2", F.xxhash64(F.lit(1), "text", "role"))


def _order() -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "h1", "h2")]


def _codes(turns: DataFrame) -> DataFrame:
    """(conv_id, block, codes, turns, low, high): runs of at most 2^BLOCK_BITS judged rows, texts left behind."""
    core = F.rtrim(F.col("text"), F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    fault = F.when(core == "", 2).when(F.right(core, F.lit(1)).isin(ENDS), 0).otherwise(1)
    judged = _keyed(turns).select("conv_id", "turn", "role", "h1", "h2", kind.alias("kind"), fault.alias("fault"))
    placed = judged.repartitionByRange(*_order()).sortWithinPartitions(*_order()).select(
        "conv_id", "turn", "h1", "h2", "kind", "fault", F.monotonically_increasing_id().alias("seq")
    )
    rows = staged(placed, "turns")
    said = ["conv_id", "h1", "h2"]
    again = (
        rows.groupBy(*said).agg(F.min("seq").alias("first"), F.count("*").alias("said")).filter("said > 1")
        .select(F.col("conv_id").alias("_c"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "first")
    )
    # no hot key on the right side; on the left, adaptive execution splits one
    seen = rows.join(again, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")), "left")
    repeated = F.col("first").isNotNull() & (F.col("seq") > F.col("first"))
    code = F.col("kind") + 4 * F.when((F.col("fault") != 2) & repeated, 3).otherwise(F.col("fault"))
    held = F.array_sort(F.collect_list(F.struct("seq", F.chr(F.lit(65) + code).alias("code"), "turn")))
    # at most 2^BLOCK_BITS rows a group, by the numbering
    blocks = seen.groupBy("conv_id", F.shiftright("seq", BLOCK_BITS).alias("block")).agg(held.alias("r"))
    named = F.array_compact(F.transform("r", lambda x: x["turn"]))
    return blocks.select(
        "conv_id", "block", F.array_join(F.transform("r", lambda x: x["code"]), "").alias("codes"),
        F.size(F.array_distinct(named)).cast("long").alias("turns"), F.array_min(named).alias("low"), F.array_max(named).alias("high"),
    )


_AUDIT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
_WAYS = pa.struct([("cost", pa.int64()), ("edits", pa.string())])


def _with_ways(blocks: DataFrame) -> DataFrame:
    kind = dict(blocks.dtypes)["conv_id"]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list] = {}
        for b in batches:
            found = []
            for codes in b.column("codes").to_pylist():
                if codes not in known:
                    if len(known) > 100_000:
                        known.clear()
                    known[codes] = [None if w is None else {"cost": w[0], "edits": w[1]} for w in block_ways(codes)]
                found.append(known[codes])
            yield pa.record_batch([*b.columns, pa.array(found, pa.list_(_WAYS))], [*b.schema.names, "ways"])

    return blocks.mapInArrow(
        solve, f"conv_id {kind}, block bigint, codes string, turns bigint, low bigint, high bigint, ways array<struct<cost:bigint,edits:string>>"
    )


def audit(turns: DataFrame) -> DataFrame:
    """One row per conversation of ``turns`` (conv_id, turn, role, text) with its faults and cheapest edits.

    conv_id; gaps (turn numbers missing between the first and the last);
    blank, duplicate, truncated (rows by their first fault); illegal
    (neighbours whose role initials are not su, ua or au); cost; audit, the
    edits' letters in order.  Rows are taken by turn, nulls first, and within
    a turn by role and content.  Null roles and texts read as one space; null
    conv_ids are one conversation; a role without initial fits no place.
    """
    ways = _with_ways(_codes(turns))
    kind = dict(ways.dtypes)["conv_id"]
    gathered = ways.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", "codes", "turns", "low", "high", "ways"))).alias("blocks"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows = [_verdict(blocks) for blocks in part.column("blocks").to_pylist()]
                columns = list(zip(*rows))
                names = [f.split()[0] for f in _AUDIT.split(", ")]
                yield pa.record_batch(
                    [part.column("conv_id"), *(pa.array(c, pa.int64()) for c in columns[:-1]), pa.array(columns[-1], pa.string())], ["conv_id", *names]
                )

    return gathered.mapInArrow(join, f"conv_id {kind}, {_AUDIT}")


def _verdict(blocks: list[dict]) -> tuple:
    cost, edits = chain([[None if w is None else (w["cost"], w["edits"]) for w in b["ways"]] for b in blocks])
    codes = "".join(b["codes"] for b in blocks)
    by_fault = [0] * 4
    for code in set(codes):
        by_fault[(ord(code) - 65) // 4] += codes.count(code)
    roles = codes.translate({65 + code: "sua?"[code % 4] for code in range(16)})
    legal = sum(a + b in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
    dated = [b for b in blocks if b["low"] is not None]
    gaps = 0
    if dated:
        shared = sum(a["high"] == b["low"] for a, b in zip(dated, dated[1:]))
        gaps = dated[-1]["high"] - dated[0]["low"] + 1 - (sum(b["turns"] for b in dated) - shared)
    return gaps, by_fault[2], by_fault[3], by_fault[1], max(0, len(roles) - 1) - legal, cost, edits


def repaired(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """The rows of every conversation after its edits: (conv_id, position, edit, role, text).

    Deleted rows are left out; inserted ones have an empty text.  A
    conversation's rows lie side by side, in order, in one partition, and are
    streamed: a task holds a batch and one audit.
    """
    kind = dict(turns.dtypes)["conv_id"]
    rows = _keyed(turns).withColumn("audit", F.lit(None).cast("string"))
    heads = audits.select(
        "conv_id", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"),
        F.lit(None).cast("long").alias("h1"), F.lit(None).cast("long").alias("h2"), "audit",
    )
    together = rows.unionByName(heads).repartition(F.col("conv_id"))
    # a conversation's audit before its rows
    ordered = together.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("audit").isNull(), *_order()[1:]).select("conv_id", "role", "text", "audit")

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        script, at, state, position = "", 0, 0, 0
        for b in batches:
            out: list[tuple] = []
            for conv, role, text, audit_ in zip(*(c.to_pylist() for c in b.columns)):
                if audit_ is not None:
                    script, at, state, position = audit_, 0, 0, 0
                else:
                    letter = script[at]
                    at += 1
                    if letter != "D":
                        initial = role[:1] if letter == "K" else "a" if state == 2 else "u"
                        state = "sua".index(initial) + 1
                        out.append((conv, position, letter, role if letter == "K" else ASSISTANT if state == 3 else USER, text))
                        position += 1
                while at < len(script) and script[at] == "I":
                    state = 3 if state == 2 else 2
                    out.append((conv, position, "I", ASSISTANT if state == 3 else USER, ""))
                    position += 1
                    at += 1
            if out:
                columns = list(zip(*out))
                kinds = (b.schema.field("conv_id").type, pa.int64(), pa.string(), pa.string(), pa.string())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["conv_id", "position", "edit", "role", "text"])

    return ordered.mapInArrow(edit, f"conv_id {kind}, position bigint, edit string, role string, text string")


def conversation_digests(rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of ``repaired`` rows: ``role:text`` joined by newlines, streamed without another shuffle."""
    kind = dict(rows.dtypes)["conv_id"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, sha, kind_ = None, None, None
        for b in batches:
            kind_ = b.schema.field("conv_id").type
            names, shas = [], []
            for mine, position, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "position", "role", "text"))):
                if position == 0:
                    if sha is not None:
                        names.append(conv)
                        shas.append(sha.hexdigest())
                    conv, sha = mine, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode())
            if names:
                yield pa.record_batch([pa.array(names, kind_), pa.array(shas, pa.string())], ["conv_id", "repaired_sha256"])
        if sha is not None:
            yield pa.record_batch([pa.array([conv], kind_), pa.array([sha.hexdigest()], pa.string())], ["conv_id", "repaired_sha256"])

    return rows.mapInArrow(digest, f"conv_id {kind}, repaired_sha256 string")


def repair_report(conversations: DataFrame) -> DataFrame:
    """One row per conversation, after ``damage``: audit columns and the digest of its repaired rows.

    A conversation that damage leaves without rows has zeros, an empty audit
    and the digest of the empty string; an empty table gives no row.  Columns
    beside conv_id, turn, role and text are not read.
    """
    hurt = damage(conversations)
    audits = staged(audit(hurt), "audits")
    shas = conversation_digests(repaired(hurt, audits))
    every = conversations.select(F.col("conv_id").alias("_every")).distinct()
    found = audits.select(F.col("conv_id").alias("_a"), *audits.columns[1:])
    ended = shas.select(F.col("conv_id").alias("_s"), "repaired_sha256")
    joined = every.join(found, F.col("_every").eqNullSafe(F.col("_a")), "left").join(ended, F.col("_every").eqNullSafe(F.col("_s")), "left")
    counts = [c for c in audits.columns[1:] if c != "audit"]
    return joined.select(
        F.col("_every").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
