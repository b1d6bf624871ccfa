"""Conversation structure repair: the cheapest edits that give ``(s?(ua)+)?``.

Every conversation is a path through an edit lattice (``lattice``: Keep 0,
Rerole 3, Delete 4, Insert 3, an undeleted truncated turn 3 more), searched
by a bidirectional Dijkstra; among equally cheap ways the ASCII-least list
of edit letters is taken.  Blank turns and duplicates must be deleted.

1. Equal rows are counted, and a row's first place among equal (role,
   text) of its conversation is found by an aggregate over digests.
2. Rows are dealt by ranges of (conv_id, turn, role, text), so a long
   conversation lies in several tasks.  Within a task conversations are cut
   into segments of at most ``SEGMENT`` distinct rows.
3. A conversation inside one segment is solved there.  Of one that crosses
   tasks or segments, each segment gives its cheapest edits between every
   pair of states; the segments are chained from the last to the first
   (strings compared piece by piece), and each is solved once more between
   the two states chosen.  No task holds more than a segment's rows.

Defined cases: null roles and texts read as given by the caller (the query
makes them one space; ``repair`` itself reads null as empty); turns are
ordered by (turn, role, text), null turns first; repeated rows are kept as
turns, all but the first being duplicates; rows with a null ``conv_id``
form one conversation; an empty role has no initial, so keeping it adds
none; a conversation without rows has no edits; other columns of the input
are ignored.  A conversation's audit is one string, so 2 GB of edits are
the limit, and its digest is taken by one task in order, in a stream.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from toposim.llm.common import lookup_join, materialize, sql_crc32, table
from toposim.llm.lattice import DELETE, FINAL, INSERT, NEXT, REROLE, ROLE, TRUNCATED, moves, solve, solve_short
from toposim.llm.rowstream import batches_of, rows_of, runs
from toposim.session import ship

#: Most distinct rows of a conversation that are searched at once.
SEGMENT = 4096
_SPACE = " \t\n\x0b\x0c\r"


def damage(conv: DataFrame) -> DataFrame:
    """The contract's damage: ``conv`` (conv_id, turn, role, text), nulls as
    one space, by crc32(``conv_id:turn``) mod 20."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conv.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"),
                       (F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20).alias("k"))
    rows = rows.where("k <> 0").select(
        "conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return rows.select("conv_id", "turn", "role", "text")


def faults(conv: DataFrame) -> DataFrame:
    """Distinct rows of ``conv`` with ``copies`` (how often the row occurs)
    and ``fault``: blank, duplicate (all copies), repeated (all copies but
    the first are duplicates), truncated, or null."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conv.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"))
    digest = F.sha2(F.concat(F.hex("role"), F.lit(":"), F.col("text")).cast("binary"), 256)
    order = F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn").alias("turn"))
    firsts = rows.select("conv_id", digest.alias("digest"), order.alias("at"))
    firsts = firsts.groupBy("conv_id", "digest").agg(F.min("at").alias("least"), F.max("at").alias("most"))
    # only texts found at several turns matter; one row per key, so nulls of conv_id get a marker that joins
    firsts = firsts.where(~F.col("least").eqNullSafe(F.col("most"))).select(F.col("conv_id").isNull().alias("__n"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("__c"), F.col("digest").alias("__d"), "least")
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    rows = rows.select("*", F.col("conv_id").isNull().alias("__n"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("__c"), digest.alias("__d"))
    rows = lookup_join(rows, materialize(firsts, "repair-firsts"), ["__n", "__c", "__d"], F.col("turn"))
    bare = F.rtrim(F.col("text"), F.lit(_SPACE))
    later = F.col("least").isNotNull() & ~F.col("least").eqNullSafe(order)
    fault = (F.when(bare == "", "blank").when(later, "duplicate")
             .when(F.substring(bare, -1, 1).isin(".", "!", "?"), F.lit(None)).otherwise("truncated"))
    return rows.select("conv_id", "turn", "role", "text", "copies", fault.alias("fault"))


def _turns(rows: list[tuple]) -> tuple:
    """Lattice turns of rows (turn, role, text, copies, fault)."""
    out = []
    for _, role, _, copies, fault in rows:
        if fault in ("blank", "duplicate"):
            out.append((copies, "", 0))
        else:
            out.append((0, role[:1], int(fault == "truncated")))
            if copies > 1:
                out.append((copies - 1, "", 0))
    return tuple(out)


def _edits(rows: list[tuple], turns: tuple, letters: str, state: int):
    """The edits as rows (turn, before, role, text, fault, copies, edit, cost)."""
    spread = []
    for r in rows:
        spread.append(r)
        if r[4] not in ("blank", "duplicate") and r[3] > 1:
            spread.append((r[0], r[1], r[2], r[3] - 1, "duplicate"))
    i = 0
    for e in letters:
        if e == "I":
            yield None, None, ROLE[state], "", None, 1, e, INSERT
            state = NEXT[state]
            continue
        turn, before, text, copies, fault = spread[i]
        run, initial, truncated = turns[i]
        i += 1
        if e == "D":
            yield turn, before, None, text, fault, run or 1, e, DELETE * (run or 1)
        elif e == "R":
            yield turn, before, ROLE[state], text, fault, 1, e, REROLE + TRUNCATED * truncated
            state = NEXT[state]
        else:
            yield turn, before, before, text, fault, 1, e, TRUNCATED * truncated
            state = next(t for x, _, t in moves(run, initial, truncated)[state] if x == "K")


def _find(turns: tuple, start: int = 0, finals: tuple = FINAL):
    return (solve_short if len(turns) <= 12 else solve)(turns, start, finals)


def _between(turns: tuple) -> str:
    """Cheapest edits between all pairs of states, as JSON."""
    found = ((s, t, _find(turns, s, (t,))) for s in range(4) for t in range(4))
    return json.dumps([[s, t, *x] for s, t, x in found if x])


def _first_pass(schema: StructType, segment: int):
    """Whole conversations become edits; rows of cut ones stay ``open``,
    with one row of costs between states per segment."""
    none = (None,) * 8

    def cut(rows):
        seg = 0
        held = None  # the last complete segment of the conversation at hand
        first = True  # whether the conversation may begin in the task before
        for key, group in runs(rows, 0, 1):
            conv, part = key
            buf, pieces = [], 0
            for r in group:
                if len(buf) == segment:
                    yield from opened(conv, part, seg, buf)
                    seg, buf, pieces = seg + 1, [], pieces + 1
                buf.append(r[2:])
            if held is not None:
                yield from held_out(*held)
            held = (conv, part, seg, buf, first or pieces > 0)
            seg, first = seg + 1, False
        if held is not None:  # and it may go on in the task after
            yield from opened(*held[:4])

    def held_out(conv, part, seg, buf, is_open):
        if is_open:
            yield from opened(conv, part, seg, buf)
            return
        turns = _turns(buf)
        for pos, e in enumerate(_edits(buf, turns, _find(turns)[1], 0)):
            yield (conv, part, seg, pos, *e, False, None)

    def opened(conv, part, seg, buf):
        yield (conv, part, seg, -1, *none, True, _between(_turns(buf)))
        for pos, (turn, role, text, copies, fault) in enumerate(buf):
            yield (conv, part, seg, pos, turn, role, None, text, fault, copies, None, None, True, None)

    return lambda batches: batches_of(cut(rows_of(batches)), schema)


class _Rope:
    """A list of pieces of text, compared without joining them."""

    __slots__ = ("piece", "rest")

    def __init__(self, piece, rest):
        self.piece, self.rest = piece, rest

    def __lt__(self, other):
        a, b, x, y = self.piece, other.piece, self.rest, other.rest
        while True:
            n = min(len(a), len(b))
            if a[:n] != b[:n]:
                return a[:n] < b[:n]
            a, b = a[n:], b[n:]
            if not a and not b and x is y:
                return False
            while not a and x is not None:
                a, x = x.piece, x.rest
            while not b and y is not None:
                b, y = y.piece, y.rest
            if not a or not b:
                return bool(b)


def _chain(schema: StructType):
    """Segments of a conversation, last first -> (part, seg, start, end)."""

    def run(rows):
        for _, group in runs(rows, 0):
            after = {f: (0, _Rope("", None)) for f in FINAL}
            steps = []
            for _, part, seg, costs in group:
                here, choice = {}, {}
                for s, t, cost, letters in json.loads(costs):
                    if t not in after:
                        continue
                    total, rope = cost + after[t][0], _Rope(letters, after[t][1])
                    if s not in here or total < here[s][0] or total == here[s][0] and rope < here[s][1]:
                        here[s], choice[s] = (total, rope), t
                after = here
                steps.append((part, seg, choice))
            state = 0
            for part, seg, choice in reversed(steps):
                yield part, seg, state, choice[state]
                state = choice[state]

    return lambda batches: batches_of(run(rows_of(batches)), schema)


def _second_pass(schema: StructType):
    def run(rows):
        for (part, seg), group in runs(rows, 1, 2):
            group = list(group)
            conv, start, end = group[0][0], group[0][-2], group[0][-1]
            buf = [r[3:8] for r in group]
            turns = _turns(buf)
            for pos, e in enumerate(_edits(buf, turns, _find(turns, start, (end,))[1], start)):
                yield (conv, part, seg, pos, *e)

    return lambda batches: batches_of(run(rows_of(batches)), schema)


def repair(conv: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``conv`` (conv_id, turn, role, text) -> its edits.

    One row per edit: conv_id; part, seg, pos (their order); turn, before
    (the row's role), role (the role it gets; null if deleted), text,
    fault, copies (equal neighbouring rows deleted at once, else 1), edit
    (K, R, D, I), cost.
    """
    ship(conv.sparkSession)
    keys = ["conv_id", "turn", "role", "text"]
    rows = faults(conv).repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = rows.select("conv_id", F.spark_partition_id().alias("part"), "turn", "role", "text", "copies", "fault")
    field = lambda df, c: df.schema[c].dataType.simpleString()
    edit = (f"conv_id {field(rows, 'conv_id')}, part int, seg int, pos int, turn {field(rows, 'turn')}, before string, role string, "
            "text string, fault string, copies long, edit string, cost long")
    first = StructType.fromDDL(f"{edit}, open boolean, costs string")
    done = materialize(rows.mapInArrow(_first_pass(first, segment), first), "repair")
    names = StructType.fromDDL(edit).names

    costs = done.where("open and pos = -1").select("conv_id", "part", "seg", "costs")
    costs = costs.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("seg"))
    path = StructType.fromDDL("part int, seg int, start int, end int")
    path_rows = costs.mapInArrow(_chain(path), path)
    opened = done.where("open and pos >= 0").join(path_rows, ["part", "seg"])
    opened = opened.select("conv_id", "part", "seg", "turn", "before", "text", "copies", "fault", "pos", "start", "end")
    opened = opened.repartition("part", "seg").sortWithinPartitions("part", "seg", "pos").drop("pos")
    second = StructType.fromDDL(edit)
    return done.where("not open").select(*names).unionByName(opened.mapInArrow(_second_pass(second), second))


def _report(schema: StructType):
    def run(rows):
        for (conv,), group in runs(rows, 0):
            blank = duplicate = truncated = illegal = cost = distinct = 0
            least = most = last = None
            audit, digest, before, sep = [], hashlib.sha256(), None, ""
            for _, turn, was, role, text, fault, copies, edit, c in group:
                if edit is None:  # the mark that every conversation has
                    continue
                cost += c
                audit.append(edit * copies)
                blank += copies * (fault == "blank")
                duplicate += copies * (fault == "duplicate")
                truncated += fault == "truncated"
                if edit != "I":
                    initial = was[:1]
                    pairs = copies - 1 + (before is not None)
                    if pairs:
                        if before is not None:
                            illegal += before + initial not in ("su", "ua", "au")
                        illegal += (copies - 1) * (initial * 2 not in ("su", "ua", "au"))
                    before = initial
                    if turn is not None:
                        distinct += turn != last
                        least, most, last = turn if least is None else least, turn, turn
                if role is not None:
                    digest.update(f"{sep}{role}:{text}".encode())
                    sep = "\n"
            gaps = 0 if least is None else int(most) - int(least) + 1 - distinct
            yield conv, gaps, blank, duplicate, truncated, illegal, cost, "".join(audit), digest.hexdigest()

    return lambda batches: batches_of(run(rows_of(batches)), schema)


def report(edits: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per conversation of ``ids`` (conv_id): its faults, the cost,
    the audit and a digest of the repaired turns."""
    ship(edits.sparkSession)
    marks = ids.select("conv_id").distinct()
    rows = edits.unionByName(marks, allowMissingColumns=True)
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seg", "pos")
    rows = rows.select("conv_id", "turn", "before", "role", "text", "fault", "copies", "edit", "cost")
    out = StructType.fromDDL(f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, gaps long, blank long, duplicate long, truncated long, "
                             "illegal long, cost long, audit string, repaired_sha256 string")
    return rows.mapInArrow(_report(out), out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return report(repair(damage(conv)), conv)


_BLANK = "regexp_replace(text, '[ \\t\\n\\v\\f\\r]+$', '')"


def _sql_best(options: list[str]) -> str:
    """The least (cost, audit) of some structs, nulls left out."""
    return f"list_sort(list_filter([{', '.join(options)}], lambda o: o IS NOT NULL))[1]"


def _oracle() -> str:
    edge = lambda c, letter, s: f"CASE WHEN b.s{s} IS NOT NULL THEN {{'c': b.s{s}.c + {c}, 'a': '{letter}' || b.s{s}.a}} END"
    row = []
    for s in range(4):
        keep = " ".join(f"WHEN l.ini = '{i}' THEN {edge('l.cut', 'K', to)}" for (i, frm), to in
                        {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3, ("", s): s}.items() if frm == s)
        row.append(_sql_best([
            edge(DELETE, "D", s),
            f"CASE WHEN NOT l.gone THEN CASE {keep} END END",
            f"CASE WHEN NOT l.gone THEN {edge(f'{REROLE} + l.cut', 'R', NEXT[s])} END"]) + f" AS s{s}")
    ins = []
    for s in range(4):
        one, two = NEXT[s], NEXT[NEXT[s]]
        ins.append(_sql_best([
            f"s{s}", f"CASE WHEN s{one} IS NOT NULL THEN {{'c': s{one}.c + {INSERT}, 'a': 'I' || s{one}.a}} END",
            f"CASE WHEN s{two} IS NOT NULL THEN {{'c': s{two}.c + {2 * INSERT}, 'a': 'II' || s{two}.a}} END"]) + f" AS s{s}")
    none = "NULL::STRUCT(c BIGINT, a VARCHAR)"
    return f"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
keyed AS (SELECT *, {sql_crc32('key')} % 20 AS k FROM src),
hurt AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM keyed, (VALUES (0), (1)) AS twice(copy) WHERE k <> 0 AND (copy = 0 OR k = 3)),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) AS seen
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS rn FROM hurt)),
faulty AS (
  SELECT *, left(role, 1) AS ini, CASE WHEN {_BLANK} = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate'
         WHEN right({_BLANK}, 1) IN ('.', '!', '?') THEN 'none' ELSE 'truncated' END AS fault FROM numbered),
l AS (SELECT *, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN {TRUNCATED} ELSE 0 END AS cut,
             ini || lead(ini) OVER (PARTITION BY conv_id ORDER BY rn) AS pair FROM faulty),
facts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM l GROUP BY conv_id),
rest AS (
  SELECT conv_id, n AS i, {{'c': 0::BIGINT, 'a': ''}} AS s0, {none} AS s1, {none.replace('NULL', "{'c': 3::BIGINT, 'a': 'I'}")} AS s2, {{'c': 0::BIGINT, 'a': ''}} AS s3 FROM facts
  UNION ALL
  SELECT conv_id, i, {', '.join(ins)} FROM (
    SELECT b.conv_id, b.i - 1 AS i, {', '.join(row)}
    FROM rest b JOIN l ON l.conv_id IS NOT DISTINCT FROM b.conv_id AND l.rn = b.i) x),
solved AS (SELECT f.*, r.s0.c AS cost, r.s0.a AS audit FROM facts f JOIN rest r ON r.conv_id IS NOT DISTINCT FROM f.conv_id AND r.i = 0),
walk AS (
  SELECT conv_id, audit, 0 AS p, 0 AS i, 0 AS s, NULL::VARCHAR AS line FROM solved
  UNION ALL
  SELECT w.conv_id, w.audit, p + 1, i + (e <> 'I')::INT,
         CASE WHEN e = 'D' OR e = 'K' AND l.ini = '' THEN s WHEN e = 'K' AND l.ini = 's' THEN 1 ELSE CASE WHEN s = 2 THEN 3 ELSE 2 END END,
         CASE WHEN e = 'D' THEN NULL WHEN e = 'K' THEN l.role || ':' || l.text
              ELSE CASE WHEN s = 2 THEN 'assistant:' ELSE 'user:' END || CASE WHEN e = 'R' THEN l.text ELSE '' END END
  FROM (SELECT *, audit[p + 1] AS e FROM walk WHERE p < length(audit)) w
  LEFT JOIN l ON e <> 'I' AND l.conv_id IS NOT DISTINCT FROM w.conv_id AND l.rn = w.i + 1),
lines AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY p) AS whole FROM walk GROUP BY conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
       sha256(coalesce(whole, '')) AS repaired_sha256
FROM ids LEFT JOIN solved s ON s.conv_id IS NOT DISTINCT FROM ids.conv_id
         LEFT JOIN lines n ON n.conv_id IS NOT DISTINCT FROM ids.conv_id
"""


ORACLE_SQL = _oracle()
