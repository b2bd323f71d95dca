"""Repair of conversations: the cheapest edits that give a well-formed one (operator 11).

A fold over a conversation's turns carries four states, by the last role given out: nothing yet, system, user, assistant. Each
is a struct of cost and audit, so that least() takes the cheapest and, of those, the least audit. Two edits of equal cost
over the same turns are never such that one's audit begins the other's (it would hold more inserts, which cost), so the
lesser audit stays the lesser whatever follows.

Inside, J and S stand for an insert and a change of role that give an assistant, and d for the copies of a turn that go with
it; from equal audits so far only one of I and J, and of R and S, is possible, so their order is that of I and R.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.llm.common import stored, table

#: Turns and bytes of text up to which a conversation is folded whole; larger ones are cut into blocks of about that size.
BLOCK_TURNS, BLOCK_BYTES = 4096, 64 << 20
RENAME, REMOVE, INSERT, CUT = 2, 3, 2, 1
_SPACE, _NEVER = " \t\n\x0b\f\r", 1 << 50
_TURNS = "array<struct<role:string,text:string>>"
_STATES = ["s0", "s1", "s2", "s3"]


def _struct(cost, audit) -> Column:
    return F.struct(F.lit(cost).cast("long").alias("cost"), F.lit(audit).alias("audit") if isinstance(audit, str) else audit.alias("audit"))


def _then(state: Column, cost, letters) -> Column:
    return _struct(state["cost"] + cost, F.concat(state["audit"], F.lit(letters) if isinstance(letters, str) else letters))


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _states(*v: Column) -> Column:
    return F.struct(*(x.alias(n) for x, n in zip(v, _STATES)))


def _inserted(v: Column) -> Column:
    """The states after any inserts: a user from all but user, an assistant from user. More than two never pay."""
    a, b, c, d = (v[n] for n in _STATES)
    return _states(a, b, F.least(c, *(_then(x, INSERT, "I") for x in (a, b, d))), F.least(d, _then(c, INSERT, "J"), *(_then(x, 2 * INSERT, "IJ") for x in (a, b))))


def _start(state: int) -> Column:
    return _states(*(_struct(0 if i == state else _NEVER, "") for i in range(4)))


def _turn(v: Column, row: Column) -> Column:
    """The states after a turn: deleted, kept, or given another role. Its copies go in any case."""

    def after(v: Column) -> Column:
        a, b, c, d = (v[n] for n in _STATES)
        copies = F.repeat(F.lit("d"), (row["n"] - 1).cast("int"))
        able, kept, gone = ~row["forced"], row["cut"] * CUT + REMOVE * (row["n"] - 1), lambda x: _then(x, REMOVE * row["n"], F.concat(F.lit("D"), copies))
        go = lambda x, cost, letter: _then(x, kept + cost, F.concat(F.lit(letter), copies))
        from_user = F.least(a, b, d)
        return _states(
            gone(a),
            F.least(gone(b), F.when(able & (row["initial"] == "s"), go(a, 0, "K"))),
            F.least(gone(c), F.when(able & (row["initial"] == "u"), go(from_user, 0, "K")), F.when(able, go(from_user, RENAME, "R"))),
            F.least(gone(d), F.when(able & (row["initial"] == "a"), go(c, 0, "K")), F.when(able, go(c, RENAME, "S"))),
        )

    return _let(_inserted(v), after)


def _fold(rows: Column, state: int) -> Column:
    return F.aggregate(rows, _start(state), _turn)


def _end(v: Column) -> Column:
    """The cheapest well-formed end: nothing, or an assistant's turn."""
    return _let(_inserted(v), lambda w: F.least(w["s0"], w["s3"]))


def _joined(v: Column, block: Column) -> Column:
    """The states after a block of which `through` holds the states for each state before it."""
    onto = lambda s, t: _struct(v[s]["cost"] + block["through"][_STATES.index(s)][t]["cost"], F.concat(v[s]["audit"], block["through"][_STATES.index(s)][t]["audit"]))
    return _states(*(F.least(*(onto(s, t) for s in _STATES)) for t in _STATES))


def _blank(text: str) -> Column:
    return F.rtrim(text, F.lit(_SPACE)) == ""


def _flagged(rows: DataFrame) -> DataFrame:
    """A row for each conversation and block with its sorted turns and counts; rows has conv_id, block, turn, role, text, n
    copies and `again`, whether the role and text came at an earlier turn."""
    order = Window.partitionBy("conv_id", "block").orderBy(F.asc_nulls_first("turn"), "role", "text")
    last, initial = F.right(F.rtrim("text", F.lit(_SPACE)), F.lit(1)), F.substring("role", 1, 1)
    blank = _blank("text")
    before = F.lag("role").over(order)
    kinds = rows.withColumns({
        "initial": initial, "blank": blank, "first": F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(order)),
        "forced": blank | F.col("again"), "cut": (~blank & ~F.col("again") & ~last.isin(".", "!", "?")).cast("long"),
        "illegal": F.col("n") - 1 + (before.isNotNull() & ~F.concat(F.substring(before, 1, 1), initial).isin("su", "ua", "au")).cast("long"),
    })
    gathered = F.array_sort(F.collect_list(F.struct(F.coalesce("turn", F.lit(-(1 << 63))).alias("at"), F.col("turn").isNotNull().alias("known"), "role", "text", "n", "initial", "forced", "cut")))
    return kinds.groupBy("conv_id", "block").agg(
        gathered.alias("rows"), F.min("turn").alias("low"), F.max("turn").alias("high"), F.sum(F.col("first").cast("long")).alias("turns"),
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).otherwise(F.col("n") - 1 + F.col("again").cast("long"))).alias("duplicate"),
        F.sum("cut").alias("truncated"), F.sum("illegal").alias("illegal"),
    )


def _repaired(rows: Column, edits: Column, tail: Column) -> Column:
    """The turns that edits, one string for each row, make of rows, and those that tail inserts."""
    given = lambda letters: F.transform(F.regexp_extract_all(letters, F.lit("[IJ]"), F.lit(0)), lambda x: F.struct(F.when(x == "I", "user").otherwise("assistant").alias("role"), F.lit("").alias("text")))

    def made(row: Column, edit: Column) -> Column:
        role = F.when(edit.contains("K"), row["role"]).when(edit.contains("R"), "user").when(edit.contains("S"), "assistant")
        own = F.when(role.isNull(), F.array().cast(_TURNS)).otherwise(F.array(F.struct(role.alias("role"), row["text"].alias("text"))))
        return F.concat(given(edit), own)

    return F.concat(F.flatten(F.zip_with(rows, edits, made)), given(tail))


_EDIT, _TAIL = "[IJ]*[DKRS]d*", "([IJ]*)$"
_COUNTS = ["blank", "duplicate", "truncated", "illegal"]


def _gaps(low, high, turns) -> Column:
    return F.coalesce((F.col(high).cast("decimal(20,0)") - F.col(low) + 1 - F.col(turns)).try_cast("long"), F.lit(0).cast("long"))


def _out(audit: str) -> Column:
    return F.translate(audit, "JSd", "IRD").alias("audit")


def _small(turns: DataFrame) -> DataFrame:
    again = F.row_number().over(Window.partitionBy("conv_id", "block", "role", "text").orderBy(F.asc_nulls_first("turn"))) > 1
    rows = turns.withColumns({"block": F.lit(0), "n": F.lit(1).cast("long")}).repartition("conv_id").withColumn("again", again)
    found = _flagged(rows).withColumn("best", _end(_fold(F.col("rows"), 0))).withColumns({"cost": F.col("best.cost"), "edits": F.col("best.audit")})
    made = _repaired(F.col("rows"), F.regexp_extract_all("edits", F.lit(_EDIT), F.lit(0)), F.regexp_extract("edits", _TAIL, 1))
    return found.select("conv_id", "block", F.lit(1).alias("blocks"), _gaps("low", "high", "turns").alias("gaps"), *_COUNTS, "cost", _out("edits"), made.alias("turns"))


def _same(a: DataFrame, b: DataFrame, *columns: str) -> Column:
    found = F.lit(True)
    for c in columns:
        found = found & a[c].eqNullSafe(b[c])
    return found


def _large(turns: DataFrame, blocks: int) -> DataFrame:
    """The same for conversations of any size. Copies are counted first, then the order of all turns is cut into blocks by
    range; each block is folded from each of the four states, and the blocks of a conversation are joined in order."""
    copies = turns.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    copies = stored(copies, "copies")
    first = copies.groupBy(*(F.col(c).alias(f"{c}_") for c in ("conv_id", "role", "text"))).agg(F.min(F.struct("turn")).alias("first"))
    known = F.col("conv_id").eqNullSafe(F.col("conv_id_")) & (F.col("role") == F.col("role_")) & (F.col("text") == F.col("text_"))
    rows = copies.join(first, known).select("conv_id", "turn", "role", "text", "n", (~F.struct("turn").eqNullSafe(F.col("first"))).alias("again"))
    rows = rows.repartitionByRange(blocks, F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text").withColumn("block", F.spark_partition_id())
    found = _flagged(stored(rows, "turns")).withColumn("through", F.array(*(_fold(F.col("rows"), s) for s in range(4))))
    found = stored(found, "blocks")
    end = lambda at: F.element_at("rows", at)["initial"].alias("initial")
    facts = F.struct("block", "low", "high", *(F.col(c) for c in ("turns", *_COUNTS)), "through", end(1).alias("head"), end(-1).alias("foot"), F.size("rows").alias("size"))
    whole = found.groupBy("conv_id").agg(F.array_sort(F.collect_list(facts)).alias("b"), F.min("low").alias("low"), F.max("high").alias("high"))

    def sums(b: Column) -> Column:
        zero = F.struct(F.lit(None).cast("long").alias("high"), F.lit("").alias("foot"), *(F.lit(0).cast("long").alias(c) for c in ("turns", *_COUNTS)))
        crossing = lambda s, x: ((s["foot"] != "") & ~F.concat(s["foot"], x["head"]).isin("su", "ua", "au")).cast("long")
        more = {c: lambda s, x, c=c: s[c] + x[c] for c in _COUNTS} | {"turns": lambda s, x: s["turns"] + x["turns"] - s["high"].eqNullSafe(x["low"]).cast("long") * x["low"].isNotNull().cast("long"), "illegal": lambda s, x: s["illegal"] + x["illegal"] + crossing(s, x)}
        return F.aggregate(b, zero, lambda s, x: F.struct(F.coalesce(x["high"], s["high"]).alias("high"), x["foot"].alias("foot"), *(more[c](s, x).alias(c) for c in ("turns", *_COUNTS))))

    whole = whole.withColumns({"sums": sums(F.col("b")), "best": _end(F.aggregate("b", _start(0), _joined))})
    whole = whole.select("conv_id", "b.block", "b.size", "low", "high", "sums.turns", *(f"sums.{c}" for c in _COUNTS), "best.cost", F.col("best.audit").alias("edits"))
    before = F.transform("size", lambda _, i: F.aggregate(F.slice("size", F.lit(1), i), F.lit(0), lambda a, x: a + x))
    each = F.transform(F.arrays_zip("block", "size", before.alias("before")), lambda x: F.struct(x["block"].alias("block"), F.slice(F.regexp_extract_all("edits", F.lit(_EDIT), F.lit(0)), x["before"] + 1, x["size"]).alias("mine")))
    parts = whole.select("*", F.size("block").alias("blocks"), F.posexplode(each).alias("nth", "part"))
    parts = parts.select(F.col("conv_id").alias("id"), "blocks", "nth", F.col("part.block").alias("of"), "part.mine", _gaps("low", "high", "turns").alias("gaps"), *(F.col(c).alias(f"{c}_") for c in (*_COUNTS, "cost")), "edits")
    tail = F.when(F.col("nth") == F.col("blocks") - 1, F.regexp_extract("edits", _TAIL, 1)).otherwise("")
    texts = found.select("conv_id", "block", "rows").join(parts, F.col("conv_id").eqNullSafe(F.col("id")) & (F.col("block") == F.col("of")))
    return texts.select("conv_id", F.col("nth").alias("block"), "blocks", "gaps", *(F.col(f"{c}_").alias(c) for c in (*_COUNTS, "cost")), _out("edits"), _repaired(F.col("rows"), F.col("mine"), tail).alias("turns"))


def repair(turns: DataFrame, block_turns: int = BLOCK_TURNS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """conv_id, block, blocks, gaps, blank, duplicate, truncated, illegal, cost, audit and turns, the repaired ones, from rows
    of conv_id, turn, role and text.

    A conversation gives one row; one of more than `block_turns` turns or `block_bytes` bytes of text gives one for each of
    its blocks, with the block's turns and all else of the whole conversation. Turns are taken by number, null first, then
    by role and text; a repeated row is a duplicate. Null roles and texts are one space: no valid role, a blank text. A role
    without a letter can't be kept, only deleted or changed. A null conv_id is a conversation like any other; a gap beyond
    a long is 0. Other columns aren't read; an empty table gives no rows.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    turns = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role"), space("text"))
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    large = stored(sizes.where((F.col("n") > block_turns) | (F.col("bytes") > block_bytes)), "large")
    n, size = large.agg(F.sum("n"), F.sum("bytes")).first()
    if not n:
        return _small(turns)
    small, rest = (turns.join(large, turns.conv_id.eqNullSafe(large.conv_id), how).select(turns["*"]) for how in ("left_anti", "left_semi"))
    return _small(small).unionByName(_large(rest, 1 + max(n // block_turns, size // block_bytes)))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows of conversations with faults put in by crc32(conv_id:turn) % 20: 0 drops one, 1 empties its text, 2 takes its
    sentence marks, 3 repeats it, 4 makes its role user. Nulls are one space, also in the key."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    rows = rows.withColumns({
        "text": F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")),
        "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role")),
    })
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("_")).drop("_")


def digests(repaired: DataFrame) -> DataFrame:
    """The rows of repair() without turns, one for each conversation, with repaired_sha256: of role:text, newline-joined. A
    conversation of several blocks is streamed block by block, since a digest is made in order; no task holds it whole."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    keep = [c for c in repaired.columns if c not in ("turns", "block", "blocks")]
    one = repaired.where("blocks = 1").select(*keep, F.sha2(lines, 256).alias("repaired_sha256"))
    many = repaired.where("blocks > 1").select(*keep, "block", "blocks", (F.size("turns") > 0).alias("some"), lines.alias("lines"))
    names = [*keep, "repaired_sha256"]

    def run(batches):
        made, filled = hashlib.sha256(), False
        for batch in batches:
            for i, (block, blocks, some, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("block", "blocks", "some", "lines")))):
                if block == 0:
                    made, filled = hashlib.sha256(), False
                if some:
                    made.update((("\n" if filled else "") + text).encode())
                    filled = True
                if block == blocks - 1:
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, 1) for c in keep), pa.array([made.hexdigest()])], names)

    return one.unionByName(many.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(run, one.schema))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    found = digests(repair(damaged(conversations)))
    ids = conversations.select(F.col("conv_id").alias("id")).distinct()
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", *_COUNTS, "cost")]
    return ids.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left").select(F.col("id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op11_sql() -> str:
    """The same in DuckDB: crc32 bit by bit, and the states as rows of a recursive query, of which each step keeps the best."""
    return r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
bits AS (SELECT *, list_prepend(4294967295, list_transform(range(8 * length(k)), lambda i: CASE WHEN i % 8 = 0 THEN ord(substr(k, CAST(i // 8 + 1 AS BIGINT), 1))::BIGINT ELSE 0 END)) AS b FROM keyed),
kinds AS (SELECT conv_id, turn, role, text, xor(list_reduce(b, lambda c, x: xor(xor(c, x) >> 1, (xor(c, x) & 1) * 3988292384)), 4294967295) % 20 AS kind FROM bits),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kinds, range(CASE WHEN kind = 3 THEN 2 ELSE 1 END) WHERE kind <> 0),
ordered AS (
  SELECT *, row_number() OVER w AS i, lag(role[1]) OVER w AS before
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
faults AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, role[1] AS c,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut FROM ordered),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
    count(*) FILTER (cut AND NOT again AND NOT blank) AS truncated, count(*) FILTER (before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM faults GROUP BY conv_id),
ins(f, g, more, price, lines) AS (VALUES (0, 0, '', 0, ''), (1, 1, '', 0, ''), (2, 2, '', 0, ''), (3, 3, '', 0, ''), (0, 2, 'I', 2, 'user:' || chr(10)), (1, 2, 'I', 2, 'user:' || chr(10)),
  (3, 2, 'I', 2, 'user:' || chr(10)), (2, 3, 'I', 2, 'assistant:' || chr(10)), (0, 3, 'II', 4, 'user:' || chr(10) || 'assistant:' || chr(10)), (1, 3, 'II', 4, 'user:' || chr(10) || 'assistant:' || chr(10))),
edit(e, t, act, needs) AS (VALUES (0, 0, 'D', NULL), (1, 1, 'D', NULL), (2, 2, 'D', NULL), (3, 3, 'D', NULL), (0, 1, 'K', 's'), (0, 2, 'K', 'u'), (1, 2, 'K', 'u'), (3, 2, 'K', 'u'), (2, 3, 'K', 'a'),
  (0, 2, 'R', NULL), (1, 2, 'R', NULL), (3, 2, 'R', NULL), (2, 3, 'R', NULL)),
steps AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS state, 0 AS cost, '' AS audit, '' AS made FROM counts
  UNION ALL
  SELECT p.conv_id, p.i + 1, t, p.cost + price + CASE act WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN act <> 'D' AND cut THEN 1 ELSE 0 END, p.audit || more || act,
    p.made || lines || CASE act WHEN 'D' THEN '' WHEN 'K' THEN role || ':' || text || chr(10) ELSE CASE t WHEN 2 THEN 'user' ELSE 'assistant' END || ':' || text || chr(10) END
  FROM steps p JOIN faults r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1 JOIN ins ON ins.f = p.state JOIN edit ON edit.e = ins.g
  WHERE (act = 'D' OR NOT (blank OR again)) AND (needs IS NULL OR needs = c)
  QUALIFY row_number() OVER (PARTITION BY p.conv_id, t ORDER BY p.cost + price + CASE act WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN act <> 'D' AND cut THEN 1 ELSE 0 END, p.audit || more || act) = 1),
best AS (
  SELECT s.conv_id, gaps, blank, duplicate, truncated, illegal, s.cost + price AS cost, s.audit || more AS audit, s.made || lines AS made
  FROM steps s JOIN counts c ON c.conv_id IS NOT DISTINCT FROM s.conv_id JOIN ins ON ins.f = s.state WHERE s.i = n AND g IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY s.conv_id ORDER BY s.cost + price, s.audit || more) = 1)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(CAST(cost AS BIGINT), 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(CASE WHEN made = '' THEN '' ELSE left(made, length(made) - 1) END, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM a.conv_id"""
