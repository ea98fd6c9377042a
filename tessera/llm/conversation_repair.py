"""Conversation structure repair by error-correcting Earley parsing.

A conversation should read `(s?(ua)+)?` in its roles' initials: C -> (empty) | T, T -> T user assistant | H user assistant,
H -> (empty) | system. Error productions carry weights: a row is kept for nothing where its role's initial is the terminal,
reroled to user or assistant for 1, deleted for 2, and an empty user or assistant row is inserted for 5; a truncated row that stays costs 5
more, a blank or duplicate one must be deleted. Chart items hold the least (cost, audit), the audit being the initials of the edits so far;
items of equal cost that consumed the same rows never have audits of which one begins the other, so the least may be kept item by item. As
the grammar is left-recursive, all items begin at row 0 and a chart set holds a fixed number of them.

Rows are sorted over the cluster by (conversation, turn, role, text), and `at` numbers them. A conversation's rows in one run of 512 numbers
are a chunk, parsed on its own: a chunk that begins a run may continue a conversation, so it is parsed from every item that can be open
there. The charts of a conversation's chunks are then joined in order, keeping the least (cost, audit) of each open item, and a chunk's
edits are settled as soon as all open items agree on it; so a conversation of any length is parsed in parallel and joined in a stream.
Edits meet their rows by `at` alone, a key that no two rows share.

Ties of turn go by role, then text; null turns come first. A null role or text is one space; a null conv_id is a conversation of its own.
Repeated rows are duplicates of the first. A role is judged by its first character. Very long texts are never split and only pass
through sorts and joins. Other columns are not read, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm.common import materialize

CHUNK_BITS = 9
NOT_SPACE = r"[^\x20\x09-\x0D]"
RULES = (("C", ()), ("C", ("T",)), ("T", ("T", "user", "assistant")), ("T", ("H", "user", "assistant")), ("H", ()), ("H", ("system",)))
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
#: Tokens of rows by role initial s, u, a, other: sound, truncated, to be deleted.
SOUND, TRUNCATED, DOOMED = "suao", "SUAO", "0123"

Item = tuple[int, int]  # a rule and the place of its dot
Chart = dict[Item, tuple[int, str, str]]  # least (cost, audit, role initials of the edits, '-' for a deletion)


def expected(item: Item) -> str | None:
    rule, dot = item
    return RULES[rule][1][dot] if dot < len(RULES[rule][1]) else None


START: Item = (RULES.index(("H", ("system",))), 0)  # nothing is read or only deleted
TURNS: Item = (RULES.index(("T", ("T", "user", "assistant"))), 1)  # as many turns as there are, all complete
#: Items that can be open between two rows: those that wait for a terminal.
OPEN: tuple[Item, ...] = tuple((r, d) for r, (_, right) in enumerate(RULES) for d, x in enumerate(right) if x.islower())


def close(chart: Chart) -> Chart:
    """Completion, the empty rules of predicted symbols, and insertions, until nothing gets cheaper."""
    agenda = list(chart)

    def offer(item: Item, weight: tuple[int, str, str]) -> None:
        if item not in chart or weight < chart[item]:
            chart[item] = weight
            agenda.append(item)

    while agenda:
        item = agenda.pop()
        cost, audit, roles = chart[item]
        wanted = expected(item)
        if item == START:  # H -> (empty)
            offer((RULES.index(("H", ())), 0), (cost, audit, roles))
        if wanted in ("user", "assistant"):
            offer((item[0], item[1] + 1), (cost + INSERT, audit + "I", roles + wanted[0]))
        if wanted is None:  # what waited at row 0 for this symbol moves on
            for r, (_, right) in enumerate(RULES):
                if right[:1] == (RULES[item[0]][0],):
                    offer((r, 1), (cost, audit, roles))
    return chart


def scan(chart: Chart, token: str) -> Chart:
    """The chart after one more row."""
    out: Chart = {}
    cut = CUT_OFF if token in TRUNCATED else 0

    def offer(item: Item, weight: tuple[int, str, str]) -> None:
        if item not in out or weight < out[item]:
            out[item] = weight

    for item, (cost, audit, roles) in chart.items():
        wanted = expected(item)
        if item in OPEN:
            offer(item, (cost + DELETE, audit + "D", roles + "-"))
        if token in DOOMED or item not in OPEN:
            continue
        after = (item[0], item[1] + 1)
        if wanted[0] == token.lower():
            offer(after, (cost + KEEP + cut, audit + "K", roles + wanted[0]))
        if wanted != "system":
            offer(after, (cost + REROLE + cut, audit + "R", roles + wanted[0]))
    return close(out)


@lru_cache(maxsize=20_000)
def parse(tokens: str, begin: Item) -> tuple[tuple[Item, tuple[int, str, str]], ...]:
    """Open items after the rows of `tokens`, if `begin` was open before them, each with its least (cost, audit, roles)."""
    chart = close({begin: (0, "", "")})
    for t in tokens:
        chart = scan(chart, t)
    return tuple((i, w) for i, w in chart.items() if i in OPEN)


def join_charts(chunks: Iterator[tuple[int, list[tuple[Item, Item, int, str, str]]]]) -> Iterator[tuple[int, int, str, str]]:
    """(chunk, cost, audit, roles) of the cheapest way through all chunks of a conversation, in order."""
    live: dict[Item, tuple[int, str]] = {START: (0, "")}  # cost, and the audit of what is not settled
    waiting: list[tuple[int, dict, dict]] = []

    def settled(n: int, end: Item) -> list[tuple[int, int, str, str]]:
        out = []
        for chunk, cells, back in reversed(waiting[:n]):
            out.append((chunk, *cells[back[end], end]))
            end = back[end]
        return out[::-1]

    for chunk, found in chunks:
        cells = {(a, b): (cost, audit, roles) for a, b, cost, audit, roles in found}
        best: dict[Item, tuple[int, str]] = {}
        back: dict[Item, Item] = {}
        for (a, b), (cost, audit, _) in cells.items():
            if a in live:
                way = live[a][0] + cost, live[a][1] + audit
                if b not in best or way < best[b]:
                    best[b], back[b] = way, a
        waiting.append((chunk, cells, back))
        live, ends = best, set(best)
        for n in range(len(waiting) - 1, 0, -1):
            ends = {waiting[n][2][e] for e in ends}
            if len(ends) == 1:
                done = settled(n, ends.pop())
                yield from done
                known = sum(len(d[2]) for d in done)
                live = {i: (c, audit[known:]) for i, (c, audit) in live.items()}
                del waiting[:n]
                break
    yield from settled(len(waiting), min((live[i], i) for i in (START, TURNS) if i in live)[1])


def sort_rows(rows: DataFrame) -> DataFrame:
    """conv_id, at (the order of all rows), turn, role, text and what the later steps ask of a row. Materialized."""
    r = rows.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    # rows alike in all four may lie in several ranges: any of them may be the first
    r = r.withColumn("spread", F.rand(1)).repartitionByRange(*order, "spread").sortWithinPartitions(*order)
    blank = ~F.col("text").rlike(NOT_SPACE)
    truncated = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    initial = F.substring("role", 1, 1)
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("o"))
    return materialize(r.select("conv_id", F.monotonically_increasing_id().alias("at"), "turn", "role", "text", kind.alias("kind"), blank.alias("blank"), truncated.alias("truncated"), F.unhex(F.sha2("text", 256)).alias("digest")), "turns")


def with_faults(turns: DataFrame) -> DataFrame:
    """conv_id, at, turn, fault (the first of blank, duplicate and truncated that a row has, or null) and token."""
    first = turns.groupBy("conv_id", "role", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("truncated"), "truncated")
    r = turns.select("conv_id", "at", "turn", "kind", "blank", "truncated").join(first, "at", "left").select("conv_id", "at", "turn", "kind", fault.alias("fault"))
    letters = F.when(F.col("fault").isin("blank", "duplicate"), F.lit(DOOMED)).when(F.col("fault").isNotNull(), TRUNCATED).otherwise(SOUND)
    return r.withColumn("token", F.substr(letters, F.expr(f"locate(kind, '{SOUND}')"), F.lit(1)))


def chunked(faults: DataFrame) -> DataFrame:
    """One row a chunk: its tokens in order (512 at most), its first row's number, and the counts that do not depend on repairs."""
    rows = faults.groupBy("conv_id", F.shiftright("at", CHUNK_BITS).alias("chunk"))
    fault = [F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")]
    one = rows.agg(F.min("at").alias("at"), F.array_sort(F.collect_list(F.struct("at", "token", "kind"))).alias("t"), *fault)
    return one.select("conv_id", "chunk", "at", F.array_join("t.token", "").alias("tokens"), F.array_join("t.kind", "").alias("kinds"), "blank", "duplicate", "truncated")


WAYS = "ways array<struct<a:int,b:int,cost:long,audit:string,roles:string>>"


def _parse_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()), ("roles", pa.string())]))
    for batch in batches:
        ways = []
        for at, tokens in zip(batch["at"].to_pylist(), batch["tokens"].to_pylist()):
            begins = range(len(OPEN)) if at % (1 << CHUNK_BITS) == 0 else (OPEN.index(START),)
            ways.append([{"a": a, "b": OPEN.index(b), "cost": w[0], "audit": w[1], "roles": w[2]} for a in begins for b, w in parse(tokens, OPEN[a])])
        yield pa.RecordBatch.from_arrays([batch["conv_id"], batch["chunk"], batch["at"], pa.array(ways, kind)], ["conv_id", "chunk", "at", "ways"])


def _runs(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b[c].to_pylist() for c in columns))


def choose_edits(chunks: DataFrame) -> DataFrame:
    """conv_id, chunk, at (of its first row), cost, audit and roles of each chunk's edits in the cheapest repair."""
    kind = chunks.schema["conv_id"].dataType.simpleString()
    parsed = chunks.select("conv_id", "chunk", "at", "tokens").mapInArrow(_parse_chunks, f"conv_id {kind}, chunk long, at long, {WAYS}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _runs(batches, "conv_id", "chunk", "at", "ways")
        ready: list[tuple] = []
        ahead = next(rows, None)
        while ahead is not None:
            conv, begins = ahead[0], {}

            def chunks_of() -> Iterator[tuple[int, list]]:
                nonlocal ahead
                while ahead is not None and ahead[0] == conv:
                    _, chunk, at, ways = ahead
                    begins[chunk] = at
                    yield chunk, [(OPEN[w["a"]], OPEN[w["b"]], w["cost"], w["audit"], w["roles"]) for w in ways]
                    ahead = next(rows, None)

            for chunk, cost, audit, roles in join_charts(chunks_of()):
                ready.append((conv, chunk, begins.pop(chunk), cost, audit, roles))
                if len(ready) >= 4096:
                    yield batch_of(ready)
                    ready = []
        if ready:
            yield batch_of(ready)

    ids, numbers, letters = to_arrow_type(chunks.schema["conv_id"].dataType), pa.int64(), pa.string()

    def batch_of(ready: list[tuple]) -> pa.RecordBatch:
        kinds = ids, numbers, numbers, numbers, letters, letters
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*ready), kinds)], ["conv_id", "chunk", "at", "cost", "audit", "roles"])

    return parsed.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(run, f"conv_id {kind}, chunk long, at long, cost long, audit string, roles string")


def summarize(chunks: DataFrame, edits: DataFrame, faults: DataFrame) -> DataFrame:
    """One row a conversation: gaps, blank, duplicate, truncated, illegal, cost and the whole audit."""
    turns = faults.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    legal = F.lit("(?=su|ua|au)")
    inside = (F.length("kinds") - 1 - F.regexp_count("kinds", legal)).cast("long")
    ends = F.struct("chunk", F.substring("kinds", 1, 1).alias("head"), F.substring("kinds", -1, 1).alias("tail"))
    counts = chunks.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")], F.sum(inside).alias("inside"), F.array_sort(F.collect_list(ends)).alias("ends"))
    between = F.expr("size(filter(transform(sequence(1, size(ends)), k -> if(k < size(ends), ends[k - 1].tail || ends[k].head, 'su')), p -> p not in ('su', 'ua', 'au')))")
    audits = edits.groupBy("conv_id").agg(F.sum("cost").alias("cost"), F.array_sort(F.collect_list(F.struct("chunk", "audit"))).alias("e"))
    audits = audits.select(F.col("conv_id").alias("c"), "cost", F.array_join("e.audit", "").alias("audit"))
    out = counts.join(turns.select(F.col("conv_id").alias("t"), F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps")), F.col("conv_id").eqNullSafe(F.col("t")))
    out = out.join(audits, F.col("conv_id").eqNullSafe(F.col("c")))
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", (F.col("inside") + between).alias("illegal"), "cost", "audit")


def _edit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each edit with the number of its row; an inserted row goes before that of the next row of the chunk, or after the last."""
    for b in batches:
        for conv, at, audit, roles in _runs([b], "conv_id", "at", "audit", "roles"):
            n, row, last = len(audit), at, at + len(audit) - audit.count("I") - 1
            ats, subs, sub = [], [], 0
            for e in audit:
                if e == "I":
                    ats.append(min(row, last))
                    subs.append(sub - 9 if row <= last else sub + 1)
                    sub += 1
                else:
                    ats.append(row)
                    subs.append(0)
                    row, sub = row + 1, 0
            yield pa.RecordBatch.from_arrays([pa.array([conv] * n, b.schema.field("conv_id").type), pa.array(ats, pa.int64()), pa.array(subs, pa.int32()), pa.array(list(audit), pa.string()), pa.array(list(roles), pa.string())], ["conv_id", "at", "sub", "edit", "initial"])


def apply_edits(turns: DataFrame, edits: DataFrame) -> DataFrame:
    """The repaired rows: conv_id, at and sub (their order), turn (null if inserted), edit, role and text."""
    kind = edits.schema["conv_id"].dataType.simpleString()
    each = edits.select("conv_id", "at", "audit", "roles").mapInArrow(_edit_rows, f"conv_id {kind}, at long, sub int, edit string, initial string").where("edit <> 'D'")
    named = F.when(F.col("initial") == "u", "user").otherwise("assistant")
    stay = each.where("edit <> 'I'").select("at", "sub", "edit", "initial").join(turns.select("conv_id", "at", "turn", "role", "text"), "at")
    stay = stay.select("conv_id", "at", "sub", "turn", "edit", F.when(F.col("edit") == "R", named).otherwise(F.col("role")).alias("role"), "text")
    new = each.where("edit = 'I'").select("conv_id", "at", "sub", F.lit(None).cast(turns.schema["turn"].dataType).alias("turn"), "edit", named.alias("role"), F.lit("").alias("text"))
    return stay.union(new)


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The summary of every conversation (`summarize`) and its repaired rows (`apply_edits`)."""
    turns = sort_rows(rows)
    faults = materialize(with_faults(turns), "faults")
    chunks = materialize(chunked(faults), "chunks")
    edits = materialize(choose_edits(chunks), "edits")
    return summarize(chunks, edits, faults), apply_edits(turns, edits)


def sha256_of(repaired: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of its `role:text` rows joined by newlines; conversations stream past, sorted, and none is held."""
    kind = repaired.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, done = None, None, []
        for b in batches:
            for c, role, text in _runs([b], "conv_id", "role", "text"):
                if state is None or c != conv:
                    if state is not None:
                        done.append((conv, state.hexdigest()))
                    conv, state = c, hashlib.sha256(f"{role}:{text}".encode())
                else:
                    state.update(f"\n{role}:{text}".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], b.schema.field("conv_id").type), pa.array([d[1] for d in done])], ["conv_id", "sha256"])
                done = []
            last = b.schema.field("conv_id").type
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], last), pa.array([state.hexdigest()])], ["conv_id", "sha256"])

    return repaired.select("conv_id", "at", "sub", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "at", "sub").mapInArrow(run, f"conv_id {kind}, sha256 string")
