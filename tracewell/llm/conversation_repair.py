"""Repair of conversation structure: least edits by dynamic programming over a trie of signatures.

A row's symbol joins its role (system, user, assistant or other, by initial) and its first fault (blank, duplicate, truncated or none); a conversation's
signature is its rows' symbols in order. Edits are keeping a row, giving it the role of a user or an assistant, deleting it, and inserting an empty turn;
the roles must come out as ``s?(ua)+`` or nothing. Costs depend on the signature alone, so signatures are sorted, and a task walks its
range of them as a prefix trie: the layers of costs along the present path are on a stack, a signature goes on from the last layer it shares with the one before, and at its end, a terminal node, the answer is read off.
Of edit lists of equal cost the one with the ASCII-least initials is taken: layers are marked backward from the end for the steps of some cheapest list, and from the start the least letter among these is followed. A step's letter tells its next
state, so initials name one list.

Ranges of signatures are cut with the conversation's id as second key, so one signature that a third of all conversations have is walked in many tasks. Rows travel twice: once narrow (hashes in place of texts) for faults and signatures, and once with their texts, sorted by conversation
and turn, for the digest of what is repaired. Both are streams: a task holds the symbols of one conversation, a byte or so a row, which its audit has as well, and never its texts. The digest of a conversation is one sequence, so one task reads it.

Defined cases: nulls in role and text, and in an id or a turn where these are hashed, are one space; a null conv_id is a conversation of its own; rows of equal turn go by role and a hash of the text, after the damage; a role is known by its first character alone, and an empty one has none;
conversations whose rows are all dropped keep their row of zeros; an empty table gives no rows; texts are taken whole; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

# fixed values: white space, ends of sentences, and what edits cost
BLANKS = "\t\n\x0b\x0c\r "
ENDS = ".!?"
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

# states: 0 before all, 1 after a system row, 2 after a user, 3 after an assistant; the end may stand in 0 and 3
CLASSES = "suao"  # system, user, assistant, other
GONE = 8  # the symbol of a row that must be deleted; others are class + 4 if truncated
KEEPS = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (3, 1): 2, (2, 2): 3}  # (state, class) -> state
SPOKEN = (2, 2, 3, 2)  # the state after a turn that is inserted or given the right role
NEVER = 1 << 60


def steps(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(initial, next state, cost) of the edits that use up a row of ``symbol``, by initial."""
    found = [("D", state, DELETE)]
    if symbol != GONE:
        more = TRUNCATED * (symbol >= 4)
        if (state, symbol % 4) in KEEPS:
            found.append(("K", KEEPS[state, symbol % 4], more))
        found.append(("R", SPOKEN[state], REROLE + more))
    return found


STEPS = [[steps(symbol, state) for state in range(4)] for symbol in range(9)]


def inserted(costs: list[int]) -> list[int]:
    """Costs after any insertions; two lead from any state to any that they can reach."""
    for _ in range(2):
        for state in range(4):
            costs[SPOKEN[state]] = min(costs[SPOKEN[state]], costs[state] + INSERT)
    return costs


def layer(before: list[int], symbol: int) -> list[int]:
    costs = [NEVER] * 4
    for state, known in enumerate(before):
        if known < NEVER:
            for _, to, more in STEPS[symbol][state]:
                costs[to] = min(costs[to], known + more)
    return inserted(costs)


FIRST = inserted([0, NEVER, NEVER, NEVER])


def answer(signature: bytes, layers: list[list[int]]) -> tuple[int, str]:
    """(least cost, ASCII-least initials) at a terminal node whose path has ``layers``."""
    n = len(signature)
    cost = min(layers[n][0], layers[n][3])
    marked = [0] * (n + 1)  # bits of states on some cheapest list
    marked[n] = sum(1 << s for s in (0, 3) if layers[n][s] == cost)
    for k in range(n, -1, -1):
        here, bits = layers[k], marked[k]
        for _ in range(2):
            for s in range(4):
                if bits >> SPOKEN[s] & 1 and here[s] + INSERT == here[SPOKEN[s]]:
                    bits |= 1 << s
        marked[k] = bits
        if k:
            table = STEPS[signature[k - 1]]
            marked[k - 1] = sum(1 << s for s, c in enumerate(layers[k - 1]) if c < NEVER and any(bits >> to & 1 and c + more == here[to] for _, to, more in table[s]))
    audit, state, k = [], 0, 0
    while True:
        here = layers[k][state]
        options = [(letter, to, k + 1) for letter, to, more in (STEPS[signature[k]][state] if k < n else ()) if marked[k + 1] >> to & 1 and here + more == layers[k + 1][to]]
        if marked[k] >> SPOKEN[state] & 1 and here + INSERT == layers[k][SPOKEN[state]]:
            options.append(("I", SPOKEN[state], k))
        if not options:
            return cost, "".join(audit)
        letter, state, k = min(options)
        audit.append(letter)


def walk(signatures: Iterator[bytes]) -> Iterator[tuple[int, str, int]]:
    """(cost, audit, layers computed) for each of sorted signatures, as one walk over their trie."""
    path, layers, last = b"", [FIRST], None
    for signature in signatures:
        made = 0
        if signature != path or last is None:
            shared, most = 0, min(len(path), len(signature))
            while shared < most and path[shared] == signature[shared]:
                shared += 1
            del layers[shared + 1 :]
            for symbol in signature[shared:]:
                layers.append(layer(layers[-1], symbol))
            made, path = len(signature) - shared, signature
            last = answer(signature, layers)
        yield *last, made


def damaged(rows: DataFrame, conv_id: Column, turn: Column) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) after the damage of a check: as often as they stand there then, with ``there`` false for one that is dropped."""
    space = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space(conv_id), F.lit(":"), space(turn)).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(space(F.col("text")), ENDS, "")).otherwise(space(F.col("text")))
    role = F.when(kind == 4, F.lit("user")).otherwise(space(F.col("role")))
    copies = F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select(conv_id.alias("conv_id"), turn.alias("turn"), role.alias("role"), text.alias("text"), (kind != 0).alias("there"), F.explode(copies).alias("copy")).drop("copy")


def ordered(*lead: str) -> list[Column]:
    return [*(F.col(c).asc_nulls_first() for c in lead), F.col("turn").asc_nulls_first(), F.col("role"), F.col("hash")]


def with_hash(rows: DataFrame) -> DataFrame:
    return rows.withColumn("hash", F.sha2(F.col("text").cast("binary"), 256))


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")


def conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, counts, signature) of each conversation of ``rows`` (conv_id, turn, role, text, there)."""
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    narrow = with_hash(rows).select("conv_id", "turn", F.col("role"), "there", "hash", (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(*ENDS)).alias("cut"))
    # both windows and the stream below are of one dealing of rows; equal rows of a conversation stand together in the first
    dealt = narrow.repartition("conv_id")
    again = F.row_number().over(Window.partitionBy("conv_id", "there", "role", "hash").orderBy(F.col("turn").asc_nulls_first())) > 1
    fault = F.when(~F.col("there"), -1).when(F.col("blank"), 1).when(again, 2).when(F.col("cut"), 3).otherwise(0)
    told = dealt.withColumn("fault", fault).withColumn("initial", F.substring("role", 1, 1)).sortWithinPartitions(*ordered("conv_id")).select("conv_id", "turn", "initial", "fault")
    kind = told.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, key, first = [], None, True
        counts, symbols = [0] * 5, bytearray()
        low = high = seen = None
        distinct, before = 0, None

        def row():
            gaps = high - low + 1 - distinct if distinct else 0
            return (key, gaps, *counts[1:], bytes(symbols))

        for batch in batches:
            for conv, turn, initial, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if first or conv != key:
                    if not first:
                        out.append(row())
                    key, first = conv, False
                    counts, symbols = [0] * 5, bytearray()
                    low = high = seen = before = None
                    distinct = 0
                if fault < 0:
                    continue
                if turn is not None and turn != seen:
                    low, high, seen, distinct = turn if low is None else low, turn, turn, distinct + 1
                if fault:
                    counts[fault] += 1
                if before is not None and before + initial not in ("su", "ua", "au"):
                    counts[4] += 1
                before = initial
                place = CLASSES.find(initial) if initial and initial in "sua" else 3
                symbols.append(GONE if fault in (1, 2) else place + 4 * (fault == 3))
            if len(out) > 1000:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema)
                out = []
        if not first:
            out.append(row())
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema)

    names = ["conv_id", *COUNTS, "signature"]
    schema = pa.schema([("conv_id", _arrow(kind)), *((c, pa.int64()) for c in COUNTS), ("signature", pa.binary())])
    return told.mapInArrow(run, f"conv_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", signature binary")


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def audited(found: DataFrame) -> DataFrame:
    """``found`` (conv_id, counts, signature) with cost and audit in place of signature."""
    kind = found.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", *COUNTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def signatures():
            for batch in batches:
                held.append(batch)
                yield from batch.column("signature").to_pylist()

        answers = []
        for cost, audit, _ in walk(signatures()):
            answers.append((cost, audit))
            if len(answers) == len(held[0]):
                batch = held.pop(0)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array([c for c, _ in answers], pa.int64()), pa.array([a for _, a in answers], pa.string())], names=[*names, "cost", "audit"])
                answers = []

    order = (F.col("signature"), F.col("conv_id").asc_nulls_first())
    return found.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, f"conv_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", cost long, audit string")


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """``audits`` with repaired_sha256: the edits applied to ``rows``, as a stream in which each conversation's audit comes before its rows."""
    kind = audits.schema["conv_id"].dataType.simpleString()
    kept = [*COUNTS, "cost", "audit"]
    heads = audits.select("conv_id", F.lit(0).alias("part"), *kept, *(F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"), ("hash", "string"))))
    body = with_hash(rows.where("there")).select("conv_id", F.lit(1).alias("part"), *(F.lit(None).cast("string" if c == "audit" else "long").alias(c) for c in kept), F.col("turn").cast("long").alias("turn"), "role", "text", "hash")
    stream = heads.unionByName(body).repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "part", *ordered()).select("conv_id", "part", *kept, "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = state = audit = at = None
        some = False

        def say(role: str, text: str) -> None:
            nonlocal some
            digest.update(f"{chr(10) if some else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            some = True

        def insertions() -> None:
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                state, at = SPOKEN[state], at + 1
                say("user" if state == 2 else "assistant", "")

        def finished() -> str:
            insertions()
            return digest.hexdigest()

        for batch in batches:
            heads, hashes = [], []
            for k, (part, found) in enumerate(zip(batch.column("part").to_pylist(), batch.column("audit").to_pylist(), strict=True)):
                if part == 0:
                    if digest is not None:
                        hashes.append(finished())
                        if len(hashes) > len(heads):  # of a conversation that began in an earlier batch
                            yield pa.RecordBatch.from_arrays([*carried, pa.array([hashes.pop()])], names=names)
                    digest, audit, at, state, some = hashlib.sha256(), found, 0, 0, False
                    heads.append(k)
                    continue
                insertions()
                letter, role, text = audit[at], batch.column("role")[k].as_py(), batch.column("text")[k].as_py()
                at += 1
                if letter == "K":
                    state = 1 if role[:1] == "s" else SPOKEN[state]
                    say(role, text)
                elif letter == "R":
                    state = SPOKEN[state]
                    say("user" if state == 2 else "assistant", text)
            if heads:
                done = pa.array(heads[: len(hashes)], pa.int64())
                if hashes:
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(done) for c in names[:-1]), pa.array(hashes)], names=names)
                carried = [batch.column(c).take(pa.array(heads[-1:], pa.int64())) for c in names[:-1]]
        if digest is not None:
            yield pa.RecordBatch.from_arrays([*carried, pa.array([finished()])], names=names)

    names = ["conv_id", *kept, "repaired_sha256"]
    return stream.mapInArrow(common.tidied(run), f"conv_id {kind}, " + ", ".join(f"{c} long" for c in (*COUNTS, "cost")) + ", audit string, repaired_sha256 string")


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, counts, cost, audit, repaired_sha256) of each conversation of ``rows`` (conv_id, turn, role, text, there)."""
    found = common.materialize(conversations(rows), "signatures")
    return repaired(rows, common.materialize(audited(found), "audits"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair(damaged(rows, F.col("conv_id"), F.col("turn")))
