"""Conversation structure repair: faults of turns, least edits to a legal alternation, and the repaired rows.

A legal conversation's role initials read (s?(ua)+)?: nothing, or an optional system turn and pairs of user and
assistant. Edits of a turn: keep (K, 0), rerole to user or assistant (R, 3), delete (D, 4; blank and repeated turns must
go); an empty user or assistant turn can be inserted anywhere (I, 3), and a truncated turn that stays adds 3.

The grammar has four states, so the states from which the rest of a conversation can be completed at a cost are four
bits. A turn's word packs these sets for all costs, one layer of four bits each: its least cost is a base, and the layers
up to ten above it, since from any state any other is at most ten dearer. A turn's edits move all layers of the next
turn's word at once by shifts and masks, from the last turn to the first. The first layer of the first word that holds
the start gives the cost; a walk over the words' bits, which takes the least letter that still completes at the
remaining cost, gives the least audit. Words are few, so steps between them are looked up.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oddsmith.llm.common import materialize

#: Fixed values of the contract: costs of edits, and what is a blank character (for rtrim and rlike).
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
START, SYSTEM, USER, ASSISTANT = range(4)
LEGAL_PAIRS = ("su", "ua", "au")

LAYERS = 11
_SPAN = 2 * LAYERS
_ONES = sum(1 << 4 * k for k in range(_SPAN))
_WINDOW = (1 << 4 * LAYERS) - 1
_FULL = (1 << 4 * _SPAN) - 1

#: Faults of a turn; of equal turns the repeated ones sort last.
CLEAN, BLANK, TRUNCATED_TURN, DUPLICATE = range(4)


def _before(word: int, initial: str) -> int:
    """States from which a turn of this initial leads into word, in every layer."""
    if initial == "s":
        return word >> SYSTEM & _ONES
    if initial == "u":
        into = word >> USER & _ONES
        return into << START | into << SYSTEM | into << ASSISTANT
    return (word >> ASSISTANT & _ONES) << USER if initial == "a" else 0


def _after(states: int, initial: str) -> int:
    """States after a turn of this initial, of a set of states."""
    if initial == "s":
        return (states & 1) << SYSTEM
    if initial == "u":
        return 1 << USER if states & (1 << START | 1 << SYSTEM | 1 << ASSISTANT) else 0
    return 1 << ASSISTANT if initial == "a" and states & 1 << USER else 0


def _with_inserts(word: int) -> int:
    for _ in range(2):  # no more than two are of use
        word |= (_before(word, "u") | _before(word, "a")) << 4 * INSERT & _FULL
    return word


def _normal(word: int) -> tuple[int, int]:
    """The word from its first layer on, and the layers left out."""
    skipped = ((word & -word).bit_length() - 1) // 4
    return word >> 4 * skipped & _WINDOW, skipped


#: Of the end of a conversation, where nothing and a closed pair are legal; it needs no base.
_END = _normal(_with_inserts(_ONES * (1 << START | 1 << ASSISTANT)))[0]


class Layers:
    """The words of a conversation's turns, last to first; steps between words are kept."""

    def __init__(self) -> None:
        self.words, self.number, self.steps = [_END], {_END: 0}, {}

    def step(self, after: int, turn: tuple[str, int]) -> tuple[int, int]:
        """(word number, cost of its first layer above that of the next turn's)"""
        found = self.steps.get((after, turn))
        if found is None:
            initial, fault = turn
            word = self.words[after] | _FULL & ~_WINDOW
            here = word << 4 * DELETE
            if fault not in (BLANK, DUPLICATE):
                own = TRUNCATED if fault == TRUNCATED_TURN else 0
                here |= _before(word, initial) << 4 * own
                here |= (_before(word, "u") | _before(word, "a")) << 4 * (REROLE + own)
            word, above = _normal(_with_inserts(here & _FULL))
            if word not in self.number:
                self.number[word] = len(self.words)
                self.words.append(word)
            found = self.steps[after, turn] = self.number[word], above
        return found

    def repair(self, turns: list[tuple[str, int]]) -> tuple[int, str]:
        """(cost, least audit) of turns, each (initial, fault)."""
        numbers, bases = array("L", [0]), array("q", [0])
        for turn in reversed(turns):
            number, above = self.step(numbers[-1], turn)
            numbers.append(number)
            bases.append(bases[-1] + above)
        numbers.reverse()
        bases.reverse()

        def completing(at: int, cost: int) -> int:
            layer = cost - bases[at]
            return 0 if layer < 0 else 15 if layer >= LAYERS else self.words[numbers[at]] >> 4 * layer & 15

        left = bases[0]
        while not completing(0, left) & 1:
            left += 1
        cost, at, states, audit = left, 0, 1, []
        while left or at < len(turns):
            initial, fault = turns[at] if at < len(turns) else ("", BLANK)
            own = TRUNCATED if fault == TRUNCATED_TURN else 0
            stepped = _after(states, "u") | _after(states, "a")
            options = [("I", INSERT, stepped, 0)]
            if at < len(turns):
                options.insert(0, ("D", DELETE, states, 1))
                if fault not in (BLANK, DUPLICATE):
                    options += [("K", own, _after(states, initial), 1), ("R", REROLE + own, stepped, 1)]
            for letter, price, then, moved in options:  # in ASCII order
                if kept := then and completing(at + moved, left - price) & then:
                    break
            audit.append(letter)
            at, left, states = at + moved, left - price, kept
        return cost, "".join(audit)


def _after_edit(state: int, letter: str, role: str) -> tuple[int, str]:
    """(state, role) of the turn that an edit other than D leaves."""
    if letter == "K":
        return {"s": SYSTEM, "u": USER}.get(role[:1], ASSISTANT), role
    return (ASSISTANT, "assistant") if state == USER else (USER, "user")


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, present): each row after the damage that CRC-32 of conv_id:turn modulo 20 names.

    0 drops it (present is then false: the conversation stays known), 1 empties the text, 2 takes out [.!?], 3 repeats
    the row, 4 sets the role user. A null conv_id or turn counts as a space in the key and stays null; null roles and texts
    become a space. Repeated rows are damaged alike; other columns are dropped.
    """
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    kind = F.crc32(F.concat_ws(":", named[0], named[1])) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    found = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), named[2].alias("role"), named[3].alias("text"), kind.alias("kind"))
    found = found.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "kind")
    return found.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select(
        "conv_id", "turn", "role", "text", (F.col("kind") != 0).alias("present")
    )


def judged(rows: DataFrame) -> DataFrame:
    """rows with digest of the text and each turn's first fault: blank, duplicate (role and text seen earlier), truncated."""
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "digest", "present").orderBy(F.col("turn").asc_nulls_first())) > 1
    trimmed = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(~F.col("wordy"), BLANK).when(again, DUPLICATE).when(~F.col("ended"), TRUNCATED_TURN).otherwise(CLEAN)
    narrow = rows.select("conv_id", "turn", "role", "digest", "present", (trimmed != "").alias("wordy"), F.substring(trimmed, -1, 1).isin(".", "!", "?").alias("ended"))
    return narrow.select("conv_id", "turn", "role", "digest", "present", fault.alias("fault"))


_AUDIT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _in_order(rows: DataFrame) -> DataFrame:
    """Conversations whole in one partition each, their turns in order."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.col("turn").asc_nulls_first(), "role", "digest", "fault")


def _runs(rows: Iterator[tuple]) -> Iterator[tuple[object, Iterator[tuple]]]:
    from itertools import groupby

    return groupby(rows, key=lambda r: r[0])


def _rows(batches: Iterator) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batches(rows: Iterator[tuple], schema, size: int = 4096) -> Iterator:
    """Rows as Arrow batches of at most `size` rows and about 8 MB of text."""
    import pyarrow as pa

    held, weight = [], 0

    def packed():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        weight += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= size or weight > 8 << 20:
            yield packed()
            held, weight = [], 0
    if held:
        yield packed()


def audits(faults: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), one row per conversation of judged rows.

    Turns pass in order through one task a conversation, which holds ten bytes a turn and no text.
    """
    id_type = faults.schema["conv_id"].dataType

    def each(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        layers = Layers()

        def found() -> Iterator[tuple]:
            for conv, rows in _runs(_rows(batches)):
                turns, seen, counts, illegal = [], [None, None, 0], [0, 0, 0, 0], 0
                for _, turn, role, fault in rows:
                    if fault < 0:
                        continue
                    initial = role[:1]
                    illegal += bool(turns) and turns[-1][0] + initial not in LEGAL_PAIRS
                    turns.append((initial, fault))
                    counts[fault] += 1
                    if turn is not None and turn != seen[1]:
                        seen = [turn if seen[0] is None else seen[0], turn, seen[2] + 1]
                gaps = seen[1] - seen[0] + 1 - seen[2] if seen[2] else 0
                yield (conv, gaps, counts[BLANK], counts[DUPLICATE], counts[TRUNCATED_TURN], illegal, *layers.repair(turns))

        kinds = [("conv_id", to_arrow_type(id_type)), *((x.split()[0], pa.int64()) for x in _AUDIT.split(", ")[:-1]), ("audit", pa.string())]
        yield from _batches(found(), pa.schema(kinds))

    narrow = faults.select("conv_id", "turn", "role", "digest", F.lit(1).alias("kind"), F.when(F.col("present"), F.col("fault")).otherwise(-1).alias("fault"))
    placed = _in_order(narrow).select("conv_id", "turn", "role", "fault")
    return placed.mapInArrow(each, f"conv_id {id_type.simpleString()}, {_AUDIT}")


def _edited(rows: DataFrame, found: DataFrame, output: str, make) -> DataFrame:
    """One shuffle of the texts: a conversation's audit comes first, then its turns in order; make turns both into rows."""
    heads = found.withColumn("kind", F.lit(0))
    turns = rows.where("present").withColumn("digest", F.unhex(F.sha2("text", 256))).select("conv_id", F.lit(1).alias("kind"), "turn", "role", "digest", "text")
    both = heads.unionByName(turns, allowMissingColumns=True).withColumn("fault", F.lit(0))
    names = ["conv_id", "turn", "role", "text", *(x.split()[0] for x in _AUDIT.split(", "))]
    placed = _in_order(both).select(*names)
    id_type = rows.schema["conv_id"].dataType

    def each(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = {"long": pa.int64(), "string": pa.string()}
        schema = pa.schema([("conv_id", to_arrow_type(id_type)), *((n, kinds[k]) for n, k in (x.split() for x in output.split(", ")))])

        def made() -> Iterator[tuple]:
            for conv, own in _runs(_rows(batches)):
                head = next(own)
                yield from make(conv, head[4:], _turns(head[-1], own))

        yield from _batches(made(), schema)

    return placed.mapInArrow(each, f"conv_id {id_type.simpleString()}, {output}")


def _turns(audit: str, rows: Iterator[tuple]) -> Iterator[tuple]:
    """(letter, turn, role, text) of every turn that the audit leaves, in order."""
    state = START
    for letter in audit:
        turn, role, text = (None, "", "") if letter == "I" else next(rows)[1:4]
        if letter != "D":
            state, role = _after_edit(state, letter, role)
            yield letter, turn, role, text


def _one_hash(conv: object, head: tuple, turns: Iterator[tuple]) -> Iterator[tuple]:
    total, first = hashlib.sha256(), True
    for _, _, role, text in turns:
        total.update(("" if first else "\n").encode() + f"{role}:{text}".encode())
        first = False
    yield (conv, *head, total.hexdigest())


def _each_turn(conv: object, head: tuple, turns: Iterator[tuple]) -> Iterator[tuple]:
    for position, (letter, turn, role, text) in enumerate(turns):
        yield conv, position, letter, turn, role, text


def _prepared(rows: DataFrame) -> DataFrame:
    text = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    present = F.col("present") if "present" in rows.columns else F.lit(True)
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *text, present.alias("present"))


def repaired_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, position, edit, turn, role, text): the repaired conversations; edit is K, R or I, turn is null for I.

    Takes (conv_id, turn, role, text), in turn order with null turns first; equal turns stand by role, then by the
    text's SHA-256. Null conv_ids are one conversation; null roles and texts are a space, which is blank. Texts may be of
    any length: one is held at a time, beside its Arrow batch. Repeated rows are duplicates; an empty table gives none;
    other columns are dropped. A column `present` of false marks a row that only makes its conversation known.
    """
    rows = materialize(_prepared(rows), "turns")
    return _edited(rows, audits(judged(rows)), "position long, edit string, turn long, role string, text string", _each_turn)


def repair_digests(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), a row per conversation.

    Rows are read as repaired_turns reads them. gaps is the turn numbers missing between the least and the greatest,
    null turns aside; blank, duplicate and truncated count turns by their first fault; illegal counts neighbours whose
    initials are not su, ua or au. The digest is SHA-256 of the repaired role:text lines. A conversation without present
    rows has zeros, an empty audit and the digest of nothing. An audit has a letter for each edit, and SHA-256 goes on from turn
    to turn, so a conversation passes through one task as a stream; only its audit is held.
    """
    rows = materialize(_prepared(rows), "turns")
    return _edited(rows, audits(judged(rows)), f"{_AUDIT}, repaired_sha256 string", _one_hash)
