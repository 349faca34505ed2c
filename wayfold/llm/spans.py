"""Spans of a text found and rewritten by built-in SQL functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A span: code points from start, end exclusive; rank orders the kinds.
SPAN = "struct<start:int,rank:int,kind:string,end:int>"
NONE = f"cast(array() as array<{SPAN}>)"


#: Items that one fold takes: what a fold appends to is copied at each step, so long arrays are folded a chunk at a time.
CHUNK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def folded(items: Column, zero: Column, state: str, step: Callable, emit: Callable, value: str) -> Column:
    """An array of emit(state, item) for each item, where step(state, item) is the next state; its work grows with the number of items, not with its square.

    state and value are SQL types. The states at the begin of the chunks come first, by folds
    that append nothing.
    """
    count = lambda a: F.greatest(F.floor((F.size(a) - 1) / CHUNK), F.lit(0)).cast("int")
    chunks = lambda a: F.transform(F.sequence(F.lit(0), count(a)), lambda k: F.slice(a, k * CHUNK + 1, CHUNK))

    def begin(parts: Column) -> Column:
        first = F.struct(zero.cast(state).alias("at"), F.expr(f"cast(array() as array<{state}>)").alias("seen"))
        return F.aggregate(parts, first, lambda acc, c: F.struct(F.aggregate(c, acc["at"], step).cast(state).alias("at"), F.array_append(acc["seen"], acc["at"]).alias("seen")), lambda acc: acc["seen"])

    def run(c: Column, at: Column) -> Column:
        first = F.struct(at.alias("at"), F.expr(f"cast(array() as array<{value}>)").alias("out"))
        return F.aggregate(c, first, lambda acc, x: F.struct(step(acc["at"], x).cast(state).alias("at"), F.array_append(acc["out"], emit(acc["at"], x).cast(value)).alias("out")), lambda acc: acc["out"])

    return let(items, lambda a: let(chunks(a), lambda parts: F.flatten(F.zip_with(parts, begin(parts), run))))


def places(text: Column, pattern: str, parts: list[Column], context: int = 0) -> Column:
    """Structs (start, found, p0...) of the leftmost matches that don't overlap; with context also before and after, so many characters to either side up to the next match.

    What lies between the matches gives their places: a start is the length of all that
    stands before it.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    around = (lambda g: [F.slice(g, 2, F.size(g)).alias("next")]) if context else (lambda g: [])
    zipped = let(gaps, lambda g: F.arrays_zip(g.alias("gap"), matches.alias("found"), *parts, *around(g)))
    names = ["found", *(f"p{i}" for i in range(len(parts)))]
    value = "struct<start:int," + ",".join(f"{n}:string" for n in names) + (",before:string,after:string" if context else "") + ">"

    def emit(at: Column, x: Column) -> Column:
        sides = [F.right(x["gap"], F.lit(context)).alias("before"), F.left(x["next"], F.lit(context)).alias("after")] if context else []
        return F.struct((at + F.length(x["gap"])).alias("start"), *[x[n].alias(n) for n in names], *sides)

    all_of = folded(zipped, F.lit(0), "int", lambda at, x: at + F.length(x["gap"]) + F.coalesce(F.length(x["found"]), F.lit(0)), emit, value)
    return F.filter(all_of, lambda m: m["found"].isNotNull())


def spans(text: Column, pattern: str, kind: str, rank: int, keep=None, group: int | None = None, quick: Column | None = None) -> Column:
    """Spans of the leftmost matches of pattern that don't overlap.

    keep takes the match and, if a group is named, that group's text; what fails is dropped
    and not tried again. quick is a cheap test that every text with a match passes.
    """
    parts = [] if group is None else [F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("p0")]
    found = places(text, pattern, parts)
    if keep is not None:
        found = F.filter(found, (lambda x: keep(x["found"])) if group is None else (lambda x: keep(x["found"], x["p0"])))
    made = F.transform(
        found,
        lambda x: F.struct(
            x["start"].cast("int").alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (x["start"] + F.length(x["found"])).cast("int").alias("end")
        ),
    ).cast(f"array<{SPAN}>")
    has = text.rlike(pattern) if quick is None else quick & text.rlike(pattern)
    return F.when(has, made).otherwise(F.expr(NONE))


def in_order(*lists: Column) -> Column:
    """All spans by start, then by the rank of their kind."""
    return F.array_sort(F.concat(*lists))


def written(found: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")


def _replaced(text: Column, found: Column, instead: Callable[[Column], Column]) -> Column:
    """The text with instead(span) in place of each span that begins after all before it have ended; what overlaps the one before goes with it.

    A chunk of spans looks at its own part of the text, as a place in a text is found by
    counting from its begin.
    """
    ordered = F.array_sort(found)
    step = lambda at, s: F.greatest(at, s["end"])
    emit = lambda at, s: F.when(s["start"] >= at, F.struct(at.alias("from"), s["start"].alias("to"), instead(s).alias("text")))
    pieces = F.filter(folded(ordered, F.lit(0), "int", step, emit, "struct<from:int,to:int,text:string>"), lambda p: p.isNotNull())

    def written_out(all_pieces: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_pieces) - 1) / CHUNK).cast("int")), lambda k: F.slice(all_pieces, k * CHUNK + 1, CHUNK))

        def of(chunk: Column) -> Column:
            base, last = chunk[0]["from"], F.element_at(chunk, -1)["to"]
            return let(F.substring(text, base + 1, last - base), lambda part: F.array_join(F.transform(chunk, lambda p: F.concat(F.substring(part, p["from"] - base + 1, p["to"] - p["from"]), p["text"])), ""))

        return F.array_join(F.transform(chunks, of), "")

    end = F.array_max(F.transform(found, lambda s: s["end"]))
    return F.when(F.size(found) > 0, F.concat(let(pieces, written_out), F.substring(text, end + 1, F.length(text)))).otherwise(text)


def rewritten(text: Column, found: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, named after the first."""
    return _replaced(text, found, lambda s: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))


def blanked(text: Column, found: Column) -> Column:
    """The text with NUL characters in place of each span, which must not overlap; places stay as they are."""
    return _replaced(text, found, lambda s: F.repeat(F.lit("\0"), s["end"] - s["start"]))
