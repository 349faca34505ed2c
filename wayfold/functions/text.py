"""Names, labels and clocks as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented letters and what they fold to.
ACCENTED, PLAIN = "àáâäãåçèéêëìíîïñòóôöõùúûüýÿß", "aaaaaaceeeeiiiinooooouuuuyys"
#: Words that stay small inside a name.
PARTICLES = "de du des d la le les l un une a au aux et en sur sous lez van der den op ten ter t ver".split()
#: Words that announce a box number, and how long one may be.
BOX_WORDS, BOX_LENGTH = ("bus", "bte", "boite", "b"), 5


def fold(s: Column) -> Column:
    return F.translate(F.lower(s), ACCENTED, PLAIN)


def normalise(s: Column) -> Column:
    """Small letters and digits without accents, single spaces between."""
    return F.trim(F.regexp_replace(fold(s), "[^a-z0-9]+", " "))


def tokens(s: Column) -> Column:
    return F.filter(F.split(normalise(s), " "), lambda t: t != "")


def name_key(s: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(s, r"\s+", " ")))


def name_score(name: Column, query: Column) -> Column:
    """4 equal, 3 prefix, 2 prefix of a word, 1 inside, 0 otherwise, on normalised texts."""
    n, q = normalise(name), normalise(query)
    return F.when(q == "", 0).when(n == q, 4).when(n.startswith(q), 3).when(F.concat(F.lit(" "), n).contains(F.concat(F.lit(" "), q)), 2).when(n.contains(q), 1).otherwise(0)


def harmonise(name: Column) -> Column:
    """Names without small letters get capitals at word starts; particles after the first word stay small, Roman numerals large."""

    def part(p: Column) -> Column:
        roman = p.rlike("^(?i)[IVXLCDM]{2,}$")
        return F.when(roman, F.upper(p)).otherwise(F.concat(F.regexp_extract(p, r"^(?U)[^\p{L}]*", 0), F.upper(F.regexp_extract(p, r"^(?U)[^\p{L}]*(\p{L}?)", 1)), F.lower(F.regexp_extract(p, r"^(?U)[^\p{L}]*\p{L}?(.*)$", 1))))

    def word(w: Column, i: Column) -> Column:
        small = F.lower(w).isin(*PARTICLES) & (i > 0)
        cut = F.split(w, r"(?<=[-'])|(?=[-'])")
        return F.when(small, F.lower(w)).otherwise(F.array_join(F.transform(cut, lambda p: F.when(p.isin("-", "'"), p).otherwise(part(p))), ""))

    words = F.filter(F.split(name, r"\s+"), lambda w: w != "")
    return F.when(name.rlike("[a-z]"), name).otherwise(F.array_join(F.transform(words, word), " "))


def box_value(token: Column) -> Column:
    """The letters and digits of a token where they make a box number: digits, or a letter and digits, at most five; else null."""
    clean = F.regexp_replace(token, "[^A-Za-z0-9]", "")
    return F.when(clean.rlike(r"^(?:[0-9]{1,5}|[A-Za-z][0-9]{0,4})$"), clean)


def same_box(label: Column, asked: Column) -> Column:
    a = normalise(label)
    return (a == asked) | (a.rlike("^[0-9]+$") & asked.rlike("^[0-9]+$") & (F.ltrim(a, F.lit("0")) == F.ltrim(asked, F.lit("0"))))


def box_reference(query: Column) -> Column:
    """(rest, box): the first marker after a house number that gives a box number, with its value taken out; box is null without one.

    A marker is a slash, or a box word, alone before the value or joined to it.
    """
    raw = F.filter(F.split(query, r"\s+"), lambda t: t != "")
    folded = F.transform(raw, fold)
    after = lambda i: box_value(F.get(folded, i + 1))
    joined = f"^(?:/|{'|'.join(BOX_WORDS)})(.+)$"

    def hit(t: Column, i: Column) -> Column:
        house = F.exists(F.slice(folded, 1, i), lambda x: x.rlike("^[0-9]"))
        word = F.regexp_replace(t, "[:.]+$", "")
        alone = word.isin(*BOX_WORDS) | (t.startswith("/") & (F.regexp_replace(t, "[^a-z0-9]", "") == ""))
        value = F.when(alone, after(i)).when(t.rlike(joined), F.coalesce(box_value(F.regexp_extract(t, f"^(?:/|{'|'.join(BOX_WORDS[:3])})(.+)$", 1)), F.when(~t.startswith("/"), box_value(F.regexp_extract(t, "^b(.+)$", 1)))))
        return F.struct(i.alias("at"), F.when(alone, 2).otherwise(1).alias("n"), F.when(house & (i > 0), value).alias("box"))

    first = F.get(F.filter(F.transform(folded, hit), lambda h: h["box"].isNotNull()), F.lit(0))
    rest = F.array_join(F.filter(raw, lambda t, i: (i < first["at"]) | (i >= first["at"] + first["n"])), " ")
    return F.struct(F.when(first.isNull(), query).otherwise(rest).alias("rest"), first["box"].alias("box"))


def clock(seconds: Column) -> Column:
    """HH:MM:SS; hours run on past 24."""
    s = seconds.cast("int")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("int"), F.floor(s % 3600 / 60).cast("int"), s % 60)


def colour(r: Column, g: Column, b: Column) -> Column:
    return F.lower(F.concat(F.lit("#"), *[F.lpad(F.hex(x.cast("long")), 2, "0") for x in (r, g, b)]))


def natural_key(short: Column) -> Column:
    """Sorts numbers by value and before other names."""
    number = short.rlike("^[0-9]+$")
    return F.struct(F.when(number, 0).otherwise(1).alias("kind"), F.when(number, short.cast("long")).otherwise(0).alias("number"), short.alias("name"))


def mode_rank(mode: Column) -> Column:
    return F.when(mode == "rail", 0).when(mode == "subway", 1).when(mode == "tram", 2).when(mode == "bus", 3).otherwise(4)


def parent_prefix(stop_id: Column) -> Column:
    return F.regexp_replace(stop_id, "_[^_]*$", "")


def agency_matches(name: Column, operator: Column) -> Column:
    upper = F.upper(name)
    return (upper == operator) | F.array_contains(F.split(upper, "[/ ]"), operator)


def is_express(short: Column, long: Column, names: list[str], prefixes: list[str]) -> Column:
    inside = [short.contains(n) | long.contains(n) for n in names]
    begins = [short.rlike(f"^{p}[0-9]") for p in prefixes]
    out = F.lit(False)
    for c in (*inside, *begins):
        out = out | c
    return out


def duration(seconds: Column) -> Column:
    minutes = F.floor(seconds / 60 + 0.5).cast("int")
    return F.when(minutes >= 60, F.format_string("%d h %02d", F.floor(minutes / 60).cast("int"), minutes % 60)).otherwise(F.format_string("%d min", minutes))
