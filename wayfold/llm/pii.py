"""Personal data: patterns that always count, and proposed spans that boosted trees accept.

Generators of high recall propose spans, each on its own, so that they overlap. Trees score
each by its format and by what stands before and after it; those over a threshold, calibrated
for its generator, are added to the spans of the base patterns. All of it runs as SQL
expressions; only the fit on a fixed, made-up set of sentences takes place where the driver is.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import Trees, fit
from .common import text_of
from .spans import NONE, SPAN, blanked, count_of, in_order, let, places, rewritten, spans, written

BASE_KINDS = ("email", "ip", "card", "phone")

#: The base patterns. A run of a class is always taken whole, so a match can only begin where a run does or where the last match ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: Generators of candidates: kind and pattern. They propose far more than they should redact, and each other's text again in other pieces.
GENERATORS = (
    ("number", r"(?<![A-Za-z0-9+.,-])\(?[0-9][0-9().\x20-]{5,22}[0-9](?![A-Za-z0-9])"),
    ("run", r"(?<![A-Za-z0-9])[0-9]{6,15}(?![A-Za-z0-9])"),
    ("mail", r"[A-Za-z0-9._%+-]{1,40}\x20?[(\[{](?i:at)[)\]}]\x20?[A-Za-z0-9-]{1,40}\x20?[(\[{](?i:dot)[)\]}]\x20?[A-Za-z]{2,20}"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("code", r"(?<![A-Za-z0-9])(?=[A-Z0-9-]{0,14}[A-Z])(?=[A-Z0-9-]{0,14}[0-9])[A-Z0-9][A-Z0-9-]{5,14}[A-Z0-9](?![A-Za-z0-9])"),
)
#: Cheap tests that every text with a candidate passes.
QUICK = (r"[0-9]{2}", r"[0-9]{6}", r"[(\[{](?i:at)[)\]}]", r"[A-Z]{2}[0-9]{2}", r"[A-Z][A-Z0-9-]{0,14}[0-9]|[0-9][A-Z0-9-]{0,14}[A-Z]")
#: Words before a candidate that speak for or against it, and what follows a plain quantity.
PHONE_WORDS = "phone|tel|telephone|call|mobile|cell|fax|reach|ring|dial|whatsapp|text|hotline|number"
ID_WORDS = "ssn|social|passport|licence|license|national|identity|id|tax|born|birth|patient|member|insurance|citizen"
BANK_WORDS = "iban|account|acct|bank|card|routing|sort|transfer|payee|pay|deposit"
OTHER_WORDS = "order|invoice|version|isbn|page|total|sum|population|item|part|row|line|ref|build|serial|date|year|model|score|ticket|batch|room|flight|article|section"
UNITS = "kg|km|m|cm|mm|g|eur|usd|euros|dollars|pages|items|people|units|times|percent|rows|bytes|ms|s|h|years"
CONTEXT = 28
#: Precision that the threshold of a generator must reach on the sentences kept for calibration.
PRECISION = 0.98


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether every second digit from the right, doubled and less 9 if over 9, and the others add up to a multiple of ten."""
    parts = F.filter(F.split(F.reverse(digits), ""), lambda d: d != "")
    doubled = F.transform(parts, lambda d, i: d.cast("int") * (1 + i % 2))
    return F.aggregate(doubled, F.lit(0), lambda total, v: total + v - F.when(v > 9, 9).otherwise(0)) % 10 == 0


def _card(found: Column) -> Column:
    digits = _digits(found)
    return F.length(digits).between(14, 19) & _luhn(digits)


def base_spans(text: Column) -> list[Column]:
    return [
        spans(text, EMAIL, "email", 0, quick=text.contains("@")),
        spans(text, IP, "ip", 1, keep=lambda found: F.forall(F.split(found, r"\."), lambda part: part.cast("double") <= 255)),
        spans(text, CARD, "card", 2, keep=_card),
        spans(text, PHONE, "phone", 3, keep=lambda found: F.length(_digits(found)).between(10, 15), quick=text.contains("+")),
    ]


def _features(c: Column) -> list[Column]:
    """Numbers on the format of a candidate (found) and on what stands before and after it."""
    found, before, after = c["found"], F.lower(c["before"]), F.lower(c["after"])
    groups = F.filter(F.split(found, "[^0-9]+"), lambda g: g != "")
    sizes = F.transform(groups, F.length)
    flag = lambda x: x.cast("double")
    word = lambda words: flag(before.rlike(f"(?<![a-z])(?:{words})(?![a-z])"))
    return [
        F.length(_digits(found)).cast("double"),
        F.length(found).cast("double"),
        F.size(groups).cast("double"),
        F.coalesce(F.array_max(sizes), F.lit(0)).cast("double"),
        F.coalesce(F.array_min(sizes), F.lit(0)).cast("double"),
        F.coalesce(F.get(sizes, F.lit(0)), F.lit(0)).cast("double"),
        F.coalesce(F.get(sizes, F.size(sizes) - 1), F.lit(0)).cast("double"),
        flag(found.contains("(")),
        flag(found.contains(".")),
        flag(found.contains("-")),
        flag(found.contains(" ")),
        flag(found.rlike(r"^\(?0")),
        flag(found.rlike("^(?:19|20)[0-9]{2}(?:[^0-9]|$)")),
        flag(found.rlike("[A-Z]")),
        flag(found.rlike("^[A-Z]{2}[0-9]{2}")),
        flag(found.rlike(r"^[^0-9]*[0-9]{3}[^0-9]+[0-9]{2}[^0-9]+[0-9]{4}$")),
        flag(found.rlike(r"\x20\x20|--|\.\.")),
        word(PHONE_WORDS),
        word(ID_WORDS),
        word(BANK_WORDS),
        word(OTHER_WORDS),
        flag(before.rlike(r"[$\u20ac\u00a3#/]\x20?$")),
        flag(before.rlike(r"[:=]\x20?$")),
        flag(before.rlike(r"(?:my|me|us|our|his|her|their|your|am|is|on|at)\x20$")),
        flag(before.rlike("[0-9]")),
        flag(after.rlike(rf"^\x20?(?:{UNITS})(?![a-z])")),
        flag(after.rlike("^[%/:]")),
        flag(after.rlike("[0-9]")),
    ]


def _sum(trees: Trees, values: Column) -> Column:
    """Log-odds as nested conditions on an array of features."""

    def branch(t: int, node: int) -> Column:
        inner = trees.feature.shape[1]
        if node >= inner:
            return F.lit(float(trees.leaf[t, node - inner]))
        if np.isinf(trees.threshold[t, node]):
            return branch(t, 2 * node + 1)
        return F.when(values[int(trees.feature[t, node])] > float(trees.threshold[t, node]), branch(t, 2 * node + 2)).otherwise(branch(t, 2 * node + 1))

    total = F.lit(trees.base)
    for t in range(len(trees.leaf)):
        total = total + branch(t, 0)
    return total


#: What made-up sentences are written with. The fit, the calibration and the test have words and turns of their own; the last two name what they hold in ways that the features don't list, too.
FIT, CALIBRATION, TEST = range(3)
_FILL = ("the was that ention herat und der que los sur with ander", "where then quite some over bonne nacht pero mucho again still", "maybe soon often garden window blue river stone paper chair")
_PHONE = (("phone {}", "tel: {}", "call {}", "mobile {}", "reach me at {}", "fax {}", "dial {}", "whatsapp {}"), ("ring {}", "telephone {}", "cell: {}", "text me on {}", "our hotline is {}", "you get me under {}"), ("phone us on {}", "their number: {}", "call him at {}", "try {} after six", "mobile no. {}", "she picks up at {}"))
_ID = (("ssn {}", "passport {}", "tax id {}", "licence {}", "born with id {}", "patient {}", "member no. {}"), ("social security: {}", "national number {}", "insurance {}", "my papers say {}"), ("license {}", "her ssn: {}", "passport no. {}", "identity card {}", "registered as {}"))
_BANK = (("iban {}", "account {}", "transfer to {}", "bank: {}"), ("pay to {}", "acct {}", "send it to {}"), ("deposit to {}", "my iban is {}", "payee account {}", "the money goes to {}"))
_OTHER = (("order {}", "invoice {}", "version {}", "isbn {}", "page {}", "total {}", "item {}", "build {}", "$ {}", "# {}", "{} kg", "{} people", "{}", "{}"), ("ref {}", "row {}", "serial {}", "sum {}", "ticket {}", "{} pages", "{} km", "{}", "see {}"), ("part {}", "model {}", "population {}", "score {}", "room {}", "batch {}", "{} units", "{} euros", "{}", "about {}"))


def _sentences(of: int, n: int = 2400, seed: int = 7) -> list[tuple[str, int, int]]:
    """Made-up sentences of one set: text, and begin and end of the personal data in it (0 and 0 for none)."""
    rng = np.random.default_rng(seed + of)
    pick = lambda xs: xs[rng.integers(len(xs))]
    num = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    letters = lambda k: "".join(chr(65 + c) for c in rng.integers(0, 26, k))
    fill = lambda: " ".join(pick(_FILL[of].split()) for _ in range(rng.integers(1, 7)))
    out = []
    for _ in range(n):
        sep = pick("- .")
        phone = pick([f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}{sep}{num(3)}{sep}{num(4)}", f"0{num(3)} {num(3)} {num(3)}", f"0{num(2)} {num(4)} {num(4)}", f"0{num(9)}", f"0{num(1)}.{num(2)}.{num(2)}.{num(2)}.{num(2)}"])
        ident = pick([f"{num(3)}-{num(2)}-{num(4)}", num(9), f"{num(2)}.{num(2)}.{num(2)}-{num(3)}.{num(2)}", f"{letters(2)}{num(7)}", f"{letters(1)}{num(8)}"])
        iban = f"{pick(['DE', 'FR', 'ES', 'GB', 'NL', 'BE'])}{num(2)}" + "".join(pick(["", " "]) + num(4) for _ in range(rng.integers(3, 6)))
        hidden = f"{pick(['anna', 'j.doe', 'info', 'k_lee'])} {pick(['(at)', '[at]', '{AT}'])} {pick(['mail', 'example', 'post'])} {pick(['(dot)', '[dot]'])} {pick(['com', 'org', 'de'])}"
        other = pick([num(8), f"{num(1)} {num(3)} {num(3)}", f"20{num(2)}-0{num(1)}-1{num(1)}", f"978-{num(1)}-{num(2)}-{num(6)}-{num(1)}", f"{num(3)}.{num(3)}.{num(2)}", f"{num(4)}-{num(5)}", num(int(rng.integers(7, 16))), f"{num(4)} {num(4)} {num(4)}", f"20{num(2)} 20{num(2)} {num(2)}", f"{letters(2)}{num(2)}-{letters(3)}{num(2)}", f"{letters(3)}-{num(5)}", phone, ident])
        value, turns = pick([(phone, _PHONE), (ident, _ID), (iban, _BANK), (hidden, _PHONE), (other, _OTHER), (other, _OTHER), (other, _OTHER)])
        before, after = pick(turns[of]).split("{}")
        head = f"{fill()} {before}"
        good = turns is not _OTHER
        out.append((f"{head}{value}{after} {fill()}", len(head) if good else 0, len(head) + len(value) if good else 0))
    return out


def _candidates(spark: SparkSession, of: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """which generator, features, whether it lies on personal data, and which sentence: of all candidates in a set of sentences."""
    rows = spark.createDataFrame([(k, *x) for k, x in enumerate(_sentences(of))], "k int, text string, a int, b int")
    found = rows.select("k", "a", "b", blanked_base(F.col("text")).alias("text"))
    out = []
    for g, (_, pattern) in enumerate(GENERATORS):
        each = found.select("k", "a", "b", F.explode(places(F.col("text"), pattern, [], CONTEXT)).alias("c"))
        inside = (F.col("c.start") < F.col("b")) & (F.col("c.start") + F.length("c.found") > F.col("a"))
        out += [(g, r["y"], r["k"], [float(g), *r["f"]]) for r in each.select("k", inside.cast("int").alias("y"), F.array(*_features(F.col("c"))).alias("f")).collect()]
    out.sort()
    return np.array([r[0] for r in out]), np.array([r[3] for r in out], float), np.array([r[1] for r in out], float), np.array([r[2] for r in out])


@functools.cache
def model(spark: SparkSession) -> tuple[Trees, tuple[float, ...]]:
    """The trees and the threshold of each generator, in log-odds.

    One set of made-up sentences fits the trees. Another one, of other words, calibrates: a
    generator's threshold is the lowest score from which on its candidates reach PRECISION.
    """
    _, x, y, _ = _candidates(spark, FIT)
    trees = fit(x, y, trees=20, depth=3, rate=0.3, least=2.0)
    which, x, y, _ = _candidates(spark, CALIBRATION)
    margin, limits = trees.margin(x), []
    for g in range(len(GENERATORS)):
        own = which == g
        order = np.argsort(-margin[own], kind="stable")
        m, right = margin[own][order], np.cumsum(y[own][order])
        whole = np.append(m[1:] < m[:-1], True)[: len(m)]  # equal scores stand or fall together
        fine = m[whole & (right >= PRECISION * np.arange(1, len(m) + 1))]
        limits.append(float(fine.min()) - 1e-9 if len(fine) else float("inf"))
    return trees, tuple(limits)


def measured(spark: SparkSession) -> tuple[float, float, float]:
    """On the third set of sentences: the share of accepted candidates that lie on personal data, the share of it that some accepted candidate lies on, and the share that some candidate lies on at all."""
    trees, limits = model(spark)
    which, x, y, k = _candidates(spark, TEST)
    taken = trees.margin(x) >= np.array(limits)[which]
    planted = sum(b > 0 for _, _, b in _sentences(TEST))
    return float(y[taken].mean()), len(set(k[taken & (y > 0)])) / planted, len(set(k[y > 0])) / planted


def blanked_base(text: Column) -> Column:
    """The text with the spans of the base patterns blanked out, so that no candidate touches one."""
    return let(in_order(*base_spans(text)), lambda base: blanked(text, base))


def proposed_spans(spark: SparkSession, text: Column) -> list[Column]:
    """Candidates that the trees accept, in a text whose base spans are blanked."""
    return [_accepted(spark, text, g) for g in range(len(GENERATORS))]


def _accepted(spark: SparkSession, text: Column, g: int) -> Column:
    (kind, pattern), (trees, limits) = GENERATORS[g], model(spark)

    def accept(c: Column) -> Column:
        return let(F.array(F.lit(float(g)), *_features(c)), lambda f: _sum(trees, f)) >= limits[g]

    def span(c: Column) -> Column:
        end = (c["start"] + F.length(c["found"])).cast("int")
        return F.struct(c["start"].cast("int").alias("start"), F.lit(len(BASE_KINDS) + g).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"))

    made = F.transform(F.filter(places(text, pattern, [], CONTEXT), accept), span).cast(f"array<{SPAN}>")
    digits = F.lit(True) if kind == "mail" else text.rlike("[0-9]")
    return F.when(digits & text.rlike(QUICK[g]) & text.rlike(pattern), made).otherwise(F.expr(NONE))


def span_column(spark: SparkSession, text: Column) -> Column:
    """All spans of a text in order: array of (start, rank, kind, end)."""
    base = in_order(*base_spans(text))

    def with_proposed(found: Column) -> Column:
        return let(blanked(text, found), lambda rest: in_order(found, *proposed_spans(spark, rest)))

    return let(base, with_proposed)


def find(docs: DataFrame, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """docs with a column of spans: array of (start, rank, kind, end) in code points, end exclusive.

    Null texts count as empty and have no spans. Repeated rows get the same spans. A column of
    docs that already has the name of spans_col is replaced; all others pass unchanged, whatever
    they are called. An empty table gives no rows.
    """
    return docs.withColumn(spans_col, span_column(docs.sparkSession, text_of(text_col)))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with each span of personal data replaced by its kind in brackets.

    Texts without any stay as they are, null and empty ones too; repeated rows are changed
    alike. All other columns pass unchanged, whatever they are called. An empty table gives no
    rows.
    """
    text = text_of(text_col)
    spans_of = span_column(docs.sparkSession, text)
    clean = let(spans_of, lambda found: F.when(F.size(found) > 0, rewritten(text, found)))
    return docs.withColumn(text_col, F.coalesce(clean, F.col(text_col)))


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, counts of the base kinds, the digest of the base spans, and all spans as text.

    Null texts count as empty: no spans, and the digest of no text. Rows that repeat get a row
    each, null ids stay, and an empty table gives no rows.
    """
    found = find(docs.select(id_col, text_col), text_col, "_spans").select(id_col, F.col("_spans").alias("spans"))
    base = F.filter("spans", lambda s: s["rank"] < len(BASE_KINDS))
    return found.select(
        id_col,
        *[count_of(F.col("spans"), kind).alias(f"n_{kind}") for kind in BASE_KINDS],
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )
