"""Secret scans: a ledger of findings by content address and rule version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_of
from .spans import SPAN, count_of, in_order, spans, written

#: The base rules (kind, pattern).
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"

#: Rules by version; a version's spans are those of all rules up to it.
BASE, EXTENDED = 1, 2
BASE_KINDS = ("assign", "access", "hex")


def _base(text: Column) -> list[Column]:
    """A whole run of letters or digits is one match, so the least lengths can stand in the patterns of access and hex."""
    return [
        spans(text, ASSIGN, "assign", 0, keep=lambda found, value: F.length(value) >= 6, group=1),
        spans(text, ACCESS, "access", 1, quick=text.contains("AKIA")),
        spans(text, HEX, "hex", 2),
    ]


def _extended(text: Column) -> list[Column]:
    """Spans that the method adds: forms that name themselves."""
    return [
        spans(text, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "pem", 3, quick=text.contains("PRIVATE KEY-----")),
        spans(text, r"gh[pousr]_[A-Za-z0-9]{36,}+", "forge", 4, quick=text.rlike("gh[pousr]_")),
        spans(text, r"xox[abpr]-[A-Za-z0-9-]{10,}+", "chat", 5, quick=text.contains("xox")),
        spans(text, r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", "jwt", 6, quick=text.contains("eyJ")),
    ]


RULES = {BASE: _base, EXTENDED: lambda text: [*_base(text), *_extended(text)]}


def blob_id(text: Column) -> Column:
    """The content address."""
    return F.unhex(F.sha2(text, 256))


def update_ledger(versions: DataFrame, ledger: DataFrame | None = None, rule_version: int = EXTENDED, text_col: str = "text") -> DataFrame:
    """The ledger (blob, rule_version, spans) with all blobs of versions scanned by rule_version.

    versions holds every historical version, one row per path and version. Only pairs of blob
    and rule version that the ledger lacks are scanned, each once however many paths carry it.
    Copies are dropped where they are read, so a blob of many copies sends one row per task.
    """
    blobs = versions.select(text_of(text_col).alias("_text")).select(blob_id(F.col("_text")).alias("blob"), "_text").groupBy("blob", "_text").agg(F.lit(1).alias("_one"))
    if ledger is not None:
        known = ledger.where(F.col("rule_version") == rule_version).select("blob")
        blobs = blobs.join(known, "blob", "left_anti")
    new = blobs.select("blob", F.lit(rule_version).alias("rule_version"), in_order(*RULES[rule_version](F.col("_text"))).alias("spans"))
    new = stored(new, "ledger")
    return new if ledger is None else ledger.unionByName(new)


def secret_scan(versions: DataFrame, ledger: DataFrame | None = None, rule_version: int = EXTENDED, text_col: str = "text") -> DataFrame:
    """versions with a column spans: array of (start, rank, kind, end) in code points, end exclusive.

    Null texts count as empty, and empty texts have no spans. Repeated rows get the same
    findings. Other columns pass unchanged; a column of versions named spans is replaced. An
    empty table gives no rows.
    """
    ledger = update_ledger(versions, ledger, rule_version, text_col)
    blob, found = "__blob_of_the_row__", "__spans_of_the_blob__"
    known = ledger.where((F.col("rule_version") == rule_version) & (F.size("spans") > 0)).select(F.col("blob").alias(found + "id"), F.col("spans").alias(found))
    rows = versions.drop("spans").withColumn(blob, blob_id(text_of(text_col)))
    return rows.join(known, F.col(blob) == F.col(found + "id"), "left").withColumn("spans", F.coalesce(found, F.expr(f"cast(array() as array<{SPAN}>)"))).drop(blob, found, found + "id")


def findings(versions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, counts of the base kinds, the digest of the base spans, and all spans as text.

    Null texts count as empty: no spans, and the digest of no text. Rows that repeat get a row
    each, null ids stay, and an empty table gives no rows.
    """
    scanned = secret_scan(versions.select(id_col, text_col), text_col=text_col)
    base = F.filter("spans", lambda s: s["rank"] < len(BASE_KINDS))
    return scanned.select(
        id_col,
        *[count_of(F.col("spans"), kind).alias(f"n_{kind}") for kind in BASE_KINDS],
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )
