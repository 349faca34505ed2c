"""BPE encoding and decoding by a lexicon of frequent words and exact merges of the rest.

A text is cut at single spaces into units that no token crosses. The ids of frequent units
come from a transducer that is compiled from counts over all documents and mapped into memory
by every worker; the ids of other units come from the merges themselves. Both give what the
tokenizers library gives, so the lexicon changes the time that a text takes, never its ids.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_dir, small_batches, text_of
from .lexicon import Lexicon, compile_lexicon

#: Units in the lexicon at most; with UNIT_BYTES it bounds the file that each machine loads.
LEXICON_UNITS = 30_000
UNIT_BYTES = 48
#: Every unit that makes more than this share of all units is counted for sure.
LEAST_SHARE = 1 / 500_000
#: Units and bytes that a worker remembers at most, and units that it counts at once.
MEMO_UNITS, MEMO_BYTES = 300_000, 64_000_000

#: Fixed value: the pattern that splits text before the merges.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A space between white space, or between white space and the end: splitting at each space would cut a run that tokens may span.
_ODD = re.compile(r"\s (?:\s|\Z)")
#: Before a space that has something else than white space on a side.
_CUT = re.compile(r"(?<=\S)(?= )|(?= \S)")
#: Characters whose classes all Unicode versions in use agree on.
_COMMON = re.compile(r"[\t-\r -ɏ‐-‧€]*")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, the rest follow from 256."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Coder:
    """Encodes and decodes with the vocabulary file at path."""

    def __init__(self, path: str, lexicon: Lexicon | None = None):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        alphabet = byte_alphabet()
        self.tokens = {i: bytes(map(alphabet.__getitem__, t)) for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._exact = Tokenizer.from_file(path)
        self._merge = tiktoken.Encoding("own", pat_str=SPLIT_PATTERN, mergeable_ranks={t: i for i, t in self.tokens.items()}, special_tokens={}).encode_ordinary
        self._lexicon = lexicon
        self._specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        all_tokens = self.tokens | {i: t.encode() for t, i in self.special.items()}
        flat = [all_tokens.get(i, b"") for i in range(max(all_tokens) + 1)]
        self._length = np.array([len(t) for t in flat], np.int64)
        self._start = np.cumsum(self._length) - self._length
        self._bytes = np.frombuffer(b"".join(flat), np.uint8)
        self._written = list(map(str, range(len(flat))))
        self.plain, self.spaced = _Memo(self._unit), _Memo(lambda piece: self._unit(" " + piece))

    def _unit(self, unit: str) -> bytes:
        known = self._lexicon.get(unit.encode()) if self._lexicon is not None else None
        return self._merged(unit) if known is None else known

    def _merged(self, unit: str) -> bytes:
        if _COMMON.fullmatch(unit):
            return np.array(self._merge(unit), "<u4").tobytes()
        return np.array(self._exact.encode(unit, add_special_tokens=False).ids, "<u4").tobytes()

    def _merged_all(self, units: list[str]) -> list[bytes]:
        """_merged() of units that begin with a space: common ones are merged as one text, which no token crosses a unit of, and cut again where their bytes end."""
        common = [u for u in units if u[1:2].strip() and _COMMON.fullmatch(u)]
        ids = np.array(self._merge("".join(common)), "<u4")
        ends, own_ends = np.cumsum([len(u.encode()) for u in common], dtype=np.int64), np.cumsum(self._length[ids])
        cuts = np.searchsorted(own_ends, ends, "right")
        if not np.array_equal(own_ends[cuts - 1], ends):
            return list(map(self._merged, units))
        raw, at = ids.tobytes(), [0, *(4 * cuts).tolist()]
        done = dict(zip(common, (raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)), strict=True))
        return [done[u] if u in done else self._merged(u) for u in units]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """encode() of each text; the units that are new to this process are looked up and merged together."""
        self._bound()
        new = list({piece for text in texts for piece in text.split(" ")}.difference(self.spaced))
        units = [f" {piece}" for piece in new]
        known = self._lexicon.get_many([u.encode() for u in units]) if self._lexicon is not None else [None] * len(units)
        rest = [k for k, ids in enumerate(known) if ids is None]
        for k, ids in zip(rest, self._merged_all([units[k] for k in rest]), strict=True):
            known[k] = ids
        for piece, ids in zip(new, known, strict=True):
            self.spaced.put(piece, ids)
        return list(map(self._encoded, texts))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit bytes."""
        self._bound()
        return self._encoded(text)

    def _bound(self) -> None:
        if self.spaced.full() or self.plain.full():
            self.spaced.forget()
            self.plain.forget()

    def _encoded(self, text: str) -> bytes:
        if self._specials is not None and self._specials.search(text):
            return b"".join(np.array([self.special[x]], "<u4").tobytes() if x in self.special else self._segment(x) for x in self._specials.split(text))
        return self._segment(text)

    def _segment(self, text: str) -> bytes:
        if _ODD.search(text):
            return b"".join(map(self.plain.__getitem__, _CUT.split(text)))
        first, *rest = text.split(" ")
        return self.plain[first] + b"".join(map(self.spaced.__getitem__, rest))

    def decode(self, ids: bytes) -> bytes:
        """The text's bytes; ids outside the vocabulary give none."""
        at = np.frombuffer(ids, "<u4")
        at = at[at < len(self._length)]
        length = self._length[at]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        return self._bytes[np.repeat(self._start[at] - ends + length, length) + np.arange(total)].tobytes()


    def decimal(self, ids: bytes) -> str:
        """The ids in decimal, joined by commas."""
        return ",".join(map(self._written.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Memo(dict):
    """What units give; their bytes are counted, as a text without spaces is one unit."""

    def __init__(self, make: Callable[[str], bytes]):
        self._make, self._bytes = make, 0

    def __missing__(self, key: str) -> bytes:
        return self.put(key, self._make(key))

    def put(self, key: str, value: bytes) -> bytes:
        self[key] = value
        self._bytes += 4 * len(key) + len(value)
        return value

    def full(self) -> bool:
        return len(self) > MEMO_UNITS or self._bytes > MEMO_BYTES

    def forget(self) -> None:
        self.clear()
        self._bytes = 0


_CODERS: dict[tuple, Coder] = {}


def coder(path: str, lexicon_file: str | None = None) -> Coder:
    """This process's coder for a vocabulary and a lexicon that Spark has brought here; only the last is kept."""
    if (path, lexicon_file) not in _CODERS:
        _CODERS.clear()
        _CODERS[path, lexicon_file] = Coder(path, Lexicon(SparkFiles.get(lexicon_file)) if lexicon_file else None)
    return _CODERS[path, lexicon_file]


def unit_counts(docs: DataFrame, text_col: str = "text", share: float = LEAST_SHARE) -> DataFrame:
    """unit, n: units after a space, by lossy counting over every document.

    Each task counts all its units and leaves out those below the given share of them, so
    what a task sends is bounded, and a unit above that share overall is above it in some task.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        total = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                pieces = text.split(" ")
                total += len(pieces) - 1
                counts.update(p for p in pieces[1:] if len(p) < UNIT_BYTES)  # longer ones are never kept
                if len(counts) > 2 * MEMO_UNITS:
                    least = max(1, int(total * share))
                    counts = Counter({u: n for u, n in counts.items() if n > least})
        least = total * share
        kept = [(u, n) for u, n in counts.items() if n > least and n > 1 and len(u.encode()) < UNIT_BYTES]
        yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["unit", "n"])

    return docs.select(text_of(text_col).alias("text")).mapInArrow(count, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, tokenizer: str, text_col: str = "text", units: int = LEXICON_UNITS) -> str:
    """Compile the most frequent units of docs, bring the file to every executor, and return its name."""
    spark = docs.sparkSession
    frequent = [r["unit"] for r in unit_counts(docs, text_col).orderBy(F.desc("n"), "unit").limit(units).collect()]
    exact = Coder(tokenizer)
    blob = compile_lexicon((f" {u}".encode(), np.frombuffer(exact.spaced[u], "<u4").tolist()) for u in frequent)
    name = f"lexicon-{hashlib.sha256(blob).hexdigest()[:24]}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{name}")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(blob))
    out.close()
    spark.sparkContext.addFile(path.toString())
    return name


def coded(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, lexicon: str | None, finish: Callable[[Coder, list[str]], list[pa.Array]], schema: T.StructType) -> DataFrame:
    """One row per document: its id, then the columns that finish makes of a batch's texts."""
    small_batches(docs.sparkSession)
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(tokenizer, lexicon)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *finish(own, batch.column(1).to_pylist())], names)

    return docs.select(F.col(id_col), text_of(text_col).alias("_text")).mapInArrow(run, schema)


def encode(docs: DataFrame, tokenizer: str | None = None, lexicon: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ids (array of int) per document. Null texts count as empty and have no ids; repeated rows are coded alike."""

    def finish(own: Coder, texts: list[str]) -> list[pa.Array]:
        return [pa.array([np.frombuffer(ids, "<i4") for ids in own.encode_batch(texts)], pa.list_(pa.int32()))]

    schema = T.StructType([docs.schema[id_col], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return coded(docs, id_col, text_col, tokenizer or default_tokenizer(), lexicon, finish, schema)


def decode(encoded: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """id and text per row of encode(). Bytes that aren't UTF-8 become U+FFFD; null ids give an empty text."""
    tokenizer = tokenizer or default_tokenizer()
    schema = T.StructType([encoded.schema[id_col], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(tokenizer)
        for batch in batches:
            texts = [own.decode(np.array(ids or [], "<u4").tobytes()).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return encoded.select(id_col, "ids").mapInArrow(run, schema)


def round_trip_digests(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_tokens, SHA-256 of its decimal ids, and SHA-256 of the text decoded from those ids.

    Null texts count as empty: no tokens, and the digests of no text. Rows that repeat are coded
    alike, null ids stay, and an empty table gives no rows.
    """
    tokenizer = tokenizer or default_tokenizer()
    small_batches(docs.sparkSession)
    lexicon = build_lexicon(docs, tokenizer, text_col)

    def finish(own: Coder, texts: list[str]) -> list[pa.Array]:
        counts, of_ids, of_text = [], [], []
        for ids in own.encode_batch(texts):
            counts.append(len(ids) // 4)
            of_ids.append(hashlib.sha256(own.decimal(ids).encode()).hexdigest())
            of_text.append(hashlib.sha256(own.decode(ids).decode("utf-8", "replace").encode()).hexdigest())
        return [pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_text)]

    schema = T.StructType([docs.schema[id_col], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return coded(docs, id_col, text_col, tokenizer, lexicon, finish, schema)
