"""Secret scans: fixed patterns, and strings that a tokenizer's vocabulary hardly compresses."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.common import table

#: The vocabulary (ranks, base64 and number a line) and the pattern that splits texts before it.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters a token below which a string is taken for a random one; of letters of one case alone, which unknown
#: words make up too: WORD_RATIO.
RATIO, WORD_RATIO = 2.8, 2.0
#: The same for what looks like words joined, but in three or more groups of one length, as keys for people to type are.
GROUP_RATIO = 1.7
KINDS = ("assign", "access", "hex", "random")
DIGESTS = (32, 40, 56, 64, 96, 128)  # hex digits of MD5, SHA-1, SHA-224, -256, -384 and -512

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_NAMES = re.compile(r"password|passwd|secret|token|api_?key", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_STRING = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_WORDLIKE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_PURE_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_PARTS = re.compile(r"[+/_=-]+")
#: A part of a delimited identifier: a word or number, or words run together; without nested quantifiers over the same letters.
_NAME_PART = re.compile(r"[a-z]*[0-9]{0,4}|[A-Z]+|[A-Z]?[a-z]+(?:[A-Z][a-z]+)*|[0-9]{1,8}")
#: Characters of an identifier's part, at most: a longer one is a string of its own, left to the ratio.
MAX_PART = 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, leftmost and non-overlapping within a kind."""
    found = []
    if ("=" in text or ":" in text) and _NAMES.search(text):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    return sorted([*found, *((m.start(), 2, m.end()) for m in _HEX.finditer(text))])


def known(string: str) -> bool:
    """Whether a string is a digest, a UUID or a delimited identifier: words and numbers of up to ``MAX_PART`` characters, joined."""
    if _UUID.fullmatch(string) or len(string) in DIGESTS and _PURE_HEX.fullmatch(string):
        return True
    return all(len(p) <= MAX_PART and _NAME_PART.fullmatch(p) for p in _PARTS.split(string))


def grouped(string: str, tokens, ratio: float) -> bool:
    """Whether a string is three or more groups of as many characters, four at least, mostly letters, that take more than a token every ``ratio`` characters."""
    parts = [p for p in _PARTS.split(string) if p]
    if len(parts) < 3 or len(parts[0]) < 4 or len({*map(len, parts)}) > 1:
        return False
    size = len(parts) * len(parts[0])
    return 2 * sum(map(str.isalpha, string)) > size and size < ratio * sum(len(tokens(p)) for p in parts)


def random_spans(text: str, tokens, ratio: float, word_ratio: float, base: list[tuple[int, int, int]], group_ratio: float = GROUP_RATIO) -> list[tuple[int, int, int]]:
    """Spans of strings with fewer than ``ratio`` characters a token (``word_ratio`` for letters of one case, ``group_ratio`` for groups of them), outside ``base``.

    ``base`` is sorted by start; both lists are walked once.
    """
    found, k, reach = [], 0, -1
    for m in _STRING.finditer(text):
        while k < len(base) and base[k][0] <= m.start():
            reach = max(reach, base[k][2])
            k += 1
        s = m[0]
        if m.end() <= reach:
            continue
        if known(s):
            if grouped(s, tokens, group_ratio):
                found.append((m.start(), 3, m.end()))
        elif len(s) < (word_ratio if _WORDLIKE.fullmatch(s) else ratio) * len(tokens(s)):
            found.append((m.start(), 3, m.end()))
    return found


def tokenizer(ranks: bytes):
    import tiktoken

    pairs = (line.split() for line in ranks.splitlines() if line)
    return tiktoken.Encoding("scan", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={}).encode_ordinary


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, ratio: float = RATIO, word_ratio: float = WORD_RATIO, group_ratio: float = GROUP_RATIO) -> DataFrame:
    """(id, spans array<struct<kind, start, end>>) for every row of ``docs``, over its whole text.

    Spans are in code points, end exclusive, by start and then kind in the order of KINDS: what the patterns
    find, and, as random, further strings of 16 or more characters that take more than one token every
    ``ratio`` characters (``word_ratio`` where they are letters of one case), unless they are digests, UUIDs or
    identifiers (but for groups of one length with more than a token every ``group_ratio`` characters) or lie within a pattern's span. A
    null or empty text has no spans; rows that repeat come back as often; other columns aren't read. The
    vocabulary is read by the driver and broadcast: its size doesn't depend on the documents.
    """
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokenizer(ranks.value)
        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in them:
            out = []
            for t in batch.column(1):
                text = t.as_py() or ""
                base = base_spans(text)
                out.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(base + random_spans(text, tokens, ratio, word_ratio, base, group_ratio))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(span))], names=["id", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(batches, f"id {kind}, spans array<struct<kind string, start bigint, end bigint>>")


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    """Counts and digests of the documents' spans, as the contract of this query asks."""
    found = scan(table(spark, sf_dir, "documents"))
    base = _joined(F.filter("spans", lambda s: s["kind"] != "random"))
    return found.select(F.col("id").alias("doc_id"), _count("assign"), _count("access"), _count("hex"), F.sha2(base, 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
