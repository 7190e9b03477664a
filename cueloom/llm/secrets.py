"""Secrets in texts: known forms, and random strings by token efficiency."""

from __future__ import annotations

import base64
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueloom.llm.toxicity import segments
from cueloom.storage import table

#: The forms every scan reports, in the order of their names.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST_VALUE = 6

#: Runs that may be random strings: LEAST characters or more.
LEAST = 20
RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
#: Random text has fewer characters than this per token; words of a natural language have 3 or more.
RATIO = 2.0
#: Lengths in hex of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGESTS = (32, 40, 56, 64, 96, 128)
UUID = r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"
#: Left out by form, with the marks beside them, where marks or the ends of the run bound them.
FORMS = re.compile(rf"[+/_-]?(?<![A-Za-z0-9])(?:{UUID}|{'|'.join(f'[0-9A-Fa-f]{{{n}}}' for n in DIGESTS)})=*(?![A-Za-z0-9])[+/_-]?")
#: What stands between marks, and those of them that may be words or numbers.
BETWEEN = re.compile(r"[A-Za-z0-9]+=*")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


@lru_cache(maxsize=2)
def vocabulary(name: str):
    """A tiktoken encoding from a public rank file."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all known forms, leftmost and not overlapping in each kind."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _random_in(text: str, start: int, end: int, count: Callable[[str], int]) -> list[tuple[int, int]]:
    """(start, end) of random strings in a piece of a run; ``count`` gives the tokens of a string.

    The whole piece is tested first, unless words and numbers are all it has between marks. Then all
    windows of joined parts are: their characters against the sum of their parts' tokens, without the
    marks. Numbers are not counted, and a window needs half of LEAST in other parts.
    """
    spans = [m.span() for m in BETWEEN.finditer(text, start, end)]
    if not all(PART.fullmatch(text[a:b].rstrip("=")) for a, b in spans) and end - start < RATIO * count(text[start:end]):
        return [(start, end)]
    parts = [(a, b, RATIO * count(text[a:b]) - (b - a)) for a, b in spans if not text[a:b].rstrip("=").isdigit()]

    def enough(i: int, j: int) -> bool:
        return parts[j][1] - parts[i][0] >= LEAST and sum(b - a for a, b, _ in parts[i : min(j + 1, i + LEAST)]) >= LEAST // 2

    found = [(parts[i][0], parts[j - 1][1]) for _, i, j in segments(np.array([g for _, _, g in parts])) if enough(i, j - 1)]
    windows = []
    for i in range(len(parts)):  # a longer window falls into two that are long enough, and one of them gains
        gain, first = 0.0, None
        for j in range(i, len(parts)):
            gain += parts[j][2]
            if first is None and enough(i, j):
                first = j
            if first is not None and gain > 0:
                windows.append((-gain, parts[i][0], parts[j][1]))
            if first is not None and first < j and enough(first + 1, j):
                break
    for _, a, b in sorted(windows):
        at = bisect_right(found, (a, end))
        if (at == 0 or found[at - 1][1] <= a) and (at == len(found) or b <= found[at][0]):
            found.insert(at, (a, b))
    return found


def random_spans(text: str, taken: list[tuple[int, int, int]], vocabulary_name: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of strings with few characters per token, outside ``taken``.

    Runs are cut at ``taken`` and at digests and UUIDs; pieces that are not only numbers are tested.
    """
    def count(s: str) -> int:
        return len(vocabulary(vocabulary_name).encode_ordinary(s))

    found, known, at = [], [], 0
    for a, _, b in taken:  # sorted: joined to spans that do not overlap
        if known and a <= known[-1][1]:
            known[-1][1] = max(known[-1][1], b)
        else:
            known.append([a, b])
    for m in RUN.finditer(text):
        while at < len(known) and known[at][1] <= m.start():
            at += 1
        cuts, k = [f.span() for f in FORMS.finditer(text, m.start(), m.end())], at
        while k < len(known) and known[k][0] < m.end():
            cuts.append((known[k][0], known[k][1]))
            k += 1
        begin = m.start()
        for a, b in [*sorted(cuts), (m.end(), m.end())]:
            if a - begin >= LEAST and any(c.isalpha() for c in text[begin:a]):
                found += [(x, 3, y) for x, y in _random_in(text, begin, a, count)]
            begin = max(begin, b)
    return found


def spans_of(text: str, vocabulary_name: str) -> list[tuple[int, int, int]]:
    base = base_spans(text)
    return sorted(base + random_spans(text, base, vocabulary_name))


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary_name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """Per row: key, found (array of kind, start, end in code points), by start, then kind.

    Null texts are empty and have none; keys may be null or repeat; other columns are ignored.
    Whole texts are scanned, row by row, without a shuffle.
    """
    found = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([docs.schema[key], T.StructField("found", found)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans_of(x.as_py() or "", vocabulary_name)] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], schema.names)

    return docs.select(key, text).mapInArrow(run, schema)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with each run of overlapping spans replaced by the kind of its first."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k]}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, text: str = "text", chars: str = "n_chars", vocabulary_name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """``docs`` with secrets replaced in their texts and ``chars``, where that column is there, counted anew.

    Rows without a secret stay as they are; null texts stay null.
    """
    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("clean", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column(1):
                t = x.as_py()
                spans = spans_of(t or "", vocabulary_name)
                rows.append(redact(t, spans) if spans else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.string())], schema.names)

    done = docs.select(F.struct(*docs.columns).alias("row"), F.col(text)).mapInArrow(run, schema)
    new = {text: F.coalesce(F.col("clean"), F.col(f"row.{text}"))}
    if chars in docs.columns:
        new[chars] = F.when(F.col("clean").isNull(), F.col(f"row.{chars}")).otherwise(F.length("clean").cast(docs.schema[chars].dataType))
    return done.select(*[new.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns])


def op8_token_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = scan_secrets(table(spark, sf_dir, "documents"))
    written = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    base = F.filter("found", lambda x: x["kind"] != "random")
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select(
        "doc_id", *[count(k) for k in KINDS], F.sha2(F.array_join(F.transform(base, written), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("found", written), ",").alias("spans"),
    )


QUERIES = {"op8_token_efficiency": op8_token_efficiency}
ORACLES: dict[str, str] = {}
