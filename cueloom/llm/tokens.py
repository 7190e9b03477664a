"""Token ids and counts of whole texts under a public tokenizer file."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from cueloom.storage import table

#: Texts of more characters are encoded in overlapping chunks.
CHUNK = 1 << 16
#: First overlap of neighbouring chunks; doubled wherever they do not align.
OVERLAP = 1 << 8
#: Tokens that must agree on each side of a cut.
STABLE = 4
#: Parts of words kept with their ids in each Python worker.
CACHE_WORDS = 350_000
LIMIT = 2048
#: Bytes of texts encoded at a time.
SLICE = 1 << 23
#: Stands between words that are encoded together. It is ASCII, so no other character becomes it.
MARK = "~"
#: Words of ASCII and Latin letters, which no normal form changes; '<' may begin a special string.
LATIN = r"^[\x21-\x3b\x3d-\x7e\x{a1}-\x{24f}]+$"
#: A letter or digit of those at the end, that stays one in lower case: marks after it are a piece of their own.
ENDS_PLAIN = r"[0-9A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{24f}]$"
MARKS = "!\"#$%&'()*+,-./:;=>?@[\\]^_`{|}~"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def stretches(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` with these starts and lengths, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)]


class Encoder:
    """Ids of texts as the library gives them, for .json files of ``tokenizers``.

    Where the tokenizer drops white space before it splits words, and no word can hold any, a
    text's ids are those of its runs between ASCII white space, one after the other. Arrow splits
    the texts and finds the distinct runs of a slice; only these are cut into stem and closing
    marks and looked up in a cache of bounded size (two generations), and only parts that are not
    there go to the library, joined by marks. Other tokenizers encode whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            self.config = json.load(f)
        self.mark, *more = self.encode(MARK).ids or [None]
        self.by_word = self._drops_space() and self.mark is not None and not more
        self.lowers = any(x["type"] == "Lowercase" for x in self._steps("normalizer", "normalizers"))
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _steps(self, part: str, inner: str) -> list[dict]:
        x = self.config[part]
        return x[inner] if x and x["type"] == "Sequence" else [x] if x else []

    def _drops_space(self) -> bool:
        normal = [(x["type"], x.get("pattern"), x.get("content")) for x in self._steps("normalizer", "normalizers")]
        space = ("Replace", {"Regex": "\\s+"}, " ")
        split = self._steps("pre_tokenizer", "pretokenizers")[:1]
        added = self.config["added_tokens"]
        dropped = bool(split) and split[0]["type"] == "Split" and split[0]["behavior"] == "Removed" and split[0]["invert"]
        pattern = split[0]["pattern"].get("Regex", "") if dropped else ""
        wordlike = dropped and all(part.startswith(("'", r"[\p{L}]", r"[\p{N}]", r"[^\s")) for part in pattern.split("|"))
        plain = {x[0] for x in normal} <= {"NFC", "Replace", "Lowercase"}
        free = not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
        return space in normal and plain and wordlike and free

    def encode(self, text: str):
        return self.library.encode(text, add_special_tokens=False)

    def learn(self, words: list[str]) -> None:
        """Ask the library for the ids of these words, with a mark between them that none holds."""
        plain = [w for w in words if MARK not in w]
        for i in range(0, len(plain), 2000):
            part = plain[i : i + 2000]
            joined = f" {MARK} ".join([*part, ""])
            ids = np.array(self.library.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
            stops = np.flatnonzero(ids == self.mark)
            raw, stops = ids.tobytes(), (stops * 4).tolist()
            for w, a, b in zip(part, [-4, *stops[:-1]], stops, strict=True):
                self.known[w] = raw[a + 4 : b]
        for w in words:
            if MARK in w:
                self.known[w] = np.array(self.encode(w).ids, np.uint32).tobytes()

    def _parts(self, runs: pa.Array) -> pa.Array:
        """Two parts of each run, in turn: Latin ones in lower case without the marks at their end, and those; others whole, and nothing."""
        latin = pc.match_substring_regex(runs, LATIN)
        low = pc.if_else(latin, pc.ascii_lower(runs), runs) if self.lowers else runs
        bare = pc.utf8_rtrim(low, MARKS)
        cut = pc.and_(latin, pc.match_substring_regex(bare, ENDS_PLAIN))
        stem = pc.if_else(cut, pc.binary_length(bare), pc.binary_length(low)).to_numpy(zero_copy_only=False)
        low = pa.concat_arrays([low])  # own buffers, without an offset
        offsets = np.frombuffer(low.buffers()[1], np.int64)[: len(low) + 1]
        both = np.empty(2 * len(low) + 1, np.int64)
        both[::2], both[1::2] = offsets, offsets[:-1] + stem
        return pa.LargeStringArray.from_buffers(2 * len(low), pa.py_buffer(both), low.buffers()[2])

    def _look_up(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words, as bytes."""
        known, older = self.known, self.older
        new = [w for w in words if w not in known]
        if len(known) + len(new) > CACHE_WORDS:
            self.older = older = known
            self.known = known = {}
            new = words
        known.update((w, older[w]) for w in new if w in older)
        self.learn([w for w in new if w not in known])
        return list(map(known.__getitem__, words))

    def _runs(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct runs in a row, and how many each has."""
        parts = self._parts(runs).dictionary_encode()
        found = self._look_up(parts.dictionary.to_pylist())
        n = np.fromiter(map(len, found), np.int64, len(found)) // 4
        at = parts.indices.to_numpy()
        flat = stretches(np.frombuffer(b"".join(found), np.uint32), (np.cumsum(n) - n)[at], n[at])
        return flat, n[at].reshape(-1, 2).sum(axis=1)

    def _split(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the distinct runs, how many each has, the runs of all texts, and where those of each text begin."""
        split = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        runs = split.flatten().dictionary_encode()
        offsets = split.offsets.to_numpy()
        return *self._runs(runs.dictionary), runs.indices.to_numpy(), offsets - offsets[0]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where those of each begin, with the end; null texts are empty."""
        if not self.by_word:
            found = self.library.encode_batch(texts.fill_null("").to_pylist(), add_special_tokens=False)
            listed = [np.array(x.ids, np.uint32) for x in found]
            return np.concatenate([np.zeros(0, np.uint32), *listed]), np.cumsum([0, *map(len, listed)])
        flat, n, at, offsets = self._split(texts)
        return stretches(flat, (np.cumsum(n) - n)[at], n[at]), np.concatenate([[0], np.cumsum(n[at])])[offsets]

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of each text."""
        if not self.by_word:
            return np.diff(self.ids(texts)[1])
        _, n, at, offsets = self._split(texts)
        return np.diff(np.concatenate([[0], np.cumsum(n[at])])[offsets])


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The encoder of this Python worker."""
    return Encoder(path)


def _resets(text: str, at: int) -> bool:
    """No token crosses ``at``, and what follows does not depend on what stands before: white space ends there."""
    return at > 0 and text[at - 1] in " \t\n\r\x0b\x0c" and text[at] not in " \t\n\r\x0b\x0c"


def chunked_ids(text: str, encode: Callable, resets: Callable[[str, int], bool] = _resets, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Ids of a huge text from overlapping chunks.

    Each chunk is encoded with offsets. Two neighbours are spliced at a place in their overlap
    where both start a token, where the tokenizer's state is proven to begin anew (``resets``),
    and where STABLE tokens on each side agree in id and place. Where there is none, the overlap
    is doubled and the chunks are encoded again, in the end as one.
    """
    got, begin, pending = [], 0, None
    while True:
        end = min(begin + chunk, len(text)) if pending is None else pending[1]
        left = encode(text[begin:end])
        tokens = [(i, a + begin, b + begin) for i, (a, b) in zip(left.ids, left.offsets, strict=True)]
        if end == len(text):
            return got + [i for i, _, _ in tokens]
        width, cut = overlap, None
        while cut is None:
            start = end - width
            if start <= begin or width > chunk:
                break
            right = encode(text[start : min(end + chunk, len(text))])
            there = {a + start: k for k, (a, _) in reversed(list(enumerate(right.offsets)))}
            for k in range(len(tokens) - STABLE - 1, STABLE, -1):
                a = tokens[k][1]
                if a <= start:
                    break
                j = there.get(a)
                if j is None or j < STABLE or tokens[k - 1][1] == a or not resets(text, a):
                    continue
                if all(tokens[k + d] == (right.ids[j + d], right.offsets[j + d][0] + start, right.offsets[j + d][1] + start) for d in range(-STABLE, STABLE)):
                    cut = k
                    break
            width *= 2
        if cut is None:  # no proven place: one longer chunk
            pending = (begin, min(end + chunk, len(text)))
            continue
        got += [i for i, _, _ in tokens[:cut]]
        begin, pending = tokens[cut][1], None


def _huge(texts: pa.Array, own: Encoder, chunk: int) -> tuple[pa.Array, list[tuple[int, str]]]:
    """The texts with those that are encoded in chunks left empty, and these with their places."""
    if not own.by_word:
        return texts, []
    huge = pc.greater(pc.utf8_length(texts), chunk).fill_null(False)
    places = np.flatnonzero(huge.to_numpy(zero_copy_only=False)).tolist()
    left = pc.if_else(huge, pa.scalar("", texts.type), texts) if places else texts
    return left, [(k, texts[k].as_py()) for k in places]


def whole_ids(texts: pa.Array, path: str, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and where those of each begin, with the end; huge texts in chunks."""
    own = encoder(path)
    left, huge = _huge(texts, own, chunk)
    flat, offsets = own.ids(left)
    lengths, parts, done = np.diff(offsets), [], 0
    for k, text in huge:
        found = np.array(chunked_ids(text, own.encode, chunk=chunk), np.uint32)
        parts += [flat[done : offsets[k]], found]
        done, lengths[k] = int(offsets[k]), len(found)
    return np.concatenate([*parts, flat[done:]]), np.cumsum(np.concatenate([[0], lengths]))


def whole_counts(texts: pa.Array, path: str, chunk: int = CHUNK) -> np.ndarray:
    """Number of ids of each text; huge texts in chunks."""
    own = encoder(path)
    left, huge = _huge(texts, own, chunk)
    counts = own.counts(left)
    for k, text in huge:
        counts[k] = len(chunked_ids(text, own.encode, chunk=chunk))
    return counts


def slices(texts: pa.Array, most: int = SLICE) -> Iterator[pa.Array]:
    """The texts in order, about ``most`` bytes at a time."""
    texts = texts.cast(pa.large_string())
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, side="right")))
        yield texts.slice(i, j - i)
        i = j


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, limit: int = LIMIT, chunk: int = CHUNK) -> DataFrame:
    """Per row: key, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    Ids are those of the library without added special tokens; special strings inside a text
    count as its default has them. Null and empty texts have 0 bytes and 0 tokens; keys may be
    null or repeat: each row is counted; other columns are ignored; an empty table gives no
    rows. Nothing is shuffled.
    """
    path = path or tokenizer_path()
    counted = (("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType()))
    schema = T.StructType([docs.schema[key], *[T.StructField(n, t) for n, t in counted]])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).cast(pa.int64()).fill_null(0)
            found = [whole_counts(texts, path, chunk) for texts in slices(batch.column(1))]
            tokens = np.concatenate([np.zeros(0, np.int64), *found])
            columns = [batch.column(0), sizes, pa.array(tokens, pa.int64()), pa.array(tokens > limit)]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.select(key, text).mapInArrow(count, schema)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


QUERIES = {"op10_token_counts": op10_token_counts}
ORACLES: dict[str, str] = {}
