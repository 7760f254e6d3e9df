"""Byte-level BPE: texts to packed token ids and back.

A text is cut at single spaces between two non-space characters, where no match
of the pattern can reach across. Matches of the pattern are kept in a bounded memo
of two generations, which frequent ones outlive; only pieces that are no match of
it are split by the pattern, and only matches not met before are encoded.

A match is encoded without replaying merges. Bytes become Latin-1 characters so
that one Aho-Corasick pass finds every token at every place. From the left the
longest token is tried, then shorter ones; a token may follow another only if
merging would have left the boundary between them, which depends on the two
tokens alone and is memoised. The first try, the longest token at every place, is
right for most matches, and no other chain of fitting tokens exists then. A place from which no ending was found is not
tried again, so the work is linear in the match.

Defined cases: a null text gives no ids; white space, control characters and
strings that look like special tokens are ordinary text; very long texts and
matches need memory in proportion to themselves only; other columns pass
through, and a clashing name for a result is refused.
"""

import base64
import re
import struct
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.llm.registry import query, table
from citeloom.llm.texts import slices
from citeloom.llm.written import fresh

RANKS = "byte_bpe_50k.tiktoken"
NEVER = 1 << 60
#: Most entries of the memos of a worker, matches (both generations) and pairs of tokens, and the longest match kept.
MEMO, FITS, LONGEST_WORD = 300_000, 400_000, 64
#: Matches that need no look at the pattern: Latin letters only, with a space before them or not.
PLAIN_WORD = re.compile(" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+").fullmatch


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _adjoined(text: str) -> bool:
    """A single space is at an end of the text or beside other white space."""
    if text[:1] == " " or text[-1:] == " ":
        return True
    return any(" " + c in text or c + " " in text for c in set(text) if c.isspace())


class Vocabulary:
    """Tokens of a rank file, with what encoding by longest match needs."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN) -> None:
        with open(path, "rb") as lines:
            pairs = (line.split() for line in lines if line.strip())
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.lengths = [len(self.tokens.get(rank, b"")) for rank in range(max(self.tokens, default=0) + 1)]
        self.pattern = regex.compile(pattern)
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._shorter: dict[int, int | None] = {}
        self._fits: dict[int, bool] = {}
        self._recent: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        """Made when first used: a worker that only decodes does without."""
        found = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            found.add_word(token.decode("latin-1"), rank)
        found.make_automaton()
        return found

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for a single byte."""
        if token not in self._halves:
            body = self.tokens[token]
            parts = [body[i : i + 1] for i in range(len(body))]
            while len(parts) > 2:
                at = min(
                    range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60)
                )
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self._halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self._halves[token]

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens ends in just these two.

        Walks back through the merges that made the parts at the boundary,
        latest first; ranks are times. A pair of parts that lived side by side
        and makes a token was merged away unless one of the two had been taken
        before: on the left also at the same rank, as the leftmost goes first.
        """
        a, b, taken_a, taken_b = left, right, NEVER, NEVER
        while True:
            joined = self.ranks.get(self.tokens[a] + self.tokens[b], NEVER)
            if joined < taken_a and joined <= taken_b and self.halves(joined) == (a, b):
                return False
            inside_a, inside_b = self.halves(a), self.halves(b)
            if inside_a is None and inside_b is None:
                return True
            if inside_b is None or (inside_a is not None and a > b):
                taken_a, a = a, inside_a[1]
            else:
                taken_b, b = b, inside_b[0]

    def shorter(self, token: int) -> int | None:
        """The longest other token that ``token`` begins with."""
        if token not in self._shorter:
            body = self.tokens[token]
            heads = (self.ranks.get(body[:n]) for n in range(len(body) - 1, 0, -1))
            self._shorter[token] = next((rank for rank in heads if rank is not None), None)
        return self._shorter[token]

    def encode_match(self, body: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        whole = self.ranks.get(body)
        if whole is not None:
            return [whole]
        characters = body.decode("latin-1")
        size, lengths, fits = len(characters), self.lengths, self._fits
        chain, at = [], 0
        for end, token in self.automaton.iter_long(characters):
            if end + 1 - lengths[token] != at:
                break
            if chain:
                fit = fits.get(chain[-1] << 32 | token)
                if fit is False or fit is None and not self._may_follow(chain[-1], token):
                    break
            chain.append(token)
            at = end + 1
        return chain if at == size else self._backtracked(characters)

    def _may_follow(self, left: int, right: int) -> bool:
        """:meth:`fits`, remembered."""
        fit = self._fits.get(left << 32 | right)
        if fit is None:
            if len(self._fits) > FITS:
                self._fits.clear()
            fit = self._fits[left << 32 | right] = self.fits(left, right)
        return fit

    def _backtracked(self, characters: str) -> list[int]:
        """The chain of fitting tokens, found from the longest token at every place."""
        size, lengths, fits, shorter = len(characters), self.lengths, self._fits, self._shorter
        longest = [0] * size
        for end, rank in self.automaton.iter(characters):
            longest[end - lengths[rank] + 1] = rank  # longer ones come later
        chain: list[int] = []
        dead: set[int] = set()
        at, last, token = 0, -1, longest[0]
        while True:
            end = at + lengths[token]
            if end not in dead:
                fit = last < 0 or fits.get(last << 32 | token)
                if fit or fit is None and self._may_follow(last, token):
                    chain.append(token)
                    if end == size:
                        return chain
                    at, last, token = end, token, longest[end]
                    continue
            token = shorter[token] if token in shorter else self.shorter(token)
            while token is None:
                # Chains of fitting tokens are unique, so this place fails for good.
                dead.add(at)
                taken = chain.pop()
                at -= lengths[taken]
                last = chain[-1] if chain else -1
                token = self.shorter(taken)

    def _match(self, match: str) -> bytes:
        """Packed ids of one match of the pattern, remembered."""
        packed = self._older.get(match) or _pack(self.encode_match(match.encode()))
        if len(match) <= LONGEST_WORD:
            if len(self._recent) >= MEMO // 2:
                self._older, self._recent = self._recent, {}
            self._recent[match] = packed
        return packed

    def _packed(self, piece: str) -> bytes:
        known = self._recent.get(piece)
        if known:
            return known
        if PLAIN_WORD(piece):
            return self._match(piece)
        return b"".join([self._recent.get(m) or self._match(m) for m in self.pattern.findall(piece)])

    def encode(self, text: str) -> bytes:
        """Ids of ``text`` as little-endian unsigned 32-bit integers."""
        words = text.split(" ")
        if _adjoined(text):
            return self._encode_spaced(words)
        # Words may be cut off on both sides, each with the space before it.
        spaced = [words[0], *[" " + word for word in words[1:]]]
        recent = self._recent.get
        return b"".join([recent(word) or self._packed(word) for word in spaced])

    def _encode_spaced(self, words: list[str]) -> bytes:
        """The same where spaces adjoin other white space: those stay in one piece."""
        found, piece = [], [words[0]]
        for before, word in zip(words, words[1:]):
            if before and word and not before[-1].isspace() and not word[0].isspace():
                found.append(self._packed(" ".join(piece)))
                piece = ["", word]
            else:
                piece.append(word)
        found.append(self._packed(" ".join(piece)))
        return b"".join(found)

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One a Python worker; workers outlive tasks."""
    return Vocabulary(path)


def _rank_file(path: str | None) -> str:
    # Found where the task runs: every machine has its own copy.
    return path or public_tokenizers.path(RANKS)


def _mapped(docs: DataFrame, source: str, steps: dict[str, Callable]) -> DataFrame:
    """``docs`` and a binary column for each step; a step takes what the one before it made."""
    if {c.lower() for c in steps} & {c.lower() for c in docs.columns}:
        raise ValueError(f"there is a column of {', '.join(steps)} already")
    at = docs.columns.index(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, size in slices(batch.column(at)):
                part = batch.slice(start, size)
                made, columns = part.column(at).to_pylist(), list(part.columns)
                for step in steps.values():
                    made = [step(x) for x in made]
                    columns.append(pa.array(made, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, *steps])

    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.BinaryType()) for c in steps)])
    return docs.mapInArrow(run, schema)


def _encoder(path: str | None) -> Callable:
    return lambda x: vocabulary(_rank_file(path)).encode(x or "")


def _decoder(path: str | None) -> Callable:
    return lambda x: vocabulary(_rank_file(path)).decode(x or b"")


def encoded(docs: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` and the packed ids of ``text``."""
    return _mapped(docs, text, {ids: _encoder(path)})


def decoded(docs: DataFrame, path: str | None = None, ids: str = "ids", body: str = "decoded") -> DataFrame:
    """``docs`` and the bytes that packed ``ids`` stand for."""
    return _mapped(docs, ids, {body: _decoder(path)})


def round_trip(
    docs: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids", body: str = "decoded"
) -> DataFrame:
    """:func:`encoded` and :func:`decoded` in one pass, by one worker."""
    return _mapped(docs, text, {ids: _encoder(path), body: _decoder(path)})


def with_round_trip(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str, str]:
    """:func:`round_trip` and the names of its columns, lengthened where ``docs`` has them already."""
    ids, body = fresh(docs.columns, "ids", "decoded")
    return round_trip(docs, text=text, ids=ids, body=body), ids, body


def id_list(ids) -> list[int]:
    """Packed ids as Python integers, for small results."""
    return np.frombuffer(bytes(ids), "<u4").tolist()


@query("op3_byte_bpe")
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip(docs).select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
