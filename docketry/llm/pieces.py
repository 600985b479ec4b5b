"""Splitting oversized items at natural boundaries: a hierarchy of separators, packed greedily, with overlap.

A text within its limits is one piece. Otherwise whole units are packed into a piece while they fit: sections (a heading
line begins one), paragraphs (blank lines), lines, sentences, words, characters. A unit that would not fit a piece of
its own is entered at the next finer level; a unit that would is left to the next piece. Every piece after the first
begins ``overlap`` characters before the end of the one before it, so consecutive pieces share exactly that many;
only where the shared text alone would fill the limit does the piece begin later (``n_shared`` says how many it shares).
Without what they share the pieces are the text, character for character. The boundaries of a text are found once for all limits.

The limit is in characters (code points), in tokens of a public tokenizer, or both; a piece is within both.

Defined cases: NULL and empty texts have no pieces; NULL or non-positive limits do not limit; an overlap of NULL is 0, one
not below the limit counts as the limit less one; repeated rows are split once; texts are read whole, however long.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.tokens import CHUNK, TOKENIZER, Counter

# Words after which a full stop ends no sentence.
SHORT_FORMS = "no|nos|rs|v|vs|sec|s|ss|art|arts|cl|para|paras|mr|mrs|ms|dr|shri|smt|hon|m/s|pvt|ltd|co|crl|c|w|ors|anr|viz|i\\.e|e\\.g|ibid|cf|vol|ed|p|pp|ch|st"

LEVELS = [
    re.compile(r"\n\s*(?=[A-Z][A-Z .&'/-]*[A-Z][ \t]*(?:\n|$))"),
    re.compile(r"\n[ \t]*\n\s*"),
    re.compile(r"\n\s*"),
    re.compile(r"(?<=[.!?।])[\"')\]”’]*\s+(?=[\"'(\[“‘]?[A-Z0-9ऀ-ॿ])|।\s*"),
    re.compile(r"\s+"),
]
SENTENCES = 3
_NO_END = re.compile(rf"(?:^|[\s(\[])(?:{SHORT_FORMS}|[A-Za-z]|\d{{1,3}})\.$", re.I)


def boundaries(text: str) -> list[list[int]]:
    """Per level, the ends of its units in order (the white space after a unit is its own); the text's end is the last."""
    out = []
    for level, pattern in enumerate(LEVELS):
        ends = [m.end() for m in pattern.finditer(text) if level != SENTENCES or not _NO_END.search(text, max(0, m.start() - 12), m.start())]
        if not ends or ends[-1] != len(text):
            ends.append(len(text))
        out.append(ends)
    return out


def cut(text: str, characters: int | None, overlap: int, reach=None, ends=None) -> list[tuple[int, int]]:
    """``(start, end)`` of the pieces. ``reach(start, beyond)``: the farthest end that a further limit allows; ``ends()``: the :func:`boundaries`."""
    n = len(text)
    if not n:
        return []
    limit = n if characters is None or characters <= 0 else characters
    farthest = lambda start, beyond: min(n, start + limit) if reach is None else min(n, start + limit, reach(start, beyond))
    if farthest(0, 0) >= n:
        return [(0, n)]
    overlap = max(0, min(overlap, limit - 1))
    ends = boundaries(text) if ends is None else ends()
    out: list[tuple[int, int]] = []
    done = 0
    while done < n:
        start = max(0, done - overlap)
        most = farthest(start, done)
        while most <= done and start < done:  # what is shared fills the piece: begin later
            start = (start + done + 1) // 2
            most = farthest(start, done)
        most = max(most, done + 1)
        at = done
        for number, level in enumerate(ends):
            if number > SENTENCES and at > done:
                break  # words are cut apart only where no sentence ends
            # as many whole units as fit
            k = bisect_right(level, most) - 1
            if k >= 0 and level[k] > at:
                at = level[k]
            if at >= most:
                break
            following = level[bisect_right(level, at)]
            fresh = max(0, at - overlap)
            if at > done and farthest(fresh, at) >= following:
                break  # the next unit fits a piece of its own
        else:
            at = most
        if at <= done:
            at = most
        out.append((start, at))
        done = at
    return out


class TokenReach:
    """The farthest end from a start within a number of tokens, by running sums over chunks."""

    def __init__(self, counter: Counter, text: str, tokens: int):
        self.counter, self.text, self.tokens = counter, text, tokens
        self.starts = [m.start() for m in CHUNK.finditer(text)] + [len(text)]
        self.sums = [0]
        for c in counter.chunks(text):
            self.sums.append(self.sums[-1] + c)

    def count(self, start: int, end: int) -> int:
        a, b = bisect_right(self.starts, start - 1), bisect_right(self.starts, end) - 1
        if a > b:
            return self.counter.exact(self.text[start:end])
        head = self.counter.exact(self.text[start : self.starts[a]]) if start < self.starts[a] else 0
        tail = self.counter.exact(self.text[self.starts[b] : end]) if end > self.starts[b] else 0
        return head + self.sums[b] - self.sums[a] + tail

    def __call__(self, start: int, beyond: int) -> int:
        """The farthest end within the tokens; where no end of a chunk lies beyond ``beyond``, an end inside a chunk."""
        a = bisect_right(self.starts, start - 1)
        head = self.counter.exact(self.text[start : self.starts[a]]) if start < self.starts[a] else 0
        if head <= self.tokens:
            end = self.starts[bisect_right(self.sums, self.sums[a] + self.tokens - head) - 1]
            if end > beyond:
                return end
        end = min(beyond + self.tokens, len(self.text))
        while end > beyond and self.count(start, end) > self.tokens:
            end -= max(1, (end - beyond) // 16)
        return end


_PIECES = "experiment_id string, record string, piece_no int, n_pieces int, start int, end int, n_shared int, n_tokens int, text string"


def _splitter(configs: list[tuple], tokenizer: str, by_tokens: bool, with_text: bool):
    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = Counter(tokenizer) if by_tokens else None
        for frame in frames:
            out = []
            for record, text in zip(frame["record"], frame["text"], strict=True):
                found: list = []

                def ends(text: str = text, found: list = found) -> list[list[int]]:
                    if not found:
                        found.append(boundaries(text))
                    return found[0]

                for name, characters, tokens, overlap in configs:
                    reach = TokenReach(counter, text, tokens) if by_tokens and tokens and tokens > 0 else None
                    parts = cut(text, characters, overlap or 0, reach, ends)
                    for i, (a, b) in enumerate(parts):
                        out.append((name, record, i, len(parts), a, b, parts[i - 1][1] - a if i else 0, reach.count(a, b) if reach else None, text[a:b] if with_text else None))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _PIECES.split(", ")])

    return split


def split(records: DataFrame, record: str, text: str, configs: list[tuple], by_tokens: bool = True, with_text: bool = True, tokenizer: str = TOKENIZER) -> DataFrame:
    """Pieces of every record under every configuration ``(name, characters, tokens, overlap)``.

    ``by_tokens`` False leaves the token limit aside, ``with_text`` False returns places only.
    """
    rows = records.select(F.col(record).cast("string").alias("record"), F.col(text).alias("text")).filter("record is not null and text is not null and text <> ''")
    return rows.mapInPandas(_splitter(configs, tokenizer, by_tokens, with_text), _PIECES)
