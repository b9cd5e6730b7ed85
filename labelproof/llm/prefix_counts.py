"""Exact token counts at every prefix of a text, for a byte-level BPE vocabulary.

Method. Two tokens can stand next to each other in an encoding if and only if encoding their joined bytes gives them back,
and an encoding is right if all its neighbours can. So the encoding of a prefix ends in the one token t, ending there, that
can follow the last token of the prefix before t: a dynamic program over prefixes that keeps the last token and the count
at each. Whether u can be followed by v is read off the merges along the seam: the pieces that end u and those that begin v,
each alive from its own merge until the next swallows it; if two that are alive together have a merge that comes
first, the seam would be crossed.

The vocabulary's pattern splits a text into pieces that are encoded on their own; a table of counts at each character of a
piece is learned once for each different piece of a block, and kept in the worker while it comes back. Counts of a text are sums
over its pieces. A prefix that ends inside a piece counts as the library counts it, with three things to mind: a run of
white space at a prefix's end is one piece, a contraction that is cut short ('r of 're) falls into two pieces, and the
special string counts as one token only where it is whole. Counts don't always grow with the prefix: the longest prefix
within a budget is the last one whose count fits.

Characters that the pattern's library and this one's pattern class differently (additions to Unicode) are split by a
stand-in of the class that the tokenizer itself gives them.

A null text is empty and has no tokens; repeated rows are each answered; a piece of n bytes takes time in proportion to n; an
empty table gives an empty result; other columns are kept whatever their names.
"""

from __future__ import annotations

import json
import re
from array import array
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelproof.llm.common import Memo, blocks, fresh, texts

#: Pieces whose tables a worker keeps.
KEPT_PIECES = 600_000
#: Pairs of tokens of which a worker keeps whether one can follow the other.
KEPT_PAIRS = 1_000_000
BLOCK = 1 << 20
#: The pattern of byte-level BPE vocabularies of this family; a fixed value.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
SPACES = regex.compile(r"\s+")
#: Contractions of which a prefix is split anew.
SPLIT_SHORT = ("'re", "'ve", "'ll")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class PrefixCounter:
    """Counts of one vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.specials = [t["content"] for t in model["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) or r"(?!)")
        self.splitter = Tokenizer.from_file(path).pre_tokenizer
        to_byte = byte_characters()
        raw = {s: bytes(map(to_byte.__getitem__, s)) for s in model["model"]["vocab"] if s not in set(self.specials)}
        self.number = {b: k for k, b in enumerate(sorted(raw.values(), key=lambda b: (len(b), b)))}
        self.longest: dict[bytes, int] = {}
        for b in self.number:
            self.longest[b[-2:]] = max(self.longest.get(b[-2:], 0), len(b))
        self.rank: dict[tuple[int, int], int] = {}
        made: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(model["model"]["merges"]):
            left, right = (self.number[raw[s]] for s in (merge.split(" ") if isinstance(merge, str) else merge))
            self.rank[left, right] = rank
            made.setdefault(self.number[bytes(x for s in (merge.split(" ") if isinstance(merge, str) else merge) for x in raw[s])], (rank, left, right))
        self.never = len(self.rank)
        # the pieces that end (begin) each token, from its byte up, each with the rank of the merge that swallows it
        self.ends = [self.spine(made, t, 2) for t in range(len(self.number))]
        self.begins = [self.spine(made, t, 1) for t in range(len(self.number))]
        self.memo = Memo(lambda pieces: list(map(self.table, pieces)), KEPT_PIECES)
        self.pairs: dict[int, bool] = {}
        self.latin = re.compile(self.latin_pattern())
        self.stand_ins: dict[str, str | None] = {}

    def spine(self, made: dict, token: int, side: int) -> list[tuple[int, int]]:
        out, gone = [], self.never
        while True:
            out.append((token, gone))
            if token not in made:
                return out[::-1]
            gone, token = made[token][0], made[token][side]

    def follows(self, u: int, v: int) -> bool:
        """The joined bytes of the tokens u and v encode as u, v."""
        pair = u << 20 | v
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            known = self.pairs[pair] = self.seam_holds(u, v)
        return known

    def seam_holds(self, u: int, v: int) -> bool:
        left, right = self.ends[u], self.begins[v]
        i = j = 0
        while True:
            (a, a_gone), (b, b_gone) = left[i], right[j]
            rank = self.rank.get((a, b), self.never)
            # of equal pairs the leftmost merges first: that is u's own merge, but not v's
            if rank < a_gone and rank <= b_gone and rank < self.never:
                return False
            if a_gone == b_gone == self.never:
                return True
            if a_gone <= b_gone:
                i += 1
            else:
                j += 1

    def byte_counts(self, raw: bytes) -> list[int]:
        """Tokens of the first 0, 1, ... bytes of a piece."""
        number, longest, follows = self.number.get, self.longest.get, self.follows
        last, counts, start = [0] * (len(raw) + 1), [0] * (len(raw) + 1), 0
        for end in range(1, len(raw) + 1):
            # only one token can end here, so any order finds it; often it is the one before with a byte more
            token = number(raw[start:end])
            if token is None or (start and not follows(last[start], token)):
                for start in range(max(0, end - longest(raw[max(0, end - 2) : end], 1)), end):
                    token = number(raw[start:end])
                    if token is not None and (not start or follows(last[start], token)):
                        break
            last[end], counts[end] = token, counts[start] + 1
        return counts

    def table(self, piece: str) -> array:
        """Tokens of the first 1, 2, ... characters of a piece."""
        if piece in SPLIT_SHORT:
            return array("I", [1, 2, self.byte_counts(piece.encode())[-1]])
        counts = self.byte_counts(piece.encode())
        if piece.isascii():
            return array("I", counts[1:])
        return array("I", [counts[k] for k in accumulate(len(c.encode()) for c in piece)])

    def latin_pattern(self) -> str:
        """The pattern for texts of the first 256 characters, with the classes that the tokenizer itself gives them."""
        kinds: dict[str, str] = {"a": "", "1": "", "!": "", " ": ""}
        for c in map(chr, range(256)):
            joins = [k for k in "a1!" if len(self.splitter.pre_tokenize_str(f"x{k}{c}"[k == "a" :])) == (1 if k == "a" else 2)]
            kinds[joins[0] if joins else " "] += f"\\x{ord(c):02x}"
        letters, digits, others, spaces = (kinds[k] for k in "a1! ")
        return f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{digits}]+| ?[{others}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+"

    def known(self, piece: str) -> array:
        """The table of a piece, from those that are kept or made anew."""
        return self.memo.find(piece) or self.table(piece)

    def plain(self, text: str) -> str:
        """The text for the pattern: characters that it would class differently give way to others of their class."""
        if text.isascii():
            return text
        known = self.stand_ins
        for c in set(text).difference(known):
            probe = f"a{c}1{c}!{c} {c}"
            if [at for _, at in self.splitter.pre_tokenize_str(probe)] == [m.span() for m in PATTERN.finditer(probe)]:
                known[c] = None
            else:
                joins = [len(self.splitter.pre_tokenize_str(x + c)) == 1 for x in "a1!"]
                known[c] = "a1!"[joins.index(True)] if any(joins) else " "
        changes = {ord(c): known[c] for c in set(text) if known[c]}
        return text.translate(changes) if changes else text

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text without special strings."""
        try:
            text.encode("latin-1")
            return self.latin.findall(text)
        except UnicodeEncodeError:
            pass
        plain = self.plain(text)
        if plain is text:
            return PATTERN.findall(text)
        return [text[a:b] for a, b in (m.span() for m in PATTERN.finditer(plain))]

    def answers(self, values: list[str], limit: int | None = None) -> tuple[list[int], list[int]]:
        """(tokens of each text, characters of the longest prefix of each with at most `limit` tokens)."""
        split = [[self.pieces(p) for p in self.special.split(v)] if self.special.search(v) else [self.pieces(v)] for v in values]
        different = list({x for mine in split for p in mine for x in p})
        total = {x: t[-1] for x, t in zip(different, self.memo.values(different), strict=True)}.__getitem__
        tokens = [len(mine) - 1 + sum(sum(map(total, p)) for p in mine) for mine in split]
        if limit is None:
            return tokens, []
        return tokens, [
            len(v) if n <= limit else self.cut(mine[0], total, limit) if len(mine) == 1 else self.fitting(v, limit)
            for v, n, mine in zip(values, tokens, split, strict=True)
        ]

    def totals(self, values: list[str]) -> list[int]:
        """Tokens of each text."""
        return self.answers(values)[0]

    def cut(self, pieces: list[str], total, limit: int) -> int:
        """Characters of the longest prefix with at most `limit` tokens of a text given by its pieces, which has more.

        The counts up to each piece say where the limit is passed; only there are prefixes looked at, from the last piece on
        that begins after a character that isn't white space."""
        base, end, at, safe = 0, 0, 0, (0, 0, 0)  # safe: piece number, characters and tokens before it
        while base <= limit:
            if not at or not pieces[at - 1][-1].isspace():
                safe = (at, end, base)
            base, end, at = base + total(pieces[at]), end + len(pieces[at]), at + 1
        first, before, tokens = safe
        while at < len(pieces) and pieces[at - 1][-1].isspace():
            at += 1  # a run of white space is counted whole
        counts = self.part_counts("".join(pieces[first:at]), limit - tokens)
        return before + max(k for k, c in enumerate(counts) if c <= limit - tokens)

    def part_counts(self, text: str, limit: int | None = None) -> list[int]:
        """Tokens of the first 0, 1, ... characters of a text without special strings; with a limit, at least as far as
        counts can be within it."""
        pieces = self.pieces(text)
        get, counts, base = self.known, [0], 0
        for x in pieces:
            if limit is not None and base > limit:
                break
            own = get(x)
            counts.extend([base + k for k in own])
            base += own[-1]
        for m in SPACES.finditer(self.plain(text)):
            a, b = m.span()
            if a >= len(counts):
                break
            counts[a + 1 : b + 1] = [counts[a] + k for k in get(text[a:b])]
        return counts

    def prefixes(self, text: str, limit: int | None = None) -> list[int]:
        """Tokens of text[:0], text[:1], ..., text. With a limit, counts beyond it may be others beyond it, and those after
        the last place that can be within it are left out."""
        counts, at, base = [0], 0, 0
        for m in [*self.special.finditer(text), None]:
            end = m.start() if m else len(text)
            cut = text[at : m.end() - 1] if m else text[at:]  # a special string that isn't whole is plain text
            own = self.part_counts(cut, None if limit is None else limit - base)
            counts.extend(base + k for k in own[1:])
            if m is None or len(own) <= end - at:
                break
            if limit is not None:
                counts.extend([limit + 1] * (len(cut) + 1 - len(own)))
            base, at = base + own[end - at] + 1, m.end()
            counts.append(base)
            if limit is not None and base > limit:
                break
        return counts

    def fitting(self, text: str, limit: int) -> int:
        """Characters of the longest prefix with at most `limit` tokens."""
        counts = self.prefixes(text, limit)
        return max(k for k, c in enumerate(counts) if c <= limit)


#: One counter for each file, for the life of the worker process.
COUNTERS: dict[str, PrefixCounter] = {}


def counter_of(path: str) -> PrefixCounter:
    if path not in COUNTERS:
        COUNTERS[path] = PrefixCounter(path)
    return COUNTERS[path]


def answered(docs: DataFrame, text: str, answers, added: list[tuple[str, str, pa.DataType]]) -> DataFrame:
    """All columns of docs, the text too, and those that answers(texts) gives."""
    others = [c for c in docs.columns if c != text]
    taken, names = set(docs.columns), []
    for name, _, _ in added:
        names.append(fresh(name, taken))
        taken.add(names[-1])
    kept = docs.select(*others, text)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), *(f"{n} {sql}" for n, (_, sql, _) in zip(names, added, strict=True))])

    def run(batches):
        for batch in batches:
            values = texts(batch.column(batch.num_columns - 1))
            for a, b in blocks(values, BLOCK):
                columns = [pa.array(c, kind) for c, (_, _, kind) in zip(answers(values[a:b]), added, strict=True)]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*batch.schema.names, *names])

    return kept.mapInArrow(run, schema)


def token_prefixes(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """The columns of docs and prefix_tokens: the tokens of the first 0, 1, ... characters of the text."""
    path = path or vocabulary()
    return answered(docs, text, lambda values: [[counter_of(path).prefixes(v) for v in values]], [("prefix_tokens", "array<int>", pa.list_(pa.int32()))])


def tokens_of_first(prefix_tokens: Column, chars: Column) -> Column:
    """Tokens of so many first characters, from the column of token_prefixes."""
    return F.try_element_at(prefix_tokens, F.least(chars, F.size(prefix_tokens) - 1).cast("int") + 1)


def chars_within(prefix_tokens: Column, limit: int) -> Column:
    """Characters of the longest prefix with at most `limit` tokens, from the column of token_prefixes."""
    return (F.size(prefix_tokens) - F.array_position(F.reverse(F.transform(prefix_tokens, lambda c: c <= limit)), True)).cast("long")


def token_counts(docs: DataFrame, limit: int, text: str = "text", path: str | None = None) -> DataFrame:
    """The columns of docs, n_tokens, and fitting_chars: the length of the longest prefix with at most `limit` tokens."""
    path = path or vocabulary()

    def answers(values):
        counter = counter_of(path)
        return counter.answers(values, limit)

    return answered(docs, text, answers, [("n_tokens", "long", pa.int64()), ("fitting_chars", "long", pa.int64())])


def count_report(docs: DataFrame, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, fitting_chars of doc_id, text."""
    rows = token_counts(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), limit)
    return rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "fitting_chars")
