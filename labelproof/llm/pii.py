"""Personal data: fixed patterns, and a semi-Markov conditional random field over whole spans.

Patterns (leftmost, non-overlapping for each kind): email addresses, IPv4 addresses, card numbers that pass the Luhn check,
phone numbers with a country code. Their spans always stay.

Field: a text's chunks between white space are cut into stretches around those with digits, "@" or a spelled-out "at". A
segment is a plain chunk or an entity of up to MAX_CHUNKS chunks and one of the four types; features describe the whole
span (digits, groups, separators, Luhn, octets, address shape, words before it). A dynamic program over boundaries and
types finds the best segmentation; entities that touch no pattern span are added. The field is learned on the driver from
the pattern spans of at most SAMPLE documents (smallest hashes among those with digits or "@"), and from spellings derived
from them (no country code, dots, an "at" for "@", digits that break the Luhn check, octets over 255) that the patterns miss
or that are no personal data. Without any pattern span in the sample the field adds nothing.

Null is the empty text. All work is a map over whole texts, one pass; repeated rows are answered alike.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
# The patterns that the contract of this operator gives, written without backtracking.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]+")

SAMPLE = 1500
MAX_CHUNKS = 5
MARGIN = 2.0
EPOCHS, RATE = 12, 0.3
CHUNK = re.compile(r"[^ \t\n\r\x0b\x0c]+")
TRIGGER = re.compile(r"[0-9]{2}|@|[(\[][aA][tT][)\]]|\s[dD][oO][tT]\s")
ACTIVE = re.compile(r"[0-9]|@|[(\[](?:at|dot)[)\]]|^(?:at|dot)$", re.I)
#: An address with "at" or "dot" in words; up to MAX_SPELLED chunks, that is five labels in words.
SPELLED = re.compile(
    r"[A-Za-z0-9._%+-]+(?:\s*[(\[]at[)\]]\s*|\s+at\s+(?!(?:the|an?|this|that|our|their|his|her)\s)|@)[A-Za-z0-9-]+(?:(?:\s*[(\[]dot[)\]]\s*|\s+dot\s+|\.)[A-Za-z0-9-]+)+", re.I)
SPELLED_AT = re.compile(r"[(\[]at[)\]]|\sat\s|@", re.I)
MAX_SPELLED = 11
GOES_ON = re.compile(r"[(\[]?dot[)\]]?", re.I)
#: Punctuation around a chunk that belongs to the sentence.
OPENING, CLOSING = "\"'<[{,;:!?", "\"'>]},;:!?."


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def octets(parts: list[str]) -> bool:
    return all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in parts)


def emails(text: str) -> list[tuple[int, int]]:
    """Each "@" with the address characters before it and a domain after it."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            out.append((start, end))
        at = text.find("@", end if domain else at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [(0, a, b) for a, b in emails(text)]
    if DIGITS.search(text):
        out += [(1, *m.span()) for m in IP.finditer(text) if octets(m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= sum(map(len, DIGITS.findall(m[0]))) <= 15]
    return out


def trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    piece = text[a:b]
    inner = piece.lstrip(OPENING)
    if inner:
        a += len(piece) - len(inner)
        b -= len(inner) - len(inner.rstrip(CLOSING)) if inner.rstrip(CLOSING) else 0
    piece = text[a:b]
    if piece.startswith("(") and ")" not in piece:
        a += 1
    if piece.endswith(")") and "(" not in piece:
        b -= 1
    return a, b


def bare(chunk: str) -> str:
    return chunk.lstrip(OPENING).rstrip(CLOSING)


def stretches(text: str):
    """Lists of (start, end, active) of chunks: those around a trigger, with two plain ones on either side."""
    if not TRIGGER.search(text):
        return
    chunks = [(*m.span(), bool(ACTIVE.search(m[0]) or ACTIVE.search(bare(m[0])))) for m in CHUNK.finditer(text)]
    k, n = 0, len(chunks)
    while k < n:
        if not chunks[k][2]:
            k += 1
            continue
        last = k
        while True:
            more = next((j for j in range(last + 1, min(n, last + 3)) if chunks[j][2]), None)
            if more is None:
                break
            last = more
        yield chunks[max(0, k - 2) : last + 3]
        k = last + 1


def traits(text: str, a: int, b: int, chunks: int, before: str) -> list[str]:
    """Features of a whole span."""
    piece = text[a:b]
    groups = DIGITS.findall(piece)
    digits = "".join(groups)
    n = len(digits)
    rest = re.sub(r"[0-9]", "", piece)
    letters = sum(c.isalpha() for c in rest)
    marks = "".join(sorted(set(re.sub(r"[^\W_]", "", rest).replace(" ", "_").replace("\n", "_").replace("\t", "_"))))
    out = [
        "one", f"chunks{chunks}", f"digits{min(n, 20)}", f"groups{'-'.join(str(len(g)) for g in groups[:6])}" if len(groups) < 7 else "groups-many",
        f"marks{marks[:8]}", "letters0" if not letters else "letters-few" if letters < 4 else "letters", f"before={before[:12]}",
    ]
    if not letters and 13 <= n <= 19:
        out.append("luhn" if luhn(digits) else "no-luhn")
    if not letters and len(groups) == 4 and rest == "...":
        out.append("octets" if octets(groups) else "no-octets")
    if not letters and piece.startswith("+"):
        out.append("plus-long" if 8 <= n <= 15 else "plus-odd")
    if not letters and 9 <= n <= 15:
        out.append("phone-long")
        if len(groups) >= 3 and [len(g) for g in groups[-2:]] == [3, 4]:
            out.append("ends-3-4")
    if re.search(r"@|\(at\)|\[at\]|\sat\s", piece, re.I):
        address = re.sub(r"\s*(?:\(at\)|\[at\]|\sat\s|@)\s*", "@", piece, flags=re.I)
        address = re.sub(r"\s*(?:\(dot\)|\[dot\]|\sdot\s)\s*", ".", address, flags=re.I)
        whole = emails(address)
        spelled = "@" not in piece
        marked = re.search(r"[(\[](?:at|dot)[)\]]|\sdot\s|@", piece, re.I) is not None
        out.append("address" if marked and whole == [(0, len(address))] else "no-address")
        out.append("spelled" if spelled else "written")
    return out


class Field:
    """Weights of (type, feature); type -1 are plain chunks, whose score is 0."""

    def __init__(self, weights: dict[tuple[int, str], float] | None = None):
        self.weights = weights or {}

    def segments(self, text: str, chunks: list[tuple[int, int, bool]]):
        """(first, last + 1, start, end, features) of the candidate entities: up to MAX_CHUNKS chunks, of which the first and the
        last and all but two are active, or up to MAX_SPELLED that spell an address."""
        n = len(chunks)
        spelled = n > 0 and SPELLED_AT.search(text, chunks[0][0], chunks[-1][1]) is not None
        for i in range(n):
            live = 0
            for j in range(i + 1, min(n, i + (MAX_SPELLED if spelled else MAX_CHUNKS)) + 1):
                live += chunks[j - 1][2]
                if not live:
                    continue
                a, b = trimmed(text, chunks[i][0], chunks[j - 1][1])
                usual = j - i <= MAX_CHUNKS and live >= (j - i) - 1 - (j - i > 2) and chunks[i][2] and chunks[j - 1][2]
                if not usual and not (spelled and SPELLED.fullmatch(text, a, b)):
                    continue
                before = text[chunks[i - 1][0] : chunks[i - 1][1]].strip(".,:;").lower() if i else ""
                features = traits(text, a, b, j - i, before if before in CONTEXT else "")
                if j < n and GOES_ON.fullmatch(text, *chunks[j][:2]):
                    features.append("goes-on")
                yield i, j, a, b, features

    def score(self, kind: int, features: list[str]) -> float:
        get = self.weights.get
        return sum(get((kind, f), 0.0) for f in features)

    def decode(self, text: str, chunks: list[tuple[int, int, bool]]) -> list[tuple[int, int, int]]:
        """(kind, start, end) of the entities of the best segmentation."""
        n = len(chunks)
        by_end = defaultdict(list)
        for i, j, a, b, features in self.segments(text, chunks):
            for kind in range(len(KINDS)):
                s = self.score(kind, features) - MARGIN
                if s > 0:
                    by_end[j].append((i, s, (kind, a, b)))
        best, back = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(1, n + 1):
            best[j] = best[j - 1]
            for i, s, span in by_end[j]:
                if best[i] + s > best[j]:
                    best[j], back[j] = best[i] + s, (i, span)
        out, j = [], n
        while j > 0:
            if back[j] is None:
                j -= 1
            else:
                out.append(back[j][1])
                j = back[j][0]
        return out[::-1]

    def learn(self, examples: list[tuple[str, list[tuple[int, int, int]]]]) -> None:
        """Gradient steps on the likelihood of the given segmentations; expectations by forward and backward sums over
        segmentations with entities of bounded length."""
        squares: dict[tuple[int, str], float] = defaultdict(lambda: 1e-2)
        data = []
        for text, spans in examples:
            chunks = [(*m.span(), bool(ACTIVE.search(m[0]) or ACTIVE.search(bare(m[0])))) for m in CHUNK.finditer(text)]
            segments = list(self.segments(text, chunks))
            gold = {(a, b): k for k, a, b in spans}
            if sum((s[2], s[3]) in gold for s in segments) >= len(gold):
                data.append((len(chunks), segments, gold))
        for _ in range(EPOCHS):
            for n, segments, gold in data:
                scores = [[self.score(k, s[4]) for k in range(len(KINDS))] for s in segments]
                ahead, back = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
                ends, starts = defaultdict(list), defaultdict(list)
                for x, s in enumerate(segments):
                    ends[s[1]].append(x)
                    starts[s[0]].append(x)
                for j in range(1, n + 1):
                    ahead[j] = log_sum([ahead[j - 1]] + [ahead[segments[x][0]] + v for x in ends[j] for v in scores[x]])
                for i in range(n - 1, -1, -1):
                    back[i] = log_sum([back[i + 1]] + [back[segments[x][1]] + v for x in starts[i] for v in scores[x]])
                seen = set()
                for x, s in enumerate(segments):
                    right = gold.get((s[2], s[3])) if (s[2], s[3]) not in seen else None
                    if right is not None:
                        seen.add((s[2], s[3]))
                    for kind in range(len(KINDS)):
                        p = math.exp(ahead[s[0]] + scores[x][kind] + back[s[1]] - ahead[n])
                        step = (kind == right) - p
                        if abs(step) > 1e-3:
                            for f in s[4]:
                                squares[kind, f] += step * step
                                self.weights[kind, f] = self.weights.get((kind, f), 0.0) + RATE * step / math.sqrt(squares[kind, f])


#: Words before a span that are features.
CONTEXT = frozenset("tel telephone phone call fax mobile cell email mail e-mail contact card visa mastercard ip host server address account".split())


def log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values)) if top > -math.inf else top


def spellings(kind: int, found: str) -> list[tuple[int, str]]:
    """Other spellings of an entity (its kind) and look-alikes that are none (-1)."""
    digits = "".join(DIGITS.findall(found))
    if kind == 0:
        name, _, domain = found.partition("@")
        out = [(-1, f"{name}@"), (-1, f"@{name}"), (-1, f"{name} at {name}")]
        # also without the digits, and with as few labels as can be, that a sample's addresses may happen to have
        for n, d in [(name, domain), (re.sub("[0-9]", "", name) or name, ".".join(re.sub("[0-9]", "", domain).split(".")[-2:]))]:
            dotted, boxed = d.replace(".", " dot "), d.replace(".", " [dot] ")
            out += [(0, f"{n} at {dotted}"), (0, f"{n} [at] {d}"), (0, f"{n}(at){d}"), (0, f"{n} [at] {boxed}"), (0, f"{n} (at) {d.replace('.', ' (dot) ')}")]
        return out
    if kind == 1:
        parts = found.split(".")
        return [(-1, ".".join(parts[:3])), (-1, ".".join([str(int(parts[0][-2:]) + 300), *parts[1:]])), (-1, f"{digits[:2]}.{digits[2:4]}"), (-1, f"20{digits[:2]}-0{digits[2:3]}-1{digits[3:4]}")]
    if kind == 2:
        wrong = digits[:-1] + str((int(digits[-1]) + 5) % 10)
        return [(-1, wrong), (-1, digits[:12]), (-1, " ".join(wrong[k : k + 4] for k in range(0, 16, 4))), (-1, digits[:6]), (-1, digits[:9])]
    local = digits[-10:].rjust(10, "5")
    a, b, c = local[:3], local[3:6], local[6:]
    return [(3, f"({a}) {b}-{c}"), (3, f"{a}-{b}-{c}"), (3, f"{a}.{b}.{c}"), (3, f"+{digits[:11]}"), (-1, f"{a} {b}"), (-1, f"{b}-{c}"), (-1, c), (-1, local), (-1, f"{a},{b}")]


def train(texts: list[str]) -> Field:
    """Learns from the pattern spans of some texts."""
    examples: list[tuple[str, list[tuple[int, int, int]]]] = []
    counts = [0] * len(KINDS)
    for text in texts:
        for kind, a, b in base_spans(text):
            if counts[kind] >= 60:
                continue
            counts[kind] += 1
            left, right = " ".join(text[:a][-40:].split()[-2:]), " ".join(text[b : b + 40].split()[:2])
            left, right = re.sub(r"[0-9@+]", "", left), re.sub(r"[0-9@+]", "", right)
            for k, spelled in [(kind, " ".join(text[a:b].split())), *spellings(kind, text[a:b])]:
                line = f"{left} {spelled} {right}"
                at = len(left) + 1
                examples.append((line, [(k, at, at + len(spelled))] if k >= 0 else []))
    field = Field()
    if examples:
        examples.sort(key=lambda x: hashlib.md5(x[0].encode("utf-8", "surrogatepass")).digest())
        field.learn(examples)
    return field


def fit(docs: DataFrame) -> Field:
    """Learns from a bounded sample of the texts with digits or "@". Only hashes are ordered; of copies one text is taken."""
    rows = docs.select("text", F.xxhash64("text").alias("h")).where(F.col("text").rlike("[0-9@]"))
    last = rows.select("h").distinct().orderBy("h").limit(SAMPLE).agg(F.max("h")).first()[0]
    if last is None:
        return Field()
    sample = rows.where(F.col("h") <= last).groupBy("h").agg(F.min("text").alias("text")).collect()
    return train([r["text"] for r in sorted(sample)])


def all_spans(text: str, field: Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The pattern spans, and these with the field's; (kind, start, end) by kind, then start."""
    base = base_spans(text)
    if not field.weights:
        return base, base
    more = [s for chunks in stretches(text) for s in field.decode(text, chunks)]
    more = [s for s in more if not any(s[1] < b and a < s[2] for _, a, b in base)]
    return base, sorted(base + more)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with the kind's name in place of each span; overlapping spans are masked as one."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{KINDS[kind].upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def mapped(docs: DataFrame, field: Field, fn, result: str) -> DataFrame:
    """docs, whose last column is the text, with that replaced by the columns that fn(text, base, spans) gives."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[:-1])
    names = [x.split()[0] for x in result.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string()}[x.split()[1]] for x in result.split(", ")]

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            rows = [fn(x, *all_spans(x or "", shared.value)) for x in texts]
            columns = [pa.array([r[k] for r in rows], kinds[k]) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*batch.schema.names[:-1], *names])

    return docs.mapInArrow(run, f"{kept}, {result}")


def reported(text: str | None, base: list, spans: list) -> tuple:
    counts = np.bincount([k for k, _, _ in base], minlength=len(KINDS)).tolist() if base else [0] * len(KINDS)
    return (*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans))


def pii_report(docs: DataFrame) -> DataFrame:
    """Per document: n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    rows = docs.select("doc_id", "text")
    return mapped(rows, fit(rows), reported, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked_docs(docs: DataFrame) -> DataFrame:
    """doc columns, text masked and n_chars its length; a null text stays null."""
    others = [c for c in docs.columns if c != "text"]
    mask = lambda text, base, spans: (None if text is None else masked(text, spans),)
    return mapped(docs.select(*others, "text"), fit(docs), mask, "text string").select(*docs.columns)
