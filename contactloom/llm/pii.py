"""Personal data: base patterns, and a CRF over word shapes.

The base finds e-mail addresses, IP addresses, payment cards and phone numbers
by their patterns. A linear-chain conditional random field over word-shape
features, trained from the labelled table below and decoded by Viterbi in numpy
batches, adds what the patterns miss: numbers written without the form or the
checksum that the patterns ask for.

Most tokens have neither a digit nor an at sign. A token without either, between
two such, carries one more feature, whose weight for the outside label is fixed
after training just above all that the transitions can add (``Field.lift``), so
the best path has that label there. A path can be cut at these tokens without
changing it, and only the stretches between them are decoded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.llm.common import by_bytes, texts_of
from contactloom.llm.crf import train

KINDS = ("email", "ip", "card", "phone")
#: What the field adds, after the base kinds in the order of ties.
ADDED = ("crf_card", "crf_phone", "crf_id", "crf_ip", "crf_email")
LABELS = ("O", *(f"{p}-{k}" for k in ("card", "phone", "id", "ip", "email") for p in "BI"))
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# matches of these begin where a run of digits does, so later starts in the run need no try
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_MARK = re.compile(r"[0-9@]")
_SPACE = " \t\n\v\f\r"

#: Labelled sentences. A span is marked {kind:text}.
LABELLED = """
Call {phone:(415) 555-2671} after six in the evening.
My number is {phone:555-867-5309} or {phone:212.555.0142} at work.
Telephone {phone:020 7946 0958} and ask for her.
Fax: {phone:(030) 901820-44}, tel.: {phone:(030) 901820-45}.
phone {phone:1-800-555-0199} is free of charge
write or ring {phone:415-555-2671}, please
Mobile {phone:0170 5551234} from Monday on
{phone:(212) 555-7788}
the line {phone:(415) 555-2671} was busy
Card {card:4149601755386017} was charged twice.
she paid with {card:9807915762804490} and left
{card:2353820953013749}
und {card:7536784127813050} {card:4845168114407329} noch einmal
number {card:4111 1111 1111 1112} expires in May
number {card:4111-1111-1111-1112} expires in May
Das war {card:5536784127813050}.
THE!! {card:5927243074273351}!! OF!!
es {card:9000426309966109}$$$ und
card {card:3714496353984311} of theirs, and {card:0759539412582376}, too
SSN {id:078-05-1120} on file.
social security {id:219-09-9999} was given
the holder of {id:457-55-5462}, born in spring
Her id is {id:123-45-6789}.
account {id:DE89370400440532013000} in Berlin
pay to {id:GB29NWBK60161331926819} by Friday
IBAN: {id:FR7630006000011234567890189}
host {ip:2001:0db8:85a3:0000:0000:8a2e:0370:7334} is down
from {ip:fe80:0000:0000:0000:0202:b3ff:fe1e:8329} to the gate
write to {email:jane@localhost} now
ask {email:root@mailhost}, please
In 1999 the price rose by 12.5 percent to 1,250 crowns.
Version 2.0 was released on 2021-03-04 and 2.1.3 a year later.
Licensed under the GNU General Public License, version 3.
Licensed under the Apache License, Version 2.0.
Licensed under CC BY-NC 4.0.
See section 3.2 and tables 14 to 17.
The room has 24 seats, 3 doors and 110 lamps.
At 10:30 on 05.06.2019 it began; by 12:45 it was over.
order 4711 of 12/05/2020 came to $1,299.99 in all
ISBN 978-3-16-148410-0 is out of print
token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" in the file
commit bae770d91ab85687d33eeaaf9ac699e1188f962 broke it
from 1914 to 1918, and again from 1939 to 1945
he scored 12345678 points in 2 games
the serial is 20231105 and the batch 0042
@someone said so, and @another agreed
it ran 26.2 miles at 5:43 a mile, 3rd of 1000
the words of a plain sentence stand here without any number
Another Plain Sentence, With Capitals And Commas.
AND ONE IN UPPER CASE, TO THE END OF THE LINE
words | with | bars | and### signs&&& in*** it
Die Straße, der Wald und das Haus.
La niña y el señor, también. Él no.
éeau ouchan, le théâtre à côté
"""

#: plain shapes: lower, capital, upper, other; and outside the text
PLAIN = ("a", "Aa", "A", "?", "^")


def shape(token: str) -> str:
    """The word shape: runs of letters shortened, of digits counted in classes, other characters as they are."""
    out = []
    for m in re.finditer(r"([0-9]+)|([A-Z]+)|([a-z]+)|([^\x00-\x7f]+)|(.)", token.strip("\"'.,;:!?#*$%&|<>=[]{}"), re.S):
        digits, upper, lower, wide, other = m.groups()
        if digits:
            n = len(digits)
            out.append(f"d{n}" if n <= 5 else "d6-8" if n < 9 else "d9-11" if n < 12 else "d12-15" if n < 16 else f"d{n}" if n <= 19 else "d20+")
        else:
            out.append("A" if upper else "a" if lower else "w" if wide else other)
    return "".join(out)


def plain_shape(token: str) -> str:
    core = token.strip("\"'.,;:!?#*$%&|<>=[]{}()")
    if not core:
        return "?"
    return "a" if core[0].islower() else "A" if len(core) > 1 and core.isupper() else "Aa" if core[0].isupper() else "?"


def traits(token: str) -> list[str]:
    """Features that a token lends to its position and to its neighbours."""
    if not _MARK.search(token):
        return [f"s={plain_shape(token)}"]
    s = shape(token)
    digits = len(_DIGIT.findall(token))
    n = "0" if not digits else "1-4" if digits < 5 else "5-8" if digits < 9 else "9" if digits == 9 else "10-11" if digits < 12 else "12-19" if digits < 20 else "20+"
    letters = any(c.isalpha() for c in token)
    return [f"s={s}", f"n={n}", f"n={n},{'l' if letters else ''}{'-' if '-' in s else ''}{'.' if '.' in s else ''}{':' if ':' in s else ''}{'(' if '(' in s else ''}{'@' if '@' in s else ''}"]


class Field:
    """The trained field, with its margins."""

    def __init__(self):
        sentences = [self._parse(x) for x in LABELLED.strip().split("\n")]
        names: dict[str, int] = {}
        for tokens, _ in sentences:
            for i in range(len(tokens)):
                for f in self._names(tokens, i):
                    names.setdefault(f, len(names))
        self.names = names
        examples = [(self.features([self._names(t, i) for i in range(len(t))]), np.array(y)) for t, y in sentences]
        self.chain = train(examples, len(names), len(LABELS), rounds=200, l2=0.0005, rate=0.3)
        # the most that transitions can speak for another label than O at one position
        move, start = self.chain.move, self.chain.start
        swing = 2 * (move.max() - move.min()) + (start.max() - start.min())
        margins = [self._margin([f"0s={b}", f"-s={a}", f"+s={c}"]) for a in PLAIN for b in PLAIN[:-1] for c in PLAIN]
        if min(margins) <= 0:
            raise AssertionError("plain tokens must speak for the outside label")
        # the weight of the feature "plain among plain"
        self.lift = max(0.0, swing - min(margins) + 1e-6)

    def _margin(self, names: list[str]) -> float:
        scores = self.chain.emissions(self.features([names]))[0]
        return float(scores[0] - scores[1:].max())

    @staticmethod
    def _parse(line: str) -> tuple[list[str], list[int]]:
        tokens, labels = [], []
        for piece in re.finditer(r"\{(\w+):([^}]*)\}([^\s{]*)|([^\s{]+)", line):
            kind, inside, tail, other = piece.groups()
            if other:
                tokens.append(other)
                labels.append(0)
                continue
            parts = inside.split()
            parts[-1] += tail
            tokens += parts
            labels += [LABELS.index(f"{'I' if i else 'B'}-{kind}") for i in range(len(parts))]
        return tokens, labels

    @staticmethod
    def _names(tokens: list[str], i: int) -> list[str]:
        found = ["0" + t for t in traits(tokens[i])]
        found += ["-" + t for t in (traits(tokens[i - 1]) if i else ["s=^"])]
        return found + ["+" + t for t in (traits(tokens[i + 1]) if i + 1 < len(tokens) else ["s=^"])]

    def features(self, rows: list[list[str]]) -> np.ndarray:
        out = np.full((len(rows), 9), -1, np.int64)
        for i, row in enumerate(rows):
            for k, name in enumerate(row):
                out[i, k] = self.names.get(name, -1)
        return out


@cache
def field() -> Field:
    return Field()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses. Each holds one at sign that ends a local part, so those are tried in turn."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns' matches, sorted."""
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGIT.findall(m.group())) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


_WORD_AFTER, _SKIP = re.compile(r"[\x20\x09-\x0D]*([^\x20\x09-\x0D]*)"), re.compile(r"[^\x20\x09-\x0D]*")


def _before(text: str, at: int) -> int:
    """Where the token that ends at ``at`` begins."""
    while at > 0 and text[at - 1] not in _SPACE:
        at -= 1
    return at


def stretches(text: str) -> list[list[tuple[int, int]]]:
    """Token spans of every stretch that has to be decoded: tokens with a digit or an at sign, two more on either side."""
    out: list[list[tuple[int, int]]] = []
    m = _MARK.search(text)
    while m:
        begin = _before(text, m.start())
        if out and out[-1][-1][0] >= begin:  # among the tokens that follow the last stretch
            tokens = out[-1]
            while tokens[-1][0] > begin:
                tokens.pop()
        else:
            tokens, at = [], begin
            for _ in range(2):
                end = at
                while end > 0 and text[end - 1] in _SPACE:
                    end -= 1
                if not end:
                    break
                at = _before(text, end)
                tokens.insert(0, (at, end))
            if out and tokens and tokens[0][0] <= out[-1][-1][0]:
                known = out[-1][-1][0]
                tokens = out[-1] + [t for t in tokens if t[0] > known]
            else:
                out.append(tokens)
            out[-1] = tokens
            tokens.append((begin, _SKIP.match(text, m.start()).end()))
        at = tokens[-1][1]
        m = _MARK.search(text, at)
        for _ in range(2):
            w = _WORD_AFTER.match(text, at)
            if w.start(1) == w.end(1):
                break
            tokens.append(w.span(1))
            at = w.end(1)
    return out


def trim(text: str, a: int, b: int) -> tuple[int, int]:
    """A span without the punctuation around it; an opening bracket that closes inside stays."""
    while a < b and not (text[a].isalnum() or text[a] in "+(" and ")" in text[a:b]):
        a += 1
    while b > a and not (text[b - 1].isalnum() or text[b - 1] == ")" and "(" in text[a:b]):
        b -= 1
    return a, b


def added_spans(texts: list[str], base: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """Spans that the field finds in each text, beside and not across the base's."""
    model = field()
    tokens, sizes, owner, rows, plain = [], [], [], [], []
    for i, text in enumerate(texts):
        for stretch in stretches(text):
            words = [text[a:b] for a, b in stretch]
            kinds = [traits(w) for w in words]
            marked = [bool(_MARK.search(w)) for w in words]
            first, last = stretch[0][0], stretch[-1][1]
            # what stands beyond a stretch is plain or the text's end; its shape is looked up so that features are those of the whole text
            end = first
            while end > 0 and text[end - 1] in _SPACE:
                end -= 1
            before = [f"s={plain_shape(text[_before(text, end) : end])}"] if end else ["s=^"]
            w = _WORD_AFTER.match(text, last)
            after = [f"s={plain_shape(w.group(1))}"] if w.group(1) else ["s=^"]
            for k, own in enumerate(kinds):
                rows.append(["0" + t for t in own] + ["-" + t for t in (kinds[k - 1] if k else before)] + ["+" + t for t in (kinds[k + 1] if k + 1 < len(kinds) else after)])
                plain.append(not (marked[k] or k and marked[k - 1] or k + 1 < len(kinds) and marked[k + 1]))
            tokens += stretch
            sizes.append(len(stretch))
            owner.append(i)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not rows:
        return out
    scores = model.chain.emissions(model.features(rows))
    scores[np.array(plain), 0] += model.lift
    labels = model.chain.decode(scores, np.array(sizes))
    at = 0
    for i, n in zip(owner, sizes):
        k = at
        at += n
        while k < at:
            label = LABELS[labels[k]]
            if label == "O":
                k += 1
                continue
            kind, e = label[2:], k + 1
            while e < at and LABELS[labels[e]] == f"I-{kind}":
                e += 1
            a, b = trim(texts[i], tokens[k][0], tokens[e - 1][1])
            if b > a and not any(x < b and a < y for x, _, y in base[i]):
                out[i].append((a, len(KINDS) + ADDED.index(f"crf_{kind}"), b))
            k = e
    return out


NAMES = KINDS + ADDED


def rendered(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{NAMES[k]}:{a}:{b}" for a, k, b in spans)


def find(texts: list[str]) -> list[tuple[list, list]]:
    """(base spans, all spans) of every text, each (start, kind, end) sorted by start, then kind."""
    base = [base_spans(t) for t in texts]
    return [(b, sorted(b + more)) for b, more in zip(base, added_spans(texts, base))]


def spans_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` as doc_id, counts of the base kinds, their digest, and all spans as text.

    Null texts count as empty. Rows are judged one by one: repeated rows and
    rows without an id are no special case, other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), texts_of(batch.column(1))
            for part in by_bytes([], [len(t) for t in texts]):
                found = find(texts[part])
                counts = [pa.array([sum(k == kind for _, k, _ in b) for b, _ in found], pa.int64()) for kind in range(len(KINDS))]
                digests = pa.array([sha256(rendered(b).encode()).hexdigest() for b, _ in found])
                yield pa.RecordBatch.from_arrays([ids[part.start : part.stop], *counts, digests, pa.array([rendered(s) for _, s in found])], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, {counts}, base_sha256 string, spans string")
