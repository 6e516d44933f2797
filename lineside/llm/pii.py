"""Personal data: plain patterns, and the same patterns behind disguises, at source offsets."""

from __future__ import annotations

import bisect
import re
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from lineside.llm.spans import Span, digest, joined, masked, ordered
from lineside.llm.tables import bounded_batches, per_batch, texts

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Characters that look like ASCII ones.
LOOKALIKES = dict(zip(
    "АВЕЅІЈКМНОРСТУХаесіјорѕухԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοονα",
    "ABESIJKMHOPCTYXaecijopsyxdqwABEZHIKMNOPTYXoova"))
# Digits as words in the languages of the texts.
DIGIT_WORDS = {word: str(n) for words in (
    "zero one two three four five six seven eight nine",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "null eins zwei drei vier fünf sechs sieben acht neun") for n, word in enumerate(words.split())} | {"oh": "0"}
# Ends of host names that a spoken address must have, so that prose with "at" and "dot" is left alone.
HOST_ENDS = ("com org net edu gov mil int info biz dev app io ai co me tv xyz online site tech cloud example test "
             "de fr es it uk eu us ca au ch at be nl pt pl se no dk fi ie mx br ar cl in jp cn kr ru").split()
AT_WORDS, DOT_WORDS = ("at", "arroba"), ("dot", "punto", "punkt", "point")

_SAME = re.compile("[­Ͱ-ԯ​-‍⁠﻿！-～\U0001d7ce-\U0001d7ff]")
_digit = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_DIGITS = re.compile(rf"(?:\bplus[\s-]+)?\b(?:(?:{_digit})[\s.-]+){{3,}}(?:(?:[0-9]+|{_digit})[\s.-]+)*(?:{_digit})\b", re.I)
_DIGIT_PART = re.compile(rf"\bplus\b|\b(?:{_digit})\b|[0-9]+|\.|[\s-]+", re.I)
# White space before a mark is taken from the head of its run only, else a long run would be read from each of its places.
_MARK = re.compile(rf"(?:(?<!\s)\s++)?[(\[{{<]\s*+(?:({'|'.join(AT_WORDS)}|@)|({'|'.join(DOT_WORDS)}|\.))\s*[)\]}}>]\s*", re.I)
_at, _dot = rf"\s+(?:{'|'.join(AT_WORDS)})\s+", rf"\s+(?:{'|'.join(DOT_WORDS)})\s+"
_SPOKEN = re.compile(
    rf"(?<![\w.%+-])[\w.%+-]{{1,64}}(?:{_dot}[\w%+-]{{1,64}}){{0,3}}({_at}|@)"
    rf"[\w-]{{1,63}}(?:(?:{_dot}|\.)[\w-]{{1,63}}){{0,3}}(?:{_dot}|\.)(?:{'|'.join(HOST_ENDS)})(?![\w-])", re.I)
#: What every spoken address holds: a sign and the first two parts of a host.
_SPOKEN_CORE = re.compile(rf"(?:(?<!\s)\s++(?:{'|'.join(AT_WORDS)})\s++|@)[\w-]{{1,63}}(?:{_dot}|\.)[\w-]", re.I)
_SPOKEN_PART = re.compile(rf"\s+(?:({'|'.join(AT_WORDS)})|({'|'.join(DOT_WORDS)}))\s+", re.I)
_SPOKEN_IP = re.compile(rf"(?<![0-9])[0-9]++(?:(?:{_dot}|\.)[0-9]++){{3}}", re.I)


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> list[Span]:
    """From each @ outwards, which is linear: a match starts at the head of the run before its @."""
    found, at, last = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            last = domain.end()
            found.append(("email", start, last))
        at = text.find("@", max(at + 1, last))
    return found


def identifiers(text: str) -> list[Span]:
    """The plain patterns; a match that fails its check is dropped and not tried in another form."""
    found = _emails(text) if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
                found.append(("phone", *m.span()))
    return found


@cache
def _plain(c: str) -> str:
    """The ASCII character that ``c`` stands for; nothing for invisible ones."""
    if c in "­​‌‍⁠﻿":
        return ""
    if "！" <= c <= "～":
        return chr(ord(c) - 0xFEE0)
    if "\U0001d7ce" <= c <= "\U0001d7ff":
        return str((ord(c) - 0x1D7CE) % 10)
    return LOOKALIKES.get(c, c)


class Tape:
    """A text under rewriting that knows, for each of its characters, where it came from."""

    def __init__(self, text: str):
        self.text, self.changes = text, 0
        self.start: list[int] | range = range(len(text))
        self.end: list[int] | range = range(1, len(text) + 1)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace spans (ascending, apart); each new character covers its span's source."""
        if not edits:
            return
        text, start, end, at = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            start += [*self.start[at:a], *[self.start[a]] * len(new)]
            end += [*self.end[at:a], *[self.end[b - 1]] * len(new)]
            at = b
        self.text = "".join([*text, self.text[at:]])
        self.start, self.end = [*start, *self.start[at:]], [*end, *self.end[at:]]
        self.changes += len(edits)


def _lookalikes(tape: Tape) -> None:
    edits = [(m.start(), m.end(), _plain(m[0])) for m in _SAME.finditer(tape.text)]
    tape.rewrite([e for e in edits if e[2] != tape.text[e[0]:e[1]]])


def _digit_words(tape: Tape) -> None:
    edits = []
    for run in _DIGITS.finditer(tape.text):
        for m in _DIGIT_PART.finditer(tape.text, *run.span()):
            word = m[0].lower()
            new = "+" if word == "plus" else DIGIT_WORDS.get(word, "" if word.strip(" \t\r\n-") == "" else word)
            if new != m[0]:
                edits.append((*m.span(), new))
    tape.rewrite(edits)


def _marks(tape: Tape) -> None:
    tape.rewrite([(*m.span(), "@" if m[1] else ".") for m in _MARK.finditer(tape.text)])


def _spoken(tape: Tape) -> None:
    edits = []
    for run in _SPOKEN.finditer(tape.text):
        edits += [(*m.span(), "@" if m[1] else ".") for m in _SPOKEN_PART.finditer(tape.text, *run.span())]
    tape.rewrite(edits)


def _spoken_ips(tape: Tape) -> None:
    edits = []
    for run in _SPOKEN_IP.finditer(tape.text):
        edits += [(*m.span(), ".") for m in _SPOKEN_PART.finditer(tape.text, *run.span())]
    tape.rewrite(edits)


def _disguised(text: str) -> bool:
    """Whether any transducer could change the text, by cheap tests."""
    if not text.isascii() and _SAME.search(text):
        return True
    if any(b in text for b in "([{<") and _MARK.search(text):
        return True
    low = text.lower()
    if _SPOKEN_CORE.search(text) and any(_SPOKEN_PART.search(text, *m.span()) for m in _SPOKEN.finditer(text)):
        return True
    return any(w in low for w in DOT_WORDS) and bool(_SPOKEN_IP.search(text)) or bool(_DIGITS.search(low))


def hidden_identifiers(text: str, base: list[Span]) -> list[Span]:
    """Identifiers that appear once the disguises are undone, at source offsets, that no span of ``base`` of their kind covers."""
    if not _disguised(text):
        return []
    tape = Tape(text)
    for step in (_lookalikes, _digit_words, _marks, _spoken, _spoken_ips):
        step(tape)
    if not tape.changes:
        return []
    found = [(kind, tape.start[a], tape.end[b - 1]) for kind, a, b in identifiers(tape.text)]
    plain = {kind: sorted((a, b) for k, a, b in base if k == kind) for kind in KINDS}

    def covered(kind: str, a: int, b: int) -> bool:
        """Plain spans of a kind lie apart: only the last that begins at ``a`` or before can cover a span."""
        at = bisect.bisect_right(plain[kind], (a, len(text)))
        return at > 0 and plain[kind][at - 1][1] >= b

    return [s for s in found if not covered(*s)]


def find_pii(docs: DataFrame, mask: bool = False) -> DataFrame:
    """Personal data in every whole text.

    Returns a row for each row of ``docs``: ``doc_id``, the counts of plain matches ``n_email, n_ip,
    n_card, n_phone``, ``base_sha256``, ``spans`` (plain and undisguised ones, in code points, end
    exclusive), ``n_added`` (how many of them were disguised) and, with ``mask``, ``masked_text``.

    Transducers replace look-alike characters, invisible characters, digits written as words (four
    or more in a row), bracketed and spoken "at" and "dot" in the languages of the texts, also between the digit groups of an IP; each keeps the source span of every
    character, so what is found in the rewritten text is reported where it stands in the source.
    A disguised match within a plain one of its kind is left out; of others that overlap both are
    reported, and their union is masked. A null text counts as empty and stays
    null when masked; repeated rows are each returned; an empty table gives no rows; other columns
    are not read. White space, brackets and plain spans cost linear time, whatever the length of the text; long runs of digit
    words that end in figures may cost more.
    """
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()),
                        ("spans", pa.string()), ("n_added", pa.int64()), *[("masked_text", pa.string())] * mask])

    def work(batch: pa.RecordBatch) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in schema.names}
        out["doc_id"] = batch.column("doc_id").to_pylist()
        for value in batch.column("text").to_pylist():
            text = value or ""
            base = ordered(identifiers(text), KINDS)
            added = hidden_identifiers(text, base)
            for kind in KINDS:
                out[f"n_{kind}"].append(sum(s[0] == kind for s in base))
            out["base_sha256"].append(digest(base))
            out["spans"].append(joined(ordered(base + added, KINDS)))
            out["n_added"].append(len(added))
            if mask:
                out["masked_text"].append(None if value is None else masked(text, base + added))
        return out

    kinds = ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'string'}" for f in schema)
    return texts(docs).mapInArrow(per_batch(schema, work), kinds)


def mask_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data replaced by its kind in brackets and ``n_chars`` (where it exists) set anew.

    Columns and their order stay; the rewriting goes along with the rows, so nothing is shuffled.
    """
    bounded_batches(docs.sparkSession)
    at, length = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for batch in batches:
            new = [None if t is None else masked(t, (base := identifiers(t)) + hidden_identifiers(t, base))
                   for t in batch.column(at).to_pylist()]
            batch = batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))
            if length is not None:
                counts = [n if t is None else len(t) for n, t in zip(batch.column(length).to_pylist(), new)]
                batch = batch.set_column(length, batch.schema.field(length), pa.array(counts, batch.schema.field(length).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)
