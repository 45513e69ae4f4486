"""Secret scan by assignment-aware lexing.

Texts are read as source or configuration: a lexer finds name-literal pairs
(quoted or bare, joined with + and by reference to earlier names), constants
are propagated from the name they were first given to the names that use them,
and a literal is reported when a name it flows into is fully sensitive and the
literal is no placeholder, or when the name is weaker and the literal looks like
a credential.  Three fixed patterns are always reported.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planarium.llm._store import small_batches
from planarium.llm._text import slices

KINDS = ("assign", "access", "hex", "flow")
# The base patterns.
ASSIGN = re.compile(
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

#: Weight of a word in a target's name.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "pwd": 0.9, "auth": 0.7, "bearer": 0.8, "private": 0.6, "access": 0.5, "key": 0.5, "signature": 0.5, "salt": 0.5}
#: Weight from which a name is fully sensitive, unless it ends in a word that tells about a secret's form or place.
FULL = 0.9
ABOUT = {"length", "len", "count", "size", "type", "limit", "name", "id", "url", "uri", "path", "file", "field", "ttl", "expires", "expiry", "policy", "index", "enabled", "required"}
#: Literals that are joined to judge a name's value.
MANY = 64
PLACEHOLDER = re.compile(r"(?i)^(?:x+|(?:\[secret\])+|\*+|\.+|none|null|true|false|todo|changeme|example|password|secret|token|test|your[-_].*|<.*>|\$\{.*\}|\{\{.*\}\}|%.*%)$")

# Literals: triple-quoted ones may span lines, others may hold escaped characters.
_LITERAL = r"\"\"\".*?\"\"\"|\x27\x27\x27.*?\x27\x27\x27|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"
_PAIR = re.compile(
    r"(?s)(?<![A-Za-z0-9_.\-])[\"']?(?P<name>[A-Za-z_][A-Za-z0-9_.\-]*)[\"']?\x20*(?::=|=>|[:=])\x20*"
    rf"(?P<value>(?:{_LITERAL}|[A-Za-z0-9+/_.=\-]+)(?:\x20*\+\x20*(?:{_LITERAL}|[A-Za-z_][A-Za-z0-9_.]*))*)"
)
_PART = re.compile(rf"(?s)(?P<q>{_LITERAL})|(?P<bare>[A-Za-z0-9+/_.=\-]+)")
#: An element of mark-up with its content, and a block that a configuration file indents below its key.
_ELEMENT = re.compile(r"<(?P<name>[A-Za-z_][A-Za-z0-9_.\-]*)>(?P<value>[^<>\n]+)</(?P=name)>")
_INDENTED = re.compile(r"(?m)^(?P<in>\x20*)(?P<name>[A-Za-z_][A-Za-z0-9_.\-]*):\x20*[|>][+-]?\n(?P<value>(?:(?P=in)\x20+\S[^\n]*(?:\n|\Z))+)")
_NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of the fixed patterns, leftmost and not overlapping within a kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


def name_weight(name: str) -> float:
    """How sensitive a target's name is, from the words it is made of."""
    found = [w.lower() for w in _NAME_WORDS.findall(name)]
    pairs = ["".join(p) for p in zip(found, found[1:])]
    weights = [SENSITIVE.get(w, 0.0) for w in found + pairs]
    return min(1.0, sum(sorted(weights)[-2:])) if weights else 0.0


def literal_weight(value: str) -> float:
    """How much a literal looks like a credential: its entropy and kinds of characters."""
    if len(value) < 6 or " " in value.strip() or PLACEHOLDER.match(value):
        return 0.0
    n = len(value)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    kinds = sum(any(f(c) for c in value) for f in (str.islower, str.isupper, str.isdigit)) + any(not c.isalnum() for c in value)
    return min(1.0, bits / 4.0) * min(1.0, 0.5 + 0.25 * (kinds - 1))


def fully_sensitive(name: str) -> bool:
    """Does the name alone say that its value is a secret?"""
    found = _NAME_WORDS.findall(name)
    return name_weight(name) >= FULL and found[-1].lower() not in ABOUT


class _Value:
    """What a name was given: literals (value, start, end) and references to what other names were given."""

    __slots__ = ("head", "parts")

    def __init__(self, parts: list):
        self.parts, self.head = parts, None

    def gather(self, out: dict[tuple[int, int], None], seen: set[int]) -> None:
        """Add the places of all literals that flow in, without walking again what was `seen`."""
        todo = [self]
        while todo:
            v = todo.pop()
            if id(v) in seen:
                continue
            seen.add(id(v))
            for x in v.parts:
                if isinstance(x, _Value):
                    todo.append(x)
                else:
                    out[x[1], x[2]] = None

    def literals(self) -> list[tuple[str, int, int]]:
        """The distinct literals that flow in, in order, however often names repeat them: all, or MANY of more.

        Each value is worked out once, after those that it refers to.
        """
        todo = [self] if self.head is None else []
        while todo:
            v = todo[-1]
            if v.head is None:
                v.head = []  # a value that refers to itself adds nothing there
                todo += [x for x in v.parts if isinstance(x, _Value) and x.head is None]
                continue
            todo.pop()
            if v.head:
                continue
            out: dict[tuple[int, int], str] = {}
            for x in v.parts:
                for value, start, end in x.head if isinstance(x, _Value) else [x]:
                    if len(out) < MANY:
                        out.setdefault((start, end), value)
            v.head = [(value, start, end) for (start, end), value in out.items()]
        return self.head


def _assignments(text: str) -> list[tuple[str, _Value, bool]]:
    """Name-value pairs in order, and whether a call or index follows; a name used before its assignment means the first one after."""
    known: dict[str, _Value] = {}
    first: dict[str, _Value] = {}
    open_: list[tuple[list, int, str]] = []
    out: list[tuple[str, _Value, bool]] = []
    for m in _PAIR.finditer(text):
        parts: list = []
        base = m.start("value")
        for p in _PART.finditer(m["value"]):
            a, b = base + p.start(), base + p.end()
            if p["q"] is not None:
                k = 3 if p["q"][:3] in ('"""', "\'\'\'") and len(p["q"]) >= 6 else 1
                parts.append((p["q"][k:-k], a + k, b - k))
            elif not p["bare"].strip("+"):  # the sign between two parts
                continue
            elif p["bare"] in known:
                parts.append(known[p["bare"]])
            else:
                open_.append((parts, len(parts), p["bare"]))
                parts.append((p["bare"], a, b))
        value = known[m["name"]] = _Value(parts)
        first.setdefault(m["name"], value)
        out.append((m["name"], value, text[m.end() : m.end() + 1] in ("(", "[")))
    for parts, i, name in open_:
        if name in first:
            parts[i] = first[name]
    if "</" in text:
        out += [(m["name"], _Value([(m["value"], m.start("value"), m.end("value"))]), False) for m in _ELEMENT.finditer(text)]
    if ":" in text and ("|" in text or ">" in text):
        for m in _INDENTED.finditer(text):
            a, b = m.start("value"), m.end("value")
            v = text[a:b]
            out.append((m["name"], _Value([(v.strip(), a + len(v) - len(v.lstrip()), b - len(v) + len(v.rstrip()))]), False))
    return out


def flow_spans(text: str, least: float = 0.5) -> list[tuple[int, int, str]]:
    """Literals that reach a sensitive name, directly, joined or through other names, before or after their use."""
    if ":" not in text and "=" not in text and "</" not in text:
        return []
    found: dict[tuple[int, int], None] = {}
    reported: set[int] = set()  # values all of whose literals have been found
    rest = []
    for name, given, call in _assignments(text):
        weight = name_weight(name)
        if not weight:
            continue
        parts = given.literals()
        value = "".join(v for v, _, _ in parts)
        named = fully_sensitive(name) and value.strip() and not call and not PLACEHOLDER.match(value.strip())
        if named or weight * literal_weight(value) >= least:
            rest.append(given)
    for given in rest:  # each value is walked once, whatever names it reaches
        given.gather(found, reported)
    return [(a, b, "flow") for a, b in found if b > a]


def scan(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans with those the lexer adds; both by start, then kind."""
    order = lambda s: (s[0], KINDS.index(s[2]), s[1])
    base = sorted(base_spans(text), key=order)
    return base, sorted(base + flow_spans(text), key=order)


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = [scan(t or "") for t in batch.column("text").to_pylist()]
        count = lambda kind: pa.array([sum(s[2] == kind for s in base) for base, _ in rows], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), count("assign"), count("access"), count("hex"), pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in rows], pa.string()), pa.array([joined(a) for _, a in rows], pa.string())],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_assign, n_access, n_hex, base_sha256, spans), one for each row of docs(doc_id, text).

    Offsets count code points, ends are exclusive.  A null text is empty and has
    no spans; doc_id may be null or repeat; a text of any length is read whole;
    no rows give no rows.  Columns other than doc_id and text are not read.
    """
    small_batches(docs)
    return docs.select("doc_id", "text").mapInArrow(_scan_batches, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def masked(text: str, mask: str = "[secret]") -> str:
    """The text with every span replaced; overlapping spans become one mask."""
    _, spans = scan(text)
    out, at, end = [], 0, -1
    for a, b, _ in spans:
        if a > end:
            out += [text[at:a], mask]
        at = end = max(end, b)
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """docs with secrets masked in text and n_chars counted anew where it changed; other columns are kept as they are."""
    small_batches(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at = batch.schema.get_field_index("text")
            texts = [None if t is None else masked(t, mask) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, "text", pa.array(texts, batch.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
