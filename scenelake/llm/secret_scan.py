"""Secrets by lexing of assignments.

Three fixed patterns give the base spans. Beside them every text is read as source or configuration: each assignment
sign (``=``, ``:``, ``:=``, ``=>``), tag and call with a name first gives a pair of a target name and a value. Values are
quoted literals, bare words, names of earlier constants and sums of these; constants hand their literals on to the
names they are assigned to. A literal is scored by how sensitive the words of its target's name are and by how little
it looks like a word or a placeholder. All of it works on bytes, each text by itself and to its end; no shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.llm.common import batches_of_text

KINDS = ("assign", "access", "hex", "literal")

#: The base patterns and the least length of what each must hold.
ASSIGN = re.compile(rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}
_ASSIGN_NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_LONG_HEX = re.compile(rb"[0-9a-f]{32}")

#: How sensitive a word, or two words in a row, of a target name are.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "passcode": 0.9, "pass": 0.8, "secret": 1.0, "secrets": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "bearer": 0.8, "authorization": 0.8, "auth": 0.7, "passwort": 1.0, "kennwort": 1.0, "contraseña": 1.0, "clave": 0.8,
    "api key": 1.0, "access key": 1.0, "private key": 1.0, "secret key": 1.0, "signing key": 1.0, "encryption key": 1.0, "master key": 1.0, "account key": 1.0,
    "shared key": 1.0, "client key": 0.8, "mot passe": 1.0,
}
#: Last words of names that tell about a secret without being one.
ABOUT = set("count length len size name type field label url uri path file limit max min ttl expiry expires hint prompt regex pattern policy required enabled version header column param id".split())
#: Parts of literals that stand for a value to be filled in.
PLACEHOLDER = ("example", "changeme", "change_me", "placeholder", "your_", "your-", "your ", "enter ", "please", "xxxx", "todo", "dummy", "sample", "redacted", "none", "null", "true", "false", "undefined", "****", "....", "<", "${", "{{", "%(")
CUTOFF = 0.5
#: Bytes before an assignment sign in which its target name stands.
NAME_BYTES = 160
#: Literals that make up a constant at most; a longer sum counts for its own target and is no constant.
PIECES = 16
#: Parts of words, one of which every sensitive name holds.
_STEMS = (b"pass", b"pwd", b"secret", b"token", b"key", b"credential", b"bearer", b"auth", b"kennwort", b"contrase", b"clave")

_SIGN = re.compile(rb"(?<![=!<>:+*/%&|^~-])(?::=|=>|=|:)(?![=:/])")
#: Bytes of names and of type notes; those from 0x80 on belong to letters beyond ASCII.
_IN_NAME = bytes(c for c in range(256) if chr(c).isalnum() and c < 128 or c >= 128 or chr(c) in "_$@.:>-")
_IN_TYPE = bytes(c for c in range(128) if chr(c).isalnum() or chr(c) in "_.[]<>|, ")
_BLANK = re.compile(rb"[ \t]*")
_QUOTED = re.compile(rb"""[rbfuRBFU@]{0,2}(?:\"{3}((?:[^\\]|\\.)*?)\"{3}|"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)'|`([^`\n]*+)`)""", re.S)
_REFERENCE = re.compile(rb"\$\{?([A-Za-z_]\w*)\}?|([A-Za-z_\x80-\xff][\w\x80-\xff]*(?:(?:\.|->|::)[\w\x80-\xff]+)*)(?![\w\x80-\xff(\[-])")
_PATH = re.compile(rb"[A-Za-z_]+(?:(?:\.|->|::)[A-Za-z_]+)+")
_BARE = re.compile(rb"""[^\s,;"'`()<>{}\[\]]++""")
_JOIN = re.compile(rb"[ \t]*(?:\+|\.\.|&)[ \t]*\\?\n?[ \t]*|[ \t]*\\?\n?[ \t]*(?=[\"'])")
_TAG = re.compile(rb"<([A-Za-z_][\w.:-]{0,100})>([^<>\s][^<>\n]*?)</\1>")
_CALL = re.compile(rb"""\([ \t]*["']([A-Za-z_][\w.-]{0,100})["'][ \t]*,[ \t]*(?=["'])""")
_PARTS = re.compile(r"[A-ZÀ-Þ]+(?![a-zß-ÿ])|[A-ZÀ-Þ]?[a-zß-ÿ]+")


@dataclass(frozen=True)
class Pair:
    """A target name and the literal pieces, as byte ranges, that reach it."""

    at: int
    name: bytes
    pieces: tuple[tuple[int, int], ...]


def name_words(name: bytes) -> list[str]:
    """Lower-case words of a name in snake, kebab, dotted or camel case."""
    return [w.lower() for w in _PARTS.findall(name.decode("utf-8", "replace"))]


def name_weight(name: bytes) -> float:
    """0 to 1: how surely a value assigned to this name is a secret."""
    words = name_words(name)
    if not words or words[-1] in ABOUT:
        return 0.0
    words = [w for w in words if w not in ("de", "of", "the")]
    return max(SENSITIVE.get(w, 0.0) for w in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]) if words else 0.0


def literal_strength(value: bytes) -> float:
    """0 to 1: how little a literal looks like a word, a sentence or a placeholder."""
    if len(value) < 8:
        return 0.0
    text = value.decode("utf-8", "replace")
    lower = text.lower()
    if any(p in lower for p in PLACEHOLDER):
        return 0.0
    counts = Counter(text)
    bits = -sum(c * math.log2(c / len(text)) for c in counts.values())
    plain = text.isalpha() and (text.islower() or text.isupper() or text.istitle())
    kinds = 0.6 if plain else 0.6 if any(c.isspace() for c in text) else 1.0
    return min(1.0, bits / 32.0) * kinds


def _value(text: bytes, at: int, known: dict[bytes, tuple]) -> tuple[tuple[int, int], ...]:
    """Literal pieces of the expression at ``at``; names of constants give the pieces that they were assigned."""
    pieces: list[tuple[int, int]] = []
    first = True
    while True:
        m = _QUOTED.match(text, at)
        if m:
            group = next(g for g in range(1, 5) if m.group(g) is not None)
            pieces.append(m.span(group))
        else:
            m = _REFERENCE.match(text, at)
            name = (m.group(1) or m.group(2)) if m else None
            if name in known:
                pieces.extend(known[name])
            elif first:
                m = _BARE.match(text, at)
                if m:
                    end = m.end()
                    while end > m.start() and text[end - 1] in b".:!?":
                        end -= 1
                    called = text[m.end() : m.end() + 1] in (b"(", b"[")
                    if not called and not _PATH.fullmatch(text, m.start(), end):
                        pieces.append((m.start(), end))
                return tuple(pieces)
            elif m is None:
                return tuple(pieces)
        joint = _JOIN.match(text, m.end())
        if joint is None or (joint.end() == m.end() and text[m.end() : m.end() + 1] not in (b'"', b"'")):
            return tuple(pieces)
        at, first = joint.end(), False


def _name_before(text: bytes, at: int) -> bytes | None:
    """The target name that ends before an assignment sign: plain, quoted, in brackets as an index, or with a type note."""
    low = max(0, at - NAME_BYTES)
    part = text[max(low, text.rfind(b"\n", low, at) + 1) : at].rstrip(b" \t")
    last = part[-1:]
    if last == b"]":
        part = part[:-1].rstrip(b" \t")
        last = part[-1:]
        if last not in (b'"', b"'"):
            return None
    if last in (b'"', b"'"):
        return part[part.rfind(last, 0, -1) + 1 : -1] if part.rfind(last, 0, -1) >= 0 else None
    name = part[len(part.rstrip(_IN_NAME)) :]
    if text[at : at + 1] == b"=":
        head = part.rstrip(_IN_TYPE)
        if head[-1:] == b":" and len(head) < len(part):
            noted = head[:-1].rstrip(b" \t")
            name = noted[len(noted.rstrip(_IN_NAME)) :] or name
    return name.lstrip(b".:>-0123456789") or None


def pairs(text: bytes) -> list[Pair]:
    """All name-literal pairs of a text, constants propagated in the order of the text."""
    found: list[tuple[int, bytes]] = []
    for m in _SIGN.finditer(text):
        name = _name_before(text, m.start())
        if name:
            found.append((m.end(), name))
    for m in _CALL.finditer(text) if b"(" in text else ():
        found.append((m.end(), m.group(1)))
    known: dict[bytes, tuple[tuple[int, int], ...]] = {}
    out: list[Pair] = []
    for at, name in sorted(found):
        pieces = tuple(dict.fromkeys(_value(text, _BLANK.match(text, at).end(), known)))
        if pieces:
            for alias in {name, name.lstrip(b"$@")}:
                if len(pieces) <= PIECES:
                    known[alias] = pieces
                else:
                    known.pop(alias, None)
            out.append(Pair(at, name, pieces))
    for m in _TAG.finditer(text) if b"</" in text else ():
        out.append(Pair(m.start(2), m.group(1), (m.span(2),)))
    return out


def literals(text: bytes, cutoff: float = CUTOFF) -> dict[tuple[int, int], tuple[bytes, float]]:
    """Byte ranges of literals that count as secrets, each with the target name and the score that say so most."""
    out: dict[tuple[int, int], tuple[bytes, float]] = {}
    lower = text.lower()
    if not any(stem in lower for stem in _STEMS):
        return out
    for pair in pairs(text):
        weight = name_weight(pair.name)
        if weight < cutoff:
            continue
        score = weight * literal_strength(b"".join(text[s:e] for s, e in pair.pieces))
        if score < cutoff:
            continue
        for piece in pair.pieces:
            if piece[1] > piece[0] and score > out.get(piece, (b"", 0.0))[1]:
                out[piece] = (pair.name, score)
    return out


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the fixed patterns, in bytes."""
    out = []
    lower = text.lower()
    if any(n in lower for n in _ASSIGN_NAMES):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if b"AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    first = _LONG_HEX.search(text)
    if first:
        out += [(m.start(), m.end(), 2) for m in HEX.finditer(text, first.start()) if m.end() - m.start() >= LEAST["hex"]]
    return out


def scan_text(text: bytes, cutoff: float = CUTOFF) -> list[tuple[int, int, int, bytes | None, float]]:
    """(start, end, kind, name, score) of all spans, in code points, by start, then kind. A literal that lies inside one base span adds nothing."""
    base = base_spans(text)
    spans = [(s, e, k, None, 1.0) for s, e, k in base]
    if b"=" in text or b":" in text or b"</" in text or b"(" in text:
        base.sort()
        for (s, e), (name, score) in literals(text, cutoff).items():
            if not any(a <= s and e <= b for a, b, _ in base):
                spans.append((s, e, 3, name, score))
    if not spans:
        return []
    if not text.isascii():
        heads = np.zeros(len(text) + 1, np.int64)
        np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80, out=heads[1:])
        spans = [(int(heads[s]), int(heads[e]), *rest) for s, e, *rest in spans]
    return sorted(spans, key=lambda x: (x[0], x[2], x[1]))


_SPANS = "array<struct<kind: string, start: int, end: int, name: string, score: double>>"


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """doc_id and spans (kind, start, end, name, score; code points, end exclusive), one row per row of ``docs``.

    Null and empty texts have no spans. ``name`` is the target name of an added literal, null for base spans. Rows that
    repeat and null ids give a row each; an empty table gives none; further columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("name", pa.string()), ("score", pa.float64())]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches_of_text(batches, "_text"):
            rows = [
                [{"kind": KINDS[k], "start": s, "end": e, "name": name and name.decode("utf-8", "replace"), "score": score} for s, e, k, name, score in scan_text(t, cutoff)]
                for t in texts
            ]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(rows, shape)], ["_id", "spans"])

    table = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return table.mapInArrow(task, f"_id {kind}, spans {_SPANS}").withColumnRenamed("_id", id_col)


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of ``find``."""
    base = F.filter("spans", lambda s: s["kind"] != KINDS[-1])
    kinds = F.col("spans")["kind"]
    counts = [(F.size("spans") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS[:-1]]
    return found.select(id_col, *counts, F.sha2(_written(base).cast("binary"), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))
