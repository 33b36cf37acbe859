r"""Secret scans through a trigram index.

From each rule's regular expression a Boolean trigram query is derived: alternatives (OR) of sets of trigrams (AND)
that every match must contain. Each task indexes its own documents, keeping postings of the trigrams that some query
asks for, intersects the postings and runs the expressions only over the documents left. A rule whose expression
forces no trigram, such as a run of hexadecimal digits, scans all documents. Texts are never shuffled: an index
belongs to the documents of its own batch, so any number of machines can work on it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product
from re import _constants as op
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: Strings kept while a stretch of an expression is still known in full, and bytes indexed at a time.
MAX_STRINGS, SLICE = 32, 4 << 20


@dataclass(frozen=True)
class Rule:
    """A match counts if `group` of it (0: all of it) has at least `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: In this order kinds are listed where two spans start together.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
    Rule("hosting", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("map_key", r"AIza[A-Za-z0-9_-]{35,}"),
)
Query = list[frozenset[bytes]]  # any of these sets of trigrams; [frozenset()] asks for nothing


def _lower(text: str) -> str:
    return text.encode().lower().decode()


def _any(a: Query, b: Query) -> Query:
    both = {*a, *b}
    return [x for x in both if not any(y < x for y in both)]


def _all(a: Query, b: Query) -> Query:
    return _any([x | y for x in a for y in b], []) if len(a) * len(b) <= 4 * MAX_STRINGS else min(a, b, key=len)


def _asked(strings: set[str]) -> Query:
    out: Query = []
    for s in strings:
        b = s.encode()
        out = _any(out, [frozenset(b[i : i + 3] for i in range(len(b) - 2))])
    return out


def _class(items) -> set[str] | None:
    found: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            found.add(_lower(chr(value)))
        elif kind is op.RANGE and value[1] - value[0] < 4 * MAX_STRINGS:
            found |= {_lower(chr(c)) for c in range(value[0], value[1] + 1)}
        else:
            return None
    return found if len(found) <= 4 else None


def _walk(nodes) -> tuple[set[str] | None, Query]:
    """All strings the nodes match, in lower case, if they are few; else None and what every match contains."""
    query: Query = [frozenset()]
    run: set[str] = {""}
    whole = True
    for kind, value in nodes:
        strings, own, after = None, [frozenset()], False
        if kind is op.LITERAL:
            strings = {_lower(chr(value))}
        elif kind is op.IN:
            strings = _class(value)
        elif kind is op.SUBPATTERN:
            strings, own = _walk(value[3])
        elif kind is op.BRANCH:
            parts = [_walk(x) for x in value[1]]
            strings = set().union(*(s for s, _ in parts)) if all(s is not None for s, _ in parts) else None
            own = []
            for s, q in parts:
                own = _any(own, q if s is None else _asked(s))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            least, most, inner = value
            one, own = _walk(inner)
            if one is not None and (least, most) == (0, 1):
                strings, own = one | {""}, [frozenset()]
            elif one is not None and least and len(one) ** min(least, 3) <= MAX_STRINGS:
                strings, after = {"".join(x) for x in product(one, repeat=min(least, 3))}, (least, most) != (min(least, 3),) * 2
            elif not least:
                own = [frozenset()]
        elif kind is op.AT:
            strings = {""}
        if strings is not None and len(run) * len(strings) <= MAX_STRINGS:
            run = {a + b for a in run for b in strings}
        else:
            query, whole = _all(query, _asked(run)), False
            if strings is None:
                query, run = _all(query, own), {""}
            else:
                run = strings
        if after:  # more may follow
            query, run, whole = _all(query, _asked(run)), {""}, False
    return (run, query) if whole else (None, _all(query, _asked(run)))


def trigram_query(pattern: str) -> Query | None:
    """Sets of lower-case trigrams of which every match contains one set whole; None if no trigram is forced."""
    strings, query = _walk(parser.parse(pattern))
    query = query if strings is None else _asked(strings)
    return None if not query or frozenset() in query else sorted(query, key=sorted)


class TrigramIndex:
    """Postings (document numbers in order) of the wanted trigrams over one batch of texts."""

    def __init__(self, texts: list[bytes], wanted: list[bytes], table: np.ndarray, codes: np.ndarray):
        gap = b"\xff\xff"  # in no UTF-8 text
        whole = np.frombuffer(gap.join(texts), np.uint8)
        starts = np.cumsum([0] + [len(t) + len(gap) for t in texts[:-1]])
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for at in range(0, max(0, len(whole) - 2), SLICE):
            part = whole[at : at + SLICE + 2].astype(np.int32)
            code = part[:-2] << 16 | part[1:-1] << 8 | part[2:]
            hits = np.flatnonzero(table[code])
            found.append((np.searchsorted(codes, code[hits]), np.searchsorted(starts, hits + at, side="right") - 1))
        which = np.concatenate([f[0] for f in found]) if found else np.empty(0, np.int64)
        docs = np.concatenate([f[1] for f in found]) if found else np.empty(0, np.int64)
        self.postings = {t: np.unique(docs[which == i]) for i, t in enumerate(wanted)}

    def candidates(self, query: Query) -> np.ndarray:
        out = np.empty(0, np.int64)
        for trigrams in query:
            lists = sorted((self.postings[t] for t in trigrams), key=len)
            docs = lists[0]
            for other in lists[1:]:
                docs = np.intersect1d(docs, other, assume_unique=True)
            out = np.union1d(out, docs)
        return out.astype(np.int64)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id (nulls stay) and `spans`, an array of (kind, start, end) by start, then by the rules' order.

    Positions are code points, end exclusive; matches of one kind never overlap. Null and empty texts have no spans.
    Rows stay apart: repeated rows give repeated results and an empty table an empty one. Very long texts are
    read whole; the index takes rows in slices, so memory follows the slice, not the table. Further columns of any name
    are not looked at and not returned.
    """
    rules = tuple(rules)

    def run(batches):
        compiled = [(r, re.compile(r.pattern, re.ASCII), trigram_query(r.pattern)) for r in rules]
        wanted = sorted({t for _, _, q in compiled if q for s in q for t in s}, key=lambda t: int.from_bytes(t))
        codes = np.array([int.from_bytes(t) for t in wanted], np.int64)
        table = np.zeros(1 << 24, bool)
        table[codes] = True
        schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))])
        for batch in common.sliced(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            spans: list[list[tuple]] = [[] for _ in texts]
            index = TrigramIndex([t.encode("utf-8", "replace").lower() for t in texts], wanted, table, codes)
            for order, (rule, pattern, query) in enumerate(compiled):
                for i in range(len(texts)) if query is None else index.candidates(query).tolist():
                    for m in pattern.finditer(texts[i]):
                        if m.end(rule.group) - m.start(rule.group) >= rule.least:
                            spans[i].append((m.start(), order, m.end()))
            rows = [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in sorted(s)] for s in spans]
            yield common.record_batch(schema, batch.column(0), rows)

    chosen = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return chosen.mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")
