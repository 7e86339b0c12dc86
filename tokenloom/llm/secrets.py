"""Secret scanning through a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over the trigrams
(of ASCII-lower-cased UTF-8 bytes) that any match must contain. Documents are
taken in segments; a segment's inverted index holds, for every trigram that some
query names, the sorted numbers of the documents that contain it. A rule's query
intersects and unites those postings, and the rule's expression is run only over
the candidates it leaves. A rule without a mandatory trigram (bare hexadecimal
runs) has the query TRUE and scans every document of the segment.

Defined cases: a null text counts as empty and has no spans; repeated documents
are each scanned; a document of any length is one entry of its segment and is
scanned whole; spans that start together are in the order of the rules; an empty
table gives no rows. Other columns are carried along untouched, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, free_name

#: Limits of the analysis: strings kept exactly, and members of a character class spelt out.
_MAX_EXACT, _MAX_CLASS = 64, 4
_SEGMENT_BYTES = 4 << 20


@dataclass(frozen=True)
class Rule:
    """kind: label of its spans. size_group and min_size: a match whose group is shorter is dropped."""

    kind: str
    pattern: str
    size_group: int = 0
    min_size: int = 0

    def spans(self, text: str, compiled: re.Pattern) -> list[tuple[int, int]]:
        g = self.size_group
        return [m.span() for m in compiled.finditer(text) if m.end(g) - m.start(g) >= self.min_size]


BASE_RULES = (
    Rule("assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}"),  # the runs of [0-9a-f]+ that have 32 characters or more
)
EXTRA_RULES = (
    # The BEGIN line, header fields, the base64 body as far as it goes, and the END line if there is one.
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:\s+[A-Z][A-Za-z-]+:[^\n]*)*(?:(?:\s|\\[nr])*[A-Za-z0-9+/]{16,}={0,2})*(?:\r?\n[A-Za-z0-9+/]{1,15}={0,2}(?![^\r\n]))?(?:(?:\s|\\[nr])*(?:[A-Za-z0-9+/]{1,15}={0,2}(?:\s|\\[nr])*)?-----END (?:[A-Z]+ )*PRIVATE KEY-----)?"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
)
RULES = BASE_RULES + EXTRA_RULES

# A query is True, a trigram (bytes), or ("and" | "or", frozenset of queries).


def both(*qs):
    parts = frozenset(y for q in qs if q is not True for y in (q[1] if isinstance(q, tuple) and q[0] == "and" else [q]))
    return True if not parts else next(iter(parts)) if len(parts) == 1 else ("and", parts)


def either(*qs):
    if any(q is True for q in qs):
        return True
    parts = frozenset(qs)
    return next(iter(parts)) if len(parts) == 1 else ("or", parts)


def of_strings(strings: set[bytes]):
    """What a text must contain if it contains one of the strings."""
    return either(*(both(*(s[i : i + 3] for i in range(len(s) - 2))) for s in strings)) if strings else True


def fold_case(s: str) -> bytes:
    return s.encode().lower()


class _Run:
    """Strings that a stretch of an expression matches, as far as they are known exactly."""

    def __init__(self) -> None:
        self.exact: set[bytes] = {b""}
        self.query = True

    def append(self, strings: set[bytes] | None, query=True) -> bool:
        """strings: all that the next part can match, or None; query: what its match must contain anyway. True if all is still known."""
        self.query = both(self.query, query)
        if strings is not None and len(self.exact) * len(strings) <= _MAX_EXACT:
            self.exact = {a + b for a in self.exact for b in strings}
            return True
        self.flush()
        if strings is not None:
            self.query = both(self.query, of_strings(strings))
        return False

    def flush(self) -> None:
        self.query = both(self.query, of_strings(self.exact))
        self.exact = {b""}


def _class(items) -> set[bytes] | None:
    out: set[bytes] = set()
    for op, arg in items:
        if op is sre.LITERAL:
            out.add(fold_case(chr(arg)))
        elif op is sre.RANGE and arg[1] - arg[0] < _MAX_CLASS:
            out |= {fold_case(chr(c)) for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= 2 * _MAX_CLASS else None


def _analyse(nodes) -> tuple[set[bytes] | None, object]:
    """All strings a sequence can match (None: too many), and its query."""
    run, whole = _Run(), True
    for op, arg in nodes:
        strings, query = None, True
        if op is sre.LITERAL:
            strings = {fold_case(chr(arg))}
        elif op is sre.IN:
            strings = _class(arg)
        elif op is sre.AT:
            strings = {b""}
        elif op is sre.SUBPATTERN:
            strings, query = _analyse(arg[3])
        elif op is sre.BRANCH:
            parts = [_analyse(x) for x in arg[1]]
            strings = set().union(*(s for s, _ in parts)) if all(s is not None for s, _ in parts) else None
            query = either(*(both(q, of_strings(s)) if s is not None else q for s, q in parts))
            if strings is not None:
                query = True  # the strings say it all
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, body = arg
            inner, query = _analyse(body)
            if low == 0:
                strings, query = ({b""} | inner if high == 1 and inner is not None else None), True
            elif low == high and inner is not None and len(inner) ** low <= _MAX_EXACT:
                strings = {b""}
                for _ in range(low):
                    strings = {a + b for a in strings for b in inner}
            elif inner is not None:
                query = both(query, of_strings(inner))
        whole = run.append(strings, query) and whole
    if whole:
        return run.exact, run.query
    run.flush()
    return None, run.query


def trigram_query(pattern: str):
    strings, query = _analyse(parser.parse(pattern))
    return both(query, of_strings(strings)) if strings is not None else query


def trigrams_in(query) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(trigrams_in, query[1]))


class TrigramIndex:
    """Inverted index of a segment over the trigrams that queries name."""

    def __init__(self, texts: list[bytes], numbers: np.ndarray, n_trigrams: int):
        """numbers: for each of the 2**24 trigrams, its number from 1, or 0 for one that no query names."""
        self.n = len(texts)
        data = np.frombuffer(b"\0\0".join([t.lower() for t in texts]) + b"\0\0", np.uint8)
        ends = np.cumsum([len(t) + 2 for t in texts])
        gram = data[:-2].astype(np.uint32)
        gram <<= np.uint32(8)
        gram |= data[1:-1]
        gram <<= np.uint32(8)
        gram |= data[2:]
        number = numbers[gram]
        at = np.flatnonzero(number)
        pairs = np.unique(number[at].astype(np.int64) * self.n + np.searchsorted(ends, at, "right"))
        which, docs = pairs // self.n, pairs % self.n
        bounds = np.searchsorted(which, np.arange(1, n_trigrams + 2))
        self.postings = [docs[a:b] for a, b in zip(bounds, bounds[1:])]

    def candidates(self, query, number_of: dict[bytes, int]) -> np.ndarray:
        if query is True:
            return np.arange(self.n)
        if isinstance(query, bytes):
            return self.postings[number_of[query] - 1]
        parts = sorted((self.candidates(q, number_of) for q in query[1]), key=len)
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
        return out


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r, re.compile(r.pattern), trigram_query(r.pattern)) for r in rules]
        self.number_of = {g: i + 1 for i, g in enumerate(sorted(set().union(*(trigrams_in(q) for _, _, q in self.rules))))}
        if len(self.number_of) >= 1 << 16:
            raise ValueError("the rules name too many trigrams for one index")
        self.numbers = np.zeros(1 << 24, np.uint8 if len(self.number_of) < 256 else np.uint16)
        for g, i in self.number_of.items():
            self.numbers[int.from_bytes(g, "big")] = i

    def scan(self, texts: list[bytes]) -> list[list[tuple[str, int, int]]]:
        """Per text its spans (kind, start, end) by start, then in the order of the rules."""
        out: list[list] = [[] for _ in texts]
        index = TrigramIndex(texts, self.numbers, len(self.number_of))
        decoded: dict[int, str] = {}
        for k, (rule, compiled, query) in enumerate(self.rules):
            for i in index.candidates(query, self.number_of).tolist():
                if i not in decoded:
                    decoded[i] = texts[i].decode()
                out[i] += [(a, k, rule.kind, b) for a, b in rule.spans(decoded[i], compiled)]
        return [[(kind, a, b) for a, _, kind, b in sorted(x)] for x in out]


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def find_secrets(docs: DataFrame, *, text: str = "text", rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, str]:
    """docs with one column of spans in code points, end exclusive, and that column's name."""
    name, at = free_name(docs, "secrets"), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            texts = [t or b"" for t in batch.column(at).cast(pa.binary()).to_pylist()]
            spans: list = []
            for a, b in chunks([len(t) for t in texts], _SEGMENT_BYTES):
                spans += [[{"kind": k, "start": x, "end": y} for k, x, y in found] for found in scanner.scan(texts[a:b])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, pa.list_(_SPAN))], [*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, SPANS)])), name


def redact(docs: DataFrame, *, text: str = "text", rules: tuple[Rule, ...] = RULES, mark: str = "[REDACTED]") -> DataFrame:
    """docs with every span replaced by mark; overlapping spans count as one."""
    at = docs.columns.index(text)

    def cut(body: str, spans: list[tuple[str, int, int]]) -> str:
        pieces, end = [], 0
        for _, a, b in spans:  # by start
            if a >= end:
                pieces += [body[end:a], mark]
            end = max(end, b)
        return "".join([*pieces, body[end:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            whole = batch.column(at)
            texts = [t or b"" for t in whole.cast(pa.binary()).to_pylist()]
            new: dict[int, str] = {}
            for a, b in chunks([len(t) for t in texts], _SEGMENT_BYTES):
                new |= {a + i: cut(texts[a + i].decode(), spans) for i, spans in enumerate(scanner.scan(texts[a:b])) if spans}
            if new:
                whole = pa.array([new.get(i, x) for i, x in enumerate(whole.to_pylist())], pa.string())
            yield pa.RecordBatch.from_arrays([whole if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
