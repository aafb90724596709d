"""The query language: a string becomes groups of clauses, and a batch becomes relations."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quarry.functions.text import SHORTEST, STOPWORDS, stem

#: A quoted span, a minus with a quoted span, or a run of other characters, tried in this order.
LEXER = re.compile(r"""(?P<phrase>"[^"]*")|(?P<without>-"[^"]*")|(?P<word>\S+)""")
_STOP = frozenset(STOPWORDS)


def terms_of(text: str) -> list[str]:
    """Stems of a text's kept tokens."""
    return [stem(t) for t in re.findall("[a-z0-9]+", text.lower()) if len(t) >= SHORTEST and t not in _STOP]


@dataclass(frozen=True)
class Clause:
    """Terms that must all occur, for a phrase one after the other."""

    terms: tuple[str, ...]
    raw: str
    phrase: bool = False


@dataclass
class Query:
    """A document must match all clauses of one of the groups, none of ``exclude``, and the site."""

    groups: list[list[Clause]] = field(default_factory=list)
    exclude: list[Clause] = field(default_factory=list)
    site: str | None = None

    def clauses(self) -> list[Clause]:
        return [c for g in self.groups for c in g]

    def terms(self) -> list[str]:
        return [t for c in self.clauses() for t in c.terms]

    def surface_terms(self) -> list[str]:
        return [w for c in self.clauses() for w in re.findall("[a-z0-9]+", c.raw.lower())]


def parse(text: str | None) -> Query:
    """Reads a query string; spans without kept tokens add no clause."""
    out = Query()
    open_groups: list[list[Clause]] = [[]]

    def add(to: list[Clause], raw: str, phrase: bool) -> None:
        if terms := terms_of(raw):
            to.append(Clause(tuple(terms), raw, phrase))

    for m in LEXER.finditer(text or ""):
        span = m.group()
        match m.lastgroup:
            case "phrase":
                add(open_groups[-1], span[1:-1], True)
            case "without":
                add(out.exclude, span[2:-1], True)
            case _ if span == "OR":
                open_groups.append([])
            case _ if span.lower().startswith("site:"):
                out.site = span.lower()[5:].strip().strip("/")
            case _ if span[0] == "-" and len(span) > 1:
                add(out.exclude, span[1:], False)
            case _:
                add(open_groups[-1], span, False)
    out.groups = [g for g in open_groups if g]
    return out


PARSED = {"qid": pa.int64(), "grp": pa.int32(), "clause": pa.int32(), "phrase": pa.bool_(), "neg": pa.bool_(), "n_terms": pa.int32(), "place": pa.int32(), "term": pa.string()}
ASKED = {"qid": pa.int64(), "query": pa.string(), "site": pa.string(), "marks": pa.list_(pa.string())}


def parsed_rows(queries: dict[int, str]) -> list[tuple]:
    """A row for each term of each clause; clause numbers are unique within a query."""
    rows = []
    for qid, text in queries.items():
        q = parse(text)
        clauses = [(g, c, False) for g, group in enumerate(q.groups) for c in group] + [(-1, c, True) for c in q.exclude]
        for number, (g, c, neg) in enumerate(clauses):
            rows += [(qid, g, number, c.phrase, neg, len(c.terms), place, term) for place, term in enumerate(c.terms)]
    return rows


def _local(spark: SparkSession, columns: dict[str, pa.DataType], rows: list[tuple]) -> DataFrame:
    """Rows as a relation that needs no job of its own."""
    return spark.createDataFrame(pa.table({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(columns.items())}))


def relations(spark: SparkSession, queries: dict[int, str], rows: list[tuple]) -> tuple[DataFrame, DataFrame]:
    """The batch as relations: terms of clauses, with the number of clauses of their group, and queries with their site and words to mark (longest first)."""
    asked = []
    for qid, text in queries.items():
        q = parse(text)
        asked.append((qid, text, q.site or None, sorted(set(q.surface_terms()), key=lambda w: (-len(w), w))))
    groups: dict[tuple, set] = {}
    for qid, grp, clause, *_ in rows:
        groups.setdefault((qid, grp), set()).add(clause)
    counted = [(*r, len(groups[r[:2]])) for r in rows]
    return _local(spark, PARSED | {"clauses": pa.int32()}, counted), _local(spark, ASKED, asked)
