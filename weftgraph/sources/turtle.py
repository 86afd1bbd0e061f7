"""Turtle, TriG and N-Quads files as triples.  Files are parsed one by one in tasks; a file that does not parse gives an issue row."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.schemas import QUAD, TRIPLE_COLUMNS
from weftgraph.storage import dealt, stored

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"
TOKEN = re.compile(
    r"""
    (?P<skip>[ \t\r\n]+|\#[^\n]*)
  | (?P<iri><[^<>"{}|^`\\\x00-\x20]*>)
  | (?P<text>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
  | (?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
  | (?P<number>[+-]?(?:\d+\.\d+(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+|\d+))
  | (?P<blank>_:[\w\-.]*[\w\-])
  | (?P<type>\^\^)
  | (?P<name>(?:[^\W\d_][\w\-.]*)?:(?:[\w:%\-]|\\.|\.(?=[\w:%\-\\]))*|[A-Za-z]+)
  | (?P<mark>[.;,()\[\]{}=])
    """,
    re.X | re.S,
)
ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
END = ("end", "")
Node = tuple[str, str, str, str]
#: A longer file is read twice, to see that it parses and then for its rows, a few at a time; written files stay below it.
LONG = 8_000_000
#: Rows that go to Spark together, and lines of a written file.
PIECE = 20_000
#: Quads in a part where they are told apart.
EACH = 200_000


class TurtleError(ValueError):
    """Text that is not Turtle."""


def _unescaped(text: str) -> str:
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" else ESCAPES.get(m[1], m[1]), text, flags=re.S)


class _Reader:
    def __init__(self, text: str, name: str) -> None:
        self.tokens = self._tokens(text)
        self.next: tuple[str, str] = next(self.tokens, END)
        self.prefixes, self.base = {}, ""
        self.graph, self.rows, self.scope, self.made = "", [], hashlib.sha256(name.encode()).hexdigest()[:12], 0

    @staticmethod
    def _tokens(text: str) -> Iterator[tuple[str, str]]:
        at = 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if m is None:
                raise TurtleError(f"unexpected {text[at : at + 20]!r}")
            if m.lastgroup != "skip":
                yield m.lastgroup, m[0]
            at = m.end()

    def peek(self) -> tuple[str, str]:
        return self.next

    def take(self, text: str | None = None) -> tuple[str, str]:
        token = self.peek()
        if token[0] == "end" or text is not None and token[1] != text:
            raise TurtleError(f"expected {text or 'more'}, found {token[1]!r}")
        self.next = next(self.tokens, END)
        return token

    def fresh(self) -> Node:
        self.made += 1
        return f"_:{self.scope}-{self.made}", "bnode", "", ""

    def emit(self, s: Node, p: Node, o: Node) -> None:
        self.rows.append((self.graph, s[0], p[0], *o))

    def iri(self, text: str) -> str:
        text = _unescaped(text[1:-1])
        return text if ":" in text or not self.base else self.base + text

    def named(self, text: str) -> str:
        prefix, _, local = text.partition(":")
        if prefix not in self.prefixes:
            raise TurtleError(f"unknown prefix {prefix!r}")
        return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)

    def node(self) -> Node:
        kind, text = self.take()
        if kind == "iri":
            return self.iri(text), "iri", "", ""
        if kind == "blank":
            return f"_:{self.scope}-{text[2:]}", "bnode", "", ""
        if kind == "number":
            return text, "literal", XSD + ("double" if "e" in text.lower() else "decimal" if "." in text else "integer"), ""
        if kind == "text":
            size = 3 if text[:3] in ('"""', "'''") else 1
            value = _unescaped(text[size:-size])
            kind, mark = self.peek()
            if kind == "at":
                self.take()
                return value, "literal", "", mark[1:].lower()
            if kind == "type":
                self.take()
                return value, "literal", self.node()[0], ""
            return value, "literal", "", ""
        if kind == "name":
            if text in ("true", "false"):
                return text, "literal", XSD + "boolean", ""
            return self.named(text), "iri", "", ""
        if text == "[":
            node = self.fresh()
            if self.peek()[1] != "]":
                self.properties(node)
            self.take("]")
            return node
        if text == "(":
            items = []
            while self.peek()[1] != ")":
                items.append(self.node())
            self.take(")")
            rest: Node = (RDF + "nil", "iri", "", "")
            for item in reversed(items):
                cell = self.fresh()
                self.emit(cell, (RDF + "first", "iri", "", ""), item)
                self.emit(cell, (RDF + "rest", "iri", "", ""), rest)
                rest = cell
            return rest
        raise TurtleError(f"unexpected {text!r}")

    def properties(self, subject: Node) -> None:
        while True:
            if self.peek() == ("name", "a"):
                self.take()
                predicate: Node = (RDF + "type", "iri", "", "")
            else:
                predicate = self.node()
            while True:
                self.emit(subject, predicate, self.node())
                if self.peek()[1] != ",":
                    break
                self.take()
            while self.peek() == ("mark", ";"):
                self.take()
            if self.peek()[1] in (".", "]", "}", "") or self.peek()[0] in ("iri", "blank"):
                return

    def read(self) -> Iterator[list[tuple]]:
        """The rows in lists of some statements each."""
        while self.peek()[0] != "end":
            if len(self.rows) >= PIECE:
                yield self.rows
                self.rows = []
            kind, text = self.peek()
            word = text.lstrip("@").lower()
            if kind in ("at", "name") and word in ("prefix", "base") and (kind == "at" or ":" not in text):
                self.take()
                if word == "prefix":
                    name = self.take()[1].rstrip(":")
                    self.prefixes[name] = self.iri(self.take()[1])
                else:
                    self.base = self.iri(self.take()[1])
                if self.peek()[1] == "." and kind == "at":
                    self.take()
            elif text == "{":
                self.block("")
            elif kind == "name" and word == "graph" and ":" not in text:
                self.take()
                self.block(self.node()[0])
            else:
                subject = self.node()
                if self.peek()[1] == "{":
                    self.block(subject[0])
                    continue
                first = len(self.rows)
                if self.peek()[1] != ".":
                    self.properties(subject)
                if self.peek()[0] in ("iri", "blank"):  # the graph of an N-Quads line
                    graph = self.node()[0]
                    self.rows[first:] = [(graph, *row[1:]) for row in self.rows[first:]]
                self.take(".")
        yield self.rows

    def block(self, graph: str) -> None:
        self.take("{")
        self.graph = graph
        while self.peek()[1] != "}":
            subject = self.node()
            if self.peek()[1] not in (".", "}"):
                self.properties(subject)
            if self.peek()[1] == ".":
                self.take()
        self.take("}")
        self.graph = ""


def parsed(text: str, name: str = "") -> list[tuple]:
    """Rows (g, s, p, o, o_kind, o_dt, o_lang); blank nodes carry the file's name so that files don't share them."""
    return [row for rows in _Reader(text.removeprefix("\ufeff"), name).read() for row in rows]


def _pieces(content: bytes, name: str) -> Iterator[list[tuple]]:
    """The rows of a file in lists of some statements each; none before all of it has been seen to parse."""
    text = content.decode().removeprefix("\ufeff")
    if len(content) <= LONG:
        yield [row for rows in _Reader(text, name).read() for row in rows]
        return
    for _ in _Reader(text, name).read():
        pass
    yield from _Reader(text, name).read()


def read(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    """(distinct quads, issues (file, problem)) of Turtle or TriG files; globs are allowed."""
    files = spark.read.format("binaryFile").load(list(paths)).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["g", "s", "p", "o", "o_kind", "o_dt", "o_lang", "file", "problem"]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=names)

        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                path = path.as_py()
                try:
                    # a batch may hold all files of a task: one of them is copied at a time
                    for piece in _pieces(content.as_py(), path):
                        for k in range(0, len(piece), PIECE):
                            yield batch_of([(*r, path, None) for r in piece[k : k + PIECE]])
                except (TurtleError, UnicodeDecodeError, IndexError) as error:
                    yield batch_of([(*[None] * 7, path, str(error))])

    # stored, or files would be parsed once for the quads and once for the issues
    found = stored(files.mapInArrow(run, f"{QUAD}, file string, problem string"), "parsed")
    names = [c.split()[0] for c in QUAD.split(", ")]
    quads = dealt(found.where("problem is null").select(*names), *names, each=EACH).distinct()
    return quads, found.where("problem is not null").select("file", "problem")


def triples(quads: DataFrame) -> DataFrame:
    """Quads without their graph, each triple once."""
    return quads.select(*TRIPLE_COLUMNS).distinct()


def declared_terms(text: DataFrame, prefix: str = "") -> DataFrame:
    """(term) declared as class or property in texts (column value), by their textual form alone."""
    pattern = rf"(?m)^\s*{prefix}(\S+)\s+a\s+owl:(?:Class|ObjectProperty|DatatypeProperty)\b"
    return text.select(F.explode(F.regexp_extract_all("value", F.lit(pattern), 1)).alias("term")).distinct()


def write(quads: DataFrame, path: str) -> None:
    """One N-Quads line a row, partitioned by nothing but Spark's own tasks; files are short enough to be parsed one by one."""
    def term(v: str, kind: str, dt: str, lang: str):
        text = F.concat(F.lit('"'), F.replace(F.replace(F.replace(F.replace(F.col(v), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit('"'))
        literal = F.when(F.col(lang) != "", F.concat(text, F.lit("@"), F.col(lang))).when(F.col(dt) != "", F.concat(text, F.lit("^^<"), F.col(dt), F.lit(">"))).otherwise(text)
        return F.when(F.col(kind) == "literal", literal).when(F.col(kind) == "bnode", F.col(v)).otherwise(F.concat(F.lit("<"), F.col(v), F.lit(">")))

    def node(v: str):
        return F.when(F.col(v).startswith("_:"), F.col(v)).otherwise(F.concat(F.lit("<"), F.col(v), F.lit(">")))

    graph = F.when(F.col("g") == "", F.lit("")).otherwise(F.concat(F.lit("<"), F.col("g"), F.lit("> ")))
    quads.select(F.concat(node("s"), F.lit(" "), node("p"), F.lit(" "), term("o", "o_kind", "o_dt", "o_lang"), F.lit(" "), graph, F.lit(".")).alias("value")).write.option("maxRecordsPerFile", PIECE).text(path)
