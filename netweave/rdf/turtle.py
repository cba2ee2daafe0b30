"""Turtle in and out.

A file is read in ranges of bytes, a task each, and gives what reading it whole
would give. Where a statement ends is plain only to who knows whether a range
begins inside a long string; so a first pass says, for each way a range may begin,
how it ends and which prefixes it declares. Put in a row, these rows (one for each
range, no text in them) tell each range how it begins and what its prefixes mean. A
range then has the statements that begin after the first end of a statement in it,
the last one to its end in the next range.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from zlib import crc32

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netweave.rdf.sparql_parser import Parser, SparqlError
from netweave.rdf.terms import PREFIXES
from netweave.session import cut
from netweave.sources.drawing import opened

SPLIT, AHEAD = 8 << 20, 1 << 16
#: Tasks at most that read ranges; with more ranges a task reads several.
TASKS = 4096
_NORMAL = re.compile(
    r"""\"\"\"|\'\'\'|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'"""
    r"""|@?\b(?:[Pp][Rr][Ee][Ff][Ii][Xx])\s+(?P<name>[\w.-]*):\s*<(?P<space>[^<>]*)>\s*\.?|@?\b(?:[Bb][Aa][Ss][Ee])\s+<(?P<base>[^<>]*)>\s*\.?"""
    r"""|<[^<>\s]*>|\#[^\n]*|\.(?=[\s#]|\Z)"""
)
_LONG = {q: re.compile(rf"(?:[^{q}\\]++|\\.|{q}(?!{q}{q}))*+{q}{q}{q}", re.S) for q in "\"'"}
_IRI = r"""<[^<>"{}|^`\\\s]*>"""
#: A statement of one triple that names its terms in full, as most files that were written by programs have them.
_PLAIN = re.compile(rf"""\s*({_IRI})\s+({_IRI})\s+({_IRI}|"(?:[^"\\\n\r]|\\.)*"(?:@[a-zA-Z]+(?:-\w+)*|\^\^{_IRI})?)\s*\.(?=\s|\Z)""")
#: A range begins in none of the long strings, or in one of either kind.
STATES = ("", '"', "'")


def scan(text: str, state: str, stop: int) -> tuple[list[tuple], str]:
    """What is found in a text that begins in a state, up to a place: ``end`` of a
    statement with the place behind it, declarations of ``prefix`` and ``base``
    with their places; and the state at that place."""
    found, at = [], 0
    while at < stop:
        if state:
            closed = _LONG[state].match(text, at)
            if not closed or closed.end() > stop:
                return found, state
            at, state = closed.end(), ""
            continue
        if (plain := _PLAIN.match(text, at)) and plain.end() <= stop:
            at = plain.end()
            found.append(("end", at - 1, at))
            continue
        token = _NORMAL.search(text, at)
        if not token or token.start() >= stop:
            break
        at = token.end()
        if token[0] in ('"""', "'''"):
            state = token[0][0]
        elif token["space"] is not None:
            found.append(("prefix", token.start(), at, token["name"], token["space"]))
        elif token["base"] is not None:
            found.append(("base", token.start(), at, "", token["base"]))
        elif token[0] == ".":
            found.append(("end", token.start(), at))
    return found, state


def _triples(text: str, prefixes: dict[str, str], base: str, mark: str) -> Iterator[tuple[str, str, str]]:
    """The triples of statements that share their prefixes. Plain statements are
    taken as they stand, up to the first that is not."""
    at = 0
    while not base and (plain := _PLAIN.match(text, at)):
        at = plain.end()
        yield plain.groups()
    parser = Parser(text[at:], prefixes)
    parser.base = base

    def term(part: tuple) -> str:
        if part[0] == "term":
            return part[1]
        if part[0] == "var" and part[1].startswith("__"):
            name = part[1].removeprefix("__")
            return f"_:{name}" if name[0] == "n" else f"_:{mark}{name}"
        raise SparqlError(f"no triple: {part}")

    while parser.peek()[0] != "end":
        for s, p, o in parser.same_subject():
            yield term(s), term(p), term(o)
        parser.take(".")


def parse_turtle(text: str, prefixes: dict[str, str] | None = None, base: str = "", state: str = "", first: bool = True, stop: int | None = None, mark: str = "") -> Iterator[tuple[str, str, str]]:
    """The triples of a Turtle text: prefixes, ``a``, ``;`` and ``,`` lists,
    nested blank nodes, literals with languages and types. A declaration holds from
    where it stands. Of a part of a text: prefixes and state are those it begins
    with, first says whether it begins with a statement, and statements are read that
    begin before stop; mark tells its nameless blank nodes from those of others."""
    prefixes = PREFIXES | (prefixes or {})
    stop = len(text) if stop is None else stop
    found, _ = scan(text, state, len(text))
    begin = None if not first else 0  # of the statements that are held back
    done, piece = begin, 0
    for event in found:
        kind, at, after = event[:3]
        if kind == "end":
            if begin is not None:
                done = after
            elif at < stop:
                begin = done = after
            if at >= stop:
                break
            continue
        if begin is not None and at >= begin and (done is None or at >= done):
            yield from _triples(text[begin:done], prefixes, base, f"{mark}{piece}x")
            begin, done, piece = after, after, piece + 1
        if kind == "prefix":
            prefixes = prefixes | {event[3]: event[4]}
        else:
            base = event[4]
    else:
        done = len(text) if begin is not None else None  # the last statement may lack its end
    if begin is not None and done is not None:
        yield from _triples(text[begin:done], prefixes, base, f"{mark}{piece}x")


def _own(file, begin: int, end: int, size: int, ahead: int = 0) -> tuple[str, int]:
    """The lines that begin in a range of bytes and so much after them, and where
    they end in it."""
    file.seek(max(0, begin - 1))
    data = file.read(end - max(0, begin - 1))
    start = 0 if begin == 0 else data.find(b"\n") + 1
    if begin and not start:
        return "", 0  # one line goes on through the whole range
    while end < size and not data.endswith(b"\n"):
        more = file.read(AHEAD)
        if not more:
            break
        cut_at = more.find(b"\n") + 1
        data += more[:cut_at] if cut_at else more
        file.seek(file.tell() - (len(more) - cut_at if cut_at else 0))
    text = data[start:].decode("utf-8", "replace")
    return text + (file.read(ahead).decode("utf-8", "ignore") if ahead else ""), len(text)


def read_turtle(spark: SparkSession, path: str, split_bytes: int = SPLIT) -> DataFrame:
    """(s, p, o) of the Turtle files under a path, each triple once. Blank nodes
    are told apart by file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size")).filter("size > 0")
    last = F.floor((F.col("size") - 1) / split_bytes)
    ranges = files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("split"))
    ranges = cut(ranges)
    tasks = max(1, min(TASKS, ranges.count()))
    dealt = lambda df: df.repartitionByRange(tasks, "path", "split")  # noqa: E731  so many, or adaptive execution makes one task of rows this small

    def looked(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for path, size, split in zip(part["path"], part["size"], part["split"], strict=True):
                files, inside = opened(path)
                with files.open_input_file(inside) as file:
                    text, stop = _own(file, split * split_bytes, min(size, (split + 1) * split_bytes), size, AHEAD)
                ways = {}
                for state in STATES:
                    events, end = scan(text, state, stop)
                    ways[state] = [end, [[e[0], *e[3:]] for e in events if e[0] != "end"]]
                out.append((path, size, split, json.dumps(ways)))
            yield pd.DataFrame(out, columns=["path", "size", "split", "ways"])

    def told(part: pd.DataFrame) -> pd.DataFrame:
        """A file's ranges in order, a row each."""
        part = part.sort_values("split")
        state, prefixes, base, begins = "", {}, "", []
        for ways in part["ways"]:
            begins.append(json.dumps([state, prefixes, base]))
            state, declared = json.loads(ways)[state]
            for kind, name, space in declared:
                prefixes, base = (prefixes | {name: space}, base) if kind == "prefix" else (prefixes, space)
        return part.assign(begins=begins)[["path", "size", "split", "begins"]]

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, size, split, begins in zip(part["path"], part["size"], part["split"], part["begins"], strict=True):
                state, prefixes, base = json.loads(begins)
                files, inside = opened(path)
                ahead, end = AHEAD, min(size, (split + 1) * split_bytes)
                while True:  # as far as the last statement goes
                    with files.open_input_file(inside) as file:
                        text, stop = _own(file, split * split_bytes, end, size, ahead if end < size else 0)
                    if ahead >= size or any(e[0] == "end" and e[1] >= stop and e[2] < len(text) for e in scan(text, state, len(text))[0]):
                        break
                    ahead *= 4
                mark = f"f{crc32(path.encode())}x"
                found = pd.DataFrame(list(parse_turtle(text, prefixes, base, state, split == 0, stop, f"s{split}x")) if stop else [], columns=["s", "p", "o"])
                for c in "so":
                    found[c] = found[c].str.replace(r"^_:", f"_:{mark}", regex=True)
                yield found

    known = dealt(ranges).mapInPandas(looked, "path string, size long, split long, ways string")
    begun = cut(known.groupBy("path").applyInPandas(told, "path string, size long, split long, begins string"))
    return dealt(begun).mapInPandas(read, "s string, p string, o string").distinct()


def turtle_lines(triples: DataFrame) -> DataFrame:
    """(line): one statement a line, in the N-Triples subset of Turtle, so any
    part of the output can be read by itself."""
    return triples.select(F.concat_ws(" ", "s", "p", "o", F.lit(".")).alias("line"))


def write_turtle(triples: DataFrame, path: str) -> None:
    turtle_lines(triples.distinct()).write.text(path)


def merge(*graphs: DataFrame) -> DataFrame:
    """The union of graphs as sets."""
    out = graphs[0].select("s", "p", "o")
    for g in graphs[1:]:
        out = out.union(g.select("s", "p", "o"))
    return out.distinct()


def rdf_xml_lines(triples: DataFrame) -> DataFrame:
    """(line): RDF/XML descriptions, one for each triple, without the root."""
    split = r"^<(.*[#/])([^#/>]+)>$"
    space, name = F.regexp_extract("p", split, 1), F.regexp_extract("p", split, 2)
    xml = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    from netweave.rdf import terms as T

    o = F.col("o")
    about = F.when(T.is_blank(F.col("s")), F.concat(F.lit('rdf:nodeID="'), F.regexp_replace("s", "^_:", ""), F.lit('"'))).otherwise(F.concat(F.lit('rdf:about="'), xml(T.text(F.col("s"))), F.lit('"')))
    typed, lang = F.regexp_extract(o, r'\^\^<([^>]*)>$', 1), T.language(o)
    value = (
        F.when(T.is_iri(o), F.concat(F.lit(' rdf:resource="'), xml(T.text(o)), F.lit('"/>')))
        .when(T.is_blank(o), F.concat(F.lit(' rdf:nodeID="'), F.regexp_replace(o, "^_:", ""), F.lit('"/>')))
        .otherwise(F.concat(F.when(lang != "", F.concat(F.lit(' xml:lang="'), lang, F.lit('"'))).when(typed != "", F.concat(F.lit(' rdf:datatype="'), typed, F.lit('"'))).otherwise(""), F.lit(">"), xml(T.text(o)), F.lit("</p:"), name, F.lit(">")))
    )
    return triples.select(F.concat(F.lit("<rdf:Description "), about, F.lit('><p:'), name, F.lit(' xmlns:p="'), space, F.lit('"'), value, F.lit("</rdf:Description>")).alias("line"))
