"""SPARQL to DataFrames.

A pattern becomes a frame with a column for each variable. Basic patterns are
filters of the triple table joined on shared variables, the most selective
first and connected ones next; OPTIONAL is a left join, MINUS and NOT EXISTS
are anti-joins, UNION is a union of bags, and paths with ``*`` or ``+`` are
closures that grow by their newest pairs. Catalyst sees one plan and prunes and
pushes from there. Variables hold terms (see ``terms``) or typed values; what
may be unbound is known before the plan is made, so that only such variables
are joined null-tolerantly.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweave.rdf import terms as T
from netweave.rdf.sparql_parser import SparqlError, parse
from netweave.session import cut

TERM, NUMBER, INTEGER, TEXT, BOOL = "term", "number", "integer", "text", "bool"


@dataclass
class Solutions:
    """A frame, the kinds of its variables, and those that may be unbound."""

    df: DataFrame
    kinds: dict[str, str]
    unsure: set[str] = field(default_factory=set)
    deferred: list = field(default_factory=list)  # filters on variables of an outer pattern


@dataclass
class Value:
    col: Column
    kind: str


def as_term(v: Value) -> Column:
    if v.kind == TERM:
        return v.col
    kind = {INTEGER: "integer", NUMBER: "double", BOOL: "boolean"}.get(v.kind)
    return T.literal(v.col, kind)


def as_number(v: Value) -> Column:
    return {TERM: lambda: T.number(v.col), TEXT: lambda: F.lit(None).cast("double"), BOOL: lambda: F.lit(None).cast("double")}.get(v.kind, lambda: v.col.cast("double"))()


def as_text(v: Value) -> Column:
    return T.text(v.col) if v.kind == TERM else v.col.cast("string")


def as_instant(v: Value) -> Column:
    return T.instant(v.col) if v.kind == TERM else F.lit(None).cast("double")


def as_bool(v: Value) -> Column:
    """The effective boolean value; null where there is none."""
    if v.kind == BOOL:
        return v.col
    if v.kind in (NUMBER, INTEGER):
        return v.col != 0
    if v.kind == TEXT:
        return v.col != ""
    n, boolean = T.number(v.col), v.col.endswith(f"^^<{T.XSD}boolean>")
    return F.when(boolean, T.text(v.col) == "true").when(n.isNotNull(), n != 0).when(T.is_literal(v.col), T.text(v.col) != "")


def turned(path: tuple) -> tuple:
    """The path walked from its object to its subject."""
    kind = path[0]
    if kind == "term":
        return ("inv", path)
    if kind == "inv":
        return path[1]
    if kind == "alt":
        return (kind, [turned(x) for x in path[1]])
    if kind == "seq":
        return (kind, [turned(x) for x in reversed(path[1])])
    if kind == "not":
        return (kind, [(not inverse, n) for inverse, n in path[1]])
    return (kind, turned(path[1]))


def _endless(path: tuple) -> bool:
    """Whether a path has a part that is walked on and on."""
    if path[0] in ("star", "plus"):
        return True
    if path[0] in ("alt", "seq"):
        return any(_endless(x) for x in path[1])
    return path[0] in ("inv", "opt") and _endless(path[1])


class Compiler:
    def __init__(self, triples: DataFrame, counts: dict[str, int] | None = None):
        self.triples = triples.select("s", "p", "o")
        self.counts = counts or {}
        self.spark = triples.sparkSession

    # -- triples and paths
    def scan(self, s: tuple, p: tuple, o: tuple) -> Solutions:
        df, kinds, wanted = self.triples, {}, []
        for column, part in (("s", s), ("p", p), ("o", o)):
            if part[0] == "term":
                df = df.filter(F.col(column) == part[1])
            elif part[1] in kinds:
                df = df.filter(F.col(column) == F.col(kinds[part[1]]))
            else:
                kinds[part[1]] = column
                wanted.append(F.col(column).alias(part[1]))
        return Solutions(df.select(*wanted) if wanted else df.select(F.lit(1).alias("__one")), dict.fromkeys(kinds, TERM))

    def pairs(self, path: tuple, start: str | DataFrame | None = None) -> DataFrame:
        """(s, o) of a path. start: only from that term, or from those of a frame
        (s)."""
        kind = path[0]

        def begin(df: DataFrame) -> DataFrame:
            if start is None:
                return df
            return df.filter(F.col("s") == start) if isinstance(start, str) else df.join(start, "s", "left_semi")

        if kind == "term":
            return begin(self.triples.filter(F.col("p") == path[1]).select("s", "o"))
        if kind == "inv":
            return begin(self.pairs(path[1]).select(F.col("o").alias("s"), F.col("s").alias("o")))
        if kind == "alt":
            out = self.pairs(path[1][0], start)
            for branch in path[1][1:]:
                out = out.union(self.pairs(branch, start))
            return out
        if kind == "seq":
            out = self.pairs(path[1][0], start)
            for step in path[1][1:]:
                right = self.pairs(step).select(F.col("s").alias("__m"), F.col("o").alias("__o"))
                out = out.join(right, out["o"] == right["__m"]).select("s", F.col("__o").alias("o"))
            return out
        if kind == "not":
            forward, backward = [n for inverse, n in path[1] if not inverse], [n for inverse, n in path[1] if inverse]
            out = self.triples.filter(~F.col("p").isin(*forward)).select("s", "o") if forward or not backward else None
            if backward:
                back = self.triples.filter(~F.col("p").isin(*backward)).select(F.col("o").alias("s"), F.col("s").alias("o"))
                out = back if out is None else out.union(back)
            return begin(out)
        if kind in ("star", "plus", "opt"):
            steps = self.pairs(path[1]).distinct()
            reached = begin(steps) if kind == "opt" else self.closure(steps, start)
            if kind == "plus":
                return reached
            own = self.triples.select(F.col("s").alias("n")).union(self.triples.select("o")).distinct()
            if start is not None:
                own = self.spark.createDataFrame([(start,)], "n string") if isinstance(start, str) else start.select(F.col("s").alias("n"))
            return reached.union(own.select(F.col("n").alias("s"), F.col("n").alias("o"))).distinct()
        raise SparqlError(f"no such path: {kind}")

    def closure(self, steps: DataFrame, start: str | DataFrame | None) -> DataFrame:
        """Pairs joined by one or more steps; each round makes and writes only new
        pairs, from the start where there is one."""
        steps = cut(steps)
        if isinstance(start, str):
            return self.reached_from(steps, start)
        first = steps
        if start is not None:
            first = steps.join(start, "s", "left_semi")
        new = cut(first)
        reached = new
        while new.take(1):
            further = new.join(steps.select(F.col("s").alias("o"), F.col("o").alias("__o")), "o").select("s", F.col("__o").alias("o")).distinct()
            new = cut(further.join(reached, ["s", "o"], "left_anti"))
            reached = reached.union(new)  # tables that are there already, one more each round
        return reached

    def reached_from(self, steps: DataFrame, start: str) -> DataFrame:
        """(s, o): what one term reaches. Of each term's steps one is kept, that to
        the term with the fewest steps into it, and what kept steps lead to is found by
        doubling: chains take a number of rounds that grows with the logarithm of
        their length. Then all steps are taken from what was new, until nothing is."""
        into = steps.groupBy("o").agg(F.count("*").alias("n"))
        kept = steps.join(into, "o").groupBy("s").agg(F.min(F.struct("n", "o")).alias("best"))
        jumps = [cut(kept.select("s", F.col("best.o").alias("o")))]
        reached = None
        new = cut(steps.filter(F.col("s") == start).select("o").distinct())
        while new.take(1):
            turn = 0
            while True:  # new holds what fewer than 2 ** turn kept steps lead to
                if turn == len(jumps):
                    far = jumps[-1]
                    jumps.append(cut(far.select("s", F.col("o").alias("m")).join(far.select(F.col("s").alias("m"), "o"), "m").select("s", "o")))
                further = new.select(F.col("o").alias("s")).join(jumps[turn], "s").select("o").distinct().join(new, "o", "left_anti")
                more = cut(further if reached is None else further.join(reached, "o", "left_anti"))
                if not more.take(1):
                    break
                new, turn = cut(new.union(more)), turn + 1
            reached = new if reached is None else cut(reached.union(new))
            new = cut(new.select(F.col("o").alias("s")).join(steps, "s").select("o").distinct().join(reached, "o", "left_anti"))
        found = new if reached is None else reached
        return found.select(F.lit(start).alias("s"), "o")

    def pattern(self, s: tuple, p: tuple, o: tuple, known: Solutions | None = None) -> Solutions:
        """known: what was found before; a path that is walked on and on starts from
        the terms that a variable of its can still be."""
        if p[0] in ("term", "var"):
            return self.scan(s, p, o)
        begins = lambda part: self.seeds(part, known) if _endless(p) else None
        if s[0] != "term" and o[0] == "term":  # walked from the end that is known
            df = self.pairs(turned(p), o[1]).select(F.col("o").alias("s"), F.col("s").alias("o"))
        elif s[0] == "term":
            df = self.pairs(p, s[1])
        elif (found := begins(s)) is None and (backward := begins(o)) is not None:
            df = self.pairs(turned(p), backward).select(F.col("o").alias("s"), F.col("s").alias("o"))
        else:
            df = self.pairs(p, found)
        wanted, kinds = [], {}
        for column, part in (("s", s), ("o", o)):
            if part[0] == "term":
                df = df.filter(F.col(column) == part[1])
            elif part[1] in kinds:
                df = df.filter(F.col("s") == F.col("o"))
            else:
                kinds[part[1]] = TERM
                wanted.append(F.col(column).alias(part[1]))
        return Solutions(df.select(*wanted) if wanted else df.select(F.lit(1).alias("__one")), kinds)

    def seeds(self, part: tuple, known: Solutions | None) -> DataFrame | None:
        """(s): the terms of a variable that is bound in all that is known."""
        if known is None or part[0] != "var" or known.kinds.get(part[1]) != TERM or part[1] in known.unsure:
            return None
        return cut(known.df.select(F.col(part[1]).alias("s")).distinct())

    def cost(self, triple: tuple) -> float:
        s, p, o = triple
        size = self.counts.get(p[1], 10**6) if p[0] == "term" else 10**9 if p[0] in ("star", "plus", "opt") else 10**7
        return size / ((10**6 if s[0] == "term" else 1) * (100 if o[0] == "term" else 1))

    def bgp(self, triples: list) -> Solutions:
        left, out = list(triples), None
        bound: set[str] = set()
        while left:
            names = lambda t: {x[1] for x in (t[0], t[1], t[2]) if x[0] == "var"}
            linked = [t for t in left if names(t) & bound] or left
            best = min(linked, key=self.cost)
            left.remove(best)
            bound |= names(best)
            found = self.pattern(*best, out)
            out = found if out is None else self.join(out, found)
        return out or self.unit()

    def unit(self) -> Solutions:
        return Solutions(self.spark.range(1).select(F.lit(1).alias("__one")), {})

    # -- joins
    def _on(self, a: Solutions, b: Solutions) -> tuple[DataFrame, Column, list[str]]:
        """The right frame with its variables renamed, and the condition that
        two solutions agree."""
        shared = [v for v in a.kinds if v in b.kinds]
        right = b.df.select(*[F.col(v).alias(f"__r_{v}") for v in b.kinds], *([] if b.kinds else [F.lit(1).alias("__r_")]))
        on = F.lit(True)
        for v in shared:
            x, y = F.col(v), F.col(f"__r_{v}")
            if a.kinds[v] != b.kinds[v]:
                x, y = as_term(Value(x, a.kinds[v])), as_term(Value(y, b.kinds[v]))
            same = x == y
            if v in a.unsure:
                same = same | F.col(v).isNull()
            if v in b.unsure:
                same = same | F.col(f"__r_{v}").isNull()
            on = on & same
        return right, on, shared

    def join(self, a: Solutions, b: Solutions, how: str = "inner", extra: Column | None = None) -> Solutions:
        shared = [v for v in a.kinds if v in b.kinds]
        open_to = next((v for v in shared if v in a.unsure and a.kinds[v] == b.kinds[v]), None)
        if open_to and extra is None:
            return self._split(a, b, open_to, how)
        if how == "inner" and any(v in b.unsure and v not in a.unsure and a.kinds[v] == b.kinds[v] for v in shared):
            return self.join(b, a)
        right, on, shared = self._on(a, b)
        on = on if extra is None else on & extra
        joined = a.df.join(right, on, how)
        cols, kinds, unsure = [], {}, set()
        for v in a.kinds:
            both = v in shared and v in a.unsure
            cols.append((F.coalesce(v, f"__r_{v}") if both else F.col(v)).alias(v))
            kinds[v] = a.kinds[v]
            if v in a.unsure and not (both and v not in b.unsure and how == "inner"):
                unsure.add(v)
        for v in b.kinds:
            if v not in shared:
                cols.append(F.col(f"__r_{v}").alias(v))
                kinds[v] = b.kinds[v]
                if v in b.unsure or how == "left":
                    unsure.add(v)
        return Solutions(joined.select(*cols) if cols else joined.select(F.lit(1).alias("__one")), kinds, unsure)

    def _split(self, a: Solutions, b: Solutions, v: str, how: str) -> Solutions:
        """A join on a variable that a may leave unbound, as two: a's solutions
        that bind it, on equality, and the others, to which it is no variable of
        a's. A condition that allows null would leave no key to join on."""
        bound = self.join(Solutions(a.df.filter(F.col(v).isNotNull()), a.kinds, a.unsure - {v}), b, how)
        rest = a.df.filter(F.col(v).isNull()).drop(v)
        free = self.join(Solutions(rest if rest.columns else rest.select(F.lit(1).alias("__one")), {k: x for k, x in a.kinds.items() if k != v}, a.unsure - {v}), b, how)
        return Solutions(bound.df.unionByName(free.df.select(*bound.df.columns)), bound.kinds, bound.unsure | free.unsure)

    def exists(self, a: Solutions, inner: list, wanted: bool) -> Solutions:
        b = self.group(inner, outer=set(a.kinds))
        return Solutions(self._held(a, b, wanted, b.deferred).df, a.kinds, a.unsure)

    def minus(self, a: Solutions, b: Solutions) -> Solutions:
        return Solutions(self._held(a, b, False, [], overlap=True).df, a.kinds, a.unsure)

    def _held(self, a: Solutions, b: Solutions, wanted: bool, filters: list, overlap: bool = False) -> Solutions:
        """a's solutions that have (or have not) one of b's that agrees with them.
        overlap: only one that shares a bound variable counts. A variable that may be
        unbound splits its frame in two, as in ``_split``, so that what is left is
        always a join on equal keys."""
        shared = [v for v in a.kinds if v in b.kinds and a.kinds[v] == b.kinds[v]]
        if v := next((v for v in shared if v in a.unsure), None):
            bound = self._held(Solutions(a.df.filter(F.col(v).isNotNull()), a.kinds, a.unsure - {v}), b, wanted, filters, overlap)
            rest = a.df.filter(F.col(v).isNull()).withColumnRenamed(v, f"__none_{v}")
            free = self._held(Solutions(rest, {k: x for k, x in a.kinds.items() if k != v}, a.unsure - {v}), b, wanted, filters, overlap)
            return Solutions(bound.df.unionByName(free.df.withColumnRenamed(f"__none_{v}", v)), a.kinds, a.unsure)
        if v := next((v for v in shared if v in b.unsure), None):
            some = Solutions(b.df.filter(F.col(v).isNotNull()), b.kinds, b.unsure - {v})
            rest = b.df.filter(F.col(v).isNull()).drop(v)
            none = Solutions(rest if rest.columns else rest.select(F.lit(1).alias("__one")), {k: x for k, x in b.kinds.items() if k != v}, b.unsure - {v})
            left = self._held(self._held(a, some, False, filters, overlap), none, wanted, filters, overlap)
            if not wanted:
                return left
            return Solutions(self._held(a, some, True, filters, overlap).df.unionByName(left.df), a.kinds, a.unsure)
        right, on, both = self._on(a, b)
        if not both and overlap:
            return a
        if not both and not filters:
            right = right.limit(1)  # that there is any is all that counts
        env = {v: Value(F.col(v), k) for v, k in a.kinds.items()} | {v: Value(F.col(f"__r_{v}"), k) for v, k in b.kinds.items()}
        for e in filters:
            on = on & F.coalesce(as_bool(self.value(e, env)), F.lit(False))
        if overlap and any(v in a.unsure or v in b.unsure for v in both):  # of different kinds
            on = on & F.coalesce(*[F.when(F.col(v).isNotNull() & F.col(f"__r_{v}").isNotNull(), True) for v in both], F.lit(False))
        return Solutions(a.df.join(right, on, "left_semi" if wanted else "left_anti"), a.kinds, a.unsure)

    # -- groups
    def group(self, parts: list, outer: set[str] = frozenset()) -> Solutions:
        out, filters = None, []
        for part in parts:
            kind = part[0]
            if kind == "filter":
                filters.append(part)
                continue
            if kind == "exists":
                filters.append(part)
                continue
            if kind == "bgp":
                found = self.bgp(part[1])
            elif kind == "group":
                found = self.group(part[1])
            elif kind == "union":
                found = self.union([self.group(b) for b in part[1]])
            elif kind == "sub":
                found = self.select(part[1])
            elif kind == "values":
                found = self.inline(part)
            elif kind == "optional":
                inner = self.group(part[1], outer=set(out.kinds) if out else set())
                out = out or self.unit()
                env = {v: Value(F.col(v), k) for v, k in out.kinds.items()} | {v: Value(F.col(f"__r_{v}"), k) for v, k in inner.kinds.items() if v not in out.kinds}
                extra = None
                for e in inner.deferred:
                    own = F.coalesce(as_bool(self.value(e, env)), F.lit(False))
                    extra = own if extra is None else extra & own
                out = self.join(out, inner, "left", extra)
                continue
            elif kind == "minus":
                out = self.minus(out or self.unit(), self.group(part[1]))
                continue
            elif kind == "bind":
                out = out or self.unit()
                v = self.value(part[2], self.env(out))
                out = Solutions(out.df.withColumn(part[1], v.col), out.kinds | {part[1]: v.kind}, out.unsure | {part[1]})
                continue
            else:
                raise SparqlError(f"no such part: {kind}")
            out = found if out is None else self.join(out, found)
        out = out or self.unit()
        for part in filters:
            if part[0] == "exists":
                out = Solutions(**(vars(self.exists(out, part[2], part[1])) | {"deferred": out.deferred}))
            elif outer and self.variables(part[1]) - set(out.kinds):
                out.deferred.append(part[1])
            else:
                out = self.filtered(out, part[1])
        return out

    def filtered(self, a: Solutions, e: tuple) -> Solutions:
        if e[0] == "and":
            return self.filtered(self.filtered(a, e[1]), e[2])
        if e[0] == "exists":
            return self.exists(a, e[2], e[1])
        if e[0] == "not" and e[1][0] == "exists":
            return self.exists(a, e[1][2], not e[1][1])
        return Solutions(a.df.filter(as_bool(self.value(e, self.env(a)))), a.kinds, a.unsure, a.deferred)

    def variables(self, e) -> set[str]:
        if isinstance(e, tuple) and e and e[0] == "var":
            return {e[1]}
        if isinstance(e, tuple | list):
            return set().union(*[self.variables(x) for x in e]) if e else set()
        return set()

    def union(self, branches: list[Solutions]) -> Solutions:
        kinds: dict[str, str] = {}
        for b in branches:
            for v, k in b.kinds.items():
                kinds[v] = k if kinds.get(v, k) == k else TERM
        unsure = {v for v in kinds if any(v not in b.kinds or v in b.unsure for b in branches)}
        out = None
        for b in branches:
            cols = [((as_term(Value(F.col(v), b.kinds[v])) if kinds[v] == TERM else F.col(v)) if v in b.kinds else F.lit(None).cast("string" if kinds[v] in (TERM, TEXT) else {NUMBER: "double", INTEGER: "long", BOOL: "boolean"}[kinds[v]])).alias(v) for v in kinds]
            part = b.df.select(*cols) if cols else b.df.select(F.lit(1).alias("__one"))
            out = part if out is None else out.unionByName(part)
        return Solutions(out, kinds, unsure)

    def inline(self, part: tuple) -> Solutions:
        _, names, rows = part
        schema = ", ".join(f"`{n}` string" for n in names)
        return Solutions(self.spark.createDataFrame([tuple(r) for r in rows], schema), dict.fromkeys(names, TERM), {n for i, n in enumerate(names) if any(r[i] is None for r in rows)})

    # -- expressions
    def env(self, a: Solutions) -> dict[str, Value]:
        return {v: Value(F.col(v), k) for v, k in a.kinds.items()}

    def value(self, e: tuple, env: dict[str, Value]) -> Value:
        kind = e[0]
        if kind == "var":
            return env.get(e[1]) or Value(F.lit(None).cast("string"), TERM)
        if kind == "term":
            return Value(F.lit(e[1]), TERM)
        if kind in ("or", "and"):
            a, b = (as_bool(self.value(x, env)) for x in e[1:])
            return Value(a | b if kind == "or" else a & b, BOOL)
        if kind == "not":
            return Value(~as_bool(self.value(e[1], env)), BOOL)
        if kind == "compare":
            return Value(self.compare(e[1], self.value(e[2], env), self.value(e[3], env)), BOOL)
        if kind == "in":
            found = F.lit(False)
            for option in e[2]:
                found = found | self.compare("=", self.value(e[1], env), self.value(option, env))
            return Value(found, BOOL)
        if kind == "math":
            a, b = as_number(self.value(e[2], env)), as_number(self.value(e[3], env))
            return Value({"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / F.nullif(b, F.lit(0.0))}[e[1]](), NUMBER)
        if kind == "call":
            return self.call(e[1], e[2], env)
        if kind == "cast":
            return self.cast(e[1], self.value(e[2][0], env))
        if kind == "aggregate":
            raise SparqlError("an aggregate outside of SELECT, HAVING and ORDER BY")
        raise SparqlError(f"no such expression: {kind}")

    def compare(self, mark: str, a: Value, b: Value) -> Column:
        """Numbers by value, dates and times by the instant they mean, other terms
        by their texts; = of two terms that are neither is that of the terms."""
        apply = {"=": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}[mark]
        if a.kind == b.kind and a.kind in (INTEGER, BOOL, TEXT):
            return apply(a.col, b.col)
        if BOOL in (a.kind, b.kind):
            return apply(as_bool(a), as_bool(b))
        x, y = as_number(a), as_number(b)
        rest = apply(as_term(a), as_term(b)) if mark in ("=", "!=") and TEXT not in (a.kind, b.kind) else F.when(x.isNull() & y.isNull(), apply(as_text(a), as_text(b)))
        if {a.kind, b.kind} & {NUMBER, INTEGER}:
            return apply(x, y)
        if a.kind == b.kind == TERM:
            i, j = as_instant(a), as_instant(b)
            rest = F.when(i.isNotNull() & j.isNotNull(), apply(i, j)).otherwise(rest)
        return F.when(x.isNotNull() & y.isNotNull(), apply(x, y)).otherwise(rest)

    def cast(self, target: str, v: Value) -> Value:
        name = target.removeprefix(f"<{T.XSD}").rstrip(">")
        if name in T.NUMERIC:
            n = F.coalesce(as_number(v), as_text(v).try_cast("double"))
            return Value(n.cast("long"), INTEGER) if name not in ("decimal", "double", "float") else Value(n, NUMBER)
        if name == "boolean":
            return Value(F.when(as_text(v).isin("true", "1"), True).when(as_text(v).isin("false", "0"), False), BOOL)
        return Value(as_text(v), TEXT)

    def call(self, name: str, args: list, env: dict[str, Value]) -> Value:
        if name == "BOUND":
            return Value(self.value(args[0], env).col.isNotNull(), BOOL)
        v = [self.value(a, env) for a in args]
        t, n = lambda i: as_text(v[i]), lambda i: as_number(v[i])
        if name in ("IF", "COALESCE"):
            branches = v[1:] if name == "IF" else v
            kinds = {b.kind for b in branches}
            kind = kinds.pop() if len(kinds) == 1 else TERM
            cols = [b.col if b.kind == kind else as_term(b) for b in branches]
            return Value(F.when(as_bool(v[0]), cols[0]).otherwise(cols[1]) if name == "IF" else F.coalesce(*cols), kind)
        if name in ("CONTAINS", "STRSTARTS", "STRENDS"):
            return Value({"CONTAINS": F.contains, "STRSTARTS": F.startswith, "STRENDS": F.endswith}[name](t(0), t(1)), BOOL)
        if name == "REGEX":
            flags = f"(?{args[2][1].strip(chr(34))})" if len(args) > 2 else ""
            return Value(F.regexp_like(t(0), F.concat(F.lit(flags), t(1))), BOOL)
        if name in ("ISIRI", "ISURI", "ISBLANK", "ISLITERAL", "ISNUMERIC"):
            x = as_term(v[0])
            return Value({"ISIRI": T.is_iri(x), "ISURI": T.is_iri(x), "ISBLANK": T.is_blank(x), "ISLITERAL": T.is_literal(x), "ISNUMERIC": n(0).isNotNull()}[name], BOOL)
        if name == "SAMETERM":
            return Value(as_term(v[0]) == as_term(v[1]), BOOL)
        if name == "LANGMATCHES":
            return Value(F.when(t(1) == "*", t(0) != "").otherwise((F.lower(t(0)) == F.lower(t(1))) | F.lower(t(0)).startswith(F.concat(F.lower(t(1)), F.lit("-")))), BOOL)
        if name == "DATATYPE":
            return Value(T.datatype(as_term(v[0])), TERM)
        if name in ("IRI", "URI"):
            return Value(T.iri(t(0)), TERM)
        if name == "STRLEN":
            return Value(F.length(t(0)).cast("long"), INTEGER)
        texts = {
            "STR": lambda: t(0), "LANG": lambda: T.language(as_term(v[0])), "UCASE": lambda: F.upper(t(0)), "LCASE": lambda: F.lower(t(0)), "CONCAT": lambda: F.concat(*[t(i) for i in range(len(v))]) if v else F.lit(""),
            "SUBSTR": lambda: F.substring(t(0), n(1).cast("int"), n(2).cast("int") if len(v) > 2 else F.length(t(0))), "REPLACE": lambda: F.regexp_replace(t(0), t(1), t(2)),
            "STRBEFORE": lambda: F.coalesce(F.when(F.contains(t(0), t(1)), F.left(t(0), F.position(t(1), t(0)) - 1)), F.lit("")),
            "STRAFTER": lambda: F.coalesce(F.when(F.contains(t(0), t(1)), F.substring(t(0), F.position(t(1), t(0)) + F.length(t(1)), F.length(t(0)))), F.lit("")),
        }
        if name in texts:
            return Value(texts[name](), TEXT)
        parts = {"YEAR": 1, "MONTH": 2, "DAY": 3, "HOURS": 4, "MINUTES": 5}
        if name in parts:
            return Value(T.stamp_part(t(0), parts[name]).try_cast("long"), INTEGER)
        if name == "SECONDS":
            return Value(T.stamp_part(t(0), 6).try_cast("double"), NUMBER)
        if name == "TZ":
            return Value(F.when(T.stamp_part(t(0), 1).isNotNull(), F.coalesce(T.stamp_part(t(0), 7), F.lit(""))), TEXT)
        if name == "NOW":
            return Value(F.concat(F.lit('"'), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"), F.lit(f'"^^<{T.XSD}dateTime>')), TERM)
        if name in ("UUID", "STRUUID"):
            return Value(F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")), TERM) if name == "UUID" else Value(F.uuid(), TEXT)
        if name == "RAND":
            return Value(F.rand(), NUMBER)
        if name == "STRDT":
            return Value(F.concat(F.lit('"'), T.escape(t(0)), F.lit('"^^'), as_term(v[1])), TERM)
        if name == "STRLANG":
            return Value(F.concat(F.lit('"'), T.escape(t(0)), F.lit('"@'), t(1)), TERM)
        if name in ("MD5", "SHA1", "SHA256", "SHA384", "SHA512"):
            return Value(F.md5(t(0)) if name == "MD5" else F.sha1(t(0)) if name == "SHA1" else F.sha2(t(0), int(name[3:])), TEXT)
        if name == "ENCODE_FOR_URI":
            coded = F.url_encode(t(0))
            for old, new in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
                coded = F.replace(coded, F.lit(old), F.lit(new))
            return Value(coded, TEXT)
        numbers = {"ABS": F.abs, "CEIL": F.ceil, "FLOOR": F.floor, "ROUND": lambda c: F.floor(c + 0.5)}
        if name in numbers:
            whole = v[0].kind == INTEGER or (args[0][0] == "term" and args[0][1].endswith(f"^^<{T.XSD}integer>"))
            return Value(numbers[name](n(0)).cast("long"), INTEGER) if whole else Value(numbers[name](n(0)).cast("double"), NUMBER)
        raise SparqlError(f"no such function: {name}")

    # -- SELECT
    def aggregates(self, e, found: dict) -> tuple:
        """The expression with its aggregates replaced by variables."""
        if isinstance(e, tuple) and e and e[0] == "aggregate":
            name = found.setdefault(repr(e), (f"__a{len(found)}", e))[0]
            return ("var", name)
        if isinstance(e, tuple):
            return tuple(self.aggregates(x, found) if isinstance(x, tuple | list) else x for x in e)
        if isinstance(e, list):
            return [self.aggregates(x, found) for x in e]
        return e

    def aggregate(self, e: tuple, env: dict[str, Value]) -> Value:
        _, name, distinct, inner, separator = e
        if inner is None:
            if distinct:
                return Value(F.countDistinct(F.struct(*[F.coalesce(v.col.cast("string"), F.lit("")) for v in env.values()])), INTEGER)
            return Value(F.count("*"), INTEGER)
        v = self.value(inner, env)
        if name == "COUNT":
            return Value(F.countDistinct(v.col) if distinct else F.count(v.col), INTEGER)
        if name in ("SUM", "AVG"):
            n = as_number(v).cast("decimal(28,9)")  # exact, so the order of rows is no matter
            total = (F.sum_distinct(n) if distinct else F.sum(n)).cast("double")
            if name == "SUM":
                return Value(F.coalesce(total, F.lit(0.0)), NUMBER)
            return Value(F.coalesce(total / (F.countDistinct(n) if distinct else F.count(n)), F.lit(0.0)), NUMBER)
        if name in ("MIN", "MAX"):
            if v.kind != TERM:
                return Value((F.min if name == "MIN" else F.max)(v.col), v.kind)
            n, pick = F.coalesce(T.number(v.col), T.instant(v.col)), F.min if name == "MIN" else F.max
            return Value(pick(F.when(v.col.isNotNull(), F.struct(n.isNull().alias("t"), n.alias("n"), v.col.alias("v"))))["v"], TERM)
        if name == "SAMPLE":
            return Value(F.min(v.col), v.kind)
        items = F.collect_set(as_text(v)) if distinct else F.collect_list(as_text(v))
        return Value(F.array_join(F.sort_array(items), separator), TEXT)

    def select(self, q: dict) -> Solutions:
        a = self.group(q["where"]) if q["where"] is not None else self.unit()
        if q.get("values"):
            a = self.join(a, self.inline(q["values"]))
        found: dict = {}
        chosen = [(v, None if e is None else self.aggregates(e, found)) for v, e in q["select"]] if q["select"] else None
        having, order = [self.aggregates(e, found) for e in q["having"]], [(desc, self.aggregates(e, found)) for desc, e in q["order"]]
        if found or q["group"] is not None:
            env = self.env(a)
            keys = [(name, self.value(e, env)) for name, e in q["group"] or []]
            sums = [(name, self.aggregate(e, env)) for name, e in found.values()]
            df = a.df.groupBy(*[k.col.alias(name) for name, k in keys]).agg(*[s.col.alias(name) for name, s in sums] or [F.count("*").alias("__n")])
            a = Solutions(df, {name: v.kind for name, v in keys + sums}, {name for name, _ in keys} & a.unsure | {name for name, _ in sums})
            for e in having:
                a = self.filtered(a, e)
        names = list(a.kinds) if chosen is None else [v for v, _ in chosen]
        names = [v for v in names if not v.startswith("__")]
        for v, e in chosen or []:
            if e is not None:
                found_value = self.value(e, self.env(a))
                a = Solutions(a.df.withColumn(v, found_value.col), a.kinds | {v: found_value.kind}, a.unsure | {v})
        keys = []
        for desc, e in order:
            v = self.value(e, self.env(a))
            for c in ([self.rank(v), as_number(v), as_instant(v), as_text(v)] if v.kind == TERM else [v.col]):
                keys.append(c.desc_nulls_last() if desc else c.asc_nulls_first())
        absent = [v for v in names if v not in a.kinds]
        df = a.df.withColumns({v: F.lit(None).cast("string") for v in absent}) if absent else a.df
        kinds = {v: a.kinds.get(v, TERM) for v in names}
        if q["distinct"] and keys:
            df = df.select(*names, *[c for c in df.columns if c not in names]).dropDuplicates(names)
        if keys:
            df = df.orderBy(*keys)
        df = df.select(*names) if names else df
        if q["distinct"] and not keys:
            df = df.distinct()
        if q["offset"]:
            df = df.offset(q["offset"])
        if q["limit"] is not None:
            df = df.limit(q["limit"])
        return Solutions(df, kinds, a.unsure & set(names) | set(absent))

    def rank(self, v: Value) -> Column:
        """Unbound, blank nodes, IRIs, literals."""
        return F.when(v.col.isNull(), 0).when(T.is_blank(v.col), 1).when(T.is_iri(v.col), 2).otherwise(3)

    def construct(self, q: dict) -> DataFrame:
        a = self.group(q["where"])
        a = Solutions(a.df.limit(q["limit"]) if q["limit"] is not None else a.df, a.kinds, a.unsure)
        own = [as_term(Value(F.col(v), k)) for v, k in a.kinds.items()]
        out = None
        for triple in q["template"]:
            cols = []
            for name, part in zip("spo", triple, strict=True):
                if part[0] == "term":
                    c = F.lit(part[1])
                elif part[1] in a.kinds:
                    c = as_term(Value(F.col(part[1]), a.kinds[part[1]]))
                else:
                    c = F.concat(F.lit(f"_:{part[1].strip('_')}x"), F.hex(F.xxhash64(*own))) if part[1].startswith("__") else F.lit(None).cast("string")
                cols.append(c.alias(name))
            part = a.df.select(*cols).dropna()
            out = part if out is None else out.union(part)
        return out.distinct()

    def describe(self, q: dict) -> DataFrame:
        if q["where"] is not None:
            a = self.group(q["where"])
            wanted = [r[1] for r in q["resources"] if r[0] == "var"] if q["resources"] else list(a.kinds)
            found = None
            for v in wanted:
                part = a.df.select(F.col(v).alias("s"))
                found = part if found is None else found.union(part)
        else:
            found = self.spark.createDataFrame([(r[1],) for r in q["resources"]], "s string")
        return self.triples.join(found.distinct(), "s", "left_semi")

    def run(self, q: dict, raw: bool = False) -> DataFrame:
        if q["form"] == "ASK":
            return self.group(q["where"]).df.limit(1).agg((F.count("*") > 0).alias("ask"))
        if q["form"] == "CONSTRUCT":
            return self.construct(q)
        if q["form"] == "DESCRIBE":
            return self.describe(q)
        found = self.select(q)
        return found.df if raw else found.df.select(*[(T.text(F.col(v)) if k == TERM else F.col(v)).alias(v) for v, k in found.kinds.items()])


def sparql(triples: DataFrame, query: str, prefixes: dict[str, str] | None = None, counts: dict[str, int] | None = None, raw: bool = False) -> DataFrame:
    """The result of a query over a triple table (s, p, o). SELECT gives a
    column for each variable (texts and IRIs as strings, counts as longs,
    arithmetic as doubles; with raw, terms as they are), ASK one boolean, and
    CONSTRUCT and DESCRIBE triples. counts: triples of each predicate, which
    order the joins. Repeated triples count once."""
    return Compiler(triples.distinct() if counts is None else triples, counts).run(parse(query, prefixes), raw)
