"""The query language on interval layouts: text in, a coverage DataFrame out.

    or     := minus { "|" minus }            greatest depth
    minus  := and { "-" and }                left where right is not
    and    := test { "&" test }              least depth
    test   := prefix { ("?i" | "?x" | "?c") prefix }   intervals inside, intersecting, containing an interval of the right
    prefix := { "!" } suffix                 1 where the depth is 0, within the layout
    suffix := base { ("_" | "+" | "-" | ">" | "<") integer | "~" ["n" | "c"] ["i"] "regex" }
    base   := name | $saved | "(" or ")"

A "-" before an integer erodes, else it is the minus of two coverages.  A name is
a style of the objects(key, bgn, end, style, name, label); "~" filters objects, so
it follows a name or another "~".  Coverage is (key, bgn, end, depth), half-open.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import intervals as iv

_TOKEN = re.compile(r'\s*(?:(?P<str>"[^"]*")|(?P<int>\d+)|(?P<saved>\$\w+)|(?P<name>[A-Za-z]\w*)|(?P<op>\?[ixc]|[|&!()_+<>~-]))')


class QueryError(ValueError):
    """The text is no query."""


@dataclass
class Layout:
    """Objects and the results saved by name."""

    objects: DataFrame
    saved: dict[str, DataFrame] = field(default_factory=dict)

    def run(self, text: str, save_as: str | None = None) -> DataFrame:
        out = _Parser(self, text).whole()
        if save_as:
            self.saved[save_as] = out
        return out


def _levels(cover: DataFrame) -> DataFrame:
    """(key, level, bgn, end): the maximal stretches of each depth or more."""
    per = cover.withColumn("level", F.explode(F.sequence(F.lit(1).cast("long"), F.col("depth").cast("long"))))
    one = per.select(F.struct("key", "level").alias("key"), "bgn", "end")
    return iv.islands(one).select("key.key", "key.level", "bgn", "end")


def _islands(cover: DataFrame) -> DataFrame:
    return iv.islands(cover.select("key", "bgn", "end")).drop("n")


def _within(cover: DataFrame, islands: DataFrame) -> DataFrame:
    """The stretches of a coverage that lie in some of its own islands: found by their begins, in one sweep."""
    both = cover.select("key", "bgn", "end", "depth", F.lit(None).cast("long").alias("stop")).unionByName(
        islands.select("key", "bgn", F.lit(None).cast("long").alias("end"), F.lit(None).cast("long").alias("depth"), F.col("end").cast("long").alias("stop")))
    w = Window.partitionBy("key").orderBy("bgn", F.col("stop").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("stop", F.max("stop").over(w)).where("depth is not null and bgn < stop").select("key", "bgn", "end", "depth")


def _clamped(iv_: DataFrame, bounds: DataFrame) -> DataFrame:
    b = bounds.select("key", F.col("bgn").alias("lo"), F.col("end").alias("hi"))
    return iv_.join(b, "key").select("key", F.greatest("bgn", "lo").alias("bgn"), F.least("end", "hi").alias("end")).where("bgn < end")


class _Parser:
    def __init__(self, layout: Layout, text: str):
        self.layout, self.tokens, at = layout, [], 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise QueryError(f"unexpected {text[at:at + 10]!r}")
            self.tokens.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        self.at = 0

    def peek(self, ahead: int = 0):
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else (None, None)

    def take(self, *ops):
        if self.peek()[0] == "op" and self.peek()[1] in ops:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def bounds(self) -> DataFrame:
        return iv.solid(self.layout.objects).groupBy("key").agg(F.min("bgn").alias("bgn"), F.max("end").alias("end"))

    def whole(self) -> DataFrame:
        out = self.either()
        if self.peek()[0]:
            raise QueryError(f"unexpected {self.peek()[1]!r}")
        return out.select("key", "bgn", "end", F.col("depth").cast("long").alias("depth"))

    def _chain(self, part, ops, how):
        left = part()
        while op := self.take(*ops):
            left = _both(left, part(), how(op))
        return left

    def either(self):
        return self._chain(self.minus, "|", lambda op: "or")

    def minus(self):
        return self._chain(self.every, "-", lambda op: "minus")

    def every(self):
        return self._chain(self.test, "&", lambda op: "and")

    def test(self):
        left = self.prefix()
        while op := self.take("?i", "?x", "?c"):
            right = _islands(self.prefix())
            own = _islands(left)
            if op == "?i":
                left = _within(left, iv.intersecting(own, right, BIN, "inside"))
                continue
            level = _levels(left)
            kept = iv.intersecting(level, right, BIN, "intersects" if op == "?x" else "contain")
            left = iv.depth(kept.select("key", "bgn", "end"))
        return left

    def prefix(self):
        if self.take("!"):
            inner = self.prefix()
            return iv.complement(_islands(inner), self.bounds()).withColumn("depth", F.lit(1))
        return self.suffix()

    def suffix(self):
        out, objects = self.base()
        while True:
            kind, op = self.peek()
            if kind == "op" and op in ("_", "+", ">", "<", "-") and self.peek(1)[0] == "int":
                self.at += 2
                out, objects = self._number(out, op, int(self.tokens[self.at - 1][1])), None
            elif kind == "op" and op == "~":
                if objects is None:
                    raise QueryError("~ needs objects on its left")
                self.at += 1
                objects = self._matching(objects)
                out = iv.depth(objects)
            else:
                return out

    def _number(self, cover, op, n):
        if op == "_":
            return iv.runs(cover.withColumn("depth", F.floor(F.col("depth") / n)).where("depth > 0"))
        if op == "<":
            return _within(cover, _islands(cover).where(F.col("end") - F.col("bgn") < n))
        level = _levels(cover)
        if op == ">":
            return iv.depth(level.where(F.col("end") - F.col("bgn") > n))
        if op == "-":
            return iv.depth(level.select("key", (F.col("bgn") + n).alias("bgn"), (F.col("end") - n).alias("end")))
        wide = level.select(F.struct("key", "level").alias("key"), (F.col("bgn") - n).alias("bgn"), (F.col("end") + n).alias("end"))
        return iv.depth(_clamped(iv.islands(wide).select("key.key", "bgn", "end"), self.bounds()))

    def _matching(self, objects):
        flags = ""
        if self.peek()[0] == "name" and re.fullmatch("[nci]+", self.peek()[1]):
            flags = self.peek()[1]
            self.at += 1
        kind, text = self.peek()
        if kind != "str":
            raise QueryError("~ needs a quoted pattern")
        self.at += 1
        pattern = ("(?i)" if "i" in flags else "") + text[1:-1]
        cols = [c for c, f in (("name", "n"), ("label", "c")) if f in flags] or ["name", "label"]
        test = F.lit(False)
        for c in cols:
            test = test | F.coalesce(F.col(c).rlike(pattern), F.lit(False))
        return objects.where(test)

    def base(self):
        kind, text = self.peek()
        if self.take("("):
            out = self.either()
            if not self.take(")"):
                raise QueryError("missing )")
            return out, None
        self.at += 1
        if kind == "saved":
            if text[1:] not in self.layout.saved:
                raise QueryError(f"nothing saved as {text}")
            return self.layout.saved[text[1:]], None
        if kind == "name":
            objects = self.layout.objects.where(F.col("style") == text)
            return iv.depth(objects), objects
        raise QueryError("a style, a saved result or ( was expected")


#: Width of the bins of interval tests, about an interval's usual length.
BIN = 4096


def _both(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Two coverages by their depths: the steps of both sides are swept at once."""
    def steps(c, x, y):
        e = F.array(F.struct(F.col("bgn").alias("at"), F.col("depth").cast("long").alias("d")), F.struct(F.col("end").alias("at"), (-F.col("depth").cast("long")).alias("d")))
        s = c.select("key", F.explode(e).alias("e")).select("key", F.col("e.at").alias("at"), F.col("e.d").alias("d"))
        return s.select("key", "at", (F.col("d") * x).alias("da"), (F.col("d") * y).alias("db"))

    g = steps(a, 1, 0).unionByName(steps(b, 0, 1)).groupBy("key", "at").agg(F.sum("da").alias("da"), F.sum("db").alias("db"))
    w = Window.partitionBy("key").orderBy("at")
    run = g.select("key", F.col("at").alias("bgn"), F.lead("at").over(w).alias("end"), F.sum("da").over(w).alias("x"), F.sum("db").over(w).alias("y"))
    value = {"and": F.least("x", "y"), "or": F.greatest("x", "y"), "minus": F.when(F.col("y") > 0, 0).otherwise(F.col("x"))}[how]
    return iv.runs(run.select("key", "bgn", "end", value.alias("depth")).where("end is not null"))
