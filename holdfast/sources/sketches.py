"""Method facts written down by hand, for examples and tests: a line for each instruction.

A sketch gives one program (`tables`), or one laid out for each row of a table (`spread`): there `{column}` in any
name stands for the row's value.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType

from ..storage import side_by_side, spread_out, written
from .facts import CLASSES, FIELD_FLAGS, METHODS, merged

BLANK = dict.fromkeys(("dst", "src", "base", "class", "field", "ty", "targets", "kind", "args", "name", "sig"))


def member(text: str) -> tuple[str, str]:
    cls, _, name = text.rpartition(".")
    return cls, name


def instruction(offset: int, text: str) -> dict:
    """`op words`: `iget 0 2 t.A.f [type]`, `enter 0`, `virtual 1,2 t.A.m:()V`, `branch 5`, `switch 3,4`."""
    op, *w = text.split()
    i = dict(BLANK, offset=offset, op=op)
    if op in ("enter", "exit"):
        i |= {"op": f"monitor_{op}", "src": int(w[0])}
    elif op in ("iget", "sget"):
        cls, name = member(w[-1] if op == "sget" else w[2])
        i |= {"dst": int(w[0]), "class": cls, "field": name} | ({"base": int(w[1]), "ty": w[3] if len(w) > 3 else None} if op == "iget" else {})
    elif op in ("iput", "sput"):
        cls, name = member(w[-1])
        i |= {"src": int(w[0]), "class": cls, "field": name} | ({"base": int(w[1])} if op == "iput" else {})
    elif op in ("new", "const_class"):
        i |= {"dst": int(w[0]), "class": w[1]}
    elif op == "move":
        i |= {"dst": int(w[0]), "src": int(w[1])}
    elif op in ("move_result", "def"):
        i |= {"dst": int(w[0])}
    elif op == "return":
        i |= {"src": int(w[0]) if w else None}
    elif op in ("goto", "branch", "switch"):
        i |= {"targets": [int(t) for t in w[0].split(",")]}
    elif op in ("virtual", "direct", "static", "interface", "super"):
        cls, name, sig = re.match(r"(.+)\.([^.:]+):(.*)", w[-1]).groups()
        i |= {"op": "invoke", "kind": op, "args": [int(a) for a in w[0].split(",")] if len(w) > 1 else [], "class": cls, "name": name, "sig": sig}
    return i


def filled(value: Column, kind: DataType, marks: list[str], texts: list) -> Column:
    """A column with the marks in all its texts replaced by the row's values. `texts` are all values that it has before: only marks that
    are in one of them are looked for."""
    texts = [t for t in texts if t is not None]
    marks = [m for m in marks if f"{{{m}}}" in repr(texts)]
    if not marks:
        return value
    if isinstance(kind, StringType):
        for m in marks:
            value = F.replace(value, F.lit(f"{{{m}}}"), F.col(m).cast("string"))
    elif isinstance(kind, ArrayType):
        value = F.transform(value, lambda v: filled(v, kind.elementType, marks, [x for t in texts for x in t]))
    elif isinstance(kind, StructType):
        value = F.struct(*[filled(value[f.name], f.dataType, marks, [t[f.name] for t in texts]).alias(f.name) for f in kind])
    return value


class Program:
    """Collects classes and methods; `tables` gives them as merged fact tables."""

    def __init__(self):
        self.classes, self.methods, self.flags, self.only = [], [], [], {}

    def cls(self, name: str, super_: str = "java.lang.Object", interfaces: tuple[str, ...] = (), artifact: int = 0) -> None:
        self.classes.append((artifact, len(self.classes), name, super_, list(interfaces)))

    def method(self, name: str, code: list[str] | None = None, registers: int = 4, ins: int = 1, access: int = 0, lines: dict | int | None = None, catches: tuple = (), file: str | None = None, only: str = "true") -> None:
        """A method `name:sig` of the last class; `lines` is one line from offset 0, or line by offset.

        `only` is a condition on the rows for which `spread` lays the method out.
        """
        self.only[len(self.methods)] = only
        artifact, ord_, cls, *_ = self.classes[-1]
        method, sig = name.split(":")
        lines = {0: lines} if isinstance(lines, int) else lines or {}
        insns = [instruction(k, text) for k, text in enumerate(code or [])]
        places = [{"offset": o, "line": n} for o, n in sorted(lines.items())]
        tries = [{"start": a, "end": b, "handler": h} for a, b, h in catches]
        self.methods.append((artifact, ord_, len(self.methods), cls, method, sig, access, registers, ins, file or cls.split("$")[0].rsplit(".", 1)[-1] + ".java", insns, places, tries))

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
        make = spark.createDataFrame
        return merged(make(self.classes, CLASSES), make(self.methods, METHODS), make([(f,) for f in self.flags], FIELD_FLAGS))

    def spread(self, rows: DataFrame, copy: str, flagged: str = "true") -> tuple[DataFrame, DataFrame, DataFrame]:
        """Merged fact tables with a copy of the program for each of `rows`, each an artifact of its own, numbered by
        the column `copy`. Classes that come out alike for many rows are merged to the first; flags are those of rows
        that `flagged` holds for."""

        def table(name: str, ddl: str, made: list[tuple], only: dict, default: str = "true") -> DataFrame:
            # The sketch itself is joined by number: as many rows as it has classes, methods or flags.
            lines = rows.sparkSession.createDataFrame([(i, *values) for i, values in enumerate(made)], f"_line int, {ddl}")
            which = F.expr(f"filter(array({', '.join(f'if({only.get(i, default)}, {i}, null)' for i in range(len(made)))}), i -> i is not null)")
            laid = rows.select(*marks, F.explode(which).alias("_line")).join(F.broadcast(lines), "_line")
            fields = StructType.fromDDL(ddl)
            columns = [F.col(copy).cast("int").alias(f.name) if f.name == "artifact_ord" else filled(F.col(f.name), f.dataType, marks, [values[j] for values in made]).alias(f.name) for j, f in enumerate(fields)]
            return written(laid.select(*columns), name)

        # A row here is a program there: few bytes that fit one task make many methods.
        rows = rows.repartition(spread_out(rows.sparkSession), copy)
        marks = sorted({copy, *re.findall(r"\{(\w+)\}", repr((self.classes, self.methods, self.flags)))})
        flags, classes, methods = side_by_side(
            rows.sparkSession, lambda: table("flags", FIELD_FLAGS, [(f,) for f in self.flags], {}, flagged),
            lambda: table("classes", CLASSES, self.classes, {}), lambda: table("methods", METHODS, self.methods, self.only),
        )
        return merged(classes, methods, flags)
