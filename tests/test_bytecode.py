"""Class files made byte by byte, read back as facts, and analysed."""

import zipfile

import numpy as np
import pytest
from assembler import File
from pyspark.sql import functions as F

from holdfast.plans.naming import lock_points
from holdfast.sources.bytecode import facts_in, instructions, java_text, read_classes, sections
from holdfast.sources.reports import fields_of, packed, read_points_columns, varint, varints, write_points_columns, write_points_json

OBJECT = "Ljava/lang/Object;"


def locks(cls: str = "Lquay/Crate;") -> File:
    """a() locks this.lid, b() locks a static field, c() is abstract, d() is static and locks the class."""
    f = File()
    m, s, v = f.field(cls, "lid", OBJECT), f.field(cls, "seal", OBJECT), f.field(cls, "flag", "I")
    a, b, c, d = (f.method(cls, n, args, "V") for n, args in (("a", []), ("b", ["J", "[Lt/X;"]), ("c", []), ("d", [])))
    k = f.type(cls)
    codes = [
        # iget-object v0, v2, lid; monitor-enter v0; goto/16 +2; monitor-exit v0; return-void
        (a, 0, {"registers": 3, "ins": 1, "units": [0x2054, m, 0x001D, 0x0029, 2, 0x001E, 0x000E], "lines": [(0, 5), (5, 300)], "tries": [(2, 3, [5], 6), (0, 1, [6], None)]}),
        # sget-object v0, seal; move-object v1, v0; monitor-enter v1; if-eqz v1, -1; monitor-exit v1; return-object v1
        (b, 0, {"registers": 6, "ins": 4, "units": [0x0062, s, 0x0107, 0x011D, 0x0138, 0xFFFF, 0x011E, 0x0111], "lines": [(0, 6)]}),
        (c, 0x400, None),
        # const-class v0; monitor-enter v0; packed-switch v0 (+9); invoke-static/range {v3..v5}, a; nop; return-void; (table)
        (d, 8, {"registers": 6, "ins": 0, "units": [0x001C, k, 0x001D, 0x002B, 11, 0, 0x0377, a, 3, 0x0000, 0x000E, 0x000E, 0x000E, 0x000E, 0x0100, 2, 0, 0, 7, 0, 8, 0], "lines": [(2, 8)]}),
    ]
    f.add(cls, OBJECT, ["Lt/I;"], "Crate.java", [(v, 0x40), (m, 0x2)], codes)
    return f


def test_class_file():
    rows = list(facts_in(locks().bytes()))
    classes = [r for kind, r in rows if kind == "class"]
    assert classes == [{"class_ord": 0, "class": "quay.Crate", "super": "java.lang.Object", "interfaces": ["t.I"]}]
    assert [r["field"] for kind, r in rows if kind == "flag"] == ["quay.Crate.flag"]
    a, b, c, d = (r for kind, r in rows if kind == "method")
    assert [(m["name"], m["sig"], m["access"], m["registers"], m["ins"]) for m in (a, b, c, d)] == [("a", "()V", 0, 3, 1), ("b", "(J[Lt/X;)V", 0, 6, 4), ("c", "()V", 0x400, 0, 0), ("d", "()V", 8, 6, 0)]
    assert a["insns"] == [
        {"offset": 0, "op": "iget", "class": "quay.Crate", "field": "lid", "ty": "java.lang.Object", "dst": 0, "base": 2}, {"offset": 2, "op": "monitor_enter", "src": 0},
        {"offset": 3, "op": "goto", "targets": [5]}, {"offset": 5, "op": "monitor_exit", "src": 0}, {"offset": 6, "op": "return", "src": None},
    ]
    assert a["positions"] == [{"offset": 0, "line": 5}, {"offset": 5, "line": 300}]
    assert a["catches"] == [{"start": 2, "end": 5, "handler": 5}, {"start": 2, "end": 5, "handler": 6}, {"start": 0, "end": 1, "handler": 6}]
    assert [(i["op"], i.get("dst"), i.get("src"), i.get("targets")) for i in b["insns"]] == [
        ("sget", 0, None, None), ("move", 1, 0, None), ("monitor_enter", None, 1, None), ("branch", None, None, [3]), ("monitor_exit", None, 1, None), ("return", None, 1, None)
    ]
    assert c["insns"] == [] and c["source_file"] == "Crate.java"
    assert [(i["offset"], i["op"], i.get("targets") or i.get("args")) for i in d["insns"]] == [
        (0, "const_class", None), (2, "monitor_enter", None), (3, "switch", [10, 11]), (6, "invoke", [3, 4, 5]), (9, "other", None), (10, "return", None), (11, "return", None), (12, "return", None), (13, "return", None)
    ]
    assert d["insns"][3]["kind"] == "static" and d["insns"][3]["name"] == "a"


def test_cut_and_broken_code():
    (pools,) = sections(locks().bytes())
    assert [i["op"] for i in instructions((0x001D, 0x0062), pools)] == ["monitor_enter"]
    # An array initializer's data is no code; a table beyond the code has no targets.
    assert [i["offset"] for i in instructions((0x0300, 1, 3, 0, 0xFFFF, 0xFFFF, 0x000E), pools)] == [6]
    assert instructions((0x002B, 50, 0), pools)[0]["targets"] == []
    with pytest.raises(ValueError, match="class file"):
        list(facts_in(b"nothing"))


def test_java_text():
    assert java_text("a\xe9".encode() + b"\xc0\x80" + "😀".encode("utf-8", "surrogatepass")) == "a\xe9\0\U0001f600"


@pytest.fixture(scope="module")
def points(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("jars")
    for name, cls in (("a.jar", "Lquay/Crate;"), ("b.jar", "Lquay/Crate;"), ("c.apk", "Lquay/Tank;")):
        with zipfile.ZipFile(folder / name, "w") as z:
            z.writestr("classes.dex", locks(cls).bytes())
            z.writestr("note.txt", "no")
    classes, methods, flags = read_classes(spark, str(folder))
    assert sorted(r["class"] for r in classes.collect()) == ["quay.Crate", "quay.Tank"]
    assert sorted(r.field for r in flags.collect()) == ["quay.Crate.flag", "quay.Tank.flag"]
    return lock_points(methods).cache()


def test_lock_points_of_class_files(points):
    got = sorted((r.method, r.line, r.lock) for r in points.where("class = 'quay.Crate'").collect())
    assert got == [("quay.Crate.a:()V", 5, "quay.Crate.lid"), ("quay.Crate.b:(J[Lt/X;)V", 6, "quay.Crate.seal"), ("quay.Crate.d:()V", 8, "quay.Crate.class")]


def test_no_class_is_an_error(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.jar", "w") as z:
        z.writestr("note.txt", "no")
    with pytest.raises(ValueError, match="no classes"):
        read_classes(spark, str(tmp_path))


def read_message(data: bytes) -> tuple[list[str], list[list[int]]]:
    """A plain reader of the dump."""
    strings, columns, at = [], {i: [] for i in range(2, 7)}, 0

    def number():
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return n

    while at < len(data):
        field, size = number() >> 3, number()
        end = at + size
        if field == 1:
            strings.append(data[at:end].decode())
            at = end
        while at < end:
            columns[field].append(number())
    return strings, list(columns.values())


@pytest.mark.parametrize("slices", [1, 3])
def test_columnar_dump(points, tmp_path, slices):
    more = points.withColumn("line", F.when(F.col("line") != 6, F.col("line"))).withColumn("source_file", F.when(F.col("line").isNotNull(), F.col("source_file")))
    more = more.unionByName(points.limit(1))
    parts = write_points_columns(more, f"file://{tmp_path}", slices).collect()
    data = b"".join(open(r.path.removeprefix("file://"), "rb").read() for r in parts)
    strings, columns = read_message(data)
    rows = [(strings[c], strings[m], strings[f], strings[k], n) for c, m, f, k, n in zip(*columns, strict=True)]
    want = [(r["class"], r.method, r.source_file or "", r.lock, r.line or 0) for r in more.collect()]
    assert sorted(rows) == sorted(want) and [r[:2] for r in rows] == sorted(r[:2] for r in rows)
    assert strings[0] == "" and len(set(strings)) == len(strings)
    # Strings stand in the order of the rows that they come first in.
    first = list(dict.fromkeys(s for r in rows for s in r[:4] if s))
    assert strings[1:] == first


@pytest.mark.parametrize("gzip", [False, True])
def test_columnar_dump_read_back(spark, points, tmp_path, gzip):
    """Parts, and the parts joined to one file, give the points again, repeated rows and unknown lines and files too."""
    more = points.withColumn("line", F.when(F.col("line") != 6, F.col("line"))).withColumn("source_file", F.when(F.col("line").isNotNull(), F.col("source_file")))
    more = more.unionByName(points.limit(1))
    parts = write_points_columns(more, f"file://{tmp_path}/parts", 2, gzip=gzip).collect()
    one = tmp_path / "one" / ("all.pb.gz" if gzip else "all.pb")
    one.parent.mkdir()
    one.write_bytes(b"".join(open(r.path.removeprefix("file://"), "rb").read() for r in parts))
    want = sorted(map(repr, more.select("class", "method", "source_file", "line", "lock").collect()))
    assert sorted(map(repr, read_points_columns(spark, str(tmp_path / "parts")).collect())) == want
    assert sorted(map(repr, read_points_columns(spark, str(one)).collect())) == want


def test_numbers_of_a_dump():
    numbers = [0, 1, 127, 128, 300, 2**31 - 1, 2**40, 0]
    assert varints(np.frombuffer(b"".join(map(varint, numbers)), np.uint8)).tolist() == numbers and varints(np.zeros(0, np.uint8)).tolist() == []
    with pytest.raises(ValueError, match="cut off"):
        varints(np.array([0x80], np.uint8))
    whole = b"".join(packed(i, [1, 2]) for i in range(2, 7))
    assert [c.tolist() for c in fields_of(whole)[1]] == [[1, 2]] * 5
    with pytest.raises(ValueError, match="no dump"):
        fields_of(whole[:-1])


def test_json_dump(spark, points, tmp_path):
    write_points_json(points, str(tmp_path / "j"), gzip=True)
    assert spark.read.json(str(tmp_path / "j")).select("class", "method", "file", "line", "lock").count() == points.count()
