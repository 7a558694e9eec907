"""Puts class files together byte by byte, for tests of the reader."""

import struct


def number(n: int) -> bytes:
    out = b""
    while n >= 0x80:
        out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
    return out + bytes([n])


def signed(n: int) -> bytes:
    out = b""
    while not -64 <= n < 64:
        out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
    return out + bytes([n & 0x7F])


class File:
    """Names get numbers as they come; `bytes` lays out what has been added."""

    def __init__(self):
        self.strings, self.types, self.protos, self.fields, self.methods, self.classes = [], [], [], [], [], []

    def of(self, pool: list, item) -> int:
        if item not in pool:
            pool.append(item)
        return pool.index(item)

    def string(self, s: str) -> int:
        return self.of(self.strings, s)

    def type(self, d: str) -> int:
        return self.of(self.types, self.string(d))

    def field(self, cls: str, name: str, d: str) -> int:
        return self.of(self.fields, (self.type(cls), self.type(d), self.string(name)))

    def method(self, cls: str, name: str, args: list[str], result: str) -> int:
        proto = self.of(self.protos, (self.string("shorty"), self.type(result), tuple(self.type(a) for a in args)))
        return self.of(self.methods, (self.type(cls), proto, self.string(name)))

    def add(self, cls: str, super_: str | None, interfaces: list[str], source: str | None, fields: list, methods: list) -> None:
        """fields: (number, access); methods: (number, access, code or None), code a dict of registers, ins, units, lines, tries."""
        self.classes.append((self.type(cls), super_ and self.type(super_), [self.type(i) for i in interfaces], source and self.string(source), fields, methods))

    def bytes(self) -> bytes:
        data, at = bytearray(), {}
        base = 0x70 + 4 * len(self.strings) + 4 * len(self.types) + 12 * len(self.protos) + 8 * len(self.fields) + 8 * len(self.methods) + 32 * len(self.classes)

        def put(raw: bytes, align: int = 4) -> int:
            data.extend(b"\0" * (-(base + len(data)) % align))
            data.extend(raw)
            return base + len(data) - len(raw)

        text = lambda s: number(len(s)) + s.encode("utf-16", "surrogatepass").decode("utf-16").encode().replace(b"\0", b"\xc0\x80") + b"\0"
        types = lambda t: put(struct.pack(f"<I{len(t)}H", len(t), *t)) if t else 0

        def code(c: dict | None) -> int:
            if c is None:
                return 0
            lines = 0
            if c.get("lines"):
                program, offset, line = number(c["lines"][0][1]) + number(0), 0, c["lines"][0][1]
                for o, n in c["lines"]:
                    program += b"\x01" + number(o - offset) + b"\x02" + signed(n - line) + b"\x07" + bytes([10 + 4])
                    offset, line = o, n
                lines = put(program + b"\0", 1)
            tries = c.get("tries", [])
            raw = struct.pack("<HHHHII", c["registers"], c["ins"], 0, len(tries), lines, len(c["units"])) + struct.pack(f"<{len(c['units'])}H", *c["units"])
            if tries:
                raw += b"\0\0" * (len(c["units"]) % 2)
                handlers, where = number(len(tries)), []
                for *_, typed, any_ in tries:
                    where.append(len(handlers))
                    handlers += signed(-len(typed) if any_ is not None else len(typed)) + b"".join(number(0) + number(h) for h in typed) + (number(any_) if any_ is not None else b"")
                raw += b"".join(struct.pack("<IHH", start, size, w) for (start, size, *_), w in zip(tries, where, strict=True)) + handlers
            return put(raw)

        ids = b"".join(struct.pack("<I", put(text(s), 1)) for s in self.strings) + b"".join(struct.pack("<I", t) for t in self.types)
        ids += b"".join(struct.pack("<III", s, r, types(a)) for s, r, a in self.protos)
        ids += b"".join(struct.pack("<HHI", *f) for f in self.fields) + b"".join(struct.pack("<HHI", *m) for m in self.methods)
        for cls, super_, interfaces, source, fields, methods in self.classes:
            body, before = number(0) + number(len(fields)) + number(0) + number(len(methods)), 0
            for k, access in sorted(fields):
                body, before = body + number(k - before) + number(access), k
            before = 0
            for k, access, c in sorted(methods, key=lambda m: m[0]):
                body, before = body + number(k - before) + number(access) + number(code(c)), k
            none = 0xFFFFFFFF
            ids += struct.pack("<8I", cls, 1, none if super_ is None else super_, types(interfaces), none if source is None else source, 0, put(body, 1), 0)
        sizes, offset = [], 0x70
        for pool, width in ((self.strings, 4), (self.types, 4), (self.protos, 12), (self.fields, 8), (self.methods, 8), (self.classes, 32)):
            sizes += [len(pool), offset]
            offset += width * len(pool)
        head = b"dex\n035\0" + b"\0" * 24 + struct.pack("<IIIIII", base + len(data), 0x70, 0x12345678, 0, 0, 0)
        return head + struct.pack("<12I", *sizes) + struct.pack("<II", len(data), base) + ids + bytes(data)
