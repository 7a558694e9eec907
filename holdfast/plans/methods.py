"""What one method does with locks: a small abstract interpreter that Spark maps over method rows.

Everything that needs more than one method is a join or an aggregate elsewhere.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import pyarrow as pa

from ..functions.names import AFFIXES, CUT, LONGEST_PATH, OF_FORMAL, OPAQUE, PLACE, STATIC

# Calls that take, try, give back or view a lock.
LOCK_CLASSES = {"Lock", "ReentrantLock", "ReentrantReadWriteLock", "ReadLock", "WriteLock"}
LOCK_CALLS = {
    "lock": "acquire", "lockInterruptibly": "acquire", "acquire": "acquire", "acquireUninterruptibly": "acquire",
    "tryLock": "acquire", "tryAcquire": "acquire", "unlock": "release", "release": "release",
}
VIEWS = {"readLock": "read", "writeLock": "write"}

# A value is (kind, text, fields, mode); kinds: this, param, recv, static, class, alloc, opaque.
Value = tuple[str, str, tuple[str, ...], str]


def lock_call(cls: str, name: str) -> str | None:
    """acquire, release, read or write, for calls that mean one."""
    if name in VIEWS:
        return VIEWS[name]
    if "locks." in cls or cls.rsplit(".", 1)[-1] in LOCK_CLASSES:
        return LOCK_CALLS.get(name)
    return None


def rendered(v: Value) -> str:
    kind, text, fields, mode = v
    before, after = AFFIXES.get(kind, ("", ""))
    return ".".join([before + text + after, *fields, *([mode] if mode else [])])


def grounded(v: Value, m: dict) -> Value:
    if v[0] == "this":
        return ("recv", m["class"], *v[2:])
    return ("opaque", m["key"] + OF_FORMAL + v[1], (), "") if v[0] == "param" else v


def longer(v: Value, fields: tuple[str, ...], mode: str, most: int = LONGEST_PATH) -> Value:
    """`v` followed by more fields; a path of more than `most` is a distinct unknown."""
    out = (v[0], v[1], v[2] + fields, mode or v[3])
    return out if len(out[2]) <= most else ("opaque", CUT + rendered(out), (), "")


def line_at(m: dict, offset: int) -> int | None:
    found = None
    for p in m["positions"]:
        if p["offset"] > offset:
            break
        found = p["line"]
    return found


def lines_of(m: dict) -> list[int | None]:
    """`line_at` of each instruction, in one way through both."""
    found, out, at, positions = None, [], 0, m["positions"]
    for i in m["insns"]:
        while at < len(positions) and positions[at]["offset"] <= i["offset"]:
            found, at = positions[at]["line"], at + 1
        out.append(found)
    return out


def callee(i: dict) -> str:
    return f"{i['class']}.{i['name']}:{i['sig']}"


def place(m: dict, i: dict) -> str:
    return PLACE.format(key=m["key"], offset=i["offset"])


# --- registers: what each holds, instruction by instruction in the order of the code -------------

# What an instruction puts into its target: a value and a class, where they are known.
Cell = tuple[Value | None, str | None]
TARGETS: dict[str, Callable[[Registers, dict], Cell]] = {
    "move": lambda regs, i: regs.cell(i["src"]),
    "move_result": lambda regs, i: (regs.taken_result(), None),
    "new": lambda regs, i: (("alloc", place(regs.method, i), (), ""), i["class"]),
    "const_class": lambda regs, i: (("class", i["class"], (), ""), None),
    "iget": lambda regs, i: (("recv", i["class"], (i["field"],), ""), i["ty"] if len(i["ty"] or "") > 1 else None),
    "sget": lambda regs, i: (("static", i["class"], (i["field"],), ""), None),
    "def": lambda regs, i: (None, None),
}


class Registers:
    """The registers before an instruction; `step` goes on to the next one.

    `getters` are values that callees are known to return, in terms of their own formals.
    """

    def __init__(self, m: dict, getters: dict[str, Value] | None = None):
        self.method, self.getters, self.result = m, getters or {}, None
        first, instance = max(m["registers"] - m["ins"], 0), not m["access"] & STATIC
        self.cells: dict[int, Cell] = {first + j: (("param", str(j), (), ""), None) for j in range(m["ins"])}
        if instance and self.cells:
            self.cells[first] = (("this", "", (), ""), m["class"])

    def cell(self, register: int | None) -> Cell:
        return self.cells.get(register, (None, None))

    def value(self, register: int | None) -> Value | None:
        return self.cell(register)[0]

    def taken_result(self) -> Value | None:
        result, self.result = self.result, None
        return result

    def called(self, i: dict) -> tuple[str | None, list[Value | None]]:
        """What a call means to locks, and the values it is given."""
        return lock_call(i["class"], i["name"]), [self.value(r) for r in i["args"]]

    def returned(self, i: dict) -> Value | None:
        means, given = self.called(i)
        own = given[0] if given else None
        if means in VIEWS.values():
            return own and (*own[:3], means)
        got = self.getters.get(callee(i)) if means is None else None
        if got is None or got[0] not in ("this", "param"):
            return got
        at = int(got[1] or 0)
        start = given[at] if at < len(given) else None
        return start and longer(start, got[2], got[3])

    def step(self, i: dict) -> None:
        if i["op"] == "invoke":
            self.result = self.returned(i)
        elif i["op"] in TARGETS:
            cell = TARGETS[i["op"]](self, i)
            if i["dst"] is not None:
                self.cells[i["dst"]] = cell


# --- values: which locks a method names, returns, stores and passes on ---------------------------

SHARED = ("recv", "static")
FACTS = ("sites", "aliases", "stores", "allocs", "bindings")


def facts_of(m: dict, getters: dict[str, Value]) -> Iterator[tuple[str, tuple | Value | None]]:
    """(name of a fact, its values) over all code, reachable or not; `returns` tell what a return gives back."""
    regs, classes = Registers(m, getters), {place(m, i): i["class"] for i in m["insns"] if i["op"] == "new"}
    for i in m["insns"]:
        taken = None
        if i["op"] == "monitor_enter":
            taken = [regs.value(i["src"])]
        elif i["op"] == "return":
            yield "returns", regs.value(i["src"])
        elif i["op"] == "iput":
            yield from stored(regs, i, classes)
        elif i["op"] == "invoke":
            means, given = regs.called(i)
            if any(v and v[0] in ("this", "param", *SHARED) for v in given):
                yield "bindings", (callee(i), given)
            if means == "acquire":
                taken = given[:1] or [None]
        if taken:
            yield "sites", (taken[0] or ("opaque", place(m, i), (), ""), line_at(m, i["offset"]))
        regs.step(i)


def stored(regs: Registers, i: dict, classes: dict[str, str]) -> Iterator[tuple[str, tuple]]:
    """A store into a field: of a formal or another lock into this object's, of a new object into any."""
    field, (value, _), base = f"{i['class']}.{i['field']}", regs.cell(i["src"]), regs.value(i["base"])
    if value is None:
        return
    mine, lock = base is not None and base[0] == "this", grounded(value, regs.method)
    if mine and value[0] == "param":
        yield "stores", (field, int(value[1]))
    elif mine and lock[0] in SHARED and rendered(lock) != field:
        yield "aliases", (field, lock)
    if value[0] == "alloc":
        yield "allocs", (field, classes[value[1]])
        if mine:
            # From here on the new object is known by the field that holds it.
            regs.cells[i["src"]] = (("this", "", (i["field"],), ""), None)


def summarize(m: dict, getters: dict[str, Value]) -> dict[str, list]:
    """The facts by name, and the one value that all returns give back, if it means something to callers."""
    out: dict[str, list] = {name: [] for name in (*FACTS, "returns")}
    for name, fact in facts_of(m, getters):
        out[name].append(fact)
    values = set(out.pop("returns"))
    only = values.pop() if len(values) == 1 else None
    return out | {"getter": only if only and only[0] not in ("alloc", "opaque") else None}


# --- held locks: a forward dataflow over basic blocks --------------------------------------------


def lock_events(m: dict) -> list[tuple | None]:
    """What each instruction means to the held locks. Getters aren't followed, and new objects have no name yet."""
    regs, out = Registers(m), []

    def name(v: Value | None) -> str | None:
        return rendered(grounded(v, m)) if v and v[0] != "alloc" else None

    for i in m["insns"]:
        op, event = i["op"], None
        if op == "invoke":
            means, given = regs.called(i)
            own = name(given[0]) if given else None
            if means == "acquire":
                event = (means, own or OPAQUE + place(m, i))
            elif means == "release":
                event = (means, own)
            elif means is None:
                whole = [v if v and v[0] in ("this", "param") and not v[2] else None for v in given]
                event = ("call", i, [regs.cell(r)[1] for r in i["args"]], [v and int(v[1] or 0) for v in whole])
        elif op == "monitor_enter":
            event = ("acquire", name(regs.value(i["src"])) or OPAQUE + place(m, i))
        elif op == "monitor_exit":
            event = ("leave", name(regs.value(i["src"])))
        elif op[1:] in ("get", "put"):
            event = ("field", f"{i['class']}.{i['field']}", op[1:] == "put")
        regs.step(i)
        out.append(event)
    return out


def straight(m: dict) -> bool:
    """One block that nothing jumps from: its instructions are gone through once."""
    ends = [k for k, i in enumerate(m["insns"]) if i["op"] in ("goto", "branch", "switch", "return", "throw")]
    return not m["catches"] and (not ends or (ends == [len(m["insns"]) - 1] and m["insns"][-1]["op"] in ("return", "throw")))


def flow_graph(m: dict) -> tuple[list[range], list[list[int]], list[list[int]]]:
    """Blocks, their normal successors, and the handlers that see their entry states."""
    insns = m["insns"]
    n, at = len(insns), {}
    offsets = [i["offset"] for i in insns]
    index = lambda offset: bisect.bisect_left(offsets, offset)
    heads = {0}
    for k, i in enumerate(insns):
        if i["op"] in ("goto", "branch", "switch", "return", "throw"):
            heads |= {k + 1, *(index(t) for t in i["targets"] or ())}
    for c in m["catches"]:
        heads |= {index(c[x]) for x in ("start", "end", "handler")}
    bounds = sorted(h for h in heads if h < n) + [n]
    blocks = [range(a, b) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    for b, block in enumerate(blocks):
        at.update(dict.fromkeys(block, b))
    after, handlers = [], []
    for b, block in enumerate(blocks):
        last = insns[block[-1]]
        jumps = [at[index(t)] for t in last["targets"] or () if index(t) < n] if last["op"] in ("goto", "branch", "switch") else []
        falls = [b + 1] if last["op"] not in ("goto", "return", "throw") and b + 1 < len(blocks) else []
        after.append(jumps + falls)
        covers = [c for c in m["catches"] if block[0] < index(c["end"]) and block[-1] + 1 > index(c["start"]) and index(c["handler"]) < n]
        handlers.append(list(dict.fromkeys(at[index(c["handler"])] for c in covers)))
    return blocks, after, handlers


# A state: the held locks innermost last, as (name, line taken), and names released for the caller.
State = tuple[tuple[tuple[str, int | None], ...], tuple[str, ...]]


def without(state: State, name: str | None, note: bool) -> tuple[State, tuple[str, int | None] | None]:
    """Takes off the innermost lock of that name (of any, for None); a miss is noted for the caller."""
    held, owed = state
    for k in range(len(held) - 1, -1, -1):
        if name is None or held[k][0] == name:
            return (held[:k] + held[k + 1 :], owed), held[k]
    return ((held, owed) if not note or name in owed else (held, (*owed, name))), None


def met(a: State, b: State) -> State:
    """What both have, by name, in the order of the first."""
    names = {n for n, _ in b[0]}
    return tuple(h for h in a[0] if h[0] in names), tuple(n for n in a[1] if n in b[1])


def held_locks(m: dict, entry: list[str], effects: dict[str, tuple[list[str], list[str]]]) -> tuple[list[tuple], list[State]]:
    """Events (kind, line, name, enter line, held names, detail) in block order, and the states at returns."""
    if not m["insns"]:
        return [], []
    meaning, lines = lock_events(m), lines_of(m)

    def run(state: State, block: range, tell: Callable) -> State:
        for k in block:
            event, line = meaning[k], lines[k]
            if event is None:
                continue
            kind, held = event[0], [n for n, _ in state[0]]
            if kind == "acquire":
                tell(("acquire", line, event[1], None, held, None))
                state = ((*state[0], (event[1], line)), state[1])
            elif kind == "leave" or (kind == "release" and event[1]):
                state, gone = without(state, event[1], kind == "release")
                if gone:
                    tell(("release", line, gone[0], gone[1], [], None))
            elif kind == "field":
                tell(("field", line, event[1], None, held, event))
            elif kind == "call":
                tell(("call", line, callee(event[1]), None, held, event))
                takes, gives = effects.get(callee(event[1]), ((), ()))
                for name in gives:
                    state, gone = without(state, name, True)
                    if gone:
                        tell(("release", line, gone[0], gone[1], [], None))
                for name in takes:
                    tell(("acquire", line, name, None, [n for n, _ in state[0]], None))
                    state = ((*state[0], (name, line)), state[1])
        return state

    states: dict[int, State] = {0: (tuple((n, None) for n in entry), ())}
    events: list[tuple] = []
    if straight(m):
        end = run(states[0], range(len(m["insns"])), events.append)
        return events, [end] if m["insns"][-1]["op"] == "return" else []
    blocks, after, handlers = flow_graph(m)
    waiting = [0]
    while waiting:
        b = waiting.pop(0)
        out = run(states[b], blocks[b], lambda _: None)
        for to, state in [*((s, out) for s in after[b]), *((h, states[b]) for h in handlers[b])]:
            now = met(states[to], state) if to in states else state
            if states.get(to) != now:
                states[to] = now
                if to not in waiting:
                    waiting.append(to)
    ends = [(b, run(states[b], blocks[b], events.append)) for b in sorted(states)]
    return events, [state for b, state in ends if m["insns"][blocks[b][-1]]["op"] == "return"]


def net_effect(ends: list[State]) -> tuple[list[str], list[str]]:
    """Locks that all returns still hold, and that all have released for the caller, sorted."""
    if not any(held or owed for held, owed in ends):
        return [], []
    both = []
    for pick in (lambda s: {n for n, _ in s[0]}, lambda s: set(s[1])):
        both.append(sorted(n for n in set.intersection(*map(pick, ends)) if not n.startswith(OPAQUE)))
    return both[0], both[1]


# --- over Arrow batches --------------------------------------------------------------------------

VALUE = "struct<kind: string, text: string, fields: array<string>, mode: string>"
SUMMARY = f"""method_id long, key string, class string, getter {VALUE}, sites array<struct<lock: {VALUE}, line: int>>,
    aliases array<struct<field: string, lock: {VALUE}>>, stores array<struct<field: string, formal: int>>,
    allocs array<struct<field: string, type: string>>, bindings array<struct<callee: string, actuals: array<{VALUE}>>>"""
EVENTS = """method_id long, key string, ord int, kind string, line int, name string, enter int, held array<string>, write boolean,
    class string, sig string, dispatch string, arg_types array<string>, arg_formals array<int>"""
WALK = f"{EVENTS}, takes array<string>, gives array<string>"
SURVEY = f"{WALK}, {SUMMARY.split('class string,')[1]}"


def value_row(v: Value | None) -> dict | None:
    return v and {"kind": v[0], "text": v[1], "fields": list(v[2]), "mode": v[3]}


def value_of(row: dict | None) -> Value | None:
    return row and (row["kind"], row["text"], tuple(row["fields"]), row["mode"])


def batches_of(rows: Iterator[dict], schema: pa.Schema, size: int = 2_000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def plain(column: pa.Array) -> list:
    """Python values of a column; nested ones are taken apart, so that values are read by the column, not one by one."""
    if not len(column):
        # Without rows there may be no offsets either.
        return []
    if pa.types.is_list(column.type):
        # Of a slice only what it holds.
        ends = column.offsets.to_numpy().tolist()
        inside, ends = plain(column.values.slice(ends[0], ends[-1] - ends[0])), [e - ends[0] for e in ends]
        out = [inside[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    elif pa.types.is_struct(column.type):
        names = [f.name for f in column.type]
        out = [dict(zip(names, values, strict=True)) for values in zip(*map(plain, column.flatten()), strict=True)]
    else:
        return column.to_pandas(integer_object_nulls=True).tolist()
    return [v if there else None for v, there in zip(out, column.is_valid().to_pylist(), strict=True)] if column.null_count else out


def methods_in(batches: Iterator[pa.RecordBatch], size: int = 500) -> Iterator[dict]:
    """Methods as Python values, `size` of a batch at a time: more of them at once don't stay near the processor."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            for values in zip(*map(plain, batch.slice(at, size).columns), strict=True):
                m = dict(zip(batch.schema.names, values, strict=True))
                for name in ("insns", "positions", "catches"):
                    m[name] = m[name] or []
                for i in m["insns"]:
                    i["args"] = i["args"] or []
                yield m


def summary_rows(methods: Iterator[dict]) -> Iterator[dict]:
    for m in methods:
        getters = {g["key"]: value_of(g["value"]) for g in m.get("getters") or ()}
        s = summarize(m, getters)
        if not any(s.values()):
            continue
        yield {
            "method_id": m["method_id"], "key": m["key"], "class": m["class"], "getter": value_row(s["getter"]),
            "sites": [{"lock": value_row(v), "line": n} for v, n in s["sites"]],
            "aliases": [{"field": f, "lock": value_row(v)} for f, v in s["aliases"]],
            "stores": [{"field": f, "formal": j} for f, j in s["stores"]],
            "allocs": [{"field": f, "type": t} for f, t in s["allocs"]],
            "bindings": [{"callee": c, "actuals": [value_row(a) for a in actuals]} for c, actuals in s["bindings"]],
        }


def known_effects(m: dict) -> dict[str, tuple[list[str], list[str]]]:
    return {e["key"]: (e["takes"], e["gives"]) for e in m.get("effects") or ()}


def effect_rows(methods: Iterator[dict]) -> Iterator[dict]:
    for m in methods:
        takes, gives = net_effect(held_locks(m, [], known_effects(m))[1])
        if takes or gives:
            yield {"method_id": m["method_id"], "key": m["key"], "takes": takes, "gives": gives}


def first_lines(events: list[tuple]) -> dict[str, int]:
    """For each name the line of its first use (0: unknown): taken, given back (then where it was taken), or held at a call or where
    another is taken."""
    first: dict[str, int] = {}
    for kind, line, name, enter, held, _ in events:
        if kind == "acquire":
            first.setdefault(name, line or 0)
        elif kind == "release" and enter is not None:
            first.setdefault(name, enter)
        if kind in ("acquire", "call"):
            for n in held:
                first.setdefault(n, line or 0)
    return first


def told(m: dict, events: list[tuple], fields: bool = True) -> Iterator[dict]:
    """A row for each event, and after them one of kind name for each lock's name, with its first line. Accesses of fields are
    left out, their numbers unused, if `fields` is false."""
    for ord_, (kind, line, name, enter, held, detail) in enumerate(events):
        if kind == "field" and not fields:
            continue
        row = {"method_id": m["method_id"], "key": m["key"], "ord": ord_, "kind": kind, "line": line, "name": name, "enter": enter, "held": held}
        if kind == "field":
            row["write"] = detail[2]
        elif kind == "call":
            _, i, types, formals = detail
            row |= {"class": i["class"], "sig": f"{i['name']}:{i['sig']}", "dispatch": i["kind"], "arg_types": types, "arg_formals": formals}
        yield row
    for ord_, (name, line) in enumerate(first_lines(events).items(), len(events)):
        yield {"method_id": m["method_id"], "key": m["key"], "ord": ord_, "kind": "name", "line": line, "name": name, "held": []}


def event_rows(methods: Iterator[dict]) -> Iterator[dict]:
    for m in methods:
        yield from told(m, held_locks(m, m.get("entry") or [], known_effects(m))[0])


def walk_rows(methods: Iterator[dict], fields: bool = True) -> Iterator[dict]:
    """Events, and the method's own effect as one more row of kind effect, of one walk that knows no callee's effects."""
    for m in methods:
        events, ends = held_locks(m, [], {})
        yield from told(m, events, fields)
        takes, gives = net_effect(ends)
        if takes or gives:
            yield {"method_id": m["method_id"], "key": m["key"], "ord": len(events), "kind": "effect", "takes": takes, "gives": gives}


def survey_rows(methods: Iterator[dict], fields: bool = True) -> Iterator[dict]:
    """As `walk_rows`, and the method's facts, as far as they are known without getters, as one more row of kind summary."""
    for m in methods:
        yield from walk_rows((m,), fields)
        for s in summary_rows((m,)):
            yield {"ord": -1, "kind": "summary"} | s
