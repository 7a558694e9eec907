"""Small programs as facts: a winch, a tower with a radio, trains, a saw and a vault."""

from holdfast.sources.sketches import Program

STATIC, PRIVATE, ABSTRACT = 0x8, 0x2, 0x400
REMOTE = "android.os.IInterface"


def within(lock: str, code: list[str], register: int = 0, this: int = 3) -> list[str]:
    """`code` with a lock of this object taken before and left after it."""
    return [f"iget {register} {this} {lock}", f"enter {register}", *code, f"exit {register}"]


def winch():
    """A site for each kind of value that can be locked."""
    p = Program()
    p.cls("pier.Winch")
    p.method("reel:(I)V", ["other", "iget 2 4 pier.Winch.drum", "other", "enter 2", "exit 2", "return"], registers=6, ins=2, lines={0: 31, 3: 33, 4: 34})
    p.method("brake:()V", ["sget 1 pier.Dock.shared", "move 0 1", "enter 0", "exit 1", "return"], lines=40)
    p.method("hold:()V", ["enter 3", "exit 3", "return"])
    p.method("audit:()V", ["const_class 0 pier.Dock", "enter 0", "exit 0", "return"], registers=1, ins=0, access=STATIC, lines=52)
    p.method("splice:(Lpier/Rope;)V", ["enter 3", "exit 3", "return"], ins=2, lines=60)
    p.method("odd:()V", ["def 0", "enter 0", "exit 0", "return"], lines=66)
    return p


def passed_keys():
    """A key goes through two constructors to a door; a bell gets one of two cords; a rail comes from a getter."""
    p = Program()
    p.cls("pier.Boat")
    p.method("board:()V", ["iget 0 3 pier.Boat.key", "new 1 pier.Cabin", "direct 1,0 pier.Cabin.<init>:(Lpier/Key;)V", "return"], lines=1)
    p.method("rail:()Lpier/Key;", ["sget 0 pier.Dock.shared", "return 0"], access=STATIC, ins=0, lines=3)
    p.method("lean:()V", ["static pier.Boat.rail:()Lpier/Key;", "move_result 0", "enter 0", "exit 0", "return"], lines=4)
    for k, cord in enumerate(("iget 0 3 pier.Boat.key", "sget 0 pier.Dock.shared")):
        p.method(f"hang{k}:()V", [cord, "new 1 pier.Bell", "direct 1,0 pier.Bell.<init>:(Lpier/Key;)V", "return"], lines=5 + k)
    p.cls("pier.Cabin")
    p.method("<init>:(Lpier/Key;)V", ["new 0 pier.Door", "direct 0,3 pier.Door.<init>:(Lpier/Key;)V", "return"], ins=2, lines=7)
    for cls, field, line in (("Door", "latch", 8), ("Bell", "cord", 11)):
        p.cls(f"pier.{cls}")
        p.method("<init>:(Lpier/Key;)V", [f"iput 3 2 pier.{cls}.{field}", "return"], ins=2, lines=line)
        p.method("move:()V", [*within(f"pier.{cls}.{field}", []), "return"], lines=line + 1)
    return p


def tower():
    """Calls over a radio whose interface is remote by its parent's parent."""
    p = Program()
    p.cls(REMOTE)
    for cls, parent, method in (("Link", REMOTE, "ping:()V"), ("Radio", "port.Link", "send:(I)V"), ("Log", "port.Paper", "note:()V")):
        p.cls(f"port.{cls}", interfaces=(parent,))
        p.method(method, access=ABSTRACT)
    p.cls("port.Tower")
    desk, ping = ["sget 0 port.Tower.desk", "enter 0"], ["iget 1 3 port.Tower.link port.Link", "interface 1 port.Link.ping:()V"]
    sent = ["iget 1 3 port.Tower.radio port.Radio", "interface 1,0 port.Radio.send:(I)V", "interface 2 port.Log.note:()V"]
    p.method("hail:()V", [*desk, *sent, "exit 0", *ping, "return"], lines={0: 70, 3: 72, 5: 73})
    p.method("relay:()V", [*ping, "return"], access=PRIVATE, lines=80)
    p.method("shout:()V", [*ping, "return"], access=PRIVATE, lines=81)
    relay, shout = "direct 3 port.Tower.relay:()V", "direct 3 port.Tower.shout:()V"
    p.method("day:()V", [*desk, relay, shout, "exit 0", "return"], lines=82)
    p.method("night:()V", [*desk, *within("port.Tower.mast", [relay], 1), "exit 0", shout, "return"], lines=83)
    return p


def trains():
    """Three locks in a ring, one step of it two calls deep; two pairs in both orders, one of them behind a guard."""
    p = Program()
    p.cls("yard.Train")
    name = lambda lock: f"yard.Train.{lock}"
    p.method("couple:()V", [*within(name("hook"), ["virtual 3 yard.Train.check:()V"]), "return"], lines=5)
    p.method("check:()V", ["virtual 3 yard.Train.test:()V", "return"], lines=6)
    p.method("test:()V", [*within(name("valve"), []), "return"], lines=7)
    for line, method, first, second in ((8, "vent", "valve", "horn"), (9, "blow", "horn", "hook"), (10, "dawn", "lamp", "sign"), (11, "dusk", "sign", "lamp")):
        p.method(f"{method}:()V", [*within(name(first), within(name(second), [], 1)), "return"], lines=line)
    for line, first, second in ((12, "bell", "siren"), (13, "siren", "bell")):
        inner = within(name(first), within(name(second), [], 1))
        p.method(f"warn{line}:()V", [*within(name("guard"), inner, 2), "return"], lines=line)
    return p


def saw():
    """Locks over branches, handlers and loops, through views and helpers, and around work that is handed on."""
    p = Program()
    p.cls("mill.Saw")
    call = lambda name, this=3: f"virtual {this} mill.Saw.{name}:()V"
    blade, held = ["iget 0 3 mill.Saw.blade", "enter 0"], "java.util.concurrent.locks."
    p.method("sort:(I)V", ["iget 0 2 mill.Saw.blade", "enter 0", "switch 5,7", call("plain", 2), "goto 9", call("first", 2), "goto 9", "exit 0", call("freed", 2), call("joined", 2), "return"], ins=2, lines=1)
    p.method("guarded:()V", [*blade, call("risky"), "exit 0", "goto 8", call("rescue"), "exit 0", "throw", call("done"), "return"], catches=((2, 3, 5),), lines=2)
    p.method("spin:()V", ["branch 8", *blade, call("inside"), "branch 7", "exit 0", "goto 0", "exit 0", call("after"), "return"], lines=3)
    view = [f"virtual 0 {held}ReentrantReadWriteLock.writeLock:()L;", "move_result 1"]
    change = [*view, f"virtual 1 {held}ReentrantReadWriteLock$WriteLock.lock:()V", call("changing"), *view, f"virtual 1 {held}ReentrantReadWriteLock$WriteLock.unlock:()V"]
    p.method("change:()V", ["iget 0 3 mill.Saw.plan", *change, call("changed"), "return"], lines=4)
    for name, does, line in (("hold", "lock", 5), ("free", "unlock", 6)):
        p.method(f"{name}:()V", ["iget 0 3 mill.Saw.bolt", f"virtual 0 {held}ReentrantLock.{does}:()V", "return"], access=PRIVATE, lines=line)
    p.method("fix:()V", ["direct 3 mill.Saw.hold:()V", "return"], access=PRIVATE, lines=7)
    p.method("cut:()V", ["direct 3 mill.Saw.fix:()V", call("fixed"), "direct 3 mill.Saw.free:()V", call("loose"), "return"], lines=8)
    p.method("now:(Lmill/Job;)V", ["interface 3 mill.Job.go:()V", "return"], ins=2, lines=9)
    p.method("twice:(Lmill/Job;)V", ["virtual 2,3 mill.Saw.now:(Lmill/Job;)V", "virtual 2,3 mill.Saw.now:(Lmill/Job;)V", "return"], ins=2, lines=10)
    p.method("queue:(Lmill/Job;)V", ["iput 3 2 mill.Saw.waiting", "return"], ins=2, lines=11)
    hand = [f"new 1 mill.{job} / virtual 3,1 mill.Saw.{to}:(Lmill/Job;)V" for job, to in (("Rip", "now"), ("Plane", "twice"), ("Sand", "queue"))]
    p.method("shift:()V", [*blade, *" / ".join(hand).split(" / "), "exit 0", "return"], lines=12)
    p.cls("mill.Job")
    p.method("go:()V", access=ABSTRACT)
    for line, job in enumerate(("Rip", "Plane", "Sand"), 13):
        p.cls(f"mill.{job}", interfaces=("mill.Job",))
        p.method("go:()V", ["return"], lines=line)
    return p


def vault():
    """Fields behind a door: two also written elsewhere, one of them through an accessor; one volatile; one only read elsewhere."""
    p = Program()
    p.cls("java.lang.Runnable")
    p.cls("bank.Vault", interfaces=("java.lang.Runnable",))
    field = lambda op, name: f"{op} 1 3 bank.Vault.{name}"
    used = [field("iput", "count"), field("iput", "state"), field("iput", "tally"), field("iget", "notes"), field("iget", "cash")]
    p.method("<init>:()V", [field("iput", "tally"), "return"], lines=1)
    for k in range(5):
        p.method(f"use{k}:()V", [*within("bank.Vault.door", [*used, "direct 3 bank.Vault.pay:()V"]), "return"], lines=10 + k)
    p.method("pay:()V", [field("iput", "cash"), "return"], access=PRIVATE, lines=20)
    p.method("run:()V", [field("iput", "count"), field("iput", "state"), field("iget", "tally"), "return"], lines=21)
    p.method("put$1:(Lbank/Vault;I)V", ["iput 3 2 bank.Vault.notes", "return"], ins=2, access=STATIC, lines={0: 0})
    p.cls("bank.Clerk", interfaces=("java.lang.Runnable",))
    p.method("run:()V", ["iget 0 3 bank.Clerk.vault", "static 0,1 bank.Vault.put$1:(Lbank/Vault;I)V", "return"], lines=30)
    p.flags.append("bank.Vault.state")
    return p


def yards(n: int):
    """n files, each with a bar that is taken before a call, and the gate of the next one under it."""
    p = Program()
    for i in range(n):
        cls, after = f"port.Yard{i}", f"port.Yard{(i + 1) % n}"
        p.cls(cls)
        p.method("open:()V", [*within(f"{cls}.bar", [f"direct 3 {cls}.shut:()V"]), "return"], lines=3)
        p.method("shut:()V", [*within(f"{after}.bar", []), "return"], lines=4)
    return p


def loft(n: int, callers: int = 0, under: bool = True, lines: int = 10):
    """n wings that override what a loft calls, under its door (if `under`) and from a thread; each wing rings the bell that it is handed."""
    p = Program()
    p.cls("java.lang.Runnable")
    p.cls("loft.Bell")
    p.method("ring:()V", ["return"], lines=1)
    p.cls("loft.Chime", super_="loft.Bell")
    p.method("ring:()V", ["return"], lines=2)
    p.cls("loft.Wing")
    p.method("beat:()V", ["return"], lines=3)
    p.method("carry:(Lloft/Bell;)V", ["return"], ins=2, lines=4)
    for k in range(n):
        p.cls(f"loft.Wing{k}", super_="loft.Wing")
        p.method("beat:()V", [f"iput 1 3 loft.Wing.speed{k}", "return"], lines=lines)
        p.method("carry:(Lloft/Bell;)V", ["virtual 3 loft.Bell.ring:()V", "return"], ins=2, lines=11)
        for j in range(3):
            p.method(f"glide{j}:()V", [*within("loft.Loft.door", [f"iput 1 3 loft.Wing.speed{k}"]), "return"], lines=12 + j)
    p.cls("loft.Loft", interfaces=("java.lang.Runnable",))
    wing, beat = "iget 1 3 loft.Loft.wing", "virtual 1 loft.Wing.beat:()V"
    if under:
        p.method("fly:()V", [*within("loft.Loft.door", [wing, beat]), "return"], lines=20)
    p.method("drop:()V", [*within("loft.Loft.door", [wing, "new 2 loft.Chime", "virtual 1,2 loft.Wing.carry:(Lloft/Bell;)V"]), "return"], lines=21)
    p.method("run:()V", [wing, beat, "return"], lines=22)
    for k in range(callers):
        p.method(f"call{k}:()V", [wing, beat, "return"], lines=30 + k)
    return p
