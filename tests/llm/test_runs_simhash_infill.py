"""Runs, SimHash groups and fill-in-the-middle against plain versions of themselves."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from holdfast.llm import infill, runs, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "id string, fp int, doc_id long, text string, n int, form string, runs int, tile int, least int, label string, row int, h1 int, first int"


def table(spark, rows, parts=3):
    """Documents with other columns whose names the operators use inside."""
    return spark.createDataFrame([("x", 1, d, t, 2, "f", 3, 4, 5, "l", 6, 7, 8) for d, t in rows], SCHEMA).repartition(parts)


def odd_texts() -> list[tuple[int | None, str | None]]:
    r = random.Random(3)
    prose = lambda n: " ".join(r.choice("abcdefghij") * r.randint(1, 3) for _ in range(n))
    base = prose(80)
    texts = [prose(r.randint(1, 200)) for _ in range(20)] + [base, base.upper(), base + " more", base.replace(" ", "\n", 3), "", None, " \n\t", "one", "two words", "\n\n\n", "no end\nof line", "ends\n"]
    texts += ["é\x0bü\xa0x \U0001f600\n" * 9, "a <P> b\nc", "<S", "<<P\n>", "x<M>", "a\x00b\n" * 30]
    rows = [(i * 7 % 61, t) for i, t in enumerate(texts)]
    return [*rows, rows[0], (rows[1][0], "the same id again"), (None, base), (None, None), (-(2**63), base)]


# --- runs ---------------------------------------------------------------------------------------


def plain_runs(w: list, least=24, times=3) -> list[tuple[int, int, int]]:
    out = []
    for p in range(1, len(w) // times + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, times * p):
                own = w[i : j + p]
                if not any(all(own[x] == own[x + q] for x in range(len(own) - q)) for q in range(1, p)):
                    out.append((i, j + p - i, p))
            i = j + 1
    return sorted(out, key=lambda x: (x[0], x[2]))


def periodic(r: random.Random) -> list[str]:
    """Words with runs of many periods, nested, touching and broken."""
    letters = r.choice(["ab", "abc", "abcdefgh"])
    out: list[str] = []
    while len(out) < r.choice([30, 90, 300]):
        block = [r.choice(letters) for _ in range(r.choice([1, 2, 3, 5, 8, 9, 13, 24]))]
        out += block * r.choice([1, 2, 3, 4, 9, 30])
        if r.random() < 0.3:
            out += [r.choice(letters) for _ in range(r.randint(1, 12))]
    return out


@pytest.mark.parametrize("probes, cells", [(runs.PROBES, runs.CELLS), (50, 16)])
def test_runs_against_all_stretches(monkeypatch, probes, cells):
    monkeypatch.setattr(runs, "PROBES", probes)
    monkeypatch.setattr(runs, "CELLS", cells)
    r = random.Random(1)
    fibonacci = ["a", "ab"]
    while len(fibonacci[-1]) < 300:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    words = [periodic(r) for _ in range(40)]
    words += [list(fibonacci[-1]), ["a"] * 23, ["a"] * 24, ["a"] * 200, [], list("abacaab" * 4 + "abaca" * 9), list(("a" * 30 + "b") * 4), list(("ab" * 20 + "c") * 3)]
    at = np.cumsum([0, *map(len, words)])
    ids = np.array([ord(x) for w in words for x in w], np.int32)
    got = runs.find_runs(ids, at)
    assert {len(got) > 50, len({tuple(x) for x in got.tolist()}) == len(got)} == {True}
    for i, w in enumerate(words):
        assert [tuple(x[1:]) for x in got.tolist() if x[0] == i] == plain_runs(w)
    short = runs.find_runs(ids, at, least=5, times=4)
    for i, w in enumerate(words):
        assert [tuple(x[1:]) for x in short.tolist() if x[0] == i] == plain_runs(w, 5, 4)


def test_neighbours_do_not_join_a_run():
    """The last words of one text and the first of the next are no run."""
    assert len(runs.find_runs(np.zeros(40, np.int32), np.array([0, 20, 40]))) == 0
    with pytest.raises(ValueError):
        runs.find_runs(np.zeros(40, np.int32), np.array([0, 40]), times=2)


def test_long_texts_take_little_more_than_their_length():
    n = 400_000
    one = np.zeros(n, np.int32)
    assert runs.find_runs(one, np.array([0, n])).tolist() == [[0, 0, n, 1]]
    r = np.random.default_rng(2)
    block = r.integers(0, 1000, n // 4)
    assert runs.find_runs(np.tile(block, 4), np.array([0, n])).tolist() == [[0, 0, n, n // 4]]
    broken = one.copy()
    broken[r.integers(0, n, 2000)] = 1
    assert runs.find_runs(broken, np.array([0, n])).shape[0] > 1000


def collapsed(w, found):
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_periodic_runs(spark):
    r = random.Random(4)
    rows = [*odd_texts(), *[(100 + i, " ".join(periodic(r))) for i in range(20)], (200, "w " * 70_000 + "end")]
    got = runs.periodic_runs(table(spark, rows)).collect()
    want = Counter()
    for d, t in rows:
        w = WORD.findall(t or "")
        found = plain_runs(w) if len(w) < 5000 else [(0, 70_000, 1)]
        want[d, len(w), tuple(found), collapsed(w, found)] += 1
    assert Counter((x.doc_id, x.n_words, tuple(map(tuple, x.runs)), x.collapsed) for x in got) == want
    assert runs.periodic_runs(table(spark, [])).collect() == []


def test_greatest_run_is_exact(spark):
    rows = [(0, [(9, 30, 10), (2, 33, 11), (50, 24, 8)]), (1, [(0, 24, 8), (1, 2**31 * 3 + 1, 2**31)]), (2, [])]
    found = spark.createDataFrame(rows, f"i int, runs {runs.RUNS}").select("i", runs.greatest_run(F.col("runs")).alias("best"))
    best = {r.i: tuple(r.best) if r.best else None for r in found.collect()}
    assert best == {0: (9, 30, 10), 1: (1, 2**31 * 3 + 1, 2**31), 2: None}


def test_planted_runs(spark):
    import zlib

    rows = [(d, " ".join(f"w{i}" for i in range(d % 90))) for d in range(300)] + [(None, "a b c")]
    for r in runs.with_planted_runs(table(spark, rows)).collect():
        w = dict(rows)[r.doc_id].split()
        h, n = zlib.crc32(str(r.doc_id).encode()), len(w)
        if r.doc_id is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        assert r.text == " ".join(w)


# --- simhash ------------------------------------------------------------------------------------


def plain_fingerprint(text: str | None) -> int:
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints: list[int], radius: int) -> dict[int, int]:
    left, label = set(prints), {}
    while left:
        todo = [min(left)]
        seen = set(todo)
        while todo:
            x = todo.pop()
            near = {y for y in left - seen if (x ^ y).bit_count() <= radius}
            seen |= near
            todo += near
        label |= dict.fromkeys(seen, min(seen))
        left -= seen
    return label


@pytest.mark.parametrize("piece, hashes", [(simhash.PIECE, simhash.HASHES), (7, 5)])
def test_simhash_groups(spark, monkeypatch, piece, hashes):
    monkeypatch.setattr(simhash, "PIECE", piece)
    monkeypatch.setattr(simhash, "HASHES", hashes)
    rows = odd_texts()
    prints = [plain_fingerprint(t) for _, t in rows]
    label = plain_components(list(set(prints)), simhash.RADIUS)
    least: dict[int, int] = {}
    for (d, _), fp in zip(rows, prints, strict=True):
        if d is not None:
            least[label[fp]] = min(least.get(label[fp], d), d)
    want = Counter((d, fp, least.get(label[fp])) for (d, _), fp in zip(rows, prints, strict=True))
    got = simhash.simhash_groups(table(spark, rows)).collect()
    assert Counter((x.doc_id, x.fp % 2**64, x.component_id) for x in got) == want
    assert simhash.simhash_groups(table(spark, [])).collect() == []
    alone = simhash.simhash_groups(table(spark, [(None, "only null ids"), (5, "another text altogether, far away")])).collect()
    assert {(x.doc_id, x.component_id) for x in alone} == {(None, None), (5, 5)}


@pytest.mark.parametrize("parts", [4, 8, 16])
@pytest.mark.parametrize("block", [5, 4096])
def test_tiles_find_all_links(spark, parts, block):
    """Chains and dense groups of near fingerprints, all-zero and all-one ones too, in blocks of few."""
    r = random.Random(parts)
    prints = {0, 1, 3, 2**63, 2**64 - 1, 2**64 - 2, (2**64 - 1) ^ 3 << 40}
    for _ in range(40):
        x = r.getrandbits(64)
        for _ in range(r.choice([1, 2, 12])):
            prints.add(x)
            for _ in range(r.choice([1, 2, 2, 3])):
                x ^= 1 << r.randrange(64)
    prints |= {1 << i | 1 << j for i in range(9) for j in range(i)}
    signed = [(x - 2**64 if x >= 2**63 else x,) for x in prints]
    edges = simhash.near_fingerprints(spark.createDataFrame(signed, "fp long"), 2, parts, block).collect()
    links = [(a % 2**64, b % 2**64) for a, b in edges]
    label = plain_components(list(prints), 2)
    assert all(label[a] == label[b] for a, b in links)
    up = {x: x for x in prints}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[root(a)] = root(b)
    assert len({root(x) for x in prints}) == len(set(label.values()))


def test_near_tiles_are_all_within_the_radius():
    assert [len(simhash.near_tiles(p, 2)) for p in (4, 8, 16)] == [21, 73, 273]


# --- fill in the middle -------------------------------------------------------------------------


def plain_infill(d, text):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(lines)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return d, n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(lines[:low]), "".join(lines[low:high]), "".join(lines[high:])
    if h[3] % 100 < 50:
        return d, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return d, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("chunk", [1, 2, 5, 40, infill.CHUNK])
def test_fill_in_middle(spark, chunk):
    r = random.Random(6)
    rows = odd_texts() + [(300 + i, "".join(r.choice(["a", "é", "\n", "\n", "<", "P", "S", ">", "\U0001f600"]) for _ in range(r.randint(0, 60)))) for i in range(60)]
    made = infill.fill_in_middle(table(spark, rows), chunk=chunk)
    made = made.withColumn("again", infill.restored(F.col("output"), F.col("form"))).collect()
    assert Counter(tuple(x)[:-1] for x in made) == Counter(plain_infill(d, t) for d, t in rows)
    assert Counter((x.doc_id, x.again) for x in made) == Counter((d, t or "") for d, t in rows)
    assert infill.fill_in_middle(table(spark, []), chunk=chunk).collect() == []


def test_long_texts_are_cut_across_chunks(spark):
    rows = [(i, f"line {i} of many, é\n" * 200_000 + "<P" * (i % 2) + "\n" * i) for i in range(3)] + [(9, "x" * 5_000_000), (10, "y" * 2_000_000 + "<M>")]
    made = infill.fill_in_middle(table(spark, rows)).collect()
    assert Counter(map(tuple, made)) == Counter(plain_infill(d, t) for d, t in rows)


def test_rates_and_markers(spark):
    rows = [(i, f"a\nb{i}\nc") for i in range(400)]
    forms = Counter(x.form for x in infill.fill_in_middle(table(spark, rows), rate=50, spm_rate=20).collect())
    assert 150 < forms["plain"] < 250 and 20 < forms["spm"] < 70
    other = ("[pre]", "[suf]", "[mid]")
    made = infill.fill_in_middle(table(spark, [*rows, (500, "has [suf] in it")]), markers=other)
    made = made.withColumn("again", infill.restored(F.col("output"), F.col("form"), other)).collect()
    assert {x.again for x in made} == {t for _, t in rows} | {"has [suf] in it"} and {x.form for x in made if x.doc_id == 500} == {"plain"}
    with pytest.raises(ValueError):
        infill.fill_in_middle(table(spark, rows), markers=("aba", "<S>", "<M>"))


def test_composition_is_associative():
    """However a text is cut into chunks, their functions compose to the same one, from every state."""
    auto, r = infill.Automaton(), random.Random(8)
    for _ in range(60):
        data = np.array([r.choice(b"ab\n<PSM>\xc3\xa9") for _ in range(r.randint(0, 40))], np.uint8)
        ahead, begun = auto.scan(data)
        cut = sorted(r.randint(0, len(data)) for _ in range(3))
        to, n = np.arange(auto.n_states), np.zeros(auto.n_states, int)
        for part in np.split(data, cut):
            step, more = auto.scan(part)
            n, to = n + more[to], step[to]
        assert (to == ahead).all() and (n == begun).all()
