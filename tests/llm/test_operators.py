"""Each operator against a plain version of itself, on texts that cover the odd cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from holdfast.llm import chat, exact, fmindex, lines, mixing, ngrams, packing, passages, quality, queries, suffix, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "id string, doc_id long, text string, lang string, source string, n_chars long, kept boolean, row int, tie int, size string"


def sha(x) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def texts() -> list[tuple[int | None, str | None, str | None]]:
    """doc_id, text, source: random prose, copies, shared passages, null and empty texts, separators, ties."""
    r = random.Random(5)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7))) for _ in range(400)]
    prose = lambda n: "".join(r.choice(words) + r.choice([" "] * 9 + ["\n", ".\n", "  "]) for _ in range(n))
    passage = prose(60)
    out = [prose(r.randint(1, 300)) for _ in range(30)]
    out += [out[3], out[3].upper(), out[4] + "x", prose(40) + passage + prose(30), passage, prose(5) + passage]
    edited = out[7].split(" ")
    edited[len(edited) // 2] = "changed"
    out += [" ".join(edited), "", None, " \t\n", "one", "é\xa0b\x0bc", "a <|endoftext|> b", "ab " * 300, prose(3000), "\n\nsame line here\nsame line here\n"]
    rows = [(i * 3 % 97, t, [None, "a", "b", "é"][i % 4]) for i, t in enumerate(out)]
    # Rows that repeat an id, with the same text and with another.
    return [*rows, rows[2], (rows[5][0], "another text of the same id " * 12, "a"), (None, out[9], "b")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(f"x{i}", d, t, "en", s, len(t or ""), False, 1, 2, "s") for i, (d, t, s) in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def in_order() -> list[tuple]:
    """Distinct (id, text) rows as the operators order them: null first; ties of an id by Spark's hash."""
    return sorted({(d, t or "") for d, t, _ in texts()}, key=lambda x: -(2**63) if x[0] is None else x[0])


def ids_once(rows):
    """For comparisons that the order of one id's texts could change: leave that id to other checks."""
    twice = {d for d, n in Counter(d for d, _ in in_order()).items() if n > 1}
    return [r for r in rows if r["doc_id"] not in twice]


def earlier_windows(rows):
    seen, want = {}, {}
    for d, t in rows:
        w, gone = WORD.findall(t), set()
        for i in range(len(w) - 19):
            if seen.setdefault(tuple(w[i : i + 20]), (d, i)) != (d, i):
                gone |= set(range(i, i + 20))
        want[d, len(w)] = (len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return want


def some_words(n: int, seed: int = 0) -> str:
    return " ".join(f"w{seed}v{i * i % 211}" for i in range(n))


@pytest.mark.parametrize(
    "rows",
    [[some_words(n)] * 2 for n in (20, 25, 40)] + [[some_words(60)], ["a b " * 500_000], ["a " * 30], [some_words(30), "x " + some_words(30), "", None]],
    ids=["20", "25", "40", "one", "ab", "a", "null"],
)
def test_substring_dedup_of_small_tables(spark, rows):
    """Shards of one short context, or of one very long text."""
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_words): (r.n_removed, r.kept_sha256) for r in fmindex.remove_earlier_windows(docs).collect()}
    assert got == earlier_windows([(d, t or "") for d, t in rows])


@pytest.mark.parametrize("least_hot", [passages.LEAST_HOT, 2])
def test_substring_dedup(docs, none, monkeypatch, least_hot):
    monkeypatch.setattr(passages, "LEAST_HOT", least_hot)
    want = earlier_windows(in_order())
    got = fmindex.remove_earlier_windows(docs).collect()
    assert len(got) == len(texts())
    for r in ids_once(got):
        assert want[r.doc_id, r.n_words] == (r.n_removed, r.kept_sha256)
    assert fmindex.remove_earlier_windows(none).collect() == []


def bytes_removed():
    seen = Counter()
    for _, t in in_order():
        b = t.encode()
        seen.update(b[i : i + 200] for i in range(len(b) - 199))
    for d, t in in_order():
        b = t.encode()
        edge = np.zeros(len(b) + 1, int)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                edge[i] += 1
                edge[i + 200] -= 1
        gone = np.cumsum(edge)[:-1] > 0
        yield d, len(b), int(gone.sum()), int((gone & ~np.append(False, gone[:-1])[: len(b)]).sum()), sha(np.frombuffer(b, np.uint8)[~gone].tobytes())


@pytest.mark.parametrize("least_hot", [passages.LEAST_HOT, 2])
def test_suffix_dedup(docs, none, monkeypatch, least_hot):
    monkeypatch.setattr(passages, "LEAST_HOT", least_hot)
    got = {tuple(r) for r in suffix.remove_repeated_bytes(docs).collect()}
    assert got == set(bytes_removed())
    assert suffix.remove_repeated_bytes(none).collect() == []


@pytest.mark.parametrize("n", range(34))
def test_a_single_short_text_makes_a_block(spark, n):
    from holdfast.llm import textkit

    text = "abcdefghijklmnopqrstuvwxyz0123456789"[:n]
    ((_, block),) = textkit.blocks(pa.RecordBatch.from_pydict({"text": [text]}), "text")
    items = suffix.byte_items(block)
    assert len(items.grams) == n and not items.chosen.any()


def test_suffix_dedup_of_one_row(spark):
    for n in (0, 1, 3, 5, 7, 9, 15, 16, 33):
        one = spark.createDataFrame([(n, "x" * n)], "doc_id long, text string")
        assert [tuple(r) for r in suffix.remove_repeated_bytes(one).collect()] == [(n, n, 0, 0, sha("x" * n))]


def similar_lines():
    earlier, want = [], {}
    for d, t in in_order():
        gone = set()
        for i, line in enumerate(t.split("\n")):
            s = frozenset(WORD.findall(line))
            if s:
                if any(len(s & x) >= 0.8 * len(s | x) for x in earlier):
                    gone.add(i)
                earlier.append(s)
        kept = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
        want[d, len(t.split("\n"))] = (len(gone), sha(kept))
    return want


@pytest.mark.parametrize("bounds", [{}, {"most": 40, "verified_words": 30}, {"most": 8, "verified_words": 200}])
def test_line_dedup(docs, none, bounds):
    """Also with so little room that frequent words and large components are dealt to blocks."""
    got = lines.remove_similar_lines(docs, **bounds).collect()
    assert len(got) == len(texts())
    want = similar_lines()
    for r in ids_once(got):
        assert want[r.doc_id, r.n_lines] == (r.n_removed, r.kept_sha256)
    assert lines.remove_similar_lines(none, **bounds).collect() == []


def lines_gone(rows: list[tuple[int, str]], similarity: float) -> dict[int, int]:
    seen, gone = [], {}
    for d, text in sorted(rows):
        gone[d] = 0
        for line in text.split("\n"):
            s = frozenset(WORD.findall(line))
            if s:
                gone[d] += any(len(s & x) >= similarity * len(s | x) - 1e-9 for x in seen)
                seen.append(s)
    return gone


@pytest.mark.parametrize("similarity", [0.6, 0.7, 0.8, 0.9])
def test_line_dedup_at_other_similarities(spark, similarity):
    """Lines of which k words are another line's: Jaccard similarities of 9/11, 8/12 and 7/13, 7/9 and 6/8."""
    text = "\n".join(" ".join([f"g{g}w{i}" for i in range(10)][:k] + [f"g{g}k{k}n{i}" for i in range(10 - k)]) for g in range(6) for k in (10, 9, 8, 7))
    more = "\n".join(" ".join([f"h{g}w{i}" for i in range(8)][: 8 - k]) for g in range(3) for k in (0, 1, 2, 3))
    rows = [(1, text), (2, "quite another line"), (3, more)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in lines.remove_similar_lines(docs, similarity=similarity).collect()}
    assert got == lines_gone(rows, similarity)


def test_line_dedup_of_long_lines(spark):
    """Lines of 40 to 400 words with so many words changed that they are just similar or just not; sketches of both widths meet."""
    r, rows = random.Random(21), []
    for g in range(40):
        n = r.choice([40, 60, 63, 64, 66, 75, 120, 250, 400])
        line = [f"l{g}w{i}" if i % 3 else f"c{i}" for i in range(n)]
        rows.append(" ".join(line))
        for k in range(4):
            changed = round(n / 9) + r.randint(-2, 2) if k < 2 else 0
            cut = 0 if k < 2 else round(n / 5) + r.randint(-1, 1)
            other = line[: n - cut]
            for i in r.sample(range(len(other)), changed):
                other[i] = f"own{g}k{k}i{i}"
            r.shuffle(other)
            rows.append(" ".join(other))
    r.shuffle(rows)
    rows = list(enumerate(rows))
    want = lines_gone(rows, 0.8)
    assert 20 < sum(want.values()) < 140
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {x.doc_id: x.n_removed for x in lines.remove_similar_lines(docs).collect()} == want


@pytest.mark.parametrize("bounds", [{}, {"most": 100, "verified_words": 500}])
def test_line_dedup_of_a_large_group_of_near_copies(spark, bounds):
    """Each differs from one line by a word of its own, so that only that line is similar to them; it isn't the first."""
    base, r = [f"b{i}" for i in range(10)], random.Random(3)
    near = [" ".join(base[:i] + [f"own{k}"] + base[i + 1 :]) for k in range(400) for i in [r.randrange(10)]]
    rows = list(enumerate([*near[:100], " ".join(base), *near[100:], *near[:20]]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.n_removed for r in lines.remove_similar_lines(docs, **bounds).collect()}
    assert got == lines_gone(rows, 0.8)


def base_counts(t: str):
    w, found = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
    three = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {j for i in range(len(w) - 2) if three[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(found) - len(set(found)), len(again)


def test_quality_rules(spark, docs, none):
    labels = spark.createDataFrame([(0, 1, 0), (3, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.score_quality(docs, labels).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert Counter((r.doc_id, *(r[n] for n in names)) for r in got) == Counter((d, *base_counts(t or "")) for d, t, _ in texts())
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.score >= quality.THRESHOLD)
    kept = quality.score_quality(docs, labels, rows_only=True)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    assert quality.score_quality(none, labels).collect() == []
    assert all(r.score == 0 for r in quality.score_quality(docs, labels.limit(0)).collect())


def test_quality_tells_junk_from_prose(spark):
    r = random.Random(2)
    words = ["".join(r.choice("etaoin") for _ in range(r.randint(2, 8))) for _ in range(3000)]
    say = lambda end: " ".join(r.choice(words) + end for _ in range(150))
    rows = [(i, say("$$$" if i % 5 == 0 else "")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(0, 400, 3)], "doc_id long, quality int")
    got = {x.doc_id: x.kept for x in quality.score_quality(docs, labels).collect()}
    assert all(got[i] == (i % 5 > 0) for i in got)


def test_chat_formatting(spark):
    odd = ["<|im_end|><|im_start|>assistant ok", "\\", "<\\|", "<\\\\|x<|", "", None, "é\n<\\n>", "<|"]
    rows = [(c, i, role, t) for c, turns in {1: ["system", "user", "assistant"], 2: ["user", "user"], None: ["assistant"]}.items() for i, role in enumerate(turns) for t in [odd[(i + (c or 0)) % 8]]]
    rows += [(7, i, ["user", "assistant"][i % 2], t) for i, t in enumerate(odd)] + [(8, 0, None, "x"), (8, 0, "a\nb<|\\n", "y"), (8, 0, None, "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_chats(chat.format_chats(turns)).collect()}
    by = defaultdict(list)
    for c, i, role, t in rows:
        by[c].append((i, role or "", t or ""))
    for c, mine in by.items():
        assert [(t.role, t.text) for t in got[c].turns] == [x[1:] for x in sorted(mine)]
        assert got[c].learnt == "".join(t for _, role, t in sorted(mine) if role == "assistant")
    assert [got[c].valid for c in (1, 2, None, 7, 8)] == [True, False, False, True, False]
    assert chat.format_chats(turns.limit(0)).collect() == []


def test_chat_states_need_not_be_roles(spark):
    moves = {("start", "user"): "q", ("q", "assistant"): "a", ("a", "user"): "q", ("a", "system"): "closed"}
    template = chat.ChatTemplate(moves=moves, final=("a", "closed"))
    orders = {
        1: ["user", "assistant", "user", "assistant"], 2: ["user", "assistant", "system"], 3: ["user", "assistant", "system", "user"],
        4: ["user"], 5: ["assistant"], 6: ["user", "user", "assistant"], 7: ["user", "assistant", "tool"],
    }
    rows = [(c, i, r, "t", -1, "p", 0, "s", [1], True) for c, roles in orders.items() for i, r in enumerate(roles)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, at long, part string, begin int, segment string, parts array<int>, allowed boolean")
    want = {}
    for c, roles in orders.items():
        state = "start"
        for r in roles:
            state = moves.get((state, r))
        want[c] = state in template.final
    chats = chat.format_chats(turns, template)
    assert {r.conv_id: r.valid for r in chats.collect()} == want
    for r in chat.read_chats(chats, template).collect():
        assert [t.role for t in r.turns] == orders[r.conv_id] and r.learnt == "t" * orders[r.conv_id].count("assistant")
    for r in chats.collect():
        assert [r.formatted[s.start : s.start + s.length] for s in r.loss_spans] == ["t"] * orders[r.conv_id].count("assistant")


def encoded():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary())
    return [(d, np.array(t.encode(x or "", add_special_tokens=False).ids, np.uint32)) for d, x, _ in texts()]


def crc(ids) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


def test_packing(docs, none):
    rows = packing.pack_documents(docs, queries.vocabulary()).collect()
    by, seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        seq[r.sequence_id].append(r)
    for pieces in seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= 1024
    want = Counter((d, crc(np.append(x, 0)[: len(x) + 1]), len(x) + 1) for d, x in encoded() if len(x) < 1024)
    whole = Counter((r.doc_id, r.ids_crc32, r.doc_tokens) for r in rows if r.start == 0 and r.length == r.doc_tokens)
    assert not whole - want
    assert sum(r.length for r in rows) == sum(len(x) + 1 for _, x in encoded())
    for d, x in encoded():
        if sum(d == e for e, _ in encoded()) == 1:
            at, ids = 0, np.append(x, 0)
            for p in sorted(by[d], key=lambda p: p.start):
                assert (p.start, p.ids_crc32, p.doc_tokens) == (at, crc(ids[at : at + p.length]), len(ids))
                at += p.length
            assert at == len(ids)
    assert packing.pack_documents(none, queries.vocabulary()).collect() == []


def test_packing_plan_uses_no_more_than_there_is():
    r = np.random.default_rng(1)
    for h in (r.integers(0, 50, 129), np.eye(129, dtype=int)[80] * 1000, np.zeros(129, int), np.full(129, 10**9)):
        h = h.copy()
        h[0] = 0
        left = h.astype(np.int64).copy()
        for way, n in packing.plan_sequences(h):
            assert sum(way) <= 128 and n > 0
            for part in way:
                left[part] -= n
        assert (left >= 0).all()


def test_least_squares_beats_random_points():
    r = np.random.default_rng(3)
    a, b = r.random((12, 20)), r.random(12)
    x = packing.least_squares(a, b)
    error = lambda y: ((a @ y - b) ** 2).sum()
    assert (x >= 0).all() and all(error(y) >= error(x) - 1e-9 for y in np.abs(x + r.normal(0, 0.1, (200, 20))))


@pytest.mark.parametrize("chunks", [(1024, 4096), (4, 16)])
def test_exact_dedup(docs, none, chunks):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    groups = defaultdict(list)
    for d, t, _ in texts():
        groups[lower(t)].append(d)
    got = exact.exact_duplicates(docs, least=chunks[0], most=chunks[1]).collect()
    best = {t: max(ids, key=lambda d: -(2**63) if d is None else d) for t, ids in groups.items()}
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == Counter((d, best[t], len(ids), sha(t)) for t, ids in groups.items() for d in ids)
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(map(sha, groups))
    assert exact.exact_duplicates(none).collect() == []
    left = exact.without_copies(docs)
    assert left.columns == docs.columns and sorted(lower(r.text) for r in left.collect()) == sorted(groups)


def test_chunk_clashes_are_told_apart(docs, monkeypatch):
    """With a hash of one value for all, chunks are still not mistaken for each other."""
    from pyspark.sql import functions as F

    want = Counter(tuple(r) for r in exact.exact_duplicates(docs).drop("kept").collect())
    real = F.xxhash64
    monkeypatch.setattr(F, "xxhash64", lambda *c: real(*c) * 0 + F.lit(7))
    assert Counter(tuple(r) for r in exact.exact_duplicates(docs, least=4, most=16).drop("kept").collect()) == want


def test_token_files(docs, none):
    got = tokens.token_files(docs, queries.vocabulary(), end_id=2).collect()
    low = lambda d: -(2**63) if d is None else d
    assert [low(r.doc_id) for r in sorted(got, key=lambda r: r.start)] == sorted(low(d) for d, _, _ in texts())
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((d, len(x) + 1, crc(np.append(x, 2))) for d, x in encoded())
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert tokens.token_files(none, queries.vocabulary(), end_id=2).collect() == []


def test_token_file_reads_only_what_is_asked():
    import io

    out, r = io.BytesIO(), np.random.default_rng(0)
    docs = [(d, r.integers(0, 50_000, 30_000).astype(np.uint32)) for d in range(10)]
    writer = tokens.Writer(out, 2)
    for d, x in docs:
        writer.add(d, x)
    writer.close()
    reader = tokens.Reader(io.BytesIO(out.getvalue()))
    opened, frame = [], reader.frame
    reader.frame = lambda i: opened.append(i) or frame(i)
    ((d, ids),) = reader.documents([4])
    assert d == 4 and (ids == docs[4][1]).all() and len(opened) == 1 < len(reader.first)
    broken = bytearray(out.getvalue())
    broken[40] ^= 1
    with pytest.raises(Exception):  # noqa: B017
        list(tokens.Reader(io.BytesIO(bytes(broken))))


@pytest.mark.parametrize("members", [ngrams.MEMBERS, 2])
def test_ngram_jaccard(docs, none, members):
    low = lambda d: -(2**63) if d is None else d
    words = [(low(d), tuple(WORD.findall(t or ""))) for d, t, _ in texts()]
    rep, copies = {}, Counter(w for _, w in words)
    for d, w in sorted(words):
        rep.setdefault(w, d)
    sets = {w: {w[i : i + 5] for i in range(max(1, len(w) - 4))} if w else set() for w in rep}
    near = {w: [v for v in rep if v != w and sets[w] and len(sets[w] & sets[v]) >= 0.8 * len(sets[w] | sets[v])] for w in rep}
    class_of = {}
    for w in rep:
        reach, todo = {w}, [w]
        while todo:
            new = [v for v in near[todo.pop()] if v not in reach]
            reach |= set(new)
            todo += new
        class_of[w] = min(rep[v] for v in reach)
    want = Counter((d, rep[w], copies[w], class_of[w], len(near[w])) for d, w in words)
    got = ngrams.near_duplicates(docs, members=members).collect()
    assert any(near.values())
    assert Counter((low(r.doc_id), low(r.rep_id), r.n_copies, low(r.class_id), r.n_links) for r in got) == want
    assert sum(r.first for r in got) >= len(set(class_of.values()))
    assert ngrams.near_duplicates(none).collect() == []


@pytest.mark.parametrize("few", [0, 5, 10_000])
def test_components(spark, few):
    r = random.Random(4)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000)]
    root = {n: n for p in pairs for n in p}
    for _ in range(50):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    edges = spark.createDataFrame([(min(p), max(p)) for p in pairs], "a long, b long").distinct()
    assert {x.node: x.label for x in ngrams.components(edges, few).collect()} == root


def test_recall_of_planted_pairs(spark):
    """Pairs whose similarity is between 0.8 and 0.86; at least 0.9 of them are to be linked, and no others."""
    r, rows, want = random.Random(8), [], 0
    for i in range(600):
        w = [f"x{r.randrange(10**9)}" for _ in range(200)]
        at = r.randrange(20, 180)
        k = r.randrange(12, 18)
        v = w[:at] + [f"y{r.randrange(10**9)}" for _ in range(k)] + w[at + k :]
        a, b = ({tuple(x[j : j + 5]) for j in range(196)} for x in (w, v))
        assert 0.8 <= len(a & b) / len(a | b) < 0.86
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
    got = ngrams.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    linked = {r.doc_id for r in got if r.n_links}
    assert all(r.n_links <= 1 and r.class_id in (r.doc_id, r.doc_id ^ 1) for r in got)
    print("recall", len(linked) / len(rows))
    assert len(linked) >= 0.9 * len(rows)


def test_bands_reach_the_recall():
    b, r = ngrams.choose_bands(0.8, 0.995, 128)
    assert b * r <= 128 and 1 - (1 - 0.8**r) ** b >= 0.995


def targets(sizes: dict, most: int = 3) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return share | {s: most * sizes[s] for s in capped}
        capped |= over


def test_mixing(docs, none):
    size, own = defaultdict(int), Counter()
    for d, t, s in texts():
        size[s] += len(WORD.findall(t or ""))
        own[d, len(WORD.findall(t or "")), s] += 1
    got = mixing.mix_sources(docs).collect()
    want = targets(size)
    assert Counter((r.doc_id, r["size"], r.source) for r in got) == own
    taken = Counter()
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 3 * r["size"] and (r.position is None) == (r.taken == 0)
        assert r.position == (r.positions[0] if r.positions else None) and len(r.positions) == -(-r.taken // max(1, r["size"]))
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in size)
    times = [r.position for r in got if r.position is not None]
    assert times == sorted(times) and -1e-9 <= times[0] and times[-1] <= 1
    assert sorted(map(str, mixing.mix_sources(docs).collect())) == sorted(map(str, got))
    assert mixing.mix_sources(none).collect() == []


def test_positions_against_a_plain_inversion(spark):
    """Words of a source before a document, found again as the integral of its weights up to the position; and the joint stream is even."""
    r = random.Random(6)
    rows = [(i, "w " * r.randrange(0, 40), "abc"[min(2, i % 7)] if i % 11 else None) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = mixing.mix_sources(docs).collect()
    target = {x.source: x.target for x in got}
    total = sum(target.values())
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(target, key=lambda s: (s is None, s or "")))}
    lean = {s: 1 - 2 * (w - 1) / 4 for s, w in weight.items()}
    mean = sum(lean[s] * target[s] for s in target) / total
    lean = {s: x - mean for s, x in lean.items()}
    slope = {s: 0.8 * x / max(1, max(map(abs, lean.values()))) for s, x in lean.items()}

    def demand(s, t):
        steps = 400
        return sum(target[s] * (1 + slope[s] * (2 * (k + 0.5) * t / steps - 1)) * t / steps for k in range(steps))

    assert all(abs(sum(demand(s, t) for s in target) - total * t) < 1e-6 * total for t in (0.1, 0.5, 0.9))
    passes = 0
    for s in target:
        mine = [x for x in got if x.source == s and x["size"]]
        size = {x.doc_id: x["size"] for x in mine}
        stream = sorted((t, x.doc_id) for x in mine for t in x.positions)
        passes = max(passes, max(len(x.positions) for x in mine))
        done = 0
        for t, d in stream:
            assert abs(demand(s, t) - done) < 1e-6 * total
            done += size[d]
        assert target[s] - 1 <= done < target[s] + 40
        # Each pass goes through the documents in the same order.
        order = [d for _, d in stream]
        assert all(order[i] == order[i % len(mine)] for i in range(len(order)))
    assert passes > 1


def test_packing_leaves_little_padding(spark):
    """Less than two in a hundred ids are padding, but for the last sequence."""
    r = random.Random(9)
    rows = [(i, " ".join(r.choice(["one", "house", "of", "blue"]) for _ in range(int(r.lognormvariate(5, 1))))) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    used = Counter()
    for p in packing.pack_documents(docs, queries.vocabulary()).collect():
        used[p.sequence_id] += p.length
    padded = sum(1024 for _ in used)
    print("padding", 1 - sum(used.values()) / padded)
    assert sum(used.values()) >= 0.98 * (padded - 1024)


def test_ratios_and_verdicts_against_plain_counts(spark):
    """Every n-gram is counted as a string here; only its bucket is asked of the operator, one n-gram at a time."""
    r = random.Random(12)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(60)]
    rows = [(i, " ".join(r.choice(words[: 60 if i % 2 else 25]) for _ in range(r.randint(45, 90)))) for i in range(60)] + [(60, None), (61, "")]
    labels = [(i, int(i % 4 == 1)) for i in range(0, 40)]
    got = quality.score_quality(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()

    def bucket(gram, kind):
        from holdfast.llm.textkit import texts_of

        texts = texts_of(pa.array([gram]))
        texts.words()
        return int(quality.ngrams(texts, texts.word_hashes())[0][{"word": 0, "pair": 2, "end": -1}[kind]])

    known = {}

    def grams(text):
        w = WORD.findall(text or "")
        out = [(x, "word") for x in w] + [(f"{a} {b}", "pair") for a, b in zip(w, w[1:])] + [(x, "end") for x in w]
        return [known.setdefault(g, bucket(*g)) if g not in known else known[g] for g in out]

    good = {d for d, q in labels if q}
    raw, trusted = Counter(), Counter()
    for d, t in rows:
        raw.update(grams(t))
        trusted.update(grams(t) if d in good else ())
    share = sum(trusted.values()) / sum(raw.values())
    log_ratio = lambda b: np.log((trusted[b] + quality.SMOOTHING) / (share * raw[b] + quality.SMOOTHING))
    text = dict(rows)
    for x in got:
        own = grams(text[x.doc_id])
        score = sum(map(log_ratio, own)) / len(own) if own else 0.0
        assert abs(score - x.score) < 1e-9
        n, _, _, _, again = base_counts(text[x.doc_id] or "")
        assert x.kept == (n >= 50 and 100 * again <= 50 * n and score >= quality.THRESHOLD)
    assert len({x.kept for x in got if x.n_words >= 50}) >= 1


@pytest.fixture(scope="module")
def long_docs(spark):
    """Texts of megabytes: one word, one line of many words, many equal lines; and none at all."""
    rows = [(1, "x" * 3_000_000, "a"), (2, "a b " * 400_000, "a"), (3, "the same line\n" * 100_000, None), (4, None, "b"), (5, "", "b"), (6, "x" * 3_000_000, "b")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


LONG = {
    "op1": (fmindex.remove_earlier_windows, lambda d: {r.doc_id: r.n_removed for r in d}, {1: 0, 2: 799_998, 3: 299_997, 4: 0, 5: 0, 6: 0}),
    "op2": (suffix.remove_repeated_bytes, lambda d: {r.doc_id: r.n_removed for r in d}, {1: 3_000_000, 2: 1_600_000, 3: 1_400_000, 4: 0, 5: 0, 6: 3_000_000}),
    "op3": (lines.remove_similar_lines, lambda d: {r.doc_id: r.n_removed for r in d}, {1: 0, 2: 0, 3: 99_999, 4: 0, 5: 0, 6: 1}),
    "op7": (exact.exact_duplicates, lambda d: {r.doc_id: r.keep_id for r in d}, {1: 6, 2: 2, 3: 3, 4: 5, 5: 5, 6: 6}),
    "op9": (ngrams.near_duplicates, lambda d: {r.doc_id: r.class_id for r in d}, {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 1}),
    "op10": (mixing.mix_sources, lambda d: {r.doc_id: r["size"] for r in d}, {1: 1, 2: 800_000, 3: 300_000, 4: 0, 5: 0, 6: 1}),
}


@pytest.mark.parametrize("name", LONG)
def test_very_long_texts(long_docs, name):
    operator, read, want = LONG[name]
    assert read(operator(long_docs).collect()) == want


def test_very_long_texts_as_tokens(long_docs):
    from tokenizers import Tokenizer

    few = long_docs.where("doc_id > 1 and doc_id < 6")
    t = Tokenizer.from_file(queries.vocabulary())
    n = {r.doc_id: len(t.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in few.collect()}
    assert {r.doc_id: r.n_tokens for r in tokens.token_files(few, queries.vocabulary(), end_id=2).collect()} == n
    got = Counter()
    for r in packing.pack_documents(few, queries.vocabulary()).collect():
        got[r.doc_id] += r.length
    assert got == n
