"""What hashes could take for equal, columns named as the operators name theirs, the lowest id, and very long texts."""

import random
from collections import Counter

import pytest

import corpus_pipeline as pipeline
from holdfast.llm import chat, exact, fmindex, lines, ngrams, packing, quality, queries, tokens

LOWEST = -(2**63)


def morse(n: int) -> str:
    """The Thue-Morse sequence of a and b: polynomials modulo powers of two take it for its complement."""
    return "".join("ab"[i.bit_count() % 2] for i in range(n))


def complement(text: str) -> str:
    return text.translate(str.maketrans("ab", "ba"))


def documents(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def removed(spark, texts) -> list[int]:
    return [r.n_removed for r in sorted(lines.remove_similar_lines(documents(spark, texts)).collect(), key=lambda r: r.doc_id)]


def test_unlike_words_are_not_one_in_lines(spark):
    """Words whose shorter hashes once were equal; as lines of one, with others, and in one document."""
    assert removed(spark, ["0746978", "2257442", "0746978 a b", "2257442 a b", "0661134\n1496632\n0806573\n5034430"]) == [0] * 5
    assert removed(spark, [morse(1024), complement(morse(1024)), " ".join(morse(1024)[:200]), "one", "one"]) == [0, 0, 0, 0, 1]


def test_many_numbers_as_lines(spark):
    rows = ["\n".join(f"{i:07d}" for i in range(k, 300_000, 4)) for k in range(4)]
    assert removed(spark, rows) == [0] * 4


def test_sequences_that_a_polynomial_takes_for_equal(spark):
    one, other = morse(1024), complement(morse(1024))
    rest = " ".join(f"w{i}" for i in range(19))
    near = {r.doc_id: (r.n_copies, r.n_links) for r in ngrams.near_duplicates(documents(spark, [f"{one} a b c d e f", f"{other} a b c d e f", " ".join(one), " ".join(other)])).collect()}
    assert [near[i][0] for i in range(4)] == [1, 1, 1, 1]
    found = {r.doc_id: r.n_removed for r in fmindex.remove_earlier_windows(documents(spark, [f"{one} {rest}", f"{other} {rest}"])).collect()}
    assert found == {0: 0, 1: 0}
    labels = spark.createDataFrame([(0, 1)], "doc_id long, quality int")
    scored = quality.score_quality(documents(spark, [f"{one}\n{other}\n{one}", None]), labels).collect()
    assert {r.doc_id: r.n_dup_lines for r in scored} == {0: 1, 1: 0}


CLASHING = ["_text_", "whole", "__sha", "sha", "__id", "id", "__key", "__n", "n", "__row", "row_number", "__position", "position", "_x"]


def clashing(spark, rows):
    """Documents with columns of these names, each with a value of its own."""
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(*r, *(f"{c}{i}" for c in CLASHING)) for i, r in enumerate(rows)], schema)


def prose(seed: int, n: int = 120) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(500)}" for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A folder with documents, labels and no more: null and repeated ids, copies, near copies, junk."""
    path = str(tmp_path_factory.mktemp("sf"))
    texts = [prose(i, 60 + 7 * i) for i in range(12)]
    near = texts[3].split()
    rows = [(i, t, "ab"[i % 2]) for i, t in enumerate(texts)]
    rows += [(20, texts[0], "a"), (21, texts[1].upper(), None), (22, " ".join(["new", *near[1:]]), "b"), (None, prose(50), "a"), (None, prose(51, 90), None), (3, prose(52), "b")]
    rows += [(30, "$$$ " * 80, "a"), (31, "same words " * 60, "a"), (32, "short", "b"), (33, None, "a"), (34, "", None), (20, texts[0], "a")]
    clashing(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(8)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows


def test_each_stage_keeps_columns_whatever_their_names(spark, folder):
    path, rows = folder
    docs = clashing(spark, rows)
    known = {tuple(r) for r in docs.collect()}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns, name
        got = [tuple(r) for r in out.collect()]
        assert got and set(got) <= known, name
        assert stage(spark, docs.limit(0), path).collect() == [], name


def test_pipeline_against_its_plain_stages(spark, folder):
    """All five stages: rows that stay are found plainly; the mix and the packing by what they promise."""
    path, rows = folder
    labels = spark.read.parquet(f"{path}/labels.parquet")
    # Quality: the base rules plainly, and the verdicts, which have a plain version elsewhere.
    scored = {(r.doc_id, r.n_words, r.word_chars): r.kept for r in quality.score_quality(clashing(spark, rows), labels).collect()}
    size = lambda t: (len((t or "").split()), len("".join((t or "").split())))
    good = [r for r in rows if len((r[1] or "").split()) >= 50 and scored[(r[0], *size(r[1]))]]
    assert not any(r[0] in (31, 32, 33, 34) for r in good)
    # Exact copies: the largest id of each stays.
    low = lambda d: LOWEST if d is None else d
    best: dict[str, tuple] = {}
    for r in good:
        key = r[1].lower()
        if key not in best or low(r[0]) > low(best[key][0]):
            best[key] = r
    # Near copies: the least id of each stays.
    grams = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    single: list[tuple] = []
    for r in sorted(best.values(), key=lambda r: low(r[0])):
        if not any(len(grams(r[1]) & grams(x[1])) >= 0.8 * len(grams(r[1]) | grams(x[1])) for x in single):
            single.append(r)
    assert 8 < len(single) < len(good)
    # The mix: each source's words come near its target, and no document comes more than three times.
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary())
    n_tokens = {r[1]: len(t.encode(r[1], add_special_tokens=False).ids) + 1 for r in single}
    out = pipeline.run(spark, path).collect()
    used, whole, sequences = Counter(), Counter(), Counter()
    for p in out:
        used[p.doc_id, p.doc_tokens] += p.length
        whole[p.doc_id, p.doc_tokens] += p.start == 0
        sequences[p.sequence_id] += p.length
        assert p.offset + p.length <= 1024
    assert max(sequences.values()) <= 1024
    assert all(used[k] == whole[k] * k[1] for k in used)
    want = {(r[0], n_tokens[r[1]]): r for r in single}
    assert set(whole) <= set(want) and max(whole.values()) <= 3
    taken = Counter()
    for k, n in whole.items():
        taken[want[k][2]] += n * len(want[k][1].split())
    sizes = Counter()
    for r in single:
        sizes[r[2]] += len(r[1].split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target, left, open_ = {}, float(sum(sizes.values())), {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    while True:
        share = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            del open_[s]
    longest = max(len(r[1].split()) for r in single)
    assert all(target[s] - 1 <= taken[s] < target[s] + longest for s in order)


def test_the_lowest_id_is_no_null(spark):
    rows = [(LOWEST, prose(1)), (None, prose(1)), (5, prose(1)), (LOWEST, prose(2)), (None, prose(3)), (7, prose(3)), (LOWEST, "x"), (None, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    read = tokens.token_files(docs, queries.vocabulary(), end_id=2).collect()
    assert Counter(r.doc_id for r in read) == Counter(d for d, _ in rows)
    ordered = [r.doc_id for r in sorted(read, key=lambda r: r.start)]
    assert ordered == [None] * 3 + [LOWEST] * 3 + [5, 7]
    near = {(r.doc_id, r.rep_id, r.class_id) for r in ngrams.near_duplicates(docs).collect()}
    assert (LOWEST, LOWEST, LOWEST) in near and (5, None, None) in near and (7, None, None) in near
    assert (LOWEST, None, None) in near  # it has a copy without an id, which comes first
    two = spark.createDataFrame([(LOWEST, prose(8) + "\n" + prose(9)), (None, prose(9) + "\n" + prose(9))], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in lines.remove_similar_lines(two).collect()} == {None: 1, LOWEST: 1}
    kept = exact.exact_duplicates(docs).collect()
    assert Counter((r.doc_id, r.keep_id) for r in kept)[(None, 5)] == 1


def test_megabytes_through_quality_chat_and_tokens(spark):
    rows = [(1, "x" * 3_000_000), (2, "a b " * 400_000), (3, "the same line\n" * 100_000), (4, None), (5, "")]
    labels = spark.createDataFrame([(2, 1)], "doc_id long, quality int")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) for r in quality.score_quality(documents(spark, []).unionByName(spark.createDataFrame(rows, "doc_id long, text string")), labels).collect()}
    assert got == {1: (1, 3_000_000, 0, 0), 2: (800_000, 800_000, 0, 800_000), 3: (300_000, 1_100_000, 99_999, 300_000), 4: (0, 0, 0, 0), 5: (0, 0, 0, 0)}
    turns = spark.createDataFrame([(c, i, ["user", "assistant"][i], t) for c, t in rows for i in (0, 1)], "conv_id long, turn long, role string, text string")
    for r in chat.read_chats(chat.format_chats(turns)).collect():
        text = dict(rows)[r.conv_id] or ""
        assert [x["text"] for x in r.turns] == [text, text] and r.learnt == text
    word = documents(spark, ["x" * 3_000_000])
    n = tokens.token_files(word, queries.vocabulary(), end_id=2).first().n_tokens
    assert sum(r.length for r in packing.pack_documents(word, queries.vocabulary()).collect()) == n
