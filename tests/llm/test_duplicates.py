import hashlib
import random
import string
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from pagewright.llm import exact_dedup, line_dedup, near_dedup, repeats

WORDS = [f"w{i}" for i in range(400)]


def prose(r, n):
    return " ".join(r.choices(WORDS, k=n))


def test_exact(docs):
    rows = [(1, "a"), (2, "a"), (3, "b"), (4, None), (5, ""), (6, "c"), (6, "c"), (None, "a"), (7, "x" * 300 + "1"), (8, "x" * 300 + "2"), (9, "x" * 300 + "1")]
    got = sorted(((r["doc_id"] if r["doc_id"] is not None else -1, r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_duplicates(docs(rows)).collect()))
    assert got == sorted(
        [(1, 2, 3, False), (2, 2, 3, True), (-1, 2, 3, False), (3, 3, 1, True), (4, 5, 2, False), (5, 5, 2, True), (6, 6, 2, False), (6, 6, 2, True), (7, 9, 2, False), (8, 8, 1, True), (9, 9, 2, True)]
    )
    lazy = exact_dedup.exact_duplicates(docs(rows), with_sha=False)
    assert lazy.where("kept").count() == 6 and lazy.where("text_sha256 is null").count() > 0
    assert exact_dedup.exact_duplicates(docs([])).count() == 0
    assert sorted(r["doc_id"] for r in exact_dedup.drop_exact_duplicates(docs(rows)).collect()) == [2, 3, 5, 6, 8, 9]


def brute_components(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = [x for x in __import__("re").split(rb"[\x20\x09-\x0d]+", (t or "").encode().lower()) if x]
        n = min(width, len(w))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for a in keys:
        for b in keys:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in keys}, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize("width", [2, 5])
def test_near_against_brute_force(docs, width):
    r = random.Random(width)
    rows = [(i, prose(r, r.randint(1, 120))) for i in range(60)]
    base = prose(r, 150).split()
    for i in range(100, 160):  # a star: copies near to the base, less so to each other
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = r.choice(WORDS)
        rows.append((i, " ".join(w)))
    rows += [(200 + i, rows[3][1].upper() if i else rows[3][1]) for i in range(4)] + [(300, ""), (301, None), (302, " \n"), (303, "One"), (304, "one")]
    want, size = brute_components(rows, width, 80)
    got = {x["doc_id"]: x for x in near_dedup.near_duplicates(docs(rows), width, 80).collect()}
    assert {i: x["component_id"] for i, x in got.items()} == want
    assert {i: x["n_shingles"] for i, x in got.items()} == size
    assert all(x["kept"] == (i == want[i]) for i, x in got.items())


def test_near_pairs_in_a_family_just_below_the_threshold(docs):
    r = random.Random(8)
    base, rows = [f"b{k}" for k in range(2000)], []
    spots = range(6, 2000, 12)  # words that differ from member to member, five forms of each
    for i in range(600):  # members at about 0.77 to each other
        w = list(base)
        for k in spots:
            w[k] = f"m{k}_{r.randrange(5)}"
        rows.append((i, " ".join(w)))
    for i in range(60):  # each of these is linked with one member
        w = rows[10 * i][1].split()
        for k in r.sample(spots, 105):
            w[k] = f"m{k}_{(int(w[k][-1]) + r.randrange(1, 5)) % 5}"
        rows.append((2000 + i, " ".join(w)))
    sets = {i: set(zip(t.split(), t.split()[1:], strict=False)) for i, t in rows}
    near = [(i, 10 * (i - 2000)) for i in range(2000, 2060)]
    assert all(100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for a, b in near)
    got = {x["doc_id"]: x["component_id"] for x in near_dedup.near_duplicates(docs(rows), 2, 80).collect()}
    assert [a for a, b in near if got[a] != got[b]] == []


def test_linked_both_ways_of_counting():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 60, 50)) for _ in range(30)]
    left, right = np.triu_indices(30, 1)
    want = [100 * len(np.intersect1d(sets[i], sets[j])) >= 40 * len(np.union1d(sets[i], sets[j])) for i, j in zip(left, right, strict=True)]
    assert near_dedup.linked(sets, left, right, 40).tolist() == want and any(want) and not all(want)
    assert near_dedup.linked(sets, left[:9], right[:9], 40).tolist() == want[:9]


def test_near_edges(docs):
    assert near_dedup.near_duplicates(docs([])).count() == 0
    rows = [(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, "z")]
    got = near_dedup.near_duplicates(docs(rows), 2)
    assert sorted((str(x["doc_id"]), str(x["component_id"]), x["kept"]) for x in got.collect()) == [("1", "1", True), ("1", "1", True), ("None", "1", False), ("None", "None", True)]
    assert sorted(str(x["doc_id"]) for x in near_dedup.drop_near_duplicates(docs(rows), 2).collect()) == ["1", "None"]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001)], "a long, b long")
    got = {r["node"]: r["root"] for r in near_dedup.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {1001: 1000}


def test_merged_transforms_against_counting():
    r = random.Random(3)
    for trial in range(60):
        parts, total = [], Counter()
        for _ in range(r.randint(1, 5)):
            own = Counter("".join(r.choices("ab" if trial % 2 else "abcd", k=r.randint(1, 6))) for _ in range(r.randint(1, 12)))
            names = list(own)
            flat = np.array([x for n in names for x in [*map(ord, n), 0]], np.uint64)
            size = np.array([len(n) + 1 for n in names])
            out, order = repeats.transform(flat, size)
            names = [names[i] for i in order]
            assert names == sorted(names)
            key = np.array([int.from_bytes(n.encode(), "big") for n in names], np.uint64)
            parts.append((out, key, np.array([own[n] for n in names], np.int32), np.array([len(n) + 1 for n in names], np.int32)))
            total += own
        got = set(repeats.repeated_strings(parts).tolist())
        assert got == {int.from_bytes(n.encode(), "big") for n, c in total.items() if c > 1}


def test_common_prefixes_of_a_merge():
    flat = lambda *s: (np.array([x for n in s for x in [*map(ord, n), 0]], np.uint64), np.array([len(n) + 1 for n in s]))
    a, b = repeats.transform(*flat("banana"))[0], repeats.transform(*flat("ananas"))[0]
    _, common, _ = repeats.merge_transforms([a, b])
    suffixes = sorted([s[i:] + "\0" for s in ("banana", "ananas") for i in range(7)])
    for k in range(1, len(suffixes)):
        x, y = suffixes[k - 1], suffixes[k]
        n = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), None)
        assert common[k] == n if n is not None else common[k] > 10


def brute_repeats(rows, length):
    raw = {i: (t or "").encode() for i, t in rows}
    count = Counter(b[k : k + length] for b in raw.values() for k in range(len(b) - length + 1))
    out = {}
    for i, b in raw.items():
        hit = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                hit[k : k + length] = True
        kept = np.frombuffer(b, np.uint8)[~hit].tobytes() if b else b""
        out[i] = (len(b), int(hit.sum()), int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("length", [400, 200])
def test_repeats_against_brute_force(docs, length):
    r = random.Random(length)
    passage, other = prose(r, 130), "é" * 150 + prose(r, 60)
    rows = [(i, prose(r, r.randint(0, 300))) for i in range(20)]
    rows += [(30 + i, prose(r, 20) + passage[i * 7 :] + prose(r, 30)) for i in range(12)]
    rows += [(50, other + "x" + other), (51, other[:-1]), (52, "ab" * 700), (53, "z" * 900), (54, rows[0][1]), (55, ""), (56, None), (57, passage[:length]), (58, passage[: length - 1])]
    want = brute_repeats(rows, length)
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in repeats.cut_repeats(docs(rows), length).collect()}
    assert got == want


def test_anchors_by_spans(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(0, 3, int(n), np.uint8)) for n in (5000, 0, 399, 400, 131_073, 401)] + [b"a" * 70_000, b"ab"]
    window, _ = repeats.shape(400)
    whole = repeats.Bytes(texts)
    want = [(a, b, int(repeats.least_grams(whole.data, len(whole.data), window)[a])) for a, b in zip(whole.begin, whole.begin[1:], strict=False) if b - a >= 400]
    assert want
    got = []
    for span in (1 << 22, 1 << 16, 1000, 97):
        monkeypatch.setattr(repeats, "SPAN", span)
        f = repeats.Anchors(texts, 400)
        assert [int(f.pos[f.doc == d][0]) for d in np.unique(f.doc)] == [x[2] for x in want]
        got.append([x.tolist() for x in (f.pos, f.doc, f.start, f.end, f.to, f.key, f.phrases(), f.bytes.hash(whole.begin[:-1], whole.begin[1:], 0, 1))])
    assert got[1:] == got[:1] * 3


def test_anchors_take_little_memory():
    texts = [bytes(np.random.default_rng(4).integers(97, 123, 250_000, np.uint8)) for _ in range(4)]
    repeats.Anchors(texts, 200)  # the tables that stay
    tracemalloc.start()
    f = repeats.Anchors(texts, 200)
    f.phrases()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40_000_000, most


def test_repeats_edges(docs):
    assert repeats.cut_repeats(docs([])).count() == 0
    long = prose(random.Random(1), 200)
    got = repeats.cut_repeats(docs([(1, long), (1, long), (None, "ä" * 300 + long)]), 400).collect()
    assert sorted((str(x["doc_id"]), x["n_removed"] > 0) for x in got) == [("1", True), ("1", True), ("None", True)]
    assert {x["kept_text"].strip("ä") for x in got} == {""}


def test_a_key_of_two_buckets_counts_no_place_twice(docs):
    r = random.Random(7)
    noise = lambda n: "".join(r.choices(string.ascii_lowercase, k=n))
    cores, tails = [noise(270) for _ in range(40)], [noise(60) for _ in range(8)]
    rows = [(i, noise(200) + cores[i % 40] + tails[i // 40 % 8] + noise(200)) for i in range(640)]
    parses = {}
    found = repeats.Anchors([x[1].encode() for x in rows], 400)
    symbols = found.phrases()
    for key, a, b in zip(found.key.tolist(), found.use, found.to, strict=True):
        parses.setdefault(key, Counter())[symbols[a:b].tobytes()[:16]] += 1
    assert any(sum(n > 1 for n in c.values()) > 1 for c in parses.values())
    assert {x["n_removed"] for x in repeats.cut_repeats(docs(rows), 400).collect()} == {0}


def test_repeats_very_long_and_clashing(docs):
    r = random.Random(5)
    long = prose(r, 60_000)
    rows = [(1, long), (2, "x" + long[5000:9000] + "y"), (3, prose(r, 100)), (4, "")]
    table = docs(rows).selectExpr("*", "'a' AS n_bytes", "'b' AS places", "'c' AS k_id")
    got = {x["doc_id"]: x for x in repeats.cut_repeats(table, 400, ("doc_id", "n_bytes", "places", "k_id", "source")).collect()}
    want = brute_repeats(rows, 400)
    assert {i: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for i, x in got.items()} == want
    assert got[1]["places"] == "b" and got[1]["k_id"] == "c" and got[2]["kept_text"] == "xy"


def test_lines(docs):
    run = ["alpha line", "beta line", "gamma line", "delta line", "epsilon line"]
    rows = [
        (1, "\n".join(["own one", *run, "own two"])),
        (2, "\n".join(["other", *run, "", "tail"])),
        (3, "\n".join(run)),
        (4, "\n".join(["a", "alpha line", "b", "beta line"])),
        (5, "\n".join(["x", "y", "z"] * 4)),
        (6, "\n\n\n\n\n\n"),
        (7, None),
        (8, ""),
        (9, "\n".join(run)),
    ]
    got = {r["doc_id"]: (r["kept_text"], r["n_removed"]) for r in line_dedup.drop_repeated_lines(docs(rows)).collect()}
    assert got[1] == (rows[0][1], 0)
    assert got[2] == ("other\n\ntail", 5)
    assert got[3] == ("", 5) and got[9] == ("", 5)
    assert got[4] == (rows[3][1], 0)
    assert got[5] == ("x\ny\nz", 9)
    assert got[6] == (rows[5][1], 0) and got[7] == (None, 0) and got[8] == ("", 0)
    assert line_dedup.drop_repeated_lines(docs([])).count() == 0


def test_every_long_run_has_a_fingerprint_in_common():
    r = random.Random(9)
    for _ in range(200):
        run = [r.randrange(1, 50) for _ in range(5)]
        marks = []
        for _ in range(2):
            lines = [r.randrange(1, 50) for _ in range(r.randint(0, 8))] + run + [r.randrange(1, 50) for _ in range(r.randint(0, 8))]
            _, key = line_dedup.fingerprints(np.array(lines, np.uint64), 3, 3)
            marks.append(set(key.tolist()))
        assert marks[0] & marks[1]


def brute_lines(rows, gram=3):
    """By definition: for every place, the runs from it that stand at an earlier place and are not blank alone."""
    lines = [(i, [x.strip() for x in t.split("\n")]) for i, t in sorted(rows)]
    out = {}
    for d, (i, a) in enumerate(lines):
        gone = [False] * len(a)
        for e in range(d + 1):
            b = lines[e][1]
            for p in range(len(a)):
                for q in range(p if e == d else len(b)):
                    n = 0
                    while p + n < len(a) and q + n < len(b) and a[p + n] == b[q + n]:
                        n += 1
                    if n >= gram and any(a[p : p + n]):
                        gone[p : p + n] = [True] * n
        text = dict(rows)[i].split("\n")
        out[i] = ("\n".join(x for x, g in zip(text, gone, strict=True) if not g), sum(gone))
    return out


def lines_of(docs, rows):
    return {r["doc_id"]: (r["kept_text"], r["n_removed"]) for r in line_dedup.drop_repeated_lines(docs(rows)).collect()}


def test_runs_of_three_lines_are_all_found(docs):
    r = random.Random(4)
    text = lambda n: [f"own {r.random()}" for _ in range(n)]
    rows = []
    for k in range(40):
        run = [f"run {k} {j}" for j in range(3)]
        rows += [(2 * k + j, "\n".join([*text(r.randint(3, 9)), *run, *text(r.randint(3, 9))])) for j in range(2)]
    got = lines_of(docs, rows)
    assert [got[2 * k + 1][1] for k in range(40)] == [3] * 40
    assert got == brute_lines(rows)


def test_a_part_that_an_early_document_holds_does_not_hide_the_whole_run(docs):
    p, q, r, s, t = (f"{x} line" for x in "pqrst")
    rows = [(1, "\n".join(["a", p, q, r, "b"])), (2, "\n".join(["c", p, q, r, s, t, "d"])), (3, "\n".join(["e", p, q, r, s, t, "f"])), (4, "\n".join(["g", q, r, s, "h"]))]
    got = lines_of(docs, rows)
    assert got == brute_lines(rows) and got[3] == ("e\nf", 5) and got[2] == (f"c\n{s}\n{t}\nd", 3)


@pytest.mark.parametrize("seed", range(3))
def test_lines_against_brute_force(docs, seed):
    r = random.Random(seed)
    rows = [(i, "\n".join(r.choices(["x", " y", "z ", "", "", f"own {i}"], k=r.randint(0, 40)))) for i in range(25)]
    assert lines_of(docs, rows) == brute_lines(rows)


def test_runs_are_grouped_by_the_fingerprint_they_chose():
    r = random.Random(2)
    for _ in range(100):
        lines = np.array([r.choice([0, 0, 1, 2, 3, 4]) for _ in range(r.randint(0, 30))], np.uint64)
        at, marks = line_dedup.fingerprints(lines, 2, 2)
        lead, mark, key, a, b = line_dedup.runs(lines, 2, 2)
        assert set(mark.tolist()) <= set(marks.tolist()) and lead.sum() <= len(at)
        plain = {(p, p + 3) for p in range(len(lines) - 2) if lines[p : p + 3].any()}
        assert plain <= set(zip(a.tolist(), b.tolist(), strict=True)) and len(key) == len(a)


def test_a_run_of_seven_is_cut_whole_where_its_middle_was_seen_before(docs):
    r = random.Random(7)
    rows = []
    for k in range(200):
        run = [f"run {k} {j}" for j in range(7)]
        text = lambda n, k=k: [f"own {k} {r.random()}" for _ in range(n)]
        rows += [(3 * k, "\n".join([*text(4), *run[2:5], *text(4)])), (3 * k + 1, "\n".join([*text(3), *run, *text(2)])), (3 * k + 2, "\n".join([*text(2), *run, *text(5)]))]
    got = lines_of(docs, rows)
    assert [got[3 * k + 2][1] for k in range(200)] == [7] * 200
    assert [got[3 * k + 1][1] for k in range(200)] == [3] * 200


def test_lines_edges(docs):
    run = "\n".join(["first line", "second line", "third line"])
    # Repeated rows are one document; a null doc_id comes last; a long text is read whole; names that clash are replaced or kept.
    long = "\n".join(f"line {i}" for i in range(30_000))
    rows = [(1, run), (1, run), (None, "x\n" + run), (2, long + "\n" + run), (3, "y\n" + long)]
    table = docs(rows).selectExpr("*", "'c' AS n_removed", "'d' AS cut", "'e' AS k_id", "'f' AS text_hash", "'g' AS `row`")
    out = line_dedup.drop_repeated_lines(table)
    assert sorted(out.columns) == sorted([*table.columns, "kept_text"])
    got = sorted((str(x["doc_id"]), x["n_removed"], x["kept_text"]) for x in out.collect())
    assert got == [("1", 0, run), ("1", 0, run), ("2", 3, long), ("3", 30_000, "y"), ("None", 3, "x")]
    assert {(x["cut"], x["k_id"], x["text_hash"], x["row"]) for x in out.collect()} == {("d", "e", "f", "g")}
