import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from pagewright.llm import byte_bpe, packing, token_counts, wordbpe

tiktoken = pytest.importorskip("tiktoken")
WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_multi_50k.tiktoken")
ODD = [
    "", "a", "don't we've 'll 're's \n's 's", "  lead", "trail  ", "a \n b", "\n\n\nx", "<|endoftext|>hi <|startoftext|>there", "x" * 3000,
    "ΣΑΣ ς İstanbul ½²³ ①②", "éà  　 x\x1cy\x1f", "日本語テキスト 123 4", "''s '' 't''t a'S", "😀😁 ok", "\x00 a\x00b", "tab\tnew\nline\x85z \t ", "a_b-c...d___ $%&",
]


def texts():
    r = random.Random(4)
    alphabet = "abcdest'lrvm  0½é\n\t.,!'<|>ΣİÄ́ 日"
    return ODD + ["".join(r.choices(alphabet, k=r.randint(0, 60))) for _ in range(400)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD)


def test_word_ids_equal_the_library(library):
    all_ = texts()
    ids, off = wordbpe.load(WORD).encode(all_)
    want = library.encode_batch(all_, add_special_tokens=False)
    assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)] == [e.ids for e in want]


def test_prefix_counts_equal_the_library(library):
    counter = token_counts.load(WORD)
    all_ = texts()
    assert counter.totals(all_).tolist() == [len(e.ids) for e in library.encode_batch(all_, add_special_tokens=False)]
    text = wordbpe.load(WORD).normalise("They're well; we'll see naïve prefixes, unbelievably long 12345 words're here.")
    want = [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
    assert counter.prefix_counts(text) == want
    budget = 7
    assert counter.truncate(text, budget) == max(i for i, c in enumerate(want) if c <= budget)


def test_token_count_query(docs):
    rows = {r["doc_id"]: r for r in token_counts.count_tokens(docs([(1, None), (2, ""), (3, "word " * 3000), (4, "é")]), WORD, 2048).collect()}
    assert (rows[1]["n_bytes"], rows[1]["n_tokens"]) == (0, 0) and rows[2]["n_tokens"] == 0
    assert rows[3]["over_limit"] and not rows[4]["over_limit"] and rows[4]["n_bytes"] == 2
    assert token_counts.count_tokens(docs([]), WORD, 2048).count() == 0


def test_byte_bpe_equals_the_library_and_decodes(docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTE, "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    all_ = texts()
    got = {r["doc_id"]: r for r in byte_bpe.encode_decode(docs([*enumerate(all_), (-1, None)]), BYTE, keep_ids=True).collect()}
    for i, t in enumerate(all_):
        ids = encoding.encode_ordinary(t)
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert bytes(got[i]["decoded"]) == t.encode() and got[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    assert got[-1]["n_tokens"] == 0
    assert byte_bpe.encode_decode(docs([]), BYTE).count() == 0


def test_packing(docs, library):
    r = random.Random(5)
    rows = [(i, "word " * r.choice([0, 3, 50, 700, 1100, 1500, 2047, 2048, 5000])) for i in range(120)] + [(200, None), (207, "twice"), (207, "twice"), (None, "no id")]
    got = packing.pack(packing.cut(docs(rows), WORD, 2048), 2048, group_items=20, fan_in=2).collect()
    by_seq, by_doc = {}, {}
    for x in got:
        by_seq.setdefault(x["sequence_id"], []).append(x)
        by_doc.setdefault(x["doc_id"], []).append(x)
    for members in by_seq.values():
        members.sort(key=lambda x: x["offset"])
        at = 0
        for x in members:
            assert x["offset"] == at
            at += x["length"]
        assert at <= 2048
    assert len(by_doc[207]) == 2 and len(by_doc[None]) == 1
    for i, t in rows[:121]:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        parts = sorted(by_doc[i], key=lambda x: x["piece"])
        assert [p["start"] for p in parts] == list(range(0, len(ids), 2048))
        for p in parts:
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes())
    sizes = [x["length"] for x in got]
    one_heap = len(packing.best_fit(sizes, 2048))
    assert -(-sum(sizes) // 2048) <= len(by_seq) <= 1.05 * one_heap + 1
    assert packing.pack_documents(docs([]), WORD).count() == 0


def test_packing_of_lengths_that_never_pair(spark):
    pieces = spark.range(500).selectExpr("id doc_id", "0 piece", "0L start", "1100L length", "0L ids_crc32").selectExpr("doc_id", "cast(piece as int) piece", "start", "length", "ids_crc32")
    got = packing.pack(pieces, 2048, group_items=50, fan_in=3)
    assert got.count() == 500 and got.select("sequence_id").distinct().count() == 500


def test_very_long_pieces_equal_the_library():
    import time

    bpe = byte_bpe.ByteBPE(BYTE)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    r = random.Random(6)
    words = "the of and to in is that for it was on are as with his they at be this from have or by one had not but what all were when".split()
    for piece in ("a" * 1_000_000, "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000)), "".join(r.choices(words, k=300_000))):
        began = time.perf_counter()
        flat, off, decoded = bpe.encode([piece, ""])
        assert time.perf_counter() - began < 60
        assert flat.tolist() == library.encode_ordinary(piece) and off[1] == off[2] and decoded == [piece.encode(), b""]


def test_one_place_a_step_gives_the_same():
    bpe = byte_bpe.ByteBPE(BYTE)
    all_ = texts()
    flat, off, _ = bpe.encode(all_)
    bpe.encode_sql, bpe.known = byte_bpe.ENCODE.format(first="AND p.k = best.k"), {}
    again, off_again, _ = bpe.encode(all_)
    assert flat.tolist() == again.tolist() and off.tolist() == off_again.tolist()
    # A vocabulary in which a token has a part of higher rank that its own bytes would not meet.
    assert bpe.made_from_below(b"the")
    bpe.ranks = {b"a": 0, b"b": 1, b"c": 2, b"bc": 3, b"abc": 5, b"ab": 4, b"abcd": 9, b"d": 6, b"cd": 10}
    assert bpe.made_from_below(b"abc") and bpe.made_from_below(b"abcd")
    del bpe.ranks[b"bc"]
    assert bpe.made_from_below(b"abc")
    bpe.ranks[b"ab"] = 7
    assert not bpe.made_from_below(b"abc")


def one_by_one(piece, ranks):
    """Ids by merging the first place of the least rank until no pair merges."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while piece not in ranks and len(parts) > 1:
        rank, at = min((ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank == 1 << 30:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[piece]] if piece in ranks else [ranks[x] for x in parts]


def test_any_rank_file_gives_what_one_place_at_a_time_gives(tmp_path):
    kinds = set()
    for seed in range(12):
        r = random.Random(seed)
        tokens = {bytes(r.choices(b"abc", k=r.choice([2, 2, 3, 4, 5]))) for _ in range(4 + 3 * seed)} | {b"ab"}
        ranks = {bytes([b]): b for b in range(256)} | {t: 256 + i for i, t in enumerate(r.sample(sorted(tokens), len(tokens)))}
        path = tmp_path / f"{seed}.tiktoken"
        path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % n for t, n in ranks.items()))
        bpe = byte_bpe.ByteBPE(str(path))
        kinds.add(bpe.encode_sql)
        pieces = ["".join(r.choices("abc", k=r.choice([1, 3, 6, 12, 31, 32, 33, 90]))) for _ in range(150)]
        flat, off, _ = bpe.encode(pieces)
        for t, a, b in zip(pieces, off[:-1].tolist(), off[1:].tolist(), strict=True):
            assert flat[a:b].tolist() == one_by_one(t.encode(), ranks), (seed, t)
    assert len(kinds) == 2  # files of either sort


def test_the_recursion_makes_few_rows():
    bpe = byte_bpe.ByteBPE(BYTE)
    r = random.Random(8)
    pieces = sorted({" " + "".join(r.choices("th er ing tion ou wh re an ed of ést ment ç que".split(), k=r.randint(2, 6))) for _ in range(3000)} - {t.decode(errors="ignore") for t in bpe.ranks})
    sql = bpe.encode_sql.replace(" USING KEY (k)", "")
    bpe.encode_sql = sql[: sql.rindex("SELECT w, tok")] + "SELECT w, tok FROM state"  # the rows of all steps
    ids, _ = bpe.encode_words(byte_bpe.pa.array(pieces, byte_bpe.pa.string()))
    assert len(ids) < 4 * sum(len(p.encode()) for p in pieces)


def test_what_is_forgotten_is_encoded_again(monkeypatch):
    bpe = byte_bpe.ByteBPE(BYTE)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 60)
    all_ = texts()
    for at in [*range(0, len(all_), 7), *range(0, len(all_), 11)]:
        part = all_[at : at + 9]
        flat, off, decoded = bpe.encode(part)
        assert [flat[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)] == [library.encode_ordinary(t) for t in part]
        assert decoded == [t.encode() for t in part]
    assert len(bpe.known) == len(bpe.back) == len(bpe.count) < 1000 and len(bpe.ids) == bpe.count.sum()


def test_rows_that_repeat_spread_over_groups(spark):
    pieces = spark.createDataFrame([(None, 0, 0, 1, 5)] * 9000, packing.PIECES)
    packed = packing.pack(pieces, 2048, group_items=1000)
    assert packed.count() == 9000 and packed.groupBy("sequence_id").count().count() <= 9
    assert packed.groupBy("sequence_id", "offset").count().where("count > 1").isEmpty()
