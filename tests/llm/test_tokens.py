import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from folio.llm import packing, token_files, wordpiece
from folio.llm.tokens import Encoder, load, pieces, vocabulary
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.01"
ODD = [None, "", " ", "  a  b", "a\n b", "a \n  b\t\tc ", "\0x\0 y", "it's  WE'LL x   y", "é ́x", "日本語 テキスト 🎉 🎉🎉", "<|endoftext|> a<|startoftext|>", "a <|endoftext|> b", "one<|startoftext|>two  <|ENDOFTEXT|> <|endoftext|", "x" * 50_000, "w 1 " * 20_000, "ΑΣ Σ ΑΣ", "　a \x1c b", "tab\tx  \n\n  y"]


def ids_of(name, texts, end):
    t = Tokenizer.from_file(vocabulary(name))
    return [(t.encode(x or "", add_special_tokens=False).ids if x else []) + [end] for x in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_by_word_equals_whole_texts(name):
    rng = random.Random(1)
    odd = [x for x in ODD if x] + ["".join(rng.choice(["a", "b", " ", "  ", "\n", "\t", ".", "'s", "1", "é", "é", " ", " ", "\x0b", "\x1f", "ß", "İ", "É", "÷", "×", "_", "\x1c", "\u0085", "ſ", "K", "²", "'re", "9", "\x00", "\x7f", "<|endoftext|>", "<|", "|>"]) for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    odd += ["".join(rng.choice(["a", "Bc", " ", "  ", "\n", "\t", ".", ",'", "'S", "'ll", "7", "é", "Ñ", "ß", "÷", "\x1c", "\x00", "\x7f", "\x85", "\xa0", "²", "µ", "Å"]) for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    assert Encoder(load(vocabulary(name))).rule is not None
    encode, t = Encoder(load(vocabulary(name)), remembered=50_000), Tokenizer.from_file(vocabulary(name))
    for text, got in zip(odd, encode(odd), strict=True):
        assert "".join(pieces(text)) == text
        assert np.frombuffer(got, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_files_equal_library(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    before, want = 0, {}
    for (d, _), ids in zip(docs, ids_of("word_bpe_49k.json", [t for _, t in docs], 2), strict=True):
        want[d] = (before, len(ids), crc(ids))
        before += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.op3_token_files(spark, SF).collect()}
    assert got == want


def test_files_odd_rows_round_trip_and_layout(spark, tmp_path):
    rows = [(i * 7 - 20, t, 5) for i, t in enumerate(ODD)] + [(1, "again", 5), (1, "again", 5), (None, "no id", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(3)
    path = f"{tmp_path}/tokens"
    token_files.write_tokens(df, path, load(vocabulary("word_bpe_49k.json")), 2)
    got = token_files.read_tokens(spark, path).collect()
    assert sorted((str(r.doc_id), r.ids) for r in got) == sorted((str(d), i) for (d, _, _), i in zip(rows, ids_of("word_bpe_49k.json", [t for _, t, _ in rows], 2), strict=True))
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == np.cumsum([0, *[len(r.ids) for r in got]])[:-1].tolist()
    assert [-(1 << 62) if r.doc_id is None else r.doc_id for r in got] == sorted(-(1 << 62) if d is None else d for d, _, _ in rows)
    some = token_files.read_tokens(spark, path, first=8, last=30)
    assert {r.doc_id for r in some.collect()} == {8, 15, 22, 29} and "PushedFilters: [IsNotNull(doc_id)" in some._jdf.queryExecution().toString()
    files = [f for f in (tmp_path / "tokens").glob("*.parquet")]
    column = pq.ParquetFile(max(files, key=lambda f: f.stat().st_size)).metadata.row_group(0).column(4)
    assert column.path_in_schema.startswith("ids") and "RLE_DICTIONARY" in column.encodings and column.has_offset_index
    token_files.write_tokens(df.limit(0), f"{tmp_path}/none", load(vocabulary("word_bpe_49k.json")), 2)
    assert token_files.with_crc(token_files.read_tokens(spark, f"{tmp_path}/none")).count() == 0


def test_end_marks_in_texts(spark, tmp_path):
    """The strings of added tokens are those tokens, as the library has it."""
    docs = [(i, t) for i, t in enumerate(["a <|endoftext|> b", "<|startoftext|>", "x<|endoftext|><|endoftext|>y " * 400, "plain", None])]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = ids_of("word_bpe_49k.json", [t for _, t in docs], 2)
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_files.op3_token_files(spark, str(tmp_path)).collect()}
    assert got == {d: (len(x), crc(x)) for (d, _), x in zip(docs, want, strict=True)} and 49407 in want[0]
    check_packing(packing.op4_nnls_packing(spark, str(tmp_path)).collect(), docs)


def test_memory_is_bounded_by_bytes():
    encode = Encoder(load(vocabulary("byte_bpe_50k.json")), remembered=20_000)
    rng = random.Random(0)
    for _ in range(40):
        list(encode([" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 400))) for _ in range(30))]))
        assert sum(map(len, encode.parts)) <= 20_000 and max(encode.held.values()) <= 20_000


def check_packing(rows, docs, end=0, window=1024, padded=1):
    ids = dict(zip([d for d, _ in docs], ids_of("byte_bpe_50k.json", [t for _, t in docs], end), strict=True))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == crc(ids[r.doc_id][r.start : r.start + r.length]) and r.length > 0
    assert by_doc.keys() == ids.keys()
    for d, own in by_doc.items():
        own.sort(key=lambda r: r.start)
        assert [r.start for r in own] == np.cumsum([0, *[r.length for r in own]])[:-1].tolist() and sum(r.length for r in own) == len(ids[d])
    sizes = []
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *[r.length for r in own]])[:-1].tolist()
        sizes.append(sum(r.length for r in own))
    assert max(sizes, default=0) <= window and sum(s < window for s in sizes) <= padded
    assert sorted(by_sequence) == list(range(len(by_sequence)))


def test_packing_equals_library(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check_packing(packing.op4_nnls_packing(spark, SF).collect(), docs)


def test_packing_odd_rows(spark):
    definition = load(vocabulary("byte_bpe_50k.json"))
    docs = list(enumerate(ODD * 3))
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, crcs string, rest int")
    check_packing(packing.pack(df, definition, 0).collect(), docs)
    same = [(i, "a b c d e f g " * 90) for i in range(300)]
    check_packing(packing.pack(spark.createDataFrame(same, "doc_id long, text string"), definition, 0).collect(), same)
    assert packing.pack(df.limit(0), definition, 0).count() == 0
    again = packing.pack(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string"), definition, 0).collect()
    assert sorted((str(r.doc_id), r.length, r.offset) for r in again)[:2] != [] and sum(r.length for r in again) == 8


@pytest.mark.parametrize("seed", range(5))
def test_plan_places_each_rest_once(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 1024, 4000) if seed % 2 else np.minimum(1023, rng.geometric(0.004, 4000))
    if seed == 4:
        lengths[:2000] = 700
    counts = np.bincount(lengths, minlength=1024)
    plan = packing.Plan(counts)
    ranks = np.zeros(len(lengths), np.int64)
    for v in np.unique(lengths):
        ranks[lengths == v] = np.arange(counts[v])
    sequence, offset, fits = plan.place(lengths, ranks)
    used = defaultdict(list)
    for s, o, f, n in zip(sequence.tolist(), offset.tolist(), fits.tolist(), lengths.tolist(), strict=True):
        used[s].append((o, f))
        if f < n:
            used[s + 1].append((0, n - f))
    for spans in used.values():
        spans.sort()
        assert [o for o, _ in spans] == np.cumsum([0, *[f for _, f in spans]])[:-1].tolist()
    assert sum(sum(f for _, f in x) < 1024 for x in used.values()) <= 1
    assert plan.sequences == len(used)
    if seed in (1, 3):
        assert plan.solved > 0.7 * len(used)


def test_least_squares_finds_exact_counts():
    counts = np.zeros(17, np.int64)
    counts[[5, 11, 8, 4]] = [30, 30, 40, 20]  # window 16: 30 x (5, 11), 10 x (4, 4, 8), 15 x (8, 8)
    rows = packing.combinations(counts, 16)
    x = packing.non_negative_least_squares(rows, counts)
    made = np.bincount(rows.ravel(), np.repeat(x, 3), 17)
    assert np.abs(made[1:] - counts[1:]).max() < 1e-4 and (x >= 0).all()


@pytest.mark.parametrize("seed", range(3))
def test_least_squares_converge(seed):
    """No column outside descends, none inside would be better smaller: the conditions of the optimum."""
    rng = np.random.default_rng(seed)
    counts = np.bincount(rng.integers(1, 64, [60, 400, 3000][seed]), minlength=64)
    rows = packing.combinations(counts, 64)
    x = packing.non_negative_least_squares(rows, counts, 500)
    weight = np.arange(64) / 64
    left = weight * (counts - np.bincount(rows.ravel(), np.repeat(x, 3), 64))
    left[0] = 0
    descent = (weight * left)[rows].sum(1)
    assert (x >= 0).all() and descent.max() < 1e-3 and np.abs(descent[x > 1e-9]).max() < 1e-3


def test_combinations_are_all_there():
    counts = np.zeros(40, np.int64)
    counts[[3, 9, 10, 14, 16, 20, 30, 31, 37]] = 1
    there = set(np.flatnonzero(counts).tolist())
    want = {(a, 40 - a, 0) for a in there if a <= 20 and 40 - a in there} | {(a, b, 40 - a - b) for a in there for b in there if a <= b <= 40 - a - b and 40 - a - b in there}
    assert set(map(tuple, packing.combinations(counts, 40).tolist())) == want


def test_most_sequences_are_solved_for(spark):
    """Of the rests of real texts, once lengths repeat; the figures are in the README."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").limit(5000).collect()]
    lengths = np.array([len(x) // 4 + 1 for x in Encoder(load(vocabulary("byte_bpe_50k.json")))(texts)]) % 1024
    counts = np.bincount(lengths, minlength=1024)
    counts[0] = 0
    plan = packing.Plan(counts)
    assert plan.solved >= 0.9 * plan.sequences


def greedy(word, first, later):
    at, n = 0, 0
    while at < len(word):
        pieces_ = first if at == 0 else later
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces_), None)
        if end is None:
            return wordpiece.UNKNOWN + 1
        at, n = end, n + 1
    return n


def test_automaton_equals_greedy():
    rng = random.Random(0)
    for _ in range(300):
        first, later = (frozenset("".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 12))) for _ in range(2))
        machine = wordpiece.LongestMatch(first, later)
        for _ in range(60):
            word = "".join(rng.choice("abcd" if rng.random() < 0.1 else "abc") for _ in range(rng.randint(1, 12)))
            assert machine.count(word) == greedy(word, first, later), (first, later, word)


def test_counts_equal_greedy(spark):
    first, later = wordpiece.piece_sets(vocabulary("piece_bpe_32k.model"))
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    known = {}
    for r in wordpiece.op5_longest_match_counts(spark, SF).collect():
        words = texts[r.doc_id].encode().split()
        n = sum(known.setdefault(w, greedy(w.decode(), first, later)) for w in words)
        assert (r.n_words, r.n_pieces, r.n_unknown) == (len(words), n % wordpiece.UNKNOWN, n // wordpiece.UNKNOWN)


def test_count_edges(spark):
    df = spark.createDataFrame([(1, None, 1), (1, "", 1), (None, " \t", 1), (2, "ab  zz", 1), (3, "ab " * 100_000, 1)], "doc_id long, text string, n_words int")
    got = sorted(((r.n_words, r.n_pieces, r.n_unknown) for r in wordpiece.count_pieces(df, frozenset(["a", "ab"]), frozenset(["b"])).collect()))
    assert got == [(0, 0, 0), (0, 0, 0), (0, 0, 0), (2, 2, 1), (100_000, 100_000, 0)]
    assert wordpiece.count_pieces(df.limit(0), frozenset("a"), frozenset("b")).count() == 0
