"""Fill-in-the-middle, collocations and token files against plain versions of themselves, on whole small tables and on awkward rows."""

import hashlib
import random
import re
import uuid
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ratelake.llm.arrow_text import cut_words
from ratelake.llm.collocations import Sketch, cells, collocations, kinds_of_bytes, phrase_counts
from ratelake.llm.fill_middle import Scan, byte_automaton, fill_in_middle, fill_in_middle_digest, restored_text
from ratelake.llm.shared_store import shared_dir
from ratelake.llm.token_files import lengths_table, pack, read_token_files, token_file_digest, unpack, write_token_files

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, n long, rank int, phrase string, shard int, block int, h1 long, lengths int, `output` string, k int, f long, part int"
EXTRA = (1, "x", 5, 2, "y", 3, 4, 5, 6, "z", 8, 9, 10)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def awkward_texts():
    rng = random.Random(5)
    words = ["red", "RED", "fox", "naïve", "混ざ", "😀", "it's", "a.b", "x-1", "İΣ", "é", "Ω"]
    mixed = ["".join(rng.choice(words) + rng.choice([" ", " ", "\t", ". ", "\n", " ", "\r\n"]) for _ in range(rng.randrange(200))) for _ in range(40)]
    return [None, "", " \t\n", "é", "😀", "<P>", "a<S>b", "x <", "<M", "<<P", "S>", "P><", "a" * 600, "é" * 511 + "<P", "😀" * 300, "<|endoftext|> tail<|startoftext|>", *mixed, *["same red fox runs here, same red fox"] * 12, *mixed[:3]]


@pytest.fixture(scope="module")
def awkward(spark):
    rng = random.Random(6)
    table = [(i, t, rng.choice(["en", "und", None, "de"]), *EXTRA) for i, t in enumerate(awkward_texts())]
    table += [table[20], table[20], (None, "no id at all", None, *EXTRA), (None, "no id at all", None, *EXTRA), (7, "an id that stands twice", "en", *EXTRA)]
    return spark.createDataFrame([(i, t, lang, "s", *rest) for i, t, lang, *rest in table], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    return "".join(rng.choice(words) + rng.choice([" ", " ", " ", ". "]) for _ in range(2_200_000))


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_fim(doc_id, text):
    x = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(x)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b, c = x[:low], x[low:high], x[high:]
    if not x or "<P>" in x or "<S>" in x or "<M>" in x or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(x), sha(x)
    form, out = ("spm", f"<S>{c}<P>{a}<M>{b}") if h[3] % 100 < 20 else ("psm", f"<P>{a}<S>{c}<M>{b}")
    return doc_id, n, form, low, high - low, sha(out), sha(x)


@pytest.mark.parametrize("which", ["awkward", "documents"])
def test_fill_in_middle(which, request):
    docs = request.getfixturevalue(which)
    found = Counter(map(tuple, fill_in_middle_digest(docs).collect()))
    assert found == Counter(plain_fim(r["doc_id"], r["text"]) for r in docs.collect())
    if which == "documents":
        assert {k[2] for k in found} == {"plain", "psm", "spm"}


def test_fill_in_middle_of_a_long_text(spark, long_text):
    texts = [(1, long_text + "é😀" * 99), (3, "ab"), (4, long_text[:70_000] + "<M>")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert {tuple(r) for r in fill_in_middle_digest(docs).collect()} == {plain_fim(*t) for t in texts}
    x = fill_in_middle(docs, moved=100, suffix_first=100)
    assert {(r[0], r[1]) for r in x.select("doc_id", restored_text(F.col("output"), F.col("form"))).collect()} == set(texts)


def test_the_automaton_forgets_all_but_three_bytes():
    goes, _ = byte_automaton()
    kinds = [0x41, ord("<"), ord("P"), ord(">"), 0x80, 0xC3, 0xE3, 0xF0, 0xFF]
    for a in kinds:
        for b in kinds:
            for c in kinds:
                ends = {goes[goes[goes[s * 256 + a].astype(int) * 256 + b].astype(int) * 256 + c] for s in range(6)}
                assert len(ends) == 1


def test_scan_counts_code_points_and_finds_them():
    texts = ["", "aé😀" * 400, "<P", ">", "x<S>y" * 200]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    scan = Scan(np.frombuffer(b"".join(raw), np.uint8), offsets, byte_automaton())
    base = scan.before(scan.begins)
    assert (scan.before(scan.ends) - base).tolist() == [len(t) for t in texts]
    assert scan.has_sentinel().tolist() == [False, False, False, False, True]
    at = scan.place(base[1] + np.arange(1201), np.full(1201, scan.ends[1])) - scan.begins[1]
    assert at.tolist() == [len(texts[1][:k].encode()) for k in range(1201)]


def plain_collocations(table, least=10, covered=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in table:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in found.items():
            if any(100 * b >= covered * a for q, b in found.items() if len(q) > len(p) and p in (q[:2], q[1:])):
                continue
            score, _, l, r = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
    return out


@pytest.mark.parametrize("which", ["awkward", "documents"])
def test_collocations(which, request):
    docs = request.getfixturevalue(which)
    found = [tuple(r) for r in collocations(docs).collect()]
    assert Counter(found) == Counter(plain_collocations([(r["text"], r["lang"]) for r in docs.collect()]))
    assert found


def test_collocations_of_the_best_only(spark):
    texts = [(f"p{i} q{i} r{i}. " * (10 + i % 3) + f"p{i} q{i}. " * i, "en") for i in range(40)]
    docs = spark.createDataFrame(texts, "text string, lang string")
    assert Counter(map(tuple, collocations(docs, top=7).collect())) == Counter(plain_collocations(texts, top=7))


def test_full_sketches_lose_nothing(spark, long_text):
    """With sketches far too small and a text cut in sections the counts are the same."""
    docs = spark.createDataFrame([(long_text, "x"), (None, "x"), ("w1 w2 " * 30, None)], "text string, lang string")
    found = Counter({(r["lang"], r["phrase"]): r["f"] for r in phrase_counts(docs, most_cells=16).collect()})
    want = Counter()
    for lang, text in (("x", long_text), ("und", "w1 w2 " * 30)):
        for piece in text.split("."):
            w = piece.split()
            want[lang, ""] += len(w)
            for k in (1, 2, 3):
                want.update((lang, " ".join(w[i : i + k])) for i in range(len(w) - k + 1))
    assert found == Counter({k: v for k, v in want.items() if v >= 10 or k[1] == ""})


def test_a_sketch_overestimates():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 2**63, 5000, dtype=np.uint64)
    rows = []
    for k in range(2):
        sums = np.bincount(cells(hashes, k, 16), np.full(5000, 10), 1 << 16)
        rows.append(np.packbits(sums >= 10))
    sketch = Sketch(16, rows)
    assert sketch.frequent(hashes).all()
    assert sketch.frequent(rng.integers(0, 2**63, 5000, dtype=np.uint64)).mean() < 0.05


def test_words_end_with_their_text():
    raw = [b"ab", b"cd e", b"", b" f", b"g"]
    offsets = np.cumsum([0, *map(len, raw)])
    word, words, at, text = cut_words(np.frombuffer(b"".join(raw), np.uint8), offsets, kinds_of_bytes())
    assert [words.to_pylist()[i] for i in word] == [b"ab", b"cd", b"e", b"f", b"g"]
    assert text.tolist() == [0, 1, 1, 3, 4] and at.tolist() == [0, 2, 5, 7, 8]


def plain_token_files(table):
    library = Tokenizer.from_file(TOKENIZER)
    start, out = 0, []
    for doc_id, text in table:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_of_documents(documents):
    table = [(r["doc_id"], r["text"]) for r in documents.orderBy("doc_id").collect()]
    assert sorted(map(tuple, token_file_digest(documents.repartition(5), TOKENIZER).collect())) == plain_token_files(table)


def test_token_files_of_awkward_rows(awkward):
    found = sorted(map(tuple, token_file_digest(awkward, TOKENIZER).collect()), key=lambda r: r[1])
    ids = [r[0] for r in found]
    assert ids == sorted(ids, key=lambda i: (i is None, i))
    assert [r[1] for r in found] == np.cumsum([0, *(r[2] for r in found[:-1])]).tolist()
    want = Counter((i, n, c) for i, _, n, c in plain_token_files([(r["doc_id"], r["text"]) for r in awkward.collect()]))
    assert Counter((i, n, c) for i, _, n, c in found) == want


def test_token_files_of_a_long_text_and_small_blocks(spark, long_text):
    texts = [(2, long_text), (1, "first"), (3, "last one")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    path = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    write_token_files(docs, path, TOKENIZER, 1, block_ids=4)
    found = read_token_files(spark, path).orderBy("doc_id").collect()
    library = Tokenizer.from_file(TOKENIZER)
    for r, (_, text) in zip(found, sorted(texts)):
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == [*library.encode(text, add_special_tokens=False).ids, 1]
    ranks = [r["id"] for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()]
    total = Counter(i for r in found for i in np.frombuffer(bytes(r["ids"]), "<u4").tolist())
    assert ranks == sorted(total, key=lambda i: (-total[i], i))


def test_bytes_of_ranks():
    rng = np.random.default_rng(2)
    for values in ([], [0], [255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1], rng.integers(0, 2 ** rng.integers(1, 33, 1001), dtype=np.int64).tolist()):
        values = np.array(values, np.uint32)
        control, data = pack(values)
        assert len(control) == -(-len(values) // 4)
        assert unpack(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), len(values), lengths_table()).tolist() == values.tolist()


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for found in (fill_in_middle_digest(docs), collocations(docs), token_file_digest(docs, TOKENIZER)):
        assert found.collect() == []
    blank = spark.createDataFrame([(None, None, None), (1, "", "en")], "doc_id long, text string, lang string")
    assert collocations(blank).collect() == []
    assert sorted(r["start"] for r in token_file_digest(blank, TOKENIZER).collect()) == [0, 1]
