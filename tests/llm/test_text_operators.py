"""Each operator against a plain version of itself, on whole small tables and on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ratelake.llm import queries, suffix_dedup
from ratelake.llm.decontamination import contamination_digest, find_contamination
from ratelake.llm.mixing import mix_sources, take_mix
from ratelake.llm.near_dedup import near_duplicate_digest
from ratelake.llm.ogg_media import encode, ogg_digest, read_packets
from ratelake.llm.suffix_dedup import repeat_digest
from ratelake.llm.token_counts import token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, gram long, size int, `key` string, place int"
LONG = " ".join(f"w{i * 7919 % 10007}" for i in range(9000))
PASSAGE = " ".join(f"passage{i}" for i in range(60))


def rows(texts):
    rng = random.Random(3)
    return [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b", None]), None, "x", 1, 2, "k", 3) for i, t in enumerate(texts)]


AWKWARD = [
    None,
    "",
    " \t\n",
    "one",
    "it's they'll I've we'd 'S DON'T  two   spaces\n\n\ttabs 12345 <|endoftext|> tail<|endoftext|>",
    "é" * 300 + " 😀😀 混ざった文字列 ١٢٣ \u00a0\u2003x",
    LONG,
    LONG + " end",
    PASSAGE + ". Something before it.",
    "Something quite different stands ahead. " + PASSAGE,
    PASSAGE.upper(),
    *["the same words again and again in many copies of one text"] * 7,
    "a" * 500,
    "a" * 500 + "b",
    "short item text",
]


@pytest.fixture(scope="module")
def awkward(spark):
    table = rows(AWKWARD)
    return spark.createDataFrame([*table, table[3], table[8]], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("which", ["awkward", "documents"])
def test_token_counts_equal_the_library(which, request):
    docs = request.getfixturevalue(which)
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    expected = Counter()
    for r in docs.collect():
        text = r["text"] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        expected[r["doc_id"], len(text.encode()), n, n > 1024] += 1
    assert Counter(map(tuple, token_counts(docs, path).collect())) == expected


def test_token_counts_of_random_strings(spark):
    rng = random.Random(9)
    alphabet = ["a", "B", "'s", "'ll", "'", "re", " ", "  ", "\n", "1", "é", "ß", "日", "😀", ".", "!?", "the", "ing", "\u0301", "\x00", "<|endoftext|>", "\u2028"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    found = by_id(token_counts(spark.createDataFrame(rows(texts), SCHEMA), path))
    for i, e in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert found[i]["n_tokens"] == len(e.ids), texts[i]


def shingles(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.parametrize("which", ["awkward", "documents"])
def test_near_duplicates_equal_all_pairs(which, request):
    docs = request.getfixturevalue(which)
    table = docs.select("doc_id", "text").distinct().collect()
    sets = {r[0]: shingles(r[1]) for r in table}
    near = {i: i for i in sets}

    def root(i):
        while near[i] != i:
            i = near[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                near[y] = x
    found = by_id(near_duplicate_digest(docs))
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in found.items()} == {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def test_near_duplicates_of_a_chain_and_of_large_groups(spark):
    base = [f"x{i}" for i in range(80)]
    texts = [" ".join(base[k : k + 60]) for k in range(0, 20, 2)] + [" ".join(base[:60])] * 40 + [f"alone {i} two three four five" for i in range(10)]
    random.Random(1).shuffle(texts)
    docs = spark.createDataFrame(rows(texts), SCHEMA)
    test_near_duplicates_equal_all_pairs("docs", type("R", (), {"getfixturevalue": lambda self, _: docs})())


def repeats(table):
    """By document: bytes kept and number of runs removed."""
    seen, out = set(), {}
    for doc_id, text in sorted(table):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            s = raw[i : i + 100]
            if s in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(s)
        out[doc_id] = (len(raw), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("which", ["awkward", "documents"])
def test_repeats_equal_a_scan_in_order(which, request):
    """Rows that are repeated lose the same bytes; rows without an id lose none and are nowhere earlier."""
    docs = request.getfixturevalue(which)
    docs = docs.union(docs.limit(40)).union(docs.limit(5).withColumn("doc_id", F.lit(None).cast("long")))
    table = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    known = repeats({r for r in table if r[0] is not None})
    whole = {t: repeats([(0, t)])[0] for i, t in table if i is None}
    expected = Counter((i, *(known[i] if i is not None else (whole[t][0], 0, 0, hashlib.sha256((t or "").encode()).hexdigest()))) for i, t in table)
    assert Counter(tuple(r) for r in repeat_digest(docs).collect()) == expected


def test_repeats_of_texts_longer_than_a_window(spark):
    rng = random.Random(8)
    base = "".join(rng.choices("abcdefé ", k=1_100_000))
    texts = [base, base[333:700] + "x" + base[450_000:480_000], base[5:260] * 3 + base[523_000:525_000], "q" * 1_100_000]
    docs = spark.createDataFrame(rows(texts), SCHEMA)
    assert {i: tuple(r[1:]) for i, r in by_id(repeat_digest(docs)).items()} == repeats(list(enumerate(texts)))


@pytest.mark.parametrize("sent", [6_000_000, 10])
def test_repeats_of_random_pieces(spark, monkeypatch, sent):
    monkeypatch.setattr(suffix_dedup, "SENT_KEYS", sent)
    rng = random.Random(5)
    pieces = ["".join(rng.choice("abcé ") for _ in range(rng.choice([30, 70, 99, 100, 101, 150, 400]))) for _ in range(25)]
    texts = ["".join(rng.choice(pieces) + rng.choice(["", "x"]) for _ in range(rng.randint(1, 6))) for _ in range(150)] + ["ab" * 400, "a" * 99, "a" * 100, "a" * 101, pieces[0] * 9]
    rng.shuffle(texts)
    docs = spark.createDataFrame(rows(texts), SCHEMA)
    assert {i: tuple(r[1:]) for i, r in by_id(repeat_digest(docs)).items()} == repeats([(i, t) for i, t in enumerate(texts)])


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def contamination(docs, items, width=10):
    wanted = defaultdict(set)
    for i, text in items:
        w = words_of(text)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            wanted[tuple(w[k : k + width])].add(i)
    lengths = {len(w) for w in wanted}
    out = []
    for doc_id, text in docs:
        w, hit, ids = words_of(text), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (found := wanted.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    ids |= {str(x) for x in found if x is not None}
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


def test_contamination_equals_all_windows(spark, sf_dir, awkward, documents):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = [tuple(r) for r in benchmark.select("item_id", "text").collect()]
    found = Counter(map(tuple, contamination_digest(documents, benchmark).collect()))
    assert found == contamination([tuple(r) for r in documents.select("doc_id", "text").collect()], items)
    assert any(r[5] for r in found)
    items = [(1, "Short item. TEXT"), (2, PASSAGE), (3, None), (4, "..."), (5, "again"), (5, "again"), (None, "one"), (7, LONG), (11, "é" * 300)]
    table = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert Counter(map(tuple, contamination_digest(awkward, asked).collect())) == contamination(table, items)
    blocks = find_contamination(awkward, asked, block_bytes=20_000)
    whole = find_contamination(awkward, asked)
    assert sorted(map(repr, blocks.collect())) == sorted(map(repr, whole.collect()))
    assert not contamination_digest(awkward, asked.limit(0)).where("contaminated").count()


def test_contamination_spans_point_into_the_text(spark):
    docs = spark.createDataFrame([(1, "Ünï — café: the QUICK brown-fox.")], "doc_id long, text string")
    spans = find_contamination(docs, spark.createDataFrame([(1, "Quick, brown fox")], "item_id long, text string")).first()["spans"]
    assert [(s["first"], s["last"], "Ünï — café: the QUICK brown-fox."[s["begin"] : s["end"]]) for s in spans] == [(4, 6, "QUICK brown-fox")]  # the dash is a word: it lies beyond ASCII


@pytest.mark.parametrize("which", ["awkward", "documents"])
def test_mixing_meets_targets(which, request):
    docs = request.getfixturevalue(which)
    mixed = mix_sources(docs)
    sources = {(r["doc_id"]): r["source"] for r in docs.collect()}
    sizes, taken, targets = Counter(), Counter(), {}
    for r in mixed.collect():
        s = sources[r["doc_id"]]
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        targets[s] = (r["target"], r["source_size"])
        assert 0 <= r["taken"] <= 3 * r["size"]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = dict(zip(order, [5, 2, 1] * len(order)))
    expected, stopped = {}, set()
    while True:
        free = [s for s in order if s not in stopped]
        rest, total = sum(sizes.values()) - sum(3 * sizes[s] for s in stopped), sum(weights[s] for s in free)
        expected = {s: rest * weights[s] / total for s in free} | {s: 3 * sizes[s] for s in stopped}
        more = {s for s in free if expected[s] > 3 * sizes[s]}
        if not more:
            break
        stopped |= more
    for s in order:
        assert targets[s] == (pytest.approx(expected[s]), sizes[s])
        assert abs(taken[s] - expected[s]) < 1
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, mix_sources(docs.repartition(3)).collect()))


def test_mix_repeats_and_cuts_texts(spark):
    docs = spark.createDataFrame([(1, "a b  c", "x"), (2, "d e", "x"), (3, "f " * 50, "y"), (4, None, "y"), (5, "", "z")], "doc_id long, text string, source string")
    mix = mix_sources(docs)
    out = take_mix(docs, mix)
    assert out.columns == docs.columns
    n = Counter()
    for r in out.collect():
        n[r["doc_id"]] += len((r["text"] or "").split())
    assert n == {r["doc_id"]: r["taken"] for r in mix.collect() if r["taken"]}


@pytest.mark.parametrize("which", ["awkward", "documents"])
def test_ogg_round_trip(which, request):
    docs = request.getfixturevalue(which)
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    for r in ogg_digest(docs).collect():
        raw = texts[r["doc_id"]]
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-16:])
        assert r["media_sha256"] == hashlib.sha256(encode(payload)).hexdigest()
        assert "bad=0" in r["feature"]


def test_ogg_leaves_out_damaged_pages():
    payload = bytes(i * 7 % 251 for i in range(192 * 400))
    media = bytearray(encode(payload))
    packets, n = read_packets(bytes(media))
    assert b"".join(p[3] for p in packets) == payload and n["streams"] == 2 and n["bad_pages"] == 0
    media[len(media) // 2] ^= 1
    packets, n = read_packets(bytes(media))
    assert n["bad_pages"] >= 1 and 0 < sum(len(p[3]) for p in packets) < len(payload)


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def test_url_rules(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    more = spark.createDataFrame([(-1, None), (-2, "no url"), (-3, "http://"), (-4, "HTTP://A.Example.COM/en/x?y#z"), (-5, "x://com"), (-6, "x://com/"), (-7, "x://notexample.com/en/"), (-8, "a://b://c/d"), (-9, "http://é.net/fr/ü" + "x" * 5000), (-9, "http://q.net#/fr/")], "page_id long, url string")
    pages = pages.unionByName(more)
    found = queries.judge_urls(pages).collect()
    assert len(found) == pages.count()
    urls = defaultdict(set)
    for i, u in pages.collect():
        rest = u.partition("://")[2] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(h + p, k) for k, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        urls[i].add((host, path, *(max(fits, key=lambda f: len(f[0])) if fits else (None, None))))
    for r in found:
        assert any((r["host"], r["path"], r["rule"]) == x[:3] and (x[3] is None or r["verdict"] == x[3]) for x in urls[r["page_id"]]), r
        assert r["verdict"] in ("allow", "block")
    verdicts = Counter((r["rule"] is None, r["verdict"]) for r in found)
    assert verdicts[True, "allow"] and verdicts[True, "block"]


def test_urls_are_judged_by_all_their_characters(spark):
    allowed, blocked = [f"http://www.example.com/en/{k}?id={k}&page=read#top" for k in range(40)], [f"http://x.net/fr/{k}?bet=casino&spin={k}#jackpot" for k in range(40)]
    new = ["http://other.org/a?page=read#top", "http://other.org/a?bet=casino#jackpot", "www.other.org?page=read#top", "www.other.org?bet=casino#jackpot"]
    pages = spark.createDataFrame(list(enumerate(new + allowed + blocked)), "page_id long, url string")
    found = {r["page_id"]: r["verdict"] for r in queries.judge_urls(pages).collect()}
    assert [found[k] for k in range(4)] == ["allow", "block", "allow", "block"]


def test_empty_tables(spark):
    e = empty(spark)
    items = spark.createDataFrame([], "item_id long, text string")
    for df in (token_counts(e, public_tokenizers.path("byte_bpe_50k.json")), near_duplicate_digest(e), repeat_digest(e), contamination_digest(e, items), mix_sources(e), ogg_digest(e), queries.judge_urls(spark.createDataFrame([], "page_id long, url string"))):
        assert df.collect() == []
