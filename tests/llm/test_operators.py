"""The operators against brute force and the libraries, on small rows with every odd case."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tallyloom.llm import byte_bpe, exact_dedup, language_id, line_dedup, media_tiff, near_dedup, packing, queries, secret_scan, sharding, token_counts

SPACES = " \t\n\x0b\f\r"
ODD = ["", None, " ", "\n\t ", "a", "A  a", "aA", "x" * 5000, "Straße é 漢字 😀", "the quick brown fox jumps over the lazy dog", "The quick\nbrown fox  jumps over the lazy dog", "<|endoftext|> end", "Σίσυφος ΣΑΣ", "é combined", "1234567890 it's we'll", "\x1c odd \x1f space wide　cjk"]
#: The queries on documents; those on embeddings have tests of their own.
ON_DOCUMENTS = {name: query for name, query in queries.queries().items() if name not in ("op11_clustering", "op12_whitening")}


def table(spark, texts, **more):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def clashing(spark, texts):
    """Extra columns named like the operators' own."""
    rows = [(i, t, 1, True, 2, "h", "en", 0.5, 3, 4) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, keep_id int, kept boolean, group_size int, text_sha256 string, lang string, score double, slot int, n_tokens int")


@pytest.fixture
def stored(spark, tmp_path):
    """Writes rows as a documents table and gives its folder."""

    def write(df):
        path = str(tmp_path / f"t{random.random()}")
        df.write.parquet(path + "/documents.parquet")
        return path

    return write


def norm(t):
    return "".join(c for c in (t or "") if c not in SPACES)


def test_exact_groups(spark, stored):
    texts = ODD + ["y" * 64 + "1", "y" * 64 + "2", "aa", " a a", "a a ", None]
    got = {r.doc_id: r for r in queries.op1_exact_dedup(spark, stored(table(spark, texts))).collect()}
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[norm(t)].append(i)
    for i, t in enumerate(texts):
        same = groups[norm(t)]
        keep = min(same, key=lambda j: (-len(texts[j] or ""), j))
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (keep, len(same), keep == i)
        assert got[i].text_sha256 == hashlib.sha256(norm(t).encode()).hexdigest()


def test_exact_without_broadcast(spark, monkeypatch):
    df = table(spark, ["a b", "ab", "c", "a  b"])
    small = sorted(map(tuple, exact_dedup.exact_groups(df).collect()))
    monkeypatch.setattr(exact_dedup, "BROADCAST_KEYS", 0)
    assert small == sorted(map(tuple, exact_dedup.exact_groups(df).collect()))
    assert [r.doc_id for r in exact_dedup.drop_exact(df).orderBy("doc_id").collect()] == [2, 3]


def test_drop_exact_keeps_one_of_repeated_rows(spark):
    rows = [(1, "same text", 7), (1, "same text", 7), (2, "sametext", 8), (3, "other", 9), (None, "same  text", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    out = exact_dedup.drop_exact(df)
    assert out.columns == ["doc_id", "text", "kept"]
    assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == [(0, "same  text"), (3, "other")]
    groups = exact_dedup.exact_groups(df.limit(4))
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in groups.collect()) == [(1, 1, 3), (1, 1, 3), (2, 1, 3), (3, 3, 1)]


def test_empty_tables(spark, stored):
    path = stored(table(spark, ["x"]).limit(0))
    for name, query in ON_DOCUMENTS.items():
        assert query(spark, path).count() == 0, name


def test_clashing_columns(spark, stored):
    path = stored(clashing(spark, ODD))
    for name, query in ON_DOCUMENTS.items():
        if name != "op4_sharding":
            assert query(spark, path).select("doc_id").distinct().count() == len(ODD), name
    shards = sharding.assign_shards(clashing(spark, ODD), queries.F.col("doc_id"), ["a", "b"], 101)
    assert shards.columns.count("slot") == 1 and shards.count() == len(ODD)


def brute_near(texts, percent=85):
    def shingles(t):
        words = (t or "").encode().lower().split()
        if not words:
            return frozenset()
        return frozenset([tuple(words)] if len(words) < 5 else [tuple(words[i : i + 5]) for i in range(len(words) - 4)])

    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def varied(rng, base, edits):
    words = base.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def test_near_groups_against_all_pairs(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: f"v{rng.randrange(4000)}"
    base = " ".join(word() for _ in range(120))
    passage = " ".join(word() for _ in range(60))
    texts = list(ODD)
    texts += [varied(rng, base, rng.randrange(0, 6)) for _ in range(60)]  # one group around a base, at all distances
    texts += [passage + " " + " ".join(word() for _ in range(rng.randrange(5, 60))) for _ in range(60)]  # a shared passage links nothing by itself
    for _ in range(15):
        own = " ".join(word() for _ in range(rng.randrange(6, 80)))
        texts += [own, own.upper(), varied(rng, own, 1)]
    want = brute_near(dict(enumerate(texts)))
    for hot in (near_dedup.HOT, 8):  # the second sends the large group and the passage through the lists of hot values
        monkeypatch.setattr(near_dedup, "HOT", hot)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_groups(table(spark, texts)).collect()}
        assert got == want
    assert [r.kept for r in near_dedup.near_groups(table(spark, ["a b c d e f", "A B C D E F"])).orderBy("doc_id").collect()] == [True, False]


def test_near_groups_at_exactly_the_limit(spark):
    """A text of 85 of the 100 shingles of a large group's base is similar to the base alone, by exactly 85 percent."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(104)]
    texts = [" ".join(base[:89]), " ".join(base[1:89])]  # the second shares 84, below the limit with the base
    for i in range(300):
        at = rng.randrange(10, 70)
        texts.append(" ".join([*base[:at], f"w{i}", *base[at + 1 :]]))
    texts.append(" ".join(base))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_groups(table(spark, texts)).collect()}
    assert got == brute_near(dict(enumerate(texts))) and got[len(texts) - 1][1] == 0


def test_packing(spark, stored):
    from tokenizers import Tokenizer

    from tallyloom.llm._shared import vocabulary_path

    library = Tokenizer.from_file(vocabulary_path(queries.WORD_BPE))
    rng = random.Random(5)
    texts = ODD + ["word " * 5000] + [" ".join(f"w{rng.randrange(999)}," for _ in range(rng.randrange(1, 900))) for _ in range(200)]
    rows = packing.pack_documents(table(spark, texts).coalesce(1), queries.WORD_BPE, with_ids=True).collect()
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length > 0
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, t in enumerate(texts):
        pieces = sorted(docs[i], key=lambda r: r.start)
        ids = [x for r in pieces for x in r.ids]
        assert ids == library.encode(t or "", add_special_tokens=False).ids + [1]
        assert [r.start for r in pieces] == [sum(p.length for p in pieces[:k]) for k in range(len(pieces))]
        assert {r.doc_tokens for r in pieces} == {len(ids)}
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == [sum(p.length for p in pieces[:k]) for k in range(len(pieces))]
        assert sum(r.length for r in pieces) <= 2048
    total = sum(r.length for r in rows)
    assert total > 0.96 * 2048 * (len(sequences) - 1)


def test_differencing_is_near_equal():
    rng = random.Random(1)
    sizes = [rng.randrange(100, 512) for _ in range(400)]
    windows = packing.differencing(sizes, 60)
    sums = [sum(sizes[i] for i in w) for w in windows]
    assert sorted(i for w in windows for i in w) == list(range(400)) and max(sums) - min(sums) <= 40
    assert packing.fill_windows([2048, 1, 2047, 5], 2048) and packing.differencing([], 3) == [[], [], []]


def test_sharding_table():
    shards, size = [f"s{i}" for i in range(7)], 1009
    table_ = sharding.fill_table(shards, size)
    counts = np.bincount(table_, minlength=7)
    assert counts.max() - counts.min() <= 1 and len(table_) == size
    prefs = [[(sharding._hash("offset:" + s) % size + j * (sharding._hash("skip:" + s) % (size - 1) + 1)) % size for j in range(size)] for s in shards]
    taken, owner, turn = set(), {}, 0
    while len(taken) < size:
        slot = next(p for p in prefs[turn % 7] if p not in taken)
        taken.add(slot)
        owner[slot] = turn % 7
        turn += 1
    assert [owner[i] for i in range(size)] == table_
    fewer = sharding.fill_table(shards[:-1], size)
    assert sum(a != b for a, b in zip(table_, fewer, strict=True) if a != 6) < 0.2 * size
    with pytest.raises(ValueError):
        sharding.fill_table(shards, 1000)


def test_sharding_null_keys(spark):
    out = sharding.assign_shards(spark.createDataFrame([(None,), (1,), (1,)], "doc_id long"), queries.F.col("doc_id"), ["a", "b", "c"], 101).collect()
    assert len(out) == 3 and out[0].slot is not None


def test_byte_bpe_equals_the_library(spark, stored):
    import public_tokenizers
    import tiktoken

    bpe = byte_bpe.load(queries.BYTE_BPE)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    rng = random.Random(2)
    parts = ["a", "th", " ", "  ", "\n", "'s", "'", "1", "é", "漢", "😀", "\x1c", "　", "\xa0", "--", "QU", "\x00", "zz"]
    texts = [t or "" for t in ODD] + ["a" * 3000, " " * 300, "\n \n x"] + ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(1500)]
    for t in texts:
        ids = bpe.encode(t)
        assert ids == library.encode_ordinary(t) and bpe.decode(ids) == t.encode()
    got = {r.doc_id: r for r in queries.op6_byte_bpe(spark, stored(table(spark, ODD))).collect()}
    for i, t in enumerate(ODD):
        ids = library.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    lists = spark.createDataFrame([(1, [0, 1]), (2, None), (3, [10**8])], "doc_id long, token_ids array<int>")
    assert [bytes(r.decoded) if r.decoded is not None else None for r in byte_bpe.decode_ids(lists, queries.BYTE_BPE).orderBy("doc_id").collect()] == [bpe.decode([0, 1]), None, None]


def test_token_counts_equal_the_library(spark, stored, monkeypatch):
    from tokenizers import Tokenizer

    from tallyloom.llm._shared import vocabulary_path

    library = Tokenizer.from_file(vocabulary_path(queries.WORD_BPE))
    counter = token_counts.load(queries.WORD_BPE)
    rng = random.Random(4)
    parts = ["a", "th", "e", " ", "\n", "'s", "'", "1", "é", "é", "漢", "😀", "\x1c", "　", "--", "Σ", "İ", "<|endoftext|>", "ß"]
    texts = [t or "" for t in ODD] + ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(1500)]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    for chunk in (token_counts.CHUNK, 5):  # the second composes the maps of many chunks
        monkeypatch.setattr(token_counts, "CHUNK", chunk)
        assert [counter.count(t) for t in texts] == want
    got = {r.doc_id: r for r in queries.op9_token_counts(spark, stored(table(spark, ODD))).collect()}
    for i, t in enumerate(ODD):
        assert (got[i].n_bytes, got[i].n_tokens) == (len((t or "").encode()), want[i]) and got[i].over_limit == (want[i] > 2048)


def test_token_counts_of_long_words(monkeypatch):
    """Words of 200,000 letters and signs: equal to the library, in bounded memory, also when states are let go within a word."""
    import tracemalloc

    from tokenizers import Tokenizer

    from tallyloom.llm._shared import vocabulary_path

    library = Tokenizer.from_file(vocabulary_path(queries.WORD_BPE))
    rng = random.Random(9)
    dna, letters = ("".join(rng.choice(a) for _ in range(200_000)) for a in ("acgt", "etaoinshrdlu"))
    texts = ["-" * 200_000, "=-" * 100_000, dna, letters, "漢字" * 20_000, "a " + letters[:150_000] + " b " + dna[:70_000] + "."]
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    counter = token_counts.TokenCounter(vocabulary_path(queries.WORD_BPE))
    for states in (token_counts.STATES, 1000):
        monkeypatch.setattr(token_counts, "STATES", states)
        counter.forget()
        assert [counter.count(t) for t in texts] == want
    tracemalloc.start()
    counter.count(letters[:20_000])  # with a trail in each state it took 1.8 GB
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50_000_000


@pytest.mark.parametrize("compression", [media_tiff.NONE, media_tiff.LZW, media_tiff.DEFLATE, media_tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff_round_trips(compression, predictor, order):
    rng = np.random.default_rng(0)
    for payload in (b"\0" * 64, rng.integers(0, 256, 64 * 300, dtype=np.uint8).tobytes(), b"abcabcab" * 8 * 700):
        for tile in (None, (16, 32)):
            data = media_tiff.encode_page(payload, 64, compression, predictor, 100, tile, order)
            (page,) = media_tiff.read_pages(data)
            assert page.data == payload and (page.width, page.compression) == (64, compression)


def test_media(spark, stored):
    got = {r.doc_id: r for r in queries.op8_media(spark, stored(table(spark, ODD))).collect()}
    for i, t in enumerate(ODD):
        raw = (t or "").encode()
        padded = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(padded)) and r.payload_sha256 == hashlib.sha256(padded).hexdigest()
        assert r.tail_crc32 == zlib.crc32(padded[-64:])
    assert got[0].media_sha256 == got[1].media_sha256 and got[0].feature == got[1].feature


def test_broken_media_give_a_row_with_an_error(spark):
    df = spark.createDataFrame([(1, bytearray(b"II*\0\x08\0\0\0")), (2, None), (3, bytearray(b""))], "doc_id long, media binary")
    rows = media_tiff.tiff_pages(df).orderBy("doc_id").collect()
    assert [(r.doc_id, r.page) for r in rows] == [(1, None), (3, None)] and all(r.error for r in rows)


def test_secret_base_findings(spark, stored):
    key, access, hexes = "Token: 'abcdef12'", "AKIA" + "B" * 16, "0123456789abcdef01234567"
    texts = ["", None, "x " + key, "password=short tOKen=12345", f"a {access} {access[:-1]}", f"{hexes} {hexes[:-1]}", f"api_key = {hexes}", "ſecret=abcdefgh", "token=token=abcdefg"]
    got = {r.doc_id: r for r in queries.op7_secret_scan(spark, stored(table(spark, texts))).collect()}
    assert [(got[i].n_assign, got[i].n_access, got[i].n_hex) for i in range(len(texts))] == [(0, 0, 0), (0, 0, 0), (1, 0, 0), (0, 0, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (0, 0, 0), (1, 0, 0)]
    assert got[6].base_sha256 == hashlib.sha256(f"assign:0:{10 + len(hexes)},hex:10:{10 + len(hexes)}".encode()).hexdigest() and got[0].spans == ""
    assert secret_scan.redact_text("a SECRET b", [(2, 8, "net"), (4, 6, "hex")]) == "a [SECRET] b"


def test_secret_network_learns():
    rng = random.Random(6)
    letters, text = "0123456789abcdef", lambda n: "".join(rng.choice("etaoin shrdlu") for _ in range(n))
    secrets, others = [], []
    for _ in range(300):
        k = "".join(rng.choice(letters) for _ in range(32))
        t = f"{text(30)} {k} {text(20)}"
        secrets += secret_scan.windows_of(t, 31, 63)
        o = f"{text(4).replace(' ', 'x')}.{rng.randrange(99)}@mail{rng.randrange(9)}.example.com"
        t = f"{text(30)} {o} {text(20)}"
        others += secret_scan.windows_of(t, 31, 31 + len(o))[:1]
    net = secret_scan.fit(secrets[:200], others[:200])
    assert (net.odds(secrets[200:]) >= net.threshold).mean() > 0.9 and (net.odds(others[200:]) >= net.threshold).mean() < 0.05
    assert net.report["recall"] >= secret_scan.RECALL - 0.01 and net.report["false_alarms"] < 0.05
    assert secret_scan.fit([], others).threshold > 1
    few = secret_scan.fit(secrets[:24], others[:40])  # a small sample is fitted as far
    assert (few.odds(secrets[200:]) >= few.threshold).mean() > 0.9 and (few.odds(others[200:]) >= few.threshold).mean() < 0.1


def plain_base(text):
    """The base findings by hand, character by character: {kind: [(start, end)]}."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    key = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    found = {"assign": [], "access": [], "hex": []}

    def assign(i):
        for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if not low.startswith(word, i):
                continue
            at = i + len(word)
            for quote in (1, 0):  # the quote is taken if there is one; giving it back never helps
                j = at
                if quote:
                    if j < len(text) and text[j] in "\"'":
                        j += 1
                    else:
                        continue
                while j < len(text) and text[j] == " ":
                    j += 1
                if j == len(text) or text[j] not in ":=":
                    continue
                j += 1
                while j < len(text) and text[j] == " ":
                    j += 1
                if j < len(text) and text[j] in "\"'" and j + 1 < len(text) and text[j + 1] in key:
                    j += 1
                end = j
                while end < len(text) and text[end] in key:
                    end += 1
                if end > j:
                    return end, end - j
        return None

    i = 0
    while i < len(text):
        hit = assign(i)
        if hit:
            if hit[1] >= 6:
                found["assign"].append((i, hit[0]))
            i = hit[0]
        else:
            i += 1
    for kind, head, chars, least in (("access", "AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 20), ("hex", "", set("0123456789abcdef"), 24)):
        i = 0
        while i < len(text):
            end = i + len(head)
            if not text.startswith(head, i):
                i += 1
                continue
            while end < len(text) and text[end] in chars:
                end += 1
            if end > i + len(head):
                if end - i >= least:
                    found[kind].append((i, end))
                i = end
            else:
                i += 1
    return found


def test_base_findings_against_a_scan_by_hand(spark, stored):
    rng = random.Random(12)
    parts = ["password", "PASSWD", "Secret", "token", "api_key", "apikey", "'", '"', " ", "=", ":", "AKIA", "AKIAB", "B" * 17, "0123456789ab", "cdef01", "é", "x", "hunter2", "\n", "-/+", "9" * 12]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(1500)]
    got = {r.doc_id: r for r in queries.op7_secret_scan(spark, stored(table(spark, texts))).collect()}
    for i, t in enumerate(texts):
        want = plain_base(t)
        listed = sorted(((a, k, b) for k, kind in enumerate(("assign", "access", "hex")) for a, b in want[kind]))
        digest = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in listed)
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(len(want[k]) for k in ("assign", "access", "hex")), t
        assert r.base_sha256 == hashlib.sha256(digest.encode()).hexdigest(), t


def test_secrets_of_forms_that_no_pattern_has(spark):
    """Fitted on the given table: planted keys without a keyword are found, whole and wherever they lie; harmless runs aren't."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = secret_scan.train(docs)
    assert net.report["recall"] >= 0.98 and net.report["false_alarms"] <= 0.02
    rng = random.Random(3)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = lambda n: "".join(rng.choice(chars) for _ in range(n))
    words = " ".join(r.text or "" for r in docs.limit(30).collect()).split()
    around = lambda s: " ".join([*rng.sample(words, 8), s, *rng.sample(words, 8)])
    kinds = [lambda: "ghp_" + key(36), lambda: "sk_live_" + key(24), lambda: f"eyJ{key(30)}.eyJ{key(60)}.{key(43)}", lambda: key(40), lambda: "glpat-" + key(20)]
    planted = [k() for k in kinds for _ in range(20)]
    texts = [around(s) for s in planted]
    found = secret_scan.scan_batch(texts, net)
    hit = sum(any(t[a:b] == s and kind == "net" for a, b, kind, _ in f) for t, s, f in zip(texts, planted, found, strict=True))
    assert hit >= 0.98 * len(planted)
    calm = ["4111111111111111", "anna.may42@mail7.example.com", "https://example.org/some/path/2024/index.html", "state-of-the-art-2024", "2024-01-02"]
    alarms = sum(bool(f) for f in secret_scan.scan_batch([around(s) for s in calm for _ in range(20)], net))
    assert alarms <= 5
    (late,) = secret_scan.scan_batch(["-".join(["word"] * 40) + "/" + key(40)], net)  # the secret lies late in a long candidate
    assert late and late[0][2] == "net"


def test_redaction_changes_nothing_else(spark):
    df = spark.createDataFrame([(1, "password = hunter2hunter2 ok", 5), (2, None, 6), (3, "clean", 7)], "doc_id long, text string, findings int")
    out = secret_scan.redact(df, secret_scan.fit([], [])).orderBy("doc_id").collect()
    assert [(r.text, r.findings) for r in out] == [("[SECRET] ok", 5), (None, 6), ("clean", 7)]


WORDS = {"en": "the of and to in is that it was for".split(), "fr": "le la les et des une dans pour que qui".split(), "de": "der die und das nicht mit ein von zu ist".split()}


def sample(rng, lang, n):
    ends = {"en": "ing", "fr": "eux", "de": "ung"}[lang]
    return " ".join(rng.choice(WORDS[lang]) if rng.random() < 0.6 else "".join(rng.choice("abcdefgh") for _ in range(4)) + ends for _ in range(n))


def test_language(spark):
    rng = random.Random(8)
    rows = [(i, sample(rng, lang, rng.randrange(20, 80)), lang) for i in range(400) for lang in [rng.choice(list(WORDS))]]
    df = spark.createDataFrame(rows + [(900, None, "en"), (901, "123 !?", None), (902, "", None)], "doc_id long, text string, lang string")
    model = language_id.train(df)
    got = {r.doc_id: r for r in language_id.identify(df, model, segments=True).collect()}
    assert sum(got[i].lang_pred == lang for i, _, lang in rows) > 0.98 * len(rows)
    assert [(got[i].lang_pred, got[i].score) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    mixed = spark.createDataFrame([(1, sample(rng, "fr", 40) + " " + sample(rng, "de", 60))], "doc_id long, text string")
    (r,) = language_id.identify(mixed, model, segments=True).collect()
    assert r.lang_pred == "de" and [s.lang for s in sorted(r.segments, key=lambda s: -s.n_words)[:2]] == ["de", "fr"]
    assert language_id.identify(mixed, language_id.fit([])).first().lang_pred == "und"


def test_forward_backward_against_all_paths():
    from itertools import product

    rng = np.random.default_rng(1)
    e, t = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3))
    weights = {p: np.exp(sum(e[0, i, s] for i, s in enumerate(p)) + sum(t[a, b] for a, b in zip(p, p[1:], strict=False))) for p in product(range(3), repeat=4)}
    total = sum(weights.values())
    marginals, expected, _ = language_id.forward_backward(e, np.array([4]), t)
    for i in range(4):
        for s in range(3):
            assert abs(marginals[0, i, s] - sum(w for p, w in weights.items() if p[i] == s) / total) < 1e-9
    pairs = np.zeros((3, 3))
    for p, w in weights.items():
        for a, b in zip(p, p[1:], strict=False):
            pairs[a, b] += w / total
    assert np.allclose(pairs, expected)


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    p = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    return a[p + (len(a) >= len(b)) :] == b[p + (len(b) >= len(a)) :]


def test_line_dedup_against_all_pairs(spark):
    rng = random.Random(9)
    lines = ["".join(rng.choice("abé 漢") for _ in range(rng.randrange(14, 40))) for _ in range(60)]
    docs = []
    for _ in range(60):
        own = []
        for _ in range(rng.randrange(0, 8)):
            s, kind = rng.choice(lines), rng.randrange(6)
            p = rng.randrange(len(s))
            own.append([s, s[:p] + "x" + s[p:], s[:p] + s[p + 1 :], s[:p] + "y" + s[p + 1 :], "short", ""][kind])
        docs.append("\n".join(own))
    long = [rng.choice("abcd efgh") for _ in range(9000)]
    for at in (0, 1, 4499, 4500, 4501, 8998, 8999):  # one edit in a long line, at all places
        docs += ["".join([*long[:at], *kind, *long[at + 1 :]]) for kind in ("", "x", "xy")]
    docs += ["".join(long), "".join([*long[:70], "q", *long[71:700], "q", *long[701:]]), " \n \n\t\n\t"]
    docs += [None, "", "z" * 3000 + "\n" + "z" * 2999 + "q", "aab" * 6 + "\n" + "aab" * 5 + "ab"]
    got = {r.doc_id: r for r in line_dedup.line_report(table(spark, docs)).collect()}
    seen = []
    for i, d in enumerate(docs):
        gone = []
        parts = (d or "").split("\n")
        for n, s in enumerate(parts):
            if s.strip(SPACES):
                if any(s == e or min(len(s), len(e)) >= line_dedup.EDIT_CHARS and one_edit(s, e) for e in seen):
                    gone.append(n)
                seen.append(s)
        assert (got[i].n_lines, got[i].dropped) == (len(parts), ",".join(map(str, gone))), (i, d)
    kept = {r.doc_id: r.text for r in line_dedup.drop_lines(table(spark, ["a" * 20 + "\nkeep", "b\n" + "a" * 20, None])).collect()}
    assert kept == {0: "a" * 20 + "\nkeep", 1: "b", 2: None}


def test_line_dedup_of_rows_without_ids_and_without_edits(spark):
    line = "a line of more than sixteen characters"
    rows = [(None, line + "\nRead more", 1), (None, line + "\nRead more", 1), (1, "Read more\n" + line + "!", 2), (2, "\n \n", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, line_no int")
    got = sorted((r.doc_id or 0, r.n_lines, r.dropped) for r in line_dedup.line_report(df).collect())
    assert got == [(0, 2, ""), (0, 2, ""), (1, 2, "0,1"), (2, 3, "")]
    assert [r.dropped for r in line_dedup.line_report(df, edits=0).filter("doc_id = 1").collect()] == ["0"]
    out = line_dedup.drop_lines(df)
    assert out.columns == df.columns and sorted(r.text for r in out.collect()) == ["", "\n \n", line + "\nRead more", line + "\nRead more"]
    with pytest.raises(ValueError):
        line_dedup.line_report(df, edits=2)


def test_language_query_against_plain_reading(spark, stored):
    """held_out, lang_pred, score and fit of the query against each text read by itself, and accuracy on what was held out."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    got = {r.doc_id: r for r in queries.op5_language_id(spark, "/root/testdata/sf0.01").collect()}
    model = language_id.train(docs)
    assert len(got) == len(rows)
    right = seen = 0
    for i, r in rows.items():
        held = zlib.crc32(str(i).encode()) % 4 == 2
        words = language_id.words_of(r.text or "")
        assert got[i].held_out == held
        if not words:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        if i % 10 == 0:  # one path at a time, in logarithms
            e, k = model.emissions(words).astype(float), len(model.languages)
            forward, back = e.copy(), np.zeros_like(e)
            for t in range(1, len(e)):
                forward[t] += np.logaddexp.reduce(forward[t - 1][:, None] + model.transitions, axis=0)
            for t in range(len(e) - 2, -1, -1):
                back[t] = np.logaddexp.reduce(model.transitions + (e[t + 1] + back[t + 1])[None, :], axis=1)
            shares = np.exp(forward + back - np.logaddexp.reduce(forward + back, axis=1, keepdims=True))
            mean = shares.mean(axis=0)
            assert model.languages[int(mean.argmax())] == got[i].lang_pred and abs(mean.max() - got[i].score) < 1e-4
            known = [[model.grams.get(f"^{w}$"[j : j + 3], 0) >> int(s.argmax()) & 1 for j in range(len(w))] for w, s in zip(words, shares, strict=True)]
            assert abs(np.mean([x for w in known for x in w]) - got[i].fit) < 1e-4 and k == 4
        if held and r.lang:
            seen += 1
            right += got[i].lang_pred == r.lang
    assert seen > 200 and right >= 0.98 * seen


def test_languages_that_are_many_or_unknown(spark):
    """No language is lost by its place in the alphabet; a column that holds no languages is refused; foreign texts are told."""
    rng = random.Random(4)
    letters = [chr(0x430 + i) for i in range(32)] + list("abcdefghijklmnopqrstuvwxyz")
    own = {f"l{n:02d}": ["".join(rng.choice(letters[(n * 5) % 50 :][:8]) for _ in range(5)) for _ in range(60)] for n in range(10)}
    text = lambda lang, n: " ".join(rng.choice(own[lang]) for _ in range(n))
    rows = [(i, text(lang, 60), lang) for i, lang in enumerate(list(own) * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df)
    assert model.languages == sorted(own)
    strange = [(1000, "zzxq qqzw xzzq wqqx " * 20), (1001, "漢字 仮名 交文 " * 20), (1002, text("l03", 40)), (1003, text("l03", 30) + " " + text("l08", 30)), (1004, "x" * 200_000), (1005, "12 !!"), (1006, None)]
    odd = spark.createDataFrame(strange, "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.foreign) for r in language_id.identify(odd, model).collect()}
    assert [got[i][1] for i in range(1000, 1005)] == [True, True, False, False, True] and got[1005] == got[1006] == ("und", False)
    assert sorted(r.doc_id for r in language_id.keep_known(odd, model).collect()) == [1002, 1003]
    many = spark.range(4 * language_id.MAX_LANGUAGES).selectExpr("id as doc_id", "'some text' as text", "cast(id as string) as lang")
    with pytest.raises(ValueError):
        language_id.train(many)


def test_near_groups_of_many_strays(spark, monkeypatch):
    """A large group whose members differ in common ways: lists within lists, round after round."""
    rng = random.Random(21)
    base = [f"b{i}" for i in range(80)]
    texts = []
    for i in range(300):
        words = list(base)
        for at in rng.sample((8, 20, 33, 47, 60, 71), rng.randrange(0, 5)):  # few places, few spellings: members share their edits
            words[at] = f"e{at}_{rng.randrange(3)}"
        if rng.random() < 0.4:
            words[rng.randrange(80)] = f"own{i}"
        texts.append(" ".join(words))
    monkeypatch.setattr(near_dedup, "HOT", 12)
    monkeypatch.setattr(near_dedup, "SPLIT", 64)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_groups(table(spark, texts)).collect()}
    assert got == brute_near(dict(enumerate(texts)))


def test_rows_without_ids_and_repeated_ids(spark, stored):
    rows = [(None, "one two three four five six seven"), (None, "one two three four five six seven"), (4, "ONE two three four five six seven"), (4, "one  two three four five six seven"), (None, "alone"), (5, "different text of the same id"), (5, "and another one that is longer than that")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    near = near_dedup.near_groups(df).collect()
    assert len(near) == len(rows) and {r.component_id for r in near if r.n_shingles == 3} >= {4} and sum(r.component_id is None for r in near) == 1
    assert sorted((r.doc_id, r.kept) for r in near if r.doc_id == 4) == [(4, True)] * 2
    path = stored(df)
    for name, query in ON_DOCUMENTS.items():
        if name != "op3_packing":
            assert query(spark, path).count() == len(rows), name
    words = spark.createDataFrame([("b", "same text"), ("a", "same  text"), (None, "sametext")], "doc_id string, text string")
    assert {r.keep_id for r in exact_dedup.exact_groups(words).collect()} == {"a"}


def test_very_long_texts(spark, stored):
    """Texts of a megabyte, with and without spaces and line feeds, go through every query whole."""
    rng = random.Random(2)
    prose = " ".join(f"w{rng.randrange(5000)}" for _ in range(150_000))
    texts = [prose, prose.upper(), "x" * 1_000_000, "ab" * 300_000 + "\n" + "ab" * 299_999 + "a", "line\n" * 100_000, "short"]
    path = stored(table(spark, texts))
    got = {name: {r.doc_id: r for r in query(spark, path).collect()} for name, query in ON_DOCUMENTS.items()}
    assert got["op2_near_dedup"][1].component_id == 0 and got["op2_near_dedup"][0].n_shingles > 149_000
    assert got["op10_line_dedup"][3].dropped == "1" and got["op10_line_dedup"][4].n_dropped == 99_999
    assert got["op9_token_counts"][0].n_bytes == len(prose) and all(len(v) == len(texts) for v in got.values())
    for i, t in enumerate(texts):
        assert got["op6_byte_bpe"][i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_queries_against_their_sql(spark):
    """The queries that SQL can express, on a given table, value by value."""
    import duckdb

    path, names = "/root/testdata/sf0.001", queries.oracle_sql()
    db = duckdb.connect()
    for view in ("documents", "embeddings"):
        db.execute(f"create view {view} as select * from '{path}/{view}.parquet'")
    for name, sql in names.items():
        found = queries.queries()[name](spark, path)
        want = db.execute(sql)
        columns = [c[0] for c in want.description]
        assert sorted(map(tuple, found.select(columns).collect())) == sorted(want.fetchall()) and sorted(columns) == sorted(found.columns), name


def test_dropping_forms_pass_columns_named_like_their_own(spark):
    names = ["doc_id", "text", "__len", "__norm", "__prefix", "__gone", "__doc", "__row", "__id", "__hit", "gone", "id"]
    rows = [(i, t, *range(100 * i, 100 * i + 10)) for i, t in enumerate(["same text here\nlast", "same text  here\nlast", "other\nlast", None])]
    df = spark.createDataFrame(rows, ", ".join(f"{n} {'string' if n == 'text' else 'long'}" for n in names))
    for out, left in ((exact_dedup.drop_exact(df), [1, 2, 3]), (near_dedup.drop_near(df), [0, 2, 3]), (line_dedup.drop_lines(df), [0, 1, 2, 3])):
        assert out.columns == names
        got = {r.doc_id: tuple(r)[2:] for r in out.collect()}
        assert got == {i: rows[i][2:] for i in left}


def test_many_findings_in_one_text():
    text = "\n".join(f"password = abcDEF123456{i:07d} key{i}XyzABCDEF99" for i in range(20_000))
    base = secret_scan.base_findings(text)
    others = secret_scan.other_candidates(text, base)
    assert len(base) == 20_000 and len(others) == 20_000
    few = text[:4000]
    base = secret_scan.base_findings(few)
    assert secret_scan.other_candidates(few, base) == [m.span() for m in secret_scan.RUN.finditer(few) if not any(a <= m.start() and m.end() <= b for a, b, _ in base)]


def test_candidates_are_all_long_runs():
    assert [a for a, _ in secret_scan.other_candidates("ABCDEFGHIJKLM abcdefghijklmn short ab+cd/ef=gh.i", [])] == [0, 14, 35]


def joined_rows(spark, since):
    """Rows that joins by list and element made in the session's executions from number since on."""
    store, made = spark._jsparkSession.sharedState().statusStore(), 0
    runs = store.executionsList()
    for run in (runs.apply(i).executionId() for i in range(since, runs.size())):
        counts, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            if "Join" in node.name() and re.search(r"\[value#\d+L?, s#\d+L?\]", node.desc()):
                found = [node.metrics().apply(i) for i in range(node.metrics().size())]
                rows = [counts.get(m.accumulatorId()) for m in found if m.name() == "number of output rows"]
                made += sum(int(r.get().replace(",", "")) for r in rows if r.isDefined())
    return made


def test_near_groups_join_few_rows_of_a_large_group(spark):
    rng = random.Random(8)
    base = " ".join(f"b{i}" for i in range(200))
    texts = [varied(rng, base, rng.randrange(1, 6)) for _ in range(500)]
    since = spark._jsparkSession.sharedState().statusStore().executionsList().size()
    assert near_dedup.near_groups(table(spark, texts)).count() == 500
    assert joined_rows(spark, since) < 20 * 500  # the counts of elements, joined to their entries, made some 200 a member


def test_all_labelled_findings_are_learned_from(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {row for r in docs.collect() for row in secret_scan._labelled(r.text or "")}
    got = [tuple(r) for r in secret_scan.labelled_findings(docs).collect()]
    assert len(got) == len(want) > 4 * secret_scan.SAMPLE and set(got) == want  # at most SAMPLE of each label before


def test_calibration_by_sums_equals_the_plain_one(spark, monkeypatch):
    rng = np.random.default_rng(2)
    y = (rng.random(12_000) < 0.95).astype(float)
    logit = np.round(rng.normal(3 * y, 1.5), 3)
    judged = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, logit, strict=True)], "y double, logit double")
    plain, summed = secret_scan.fit([], []), secret_scan.fit([], [])
    monkeypatch.setattr(secret_scan, "_logits", lambda net, x: logit)
    secret_scan._calibrate(plain, None, y)
    secret_scan._calibrate_all(summed, judged)
    assert np.allclose([plain.scale, plain.offset, plain.threshold], [summed.scale, summed.offset, summed.threshold], atol=1e-4)
    assert plain.report["recall"] == summed.report["recall"] and plain.report["false_alarms"] == summed.report["false_alarms"]


def test_steps_in_single_precision_go_down_the_slope():
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 98, (64, 80)), np.repeat([0.0, 1.0], 32)
    numbers = [rng.normal(0, 0.3, shape) for shape in ((98, 8), (40, 16), 16, 64)] + [0.1]
    double, single = secret_scan.Network(*map(np.array, numbers)), secret_scan._network(*numbers)
    loss = lambda: float(np.logaddexp(0, np.where(y > 0, -1, 1) * double.forward(x)[4]).mean())
    slopes = {}
    for k in secret_scan.NUMBERS[:-1]:
        part = getattr(double, k)
        place = (40,) * (k == "embedding") + (3,) * (part.ndim if k != "embedding" else 1)
        was, sides = part[place], []
        for by in (1e-6, -1e-6):
            part[place] = was + by
            sides.append(loss())
        part[place] = was
        slopes[k] = (place, (sides[0] - sides[1]) / 2e-6)
    for net, near in ((double, 1e-4), (single, 1e-2)):
        take = secret_scan._Steps(net, 0.001)
        take(x, y)
        assert all(abs(take.first[k][place] / 0.1 - slope) <= near * abs(slope) + 1e-6 for k, (place, slope) in slopes.items())
    assert single.forward(x)[1].dtype == single.filters.dtype == np.float32  # double before
    held = secret_scan._ROOM["runs", single.filters.dtype]
    secret_scan._Steps(single, 0.001)(x, y)
    assert secret_scan._ROOM["runs", single.filters.dtype] is held  # taken anew at each step before


def generated_rows(spark, since):
    """Rows made by generators in the executions from that one on."""
    store, made = spark._jsparkSession.sharedState().statusStore(), 0
    for at in range(since, store.executionsList().size()):
        execution = store.executionsList().apply(at).executionId()
        values, nodes = store.executionMetrics(execution), store.planGraph(execution).allNodes()
        for node in [nodes.apply(i) for i in range(nodes.size())]:
            if node.name() == "Generate":
                rows = [values.get(node.metrics().apply(i).accumulatorId()) for i in range(node.metrics().size()) if "output rows" in node.metrics().apply(i).name()]
                made += sum(int(r.get().replace(",", "")) for r in rows if r.isDefined())
    return made


def test_long_lists_of_texts_that_share_only_a_passage(spark):
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(60))
    sets, members = [], []
    for i in range(120):
        texts = passage + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(140))
        sets.append((i, [int(h) for h in near_dedup.Shingler().hashes(texts)]))
        members.append((7, i, 120))
    sets.append((120, sets[5][1][:-2]))  # one near pair
    members = spark.createDataFrame([(v, r, 121) for v, r, _ in [*members, (7, 120, 0)]], "value long, rep long, m long")
    since = spark._jsparkSession.sharedState().statusStore().executionsList().size()
    links, more, longer = near_dedup._hot_pairs(members, spark.createDataFrame(sets, "rep long, shingles array<long>"), 85)
    met = {(r.a, r.b) for r in more.collect()} | {(min(r.a, r.b), max(r.a, r.b)) for r in links.collect()}
    assert (5, 120) in met and longer.isEmpty()
    assert generated_rows(spark, since) < 40 * 121  # some 400 a member before: every element of every difference, twice
