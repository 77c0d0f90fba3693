"""Each operator against brute force on whole small tables, and on odd rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from glosswright.llm import bpe, codec, embedding_dedup, exact_dedup, jaccard_join, licenses, packing, repeat_removal, token_counts, token_files, toxicity
from glosswright.llm.common import components
from glosswright.llm.run_index import RunIndex

DATA = "/root/testdata/sf0.001"
WORD_FILE, BYTE_FILE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
PASSAGE = "a passage of well over fifty bytes that several of these documents have in common, word by word"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, name string, rank int, sha string, n int, member int, rest string, starts string, text_utf8 string"


def _texts():
    base = " ".join(f"word{i % 37} thing{i % 11}" for i in range(120))
    rows = [(i, base + f" tail{i}") for i in range(6)]
    rows += [(10, PASSAGE), (11, "before " + PASSAGE + " after"), (12, PASSAGE + PASSAGE), (13, "é" * 40 + PASSAGE)]
    rows += [(20, "Same text"), (21, "same Text"), (22, "Same  text\n"), (23, "Same text"), (None, "Same text"), (24, None), (25, ""), (26, " \n\t")]
    rows += [(30, "x" * 30000), (31, "x" * 200), (40, "Released under the MIT License."), (41, "You are an idiot, a stupid clown."), (42, "<|endoftext|> a<|startoftext|>b  c ")]
    rows += [(20, "Same text"), (50, "one two three"), (51, "one two three"), (52, "one two")]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "s", len(t or ""), "n", 1, "h", 2, 3, "r", "q", "u") for i, t in _texts()]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def _ids(path, texts):
    return [x.ids for x in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def _pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("path", [WORD_FILE, BYTE_FILE])
@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aab éßÅΣİ中😀́   \n\t\x1c1'slLtre.,!<|>", max_size=40))
def test_encoder_is_the_library(path, text):
    got = next(bpe.encoder(path).encode([text.encode()]))
    assert np.frombuffer(got, "<u4").tolist() == _ids(path, [text])[0]


@pytest.mark.parametrize("path", [WORD_FILE, BYTE_FILE])
@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|", "|>", " ", "  ", "\u00a0", "\u2003", "\n", "foo", "Bar's", "é", "“", "”", ",", "42", "²", "中", "\u0301", "don't"]), max_size=9).map("".join), max_size=4))
def test_encoder_is_the_library_on_wide_spaces_and_marks(path, texts):
    got = bpe.encoder(path).encode([t.encode() for t in texts])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == _ids(path, texts)


def test_what_the_encoder_keeps_is_bounded():
    enc = bpe.TextEncoder(BYTE_FILE)
    for k in range(4):
        list(enc.encode([b" ".join(b"%d\xc2\xa0w%d" % (i, k) for i in range(40_000)) + b"\xc2\xa0" * 1000 for _ in range(3)]))
        assert sum(map(len, enc.new)) <= enc.KEPT + 8 * enc.BLOCK
    assert len(enc.new) > 1000


def test_speculation_and_exact_merging_agree():
    b = bpe.encoder(BYTE_FILE).bpe
    words = [w.encode() for w in "the lower newest international aaaaaaaaaaaa zzz thththth reer".split()]
    flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
    exact, n = b._merge_exactly(b.base[flat], np.array([len(w) for w in words]))
    got, counts = b.encode(words)
    assert got.tolist() == exact.tolist() and counts.tolist() == n.tolist()


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_codec(which, request):
    df = request.getfixturevalue(which)
    rows = _pairs(df)
    t = Tokenizer.from_file(WORD_FILE)
    want = Counter()
    for (i, _), ids in zip(rows, _ids(WORD_FILE, [x for _, x in rows]), strict=True):
        want[(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in codec.round_trip_digests(df, WORD_FILE).collect()) == want


def test_encode_texts(odd):
    got = {r["doc_id"]: (np.frombuffer(r["ids"], "<u4").tolist(), bytes(r["decoded"]).decode()) for r in codec.encode_texts(odd, WORD_FILE).collect()}
    tok = Tokenizer.from_file(WORD_FILE)
    want = {i: (ids, tok.decode(ids, skip_special_tokens=False)) for (i, _), ids in zip(_pairs(odd), _ids(WORD_FILE, [t for _, t in _pairs(odd)]), strict=True)}
    assert got == want
    assert all(r["decoded"] is None for r in codec.encode_texts(odd, BYTE_FILE, decode=False).collect())


def test_token_files_keep_any_identifier(spark, tmp_path):
    rows = [(-(1 << 63), "a b"), (None, "c"), ((1 << 63) - 1, None), (0, "")]
    token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), f"file://{tmp_path}/t", BYTE_FILE, 0)
    got = token_files.read_token_files(spark, f"file://{tmp_path}/t").orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, -(1 << 63), 0, (1 << 63) - 1]


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_packing(which, request):
    df = request.getfixturevalue(which)
    rows = packing.pack_documents(df, WORD_FILE, 1, 256).collect()
    texts = _pairs(df)
    want = Counter()
    for (i, _), ids in zip(texts, _ids(WORD_FILE, [x for _, x in texts]), strict=True):
        ids = [*ids, 1]
        for k, at in enumerate(range(0, len(ids), 256)):
            want[(i, k, at, len(ids[at : at + 256]), _crc(ids[at : at + 256]))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(by) <= -(-sum(r["length"] for r in rows) // 256) * 1.03 + 1


def test_fullest_is_the_fullest():
    rng = np.random.default_rng(3)
    for _ in range(60):
        counts = {int(k): int(v) for k, v in zip(rng.integers(2, 40, 6), rng.integers(1, 3, 6), strict=True)}
        room = int(rng.integers(1, 90))
        sums = {0}
        for k, v in counts.items():
            sums = {s + k * n for s in sums for n in range(v + 1)}
        used = packing.fullest(counts, sorted(counts, reverse=True), room)
        assert sum(k * n for k, n in used.items()) == max(s for s in sums if s <= room)
        assert all(n <= counts[k] for k, n in used.items())


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_token_files(which, request, spark, tmp_path):
    df = request.getfixturevalue(which)
    path = f"file://{tmp_path}/t"
    token_files.write_token_files(df, path, BYTE_FILE, 0, block_ids=500)
    rows = sorted(_pairs(df), key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    want, at = [], 0
    for (i, _), ids in zip(rows, _ids(BYTE_FILE, [x for _, x in rows]), strict=True):
        ids = [*ids, 0]
        want.append((i, at, len(ids), _crc(ids)))
        at += len(ids)
    got = sorted((tuple(r) for r in token_files.read_token_files(spark, path).collect()), key=lambda r: r[1])
    assert got == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300_000), max_size=60))
def test_id_codes(ids):
    a = np.array(ids, np.uint32)
    if len(a):
        assert token_files.unpack_ids(len(a), *token_files.pack_ids(a)).tolist() == ids


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_token_counts(which, request):
    df = request.getfixturevalue(which)
    costs, byte = token_counts.piece_costs(public_tokenizers.path("piece_bpe_32k.model"))

    def tokens(word):
        text, best = "▁" + word, [0]
        for i, c in enumerate(text, 1):
            ways = [best[j] + costs[text[j:i]] for j in range(i) if text[j:i] in costs]
            best.append(min([*ways, best[-1] + byte * len(c.encode())]))
        return best[-1] & (1 << token_counts.COUNT_BITS) - 1

    rows = [(i, t) for i, t in _pairs(df) if len(t or "") < 3000]
    memo = {}
    want = Counter()
    for i, t in rows:
        words = [w.decode() for w in (t or "").encode().split()]
        want[(i, len(words), sum(memo.setdefault(w, tokens(w)) for w in words if len(w) < 3000))] += 1
    got = Counter(tuple(r) for r in token_counts.count_tokens(df.where("length(coalesce(text, '')) < 3000"), public_tokenizers.path("piece_bpe_32k.model")).collect())
    assert got == want


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_exact_dedup(which, request):
    df = request.getfixturevalue(which)
    rows, groups = _pairs(df), {}
    norm = lambda t: re.sub("[\x20\x09-\x0d]", "", t or "")
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i))
    want = Counter()
    for i, t in rows:
        g = groups[norm(t)]
        keep = min(g, key=lambda x: (x[0], x[1], x[2] or 0))[2]
        want[(i, keep, len(g), i == keep, hashlib.sha256(norm(t).encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in exact_dedup.duplicate_groups(df).collect()) == want
    left = exact_dedup.without_duplicates(df)
    assert left.columns == df.columns
    assert Counter(norm(r["text"]) for r in left.collect()) == Counter(groups.keys())


def _jaccard(rows, k, percent):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    sets = []
    for i, t in rows:
        w = re.findall("[^ \t-\r]+", low(t))
        sets.append((i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())))
    up = {i: i for i, _ in sets if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, r in sets[:a]:
            if i is not None and j is not None and s and r and 100 * len(s & r) >= percent * len(s | r):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return Counter((i, len(s), None if i is None else find(i)) for i, s in sets)


@pytest.mark.parametrize("which,k,percent", [("odd", 4, 85), ("odd", 2, 50), ("docs", 4, 85), ("docs", 5, 80)])
def test_jaccard_join(which, k, percent, request):
    df = request.getfixturevalue(which)
    got = jaccard_join.jaccard_components(df, k, percent)
    assert Counter(tuple(r) for r in got.collect()) == _jaccard(_pairs(df), k, percent)


def test_jaccard_blocks_of_a_large_component(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 5)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[: 40 + i % 20] + [f"own{i}"])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in jaccard_join.jaccard_components(df, 2, 85).collect()) == _jaccard(rows, 2, 85)


def test_sets_of_one_name_keep_their_links(docs, monkeypatch):
    monkeypatch.setattr(jaccard_join, "NAME", 1)
    part = docs.where("n_chars < 1500")
    assert Counter(tuple(r) for r in jaccard_join.jaccard_components(part, 4, 85).collect()) == _jaccard(_pairs(part), 4, 85)


def test_hot_groups_of_copies(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_GROUPS", 4)
    monkeypatch.setattr(exact_dedup, "LEAST_HOT", 3)
    rows = [(i, "common  text" if i % 3 == 0 else f"text {i // 4}") for i in range(60)] + [(None, "common text")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.duplicate_groups(df).collect()}
    assert len(got) == 61 and got[None] == (0, 21) and all(got[i] == (0, 21) for i in range(0, 60, 3))
    assert got[4] == (4, 3) and got[1] == (1, 2)


def test_prefix_tree_counts_exactly():
    rng = np.random.default_rng(5)
    base = np.sort(rng.choice(10_000, 120, replace=False)).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, 110, replace=False), rng.integers(0, 10_000, 8).astype(np.uint64)])) for _ in range(30)]
    tree = jaccard_join.PrefixTree(sets, 80)
    for x in range(30):
        want = {y for y in range(30) if y != x and 100 * len(np.intersect1d(tree.sets[x], tree.sets[y])) >= 80 * len(np.union1d(tree.sets[x], tree.sets[y]))}
        assert set(tree.matches(x, np.array([y for y in range(30) if y != x]))) == want


def _repeats(rows, n):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - n + 1) if i is not None else ():
            w = b[p : p + n]
            first[w] = min(first.get(w, i), i)
    out = Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1) if i is not None else ():
            if first[b[p : p + n]] < i:
                gone[p : p + n] = b"\1" * n
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[(i, len(b), sum(gone), sum(1 for x in bytes(gone).split(b"\0") if x), hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_repeat_removal(which, request):
    df = request.getfixturevalue(which)
    assert Counter(tuple(r) for r in repeat_removal.removal_digests(df, 50).collect()) == _repeats(_pairs(df), 50)


def test_repeat_removal_of_hot_minimisers(spark, monkeypatch):
    monkeypatch.setattr(repeat_removal, "HOT", 3)
    monkeypatch.setattr(repeat_removal, "HEAVY", 2)
    monkeypatch.setattr(repeat_removal, "HELD", 3000)
    monkeypatch.setattr(repeat_removal, "CHUNK", 2000)
    rng = np.random.default_rng(2)
    common = bytes(rng.integers(97, 123, 70, np.uint8)).decode()
    texts = [bytes(rng.integers(97, 99 + k % 24, k % 90, np.uint8)).decode() + common[k % 3 :] * (1 + k % 2) + "ab" * (k % 50) for k in range(120)]
    df = spark.createDataFrame([((7 * k) % 110, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    assert Counter(tuple(r) for r in repeat_removal.removal_digests(df, 50).collect()) == _repeats(_pairs(df), 50)


def test_equal_hashes_are_compared():
    data = np.frombuffer(b"abcabdabcabd", np.uint8)
    size = np.full(4, 3)
    order, owner = repeat_removal.equal_segments(data, np.arange(4) * 3, size, np.zeros(4, np.uint64), np.array([5, 6, 7, 8]), np.zeros(4, np.int64))
    assert all(bytes(data[3 * i : 3 * i + 3]) == bytes(data[3 * j : 3 * j + 3]) and j <= i for i, j in zip(order.tolist(), owner.tolist(), strict=True))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=30).map(lambda b: bytes(c % 3 + 97 for c in b)), min_size=1, max_size=25), st.integers(1, 12))
def test_run_index_finds_the_first_place(pieces, context):
    index = RunIndex(np.frombuffer(b"".join(pieces), np.uint8), np.array([len(p) for p in pieces]), context)
    text, got = b"\0".join(pieces) + b"\0", index.witnesses().tolist()
    for p in range(len(text) - context):
        window = text[p : p + context + 1]
        if b"\0" not in window:
            assert got[p] == text.index(window)


def test_repeat_removal_cuts_only_minimisers_that_would_fill_a_chunk(spark):
    """3,000 different segments around one passage are some 200 KB; as single windows they were ten times as many."""
    rng = np.random.default_rng(7)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    word = lambda n: "".join(letters[rng.integers(0, 26, n)])
    rows = [(i, hash(i), (word(40) + " all of these are in one long row " + word(40)).encode()) for i in range(3_000)]
    docs = spark.createDataFrame(rows, "doc_id long, th long, text binary").coalesce(1)
    filters = spark.sparkContext.broadcast(repeat_removal.shared_filters(docs, 50))
    sent = repeat_removal.segments(docs, 50, filters).agg(F.sum("n")).first()[0]
    assert 3_000 <= sent < 9_000


def test_segments_in_blobs():
    rng = np.random.default_rng(3)
    size = rng.integers(50, 70, 40)
    data, begin = rng.integers(0, 256, int(size.sum())).astype(np.uint8), np.cumsum(size) - size
    doc, th, place, group = (rng.integers(0, 1 << b, 40) for b in (40, 60, 30, 32))
    order, first = rng.permutation(40), np.array([0, 7, 8, 30])
    raw = list(repeat_removal.packed(doc[order], th[order], place[order], size[order], group[order], data, begin[order], first))
    for blob, s in zip(raw, np.split(order, first[1:]), strict=True):
        *planes, content = repeat_removal.unpacked(blob, len(s))
        assert [p.tolist() for p in planes] == [x[s].tolist() for x in (doc, th, place, size, group)]
        assert content.tobytes() == b"".join(data[a : a + n].tobytes() for a, n in zip(begin[s], size[s], strict=True))


def test_repeat_removal_any_column_names(spark):
    names = ["_th", "_utf8", "_id", "row", "utf8", "marked", "th", "start", "text_utf8"]
    base = spark.createDataFrame([(1, PASSAGE), (2, "x" + PASSAGE), (3, None)], "doc_id long, text string")
    df = base.select("*", *(F.lit(k).alias(n) for k, n in enumerate(names)))
    left = repeat_removal.without_repeats(df, 50)
    assert left.columns == df.columns
    assert {r["doc_id"]: (r["text"], [r[n] for n in names]) for r in left.collect()} == {1: (PASSAGE, list(range(9))), 2: ("x", list(range(9))), 3: (None, list(range(9)))}


def test_repeat_removal_keeps_columns_and_characters(odd):
    left = repeat_removal.without_repeats(odd, 50)
    assert left.columns == odd.columns and left.count() == odd.count()
    got = {r["doc_id"]: r["text"] for r in left.collect()}
    assert got[11] == "before  after" and got[13] == "é" * 40 and got[10] == PASSAGE and got[24] is None


@pytest.mark.parametrize("cut", [0, 1])
def test_full_filter_changes_nothing(docs, monkeypatch, cut):
    full = zlib.compress(b"\xff" * (1 << repeat_removal.FILTER_BITS - 3), 1)
    hot = np.arange((1 << repeat_removal.HOT_BITS) * cut, dtype="<i4").tobytes()
    monkeypatch.setattr(repeat_removal, "shared_filters", lambda rows, length: [(0, full, hot)])
    part = docs.where("n_chars < 2000")
    assert Counter(tuple(r) for r in repeat_removal.removal_digests(part, 50).collect()) == _repeats(_pairs(part), 50)


def _vectors():
    rng = np.random.default_rng(7)
    rows = []
    for k in range(300):
        v = rng.normal(size=16)
        rows.append((k, v.tolist(), k % 3))
        if k % 4 == 0:
            w = v + rng.normal(size=16) * rng.uniform(0.05, 0.5) * np.linalg.norm(v) / 4
            rows.append((1000 + k, w.tolist(), k % 3))
        if k % 10 == 0:
            rows.append((2000 + k, v.tolist(), k % 3))
            rows.append((3000 + k, v.tolist(), (k + 1) % 3))
    hub = rng.normal(size=16)
    rows += [(5000 + k, (hub + rng.normal(size=16) * 0.05).tolist(), 1) for k in range(80)]
    rows += [(9000, None, 1), (9001, [0.0] * 16, 1), (9002, [float("nan")] * 16, 1), (9003, [None] * 16, 1), (9004, rows[0][1], None), (9005, [1.0, 2.0], 1), (9006, [2.0, 4.0], 1), (9007, [], 1)]
    return rows


@pytest.mark.parametrize("block", [1024, 16])
def test_near_duplicate_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rows = _vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    ok = [(i, np.array(v), c) for i, v, c in rows if v and c is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i, _, _ in rows}
    for a, (i, v, c) in enumerate(ok):
        for j, w, d in ok[:a]:
            if c == d and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.93:
                links[i].add(j)
                links[j].add(i)
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicate_vectors(df, 0.93).collect()}
    found, total = sum(r["n_links"] for r in got.values()), sum(map(len, links.values()))
    assert found <= total and found >= 0.995 * total
    assert all(got[i]["n_links"] <= len(links[i]) for i in links)
    if found == total:
        for i in links:
            seen, todo = {i}, [i]
            while todo:
                new = links[todo.pop()] - seen
                seen |= new
                todo += new
            assert got[i]["component_id"] == min(seen) and got[i]["kept"] == (min(seen) == i)


def test_toxicity_learns_and_scores(spark, docs, odd):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = toxicity.score_documents(odd, toxicity.train(docs, labels)).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    said, denied, reported, quoted, clean = toxicity.Grammar(toxicity.Model()).features([b"You are an idiot.", b"You are not an idiot.", b"He said you are an idiot.", b'Then "what an idiot" rang.', b"A quiet day."])
    assert said[0] > 0 and said[2] > 0 and denied[0] == 0 and denied[3] > 0 and reported[0] == 0 and reported[4] > 0 and quoted[4] > 0 and not clean.any()
    threat, far, plain = toxicity.Grammar(toxicity.Model()).features([b"I will hurt you.", b"I will hurt myself, and then you.", b"You may not hurt her."])
    assert threat[5] > 0 and not far.any() and plain[5] == 0


def _clauses(tape):
    """The features by plain rules, clause by clause, without any automaton."""
    plain, strongest, aimed, negated, reported, threats = 0.0, 0.0, 0.0, 0.0, 0.0, 0
    for sentence in tape.split("."):
        told = quoted = False
        for clause in sentence.split(","):
            words, mass = [], [0.0, 0.0, 0.0]
            for a in clause:
                if a in "Qq":
                    quoted = a == "Q"
                    continue
                no = "N" in [w for w, _ in words[-3:]]
                marked = told or quoted
                words.append((a, no or marked))
                if a in "abcdefgh":
                    mass[1 if no else 2 if marked else 0] += (ord(a) - 96) / 8
                told = told or a == "R"
            target = any(w == "T" for w, _ in words)
            threats += any(v == "H" and not m and any(w == "T" for w, _ in words[max(0, i - 4) : i + 5]) for i, (v, m) in enumerate(words))
            plain, negated, reported = plain + mass[0], negated + mass[1], reported + mass[2]
            strongest, aimed = max(strongest, mass[0]), aimed + mass[0] * target
    return [np.log1p(plain), min(strongest, 2.0), np.log1p(aimed), np.log1p(negated), np.log1p(reported), np.log1p(threats)]


@settings(max_examples=500, deadline=None)
@given(st.text("_,.TNRQqHah", max_size=60))
def test_composed_automaton_against_plain_rules(tape):
    got = toxicity.path_weights(tape)
    want = _clauses(tape)
    if "T" in tape and "H" in tape:  # the automaton keeps the nearer of a verb and a target only
        got, want = got[:5], want[:5]
    assert got == pytest.approx(want)


@settings(max_examples=300, deadline=None)
@given(st.text("_TH", max_size=14))
def test_threats_need_a_target_within_reach(words):
    near = any({words[i], words[j]} == {"T", "H"} for i in range(len(words)) for j in range(i + 1, min(len(words), i + 1 + toxicity.REACH)))
    assert (toxicity.path_weights(words)[5] > 0) == near


def test_toxicity_is_a_function_of_the_rows(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    clash = docs.select("*", F.lit(1).alias("y"), F.lit(2).alias("sha"), F.lit("x").alias("score"), F.lit("z").alias("pattern"))
    one = toxicity.train(docs.repartition(1), labels)
    assert one == toxicity.train(docs.repartition(16), labels.repartition(7)) == toxicity.train(clash, labels)
    again = docs.union(docs.withColumn("source", F.lit("copy")))
    assert one == toxicity.train(again, labels.union(labels))


def test_toxicity_odd_rows(spark, odd):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (5, None), (6, 1), (6, 0)], "doc_id long, toxic int")
    model = toxicity.train(odd, labels)
    got = toxicity.score_documents(odd, model).collect()
    assert len(got) == odd.count() and not any(r["held_out"] for r in got if r["doc_id"] is None)
    assert toxicity.without_toxic(odd, model).columns == odd.columns


def test_cues_are_learned(spark):
    rows = [(f"we saw zorp idiot here {k}, and some other words went by {k}.".encode(), 1) for k in range(40)]
    rows += [(f"it was hardly an idiot thing {k}, and some other words went by {k}.".encode(), 0) for k in range(40)]
    cues = toxicity.learn_cues(spark.createDataFrame(rows, "text binary, y int").repartition(3), {"idiot": 4.0})
    assert cues.get("zorp") == "T" and cues.get("hardly") == "N" and "words" not in cues


def test_toxicity_held_out_accuracy(spark):
    base = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    scored = toxicity.score_documents(docs, toxicity.train(docs, labels)).join(labels, "doc_id").where("held_out")
    n = {(r["toxic"], r["predicted"]): r["count"] for r in scored.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.9 and n[1, 1] / (n[1, 1] + n.get((0, 1), 0)) > 0.9


def test_licenses(spark, docs):
    templates = {"T": [" ".join(f"term{i}" for i in range(30))]}
    t = templates["T"][0].split()
    noise = [f"n{i}" for i in range(50)]
    rows = [(1, " ".join(noise + t + noise)), (2, " ".join(noise + t[:15] + ["odd"] + t[16:])), (3, " ".join(t[:12])), (4, None), (5, ""), (6, " ".join(noise))]
    got = {r["doc_id"]: r["containment"] for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), templates).collect()}
    assert got == {1: 1.0, 2: round(21 / 26, 6)}
    want = {(i, n) for i, x in _pairs(docs) for n, v in licenses.TEMPLATES.items() for p in v if p.lower() in (x or "").lower()}
    assert want <= {(r["doc_id"], r["license"]) for r in licenses.scan_licenses(docs).collect()}


def test_licenses_on_odd_rows(spark, odd):
    text = next(iter(licenses.TEMPLATES.values()))[0]
    rows = [(1, text), (1, text), (None, text), (2, None), (3, ""), (4, "word " * 20000 + text), (5, text[: len(text) // 3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit(1).alias(c) for c in ("license", "containment", "window")))
    got = Counter(r["doc_id"] for r in licenses.scan_licenses(df).collect() if r["containment"] == 1.0)
    assert got[1] == 2 * got[2 + 2] and got[None] == got[4] >= 1 and 2 not in got and 3 not in got
    assert licenses.scan_licenses(odd).count() >= 1


def test_token_counts_of_long_texts(spark):
    rows = [(k, " ".join(f"Wörd{i * k % 97}x{i % 13}" for i in range(4000))) for k in range(1, 4)] + [(9, "y" * 50000), (None, "a a"), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("n_words"), F.lit(2).alias("score"))
    got = Counter(tuple(r) for r in token_counts.count_tokens(df, public_tokenizers.path("piece_bpe_32k.model")).collect())
    one = token_counts.ForwardTrie(*token_counts.piece_costs(public_tokenizers.path("piece_bpe_32k.model")))
    want = Counter()
    for i, t in rows:
        words = (t or "").encode().split()
        want[(i, len(words), sum(next(one.counts([w]))[1] for w in words))] += 1
    assert got == want


def test_near_duplicate_vectors_odd_rows(spark):
    v = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]
    rows = [(1, v, 1), (1, v, 1), (2, [2 * x for x in v], 1), (3, v, 2), (None, v, 1), (4, None, 1), (5, v, None), (6, [*v[:7], float("nan")], 1), (7, [], 1), (8, [0.0] * 8, 1), (9, v[:7], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").select("*", *(F.lit(0).alias(c) for c in ("v", "cid", "n", "cell", "part", "side", "links")))
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0) for r in embedding_dedup.near_duplicate_vectors(df).collect())
    assert got == [(0, 0, 0), (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 0, 8), (9, 0, 9)]


def test_near_duplicate_vectors_of_the_table(spark):
    path = "/root/testdata/sf0.1/embeddings.parquet"
    rows = [(r["vec_id"], r["label"], r["embedding"]) for r in spark.read.parquet(path).collect()]
    wide = spark.read.parquet(path)
    near = wide.where("vec_id % 50 = 0").select((F.col("vec_id") + 1_000_000).alias("vec_id"), F.transform("embedding", lambda x: x + F.lit(0.01).cast("float")).alias("embedding"), "label")
    rows += [(r["vec_id"], r["label"], r["embedding"]) for r in near.collect()]
    unit = {i: np.array(v, float) / np.linalg.norm(np.array(v, float)) for i, _, v in rows if v is not None and np.linalg.norm(np.array(v, float))}
    links = Counter()
    for label in {y for _, y, _ in rows if y is not None}:
        ids = np.array([i for i, y, _ in rows if y == label and i in unit])
        if len(ids):
            m = np.stack([unit[i] for i in ids])
            for a, b in zip(*np.nonzero(np.triu(m @ m.T >= 0.93, 1)), strict=True):
                links[int(ids[a])] += 1
                links[int(ids[b])] += 1
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicate_vectors(wide.select("vec_id", "embedding", "label").unionByName(near)).collect()}
    assert len(got) == len(rows) and sum(links.values()) > 0
    assert all(n <= links[i] for i, n in got.items()) and sum(got.values()) >= 0.99 * sum(links.values())


def test_components(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 200), (200, 150), (7, 7), (None, 3)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys((100, 150, 200), 100)}


def test_empty_tables(spark, docs, tmp_path):
    none = docs.where(F.lit(False))
    assert codec.round_trip_digests(none, WORD_FILE).count() == 0
    assert packing.pack_documents(none, WORD_FILE).count() == 0
    assert exact_dedup.duplicate_groups(none).count() == 0
    assert jaccard_join.jaccard_components(none).count() == 0
    assert repeat_removal.removal_digests(none).count() == 0
    assert licenses.scan_licenses(none).count() == 0
    assert token_counts.count_tokens(none, public_tokenizers.path("piece_bpe_32k.model")).count() == 0
    token_files.write_token_files(none, f"file://{tmp_path}/e", BYTE_FILE, 0)
    assert token_files.read_token_files(spark, f"file://{tmp_path}/e").count() == 0
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    assert toxicity.score_documents(none, toxicity.train(none, labels.where(F.lit(False)))).count() == 0
    vectors = spark.read.parquet(f"{DATA}/embeddings.parquet").where(F.lit(False))
    assert embedding_dedup.near_duplicate_vectors(vectors).count() == 0
