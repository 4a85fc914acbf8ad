"""Corpus operators on awkward rows and against brute force."""

from __future__ import annotations

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

import public_tokenizers
from rerunlab.llm import bpe, exact_dedup, packing, pii, sharding, simhash, suffix, tokenfile, topk, toxicity, vocab

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that the operators use themselves
        *(T.StructField(n, T.StringType()) for n in ("rid", "name", "kept", "score", "found", "fp", "_hash", "pos", "component", "length")),
    ]
)
#: All code points of the planes in everyday use, and every 97th of the others.
CODES = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and (c < 0x20000 or c % 97 == 0)]
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 99)) * r.randint(0, 1) for _ in range(n))


def frame(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, None if k % 3 == 0 else "en", None, None, *["x"] * 10) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def awkward(spark):
    long = prose(1, 30_000)
    texts = [None, "", " ", "a", "a", "A", "é ß 漢字 😀", "ǅ Σας ΟΔΟΣ", "<|endoftext|> x", "x\x00y", "tab\tnew\nline\r\n", long, long + " end", "mail me@x.example.org or 10.0.0.1", prose(2, 80), prose(2, 80) + " more", "a" * 5000, "-" * 300, "", None]
    ids = [*range(len(texts) - 3), 3, 3, None]
    return frame(spark, texts, ids).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def pairs(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def test_exact_dedup(awkward, empty):
    got = exact_dedup.exact_groups(awkward, block_bytes=64).collect()
    rows = pairs(awkward)
    by_text = collections.defaultdict(list)
    for i, t in rows:
        by_text[t].append(i)
    assert len(got) == len(rows)
    want = collections.Counter((i, max((x for x in by_text[t] if x is not None), default=None), len(by_text[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
    assert collections.Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(by_text)
    kept = exact_dedup.drop_exact_copies(awkward)
    assert kept.columns == awkward.columns and kept.count() == len(by_text)
    assert exact_dedup.exact_groups(empty).collect() == []


@pytest.mark.parametrize("size", [4, 4096])
def test_exact_dedup_hot_block(spark, size):
    """Blocks and pairs with over a thousandth of all rows are dealt over tasks and still get one name."""
    texts = ["same text here"] * 1500 + [prose(i, 5) for i in range(60)]
    got = exact_dedup.exact_groups(frame(spark, texts), block_bytes=size).collect()
    assert sum(r["kept"] for r in got) == len(set(texts))
    assert max(r["group_size"] for r in got) == 1500


def brute_shard(key: str, shards: int) -> int:
    def pick(name, weights):
        draws = []
        for i, w in enumerate(weights):
            if w > 0:
                bits = xxhash.xxh64_intdigest(f"{key}|{name}.{i}", 42) >> 12
                draws.append((-np.log((bits + 0.5) / 2.0**52) / w, i))
        return min(draws)[1]

    root = sharding.tree(shards)
    g = pick("t", [c.weight for c in root.children])
    racks = max(len(c.children) for c in root.children)
    k = pick(f"t.{g}", [c.weight for c in root.children[g].children] + [0.0] * (racks - len(root.children[g].children)))
    leaves = root.children[g].children[k].children
    return leaves[pick(f"t.{g}.{k}", [c.weight for c in leaves])].shard


def test_sharding(spark, awkward, empty):
    docs = frame(spark, ["t"] * 3000)
    rows = sharding.shard_table(docs).collect()
    assert all(r["grown_shard"] in (r["shard"], 40) for r in rows)
    for r in rows[:150]:
        assert (r["shard"], r["grown_shard"]) == (brute_shard(str(r["doc_id"]), 40), brute_shard(str(r["doc_id"]), 41))
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) == set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    some = sharding.shard_table(awkward).collect()
    want = collections.Counter((i, len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in pairs(awkward))
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in some) == want
    assert sharding.shard_table(empty).collect() == []


def test_topk(spark):
    r = random.Random(3)
    rows = [(i, [r.choice([-1.0, -0.5, 0.0, 0.25, 1.0, 0.3]) for _ in range(6)]) for i in range(400)]
    rows += [(1000, None), (1001, [None] * 6), (1002, [float("nan")] * 6), (1003, [float("inf")] * 6), (1100, [1.0, 2.0]), (7, rows[7][1]), (8, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.top_k(df, df.where("vec_id % 100 = 0"), 10).collect()
    good = [(i, np.floor(1024 * np.array(v, np.float32).astype(float))) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, v in good:
        if q % 100 == 0:
            s = sorted(((-int(v @ w), i) for i, w in good if i != q and len(w) == len(v)))[:10]
            want += [(q, k + 1, i, -x) for k, (x, i) in enumerate(s)]
    assert sorted((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in got) == sorted(want)
    assert topk.top_k(df.limit(0), df.limit(0)).collect() == []


def test_simhash(spark, awkward, empty):
    base = prose(5, 400).split()
    texts = [t for _, t in pairs(awkward)]
    for i in range(60):
        w = list(base)
        w[i * 3] = "changed"
        texts.append(" ".join(w))
    docs = frame(spark, texts)
    got = {r["doc_id"]: r for r in simhash.near_groups(docs).collect()}
    fps = np.array([simhash.fingerprint(t.encode()) for t in texts], np.uint64)
    for t, f in zip(texts[:30], fps, strict=False):
        w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t)) if x]
        sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        assert int(f) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= 3):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    assert {i: r["component_id"] for i, r in got.items()} == {i: find(i) for i in range(len(texts))}
    assert simhash.near_groups(empty).collect() == []
    assert simhash.near_groups(awkward).count() == awkward.count()
    assert simhash.drop_near_copies(docs).count() == len({find(i) for i in range(len(texts))})


@pytest.mark.parametrize("blocks", [4, 5, 6])
def test_simhash_links_by_chunks(spark, blocks, monkeypatch):
    """Buckets past SMALL are compared by chunks and lose no link."""
    monkeypatch.setattr(simhash, "SMALL", 4)
    monkeypatch.setattr(simhash, "CHUNK", 16)
    r = random.Random(9)
    fps = {0}
    while len(fps) < 150:
        fps.add(r.choice(sorted(fps)) ^ (1 << r.randint(0, 63)) ^ (1 << r.randint(0, 63)))
    signed = [f - (1 << 64) if f >> 63 else f for f in sorted(fps)]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    from rerunlab.llm.graph import components

    got = {x["node"]: x["component"] for x in components(simhash.links(df, len(fps), blocks=blocks)).collect()}
    a = np.array(signed, np.int64).view(np.uint64)
    near = {(i, j) for i in range(len(a)) for j in range(i) if bin(int(a[i]) ^ int(a[j])).count("1") <= 3}
    root = list(range(len(a)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for i, j in near:
        root[find(i)] = find(j)
    groups = collections.defaultdict(set)
    for i in range(len(a)):
        groups[find(i)].add(signed[i])
    assert {min(g) for g in groups.values() if len(g) > 1} == set(got.values())
    for g in groups.values():
        if len(g) > 1:
            assert {got.get(x, x) for x in g} == {min(g)}


def test_components_of_a_path(spark):
    from rerunlab.llm.graph import components

    n = 40
    df = spark.createDataFrame([((i * 7) % n, ((i + 1) * 7) % n) for i in range(n - 1)], "a long, b long")
    assert {r["component"] for r in components(df).collect()} == {0}
    assert components(df.limit(0)).collect() == []


def library(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda x: np.array(t.encode(x, add_special_tokens=False).ids, np.uint32), t


@pytest.mark.parametrize(("name", "make"), [("byte_bpe_50k.json", vocab.byte_encoder), ("word_bpe_49k.json", vocab.word_encoder)])
def test_encoders_equal_the_library(name, make, awkward):
    slow, _ = library(name)
    e, r = make(), random.Random(4)
    texts = [t[:20_000] for _, t in pairs(awkward)]
    letters = "abcdefghtheingion   \n\t'stlv123.,-_ÄßéñÉ  漢字ǅİſΣσ😀\U00011380"
    texts += ["".join(r.choices(letters, k=r.randint(0, 40))) for _ in range(3000)]
    for t in texts:
        assert np.array_equal(e.ids(t), slow(t)), t[:80]


@pytest.mark.parametrize("make", [vocab.byte_encoder, vocab.word_encoder])
def test_encoders_equal_the_library_everywhere(make):
    """Every vocabulary entry by itself and in a text, and code points beside letters, digits and blanks."""
    e, letters = make(), vocab.byte_letters()
    texts = []
    for token in e.spec["model"]["vocab"]:
        s = bytes(letters[c] for c in token.replace("</w>", "")).decode("utf8", "ignore")
        texts.append(f"{s} x{s}{s} {s}'s")
    codes = CODES
    texts += ["".join(f"a{chr(c)}1{chr(c)}{chr(c)} {chr(c)}." for c in codes[i : i + 40]) for i in range(0, len(codes), 40)]
    want = [np.array(x.ids, np.uint32) for x in e.library.encode_batch(texts, add_special_tokens=False)]
    for t, w in zip(texts, want, strict=True):
        assert np.array_equal(e.ids(t), w), t[:60]


def test_automaton_splits_like_the_library():
    """Code points through the automaton's own splitter."""
    c, e = bpe.coder(), vocab.byte_encoder()
    codes = CODES
    texts = ["".join(f"a{chr(x)}1{chr(x)}{chr(x)} {chr(x)}." for x in codes[i : i + 40]) for i in range(0, len(codes), 40)]
    for t, w in zip(texts, e.library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert c.encode(t) == np.array(w.ids, "<u4").tobytes(), t[:60]


def test_token_files(spark, awkward, empty, tmp_path):
    slow, _ = library("byte_bpe_50k.json")
    got = [tuple(r) for r in tokenfile.token_table(awkward, part_bytes=20_000).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    rows = sorted(pairs(awkward), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    want, start = [], 0
    for i, t in rows:
        ids = np.append(slow(t), np.uint32(0)).astype("<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    assert tokenfile.token_table(empty).collect() == []


def test_token_file_random_access_and_damage(tmp_path):
    import zstandard

    path = tmp_path / "x.zst"
    docs = {i: np.arange(i * 10, dtype=np.uint32) for i in range(1, 40)}
    with open(path, "wb") as f:
        w = tokenfile.Writer(f, frame_ids=64)
        for i, ids in docs.items():
            w.add(i, ids)
        w.close()
    r = tokenfile.open_file(f"file://{path}")
    some = r.find([3, 17, 39, 99])
    assert set(some) == {3, 17, 39} and all(np.array_equal(some[i], docs[i]) for i in some)
    raw = path.read_bytes()
    plain = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read(4 * sum(map(len, docs.values())))
    assert plain == np.concatenate(list(docs.values())).astype("<u4").tobytes()
    path.write_bytes(raw[:40] + bytes([raw[40] ^ 255]) + raw[41:])
    with pytest.raises((ValueError, zstandard.ZstdError)):
        bad = tokenfile.open_file(f"file://{path}")
        [bad.ids(i) for i in range(len(bad.docs))]


def brute_bfd(lengths, capacity):
    left = []
    for x in sorted(lengths, reverse=True):
        fit = [(c, i) for i, c in enumerate(left) if c >= x]
        if fit:
            left[min(fit)[1]] -= x
        else:
            left.append(capacity - x)
    return len(left)


@pytest.mark.parametrize("seed", range(25))
def test_packing_plan(seed):
    r = random.Random(seed)
    cap = r.choice([7, 16, 50])
    lengths = [r.randint(1, cap) for _ in range(r.randint(0, 80))]
    bins, ranks = collections.defaultdict(list), set()
    for length, first, n, at, offset, each in packing.plan(dict(collections.Counter(lengths)), cap):
        for i in range(n):
            ranks.add((length, first + i))
            bins[at + i // each].append((offset + i % each * length, length))
    assert len(ranks) == len(lengths)
    for content in bins.values():
        end = 0
        for offset, length in sorted(content):
            assert offset == end
            end += length
        assert end <= cap
    assert len(bins) == brute_bfd(lengths, cap)


def test_packing(awkward, empty):
    slow, _ = library("word_bpe_49k.json")
    got = packing.packed_documents(awkward).collect()
    want = collections.Counter()
    for i, t in pairs(awkward):
        ids = np.append(slow(t), np.uint32(1)).astype("<u4")
        for p, s in enumerate(range(0, len(ids), 4096)):
            part = ids[s : s + 4096]
            want[i, p, s, len(part), zlib.crc32(part.tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for content in bins.values():
        end = 0
        for offset, length in sorted(content):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(bins) == brute_bfd([r["length"] for r in got], 4096)
    assert packing.packed_documents(empty).collect() == []


def test_pii_base_patterns():
    for text in ["a@b.c x@y", "me.@x-y.z.w@q.r", "@@a@b.co", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.4", "4539 1488 0343 6467 and 4539-1488-0343-6468", "+1 (487) 555-7209 +12 +1234567890123456", "a+b@c.d+1 234 567 89"]:
        spans = pii.base_spans(text)
        want = [(0, *m.span()) for m in pii.EMAIL.finditer(text)]
        want += [(1, *m.span()) for m in pii.IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
        want += [(2, *m.span()) for m in pii.CARD.finditer(text) if 16 <= sum(c.isdigit() for c in m[0]) <= 19 and pii.luhn("".join(c for c in m[0] if c.isdigit()))]
        want += [(3, *m.span()) for m in pii.PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
        assert spans == want, text


def test_pii_contexts_find_unseen(spark, awkward, empty):
    r = random.Random(8)
    texts = [f"please contact user{i}@mail.example.com soon {prose(i, 5)}" for i in range(30)]
    texts += ["please contact admin@localhost soon", "numbers 123456789 here", "please contact admin@localhost"]
    docs = frame(spark, texts + [None, "", prose(1, 3000)])
    got = {x["doc_id"]: x for x in pii.find(docs).collect()}
    assert got[30]["spans"] == "email:15:30" and got[30]["n_email"] == 0
    assert got[31]["spans"] == "" and got[3]["n_email"] == 1
    assert got[0]["base_sha256"] == hashlib.sha256(b"email:15:37").hexdigest()
    clean = {x["doc_id"]: x for x in pii.redact(docs).collect()}
    assert clean[30]["text"] == "please contact [EMAIL] soon" and clean[31]["text"] == texts[31]
    assert clean[33]["text"] is None and pii.redact(docs).columns == docs.columns
    assert pii.find(awkward).count() == awkward.count() and pii.find(empty).collect() == []
    assert r is not None


def test_suffix(spark, awkward, empty):
    shared, other = prose(50, 70), prose(51, 49)
    texts = [f"{prose(60, 30)} one {shared} two {prose(61, 40)}", f"{prose(62, 90)} three {shared} four", f"{shared} five {prose(63, 30)}", f"six {other} seven {prose(64, 30)}", f"eight {other} nine {prose(65, 40)}", f"{prose(66, 60)} {prose(66, 60)}", None, ""]
    got = sorted((r["doc_id"], r["start_word"], r["end_word"]) for r in suffix.repeated_passages(frame(spark, texts)).collect())
    assert got == [(0, 31, 101), (1, 91, 161), (2, 0, 70)]
    assert suffix.repeated_passages(empty).collect() == []
    found = {r["doc_id"] for r in suffix.repeated_passages(awkward).collect()}
    assert found == {11, 12, 14, 15}


def test_suffix_against_brute_force(spark):
    """Every word that stands in a window of 50 words that another document has is covered, and no other."""
    r = random.Random(12)
    parts = [prose(100 + i, r.randint(20, 120)) for i in range(12)]
    texts = [" ".join(r.choice(parts) for _ in range(r.randint(1, 5))) for _ in range(25)]
    docs = [t.split() for t in texts]
    owners = collections.defaultdict(set)
    for d, w in enumerate(docs):
        for i in range(len(w) - 49):
            owners[tuple(w[i : i + 50])].add(d)
    want = set()
    for d, w in enumerate(docs):
        for i in range(len(w) - 49):
            if len(owners[tuple(w[i : i + 50])]) > 1:
                want |= {(d, j) for j in range(i, i + 50)}
    got = {(x["doc_id"], j) for x in suffix.repeated_passages(frame(spark, texts)).collect() for j in range(x["start_word"], x["end_word"])}
    assert got == want


def covered(texts, least):
    docs = [(t or "").split() for t in texts]
    owners = collections.defaultdict(set)
    for d, w in enumerate(docs):
        for i in range(len(w) - least + 1):
            owners[tuple(w[i : i + least])].add(d)
    return {(d, j) for d, w in enumerate(docs) for i in range(len(w) - least + 1) if len(owners[tuple(w[i : i + least])]) > 1 for j in range(i, i + least)}


def test_suffix_staggered_surroundings(spark):
    """Texts that share a beginning but more or less before and after it, so that the best
    neighbours in either order are not the best match."""
    r, master, texts = random.Random(21), prose(77, 40).split(), []
    for _ in range(250):
        a, b = sorted(r.sample(range(41), 2))
        texts.append(" ".join(r.choice(WORDS) for _ in range(r.randint(0, 6))) + " " + " ".join(master[a:b]) + " " + " ".join(r.choice(WORDS) for _ in range(r.randint(0, 6))))
    got = {(x["doc_id"], j) for x in suffix.repeated_passages(frame(spark, texts), least=12, gram=4).collect() for j in range(x["start_word"], x["end_word"])}
    assert got == covered(texts, 12)


def test_common_words():
    r = random.Random(2)
    for _ in range(2000):
        a = [r.choice(["a", "ab", "abc", "b"]) for _ in range(r.randint(0, 5))]
        b = [r.choice(["a", "ab", "abc", "b"]) for _ in range(r.randint(0, 5))]
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        assert suffix.common_words(" ".join(a).encode(), " ".join(b).encode()) == n


def test_bpe(awkward, empty):
    slow, t = library("byte_bpe_50k.json")
    got = bpe.digests(awkward).collect()
    want = collections.Counter()
    for i, x in pairs(awkward):
        ids = slow(x).astype("<u4")
        want[i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.decode(ids.tolist(), skip_special_tokens=False).encode()).hexdigest()] += 1
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want
    assert bpe.digests(empty).collect() == []


def test_bpe_automaton_follows_merges():
    """Random merge lists against merging by hand, first merge first, left to right."""
    r = random.Random(5)
    for _ in range(120):
        base = {bytes([c]): i for i, c in enumerate(b"abc")}
        ids, merges = dict(base), []
        corpus = [bytes(r.choices(b"abc", k=r.randint(2, 12))) for _ in range(30)]
        split = [[bytes([c]) for c in w] for w in corpus]

        def apply(words, pair):
            out = []
            for w in words:
                new, i = [], 0
                while i < len(w):
                    if i + 1 < len(w) and (w[i], w[i + 1]) == pair:
                        new.append(w[i] + w[i + 1])
                        i += 2
                    else:
                        new.append(w[i])
                        i += 1
                out.append(new)
            return out

        for _ in range(r.randint(1, 12)):
            counts = collections.Counter(p for w in split for p in zip(w, w[1:], strict=False))
            counts = {p: n for p, n in counts.items() if p[0] + p[1] not in ids}
            if not counts:
                break
            pair = max(counts, key=lambda p: (counts[p], p))
            merges.append(pair)
            ids[pair[0] + pair[1]] = len(ids)
            split = apply(split, pair)
        a = bpe.Automaton(base, merges, ids)
        for _ in range(60):
            word = bytes(r.choices(b"abc", k=r.randint(1, 14)))
            by_hand = [[bytes([c]) for c in word]]
            for pair in merges:
                by_hand = apply(by_hand, pair)
            assert a.run(word) == [ids[x] for x in by_hand[0]]


def test_toxicity(spark, awkward, empty):
    r = random.Random(6)
    texts, rows = [], []
    for i in range(400):
        bad = i % 4 == 0
        w = prose(i, r.randint(10, 60)).split()
        if bad:
            w[r.randrange(len(w))] = r.choice(["vile", "foul"])
        texts.append(" ".join(w))
        rows.append((i, 1, int(bad)))
    labels = spark.createDataFrame([*rows, (5000, 1, 1), (1, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score_table(frame(spark, texts), labels).collect()
    held = [x for x in got if x["held_out"]]
    assert {x["doc_id"] for x in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.5) for x in got)
    assert np.mean([x["predicted"] == int(x["doc_id"] % 4 == 0) for x in held]) > 0.9
    assert toxicity.score_table(awkward, labels).count() == awkward.count()
    assert toxicity.score_table(empty, labels).collect() == []
    assert {x["score"] for x in toxicity.score_table(awkward, labels.limit(0)).collect()} == {0.0}
    assert toxicity.drop_toxic(frame(spark, texts), labels).columns == frame(spark, texts).columns


def test_long_text_scores_as_a_whole():
    """Chunked scoring of one long text equals scoring it at once."""
    rng = np.random.default_rng(0)
    n = toxicity.RESPONSES + 1
    m = toxicity.Model(rng.normal(size=(toxicity.BUCKETS, n)).astype(np.float32), rng.normal(size=(toxicity.BUCKETS, n)).astype(np.float32), np.zeros(24, np.float32), rng.normal(size=24).astype(np.float32), 0.0, np.zeros(1))
    codes = rng.integers(0, toxicity.BUCKETS, 3000) | rng.integers(0, toxicity.BUCKETS, 3000) << 16
    whole = m.logits([codes, codes[:10]])[0]
    small, toxicity.CHUNK_WORDS = toxicity.CHUNK_WORDS, 500
    try:
        assert np.allclose(m.logits([codes, codes[:10]])[0], whole, atol=1e-3)
    finally:
        toxicity.CHUNK_WORDS = small


def test_labels_do_not_reach_scores(spark):
    """Language and source change no score."""
    texts = [prose(i, 20) + (" vile" if i % 3 == 0 else "") for i in range(150)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(150)], "doc_id long, quality int, toxic int")
    docs = frame(spark, texts)
    model = toxicity.train(docs, labels)
    a = {x["doc_id"]: x["score"] for x in toxicity.with_score(docs.drop("score"), model).collect()}
    b = {x["doc_id"]: x["score"] for x in toxicity.with_score(docs.drop("score").withColumn("lang", F.lit("zz")).withColumn("source", F.lit("q")), model).collect()}
    assert a == b
