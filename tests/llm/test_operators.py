"""Each corpus operator against brute force, a round trip, its SQL or held-out accuracy, and its edge cases."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cloneweave.llm import blobs, chat, common, decontaminate, jaccard, langid, media, mixing, pii, quality, queries, textkernel, tokenio, warc
from cloneweave.llm.components import components

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, sig string, n long, key string"
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "a b c"), (None, "a b c d e f"), (7, "x " * 40_000), (8, "Same text here twice now"), (8, "Same text here twice now"), (9, "ünï cödé " * 30)]


def docs(spark, rows):
    """Documents with clashing extra columns."""
    return spark.createDataFrame([(i, t, "en", None if i == 4 else f"s{(i or 0) % 3}", len(t or ""), "x", 1, "k") for i, t in rows], DOCS)


def words(text):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))


def shingle_set(text, k):
    w = words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def near_copies(n, seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocab) for _ in range(120)]
    out = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.6:
            w = list(base)
            for _ in range(rng.randint(0, 7)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            w = w[: rng.randint(100, 120)]
        else:
            w = [rng.choice(vocab) for _ in range(rng.randint(1, 80))] + base[:20]
        out.append((i, " ".join(w)))
    return out + [(n + i, out[i][1].upper()) for i in range(5)]


def brute_components(rows, k, num, den):
    sets = {i: shingle_set(t, k) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_kernel_words_and_shingles():
    rows = [t for _, t in ODD] + ["a\x0bb\x0cc", "A b C D e", "a B c d E"]
    for k in (1, 4, 5):
        got = [len(s) for _, s in textkernel.shingles(pa.array(rows, pa.string()), k)]
        assert got == [len(shingle_set(t, k)) for t in rows]
    a, b = (s for _, s in textkernel.shingles(pa.array(["x A b C D e", "x a B c d E"], pa.string()), 4))
    assert np.array_equal(a, b)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = {x: find(x) for x in root if find(x) != x}
    assert {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == want


@pytest.mark.parametrize("k,num,tile", [(4, 85, 2048), (5, 80, 8)])
def test_jaccard(spark, k, num, tile):
    rows = near_copies(160)
    p = jaccard.JoinParams(k=k, num=num, tile=tile)
    got = {r[0]: (r[1], r[2]) for r in jaccard.join_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), p).collect()}
    assert got == brute_components(rows, k, num, 100)


@pytest.mark.parametrize("pivots", [1, 3])
def test_jaccard_large_groups(spark, pivots):
    """Groups of many tiles, some of whose nodes are linked only through others or with nothing."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(150):  # a walk: each near the one before it, the ends far apart
        base = list(base)
        base[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(base + ["tail"] * (i % 3))))
    rows += [(200 + i, " ".join([f"b{j}" for j in range(60)] + [f"y{i}_{j}" for j in range(rng.randint(0, 30))])) for i in range(60)]
    p = jaccard.JoinParams(tile=16, pivots=pivots)
    got = {r[0]: (r[1], r[2]) for r in jaccard.join_components(spark.createDataFrame(rows, "doc_id long, text string"), p).collect()}
    assert got == brute_components(rows, 4, 85, 100)


def test_rows_dealt_grow_with_the_group(spark):
    p = jaccard.JoinParams()
    for n in (20_000, 160_000):
        rows = spark.range(n).select(F.lit(0).cast("long").alias("key"), F.col("id").alias("node"), (100 + F.col("id") % 10).alias("n"))
        marked = jaccard.counted(rows, "key", p)
        assert marked.first()["_all"] == -(-n // p.tile)
        assert jaccard.pivot_tiles(marked, "key", p).count() <= n * (1 + 2 * p.pivots / p.tile) + p.pivots
        roots = spark.range(1, n).filter("id % 1000 <> 7").select(F.col("id").alias("node"), F.lit(0).cast("long").alias("root"))
        dealt = jaccard.rest_tiles(marked, "key", roots, p)
        assert 2 * n <= dealt.count() <= 3 * n
        assert dealt.groupBy("_g", "_c1", "_c2").count().agg(F.max("count")).first()[0] <= 3 * p.tile


def test_short_sets_blur_no_long_ones():
    """Long sets that share little stay apart in a tile that holds a short one, and links are kept at every width."""
    p, rng = jaccard.JoinParams(), np.random.default_rng(4)
    draw = lambda n: rng.integers(0, 2**64, n, dtype=np.uint64)
    far = [draw(5000) for _ in range(6)]
    near = [np.concatenate([far[0][:4700], draw(100)]), np.concatenate([far[1][:4900], draw(100)])]
    short = draw(20)
    sets = sorted([short, np.concatenate([short[:19], draw(1)]), *far, *near], key=len)
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    sigs = [jaccard.signature(x, jaccard.width(len(x), p)).tobytes() for x in sets]
    root = jaccard.forest(sizes, sigs, p).tolist()
    of = {id(x): r for x, r in zip(sets, root)}
    assert of[id(far[0])] == of[id(near[0])] and of[id(far[1])] == of[id(near[1])]
    assert root[0] == root[1] and len(set(root)) == 7
    for wide, narrow in ((4096, 64), (512, 512)):
        one = jaccard.signature(far[0], wide)
        assert (jaccard.folded(one[None], narrow)[0] == jaccard.signature(far[0], narrow)).all()


def relinked(f):
    """A base text, two with another stretch of it rewritten each, and one with a word changed in the first of these stretches."""
    base = [f"b{f}_{i}" for i in range(203)]
    one, two = base[:40] + [f"x{f}_{i}" for i in range(13)] + base[53:], base[:140] + [f"y{f}_{i}" for i in range(13)] + base[153:]
    return [(1000 * f + i, " ".join(w)) for i, w in ((1, base), (5, one), (7, two), (9, base[:46] + ["z"] + base[47:]))]


@pytest.mark.parametrize("times", [2, 3])
def test_jaccard_repeated_rows(spark, times):
    rows = [r for f in range(25) for r in relinked(f)] + [(i + 100_000, t) for i, t in near_copies(160)]
    got = [(r[0], (r[1], r[2])) for r in jaccard.join_components(spark.createDataFrame(rows * times, "doc_id long, text string").repartition(3)).collect()]
    assert len(got) == times * len(rows) and dict(got) == brute_components(rows, 4, 85, 100) and len(set(got)) == len(rows)


def test_jaccard_ids_of_two_texts(spark):
    rows = [r for f in range(25) for r in relinked(f)]
    rows += [(i, f"{t} {' '.join(f'q{i}_{j}' for j in range(5))}") for i, t in rows]
    got = {r[0]: r[2] for r in jaccard.join_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i // 1000 * 1000 + 1 for i, _ in rows}


def test_jaccard_odd(spark):
    got = jaccard.join_components(docs(spark, ODD)).collect()
    assert len(got) == len(ODD)
    by = {r[0]: (r[1], r[2]) for r in got}
    assert by[1] == (0, 1) and by[2] == (0, 2) and by[4] == (1, 4) and by[8] == (2, 8) and by[None] == (3, None)
    assert jaccard.join_components(docs(spark, [])).count() == 0


def brute_leaks(rows, items, k=5, least=0.8):
    split = lambda t: [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
    out = {}
    for item, text in items:
        w = split(text)
        if not w:
            continue
        kk = min(k, len(w))
        have = Counter(tuple(w[i : i + kk]) for i in range(len(w) - kk + 1))
        m = sum(have.values())
        for d, t in rows:
            v = split(t)
            g = [tuple(v[i : i + kk]) for i in range(len(v) - kk + 1)]
            if have.keys().isdisjoint(g):
                continue
            for a in range(max(1, len(g) - m + 1)) if g else ():
                x = Counter(g[a : a + m])
                o = sum((x & have).values())
                s = o / (m + sum(x.values()) - o)
                if s >= least:
                    out[d, item] = max(s, out.get((d, item), 0))
    return out


def test_leaks(spark):
    rng = random.Random(4)
    vocab = [f"v{i}" for i in range(300)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(text(rng.randint(12, 50)))) for i in range(12)] + [(20, "tiny item"), (21, None), (22, "a a a a a a a a b")]
    rows = []
    for i in range(80):
        w = text(rng.randint(0, 200))
        if i % 2 == 0:
            leak = items[rng.randrange(12)][1].split()
            if i % 4 == 0:
                leak[rng.randrange(len(leak))] = "changed"
            if i % 8 == 0:
                leak = leak[: len(leak) - 1]
            w[len(w) // 2 : len(w) // 2] = leak
        rows.append((i, ", ".join(w).upper() + "."))
    rows += [(100, items[0][1]), (101, "my Tiny-item!"), (102, None), (103, ""), (104, "a a a a a a a a b")]
    want = brute_leaks(rows, items)
    got = {(r[0], r[1]): r[2] for r in decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got.keys() == want.keys() and len(want) > 20
    assert all(abs(got[x] - want[x]) < 1e-9 for x in want)


def test_leaks_of_long_items(spark):
    rng = random.Random(14)
    long = [f"l{rng.randrange(5000)}" for _ in range(1500)]
    changed = [w if rng.random() > 0.01 else "other" for w in long]
    items = [(1, " ".join(long)), (2, " ".join(long[:700])), (3, "so it goes on and on and on and on"), (3, "so it goes on and on and on and on")]
    rows = [(1, " ".join(["pad"] * 50 + changed + ["pad"] * 50)), (2, " ".join(long[100:900])), (3, "so it goes " * 300 + items[2][1]), (3, "so it goes " * 3)]
    want = brute_leaks(rows, items)
    for p in (decontaminate.LeakParams(), decontaminate.LeakParams(broadcast_rows=0)):
        got = {(r[0], r[1]): r[2] for r in decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), p).collect()}
        assert got.keys() == want.keys() >= {(1, 1), (1, 2), (3, 3)} and all(abs(got[x] - want[x]) < 1e-9 for x in want)


@tables
def test_leaks_query(spark):
    found = lambda t: [tuple(r) for r in spark.read.parquet(f"{SF}/{t}.parquet").select("doc_id" if t == "documents" else "item_id", "text").collect()]
    want = brute_leaks(found("documents"), found("benchmark"))
    got = {(r[0], r[1]): r[2] for r in queries.op9_decontaminate(spark, SF).collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)


def test_leaks_odd(spark):
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    found = decontaminate.leaks(docs(spark, ODD), items).collect()
    assert [(r[0], r[1]) for r in found] == [(None, 1)]
    assert decontaminate.leaks(docs(spark, ODD), items.filter("false")).count() == 0
    assert decontaminate.leaks(docs(spark, []), items).count() == 0


def test_sainte_lague_is_one_by_one():
    rng = random.Random(5)
    for _ in range(60):
        votes = [rng.choice([0, 1, 5, 5, 17, 100, rng.randint(1, 500)]) for _ in range(rng.randint(1, 9))]
        seats, most = rng.randint(0, 60), [rng.randint(0, 20) for _ in votes]
        given = [0] * len(votes)
        for _ in range(seats):
            best = max(range(len(votes)), key=lambda i: (votes[i] / (2 * given[i] + 1) if given[i] < most[i] and votes[i] else -1, -i))
            if given[best] >= most[best] or not votes[best]:
                break
            given[best] += 1
        assert mixing.sainte_lague(np.array(votes), seats, np.array(most)).tolist() == given


def test_targets():
    t = mixing.targets(np.array([100.0, 10.0, 50.0]), np.array([3.0, 1.0, 2.0]), 240, 2.0)
    assert t[1] == 20 and abs(t.sum() - 240) < 1e-9 and (t <= [200, 20, 100]).all()


def test_mix(spark):
    rng = random.Random(6)
    rows = [(i, " ".join("w" * (i % 3 + 1) for _ in range(rng.randint(0, 300))), None if i % 11 == 0 else rng.choice("abc")) for i in range(600)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [tuple(r) for r in mixing.mix(d, mixing.MixParams(shard_words=4000)).collect()]
    assert sorted(got) == sorted(tuple(r) for r in mixing.mix(d.repartition(5), mixing.MixParams(shard_words=4000)).collect())
    size = {i: len(words(t)) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    names = sorted({s for s in source.values() if s}) + [None]
    sums = np.array([sum(size[i] for i in size if source[i] == s) for s in names], dtype=float)
    want = dict(zip(names, mixing.targets(sums, np.array([3.0, 1.0, 2.0, 3.0]), 1.5 * sums.sum(), 2.0)))
    taken = Counter()
    for i, n, total, target, took in got:
        assert n == size[i] and total == sums[names.index(source[i])] and abs(target - want[source[i]]) < 1e-6 and 0 <= took <= 2 * n
        taken[source[i]] += took
    for s in names:
        assert abs(taken[s] - want[s]) <= 64 * 6


def test_mix_odd(spark):
    got = mixing.mix(docs(spark, ODD)).collect()
    assert len(got) == len(ODD) and all(r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.mix(docs(spark, [])).count() == 0


def tokens():
    return tokenio.TokenParams(**(queries.token_params().__dict__ | {"cache": 50, "longest": 12}))


def test_encoder_is_the_librarys():
    e = tokenio.Encoder(tokens().tokenizer, tokens())
    texts = [t for _, t in ODD] + ["Don't stop. It's, well... fine,, ok!", "<|endoftext|> a <|ENDOFTEXT|>", "a\x1cb c d", "ÀÉ́ 12.5 km/h", "x" * 500 + " y", "Ünï. cödé, çà."]
    texts += [" ".join(random.Random(i).choices(["thre", "the,", "of.", "Ärger,", "co-op", "3.14", "e.g.", "!!", "naïve."], k=200)) for i in range(4)]
    assert e.batch(texts) == [e.whole(t or "") for t in texts]


def test_encoder_after_a_full_cache():
    e = tokenio.Encoder(tokens().tokenizer, tokens())
    for texts in (["the end of the day, the"], [" ".join(["the", *(f"w{i}" for i in range(60)), "end."]), "the day, of"], ["of the w1 w2"]):
        assert e.batch(texts) == [e.whole(t) for t in texts]


def test_records(spark):
    p = tokens()
    rows = [r for r in ODD if r[0] != 8] + [(i, f"text number {i}. " * (i % 5)) for i in range(20, 400)]
    folder, index = tokenio.write_records(docs(spark, rows).repartition(4), p)
    got = sorted((tuple(r) for r in tokenio.read_records(index, tokenio.TokenParams(**(p.__dict__ | {"read_bytes": 500}))).collect()), key=lambda r: r[1])
    e, start = tokenio.Encoder(p.tokenizer, p), 0
    for (key, text), r in zip(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), got):
        ids = np.append(np.frombuffer(e.whole(text or ""), e.dtype), 1).astype("<u4")
        assert r == (key, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(got) == len(rows)
    assert tokenio.read_records(tokenio.write_records(docs(spark, []), p)[1], p).count() == 0


def test_damaged_record():
    import io

    data = bytearray(tokenio.frame(b"hello"))
    assert tokenio.unframe(io.BytesIO(bytes(data)).read) == b"hello"
    data[14] ^= 1
    with pytest.raises(ValueError):
        tokenio.unframe(io.BytesIO(bytes(data)).read)


def test_media(spark):
    folder = media.write_archives(docs(spark, ODD).repartition(3))
    got = media.features(media.read_archives(spark, folder, rangeBytes=700, batchBytes=900)).collect()
    assert len(got) == len(ODD)
    texts = {i: t or "" for i, t in ODD}
    for r in got:
        raw = texts[r["doc_id"]].encode()
        full = media.padded(raw)
        assert len(full) % 64 == 0 and len(full) >= 64
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
    assert media.features(media.read_archives(spark, media.write_archives(docs(spark, [])))).count() == 0


def test_media_retries():
    content = media.encode_png(b"abc")
    block = media.tar_header("7.png", len(content)) + content

    class Shaky(media.ArchiveReader):
        calls = 0

        def __init__(self):
            self.retries = 2

        def handle(self, system, path):
            import io

            Shaky.calls += 1
            return io.BytesIO(block[:600] if Shaky.calls < 3 else block)

    assert Shaky().member(None, "", 0) == ("7.png", content) and media.decode_png(content) == (media.padded(b"abc"), 3)
    Shaky.calls = -9
    with pytest.raises(OSError):
        Shaky().member(None, "", 0)


def test_arc_versions():
    import io

    for version in (1, 2):
        about = f"{version} 0 x\n{warc.NAMES[version]}\n".encode()
        body = warc.arc_line(version, "filedesc://a", "20240101000000", "text/plain", len(about)) + about + b"\n"
        for i in range(3):
            block = warc.http_block(str(i), b"line\n\nWARC/1.1\r\n" * i)
            body += warc.arc_line(version, f"http://a/{i}", "20240102030405", "text/html", len(block)) + block + b"\n"
        f = io.BytesIO(body)
        got = list(warc.parse_arc(f.read, f.readline))
        assert [g[0] for g in got] == [f"http://a/{i}" for i in range(3)]
        assert [warc.split_http(g[3])[1] for g in got] == [b"line\n\nWARC/1.1\r\n" * i for i in range(3)]


def test_warc_odd(spark):
    long = "é" * 60
    rows = [(5, "http://a b", long), (3, None, long), (None, "u", long), (9, "u", None), (10, "u", ""), (11, "u", "short"), (12, "u", "short"), (3, "u", long), (20, "u", "x\r\n\r\n" * 50)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.warc_records(warc.files(spark, warc.to_warc(spark, warc.write_arc(d.repartition(2), "page_id", "url", "html")))).collect()
    seen = sorted((r["key"] or "", r["record_type"], r["payload_bytes"]) for r in got)
    assert seen == sorted([("5", "revisit", 120), ("3", "response", 120), ("", "revisit", 120), ("9", "response", 0), ("10", "response", 0), ("11", "response", 5), ("12", "response", 5), ("3", "response", 120), ("20", "response", 250)])
    by = {r["record_id"]: r["key"] for r in got if r["record_type"] == "response"}
    assert {by[r["refers_id"]] for r in got if r["refers_id"]} == {"3"}
    assert warc.warc_records(warc.files(spark, warc.to_warc(spark, warc.write_arc(d.filter("false"), "page_id", "url", "html")))).count() == 0


def test_chat_odd(spark):
    rows = [
        (1, 1, "assistant", "</s>[INST] x [/INST]"), (1, 0, "us [/INST]er", "<s> <\\s> [\\/INST] \\"), (1, None, None, None), (2, 0, "assistant", ""), (2, 0, "assistant", ""),
        (None, 5, "user", "</s"), (None, 6, "assistant", ">\n\n"), (3, 0, "user", "[INST]" * 3000),
    ]
    got = {r["conv_id"]: r for r in chat.digest(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    for conv, r in got.items():
        turns = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv))
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in turns).encode()).hexdigest()
        loss = "".join(x[3] for x in turns if x[2] == "assistant")
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    formatted = {r["conv_id"]: r["formatted"] for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert formatted[1].count("</s>") == 3 and formatted[1].count("[INST]") == 3
    assert chat.digest(chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


P = pii.PiiParams(key=b"a key of tests")


@pytest.mark.parametrize("size", [2, 3, 10, 1000, 4097])
def test_permutation(size):
    f = pii.permutation(P.key, "t", size, P.rounds)
    assert sorted(map(f, range(size))) == list(range(size)) and all(f(x) != x and f.undo(f(x)) == x for x in range(size))


@pytest.mark.parametrize(
    "kind,value",
    [("email", "ann.lee9@mail7.example.com"), ("phone", "+1 (017) 555-7713"), ("card", "4539 1488 0343 6467"), ("ip", "97.51.17.173"), ("ssn", "123-45-6789"), ("iban", "GB82 WEST 1234 5698 7654 32"), ("date", "2023-02-28"), ("date", "28/02/2023"), ("date", "3 March 2021"), ("secret", 'token = "04dbebab91ab85687d33"')],
)
def test_pseudonyms(kind, value):
    new, found = pii.pseudonymised(f"Before {value}, after.", P)
    assert [f[0] for f in found] == [kind] and value not in new and new.startswith("Before ") and new.endswith(", after.")
    shape = lambda s: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d+" if kind in ("ip", "date") else r"\d", "0", s)))
    if kind not in ("date", "secret") or "M" not in value:
        assert kind == "secret" or shape(found[0][3]) == shape(value) or "March" in value
    again, more = pii.pseudonymised(new, P)
    assert [f[0] for f in more] == [kind]  # a pseudonym is as valid as its value
    assert pii.pseudonymised(f"x {value}", P)[1][0][3] == found[0][3]


def test_links_and_clean_text():
    a = pii.pseudonymised("4539 1488 0343 6467", P)[0]
    assert pii.pseudonymised("4539-1488-0343-6467", P)[0] == a.replace(" ", "-")
    one, two = pii.pseudonymised("2023-02-28", P)[0], pii.pseudonymised("28/02/2023", P)[0]
    assert one.split("-") == two.split("/")[::-1]
    for clean in ("4539148803436468", "Version 2.0 of 2023", "300.1.2.3", "31/02/2023 x 13-13-2020", "a@b", "666-12-3456", "MIT 1.2.3.4.5"):
        assert pii.pseudonymised(clean, P) == (clean, [])


@pytest.mark.parametrize(
    "kind,value,text",
    [
        ("card", "4111111111111111", "{} 123"), ("card", "4111 1111 1111 1111", "{} 12/25"), ("card", "4111111111111111", "5 {}"), ("card", "4111 1111 1111 1111", "12 {}"),
        ("card", "4111111111111111", "{} 97.51.17.173"), ("card", "4111 1111 1111 1111", "7 12 {} 123 2024"), ("card", "4111-1111-1111-1111", "{}-123"), ("card", "9999 9999 9999 9995", "12 {} 3"),
        ("iban", "BE68 5390 0754 7034", "{} BIC"), ("iban", "BE68539007547034", "{} 2024"), ("iban", "BE68 5390 0754 7034", "AB12 {} EUR 100"), ("iban", "GB82 WEST 1234 5698 7654 32", "{} GEBABEBB"),
    ],
)
def test_numbers_beside_others(kind, value, text):
    new, found = pii.pseudonymised(text.format(value), P)
    mine = [f for f in found if f[0] == kind]
    assert [(f[1], f[2]) for f in mine] == [(text.index("{"), len(value))]
    assert value not in new and mine[0][3] == pii.pseudonymised(value, P)[0]
    assert "97.51" in text or new == text.format(mine[0][3])


def test_cards_in_long_runs():
    cards = ["4111 1111 1111 1111", "4539 1488 0343 6467", "5555555555554444"]
    new, found = pii.pseudonymised(" ".join(cards * 50), P)
    assert [f[2] for f in found] == [len(c) for c in cards] * 50 and not any(c in new for c in cards)
    assert len(pii.pseudonymised("4111 1111 1111 1111 017-555-7713", P)[1]) == 2


@pytest.mark.parametrize("name", ["token", "access_token", "client_secret", "MY-API-KEY", "userPassword"])
@pytest.mark.parametrize("value", ["a1b2c3d4e5" * 40, "Q" * 300 + "7" * 100, "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.dBjftJeZ4CVPmB92K27", "04dbebab91ab85687d33"])
def test_whole_secrets(name, value):
    new, found = pii.pseudonymised(f"{name} = {value}. Next", P)
    assert [f[0] for f in found] == ["secret"] and found[0][1] + found[0][2] == len(f"{name} = {value}")
    got = new[len(f"{name} = ") : -len(". Next")]
    assert new.startswith(f"{name} = ") and new.endswith(". Next") and len(got) == len(value)
    assert not any(value[i : i + 16] == got[i : i + 16] for i in range(0, len(value) - 16, 16))
    assert pii.pseudonymised(f"{name}={'a' * 400} and token=abc1.", P)[1] == []


def test_pii_odd(spark):
    d = docs(spark, [*ODD, (30, "mail a.b1@x.example.org now")])
    got = pii.pseudonymise(d.withColumn("findings", F.lit(1)), P)
    assert set(d.columns) < set(got.columns)
    rows = got.collect()
    assert {r["doc_id"] for r in rows if r["n_found"]} == {30} and len(rows) == len(ODD) + 1
    assert all(r["text"] == dict(ODD)[r["doc_id"]] for r in rows if r["doc_id"] != 30)
    assert pii.pseudonymise(docs(spark, []), P).count() == 0


@pytest.mark.parametrize("value,kind", [("x" * 70 + "@mail.acme.com", "email"), ("Ann@acme.co.uk", "email"), ("+44 20 7946 0958", "phone"), ("+49 (89) 123456", "phone"), ("2023-2-8", "date"), ("8.2.2023", "date"), ("08 March 2021", "date"), ("token=correctHorseBatteryStaple", "secret"), ("password: correct-horse-battery-staple", "secret"), ("(017) 555-7713", "phone")])
def test_whole_values(value, kind):
    new, found = pii.pseudonymised(f"See {value}, so.", P)
    assert [(f[0], f[1], f[2]) for f in found] == [(kind, 4, len(value))] and new[4:-5] == found[0][3] != value
    assert "acme" not in new and "horse" not in new.lower() and (kind == "date" or len(found[0][3]) == len(value))
    assert kind != "date" or "March" in value or [len(x) for x in re.split("[-.]", found[0][3])] == [len(x) for x in re.split("[-.]", value)]


def test_dates_are_linked_and_wide_as_they_were():
    a, b, c = (re.split(r"\D", pii.pseudonymised(x, P)[0]) for x in ("2023-2-8", "08/02/2023", "2023.02.08"))
    assert list(map(int, a)) == list(map(int, c)) == list(map(int, b[::-1])) and len(c[1]) == 2
    for clean in ("password: required", "secret: nothing", "+999 123 4567", "+44 00 0000 0000", "+12", "token: aaaaaaaaaaaaaaaaaaaaaaaaaa"):
        assert pii.pseudonymised(clean, P) == (clean, [])
    with pytest.raises(TypeError):
        pii.PiiParams()


def test_pii_query_is_the_plain_way(spark, tmp_path):
    values = ["ann.b1@x.example.org", "+1 (017) 555-7713", "4539 1488 0343 6467", "97.51.17.173", "password=e3b3ed3cc8548923d6", "GB82 WEST 1234 5698 7654 32", "2023-02-28"]
    rows = [*ODD, *[(100 + i, f"some words {values[i % 7]} and {values[i * 3 % 7]} more {i}") for i in range(60)]]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set(queries.OP5_KEY, "k")
    got = [(r["doc_id"], r["text"], [tuple(f) for f in r["findings"]]) for r in queries.op5_pii(spark, str(tmp_path)).collect()]
    spark.conf.unset(queries.OP5_KEY)
    want = [(i, *(pii.pseudonymised(t, pii.PiiParams(key=b"k")) if t is not None else (None, []))) for i, t in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_quality_odd(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(20, 60)], "doc_id long, quality int")
    d = docs(spark, [*ODD, *[(i, "good fine words here" if i % 2 else "### junk ### $$$") for i in range(20, 60)]])
    p = quality.QualityParams(buckets=1 << 12)
    got = {r["doc_id"]: r["score"] for r in quality.classify(d, quality.fit(d, labels, params=p), params=p).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and got[21] > 0.9 > 0.1 > got[20]
    none = quality.fit(d, labels.filter("false"), params=p)
    assert {r["score"] for r in quality.classify(d, none, params=p).collect()} == {0.5}
    assert quality.classify(docs(spark, []), none, params=p).count() == 0


def test_language_odd(spark):
    p = langid.LangParams(bins=1 << 10)
    train = docs(spark, [(i, "the cat and the hat") for i in range(20, 30)]).unionByName(docs(spark, [(i, "der hund und die katze") for i in range(30, 40)]).withColumn("lang", F.lit("de")))
    model = langid.fit(train, params=p)
    got = {r["doc_id"]: (r["lang_pred"], r["lang_score"]) for r in langid.identify(docs(spark, [*ODD, (50, "und der hund"), (51, "12 34!")]), model, params=p).collect()}
    assert got[1] == got[2] == got[51] == ("und", 0.0) and got[50][0] == "de" and got[4][0] in ("en", "de")
    empty = langid.fit(train.filter("false"), params=p)
    assert {r["lang_pred"] for r in langid.identify(train, empty, params=p).collect()} == {"und"}


@pytest.mark.parametrize("uri, want", [("file:/a/b", "file:///a/b"), ("file:///a", "file:///a"), ("s3a://b/k", "s3://b/k"), ("s3n://b/k", "s3://b/k"), ("hdfs://h:1/x", "hdfs://h:1/x")])
def test_paths(uri, want):
    assert blobs.plain_uri(uri) == want


@tables
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cur.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(repr, cur.fetchall()))


@tables
def test_held_out_accuracy(spark):
    big = SF.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{big}/labels.parquet")
    rows = queries.op1_quality(spark, big).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.95
    docs_ = spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "lang")
    rows = queries.op10_language(spark, big).join(docs_, "doc_id").filter("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) / len(rows) > 0.95


@tables
def test_pipeline(spark):
    import corpus_pipeline as cp

    d = spark.read.parquet(f"{SF}/documents.parquet")
    near = cp.near_duplicates(spark, d, SF)
    want = {i for i, (_, c) in brute_components([(r[0], r[1]) for r in d.select("doc_id", "text").collect()], 5, 80, 100).items() if i == c}
    assert near.columns == d.columns and {r[0] for r in near.collect()} == want
    leaks = brute_leaks([(r[0], r[1]) for r in d.select("doc_id", "text").collect()], [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    assert {r[0] for r in d.collect()} - {r[0] for r in cp.clean(spark, d, SF).collect()} == {x for x, _ in leaks}
    last = cp.run(spark, SF)
    assert last.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and last.count() > 0
    assert not [x for x in common.made if "/pipeline-" in x and "tokens" not in x]
    common.discard(spark, list(common.made))
    assert not common.made


STAGE_ODD = [*ODD, (8, "another text of the same id here"), (11, "the same words here and there and here"), (None, "the same words here and there and here"), (None, "THE same words here and there and here"), (12, "the  same words here and there and here")]


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Odd rows with columns that clash with those of the stages."""
    d = docs(spark, STAGE_ODD)
    for c in ("_key", "key", "row", "times", "time", "share", "at", "text_", "held", "_h", "lang_pred", "_lang", "doc", "size", "taken"):
        d = d.withColumn(c, F.lit(c))
    return d


@tables
def test_stages_odd(spark, odd_docs):
    import corpus_pipeline as cp

    got = {}
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, odd_docs, SF)
        assert out.columns == odd_docs.columns
        got[name] = Counter((r["doc_id"], r["text"]) for r in out.collect())
        assert stage(spark, odd_docs.filter("false"), SF).count() == 0
    every = Counter(STAGE_ODD)
    assert got["language"] == Counter({x: n for x, n in every.items() if re.search(r"[^\W\d_]", x[1] or "")})
    near = got["near_duplicates"]
    assert set(near.values()) == {1} and near.keys() == every.keys() - {(None, STAGE_ODD[11][1]), (None, STAGE_ODD[13][1]), STAGE_ODD[14], STAGE_ODD[12], STAGE_ODD[13]} | {STAGE_ODD[11]}
    assert got["decontamination"] == every
    assert all(words(t) for _, t in got["mixing"])
    n, index = cp.tokens(spark, odd_docs, SF).count(), cp.tokens(spark, odd_docs.filter("false"), SF).count()
    assert (n, index) == (len(STAGE_ODD), 0)


def test_language_stage_learns_nothing(spark):
    import corpus_pipeline as cp

    d = docs(spark, STAGE_ODD).withColumn("lang", F.lit(None).cast("string"))
    assert cp.language(spark, d, SF).count() == sum(bool(re.search(r"[^\W\d_]", t or "")) for _, t in STAGE_ODD)


def test_mixed_stage_follows_the_targets(spark):
    """Words of a source after the stage: near its target, also where a source is a few long documents."""
    import corpus_pipeline as cp

    rng = random.Random(16)
    rows = [(i, " ".join([f"w{i}"] * rng.randint(1, 60)), rng.choice("abc")) for i in range(4000)] + [(9000 + i, f"x{i} " * 900, "d") for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    size = {i: len(words(t)) for i, t, _ in rows}
    names = "abcd"
    sums = np.array([sum(size[i] for i, _, s in rows if s == n) for n in names], dtype=float)
    want = mixing.targets(sums, np.array([3.0, 1.0, 2.0, 3.0]), 1.5 * sums.sum(), 2.0)
    out = [tuple(r) for r in cp.mixed(spark, d, SF).collect()]
    for n, w in zip(names, want):
        assert abs(sum(size[i] for i, _, s in out if s == n) - w) <= 1000
    assert Counter(out) == Counter(tuple(r) for r in cp.mixed(spark, d.repartition(7), SF).collect()) and max(Counter(out).values()) <= 3


def test_bounded_samples(spark):
    """An id repeated very often is one row of the sample; classes and languages have at most so many rows."""
    rows = spark.range(40_000).select(F.lit(5).cast("long").alias("id"), F.lit("a").alias("y")).union(spark.range(900).select(F.col("id") + 100, F.lit("a"))).union(spark.range(50).select(F.col("id") + 5000, F.lit("b")))
    got = Counter(r["y"] for r in common.sample_per_class(rows, ["id"], "y", 300).collect())
    assert got == {"a": 300, "b": 50}
    assert {r["y"] for r in common.sample_per_class(rows, ["id"], "y", 300, labels=1).collect()} == {"a"}
    model = langid.fit(spark.range(5000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.lit("xx").alias("lang")), params=langid.LangParams(bins=1 << 10, per_lang=40))
    assert model[0] == ["xx"] and len(model[1]) <= 16
    d = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("good "), F.col("id")).alias("text")).union(spark.createDataFrame([(8, "bad junk")] * 3000, "doc_id long, text string"))
    fitted = quality.fit(d, spark.createDataFrame([(7, 1), (8, 0)] * 50, "doc_id long, quality int"), params=quality.QualityParams(buckets=1 << 12, per_class=100, epochs=1))
    assert len(fitted[0]) == 1 << 12


def test_quality_scores_are_the_plain_average(spark):
    """The query's way of scoring against a mean over bags made word by word, and the training against its own sums."""
    p = quality.QualityParams(buckets=1 << 14)
    rng = np.random.default_rng(2)
    logit, bias = rng.normal(size=p.buckets).astype(np.float32), 0.3
    texts = [t for _, t in ODD] + ["One two two, ünï three", "a", "the the the the"]
    got = quality.score(pa.array(texts, pa.string()), logit, bias, p)
    for t, s, (ids, share) in zip(texts, got, quality.bags(pa.array(texts, pa.string()), p)):
        z = bias + float((logit[ids].astype(float) * share).sum())
        assert abs(s - 1 / (1 + np.exp(-z))) < 1e-6
        w = [x.encode() for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        n = sum(1 + sum(max(0, len(x) + 2 - g + 1) for g in p.ngrams) for x in w) + max(0, len(w) - 1)
        assert (len(ids) > 0) == (n > 0) and (not n or abs(share.min() - round(share.min() * n) / n) < 1e-6)


def test_language_solution_is_the_direct_one():
    """Kernel ridge over Nystrom features against the same normal equations written out, and scores against plain kernels."""
    p = langid.LangParams(bins=1 << 10, landmarks_per_lang=4, block=3)
    texts = ["the cat and the hat", "a dog in the fog", "der hund und die katze", "ein haus am see", "le chat et le chien", "une maison bleue"] * 2
    langs = ["en", "en", "de", "de", "fr", "fr"] * 2
    dense = np.concatenate([x for _, x in langid.presence(pa.array(texts), p)])
    names, bits, weights = langid.solve(np.packbits(dense > 0, axis=1), langs, p)
    rows, base = langid.normal(dense.copy()).astype(float), langid.unpacked(bits).astype(float)
    values, vectors = np.linalg.eigh(base @ base.T)
    phi = np.hstack([rows @ base.T @ (vectors[:, values > 1e-6] / np.sqrt(values[values > 1e-6])), np.ones((len(rows), 1))])
    y = np.where(np.array(langs)[:, None] == np.array(names), 1.0, -1.0)
    ridge = np.diag([p.ridge * len(y)] * (phi.shape[1] - 1) + [0.0])
    beta = np.linalg.solve(phi.T @ phi + ridge + 1e-9 * np.eye(phi.shape[1]), phi.T @ y)
    assert np.allclose(phi @ beta, rows @ base.T @ weights[:-1] + weights[-1], atol=1e-3)
    grams = lambda t: {(n, t.encode()[i : i + n]) for n in p.orders for i in range(len(t) - n + 1)}
    big = langid.LangParams(bins=1 << 18)
    x = langid.normal(np.concatenate([x for _, x in langid.presence(pa.array(texts[:4]), big)]))
    for i in range(4):
        for j in range(4):
            a, b = grams(texts[i]), grams(texts[j])
            assert abs(float(x[i] @ x[j]) - len(a & b) / np.sqrt(len(a) * len(b))) < 0.02
    got, _ = langid.predict(pa.array(texts), np.ones(len(texts), bool), (names, langid.unpacked(bits).T, weights), p)
    assert got == langs


@tables
@pytest.mark.parametrize("name", ["op4_mix", "op6_jaccard", "op7_media", "op8_tokens"])
def test_queries_are_brute_force(spark, name):
    """The registered queries over the smallest tables against plain Python."""
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    got = queries.QUERIES[name](spark, SF).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    if name == "op6_jaccard":
        assert {i: (r["n_shingles"], r["component_id"]) for i, r in by.items()} == brute_components([r[:2] for r in rows], 4, 85, 100)
    elif name == "op7_media":
        for i, t, _ in rows:
            raw = (t or "").encode()
            full = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
            r = by[i]
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
    elif name == "op8_tokens":
        from tokenizers import Tokenizer

        plain, start = Tokenizer.from_file(queries.token_params().tokenizer), 0
        for i, t, _ in sorted(rows):
            ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
            assert (by[i]["start"], by[i]["n_tokens"], by[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
            start += len(ids)
    else:
        size = {i: len(words(t)) for i, t, _ in rows}
        names = sorted({s for *_, s in rows if s is not None}, key=str.encode) + [None] * any(s is None for *_, s in rows)
        sums = np.array([sum(size[i] for i, _, s in rows if s == n) for n in names], dtype=float)
        want = dict(zip(names, mixing.targets(sums, np.resize([3.0, 1.0, 2.0], len(names)), 1.5 * sums.sum(), 2.0)))
        taken = Counter()
        for i, _, s in rows:
            r = by[i]
            assert r["size"] == size[i] and r["source_size"] == sums[names.index(s)] and abs(r["target"] - want[s]) < 1e-6 and 0 <= r["taken"] <= 2 * size[i]
            taken[s] += r["taken"]
        assert all(abs(taken[n] - want[n]) <= 64 for n in names)


def test_small_sources_are_taken(spark):
    rows = [(i, "w " * 400, "a") for i in range(50)] + [(100, "w " * 7, "b"), (101, "w", "c"), (102, "w " * 12, None)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert all(abs(sum(r["taken"] for r in got if r["doc_id"] == i) - next(r["target"] for r in got if r["doc_id"] == i)) <= 1 for i in (100, 101, 102))


def test_damaged_member(spark):
    png = media.encode_png(b"abc" * 50)
    rows = [("a", 0, "7.png", bytearray(png[:-20] + b"x" + png[-19:])), ("a", 1, "8.png", bytearray(png))]
    got = {r["doc_id"]: r for r in media.features(spark.createDataFrame(rows, media.MEMBERS)).collect()}
    assert got[7]["feature"].startswith("damaged") and got[7]["payload_sha256"] is None and got[8]["n_bytes"] == 150


def test_encoder_remembers_words_that_come_again():
    """Words that come once would fill the memory of a worker, which later stages share with it."""
    p = queries.token_params()
    enc = tokenio.Encoder(p.tokenizer, p)
    rng = random.Random(31)
    text = " ".join(sorted({"".join(rng.choices("abcdefghij", k=9)) + rng.choice(["", ".", ",", "7"]) for _ in range(20_000)}))
    first = enc.batch([text])
    assert first == [enc.whole(text)] and len(enc.cache) < 400
    assert enc.batch([text]) == first and len(enc.cache) >= 19_000
    remembered = dict(enc.cache)
    assert enc.batch([text, "one " + text]) == [enc.whole(text), enc.whole("one " + text)] and remembered.keys() <= enc.cache.keys()
    few = tokenio.Encoder(p.tokenizer, tokenio.TokenParams(tokenizer=p.tokenizer, marks=64))
    assert few.batch([text, text]) == first * 2


def test_encoder_of_texts_with_special_strings():
    e = tokenio.Encoder(tokens().tokenizer, tokens())
    rng = random.Random(8)
    some = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|StartOfText|>", "<|start", "of", "text|>", "a", "The,", "\u00a0", "\u212aelvin", "\u0130x", "e\u0301.", "'s", "it's", "12", "\n", "<|endoftext|>b"]
    texts = ["a <|ENDOFTEXT|> b"] + ["".join(rng.choice([" ", "", "\t"]) + rng.choice(some) for _ in range(rng.randint(1, 12))) for _ in range(300)]
    assert e.batch(texts) == [e.whole(t) for t in texts]


def test_encoder_of_any_letters():
    """Words of letters of all scripts, marks and digits, over chunks of a few texts; lines that can't be cut by their last tokens too."""
    rng = random.Random(9)
    planes = [(0x61, 0x7B), (0xC0, 0x250), (0x370, 0x530), (0x5D0, 0x700), (0x900, 0xE00), (0x1C80, 0x2000), (0x2160, 0x2190), (0x3040, 0x4E40), (0xA640, 0xABC0), (0xAC00, 0xAC80), (0xFB00, 0xFDD0), (0x10400, 0x10500), (0x1E900, 0x1E960), (0x30, 0x3A), (0x300, 0x370)]
    texts = []
    for _ in range(400):
        low, high = rng.choice(planes)
        texts.append(" ".join("".join(chr(rng.randrange(low, high)) for _ in range(rng.randint(1, 5))) + rng.choice(["", "", ".", ","]) for _ in range(rng.randint(0, 60))))
    for change in ({"chunk_bytes": 300}, {"cache": 1 << 20, "longest": 64}):
        e = tokenio.Encoder(tokens().tokenizer, tokenio.TokenParams(**(tokens().__dict__ | change)))
        assert e.ends.any() and e.batch([None, *texts, ""]) == [b"", *(e.whole(t) for t in texts), b""]


def test_encoder_of_another_tokenizer():
    import public_tokenizers

    other = tokenio.Encoder(public_tokenizers.path("byte_bpe_50k.json"), tokens())
    texts = ["Two  spaces, CAPITALS and\nlines.", "<|endoftext|> x", " lead"]
    assert not other.by_word and other.batch(texts) == [other.whole(t) for t in texts]


def test_warc_hot_payloads(spark):
    """Payloads over and under the bound of what is broadcast give the same records."""
    rows = [(i, f"http://a/{i}", ("hot " * 40) if i % 3 == 0 else f"page {i // 4} " * 30 if i % 3 == 1 else "short") for i in range(60)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    arc = warc.write_arc(d, "page_id", "url", "html")
    out = [sorted(tuple(r) for r in warc.warc_records(warc.files(spark, warc.to_warc(spark, arc, warc.WarcParams(hot=h, records=7)))).collect()) for h in (1 << 16, 3)]
    first = {}
    for i, _, h in rows:
        first[h] = min(i, first.get(h, i))
    want = {str(i): str(first[h]) if len(h) >= 100 and first[h] != i else None for i, _, h in rows}
    assert out[0] == out[1] and {r[0]: r[6] for r in out[0]} == want and len(out[0]) == 60
