"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymetric.llm import html_extract as H
from waymetric.llm import packing as K
from waymetric.llm.chat_format import assemble, rotate_perspectives
from waymetric.llm.components import connected_components
from waymetric.llm.exact_dedup import build_directory, dedup_exact
from waymetric.llm.jaccard_join import Trie, jaccard_components, word_hashes
from waymetric.llm.packing import cutting_stock, pack
from waymetric.llm.quality import quality_rules
from waymetric.llm.sentencepiece_sa import SuffixArrayModel, decode_ids, encode_texts
from waymetric.llm.shared_tokens import packed, unpacked
from waymetric.llm.suffix_dedup import remove_repeats, repeated_windows
from waymetric.llm.url_filter import PAGE_RULES, filter_urls, rules_frame
from waymetric.llm.warc import plan_records, read_archives, warc_round_trip, write_archives

DOCS = "doc_id long, text string, source string, row long, norm string, key string"
tokenizers = pytest.importorskip("public_tokenizers")


def low(b):
    return b.translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))


def corpus(seed, n=60, words=40):
    """Random texts with copies, near copies, shared passages, nulls, empties and one long text."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 7))) for _ in range(300)]
    passage = " ".join(r.choice(vocab) for _ in range(40))
    texts = []
    for i in range(n):
        t = " ".join(r.choice(vocab) for _ in range(r.randint(1, words)))
        k = r.random()
        if texts and k < 0.15:
            t = r.choice(texts)
        elif texts and k < 0.45:
            w = (r.choice(texts) or "").split(" ")
            w[r.randrange(len(w))] = r.choice(vocab)
            t = " ".join(w)
        elif k < 0.6:
            t = t + "\n" + passage
        elif k < 0.65:
            t = None
        elif k < 0.7:
            t = r.choice(["", " ", "\n\t", "A", "a", "ß"])
        elif k < 0.75:
            t = "xy " * 80
        texts.append(t)
    texts.append(" ".join(r.choice(vocab) for _ in range(5000)))
    return texts


def frame(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, f"s{k % 2}" if k % 5 else None, k, "x", "y") for k, (i, t) in enumerate(zip(ids, texts, strict=True))], DOCS)


# -- 1 ---------------------------------------------------------------------------------------------------------------


def test_url_filters(spark):
    urls = [
        "http://A.Example.ORG/es/1?x", "https://example.org/en/12", "https://example.org/en/2", "http://x.org", "http://x.org/", "http://notorg/", "http://a.com/fr/", "http://a.com/de/9#top",
        "http://a.com/xx", None, "no scheme /fr/", "http:///path", "http://a.b.c.d.e.f.org/" + "p" * 3000, "x://org/es/", "http://org.com/de/", "http://example.org//es/",
    ]
    df = spark.createDataFrame([(i % 14, u, "clash", "clash") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")

    def want(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = low(re.match(r"[^/?#]*", rest)[0].encode()).decode()
        path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
        fits = [(len(h + p), h, a, h + p) for a, h, p in PAGE_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        return host, path, best and best[3], best[2] if best else "allow"

    got = filter_urls(df, rules_frame(spark, PAGE_RULES)).collect()
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == Counter((i % 14, *want(u)) for i, u in enumerate(urls))
    assert filter_urls(df.where("false"), rules_frame(spark, PAGE_RULES)).count() == 0
    assert {r.verdict for r in filter_urls(df, rules_frame(spark, []), default="block").collect()} == {"block"}
    # without broadcasts the answer is the same
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(str, filter_urls(df, rules_frame(spark, PAGE_RULES)).collect())) == sorted(map(str, got))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# -- 2 ---------------------------------------------------------------------------------------------------------------


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    path = str(tokenizers.path("word_bpe_49k.json"))
    texts = corpus(5) + ["It's ÉCOLE's 3.14, a.b. \u1e9b\u0323 x\u0301, <|endoftext|> <|ENDOFTEXT|> end.", "e\u0301,. E\u0301. .,\u0301", "x" * 3000, "a\0b\u00a0c\u2003d"]
    ids = [None if k == 3 else 7 if k == 4 else k for k in range(len(texts))]
    t = Tokenizer.from_file(path)
    want = [[*e.ids, 2] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    rows = pack(frame(spark, texts, ids), path, capacity=512, with_ids=True).collect()
    got = Counter()
    for r in rows:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length <= 2048
        got[(r.doc_id, r.start, bytes(r.ids), r.doc_tokens)] += 1
    assert got == Counter((i, a, np.array(w[a : a + 512], "<u4").tobytes(), len(w)) for i, w in zip(ids, want, strict=True) for a in range(0, len(w), 512))
    for s in {r.sequence_id for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 512
    assert pack(frame(spark, []), path).count() == 0


def test_packing_wastes_little_on_short_texts(spark):
    path = str(tokenizers.path("word_bpe_49k.json"))
    for words, copies in ((0, 9000), (16, 3000), (40, 2000)):
        df = spark.range(copies).selectExpr("id as doc_id", f"repeat('the ', {words}) as text")
        rows = pack(df, path).collect()
        assert sum(r.length for r in rows) == copies * (words + 1) and len(rows) == copies
        full = -(-copies * (words + 1) // 4096)
        assert len({r.sequence_id for r in rows}) <= full * 1.04 + 1
        spans = sorted((r.sequence_id, r.offset, r.length) for r in rows)
        assert all(b[1] == (a[1] + a[2] if a[0] == b[0] else 0) for a, b in zip(spans[:-1], spans[1:], strict=True))


def test_packing_with_another_tokenizer_and_with_colliding_hashes(monkeypatch):
    from tokenizers import Tokenizer

    texts = [(t or "") for t in corpus(15)[:40]] + ["X" * 400 + " y " + "x" * 400 + ".", "a.\tb..", "<|endoftext|> A."]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = str(tokenizers.path(name))
        want = [[*e.ids, 2] for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
        for weak in (False, True):
            if weak:  # the first hash says nothing: the second one tells
                whole = K._Hash.of
                monkeypatch.setattr(K._Hash, "of", lambda self, a, b, whole=whole: whole(self, a, b) & np.uint64(7 if int(self.down[1:2].sum()) == pow(K._BASES[0], -1, 1 << 64) else 2**64 - 1))
            words = K.WordIds(path)
            for _ in range(2):
                ids, ends = words.encode([t.encode() for t in texts], 2)
                assert [x.tolist() for x in np.split(ids, ends[:-1])] == want
            monkeypatch.undo()


def test_cutting_stock_is_near_the_bound():
    r = np.random.default_rng(3)
    sizes = np.unique(r.integers(1, 257, 120))
    demand = r.integers(1, 400, len(sizes))
    plan = cutting_stock(sizes, demand, 256)
    assert (sum(p * n for p, n in plan) == demand).all() and all((p * sizes).sum() <= 256 for p, _ in plan)
    assert sum(n for _, n in plan) <= 1.02 * (sizes * demand).sum() / 256 + 3
    assert K.best_pattern(np.array([3, 5]), np.array([3.1, 5.0]), 11)[0] == pytest.approx(11.2)


# -- 3 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, weak):
    texts = corpus(1) + ["É", "é", "ABC", "abc"]
    ids = [None if k % 9 == 2 else k for k in range(len(texts))]
    key = F.pmod(F.length("norm"), F.lit(3)).cast("long") if weak else None
    rows = dedup_exact(frame(spark, texts, ids), key=key, bucket_entries=4).collect()
    norm = [low((t or "").encode()) for t in texts]
    keep, size = {}, Counter(norm)
    for i, n in zip(ids, norm, strict=True):
        keep[n] = max((x for x in (keep.get(n), i) if x is not None), default=None)
    want = Counter((i, keep[n], size[n], hashlib.sha256(n).hexdigest()) for i, n in zip(ids, norm, strict=True))
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows) == want
    assert sum(r.kept for r in rows) == len(size) and all(r.kept == (r.doc_id == r.keep_id) for r in rows if r.keep_id is not None)
    assert dedup_exact(frame(spark, [])).count() == 0


def test_chain_links_part_the_texts_of_one_key(spark):
    from waymetric.llm.exact_dedup import chain_links

    texts = ["a", "b", "a", "c", "d", "d", "d", ""]
    rows = spark.createDataFrame([(k, t, 1 if t in "abc" else 2) for k, t in enumerate(texts)], "at long, norm string, key long")
    got = {(r.key, r.sha): (r.link, r.keep, r.group_size) for r in chain_links(rows).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    # the empty text is in every string, so that it is in the chain of the first key
    assert got == {(1, sha("")): (0, 7, 1), (1, sha("a")): (1, 2, 2), (1, sha("b")): (2, 1, 1), (1, sha("c")): (3, 3, 1), (2, sha("d")): (0, 6, 3)}


def test_exact_dedup_repeated_rows_keep_one(spark):
    rows = dedup_exact(frame(spark, ["a", "A", "a", "b"], [5, 5, 1, 5])).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in rows) == [(1, 5, 3), (5, 5, 1), (5, 5, 3), (5, 5, 3)] and sum(r.kept for r in rows) == 2


def bucket_of(key, rows):
    cell = key & (2**64 - 1)
    return [(r.depth, r.prefix) for r in rows if (cell >> (64 - r.depth) if r.depth else 0) == r.prefix & (2**64 - 1)]


def test_directory_covers_every_key_once(spark):
    keys = spark.range(500).select(F.xxhash64("id").alias("key"))
    rows = build_directory(keys, 16).collect()
    assert all(r.entries <= 16 for r in rows) and sum(r.entries for r in rows) == 500
    assert len({r.depth for r in rows}) > 1  # some buckets have split
    assert all(len(bucket_of(key, rows)) == 1 for (key,) in keys.collect())


def test_directory_doubles_below_equal_prefixes_and_chains_equal_keys(spark):
    # keys that differ in their last bits only, negative ones, and one key many times over
    values = [*range(40), *(-k for k in range(1, 40)), *[7 << 40] * 50, -(2**63), 2**63 - 1]
    rows = build_directory(spark.createDataFrame([(v,) for v in values], "key long"), 4).collect()
    assert sum(r.entries for r in rows) == len(values) and max(r.depth for r in rows) >= 62
    assert all(r.entries <= 4 or r.low == r.high for r in rows)
    assert all(len(bucket_of(v, rows)) == 1 for v in values)
    assert build_directory(spark.createDataFrame([], "key long"), 4).count() == 0


def test_exact_dedup_answers_come_from_the_index(spark, monkeypatch):
    from waymetric.llm import exact_dedup as E

    # a directory that has lost a bucket loses that bucket's rows
    whole = E.build_directory
    monkeypatch.setattr(E, "build_directory", lambda e, n: whole(e, n).where("prefix <> 0"))
    texts = [f"text number {i // 2}" for i in range(400)]
    assert 0 < E.dedup_exact(frame(spark, texts), bucket_entries=16).count() < 400


# -- 4 ---------------------------------------------------------------------------------------------------------------


def test_chat_perspectives(spark):
    rows = [(1, 0, "system", "be nice"), (1, 1, "ann", "hi <|x"), (1, 2, "bob", None), (1, 3, "ann", "bye"), (2, 0, "system", "alone"), (3, None, None, "?"), (None, 1, "ann", "n"), (1, 3, "ann", "bye")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, position string")
    whole = {(r.conv_id, r.perspective): r for r in assemble(rotate_perspectives(df)).collect()}
    assert set(whole) == {(1, "ann"), (1, "bob"), (3, None), (None, "ann")}
    ann = whole[(1, "ann")]
    assert ann.text == "<|system|>\nbe nice<|end|>\n<|assistant|>\nhi <||x<|end|>\n<|user name=bob|>\n<|end|>\n" + 2 * "<|assistant|>\nbye<|end|>\n"
    assert [ann.text[int(a) : int(b)] for a, b in (m.split("-") for m in ann.masks.split(","))] == ["hi <||x<|end|>", "bye<|end|>", "bye<|end|>"]
    assert "<|user name=ann|>\nbye" in whole[(1, "bob")].text and rotate_perspectives(df.where("false")).count() == 0
    parts = assemble(rotate_perspectives(df), part_chars=30).where("conv_id = 1 and perspective = 'ann'").orderBy("part").collect()
    assert len(parts) > 1 and "".join(p.text for p in parts) == ann.text and ",".join(p.masks for p in parts if p.masks) == ann.masks


def test_chat_against_a_plain_loop(spark):
    r = random.Random(7)
    names = ["ann", "bob|>\n<|assistant|>\n", None, "unknown", "system", "%7C", "|", "ü"]
    rows = [(r.choice([1, 2, None]), r.choice([None, *range(6)]), r.choice(names), r.choice(["", None, "a <|end|>\n", "é" * 9])) for _ in range(60)]
    speakers: dict = {}
    for conv, _, name, _ in rows:
        if name != "system":
            speakers.setdefault(conv, set()).add(name)
    null_first = lambda x: (x is not None, x or 0)
    want = {}
    for conv, people in speakers.items():
        for me in people:
            turns = []
            for c, turn, name, text in rows:
                if c == conv:
                    shown = "".join(f"%{ord(x):02X}" if x in "%<>|\n\r" else x for x in name or "")
                    head = "<|assistant|>" if name == me else "<|system|>" if name == "system" else "<|user|>" if name is None else f"<|user name={shown}|>"
                    body = (text or "").replace("<|", "<||") + "<|end|>\n"
                    turns.append((null_first(turn), null_first(name) if name is None else (True, name), f"{head}\n{body}", len(head) + 1, name == me))
            text, masks = "", []
            for _, _, whole, n_head, own in sorted(turns, key=lambda t: (t[0], t[1][0], t[1][1] or "", t[2])):
                if own:
                    masks.append(f"{len(text) + n_head}-{len(text) + len(whole) - 1}")
                text += whole
            want[conv, me] = (len(turns), text, ",".join(masks))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = assemble(rotate_perspectives(df)).collect()
    assert {(g.conv_id, g.perspective): (g.n_turns, g.text, g.masks) for g in got} == want


# -- 5 ---------------------------------------------------------------------------------------------------------------


def brute_repeats(docs, length):
    seen, out = set(), {}
    for i, t in docs:
        b = (t or "").encode()
        cover = bytearray(len(b))
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            if w in seen:
                cover[k : k + length] = b"\1" * length
            seen.add(w)
        kept = bytes(c for c, m in zip(b, cover, strict=True) if not m)
        out[i] = (len(b), sum(cover), len(re.findall(rb"\x01+", bytes(cover))), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore"))
    return out


@pytest.mark.parametrize(("hot", "warm"), [(0xFFFF, 256), (0xFFFF, 2), (2, 256), (3, 5)])
def test_suffix_dedup(spark, hot, warm):
    texts = corpus(2) + ["ab" * 300, "é" * 200, "q" * 99, "r" * 101, None, "\0\1" * 90]
    df = frame(spark, texts).repartition(3, "doc_id")
    df.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/repeats-{hot}-{warm}")
    rows = remove_repeats(spark.read.parquet(path), hot=hot, warm=warm, with_text=True).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.kept_text) for r in rows} == brute_repeats(list(enumerate(texts)), 100)
    assert remove_repeats(spark.read.parquet(path).where("false")).count() == 0


def test_suffix_dedup_across_slices_and_pieces(spark, monkeypatch):
    """Texts longer than a slice and a piece, with a passage that many of them share."""
    from waymetric.llm import suffix_dedup as S

    r = random.Random(21)
    passage = "".join(r.choice("abcdefghijklmnop ") for _ in range(400))
    long = "".join(r.choice("abcdefgh ") for _ in range(S.PIECE_BYTES + 5000))
    texts = [long[:-3000] + passage, passage + long[-9000:], long[S.PIECE_BYTES - 300 : S.PIECE_BYTES + 300]]
    texts += ["".join(r.choice("qrstuvwxyz") for _ in range(150)) + passage[k : 400 - k] for k in range(40)]
    frame(spark, texts).repartition(5).write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/repeats-long")
    rows = remove_repeats(spark.read.parquet(path), warm=8, with_text=True).collect()
    assert {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256, x.kept_text) for x in rows} == brute_repeats(list(enumerate(texts)), 100)


def test_suffix_dedup_repeated_and_null_ids(spark):
    r = random.Random(4)
    text = "".join(r.choice("abcdefgh") for _ in range(300))
    rows = remove_repeats(frame(spark, [text, text, "x" + text, text], [3, 3, None, 2]).coalesce(1)).collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in rows) == [(-1, 0), (2, 300), (3, 300), (3, 300)]


def test_interval_expansion():
    r = random.Random(3)
    for _ in range(40):
        base = bytes(r.choice(b"abc\x00\xff") for _ in range(60))
        strings = [base[a : a + r.randint(9, 30)] for a in (r.randint(0, 30) for _ in range(6))]
        strings += strings[:2]  # equal ones too
        ids = np.array([r.randint(0, 3) for _ in strings])
        starts = np.arange(len(strings)) * 1000
        where = {}
        for s, i, at in zip(strings, ids.tolist(), starts.tolist(), strict=True):
            for j in range(len(s) - 8):
                where.setdefault(s[j : j + 9], []).append((i, i * 10, at + j))
        want = {k[1:] for v in where.values() for k in v if k != min(v)}
        assert {(row, s + j) for row, s, n in repeated_windows(strings, ids, ids * 10, starts, 9) for j in range(n)} == want


def test_blocks_round_trip():
    for n in (0, 1, 2, 500):
        x = np.sort(np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64))
        assert (unpacked(packed(x), n) == x).all()


# -- 6 ---------------------------------------------------------------------------------------------------------------


def brute_components(docs):
    sets, group = {}, {}
    for i, t in docs:
        w = low((t or "").encode()).split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        group[i] = i
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    return {i: (len(sets[i]), group[i]) for i in sets}


@pytest.mark.parametrize("block_sets", [256, 3])
def test_jaccard_components(spark, block_sets):
    r = random.Random(8)
    base = [f"w{r.randrange(10**6)}" for _ in range(60)]
    near = []
    for k in range(25):  # one large group of near copies, linked through some of them only
        w = list(base)
        for _ in range(k % 4):
            w[r.randrange(60)] = f"x{r.randrange(10**6)}"
        near.append(" ".join(w) if k % 2 else " ".join(w).upper())
    texts = corpus(6, words=120) + near + ["one two three", "One two  three", "one two"]
    rows = jaccard_components(frame(spark, texts), block_sets=block_sets).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_components(list(enumerate(texts)))
    assert jaccard_components(frame(spark, [])).count() == 0


def test_shared_tokens_with_frequent_ones(spark, monkeypatch):
    """Tokens that a unit sends as counts come back as if they had been sent one by one."""
    from waymetric.llm import shared_tokens as S

    r = random.Random(5)
    docs = [sorted({r.choice([1, 2, 3]) if r.random() < 0.4 else r.randrange(4, 400) for _ in range(8)}) for _ in range(300)]
    df = spark.createDataFrame([(i, i, ",".join(map(str, d))) for i, d in enumerate(docs)], "row long, id long, text string").repartition(4)

    def emit(texts):
        pairs = [(int(x) * 0x9E3779B97F4A7C15 % 2**48) << 16 | i for i, t in enumerate(texts) for x in t.decode().split(",")]
        return np.sort(np.array(pairs, np.uint64)), {"n": [len(t) for t in texts]}

    def finish(meta, values, counts, edges):
        import pyarrow as pa

        lists = [[f"{v}:{c}" for v, c in zip(values[a:b].tolist(), counts[a:b].tolist(), strict=True)] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return pa.table({"row": pa.array(meta["row"], pa.int64()), "got": pa.array(lists, pa.list_(pa.string()))})

    n = Counter(x for d in docs for x in d)
    token = lambda x: x * 0x9E3779B97F4A7C15 % 2**48
    want = {i: [f"{token(x)}:{n[x]}" for x in sorted(d, key=lambda x: (n[x], token(x))) if n[x] > 1] for i, d in enumerate(docs)}
    got = {x.row: list(x.got) for x in S.shared_tokens(df, emit, finish, "row long, got array<string>", 300 << 20).collect()}
    assert got == want and max(n.values()) > 2 * S.OFTEN


def test_jaccard_repeated_and_null_ids(spark):
    rows = jaccard_components(frame(spark, ["a b c d e f"] * 3 + ["p q r s t"] + [None], [None, 4, 4, None, 9])).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in rows) == [("4", 2, "4"), ("4", 2, "4"), ("9", 0, "9"), ("None", 1, "None"), ("None", 2, "4")]


def test_word_hashes_do_not_depend_on_pieces():
    texts = [(t or "").encode() for t in corpus(12)]
    whole, small = word_hashes(texts), word_hashes(texts, 7)
    assert all((a == b).all() for a, b in zip(whole, small, strict=True))
    assert len(whole[0]) == sum(len(t.split()) for t in texts) and len(set(whole[0].tolist())) == len({w for t in texts for w in low(t).split()})


def test_trie_finds_what_pairs_find():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 14, r.integers(1, 14))) for _ in range(60)]
    n = np.array([len(s) + int(r.integers(0, 3)) for s in sets])
    trie = Trie(sets, n)
    for i, s in enumerate(sets):
        want = [j for j, o in enumerate(sets) if 100 * (k := len(np.intersect1d(s, o))) >= 80 * (n[i] + n[j] - k)]
        assert sorted(trie.similar(s, int(n[i]), 14, 80)) == want


def test_components_by_stars(spark):
    r = random.Random(2)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 160)]
    group = {i: i for e in edges for i in e}
    for _ in range(70):
        for a, b in edges:
            group[a] = group[b] = min(group[a], group[b])
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in group.items() if any(k in e and e[0] != e[1] for e in edges)}


# -- 7 ---------------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1><p>Your daily news from the region, every day.</p></header><nav><ul><li><a href="/">Home</a><li><a href="/b">News of the day</a></ul></nav>
<div class="cookie-notice">We use cookies to make this site work better for all of its readers. Accept them all.</div>
<div id=content><article><h1>A &amp; B</h1><p><b>First &lt;words&gt;<br>here.<p>Second   paragraph
with text.</p><div class="share">Share this article with your friends on all networks now.</div><p>Ok.</p><p>Third one, with a <a href="x">link</a> in it &copy 2020.</p>
<section class="comments"><p>I liked this article very much, thanks for all of it.</p></section></article></div>
<aside><p>Most read: something that has nothing to do with the article at all.</p></aside>
<form><p>Sign up for our newsletter and get all news by mail.</p><input></form><footer>&copy; Site. All rights reserved, here and there.</footer></body>"""


def test_html_extraction(spark):
    want = "A & B\nFirst <words> here.\nSecond paragraph with text.\nOk.\nThird one, with a link in it © 2020."
    pages = [PAGE, None, "", "<p", "<!-- open", "plain text only, with some words in a sentence of its own.", "<nav>a</nav>", "<p>x < y and <b>z</p" + " long" * 20000, '<a "' * 3000]
    df = spark.createDataFrame([(i, None, p, 5) for i, p in enumerate(pages)], "page_id long, url string, html string, n_chars long")
    got = {r.page_id: r for r in H.extract_main_text(df).collect()}
    assert got[0].text == want and got[0].n_chars == len(want) and all(got[i].text == "" for i in (1, 2, 4, 6)) and len(got) == len(pages)
    assert H.extract_main_text(df.where("false")).count() == 0


def test_minimum_cut_is_minimal():
    r = random.Random(5)
    for _ in range(150):
        n = r.randint(1, 7)
        cap = [r.randint(-9, 9) for _ in range(n)]
        edges = [(a, b, r.randint(1, 6)) for a in range(n) for b in range(a + 1, n) if r.random() < 0.5]
        cost = lambda x: sum(abs(c) for c, k in zip(cap, x, strict=True) if (c > 0) != k and c) + sum(c for a, b, c in edges if x[a] != x[b])  # noqa: B023, E731
        assert cost(H.minimum_cut(cap, edges)) == min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))


# -- 8 ---------------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    big, r = "é<p>\r\n\r\nWARC/1.1\r\n" * 20000, random.Random(1)
    html = [big, "a" * 999, "a" * 999, "b" * 1000, "b" * 1000, "b" * 1000, None, "", "c" * 2000, "c" * 2000, big, "".join(chr(r.randint(1, 0x2FF)) for _ in range(70000))]
    ids = [0, 1, 2, 3, 4, 5, 6, 7, 8, 8, 9, None]
    df = spark.createDataFrame([(i, None if k == 2 else f"http://x/\r\n{k}", h, "clash") for k, (i, h) in enumerate(zip(ids, html, strict=True))], "page_id long, url string, html string, payload string")
    want = []
    for i, h in zip(ids, html, strict=True):
        b = (h or "").encode()
        top = max((j for j, g in zip(ids, html, strict=True) if g == h and j is not None), default=None)
        again = len(b) >= 1000 and top is not None and i != top
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", top if again else None))
    rows = warc_round_trip(df).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows) == Counter(want) and all(r.verified for r in rows)
    assert warc_round_trip(df.where("false")).count() == 0
    archives = write_archives(plan_records(df, id_col="page_id", url_col="url", payload_col="html"), f"{spark.conf.get('spark.checkpoint.dir')}/warc-small", chunk_bytes=1000, archive_bytes=5000)
    chunks = read_archives(archives, chunk_bytes=700).where("page_id = 9").orderBy("chunk").collect()
    assert archives.count() > 2 and b"".join(bytes(c.data) for c in chunks) == big.encode() and [c.chunk for c in chunks] == list(range(len(chunks))) and chunks[-1].last
    names = read_archives(archives).where("chunk = 0").select("record_id", "record_date").collect()
    assert len({n.record_id for n in names}) == len(names) == len(ids) and all(re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", n.record_date) for n in names)
    assert all(len(c.data) <= 700 for c in chunks) and chunks[1].digest_so_far == hashlib.sha1(big.encode()[:1400]).hexdigest()


# -- 9 ---------------------------------------------------------------------------------------------------------------


def test_quality_rules(spark):
    texts = corpus(9) + ["a b\n a b\nA B\n\n \na b", "x\x0by\x0cz\u00a0w é#*$%", "the same words here again the same words here again " * 3]
    rows = {r.doc_id: r for r in quality_rules(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        c, cover = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)), set()
        for k in range(len(w) - 4):
            if c[tuple(w[k : k + 5])] > 1:
                cover |= set(range(k, k + 5))
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover), len(w) < 10 or 100 * len(cover) > 20 * len(w))
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want and not (r.kept and r.base_failed)
    assert quality_rules(frame(spark, [])).count() == 0


def test_frequent_lines_go_and_depleted_documents_with_them(spark):
    menu = "Home   News CONTACT imprint about us login search more and so on"
    texts = [f"{menu}\nown words number {i} a{i} b{i} c{i} d{i} e{i} f{i} g{i} h{i}" for i in range(30)] + [menu.lower(), f" {menu} \nx{1}"] + ["a copied text that is long enough to be kept by all of the rules here"] * 40
    df = spark.createDataFrame([(i, t, "h") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    rows = {r.doc_id: r for r in quality_rules(df, with_text=True).collect()}
    assert all(rows[i].kept and rows[i].clean_text.startswith("own words") for i in range(30)) and not rows[30].kept and not rows[31].kept and rows[30].clean_text == ""
    assert all(rows[i].kept and rows[i].clean_text == texts[i] for i in range(32, 72))


def test_frequent_lines_of_small_hosts_and_long_lines(spark):
    rows = [(f"seen again\nown text of document number {i} " + " ".join(f"{h}{i}w{k}" for k in range(12)), h) for h, n in (("small", 12), ("five", 5), ("large", 300)) for i in range(n)]
    rows += [(f"now and then\nown text {i} " + " ".join(f"n{i}w{k}" for k in range(12)), "large") for i in range(20)] + [("Seen\tAGAIN \u00a0x\n" + "w " * 60000 + "seen again", None)] * 2
    df = spark.createDataFrame([(i, t, h) for i, (t, h) in enumerate(rows)], "doc_id long, text string, source string")
    lost = {r.doc_id: r.clean_text != rows[r.doc_id][0] for r in quality_rules(df, with_text=True).collect()}
    # more than a tenth of 12 documents, and more than 20 of 320; but not five, and not 20
    assert sorted(i for i in lost if lost[i]) == [i for i, (t, h) in enumerate(rows) if h in ("small", "large") and t.startswith("seen")]


def test_quality_filter_keeps_columns_and_takes_lines_out(spark):
    from waymetric.llm.quality import filter_documents

    texts = [f"Common  LINE of all\nown text of number {i} " + " ".join(f"a{i}w{k}" for k in range(12)) + ("\ncommon line of all" if i % 2 else "") for i in range(30)] + [None, "", "short"]
    df = spark.createDataFrame([(i, t, "s", 7, i, [i], len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, source string, row long, gone long, d array<long>, n_chars long")
    df.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/quality-filter")
    out = filter_documents(spark.read.parquet(path))
    rows = {r.doc_id: r for r in out.collect()}
    assert out.columns == df.columns and set(rows) == set(range(30))
    for i, r in rows.items():
        assert r.text == texts[i].split("\n")[1] and r.n_chars == len(r.text) and (r.row, r.gone, r.d) == (7, i, [i])
    assert filter_documents(spark.read.parquet(path).where("false")).count() == 0


# -- 10 --------------------------------------------------------------------------------------------------------------


def test_sentencepiece_matches_the_library(spark):
    import sentencepiece

    path = str(tokenizers.path("piece_bpe_32k.model"))
    sp, r = sentencepiece.SentencePieceProcessor(model_file=path), random.Random(1)
    texts = ["", None, "  hello   world\n\tx ", "\u2581a b", "a<s>b<0x41> ﬁ É", "\x00a", "日本語 テキスト 😀😀", " " * 40, "a" * 5000, "\r\n\r\n  x"]
    texts += ["".join(r.choice("ab \u2581.éñ\n😀thein") for _ in range(r.randint(0, 60))) for _ in range(300)] + corpus(3)
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    rows = {r.doc_id: r.ids for r in encode_texts(df, path).collect()}
    assert all(rows[i] == sp.encode(t or "") for i, t in enumerate(texts))
    back = {r.doc_id: r for r in decode_ids(encode_texts(df, path), path).collect()}
    assert all(back[i].text == (t or "").replace("\u2581", " ") and back[i].n_tokens == len(rows[i]) for i, t in enumerate(texts))
    assert encode_texts(df.where("false"), path).count() == 0 and SuffixArrayModel(path).encode([]) == []


def test_sentencepiece_long_words_take_log_linear_time():
    import time

    import sentencepiece

    path = str(tokenizers.path("piece_bpe_32k.model"))
    sp, model, r = sentencepiece.SentencePieceProcessor(model_file=path), SuffixArrayModel(path), random.Random(3)
    for alphabet, n in (("ab", 3000), ("etaoinshrdlu", 5000), ("ABCDEFghijkl0123456789+/", 20000), ("日本語é", 4000), ("a", 2000), ("thein", 129)):
        word = "".join(r.choice(alphabet) for _ in range(n))
        assert model.encode([word.encode(), f"x {word} y".encode()])[0].tolist() == sp.encode(word), alphabet
    whole = "".join(r.choice("ABCDEFghijkl0123456789+/") for _ in range(1 << 20))
    began = time.process_time()
    ids = model.encode([whole.encode()])[0]
    assert time.process_time() - began < 60 and model.decode(ids.tolist()) == whole
